"""The exact ids of a word-level BPE vocabulary (tokenizers .json), by pre-token.

The library's result for a text is the concatenation of its results for the
text's pre-tokens. Splitting is done here with one regular expression over an
alphabet of characters for which, when the vocabulary is loaded, splitting and
lower-casing are shown to agree with the library. Of a text with any other
character, the stretches between white space that have one are split by the
library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 18
#: Pre-tokens that a process keeps with their ids; beyond it the store starts anew.
KEPT_WORDS = 400_000
#: Stretches of other characters that a process keeps with their pre-tokens, and how long one may be for that.
KEPT_STRETCHES, STRETCH = 100_000, 64
#: Characters tried for the fast alphabet: Latin blocks and general punctuation.
#: None of them composes with another under NFC.
TRIED = [chr(c) for c in (*range(0x00, 0x250), *range(0x2010, 0x2028), 0x20AC, 0x2122)]


class WordVocabulary:
    """A vocabulary file with its proven fast alphabet and a bounded store of encoded words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.strings = vocab
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if self.suffix and s.endswith(self.suffix)]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._prove()
        self.store: dict[str | tuple[str], bytes] = {}
        self.foreign: dict[str, list[str | tuple[str]]] = {}

    def _prove(self) -> None:
        kinds: dict[str, list[str]] = {"letter": [], "number": [], "space": [], "other": []}
        cut = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        for c in TRIED:
            low, norm = c.lower(), self.library.normalizer.normalize_str(f"a{c}b")
            blank = norm == "a b"
            if len(low) != 1 or not (blank or norm == f"a{low}b"):
                continue
            pieces = cut(f"a{low}b")
            if blank:
                kinds["space"].append(c)
            elif pieces == 1:
                kinds["letter"] += {c, low}
            elif pieces == 3:
                kinds["number" if cut(low + low) == 2 else "other"] += {c, low}
        own = {k: "".join(map(re.escape, sorted(set(v)))) for k, v in kinds.items()}
        self.letters, self.numbers, self.spaces = own["letter"], own["number"], own["space"]
        self._cut = re.compile(f"[{own['space']}]+").split
        self._known = re.compile(f"[{''.join(own.values())}]*").fullmatch
        #: The vocabulary's own split, fixed by its file, over the proven classes; letters
        #: come first, for no other alternative begins with one.
        self._split = re.compile(rf"[{own['letter']}]+|[{own['number']}]|'(?:s|t|re|ve|m|ll|d)|[^{own['space']}{own['letter']}{own['number']}]+").findall

    def words(self, text: str) -> list[str | tuple[str]]:
        """The text's pre-tokens; a stretch that only the library can take whole is a tuple of itself.

        Neither normalising nor a special token reaches over white space.
        """
        if self._known(text) and not any(s in text for s in self.special):
            return self._split(text.lower())
        out: list[str | tuple[str]] = []
        for piece in self._cut(text):
            if any(s in piece for s in self.special):
                out.append((piece,))
            elif self._known(piece):
                out += self._split(piece.lower())
            else:
                out += self._by_library(piece)
        return out

    def _by_library(self, piece: str) -> list[str | tuple[str]]:
        """A stretch's pre-tokens, if each is the library's pre-token of itself."""
        found = self.foreign.get(piece)
        if found is None:
            plain = self.library.normalizer.normalize_str(piece)
            found = [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            if any(self.library.normalizer.normalize_str(w) != w for w in found):
                found = [(piece,)]
            if len(piece) <= STRETCH:
                if len(self.foreign) >= KEPT_STRETCHES:
                    self.foreign.clear()
                self.foreign[piece] = found
        return found

    def encode_words(self, words: list[str | tuple[str]]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers; several hundred a call, cut where a word's last piece ends."""
        out: list[bytes] = []
        alone = lambda w: np.array(self.library.encode(w if isinstance(w, str) else w[0], add_special_tokens=False).ids, "<u4").tobytes()
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            if all(isinstance(w, str) for w in part):
                ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
                at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(at) == len(part) and at[-1] == 4 * len(ids):
                    data = ids.tobytes()
                    out += [data[a:b] for a, b in zip([0, *at], at)]
                    continue
            out += map(alone, part)
        return out

    def learn(self, words: set[str | tuple[str]]) -> None:
        """Puts the ids of every word given into the store."""
        missing = self.lacking(words, self.store)
        self.store.update(zip(missing, self.encode_words(missing), strict=True))

    @staticmethod
    def lacking(words: set[str | tuple[str]], store: dict) -> list[str | tuple[str]]:
        """The words, in order, that a bounded store lacks; it is emptied first if they would not fit."""
        missing = [w for w in words if w not in store]
        if len(store) + len(missing) > KEPT_WORDS:
            store.clear()
            missing = list(words)
        return sorted((w for w in missing if isinstance(w, str))) + sorted(w for w in missing if not isinstance(w, str))

    def forget(self) -> None:
        """Empties the stores."""
        self.store.clear()
        self.foreign.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        split = [self.words(t or "") for t in texts]
        self.learn(set().union(*split))
        get = self.store.__getitem__
        return [b"".join(map(get, x)) for x in split]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One vocabulary per process and path."""
    return WordVocabulary(path)
