"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import steps, to_batch
from tesselith.llm.word_tokens import ENCODE_BYTES, vocabulary


def _byte_letters() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that encode alone as exactly one token.

    Every vocabulary string that can end a word is turned back into text, taken
    only if the splitter gives it back as one pre-token, and encoded by the
    library; it is proven when a single id comes out. At most one entry per
    vocabulary string, so the table is safe to broadcast.
    """
    own, letters = vocabulary(path), _byte_letters()
    tried = []
    for s in own.strings:
        if own.suffix and s.endswith(own.suffix):
            try:
                word = bytes(letters[c] for c in s[: -len(own.suffix)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and own.words(word) == [word]:
                tried.append(word)
    return frozenset(w for w, ids in zip(tried, own.encode_words(tried), strict=True) if len(ids) == 4)


_merged: dict[str, dict[str, int]] = {}


def count_tokens(texts: list[str | None], path: str, single: frozenset[str]) -> list[int]:
    """Tokens of each text: matches of the table count one each, only other words are merged."""
    own, merged = vocabulary(path), _merged.setdefault(path, {})
    out, rest = [], []
    for t in texts:
        words = own.words(t or "")
        rest.append([w for w in words if w not in single])
        out.append(len(words) - len(rest[-1]))
    missing = own.lacking(set().union(*rest), merged)
    merged.update(zip(missing, (len(x) // 4 for x in own.encode_words(missing)), strict=True))
    return [n + sum(map(merged.__getitem__, x)) for n, x in zip(out, rest, strict=True)]


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle: each partition is counted where it is read. A null text counts
    as empty (0, 0, false); a null id stays null; repeated rows give repeated
    rows; other columns are not read; an empty table gives an empty table.
    Texts of any length are counted whole.
    """
    single = df.sparkSession.sparkContext.broadcast(whole_tokens(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", ENCODE_BYTES):
                n = np.array(count_tokens(part.column("text").to_pylist(), path, single.value), np.int64)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield to_batch({"doc_id": part.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}, schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
