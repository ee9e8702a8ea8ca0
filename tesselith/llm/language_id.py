"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import release, steps, to_batch

#: N-grams of one to three characters; so many of the most frequent make a profile, or stand for a document.
RANKS = 400
#: Labelled documents from which a language's profile is learned, about so many at most.
SAMPLE_DOCS = 2_000
UNKNOWN = "und"
#: Bits of a character within an n-gram's code, and the code of the blank around words.
BITS, BLANK = 21, 1
#: Characters of a text whose n-grams are held at a time.
STRETCH = 1 << 20


@lru_cache(maxsize=1)
def _letter_codes() -> np.ndarray:
    """By code point: one more than it for letters and marks, the blank for all else."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in points), bool, len(points)), points + 1, BLANK)


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text's words between blanks, as numbers, each as often as it occurs, a stretch at a time.

    A word is a run of letters and marks in lower case. The blank counts within
    n-grams of two or three, at their ends.
    """
    c = _letter_codes()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    c = np.concatenate([[BLANK], c, [BLANK]])
    c = c[np.append(True, (c[1:] != BLANK) | (c[:-1] != BLANK))]
    for i in range(0, len(c) if len(c) > 2 else 0, STRETCH):
        x = c[i : i + STRETCH + 2]  # two more, for the n-grams that begin in this stretch
        two = x[:-1] << BITS | x[1:]
        three = (two[:-1] << BITS | x[2:])[x[1:-1] != BLANK]
        one = x[:STRETCH]
        yield np.concatenate([one[one != BLANK], two[:STRETCH], three])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams by code, and how often each occurs."""
    out = (np.empty(0, np.int64), np.empty(0, np.int64))
    for grams in gram_codes(text):
        found = np.unique(grams, return_counts=True)
        if len(out[0]):
            keys, at = np.unique(np.concatenate([out[0], found[0]]), return_inverse=True)
            found = keys, np.bincount(at, np.concatenate([out[1], found[1]])).astype(np.int64)
        out = found
    return out


def top_grams(text: str) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:RANKS]]


class Profiles:
    """Each language's rank of every n-gram in any profile; RANKS where a profile lacks it."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.grams = np.array(sorted({g for x in ranked.values() for g in x}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(ranked)), RANKS, np.int32)
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, ranked[language]), k] = np.arange(len(ranked[language]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: first by name), and 1 less its share of the largest."""
        top = top_grams(text) if text and any(map(str.isalpha, text)) else ()
        if not len(top) or not len(self.grams):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        ranks = self.ranks[at]
        out_of_place = np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None])
        distance = np.where(ranks == RANKS, RANKS, out_of_place).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (RANKS * len(top))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn_profiles(df: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from labelled documents that are not held out.

    Each language's sample is drawn by a hash of the id at the rate that gives
    about `sample_docs` documents (all, if there are fewer); their whole texts
    count. What reaches the driver is a count and RANKS n-grams per distinct label.
    """
    labelled = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return Profiles({})
    # a rate as the largest hash that is drawn, so that it is no coarser for many documents
    rate = F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for k, n in sizes.items() for x in (k, (min(sample_docs, n) << 64) // n - (1 << 63) - 1)])
    sample = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.xxhash64("doc_id") <= rate[F.col("lang")])
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                totals: dict[str, list] = {}
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                for text, lang in zip(texts, langs, strict=True):
                    totals.setdefault(lang, []).append(gram_counts(text))
                for lang, found in totals.items():
                    grams, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                    yield to_batch({"lang": [lang] * len(grams), "gram": grams, "n": np.bincount(at, np.concatenate([x[1] for x in found]), len(grams)).astype(np.int64)}, schema)

    summed = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= RANKS)
    ranked: dict[str, list[int]] = {k: [] for k in sizes}
    for r in top.orderBy("lang", "rank").collect():
        ranked[r["lang"]].append(r["gram"])
    return Profiles(ranked)


def identify_language(df: DataFrame, profiles: Profiles | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1). No shuffle but for learning.

    Only the text decides a prediction. `und` with score 0 if the text is null or
    has no letter, or nothing could be learned; a null id is not held out and
    stays null; repeated rows give repeated rows; an empty table gives no rows;
    other columns are not read. Whole texts count, of any length.
    """
    learned = df.sparkSession.sparkContext.broadcast(profiles or learn_profiles(df, id_col=id_col, text_col=text_col, lang_col=lang_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                found = [learned.value.predict(t) for t in part.column("text").to_pylist()]
                yield to_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}, schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def filter_language(df: DataFrame, least: float, profiles: Profiles | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language predicted with this score at least. No shuffle but for learning.

    A null or empty text, and one without a letter, has no language and goes; the
    id does not matter, so rows with a null id and repeated rows are judged each;
    an empty table gives none. Without `profiles`, `doc_id`, `lang` and the text
    of the rows are learned from.
    """
    learned = df.sparkSession.sparkContext.broadcast(profiles or learn_profiles(df, text_col=text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                found = [learned.value.predict(t) for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array([x != UNKNOWN and score >= least for x, score in found], pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
