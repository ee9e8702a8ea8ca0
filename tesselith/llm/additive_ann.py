"""Approximate nearest neighbours by additive quantisation, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.llm.common import stored, to_batch

#: Codebooks, words of each, partial sums kept by the encoder, vectors the codebooks are fitted on at most.
CODEBOOKS, WORDS, BEAM, SAMPLE = 40, 32, 4, 16_384
#: Candidates a query is first reranked with; vectors and bytes of them that one scoring task holds; queries it scores at a time.
RERANK, HELD, HELD_BYTES, QUERIES = 200, 131_072, 1 << 26, 256
#: More than single precision takes from an approximate score.
SLACK = 1e-5


class AdditiveQuantiser:
    """A unit vector as a sum of one full-dimensional word of every codebook."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # codebook, word, dimension
        self.squares = (self.books**2).sum(axis=2)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = CODEBOOKS, words: int = WORDS, seed: int = 0) -> AdditiveQuantiser:
        """k-means of what the codebooks before leave over, then all words anew by least squares."""
        rng = np.random.default_rng(seed)
        words = min(words, len(x))
        rest, out = x.copy(), []
        for _ in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(8):
                near = (2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                sums = np.add.reduceat(rest[order], np.searchsorted(near[order], np.flatnonzero(n)), axis=0)
                centres[n > 0] = sums / n[n > 0, None]
            near = (2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
            rest = rest - centres[near]
            out.append(centres)
        own = cls(np.stack(out))
        codes = own.encode(x)[0] + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        for i in range(books):
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1.0)
        right = np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
        prior = own.books.reshape(books * words, -1)
        solved = np.linalg.solve(gram + np.eye(len(gram)), right + prior)  # words without members stay
        return cls(solved.reshape(books, words, -1))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search, and the norm of each vector's sum of words."""
        codes, norms = [], []
        for i in range(0, len(x), 512):
            c, left = self._beam(x[i : i + 512], beam)
            codes.append(c)
            norms.append(np.sqrt(((x[i : i + 512] - left) ** 2).sum(axis=1)))
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.empty((0, len(self.books)), np.int64), np.empty(0, np.float32))

    def _beam(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, words = len(x), self.books.shape[1]
        rest, codes = x[:, None, :], np.empty((n, 1, 0), np.int64)
        rows = np.arange(n)[:, None]
        for m, book in enumerate(self.books):
            cost = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + self.squares[m]
            cost = cost.reshape(n, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            from_, word = best // words, best % words
            rest = rest[rows, from_] - book[word]
            codes = np.concatenate([codes[rows, from_], word[:, :, None]], axis=2)
        least = (rest**2).sum(axis=2).argmin(axis=1)
        return codes[rows[:, 0], least], rest[rows[:, 0], least]

    def likeness(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The cosine of each unit vector and its sum of words; -1 where that is about zero."""
        total = np.zeros(x.shape)
        for book, code in zip(self.books, np.asarray(codes).T, strict=True):
            total += book[code]
        norms = np.sqrt((total**2).sum(axis=1))
        return np.where(norms > 1e-3, (x * total).sum(axis=1) / np.maximum(norms, 1e-3), -1.0)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Each query's dot product with every word: query, codebook * word."""
        return (queries @ self.books.reshape(-1, self.books.shape[2]).T).astype(np.float32)


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; of equal scores at the border the first places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    border = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > border)
    return np.concatenate([over, np.flatnonzero(scores == border)[: k - len(over)]])


def nearest_held(query: np.ndarray, x: np.ndarray, reps: np.ndarray, near: np.ndarray, like: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k nearest of `x`; of equal scores the smaller reps.

    A vector at angle t from its sum of words (`like` is the cosine of t) is no
    nearer to the query than the sum's own angle less t. The `rerank` best by that
    bound are scored exactly, then, in growing blocks, all whose bound reaches the
    k-th exact score so far.
    """
    near = np.clip(near.astype(np.float64) + SLACK, -1.0, 1.0)
    bound = np.where(near < like, near * like + np.sqrt((1 - near**2) * np.maximum(1 - like**2, 0.0)), 1.0) + SLACK
    at = best_places(near, max(rerank, k))
    scores = (x[at] * query).sum(axis=1)

    def first(at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((reps[at], -scores))[:k]
        return at[order], scores[order]

    bound[at] = -2.0  # scored
    at, scores = first(at, scores)
    more = np.flatnonzero(bound >= max(scores[-1], -1.5))
    more = more[np.argsort(-bound[more], kind="stable")]
    i, step = 0, rerank
    while i < len(more) and bound[more[i]] >= scores[-1]:
        part = more[i : i + step]
        at, scores = first(np.concatenate([at, part]), np.concatenate([scores, (x[part] * query).sum(axis=1)]))
        i, step = i + step, min(2 * step, 8192)
    return at, scores


def _clean(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """vec_id and the vector's bytes, of the rows that take part."""
    element = df.schema[vec_col].dataType.elementType
    kind = np.dtype("<f4") if isinstance(element, T.FloatType) else np.dtype("<f8")
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            x = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # a null is not a number here
            bounds = lists.offsets.to_numpy().astype(np.int64)
            within = lambda flags: np.diff(np.append(0, np.cumsum(flags))[bounds])  # noqa: B023, E731
            keep = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False) & (within(~np.isfinite(x)) == 0) & (within(x != 0) > 0)
            starts, sizes = bounds[:-1][keep], np.diff(bounds)[keep]
            ends = np.cumsum(sizes)
            data = x[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            buffers = [None, pa.py_buffer(np.append(0, ends * kind.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())]
            yield to_batch({"vec_id": ids.filter(pa.array(keep)), "vec": pa.Array.from_buffers(pa.binary(), len(sizes), buffers)}, schema)

    rows, _ = stored(df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "vec_id long, vec binary"), "ann-rows")
    sizes = rows.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.octet_length("vec") == (sizes["size"] if sizes else 0)), kind


def _exact_unit(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    """n vectors, one after another, at length 1 in double precision."""
    x = np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x


def _unit(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return _exact_unit(b"".join(column.to_pylist()), len(column), kind).astype(np.float32)


def nearest_neighbours(df: DataFrame, every: int = 50, k: int = 5, rerank: int = RERANK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine of each row whose vec_id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score (double precision, on the
    original vectors); equal scores go by the smaller vec_id.

    Equal vectors are one candidate with their k + 1 smallest ids, found with a
    limit before the shuffle, so copies do not crowd others out. The quantiser is
    fitted on SAMPLE distinct vectors at most (drawn by hash); every distinct
    vector is encoded. Scoring tasks hold HELD vectors each, with their codes, and
    stream the query blocks past them; each gives a query's nearest of its own,
    scored exactly: the `rerank` best by table look-ups, and all others that the
    error of their codes does not exclude. Nothing near is lost, however many near
    copies there are; those cost exact scores. Work is queries times rows.

    Null ids and vectors that are null, empty, zero or have a null or non-finite
    component take no part, nor do vectors of another dimension than the most
    frequent one. Repeated rows count once. Fewer rows than k + 1 give all; an
    empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    rows, kind = _clean(df, id_col, vec_col)
    first = Window.partitionBy("vec").orderBy("vec_id")
    distinct, _ = stored(rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "vec", "ids"), "ann-distinct")
    queries, _ = stored(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("mark"), "vec").distinct(), "ann-queries")
    count = distinct.count()
    sample = distinct.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(count, 1)) * 1_000_000)).select("vec").toArrow().column("vec").combine_chunks()
    if not len(sample):  # too few rows for the rate to draw any
        sample = distinct.select("vec").limit(WORDS).toArrow().column("vec").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = spark.sparkContext.broadcast(AdditiveQuantiser.fit(_unit(sample, kind)))
    wide = len(sample[0].as_py()) // kind.itemsize
    tasks = max(-(-count // max(min(HELD, HELD_BYTES // (8 * wide)), 1)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 2048)))

    # kind 0: a candidate's code, vector and likeness; kind 1: a block of queries, for every task
    row = pa.schema([("task", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("data", pa.binary()), ("vec", pa.binary()), ("norm", pa.float32()), ("like", pa.float64())])
    row_ddl = "task int, kind int, id long, mark long, data binary, vec binary, norm float, like double"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.column("vec"), kind)
            codes, norms = quantiser.value.encode(x)
            yield to_batch({"task": batch.column("task"), "kind": np.zeros(len(batch), np.int32), "id": batch.column("rep"), "mark": batch.column("mark"), "data": [c.tobytes() for c in np.asarray(codes, np.uint8)], "vec": batch.column("vec"), "norm": np.asarray(norms, np.float32), "like": quantiser.value.likeness(x, codes)}, row)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), QUERIES):
                part = batch.slice(i, QUERIES)
                data = np.asarray(part.column("query_id")).tobytes() + np.asarray(part.column("mark")).tobytes() + b"".join(part.column("vec").to_pylist())
                yield to_batch({"task": [0], "kind": [1], "id": [len(part)], "mark": [0], "data": [data], "vec": [None], "norm": [0.0], "like": [0.0]}, row)

    index = distinct.select(F.pmod(F.xxhash64("rep"), F.lit(tasks)).cast("int").alias("task"), "rep", F.xxhash64("vec").alias("mark"), "vec").mapInArrow(encode, row_ddl)
    asked = queries.mapInArrow(blocks, row_ddl).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select("task", "kind", "id", "mark", "data", "vec", "norm", "like")
    found_schema = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("reps", pa.list_(pa.int64())), ("owns", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, held, index_ = quantiser.value, None, [], None
        words = own.books.shape[1]
        for batch in batches:
            for row_ in batch.to_pylist():  # by task: its codes, then the query blocks
                if row_["task"] != task:
                    task, held, index_ = row_["task"], [], None
                if row_["kind"] == 0:
                    held.append((row_["id"], row_["data"], row_["norm"], row_["vec"], row_["like"], row_["mark"]))
                    continue
                if not held and index_ is None:
                    continue
                if index_ is None:
                    codes = np.frombuffer(b"".join(x[1] for x in held), np.uint8).reshape(len(held), -1).astype(np.int64) + np.arange(own.books.shape[0]) * words
                    index_ = np.array([x[0] for x in held]), np.ascontiguousarray(codes.T), np.array([x[2] for x in held], np.float32), _exact_unit(b"".join(x[3] for x in held), len(held), kind), np.array([x[4] for x in held]), np.array([x[5] for x in held])
                    held = []
                reps, codes, norms, exact, like, owns = index_
                n = row_["id"]
                ids, marks = np.frombuffer(row_["data"][: 16 * n], np.int64).reshape(2, n)
                asked_ = _exact_unit(row_["data"][16 * n :], n, kind)
                best, own_marks, values = [], [], []
                for query, table in zip(asked_, own.tables(asked_.astype(np.float32)), strict=True):
                    got = table[codes[0]]
                    for c in codes[1:]:
                        got += table[c]
                    got /= np.maximum(norms, 1e-12)
                    at, scores = nearest_held(query, exact, reps, got, like, k + 1, rerank)
                    best.append(reps[at])
                    own_marks.append(owns[at])
                    values.append(scores)
                yield to_batch({"query_id": ids, "mark": marks, "reps": best, "owns": own_marks, "scores": values}, found_schema)

    held_rows = index.unionByName(asked).repartition(tasks, "task").sortWithinPartitions("task", "kind", "id")
    found = held_rows.mapInArrow(score, "query_id long, mark long, reps array<long>, owns array<long>, scores array<double>")
    query = ("query_id", "mark")
    pairs = found.select(*query, F.explode(F.arrays_zip("reps", "owns", "scores")).alias("x")).select(*query, F.col("x.reps").alias("rep"), F.col("x.owns").alias("own"), F.col("x.scores").alias("score"))
    best = Window.partitionBy(*query).orderBy(F.desc("score"), "rep", "own")
    pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id"))
    scored = pairs.join(distinct.select("rep", F.xxhash64("vec").alias("own"), "ids"), ["rep", "own"]).select(*query, "own", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id or mark != own")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
