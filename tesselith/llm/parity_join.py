"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import join_counted, release, remove, steps, stored, to_batch
from tesselith.llm.components import connected_components

#: A size band reaches to this multiple of its least size.
BAND_RATIO = 1.4
#: Bands' least sizes, up to sets of 10 ** 12 shingles.
LARGEST = 10**12
#: A set leaves out its SPARE_SHARE of the largest difference, plus one, of keys that most sets have.
SPARE_SHARE = 0.1
#: A key's number of sets is counted as far as this.
FREQUENT = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the MurmurHash3 finaliser's fixed constants)."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


#: By byte: whether it ends words; its value in a word's hash, that of the small letter for A-Z.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUES = mix(np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, in order, and how many words each text has.

    Words are runs of bytes other than ASCII white space, with A-Z in lower
    case; a word's hash mixes the sum of its bytes' values times powers of a
    constant.
    """
    global _powers
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] |= solid[starts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.cumsum(solid)[begin] - 1
    sizes = np.diff(np.append(at, int(solid.sum())))
    while len(_powers) <= sizes.max():
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _STEP)])
    values = _VALUES[data[solid]]
    values *= _powers[np.arange(len(values)) - np.repeat(at, sizes)]
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    return mix(np.add.reduceat(values, at) + sizes.astype(np.uint64)), counts


def shingle_sets(texts: Iterable[str | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words, as sorted 64-bit hashes.

    A text with fewer words is one shingle; one without words has none.
    """
    flat, counts = word_hashes([(t or "").encode() for t in texts])
    full = _combined(flat, size)  # of all texts at once; those that reach into the next text are not used
    out, end = [], 0
    for n in counts.tolist():
        end += n
        found = full[end - n : end - size + 1] if n >= size else _combined(flat[end - n : end], n)
        out.append(np.unique(found) if n else flat[:0])
    return out


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` hashes in a row."""
    n = max(len(hashes) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for i in range(width if n else 0):
        out = mix(out ^ hashes[i : i + n]) + np.uint64(i + 1)
    return out


class Bands:
    """Size bands, and for each the parts of the sketch that the threshold asks for.

    Sets of sizes a and b link when per * |both| >= part * |either|, so their
    symmetric difference is (per - part) / (per + part) * (a + b) at most.
    """

    def __init__(self, part: int, per: int):
        self.part, self.per = part, per
        self.lows = [1]
        while self.lows[-1] <= LARGEST:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND_RATIO)))
        #: The largest symmetric difference of a linked pair whose smaller set is in the band.
        self.most = [(per - part) * (top + top * per // part) // (per + part) for top in (x - 1 for x in self.lows[1:])]
        #: Shared keys that each of the two sets may leave out, and the pair is found still.
        self.spare = [int(SPARE_SHARE * d) + 1 for d in self.most]
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def of(self, n: int) -> range:
        """Bands in which a set of n looks for partners: its own, and those of smaller partners."""
        return range(self.band(-(-self.part * n // self.per)), self.band(n) + 1)

    def shape(self, b: int) -> tuple[int, int]:
        """Parts of the band's sketch, and how many of a set's keys are kept.

        A linked pair differs in `most` parts at most. The others number one and
        the spare ones and the left-out ones, which are so many that few sets have
        more empty parts (by three deviations of a random set of the least size).
        """
        if b not in self.known:
            kept = self.most[b] + 1 + self.spare[b]

            def enough(left: int) -> bool:
                empty = (kept + left) * math.exp(-self.lows[b] / (kept + left))
                return left >= empty + 3 * math.sqrt(empty)

            low, high = 0, 2 * kept + 4
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if enough(mid) else (mid + 1, high)
            self.known[b] = kept + low, kept
        return self.known[b]


def pigeonhole_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The 64-bit keys of a set, the last byte their band; linked sets that are not equal share over `spare` of one band.

    In each band the sketch has 2 ** 64 bits, of which a shingle flips the one
    that its hash names, and is cut into parts. The sketches of two sets differ
    in no more parts than their symmetric difference has shingles. A part is kept
    as the exclusive or of random numbers of its bits that are set, so equal parts
    have equal keys. A set leaves out its emptiest keys. That order depends on
    the keys alone, so of the keys that two sets share, those that either leaves
    out are the least ones, which one of the two leaves out all by itself: no more
    than it may.
    """
    out = []
    high, bits = shingles >> np.uint64(32), mix(shingles)
    for b in bands.of(len(shingles)):
        if not bands.most[b]:  # only equal sets link here
            continue
        n, kept = bands.shape(b)
        parts = ((high * np.uint64(n)) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes are
        begin = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
        words, held = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        words[parts[begin]] = np.bitwise_xor.reduceat(bits, begin)
        held[parts[begin]] = np.minimum(np.diff(np.append(begin, len(parts))), 255)
        keys = mix(words ^ mix(np.arange(n, dtype=np.uint64) + np.uint64((b + 1) << 40))) >> np.uint64(8)
        keys |= (np.uint64(255) - held) << np.uint64(56)
        out.append(np.partition(keys, kept - 1)[:kept] << np.uint64(8) | np.uint64(b))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, part: int, per: int) -> bool:
    """The exact test on two sets of sorted hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return per * both >= part * (len(a) + len(b) - both) and both > 0


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """A sketch of two to four bits a shingle: a power of two, so that a longer one folds to a shorter."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    at = np.sort((shingles >> np.uint64(8)) & np.uint64(bits - 1))
    place = (at >> np.uint64(6)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out = np.zeros(bits // 64, np.uint64)
    out[place[begin]] = np.bitwise_xor.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch, or rows of sketches, shortened to so many words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def may_link(a_size, b_size, differ, part: int, per: int):
    """Whether sizes and a lower bound of the symmetric difference leave a link possible."""
    total = a_size + b_size
    return (per * np.minimum(a_size, b_size) >= part * np.maximum(a_size, b_size)) & ((per + part) * differ <= (per - part) * total)


#: Members of a family, and bytes of their sketches, that are compared at a time; a larger one is compared piece by piece.
PIECE, PIECE_BYTES = 4096, 1 << 26
#: Bytes of text whose keys a task makes at a time, keys among which it looks for frequent ones, and documents for which keys get a partition.
KEY_STEP, KEY_BLOCK, KEY_DOCS = 1 << 20, 1 << 21, 8000
#: Sets that a task remembers to have made keys for.
SEEN = 200_000
#: Rows with texts, and with whole sets, that go to Python at a time.
TEXT_ROWS, SET_ROWS = 1000, 500
#: Ids of documents whose sets are fetched by broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A row is a document (doc, mark, digest, n, sketch) or a class that has a key with others (key, frequent: the classes that have it, FREQUENT at most).
#: A class of equal sets goes by the first eight bytes of its digest; two that share them are joined as two.
ROWS = "key long, frequent int, class long, doc long, mark long, digest binary, n long, sketch binary"
ROW_SCHEMA = pa.schema([("key", pa.int64()), ("frequent", pa.int32()), ("class", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())])
KEY_SCHEMA = pa.schema([("key", pa.int64()), ("value", pa.int64()), ("extra", pa.binary())])


def _spread(n: int, seed: int) -> np.ndarray:
    """Keys of rows that may go to any task."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(abs(seed))).view(np.int64)


def _key_rows(keys: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of a block of keys; of a key that is frequent already here, those beyond FREQUENT skip the sort, with the key in `extra`."""
    k, c = np.concatenate(keys).view(np.int64), np.concatenate(classes)
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    k, c = k[fresh], c[fresh]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))
    beyond = np.arange(len(k)) - np.repeat(start, size) >= FREQUENT
    if beyond.any():
        yield to_batch({"key": _spread(int(beyond.sum()), int(c[0])), "value": c[beyond], "extra": [x.tobytes() for x in k[beyond]]}, KEY_SCHEMA)
        k, c = k[~beyond], c[~beyond]
    for j in range(0, len(k), 1 << 18):
        yield to_batch({"key": k[j : j + (1 << 18)], "value": c[j : j + (1 << 18)], "extra": pa.nulls(len(k[j : j + (1 << 18)]), pa.binary())}, KEY_SCHEMA)


def _keys(size: int, part: int, per: int):
    """Documents to key rows, and a row with everything else in `extra`; equal sets have keys once a task, mostly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held, keys, values = Bands(part, per), set(), 0, [], []
        for batch in batches:
            for piece in steps(batch, "text", KEY_STEP):
                ids, sets = piece.column("doc").to_pylist(), shingle_sets(piece.column("text").to_pylist(), size)
                marks, extra = piece.column("mark").to_numpy(), []
                for i, x, mark in zip(ids, sets, marks, strict=True):
                    digest = xxhash.xxh3_128_digest(x.tobytes())
                    extra.append(digest + len(x).to_bytes(8, "little") + mark.tobytes() + (parity_sketch(x).tobytes() if len(x) else b""))
                    if i is not None and len(x) and digest not in seen:
                        seen.add(digest)
                        keys.append(pigeonhole_keys(x, bands))
                        values.append(np.full(len(keys[-1]), int.from_bytes(digest[:8], "big", signed=True)))
                        held += len(keys[-1])
                # documents go to any task: they are only written there
                yield to_batch({"key": _spread(len(ids), hash((ids[0], len(ids)))), "value": pa.array(ids, pa.int64()), "extra": extra}, KEY_SCHEMA)
                if len(seen) > SEEN:
                    seen.clear()
                if held >= KEY_BLOCK:
                    yield from _key_rows(keys, values)
                    held, keys, values = 0, [], []
        if held:
            yield from _key_rows(keys, values)
        release()

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted key rows to the members of runs of two classes or more, with the run's size as far as FREQUENT; other rows pass through."""
    none = np.empty(0, np.int64)
    held = none, none  # a run of less than FREQUENT so far, not given out
    last: tuple | None = None  # the last row, for a class has rows of several tasks
    long: int | None = None  # the key of a longer run, of which a part has been given out
    blank = {f.name: f.type for f in ROW_SCHEMA}

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return to_batch({c: pa.nulls(n, t) for c, t in blank.items()} | columns, ROW_SCHEMA)

    for batch in batches:
        plain = batch.column("extra").is_null()
        own, rest = batch.filter(pc.invert(plain)), batch.filter(plain)
        if len(own):
            beyond = pc.equal(pc.binary_length(own.column("extra")), 8)
            skipped, own = own.filter(beyond), own.filter(pc.invert(beyond))
            if len(skipped):
                yield rows(key=np.frombuffer(b"".join(skipped.column("extra").to_pylist()), np.int64), frequent=np.full(len(skipped), FREQUENT, np.int32), **{"class": skipped.column("value")})
            data = own.column("extra").to_pylist()
            if data:
                sizes = np.frombuffer(b"".join(x[16:32] for x in data), np.int64).reshape(-1, 2)
                yield rows(doc=own.column("value"), mark=sizes[:, 1], digest=[x[:16] for x in data], n=sizes[:, 0], sketch=[x[32:] for x in data])
        if not len(rest):
            continue
        k, c = rest.column("key").to_numpy(), rest.column("value").to_numpy()
        fresh = np.append((k[0], c[0]) != last, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        last = k[-1], c[-1]
        k, c = np.append(held[0], k[fresh]), np.append(held[1], c[fresh])
        if not len(k):
            continue
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        size[0] += FREQUENT if k[0] == long else 0
        keep = size > 1
        if size[-1] < FREQUENT:
            held, long, keep[-1] = (k[start[-1] :], c[start[-1] :]), None, False
        else:
            held, long = (none, none), k[-1]
        lengths = np.diff(np.append(start, len(k)))
        given = np.repeat(keep, lengths)
        if given.any():
            yield rows(key=k[given], frequent=np.minimum(np.repeat(size, lengths)[given], FREQUENT).astype(np.int32), **{"class": c[given]})
    release()
    if len(held[0]) > 1:
        yield rows(key=held[0], frequent=np.full(len(held[0]), len(held[0]), np.int32), **{"class": held[1]})


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """Sketches or sets, from their bytes."""
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _by_sketch(part: int, per: int):
    """Pairs (a, b, each with n and sketch) to those that sizes and sketches leave possible."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _numbers(batch.column("a_sketch")), _numbers(batch.column("b_sketch"))
            differ = np.array([int(np.bitwise_count(fold(p, min(len(p), len(q))) ^ fold(q, min(len(p), len(q)))).sum()) for p, q in zip(x, y, strict=True)], np.int64)
            keep = may_link(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), differ, part, per)
            yield to_batch({c: batch.column(c).filter(pa.array(keep)) for c in "ab"}, schema)

    return run


def _across(part: int, per: int):
    """Members sorted by (pivot, i, j), with their sets, to links between the components of a family; a link that no longer joins two is left out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own, comp, n, piece = (rows.column(c).to_numpy() for c in ("class", "component", "n", "piece"))
        label, of, members = np.unique(comp, return_inverse=True, return_counts=True)
        if len(label) < 2:
            return
        # members of the largest component meet the others only, so these are gone through
        place = np.argsort(-members, kind="stable").argsort(kind="stable")[of]
        pivot, i, j = (rows.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        sketch, sets = _numbers(rows.column("sketch")), _numbers(rows.column("set"))
        words = np.array(list(map(len, sketch)))
        groups = {}  # words, and members with so many: their numbers, their sketches
        for w in np.unique(words).tolist():
            at = np.flatnonzero((words == w) & (own != pivot))  # the pivot has met every member
            groups[w] = at, np.stack([sketch[x] for x in at]) if len(at) else np.empty((0, w), np.uint64)
        parent = list(range(len(label)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for x in np.flatnonzero((place > 0) & (own != pivot)).tolist():
            for w, (at, held) in groups.items():
                near = (place[at] < place[x]) & (per * np.minimum(n[at], n[x]) >= part * np.maximum(n[at], n[x]))
                if i != j:
                    near &= piece[at] != piece[x]
                if near.any():
                    shorter = min(w, len(sketch[x]))
                    differ = np.bitwise_count(fold(sketch[x], shorter) ^ fold(held[near], shorter)).sum(axis=1).astype(np.int64)
                    able = may_link(n[x], n[at[near]], differ, part, per)
                    order = np.argsort(differ[able], kind="stable")
                    for y in at[near][able][order].tolist():
                        if root(of[x]) != root(of[y]) and linked(sets[x], sets[y], part, per):
                            parent[root(of[x])] = root(of[y])
                            links.append((own[x], own[y]))
        if links:
            a, b = np.array(links, np.int64).T
            yield to_batch({"a": a, "b": b}, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("pivot", "i", "j")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if begin == end:
                    continue
                group = tuple(int(x[begin]) for x in names)
                if group != last and held:
                    yield from found(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = group
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())
        del held
        release()

    return run


def _sets_of(wanted: DataFrame, texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and its whole set, made anew from the text of its first document, for the classes asked for; stored."""
    named, path = stored(wanted.distinct().join(classes.select("class", "rep", "digest"), "class").withColumnRenamed("rep", "doc"), "parity-wanted")
    ids = named.select("doc").distinct()
    set_schema = pa.schema([("doc", pa.int64()), ("digest", pa.binary()), ("set", pa.binary())])

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for piece in steps(batch, "text"):
                own = [x.tobytes() for x in shingle_sets(piece.column("text").to_pylist(), size)]
                rows = [(i, xxhash.xxh3_128_digest(x), x) for i, x in zip(piece.column("doc").to_pylist(), own, strict=True)]
                rows = [r for r in rows if r[:2] not in seen and not seen.add(r[:2])]
                if len(seen) > SEEN:
                    seen.clear()
                if rows:
                    yield to_batch(dict(zip(set_schema.names, zip(*rows, strict=True), strict=True)), set_schema)
        release()

    # an id may have several texts, of which the classes are told by digest; a text may be there several times
    count = named.count()
    read = texts.select("doc", "text").join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc").mapInArrow(sets, "doc long, digest binary, set binary")
    known, known_path = stored(read.join(named, ["doc", "digest"]).select("class", "set"), "parity-sets", TEXT_ROWS)
    if known.count() > count:  # a row that is there several times
        once, _ = stored(known.dropDuplicates(["class"]), "parity-sets")
        remove(wanted.sparkSession, known_path)
        known = once
    remove(wanted.sparkSession, path)
    return known


def _verify(pairs: DataFrame, known: DataFrame, part: int, per: int) -> DataFrame:
    """The pairs (a, b: classes) whose whole sets link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _numbers(batch.column("a_set")), _numbers(batch.column("b_set"))
            keep = pa.array([linked(p, q, part, per) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield to_batch({c: batch.column(c).filter(keep) for c in "ab"}, schema)
        release()

    first = pairs.join(known.select(F.col("class").alias("a"), F.col("set").alias("a_set")), "a")
    both = first.join(known.select(F.col("class").alias("b"), F.col("set").alias("b_set")), "b")
    return stored(both.select("a", "b", "a_set", "b_set").mapInArrow(test, "a long, b long").distinct(), "parity-links", SET_ROWS)[0]


def linked_classes(df: DataFrame, size: int, part: int, per: int, id_col: str, text_col: str, one_per_id: bool) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: documents, a row per input row (doc, mark, n, digest), and classes, one per different set that is not empty.

    Classes have digest, class (its number), copies and component, the least class
    that links reach. With `one_per_id`, the classes of one id are linked as well.
    `mark` is a hash of the text.

    1. One pass over the texts gives every document's size, digest and sketch,
       and the pigeonhole keys of its set (once a task for equal sets). Keys are
       shuffled and sorted; runs of two classes or more are kept. Equal sets are
       one class.
    2. Linked sets share more than `spare` keys of a band, so each class leaves out
       that many of its keys, those that most classes have: one shared key remains.
       Classes with no more shared keys than that fall out altogether.
    3. Each member of a remaining run is paired with the run's first. Sizes and
       sketches (a lower bound of the symmetric difference) exclude most pairs,
       whole sets decide.
    4. Members of the runs that have one first are a family. One that holds several
       components is brought together with its sets, a large one piece against
       piece: pairs across components that pass the same bound take the same test
       there, until the two are joined. So every linked pair is in one component or
       has been tested, and no more than links are given out.
    """
    spark = df.sparkSession
    bands = Bands(part, per)
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.mapInArrow(_keys(size, part, per), "key long, value long, extra binary")
    parts = max(n, -(-texts.count() // KEY_DOCS))
    rows, _ = stored(keyed.repartition(parts, "key").sortWithinPartitions("key", "value").mapInArrow(_runs, ROWS), "parity-rows")
    light = rows.where("n is not null")
    filled = light.where("n > 0 and doc is not null")
    number = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    classes, _ = stored(filled.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("class", number), "parity-classes")

    # each class without the keys that most classes have
    band = F.col("key").bitwiseAND(255).cast("int")
    order = Window.partitionBy("class", "band").orderBy(F.desc("frequent"), "key")
    spare = F.element_at(F.array(*map(F.lit, bands.spare)), F.col("band") + 1)
    shared, shared_path = stored(rows.where("key is not null").select("key", "frequent", "class", band.alias("band")).withColumn("place", F.dense_rank().over(order)).where(F.col("place") > spare).select("key", "class"), "parity-shared")
    runs, runs_path = stored(shared.groupBy("key").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "parity-runs")
    members, members_path = stored(join_counted(shared, runs, "key", "members", shared.count()).select("pivot", "class").distinct(), "parity-members")

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    stars = members.where("pivot != class").select(F.col("pivot").alias("a"), F.col("class").alias("b")).join(side("a"), "a").join(side("b"), "b")
    tried, _ = stored(stars.select("a", "a_n", "a_sketch", "b", "b_n", "b_sketch").mapInArrow(_by_sketch(part, per), "a long, b long").distinct(), "parity-pairs")
    links = _verify(tried, _sets_of(tried.select(F.explode(F.array("a", "b")).alias("class")), texts, classes, size), part, per)
    if one_per_id:
        first = filled.groupBy("doc").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least != most").select("doc")
        same = filled.join(first, "doc").select("doc", "digest").distinct().join(classes.select("digest", "class"), "digest")
        own = same.join(same.groupBy("doc").agg(F.min("class").alias("a")), "doc")
        links = links.unionByName(own.where("a != class").select("a", F.col("class").alias("b")))
    found = connected_components(links)

    # families: the members of runs with one first class, where they lie in several components
    labels = classes.select("class", (F.octet_length("sketch") + 8 * F.col("n")).alias("bytes")).join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed, placed_path = stored(members.join(labels, "class"), "parity-families")
    pieces = F.greatest(F.col("m") / PIECE, F.col("held") / PIECE_BYTES).cast("int")
    families = placed.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("held")).where("low != high and m > 2").select("pivot", "m", pieces.alias("last"))
    several, several_path = stored(join_counted(placed.drop("bytes"), families, "pivot", "m", placed.count()), "parity-several")
    if not several.isEmpty():
        known = _sets_of(several.select("class"), texts, classes, size)
        piece = F.pmod(F.xxhash64("class"), F.col("last") + 1)
        cut = several.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")).cast("array<long>")))
        spread = cut.select("pivot", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "class", "component", "piece").join(classes.select("class", "n", "sketch"), "class").join(known, "class")
        across = spread.repartition(n, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(_across(part, per), "a long, b long")
        joined, joined_path = stored(across, "parity-across", SET_ROWS)
        found = connected_components(links.unionByName(joined))
        remove(spark, joined_path)
    for p in (shared_path, runs_path, members_path, placed_path, several_path):
        remove(spark, p)
    whole = classes.select("digest", "class", "copies").join(found.withColumnRenamed("node", "class"), "class", "left")
    return light.select("doc", "mark", "n", "digest"), whole.withColumn("component", F.coalesce("component", "class"))


def jaccard_components(df: DataFrame, size: int = 5, part: int = 80, per: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when per * |shared shingles| >= part * |all shingles|, of
    `size` words each; component_id is the smallest doc_id reachable by links,
    the document's own included. `linked_classes` says how links are found.

    A text without words, or null, has no shingles and links with nothing; a null
    id has a null component and links with nothing; rows that repeat an id share
    its component; repeated rows give repeated rows; an empty table gives none;
    other columns are not read. Texts must be repeatable (a stored table).
    """
    docs, classes = linked_classes(df, size, part, per, id_col, text_col, one_per_id=True)
    joined = _with_component(docs, classes)
    by_component, _ = stored(joined.groupBy("component").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("held")), "parity-components")
    ids = join_counted(joined.select("doc", "component").distinct(), by_component, "component", "held", docs.count()).select("doc", "least").distinct()
    return docs.join(ids, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def _with_component(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with shingles and an id, and the component of their class, stored."""
    filled = docs.where("n > 0 and doc is not null").select("doc", "mark", "digest")
    return stored(join_counted(filled, classes, "digest", "copies", filled.count()).select("doc", "mark", "component"), "parity-documents")[0]


def keep_one_of_each(df: DataFrame, size: int = 5, part: int = 80, per: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table without near duplicates: one of each group that `linked_classes` finds, that of the smallest id.

    A row is judged by its own text: texts that share an id but are not linked
    both stay, of linked or equal ones the first by hash. A text without words,
    or null, and a row with a null id are in no group and stay. An empty table
    gives none. Columns of any name are kept.
    """
    docs, classes = linked_classes(df, size, part, per, id_col, text_col, one_per_id=False)
    joined = _with_component(docs, classes)
    firsts = joined.groupBy("component").agg(F.min(F.struct("doc", "mark")).alias("first")).select("first.doc", "first.mark")
    rows = joined.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("rows"))
    first, _ = stored(firsts.join(rows, ["doc", "mark"]), "parity-firsts")
    named = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    loose = docs.where("doc is not null and n = 0").select("doc", "mark").distinct()
    out = named.join(first.where("rows = 1").select("doc", "mark").unionByName(loose), ["doc", "mark"], "left_semi")
    repeated = first.where("rows > 1").select("doc", "mark")
    n = repeated.count()
    if n:
        out = out.unionByName(named.join(F.broadcast(repeated) if n <= BROADCAST_IDS else repeated, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"]))
    if not docs.where("doc is null").isEmpty():
        out = out.unionByName(named.where("doc is null"))
    return out.select("row.*")
