"""Packing of token sequences, balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import release, steps, to_batch
from tesselith.llm.word_tokens import ENCODE_BYTES, vocabulary

#: Tokens that one window packs together: bounds memory, and the padding is a fixed few sequences a window.
WINDOW_TOKENS = 4 << 20
#: Cost of a piece of n tokens: LINEAR * n for the projections, plus n * n for attention within the piece.
LINEAR = 4096


class CheapestFit:
    """Open sequences in a tree over remaining capacity, each leaf a heap by cost.

    cheapest(n) gives the lowest-cost sequence with room for n tokens (ties: the
    lower number) in time logarithmic in the capacity.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[int, int] | None] = [None] * (2 * self.size)

    def _lift(self, room: int) -> None:
        i = self.size + room
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else None
        while i > 1:
            i //= 2
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if b is None or (a is not None and a <= b) else b

    def put(self, room: int, cost: int, number: int) -> None:
        import heapq

        if room:
            heapq.heappush(self.heaps[room], (cost, number))
            self._lift(room)

    def cheapest(self, n: int) -> tuple[int, int, int] | None:
        """Takes out (room, cost, number), or gives None if nothing has the room."""
        import heapq

        low, high, best = self.size + n, 2 * self.size, None
        while low < high:
            for i in ((low,) if low & 1 else ()) + ((high - 1,) if high & 1 else ()):
                if self.tree[i] is not None and (best is None or self.tree[i] < best[0]):
                    best = (self.tree[i], i)
            low, high = (low + 1) // 2, high // 2
        if best is None:
            return None
        key, i = best
        while i < self.size:
            i = 2 * i if self.tree[2 * i] == key else 2 * i + 1
        heapq.heappop(self.heaps[i - self.size])
        self._lift(i - self.size)
        return i - self.size, *key

    def roomiest(self) -> tuple[int, int, int] | None:
        """Takes out the cheapest sequence among those with the most room."""
        if self.tree[1] is None:
            return None
        i = 1
        while i < self.size:
            i = 2 * i + 1 if self.tree[2 * i + 1] is not None else 2 * i
        return self.cheapest(i - self.size)


def pack_window(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    A document's full-capacity stretches are sequences of their own. The rest
    are taken in descending length, each into the lowest-cost sequence with room
    for it; where none has, the piece is cut over the roomiest ones. The number
    of sequences is fixed beforehand at what the tokens need; the tokens beyond
    full sequences (the last documents taken) fill sequences of power-of-two
    length, which need no padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    number, tails = 0, []
    for i, n in enumerate(lengths):
        full = n // capacity * capacity
        for start in range(0, full, capacity):
            pieces.append((i, start, capacity, number, 0))
            number += 1
        if n > full:
            tails.append((n - full, i, full))
    tails.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in tails)
    open_ = CheapestFit(capacity)
    rooms: dict[int, int] = {}
    for _ in range(total // capacity):
        rooms[number] = capacity
        open_.put(capacity, 0, number)
        number += 1
    rest = total % capacity
    small = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
    for size in small:
        rooms[number] = size
        open_.put(size, 0, number)
        number += 1
    sizes = dict(rooms)
    for n, i, start in tails:
        while n:
            found = open_.cheapest(n) or open_.roomiest()
            room, cost, at = found
            took = min(n, room)
            pieces.append((i, start, took, at, sizes[at] - room))
            open_.put(room - took, cost + LINEAR * took + took * took, at)
            n, start = n - took, start + took
    return pieces


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, window: int = WINDOW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids and end id into sequences of at most `capacity` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Each partition packs windows of `window` tokens as it reads them, so
    nothing is shuffled and memory does not grow with a partition; sequence_id
    has the partition number above its lowest 33 bits. Padding: all sequences
    are full but for those of power-of-two length, at most twelve a window.
    A null or empty text is its end id alone; null ids stay null; repeated rows
    are packed each; a text longer than a window is a window of its own; an empty
    table gives no rows; other columns are not read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = vocabulary(path)
        base, ids, held, tokens = TaskContext.get().partitionId() << 33, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base, ids, held, tokens
            pieces = pack_window([len(x) // 4 for x in held], capacity)
            doc, start, length, seq, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            crc = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            out = to_batch({"doc_id": pa.array(ids, pa.int64()).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": np.array([len(x) // 4 for x in held], np.int64)[doc], "sequence_id": base + seq, "offset": offset}, schema)
            base, ids, held, tokens = base + int(seq.max()) + 1, [], [], 0
            return out

        for batch in batches:
            for part in steps(batch, "text", ENCODE_BYTES):
                got = [x + end for x in own.encode(part.column("text").to_pylist())]
                ids += part.column("doc_id").to_pylist()
                held += got
                tokens += sum(map(len, got)) // 4
                if tokens >= window:
                    yield packed()
        if held:
            yield packed()
        own.forget()
        release()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
