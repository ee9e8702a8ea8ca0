"""Quality rules: word statistics, then zstandard ratios in bands by length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import release, steps, to_batch

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEVEL = 3
CHUNK_BYTES = 4096
#: For texts under so many UTF-8 bytes, the least and the largest
#: compressed share of the whole text that is kept, the same for the fixed chunks'
#: median, and the least structure. Short texts carry zstandard's frame, so their
#: shares are higher. Set around the labelled clean prose (Latin script) of sf0.1
#: with even ids: upper limits 0.03 over its shares, lower ones 0.03 under them below
#: 1024 bytes and 0.065 from there, where text of few letters compresses further;
#: structure 0.035 under. No labelled text has 32 KB, so the last lower limits are wide.
LIMITS = [
    (363, 0.572, 0.755, 0.572, 0.755, 1.184),
    (431, 0.514, 0.731, 0.514, 0.731, 1.096),
    (512, 0.514, 0.730, 0.514, 0.730, 1.082),
    (609, 0.514, 0.712, 0.514, 0.712, 1.082),
    (725, 0.513, 0.671, 0.513, 0.671, 1.048),
    (862, 0.490, 0.651, 0.490, 0.651, 0.991),
    (1_024, 0.477, 0.634, 0.477, 0.634, 0.919),
    (1_218, 0.439, 0.610, 0.439, 0.610, 0.913),
    (1_449, 0.426, 0.591, 0.426, 0.591, 0.884),
    (1_723, 0.418, 0.573, 0.418, 0.573, 0.875),
    (2_048, 0.412, 0.560, 0.412, 0.560, 0.847),
    (2_436, 0.406, 0.551, 0.406, 0.551, 0.842),
    (2_897, 0.400, 0.538, 0.400, 0.538, 0.830),
    (3_445, 0.388, 0.520, 0.388, 0.520, 0.808),
    (4_096, 0.386, 0.513, 0.386, 0.513, 0.808),
    (4_871, 0.382, 0.501, 0.372, 0.551, 0.796),
    (5_793, 0.372, 0.496, 0.372, 0.551, 0.778),
    (6_889, 0.372, 0.496, 0.372, 0.551, 0.776),
    (8_192, 0.362, 0.484, 0.372, 0.551, 0.759),
    (9_742, 0.362, 0.477, 0.372, 0.551, 0.759),
    (11_586, 0.360, 0.476, 0.372, 0.551, 0.749),
    (13_778, 0.359, 0.472, 0.372, 0.551, 0.749),
    (16_384, 0.351, 0.467, 0.372, 0.551, 0.736),
    (32_768, 0.338, 0.458, 0.372, 0.551, 0.723),
    (1 << 62, 0.250, 0.458, 0.372, 0.551, 0.550),
]
BANDS = [x[:5] for x in LIMITS]
#: Texts of other scripts, whose letters take several bytes, have no labelled rows to set close limits by.
OTHER_BANDS = [
    (512, 0.20, 1.00, 0.20, 1.00),
    (2048, 0.15, 0.85, 0.15, 0.85),
    (8192, 0.12, 0.75, 0.15, 0.80),
    (1 << 62, 0.08, 0.70, 0.15, 0.80),
]
#: From so many distinct words on, pairs of words are numbered anew, or three would not fit 63 bits.
NUMBERED = 2_000_000
#: From this share of continuation bytes on, a text is one of another script.
OTHER_SHARE = 0.2


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words))


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:  # two windows at least
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    v = len(seen)
    if v < NUMBERED:
        windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # keeps the product within 63 bits: number the pairs first
        windows = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def cut(data: bytes) -> list[bytes]:
    """The text in fixed chunks; a last one under half full is part of the one before."""
    starts = list(range(0, len(data), CHUNK_BYTES))
    if len(starts) > 1 and (len(data) - starts[-1]) * 2 < CHUNK_BYTES:
        starts.pop()
    return [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)]


def structure(data: bytes, whole: float) -> float:
    """The compressed share by what the bytes' frequencies alone would leave.

    Junk glued to words adds rare bytes in a fixed order: it raises the
    frequencies' entropy, yet hardly what the compressor writes.
    """
    n = np.bincount(np.frombuffer(data, np.uint8))
    n = n[n > 0] / len(data)
    entropy = -float((n * np.log2(n)).sum()) / 8
    return whole / entropy if entropy else 0.0


def other_script(data: bytes) -> bool:
    """Whether many of the UTF-8 bytes continue a character."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 == 0x80)) >= OTHER_SHARE * len(data)


def within_bands(data: bytes, share: float) -> bool:
    """Whether the share and the structure of a text, or a chunk, lie inside the limits of its length band."""
    other = other_script(data)
    low, high = next(b[1:3] for b in (OTHER_BANDS if other else BANDS) if len(data) < b[0])
    return low <= share <= high and (other or structure(data, share) >= next(x[5] for x in LIMITS if len(data) < x[0]))


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The counts, base_failed, kept and the two ratios of one text."""
    text = text or ""
    counts, data = base_counts(text), text.encode()
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    if not data:
        return *counts, failed, False, None, None
    pieces = {data: len(packer.compress(data)) / len(data)}
    chunks = cut(data)
    pieces |= {c: len(packer.compress(c)) / len(c) for c in chunks if c not in pieces}
    chunk = float(np.median([pieces[c] for c in chunks]))
    low, high = next(b[3:] for b in (OTHER_BANDS if other_script(data) else BANDS) if len(data) < b[0])
    kept = not failed and low <= chunk <= high and all(within_bands(c, share) for c, share in pieces.items())
    return *counts, failed, kept, pieces[data], chunk


def compression_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the counts, the two ratios and the verdict.

    base_failed: under 50 words, or over half of the words lie in repeated 3-word
    windows. kept: not base_failed, and the compressed share and the structure of
    the whole text and of every fixed chunk within the limits of its own length
    band. ratio is the whole text's share, chunk_ratio the chunks' median. A null or
    blank text has counts of 0 and is base_failed; without bytes its ratios are null. Null ids stay null; repeated rows give repeated rows; other
    columns are not read. Whole texts are used, of any length. No shuffle.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *((c, pa.bool_()) for c in ("base_failed", "kept")), *((c, pa.float64()) for c in ("ratio", "chunk_ratio"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for batch in batches:
            for part in steps(batch, "text"):
                rows = [judge(t, packer) for t in part.column("text").to_pylist()]
                columns = dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True))
                yield to_batch({"doc_id": part.column("doc_id")} | columns, schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_ratio double")


def filter_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is kept by the same rules. No shuffle.

    A null, empty or blank text has no words and goes; repeated rows are judged
    each; other columns, of any name, are passed on; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array([judge(t, packer)[6] for t in part.column(text_col).to_pylist()], pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
