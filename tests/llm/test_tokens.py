"""Tokenising operators against the libraries themselves."""

import hashlib
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tesselith.llm.arrow_output import BATCH, FIRST, SequenceFile, SequenceWriter, arrow_output, read_sequences, write_sequences
from tesselith.llm.byte_bpe import byte_bpe, byte_vocabulary
from tesselith.llm.packing import CheapestFit, pack_documents, pack_window
from tesselith.llm.token_counts import count_tokens, token_counts, whole_tokens
from tesselith.llm.word_tokens import vocabulary

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def word_ids(text):
    return vocabulary(WORD).library.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def table():
    return whole_tokens(WORD)


def le(ids):
    return np.array(ids, "<u4").tobytes()


@given(st.lists(st.text(st.one_of(st.sampled_from("abSTLldremv'0½²  \t\n\x85\xa0\x1c—’éÉßñ_-.,#<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_librarys(texts):
    own = vocabulary(WORD)
    assert own.encode(texts) == [le(word_ids(t)) for t in texts]
    assert count_tokens(texts, WORD, table()) == [len(word_ids(t)) for t in texts]


def test_special_strings_in_texts():
    texts = ["<|endoftext|>", "a<|startoftext|> b<|endoftext|>c", "<|END|>", "é<|endoftext|>日本 語 x", "<|endoftext|> \u3000<|ENDOFTEXT|>"]
    assert vocabulary(WORD).encode(texts) == [le(word_ids(t)) for t in texts]


SCRIPTS = "привет мир, ελληνικά κείμενα; 日本語の文章。 한국어 العربية हिन्दी ไทย İSTANBUL ΣΊΣΥΦΟΣ e\u0301 \u0301x K ﬁ 😀👍🏽 ½²٣ \u3000 \u2003x ".split(" ")


@given(st.lists(st.sampled_from([*SCRIPTS, "the house", "don't", "42", "a,b"]), max_size=30), st.sampled_from([" ", "  ", "\n", "\u3000", ""]))
@settings(max_examples=200, deadline=None)
def test_other_scripts_are_split_by_pre_token(words, blank):
    own, text = vocabulary(WORD), blank.join(words)
    assert own.encode([text]) == [le(word_ids(text))]
    assert count_tokens([text], WORD, table()) == [len(word_ids(text))]


def test_one_odd_letter_does_not_send_the_text_past_the_table():
    own, plain = vocabulary(WORD), "the house by the river " * 50
    words = own.words(f"{plain}привет, 😀 {plain}")
    assert words[:250] == own.words(plain) and all(isinstance(w, str) for w in words) and "привет" in words
    assert "привет" in own.store or own.encode([f"{plain}привет"]) and "привет" in own.store
    assert any(not w.isascii() and not w.isalpha() or ord(w[0]) > 0x250 for w in table())


def test_stores_are_bounded(monkeypatch):
    import tesselith.llm.word_tokens as module

    monkeypatch.setattr(module, "KEPT_WORDS", 5)
    monkeypatch.setattr(module, "KEPT_STRETCHES", 2)
    own = module.WordVocabulary(WORD)
    for text in ("a b c d e f g h", "привет мир как дела", "x y привет", "z"):
        assert own.encode([text]) == [le(word_ids(text))]
    assert len(own.store) <= 8 and len(own.foreign) <= 2


def test_whole_tokens_are_proven():
    assert len(table()) > 30_000
    assert all(len(word_ids(w)) == 1 for w in sorted(table())[::500])


def test_token_counts(awkward, pairs, nothing):
    got = Counter(map(tuple, token_counts(awkward, WORD).collect()))
    assert got == Counter((i, len(t.encode()), len(word_ids(t)), len(word_ids(t)) > 2048) for i, t in pairs)
    assert token_counts(nothing, WORD).count() == 0


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
@settings(max_examples=200, deadline=None)
def test_pre_tokens_encode_alone_as_in_the_text(texts):
    own = byte_vocabulary(BYTE, public_tokenizers.PATTERN)
    for t in texts:
        if not own.unstable[[ord(c) for c in t]].any():
            assert b"".join(map(own.encode_word, own.split(t))) == np.array(own.library.encode_ordinary(t), own.kind).tobytes()


def test_byte_bpe_round_trip(awkward, pairs, nothing):
    library = byte_vocabulary(BYTE, public_tokenizers.PATTERN).library
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, t, library.encode_ordinary(t)) for i, t in pairs]
    want = Counter((i, len(x), digest(le(x)), digest(t.encode())) for i, t, x in ids)
    assert Counter(map(tuple, byte_bpe(awkward, BYTE, public_tokenizers.PATTERN).collect())) == want
    assert byte_bpe(nothing, BYTE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("limits", [(1, 10**9), (400, 10**9), (2000, 20)])
def test_byte_bpe_over_many_chunks(awkward, pairs, spark, tmp_path, limits):
    """Chunks of a few documents, by bytes or by distinct words: several a task."""
    folder = f"file://{tmp_path}/bpe"
    rows = awkward.repartition(2).select("doc_id", "text").sortWithinPartitions("doc_id")
    got = byte_bpe(rows, BYTE, public_tokenizers.PATTERN, folder=folder, chunk_bytes=limits[0], chunk_words=limits[1])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, t, byte_vocabulary(BYTE, public_tokenizers.PATTERN).library.encode_ordinary(t)) for i, t in pairs]
    assert Counter(map(tuple, got.collect())) == Counter((i, len(x), digest(le(x)), digest(t.encode())) for i, t, x in ids)
    assert len(list((tmp_path / "bpe/chunks").iterdir())) > 2


@given(st.text(st.one_of(st.sampled_from("ab 1,'s\n\t\x1c\x1f\x85\xa0\u180eᲀ𞤢Ა"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_stretches_with_unlike_letters_stay_whole(text):
    own = byte_vocabulary(BYTE, public_tokenizers.PATTERN)
    words = own.words(text)
    assert "".join(words) == text
    assert b"".join(map(own.encode_word, words)) == np.array(own.library.encode_ordinary(text), own.kind).tobytes()


def test_one_unlike_letter_does_not_bypass_the_dictionary():
    own = byte_vocabulary(BYTE, public_tokenizers.PATTERN)
    plain = "the house by the river"
    assert own.unlike("ᲀ") and own.words(f"{plain} xᲀ {plain}") == [*own.split(plain), " xᲀ", *own.split(f" {plain}")]


def test_arrow_output(awkward, pairs, nothing, spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = arrow_output(awkward, WORD, folder, length=16).collect()
    rows.sort(key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(word_ids(t)) + 1, zlib.crc32(le([*word_ids(t), 1]))) for i, t in pairs)
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    total = 0
    for r in spark.read.parquet(f"{folder}/index").groupBy("file").sum("n_tokens").collect():
        path, n, k = r["file"].removeprefix("file://"), r[1], 0
        own = SequenceFile(path)
        while k * 16 < n:
            values, mask = own.sequence(k)
            assert len(values) == len(mask) == 16 and mask.sum() == min(16, n - 16 * k)
            k += 1
        for bad in (k, -1, 10**9):
            with pytest.raises(IndexError):
                own.sequence(bad)
        total += n
    assert total == sum(r["n_tokens"] for r in rows)
    assert arrow_output(nothing, WORD).count() == 0


def test_sequences_are_views_of_the_file_wherever_they_lie(tmp_path):
    path, length, n = str(tmp_path / "x.arrows"), 8, 8 * BATCH * 5 + 8 * 3 + 5
    ids = np.arange(n) % 60_000
    with pa.OSFile(path, "wb") as sink:
        out = SequenceWriter(sink, length, pa.uint16())
        for i in range(0, n, 999):
            out.add(ids[i : i + 999].astype(np.uint16))
        out.close()
    own = SequenceFile(path)
    own.source.seek(0)
    base, size = own.source.read_buffer().address, own.source.size()
    for k in (5 * BATCH + 3, 0, BATCH - 1, BATCH, 3 * BATCH + 7, 5 * BATCH):
        before = pa.total_allocated_bytes()
        values, mask = own.sequence(k)
        assert pa.total_allocated_bytes() == before
        for x in (values, mask):  # inside of the mapped file
            assert base <= x.__array_interface__["data"][0] < base + size and not x.flags.owndata and not x.flags.writeable
        valid = min(length, n - k * length)
        assert values[:valid].tolist() == ids[k * length : k * length + valid].tolist() and mask.tolist() == [1] * valid + [0] * (length - valid)
    assert len(pa.ipc.open_stream(path).read_all()) == own.rows * 5 + 4


@pytest.mark.parametrize("kind", ["one id", "one row", "few"])
def test_one_id_spreads_over_partitions_in_order(spark, tmp_path, kind):
    """Most rows share an id, or are one and the same row: several partitions have them, and the order holds."""
    texts = {"one id": lambda i: f"text {i}", "one row": lambda i: "the same", "few": lambda i: "ab"[i % 2]}[kind]
    rows = [(7, texts(i)) for i in range(400)] + [(i, f"other {i}") for i in range(-5, 15) if i != 7] + [(None, "none")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/out"
    index = write_sequences(frame, WORD, folder, length=16)
    parts = {r["part"] for r in index.where("doc_id = 7").collect()}
    assert len(parts) > 2
    got = sorted(read_sequences(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: FIRST if i is None else i)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(word_ids(t)) + 1, zlib.crc32(le([*word_ids(t), 1]))) for i, t in rows)


def test_files_are_closed_after_so_many_tokens(awkward, pairs, spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    rows = awkward.repartition(1)
    write_sequences(rows, WORD, folder, length=16)
    whole = sorted(map(tuple, read_sequences(spark, folder).collect()), key=repr)
    short = f"file://{tmp_path}/short"
    write_sequences(rows, WORD, short, length=16, file_tokens=1)
    assert sorted(map(tuple, read_sequences(spark, short).collect()), key=repr) == whole
    assert len(list((tmp_path / "short/data").glob("*.arrows"))) >= len(list((tmp_path / "out/data").glob("*.arrows")))


def test_a_file_that_lacks_ids_or_has_more_is_noticed(awkward, spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    index = write_sequences(awkward.coalesce(1), WORD, folder, length=16)
    for change in ("n_tokens + 1", "n_tokens - 1"):
        index.withColumn("n_tokens", F.expr(f"case when doc_id = 7 then {change} else n_tokens end")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/changed")
        (tmp_path / "bad").mkdir(exist_ok=True)
        spark.read.parquet(f"{tmp_path}/changed").write.mode("overwrite").parquet(f"{tmp_path}/bad/index")
        with pytest.raises(PythonException, match="documents have"):
            read_sequences(spark, f"file://{tmp_path}/bad").collect()


def test_write_sequences_again_replaces_the_index(awkward, spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    for _ in range(2):
        write_sequences(awkward, WORD, folder)
    assert read_sequences(spark, folder).count() == awkward.count()


def padding(lengths, capacity):
    return sum(capacity - n for n in lengths if n & (n - 1))


@given(st.lists(st.integers(1, 200), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pack_window(lengths):
    pieces = pack_window(lengths, 64)
    seen, filled = {}, {}
    for i, start, n, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert n > 0 and filled.get(seq, 0) == offset
        filled[seq] = offset + n
        seen.setdefault(i, []).append((start, n))
    assert all(n <= 64 for n in filled.values()) and not padding(filled.values(), 64)
    for i, n in enumerate(lengths):
        at = 0
        for start, took in sorted(seen[i]):
            assert start == at
            at += took
        assert at == n


@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 5)), max_size=20), st.lists(st.integers(1, 16), max_size=20))
@settings(max_examples=200, deadline=None)
def test_cheapest_fit_against_a_list(bins, asked):
    tree, plain = CheapestFit(16), []
    for k, (room, cost) in enumerate(bins):
        tree.put(room, cost, k)
        plain.append((room, cost, k))
    for n in asked:
        fits = [x for x in plain if x[0] >= n]
        want = min(fits, key=lambda x: x[1:]) if fits else None
        assert tree.cheapest(n) == want
        if want:
            plain.remove(want)


def test_costs_are_balanced():
    lengths = [100] * 40 + [7] * 500 + [300] * 30
    cost, filled = {}, {}
    for _, _, n, seq, _ in pack_window(lengths, 1024):
        cost[seq], filled[seq] = cost.get(seq, 0) + n * n, filled.get(seq, 0) + n
    full = [c for seq, c in cost.items() if filled[seq] == 1024]
    assert len(full) == sum(lengths) // 1024 and max(full) < 2 * min(full)


@pytest.mark.parametrize("seed", range(5))
def test_no_sequence_costs_much_beyond_its_largest_piece(seed):
    """Lengths as of texts: what shares a sequence with its largest piece costs less than the cheapest full sequence."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.exp(rng.normal(5.5, 1.3, 6000)).astype(int) + 1, 30_000).tolist()
    cost, largest, filled = Counter(), Counter(), Counter()
    for _, _, n, seq, _ in pack_window(lengths, 4096):
        cost[seq], filled[seq], largest[seq] = cost[seq] + n * n, filled[seq] + n, max(largest[seq], n)
    full = [x for x in cost if filled[x] == 4096]
    several = [x for x in full if largest[x] < 4096]
    assert len(full) == sum(lengths) // 4096 and len(several) > 200
    assert max(cost[x] - largest[x] ** 2 for x in several) <= min(cost[x] for x in several)


def test_pack_documents(awkward, pairs, nothing):
    want = Counter((i, le([*word_ids(t), 2])) for i, t in pairs)
    rows = pack_documents(awkward.coalesce(2), WORD, capacity=128).collect()
    texts = {}
    for i, b in want:
        texts.setdefault(i, []).append(b)
    covered, filled = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        piece = slice(4 * r["start"], 4 * (r["start"] + r["length"]))
        assert any(len(b) == 4 * r["doc_tokens"] and zlib.crc32(b[piece]) == r["ids_crc32"] for b in texts[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
    assert covered == Counter({i: sum(len(b) // 4 * n for (j, b), n in want.items() if j == i) for i in texts})
    assert max(filled.values()) <= 128 and not padding(filled.values(), 128)
    assert pack_documents(nothing, WORD).count() == 0
