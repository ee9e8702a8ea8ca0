"""Sharding, language, quality and near duplicates against brute force."""

import base64
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tesselith.llm.components import connected_components
from tesselith.llm.compression_quality import BANDS, CHUNK_BYTES, LEVEL, base_counts, compression_quality, filter_quality, judge
from tesselith.llm.language_id import RANKS, Profiles, gram_counts, identify_language, learn_profiles, top_grams
from tesselith.llm.parity_join import Bands, fold, jaccard_components, keep_one_of_each, linked, parity_sketch, pigeonhole_keys
from tesselith.llm.sharding import best_fit_decreasing, fewest_capacity, shard_documents

DATA = "/root/testdata/sf0.001"


# ---- sharding ----


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_best_fit_against_a_list(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    rooms, want = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        i = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, s))
        rooms[i] -= s
        want.append(i)
    assert list(best_fit_decreasing(sizes, capacity)) == want


@given(st.lists(st.integers(1, 1000), max_size=200), st.integers(1, 24))
@settings(max_examples=100, deadline=None)
def test_fewest_capacity(sizes, bins):
    got = fewest_capacity(sizes, bins)
    assert len(got) == len(sizes) and all(0 <= b < bins for b in got)
    totals = [sum(s for s, b in zip(sizes, got, strict=True) if b == k) for k in range(bins)]
    assert max(totals) <= 2 * max(-(-sum(sizes) // bins), max(sizes, default=0))


def test_shard_documents(awkward, pairs, nothing):
    rows = shard_documents(awkward, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for i, t in pairs)
    for k in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert all(len({r["shard"] for r in rows if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in rows})
    assert shard_documents(nothing).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([1, 10, 100, 1000])) for i in range(3000)]
    rows = [(i, f"{i if i % 3 else 0}{t}") for i, t in rows]
    rows += [(10_000 + i, "hot") for i in range(1500)]
    sizes = Counter()
    for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r["shard"]] += r["size"]
    # one group is over a shard's share and has a shard alone
    largest, *others = sorted(sizes.values(), reverse=True)
    assert len(others) == 23 and largest > 2 * others[0] and others[0] < 1.02 * others[-1]


# ---- language ----


def test_grams_by_hand():
    grams, counts = gram_counts("Ab 1 ab")
    # _ab_ twice: a, b, _a, ab, b_, _ab, ab_
    assert len(grams) == 7 and set(counts.tolist()) == {2}
    assert len(top_grams("ab " * 3)) == 7 and not len(top_grams("12 -"))
    text = "un deux trois été " * 500
    assert len(top_grams(text)) <= RANKS


def test_long_texts_are_counted_in_stretches(monkeypatch):
    import tesselith.llm.language_id as module

    text = "the quick brown foxes été ünï jump " * 40
    whole = gram_counts(text)
    monkeypatch.setattr(module, "STRETCH", 17)
    assert all((a == b).all() for a, b in zip(whole, gram_counts(text), strict=True))


def test_language_on_awkward_rows(awkward, pairs, nothing):
    rows = identify_language(awkward).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((i, held(i)) for i, _ in pairs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} >= {1, 2, 3}
    assert identify_language(nothing).count() == 0
    unlabelled = awkward.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in identify_language(unlabelled).collect()} == {"und"}


def test_marks_alone_are_no_language():
    profiles = Profiles({"en": top_grams("the \u0301 house \u0301\u0302").tolist(), "fr": top_grams("la maison").tolist()})
    for text in (None, "", " \n", "\u0301\u0302\u0301", "12 \u0301, 4", "½ ² ٣ 😀"):
        assert profiles.predict(text) == ("und", 0.0)
    assert profiles.predict("the\u0301 house")[0] == "en"


def test_ties_go_to_the_first_language_and_the_lower_code():
    grams = top_grams("abc abd").tolist()
    profiles = Profiles({"zz": grams, "aa": grams, "mm": grams[::-1]})
    assert profiles.predict("abc abd") == ("aa", 1.0)
    assert top_grams("b a").tolist() == sorted(top_grams("a b").tolist())  # equal counts: by code
    # a n-gram that no profile has is as far as can be from each
    assert profiles.predict("xyz") == ("aa", 0.0)


def test_profiles_are_learned_from_a_sample_of_any_share(spark):
    rows = [(i, "the house of the river" if i % 2 else "la maison de la ville", "en" if i % 2 else "fr") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, part = learn_profiles(docs, 10**9), learn_profiles(docs, 20)
    assert whole.languages == part.languages == ["en", "fr"] and set(part.grams.tolist()) == set(whole.grams.tolist())
    assert [whole.predict(t)[0] for _, t, _ in rows[:2]] == ["fr", "en"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_prediction_is_out_of_place_distance(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    profiles = learn_profiles(docs)
    for text in [r["text"] for r in docs.limit(20).collect()]:
        own = {g: i for i, g in enumerate(top_grams(text).tolist())}
        distance = {}
        for k, language in enumerate(profiles.languages):
            ranks = {int(g): int(r) for g, r in zip(profiles.grams, profiles.ranks[:-1, k], strict=True) if r < RANKS}
            distance[language] = sum(abs(ranks[g] - i) if g in ranks else RANKS for g, i in own.items())
        language, score = profiles.predict(text)
        assert language == min(distance, key=lambda x: (distance[x], x))
        assert score == pytest.approx(1 - distance[language] / (RANKS * len(own)))


# ---- quality ----


def slow_counts(text):
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in blank for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@given(st.text(st.sampled_from("ab é#|\n \t\x1c\x85\xa0"), max_size=80))
@settings(max_examples=400, deadline=None)
def test_base_counts(text):
    assert base_counts(text) == slow_counts(text)


def test_many_distinct_words_are_counted_alike(monkeypatch):
    import tesselith.llm.compression_quality as module

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(n)) for n in (5, 60, 700, 5000)]
    monkeypatch.setattr(module, "NUMBERED", 3)
    assert [base_counts(t) for t in texts] == [slow_counts(t) for t in texts]


def test_compression_quality(awkward, pairs, nothing):
    rows = compression_quality(awkward).collect()
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    want = Counter()
    for i, t in pairs:
        counts, data = slow_counts(t), t.encode()
        failed = counts[0] < 50 or counts[4] > counts[0] / 2
        kept = False
        if not failed:
            low, high, chunk_low, chunk_high = next(b[1:] for b in BANDS if len(data) < b[0])
            chunks = [data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
            chunks = [c for c in chunks if len(c) == len(chunks[0]) or 2 * len(c) >= CHUNK_BYTES]
            ratio = len(packer.compress(data)) / len(data)
            chunk = ratio if len(data) <= CHUNK_BYTES else float(np.median([len(packer.compress(c)) / len(c) for c in chunks]))
            kept = low <= ratio <= high and chunk_low <= chunk <= chunk_high
        want[(i, *counts, failed, kept)] += 1
    assert Counter(tuple(r)[:8] for r in rows) == want
    assert compression_quality(nothing).count() == 0
    assert filter_quality(awkward).count() == sum(r["kept"] for r in rows)
    assert filter_quality(awkward).columns == awkward.columns


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(2)
    syllables = ["ba", "ne", "ti", "ro", "lu", "ka", "so", "mi", "da", "re", "fo", "gu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(n)) for n in (60, 300, 2000)]
    # no repeated three-word window, yet highly compressible; and bytes without structure
    dull = " ".join("a" * 50 + f"{i:x}" for i in range(900))
    noise = " ".join(base64.b85encode(rng.randbytes(40)).decode() for _ in range(900))
    rows = [(i, t) for i, t in enumerate([*clean, dull, noise])]
    assert [r["kept"] for r in compression_quality(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [True, True, True, False, False]


def test_bands_tell_labelled_junk_from_clean(spark):
    data = "/root/testdata/sf0.1"
    # limits were set on even ids
    rows = compression_quality(spark.read.parquet(f"{data}/documents.parquet")).where("not base_failed and doc_id % 2 = 1")
    labelled = rows.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("quality", "kept", (rows.n_symbols > rows.n_words).alias("glued")).collect()
    share = lambda x: sum(r["kept"] for r in x) / len(x)
    assert share([r for r in labelled if r["quality"] == 1]) > 0.99
    assert share([r for r in labelled if r["quality"] == 0 and r["glued"]]) < 0.15
    assert share([r for r in labelled if r["quality"] == 0]) < 0.5


def test_bands_reject_encoded_bytes():
    rng = random.Random(3)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    cut = lambda s, k: " ".join(s[i : i + k] for i in range(0, len(s), k))
    for n in (3000, 6000, 40_000):
        assert not judge(cut(rng.randbytes(n).hex()[:n], 32), packer)[6]
        assert not judge(cut(base64.b64encode(rng.randbytes(n)).decode()[:n], 40), packer)[6]
    words = ["слово", "река", "дом", "камень", "небо", "вода", "город", "лес", "путь", "время", "голос", "рука"]
    assert judge(" ".join(rng.choice(words) + rng.choice(words) for _ in range(300)), packer)[6]  # no close limits for other scripts


def test_every_chunk_is_judged(spark):
    rng = random.Random(4)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    prose = "\n".join(r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and n_chars > 3000").orderBy("doc_id").limit(30).collect())
    line = lambda n: ("Click here to subscribe to our newsletter.\n" * n)[:n]
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(n // 60))[:n]
    keeps = lambda t: judge(t, packer)[6]
    for n in (4500, 5900, 9000, 13_800, 40_000):
        assert keeps(prose[:n])
    for junk in (line, noise):
        for share in (0.3, 0.45):
            m = int(40_000 * share)
            assert not keeps(prose[: 40_000 - m] + "\n" + junk(m))
            assert not keeps(prose[:9000] + "\n" + junk(m) + "\n" + prose[9000 : 40_000 - m])
        assert not keeps(prose[:4200] + "\n" + junk(1800))  # one chunk, joined by its tail
        assert not keeps(prose[:12_288] + "\n" + junk(1900))


# ---- near duplicates ----


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
@settings(max_examples=8, deadline=None)
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert got.pop(x) == min(seen)
    assert not got


@pytest.mark.parametrize("many", [0, 1_000_000])
def test_long_chain_of_links(spark, monkeypatch, many):
    import tesselith.llm.components as module

    monkeypatch.setattr(module, "MANY_LINKS", many)
    links = [(i, i + 1) for i in range(300)]
    random.Random(4).shuffle(links)
    got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


@pytest.mark.parametrize("part", [80, 85])
def test_linked_sets_share_a_key_and_pass_the_bounds(part):
    rng = np.random.default_rng(part)
    bands = Bands(part, 100)
    for _ in range(600):
        n = int(rng.choice([3, 8, 20, 60, 150, 700, 2000]))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate([base[rng.random(n) > 0.15 * rng.random()], rng.integers(0, 2**64, int(0.12 * n * rng.random()), dtype=np.uint64)]))
        if len(b) and linked(a, b, part, 100) and len(np.setxor1d(a, b)):
            both = np.intersect1d(pigeonhole_keys(a, bands), pigeonhole_keys(b, bands))
            band = bands.band(min(len(a), len(b)))
            assert np.sum(both & np.uint64(255) == band) > bands.spare[band]
            x, y = parity_sketch(a), parity_sketch(b)
            words = min(len(x), len(y))
            assert np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= len(np.setxor1d(a, b))


def brute_components(pairs, size, part):
    ids = [i for i, _ in pairs]
    sets = []
    for _, t in pairs:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    near = {}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if ids[i] is not None and ids[j] is not None and a and b and (ids[i] == ids[j] or 100 * len(a & b) >= part * len(a | b)):
                near.setdefault(ids[i], set()).add(ids[j])
                near.setdefault(ids[j], set()).add(ids[i])
    out = Counter()
    for (i, _), s in zip(pairs, sets, strict=True):
        seen, todo = {i}, [i]
        while todo:
            todo += [y for y in near.get(todo.pop(), ()) if y not in seen and not seen.add(y)]
        out[i, len(s), min(seen) if i is not None else None] += 1
    return out


def test_jaccard_components_on_awkward_rows(awkward, pairs, nothing):
    got = Counter(map(tuple, jaccard_components(awkward, 4, 85).collect()))
    assert got == brute_components(pairs, 4, 85)
    assert jaccard_components(nothing).count() == 0


@pytest.mark.parametrize(("size", "part"), [(4, 85), (5, 80)])
def test_jaccard_components_on_near_copies(spark, size, part):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 90, 250]))]
        for _ in range(rng.choice([2, 5, 30])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                text = copy  # drifts, so that links chain
            rows.append((len(rows) * 7 % 997, " ".join(copy)))
    rng.shuffle(rows)
    got = Counter(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, part).collect()))
    assert got == brute_components(rows, size, part)


@pytest.mark.parametrize("frequent", [2, 4])
def test_frequent_keys_are_told_from_rare_ones(spark, monkeypatch, frequent):
    """A passage that all documents share, within texts of which some are near copies; blocks of keys with frequent ones in them."""
    import tesselith.llm.parity_join as module

    monkeypatch.setattr(module, "FREQUENT", frequent)
    monkeypatch.setattr(module, "KEY_BLOCK", 500)
    rng = random.Random(frequent)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(20):
        own = [rng.choice(words) for _ in range(rng.choice([30, 60, 90]))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = own + passage
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = Counter(map(tuple, module.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5, 80).collect()))
    assert got == brute_components(rows, 5, 80)


def test_unrelated_sets_hardly_share_keys():
    """Random sets of one size: no part that two have is empty, so chance collisions are next to none."""
    rng = np.random.default_rng(8)
    bands = Bands(80, 100)
    for n in (30, 100, 300, 1000):
        keys = [pigeonhole_keys(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), bands) for _ in range(400)]
        run = np.unique(np.concatenate(keys), return_counts=True)[1]
        pairs = (run * (run - 1) // 2).sum() / (400 * 399 / 2)
        assert pairs < 1e-4 and run.max() <= 2


def test_keys_do_not_outgrow_the_text():
    bands = Bands(80, 100)
    rng = np.random.default_rng(9)
    for n in (1, 4, 5, 6, 50, 10_000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert len(pigeonhole_keys(x, bands)) <= n + 12
    assert bands.shape(bands.band(10**9))[0] < 10**9


def test_long_runs_are_compared_in_pieces(spark, monkeypatch):
    import tesselith.llm.parity_join as module

    monkeypatch.setattr(module, "PIECE", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = Counter(map(tuple, module.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()))
    assert got == brute_components(rows, 4, 85)


# ---- pipeline ----


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language identification", "near duplicates", "packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in compression_quality(docs).where("kept").collect()}
    found = {r["doc_id"]: r for r in identify_language(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    kept = {i for i in kept if found[i]["lang_pred"] != "und" and found[i]["score"] >= corpus_pipeline.LEAST_SCORE}
    components = brute_components([(i, texts[i]) for i in sorted(kept)], 5, 80)
    kept = {i for i, _, c in components if i == c}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == kept
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    shape = "doc_id", "text", "lang"
    rows = awkward.select(*shape).selectExpr("*", "cast(null as string) source", "cast(null as long) n_chars")
    for frame in (rows, rows.limit(0)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, frame, DATA)
            docs.count()
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, rows, DATA).collect())
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    ids = {i for i, _ in kept}
    assert {1, 2, 3, 4, 7} <= ids and not ids & set(range(100, 105))
    assert kept[4, texts[4]] == 1 and kept[5, "again"] == 1 and len([1 for i, _ in kept if i == 5]) == 2  # unlike texts of one id
    assert sum(n for (i, _), n in kept.items() if i is None) == 2


def test_one_of_each_group_stays_whatever_columns_are_called(spark):
    rng = random.Random(5)
    text = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)) for _ in range(3)]
    rows = [(2, text[0], 0), (1, text[0] + " more", 1), (1, text[1], 2), (3, text[1], 3), (3, text[1], 4), (4, text[2], 5), (4, text[2], 6), (5, "", 7), (5, None, 8)]
    frame = spark.createDataFrame([(*r, *"xyzuv") for r in rows], "doc_id long, text string, component int, kept_id string, mark string, digest string, row string, `a.b` string")
    got = keep_one_of_each(frame)
    assert got.columns == frame.columns
    rows = sorted((r["doc_id"], r["component"]) for r in got.collect())
    assert [x for x in rows if x[0] != 4] == [(1, 1), (1, 2), (5, 7), (5, 8)] and [i for i, _ in rows].count(4) == 1
    assert keep_one_of_each(frame.limit(0)).count() == 0
