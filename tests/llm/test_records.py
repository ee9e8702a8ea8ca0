"""Archives and nearest neighbours against brute force."""

import base64
import gzip
import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselith.llm.additive_ann import AdditiveQuantiser, best_places, nearest_neighbours
from tesselith.llm.warc import PROFILE, page_of, read_archives, record_id, records, render, warc_round_trip, write_archives


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
@settings(max_examples=300, deadline=None)
def test_record_ids_hold_the_page(page):
    assert page_of(record_id(page)) == page


@given(st.integers(0, 99), st.one_of(st.none(), st.text(max_size=20)), st.binary(max_size=50), st.booleans())
@settings(max_examples=200, deadline=None)
def test_a_record_reads_back(tmp_path_factory, page, url, payload, revisit):
    data = render(page, url, payload, (7, url) if revisit else None, "2024-01-01T00:00:00Z")
    path = tmp_path_factory.mktemp("r") / "x.gz"
    path.write_bytes(gzip.compress(data) + gzip.compress(data))
    with path.open("rb") as f:
        found = list(records(f))
    assert len(found) == 2
    headers, block = found[0]
    assert headers["warc-type"] == ("revisit" if revisit else "response")
    assert block.endswith(b"\r\n\r\n" if revisit else payload)
    assert (headers.get("warc-profile"), "warc-refers-to" in headers) == ((PROFILE, True) if revisit else (None, False))


PAGES = [(1, "http://a/ b", "same"), (2, "http://a\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "café 日本"), (None, "u", "same"), (None, "u", "alone"), (6, "u", "twice"), (6, "u", "twice"), (7, "u", "x" * 500_000), (8, "u", "WARC/1.1\r\n\r\n")]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in PAGES], "page_id long, url string, html string, digest int, origin string")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = Counter()
    for i, _, h in PAGES:
        first = max((j for j, _, k in PAGES if (k or "") == (h or "") and j is not None), default=None)
        revisit = first is not None and i != first
        want[i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first if revisit else None] += 1
    got = warc_round_trip(df).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc_round_trip(df.limit(0)).count() == 0


def test_archives_hold_each_payload_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "shared payload" * 50) for i in range(200)] + [(1000, "u", "other")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    write_archives(df, folder)
    kinds = Counter()
    for p in Path(f"{tmp_path}/w/archives").glob("*.warc.gz"):
        with p.open("rb") as f:
            for headers, block in records(f):
                kinds[headers["warc-type"], b"shared" in block] += 1
    assert kinds == {("response", True): 1, ("revisit", False): 199, ("response", False): 1}
    assert {r["refers_to"] for r in read_archives(spark, folder).where("record_type = 'revisit'").collect()} == {199}


def test_a_changed_payload_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), folder)
    (path,) = Path(f"{tmp_path}/w/archives").glob("*.warc.gz")
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"\r\n\r\npayload", b"\r\n\r\npaylo4d")))
    with pytest.raises(Exception, match="does not have the payload"):
        read_archives(spark, folder).collect()


# ---- nearest neighbours ----


def brute(rows, every, k):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
    out = {}
    for q in sorted(i for i in ids if i % every == 0):
        s = unit @ unit[ids.index(q)]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[q] = [(r + 1, ids[j], s[j]) for r, j in enumerate(order)]
    return out


def compare(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {q for q, x in want.items() if x}
    hits = total = 0
    for q, x in found.items():
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1))
        exact = {i: s for _, i, s in want[q]}
        hits, total = hits + len({i for _, i, _ in x} & set(exact)), total + len(exact)
        for _, i, s in x:
            if i in exact:
                assert math.isclose(s, exact[i], abs_tol=1e-12)
    return hits / total


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding {kind}, rep int")


def test_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(4000, 64)))]
    assert compare(nearest_neighbours(vectors(spark, rows)).collect(), brute(rows, 50, 5)) >= 0.95


def test_many_copies_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=16)
    rows = [(i, (hot if i % 3 == 0 else hot + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(2000)]
    got = nearest_neighbours(vectors(spark, rows), rerank=40).collect()
    # of equal vectors the smallest ids are nearest, the query's own left out
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [3, 6, 9, 12, 15]
    assert compare(got, brute(rows, 50, 5)) >= 0.95


def test_many_near_copies_lose_nothing(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    x = rng.normal(size=(4000, 64))
    x[::2] = centre + rng.normal(size=(2000, 64)) * 0.1
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    assert compare(nearest_neighbours(vectors(spark, rows)).collect(), brute(rows, 50, 5)) == 1


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0]), (2, None), (100, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (8, [1e200, 1e200])]
    valid = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0]), (8, [1.0, 1.0])]
    assert compare(nearest_neighbours(vectors(spark, rows, "array<double>")).collect(), brute(valid, 50, 5)) == 1
    for few in (rows[:1], [], rows[3:8]):
        assert nearest_neighbours(vectors(spark, few, "array<double>")).count() == 0


def test_rows_that_share_an_id_are_queries_and_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (1, [-1.0, 0.2])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest_neighbours(vectors(spark, rows)).collect()]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    own, want = list(dict.fromkeys((i, tuple(v)) for i, v in rows)), []
    for q in (x for x in own if x[0] == 0):
        ranked = sorted(((-cosine(q[1], v), i) for i, v in own if (i, v) != q))
        want += [(0, k, i, round(-s, 6)) for k, (s, i) in enumerate(ranked, 1)]
    assert sorted(got) == sorted(want)


def test_quantiser_improves_with_the_beam():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    own = AdditiveQuantiser.fit(x, 6, 16)
    error = []
    for beam in (1, 8):
        codes, norms = own.encode(x, beam)
        sums = sum(own.books[m][codes[:, m]] for m in range(6))
        assert np.allclose(np.sqrt((sums**2).sum(axis=1)), norms, atol=1e-3)
        error.append(float(((x - sums) ** 2).sum()))
    assert error[1] <= error[0]


@given(st.lists(st.integers(0, 5), max_size=30), st.integers(1, 10))
@settings(max_examples=200, deadline=None)
def test_best_places(values, k):
    scores = np.array(values, np.float32)
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))[:k]
    assert sorted(best_places(scores, k).tolist()) == sorted(want)
