"""Resampling, hard negatives and archives against plain versions, and on edge rows."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbflow.llm import hardnegatives, resampling, warc
from kerbflow.llm import queries as q
from kerbflow.session import shared_folder
from tests.compare import connect, differences
from tests.llm import brute

FOLDER = os.environ.get("KERBFLOW_TEST_TABLES", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CLASHES = (*brute.CLASHES, "rank", "weight", "falling", "at_", "part_", "start_", "file", "offset",
           "mark_", "copies", "place_", "url_key", "payload_bytes", "first_id", "n")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


@tables
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives", "op13_warc_archive"])
def test_equals_sql(spark, name):
    got = q.QUERIES[name](spark, FOLDER).toArrow()
    want = connect(FOLDER).sql(q.ORACLES[name]).to_arrow_table()
    assert differences(got, want) == []


# resampling

def naive_resample(rows, target, settings):
    """Sorted (doc_id, n_features, weight, score, rank) by plain lists."""
    n = settings.buckets
    of = [[zlib.crc32(w.encode()) % n for w in naive_words(t)] for _, t in rows]
    raw, good = Counter(b for x in of for b in x), Counter(
        zlib.crc32(w.encode()) % n for t in target for w in naive_words(t))
    s, t = sum(raw.values()), sum(good.values())
    gain = [math.floor(1000 * math.log((good[b] + 1) * (s + n) / ((raw[b] + 1) * (t + n)))) for b in range(n)]
    out = []
    for (doc_id, _), x in zip(rows, of):
        h = int(hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(x), weight, score, None])
    drawn = sorted((r for r in out if r[1] >= settings.least_words),
                   key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: settings.percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def edges(spark):
    docs = spark.createDataFrame(brute.EDGES, brute.SCHEMA)
    return docs.withColumns({c: F.lit(7) for c in CLASHES}).repartition(3).cache()


@pytest.mark.parametrize("settings", [
    resampling.Resampling(buckets=50, percent=60, least_words=3),
    resampling.Resampling(percent=100, least_words=0, probes=1),
    resampling.Resampling(),
])
def test_resampling_edges(spark, edges, settings):
    target = ["one two three licensed mit", None, "", "É Word WORD"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, row_key int")
    got = sorted(map(tuple, resampling.resample(edges, frame, settings).collect()), key=repr)
    assert got == naive_resample([r[:2] for r in brute.EDGES], target, settings)


def test_resampling_empty(spark, edges):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(edges.limit(0), none).collect() == []
    got = sorted(map(tuple, resampling.resample(edges, none).collect()), key=repr)
    assert got == naive_resample([r[:2] for r in brute.EDGES], [], resampling.Resampling())


def test_hot_id_is_drawn_in_part(spark):
    """A third of the rows repeat one document: ties are cut exactly, ranks are gapless."""
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t u")] * 300 + [
        (1000 + i, f"a b c d e f g h i j k l m n o p q r s t u {i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    settings = resampling.Resampling(percent=37)
    got = [tuple(r) for r in resampling.resample(
        frame, spark.createDataFrame([("a b",)], "text string"), settings).collect()]
    assert sorted(got, key=repr) == naive_resample(rows, ["a b"], settings)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 900 * 37 // 100 + 1))


def test_cutoff_counts_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(rng.integers(-3, 3, (400, 2)))]
    frame = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 57, 200, 399, 400):
        found = resampling.cutoff(frame, ("a", "b", "c"), k, probes=3)
        got = {tuple(r) for r in frame.filter(resampling.up_to(("a", "b", "c"), found)).collect()}
        assert got == set(sorted(rows)[:k])


def test_crcs_and_pieces(monkeypatch):
    texts = ["Aé中 " * 50, None, "", "x" * 500 + " y", "  ", "1,2;3" * 90]
    want = [(i, zlib.crc32(w.encode())) for i, t in enumerate(texts) for w in naive_words(t)]
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(resampling, "PIECE_BYTES", size)
        got = [x for d, c in resampling.hashed_words(pa.array(texts)) for x in zip(d.tolist(), c.tolist())]
        assert got == want


# hard negatives

def naive_mine(rows, k=5):
    usable = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        usable.append((vec_id, label, [math.floor(256 * v) for v in x]))
    out = []
    place = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for i, (anchor, label, x) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = [(v, sum(a * b for a, b in zip(x, y)), other) for j, (v, other, y) in enumerate(usable) if j != i]
        for p in sorted((s for s in scored if s[2] == label), key=place)[:k]:
            hard = sorted((s for s in scored if s[2] != label and 80 * p[1] <= 100 * s[1] <= 100 * p[1]), key=place)
            out.extend((anchor, p[0], r + 1, n[0], p[1], n[1]) for r, n in enumerate(hard[:k]))
    return sorted(out, key=repr)


def vector_rows(n=300, width=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (6, width))
    rows = [(i, [float(v) for v in np.float32(base[i % 6] + rng.normal(0, 0.3, width))], int(rng.integers(0, 4)))
            for i in range(n)]
    return rows


@pytest.mark.parametrize("levels, block_rows, block_anchors", [(1, 40, 2), (4, 10_000, 10_000), (7, 64, 1)])
def test_mining_any_codes_and_blocks(spark, levels, block_rows, block_anchors):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    settings = hardnegatives.Mining(levels=levels, block_rows=block_rows, block_anchors=block_anchors)
    got = sorted(map(tuple, hardnegatives.mine(frame, settings).collect()), key=repr)
    assert got == naive_mine(rows) and got


def test_mining_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(120) + [
        (100, [nan] * 24, 1), (200, None, 1), (200, [1.0, None], 1), (200, [inf], 1), (300, [1.0] * 24, None),
        (None, [1.0] * 24, 1), (None, [1.0] * 24, 2), (400, [], 1), (500, [0.0] * 24, 2), (700, [1.0] * 24, 9),
        (100, [2.0] * 24, 3), (100, [2.0] * 24, 3), (100, [2.0] * 24, 3), (5, [2.0] * 24, 3), (6, [2.0] * 24, 0),
        (6, [2.0] * 24, 0), (-100, [-1.0] * 24, 3), (8, [1.5] * 7, 3), (9, [-2.0] * 24, 1), (12, [2.0] * 80, 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit(7) for c in CLASHES}).repartition(3)
    got = sorted(map(tuple, hardnegatives.mine(frame).collect()), key=repr)
    assert got == naive_mine(rows)
    assert hardnegatives.mine(frame.limit(0)).collect() == []
    large = spark.createDataFrame([(100, [7e4], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        hardnegatives.mine(large).collect()


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.12, (500, 64))).astype(np.int64)
    widths = []
    for levels in (1, 2, 4, 8):
        turns = hardnegatives.rotations(64, levels, 11)
        assert all(np.allclose(t @ t.T, np.eye(64)) for t in turns)
        codes, alignments, rest = hardnegatives.coded(x, turns)
        block = hardnegatives.Block(pa.table({
            "row_key": np.arange(500), "vec_id": np.arange(500), "label": np.zeros(500, np.int64),
            "copies": np.ones(500, np.int64), "components": [r.astype("<i4").tobytes() for r in x],
            "codes": [r.tobytes() for r in codes],
            "facts": [r.tobytes() for r in np.column_stack([alignments, rest])]}), 64, turns)
        for a in range(0, 500, 50):
            low_, high = block.intervals(x[a])
            score = x @ x[a]
            assert (low_ <= score).all() and (score <= high).all()
        widths.append(float((high - low_).mean()))
    assert widths == sorted(widths, reverse=True) and widths[2] < 0.3 * widths[0]


# archives

PAGES = [
    (3, "http://WWW.a.com:80/x?y#z", "x" * 200), (3, "http://WWW.a.com:80/x?y#z", "x" * 200),
    (3, "http://WWW.a.com:80/x?y#z", "x" * 200), (2, None, "short"), (4, "http://e.org/", "short"),
    (1, "bad\turl\r\nX: y", None), (None, "//b", "x" * 200), (None, "//b", "x" * 200), (5, "http://q/", ""),
    (7, "é", "é" * 60), (6, "x", "é" * 60), (9, "http://a.com" + "/y" * 50_000, "z" * 1_000_000),
    (10, "http://c/", "k" * 99), (11, "http://c/", "k" * 99), (12, "http://c/", "k" * 100), (13, "http://c/", "k" * 100),
    (None, None, "n" * 500), (None, None, "n" * 500), (14, "http://d/", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20),
] + [(100 + i, "http://www.hot.com/", "hot" * 50) for i in range(700)]


def naive_captures(rows):
    groups = defaultdict(list)
    for k, (page_id, _, html) in enumerate(rows):
        payload = (html or "").encode()
        groups[hashlib.sha256(payload).hexdigest()].append((page_id is None, page_id or 0, k, len(payload), page_id))
    out = []
    for digest, found in groups.items():
        found.sort()
        for i, (_, _, _, size, page_id) in enumerate(found):
            again = size >= 100 and i > 0
            out.append((page_id, size, digest, "revisit" if again else "response", found[0][4] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return frame.withColumns({c: F.lit(7) for c in CLASHES}).repartition(3).cache()


def test_archive_edges(spark, pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == naive_captures(PAGES)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_small_files_blocks_and_directory(spark, pages):
    """Many files, blocks of few lines, one key over many blocks, short directory keys."""
    archive = warc.Archive(shared_folder(spark, "warc"), file_bytes=2000, block_lines=10, key_chars=4, chunk_bytes=500)
    assert sorted(map(tuple, warc.round_trip(pages, archive).collect()), key=repr) == naive_captures(PAGES)
    directory = warc.read_directory(spark, archive).collect()
    assert sum(r["lines"] for r in directory) == len(PAGES) and max(r["lines"] for r in directory) <= 10
    few = warc.Archive(shared_folder(spark, "warc"), block_lines=1, most_blocks=3)
    warc.archive_pages(pages, few)
    assert warc.read_directory(spark, few).count() <= 3 + 8


def test_look_up_and_payload(spark, pages):
    archive = warc.Archive(shared_folder(spark, "warc"), block_lines=5)
    warc.archive_pages(pages, archive)
    asked = spark.createDataFrame(
        [("https://a.com/x?y",), ("http://www.hot.com",), ("http://nobody.net/",), ("http://a.com/x?y",)], "url string")
    found = warc.look_up(asked.select(warc.url_key(F.col("url")).alias("url_key")), archive)
    assert found.groupBy("url_key").count().collect() and found.filter("page_id = 3").count() == 3
    got = warc.read_records(found, archive).collect()
    assert Counter(r["record_type"] for r in got if r["page_id"] != 3) == {"response": 1, "revisit": 699}
    one = [r for r in got if r["page_id"] == 3 and r["record_type"] == "response"]
    assert [bytes(r["payload"]) for r in one] == [b"x" * 200] and one[0]["url"] == "http://WWW.a.com:80/x?y#z"


def test_url_keys(spark):
    urls = ["http://user@WWW.Example.ORG:8080/a?b=1#c", "HTTPS://example.org", "//b.c", None, "a/b", "http://x.y?q"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r[0] for r in frame.orderBy("i").select(warc.url_key(F.col("url"))).collect()]
    assert got == ["org,example)/a?b=1", "org,example)/", "c,b)/", ")/", ")/a/b", "y,x)/?q"]


def test_records_are_checked():
    data = warc.record(1, "http://a/", "<p>é", 5, hashlib.sha256("<p>é".encode()).hexdigest(), "response", None, "u")
    assert warc.parsed(data)["payload"] == "<p>é".encode()
    assert zlib.decompress(gzip.compress(data), 31) == data
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError):
        warc.parsed(data[:-1])
