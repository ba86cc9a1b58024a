"""Importance resampling, line dedup and hard negatives against brute force and SQL, and on odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import hard_negatives, importance_resampling, line_dedup, oracles, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_dropped string, keep int, at string, _k string"
LONG = "one line that is long enough\n" * 40_000
ODD = [
    (1, None, "x", 1, "y", "z"), (2, "", "x", 1, "y", "z"), (3, "  The Same Line here \nshort\n\x0bthe same line HERE\t", "x", 1, "y", "z"), (4, "the same line here\nown line of this one", "x", 1, "y", "z"),
    (4, "the same line here\nown line of this one", "x", 1, "y", "z"), (4, "another text of the id\nthe same line here", "x", 1, "y", "z"), (None, "the same line here\nonly of the null ids", "x", 1, "y", "z"),
    (None, "only of the null ids\n", "x", 1, "y", "z"), (6, LONG, "x", 1, "y", "z"), (7, "z" * 3_000_000, "x", 1, "y", "z"), (8, "ünïcödé lïnê äöü\nünïcödé lïnê äöü", "x", 1, "y", "z"), (9, "ÜNÏCÖDÉ LÏNÊ ÄÖÜ\nünïcödé lïnê äöü", "x", 1, "y", "z"), (5, LONG + "ééééééééé", "x", 1, "y", "z"), (10, "ééééééééé", "x", 1, "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def same_as_twin(spark, duck, name, sql):
    df = queries.queries()[name](spark, DATA)
    run = duck.execute(sql)
    there = [x[0] for x in run.description]
    assert sorted(there) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in there) for r in df.collect()) == sorted(run.fetchall())


# 11: importance resampling


def features_by_hand(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(words), [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def resampled_by_hand(docs, target, percent=5, least=20):
    counted = [(d, *features_by_hand(t)) for d, t in docs]
    count = lambda rows: collections.Counter(zlib.crc32(f.encode()) % 10_000 for _, _, fs in rows for f in fs)
    s, t = count(counted), count([(0, *features_by_hand(x)) for x in target])
    n_s, n_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000) / ((s[b] + 1.0) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, words, fs in counted:
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = queries.queries()["op11_importance_resampling"](spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_hand(docs, target)


def test_resampling_odd(spark, odd):
    target = spark.createDataFrame([("the same line",), (None,), ("",)], "text string")
    got = importance_resampling.resample(odd, target, percent=50, least_words=4)
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_hand([r[:2] for r in ODD], ["the same line", None, ""], 50, 4)
    nothing = spark.createDataFrame([], DOCS)
    assert importance_resampling.resample(nothing, target).collect() == []
    assert importance_resampling.resample(odd, nothing).count() == len(ODD)


def test_texts_in_pieces_have_the_same_counts(monkeypatch):
    text = b"Alpha beta, gamma-delta " * 50 + "é1 Z".encode() * 30 + b"x" * 700 + b" end"
    whole = importance_resampling.bucket_counts(text)
    for piece in (1, 7, 64, 500):
        monkeypatch.setattr(importance_resampling, "PIECE", piece)
        n, counts = importance_resampling.bucket_counts(text)
        assert n == whole[0]
        assert (counts == whole[1]).all()


def test_blocks_of_any_size_hold_the_matrix(spark, odd, monkeypatch):
    monkeypatch.setattr(importance_resampling, "BLOCK_DOCS", 2)
    blocks = importance_resampling.count_blocks(odd.coalesce(1))
    sums = importance_resampling.column_sums(blocks)
    want = collections.Counter(zlib.crc32(f.encode()) % 10_000 for r in ODD for f in features_by_hand(r[1])[1])
    assert {k: int(v) for k, v in enumerate(sums) if v} == dict(want)


# 12: line dedup


def dropped_by_hand(rows):
    """Positions that each row loses."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda d: (d is None, d or 0)
    least = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            least[key(line)] = min(least.get(key(line), order(d)), order(d))
    return [[at for at, line in enumerate((text or "").split("\n")) if len(key(line)) >= 10 and least[key(line)] < order(d)] for d, text in rows]


def lines_by_hand(rows):
    for (d, text), drop in zip(rows, dropped_by_hand(rows), strict=True):
        lines = (text or "").split("\n")
        gone = set(drop)
        kept = "\n".join(line for at, line in enumerate(lines) if at not in gone)
        yield d, len(lines), len(drop), hashlib.sha256(kept.encode()).hexdigest()


def test_lines_equal_sql(spark, duck):
    same_as_twin(spark, duck, "op12_line_dedup", oracles.OP12)


def test_lines_digest_takes_few_texts_at_once(spark, odd, monkeypatch):
    held = {}
    real = line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, label: held.update({label: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))}) or real(df, label))
    got = line_dedup.line_digest(odd)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert {held[label] for label in ("lines", "line-digests")} == {line_dedup.BATCH_TEXTS}


@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_lines_odd(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(line_dedup.keep_bitmaps, "__defaults__", (10, rows if rows > 1000 else 4_000))
    got = sorted(map(tuple, line_dedup.line_digest(odd).collect()), key=str)
    assert got == sorted(lines_by_hand([r[:2] for r in ODD]), key=str)
    assert line_dedup.line_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_ranges_within_one_hash(spark):
    rows = [(k, "a line that every document holds\n" * (1 + k % 3) + f"{'own of ' if k % 2 else 'shared by a '}{k // 4:06d}") for k in range(400)] + [(None, "a line that every document holds")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    maps = line_dedup.keep_bitmaps(df, range_rows=40)
    want = collections.Counter({(r[0], len(drop)) for r, drop in zip(rows, dropped_by_hand(rows), strict=True) if drop})
    assert collections.Counter((None if r.none else r.doc_id, r.n_dropped) for r in maps.collect()) == want
    assert sorted(map(tuple, line_dedup.line_digest(df).collect()), key=str) == sorted(lines_by_hand(rows), key=str)


def test_documents_keep_their_columns(spark, odd):
    got = line_dedup.without_repeated_lines(odd)
    assert got.schema == odd.schema
    want = []
    for row, drop in zip(ODD, dropped_by_hand([r[:2] for r in ODD]), strict=True):
        gone = set(drop)
        text = None if row[1] is None else "\n".join(line for at, line in enumerate(row[1].split("\n")) if at not in gone)
        want.append((row[0], text, *row[2:]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# 13: hard negatives


def mined_by_hand(rows, every=50, positives=5, negatives=3):
    usable = {}
    for vec_id, label, x in sorted((r for r in rows if None not in r[:2] and r[2]), key=lambda r: (r[0], r[1], r[2] if None not in r[2] else [])):
        if None not in x and np.isfinite(x).all():
            usable.setdefault(vec_id, (label, np.floor(256 * np.array(x, np.float64))))
    out = []
    for a, (label, x) in usable.items():
        if a % every:
            continue
        ranked = sorted((-int(x @ y), b, m) for b, (m, y) in usable.items() if b != a and len(x) == len(y))
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [r for r in ranked if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s][:negatives]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b, _) in enumerate(fit)]
    return sorted(out)


def clustered(n, width, seed, groups=12, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    x = centres[rng.integers(groups, size=n)] + spread * rng.standard_normal((n, width)) * rng.random((n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_negatives_equal_sql(spark, duck):
    same_as_twin(spark, duck, "op13_hard_negatives", oracles.OP13)


@pytest.mark.parametrize(("segment", "block", "first"), [(16, 4, 0.02), (64, 8, 0.25), (1024, 256, 0.25)])
def test_negatives_equal_brute_force(spark, monkeypatch, segment, block, first):
    for name, value in (("SEGMENT", segment), ("BLOCK", block), ("FIRST_RADIUS", first)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    x = clustered(700, 8, 1).tolist() + [[0.5] * 8] * 60 + (clustered(80, 3, 2) * rng.random((80, 1)) * 5).tolist()
    rows = [(k, int(rng.integers(4)), v) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined_by_hand(rows, every=20)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[0] for r in want}) > 20


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (2, 3, [0.1, 0.1]), (3, None, [0.7, 0.3]), (4, 2, None), (5, 2, [nan, 0.5]), (6, 2, [None, 0.7]), (7, 2, [inf, 0.0]), (8, 2, [1e308, 0.0]), (None, 2, [0.7, 0.3]), (50, 9, [0.0, 0.0]), (100, 1, [0.5, 0.5, 0.5]), (9, 2, [])]
    schema = "vec_id long, label int, embedding array<double>, block string, anchor int, rank int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    want = mined_by_hand([r for r in rows if r[0] != 8], positives=5)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == want
    assert want
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    none = hard_negatives.hard_negatives(df, F.lit(None).cast("boolean"))
    assert none.collect() == []
    wide = spark.createDataFrame([(k, k % 2, [0.01 * (k + 1)] * 5000) for k in range(12)], "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(wide, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand([(k, k % 2, [0.01 * (k + 1)] * 5000) for k in range(12)], every=5)
