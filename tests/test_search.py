"""The index, recall, platforms, calibration and retention, with expected values written down."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from siftwell.functions import platform
from siftwell.operators import analytics, postings, retrieval
from siftwell.sources import retention


def bm25f_by_hand(docs, terms, weights, k1=1.2, b=0.75):
    import re

    split = {d: {f: re.findall("[a-z0-9]+", (t or "").lower()) for f, t in fields.items()} for d, fields in docs.items()}
    mean = {f: sum(len(s[f]) for s in split.values()) / len(split) for f in weights}
    tf = {t: {d: sum(w * s[f].count(t) / (1 - b + b * len(s[f]) / mean[f]) for f, w in weights.items() if s[f]) for d, s in split.items()} for t in terms}
    out = {}
    for t in terms:
        df = sum(v > 0 for v in tf[t].values())
        for d, v in tf[t].items():
            if v > 0:
                out[d] = out.get(d, 0) + math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * v * (k1 + 1) / (v + k1)
    return out


def test_index_by_batches(spark, tmp_path):
    path, schema, names = f"file://{tmp_path}/index", "id long, title string, body string", {"title": "title", "body": "body"}
    one = [(1, "red fox", "the fox runs, the dog sleeps"), (2, None, "a red red dog"), (3, "", ""), (None, "fox", "fox"), (4, "fox", "fox " * 50)]
    two = [(2, "blue fox", "no more"), (5, "Fox!", None)]
    assert postings.search(spark, path, "fox", 5, {"title": 1.0}).collect() == []
    postings.add_batch(spark.createDataFrame(one, schema), path, 1, "id", names)
    postings.add_batch(spark.createDataFrame(two, schema), path, 2, "id", names)
    weights = {"title": 2.0, "body": 1.0}
    for again in range(2):
        docs = {i: {"title": t, "body": x} for i, t, x in one + two if i is not None}
        got = {r.id: r.score for r in postings.search(spark, path, "Fox dog red", 10, weights).collect()}
        want = bm25f_by_hand(docs, ["fox", "dog", "red"], weights)
        assert got == pytest.approx(want)
        if not again:  # a batch that is written again changes nothing
            postings.add_batch(spark.createDataFrame(two, schema), path, 2, "id", names)
    assert [r.rank for r in postings.search(spark, path, "Fox dog red", 2, weights).collect()] == [1, 2]
    assert postings.search(spark, path, "!!", 5, weights).collect() == []


def test_search_reads_only_the_folders_of_its_terms(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.add_batch(spark.createDataFrame([(n, f"word{n} common") for n in range(300)], "id long, body string"), path, 1, "id", {"body": "body"})
    plan = postings._read(spark, path, "postings", postings.POSTINGS).where(F.col("bucket").isin([3]) & F.col("term").isin(["word3"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan
    assert [r.id for r in postings.search(spark, path, "word17", 5, {"body": 1.0}).collect()] == [17]


def test_recall(spark):
    rows = [(1, "Use JWT for sessions", "chosen"), (2, "auth rewrite", None), (3, "author list", ""), (4, None, "auth rewrite"), (5, "unrelated", "x")]
    got = retrieval.recall(spark.createDataFrame(rows, "id long, what string, why string"), "id", {"what": 2.0, "why": 1.0}, "Auth rewrite about", 10)
    # the phrase is "auth rewrite about", which nobody has; terms: auth, its other names, rewrite
    assert [(r.id, r.score, r.matched) for r in got.collect()] == [(2, 8.0, ["what"]), (1, 4.0, ["what"]), (4, 4.0, ["why"]), (3, 2.0, ["what"])]
    both = retrieval.recall(spark.createDataFrame(rows, "id long, what string, why string"), "id", {"what": 1.0}, "auth rewrite", 2, F.when(F.col("id") == 3, 0.9), 10.0)
    assert [(r.id, r.score) for r in both.collect()] == [(3, 10.0), (2, 8.0)]


TARGETS = [
    (None, True), ("", True), ("cfg(windows)", False), ("cfg(unix)", True), ("cfg(not(windows))", True), ('cfg(target_os = "linux")', True), ('cfg(all(unix, not(target_os = "linux")))', False), ('cfg(any(windows, target_arch = "aarch64"))', False),
    ('cfg(any(windows, all(unix, target_arch="x86_64")))', True), ('cfg(not(any(target_os = "macos", target_os = "linux")))', False), ("cfg(not(not(all(unix, not(windows)))))", True), ('cfg(feature = "x")', True), ("cfg(miri)", True), ("cfg(all())", True), ("cfg(any())", False),
    ("x86_64-pc-windows-msvc", False), ("x86_64-unknown-linux-gnu", True), ("aarch64-unknown-linux-gnu", False), ("i686-unknown-linux-gnu", False), ("wasm32-unknown-unknown", True), ("aarch64-apple-darwin", False), ('cfg(any(windows, not(target_family = "windows"), miri))', True), ("cfg(all(unix, any(windows, all(not(unix)))))", False),
]


def test_platforms(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(TARGETS)], "n int, target string")
    got = {r.n: r.x for r in rows.select("n", platform.target_applies(F.col("target"), F.lit("linux"), F.lit("unix"), F.lit("x86_64")).alias("x")).collect()}
    assert [(t, got[n]) for n, (t, _) in enumerate(TARGETS)] == TARGETS


def test_sigmoid_fit(spark):
    rows = [(n, 0.3 + 0.001 * n) for n in range(60)] + [(100, None), (101, 0.001), (None, 0.5)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = analytics.sigmoid_fit(df, "s", "id").first()
    assert (got.n, got.mean, got.center) == (60, 0.3295, 0.3295)
    assert got.scale == 30.0
    few = analytics.sigmoid_fit(df.where("id < 40"), "s", "id").first()
    assert (few.n, few.center, few.scale) == (40, None, None)
    flat = analytics.sigmoid_fit(df.withColumn("s", F.lit(0.5)), "s", "id").first()
    assert flat.center is None
    a, b = analytics.sigmoid_fit(df, "s", "id", sample=55).first(), analytics.sigmoid_fit(df.repartition(7), "s", "id", sample=55).first()
    assert tuple(a) == tuple(b)


def test_retention(spark, tmp_path):
    root = f"file://{tmp_path}/{uuid.uuid4().hex}"
    items = spark.createDataFrame([(1, 10), (2, 5), (3, None)], "id long, age int")
    notes = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "id long, item long")
    runs = spark.createDataFrame([(n,) for n in range(9)], "n int")
    rules = [retention.Rule("items", keep=F.col("age") < 8), retention.Rule("notes", refers=(("item", "items", "id"),)), retention.Rule("runs", last=3, order=(F.desc("n"),))]
    tables = {"items": items, "notes": notes, "runs": runs, "other": items}
    assert retention.current(spark, root) == {}
    folders = retention.swap(spark, root, 1, retention.retained(tables, rules))
    kept = {name: sorted(map(tuple, spark.read.parquet(folder).collect()), key=str) for name, folder in folders.items()}
    assert kept == {"items": [(2, 5), (3, None)], "notes": [(2, 2), (3, None)], "runs": [(6,), (7,), (8,)], "other": [(1, 10), (2, 5), (3, None)]}
    assert retention.swap(spark, root, 1, {"items": items}) == folders  # a version is written once
    again = retention.retained({name: spark.read.parquet(f) for name, f in folders.items()}, rules)
    assert {name: df.count() for name, df in again.items()} == {name: len(rows) for name, rows in kept.items()}
    assert retention.current(spark, root) == folders


def test_leaned_query(spark):
    q = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    mine = spark.createDataFrame([([0.0, 1.0],), ([0.0, 3.0],), ([0.0, 0.0],), ([1.0, 2.0, 3.0],), (None,)], "m array<double>")
    got = retrieval.leaned(q, "v", mine, "m", 0.25).first().vector
    norm = math.hypot(0.75, 0.5)
    assert got == pytest.approx([0.75 / norm, 0.5 / norm])
    assert retrieval.leaned(q, "v", mine, "m", 9.0).first().vector == pytest.approx([0.5 / math.hypot(0.5, 1.0), 1.0 / math.hypot(0.5, 1.0)])
    assert retrieval.leaned(q, "v", mine, "m", 0.0).first().vector == [1.0, 0.0]
    assert retrieval.leaned(q, "v", mine.where("false"), "m", 0.3).first().vector == [1.0, 0.0]


def test_find_keeps_the_best_of_a_path(spark):
    schema = "id long, path string, relevance double"
    near = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.5), (3, None, 0.4)], schema)
    told = spark.createDataFrame([(4, "a", 0.95), (5, "b", 0.5), (6, None, 0.4), (7, "c", 0.1)], schema)
    got = [(r.id, r.by) for r in retrieval.find(near, told, "path", "id", 4).collect()]
    assert got == [(4, "keyword"), (2, "vector"), (3, "vector"), (6, "keyword")]


def test_recall_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "C++, for\n\nall"), (2, "c++ forall"), (3, "(C++)"), (4, "c+++ for all"), (5, "for -- all, c++")], "id long, what string")
    got = retrieval.recall(docs, "id", {"what": 1.0}, "C++ for all", 10)
    assert [(r.id, r.score) for r in got.collect()] == [(1, 10.0), (5, 6.0), (4, 5.0), (2, 4.0), (3, 2.0)]
    plan = got._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_tasks_of_a_batch_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TASK_BYTES", 2000)
    rows = [(n, f"word{n} common " * 20) for n in range(600)]
    postings.add_batch(spark.createDataFrame(rows, "id long, body string"), f"file://{tmp_path}/index", 1, "id", {"body": "body"})
    found = postings._read(spark, f"file://{tmp_path}/index", "postings", postings.POSTINGS)
    common = found.where("term = 'common'").groupBy(F.input_file_name()).count().collect()
    assert len(common) > 1 and max(r["count"] for r in common) < 600 / 4
    assert found.count() == 1200 and postings.search(spark, f"file://{tmp_path}/index", "word17", 5, {"body": 1.0}).first().id == 17
