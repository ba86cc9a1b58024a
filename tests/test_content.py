"""Content features and feedback on nulls, empty texts, ties and empty tables."""

from pyspark.sql import functions as F

from siftwell.functions import content
from siftwell.operators import feedback, matching, sequences


def test_classes(spark):
    rows = [("CVE-2025-1234: Critical RCE in OpenSSL", ""), ("He just crawled through hell to fix the browser...", ""), (None, None), ("", "x" * 2001), ("Weekly notes", "see cve 2024"), ("Forced entry", ""), ("Engineer: how to interview", ""), ("How to interview", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, title string, body string")
    got = [r.c.name for r in df.orderBy("id").select(content.content_class(F.col("title"), F.col("body")).alias("c")).collect()]
    assert got == ["security_advisory", "clickbait", "discussion", "deep_dive", "security_advisory", "discussion", "hiring", "tutorial"]


def test_versions(spark):
    cases = [
        ("1.2.3-rc.1", "^1.2", False), ("1.2.3-rc.1", ">= 1.2.3-beta, < 2", True), ("1.2.3-alpha", "> 1.2.3-beta", False), ("v1.2", "= 1.2", True), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False),
        ("0.4.0", "^0", True), ("1.0.0", "^0", False), ("1.9.0", "<= 1", True), ("2.0.0", "<= 1", False), (None, "< 1", True), ("junk", "< 1", True), ("2.0.0", None, True), ("2.0.0", "any", True), ("2.0.0", "", True),
    ]
    df = spark.createDataFrame([(i, v, r) for i, (v, r, _) in enumerate(cases)], "id long, v string, r string")
    assert [x.m for x in df.orderBy("id").select(content.meets(F.col("v"), F.col("r")).alias("m")).collect()] == [m for _, _, m in cases]


def test_titles(spark):
    df = spark.createDataFrame([(0, ""), (1, "A calm account of four things"), (2, "THIS IS LOUD TEXT!!")], "id long, t string")
    rows = df.orderBy("id").select(F.round(content.title_quality(F.col("t")), 6).alias("q"), content.strong_bait(F.col("t")).alias("s"), content.depth(F.lit(None).cast("string")).alias("d"), content.ecosystem(F.lit(" PIP ")).alias("e")).collect()
    assert [r.q for r in rows] == [0.65, 1.0, 0.5] and not any(r.s for r in rows) and rows[0].d == 0.3 and rows[0].e == "PyPI"


def test_feedback(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "x"), ("a", 2, None, None), (None, 3, 1.0, "x")], "k string, at long, s double, v string")
    assert {r.k: r.value for r in feedback.last_write(df, "k", ["at"], "v").collect()} == {"a": None, None: "x"}
    assert feedback.accuracy(df, "k", "s", least=1).collect()[0].n == 2
    assert feedback.accuracy(df.limit(0), "k", "s").collect() == [] and feedback.threshold(df.limit(0), F.lit(True), 0.4).first().threshold == 0.4
    assert [(r.shared, r.own) for r in feedback.convergence(df, "k", "v").where("k = 'a'").collect()] == [(0, 1)]
    acts = spark.createDataFrame([("click", 30.0, None, 0.0), ("click", 600.0, "bounced", 0.0), ("nothing", 1.0, None, 0.0), ("complete", 600.0, None, 2.0)], "a string, s double, p string, d double")
    assert [round(r[0], 6) for r in acts.select(feedback.strength(F.col("a"), F.col("s"), F.col("p"), F.col("d"))).collect()] == [1.0, -0.4, 0.0, 1.0]


def test_pairs_in_time(spark):
    e = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:00"), (3, None, "2024-01-01 00:00:00"), (4, "b", None), (5, "b", "2024-01-01 10:00:00")], "event_id long, k string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    later = spark.createDataFrame([(7, "a", "2024-01-01 00:00:00"), (8, "a", "2024-01-02 00:00:00"), (9, "a", "2024-01-02 00:00:01"), (6, "b", "2024-01-01 09:00:00"), (10, None, "2024-01-03 00:00:00")], "event_id long, k string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = sequences.first_after(e, later, "k", "ts", "ts", "event_id").collect()
    assert {r.event_id: r.incident_id for r in got} == {1: 8, 2: 8, 3: None, 4: None, 5: None} and len(got) == 5
    assert sequences.first_after(e.limit(0), later, "k", "ts", "ts", "event_id").collect() == []
    pairs = matching.paired_within(e, later, "k", "ts", 24).collect()
    assert sorted((r.event_id, r.later_id) for r in pairs) == [(1, 7), (1, 8), (2, 7), (2, 8)]
