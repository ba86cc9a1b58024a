"""Selections on nulls, empty texts, ties and empty tables."""

from pyspark.sql import functions as F

from siftwell.operators import selection


def test_terms(spark):
    df = spark.createDataFrame([(1, "The end OF all", None), (2, None, "100% of the"), (3, "", "")], "id long, a string, b string")
    ids = lambda cond: [r.id for r in df.where(cond).orderBy("id").collect()]
    assert ids(selection.in_order(F.col("a"), ["the", "of"])) == [1] and ids(selection.in_order(F.col("a"), ["of", "the"])) == []
    assert ids(selection.in_order(F.col("b"), ["100%", "the"])) == [2] and ids(selection.in_order(F.col("b"), ["1%0"])) == []
    assert ids(selection.all_terms([F.col("a"), F.col("b")], ["OF", "the"])) == [1, 2]
    assert ids(selection.not_among(F.col("a"), [""])) == [1, 2]
    assert [r[0] for r in df.orderBy("id").select(selection.prefix_query(F.col("b"))).collect()] == [None, '"100"* "of"* "the"*', ""]


def test_best_and_first(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "x", 2.0), (3, "y", None), (4, None, -1.0)], "id long, k string, v double")
    assert {r.k: r.id for r in selection.best_of_each(df, "k", "v", "id").collect()} == {"x": 1, "y": 3, None: 4}
    a, b = df.where("id < 3").select("k", "v"), df.select("k", F.lit(9.0).alias("v"))
    assert {r.k: r.v for r in selection.first_of([a, b], ["k"]).collect()} == {"x": 2.0, "y": 9.0, None: 9.0}
    assert selection.serendipity(df.limit(0), F.col("v") > 0, "v", "id", 50).collect() == []
    assert [r.id for r in selection.serendipity(df, F.col("v") > 0, "v", "id", 50).collect()] == [4]
