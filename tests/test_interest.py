"""Interests, competitors and form, with expected values worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import content, interest


def column(spark, expression, rows, schema):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, {schema}")
    return [r.x for r in df.select("n", expression.alias("x")).orderBy("n").collect()]


def score(spark, interests, rows, aliases=None):
    return column(spark, interest.keyword_interest(F.col("title"), F.col("body"), interests, aliases), rows, "title string, body string")


def test_keyword_interest(spark):
    rows = [("Rust in production", ""), ("News", "on rust and more"), ("News", "x " * 150 + "rust"), ("Frustrating times", "trusty"), ("Goodbye", "we stopped using rust"), (None, None), ("Rusting hulls", "")]
    got = score(spark, {"rust": 1.0}, rows)
    assert got == pytest.approx([0.80, 0.65, 0.55, 0.0, 0.325, 0.0, 0.65])
    assert score(spark, {"rust": 0.5, "ai": 1.0, "x": 1.0}, [("Rust", ""), ("AI everywhere", ""), ("x", "x")]) == pytest.approx([0.40, 0.80, 0.0])
    phrase = score(spark, {"data lake": 1.0}, [("A data lake", ""), ("A", "the data lake"), ("No", "replacing data lake tools"), ("Data of a lake", ""), ("Data", "")])
    assert phrase == pytest.approx([0.95, 0.80, 0.40, 0.80, 0.40])
    assert score(spark, {"llm": 1.0}, [("Many LLMs", ""), ("language model news", ""), ("", "talk of llms")], {"llm": ("language model",)}) == pytest.approx([0.80, 0.80, 0.55])
    assert score(spark, {}, [("Rust", "")]) == [0.0]


def test_competitors(spark):
    rows = [("Electron 30 released", "", None), ("Tauri vs Electron", "", None), ("Electron 30", "as tauri users know", None), ("Electron 30 benchmark", "", None), ("Frameworks", "", ["Electron"]), ("Gardening", "", []), (None, None, None), ("React and Vue", "", None), ("Svelte news", "", None)]
    got = column(spark, interest.competing_factor(F.col("title"), F.col("body"), F.col("topics"), ("tauri", "React", "vue")), rows, "title string, body string, topics array<string>")
    assert got == [0.50, 1.0, 0.80, 0.85, 0.70, 1.0, 1.0, 1.0, 0.50]


def test_losses(spark):
    one = lambda f, *t: column(spark, f(F.col("t")), [(x,) for x in t], "t string")
    assert one(content.repeated_words, "cache cache cache", "cache cache", "cache cache CACHE cache", "that that that that", "") == [-0.10, 0.0, -0.20, 0.0, 0.0]
    assert one(content.few_words, "a a a b", "a b", "", "x x x") == [0.0, 0.0, 0.0, -0.15]
    assert one(content.part_of_series, "3/12 on queues", "Day 4: caches", "part 2 — more", "Daylight: saving", "1000/1 odds", "A thread on locks", "days") == [-0.25, -0.25, -0.25, 0.0, 0.0, -0.25, 0.0]
    rows = [("Widgets gadgets sprockets", "nothing of it at last"), ("Widgets gadgets sprockets", "widgets alone"), ("Widgets gadgets sprockets", "gadgets, WIDGETS"), ("Widgets gadgets", "other things"), ("Widgets gadgets sprockets", "")]
    assert column(spark, content.unlike_body(F.col("t"), F.col("b")), rows, "t string, b string") == [-0.20, -0.10, 0.0, 0.0, 0.0]


def test_quality_factor(spark):
    rows = [
        ("Cutting tail latency in a queue service", "", "https://github.com/x"), ("Cutting tail latency in a queue service", "", "https://medium.com/x"), ("You won't believe this one trick!!", "", None), ("9 ways", "", None), (None, None, None),
    ]
    got = column(spark, content.quality_factor(F.col("t"), F.col("b"), F.col("u")), rows, "t string, b string, u string")
    # title 1, depth 0.3, address 1.15: (0.5 + 0.09 + 0.23) * 0.7 + 0.5, and a comparison word: + 0.01
    assert got[0] == pytest.approx(0.82 * 0.7 + 0.51)
    assert got[1] == pytest.approx(0.76 * 0.7 + 0.51)
    # bait and marks: title 0.5; vague and dense words none
    assert got[2] == pytest.approx((0.5 * 0.5 + 0.09 + 0.2) * 0.7 + 0.5)
    # two words and a list: title 0.5
    assert got[3] == pytest.approx((0.5 * 0.5 + 0.09 + 0.2) * 0.7 + 0.5)
    assert got[4] == pytest.approx((0.65 * 0.5 + 0.09 + 0.2) * 0.7 + 0.5)


def test_a_word_that_the_beginning_cuts_is_not_the_term(spark):
    body = "x" * 196 + " rust" + "ed hulls"  # the first 200 characters end within the word
    assert score(spark, {"rust": 1.0}, [("News", "x" * 195 + " rusted hulls"), ("News", body)]) == pytest.approx([0.45, 0.45])
