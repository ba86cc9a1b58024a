"""Operators that SQL cannot express, and library parts without a registered query."""

import io
import json
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.functions import numeric, text
from siftwell.operators import dedup, graph, matching, retrieval, sequences
from siftwell.sources import readers, sinks
from siftwell.streaming import jobs

DATA = "/root/testdata/sf0.001"


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(value.alias("x")).first().x


@pytest.mark.parametrize(("url", "want"), [("HTTP://www.Example.com/a/?utm_source=x&b=2&a=Q#f", "https://example.com/a?a=Q&b=2"), ("https://m.ex.net/", "https://m.ex.net"), ("https://ex.net/p?ref=1", "https://ex.net/p")])
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonical_url(F.col("u")), u=url) == want


def test_text_helpers(spark):
    assert one(spark, text.preprocess(F.col("h")), h="<p>a &amp; b</p><script>x</script> https://x.y/z  c") == "a & b c"
    assert one(spark, text.cve_ids(F.col("t")), t="cve-2024-12345 and CVE-2024-12345, CVE-2023-0001") == ["CVE-2023-0001", "CVE-2024-12345"]
    assert json.loads(one(spark, text.redact_fields(F.col("j")), j='{"a": {"api_key": "s", "n": 1}}')) == {"a": {"api_key": "[REDACTED]", "n": 1}}
    assert one(spark, text.chunks(F.col("t"), 10), t="aaaa\n\nbbbb\n\ncccccccccccc\nd") == ["aaaa\nbbbb", "cccccccccccc", "d"]
    assert one(spark, text.contains_word(F.col("t"), "go"), t="let's go!") and not one(spark, text.contains_word(F.col("t"), "go"), t="gopher")
    assert [one(spark, text.stem(F.col("w")), w=w) for w in ("running", "parties", "cats", "class")] == ["runn", "party", "cat", "class"]


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0", "v1.2", "1.10.0", "2"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(numeric.version(F.col("v"))).collect()] == order
    deps = spark.createDataFrame([("a-b", "npm", "1.5.0"), ("a-b", "npm", "2.0.0"), ("A_B", "npm", None), ("a-b", "pypi", "1.5.0")], "name string, ecosystem string, version string")
    adv = spark.createDataFrame([("X", "a_b", "npm", "1.0.0", "2.0.0", None)], "advisory_id string, package string, ecosystem string, introduced string, fixed string, last string")
    found = matching.matched_advisories(deps, adv)
    assert sorted((r.name, str(r.version), r.confirmed) for r in found.collect()) == [("A_B", "None", False), ("a-b", "1.5.0", True)]
    assert matching.upgrade_plan(found.withColumn("name", F.lit("a-b"))).first().upgrade_to == "2.0.0"


def test_curves(spark):
    assert one(spark, numeric.piecewise(F.lit(0.5), [(0.0, 0.0), (1.0, 2.0)])) == 1.0
    assert one(spark, numeric.sigmoid(F.lit(0.48))) == 0.5
    assert one(spark, numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_fuzzy_is_greedy_by_score(spark):
    rows = [(1, 1.0, "a b c d".split()), (2, 3.0, "a b c d e".split()), (3, 2.0, "a b c d e f".split()), (4, 0.5, "x y".split())]
    got = {r.id: (r.kept_id, r.similar_count) for r in dedup.fuzzy(spark.createDataFrame(rows, "id long, score double, w array<string>"), "id", "w", "score").collect()}
    assert got == {1: (2, 0), 2: (2, 2), 3: (2, 0), 4: (4, 0)}


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for g in ((1, 2, 3, 4), (11, 12, 13, 14)) for a in g for b in g if a < b] + [(4, 11, 0.1)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert got == {n: 1 if n < 10 else 11 for n in (1, 2, 3, 4, 11, 12, 13, 14)}


def test_hops(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 5.0), (8, 9, 0.1), (9, 10, 0.1)], "a long, b long, weight double")
    strong = edges.where("weight > 1").union(spark.createDataFrame([(90, 91, 0.0), (92, 93, 0.0), (94, 95, 0.0), (96, 97, 0.0)], "a long, b long, weight double"))
    assert {r.id: r.hop for r in graph.hops(strong, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_parse():
    q = retrieval.parse("How many rust articles from last week?")
    assert (q.intent, q.days) == ("count", 7) and "rust" in q.keywords


def test_breaker(spark):
    rows = [(1, i, f"2024-01-01 00:0{i}:00", i != 0) for i in range(6)] + [(2, 0, "2024-01-01 00:00:00", True), (2, 1, "2024-01-01 00:01:00", False)]
    df = spark.createDataFrame(rows, "k int, o int, s string, failed boolean").withColumn("ts", F.col("s").cast("timestamp"))
    assert sorted((r.k, r.failures, r.is_open) for r in sequences.breaker_states(df, "k", "ts", "o", "failed").collect()) == [(1, 5, True), (2, 0, False)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"objectID": "1", "title": "T", "url": "u", "created_at": "2024-01-02T00:00:00Z", "tags": ["x"]}\n{"title": "no id"}\n')
    row = readers.REGISTRY["hackernews"](spark, str(tmp_path / "a.json")).collect()
    assert [(r.source_id, r.title, r.tags) for r in row] == [("1", "T", ["x"])] and row[0].published_at.year == 2024
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    feed = readers.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (feed.title, feed.source_id, feed.published_at.day) == ("A", "l", 2)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("n/one.txt", "hello")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(body.getvalue())
    assert [(r.entry, r.text) for r in readers.archive_entries(spark, str(tmp_path / "z")).collect()] == [("n/one.txt", "hello")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "package.json").write_text('{"dependencies": {"left": "1.0.0"}, "devDependencies": {"t": "2"}}')
    (tmp_path / "p" / "requirements.txt").write_text("numpy==1.2\n# note\nx>=3\n")
    deps = readers.manifest_dependencies(readers.discover_projects(spark, str(tmp_path / "p")))
    assert sorted((r.ecosystem, r.name, r.version, r.is_dev) for r in deps.collect()) == [("npm", "left", "1.0.0", False), ("npm", "t", "2", True), ("pypi", "numpy", "1.2", False), ("pypi", "x", None, False)]


def test_command_source(spark):
    spark.dataSource.register(readers.CommandSource)
    code = "import json,sys; c=json.load(sys.stdin); print(json.dumps([{'title': f\"t{c['partition']}\", 'url': None, 'content': c['w']}]))"
    df = spark.read.format("command").option("command", json.dumps([sys.executable, "-c", code])).option("config", '{"w": "x"}').option("partitions", "2").load()
    assert sorted((r.title, r.content) for r in df.collect()) == [("t0", "x"), ("t1", "x")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "s3cret")], "name string, api_token string")
    sinks.export_json(df, str(tmp_path / "j"))
    assert "s3cret" not in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    sinks.export_csv(df, str(tmp_path / "c"), ("api_token",))
    assert "[REDACTED]" in "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.events_stream(spark, str(tmp_path / "in"), e.schema, 1)
    seen = {}

    def sink(batch, n):
        seen.update({r.user_id: r.failures for r in batch.collect()})

    jobs.run_each_batch(jobs.breakers(stream().withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed"), str(tmp_path / "c1"), sink)
    assert set(seen) == {r.user_id for r in e.select("user_id").distinct().collect()}
    first = jobs.run_available(jobs.first_seen(stream(), ["event_id"], "ts", "60 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert first.count() == e.count()
    closed = jobs.run_available(jobs.sessions(stream(), "user_id", "ts", "30 minutes", "40 days"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert closed.count() <= sequences.merge_windows(e, ["user_id"], "ts", 30).count()


def test_exact_dedup_keeps_the_least_of_equal_titles(spark, tmp_path):
    from siftwell.plans import texts

    rows = [(1, "A title", 7), (2, "...A title!!!", 13), (3, "", 0), (4, "!?", 2), (5, None, 0), (6, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in texts.exact_dedup(spark, str(tmp_path)).collect()) == [1, 3, 4, 5]


def test_few_pairs_of_word_sets_reach_the_comparison_of_words(spark, monkeypatch):
    rows = [(n, [f"w{n}-{i}" for i in range(60)] + [f"common{n // 2}-{i}" for i in range(40)]) for n in range(40)] + [(90, [f"w0-{i}" for i in range(60)] + [f"common0-{i}" for i in range(38)])]
    written = {}

    def staged(df, label, real=dedup.staged):
        out = written[label] = real(df, label)
        return out

    monkeypatch.setattr(dedup, "staged", staged)
    pairs, _ = dedup.similar_sets(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", 0.5)
    assert [(r.a, r.b, round(r.similarity, 6)) for r in pairs.collect()] == [(0, 90, 0.98)]
    assert written["word-candidates"].count() == 1
    for r in dedup.sketches(written["word-sets"].select("s.id", "n", F.col("s.w").alias("w"))).collect():
        assert sum((v & (2**64 - 1)).bit_count() for v in r[2:]) % 2 == r.n % 2 and r.n - 50 <= sum((v & (2**64 - 1)).bit_count() for v in r[2:]) <= r.n
