"""Topics and links with expected values written down."""

from pyspark.sql import functions as F

from siftwell.operators import links, stories, topics


def test_topics(spark):
    rows = [
        (1, "Rust async patterns for Tauri apps", "A guide to async Rust", None), (2, "Building a Rust web server", "Using async with PostgreSQL database", None),
        (3, "Machine Learning with Python", "Deep learning and open source tools", None), (4, "C++ programming", "Using C++ for systems, next.js", []), (5, "", "", None), (6, None, None, None),
        (7, "plain words", "nothing here", ["Rust", "async-sql", "open source", None, "unknown", "x-y"]), (8, "The Big (Gizmo) Über-fast v2 Go", "gopher going", None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, content string, tags array<string>")
    got = {r.id: r.t for r in df.select("id", topics.topics(F.col("title"), F.col("content"), F.col("tags")).alias("t")).collect()}
    assert got[1] == ["rust", "tauri"]
    assert got[2] == ["rust", "postgresql", "database"]
    assert got[3] == ["python", "machine learning", "deep learning", "open source", "machine"]
    assert got[4] == ["next", "c++", "next.js"]
    assert got[5] == got[6] == []
    assert got[7] == ["rust", "sql", "open source"]
    assert got[8] == ["go", "gizmo", "über-fast"]


def test_dictionary(spark):
    book = spark.createDataFrame([("new york",), ("new york times",), ("york",), ("Times",), ("!!",), (None,), ("york",)], "phrase string")
    items = spark.createDataFrame([(1, "The New York Times of york; new   YORK"), (2, None), (3, ""), (4, "new"), (5, "times new york times new york")], "id long, text string")
    got = sorted(tuple(r) for r in topics.dictionary_matches(items, "id", "text", book).select("id", "start", "phrase").collect())
    assert got == [(1, 1, "new york times"), (1, 5, "york"), (1, 6, "new york"), (5, 0, "Times"), (5, 1, "new york times"), (5, 4, "new york")]
    assert topics.dictionary_matches(items, "id", "text", book.where("false")).collect() == []


def test_links_have_the_best_proof(spark):
    names = spark.createDataFrame([("serde_json",), ("@acme/data-grid",), ("async-trait",), ("react",), ("tokio",), ("requests",), ("log",), (None,), ("tokio",), ("github.com/x/y",)], "name string")
    rows = [
        (1, "crates_io", "crate-serde-json", "New release", "", None), (2, "npm_registry", "@acme/data-grid@1.2.3", "tokio inside", "", None), (3, "pypi", "requests-2.31.0", "x", "", None), (4, "crates", "crate-log", "y", "", None),
        (5, "osv", "", "Flaw in react", "Summary\n  Affected: Async_Trait (crates.io), other (npm)\nmore", None), (6, "rss", "", "Flaw in React!", "no list", "security_advisory"), (7, "rss", "", "react-native and react_query, log", "", None),
        (8, "rss", "", "Why async_trait: a look at (tokio)", "", None), (9, "rss", "", "moving github.com/x/y to github.com/x/yy", "", None), (10, "cve", "", "tokio flaw", "Affected: unknown", None), (11, None, None, None, None, None), (12, "rss", "", "иreact @acme/data-grid2 @acme/data-grid", "", None),
    ]
    items = spark.createDataFrame(rows, "item_id long, source_type string, source_id string, title string, content string, content_type string")
    got = sorted((r.item_id, r.name, r.proof, r.confidence) for r in links.dependency_links(items, names).collect())
    assert got == [
        (1, "serde_json", "exact_registry", 0.95), (2, "@acme/data-grid", "exact_registry", 0.95), (2, "tokio", "title_heuristic", 0.5), (3, "requests", "exact_registry", 0.95), (4, "log", "exact_registry", 0.95), (5, "async-trait", "advisory", 0.9),
        (6, "react", "advisory", 0.75), (8, "async-trait", "title_heuristic", 0.5), (8, "tokio", "title_heuristic", 0.5), (9, "github.com/x/y", "title_heuristic", 0.5), (10, "tokio", "advisory", 0.75), (12, "@acme/data-grid", "title_heuristic", 0.5),
    ]


def test_topic_clusters(spark):
    rows = [
        (1, 0.9, "hn", "Engine improves joins", [1.0, 0.0]), (2, 0.5, "rss", "Engine broken by joins", [1.0, 0.01]), (3, 0.8, "hn", "Other", [0.0, 1.0]), (4, 0.1, "hn", "noise", [1.0, 0.0]), (5, 0.7, "x", "zero", [0.0, 0.0]),
        (6, 0.4, None, "Engine v2.1 release notes", [0.8, 0.65]), (7, 0.3, "dev", "engine v2.4 release notes", [0.8, -0.1]), (8, 0.3, "dev", "null", None), (9, None, "dev", "null", [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "id long, score double, source string, title string, vector array<double>")
    got = {r.id: (r.cluster, r["size"], r.sources, r.bonus, r.mixed) for r in stories.topic_clusters(df).collect()}
    assert got == {1: (1, 4, 4, 0.15, True), 2: (1, 4, 4, 0.15, True), 6: (1, 4, 4, 0.15, True), 7: (1, 4, 4, 0.15, True), 3: (3, 1, 1, 0.0, False)} | ({5: got[5]} if 5 in got else {})


def test_stories(spark):
    from siftwell.operators.graph import components

    keys = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (None, "a"), (4, "c")], "id long, key string")
    assert {r.id: r.story for r in stories.collapsed(keys, components).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
