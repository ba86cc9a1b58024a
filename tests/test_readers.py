"""Manifests, files by extension, sections, origins and mirrored advisories."""

import json
import zipfile
import zlib

from pyspark.sql import functions as F

from siftwell.sources import readers

CARGO = """[package]
name = "x"

[dependencies]
serde = "1.0"
tokio = { version = "1.2", features = ["full"] }
local = { path = "../local" }

[dev-dependencies]
tempfile = "3"

[target.'cfg(windows)'.dependencies]
winapi = "0.3"

[dependencies.regex]
version = "1.9"
default-features = false
"""
PYPROJECT = """[project]
name = "y"
dependencies = [
  "requests[socks]>=2.1",
  'numpy',
]

[tool.poetry.dependencies]
python = "^3.11"
pandas = "^2.0"

[tool.poetry.group.dev.dependencies]
pytest = { version = "8.0" }
"""
GOMOD = "module example.com/z\n\ngo 1.22\n\nrequire github.com/one/a v1.2.3\n\nrequire (\n\tgolang.org/x/net v0.1.0 // indirect\n)\n"


def test_manifests(spark):
    rows = [("p", "Cargo.toml", CARGO), ("p", "pyproject.toml", PYPROJECT), ("p", "go.mod", GOMOD), ("q", "package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("q", "requirements.txt", "c==1.0\n# note\nd>=2\n"), ("r", "Cargo.toml", ""), ("r", "go.mod", None)]
    df = spark.createDataFrame(rows, "project string, manifest string, text string")
    got = {(r.project, r.ecosystem, r.name, r.version, r.is_dev) for r in readers.manifest_dependencies(df).collect()}
    assert got == {
        ("p", "crates.io", "serde", "1.0", False), ("p", "crates.io", "tokio", "1.2", False), ("p", "crates.io", "local", None, False), ("p", "crates.io", "tempfile", "3", True), ("p", "crates.io", "winapi", "0.3", False), ("p", "crates.io", "regex", "1.9", False),
        ("p", "pypi", "requests", ">=2.1", False), ("p", "pypi", "numpy", None, False), ("p", "pypi", "pandas", "^2.0", False), ("p", "pypi", "pytest", "8.0", True), ("p", "go", "github.com/one/a", "v1.2.3", False), ("p", "go", "golang.org/x/net", "v0.1.0", False),
        ("q", "npm", "a", "^1", False), ("q", "npm", "b", "2", True), ("q", "pypi", "c", "1.0", False), ("q", "pypi", "d", None, False),
    }
    assert {(r.name, r.target) for r in readers.cargo_dependencies(df).where("target is not null").collect()} == {("winapi", "cfg(windows)")}


def test_origins(spark):
    rows = ['{"feed_url": "f", "handle": "h"}', '{"language": "rust"}', '{"handle": 5, "language": "x"}', "{}", None, "no json", '{"channel_id": "c", "source_name": "s"}']
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, m string")
    assert [r.o for r in df.select("n", readers.feed_origin(F.col("m")).alias("o")).orderBy("n").collect()] == ["f", "rust", None, None, None, None, "c"]


def test_sections(spark):
    text = "intro\nmore\n# Features\nfast\n\n## \nstill\n# Empty\n# License\nMIT\n#Odd\nlast"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "# only a heading")], "id long, text string")
    got = sorted((r.id, r.section, r.heading, r.content, r.weight) for r in readers.readme_sections(df, "id", "text").collect())
    assert got == [(1, 0, "Overview", "intro\nmore", 1.0), (1, 1, "Features", "fast", 1.0), (1, 2, "Features", "still", 1.0), (1, 3, "License", "MIT", 0.3), (1, 4, "Odd", "last", 0.6)]


def test_files_by_extension(spark, tmp_path):
    shown = b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj T* [(Wor) -20 (ld)] TJ ET"
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(shown) + b"\nendstream\nendobj\n2 0 obj\nstream\nBT (plain) Tj ET\nendstream\n")
    (tmp_path / "b.md").write_text("# text é")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "e.pdf").write_bytes(b"no pdf")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>one</w:p><w:p>two</w:p>")
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.text) for r in readers.documents_text(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", "pdf", "Hello (PDF)\nWorld\nplain"), ("b.md", "text", "# text é"), ("d.docx", "office", "one\ntwo\n"), ("e.pdf", "pdf", "")}


def test_mirror(spark, tmp_path):
    one = {"id": "A-1", "affected": [{"package": {"name": "x", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}, {"last_affected": "2.4"}]}, {"type": "GIT", "events": [{"introduced": "abc"}]}]}]}
    two = {"id": "A-2", "affected": [{"package": {"name": "y", "ecosystem": "PyPI"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "1.0"}]}]}]}
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("A-1.json", json.dumps(one))
        z.writestr("A-2.json", json.dumps(two))
        z.writestr("A-3.json", json.dumps(one | {"id": "A-3", "withdrawn": "2024-01-01"}))
        z.writestr("bad.json", "{")
    got = {tuple(r) for r in readers.osv_advisories(spark, str(tmp_path)).collect()}
    assert got == {("A-1", "x", "npm", "0", "1.2", None), ("A-1", "x", "npm", "2.0", None, "2.4"), ("A-2", "y", "PyPI", "1.0", None, None)}


def test_gate_keeps_the_least_id(spark):
    rows = [("hn", "b", "A title that is long", "u2"), ("hn", "a", "a TITLE that is long ", "u1"), ("rss", "c", "A title that is long", "u3"), ("hn", "d", "short", "u"), ("hn", "e", "You won't believe this title", "u")]
    got = readers.quality_gate(spark.createDataFrame(rows, "source_type string, source_id string, title string, url string"))
    assert sorted((r.source_type, r.source_id) for r in got.collect()) == [("hn", "a"), ("rss", "c")]


def test_archives_tell_what_does_not_fit(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("small.txt", "ok")
        z.writestr("large.txt", "z" * 200)
    monkeypatch.setattr(readers, "ARCHIVE_BUDGET", 100)
    assert {(r.entry, r.text) for r in readers.archive_entries(spark, str(tmp_path)).collect()} == {("small.txt", "ok"), ("large.txt", None)}
