"""Sources: landing files by adapter, archives of documents, feeds in XML, and a pluggable external source."""

from __future__ import annotations

import io
import json
import re
import subprocess
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Every adapter gives these columns.
ITEM = "source_type string, source_id string, title string, url string, content string, tags array<string>, published_at timestamp"
#: Keys of the landing records that hold an item's fields, by adapter; the first that is there counts.
ADAPTERS: dict[str, dict[str, tuple[str, ...]]] = {
    "hackernews": {"source_id": ("objectID", "id"), "title": ("title",), "url": ("url", "story_url"), "content": ("text", "story_text"), "published_at": ("created_at",)},
    "github": {"source_id": ("full_name", "id"), "title": ("full_name",), "url": ("html_url",), "content": ("description",), "published_at": ("pushed_at", "updated_at")},
    "reddit": {"source_id": ("name", "id"), "title": ("title",), "url": ("url",), "content": ("selftext",), "published_at": ("created",)},
    "lobsters": {"source_id": ("short_id",), "title": ("title",), "url": ("url", "comments_url"), "content": ("description_plain",), "published_at": ("created_at",)},
    "devto": {"source_id": ("id",), "title": ("title",), "url": ("url",), "content": ("description",), "published_at": ("published_at",)},
    "stackoverflow": {"source_id": ("question_id",), "title": ("title",), "url": ("link",), "content": ("body",), "published_at": ("creation_date",)},
    "npm_registry": {"source_id": ("name",), "title": ("name",), "url": ("homepage",), "content": ("description",), "published_at": ("date", "modified")},
    "pypi": {"source_id": ("name",), "title": ("name",), "url": ("project_url", "home_page"), "content": ("summary",), "published_at": ("upload_time",)},
    "crates_io": {"source_id": ("id", "name"), "title": ("name",), "url": ("documentation", "repository"), "content": ("description",), "published_at": ("updated_at",)},
    "osv": {"source_id": ("id",), "title": ("summary",), "url": ("url",), "content": ("details",), "published_at": ("published",)},
    "cve": {"source_id": ("id", "cveId"), "title": ("id", "cveId"), "url": ("url",), "content": ("description",), "published_at": ("published",)},
}
GENERIC = {"source_id": ("id", "guid", "uri", "link"), "title": ("title", "name"), "url": ("url", "link"), "content": ("content", "summary", "description", "text"), "published_at": ("published_at", "published", "created_at", "updated", "date")}


def _first(record: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(record, f"$.{k}") for k in keys])


def landed_items(spark: SparkSession, path: str, adapter: str) -> DataFrame:
    """Items of an adapter from landing files of one JSON record a line."""
    keys = ADAPTERS.get(adapter, GENERIC)
    raw = spark.read.text(path)
    when = _first(F.col("value"), keys["published_at"])
    stamp = F.coalesce(F.try_to_timestamp(when), F.timestamp_seconds(when.try_cast("double")))
    named = [_first(F.col("value"), keys[c]).alias(c) for c in ("source_id", "title", "url", "content")]
    return raw.select(F.lit(adapter).alias("source_type"), *named, F.from_json(F.get_json_object("value", "$.tags"), "array<string>").alias("tags"), stamp.alias("published_at")).where("source_id is not null")


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS feeds; Atom entries with row_tag `entry`."""
    schema = "title string, link string, guid string, description string, pubDate string, published string, summary string, id string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    when = F.coalesce("pubDate", "published")
    stamp = F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(F.regexp_replace(when, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return raw.select(F.lit("rss").alias("source_type"), F.coalesce("guid", "id", "link").alias("source_id"), "title", F.col("link").alias("url"), F.coalesce("description", "summary").alias("content"), F.array().cast("array<string>").alias("tags"), stamp.alias("published_at"))


def quality_gate(items: DataFrame, least_title: int = 10, hype: str = r"(?i)\b(you won't believe|shocking|insane|mind-?blowing)\b") -> DataFrame:
    """Items with a title long enough and without hype, of each source_type and title the one of least source_id."""
    good = items.where((F.length(F.btrim("title")) >= least_title) & ~F.rlike("title", F.lit(hype)))
    rank = F.row_number().over(Window.partitionBy("source_type", F.lower(F.btrim("title"))).orderBy(F.col("source_id").asc_nulls_last(), "title", "url"))
    return good.withColumn("_r", rank).where("_r = 1").drop("_r")


#: Keys that name the feed an item came from, the first that is there counts.
ORIGINS = ("feed_url", "channel_id", "handle", "subreddit", "language", "source_name")


def feed_origin(metadata: Column) -> Column:
    """The feed that an item's metadata (JSON) names; null if the first key that is there holds no text, or none is."""
    keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    first = F.get(F.filter(F.array(*map(F.lit, ORIGINS)), lambda k: F.array_contains(keys, k)), F.lit(0))
    values = F.from_json(metadata, F.lit("map<string,string>"))
    quoted = F.rlike(metadata, F.concat(F.lit('"'), first, F.lit('"\\s*:\\s*"')))
    return F.when(quoted, F.element_at(values, first))


def fetch_cap(base: int, rows: Column, rate: Column, source: Column) -> Column:
    """Rows to fetch by observed yield: base times hit rate over 0.25, within a tenth and the whole; exempt or new sources get all."""
    part = F.greatest(F.lit(0.1), F.least(rate / 0.25, F.lit(1.0)))
    return F.when(source.isin("osv", "cve") | (rows < 200), F.lit(base)).otherwise(F.round(F.lit(base) * part).cast("int"))


#: Bytes of an archive that are unpacked at most, against archives that grow without end.
ARCHIVE_BUDGET = 64 << 20


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.{zip,tar,gz,tgz}") -> DataFrame:
    """Text entries of ZIP and TAR archives: path, entry, text. Archives are read by Spark and unpacked in tasks. An entry
    beyond the budget has a null text."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, texts, left = [], [], ARCHIVE_BUDGET
                if zipfile.is_zipfile(io.BytesIO(body)):
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                fits = info.file_size <= left
                                left -= info.file_size * fits
                                names.append(info.filename)
                                texts.append(z.read(info).decode("utf-8", "replace") if fits else None)
                else:
                    with tarfile.open(fileobj=io.BytesIO(body)) as t:
                        for info in t:
                            if info.isfile():
                                fits = info.size <= left
                                left -= info.size * fits
                                names.append(info.name)
                                texts.append(t.extractfile(info).read().decode("utf-8", "replace") if fits else None)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(names), pa.string()), "entry": pa.array(names, pa.string()), "text": pa.array(texts, pa.string())})

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(entries, "path string, entry string, text string")


def office_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of DOCX and XLSX files: their archives' XML parts without tags."""
    parts = archive_entries(spark, path, "*.{docx,xlsx}")
    body = parts.where(F.col("entry").isin("word/document.xml", "xl/sharedStrings.xml"))
    plain = F.btrim(F.regexp_replace(F.regexp_replace("text", r"</w:p>|</si>", "\n"), r"<[^>]*>", ""))
    return body.select("path", plain.alias("text"))


#: Strings that a PDF's text operators show, in parentheses or as hexadecimal digits, and the ends of lines.
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ|<([0-9A-Fa-f\s]+)>\s*Tj|(T\*|Td|TD|ET)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return plain.decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("latin-1")


def pdf_strings(body: bytes) -> str:
    """The text that a PDF's content streams show, stored or deflated. Fonts with codes of their own are not decoded."""
    out: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        if b"BT" not in data:
            continue
        for shown, several, digits, end in _SHOWN.findall(data):
            if end:
                out.append("\n")
            elif several:
                out.append("".join(_pdf_string(x) for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", several, re.S)))
            elif digits:
                out.append(bytes.fromhex(re.sub(rb"\s", b"", digits).decode().ljust(2, "0")[: len(digits) // 2 * 2]).decode("latin-1"))
            else:
                out.append(_pdf_string(shown))
    return re.sub(r"\n\s*\n+", "\n", "".join(out)).strip()


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of PDF files: path, text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pdf_strings(x) for x in batch.column(1).to_pylist()], pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(texts, "path string, text string")


def documents_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of all files under a path by their extension: path, kind, text. Kinds: text, office, pdf; others are left out."""
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,rst,csv,json,html}").option("recursiveFileLookup", "true").load(path)
    parts = [plain.select("path", F.lit("text").alias("kind"), F.decode("content", "UTF-8").alias("text")), office_text(spark, path).select("path", F.lit("office").alias("kind"), "text"), pdf_text(spark, path).select("path", F.lit("pdf").alias("kind"), "text")]
    return parts[0].union(parts[1]).union(parts[2])


#: Weights of sections by what their heading has, the first that fits counts; others weigh 0.6.
SECTIONS = (
    (1.0, ("feature", "overview", "about")), (0.9, ("api", "usage", "how to")), (0.85, ("architect", "design", "structure")), (0.8, ("example", "demo", "tutorial")),
    (0.7, ("install", "setup", "getting started", "quickstart")), (0.3, ("license", "credit", "author", "contributor")),
)


def readme_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of Markdown texts: (key, section, heading, content, weight), numbered from 0.

    Lines that begin with a number sign are headings; what comes before the first is the overview, and a heading without
    words keeps the name before it. Sections without words are left out.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))
    head = F.trim("line").startswith("#")
    name = F.nullif(F.trim(F.regexp_replace(F.trim("line"), "^#+", "")), F.lit(""))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(key, "pos", "line", head.alias("head"), F.last(F.when(head, name), ignorenulls=True).over(so_far).alias("heading"), F.count(F.when(head, 1)).over(so_far).alias("n"))
    body = F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"), F.lit(" \n\t\r"))
    parts = marked.where("not head").groupBy(key, "n").agg(F.first("heading").alias("heading"), body.alias("content")).where("content <> ''")
    heading = F.coalesce("heading", F.lit("Overview"))
    weight = F.when(F.lit(False), 0.0)
    for value, words in SECTIONS:
        for w in words:
            weight = weight.when(F.contains(F.lower(heading), F.lit(w)), value)
    order = F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1
    return parts.select(key, order.alias("section"), heading.alias("heading"), "content", weight.otherwise(0.6).alias("weight"))


def osv_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories of mirrored archives of JSON records: advisory_id, package, ecosystem, introduced, fixed, last; one row for
    each package and stretch of versions. Withdrawn records and what is no JSON are left out."""
    schema = "id string, withdrawn string, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    records = archive_entries(spark, path, "*.zip").where(F.col("entry").endswith(".json")).select(F.from_json("text", schema).alias("r")).where("r.id is not null and r.withdrawn is null")
    each = records.select(F.col("r.id").alias("advisory_id"), F.explode("r.affected").alias("a")).select("advisory_id", F.col("a.package.name").alias("package"), F.col("a.package.ecosystem").alias("ecosystem"), F.explode("a.ranges").alias("range"))
    events = each.where("range.type <> 'GIT'").select("advisory_id", "package", "ecosystem", "range.events", F.posexplode("range.events").alias("at", "event")).where("event.introduced is not null")
    after = F.get("events", F.col("at") + 1)  # what ends the stretch that begins here
    return events.select("advisory_id", "package", "ecosystem", F.col("event.introduced").alias("introduced"), after["fixed"].alias("fixed"), after["last_affected"].alias("last"))


def discover_projects(spark: SparkSession, path: str) -> DataFrame:
    """Folders with a manifest: project, manifest, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{package.json,Cargo.toml,pyproject.toml,go.mod,requirements.txt}").load(path)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("project"), F.regexp_extract("path", r"([^/]+)$", 1).alias("manifest"), F.decode("content", "UTF-8").alias("text"))


def _lines(projects: DataFrame, manifest: str) -> DataFrame:
    """Lines of manifests with the table of a TOML file that they stand in."""
    lines = projects.where(F.col("manifest") == manifest).select("project", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    table = F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+", 1), F.lit(""))
    return lines.withColumn("table", F.last(table, ignorenulls=True).over(Window.partitionBy("project").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def cargo_dependencies(projects: DataFrame) -> DataFrame:
    """Dependencies of Cargo.toml manifests: project, name, version, is_dev, target (null: any)."""
    lines = _lines(projects, "Cargo.toml")
    shape = r"^(?:target\.(?:'([^']*)'|\"([^\"]*)\"|([^.]+))\.)?(dev-|build-)?dependencies(?:\.(.+))?$"
    part = lambda n: F.nullif(F.regexp_extract("table", shape, n), F.lit(""))
    within = lines.where(F.rlike("table", F.lit(shape))).select("project", "line", F.coalesce(part(1), part(2), part(3)).alias("target"), F.coalesce(part(4) == "dev-", F.lit(False)).alias("is_dev"), part(5).alias("own"))
    version = F.nullif(F.regexp_extract("line", r'(?:=\s*"([^"]*)"|version\s*=\s*"([^"]*)")', 1), F.lit(""))
    inner = F.nullif(F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1), F.lit(""))
    simple = within.where("own is null").select("project", F.regexp_extract("line", r'^\s*"?([A-Za-z0-9_-]+)"?\s*=', 1).alias("name"), F.when(F.contains("line", F.lit("{")), inner).otherwise(version).alias("version"), "is_dev", "target").where("name <> ''")
    tables = within.where("own is not null").groupBy("project", F.col("own").alias("name"), "is_dev", "target").agg(F.max(F.when(F.rlike("line", F.lit(r"^\s*version\s*=")), inner)).alias("version"))
    return simple.unionByName(tables)


def manifest_dependencies(projects: DataFrame) -> DataFrame:
    """Dependencies (project, ecosystem, name, version, is_dev) of package.json, requirements.txt, Cargo.toml, pyproject.toml
    and go.mod manifests. Versions stand as they are written; without one they are null."""
    deps = []
    for field, dev in (("dependencies", False), ("devDependencies", True)):
        pairs = projects.where("manifest = 'package.json'").select("project", F.explode(F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>")).alias("name", "version"))
        deps.append(pairs.select("project", F.lit("npm").alias("ecosystem"), "name", "version", F.lit(dev).alias("is_dev")))
    lines = projects.where("manifest = 'requirements.txt'").select("project", F.explode(F.split("text", r"\r?\n")).alias("line"))
    name = F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)", 1)
    pinned = F.nullif(F.regexp_extract("line", r"==\s*([^\s;#]+)", 1), F.lit(""))
    deps.append(lines.where(name != "").select("project", F.lit("pypi").alias("ecosystem"), name.alias("name"), pinned.alias("version"), F.lit(False).alias("is_dev")))
    deps.append(cargo_dependencies(projects).select("project", F.lit("crates.io").alias("ecosystem"), "name", "version", "is_dev"))
    listed = F.regexp_extract("text", r"(?s)\[project\](?:(?!\n\[).)*?\ndependencies\s*=\s*\[((?:[^\]\"']|\"[^\"]*\"|'[^']*')*)\]", 1)
    asked = projects.where("manifest = 'pyproject.toml'").select("project", F.explode(F.regexp_extract_all(listed, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("line"))
    spec = F.nullif(F.trim(F.regexp_extract("line", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*([^;]*)", 1)), F.lit(""))
    deps.append(asked.select("project", F.lit("pypi").alias("ecosystem"), name.alias("name"), spec.alias("version"), F.lit(False).alias("is_dev")))
    poetry = _lines(projects, "pyproject.toml").where(F.rlike("table", F.lit(r"^tool\.poetry\.(group\.[^.]+\.)?(dev-)?dependencies$")))
    own = F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)\s*=", 1)
    told = F.coalesce(F.nullif(F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("line", r'=\s*"([^"]*)"', 1), F.lit("")))
    deps.append(poetry.where((own != "") & (own != "python")).select("project", F.lit("pypi").alias("ecosystem"), own.alias("name"), told.alias("version"), (F.col("table") != "tool.poetry.dependencies").alias("is_dev")))
    go = projects.where("manifest = 'go.mod'").select("project", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([^\s()/]+\.[^\s()]+\s+v[^\s]+)"), F.lit(1))).alias("line"))
    deps.append(go.select("project", F.lit("go").alias("ecosystem"), F.split("line", r"\s+")[0].alias("name"), F.split("line", r"\s+")[1].alias("version"), F.lit(False).alias("is_dev")))
    out = deps[0]
    for more in deps[1:]:
        out = out.union(more)
    return out


class CommandSource(DataSource):
    """An external program as a source: it gets its configuration as JSON and prints a list of items as JSON.

    Options: command (JSON list), config (JSON), partitions. Each partition runs the program once, with its number in the
    configuration.
    """

    @classmethod
    def name(cls) -> str:
        return "command"

    def schema(self) -> str:
        return "title string, url string, content string"

    def reader(self, schema) -> DataSourceReader:
        return CommandReader(self.options)


class CommandReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.command, self.config, self.n = json.loads(options["command"]), json.loads(options.get("config", "{}")), int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        done = subprocess.run(self.command, input=json.dumps(self.config | {"partition": partition.value}), capture_output=True, text=True, timeout=300, check=True)
        for item in json.loads(done.stdout):
            yield item.get("title"), item.get("url"), item.get("content")


REGISTRY: dict[str, Callable[..., DataFrame]] = {name: (lambda spark, path, name=name: landed_items(spark, path, name)) for name in (*ADAPTERS, "youtube", "producthunt", "arxiv", "huggingface", "papers_with_code", "lemmy", "mastodon", "twitter", "bluesky", "go_modules")} | {"rss": feed_items}
