"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

A multinomial model over hashed byte trigrams gives each text's log-likelihood by language. A declared language and the
suffix of the address are further evidence, with reliabilities taken from the corpus. The prior of a host is its
languages' share, smoothed towards the share of its domain, which is smoothed towards that of all rows; shares are sums
of the text's own posteriors, by grouped aggregation, without the row itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart, batches_of, binary_values, broadcast_within, columns, staged

#: Buckets of the trigram hash, and weight of an unseen trigram.
BUCKETS, ALPHA = 1 << 14, 0.5
#: Labelled rows that the trigram model is fitted on, those of least hash of their id; they bound the languages as well.
SAMPLE_ROWS = 4000
#: Trigrams of a text overlap; its log-likelihood counts by this factor, and by no more than so many trigrams.
TEMPER, MOST_EVIDENCE = 0.25, 2000.0
#: A text is rejected when its log-likelihood lies so many roots of its number of trigrams below that of chance.
REJECT_WIDTH = 6.0
#: Texts that are passed to Python together.
BATCH_TEXTS = 1000
#: Pseudo-rows with which a host's shares lean on its domain's, and a domain's on the shares of all rows.
HOST_SMOOTHING, DOMAIN_SMOOTHING = 20.0, 100.0
#: Hosts up to this number are broadcast; beyond, Spark shuffles the join.
BROADCAST_HOSTS = 200_000


def _fold_table() -> np.ndarray:
    """Bytes to letters: A-Z lower-cased, bytes of multi-byte characters kept, all else a blank."""
    t = np.full(256, 32, np.int32)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            t[b] = b
        elif c.isalpha():
            t[b] = ord(c.lower())
    return t


FOLD = _fold_table()


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of a whole text that are not blank in the middle."""
    x = FOLD[np.frombuffer(text, np.uint8)]
    if len(x) < 1:
        return np.zeros(0, np.int32)
    x = np.concatenate([[32], x, [32]])
    keep = x[1:-1] != 32
    return (((x[:-2] * 961 + x[1:-1]) * 31 + x[2:]) * 40503 >> 5 & (BUCKETS - 1))[keep]


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # languages x BUCKETS

    def score(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of trigrams and log-likelihoods."""
        t = trigrams(text)
        return len(t), self.logs[:, t].sum(axis=1, dtype=np.float64) if len(t) else np.zeros(len(self.languages))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit on at most `sample_rows` rows (key, text, label), whole texts; null labels and texts are left out."""
    rows = labelled.where("label is not null and text is not null")
    chosen = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(sample_rows).distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                total.setdefault(label, np.zeros(BUCKETS, np.int64))[:] += np.bincount(trigrams(text), minlength=BUCKETS)
        for label, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "bucket", "n"])

    counts = rows.join(F.broadcast(chosen), "key", "left_semi").select("label", "text").mapInArrow(counted, "label string, bucket int, n long")
    with batches_of(labelled.sparkSession, BATCH_TEXTS):
        got = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS rows
    labels, buckets, ns = (got[c].to_numpy(zero_copy_only=False) for c in ("label", "bucket", "n"))
    names, place = np.unique(labels.astype(str), return_inverse=True)
    table = np.full((len(names), BUCKETS), ALPHA)
    np.add.at(table, (place, buckets.astype(int)), ns)
    return TextModel(tuple(names), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _posterior(logs: Column) -> Column:
    """Softmax of an array."""
    parts = F.transform(F.array(logs), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))
    return F.get(F.transform(parts, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.get(column, F.lit(i))).alias(f"s{i}") for i in range(n)]


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Rows (key, text, declared, suffix, host, domain) to (key, text_hash, language, confidence, trigrams, rejected).

    declared and suffix name a language or are null; host and domain may be null, then the shares of all rows serve.
    A row is rejected, its language `und`, when its text has no trigram of letters (null, empty, blank, marks only), or
    when it is less likely in every language than if all trigrams were alike likely, by more than chance explains at its
    length: REJECT_WIDTH roots of its number of trigrams. Repeated rows each give a row.
    """
    names, k = model.languages, len(model.languages)
    if not k:
        return rows.select("key", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("trigrams"), F.lit(True).alias("rejected"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t) for t in binary_values(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), pa.array([n for n, _ in got], pa.int64()), pa.array([x.tolist() for _, x in got], pa.list_(pa.float64()))], ["key", "declared", "suffix", "host", "domain", "text_hash", "trigrams", "logs"])

    text = F.coalesce(F.col("text"), F.lit(""))
    inputs = rows.select("key", "declared", "suffix", "host", "domain", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    seen = inputs.mapInArrow(scored, "key long, declared string, suffix string, host string, domain string, text_hash long, trigrams long, logs array<double>")
    scale = F.when(F.col("trigrams") > 0, TEMPER * F.least(F.lit(1.0), F.lit(MOST_EVIDENCE) / F.col("trigrams"))).otherwise(0.0)
    seen = seen.withColumn("text_logs", F.transform("logs", lambda x: x * scale))
    seen = seen.withColumn("own", F.when(F.col("trigrams") > 0, _posterior(F.col("text_logs"))).otherwise(F.array(*[F.lit(0.0)] * k)))
    with batches_of(rows.sparkSession, BATCH_TEXTS):
        seen = staged(seen, "language-evidence")
    everywhere = seen.agg(*_sums("own", k), *[F.avg(F.when(F.col(c).isNotNull() & (F.col("trigrams") > 0), F.coalesce(F.get("own", F.array_position(F.lit(list(names)), F.col(c)).cast("int") - 1), F.lit(0.0)))).alias(c) for c in ("declared", "suffix")]).first()
    shares = np.array([everywhere[f"s{i}"] or 0.0 for i in range(k)]) + 1.0
    shares = (shares / shares.sum()).tolist()
    trust = {c: min(0.99, max(1 / k, everywhere[c] if everywhere[c] is not None else 1 / k)) for c in ("declared", "suffix")}
    domains = seen.groupBy("domain").agg(*_sums("own", k)).where("domain is not null")
    domains = domains.select("domain", F.array(*[f"s{i}" for i in range(k)]).alias("domain_sums"))
    hosts = seen.groupBy("host", "domain").agg(*_sums("own", k)).where("host is not null")
    hosts = hosts.select("host", "domain", F.array(*[f"s{i}" for i in range(k)]).alias("host_sums"))
    tables = staged(hosts.join(domains, "domain", "left").select(F.col("host").alias("h"), F.col("domain").alias("m"), "host_sums", "domain_sums"), "hosts")
    joined = seen.join(broadcast_within(tables, tables.count(), BROADCAST_HOSTS), (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("m")), "left")
    zero = F.array(*[F.lit(0.0)] * k)
    base = F.array(*map(F.lit, shares))

    def leaned(sums: Column, parent: Column, weight: float) -> Column:
        """Shares from sums without the row itself, leaning on the parent's shares."""
        rest = F.zip_with(F.coalesce(sums, zero), F.when(sums.isNotNull(), F.col("own")).otherwise(zero), lambda s, o: F.greatest(s - o, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, parent, lambda r, p: (r + weight * p) / (total + weight))

    joined = joined.withColumn("of_domain", leaned(F.col("domain_sums"), base, DOMAIN_SMOOTHING)).withColumn("prior", leaned(F.col("host_sums"), F.col("of_domain"), HOST_SMOOTHING))

    def told(column: str, name: Column) -> Column:
        """Log-likelihood of a declared language: its trust where it is the row's, the rest shared by the others."""
        right, wrong = float(np.log(trust[column])), float(np.log(max(1e-3, (1 - trust[column]) / max(1, k - 1))))
        known = F.array_contains(F.lit(list(names)), F.col(column))
        return F.when(known, F.when(F.col(column) == name, right).otherwise(wrong)).otherwise(0.0)

    labels = F.lit(list(names))
    logs = F.transform(F.arrays_zip("text_logs", F.col("prior"), labels.alias("name")), lambda x: x["text_logs"] + F.ln(F.greatest(x["prior"], F.lit(1e-9))) + told("declared", x["name"]) + told("suffix", x["name"]))
    out = joined.withColumn("posterior", _posterior(logs))
    chance = float(-np.log(BUCKETS))
    rejected = (F.col("trigrams") == 0) | (F.array_max("logs") < chance * F.col("trigrams") - REJECT_WIDTH * F.sqrt("trigrams"))
    best = F.get(labels, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return out.select("key", "text_hash", F.when(rejected, "und").otherwise(best).alias("language"), F.when(rejected, 0.0).otherwise(F.array_max("posterior")).alias("confidence"), "trigrams", rejected.alias("rejected"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the source is the host, the declared language is the lang column; there is no address."""
    none = F.lit(None).cast("string")
    return columns(docs, key=F.col("doc_id").cast("long"), text=F.col("text").cast("string"), declared=F.col("lang").cast("string"), suffix=none, host=F.col("source").cast("string"), domain=none)


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html tag's language, the language code in the address, its host and the host's domain."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    code = F.coalesce(F.nullif(F.regexp_extract(url, r"^[^/]*//[^/]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit("")))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang=[\"']?([a-z]{2})", 1)), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1>", " "), r"<[^>]*>|&[#\w]+;", " ")
    return columns(pages, key=F.col("page_id").cast("long"), text=text, declared=declared, suffix=code, host=F.nullif(host, F.lit("")), domain=F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")))


def labelled_documents(docs: DataFrame) -> DataFrame:
    return columns(docs, key=F.col("doc_id").cast("long"), text=F.col("text").cast("string"), label=F.col("lang").cast("string"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, language, confidence, trigrams, rejected for every document; fitted on its labelled rows."""
    return identify(of_documents(docs), fit(labelled_documents(docs))).withColumnRenamed("key", "doc_id").drop("text_hash")


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, confidence, trigrams, rejected for every page, from all its evidence; fitted on labelled documents."""
    return identify(of_pages(pages), fit(labelled_documents(docs))).withColumnRenamed("key", "page_id").drop("text_hash")


def in_known_languages(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns; the pipeline's stage."""
    found = identify(of_documents(docs), fit(labelled_documents(docs)))
    k, x = apart(docs, "k", "x")
    odd = staged(found.where("rejected").select(F.col("key").alias(k), F.col("text_hash").alias(x)).distinct(), "rejected")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(x))
    return docs.join(broadcast_within(odd, odd.count(), BROADCAST_HOSTS), same, "left_anti").select(*docs.columns)
