"""A persisted inverted index: postings by bucket of terms, updated by batch, read only where a query's terms lie."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import ascii_words
from siftwell.operators.staging import broadcast_within

#: Buckets of terms, each a folder of the posting table.
BUCKETS = 64
POSTINGS = "id long, batch long, term string, field string, tf long, length long, bucket int"
ITEMS = "id long, batch long, lengths map<string,long>"
#: Bytes of text for each task of a batch: tasks grow in number and not in size.
TASK_BYTES = 16 << 20
#: Items replaced up to which they are broadcast to a search.
BROADCAST_REPLACED = 500_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One of the index's tables; empty if no batch has been written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def add_batch(items: DataFrame, path: str, batch: int, id_col: str, fields: dict[str, str]) -> None:
    """Add a batch of items to the index at `path`; fields: name of a field to the column with its text.

    An item that an earlier batch had is replaced: its old version is noted, not rewritten. A batch that was written before
    is written again, so that a job may be repeated. Words are runs of a-z and 0-9 in lower case. Null texts are empty; rows
    with a null id are left out; of repeated ids the one of the least texts counts.
    """
    spark = items.sparkSession
    texts = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(f) for f, c in fields.items()])
    each_id = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), texts.alias("t"))
    size = each_id.agg(F.sum(sum((F.octet_length(f"t.{f}") for f in fields), F.lit(0).cast("long")))).first()[0] or 0
    tasks = 1 + size // TASK_BYTES
    one = each_id.repartition(tasks, "id").groupBy("id").agg(F.min("t").alias("t"))
    split = one.select("id", *[ascii_words(F.col(f"t.{f}")).alias(f) for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("w")) for f in fields])
    files = max(8, tasks // 32)
    rows = split.select("id", F.explode(each).alias("e")).select("id", "e.field", F.size("e.w").cast("long").alias("length"), F.explode("e.w").alias("term"))
    counted = rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    parts = counted.select("id", "term", "field", "tf", "length", _bucket(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(files)).alias("part"))
    # a bucket's rows are dealt to several files, sorted by term, so that a frequent term is no single task
    parts = parts.repartition(min(BUCKETS * files, 2 * tasks), "bucket", "part").sortWithinPartitions("bucket", "term").drop("part")
    parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    lengths = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.size(f).cast("long") for f in fields]))
    split.select("id", lengths.alias("lengths")).write.mode("overwrite").parquet(f"{path}/items/batch={batch}")
    old = _read(spark, path, "items", ITEMS).where(F.col("batch") < batch).join(split.select("id"), "id", "left_semi")
    old.select("id", F.col("batch").alias("old")).write.mode("overwrite").parquet(f"{path}/replaced/batch={batch}")


def _live(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    gone = _read(spark, path, "replaced", "id long, old long, batch long").select("id", F.col("old").alias("batch")).distinct()
    return rows.join(broadcast_within(gone, BROADCAST_REPLACED), ["id", "batch"], "left_anti")


def search(spark: SparkSession, path: str, query: str, k: int, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best items by BM25 over weighted fields: id, score, rank.

    A term's frequency is the weighted sum of its frequencies in the fields, each damped by the field's length against its
    mean; with one field of weight 1 this is BM25. Of the postings only the folders of the query's terms are read. Ties go
    to the smaller id; a query without words finds nothing.
    """
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    items = _live(spark, path, _read(spark, path, "items", ITEMS))
    means = items.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.element_at("lengths", f), F.lit(0))).alias(f"mean_{at}") for at, f in enumerate(weights)])
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()]
    hits = _read(spark, path, "postings", POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & F.col("field").isin(*weights))
    hits = _live(spark, path, hits).join(F.broadcast(means))  # one row
    damped = reduce(lambda rest, f: F.when(F.col("field") == f[1], weights[f[1]] * F.col("tf") / (1 - b + b * F.col("length") / F.col(f"mean_{f[0]}"))).otherwise(rest), enumerate(weights), F.lit(0.0))
    of_term = hits.groupBy("id", "term").agg(F.sum(damped).alias("tf"), F.first("n").alias("n"))
    known = of_term.groupBy("term").agg(F.count("*").alias("df"))
    scored = of_term.join(F.broadcast(known), "term")  # one row a term of the query
    value = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)
    top = scored.groupBy("id").agg(F.round(F.sum(value), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
