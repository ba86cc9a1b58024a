"""Helpers shared by the training-data operators: reading, staging on shared storage, word hashing, components."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier that joins the hashes of a shingle's words, and the two multipliers of the 64-bit finaliser (fixed values).
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only in local mode where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'siftwell-shared')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written inside, so that tasks hold few whole texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables. All that was made from them must have been written by then."""
    for df in tables:
        for folder in {df.__dict__["staged_at"]} if "staged_at" in df.__dict__ else {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **named: str | Column) -> DataFrame:
    """Only the given columns under the given names; other input columns, whatever their names, are left out."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in named.items()])


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to be no column of the table."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any(f"{lead}{name}".lower() in taken for name in names):
        lead += "_"
    return [f"{lead}{name}" for name in names]


def broadcast_within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side whose row count has been taken and lies within the limit; otherwise Spark shuffles the join."""
    return F.broadcast(df) if rows <= limit else df


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over a numpy array of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the next text; emptied when there are very many."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space, with A-Z lower-cased (bytes.lower and bytes.split know ASCII alone)."""
    return text.lower().split()


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `size` words; the whole sequence when there are fewer; none without words."""
    n = min(size, len(words))
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if n else set()


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; for finding candidates, never for counting."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        out = mixed(out * ROLL + w[k : len(w) - n + 1 + k])
    return np.unique(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def binary_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string of an Arrow column; null gives an empty string."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        for at in (root[a], root[b], a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: A node with more than this share of all edges is hot, so that at most 2 / HOT_SHARE nodes are; those are broadcast.
HOT_SHARE = 1 / 500
#: Edges that one task takes (1.6 MB of ids); a graph of no more needs no shuffle. Larger ones are dealt out by node.
TASK_EDGES = 100_000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int, few: bool) -> DataFrame:
    """Edges (a, b) with the column low of their a in `least` (a, low, n); the edges of hot nodes are not brought together,
    unless so few edges are in one task anyway."""
    if few:
        return edges.join(least.select("a", "low").hint("merge"), "a")
    hot = least.where(F.col("n") > max(1000, n_edges * HOT_SHARE)).select("a", F.col("low").alias("hot_low"))
    cut = edges.join(F.broadcast(hot), "a", "left")
    rest = cut.where("hot_low is null").select("a", "b").join(least.select("a", "low"), "a")
    return cut.where("hot_low is not null").select("a", "b", F.col("hot_low").alias("low")).union(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (id, component), component being the smallest id reachable.

    Alternating large-star and small-star rounds; each round is two aggregations with map-side combine and two joins, from
    which the edges of nodes with very many are kept out; both halves are written to the shared folder. While there are few
    edges, a half is one task without a shuffle: else a handful of rows costs the driver some thousand tasks. Ids without an
    edge to another id are not returned. Null ids are left out.
    """
    live = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = live.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        few = mark[0] <= TASK_EDGES
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if few else both
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        large = _with_least(both.where("b > a"), low, 2 * mark[0], few).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        discard(live)
        held = large.coalesce(1) if few else large
        least = held.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = _with_least(held, least, mark[0], few).select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        live = staged(small, "edges")
        discard(large)
        before, mark = mark, live.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == mark:
            roots = live.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return live.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
