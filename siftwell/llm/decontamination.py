"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window has as many words as a benchmark item. Only windows that share a shingle with an item can be similar to it, so
windows are laid where a document's shingle is one of an item's, at the place that puts both shingles together. Each
window's 64-bit SimHash is cut into blocks; two fingerprints within RADIUS differ in at most RADIUS // BLOCKS bits in some
block, and items are indexed under all such variants of their blocks, so that no fingerprint within the radius is missed.
Candidates are verified by the weighted Jaccard similarity of their shingles, weights being how often a shingle occurs.
All of it is DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart, broadcast_within, columns, staged

SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Rows of benchmark shingles or blocks, or ids of documents with hits, up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Shingles of all items, of some 30 bytes each, up to which they are broadcast for the verification.
BROADCAST_SHINGLES = 2_000_000
#: Largest distance of sampled positions; see `stride`.
MOST_STRIDE = 4


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, size: int, step: int = 1) -> Column:
    """Hashes of the runs of `size` words that begin at every `step`-th word."""
    at = F.sequence(F.lit(0), F.size(w) - size, F.lit(step))
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h")))).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))


def stride(least: int, num: int, den: int) -> int:
    """The largest distance at which sampled shingles still meet every window that can be similar.

    A window with m shingles, of an item with n, is similar only if m >= t n and at most (m - t n)/(1 + t) of its shingles
    are not the item's. If more shingles than that are sampled in any m neighbours, one of the sampled is the item's.
    """
    for step in range(MOST_STRIDE, 1, -1):
        if all(m // step > (den * m - num * n) // (den + num) for n in range(max(1, least), max(2, least) * 50 + 200) for m in range(-(-num * n // den), n + 1)):
            return step
    return 1


def simhash(w: Column) -> Column:
    """64-bit SimHash of an array of words, each as often as it occurs: a bit is set where most words' hashes have it."""

    def packed(h: Column) -> Column:
        def bit(acc: Column, b: Column) -> Column:
            ones = F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)))
            return acc.bitwiseOR(F.when(ones * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), packed), F.lit(0))


def _blocks(fingerprint: str) -> Column:
    """Array of (block, value) of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fingerprint), b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for b in range(BLOCKS)])


def _variants() -> list[int]:
    """Masks with at most RADIUS // BLOCKS bits of a block set."""
    return [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), k)]


def _weighted(w: Column) -> Column:
    """Shingle hashes of a window, each with the number of its occurrences before, so that sets stand for multisets."""

    def numbered(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct(x.alias("h"), (i - F.array_position(s, x) + 1).alias("k")))

    long = F.array_sort(F.transform(shingle_hashes(w, SHINGLE), lambda x: x["h"]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
    return F.get(F.transform(F.array(F.when(F.size(w) >= SHINGLE, long).otherwise(whole)), numbered), F.lit(0))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, start, similarity): each document and item with the best similar window.

    A window is similar to an item when the weighted Jaccard similarity of their five-word shingles is at least num/den;
    an item with fewer words is one shingle, found only as a whole. Windows that reach over an end of the document are cut
    there. Items and documents without words, and null texts, match nothing. Repeated items each match; items with a null
    id match too, those of different words one by one; repeated documents match once per id and text. start is the window's first word, counted from 0. Extra columns are ignored;
    empty tables give an empty result.
    """
    items = columns(benchmark, item_id=F.col("item_id").cast("long"), w=words(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("size", F.size("w")).where("size > 0")
    # Ids may be null; item_key tells items apart in joins.
    items = items.withColumn("item_key", F.xxhash64("item_id", "w"))
    items = staged(items.withColumn("item_print", simhash(F.col("w"))).withColumn("shingles", _weighted(F.col("w"))), "items")
    found = items.groupBy(F.least("size", F.lit(SHINGLE)).alias("run")).agg(F.min("size")).collect()  # SHINGLE rows at most
    texts = columns(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    windows = None
    for run, least in found:
        step = stride(least - SHINGLE + 1, num, den) if run == SHINGLE else 1
        of_items = items.where(F.least("size", F.lit(SHINGLE)) == run).select("size", F.explode(shingle_hashes(F.col("w"), run)).alias("s")).select("s.h", "size", F.col("s.at").alias("offset")).distinct()
        of_items = staged(of_items, "item-shingles")
        places = texts.select("doc_id", "text_hash", F.size("w").alias("n"), F.explode(shingle_hashes(F.col("w"), run, step)).alias("s")).select("doc_id", "text_hash", "n", "s.h", "s.at")
        met = places.join(broadcast_within(of_items, of_items.count(), BROADCAST_ROWS), "h").select("doc_id", "text_hash", "n", "size", (F.col("at") - F.col("offset")).alias("start"))
        windows = met if windows is None else windows.union(met)
    if windows is None:
        return texts.limit(0).select("doc_id", "text_hash", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    inside = F.least("n", F.col("start") + F.col("size")) - F.greatest("start", F.lit(0))
    windows = staged(windows.where(inside * den >= num * F.col("size")).select("doc_id", "text_hash", "size", "start").distinct(), "windows")
    ids = staged(windows.select("doc_id", "text_hash").distinct(), "hit-ids")
    of_hits = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    of_hits = of_hits.join(broadcast_within(ids, ids.count(), BROADCAST_ROWS), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("text_hash")), "left_semi")
    of_hits = of_hits.select("d", "x", words(F.col("text")).alias("w")).dropDuplicates(["d", "x"])
    cut = windows.join(of_hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("x")))
    first = F.greatest("start", F.lit(0))
    cut = cut.select("doc_id", "text_hash", "size", "start", F.slice("w", first + 1, F.col("size") + F.least("start", F.lit(0))).alias("w"))
    cut = staged(cut.withColumn("print", simhash(F.col("w"))).withColumn("own", _weighted(F.col("w"))), "cut-windows")
    index = items.select("item_key", "size", "item_print", "shingles", F.explode(_blocks("item_print")).alias("b"))
    index = index.select("item_key", "size", "item_print", "shingles", "b.block", F.explode(F.array(*[F.col("b.value").bitwiseXOR(F.lit(m)) for m in _variants()])).alias("value"))
    asked = cut.select("doc_id", "text_hash", "size", "start", "print", F.explode(_blocks("print")).alias("b")).select("doc_id", "text_hash", "size", "start", "print", "b.*")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    index_rows = n_items * BLOCKS * len(_variants())
    near = asked.join(broadcast_within(index.drop("shingles"), index_rows, BROADCAST_ROWS), ["size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("doc_id", "text_hash", "size", "start", "item_key").distinct()
    pairs = near.join(cut.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("x"), F.col("size").alias("z"), F.col("start").alias("s"), "own"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("x")) & (F.col("size") == F.col("z")) & (F.col("start") == F.col("s")))
    pairs = pairs.join(broadcast_within(items.select("item_id", "item_key", F.col("size").alias("of"), "shingles"), n_shingles, BROADCAST_SHINGLES), "item_key").where("size = of")
    both = F.size(F.array_intersect("own", "shingles"))
    union = F.size("own") + F.size("shingles") - both
    nameless = F.when(F.col("item_id").isNull(), F.col("item_key")).alias("nameless")
    good = pairs.where(both * den >= union * num).select("doc_id", "text_hash", "item_id", nameless, "start", (both / union).alias("similarity"))
    best = good.groupBy("doc_id", "text_hash", "item_id", "nameless").agg(F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", "b.start", "b.similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window similar to a benchmark item, with their columns; the pipeline's stage."""
    d, x = apart(docs, "d", "x")
    hits = staged(benchmark_hits(docs, benchmark).select(F.col("doc_id").alias(d), F.col("text_hash").alias(x)).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(x))
    return docs.join(broadcast_within(hits, hits.count(), BROADCAST_ROWS), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
