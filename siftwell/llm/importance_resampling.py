"""Importance resampling towards a target distribution, over a sparse document-by-bucket count matrix.

The features of a text are its runs of 1 to 3 words; a feature's bucket is the crc32 of its bytes modulo the number of
buckets. The counts of all documents are written once as blocks in compressed sparse row form. Column sums of the blocks
give the distributions of corpus and target; the product of the matrix with the gains of the buckets gives each document's
weight. With noise drawn from a hash of the id, the highest scores are a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import batches_of, binary_values, columns, discard, staged

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
#: Documents and counts that a block holds at most, one document at least.
BLOCK_DOCS, BLOCK_COUNTS = 512, 2_000_000
#: Bytes of text that are split at once; longer texts are split in pieces that end between words.
PIECE = 1 << 20
#: Whole texts that a task is handed at once.
BATCH_TEXTS = 256
BLOCK_SCHEMA = "doc_ids array<long>, n_words array<long>, n_features array<long>, sizes array<int>, n_counts long, columns binary, counts binary"
#: Bytes of words after lower-casing: digits, letters and all bytes beyond ASCII; the others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, list by list."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_WORDS)
        while end < len(text) and not piece.endswith(b" "):  # the piece ends within a word, or may do so
            more = text[end : end + 256].translate(_WORDS)
            cut = more.find(b" ")
            piece += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        at = end
        yield piece.split()


def bucket_counts(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and, for each bucket, of features. The crc of a longer run goes on from that of its beginning."""
    total, counts, before = 0, np.zeros(buckets, np.int64), []
    for words in _pieces(text):
        if not words:
            continue
        total += len(words)
        run = before + words
        spaced = [b" " + w for w in run]
        crcs = list(map(crc32, run))
        for length in range(1, RUN + 1):
            new = len(words) + len(before) - length + 1 - max(0, len(before) - length + 1)  # runs that end in this piece
            if new > 0:
                counts += np.bincount(np.array(crcs[-new:], np.uint32) % np.uint32(buckets), minlength=buckets)
            crcs = list(map(crc32, spaced[length:], crcs))
        before = run[1 - RUN :]
    return total, counts


def _squeezed(x: np.ndarray) -> bytes:
    """Small numbers as bytes: the low bytes together, then the next, compressed."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def count_blocks(docs: DataFrame, buckets: int = BUCKETS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The count matrix as blocks of rows, written to the shared folder.

    A block has the ids, words, features and numbers of filled buckets of its documents, the filled buckets of one document
    after the other, ascending and each as its distance from the one before (the first from -1), and their counts. A null or
    empty text has no features. Null and repeated ids have rows of their own. Extra columns are ignored; an empty table
    gives no blocks.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, features, sizes, places, counts, n = [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((ids, pa.int64()), (words, pa.int64()), (features, pa.int64()), (sizes, pa.int32()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int64()), pa.array([_squeezed(np.concatenate(places))], pa.binary()), pa.array([_squeezed(np.concatenate(counts))], pa.binary())], ["doc_ids", "n_words", "n_features", "sizes", "n_counts", "columns", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                total, row = bucket_counts(text, buckets)
                filled = np.flatnonzero(row)
                ids.append(doc_id)
                words.append(total)
                features.append(int(row.sum()))
                sizes.append(len(filled))
                places.append(np.diff(filled, prepend=-1))
                counts.append(row[filled])
                n += len(filled)
                if len(ids) >= BLOCK_DOCS or n >= BLOCK_COUNTS:
                    yield out()
                    ids, words, features, sizes, places, counts, n = [], [], [], [], [], [], 0
        if ids:
            yield out()

    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        return staged(rows.mapInArrow(made, BLOCK_SCHEMA), "count-blocks")


def _parts_of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the rows of a block, their filled buckets and counts."""
    sizes, n = np.array(block["sizes"], np.int64), block["n_counts"]
    steps, counts = _unsqueezed(block["columns"], n).astype(np.int64), _unsqueezed(block["counts"], n).astype(np.int64)
    run = np.cumsum(steps)
    ends = np.cumsum(sizes)
    base = np.concatenate([[0], run])[ends - sizes]  # sum of the steps of the rows before
    return sizes, run - np.repeat(base, sizes) - 1, counts


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket over all documents; as many numbers as there are buckets reach the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                _, at, counts = _parts_of(block)
                np.add.at(total, at, counts)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in blocks.select("sizes", "n_counts", "columns", "counts").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 times the log of its smoothed share of the target by that of the corpus, rounded down."""
    in_corpus, in_target, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (in_corpus + n) / ((s + 1.0) * (in_target + n)))) for s, t in pairs], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and id; a null id is hashed as an empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(blocks: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score): the product of matrix and gains, and the noise."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                sizes, at, counts = _parts_of(block)
                sums = np.concatenate([[0], np.cumsum(gain[at] * counts)])
                ends = np.cumsum(sizes)
                weight = sums[ends] - sums[ends - sizes]
                score = weight + np.array([noise(x, seed) for x in block["doc_ids"]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(block["n_words"], pa.int64()), pa.array(block["n_features"], pa.int64()), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(made, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Of the documents with at least `least_words` words, floor(percent * N / 100) with the highest scores are drawn and
    ranked from 1; equal scores go by the smaller doc_id, null ids last, rows of one id in any order. The others have a null
    rank, the short ones too. A null text has no features and weight 0. Extra columns are ignored; an empty table gives an
    empty result, an empty target gives gains that only smoothing makes.
    """
    spark = docs.sparkSession
    blocks = count_blocks(docs, buckets, id_col=id_col, text_col=text_col)
    aims = count_blocks(columns(target, doc_id=F.lit(None).cast("long"), text=text_col), buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets))
    rows = staged(weighed(blocks, gain, seed).withColumn("at", F.monotonically_increasing_id()), "weights")
    discard(blocks, aims)
    # Ranks without one task for all: ranges of scores are numbered apart, each from the number of rows in those before.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")]
    fit = rows.where(F.col("n_words") >= least_words)
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(fit.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = {r.range: r.n for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    drawn = percent * sum(counts.values()) // 100
    firsts, before = [], 0
    for at in range(max(counts, default=-1) + 1):
        firsts.append(before)
        before += counts.get(at, 0)
    first = F.get(F.array(*map(F.lit, firsts)).cast("array<long>"), F.col("range"))
    rank = first + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = ranged.withColumn("rank", rank).select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    short = rows.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.union(short)
