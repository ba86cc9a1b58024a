"""Exact duplicate lines over all documents: hashes in ranges, first occurrences streamed, keep bitmaps returned.

A line's key is hashed to 128 bits. The rows (hash, document, position) are dealt out in ranges of all three and sorted
within each range, so that a line that very many documents hold lies in many ranges and a task streams its rows in constant
memory: the first document of a hash keeps its lines, the others lose theirs. Where a range begins inside a hash, the first
document of that hash is found in the ranges before it. What is returned is one compressed bitmap for each document that
loses a line; texts are read again only to apply it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart, batches_of, binary_values, columns, discard, staged

#: What is stripped from both ends of a line before it is compared (fixed values).
BLANKS = b" \t\n\v\f\r"
#: Occurrences of lines that one range holds, about; a range is streamed, so this bounds time and sorting space.
RANGE_ROWS = 1_000_000
#: Whole texts that a task holds at once.
BATCH_TEXTS = 256
#: Repeated rows that a task has met lately and does not mark again.
SEEN = 100_000


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANKS) for line in text.lower().split(b"\n")]


def _has(key: bytes, least_chars: int) -> bool:
    """Whether a key has so many code points."""
    n = len(key)
    return n >= least_chars and (n >= 4 * least_chars or key.isascii() or len(key.decode()) >= least_chars)


def _marks(least_chars: int):
    """Rows (hi, lo, none, doc_id, told, pos): one for each line that may be dropped; `none` tells a null doc_id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            hashes, rows, places = [], [], []
            ids, told = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, text in enumerate(binary_values(batch.column(1))):
                if len(text) < least_chars or (ids[row], told[row]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((ids[row], told[row]))
                found = [(at, key) for at, key in enumerate(line_keys(text)) if _has(key, least_chars)]
                hashes += [xxhash.xxh3_128_digest(key) for _, key in found]
                places += [at for at, _ in found]
                rows += [row] * len(found)
            at = np.array(rows, np.int64)
            words = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            null = np.array([x is None for x in ids], bool)
            doc = np.array([x or 0 for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(null[at]), pa.array(doc[at]), pa.array(np.array(told, np.int64)[at]), pa.array(np.array(places, np.int32))], ["hi", "lo", "none", "doc_id", "told", "pos"])

    return made


#: Kinds of rows that a range gives: a line to drop, a line of the first document of the hash with which the range begins,
#: and the first document that the range has of its first and last hash.
DROP, OPEN, EDGE = 0, 1, 2
FLOW = "kind int, hi long, lo long, none boolean, doc_id long, told long, pos int"


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one range sorted by (hi, lo, none, doc_id); state is one row, the first of the present hash."""
    first, leading = None, True

    def given(kind: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *map(pa.array, columns)], ["kind", "hi", "lo", "none", "doc_id", "told", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, none, doc, told, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        starts = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        carried = first is not None and (first[0], first[1]) == (hi[0], lo[0])
        head = np.maximum.accumulate(np.where(starts, np.arange(len(hi)), 0))  # the row where each row's hash begins
        first_none, first_doc = none[head], doc[head]
        in_first = head == 0
        if carried:
            first_none = np.where(in_first, first[2], first_none)
            first_doc = np.where(in_first, first[3], first_doc)
        same = (none == first_none) & (doc == first_doc)
        leads = in_first & (leading and (carried or first is None))
        kind = np.where(same, np.where(leads, OPEN, -1), DROP)
        if first is None:
            yield given(np.array([EDGE]), [x[:1] for x in (hi, lo, none, doc, told, pos)])
        out = kind >= 0
        yield given(kind[out], [x[out] for x in (hi, lo, none, doc, told, pos)])
        leading = leading and bool(leads.all())
        first = (hi[-1], lo[-1], first_none[-1], first_doc[-1])
    if first is not None:
        yield given(np.array([EDGE]), [np.array([first[0]]), np.array([first[1]]), np.array([first[2]]), np.array([first[3]]), np.zeros(1, np.int64), np.zeros(1, np.int32)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions to compressed bitmaps: a bit for each line up to the last dropped one and its byte, set where the line stays."""
    for batch in batches:
        maps, counts = [], []
        for positions in batch.column(3):
            drop = positions.values.to_numpy()
            keep = np.ones(8 * (int(drop.max()) // 8 + 1), bool)
            keep[drop] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            counts.append(len(drop))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["none", "doc_id", "told", "n_dropped", "keep"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return rows.withColumn("told", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 10, range_rows: int = RANGE_ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (none, doc_id, told, n_dropped, keep), one for each document that loses a line; the others keep all.

    A line of at least `least_chars` code points, compared without blanks at its ends and A-Z in lower case, that two or
    more documents hold stays in the smallest doc_id alone, there with its repeats. `told` is xxhash64 of the text, `keep`
    a compressed bitmap in which a line beyond the end stays. Null and empty texts have one empty line, which stays. Rows
    with a null doc_id count as one document after all others; rows of one doc_id are one document, each text with its own
    bitmap. Extra columns are ignored; an empty table gives an empty result.
    """
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        marks = staged(_rows(docs, id_col, text_col).mapInArrow(_marks(least_chars), "hi long, lo long, none boolean, doc_id long, told long, pos int"), "lines")
    order = ["hi", "lo", "none", "doc_id", "told", "pos"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), marks.count() // range_rows + 1)
    flow = staged(marks.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_first_occurrences, FLOW), "first-lines")
    discard(marks)
    # Two rows a range at most: what each has first of the hashes at its two ends.
    edges = flow.where(F.col("kind") == EDGE).groupBy("hi", "lo").agg(F.min(F.struct("none", "doc_id")).alias("first"))
    opened = flow.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["hi", "lo"]).where(F.col("first") < F.struct("none", "doc_id"))
    drops = flow.where(F.col("kind") == DROP).select("none", "doc_id", "told", "pos").union(opened.select("none", "doc_id", "told", "pos"))
    sets = drops.groupBy("none", "doc_id", "told").agg(F.collect_set("pos").alias("drop"))
    bitmaps = staged(sets.mapInArrow(_packed, "none boolean, doc_id long, told long, n_dropped long, keep binary"), "keep-bitmaps")
    discard(flow)
    return bitmaps


def kept_lines(text: bytes, keep: bytes | None) -> list[bytes]:
    """The lines of a text that its bitmap leaves, as they were."""
    lines = text.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [line for at, line in enumerate(lines) if at >= len(bits) or bits[at]]


def _with_bitmaps(rows: DataFrame, bitmaps: DataFrame, doc: Column, told: Column, names: list[str]) -> DataFrame:
    """Rows with the columns (n_dropped, keep) of their bitmaps under other names. A hash table of the bitmaps of a part is
    built, so that texts are not sorted."""
    there = bitmaps.select(*[F.col(c).alias(n) for c, n in zip(("none", "doc_id", "told", "n_dropped", "keep"), names, strict=True)])
    match = (doc.isNull() == F.col(names[0])) & (F.coalesce(doc, F.lit(0)) == F.col(names[1])) & (told == F.col(names[2]))
    return rows.join(there.hint("shuffle_hash"), match, "left")


def without_repeated_lines(docs: DataFrame, least_chars: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without the lines that `keep_bitmaps` drops. A null text stays null."""
    bitmaps = keep_bitmaps(docs, least_chars, id_col=id_col, text_col=text_col)
    names = apart(docs, "none", "doc", "told", "n", "keep")
    text = F.col(f"`{text_col}`").cast("string")
    joined = _with_bitmaps(docs, bitmaps, F.col(f"`{id_col}`").cast("long"), F.xxhash64(text), names)
    at = docs.columns.index(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column(at), batch.column(len(batch.schema) - 1).to_pylist()
            if any(keeps):
                old = zip(texts, binary_values(texts), keeps, strict=True)
                new = pa.array([b"\n".join(kept_lines(t, k)) if x.is_valid else None for x, t, k in old], pa.binary())
                batch = batch.set_column(at, batch.schema.field(at), new.cast(pa.string()).cast(texts.type))
            yield batch.select(range(len(batch.schema) - 1))

    with_keep = joined.select(*[F.col(f"`{c}`") for c in docs.columns], names[4])
    return with_keep.mapInArrow(made, docs.schema)


def line_digest(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """One row per document: doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the lines left, joined by \\n.

    Nulls, ties and repeats are as in `keep_bitmaps`; a null text counts as an empty one, of one line. The digests are
    written and read again, so that a task holds few texts at once whoever uses them.
    """
    rows = _rows(docs, "doc_id", "text")
    bitmaps = keep_bitmaps(docs, least_chars)
    names = ["_none", "_doc", "_told", "n_dropped", "keep"]
    joined = _with_bitmaps(rows, bitmaps, F.col("doc_id"), F.col("told"), names).select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for text, keep in zip(binary_values(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                n.append(text.count(b"\n") + 1)
                digests.append(hashlib.sha256(text if keep is None else b"\n".join(kept_lines(text, keep))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(digests)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    # Written here, since the size of Arrow batches is read when a job starts; up to 10,000 texts would be one batch else.
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        digests = staged(joined.mapInArrow(made, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"), "line-digests")
    discard(bitmaps)
    return digests
