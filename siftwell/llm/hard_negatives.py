"""Hard negatives by one-dimensional distance keys.

Vectors are rounded to integers and augmented by one component that gives all of them the same length, so that a larger
inner product with an anchor is a smaller distance from it. They are stored sorted by (pivot, distance from the pivot), in
segments of consecutive keys. A search scans the segments whose keys lie within a radius of the anchor's own distance from
each pivot; the triangle inequality bounds what all others can reach. The radius grows until the best rows found lie within
it, or until it covers all rows that the search admits. Scans compare a block of anchors with a segment at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import batches_of, broadcast_within, columns, discard, staged

#: Rows of a segment and anchors of a block.
SEGMENT, BLOCK = 1024, 256
#: Pivots, and rows of least hash on which they are fitted. They decide what is scanned, never what is found.
PIVOTS, PIVOT_SAMPLE = 32, 4096
#: The first radius, and slack for rounding, as shares of the length of an augmented vector.
FIRST_RADIUS, SLACK = 0.25, 1e-6
#: Rows of segment limits, and anchors, up to which they are broadcast.
BROADCAST_SEGMENTS, BROADCAST_ANCHORS = 100_000, 100_000
#: Pairs of block and segment (at most 1.3 MB each at 1024 floats) that a task is handed at once.
BATCH_PAIRS = 16
#: A score that none reaches.
FAR = 1 << 62

CELL = "width int, pivot int, dist double, vec_id long, label long, anchor boolean, norm2 double, vector binary"
PIECE = "width int, pivot int, low double, high double, ids array<long>, labels array<long>, norms array<double>, vectors binary"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as 4-byte floats if those hold them, else as 8-byte floats."""
    return x.astype("<f4" if np.abs(x).max(initial=0) < 1 << 24 else "<f8").tobytes()


def unpacked(values: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(values), width))
    for at, value in enumerate(values):
        out[at] = np.frombuffer(value, "<f4" if len(value) == 4 * width else "<f8")
    return out


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows with their components multiplied by 256 and rounded down."""
    for batch in batches:
        rows, widths, norms, vectors = [], [], [], []
        for row, value in enumerate(batch.column(3)):
            part = value.values
            if part.null_count == 0:
                x = np.floor(256 * part.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all() and np.isfinite(norm := float(x @ x)):
                    rows.append(row)
                    widths.append(len(x))
                    norms.append(norm)
                    vectors.append(packed(x))
        taken = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(taken.column(k) for k in range(3)), pa.array(widths, pa.int32()), pa.array(norms, pa.float64()), pa.array(vectors, pa.binary())], ["vec_id", "label", "anchor", "width", "norm2", "vector"])


def augmented(x: np.ndarray, norms: np.ndarray, length2: float) -> np.ndarray:
    """Vectors with one more component, so that the square of their length is length2."""
    return np.column_stack([x, np.sqrt(np.maximum(0, length2 - norms))])


def fit_pivots(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Points far from each other, moved to the means of what is nearest to them. Equal input gives equal pivots."""
    chosen = [x[0]]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    out = np.array(chosen)
    for _ in range(3):
        near = distances(x, out).argmin(axis=1)
        out = np.array([x[near == k].mean(axis=0) if (near == k).any() else out[k] for k in range(len(out))])
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(0, square))


def _pivots_of(pivots: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The pivots of a width; a width that the sample had not has one, the origin."""
    return pivots.get(width, np.zeros((1, width + 1)))


def _keyed(pivots: dict[int, np.ndarray], length2: float):
    """Each row with its nearest pivot and the distance from it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, norms = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            vectors = batch.column(5).to_pylist()
            pivot, dist = np.zeros(len(widths), np.int32), np.zeros(len(widths))
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                d = distances(augmented(unpacked([vectors[k] for k in at], width), norms[at], length2), _pivots_of(pivots, width))
                pivot[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(pivot), pa.array(dist), batch.column(0), batch.column(1), batch.column(2), batch.column(4), batch.column(5)], ["width", "pivot", "dist", "vec_id", "label", "anchor", "norm2", "vector"])

    return made


def _cut(size: int):
    """Runs of at most `size` consecutive rows of one width and pivot; rows come sorted by (width, pivot, dist)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def out() -> pa.RecordBatch:
            by_id = sorted(rows, key=lambda r: r["vec_id"])
            wide = any(len(r["vector"]) > 4 * r["width"] for r in rows)
            vectors = b"".join(np.frombuffer(r["vector"], "<f4" if len(r["vector"]) == 4 * r["width"] else "<f8").astype("<f8").tobytes() if wide else r["vector"] for r in by_id)
            lists = [pa.array([[r[name] for r in by_id]], pa.list_(kind)) for name, kind in (("vec_id", pa.int64()), ("label", pa.int64()), ("norm2", pa.float64()))]
            ends = [pa.array([rows[0]["width"]], pa.int32()), pa.array([rows[0]["pivot"]], pa.int32()), pa.array([rows[0]["dist"]]), pa.array([rows[-1]["dist"]])]
            return pa.RecordBatch.from_arrays([*ends, *lists, pa.array([vectors], pa.binary())], ["width", "pivot", "low", "high", "ids", "labels", "norms", "vectors"])

        for batch in batches:
            for row in batch.to_pylist():
                if rows and (len(rows) >= size or (rows[0]["width"], rows[0]["pivot"]) != (row["width"], row["pivot"])):
                    yield out()
                    rows.clear()
                rows.append(row)
        if rows:
            yield out()

    return made


def _pieces(cells: DataFrame, size: int, name: str) -> DataFrame:
    """Store rows sorted by (width, pivot, dist) as numbered pieces."""
    order = ["width", "pivot", "dist", "vec_id"]
    parts = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cut(size), PIECE)
    return staged(pieces.withColumn(name, F.monotonically_increasing_id()), name)


def _spans(pivots: dict[int, np.ndarray], length2: float):
    """For each block and pivot the keys between which its open searches lie: (block, width, pivot, least, most)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                x = unpacked(_split(row["vectors"], len(row["ids"])), width)
                d = distances(np.column_stack([x, np.zeros(len(x))]), _pivots_of(pivots, width))
                at = {x: k for k, x in enumerate(row["ids"])}
                own = d[[at[s["anchor_id"]] for s in row["open"]]]
                inner, radius = (np.array([s[k] for s in row["open"]])[:, None] for k in ("inner", "radius"))
                least, most = np.maximum(own - radius, inner - own).min(axis=0), (own + radius).max(axis=0)
                n = d.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n, pa.int64()), pa.array([width] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(least), pa.array(most)], ["block", "width", "pivot", "least", "most"])

    return made


def _split(data: bytes, n: int) -> list[bytes]:
    step = len(data) // n
    return [data[k * step : (k + 1) * step] for k in range(n)]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k largest of their row; -inf never is, ties go to the earlier column."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = scores > kth, scores == kth
        keep = above | (level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(scores.shape, bool)
    return keep & (scores > -np.inf)


def _scanned(k: int, same_label: bool):
    """Compare blocks with segments; give (anchor_id, which, score, vec_id) of rows that may be among the best k.

    A row is given only if it is better than the k best that the task has met before for the same search.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for row in batch.to_pylist():
                width, anchors, ids = row["width"], np.array(row["a_ids"]), np.array(row["ids"])
                x, y = (unpacked(_split(row[v], n), width) for v, n in (("a_vectors", len(anchors)), ("vectors", len(ids))))
                scores = np.clip(x @ y.T, -float(FAR), float(FAR))
                equal = np.array(row["a_labels"])[:, None] == np.array(row["labels"])[None, :]
                may = equal & (anchors[:, None] != ids[None, :]) if same_label else ~equal
                at = {a: n for n, a in enumerate(row["a_ids"])}
                limits: dict[int, np.ndarray] = {}
                for s in row["asked"]:
                    limits.setdefault(s["which"], np.full((len(anchors), 2), np.nan))[at[s["anchor_id"]]] = s["least"], s["cap"]
                for which, limit in limits.items():
                    asked = np.flatnonzero(~np.isnan(limit[:, 0]))
                    of = slice(None) if len(asked) == len(anchors) else asked  # no copies where all ask
                    top_score, top_id = met.get((row["block"], which), (np.full((len(anchors), k), -np.inf), np.full((len(anchors), k), FAR)))
                    score, last_score = scores[of], top_score[of, -1:]
                    better = (score >= np.maximum(limit[of, :1], last_score)) & may[of]
                    better &= score <= limit[of, 1:]
                    some = np.flatnonzero(better.any(axis=1))
                    if not len(some):
                        continue
                    asked, score, better = asked[some], score[some], better[some]
                    better &= (score > top_score[asked, -1:]) | (ids[None, :] < top_id[asked, -1:])
                    keep = best(np.where(better, score, -np.inf), k)
                    a, b = np.nonzero(keep)
                    found.append((anchors[asked[a]], np.full(len(a), which), score[a, b], ids[b]))
                    # the k best of each anchor so far: those before and the new ones, side by side
                    new_score, new_id = np.full((len(asked), k), -np.inf), np.full((len(asked), k), FAR)
                    place = keep.cumsum(axis=1)[a, b] - 1
                    new_score[a, place], new_id[a, place] = score[a, b], ids[b]
                    both_score, both_id = np.hstack([top_score[asked], new_score]), np.hstack([top_id[asked], new_id])
                    order = np.lexsort((both_id, -both_score), axis=-1)[:, :k]
                    top_score[asked], top_id[asked] = np.take_along_axis(both_score, order, 1), np.take_along_axis(both_id, order, 1)
                    met[row["block"], which] = top_score, top_id
            parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(t)) for p, t in zip(parts, (np.int64, np.int32, np.int64, np.int64), strict=True)], ["anchor_id", "which", "score", "vec_id"])

    return made


HITS = "anchor_id long, which int, score long, vec_id long"


class Index:
    """Vectors sorted by (pivot, distance) in segments, and their anchors in blocks; both written to the shared folder."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, anchor, width, norm2, vector, as `_rounded` gives them, written."""
        self.spark = rows.sparkSession
        self.length2 = rows.agg(F.max("norm2")).first()[0] or 0.0
        self.pivots: dict[int, np.ndarray] = {}
        by_width: dict[int, list] = {}
        for r in rows.select("width", "norm2", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect():
            by_width.setdefault(r.width, []).append(r)
        for width, sample in by_width.items():
            x = unpacked([bytes(r.vector) for r in sample], width)
            self.pivots[width] = fit_pivots(augmented(x, np.array([r.norm2 for r in sample]), self.length2))
        cells = rows.mapInArrow(_keyed(self.pivots, self.length2), CELL)
        self.segments = _pieces(cells, SEGMENT, "segment")
        limits = self.segments.select("segment", "width", "pivot", "low", "high")
        self.limits = broadcast_within(limits, limits.count(), BROADCAST_SEGMENTS)
        self.blocks = _pieces(cells.where("anchor"), BLOCK, "block")
        self.anchors = self.blocks.select("block", F.explode(F.arrays_zip("ids", "norms")).alias("a")).select("block", F.col("a.ids").alias("anchor_id"), F.col("a.norms").alias("norm2"))
        self.n_anchors = self.anchors.count()

    def close(self) -> None:
        discard(self.segments, self.blocks)

    def distance(self, norm2: Column, score: Column) -> Column:
        """The distance of an anchor from a row of such a score; of a score that none reaches, 0 or more than any."""
        square = norm2 + F.lit(self.length2) - 2 * score.cast("double")
        return F.sqrt(F.greatest(F.lit(0.0), F.least(square, norm2 + F.lit(self.length2) * 3)))

    def search(self, searches: DataFrame, k: int, same_label: bool) -> DataFrame:
        """The best k rows of each search (anchor_id, which, cap, least): rows (anchor_id, which, rank, score, vec_id).

        A search admits rows of the anchor's own label without itself, or of the other labels, with scores from `least` to
        `cap`. Higher scores come first, ties go to the smaller vec_id.
        """
        length = float(np.sqrt(self.length2))
        asked = searches.join(broadcast_within(self.anchors, self.n_anchors, BROADCAST_ANCHORS), "anchor_id")
        inner, outer = self.distance(F.col("norm2"), F.col("cap")), self.distance(F.col("norm2"), F.col("least"))
        slack = F.lit(length * SLACK)
        asked = staged(asked.withColumn("inner", F.greatest(F.lit(0.0), inner - slack)).withColumn("outer", outer + slack), "searches")
        each = asked.groupBy("block").agg(F.collect_list(F.struct("anchor_id", "which", "cap", "least")).alias("asked"))
        blocks = staged(self.blocks.select("block", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors")).join(each, "block"), "asked-blocks")
        open_now = staged(asked.withColumn("radius", F.least("outer", F.col("inner") + length * FIRST_RADIUS)), "open")
        done, hits = [], []
        while not open_now.isEmpty():
            wanted = open_now.groupBy("block").agg(F.collect_list(F.struct("anchor_id", "inner", "radius")).alias("open"))
            spans = self.blocks.select("block", "width", "ids", "vectors").join(wanted, "block")
            spans = spans.mapInArrow(_spans(self.pivots, self.length2), "block long, width int, pivot int, least double, most double")
            pairs = spans.join(self.limits, ["width", "pivot"]).where("high >= least and low <= most").select("block", "segment")
            if done:
                pairs = pairs.join(functools.reduce(DataFrame.union, done), ["block", "segment"], "left_anti")
            done.append(staged(pairs, "pairs"))
            joined = done[-1].join(self.segments, "segment").join(broadcast_within(blocks, self.n_anchors, BROADCAST_ANCHORS), "block")
            with batches_of(self.spark, BATCH_PAIRS):
                found = joined.select("block", "width", "ids", "labels", "vectors", "a_ids", "a_labels", "a_vectors", "asked").mapInArrow(_scanned(k, same_label), HITS)
                found = found.union(hits[-1].select("anchor_id", "which", "score", "vec_id")) if hits else found
                rank = F.row_number().over(Window.partitionBy("anchor_id", "which").orderBy(F.desc("score"), "vec_id"))
                hits.append(staged(found.withColumn("rank", rank).where(F.col("rank") <= k), "hits"))
            last = hits[-1].where(F.col("rank") == k).select("anchor_id", "which", F.col("score").alias("last"))
            state = open_now.join(last, ["anchor_id", "which"], "left")
            need = F.when(F.col("last").isNull(), F.col("outer")).otherwise(F.least("outer", self.distance(F.col("norm2"), F.col("last")) + slack))
            grown = F.when(F.col("last").isNull(), F.least("outer", 2 * F.col("radius") + slack)).otherwise(need)
            before, open_now = open_now, staged(state.where(F.col("radius") < need).withColumn("radius", grown).select(open_now.columns), "open")
            discard(before)
        discard(asked, blocks, open_now, *done, *hits[:-1])
        if not hits:
            return self.spark.createDataFrame([], "anchor_id long, which int, rank int, score long, vec_id long")
        return hits[-1].select("anchor_id", "which", "rank", "score", "vec_id")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are multiplied by 256 and rounded down; a score is the inner product with the anchor, exact below 2^53.
    Anchors are the usable rows for which `anchor`, a boolean of the input's columns, is true. An anchor's positives are its
    first `positives` other rows of the same label; for each of them come the first `negatives` rows of other labels whose
    score is low to high percent of the positive's. Higher scores come first, ties go to the smaller id; all are taken if
    there are fewer. Rows with a null id, label or vector, or with a component that is null or not finite, take no part,
    nor do vectors too large for doubles. Repeated ids count once, with the least (label, vector). Vectors of another width
    than the anchor's have no score with it. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = columns(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), label=F.col(f"`{label_col}`").cast("long"), anchor=F.coalesce(anchor, F.lit(False)), embedding=vector_col)
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(F.size("embedding") > 0)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("v")).select("vec_id", "v.label", "v.anchor", "v.embedding")
    rows = staged(rows.mapInArrow(_rounded, "vec_id long, label long, anchor boolean, width int, norm2 double, vector binary"), "rounded")
    index = Index(rows)
    everything = index.anchors.select("anchor_id", F.lit(0).alias("which"), F.lit(FAR).alias("cap"), F.lit(-FAR).alias("least"))
    positive = index.search(everything, positives, same_label=True)
    window = positive.select("anchor_id", F.col("rank").alias("which"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("cap"), F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100").alias("least"))
    negative = index.search(window.where("least <= cap"), negatives, same_label=False)
    out = negative.join(positive.select("anchor_id", F.col("rank").alias("which"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "which"])
    out = staged(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    index.close()
    discard(rows, *[df for df in (positive, negative) if df.inputFiles()])
    return out
