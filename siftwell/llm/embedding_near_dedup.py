"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Every vector is normalised, padded and turned by a seeded random rotation. The signs of the turned vector are its binary
code; the inner product of code and vector is stored as its correction factor. From a code and another turned vector
follow an unbiased estimate of their cosine and a confidence bound; only pairs whose bound reaches the threshold are
computed again in double precision. Disjoint runs of code bits serve as bucket keys, so that pairs are met in buckets of
near vectors instead of all against all.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import HOT_SHARE, binary_values, broadcast_within, columns, components, signed, staged

SEED = 20260101
#: Rows of a bucket that one task compares; larger buckets are cut into blocks and each pair of blocks is a task.
BLOCK = 1024
#: Buckets with more rows than BLOCK are few: at most tables * vectors / BLOCK. Up to this many are broadcast.
BROADCAST_BUCKETS = 500_000


def layout(group_rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a bucket key and number of tables.

    Two vectors at the threshold differ in a bit with probability angle/pi. Keys are so long that unrelated vectors of the
    largest label meet about 64 to a bucket; there are so many tables that a pair at the threshold shares no bucket with
    probability of at most `miss`. Pairs above the threshold are missed less often still.
    """
    bits = min(24, max(4, math.ceil(math.log2(max(group_rows, 1) / 64 + 1))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1


@functools.lru_cache(maxsize=4)
def rotation(width: int, dims: int) -> np.ndarray:
    """dims x width part of a random orthogonal dims x dims matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + width * 65_537 + dims).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r)))[:, :width]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of unit vectors and their correction factors <code, vector>."""
    turned = vectors @ turn.T
    return np.packbits(turned >= 0, axis=1, bitorder="little"), np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def bounds(codes: np.ndarray, factors: np.ndarray, others: np.ndarray, turn: np.ndarray, width_of_bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded vectors (rows) and others (columns), and half the width of their bounds."""
    dims = len(turn)
    signs = np.unpackbits(codes, axis=1, bitorder="little")[:, :dims].astype(np.float32) * 2 - 1
    estimate = (signs @ (others @ turn.T).astype(np.float32).T) / (math.sqrt(dims) * factors[:, None])
    error = width_of_bound * np.sqrt(np.maximum(0, 1 - factors**2) / factors**2) / math.sqrt(dims - 1)
    return estimate, error[:, None]


def _units(batch: pa.RecordBatch, floats: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of the batch's usable vectors by width: width, row numbers, raw components."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    by_width: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for row, value in enumerate(column):
        if value.is_valid and len(value.values):
            part = value.values
            if part.null_count == 0:
                x = part.to_numpy(zero_copy_only=False).astype(floats)
                wide = x.astype(np.float64)
                if np.isfinite(wide).all() and wide.any():
                    rows, xs = by_width.setdefault(len(x), ([], []))
                    rows.append(row)
                    xs.append(x)
    for width, (rows, xs) in by_width.items():
        yield width, np.array(rows), np.stack(xs)


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def near_duplicate_embeddings(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, bound: float = 4.0, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector id: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their widths are equal and their cosine in double precision is
    at least `threshold`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Repeated ids count once, with the least (label, vector). A null id links with nothing and gives one row with a null
    component. Extra columns are ignored; an empty table gives an empty result. A bucket of any size is compared whole:
    beyond `block` rows it is cut into blocks and each pair of blocks goes to a task of its own; no pair leaves its task,
    only each vector's number of links and its root in the task.
    """
    kind = "<f4" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "<f8"
    rows = columns(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), label=F.col(f"`{label_col}`").cast("string"), embedding=vector_col)
    rows = staged(rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*"), "vectors")
    # Copies of a vector under one label are one node, told by 128 bits of hash, with its least id and their number.
    finite = F.forall("embedding", lambda v: F.abs(v) < float("inf")) & F.exists("embedding", lambda v: v != 0)
    told = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    told = told.select("*", F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(1), "label", "embedding").alias("g"))
    usable = told.groupBy("h", "g").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("v"), F.count("*").alias("copies"))
    usable = staged(usable.select("h", "g", "copies", "v.*"), "nodes")
    largest = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(largest, threshold, miss)
    dims_least = 64 * math.ceil(max(256, bits * tables) / 64)

    def dims_of(width: int) -> int:
        return max(dims_least, 64 * math.ceil(width / 64))

    def keys(codes: np.ndarray) -> np.ndarray:
        unpacked = np.unpackbits(codes, axis=1, bitorder="little")[:, : bits * tables].reshape(len(codes), tables, bits)
        return unpacked.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, at, raw in _units(batch, kind):
                turn = turns.setdefault(width, rotation(width, dims_of(width)))
                codes, factors = encode(unit(raw), turn)
                taken = batch.take(pa.array(at))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), taken.column(2), pa.array([width] * n, pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors, pa.float64()), pa.array(keys(codes).tolist(), pa.list_(pa.int64()))],
                    ["vec_id", "label", "copies", "width", "raw", "code", "factor", "keys"],
                )

    codes = usable.select("vec_id", "label", "copies", "embedding").mapInArrow(coded, "vec_id long, label string, copies long, width int, raw binary, code binary, factor double, keys array<long>")
    codes = staged(codes, "codes")
    met = codes.select("*", F.posexplode("keys").alias("tab", "key")).drop("keys")
    cell = ["label", "width", "tab", "key"]
    large = codes.select("label", "width", F.posexplode("keys").alias("tab", "key")).groupBy(*cell).count().where(F.col("count") > block)
    large = staged(large.select(*cell, F.ceil(F.col("count") / block).cast("int").alias("cut")), "large-buckets")
    met = met.join(broadcast_within(large, large.count(), BROADCAST_BUCKETS), cell, "left")
    met = met.withColumn("part", F.when(F.col("cut").isNull(), 0).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("cut"))).cast("int"))
    met = met.withColumn("other", F.explode(F.when(F.col("cut").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cut") - 1))))
    met = met.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("cut", "other")

    def compared(key: tuple, group: pa.Table) -> pa.Table:
        tab, width, low, high = key[2].as_py(), key[1].as_py(), key[4].as_py(), key[5].as_py()
        ids, copies = group["vec_id"].to_numpy(), group["copies"].to_numpy()
        found_n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(ids) > 1:
            part = group["part"].to_numpy()
            one = np.flatnonzero(part == low)
            two = one if low == high else np.flatnonzero(part == high)
            raw = np.frombuffer(b"".join(binary_values(group["raw"].combine_chunks())), kind).reshape(len(ids), width)
            code = np.frombuffer(b"".join(binary_values(group["code"].combine_chunks())), np.uint8).reshape(len(ids), -1)
            x, factor, turn = unit(raw), group["factor"].to_numpy(), rotation(width, dims_of(width))
            estimate, error = bounds(code[one], factor[one], x[two], turn, bound)
            back, back_error = bounds(code[two], factor[two], x[one], turn, bound)
            near = (estimate + error >= threshold) & (back + back_error >= threshold).T
            i, j = np.nonzero(np.triu(near, 1) if low == high else near)
            i, j = one[i], two[j]
            table_keys = keys(code) if len(i) else None
            for at in range(0, len(i), 65_536):
                a, b = i[at : at + 65_536], j[at : at + 65_536]
                exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[exact], b[exact]
                first = ~(table_keys[a, :tab] == table_keys[b, :tab]).any(axis=1)
                np.add.at(found_n, a[first], copies[b[first]])
                np.add.at(found_n, b[first], copies[a[first]])
                while True:  # least root over the links of this task
                    r = np.minimum(root[a], root[b])
                    new = root.copy()
                    np.minimum.at(new, root[a], r)
                    np.minimum.at(new, root[b], r)
                    np.minimum.at(new, a, r)
                    np.minimum.at(new, b, r)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
        linked = np.flatnonzero((found_n > 0) | (root != np.arange(len(ids))))
        return pa.table({"vec_id": signed(ids[linked]), "n": signed(found_n[linked]), "root": signed(ids[root[linked]])})

    parts = met.groupBy("label", "width", "tab", "key", "low", "high").applyInArrow(compared, "vec_id long, n long, root long")
    parts = staged(parts, "links")
    counts = parts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = components(parts.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    nodes = usable.select("vec_id", "h", "g", "copies").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    nodes = staged(nodes.select("h", "g", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("root")), "node-links")
    # Nodes of very many copies, at most 1 / HOT_SHARE of them, are broadcast; the rows of the others are few each.
    n_rows = rows.count()
    hot = nodes.where(F.col("copies") > max(1000, n_rows * HOT_SHARE)).select(F.col("h").alias("hot_h"), F.col("g").alias("hot_g"), F.col("n").alias("hot_n"), F.col("root").alias("hot_root"))
    cut = told.select("vec_id", "h", "g").join(F.broadcast(hot), (F.col("h") == F.col("hot_h")) & (F.col("g") == F.col("hot_g")), "left")
    rest = cut.where("hot_h is null").select("vec_id", "h", "g").join(nodes, ["h", "g"]).select("vec_id", "n", "root")
    linked = cut.where("hot_h is not null").select("vec_id", F.col("hot_n").alias("n"), F.col("hot_root").alias("root")).union(rest)
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
