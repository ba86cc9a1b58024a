"""Sharding by a hierarchical weighted hash tree: region, rack and shard are chosen one below the other.

At each level every child draws from the hash of key and child; the child of least -ln(draw)/weight is taken, so that a
child gets keys in proportion to its weight and a change of weights moves keys only into or out of the subtrees whose
weights change. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import columns

#: Parts into which the rows of a shard are counted and numbered.
SLOT_PARTS = 512


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 16, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """A tree of equal shards. Shards from number `base` on are each a region of their own, so that a new shard changes the
    weight of no older subtree and takes rows only into itself."""
    leaves = [Leaf(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s) for s in range(min(shards, base))]
    return leaves + [Leaf(f"added{s}", f"added-rack{s}", s) for s in range(base, shards)]


def _draw(key: Column, children: Column) -> Column:
    """The child of least -ln(draw)/weight; ties go to the smaller name."""

    def score(child: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11) + 0.5) / float(1 << 53)
        return F.struct((-F.ln(draw) / child["weight"]).alias("score"), child["name"].alias("name"))

    return F.array_min(F.transform(children, score))["name"]


def _level(parents: dict[str, dict[str, float]]) -> Column:
    """Literal map of each parent to its children (name, weight); children without weight are left out."""
    pairs: list[Column] = []
    for parent, children in sorted(parents.items()):
        pairs += [F.lit(parent), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(children.items()) if w > 0])]
    return F.create_map(*pairs)


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key in a tree; the tree's size is that of the configuration, not of the data."""
    regions: dict[str, dict[str, float]] = {"": {}}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        regions[""][leaf.region] = regions[""].get(leaf.region, 0) + leaf.weight
        of = racks.setdefault(leaf.region, {})
        of[leaf.rack] = of.get(leaf.rack, 0) + leaf.weight
        shards.setdefault(f"{leaf.region}/{leaf.rack}", {})[f"{leaf.shard}"] = leaf.weight
    region = _draw(key, F.element_at(_level(regions), F.lit("")))
    rack = F.transform(F.array(region), lambda r: F.struct(r.alias("region"), _draw(key, F.element_at(_level(racks), r)).alias("rack")))[0]
    return F.transform(F.array(rack), lambda x: _draw(key, F.element_at(_level(shards), F.concat(x["region"], F.lit("/"), x["rack"]))))[0].cast("int")


def assign_shards(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    doc_id and the tree alone decide the shard (law `key`). size is the number of UTF-8 bytes of the text (null: none) plus
    1; the crc is of the same bytes. slot numbers the rows of a shard from 0 without gaps: counts by shard and part of the
    row's hash give each part its first slot, and rows are numbered within their part, so that no task sees a whole shard. Rows
    with a null doc_id all share one key. Repeated rows share their shard and get slots of their own. Extra columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    rows = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.concat_ws("", F.col("doc_id").cast("string"))
    rows = rows.withColumn("shard", shard_of(key, leaves)).withColumn("grown_shard", shard_of(key, grown))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(SLOT_PARTS)).cast("int"))
    parts = rows.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = parts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("first"))  # at most SLOT_PARTS rows a shard
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("within", within).join(F.broadcast(firsts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, leaves: list[Leaf], path: str, files_per_shard: int = 8, *, id_col: str = "doc_id") -> None:
    """Write all columns of the documents as Parquet, one folder a shard and several files in each."""
    key = F.concat_ws("", F.col(f"`{id_col}`").cast("long").cast("string"))
    out = docs.withColumn("shard", shard_of(key, leaves)).withColumn("_file", F.pmod(F.xxhash64(key, F.lit("file")), F.lit(files_per_shard)))
    out.repartition(len(leaves) * files_per_shard, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
