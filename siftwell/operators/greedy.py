"""Greedy selection in priority order, in rounds: the same choice that one pass over all rows would make.

In a pass from the best row to the worst, a row is kept unless a kept row before it is its neighbour. Whether a row is kept
depends on better neighbours alone, so every row that is the best of all that are left around it can be decided at once.
Each round decides those and takes out what they displace; the rest goes on. Neighbourhoods are given as groups, whose rows
are all neighbours of each other; a single pair is a group of two. No group is brought into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.staging import broadcast_within, discard, staged

#: Rows of a side of a join that is broadcast at most.
BROADCAST_ROWS = 200_000


def greedy(groups: DataFrame) -> DataFrame:
    """Rows (id, kept_id) for the rows that a kept one displaces.

    groups: (group, id, place), one row for each member of each group; a smaller place is better, and equal places go by id.
    A displaced row goes to the best kept row among its neighbours. Rows not returned are kept. Null ids and groups of one
    row have no effect; repeated rows count once. Each round settles at least the best open row of each connected part.
    """
    rows = staged(groups.where("id is not null and group is not null").select("group", F.struct("place", "id").alias("at")).distinct(), "greedy-groups")
    left, displaced = _of_several(rows), []
    left = staged(left, "greedy-open")
    while not left.isEmpty():
        first = left.groupBy("group").agg(F.min("at").alias("first"))
        ranked = left.join(first, "group")
        # kept now: first in all of its groups
        kept = ranked.groupBy("at").agg(F.bool_and(F.col("at") == F.col("first")).alias("leads")).where("leads").select("at")
        taken = ranked.join(kept.withColumnRenamed("at", "first"), "first", "left_semi").where("at <> first").select("at").distinct()
        displaced.append(staged(taken, "greedy-displaced"))
        gone = kept.union(displaced[-1])
        before, left = left, staged(_of_several(left.join(gone, "at", "left_anti")), "greedy-open")
        discard(before)
    if not displaced:
        empty = rows.where("false").select("at.id", F.col("at.id").alias("kept_id"))
        return empty
    out = reduce(DataFrame.union, displaced)
    # of each group at most one row is kept
    heads = rows.join(out, "at", "left_anti").select("group", F.col("at").alias("head"))
    best = rows.join(out, "at", "left_semi").join(heads, "group").groupBy("at").agg(F.min("head").alias("head"))
    best = staged(best.select("at.id", F.col("head.id").alias("kept_id")), "greedy")
    discard(rows, left, *displaced)
    return best


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """What `greedy` does for groups of two: rows (second, first) of displaced rows with the best kept one.

    pairs: (first, second), each once, longs that tell the rows and their order; the smaller is better. A row of a pair is
    two numbers here, so that many pairs take little disk.
    """
    rows = staged(pairs.select("first", "second"), "greedy-pairs")
    left, displaced = staged(rows, "greedy-open"), []
    while not left.isEmpty():
        # kept now: second in no pair
        kept = staged(left.select("first").distinct().join(left.select(F.col("second").alias("first")).distinct(), "first", "left_anti"), "greedy-kept")
        displaced.append(staged(left.join(broadcast_within(kept, BROADCAST_ROWS), "first", "left_semi").select("second").distinct(), "greedy-displaced"))
        gone = displaced[-1]
        rest = left.join(broadcast_within(kept.union(gone), BROADCAST_ROWS), "first", "left_anti").join(broadcast_within(gone, BROADCAST_ROWS), "second", "left_anti")
        before, left = left, staged(rest.select("first", "second"), "greedy-open")
        discard(before, kept)
    out = broadcast_within(reduce(DataFrame.union, displaced, rows.where("false").select("second")), BROADCAST_ROWS)
    best = rows.join(out, "second", "left_semi").join(out.withColumnRenamed("second", "first"), "first", "left_anti").groupBy("second").agg(F.min("first").alias("first"))
    best = staged(best, "greedy")
    discard(rows, left, *displaced)
    return best


def _of_several(rows: DataFrame) -> DataFrame:
    """Rows of groups with more than one row."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return rows.join(sizes, "group", "left_semi")


def pairs_as_groups(pairs: DataFrame, a: str, b: str, place_a: str, place_b: str) -> DataFrame:
    """Pairs with the places of both ends as groups of two."""
    name = F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    ends = F.array(F.struct(F.col(a).alias("id"), F.col(place_a).alias("place")), F.struct(F.col(b).alias("id"), F.col(place_b).alias("place")))
    return pairs.select(name.alias("group"), F.explode(ends).alias("e")).select("group", "e.id", "e.place")
