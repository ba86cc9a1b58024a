"""Similarity graphs and their communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.staging import discard, staged
from siftwell.operators.vectors import nearest


def mutual_edges(rows: DataFrame, id_col: str, vector_col: str, k: int = 3, floor: float = 0.55) -> DataFrame:
    """Edges a < b between rows that are among each other's k nearest by cosine, at least `floor`; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    near = staged(nearest(rows, id_col, vector_col, k, floor).withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "cosine"), "nearest")
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b", F.col("cosine").alias("weight"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair, whatever its direction, with the greatest weight."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """Nodes within `most` hops of the starts (id) through edges above the median weight, with their least number of hops."""
    median = edges.agg(F.percentile("weight", 0.5).alias("m"))
    strong = edges.join(F.broadcast(median), F.col("weight") > F.col("m")).select("a", "b")
    both = strong.union(strong.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    for n in range(1, most + 1):
        new = seen.where(F.col("hop") == n - 1).join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().withColumn("hop", F.lit(n))
        seen = seen.union(new).groupBy("id").agg(F.min("hop").alias("hop"))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """Least id reachable from each end of the edges (a, b), by least labels with shortcuts, written by round."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    before = None
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels.id == heard.a, "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("component"))
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        old, labels = labels, staged(near.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        discard(old)
        now = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            discard(both)
            return labels
        before = now


def _roots(parents: DataFrame) -> DataFrame:
    """Rows (id, root) of a forest (id, parent), a root being its own parent, by doubling of paths."""
    now = staged(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        above = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        new = staged(now.join(above, "root").select("id", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), "roots")
        discard(now)
        now = new.select("id", "root")
        now.staged_at = new.staged_at
        if new.where("moved").isEmpty():
            return now


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest (a, b) of edges a < b, one a pair; of equal weights the smaller (a, b) is taken first.

    Boruvka rounds: every tree takes its best edge to another tree, and trees joined so become one; their number at least
    halves in each round. As the order of edges is total, no cycle closes.
    """
    key = F.struct((-F.col("weight")).alias("low"), "a", "b")
    cross = staged(edges.where("a <> b").select(key.alias("key"), F.col("a").alias("x"), F.col("b").alias("y")), "cross-edges")
    chosen: list[DataFrame] = []
    while not cross.isEmpty():
        ends = cross.select(F.explode(F.array(F.struct(F.col("x").alias("tree"), F.col("y").alias("other"), "key"), F.struct(F.col("y").alias("tree"), F.col("x").alias("other"), "key"))).alias("e")).select("e.*")
        best = staged(ends.groupBy("tree").agg(F.min(F.struct("key", "other")).alias("best")).select("tree", "best.other", "best.key"), "best-edges")
        chosen.append(best)
        back = best.select(F.col("tree").alias("other"), F.col("other").alias("returns"))
        # two trees that choose each other choose the same edge; the smaller one is the root
        parent = F.when((F.col("returns") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other"))
        roots = _roots(best.join(back, "other", "left").select(F.col("tree").alias("id"), parent.alias("parent")))
        new = cross.join(roots.toDF("x", "rx"), "x").join(roots.toDF("y", "ry"), "y").where("rx <> ry").select("key", F.col("rx").alias("x"), F.col("ry").alias("y"))
        before, cross = cross, staged(new, "cross-edges")
        discard(before, roots)
    if not chosen:
        return edges.select("a", "b").where("false")
    return reduce(DataFrame.union, [c.select("key.a", "key.b") for c in chosen]).distinct()


def sparsified(edges: DataFrame, k: int) -> DataFrame:
    """The readable backbone of edges (a, b, weight): a maximum spanning forest and the k best edges of each node.

    The order of edges is by weight, then by (a, b). Connected nodes stay connected.
    """
    one = staged(merged_edges(edges.where("a <> b")).select("a", "b", "weight"), "merged-edges")
    ends = one.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "weight")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "a", "b"))
    best = ends.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b")
    return one.join(spanning_forest(one).union(best).distinct(), ["a", "b"])


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Weighted modularity of communities (id, community) of the edges (a, b, weight)."""
    labelled = edges.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b")
    inner, total = labelled.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
    ends = labelled.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("s"))
    return inner / total - ends.agg(F.sum((F.col("s") / (2 * total)) ** 2)).first()[0]


def _moved(links: DataFrame, nodes: DataFrame, m2: float, sweeps: int, least_gain: float) -> DataFrame:
    """Local moves of one level: (id, k, c). links: (a, b, w) in both directions; nodes: (id, inner), inner being the weight
    within.

    In a round every node knows the communities around it and their weights; half of the nodes, chosen by hash of id and
    round, go to the best of them, so that two neighbours that want to swap do not do so for ever. Scores are rounded, and
    equal ones go to the smaller community, so that results do not depend on the order of sums.
    """
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"))
    state = staged(nodes.join(degree, "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) + 2 * F.col("inner")).alias("k"), F.col("id").alias("c")), "communities")
    for sweep in range(2 * sweeps):
        weights = state.groupBy("c").agg(F.sum("k").alias("s"))
        near = links.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), F.col("c").alias("to")).agg(F.sum("w").alias("w"))
        own = state.join(weights, "c").select("id", "k", "c", F.col("s").alias("own"))
        seen = near.join(own, "id").join(weights.withColumnRenamed("c", "to"), "to")
        value = F.round(F.col("w") - F.col("k") * (F.col("s") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / m2, 9)
        pick = seen.withColumn("value", value).groupBy("id").agg(F.max(F.when(F.col("to") == F.col("c"), F.col("value"))).alias("stay"), F.max(F.when(F.col("to") != F.col("c"), F.struct("value", (-F.col("to")).alias("less")))).alias("best"))
        stay = F.coalesce("stay", F.round(-F.col("k") * (F.col("own") - F.col("k")) / m2, 9))
        wants = F.coalesce(F.col("best.value") > stay + least_gain, F.lit(False))
        turn = F.pmod(F.xxhash64("id", F.lit(sweep)), F.lit(2)) == 0
        out = own.join(pick, "id", "left").select("id", "k", F.when(wants & turn, -F.col("best.less")).otherwise(F.col("c")).alias("c"), wants.alias("wants"))
        new = staged(out, "communities")
        discard(state)
        state = new.select("id", "k", "c")
        state.staged_at = new.staged_at
        if new.where("wants").isEmpty():
            break
    return state


def communities(edges: DataFrame, sweeps: int = 30, levels: int = 10, least_gain: float = 1e-7) -> DataFrame:
    """Louvain communities of edges (a, b, weight): (id, community), a community being named by its least id.

    Local moves and contraction as joins and aggregations over the whole graph, level by level, until a level merges
    nothing. Negative weights count as 0. The same edges always give the same communities.
    """
    merged = merged_edges(edges.where("a <> b")).select("a", "b", F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    links = staged(merged.union(merged.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    nodes = links.select(F.col("a").alias("id")).distinct().withColumn("inner", F.lit(0.0))
    m2 = links.agg(F.sum("w")).first()[0] or 0.0
    of = staged(nodes.select("id", F.col("id").alias("node")), "members")
    for _ in range(levels if m2 > 0 else 0):
        moves = _moved(links, nodes, m2, sweeps, least_gain)
        n, left = moves.agg(F.count("*"), F.countDistinct("c")).first()
        if n == left:
            break
        step = moves.select(F.col("id").alias("node"), "c")
        before, of = of, staged(of.join(step, "node").select("id", F.col("c").alias("node")), "members")
        ends = links.join(step.toDF("a", "ca"), "a").join(step.toDF("b", "cb"), "b").groupBy("ca", "cb").agg(F.sum("w").alias("w"))
        ends = staged(ends, "contracted")
        inside = nodes.join(step.withColumnRenamed("node", "id"), "id").groupBy("c").agg(F.sum("inner").alias("inner"))
        within = ends.where("ca = cb").select(F.col("ca").alias("c"), (F.col("w") / 2).alias("more"))
        nodes = staged(inside.join(within, "c", "left").select(F.col("c").alias("id"), (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner")), "nodes")
        old, links = links, staged(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), "links")
        discard(before, old, ends)
    names = of.groupBy("node").agg(F.min("id").alias("community"))
    return of.join(names, "node").select("id", "community")
