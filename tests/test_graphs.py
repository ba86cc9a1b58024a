"""Greedy rounds, spanning forests and communities against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import dedup, graph, greedy


def greedy_by_hand(nodes, pairs):
    """One pass from the best node: nodes (id, place)."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    place, kept, out = dict(nodes), [], {}
    for n in sorted(place, key=lambda n: (place[n], n)):
        heads = [k for k in kept if k in near.get(n, ())]
        if heads:
            out[n] = min(heads, key=lambda k: (place[k], k))
        else:
            kept.append(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    nodes = [(n, float(rng.randrange(8))) for n in range(60)]
    place = dict(nodes)
    cliques = [rng.sample(range(60), rng.randrange(1, 7)) for _ in range(12)] + [rng.sample(range(60), 2) for _ in range(40)]
    rows = [(str(g), n, place[n]) for g, c in enumerate(cliques) for n in c] * 2
    got = greedy.greedy(spark.createDataFrame(rows, "group string, id long, place double"))
    want = greedy_by_hand(nodes, [(a, b) for c in cliques for a in c for b in c if a < b])
    assert {r.id: r.kept_id for r in got.collect()} == want


def test_chain_is_settled_from_its_best_end(spark):
    rows = [(f"{n}", m, m) for n in range(9) for m in (n, n + 1)]
    got = greedy.greedy(spark.createDataFrame(rows, "group string, id long, place int"))
    assert sorted((r.id, r.kept_id) for r in got.collect()) == [(n, n - 1) for n in range(1, 10, 2)]


def test_greedy_odd(spark):
    rows = [("a", None, 1.0), (None, 1, 1.0), ("b", 2, 1.0), ("c", 3, None), ("c", 4, 2.0)]
    assert [(r.id, r.kept_id) for r in greedy.greedy(spark.createDataFrame(rows, "group string, id long, place double")).collect()] == [(4, 3)]
    assert greedy.greedy(spark.createDataFrame([], "group string, id long, place double")).collect() == []


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    rows = [(n, rng.sample(words, rng.randrange(0, 30))) for n in range(150)]
    rows += [(200 + n, list(rows[n][1])) for n in range(20)] + [(300, None), (301, []), (302, ["only"]), (303, ["only", "only"])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    for threshold in (0.35, 0.65, 0.8):
        want = {(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] and b[1] and jaccard(set(a[1]), set(b[1])) >= threshold}
        got = [(r.a, r.b) for r in dedup.similar_pairs(df, "id", "w", threshold).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_fuzzy_equals_one_pass(spark):
    rng = random.Random(6)
    base = [[f"t{k}w{j}" for j in range(10)] for k in range(8)]
    rows = [(n, rng.choice([0.5, 1.0, 2.0, None]), rng.sample(base[n % 8], 9) + [f"x{rng.randrange(3)}"]) for n in range(80)]
    got = {r.id: (r.kept_id, r.similar_count) for r in dedup.fuzzy(spark.createDataFrame(rows, "id long, score double, w array<string>"), "id", "w", "score").collect()}
    pairs = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if jaccard(set(a[2]), set(b[2])) >= 0.65]
    taken = greedy_by_hand([(n, (s is None, -(s or 0))) for n, s, _ in rows], pairs)
    heads = [taken.get(n, n) for n, _, _ in rows]
    assert got == {n: (taken.get(n, n), heads.count(n) - 1 if taken.get(n, n) == n else 0) for n, _, _ in rows}


def test_briefing(spark):
    rows = [
        (1, "Widget 4.2 ships with faster joins", 0.4), (2, "Widget 4.2 ships with faster joins!", 0.9), (3, "Widget 4.2 ships", 0.5), (4, "Announcing Gadget 5 beta", 0.7), (5, "Announcing  gadget 7 BETA", 0.6),
        (6, "Something else entirely happens here", 0.1), (7, "!!!", 0.2), (8, "???", 0.3), (9, None, 0.2), (10, "tiny", 0.2), (11, "tiny thing", None), (12, "Something else entirely happens", None), (13, "entirely new words are here", 0.05),
    ]
    got = {r.id: r.kept_id for r in dedup.briefing(spark.createDataFrame(rows, "id long, title string, score double"), "id", "title", "score").collect()}
    assert got == {n: n for n, _, _ in rows} | {1: 2, 3: 2, 5: 4, 12: 6}


def forest_by_hand(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = set()
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_backbone(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b): float(rng.randrange(6)) for a, b in (sorted(rng.sample(range(50), 2)) for _ in range(130)) if (a < 25) == (b < 25)}
    edges = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    assert {(r.a, r.b) for r in graph.spanning_forest(df).collect()} == forest_by_hand(edges)
    best = {e for n in range(50) for e in [(a, b) for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])) if n in (a, b)][:2]}
    back = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(-1.0).alias("weight"))).union(spark.createDataFrame([(1, 1, 9.0)], "a long, b long, weight double"))
    assert {(r.a, r.b) for r in graph.sparsified(back, 2).collect()} == forest_by_hand(edges) | best
    assert graph.sparsified(df.where("false"), 2).collect() == []


def louvain_by_hand(edges, least_gain=1e-7):
    """One task: nodes in order, level by level."""
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    member = {n: n for n in ids}
    m = sum(w for _, _, w in edges)
    while True:
        near, inner = {c: {} for c in member.values()}, dict.fromkeys(member.values(), 0.0)
        for a, b, w in edges:
            x, y = member[a], member[b]
            if x == y:
                inner[x] += w
            else:
                near[x][y] = near[x].get(y, 0) + w
                near[y][x] = near[y].get(x, 0) + w
        k = {c: sum(near[c].values()) + 2 * inner[c] for c in near}
        of, total = {c: c for c in near}, dict(k)
        any_moved = False
        for _ in range(30):
            moved = False
            for v in sorted(near):
                links = {}
                for u, w in near[v].items():
                    links[of[u]] = links.get(of[u], 0) + w
                total[of[v]] -= k[v]
                best, gain = of[v], links.get(of[v], 0) - total[of[v]] * k[v] / (2 * m)
                for c in sorted(links):
                    if (g := links[c] - total[c] * k[v] / (2 * m)) > gain + least_gain:
                        best, gain = c, g
                total[best] += k[v]
                moved |= best != of[v]
                of[v] = best
            any_moved |= moved
            if not moved:
                break
        if not any_moved:
            return member
        member = {n: of[c] for n, c in member.items()}


def test_communities(spark):
    rng = random.Random(4)
    edges = {}
    for _ in range(420):
        a, b = sorted(rng.sample(range(90), 2))
        if a // 15 == b // 15 or rng.random() < 0.12:
            edges[a, b] = 0.5 + rng.random()
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, weight double")
    got = graph.communities(df).collect()
    hand = spark.createDataFrame(list(louvain_by_hand(rows).items()), "id long, community long")
    mine = spark.createDataFrame([tuple(r) for r in got], "id long, community long")
    assert graph.modularity(df, mine) >= 0.98 * graph.modularity(df, hand) > 0.3
    assert sorted(map(tuple, graph.communities(df.repartition(3)).collect())) == sorted(map(tuple, got))
    assert all(min(r.id for r in got if r.community == c) == c for c in {r.community for r in got})
    assert graph.communities(df.where("false")).collect() == []


def test_nearest_writes_no_vector_for_each_comparison(spark, monkeypatch):
    import numpy as np

    from siftwell.operators import vectors

    monkeypatch.setattr(vectors, "LEAST_ROWS", 8)
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.RandomState(1)
    x = rng.randn(300, 6)
    x[100:130] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None), (902, [1.0, 2.0]), (903, [2.0, 4.0]), (None, [1.0] * 6), (904, [float("nan")] * 6)]
    got = vectors.nearest(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3, 0.3)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString() and "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    best: dict = {}
    for r in got.collect():
        best.setdefault(r.a, []).append((-r.cosine, r.b))
    for i in range(300):
        assert sorted(best[i])[:3] == sorted((-c[i, j], j) for j in range(300) if j != i and c[i, j] >= 0.3)[:3]
    assert [best[902], best[903]] == [[(-1.0, 903)], [(-1.0, 902)]] and set(best) == set(range(300)) | {902, 903}


def test_leaders_in_rounds(spark, monkeypatch):
    import numpy as np

    from siftwell.operators import vectors

    monkeypatch.setattr(vectors, "LEADERS", 9)
    rng = np.random.RandomState(2)
    x, w, p = rng.randn(120, 4), [[f"w{n}" for n in rng.randint(0, 12, 3)] for _ in range(120)], rng.randint(0, 20, 120).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c, share = np.round(u @ u.T, 9), lambda i, j: len(set(w[i]) & set(w[j])) / len(set(w[i]) | set(w[j]))
    want: dict = {}
    for i in sorted(range(120), key=lambda i: (p[i], i)):
        if i not in want:
            want |= {j: i for j in range(120) if j not in want and (j == i or c[i, j] > 0.8 or (c[i, j] > 0.5 and share(i, j) > 0.4))}
    df = spark.createDataFrame([(i, x[i].tolist(), w[i], float(p[i])) for i in range(120)], "id long, v array<double>, w array<string>, p double")
    got = vectors.leaders(df, "id", "v", "w", F.col("p"), 0.8, 0.5, 0.4)
    assert {r.id: r.kept_id for r in got.collect()} == want
    assert vectors.leaders(df.where("false"), "id", "v", "w", F.col("p"), 0.8, 0.5, 0.4).collect() == []


@pytest.mark.parametrize("most", [0, 1000])
def test_greedy_pairs_equal_one_pass(spark, monkeypatch, most):
    monkeypatch.setattr(greedy, "BROADCAST_ROWS", most)
    rng = random.Random(12)
    pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(260)})
    got = {r.second: r.first for r in greedy.greedy_pairs(spark.createDataFrame(pairs, "first long, second long")).collect()}
    assert got == greedy_by_hand([(n, n) for n in range(120)], pairs)
    assert greedy.greedy_pairs(spark.createDataFrame([], "first long, second long")).collect() == []


def rows_shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(at).shuffleWriteRecords() for at in range(stages.size()))


def test_fuzzy_shuffles_no_pairs_of_sets_that_differ(spark):
    rng = random.Random(9)
    rows = [(n, 1.0, rng.sample([f"w{k}" for k in range(120)], 50)) for n in range(600)] + [(900, 2.0, None), (901, 2.0, [])]
    rows.append((902, 3.0, rows[7][2][:-2] + ["other", "words"]))
    before = rows_shuffled(spark)
    got = {r.id: (r.kept_id, r.similar_count) for r in dedup.fuzzy(spark.createDataFrame(rows, "id long, score double, w array<string>"), "id", "w", "score").collect()}
    # nearly all of the 180,300 pairs share a word of their beginnings; the words alone are 30,050
    assert rows_shuffled(spark) - before < 15_000
    assert got == {n: (n, 0) for n, _, _ in rows} | {7: (902, 0), 902: (902, 1)}


def test_similar_sets_in_many_blocks_and_cells(spark, monkeypatch):
    for name, value in (("BLOCK_SETS", 8), ("BLOCKS_A_TASK", 2), ("PART_BYTES", 4096), ("BROADCAST_NEEDS", 3), ("TOGGLED", 4096)):
        monkeypatch.setattr(dedup, name, value)
    rng, rows = random.Random(10), []
    for n, size in enumerate([1, 2, 3, 7, 15, 31, 64, 90, 200, 700, 1500] * 3):
        base = [f"b{n}-{k}" for k in range(size)]
        for copy in range(6):
            words = [w if rng.random() > 0.04 * copy else f"x{rng.randrange(10**9)}" for w in base] + [f"y{rng.randrange(10**9)}" for _ in range(size * copy // 12)]
            rows.append((len(rows), rng.sample(words, len(words))))
    for threshold in (0.35, 0.65, 0.9):
        got = sorted((r.a, r.b, r.similarity) for r in dedup.similar_pairs(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", threshold).collect())
        assert got == [(a, b, s) for a, x in rows for b, y in rows[a + 1 :] if (s := jaccard(set(x), set(y))) >= threshold]


def test_word_jaccard_sends_the_words_of_a_group_of_near_copies_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_BYTES", 16384)
    rows = [(n, [f"c{n // 4}-{k}" for k in range(30)] + [f"own{n}"]) for n in range(400)]
    sent = []

    def staged(df, label, real=dedup.staged):
        out = real(df, label)
        if label == "word-cells":
            sent.append(out.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().count())
        return out

    monkeypatch.setattr(dedup, "staged", staged)
    pairs = dedup.similar_pairs(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", 0.65).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(a, b) for a in range(400) for b in range(a + 1, 400) if a // 4 == b // 4]
    assert sent == [400]
