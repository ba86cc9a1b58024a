"""Removal of repeated and similar items: exact, fuzzy, by topic, by time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.graph import components
from siftwell.operators.greedy import greedy, greedy_pairs, pairs_as_groups
from siftwell.operators.staging import broadcast_within, discard, staged


def exact(items: DataFrame, identity: Column, score: str, key: str) -> DataFrame:
    """The best row of each identity; rows of null or empty identity all stay."""
    named = items.withColumn("_i", identity)
    # rows that all stay are no group, however many they are
    alone = F.when(F.coalesce(F.col("_i"), F.lit("")) == "", F.col(key))
    rank = F.row_number().over(Window.partitionBy("_i", alone).orderBy(F.desc(score), key))
    return named.withColumn("_r", rank).where("_r = 1 or _i is null or _i = ''").drop("_i", "_r")


#: Longs of a sketch of one width: a set's words toggle its bits.
SKETCH = 16
#: Bits that are toggled at once.
TOGGLED = 1 << 19
#: Sets of a block and bytes of their sketches at most, blocks of one task on either side, sides that are cut at least.
BLOCK_SETS, BLOCK_BYTES, BLOCKS_A_TASK, LEAST_SIDES = 4096, 1 << 20, 8, 4
#: Bytes of words of one part of the sets that are compared word by word; a task holds two parts. Partners compared at once.
PART_BYTES, PARTNERS = 32 << 20, 1024
#: Sets that are broadcast at most, with the cells that need them.
BROADCAST_NEEDS = 1_000_000


def _parities(words: pa.ListArray, longs: int) -> np.ndarray:
    """Sketches of the sets, one a row: each word toggles one bit."""
    sizes, bits = words.value_lengths().to_numpy(zero_copy_only=False), 64 * longs
    at, ends = words.flatten().to_numpy(zero_copy_only=False) & (bits - 1), np.r_[0, np.cumsum(sizes)]
    out, step = np.zeros((len(sizes), longs), "<u8"), max(1, TOGGLED // bits)
    for start in range(0, len(sizes), step):
        own = sizes[start : start + step]
        row = np.repeat(np.arange(len(own)), own)
        odd = np.bincount(row * bits + at[ends[start] : ends[start + len(own)]], minlength=len(own) * bits) & 1
        out[start : start + step] = np.packbits(odd.astype(np.uint8).reshape(len(own), bits), axis=1, bitorder="little").view("<u8")
    return out


def sketches(sets: DataFrame) -> DataFrame:
    """Parity sketches of the sets (id, n, w) of hashes, all of one width: (id, n, s0, s1, ...)."""

    def toggled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = _parities(batch.column("w"), SKETCH).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *[pa.array(longs[:, at]) for at in range(SKETCH)]], ["id", "n", *[f"s{at}" for at in range(SKETCH)]])

    schema = sets.select("id", "n").schema
    for at in range(SKETCH):
        schema = schema.add(f"s{at}", "long")
    return sets.select("id", "n", "w").mapInArrow(toggled, schema)


def _longs(n: np.ndarray | float, threshold: float) -> np.ndarray:
    """Longs of a sketch, a power of two, in which sets of n words that have little in common differ by more than similar ones."""
    return 2 ** np.ceil(np.log2(np.maximum(1.0, np.multiply(n, 6 * (1 - threshold) / (1 + threshold)) / 64))).astype(int)


def _folded(x: np.ndarray, longs: int) -> np.ndarray:
    """Sketches (one a column) as narrower ones of the same sets."""
    return np.bitwise_xor.reduce(x.reshape(-1, longs, x.shape[1]), axis=0)


def _near(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Columns of x and of y whose sets may be similar, by sketches and sizes; sizes ascend. Of one block (own) each pair once.

    A bit in which two sketches differ is a word that one of the sets has alone. Narrow sketches are compared first.
    """
    most = min(len(x), len(y))
    x, y = _folded(x, most), _folded(y, most)
    narrow = min(most, int(_longs((nx[-1] + ny[-1]) / 2, threshold)))
    short_x, short_y = _folded(x, narrow), _folded(y, narrow)
    alone = (1 - threshold) / (1 + threshold)
    low, high = np.searchsorted(ny, np.ceil(nx * threshold - 1e-9)), np.searchsorted(ny, np.floor(nx / threshold + 1e-9), side="right")
    if own:
        low = np.maximum(low, np.arange(len(nx)) + 1)
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in np.flatnonzero(low < high):
        part = slice(low[i], high[i])
        limit = np.floor((nx[i] + ny[part]) * alone + 1e-6).astype(np.int32)
        found = np.flatnonzero(np.bitwise_count(short_y[:, part] ^ short_x[:, i, None]).sum(axis=0, dtype=np.uint16 if narrow < 1024 else np.uint32) <= limit)
        if len(found) and narrow < most:
            found = found[np.bitwise_count(y[:, low[i] + found] ^ x[:, i, None]).sum(axis=0, dtype=np.int32) <= limit[found]]
        if len(found):
            left.append(np.full(len(found), i))
            right.append(low[i] + found)
    return np.concatenate(left), np.concatenate(right)


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, na, b, nb) of sets (id, n, m) that may be similar, each once; m is a sketch of four times the width that is
    compared first.

    Sketches are packed into blocks of about one size. A task holds some blocks and reads some others, so that no row is
    written for a pair that sketches tell apart. The number of comparisons is the square of that of sets within a size.
    """
    count, size = sets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("m")), F.lit(0))).first()
    sides = max(-(-count // (BLOCK_SETS * BLOCKS_A_TASK)), -(-size // (BLOCK_BYTES * BLOCKS_A_TASK)), min(LEAST_SIDES, -(-count // BLOCK_SETS)), 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held) if (held := list(batches)) else None
        if part is None or not part.num_rows:
            return
        n, ids, m = part["n"].to_numpy(), part["id"].combine_chunks(), part["m"].combine_chunks()
        longs = pc.binary_length(m).to_numpy() // 8
        runs = np.flatnonzero(np.r_[True, longs[1:] != longs[:-1], True])
        for first, end in zip(runs[:-1], runs[1:], strict=True):
            step = max(1, min(BLOCK_SETS, BLOCK_BYTES // (8 * int(longs[first]))))
            for start in range(first, end, step):
                rows = slice(start, min(start + step, end))
                x = np.frombuffer(b"".join(m[rows].to_pylist()), "<u8").reshape(-1, longs[first]).T
                held_ids = pa.ListArray.from_arrays(pa.array([0, x.shape[1]], pa.int32()), ids[rows])
                columns = [ids[start : start + 1], pa.array(n[start : start + 1]), pa.array(n[rows][-1:]), held_ids, [n[rows].astype("<i4").tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], ["first", "low", "high", "ids", "ns", "m"])

    kind = sets.schema["id"].dataType.simpleString()
    near = sets.select("id", "n", "m").repartitionByRange(sides, "n", "id").sortWithinPartitions("n", "id")
    blocks = staged(near.mapInArrow(packed, f"first {kind}, low int, high int, ids array<{kind}>, ns binary, m binary"), "word-blocks")
    others = blocks.toDF(*[f"other_{c}" for c in blocks.columns]).coalesce(sides).hint("shuffle_replicate_nl")
    once = (F.col("low") < F.col("other_low")) | ((F.col("low") == F.col("other_low")) & (F.col("first") <= F.col("other_first")))
    both = blocks.coalesce(sides).join(others, once & (F.col("other_low") * threshold - 1e-6 <= F.col("high")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                nx, ny = (np.frombuffer(row[c].as_buffer(), "<i4") for c in ("ns", "other_ns"))
                x, y = (np.frombuffer(row[c].as_buffer(), "<u8").reshape(-1, len(n)) for c, n in (("m", nx), ("other_m", ny)))
                i, j = _near(x, nx, y, ny, threshold, row["first"] == row["other_first"])
                yield pa.RecordBatch.from_arrays([row["ids"].values.take(pa.array(i)), pa.array(nx[i]), row["other_ids"].values.take(pa.array(j)), pa.array(ny[j])], ["a", "na", "b", "nb"])

    met = staged(both.mapInArrow(compared, f"a {kind}, na int, b {kind}, nb int"), "word-candidates")
    discard(blocks)
    return met


def _cells(met: DataFrame) -> DataFrame:
    """Candidates (a, na, b, nb) dealt into cells: (cell, a, b). A cell has sets of two parts, each of PART_BYTES of words or so.

    Sets around one least set are of one part, so that most words go to one cell; where these are many, they are dealt by set.
    """
    both = met.select("a", "na", "b").union(met.select("b", "nb", "a")).toDF("id", "n", "other")
    named = both.groupBy("id").agg(F.min("n").alias("n"), F.least("id", F.min("other")).alias("label"))
    named = staged(named, "word-labels")
    parts = max(1, -(-8 * (named.agg(F.sum("n")).first()[0] or 0) // PART_BYTES))
    large = named.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") * 8 > PART_BYTES // 8).select("label", F.lit(True).alias("large"))
    name = F.when(F.col("large"), F.xxhash64("id")).otherwise(F.xxhash64("label"))
    part = staged(named.join(broadcast_within(large, BROADCAST_NEEDS), "label", "left").select("id", F.pmod(name, F.lit(parts)).alias("part")), "word-parts")
    dealt = met.select("a", "b")
    for end in "ab":
        dealt = dealt.join(broadcast_within(part.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}")), BROADCAST_NEEDS), end)
    return dealt.select((F.least("part_a", "part_b") * parts + F.greatest("part_a", "part_b")).alias("cell"), "a", "b")


def _counted(pairs: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """Of pairs (a, b) of the sets (id, w) those with a similarity of at least the threshold; words ascend."""
    words = sets["w"].combine_chunks()
    values, ends = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    a, b = (pc.index_in(pairs[end], value_set=sets["id"].combine_chunks()).to_numpy().astype(int) for end in "ab")
    order = np.argsort(a, kind="stable")
    similarity = np.zeros(len(a))
    runs = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0, True]) if len(a) else np.zeros(1, int)
    for first, end in zip(runs[:-1], runs[1:], strict=True):
        own = values[ends[a[order[first]]] : ends[a[order[first]] + 1]]
        for start in range(first, end, PARTNERS):
            rows = order[start : min(start + PARTNERS, end)]
            sizes = ends[b[rows] + 1] - ends[b[rows]]
            met = np.concatenate([values[ends[k] : ends[k + 1]] for k in b[rows]])
            hit = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
            common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=int)
            similarity[rows] = common / (len(own) + sizes - common)
    good = pa.array(similarity >= threshold)
    return pa.table({"a": pairs["a"].filter(good), "b": pairs["b"].filter(good), "similarity": pa.array(similarity).filter(good)})


def similar_sets(items: DataFrame, key: str, words: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Word sets with Jaccard similarity of at least the threshold: pairs (a, b, similarity) of sets, a < b, and the
    members (set, id) of each set, which is named by its least id.

    Equal sets are one set, so that copies do not multiply. Sketches of all sets within a size are compared by pairs of
    packed blocks; what they cannot tell apart is compared by words. For that, candidates are dealt into cells by parts of
    both sets, and the words of a set go once to each cell that needs them. So disk grows with the sets and the candidates,
    and products with the square of the sets. Words are told apart by 64 bits of hash. Rows without words have no part in it.
    """
    hashed = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("w"))
    rows = staged(hashed.select(F.struct("id", "w").alias("s"), F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.hash("w").alias("g")), "word-sets").where("n > 0")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = 4 * _longs(batch.column("n").to_numpy(), threshold)
            for width in np.unique(longs):
                own = batch.filter(pa.array(longs == width))
                data = _parities(own.column("w"), int(width)).tobytes()
                offsets = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * np.int32(8 * width))
                m = pa.BinaryArray.from_buffers(pa.binary(), own.num_rows, [None, offsets.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("h", "n", "g", "id")], m], ["h", "n", "g", "id", "m"])

    narrow = rows.select("h", "n", "g", F.col("s.id").alias("id"))
    marked = rows.select("h", "n", "g", F.col("s.id").alias("id"), F.col("s.w").alias("w")).mapInArrow(sketched, narrow.schema.add("m", "binary"))
    sets = staged(marked.groupBy("h", "n", "g").agg(F.min("id").alias("id"), F.first("m").alias("m")), "word-sketches")
    members = staged(narrow.join(sets.select("h", "n", "g", F.col("id").alias("set")), ["h", "n", "g"]).select("set", "id"), "word-members")
    met = _candidates(sets, threshold)
    dealt = staged(_cells(met), "word-cells")
    needs = broadcast_within(dealt.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct(), BROADCAST_NEEDS)
    held = rows.select(F.col("s.id").alias("id"), F.col("s.w").alias("w")).join(needs, "id").select(F.col("cell").alias("of"), "id", "w")
    kind = sets.schema["id"].dataType.simpleString()

    def counted(pairs: pa.Table, own: pa.Table) -> pa.Table:
        return _counted(pairs, own, threshold)

    found = dealt.groupBy("cell").cogroup(held.groupBy("of")).applyInArrow(counted, f"a {kind}, b {kind}, similarity double")
    pairs = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), "word-pairs")
    discard(sets, dealt)
    return pairs, members


def similar_pairs(items: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """All pairs a < b of rows whose word sets have Jaccard similarity of at least the threshold, copies among them."""
    pairs, members = similar_sets(items, key, words, threshold)
    same = pairs.select("a", "b", "similarity").union(members.select("set").distinct().select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity")))
    left, right = members.toDF("a", "ia"), members.toDF("b", "ib")
    every = same.join(left, "a").join(right, "b").where((F.col("a") < F.col("b")) | (F.col("ia") < F.col("ib")))
    return every.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")


def fuzzy(items: DataFrame, key: str, words: str, score: str, threshold: float = 0.65) -> DataFrame:
    """Greedy removal, best score first: an item similar to a kept one goes to it. Returns id, kept_id, similar_count.

    Items of equal words have the same neighbours, so the best of them decides for all. Null scores come last, ties go to
    the smaller id.
    """
    pairs, members = similar_sets(items, key, words, threshold)
    scored = members.join(items.select(F.col(key).alias("id"), F.col(score).cast("double").alias("score")), "id")
    place = F.struct(F.col("score").isNull().alias("none"), (-F.coalesce("score", F.lit(0.0))).alias("low"), F.col("id"))
    best = scored.groupBy("set").agg(F.min(place).alias("best"))
    # numbers that ascend with the places
    places = staged(best.orderBy("best").select("set", F.col("best.id").alias("kept_id"), F.monotonically_increasing_id().alias("at")), "set-places")
    ends = pairs.select("a", "b")
    for end in "ab":
        ends = ends.join(places.select(F.col("set").alias(end), F.col("at").alias(f"at_{end}")), end)
    taken = greedy_pairs(ends.select(F.least("at_a", "at_b").alias("first"), F.greatest("at_a", "at_b").alias("second")))
    heads = places.select("set", "at").join(taken.select(F.col("second").alias("at"), "first"), "at", "left").select("set", F.coalesce("first", "at").alias("at"))
    heads = heads.join(places.select("at", "kept_id"), "at").select("set", "kept_id")
    found = staged(members.join(heads, "set").select("id", "kept_id"), "fuzzy")
    counts = found.where("id <> kept_id").groupBy(F.col("kept_id").alias("id")).agg(F.count("*").alias("similar_count"))
    out = items.select(F.col(key).alias("id")).join(found, "id", "left").join(counts, "id", "left")
    return out.select("id", F.coalesce("kept_id", "id").alias("kept_id"), F.coalesce("similar_count", F.lit(0)).alias("similar_count"))


def normal_heading(title: Column) -> Column:
    """Lower case, letters and digits, blanks for white space, dashes and underscores; all else goes."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}\s_-]+", ""), r"[\s_-]+", " "))


def briefing(items: DataFrame, key: str, title: str, score: str, threshold: float = 0.55, least: int = 10, longer: int = 200) -> DataFrame:
    """Near-duplicate headings fall to the best scored one, in one greedy order: id, kept_id.

    Two headings are duplicates when one begins with the other (at least `least` bytes, at most `longer` more), when they
    have at least two words and differ in numbers alone, or when their sets of word pairs have Jaccard similarity of at
    least the threshold. Beginnings meet by hash at the lengths that occur behind the same first `least` bytes, series by
    their words; a series is one group, whatever its size. Headings without letters and digits stay; null scores come last.
    """
    head = normal_heading(F.col(title)).alias("t")
    place = F.struct(F.col(score).isNull().alias("none"), (-F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("low"))
    rows = items.select(F.col(key).alias("id"), head, place.alias("place")).where("t <> ''")
    # equal headings have the same neighbours; the best decides
    named = staged(rows.groupBy("t").agg(F.min(F.struct("place", "id")).alias("at")).select("t", "at.id", "at.place"), "headings")
    raw = named.select("id", "place", F.col("t").cast("binary").alias("b")).where(F.octet_length("b") >= least)
    raw = raw.select("id", "place", "b", F.octet_length("b").alias("n"), F.substring("b", 1, least).alias("start"))
    lengths = raw.groupBy("start").agg(F.collect_set("n").alias("lengths"))
    shorter = raw.join(lengths, "start").select("id", "place", "b", F.explode(F.filter("lengths", lambda x: (x < F.col("n")) & (x >= F.col("n") - longer))).alias("cut"))
    shorter = shorter.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.expr("substring(b, 1, cut)").alias("text"))
    begins = shorter.join(raw.select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("b").alias("text")), "text")
    words = F.filter(F.split("t", " "), lambda w: ~F.rlike(w, F.lit("^[0-9]+$")))
    series = named.select(F.concat(F.lit("series "), F.array_join(words, " ")).alias("group"), "id", "place", F.size(words).alias("n")).where("n >= 2").drop("n")
    split = F.split("t", " ")
    couples = F.when(F.size(split) < 2, split).otherwise(F.transform(F.slice(split, F.lit(1), F.size(split) - 1), lambda w, i: F.concat_ws(" ", w, F.get(split, i + 1))))
    pairs, members = similar_sets(named.select("id", couples.alias("couples")), "id", "couples", threshold)
    copies = members.select(F.concat(F.lit("set "), F.col("set").cast("string")).alias("group"), "id")
    near = pairs.select(F.concat(F.lit("pair "), F.col("a").cast("string"), F.lit("/"), F.col("b").cast("string")).alias("group"), F.explode(F.array("a", "b")).alias("set")).join(members, "set").select("group", "id")
    near = near.union(copies).join(named.select("id", "place"), "id").select("group", "id", "place")
    groups = pairs_as_groups(begins, "a", "b", "pa", "pb").unionByName(series).unionByName(near)
    taken = greedy(groups)
    heads = named.select("t", F.col("id").alias("best")).join(taken.select(F.col("id").alias("best"), "kept_id"), "best", "left").select("t", F.coalesce("kept_id", "best").alias("kept_id"))
    out = items.select(F.col(key).alias("id"), head).join(heads, "t", "left")
    return out.select("id", F.coalesce("kept_id", "id").alias("kept_id"))


def topic_dedup(items: DataFrame, topic: str, score: str, key: str, gap: float = 0.10) -> DataFrame:
    """Of each topic the best item and those within the gap of it; items without a topic stay."""
    best = F.max(score).over(Window.partitionBy(topic))
    return items.withColumn("_b", best).where(F.col(topic).isNull() | (F.col("_b") - F.col(score) <= gap)).drop("_b")


def clusters(items: DataFrame, key: str, words: str, threshold: float = 0.35) -> DataFrame:
    """Items joined by word similarity, directly or through others: id, cluster (least id), size."""
    pairs, members = similar_sets(items, key, words, threshold)
    sets = components(pairs).withColumnRenamed("id", "set")
    parts = members.join(sets, "set", "left").select("id", F.coalesce("component", "set").alias("component"))
    out = items.select(F.col(key).alias("id")).join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    return out.join(out.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("id", "cluster", "size")
