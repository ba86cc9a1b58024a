"""Set-similarity join of documents on word shingles: universe partitioning with the pigeonhole principle.

Shingles are hashed into the segments of a size band. Two sets with Jaccard similarity of at least t differ in at most
H = (1 - t)/(1 + t) * (|r| + |s|) shingles, so that among segments whose levels add up to H + 1 at least one of level 1 is
identical, or one of level 2 differs in at most one shingle. A set therefore indexes only its first segments that are not
empty, up to that sum: a segment by its hash, one of level 2 also by the hashes with one shingle left out. Documents that
share a signature are candidates. A parity sketch, whose differing bits never outnumber the differing shingles, drops
candidates that cannot be similar; the others are verified on the words of their whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WordHashes, batches_of, binary_values, broadcast_within, columns, components, discard, mixed, shingle_hashes, shingles_of, signed, staged, words_of

#: Ratio of the largest to the smallest set size of a band.
BAND = 2.0
#: Cost of a segment that unrelated sets share, in signatures, for the allocation of levels.
COLLISION_COST = 40.0
#: Bits of a signature. Signatures of different segments that are equal by chance only cost a comparison.
SIGNATURE_BITS = 48
#: Ids of up to this many documents (2 MB) are broadcast when texts are fetched again; beyond, Spark shuffles.
BROADCAST_IDS = 250_000
#: Rounds in which members are compared with one centre before what is left of the buckets is compared in blocks.
STAR_ROUNDS = 2
#: Sets of a block, and bytes of texts; larger buckets are cut and each pair of blocks is compared on its own.
BLOCK_SETS, BLOCK_BYTES = 1024, 8_000_000
#: Rows of blocks, and their bytes of sketches or texts, that are brought to a task together, about.
TASK_ROWS, TASK_BYTES = 20_000, 8_000_000
#: Texts that are passed to Python together.
BATCH_TEXTS = 500
#: Signatures that a task holds before it passes rows on, and sets that it keeps while it verifies.
HELD_SIGNATURES, KEPT_SETS = 100_000, 100


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def band_top(band: int) -> int:
    """The largest set size in a band."""
    top = math.ceil(BAND ** (band + 1)) + 1
    while top > 1 and band_of(top) > band:
        top -= 1
    return top


def most_different(sizes: int, num: int, den: int) -> int:
    """Largest symmetric difference of two sets whose sizes add up to `sizes`, with similarity of at least num/den."""
    return (den - num) * sizes // (den + num)


def levels_needed(size: int, top: int, num: int, den: int) -> int:
    """Sum of levels that a set must index in a band: one more than it can differ from any similar set of the band."""
    return most_different(size + min(top, size * den // num), num, den) + 1


@lru_cache(maxsize=256)
def allocation(band: int, num: int, den: int) -> tuple[int, int]:
    """Segments of a band, and how many of them, the first ones, have level 2.

    Together the levels are at least as many as the largest sets need, and so many more that these sets seldom fill too
    few segments. Among the numbers of level-2 segments the one of least cost is taken: the signatures of a middling set,
    plus what segments cost that are so small that unrelated sets share them.
    """
    top = band_top(band)
    need = levels_needed(top, top, num, den)
    size, best = (top + 1) * 0.75, None
    asked = levels_needed(int(size), top, num, den)
    for two in sorted({need * k // 32 for k in range(17)}):
        count = max(1, need - two)
        while need > 1 and count < 2 * need and count + two < need + count * math.exp(-top / count) + 3 * math.sqrt(count * math.exp(-top / count)):
            count += max(1, count // 50)
        each = size / count
        used = min(two, asked // 2)
        single = max(0, asked - 2 * used)
        cost = used * (1 + each) + single + COLLISION_COST * (single * math.exp(-1.5 * each) + used * math.exp(-1.5 * max(0.0, each - 1)))
        if best is None or cost < best[0]:
            best = (cost, count, two)
    return best[1:]


def signatures(shingles: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
    """Signatures of a set of `size` shingles in its own band and in those where a similar larger set can be.

    Of two similar sets, take the one whose indexed segments end first. It indexes levels for one more difference than
    there is, so one of these segments is the same in both, or differs in one shingle and has level 2; the other set
    indexes it too. A set that fills too few segments indexes all, the empty ones included, and leaves out single
    shingles too: two such sets then agree in a segment, as all levels together are more than their differences.
    """
    out = []
    for band in range(band_of(size), band_of(max(size, size * den // num)) + 1):
        count, two = allocation(band, num, den)
        need = levels_needed(size, band_top(band), num, den)
        place = mixed(shingles ^ np.uint64(band + 1))
        segment = ((place >> np.uint64(11)) % np.uint64(count)).astype(np.int64)
        element = mixed(place ^ np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(segment, kind="stable")
        segment, element = segment[order], element[order]
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        number, held = segment[first], np.diff(first, append=len(segment))
        whole = np.add.reduceat(element, first)
        label = mixed(number.astype(np.uint64) * np.uint64(256) + np.uint64(band))
        sums = np.cumsum(np.where((number < two) & (held > 1), 2, 1))
        last = int(np.searchsorted(sums, need)) + 1
        least = 2
        if sums[-1] < need:
            least = 1
            empty = np.setdiff1d(np.arange(count), number).astype(np.uint64)
            out.append(mixed(mixed(empty * np.uint64(256) + np.uint64(band))))
        out.append(mixed(whole[:last] + label[:last]))
        if two:
            of = np.repeat(np.arange(len(first)), held)
            cut = (of < last) & (number[of] < two) & (held[of] >= least)
            out.append(mixed(whole[of[cut]] - element[cut] + label[of[cut]]))
    return np.unique(np.concatenate(out) >> np.uint64(64 - SIGNATURE_BITS))


def sketch_bits(size: int, num: int, den: int) -> int:
    """Bits of the parity sketch of a set: a power of two, about four times as many as its similar sets differ in."""
    return 1 << max(6, (4 * most_different(2 * size, num, den)).bit_length())


def parity_sketch(shingles: np.ndarray, bits: int) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of shingles has it."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer bits."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def can_be_similar(a: bytes, b: bytes, sizes: int, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= most_different(sizes, num, den)


MARKED = "doc_id long, hi long, lo long, n long, sketch binary, signatures array<long>"


def _marked(size: int, num: int, den: int):
    """Rows (doc_id, text) to those of MARKED. hi and lo are a 128-bit digest of the document's words in order."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, digests, ns, sketches, lists = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        arrays = [pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(lists)))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "hi", "lo", "n", "sketch", "signatures"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            rows, total = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                words = words_of(text)
                n = len(shingles_of(words, size))
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if n and doc is not None:
                    hashes = shingle_hashes(words, size, known)
                    rows.append((doc, digest, n, parity_sketch(hashes, sketch_bits(n, num, den)), signatures(hashes, n, num, den)))
                else:
                    rows.append((doc, digest, n, b"", none))
                total += len(rows[-1][-1])
                if total > HELD_SIGNATURES:
                    yield out(rows)
                    rows, total = [], 0
            if rows:
                yield out(rows)

    return made


def _possible(num: int, den: int):
    """Pairs (a, b, na, nb, sketches) to the pairs (a, b) that their sketches do not rule out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep = [can_be_similar(a, b, n, num, den) for a, b, n in zip(binary_values(batch.column(4)), binary_values(batch.column(5)), sizes, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return made


def _verified(size: int, num: int, den: int):
    """Pairs with both texts to those pairs whose similarity is at least num/den, counted on the shingles' words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, set] = {}

        def of(text: bytes) -> set:
            if text not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                kept[text] = shingles_of(words_of(text), size)
            return kept[text]

        for batch in batches:
            good = []
            for left, right in zip(binary_values(batch.column(2)), binary_values(batch.column(3)), strict=True):
                a, b = of(left), of(right)
                both = len(a & b)
                good.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return made


def _near(n: np.ndarray, done: np.ndarray, sketches: list[bytes], own: np.ndarray, apart: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each own set of a block those as large or larger that sizes and sketches allow to be similar.

    Sets with equal `done` are connected already. `apart` is the block that a set is of, -1 where sets of one block are
    compared.
    """
    words = np.array([len(x) // 8 for x in sketches])
    by_words = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    tables = {(w, w): np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), w) for w, at in by_words.items()}
    for i in np.flatnonzero(own).tolist():
        mine = tables[words[i], words[i]][np.searchsorted(by_words[words[i]], i)]
        for w, at in by_words.items():
            if w < words[i]:
                continue
            fit = (n[at] * num <= n[i] * den) & (done[at] != done[i]) & ((n[at] > n[i]) | ((n[at] == n[i]) & (at > i))) & ((apart[at] < 0) | (apart[at] != apart[i]))
            if fit.any():
                if (w, words[i]) not in tables:
                    tables[w, words[i]] = folded(tables[w, w], words[i])
                differ = np.bitwise_count(tables[w, words[i]][fit] ^ mine).sum(axis=1)
                found = at[fit][differ <= (den - num) * (n[at[fit]] + n[i]) // (den + num)]
                if len(found):
                    yield i, found


def _blocks_of(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each pair of blocks of a task, and of each row its block where two are compared, else -1."""
    keys = [group[c].to_numpy() for c in ("sig", "cls", "low", "high")]
    order = np.lexsort(keys)
    new = np.any([np.diff(k[order], prepend=k[order][:1] - 1) != 0 for k in keys], axis=0) if len(order) else np.zeros(0, bool)
    part, low, high = (group[c].to_numpy() for c in ("part", "low", "high"))
    for at in np.split(order, np.flatnonzero(new)[1:]):
        if len(at) > 1:
            yield at, np.where(low[at] == high[at], -1, part[at])


class Roots(dict):
    """Least members of groups that are united pair by pair; a key alone is its own group."""

    def top(self, x: int) -> int:
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        """False where they are in one group already."""
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _alive_in_blocks(num: int, den: int):
    """Sets in blocks to rows (a, b) that connect each set to those that may be similar to it, though of another component."""

    def made(group: pa.Table) -> pa.Table:
        n, done, own, ids = (group[c].to_numpy() for c in ("n", "component", "own", "id"))
        sketches = list(binary_values(group["sketch"].combine_chunks()))
        roots = Roots()
        for at, apart in _blocks_of(group):
            for i, found in _near(n[at], done[at], [sketches[k] for k in at], own[at], apart, num, den):
                for j in found.tolist():
                    roots.unite(int(ids[at[i]]), int(ids[at[j]]))
        return pa.table({"a": pa.array(list(roots), pa.int64()), "b": pa.array([roots.top(x) for x in list(roots)], pa.int64())})

    return made


def _linked_in_blocks(size: int, num: int, den: int):
    """Sets in blocks to links (a, b) that connect all similar ones; no other pair leaves the task."""

    def made(group: pa.Table) -> pa.Table:
        n, done, own, ids = (group[c].to_numpy() for c in ("n", "component", "own", "id"))
        sketches, texts = (list(binary_values(group[c].combine_chunks())) for c in ("sketch", "text"))
        links, kept = [], {}

        def of(k: int) -> set:
            if texts[k] not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                kept[texts[k]] = shingles_of(words_of(texts[k]), size)
            return kept[texts[k]]

        for at, apart in _blocks_of(group):
            roots = Roots()
            for i, found in _near(n[at], done[at], [sketches[k] for k in at], own[at], apart, num, den):
                for j in found.tolist():
                    x, y = int(done[at[i]]), int(done[at[j]])
                    if roots.top(x) != roots.top(y):
                        a, b = of(at[i]), of(at[j])
                        both = len(a & b)
                        if den * both >= num * (len(a) + len(b) - both):
                            roots.unite(x, y)
                            links.append((ids[at[i]], ids[at[j]]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return made


def _in_blocks(rows: DataFrame, keep: list[str], weight: str, num: int, den: int) -> DataFrame:
    """Rows (sig, id, n, ...) cut into blocks of bounded size, each row once for each pair of blocks that it belongs to.

    A class of sizes is as wide as similar sets can differ, so sets meet those of their own class (own) and the next.
    """
    cls = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * 1.000001 + 1e-12)).cast("long")
    rows = rows.withColumn("of", cls).withColumn("cls", F.explode(F.array("of", F.col("of") - 1))).withColumn("own", F.col("of") == F.col("cls"))
    cuts = rows.groupBy("sig", "cls").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("int").alias("cut"), F.count("*").alias("n_rows"), F.sum(weight).alias("bytes"), F.max("own").alias("any"))
    cuts = staged(cuts.where("any and n_rows > 1").select("sig", "cls", "cut", "n_rows", "bytes"), "cuts")
    n_rows, n_bytes = cuts.agg(*[F.coalesce(F.sum(F.col("cut") * F.col(c)), F.lit(0)) for c in ("n_rows", "bytes")]).first()
    rows = rows.join(cuts.select("sig", "cls", "cut"), ["sig", "cls"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.select("sig", "cls", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "own", *keep)
    tasks = max(1, math.ceil(n_rows / TASK_ROWS), math.ceil(n_bytes / TASK_BYTES))
    return rows.withColumn("task", F.pmod(F.xxhash64("sig", "cls", "low", "high"), F.lit(tasks)).cast("int")).repartition(tasks, "task").groupBy("task")


def similar_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct runs of `size` words (a word is a run of characters other than ASCII white space,
    A-Z lower-cased); with fewer words the whole sequence is one; a null, empty or blank text has none and links with
    nothing. Documents link when den * intersection >= num * union. component_id is the smallest doc_id reachable by
    links, itself included. Documents with equal words are one node, known by a 128-bit digest; all other counts are taken
    on words. Each member of a bucket is first compared with one centre; members that are then connected need no
    comparison. What is still unconnected in a bucket is compared in blocks, so that no link is lost and no group expands
    into rows of pairs. Rows with a null id get a null component and link with nothing;
    repeated rows each give a row; rows of one id with different texts are one document with the links of all of them.
    Extra columns are ignored. An empty table gives an empty result.
    """
    docs = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    spark = docs.sparkSession
    with batches_of(spark, BATCH_TEXTS):
        marked = staged(docs.mapInArrow(_marked(size, num, den), MARKED), "signatures")
    nodes = marked.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"))
    nodes = staged(nodes.where("id is not null"), "nodes")
    copies = staged(marked.where("n > 0").select("doc_id", "hi", "lo").join(nodes, ["hi", "lo"]).where("doc_id <> id").select("doc_id").distinct(), "copies")
    ones = marked.where("n > 0 and doc_id is not null").join(broadcast_within(copies, copies.count(), BROADCAST_IDS), "doc_id", "left_anti").withColumnRenamed("doc_id", "id")
    met = ones.select("id", F.explode("signatures").alias("sig"))
    shared = staged(met.groupBy("sig").agg(F.count("*").alias("times")).where("times > 1").select("sig"), "shared")
    members = staged(met.join(shared, "sig"), "members")
    discard(shared)
    # Buckets with the same members, told by 128 bits, are one; those of a set's copies with few changes mostly are.
    prints = members.groupBy("sig").agg(F.min("id").alias("centre"), F.count("*").alias("times"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = prints.groupBy("centre", "times", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "centre", "weight")
    buckets = staged(members.join(kept, "sig").distinct(), "buckets")
    discard(members)
    sketches = ones.select("id", "n", "sketch")

    def fetched(ids: DataFrame) -> DataFrame:
        """The texts of the given documents, one row for each text."""
        ids = staged(ids.distinct(), "asked")
        found = docs.withColumnRenamed("doc_id", "id").join(broadcast_within(ids, ids.count(), BROADCAST_IDS), "id", "left_semi")
        out = staged(found, "texts")
        discard(ids)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of ids."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        with_sketches = pairs.join(sketches.toDF("a", "na", "left"), "a").join(sketches.toDF("b", "nb", "right"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        possible = staged(with_sketches.select("a", "b", "na", "nb", "left", "right").mapInArrow(_possible(num, den), "a long, b long"), "possible")
        texts = fetched(possible.select(F.explode(F.array("a", "b")).alias("id")))
        with_texts = possible.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
        with batches_of(spark, BATCH_TEXTS):
            out = staged(with_texts.select("a", "b", "left", "right").mapInArrow(_verified(size, num, den), "a long, b long"), "links")
        discard(possible, texts)
        return out

    def linked_in_buckets(open_members: DataFrame) -> DataFrame:
        """All links that connect members (sig, id, component) of open buckets.

        Sketches tell which sets may be similar to one of another component in their bucket. What that connects is a family;
        the texts of families are brought together once, in blocks where there are many.
        """
        rows = staged(open_members.join(sketches, "id").withColumn("weight", F.length("sketch").cast("long")), "open-sets")
        alive = _in_blocks(rows, ["id", "component", "n", "sketch"], "weight", num, den).applyInArrow(_alive_in_blocks(num, den), "a long, b long")
        families = staged(components(staged(alive.distinct(), "alive")), "families").withColumnRenamed("component", "sig")
        texts = fetched(families.select("id"))
        few = rows.drop("sig").join(families, "id").dropDuplicates(["id", "n", "sketch"]).join(texts, "id").withColumn("weight", F.octet_length("text").cast("long"))
        few = staged(few, "alive-sets")
        out = staged(_in_blocks(few, ["id", "component", "n", "sketch", "text"], "weight", num, den).applyInArrow(_linked_in_blocks(size, num, den), "a long, b long"), "links")
        discard(rows, families, texts, few)
        return out

    links, groups, open_members = None, None, buckets
    for step in range(STAR_ROUNDS + 1):
        if step == 0:
            votes = buckets.where("id <> centre").groupBy("id", "centre").agg(F.sum("weight").alias("votes"))
            found = linked(votes.groupBy("id").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("b")).withColumnRenamed("id", "a"))
            rest = buckets.select("sig", "id")
        elif step < STAR_ROUNDS:
            centre = open_members.groupBy("sig").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(step))).alias("c"))
            compared = staged(open_members.join(centre, "sig").select("sig", "id", "component", F.col("c.id").alias("b"), F.col("c.component").alias("of")), "compared")
            found = linked(compared.where("component <> of").select(F.col("id").alias("a"), "b"))
            discard(open_members)
            open_members = compared
            rest = compared.where("id <> b").select("sig", "id")  # a centre has been compared with all of its bucket
        else:
            found = linked_in_buckets(open_members)
        links = found if links is None else links.union(found)
        if groups is not None:
            discard(groups)
        groups = staged(components(links), "groups")
        if step < STAR_ROUNDS:
            now = rest.join(groups, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
            several = now.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
            still = staged(now.join(several, "sig", "left_semi"), "open")
            discard(open_members)
            open_members = still
            if open_members.isEmpty():
                break
    discard(open_members, links)
    least = nodes.join(groups, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("least"))
    out = marked.select("doc_id", "hi", "lo", "n").join(least, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that are the smallest of their group, with their columns; the pipeline's stage.

    Rows with a null doc_id stay. Of repeated rows with one doc_id all stay, as they name the same document.
    """
    groups = similar_groups(docs, size, num, den)
    gone = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_within(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
