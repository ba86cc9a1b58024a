"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding by joining binary pieces.

A text is split by the tokenizer's pattern. A word's bytes are pieces, each with its id; a fold of higher-order functions
merges the neighbouring pieces of least rank, as a literal rank map of piece pairs has it, until no merge is left. The fold
runs once for each of the most frequent words of the corpus, whose ids form a dictionary of bounded size. Words that it lacks
get the same merges in the task that meets them, once for each distinct word of a chunk of texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import batches_of, columns, staged

#: Most words of the dictionary.
DICTIONARY = 1 << 18
#: Buckets of the literal rank map, a prime number.
BUCKETS = 65_537
#: Rank of a pair that does not merge.
NEVER = 2**31 - 1
#: Words of so many characters go to a heap of merges instead of a scan for each merge. The ids are the same.
LONG = 256
#: Words of texts that are looked up together, but for a text that has more.
CHUNK_WORDS = 1 << 18
#: Texts that are passed to Python together.
BATCH_TEXTS = 500


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """Each pair of ids that merges, as one number, with its rank, which also is the id of the merged piece."""
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                yield left * (len(ranks) + 1) + right, rank


def java_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode has it."""
    return f"(?U){pattern}"


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def byte_array(word: Column) -> Column:
    """The UTF-8 bytes of a word as an array of int."""
    return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), F.ascii)


class Coder:
    """A byte-level vocabulary as Spark expressions."""

    def __init__(self, ranks_path: str) -> None:
        ranks = read_ranks(ranks_path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks have gaps")
        self.edge = len(ranks)  # stands before and after a word's pieces and merges with nothing
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.ranks_path = ranks_path
        pairs: list[list[int]] = [[] for _ in range(BUCKETS)]
        merged: list[list[int]] = [[] for _ in range(BUCKETS)]
        for pair, rank in merges(ranks):
            pairs[pair % BUCKETS].append(pair)
            merged[pair % BUCKETS].append(rank)

        def literal(value: list, kind: str) -> Column:
            return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)

        self.literals = F.struct(literal(pairs, "array<array<bigint>>").alias("pairs"), literal(merged, "array<array<int>>").alias("merged"), literal(self.bytes, "array<int>").alias("bytes"))

    @property
    def pairs(self) -> dict[int, int]:
        return dict(merges(read_ranks(self.ranks_path)))

    def fold(self, byte_arrays: Column) -> Column:
        """Ids of each byte array of an array: what is left of its bytes after all merges."""

        def with_map(t: Column) -> Column:
            return F.transform(byte_arrays, lambda b: self._fold(b, t))

        return F.get(F.transform(F.array(self.literals), with_map), F.lit(0))

    def _fold(self, b: Column, t: Column) -> Column:
        edge = F.array(F.lit(self.edge))

        def rank(left: Column, right: Column) -> Column:
            """Rank of a pair, which also is the id of the merged piece."""
            pair = left.cast("long") * (self.edge + 1) + right
            bucket = (pair % BUCKETS).cast("int")
            return F.coalesce(F.get(F.get(t["merged"], bucket), (F.array_position(F.get(t["pairs"], bucket), pair) - 1).cast("int")), F.lit(NEVER))

        def start(p: Column) -> Column:
            ranks = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), rank)
            return F.struct(p.alias("p"), ranks.alias("r"))

        def step(state: Column, _: Column) -> Column:
            p, r = state["p"], state["r"]

            def merge(x: Column) -> Column:
                new, i = x["m"], x["i"]  # i counts from 1 and never is 1, where the edge is
                pieces = F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p)))
                ranks = F.concat(F.slice(r, F.lit(1), i - 2), F.array(rank(F.get(p, i - 2), new), rank(new, F.get(p, i + 1))), F.slice(r, i + 2, F.size(r)))
                return F.struct(pieces.alias("p"), ranks.alias("r"))

            def at(m: Column) -> Column:
                place = F.struct(m.alias("m"), F.array_position(r, m).cast("int").alias("i"))
                return F.when(m < NEVER, F.get(F.transform(F.array(place), merge), F.lit(0))).otherwise(state)

            return F.get(F.transform(F.array(F.array_min(r)), at), F.lit(0))

        def folded(p: Column) -> Column:
            inner = F.aggregate(F.sequence(F.lit(4), F.size(p)), start(p), step, lambda s: F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2))
            return F.when(F.size(p) > 3, inner).otherwise(F.slice(p, F.lit(2), F.size(p) - 2))

        pieces = F.concat(edge, F.transform(b, lambda x: F.get(t["bytes"], x)), edge)
        return F.get(F.transform(F.array(pieces), folded), F.lit(0))


@dataclass
class Known:
    """Ids of known words: the vocabulary's own pieces, each its rank, and the most frequent words, folded."""

    index: dict[str, int]
    first: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    pairs: dict[int, int]
    bytes: list[int]
    edge: int


def frequent_words(docs: DataFrame, pattern: str, most: int = DICTIONARY) -> DataFrame:
    """The most frequent words of all texts, at most `most`: all words that occur at least a certain number of times.

    The number is found from a histogram of the counts with eight steps to each doubling, so no task sees all words.
    """
    counts = docs.select(F.explode(words(F.col("text"), pattern)).alias("word")).groupBy("word").count()
    level = F.floor(F.log2("count") * 8).cast("int")
    counts = staged(counts.where(F.length("word") < LONG).select("word", level.alias("level")), "word-counts")
    histogram = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}  # at most 512 rows
    least, total = 512, 0
    for at in sorted(histogram, reverse=True):
        total += histogram[at]
        if total > most:
            break
        least = at
    return counts.where(F.col("level") >= least).select("word")


def known_words(docs: DataFrame, coder: Coder, pattern: str) -> bytes:
    """The most frequent words and their ids, folded, as an Arrow stream; the driver holds no more than that."""
    frequent = frequent_words(docs, pattern)
    got = frequent.select("word", F.get(coder.fold(F.array(byte_array(F.col("word")))), F.lit(0)).alias("ids")).toArrow()  # DICTIONARY rows at most
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as out:
        out.write_table(got)
    return sink.getvalue().to_pybytes()


@lru_cache(maxsize=1)
def known_of(stream: bytes, ranks_path: str) -> Known:
    """What a task looks words up in; a Python worker makes it once."""
    got = pa.ipc.open_stream(stream).read_all()
    lists = got["ids"].combine_chunks()
    ids, size = [lists.flatten().to_numpy()], [lists.value_lengths().to_numpy()]
    index = {w: i for i, w in enumerate(got["word"].to_pylist())}
    ranks, whole = read_ranks(ranks_path), {}
    for piece, rank in ranks.items():
        try:
            whole[piece.decode()] = rank
        except UnicodeDecodeError:
            continue
    index |= {w: len(lists) + i for i, w in enumerate(whole)}  # a word that is a piece has that piece's id, whatever merges give
    size = np.concatenate([*size, np.ones(len(whole), np.int32)]).astype(np.int64)
    ids = np.concatenate([*ids, np.array(list(whole.values()))]).astype(np.int32)
    return Known(index, np.cumsum(size) - size, size, ids, dict(merges(ranks)), [ranks[bytes([b])] for b in range(256)], len(ranks))


def merge(word: bytes, known: Known) -> list[int]:
    """The fold for one word: the leftmost pair of least rank is merged until no pair merges."""
    pairs, base = known.pairs, known.edge + 1
    p = [known.bytes[b] for b in word]
    r = [pairs.get(x * base + y, NEVER) for x, y in zip(p, p[1:], strict=False)]
    while r and (m := min(r)) < NEVER:
        i = r.index(m)
        p[i : i + 2] = [m]
        del r[i]
        if i:
            r[i - 1] = pairs.get(p[i - 1] * base + m, NEVER)
        if i < len(r):
            r[i] = pairs.get(m * base + p[i + 1], NEVER)
    return p


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges as the fold, in the same order, by a heap over linked pieces."""
    if word in ranks:
        return [ranks[word]]
    piece, after, before = [word[i : i + 1] for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, piece[i] + piece[i + 1]) for i in range(len(word) - 1) if (r := ranks.get(piece[i] + piece[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if piece[i] is None or j >= len(word) or piece[j] is None or piece[i] + piece[j] != both:
            continue
        piece[i], piece[j], after[i] = both, None, after[j]
        if after[j] < len(word):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < len(word) and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, piece[a] + piece[b]))
    return [ranks[p] for p in piece if p is not None]


def gathered(first: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs values[first : first + size], one after another."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]


def _encoded(known: Broadcast, ranks_path: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """Rows (doc_id, words) to rows (doc_id, ids), in chunks, and `finish` of those."""

    def ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = known_of(known.value, ranks_path)
        ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
        coded = batch.column(1).flatten().dictionary_encode()
        new: list[list[int]] = []
        places = np.empty(len(coded.dictionary), np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            place = k.index.get(word)
            if place is None:
                place = len(k.size) + len(new)
                new.append(merge(word.encode(), k) if len(word) < LONG else merge_long(word.encode(), read_ranks(ranks_path)))
            places[i] = place
        size = np.concatenate([k.size, np.array([len(x) for x in new], np.int64)])
        first = np.concatenate([k.first, len(k.ids) + np.cumsum(size[len(k.size) :]) - size[len(k.size) :]])
        at = places[coded.indices.to_numpy()]
        out = gathered(first[at], size[at], np.concatenate([k.ids, np.array([i for x in new for i in x], np.int32)]))
        ends = np.concatenate([[0], np.cumsum(size[at])])[ends]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))], ["doc_id", "ids"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy()
            at = 0
            while at < len(counts):
                n = max(1, int(np.searchsorted(np.cumsum(counts[at:]), CHUNK_WORDS, "right")))
                yield finish(ids_of(batch.slice(at, n)))
                at += n

    return made


def _encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> tuple[DataFrame, Broadcast]:
    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    known = docs.sparkSession.sparkContext.broadcast(known_words(rows, Coder(ranks_path), pattern))
    return rows.select("doc_id", words(F.col("text"), pattern).alias("words")).mapInArrow(_encoded(known, ranks_path, finish), schema), known


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int), without special tokens.

    A null or empty text has no ids. Null ids are kept; repeated rows each give a row. Extra columns are ignored; an empty
    table gives an empty result. Every text is encoded whole.
    """
    return _encode(docs, ranks_path, pattern, id_col, text_col, lambda batch: batch, "doc_id long, ids array<int>")[0]


@lru_cache(maxsize=2)
def _pieces(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id the place and length of its piece in the bytes of all pieces."""
    ranks = read_ranks(ranks_path)
    pieces = sorted(ranks, key=ranks.get)
    size = np.array([len(p) for p in pieces], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(pieces), np.uint8)


def decoded(ids: np.ndarray, ranks_path: str) -> bytes:
    """The bytes that ids stand for: their pieces one after another."""
    first, size, pieces = _pieces(ranks_path)
    return gathered(first[ids], size[ids], pieces).tobytes()


def _id_lists(column: pa.Array) -> Iterator[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    flat = column.flatten().to_numpy()
    yield from (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Rows (doc_id, ids) to (doc_id, decoded), decoded being binary; no ids give no bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded(x, ranks_path) for x in _id_lists(batch.column(1))], pa.binary())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(made, "doc_id long, decoded binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and, of the decoded ids, decoded_sha256."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, little, back = [], [], []
        for ids in _id_lists(batch.column(1)):
            n.append(len(ids))
            little.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(decoded(ids, ranks_path)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(little, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, known = _encode(docs, ranks_path, pattern, "doc_id", "text", digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        out = staged(rows, "bpe-digest")
    known.destroy()
    return out
