"""Token ids in a grammar-compressed binary format with random access (Re-Pair).

Documents are range-partitioned by id, tokenised and packed into blocks. In a block, frequent pairs of neighbouring ids
are replaced by nonterminals, round after round; pairs never cross the end of a document. A block is one row of a Parquet
table: its documents with their id counts and symbol counts, the symbols, the rules (two symbols each) and each rule's
expansion length. The table is written by Spark to any store that it knows, so a lost executor costs one task.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import batches_of, columns, shared_dir

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 19
#: Uses that a rule needs. Pairs are replaced until none is used so often.
USES = 4
#: Words whose ids a worker keeps; beyond, it starts anew.
KEPT_WORDS = 400_000
#: Whole texts that a task is handed at once.
BATCH_TEXTS = 512
#: Bytes of texts that are looked up together, but for a text that has more.
CHUNK_BYTES = 1 << 22
#: Bits of the table by which selected pairs are found.
PAIR_BITS = 18
#: Pairs up to which they are sorted and searched instead.
FEW = 20_000
BLOCK_SCHEMA = "part int, block int, ids_before long, n_ids long, docs array<struct<doc_id:long,n_ids:long,n_symbols:long>>, base int, rules binary, lengths binary, symbols binary"


#: Kinds of the bytes of plain words: letters of ASCII and Latin-1, ASCII marks and ASCII digits. Normalising changes only the
#: case of such words, and the vocabulary's pattern cuts them where the kind changes and around each digit. Words with other
#: bytes, with an apostrophe (contractions) or a bar (special markers) go the whole way through the library.
LETTER, MARK, DIGIT = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0xC0), 0xC3]] = LETTER
KINDS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")] = MARK
KINDS[list(b"0123456789")] = DIGIT
#: Lower case by bytes: A-Z, and the second bytes of capital Latin-1 letters in UTF-8.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*range(65, 91), *range(0x80, 0x9F)]] += 32
#: The last byte of a piece is written as a letter of its own, from here on; it stands for the letter with the model's suffix.
LAST = 0xE000
#: Words whose pieces the model is asked for at once, and the bytes from which on a word is not plain.
TOGETHER, LONG = 128, 100


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*shown}))}


class WordTokens:
    """A tokenizers vocabulary applied to texts; ids of blank-separated words are kept, as no token spans a blank."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        spec = json.loads(self.tokenizer.to_str())
        kinds, suffix = [x["type"] for x in spec["normalizer"]["normalizers"]], spec["model"]["end_of_word_suffix"]
        markers = all("|" in x["content"] for x in spec["added_tokens"])
        self.asks_model = kinds == ["NFC", "Replace", "Lowercase"] and bool(suffix) and markers
        if self.asks_model:
            self._join(spec["model"], suffix)
        self._forget()

    def _join(self, spec: dict, suffix: str) -> None:
        """The library's model over the same vocabulary and merges, in which the last letter of a piece with the suffix is one
        letter. No merge has such a letter on its left, so that pieces written one after another stay apart."""
        from tokenizers.models import BPE

        letters = byte_letters()
        number = {letter: byte for byte, letter in letters.items()}

        def renamed(token: str) -> str:
            return f"{token[: -len(suffix) - 1]}{chr(LAST + number[token[-len(suffix) - 1]])}" if token.endswith(suffix) else token

        merges = [(renamed(a), renamed(b)) for a, b in spec["merges"]]
        self.model = BPE(vocab={renamed(t): i for t, i in spec["vocab"].items()}, merges=merges, cache_capacity=0)
        self.letters = np.array([ord(letters[b]) for b in range(256)], np.uint16)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in spec["vocab"].items() if t.endswith(suffix)]] = True

    def _forget(self) -> None:
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are plain, the ids of those one after another, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        size, n = np.diff(offsets), int(offsets[-1] - offsets[0])
        if not self.asks_model or not n:
            return np.zeros(len(words), bool), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        kind, before = KINDS[data], np.concatenate([data[:1] * 0, data[:-1]])
        wrong = (kind == 0) | ((data >= 0x80) & (data < 0xC0) & ((before != 0xC3) | (data == 0x97) | (data == 0xB7)))
        begins = (kind == DIGIT) | np.concatenate([[True], kind[1:] != kind[:-1]])
        begins[offsets[:-1][size > 0]] = True
        wrongs, pieces = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (wrong, begins))
        plain = (wrongs == 0) & (size > 0) & (size < LONG)
        low = LOWER[data]
        letters = np.where(np.concatenate([begins[1:], [True]]), low + np.uint16(LAST), self.letters[low])[np.repeat(plain, size)]
        text, cuts = letters.astype("<u2").tobytes().decode("utf-16-le"), np.concatenate([[0], np.cumsum(size[plain])])[::TOGETHER].tolist()
        found = array("I")
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
            found.extend([t.id for t in self.model.tokenize(text[a:b])])
        ids = np.frombuffer(found, np.uint32)
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(pieces[plain]) - 1] + 1
        return plain, ids, np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Keep the ids of new words; returns the place of each among the kept ones."""
        plain, ids, sizes = self._plain(words)
        rest = words.filter(pa.array(~plain))
        found, counts = [ids], []
        for at in range(0, len(rest), 5000):
            some = self.tokenizer.encode_batch(rest[at : at + 5000].to_pylist(), add_special_tokens=False)
            found += [np.array(x.ids, np.uint32) for x in some]
            counts += [len(x.ids) for x in some]
        place = np.where(plain, np.cumsum(plain) - 1, len(sizes) + np.cumsum(~plain) - 1) + len(self.words)
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(plain)), rest])
        self.flat = np.concatenate([self.flat, *found])
        self.sizes = np.concatenate([self.sizes, sizes, np.array(counts, np.int64)])
        return place

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. A null text has none."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.string())
        known = pc.index_in(words, value_set=self.words)
        if known.null_count and len(self.words) + known.null_count > KEPT_WORDS:
            self._forget()
            known = pa.nulls(len(known), pa.int32())
        place = pc.fill_null(known, -1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(words.take(pa.array(new)))
        at = place[coded.indices.to_numpy()]
        each, start = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(start - ends[:-1], each)
        where += np.arange(ends[-1])
        ids = self.flat[where]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])])

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of(pa.array([text]))[0]


@lru_cache(maxsize=2)
def tokens_of(path: str) -> WordTokens:
    return WordTokens(path)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _frequent(pairs: np.ndarray, uses: int) -> np.ndarray:
    """The different pairs that occur `uses` times or more, the most frequent first."""
    values, counts = np.unique(pairs, return_counts=True)
    often = np.flatnonzero(counts >= uses)
    return values[often[np.lexsort((values[often], -counts[often]))]]


def _hits(pairs: np.ndarray, slots: np.ndarray | None, places: np.ndarray, after: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places with their pairs those at which chosen pairs are replaced, none overlapping another, which of them each
    is, and all places of chosen pairs. Of pairs that share a slot of the table the first is taken; the others come in a
    later round."""
    if slots is not None:
        table = np.full(1 << PAIR_BITS, -1, np.int32)
        table[_slot(chosen[::-1])] = np.arange(len(chosen))[::-1]
        rule = table[slots]
        hit = np.flatnonzero((chosen[rule] == pairs) & (rule >= 0))
    else:
        order = np.argsort(chosen)
        rule = order[np.searchsorted(chosen[order], pairs).clip(max=len(chosen) - 1)]
        hit = np.flatnonzero(chosen[rule] == pairs)
    at = places[hit]
    run = np.concatenate([[True], after[at[:-1]] != at[1:]])  # in a run of overlapping hits every second one is replaced
    if run.all():
        return at, rule[hit], at
    number = np.arange(len(at), dtype=np.int32)
    even = np.flatnonzero(((number - np.maximum.accumulate(np.where(run, number, np.int32(0)))) & 1) == 0)
    return at[even], rule[hit[even]], at


def compress(ids: np.ndarray, ends: np.ndarray, base: int, uses: int = USES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules, expansion lengths and the documents' ends in symbols. ends: the documents' ends in ids.

    Rounds go on until no pair can be replaced `uses` times. Symbols stay where they are, linked to the next and the one
    before, so that a round looks only at the pairs around the symbols of the round before, and at the frequent pairs that
    it left. When those give no rule, all pairs are counted once more. When the pairs of a round stand in each other's way,
    the better half of them goes first.
    """
    n = len(ids)
    symbols, last, there = ids.astype(np.uint32), np.zeros(n, bool), np.ones(n, bool)
    last[ends[ends > 0] - 1] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    made, lengths = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)]
    known, fresh = np.ones(base, np.uint32), None
    while True:
        if fresh is None:
            places = np.flatnonzero(there)  # each is followed by the next one
            here, inner = symbols[places].astype(np.uint64), ~last[places[:-1]]
            places, pairs = places[:-1][inner], ((here[:-1] << np.uint64(32)) | here[1:])[inner]
        else:
            places = np.concatenate([fresh, before[fresh], left[there[left]]])
            places = np.sort(places[places >= 0], kind="stable")
            places = places[np.concatenate([[True], places[1:] != places[:-1]]) & ~last[places]] if len(places) else places
            pairs = (symbols[places].astype(np.uint64) << np.uint64(32)) | symbols[after[places]]
        slots = None
        if len(pairs) > FEW:  # only pairs in slots with so many pairs are looked at
            slots = _slot(pairs)
            some = np.flatnonzero((np.bincount(slots, minlength=1 << PAIR_BITS) >= uses)[slots])
            pairs, slots, places = pairs[some], slots[some], places[some]
        chosen = _frequent(pairs, uses)
        at, often = np.zeros(0, np.int64), None
        while len(chosen):
            at, rule, held = _hits(pairs, slots, places, after, chosen)
            often = held if often is None else often
            used = np.bincount(rule, minlength=len(chosen))
            at, rule = at[used[rule] >= uses], rule[used[rule] >= uses]
            if len(at):
                break
            chosen = chosen[: len(chosen) // 2]
        if not len(at):
            if fresh is None:
                break
            fresh = None
            continue
        taken = chosen[used >= uses]
        number = np.cumsum(used >= uses) - 1 + len(known)
        made.append(np.stack([taken >> np.uint64(32), taken & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        lengths.append(known[made[-1]].sum(axis=1, dtype=np.uint32))
        known = np.concatenate([known, lengths[-1]])
        gone = after[at]
        symbols[at], last[at], there[gone] = number[rule], last[gone], False
        after[at] = after[gone]
        before[after[at]] = at
        fresh, left = at, often
    symbols, last = symbols[there], last[there]
    out = np.zeros(len(ends), np.int64)
    out[np.diff(ends, prepend=0) > 0] = np.flatnonzero(last) + 1
    return symbols, np.concatenate(made), np.concatenate(lengths), np.maximum.accumulate(out) if len(out) else out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for. The rules are written out once, those of lesser depth first, and then copied."""
    depth = np.zeros(base + len(rules), np.int32)
    while True:
        new = 1 + depth[rules].max(axis=1, initial=0)
        if (new == depth[base:]).all():
            break
        depth[base:] = new
    size = np.ones(base + len(rules), np.int64)
    start = np.zeros(base + len(rules), np.int64)
    by_depth = np.argsort(depth[base:], kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[base:][by_depth])) + 1) if len(rules) else []
    for level in levels:
        size[base + level] = size[rules[level]].sum(axis=1)
    start[base + by_depth] = np.cumsum(size[base + by_depth]) - size[base + by_depth]
    text = np.empty(int(size[base:].sum()), np.uint32)

    def copied(of: np.ndarray, out: np.ndarray, to: np.ndarray) -> None:
        """Write the symbols `of` to `out`, each from its place in `to` on."""
        plain = of < base
        out[to[plain]] = of[plain]
        of, to = of[~plain], to[~plain]
        n = size[of]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = text[np.repeat(start[of], n) + step]

    for level in levels:
        left, right = rules[level].T
        to = start[base + level]
        copied(left, text, to)
        copied(right, text, to + size[left])
    sizes = size[symbols]
    out = np.empty(int(sizes.sum()), np.uint32)
    copied(symbols, out, np.cumsum(sizes) - sizes)
    return out


def ids_between(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block; by the expansion lengths only the symbols that cover them are expanded."""
    size = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    after = np.cumsum(size)
    a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
    offset = int(after[a - 1]) if a else 0
    return expand(symbols[a:b], rules, base)[start - offset : stop - offset]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of CHUNK_BYTES of text about: small batches are put together, large ones are cut."""
    waiting, held = [], 0
    for batch in batches:
        bytes_before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        for part_of in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(bytes_before // CHUNK_BYTES)) + 1):
            if not len(part_of):
                continue
            waiting.append(batch.slice(part_of[0], len(part_of)))
            held += int(bytes_before[part_of[-1]] - (bytes_before[part_of[0] - 1] if part_of[0] else 0))
            if held >= CHUNK_BYTES:
                yield pa.concat_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _blocks(tokenizer: str, end_id: int, block_ids: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, block, before = tokens_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, docs, size = [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            symbols, rules, lengths, cut = compress(np.concatenate(ids), ends, max(tokens.size, end_id + 1))
            rows = [{"doc_id": d, "n_ids": len(x), "n_symbols": int(n)} for d, x, n in zip(docs, ids, np.diff(cut, prepend=0), strict=True)]
            row = {"part": part, "block": block, "ids_before": before, "n_ids": size, "docs": rows, "base": max(tokens.size, end_id + 1), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_symbols", pa.int64())]))), ("base", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())]))

        for some in _chunks(batches):
            flat, counts = tokens.ids_of(some.column(1))
            ends = np.cumsum(counts)
            for doc, a, b in zip(some.column(0).to_pylist(), ends - counts, ends, strict=True):
                docs.append(doc)
                ids.append(np.append(flat[a:b], np.uint32(end_id)))
                size += len(ids[-1])
                if size >= block_ids:
                    yield out()
                    before, block = before + size, block + 1
                    ids, docs, size = [], [], 0
        if docs:
            yield out()

    return made


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise the documents, end each with `end_id`, and write them to `path` as blocks in ascending doc_id order.

    A null text has only the end id; null ids come first; repeated ids are ordered by text. Extra columns are ignored; an
    empty table writes a table without rows. A text is tokenised whole; a block holds at least one document.
    """
    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        ordered.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the number of ids in all blocks before; one row a part is summed up over all parts."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    first = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", first.alias("first"))
    return blocks.join(F.broadcast(parts), "part").select("*", (F.col("first") + F.col("ids_before")).alias("start")).drop("first")


DOCUMENTS = "doc_id long, start long, ids array<int>"


def read_documents(spark: SparkSession, path: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = DOCUMENTS) -> DataFrame:
    """Rows (doc_id, start, ids) decoded from the files at `path`; or what `then` makes of them, a block at a time, in the
    task that decodes them, so that ids need not leave it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"], "<u4"), rules, row["base"])
                n = np.array([d["n_ids"] for d in row["docs"]])
                ends = np.cumsum(n)
                decoded = pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array(row["start"] + ends - n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32), pa.int32()))], ["doc_id", "start", "ids"])
                yield then(decoded) if then else decoded

    return read_token_blocks(spark, path).mapInArrow(made, schema)


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Random access: the ids numbered start to stop over the whole corpus, as rows (start, ids), one a block that has some."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(start, row["start"]), min(stop, row["start"] + row["n_ids"])
                symbols, rules, lengths = (np.frombuffer(row[k], "<u4") for k in ("symbols", "rules", "lengths"))
                ids = ids_between(symbols, rules.reshape(-1, 2), lengths, row["base"], a - row["start"], b - row["start"])
                yield pa.RecordBatch.from_pydict({"start": pa.array([a], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    blocks = read_token_blocks(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return blocks.mapInArrow(made, "start long, ids array<int>")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents to the shared folder, read the files back, and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer, end_id)

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        data, cuts = lists.flatten().to_numpy().astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_documents(spark, path, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
