"""The training-data operators against brute force, exact round trips and held-out rows, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import byte_bpe, chat_formatting, decontamination, embedding_near_dedup, language_id, license_scan, ngram_jaccard_join, pii, sharding, token_output
from siftwell.llm.common import components

DATA = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_links string, label int, _k string"
ODD = [(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (3, " \n ", "x", 1, "y"), (4, "short", "x", 1, "y"), (4, "short", "x", 1, "y"), (None, "no id here at all", "x", 1, "y"), (6, "word " * 30_000, "x", 1, "y"), (7, "z" * 3000, "x", 1, "y"), (8, "ünï \U0001f600 <|endoftext|> it's x", "x", 1, "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (8, 10)]
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8}


@pytest.mark.parametrize("task_edges", [100_000, 0])
def test_components_of_few_edges_take_few_tasks(spark, monkeypatch, task_edges):
    """Rounds over a handful of edges gave the driver a task for each shuffle partition, half after half."""
    monkeypatch.setattr("siftwell.llm.common.TASK_EDGES", task_edges)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(100, i) for i in range(101, 140)], "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup(group := f"components-{task_edges}", "")
    try:
        got = {r.id: r.component for r in components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert task_edges == 0 or tasks < 150



# 1: byte-level BPE


def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(spark, docs, odd):
    both = docs.select("doc_id", "text").limit(60).union(odd.select("doc_id", "text"))
    want = collections.Counter((r.doc_id, tuple(encoding().encode_ordinary(r.text or ""))) for r in both.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(both, RANKS, PATTERN).collect()) == want


def test_bpe_round_trip(odd):
    got = collections.Counter(r.decoded_sha256 for r in byte_bpe.bpe_digest(odd, RANKS, PATTERN).collect())
    assert got == collections.Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ODD)


def test_bpe_empty(spark):
    assert byte_bpe.bpe_digest(spark.createDataFrame([], DOCS), RANKS, PATTERN).collect() == []


def test_long_merge():
    ranks = byte_bpe.read_ranks(RANKS)
    for word in ("abab" * 50, "aaaaaaa", "the", "ünïcödé"):
        assert byte_bpe.merge_long(word.encode(), ranks) == encoding().encode_ordinary(word) or len(regex.findall(PATTERN, word)) > 1


def test_fold_merges_and_decoding_agree(spark):
    words = ["abab" * 9, "aaaaaaa", "zzq", "ünïcödé", " the", "日本語", "x"]
    coder = byte_bpe.Coder(RANKS)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in df.select("word", F.get(coder.fold(F.array(byte_bpe.byte_array(F.col("word")))), F.lit(0)).alias("ids")).collect()}
    known = byte_bpe.Known({}, None, None, None, coder.pairs, coder.bytes, coder.edge)
    assert all(byte_bpe.merge(w.encode(), known) == got[w] for w in words)
    rows = spark.createDataFrame([(i, got[w]) for i, w in enumerate(words)] + [(None, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).collect()} == {i: w.encode() for i, w in enumerate(words)} | {None: b""}


# 2: language


def test_language_held_out(docs):
    model = language_id.fit(language_id.labelled_documents(docs.where("doc_id % 2 = 0")))
    got = language_id.identify(language_id.of_documents(docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string"))), model)
    rows = got.join(docs, F.col("key") == F.col("doc_id")).select("language", "lang", "rejected").collect()
    assert np.mean([r.language == r.lang for r in rows]) >= 0.95 and sum(r.rejected for r in rows) == 0


def test_language_evidence(spark, docs):
    model = language_id.fit(language_id.labelled_documents(docs))
    rows = [(i, "x", "de", None, "h1", "d") for i in range(3)] + [(9, None, "de", None, "h1", "d"), (10, "***", None, None, None, None)]
    got = {r.key: r for r in language_id.identify(spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string"), model).collect()}
    assert got[9].rejected and got[9].language == "und" and got[10].rejected and not got[0].rejected
    pages = language_id.identify(language_id.of_pages(spark.read.parquet(f"{DATA}/pages.parquet")), model)
    assert pages.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_unmodelled_languages_are_rejected_at_all_lengths(spark, docs):
    model = language_id.fit(language_id.labelled_documents(docs))
    odd = "съешь же ещё этих мягких французских булок да выпей чаю "
    texts = [odd[:20], odd, odd * 2, odd * 40]
    good = [r.text for r in docs.where("length(text) > 200 and lang is not null").limit(40).collect()]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(texts + [x[:n] for x in good for n in (12, 40, 120, 20_000)])]
    got = {r.key: r.rejected for r in language_id.identify(spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string"), model).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * 4 + [False] * (4 * len(good))


def test_pages_use_all_evidence(spark, docs):
    """Each page's text says nothing; address and markup decide, and the host's other pages where both are missing."""
    text = [r.text for r in docs.where("lang = 'de' and length(text) > 2000").limit(5).collect()]
    rows = [(i, "https://h1.example.com/x", f"<html><body>{t}</body></html>") for i, t in enumerate(text)]
    rows += [(50, "https://h1.example.com/y", "<html><p>x</p></html>"), (51, "https://o.example.org/fr/", "<html lang=fr><p>x</p></html>"), (52, None, None)]
    rows += [(60 + i, f"https://o.example.org/{c}/", f"<html lang={c}>{t}</html>") for i, (c, t) in enumerate((r.lang, r.text) for r in docs.where("length(text) > 500").limit(30).collect())]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[50].language == "de" and got[51].language == "fr" and got[52].rejected and len(got) == len(rows)


def test_language_odd(spark, odd):
    full = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert language_id.identify_documents(full).count() == len(ODD)
    assert language_id.identify_documents(full.limit(0)).collect() == []


def test_any_number_of_languages(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 5} " * 20, f"l{i}", "h", 0) for i in range(70)]
    got = language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k int")).collect()
    assert len(got) == 70 and sum(r.language == f"l{r.doc_id}" for r in got) >= 65


# 3: licences


def test_license_rules(spark):
    mit = "MIT License\n\n" + ". ".join(t for n, t in license_scan.SENTENCES if n in ("mit-grant", "mit-notice", "mit-as-is")) + "."
    rows = [(1, mit), (2, "Foo.\nReleased under the MIT License.\nAll rights reserved. "), (3, "the license"), (4, None), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.rules, r.licenses) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["mit-titled-text"], ["MIT"]), 2: (["mit-short", "all-rights-reserved"], ["MIT", "proprietary"]), 3: ([], []), 4: ([], []), None: (["cc-by-nc-4.0-short"], ["CC-BY-NC-4.0"])}


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_license_texts_as_they_are_wrapped(spark):
    texts = {"gpl-3.0-header": GPL.format(":", ",", 3), "gpl-2.0-header": GPL.format(";", ";", 2), "apache-2.0-header": APACHE, "mit-titled-text": MIT, "bsd-3-clause-text": BSD}
    ways = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "".join(f" * {x}\n" for x in t.split("\n")), lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    rows = [(i, way(t), name) for name, t in texts.items() for i, way in enumerate(ways)]
    got = license_scan.scan_licenses(spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.rules for r in got} == {k: [name] for k, (_, _, name) in enumerate(rows)}
    cut = [(1, "Some words\nAll rights reserved\nmore words"), (2, "all rights\n\nreserved"), (3, "all rights. Reserved"), (4, "ж; " * 20_000 + "\nReleased under the\nMIT License"), (5, "; " * 20_000 + "the\n" * 20_000)]
    got = license_scan.scan_licenses(spark.createDataFrame(cut, "doc_id long, text string")).collect()
    assert {r.doc_id: r.sentence_ids for r in got} == {1: ["reserved"], 2: [], 3: [], 4: ["mit-short"], 5: []}


def test_license_odd(spark, odd):
    assert license_scan.license_digest(odd).count() == len(ODD) and license_scan.license_digest(odd.limit(0)).count() == 0


# 4: embeddings


def vectors(spark, n=300, width=16, seed=0):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, width))
    x[n // 2 :] = x[: n - n // 2] + g.standard_normal((n - n // 2, width)) * g.choice([0.0, 0.05, 0.2], (n - n // 2, 1))
    x[-40:] = x[0] + g.standard_normal((40, width)) * 0.05
    return [(i, [float(np.float32(v)) for v in row], i % 2 if i < n - 40 else 0, "c") for i, row in enumerate(x)]


@pytest.mark.parametrize("block", [8, 1024])
def test_embedding_links(spark, block):
    rows = vectors(spark) + [(900, None, 0, "c"), (901, [0.0] * 16, 0, "c"), (902, [math.nan] + [1.0] * 15, 0, "c"), (903, [None] + [1.0] * 15, 0, "c"), (904, [1.0] * 16, None, "c"), (905, [], 0, "c"), (None, [1.0] * 16, 0, "c")]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in embedding_near_dedup.near_duplicate_embeddings(df, block=block).collect()}
    good = [(i, np.array(e, float), lab) for i, e, lab, _ in rows if i is not None and i < 900]
    x = np.stack([e for _, e, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([z for _, _, z in good])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([root[i], *root[link[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906)) and got[None].n_links == 0


def test_embedding_copies_are_one_node(spark):
    g = np.random.default_rng(3)
    one, far = g.standard_normal(8), g.standard_normal(8)
    near = one + g.standard_normal(8) * 0.01
    rows = [(i, one.tolist(), 1) for i in range(1500)] + [(2000 + i, near.tolist(), 1) for i in range(3)] + [(3000, far.tolist(), 1), (3001, one.tolist(), 2)] + [(4000 + i, [0.0] * 8, 1) for i in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_dedup.near_duplicate_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (1502, 0) if lab == 1 and i < 3000 else (0, i) for i, _, lab in rows}


def test_estimates_hold_their_bounds():
    g = np.random.default_rng(1)
    x = g.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = embedding_near_dedup.rotation(64, 256)
    codes, factors = embedding_near_dedup.encode(x, turn)
    estimate, error = embedding_near_dedup.bounds(codes, factors, x, turn, 4.0)
    off = ~np.eye(200, dtype=bool)
    assert (np.abs(estimate - x @ x.T) <= error)[off].mean() > 0.999 and abs((estimate - x @ x.T)[off].mean()) < 0.005


def test_embedding_empty(spark):
    assert embedding_near_dedup.near_duplicate_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


# 5: chats


def test_chat_events(spark):
    log = [(1, 0, 0, "message", "user", "a <b> \\l"), (1, 1, 1, "message", "assistant", "x"), (1, 1, 2, "delta", None, "y"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "p"), (1, 1, 5, "delta", None, "q"), (1, 0, 6, "edit", None, "edited </turn>"), (2, 0, 0, "message", None, None)]
    got = {r.conv_id: r for r in chat_formatting.format_chats(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).select("*", chat_formatting.read_turns(F.col("formatted")).alias("t"), chat_formatting.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("user", "edited </turn>"), ("assistant", "pq")] and got[1].l == "pq"
    assert [(t.role, t.text) for t in got[2].t] == [("", "")] and got[2].l == ""


def test_chat_repeats(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (None, None, "assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in chat_formatting.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 2 and got[None].loss_chars == 26
    assert chat_formatting.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# 6: decontamination


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = split(t)
        for i, b in items:
            z = split(b)
            grams = lambda x: collections.Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else collections.Counter([tuple(x)])
            for s in range(-len(z), len(w)):
                cut = w[max(0, s) : max(0, s + len(z))]
                if z and cut:
                    a, c = grams(cut), grams(z)
                    if sum((a & c).values()) >= 0.8 * sum((a | c).values()):
                        out.setdefault((d, i), 0)
    return set(out)


def test_hits_equal_brute_force(spark):
    g = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(40)]
    say = lambda n: list(g.choice(vocab, n))
    items = [(k, say(n)) for k, n in enumerate((12, 15, 20, 33, 47, 47, 3, 5))]
    docs = []
    for k in range(60):
        w = say(g.integers(0, 120))
        if k % 2:
            passage = list(items[g.integers(0, len(items))][1])
            kind = k % 10
            passage = passage[1:] if kind == 1 else passage[:-2] if kind == 3 else ["new", *passage[1:]] if kind == 5 else passage
            at = g.integers(0, len(w) + 1)
            w[at:at] = passage
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, " ".join(items[0][1])), (102, "")]
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, "")]
    got = decontamination.benchmark_hits(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_hits(docs, items)


def test_hits_odd(spark, odd):
    bench = spark.createDataFrame([(1, "no id here at all"), (2, "short")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontamination.benchmark_hits(odd, bench).collect()) == [("4", 2), ("None", 1)]
    assert decontamination.benchmark_hits(odd, bench.limit(0)).count() == 0 and decontamination.benchmark_hits(odd.limit(0), bench).count() == 0


def test_items_without_an_id_are_found(spark):
    passage = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(3)]
    docs = spark.createDataFrame([(1, f"before {passage[0]} after"), (2, f"x {passage[1]} y {passage[2]}"), (3, "nothing of it " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage[0]), (7, passage[1]), (None, passage[2]), (None, passage[2])], "item_id long, text string")
    assert sorted((r.doc_id, str(r.item_id), r.start) for r in decontamination.benchmark_hits(docs, bench).collect()) == [(1, "None", 1), (2, "7", 1), (2, "None", 14)]
    assert [r.doc_id for r in decontamination.without_benchmark(docs, bench).collect()] == [3]


# 7: shards


def test_shards(spark, docs, odd):
    got = sharding.assign_shards(docs, sharding.tree(16), sharding.tree(17)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1 for r in got)
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    rows = sharding.assign_shards(odd, sharding.tree(16), sharding.tree(17)).collect()
    assert len(rows) == len(ODD) and len({(r.shard, r.slot) for r in rows}) == len(ODD)
    assert sharding.assign_shards(odd.limit(0), sharding.tree(16), sharding.tree(17)).count() == 0


def test_rows_of_one_key_are_numbered_in_many_parts(spark):
    rows = sharding.assign_shards(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text")), sharding.tree(16), sharding.tree(17)).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))


def test_weights_move_only_their_subtrees(spark):
    leaves = sharding.tree(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.rack == "rack3" else 1.0) for x in leaves]
    rows = spark.range(4000).select(sharding.shard_of(F.col("id").cast("string"), leaves).alias("a"), sharding.shard_of(F.col("id").cast("string"), heavier).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b // 8 == 1 for _, b in moved)
    n = collections.Counter(r.b for r in rows)
    assert sum(n[s] for s in range(12, 16)) > 1.8 * sum(n[s] for s in range(4))


# 8: personal data


def base_by_hand(t):
    out = []
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, rule in rules.items():
        for m in re.finditer(rule, t):
            n = re.sub("[^0-9]", "", m[0])
            twice = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n)))
            if not (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(n) <= 19 and twice % 10 == 0) or kind == "phone" and not 9 <= len(n) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    g = np.random.default_rng(5)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0100", "+12", " ", "é", "\U0001f600", "a_b", "-", "1.2.3.4.5.6.7.8", "0001.002.3.255", "12345678901234567890123"]
    texts = ["".join(g.choice(parts, g.integers(0, 12))) for _ in range(400)] + ["a@b.c_d@e.f.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "9" * 5000, "x" * 20000 + "@y.z"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.base_sha256 for r in pii.pii_digest(df).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != hashlib.sha256(base_by_hand(t).encode()).hexdigest()] == []


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"lorem ipsum account mail: user{i}@mail.example.com dolor {i}") for i in range(12)]
    rows += [(100, "lorem account mail: hidden99(at)mail dolor"), (101, "some other words 12345678 here")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].startswith("email:20:") and got[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")).collect()}
    assert clean[3] == "lorem ipsum account mail: [email] dolor 3" and "hidden99" not in clean[100] and clean[101] == rows[-1][1]


def test_contexts_of_later_rounds_may_lack_seeds(spark):
    rows = [(i, f"lorem ipsum account mail: user{i}@mail.example.com dolor") for i in range(150)]
    rows += [(200 + i, f"lorem account mail: hidden{i}(at)mail dolor ticket code: hidden{i}(at)mail") for i in range(9)]
    rows += [(300, "sit amet ticket code: other77(at)mail dolor")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].count("email:") == 2 and got[300] == "email:22:37"


def test_contexts_are_whole_words_of_the_text(spark):
    rows = [(i, f"lorem call phone 2: +15550100{i:02d} now") for i in range(12)] + [(100, "lorem call phone 2: AB-1234 now")]
    rows += [(20 + i, f"say to user me (u{i}@mail.example.com) now") for i in range(12)] + [(101, "say to user me (hidden55(at)mail) now")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:20:27" and got[101] == "email:16:32"


def test_very_many_hits_in_one_text(spark):
    texts = [" ".join(f"u{i}@x.org 10.0.{i % 300}.1" for i in range(n)) for n in (255, 256, 257, 6000)]
    got = {r.doc_id: r.base_sha256 for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: hashlib.sha256(base_by_hand(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_redact_keeps_clashing_columns(spark):
    rows = [(1, "mail a@b.org now", "p", "q", 3, "r"), (2, None, None, None, None, None)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, _d string, __H string, _s int, _t string")).collect()
    assert sorted(map(tuple, got)) == [(1, "mail [email] now", "p", "q", 3, "r"), rows[1]]


def test_pii_odd(odd):
    got = pii.pii_digest(odd).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got) and pii.pii_digest(odd.limit(0)).collect() == []
    assert pii.redact(odd).count() == len(ODD)


# 9: set join


def brute_groups(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_groups_equal_brute_force(spark, size, num, den):
    g = np.random.default_rng(size)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        w = list(g.choice(vocab, g.integers(1, 150)))
        for _ in range(g.integers(1, 7)):
            c = list(w)
            for _ in range(g.integers(0, 5)):
                c[g.integers(0, len(c))] = str(g.choice(vocab))
            rows.append((len(rows), " ".join(c)))
    rows += [(900, None), (901, " "), (902, "Only Two"), (903, "only\ttwo")]
    got = ngram_jaccard_join.similar_groups(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, set_id int"), size, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows, size, num, den)


def test_exact_copies_without_near_ones_are_linked(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    rows = [(k, say(k)) for k in range(8)] + [(20, say(3)), (21, say(3)), (22, say(5)), (23, None), (24, " "), (None, say(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join.similar_groups(df).collect()}
    assert got == {k: k for k in range(8)} | {20: 3, 21: 3, 22: 5, 23: 23, 24: 24, None: None}
    assert sorted(str(r.doc_id) for r in ngram_jaccard_join.one_of_each_group(df).collect()) == sorted(map(str, [*range(8), 23, 24, None]))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100), (30, 100)])
def test_similar_sets_share_a_signature(num, den):
    g = np.random.default_rng(num)
    for size in (*range(1, 40), 63, 64, 65, 200, 700):
        for _ in range(40):
            a = np.unique(g.integers(0, 2**63, size).astype(np.uint64))
            out = g.integers(0, ngram_jaccard_join.most_different(2 * size, num, den) + 1)
            more = g.integers(0, ngram_jaccard_join.most_different(2 * size, num, den) + 1)
            b = np.unique(np.concatenate([g.permutation(a)[: max(1, len(a) - out)], g.integers(0, 2**63, more).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_jaccard_join.signatures(a, len(a), num, den), ngram_jaccard_join.signatures(b, len(b), num, den)).size
                sketch = [ngram_jaccard_join.parity_sketch(x, ngram_jaccard_join.sketch_bits(len(x), num, den)) for x in (a, b)]
                assert ngram_jaccard_join.can_be_similar(*sketch, len(a) + len(b), num, den)
    for band in range(14):
        count, two = ngram_jaccard_join.allocation(band, num, den)
        top = ngram_jaccard_join.band_top(band)
        assert count + two >= ngram_jaccard_join.levels_needed(top, top, num, den) and count >= two


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, thue.upper()), (4, f" {thue}\t")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 1)}


def test_blocks_lose_no_link(spark, monkeypatch):
    """Many sets share a common line; after few star rounds most links come from small blocks."""
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK_SETS", 16)
    g = np.random.default_rng(9)
    line = [f"c{i}" for i in range(12)]
    rows = []
    for k in range(60):
        own = [f"w{x}" for x in g.integers(0, 10**6, 14)]
        for _ in range(g.integers(1, 4)):
            c = list(own)
            c[g.integers(0, 14)] = "new"
            rows.append((len(rows), " ".join([*line, *c, *line] if len(rows) % 3 else [*line, *own])))
    for rounds in (1, 2):
        monkeypatch.setattr(ngram_jaccard_join, "STAR_ROUNDS", rounds)
        got = ngram_jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 2, 70, 100)


def test_groups_odd(spark, odd):
    got = ngram_jaccard_join.similar_groups(odd)
    assert got.count() == len(ODD) and {r.component_id for r in got.where("doc_id = 4").collect()} == {4}
    assert ngram_jaccard_join.similar_groups(odd.limit(0)).collect() == [] and ngram_jaccard_join.one_of_each_group(odd).count() == len(ODD)


# 10: token files


def test_token_files(spark, docs, odd, tmp_path):
    t = Tokenizer.from_file(WORDS)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") - 1000).dropDuplicates(["doc_id"]))
    rows = sorted((r.doc_id, r.text or "") for r in both.collect())
    want, start = {}, 0
    for (d, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True):
        want[d] = (start, [*e.ids, 1])
        start += len(e.ids) + 1
    path = f"file://{tmp_path}/blocks"
    token_output.write_token_blocks(both, path, WORDS, block_ids=20_000)
    assert {r.doc_id: (r.start, list(r.ids)) for r in token_output.read_documents(spark, path).collect()} == want
    flat = [i for d in sorted(want) for i in want[d][1]]
    for a, b in ((0, 5), (19_990, 20_050), (start - 7, start)):
        got = [i for r in token_output.read_ids(spark, path, a, b).orderBy("start").collect() for i in r.ids]
        assert got == flat[a:b]
    digest = {r.doc_id: r for r in token_output.token_digest(both, WORDS).collect()}
    assert all(digest[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and digest[d].start == s for d, (s, ids) in want.items())


def test_words_equal_the_library():
    t = Tokenizer.from_file(WORDS)
    words = ["<|startoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "Hello,", "ÉTÉ!", "it's", "İx", "Å", "ẞ", "a1", "...", "x́y", "don't.", "<|endoftext|>", "日本", "µ", "naïve;", "'s", "K"]
    got = token_output.WordTokens(WORDS)
    assert [list(got.ids(w)) for w in words] == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_grammar_round_trip():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 5000):
        ids = g.integers(0, 6, n).astype(np.uint32)
        ends = np.unique(np.concatenate([g.integers(0, n + 1, 5), [n]])) if n else np.array([0])
        symbols, rules, lengths, cut = token_output.compress(ids, ends, 10)
        assert (token_output.expand(symbols, rules, 10) == ids).all() and len(cut) == len(ends)
        assert len(symbols) <= max(1, n) and (n < 1000 or len(symbols) < n / 2)
        if n > 50:
            assert (token_output.ids_between(symbols, rules, lengths, 10, 7, 31) == ids[7:31]).all()


def test_grammar_leaves_no_frequent_pair():
    g = np.random.default_rng(7)
    words = [g.integers(0, 40, int(g.integers(2, 9))).astype(np.uint32) for _ in range(60)]
    docs = [np.concatenate([words[int(k)] for k in g.zipf(1.4, 200) % 60]) for _ in range(20)] + [g.integers(0, 40, 200).astype(np.uint32)] * 6
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    symbols, rules, lengths, cut = token_output.compress(ids, ends, 40)
    assert (token_output.expand(symbols, rules, 40) == ids).all() and lengths.max() > 64
    used, before = collections.Counter(), {}
    for start, stop in zip([0, *cut[:-1]], cut, strict=True):
        for at in range(start, stop - 1):
            pair = (int(symbols[at]), int(symbols[at + 1]))
            if before.get(pair) != at - 1 or pair[0] != pair[1]:  # what overlaps is used once
                used[pair] += 1
                before[pair] = at
    assert max(used.values()) < token_output.USES


def test_token_words_with_digits_and_marks_ask_the_model_many_at_once(monkeypatch):
    t, got = Tokenizer.from_file(WORDS), token_output.WordTokens(WORDS)
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abzABZ\xe9\xc9\xdf\xff\xc0\xde09.-_\"\\<>!", k=rnd.randint(1, 12))) for _ in range(3000)]
    other = ["a\xd7b", "\xf7", "don't", "x<|endoftext|>y", "a|b", "\u0130x", "e\u0301", "\u212a", "\xb2\xaa", "a\tb\x00", "\u65e5\u672c", "z" * 300, ""]
    asked = []

    class Watched:
        def encode_batch(self, some, **how):
            asked.extend(some)
            return t.encode_batch(some, **how)

    got.tokenizer = Watched()
    texts = [" ".join(words[k : k + 7]) for k in range(0, 3000, 7)] + other
    ids, counts = got.ids_of(pa.array([*texts, None]))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert list(ids) == sum(want, []) and list(counts) == [*map(len, want), 0]
    assert not set(words) & set(asked) and set(asked) == set(other)
    monkeypatch.setattr(token_output, "KEPT_WORDS", 100)
    assert all(list(x) == list(y) for x, y in zip(got.ids_of(pa.array([*texts, None])), (ids, counts), strict=True))


def test_token_chunks():
    schema = pa.schema({"doc_id": pa.int64(), "text": pa.string()})
    batches = [pa.record_batch({"doc_id": [k], "text": [x]}, schema) for k, x in enumerate(["a" * 3_000_000, None, "", "b" * 3_000_000, "c" * 9_000_000])]
    large = pa.record_batch({"doc_id": [9, 10, 11], "text": ["d" * 5_000_000, "e" * 5_000_000, "f"]}, schema)
    got = list(token_output._chunks(iter([*batches, large, large.slice(0, 0)])))
    assert [x.column(0).to_pylist() for x in got] == [[0, 1, 2, 3], [4], [9], [10, 11]]


def test_token_files_odd(spark, odd):
    assert token_output.token_digest(odd, WORDS).count() == len(ODD) and token_output.token_digest(odd.limit(0), WORDS).collect() == []


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    groups = brute_groups(sorted(rows.items()), 5, 80, 100)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {d: t for d, t in rows.items() if groups[d][1] == d and re.search(r"[^\W\d_]", t)}
    hit = {d for d, _ in brute_hits([(d, t) for d, t in left.items() if any(" ".join(b.split()[:4]).lower() in " ".join(t.split()).lower() for _, b in items)], items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(left) - hit
    for d in got:
        if not base_by_hand(left[d]):
            assert got[d].n_tokens == len(encoding().encode_ordinary(left[d])) and got[d].decoded_sha256 == hashlib.sha256(left[d].encode()).hexdigest()
