"""Personal data: fixed patterns give seed entities, and bootstrapped contexts find identifiers that no pattern knows.

Seeds induce lexical patterns, here the two words before an entity with digits made alike. Patterns and the values they
surround form a graph. Each round scores a pattern by the confidence of its values against all its occurrences in the
corpus, and then a value by the patterns around it; values that reach the threshold support further patterns in the next
round. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart, broadcast_within, columns, staged

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the kinds. Possessive repeats and the look-behinds change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Candidates for unseen identifiers: words with a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<start:int,end:int,value:string,ctx:bigint>>"
#: Contexts and documents with findings up to these counts are broadcast; beyond, Spark shuffles the join.
BROADCAST_ROWS = 200_000
#: Matches of a text are walked in blocks of this many: an array that grows by one is copied each time, so blocks keep the
#: work close to the number of matches.
WALK = 256


def appended(n: Column, rest: dict[str, Column], kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Fold 0 to n - 1 (n > 0) by `step`, from whose state's array `out` grows; gives the last state, with all of `out`."""

    def block(state: Column, first: Column) -> Column:
        start = F.struct(F.array().cast(kind).alias("out"), *[state[name].alias(name) for name in rest])
        walked = F.aggregate(F.sequence(first, F.least(first + WALK, n) - 1), start, step)
        return F.get(F.transform(F.array(walked), lambda r: F.struct(F.concat(state["out"], F.array(r["out"])).alias("out"), *[r[name].alias(name) for name in rest])), F.lit(0))

    none = F.struct(F.array().cast(f"array<{kind}>").alias("out"), *[value.alias(name) for name, value in rest.items()])
    firsts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(WALK))
    return F.aggregate(firsts, none, block, lambda s: F.struct(F.flatten(s["out"]).alias("out"), *[s[name].alias(name) for name in rest]))


def _located(text: Column, pattern: str) -> Column:
    """All matches with their positions in code points and their contexts, from the pieces between matches.

    Of what stands before a match the last two whole words and what is glued to the match are carried on to the next one.
    """

    def walk(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            before, value = F.get(x["pieces"], i), F.get(x["hits"], i)
            start = state["at"] + F.length(before)
            words = F.split(F.concat(state["tail"], F.coalesce(F.get(x["hits"], i - 1), F.lit("")), before), r"\s+")

            def seen(w: Column) -> Column:
                span = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), context(w).alias("ctx"))
                tail = F.array_join(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)), " ")
                return F.struct(F.concat(state["out"], F.array(span)).alias("out"), (start + F.length(value)).alias("at"), tail.alias("tail"))

            return F.get(F.transform(F.array(words), seen), F.lit(0))

        out = appended(F.size(x["hits"]), {"at": F.lit(0), "tail": F.lit("")}, SPAN, step)
        return F.when(F.size(x["hits"]) > 0, out["out"]).otherwise(F.array().cast(SPAN))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.get(F.transform(F.array(both), walk), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            short = F.ltrim(part, F.lit("0"))
            return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, ctx) by kind as in KINDS (numbered from 0), then start."""

    def of(number: int, kind: str) -> Column:
        has = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(NEEDS[kind]))
        spans = F.when(has, _located(text, PATTERNS[kind])).otherwise(F.array().cast(SPAN))
        good = F.filter(spans, lambda s: _valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["ctx"].alias("ctx")))

    return F.concat(*[of(number, kind) for number, kind in enumerate(KINDS)])


def candidates(text: Column) -> Column:
    """Words with a digit or an at sign, without the punctuation around them, at least five code points long."""
    spans = F.when(F.rlike(text, F.lit("[0-9@]")), _located(text, CANDIDATE)).otherwise(F.array().cast(SPAN))

    def trimmed(s: Column) -> Column:
        inner = F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+]*+(.*?)[^\p{L}\p{N}]*$", 1)
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+]*+", 0))
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(inner)).alias("end"), inner.alias("value"), s["ctx"].alias("ctx"))

    return F.filter(F.transform(spans, trimmed), lambda s: F.length(s["value"]) >= 5)


def _alike(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]+", "0")


def context(words: Column) -> Column:
    """Hash of the two whole words before an entity, or null where there are fewer; the last item is what is glued to it."""
    return F.when((F.size(words) >= 3) & (F.get(words, F.size(words) - 3) != ""), F.xxhash64(_alike(F.element_at(words, -3)), _alike(F.element_at(words, -2))))


def context_totals(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each context (column ctx) occurs in all texts; contexts are few, so texts are not shuffled."""
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    rows = docs.select(F.transform(words, _alike).alias("w")).where("size(w) > 1")
    pairs = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("ctx"))
    return pairs.join(broadcast_within(contexts, contexts.count(), BROADCAST_ROWS), "ctx", "left_semi").groupBy("ctx").agg(F.count("*").alias("total"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the columns that the operators below take, with a null text made empty."""
    return columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def discover(docs: DataFrame, found: DataFrame, support: int = 5, pattern_least: float = 0.6, value_least: float = 0.8) -> DataFrame:
    """Spans that contexts add to the base ones: rows (doc_id, hash, kind, start, end).

    A pattern is a kind and a context; it needs `support` different values and a confidence of `pattern_least`: the sum of
    its mentions' confidences by all its occurrences in the corpus, whatever follows there. A value's confidence is
    1 - product of (1 - confidence) over the patterns of its mentions. Rounds go on until the values that they accept are
    those of an earlier round.
    """
    seeds = found.select("doc_id", "hash", F.explode("spans").alias("s")).select("doc_id", "hash", "s.kind", "s.value", "s.ctx", F.lit(1.0).alias("conf"))
    seeds = staged(seeds.where("ctx is not null"), "seeds")

    def supported(instances: DataFrame) -> DataFrame:
        each = instances.groupBy("kind", "ctx", "value").agg(F.sum("conf").alias("conf"))
        return each.groupBy("kind", "ctx").agg(F.sum("conf").alias("conf"), F.count("*").alias("n")).where(F.col("n") >= support)

    maybe = found.select("doc_id", "hash", F.explode("others").alias("c")).select("doc_id", "hash", "c.start", "c.end", "c.value", "c.ctx").where("ctx is not null")
    maybe = staged(maybe, "candidates")
    held = staged(seeds.select(F.col("doc_id").alias("d"), F.col("hash").alias("h")).distinct(), "seeded")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))
    seeded = docs.join(broadcast_within(held, held.count(), BROADCAST_ROWS), same, "left_semi")
    instances, accepted, known = seeds, None, None
    marks: set[tuple] = set()
    while True:
        patterns = staged(supported(instances), "patterns")
        asked = patterns.select("ctx").distinct() if known is None else patterns.select("ctx").distinct().join(known, "ctx", "left_anti")
        asked = staged(asked, "contexts")
        if not asked.isEmpty():
            # The texts that hold seeds bound the totals from below, which settles common contexts without counting them
            # everywhere; a context that they do not hold, learnt from values found elsewhere, is bounded by nothing.
            bound = staged(context_totals(seeded, asked), "bounds")
            asked = staged(patterns.join(asked, "ctx", "left_semi").join(bound, "ctx", "left").where(F.col("conf") >= pattern_least * F.coalesce("total", F.lit(0))).select("ctx").distinct(), "contexts")
        if not asked.isEmpty():
            totals = staged(context_totals(docs, asked), "totals")
            known = totals if known is None else known.union(totals)
        if known is None:
            break
        scored = patterns.join(known, "ctx").select("kind", "ctx", F.least(F.lit(0.999), F.col("conf") / F.col("total")).alias("p")).where(F.col("p") >= pattern_least)
        values = maybe.join(scored, "ctx").groupBy("kind", "value", "ctx").agg(F.first("p").alias("p")).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("conf"))
        best = values.groupBy("value").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"), F.max("conf").alias("conf")).where(F.col("conf") >= value_least)
        accepted = now = staged(maybe.join(best, "value"), "accepted")
        mark = tuple(now.select("kind", "value").distinct().agg(F.count("*"), F.bit_xor(F.xxhash64("kind", "value"))).first())
        if not mark[0] or mark in marks:
            break
        marks.add(mark)
        instances = seeds.unionByName(now.select("doc_id", "hash", "kind", "value", "ctx", "conf"))
    if accepted is None:
        return maybe.limit(0).select("doc_id", "hash", F.lit(0).alias("kind"), "start", "end")
    return accepted.select("doc_id", "hash", "kind", "start", "end").distinct()


def _free(others: Column, spans: Column) -> Column:
    """The candidates, which are in order, that overlap no span; by blocks, each against the spans in its reach."""

    def of_block(part: Column) -> Column:
        lo, hi = F.get(part, F.lit(0))["start"], F.get(part, F.size(part) - 1)["end"]
        near = F.filter(spans, lambda s: (s["start"] < hi) & (lo < s["end"]))
        return F.get(F.transform(F.array(near), lambda n: F.filter(part, lambda c: ~F.exists(n, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))), F.lit(0))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(others), F.lit(1)), F.lit(WALK))
    return F.flatten(F.transform(F.transform(firsts, lambda i: F.slice(others, i, F.lit(WALK))), of_block))


def _found(docs: DataFrame) -> DataFrame:
    """One staged row for each text: doc_id, hash of the text, base spans, other candidates."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.struct(base_spans(F.col("text")).alias("spans"), candidates(F.col("text")).alias("others")).alias("x"))
    free = F.get(F.transform(F.array("x"), lambda x: _free(x["others"], x["spans"])), F.lit(0))
    return staged(rows.select("doc_id", "hash", F.col("x.spans").alias("spans"), free.alias("others")), "pii")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and all, arrays of (kind, start, end) by kind, then start, in code points.

    A null text is empty. Repeated rows each give a row. Rows with a null id are kept. Extra columns are ignored; an empty
    table gives an empty result. Base spans are those of PATTERNS that pass their test; `all` adds what contexts find,
    never overlapping a base span.
    """
    texts = scan(docs)
    found = _found(texts)
    more = staged(discover(texts, found), "discovered")
    span = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = found.select("doc_id", "hash", span.alias("base"))
    n = more.count()
    if not n:
        return rows.select("doc_id", "base", F.col("base").alias("all"))
    more = more.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    out = rows.join(broadcast_within(more, n, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("all"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256 and spans."""
    rows = find_pii(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_append(kinds, F.lit(-1)), n)) for n in range(len(KINDS))]
    counts = [(F.size("base") + 1 - left).cast("long").alias(f"n_{kind}") for left, kind in zip(counts, KINDS, strict=True)]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans are replaced as one, under the kind that starts first. A null text stays null. The columns of the
    input stay; only text and n_chars change. The pipeline's stage.
    """
    d, h, at_s, t = apart(docs, "d", "h", "s", "t")
    texts = scan(docs)
    found = _found(texts)
    more = staged(discover(texts, found), "discovered")
    spans = found.select("doc_id", "hash", F.explode("spans").alias("s")).select("doc_id", "hash", "s.start", "s.end", "s.kind")
    spans = spans.union(more.select("doc_id", "hash", "start", "end", "kind"))
    spans = staged(spans.groupBy(F.col("doc_id").alias(d), F.col("hash").alias(h)).agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias(at_s)), "spans")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(state: Column, i: Column) -> Column:
        s = F.get(at_s, i)
        gap = F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        new = s["start"] >= state["at"]
        return F.struct(F.when(new, F.concat(state["out"], F.array(gap, F.get(names, s["kind"])))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    joined = docs.join(broadcast_within(spans, spans.count(), BROADCAST_ROWS), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    cut = F.array(appended(F.size(at_s), {"at": F.lit(0)}, "array<string>", step))
    clean = F.get(F.transform(cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), s["at"] + 1, F.length("text")))), F.lit(0))
    text = F.when(F.col(at_s).isNull(), F.col("text")).otherwise(clean)
    shown = joined.withColumn(t, text)
    return shown.select(*[F.col(t).alias("text") if c == "text" else F.when(F.col(at_s).isNull(), F.col("n_chars")).otherwise(F.length(t)).cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes])
