"""Lexical, vector and fused search, and the plain-language query front end."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.numeric import l2
from siftwell.functions.text import ascii_words
from siftwell.operators.staging import staged

STOP_WORDS = frozenset("a an and are about all any by did do does find for from had has have how i in is it list many me my of on or search show that the these this those to was were what when where which with".split())


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for a query by BM25: id, score, rank.

    Texts are read once: numbers of words and of each term are counted by patterns and written, and both the means and the
    scores come from those few columns. For many queries over one corpus see `postings`.
    """
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counted = docs.select(F.col(id_col), low.alias("t")).select(id_col, F.regexp_count("t", F.lit("[a-z0-9]+")).alias("len"), *[F.regexp_count("t", F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = staged(counted, "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    top = hits.select(id_col, F.round(score, 9).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def knn(rows: DataFrame, query: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """The k nearest rows of a single query vector (a frame of one row) by L2 distance."""
    one = query.select(F.col(vector_col).alias("_q")).limit(1)
    near = rows.join(F.broadcast(one)).select(id_col, F.round(l2(F.col(vector_col), F.col("_q")), 9).alias("distance"))
    top = near.orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def knn_of_set(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, floor: float = -1.0, block: int = 2048) -> DataFrame:
    """For each query the k rows of highest cosine, itself left out: query_id, id, cosine, rank.

    Rows and queries are dealt into blocks and each pair of blocks is one task's matrix product, of which only k rows a
    query leave the task. Null vectors are left out; a zero vector has cosine 0 with all.
    """

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name)), n

    (q, nq), (r, nr) = dealt(queries, "qb"), dealt(rows, "rb")
    both = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("is_query", F.lit(True))
    both = both.unionByName(r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("is_query", F.lit(False)))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part.is_query].sort_values("id"), part[~part.is_query].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        x, y = (np.stack(p.v.values).astype(np.float64) for p in (a, b))
        x, y = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (x, y))
        c = np.round(x @ y.T, 9)
        c[a.id.values[:, None] == b.id.values[None, :]] = -9
        at = np.argsort(-c, axis=1, kind="stable")[:, : k + 1][:, :k]
        return pd.DataFrame({"query_id": np.repeat(a.id.values, at.shape[1]), "id": b.id.values[at.ravel()], "cosine": np.take_along_axis(c, at, 1).ravel()})

    found = both.groupBy("qb", "rb").applyInPandas(best, "query_id long, id long, cosine double").where(F.col("cosine") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_of_class(rows: DataFrame, query: DataFrame, id_col: str, vector_col: str, eligible: Column, k: int) -> DataFrame:
    """The k nearest of the rows that are eligible. The class is asked before the distance, so that the result is never
    short of rows, however many nearer ones are not eligible; a null class is not."""
    return knn(rows.where(F.coalesce(eligible, F.lit(False))), query, id_col, vector_col, k)


def leaned(query: DataFrame, vector_col: str, interests: DataFrame, interest_col: str, weight: float, most: float = 0.5) -> DataFrame:
    """A query vector (a frame of one row) leaned towards the mean of a person's vectors and made a unit vector: (vector).

    The weight counts from 0 to `most`. Null and zero vectors and those of another width have no part; without any, or
    without weight, the query stays as it is. The mean is taken by component, so vectors meet as sums.
    """
    w = min(max(weight, 0.0), most)
    one = query.select(F.col(vector_col).cast("array<double>").alias("vector")).limit(1)
    usable = interests.select(F.col(interest_col).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    same = usable.join(F.broadcast(one.select(F.size("vector").alias("width"))), F.size("v") == F.col("width")).select("v")  # one row
    sums = same.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"))  # a row a component
    mean = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("mean"))
    mixed = F.zip_with("vector", "mean", lambda q, c: (1 - w) * q + w * c)
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(norm > 0, F.transform(mixed, lambda x: x / norm)).otherwise(mixed)
    return one.join(F.broadcast(mean)).select(F.when((F.size("mean") > 0) & F.lit(w > 0), unit).otherwise(F.col("vector")).alias("vector"))


def find(vector_hits: DataFrame, keyword_hits: DataFrame, path_col: str, id_col: str, limit: int) -> DataFrame:
    """Hits of both kinds (id, path, relevance), the most relevant of each path: id, path, relevance, by.

    Higher relevance comes first, then hits by vector before those by keyword, then the smaller id. Null paths are paths of
    their own.
    """
    both = vector_hits.select(id_col, path_col, "relevance", F.lit("vector").alias("by")).union(keyword_hits.select(id_col, path_col, "relevance", F.lit("keyword").alias("by")))
    order = [F.desc("relevance"), F.desc("by"), F.asc(id_col)]
    own = F.coalesce(F.concat(F.lit("p"), F.col(path_col)), F.concat(F.lit("i"), F.col(id_col).cast("string")))
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy(own).orderBy(*order))).where("_r = 1").drop("_r")
    return first.orderBy(*order).limit(limit)


#: Words that a recall leaves out, and other names of words.
RECALL_STOP_WORDS = frozenset("about after again against before between from into should that their there this with would".split())
ALIASES = {
    "auth": ("authentication", "authorization", "jwt", "oauth"), "authentication": ("auth",), "authorization": ("auth", "authz"), "authz": ("authorization",), "js": ("javascript",), "javascript": ("js",),
    "postgres": ("postgresql",), "postgresql": ("postgres",), "py": ("python",), "python": ("py",), "sqlite": ("sqlite3",), "sqlite3": ("sqlite",), "ts": ("typescript",), "typescript": ("ts",),
}


#: The characters of a recall's words, as in a pattern's brackets.
RECALL_LETTERS = "a-z0-9+#"


def recall(rows: DataFrame, id_col: str, weights: dict[str, float], query: str, limit: int, vector_score: Column | None = None, vector_weight: float = 0.0) -> DataFrame:
    """The best rows for a question over weighted fields: id, score, matched (the fields that match, as weighted).

    Words are runs of a-z, 0-9, plus and number signs in lower case. In each field the whole question counts 4, each of its words of three characters or more and each of their other names
    counts 2 as a word and 1 within one. `vector_score`, a column of cosines, adds its part times `vector_weight` to rows
    that match. Ties go to the smaller id; nulls are empty. Texts are read once: their counts are written.
    """
    phrase = " ".join(re.findall("[a-z0-9+#]+", query.lower()))
    found = [w for w in phrase.split(" ") if len(w) >= 3 and w not in RECALL_STOP_WORDS]
    terms = list(dict.fromkeys(t for w in found for t in (w, *ALIASES.get(w, ()))))
    extra = F.coalesce(vector_score, F.lit(0.0)) * vector_weight if vector_score is not None else F.lit(0.0)
    texts = [F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(f"_text{at}") for at, name in enumerate(weights)]
    low, values = rows.select(F.col(id_col), extra.alias("_vector"), *texts), []
    for at in range(len(weights)):
        text = F.col(f"_text{at}")
        has = lambda s, text=text: F.contains(text, F.lit(s))
        whole = F.rlike(text, F.lit(f"[^{RECALL_LETTERS}]+".join(map(re.escape, phrase.split(" ")))))
        value = F.when(has(phrase) | (has(phrase.split(" ")[0]) & whole), 4).otherwise(0) if len(phrase) >= 3 else F.lit(0)
        for t in terms:
            # a search for the term comes first and a pattern last, as patterns take longest
            word = has(f" {t} ") | F.rlike(text, F.lit(f"(?<![{RECALL_LETTERS}]){re.escape(t)}(?![{RECALL_LETTERS}])"))
            value = value + F.when(~has(t), 0).when(word, 2).otherwise(1)
        values.append(value.alias(f"_field{at}"))
    scored = staged(low.select(id_col, "_vector", *values), "recall-counts")
    total = sum((F.col(f"_field{at}") * w for at, w in enumerate(weights.values())), F.lit(0.0))
    matched = F.array_compact(F.array(*[F.when(F.col(f"_field{at}") > 0, name) for at, name in enumerate(weights)]))
    out = scored.select(F.col(id_col), F.round(total, 6).alias("_lexical"), "_vector", matched.alias("matched")).where("_lexical > 0")
    return out.select(id_col, F.round(F.col("_lexical") + F.col("_vector"), 6).alias("score"), "matched").orderBy(F.desc("score"), id_col).limit(limit)


def fused(text_leg: DataFrame, vector_leg: DataFrame, id_col: str, limit: int, text_weight: float = 1.0, vector_weight: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs (id, rank)."""
    t = text_leg.select(id_col, F.col("rank").alias("text_rank"))
    v = vector_leg.select(id_col, F.col("rank").alias("vector_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    both = t.join(v, id_col, "full").withColumn("score", F.round(part("text_rank", text_weight) + part("vector_rank", vector_weight), 9))
    return both.orderBy(F.desc("score"), id_col).limit(limit)


def keyword_relevance(text, terms: list[str]):
    """0.6 of the share of terms found plus 0.4 of their saturated square-root lengths."""
    found = [F.contains(F.lower(text), F.lit(t)).cast("double") for t in terms]
    n = max(1, len(terms))
    ratio = sum(found, F.lit(0.0)) / n
    weight = sum((f * float(np.sqrt(len(t))) for f, t in zip(found, terms, strict=True)), F.lit(0.0)) / (3 * n)
    return 0.6 * ratio + 0.4 * F.least(weight, F.lit(1.0))


@dataclass(frozen=True)
class Query:
    intent: str
    keywords: tuple[str, ...]
    days: int | None


def parse(text: str) -> Query:
    """A plain-language question to its intent, keywords and time range in days."""
    low = text.lower()
    intent = "count" if re.search(r"\bhow many\b|\bcount\b", low) else "timeline" if re.search(r"\btimeline\b|\bhistory\b|\bwhen\b", low) else "compare" if re.search(r"\bcompare\b|\bversus\b|\bvs\b", low) else "summarize" if re.search(r"\bsummar", low) else "find"
    days = next((n for word, n in (("today", 1), ("yesterday", 2), ("last week", 7), ("this week", 7), ("last month", 30), ("last year", 365)) if word in low), None)
    drop = STOP_WORDS | set("count timeline history compare versus vs summarize summary today yesterday last week month year this files documents many".split())
    return Query(intent, tuple(w for w in re.findall(r"[a-z0-9]+", low) if w not in drop), days)


def answer(query: Query, docs: DataFrame, id_col: str, text_col: str, limit: int, ts_col: str | None = None, now: Column | None = None) -> DataFrame:
    """The plan of a parsed question over documents.

    count: the number of documents with one of the keywords. timeline: the newest of them. compare: for each keyword its
    documents, their mean relevance and, with times, the newest. summarize: the documents by day, newest first (by keyword
    without times). find, and else: the most relevant. The question's days count back from `now`, both ends included, where
    the documents have times. A question without keywords finds nothing but can be counted and put on a timeline. Ties go to
    the smaller id.
    """
    rows = docs
    if query.days and ts_col and now is not None:
        rows = rows.where(F.col(ts_col).between(now - F.make_interval(days=F.lit(query.days)), now))
    has = [F.contains(F.lower(F.col(text_col)), F.lit(w)) for w in query.keywords]
    any_word = has[0] if has else F.lit(query.intent in ("count", "timeline"))
    for h in has[1:]:
        any_word = any_word | h
    hits = rows.where(any_word)
    if query.intent == "count":
        return hits.agg(F.count("*").alias("n"))
    scored = hits.withColumn("relevance", F.round(keyword_relevance(F.col(text_col), list(query.keywords)), 9))
    if query.intent == "timeline" and ts_col:
        return scored.orderBy(F.desc(ts_col), id_col).limit(limit).select(id_col, ts_col, "relevance")
    if query.intent == "compare" or (query.intent == "summarize" and not ts_col):
        each = scored.withColumn("keyword", F.explode(F.array_compact(F.array(*[F.when(h, w) for h, w in zip(has, query.keywords, strict=True)]))) if has else F.lit(None).cast("string"))
        newest = [F.max(ts_col).alias("newest")] if ts_col else []
        return each.groupBy("keyword").agg(F.count("*").alias("n"), F.round(F.avg("relevance"), 6).alias("relevance"), *newest)
    if query.intent == "summarize":
        daily = scored.groupBy(F.to_date(ts_col).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("relevance"), 6).alias("relevance"), F.min_by(id_col, F.struct((-F.col("relevance")).alias("r"), id_col)).alias("best"))
        return daily.orderBy(F.desc("day")).limit(limit)
    return scored.orderBy(F.desc("relevance"), id_col).limit(limit).select(id_col, "relevance")


def match_standing(items: DataFrame, standing: DataFrame, text_col: str) -> DataFrame:
    """Items that hold all keywords of a saved query (query_id, keywords array); saved queries are a small table. Works on
    streams too."""
    words = ascii_words(F.col(text_col))
    pairs = items.withColumn("_w", F.array_distinct(words)).withColumn("_first", F.explode("_w"))
    asked = F.broadcast(standing.withColumn("_first", F.get("keywords", F.lit(0))))
    return pairs.join(asked, "_first").where(F.size(F.array_except("keywords", "_w")) == 0).drop("_w", "_first")
