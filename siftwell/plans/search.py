"""Registered queries on the inverted index, recall, classes of neighbours, calibration, platforms and retention."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import numeric, platform, text
from siftwell.operators import analytics, postings, retrieval
from siftwell.operators.staging import shared_dir
from siftwell.plans.common import newest, table
from siftwell.sources import retention

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


def index_of(spark: SparkSession, d: str) -> str:
    """An index of the documents by text and source, in two batches, the second of which replaces some of the first."""
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    postings.add_batch(docs.withColumn("text", F.when(F.col("source") == "src1", F.lit("an old version of the text")).otherwise(F.col("text"))), path, 1, "doc_id", {"text": "text", "source": "source"})
    postings.add_batch(docs.where("source = 'src1'"), path, 2, "doc_id", {"text": "text", "source": "source"})
    return path


@query(rf"""WITH f AS (SELECT doc_id AS id, 'text' AS field, {_WORDS.format("coalesce(text, '')")} AS w, 1.0 AS weight FROM documents UNION ALL SELECT doc_id, 'source', {_WORDS.format("coalesce(source, '')")}, 2.0 FROM documents),
m AS (SELECT field, avg(len(w)) AS mean, count(*) AS n FROM f GROUP BY 1), h AS (SELECT id, field, weight, len(w) AS length, t AS term, len(list_filter(w, lambda x: x = t)) AS tf FROM f, (SELECT unnest(['the', 'with', 'tion', 'src3']) AS t) q),
d AS (SELECT id, term, sum(weight * tf / (0.25 + 0.75 * length / mean)) AS tf, max(n) AS n FROM h JOIN m USING (field) WHERE tf > 0 GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM d),
s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 9) AS score FROM k GROUP BY 1)
SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 25""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    return postings.search(spark, index_of(spark, d), "the with tion src3", 25, {"text": 1.0, "source": 2.0}).withColumn("score", F.round("score", 6))


_RECALLED = ("auth", "src3", "than", "for", "authentication", "authorization", "jwt", "oauth")


@query(rf"""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9+#]+', ' ', 'g')) AS a, trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9+#]+', ' ', 'g')) AS b FROM documents),
s AS (SELECT doc_id, {" + ".join(f"CASE WHEN list_contains(string_split(a, ' '), '{t}') THEN 2 WHEN contains(a, '{t}') THEN 1 ELSE 0 END" for t in _RECALLED)} + CASE WHEN contains(a, 'auth src3 than for') THEN 4 ELSE 0 END AS x,
  {" + ".join(f"CASE WHEN list_contains(string_split(b, ' '), '{t}') THEN 2 WHEN contains(b, '{t}') THEN 1 ELSE 0 END" for t in _RECALLED)} AS y FROM f)
SELECT doc_id, round(x * 1.0 + y * 2.5, 6)::DOUBLE AS score, list_filter([CASE WHEN x > 0 THEN 'text' END, CASE WHEN y > 0 THEN 'source' END], lambda n: n IS NOT NULL) AS matched FROM s WHERE x + y > 0 ORDER BY 2 DESC, doc_id LIMIT 40""")
def recall_weighted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recall(table(spark, d, "documents"), "doc_id", {"text": 1.0, "source": 2.5}, "Auth src3, than for", 40)


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), k AS (SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS distance FROM embeddings, q WHERE label IN (2, 5))
SELECT vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 12""")
def knn_of_class(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return retrieval.knn_of_class(v, v.where("vec_id = 7"), "vec_id", "embedding", F.col("label").isin(2, 5), 12).withColumn("distance", F.round("distance", 6))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), x AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3), c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v) AS m FROM x GROUP BY 1)),
m AS (SELECT list_transform(list_zip(q, c), lambda z: 0.7 * z[1] + 0.3 * z[2]) AS m FROM q, c), l AS (SELECT list_transform(m, lambda y: y / sqrt(list_sum(list_transform(m, lambda z: z * z)))) AS l FROM m), k AS (SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), l), 9) AS distance FROM embeddings, l)
SELECT vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 15""")
def knn_leaned(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    towards = retrieval.leaned(v.where("vec_id = 7"), "embedding", v.where("label = 3"), "embedding", 0.3)
    return retrieval.knn(v, towards.withColumnRenamed("vector", "embedding"), "vec_id", "embedding", 15).withColumn("distance", F.round("distance", 6))


@query(r"""WITH p AS (SELECT doc_id AS id, source || '/' || lang AS path, lower(text) AS t FROM documents), v AS (SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 9) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20),
b AS (SELECT id, path, round(1 - least(distance / 2, 1), 6) AS relevance, 'vector' AS "by" FROM v JOIN p USING (id) UNION ALL SELECT id, path, round(0.6 * (contains(t, 'than')::INT + contains(t, 'shth')::INT) / 2 + 0.4 * least((contains(t, 'than')::INT * 2 + contains(t, 'shth')::INT * 2) / 6, 1.0), 6), 'keyword' FROM p WHERE contains(t, 'than') OR contains(t, 'shth'))
SELECT id, path, relevance::DOUBLE AS relevance, "by" FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY relevance DESC, "by" DESC, id) = 1 ORDER BY relevance DESC, "by" DESC, id LIMIT 30""")
def find_by_path(spark: SparkSession, d: str) -> DataFrame:
    docs, v = table(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", "lang")), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = retrieval.knn(v, v.where("doc_id = 7"), "doc_id", "embedding", 20).join(docs, "doc_id").select(F.col("doc_id").alias("id"), "path", F.round(1 - F.least(F.col("distance") / 2, F.lit(1.0)), 6).alias("relevance"))
    words = ["than", "shth"]
    held = docs.where(F.contains(F.lower("text"), F.lit(words[0])) | F.contains(F.lower("text"), F.lit(words[1])))
    told = held.select(F.col("doc_id").alias("id"), "path", F.round(retrieval.keyword_relevance(F.col("text"), words), 6).alias("relevance"))
    return retrieval.find(near, told, "path", "id", 30)


@query("""WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])) AS v FROM embeddings), k AS (SELECT v FROM s WHERE v > 0.01 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 500),
a AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS deviation FROM k)
SELECT n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(CASE WHEN n >= 50 AND deviation >= 0.01 THEN greatest(0.2, least(mean, 0.7)) END, 6) AS center, round(CASE WHEN n >= 50 AND deviation >= 0.01 THEN greatest(5.0, least(2.5 / deviation, 30.0)) END, 6) AS scale FROM a""")
def sigmoid_fit(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    seen = v.join(F.broadcast(one)).select("vec_id", numeric.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    return analytics.sigmoid_fit(seen, "similarity", "vec_id")


@query("""WITH t AS (SELECT p_partkey, p_type, p_size, CASE p_size % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'aarch64' ELSE 'x86' END AS arch FROM part)
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN false WHEN 'ECONOMY' THEN arch <> 'x86_64' WHEN 'STANDARD' THEN p_size > 25 OR arch = 'x86_64' WHEN 'SMALL' THEN arch = 'x86_64' ELSE true END AS applies FROM t""")
def platform_targets(spark: SparkSession, d: str) -> DataFrame:
    arch = F.when(F.col("p_size") % 3 == 0, "x86_64").when(F.col("p_size") % 3 == 1, "aarch64").otherwise("x86")
    system = F.when(F.col("p_size") > 25, "linux").otherwise("freebsd")
    kind = F.col("p_type")
    target = F.when(kind == "PROMO", "cfg(windows)").when(kind == "ECONOMY", F.concat(F.lit('cfg(all(unix, not(target_arch = "'), arch, F.lit('")))'))).when(kind == "STANDARD", F.concat(F.lit('cfg(any(target_os = "'), system, F.lit('", all(target_family = "unix", target_arch = "'), arch, F.lit('")))')))
    target = target.when(kind == "SMALL", F.concat(F.when(arch == "x86", "i686").otherwise(arch), F.lit("-unknown-linux-gnu"))).when(F.col("p_size") > 30, "cfg(feature_unknown)")
    return table(spark, d, "part").select("p_partkey", platform.target_applies(target, F.lit("linux"), F.lit("unix"), F.lit("x86_64")).alias("applies"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_quantity > 5), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
e AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY ORDER BY ts DESC, event_id DESC LIMIT 500), d AS (SELECT * FROM documents WHERE n_chars >= 100), b AS (SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM d)), v AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM d)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l))
SELECT 'orders' AS name, count(*) AS kept, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM c UNION ALL SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT) FROM e
UNION ALL SELECT 'documents', count(*), CAST(sum(doc_id) AS BIGINT) FROM d UNION ALL SELECT 'labels', count(*), CAST(sum(doc_id) AS BIGINT) FROM b UNION ALL SELECT 'embeddings', count(*), CAST(sum(vec_id) AS BIGINT) FROM v UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM p UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM s""")
def retention_cascade(spark: SparkSession, d: str) -> DataFrame:
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "part": "p_partkey", "supplier": "s_suppkey"}
    tables = {name: table(spark, d, name) for name in keys}
    last = tables["orders"].agg(F.max("o_orderdate")).first()[0]
    rules = [
        retention.Rule("orders", keep=F.col("o_orderdate") >= F.lit(last) - F.expr("INTERVAL 900 DAYS")),
        retention.Rule("lineitem", keep=F.col("l_quantity") > 5, refers=(("l_orderkey", "orders", "o_orderkey"),)),
        retention.Rule("customer", refers=(("c_custkey", "orders", "o_custkey"),)),
        retention.Rule("events", keep=F.col("ts") >= newest(spark, d) - F.expr("INTERVAL 20 DAYS"), last=500, order=(F.desc("ts"), F.desc("event_id"))),
        retention.Rule("documents", keep=F.col("n_chars") >= 100),
        retention.Rule("labels", refers=(("doc_id", "documents", "doc_id"),)),
        retention.Rule("embeddings", refers=(("vec_id", "documents", "doc_id"),)),
        retention.Rule("part", refers=(("p_partkey", "lineitem", "l_partkey"),)),
        retention.Rule("supplier", refers=(("s_suppkey", "lineitem", "l_suppkey"),)),
    ]
    root = f"{shared_dir(spark)}/retention-{uuid.uuid4().hex}"
    folders = retention.swap(spark, root, 1, retention.retained(tables, rules))
    counted = [spark.read.parquet(folders[name]).agg(F.lit(name).alias("name"), F.count("*").alias("kept"), F.sum(key).alias("keys")).select("name", "kept", "keys") for name, key in keys.items()]
    return reduce(DataFrame.union, counted)


_BM25 = rf"""w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), t AS (SELECT unnest(['the', 'with', 'tion']) AS t), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w), c AS (
  SELECT doc_id, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM w, t), f AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM c GROUP BY 1), k AS (
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 9) AS score FROM c JOIN f USING (t), s GROUP BY doc_id HAVING max(tf) > 0), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 50)"""
#: The twin of texts.hybrid_search, whose function is the flagship.
HYBRID = f"""WITH {_BM25}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 9), vec_id) AS rank FROM embeddings QUALIFY rank <= 50)
SELECT doc_id, CAST(b.rank AS INTEGER) AS text_rank, CAST(v.rank AS INTEGER) AS vector_rank, round(coalesce(0.4 / (60 + b.rank), 0) + coalesce(0.6 / (60 + v.rank), 0), 9) AS score FROM b FULL JOIN v USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""
ORACLE["hybrid_search"] = HYBRID

ORACLE["chunk_text"] = rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n|\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
r AS (SELECT doc_id, p, 1 AS i, 0 AS chunk, length(p[1]) AS size FROM p WHERE len(p) > 0
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN size + 1 + length(p[i + 1]) <= 500 THEN chunk ELSE chunk + 1 END, CASE WHEN size + 1 + length(p[i + 1]) <= 500 THEN size + 1 + length(p[i + 1]) ELSE length(p[i + 1]) END FROM r WHERE i < len(p)),
c AS (SELECT doc_id, chunk, string_agg(p[i], chr(10) ORDER BY i) AS content FROM r GROUP BY 1, 2)
SELECT doc_id, chunk, content FROM c WHERE NOT (length(content) < 50 OR regexp_matches(content, '{text.BOILERPLATE}'))"""
