"""Registered queries that choose and order rows: keywords, null-aware filters, top rows by class, budgets, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import numeric
from siftwell.operators import selection
from siftwell.plans.common import newest, stamp, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT source, count(*) AS n FROM documents WHERE text ILIKE '%the%of%in%' GROUP BY 1")
def keywords_in_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(selection.in_order(F.col("text"), ["the", "of", "in"])).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE (contains(lower(url), 'example') OR contains(lower(html), 'example')) AND (contains(lower(url), 'title') OR contains(lower(html), 'title'))")
def all_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(selection.all_terms([F.col("url"), F.col("html")], ["example", "title"])).select("page_id")


@query("SELECT doc_id FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')")
def null_passes_not_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(selection.not_among(F.col("lang"), ["en", "de"])).select("doc_id")


@query("SELECT d.doc_id, l.quality IS NOT DISTINCT FROM 1 AS judged_good FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_safe_flag(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.col("quality").eqNullSafe(F.lit(1)).alias("judged_good"))


@query("""SELECT event_id, epoch_us(effective) AS effective_us FROM (SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN ts - INTERVAL 1 HOUR END, ts) AS effective FROM events)
WHERE effective BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)""")
def effective_time_range(spark: SparkSession, d: str) -> DataFrame:
    now = newest(spark, d)
    published = F.when(F.col("event_type") == "view", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    e = table(spark, d, "events").withColumn("effective", F.coalesce(published, "ts"))
    return e.where(F.col("effective").between(now - F.expr("INTERVAL 7 DAYS"), now)).select("event_id", stamp("effective").alias("effective_us"))


@query("""SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id LIMIT 100""")
def backlog_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, d, "events").orderBy(rank, F.desc("ts"), "event_id").limit(100).select("event_id", "event_type")


@query("""SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, d.n_chars DESC, d.doc_id LIMIT 100""")
def relevance_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.orderBy(F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "quality")


@query("""WITH t AS (SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)
SELECT t.event_id AS trigger_id, e.event_id FROM t JOIN events e ON e.user_id = t.user_id AND e.event_type = t.event_type AND e.event_id <> t.event_id""")
def same_kind_as_trigger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    triggers = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select(F.col("event_id").alias("trigger_id"), "user_id", "event_type")
    return e.join(F.broadcast(triggers), ["user_id", "event_type"]).where("event_id <> trigger_id").select("trigger_id", "event_id")


@query("SELECT user_id, (SELECT x.event_id FROM events x WHERE x.user_id = e.user_id ORDER BY x.value DESC NULLS LAST, x.event_id LIMIT 1) AS event_id, max(value) AS value FROM events e GROUP BY user_id")
def correlated_best(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_of_each(table(spark, d, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0")
def days_without_failure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("failed")).where("not failed").select("user_id", "day")


@query("""WITH l AS (SELECT string_split_regex(lower(text), '[^a-z0-9]+') AS w, quality FROM documents JOIN labels USING (doc_id)), v AS (
  SELECT unnest(list_distinct(list_filter(w, lambda x: length(x) > 3)[1:5])) AS word, quality FROM l)
SELECT word, CAST(sum(quality) AS BIGINT) AS saves, CAST(sum(1 - quality) AS BIGINT) AS dismissals, round((sum(quality) - sum(1 - quality)) / count(*), 6) AS net FROM v GROUP BY 1 HAVING count(*) >= 2""")
def word_votes(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    out = selection.word_votes(joined, F.col("text"), F.col("quality") == 1)
    return out.withColumn("net", F.round("net", 6))


@query("""SELECT source, lang, count(*) AS n, round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2
HAVING count(*) >= 8 AND avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) >= 0.1""")
def dismissal_rates(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rate = F.avg(F.when(F.col("quality") == 0, 1.0).otherwise(0.0))
    return joined.groupBy("source", "lang").agg(F.count("*").alias("n"), rate.alias("rate")).where("n >= 8 and rate >= 0.1").withColumn("rate", F.round("rate", 6))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) > CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 50 ELSE 200 END AS demoted FROM events")
def class_budgets(spark: SparkSession, d: str) -> DataFrame:
    return selection.within_budgets(table(spark, d, "events"), "event_type", "value", "event_id", {"error": 10, "purchase": 50}, 200).select("event_id", "demoted")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'purchase')
WHERE r <= least(5, floor((SELECT count(*) FROM events WHERE event_type = 'purchase') * 10 / 100))""")
def serendipity_budget(spark: SparkSession, d: str) -> DataFrame:
    return selection.serendipity(table(spark, d, "events"), F.col("event_type") == "purchase", "value", "event_id", 10).select("event_id")


@query("""SELECT l_partkey AS package, 'used' AS origin FROM lineitem WHERE l_quantity > 40 GROUP BY 1 UNION ALL
SELECT p_partkey, 'listed' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def first_source_wins(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("package"), F.lit("used").alias("origin"))
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("package"), F.lit("listed").alias("origin"))
    return selection.first_of([used, listed], ["package"])


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ORDER BY last DESC, user_id LIMIT 50")
def distinct_by_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(50).select("user_id")


@query("""SELECT p_partkey FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda t: contains(t, 'ring') OR contains('ring', t) OR contains(t, 'redder') OR contains('redder', t))) > 0""")
def excluded_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(selection.excluded_by(F.split("p_name", " "), ["Ring", "redder"])).select("p_partkey")


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '[^A-Za-z0-9_]+'), lambda w: w <> ''), lambda w: '"' || w || '"*'), ' ') AS terms FROM part""")
def prefix_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", selection.prefix_query(F.col("p_name")).alias("terms"))


@query("""WITH k AS (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0), b AS (SELECT e.*, k.event_id IS NOT NULL AS known FROM events e LEFT JOIN k USING (event_id)), h AS (
  SELECT event_type, count(*) AS n, avg(CASE WHEN known THEN 1.0 ELSE 0.0 END) AS known_share, trunc((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1000000) / 3600 AS age_hours FROM b GROUP BY 1)
SELECT event_type, n, round(known_share, 6) AS known_share, round(age_hours, 6) AS age_hours, CASE WHEN age_hours > 24 THEN 'stale' WHEN known_share > 0.9 THEN 'repeating' ELSE 'healthy' END AS verdict FROM h""")
def batch_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = selection.batch_health(e, "event_id", "ts", e.where("event_id % 3 = 0"), "event_type", newest(spark, d))
    return out.select("event_type", "n", F.round("known_share", 6).alias("known_share"), F.round("age_hours", 6).alias("age_hours"), "verdict")


_FACETS = "SELECT event_id, event_type = 'error' AS security, user_id % 2 = 0 AS known, event_type = 'purchase' AS release, event_type = 'view' AS intro, least(value / 1000.0, 1.0) AS c FROM events"


@query(f"""SELECT event_id, round(CASE WHEN security AND known THEN 1.30 WHEN security THEN 1.10 WHEN release AND known THEN 1.25 WHEN release THEN 1.05 WHEN intro AND known THEN 1 - 0.5 * c WHEN intro THEN 1 - 0.2 * c ELSE 1.0 END, 6) AS novelty FROM ({_FACETS})""")
def novelty_factor(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    factor = numeric.novelty(kind == "error", F.col("user_id") % 2 == 0, kind == "purchase", kind == "view", F.least(F.col("value") / 1000.0, F.lit(1.0)))
    return table(spark, d, "events").select("event_id", F.round(factor, 6).alias("novelty"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS acted, count(*) FILTER (event_type = 'error') AS expired, count(*) FILTER (event_type = 'signup') AS gaps, count(*) AS n, avg(value) AS lead FROM events GROUP BY 1)
SELECT user_id, round(100 * (0.30 * CASE WHEN acted + expired > 0 THEN acted / (acted + expired) ELSE 0.5 END + 0.20 * least(lead / 168, 1.0) + 0.25 * 0.8 + 0.15 * least(gaps / 5, 1.0) + 0.10 * least(ln(n) / ln(1000), 1.0)), 6) AS advantage FROM u""")
def compound_advantage(spark: SparkSession, d: str) -> DataFrame:
    count = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    u = table(spark, d, "events").groupBy("user_id").agg(count("purchase").alias("acted"), count("error").alias("expired"), count("signup").alias("gaps"), F.count("*").alias("n"), F.avg("value").alias("lead"))
    score = numeric.advantage(F.col("acted"), F.col("expired"), F.col("lead"), F.lit(0.8), F.col("gaps"), F.col("n"))
    return u.select("user_id", F.round(score, 6).alias("advantage"))
