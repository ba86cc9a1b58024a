"""Registered queries over events, labels and orders: joins, aggregations, windows, sequences, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import numeric
from siftwell.operators import analytics, matching, ranking, scoring, sequences
from siftwell.plans.common import newest, stamp, table
from siftwell.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


NOW = "(SELECT max(ts) FROM events)"


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 20 ORDER BY (SELECT 1) """.replace("ORDER BY (SELECT 1)", "QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 50"))
def balanced_by_source(spark: SparkSession, d: str) -> DataFrame:
    return ranking.newest_per_group(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 20, 50).select("event_id", "event_type")


@query("""SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY value DESC, ts DESC, event_id) <= 3""")
def best_per_source_day(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ranking.newest_per_group(e, ["event_type", "day"], [F.desc("value"), F.desc("ts"), F.col("event_id")], 3).select("event_id", "event_type", "day")


@query("""SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM documents JOIN labels USING (doc_id)
GROUP BY source HAVING count(*) >= 5""")
def source_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("hit_rate")).where("n >= 5")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


_ENGAGED = """WITH i AS (SELECT source, count(*) AS items FROM documents GROUP BY 1), r AS (
  SELECT source, count(*) AS rated, sum(CAST(quality AS BIGINT)) AS engaged FROM documents JOIN labels USING (doc_id) GROUP BY 1
), e AS (SELECT source, items, CAST(coalesce(rated, 0) AS BIGINT) AS rated, CAST(coalesce(engaged, 0) AS BIGINT) AS engaged,
  round(coalesce(engaged, 0) / items, 6) AS rate FROM i LEFT JOIN r USING (source))"""


def _engagement(spark: SparkSession, d: str) -> DataFrame:
    return analytics.engagement(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source", "quality")


@query(f"{_ENGAGED} SELECT * FROM e")
def source_engagement(spark: SparkSession, d: str) -> DataFrame:
    return _engagement(spark, d)


@query(f"""{_ENGAGED}, o AS (SELECT *, sum(engaged) OVER () / sum(items) OVER () AS overall FROM e), k AS (
  SELECT *, CASE WHEN items >= 10 AND rate < 0.05 THEN 'over_scored' WHEN rate > 0.5 AND rate > 2 * overall THEN 'under_scored' ELSE 'normal' END AS kind FROM o)
SELECT source, items, rate, kind, round(CASE kind WHEN 'over_scored' THEN -least(0.2 * (1 - rate / 0.05), 0.2) WHEN 'under_scored' THEN least((rate - overall) * 0.3, 0.15) ELSE 0.0 END, 6) AS adjustment FROM k""")
def anti_patterns(spark: SparkSession, d: str) -> DataFrame:
    return analytics.anti_patterns(_engagement(spark, d), "source", 10)


@query("""SELECT source, count(*) AS n, round(avg(CAST(quality AS DOUBLE)) - 1.0, 6) AS delta, round(least(count(*) / 20.0, 1.0), 6) AS confidence
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def calibration_delta(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("double")) - 1.0, 6).alias("delta"), F.round(F.least(F.count("*") / 20.0, F.lit(1.0)), 6).alias("confidence"))


_PREDICTED = "SELECT l.*, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS p FROM labels l JOIN documents USING (doc_id)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"))
    return table(spark, d, "labels").join(docs, "doc_id")


@query(f"SELECT count(*) AS n, round(avg(pow(p - quality, 2)), 6) AS brier FROM ({_PREDICTED})")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("quality"), F.lit(2))), 6).alias("brier"))


@query(f"""WITH b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(quality AS DOUBLE)) AS my FROM ({_PREDICTED}) GROUP BY 1)
SELECT bin, n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y, round(abs(mp - my) * n / sum(n) OVER (), 6) AS part FROM b""")
def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    return analytics.ece(_predicted(spark, d), "p", "quality", 10)


@query(f"""WITH c AS (SELECT CAST(count(*) FILTER (p >= 0.5 AND quality = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (p >= 0.5 AND quality <> 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (p < 0.5 AND quality <> 1) AS BIGINT) AS tn, CAST(count(*) FILTER (p < 0.5 AND quality = 1) AS BIGINT) AS fn FROM ({_PREDICTED}))
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return analytics.confusion(_predicted(spark, d), "p", "quality", 0.5)


@query("SELECT lower(event_type) AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def json_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.lower("event_type").alias("event_type"), k.alias("k")).agg(F.count("*").alias("n")).where("n >= 3")


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), w AS (
  SELECT *, avg(n) OVER x AS mean, stddev_pop(n) OVER x AS sd, count(*) OVER x AS seen FROM c
  WINDOW x AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n AS count, round(CASE WHEN seen >= 3 AND sd > 0 THEN (n - mean) / sd END, 6) AS z,
  coalesce(abs(CASE WHEN seen >= 3 AND sd > 0 THEN (n - mean) / sd END) > 2, false) AS abnormal FROM w""")
def daily_volume_z(spark: SparkSession, d: str) -> DataFrame:
    return analytics.volume_anomalies(table(spark, d, "events"), "event_type", "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(lag(ts) OVER w) - epoch_us(ts) > 30 * 60000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 30).select("event_id", "user_id", F.col("session").cast("long").alias("session"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, s""")
def session_merge_60m(spark: SparkSession, d: str) -> DataFrame:
    return sequences.merge_windows(table(spark, d, "events"), ["user_id"], "ts", 60).select("user_id", stamp("first_ts").alias("first_us"), stamp("last_ts").alias("last_us"), "n")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM d)
SELECT user_id, strftime(min(day), '%Y-%m-%d') AS first_day, count(*) AS days FROM i GROUP BY user_id, g""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return sequences.streaks(table(spark, d, "events"), "user_id", "ts").select("user_id", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "days")


_INTERVALS = """SELECT user_id, event_id, row_number() OVER w - 1 AS idx, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000.0 AS interval
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(f"SELECT user_id, event_id, CAST(idx AS INTEGER) AS idx, round(interval, 6) AS interval FROM ({_INTERVALS})")
def chain_intervals(spark: SparkSession, d: str) -> DataFrame:
    return sequences.intervals(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "idx", F.round("interval", 6).alias("interval"))


@query(f"""WITH c AS (SELECT user_id, count(*) AS links, regr_slope(interval, idx) AS slope, avg(interval) AS mean, stddev_pop(interval) AS sd FROM ({_INTERVALS}) GROUP BY 1)
SELECT user_id, links, round(slope, 6) AS slope, round(mean, 6) AS mean, round(least(0.6 * least(links / 6, 1.0) + 0.4 * greatest(1 - CASE WHEN mean > 0 THEN sd / mean ELSE 1.0 END, 0.0), 0.85), 6) AS confidence,
  CASE WHEN links < 3 THEN 'nascent' WHEN slope < 0 THEN 'accelerating' WHEN mean > 72 THEN 'fading' ELSE 'steady' END AS phase FROM c""")
def chain_shape(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.chain_shape(table(spark, d, "events"), "user_id", "ts", "event_id")
    return out.select("user_id", "links", *[F.round(c, 6).alias(c) for c in ("slope", "mean", "confidence")], "phase")


@query("""SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY event_type) >= 3 THEN 0.8 * value + 0.2 * row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type) ELSE value END, 6) AS blended FROM events""")
def percentile_norm(spark: SparkSession, d: str) -> DataFrame:
    return ranking.blended_rank(table(spark, d, "events"), "event_type", "value", "event_id").select("event_id", F.round("blended", 6).alias("blended"))


@query("""SELECT event_id, round(CASE WHEN r > 2 THEN value * pow(0.85, r - 2) ELSE value END, 6) AS decayed FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, json_extract(props, '$.k') ORDER BY value DESC, event_id) AS r FROM events)""")
def source_topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("topic", F.get_json_object("props", "$.k"))
    return ranking.repeat_decay(e, ["event_type", "topic"], "value", "event_id").select("event_id", F.round("decayed", 6).alias("decayed"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def retention_keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    return sinks.keep_last(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("event_id")


@query("""WITH o AS (SELECT event_id, event_type, value, ts FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) END AS event_type, value + 1 AS value, ts + INTERVAL 1 HOUR AS ts FROM events WHERE event_id % 5 <> 0)
SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.event_type, o.event_type) AS event_type, round(CASE WHEN n.event_id IS NOT NULL THEN n.value ELSE o.value END, 6) AS value, epoch_us(coalesce(o.ts, n.ts)) AS ts_us
FROM o FULL JOIN n ON o.event_id = n.event_id""")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.where("event_id % 3 <> 0").select("event_id", "event_type", "value", "ts")
    new = e.where("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).alias("event_type"), (F.col("value") + 1).alias("value"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return sinks.upsert(old, new, ["event_id"], keep_old_first=("ts",), fill=("event_type",)).select("event_id", "event_type", F.round("value", 6).alias("value"), stamp("ts").alias("ts_us"))


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value < 5 AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY value, ts, event_id LIMIT 100)""")
def prune_noise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return sinks.prune_noise(e, "value", "ts", "event_id", 5.0, newest(spark, d) - F.expr("INTERVAL 7 DAYS"), 100).select("event_id")


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS projects, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS project_list FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2""")
def cross_project_packages(spark: SparkSession, d: str) -> DataFrame:
    return matching.shared_packages(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT l_partkey AS package FROM lineitem UNION SELECT p_partkey FROM part")
def union_distinct_deps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("package")).union(table(spark, d, "part").select("p_partkey")).distinct()


_ADVISORIES = [("A1", "small ring", "ECONOMY", "0.0.0", "5.1.0", None), ("A2", "red widget", "ECONOMY", "2.0.0", None, "9.3.2"), ("A3", "SMALL ring", "STANDARD", "1.0.0", "3.0.0", None), ("A4", "large bolt", "PROMO", None, "20.0.0", None)]


@query("""WITH a(advisory_id, package, ecosystem, lo, hi, last) AS (VALUES ('A1', 'small ring', 'ECONOMY', 0, 501, NULL), ('A2', 'red widget', 'ECONOMY', 200, NULL, 903), ('A3', 'small ring', 'STANDARD', 100, 300, NULL), ('A4', 'large bolt', 'PROMO', NULL, 2000, NULL)), p AS (
  SELECT p_partkey, lower(p_name) AS name, p_type, p_size * 100 + p_partkey % 10 AS v FROM part)
SELECT p_partkey, advisory_id FROM p JOIN a ON p.name = a.package AND p.p_type = a.ecosystem WHERE (lo IS NULL OR v >= lo) AND CASE WHEN hi IS NOT NULL THEN v < hi - hi % 100 + (hi % 100) * 1 WHEN last IS NOT NULL THEN v <= last ELSE true END""")
def advisory_version_range(spark: SparkSession, d: str) -> DataFrame:
    advisories = spark.createDataFrame(_ADVISORIES, "advisory_id string, package string, ecosystem string, introduced string, fixed string, last string")
    deps = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("ecosystem"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.lit("0")).alias("version"))
    found = matching.matched_advisories(deps.drop("p_partkey").distinct(), advisories.withColumn("package", F.lower("package")))
    return deps.join(found.select("name", "ecosystem", "version", "advisory_id"), ["name", "ecosystem", "version"]).select("p_partkey", "advisory_id")


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT s.event_id, s.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS incident_id FROM s LEFT JOIN e ON s.user_id = e.user_id AND e.ts > s.ts GROUP BY 1, 2""")
def asof_incident(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    signups = e.where("event_type = 'signup'").drop("event_type")
    return sequences.first_after(signups, e.where("event_type = 'error'"), "user_id", "ts", "ts", "event_id").select("event_id", "user_id", "incident_id")


@query("""SELECT a.event_id, b.event_id AS later_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 48 HOURS WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def interval_pairing_48h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return matching.paired_within(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", 48).select("event_id", "later_id")


@query("""WITH b AS (SELECT event_id, value, CASE WHEN event_type IN ('view', 'click') THEN 'core' WHEN event_type = 'purchase' THEN 'adjacent' ELSE 'other' END AS bucket FROM events), r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, event_id) AS in_bucket FROM b), q AS (
  SELECT *, in_bucket <= CASE bucket WHEN 'core' THEN 14 WHEN 'adjacent' THEN 4 ELSE 2 END AS in_quota FROM r WHERE in_bucket <= 20)
SELECT event_id, bucket, in_quota FROM q ORDER BY in_quota DESC, value DESC, event_id LIMIT 20""")
def composition_floors(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("event_type").isin("view", "click"), "core").when(F.col("event_type") == "purchase", "adjacent").otherwise("other")
    e = table(spark, d, "events").withColumn("bucket", bucket)
    return ranking.with_quotas(e, "bucket", "value", "event_id", {"core": 14, "adjacent": 4, "other": 2}, 20).select("event_id", "bucket", "in_quota")


@query("""WITH c AS (SELECT user_id % 20 AS domain, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS good, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS bad FROM events GROUP BY 1, 2)
SELECT *, CASE WHEN good + bad >= 5 THEN round(good / (good + bad), 6) END AS precision FROM c""")
def trust_precision(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("domain", F.col("user_id") % 20)
    return analytics.precision_by_period(e, "domain", "ts", F.col("event_type") == "purchase", F.col("event_type") == "error").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(f"""WITH t AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS topic, count(*) AS mentions, count(DISTINCT event_type) AS sources, (epoch_us({NOW}) - epoch_us(max(ts))) / 3600000000.0 AS age, count(*) FILTER (event_type = 'click') AS hits FROM events GROUP BY 1)
SELECT topic, mentions, sources, round(greatest(ln(mentions + 1) + 0.5 * sources + CASE WHEN age < 24 THEN 1.0 WHEN age < 72 THEN 0.5 ELSE -least(age / 168, 2.0) END + 2.0 * hits, 0.0), 6) AS hotness FROM t""")
def hotness(spark: SparkSession, d: str) -> DataFrame:
    now = newest(spark, d)
    t = table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("topic")).agg(F.count("*").alias("mentions"), F.countDistinct("event_type").alias("sources"), F.max("ts").alias("last"), F.sum((F.col("event_type") == "click").cast("long")).alias("hits"))
    return t.select("topic", "mentions", "sources", F.round(numeric.hotness(F.col("mentions"), F.col("sources"), numeric.hours(now, F.col("last")), F.col("hits")), 6).alias("hotness"))


@query(f"""WITH s AS (SELECT user_id, count(*) AS evidence, round(least(sum(CASE WHEN event_type = 'purchase' THEN 2.0 ELSE 1.0 END * exp(-((epoch_us({NOW}) - epoch_us(ts)) / 3600000000.0) / 168.0)), 10.0), 6) AS stability FROM events GROUP BY 1)
SELECT *, CASE WHEN stability >= 1.5 THEN 'stable' WHEN stability >= 0.7 THEN 'emerging' WHEN stability >= 0.4 THEN 'candidate' ELSE 'dropped' END AS state FROM s""")
def decay_stability(spark: SparkSession, d: str) -> DataFrame:
    return analytics.stability(table(spark, d, "events"), "user_id", "ts", newest(spark, d), 168.0, F.when(F.col("event_type") == "purchase", 2.0).otherwise(1.0))


@query(f"""WITH a AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS topic, (epoch_us({NOW}) - epoch_us(ts)) / 3600000000.0 AS age FROM events), c AS (
  SELECT topic, CAST(count(*) FILTER (age < 24) AS BIGINT) AS young, CAST(count(*) FILTER (age >= 24 AND age < 72) AS BIGINT) AS mid, CAST(count(*) FILTER (age >= 72) AS BIGINT) AS old FROM a GROUP BY 1)
SELECT *, CASE WHEN young > 0.6 * (young + mid + old) THEN 24 WHEN old > 0.4 * (young + mid + old) THEN 168 ELSE 72 END AS half_life FROM c""")
def topic_half_life(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("topic", F.get_json_object("props", "$.k").cast("long"))
    return analytics.half_life(e, "topic", "ts", newest(spark, d))


@query(f"""SELECT event_id, CASE WHEN age < 1 THEN 1.1 WHEN age < 6 THEN 1.08 WHEN age < 24 THEN 1.05 WHEN age < 72 THEN 1.0 WHEN age < 168 THEN 0.92 WHEN age < 720 THEN 0.85 ELSE 0.8 END::DOUBLE AS freshness
FROM (SELECT event_id, (epoch_us({NOW}) - epoch_us(ts)) / 3600000000.0 AS age FROM events)""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scoring.freshness(numeric.hours(newest(spark, d), F.col("ts"))).alias("freshness"))


@query("""WITH f AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), l AS (
  SELECT user_id, max(run) AS last, max(ts) AS now FROM f GROUP BY 1), t AS (SELECT user_id, count(*) AS failures, max(ts) AS last_failure FROM f JOIN l USING (user_id) WHERE failed AND run = last GROUP BY 1)
SELECT user_id, coalesce(failures, 0) AS failures, coalesce(failures >= 2 AND epoch_us(now) - epoch_us(last_failure) < 600000000, false) AS is_open FROM l LEFT JOIN t USING (user_id)""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return sequences.breaker_states(e, "user_id", "ts", "event_id", "failed", opens_at=2)


@query("""WITH s AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1)
SELECT event_type, n, CAST(CASE WHEN n < 200 THEN 60 ELSE round(60 * greatest(0.1, least(r / 0.25, 1.0))) END AS INTEGER) AS cap FROM s""")
def fetch_caps(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("r"))
    return s.select("event_type", "n", readers.fetch_cap(60, F.col("n"), F.col("r"), F.col("event_type")).alias("cap"))


@query("""WITH w AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS topic, date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1, 2)
SELECT topic, strftime(week, '%Y-%m-%d') AS week, n, n - lag(n) OVER (PARTITION BY topic ORDER BY week) AS change FROM w""")
def weekly_trend(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("topic"), F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("topic").orderBy("week"))
    return w.select("topic", F.date_format("week", "yyyy-MM-dd").alias("week"), "n", change.alias("change"))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS tech, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def adoption_curves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("tech")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS r FROM d)
SELECT user_id, CAST(floor((r - 1) / 7) AS BIGINT) AS seal, CAST(sum(n) AS BIGINT) AS items, strftime(min(day), '%Y-%m-%d') AS first_day FROM r GROUP BY 1, 2 HAVING count(*) = 7""")
def weekly_seals(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    seal = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1) / 7)
    return days.withColumn("seal", seal).groupBy("user_id", "seal").agg(F.sum("n").alias("items"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.count("*").alias("_d")).where("_d = 7").drop("_d")


@query("""SELECT o_custkey, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1 HAVING count(*) >= 5 ORDER BY revenue DESC, o_custkey LIMIT 50""")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    out = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.where("orders >= 5").orderBy(F.desc("revenue"), "o_custkey").limit(50)
