"""Registered queries on content features and on what feedback says of topics, sources and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import content, numeric
from siftwell.functions.text import ascii_words
from siftwell.operators import feedback
from siftwell.plans.common import newest, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Titles that the items of a table take in turn, as their texts are invented words.
TITLES = (
    "CVE-2025-1234: Critical RCE in OpenSSL 3.0", "Security update for critical auth bug", "React 19.2 released with new compiler", "Breaking change: Node drops support for v16", "We're hiring a Rust developer",
    "Engineer career switch after ten years", "I built a tiny database in Zig", "Show HN: offline maps for cyclists", "He just crawled through hell to fix it", "You won't believe these 10 tricks!!",
    "How do I choose a queue?", "Error when building the image", "My cluster stopped working, any ideas?", "How to deploy Postgres at home", "Getting started with Kafka for beginners", "★ awesome-python roadmap",
    "Postgres vs MySQL: benchmark of write latency", "10 things about Docker", "THIS IS HUGE NEWS FOR EVERYONE", "A complete guide to memory ordering", "Introduction to lock-free queues", "Interesting thoughts on typing?", "The release notes of v2.5 beta", "Cutting p99 from 900 ms to 12 ms with io_uring",
    "Go 1.24 is out", "Learn Rust from scratch, step by step", "What is consensus", "",
)
_ITEMS = "(SELECT doc_id, source, text, [" + ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES) + f"][doc_id % {len(TITLES)} + 1] AS title FROM documents)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, d: str) -> DataFrame:
    titles = F.array(*map(F.lit, TITLES))
    return table(spark, d, "documents").select("doc_id", "source", "text", F.element_at(titles, (F.col("doc_id") % len(TITLES) + 1).cast("int")).alias("title"))


def _held(column: str, phrases: tuple[str, ...]) -> str:
    return "(false" + "".join(f" OR contains({column}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def _n_held(column: str, phrases: tuple[str, ...]) -> str:
    return "(0" + "".join(f" + contains({column}, '" + p.replace("'", "''") + "')::INT" for p in phrases) + ")"


def _class_sql(at: int) -> str:
    cases = []
    for c in content.CLASSES:
        q = lambda p: p.replace("'", "''")
        fits = [_held("t", c[2 + 1])] + [f"starts_with(t, '{q(p)}')" for p in c[2]] + [f"ends_with(t, '{q(p)}')" for p in c[4]] + ([f"regexp_matches(t, '{q(c[5])}')"] if c[5] else [])
        if c[0] == "security_advisory":
            fits.append(f"regexp_matches(lower(coalesce(text, '')[1:{content.BODY_START}]), 'cve[- ][0-9]{{4}}')")
        cases.append(f"WHEN {' OR '.join(fits)} THEN " + (f"'{c[0]}'" if at == 0 else str(c[1])))
    last = [content.DEEP_DIVE[at], content.DISCUSSION[at]]
    last = [f"'{x}'" if at == 0 else str(x) for x in last]
    return f"CASE {' '.join(cases)} WHEN strlen(coalesce(text, '')) > {content.DEEP_BYTES} THEN {last[0]} ELSE {last[1]} END"


@query(f"SELECT doc_id, {_class_sql(0)} AS class, CAST({_class_sql(1)} AS DOUBLE) AS factor FROM (SELECT *, lower(title) AS t FROM {_ITEMS})")
def content_classes(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("doc_id", content.content_class(F.col("title"), F.col("text")).alias("c")).select("doc_id", F.col("c.name").alias("class"), "c.factor")


@query(f"""SELECT doc_id, round(greatest(0, least(1, 1e0 - CASE WHEN len(regexp_extract_all(title, '[^ \\t\\n\\r\\f]{{2,}}')) < 4 THEN 0.35 ELSE 0 END
  - CASE WHEN len(regexp_replace(title, '[^\\pL]', '', 'g')) >= 5 AND len(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) * 2 > len(regexp_replace(title, '[^\\pL]', '', 'g')) THEN 0.3 ELSE 0 END
  - CASE WHEN len(title) - len(replace(title, '!', '')) > 1 OR len(title) - len(replace(title, '?', '')) > 2 THEN 0.2 ELSE 0 END - CASE WHEN {_held('t', content.BAIT)} THEN 0.3 ELSE 0 END
  - CASE WHEN regexp_matches(t, '^ *[0-9]+ *(things|ways|tips|reasons|tools|best)') THEN 0.15 ELSE 0 END + CASE WHEN {_held('t', content.EXACT)} THEN 0.1 ELSE 0 END)), 6) AS quality,
  {_held('t', content.STRONG_BAIT)} OR (contains(t, 'this one') AND contains(t, 'trick')) AS bait,
  round(greatest(0, least(1, 5e-1 + CASE WHEN (contains(t, ' v') AND regexp_matches(t, '[0-9]')) OR regexp_matches(t, '[0-9]\\.[0-9]') THEN 0.15 ELSE 0 END + CASE WHEN {_held('t', content.QUANTITIES)} THEN 0.1 ELSE 0 END
  + CASE WHEN {_held('t', content.COMPARISONS)} THEN 0.1 ELSE 0 END + CASE WHEN {_held('t', content.SPECIFIC)} THEN 0.1 ELSE 0 END - CASE WHEN {_held('t', content.VAGUE)} THEN 0.15 ELSE 0 END)), 6) AS facts
FROM (SELECT *, lower(title) AS t FROM {_ITEMS})""")
def title_quality(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return items(spark, d).select("doc_id", F.round(content.title_quality(t), 6).alias("quality"), content.strong_bait(t).alias("bait"), F.round(content.density_of_facts(t), 6).alias("facts"))


@query(f"""SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0.3 ELSE greatest(0, least(1, 3e-1 + CASE WHEN n <= 50 THEN 0.0 WHEN n <= 200 THEN 0.1 WHEN n <= 500 THEN 0.2 WHEN n <= 1000 THEN 0.3 ELSE 0.4 END
  + CASE WHEN {_held('text', content.CODE)} THEN 0.15 ELSE 0 END + CASE WHEN {_held('text', content.STRUCTURE)} THEN 0.1 ELSE 0 END)) END, 6) AS depth
FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM documents)""")
def content_depth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(content.depth(F.col("text")), 6).alias("depth"))


_LEVELS = " ".join(f"WHEN {_n_held('t', p)} > 0 THEN {base} + least({_n_held('t', p)} * {each}, {most})" for base, each, most, p in content.INTRO)


@query(f"""SELECT doc_id, round(least(c + CASE WHEN c < 1 AND {_n_held('b', content.INTRO_BODY)} >= 2 THEN 0.3 ELSE 0 END, 1.0), 6) AS confidence
FROM (SELECT *, CASE {_LEVELS} ELSE 0e0 END AS c FROM (SELECT doc_id, lower(title) AS t, lower(coalesce(text, '')) AS b FROM {_ITEMS}))""")
def intro_confidence(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("doc_id", F.round(content.intro_confidence(F.col("title"), F.col("text")), 6).alias("confidence"))


_SOURCES, _ALIASES = ("cve", "arxiv", "github", "rss", "devto", "elsewhere"), ("JavaScript", " rust", "pip", "golang", "Kotlin", "c#", "composer", "gem", "Flutter", "swift")


@query(f"""SELECT doc_id, CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 5e-1 END AS authority,
  ['npm', 'crates.io', 'PyPI', 'Go', 'Maven', 'NuGet', 'Packagist', 'RubyGems', 'Pub', 'swift'][n_chars % {len(_ALIASES)} + 1] AS ecosystem FROM (SELECT doc_id, n_chars, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % {len(_SOURCES)} AS i FROM documents)""")
def authority_and_ecosystem(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    source = pick(_SOURCES, F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return table(spark, d, "documents").select("doc_id", content.authority(source).alias("authority"), content.ecosystem(pick(_ALIASES, F.col("n_chars"))).alias("ecosystem"))


#: Requirements, and the versions from and below which they hold, as major * 10^6 + minor * 10^3 + patch.
_REQUIREMENTS = (("< 4.17.21", 0, 4017021), (">= 2.0.0, < 2.1.5", 2000000, 2001005), ("= 1.2.3", 1002003, 1002004), ("^1.2.3", 1002003, 2000000), ("~1.2", 1002000, 1003000), ("> 1", 2000000, 10**9), ("<= 1.2", 0, 1003000), ("^0.3.1", 3001, 4000), ("1.4", 1004000, 2000000), ("", 0, 10**9))


@query("WITH r(req, low, high) AS (VALUES " + ", ".join(f"('{r}', {a}, {b})" for r, a, b in _REQUIREMENTS) + """),
v AS (SELECT DISTINCT p_partkey % 5 AS a, p_size % 5 AS b, p_partkey % 23 AS c FROM part)
SELECT a || '.' || b || '.' || c AS version, req, a * 1000000 + b * 1000 + c >= low AND a * 1000000 + b * 1000 + c < high AS met FROM v, r""")
def version_requirements(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select(F.concat_ws(".", (F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 23).cast("string")).alias("version")).distinct()
    rows = v.withColumn("req", F.explode(F.array(*[F.lit(r) for r, _, _ in _REQUIREMENTS])))
    return rows.select("version", "req", content.meets(F.col("version"), F.col("req")).alias("met"))


_NEED = "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN least(value / 100.0, 1.0) ELSE 0.0 END AS dep, CASE event_id % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' END AS severity, CASE event_type WHEN 'error' THEN 'security_alert' WHEN 'signup' THEN 'deprecation' END AS signal, CASE event_type WHEN 'purchase' THEN 'breaking_change' WHEN 'click' THEN 'release_notes' END AS content, user_id % 8 AS projects, (event_id % 4) / 10.0 AS gap, (event_id % 5) / 10.0 AS win, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600000000.0 AS age, event_id % 11 <> 0 AS affected FROM events"


@query(f"""WITH s AS (SELECT *, signal = 'security_alert' OR severity IS NOT NULL AS sec, content = 'breaking_change' AS brk FROM ({_NEED})), p AS (SELECT *, CASE WHEN sec THEN 's' WHEN brk THEN 'b' WHEN signal = 'deprecation' AND dep > 0 THEN 'd' WHEN content = 'release_notes' AND dep > 0 THEN 'r' WHEN win > 0.1 THEN 'w' WHEN gap > 0.1 THEN 'g' ELSE 'n' END AS path, lower(coalesce(severity, 'medium')) AS lev FROM s),
b AS (SELECT *, CASE path WHEN 's' THEN CASE WHEN NOT affected THEN 0.15 WHEN dep > 0 THEN CASE lev WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.85 ELSE 0.6 END ELSE CASE lev WHEN 'critical' THEN 0.4 WHEN 'high' THEN 0.3 ELSE 0.2 END END WHEN 'b' THEN CASE WHEN dep > 0 THEN 0.8 ELSE 0.25 END WHEN 'd' THEN 0.65 WHEN 'r' THEN least(0.45 + dep * 0.2, 0.65) WHEN 'w' THEN 0.5 + win WHEN 'g' THEN 0.4 + gap ELSE 0.0 END AS base FROM p)
SELECT event_id, round(least(1.0, base * CASE WHEN projects > 1 THEN least(1 + (projects - 1) * 0.1, 1.5) ELSE 1 END * CASE WHEN path <> 's' AND age > 0 THEN greatest(0.5, 1 - age / 168.0) ELSE 1 END), 6) AS score,
  CASE path WHEN 's' THEN 'security_vulnerability' WHEN 'b' THEN 'breaking_change' WHEN 'd' THEN 'deprecation_notice' WHEN 'r' THEN 'ecosystem_shift' WHEN 'w' THEN 'decision_relevant' WHEN 'g' THEN 'blind_spot' ELSE 'none' END AS category,
  CASE WHEN path = 's' AND affected AND dep > 0 AND lev = 'critical' THEN 'immediate' WHEN path = 's' AND affected AND dep > 0 AND lev = 'high' THEN 'this_week' WHEN path = 'd' OR (path = 'b' AND dep > 0) THEN 'this_week' WHEN path = 'n' THEN 'none' ELSE 'awareness' END AS urgency FROM b""")
def necessity(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    score = content.necessity(
        dep=F.when(F.col("user_id") % 3 == 0, F.least(F.col("value") / 100.0, F.lit(1.0))).otherwise(0.0), severity=F.when(n % 7 == 0, "CRITICAL").when(n % 7 == 1, "high"),
        signal=F.when(kind == "error", "security_alert").when(kind == "signup", "deprecation"), content=F.when(kind == "purchase", "breaking_change").when(kind == "click", "release_notes"),
        projects=F.col("user_id") % 8, gap=(n % 4) / 10.0, window=(n % 5) / 10.0, named=F.lit(True), age_hours=numeric.hours(newest(spark, d), F.col("ts")), grounded=F.lit(True), affected=n % 11 != 0)
    return table(spark, d, "events").select("event_id", score.alias("s")).select("event_id", F.round("s.score", 6).alias("score"), "s.category", "s.urgency")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Events with a topic (props.k) and the signal that their type is."""
    signal = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "error", -0.8).otherwise(0.0)
    return table(spark, d, "events").select("*", F.get_json_object("props", "$.k").alias("topic"), signal.alias("signal"))


_TOPICS = "(SELECT *, props->>'$.k' AS topic, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN -0.8 ELSE 0.0 END AS signal FROM events)"


@query(f"""SELECT topic, count(*) AS n, round((avg(CASE WHEN signal > 0 THEN 1.0 ELSE 0.0 END) - 0.5) * 0.6 + avg(signal) * 0.4, 6) AS delta, round(least(count(*) / 15, 1.0), 6) AS confidence FROM {_TOPICS} WHERE topic IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def accuracy_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return feedback.accuracy(topics(spark, d), "topic", "signal")


_WORDS = "(SELECT p_partkey, p_brand, p_type, p_size, unnest(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 3))) AS word FROM part)"


def part_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.explode(F.array_distinct(ascii_words(F.col("p_name"), 3))).alias("word"))


@query(f"""WITH e AS (SELECT l_partkey AS p_partkey, max(l_quantity) > 45 AS engaged FROM lineitem GROUP BY 1)
SELECT word, count(*) AS n, round(avg(CASE WHEN coalesce(engaged, false) THEN 1.0 ELSE 0.0 END) - 1, 6) AS delta, round(least(count(*) / 10, 1.0), 6) AS confidence FROM {_WORDS} LEFT JOIN e USING (p_partkey) GROUP BY 1 HAVING count(*) >= 3""")
def calibration_by_topic(spark: SparkSession, d: str) -> DataFrame:
    engaged = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_quantity") > 45).alias("engaged"))
    return feedback.calibration(part_words(spark, d).join(engaged, "p_partkey", "left"), "word", "engaged")


@query(f"""SELECT word, p_type, count(*) AS n, round(avg(CASE WHEN p_size < 38 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(least((avg(CASE WHEN p_size < 38 THEN 1.0 ELSE 0.0 END) - 0.5) * 0.5, 0.25), 6) AS penalty FROM {_WORDS} GROUP BY 1, 2
HAVING count(*) >= 8 AND avg(CASE WHEN p_size < 38 THEN 1.0 ELSE 0.0 END) >= 0.7""")
def dismissal_archetypes(spark: SparkSession, d: str) -> DataFrame:
    return feedback.archetypes(part_words(spark, d), ["word", "p_type"], F.col("p_size") < 38)


@query(f"""WITH x AS (SELECT topic, signal, event_type || '-' || user_id % 10 AS title, ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS now FROM {_TOPICS} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
g AS (SELECT topic, list(DISTINCT title) FILTER (now) AS a, list(DISTINCT title) FILTER (NOT now) AS b, avg(signal) FILTER (now) - avg(signal) FILTER (NOT now) AS change FROM x GROUP BY 1),
f AS (SELECT topic, round(1 - len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS drift, CASE WHEN change > 0.05 THEN 'gaining' WHEN change < -0.05 THEN 'losing' ELSE 'changed' END AS direction FROM g WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT * FROM f WHERE drift > 0.5""")
def topic_drift(spark: SparkSession, d: str) -> DataFrame:
    e = topics(spark, d).withColumn("title", F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")))
    return feedback.drift(e, "topic", "title", "signal", "ts", newest(spark, d), days=7)


@query(f"SELECT topic, count(*) AS n, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS wrong, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {_TOPICS} WHERE topic IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
def false_positive_rates(spark: SparkSession, d: str) -> DataFrame:
    return feedback.false_positives(topics(spark, d), "topic", F.col("event_type") == "error")


@query("""SELECT n, round(CASE WHEN n < 20 THEN 0.4 WHEN r > 0.5 THEN 0.38 WHEN r < 0.15 THEN 0.42 ELSE 4e-1 END, 6) AS threshold FROM (SELECT count(*) AS n, avg(CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END) AS r FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)""")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "events").where(F.col("ts") > newest(spark, d) - F.expr("INTERVAL 7 DAYS"))
    return feedback.threshold(recent, F.col("event_type").isin("click", "purchase"), 0.40)


@query("""WITH g AS (SELECT user_id, event_type, least(count(*) / 20, 1.0) AS c, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 86400000000.0 AS days FROM events GROUP BY 1, 2), f AS (SELECT user_id, event_type, CASE WHEN days > 7 THEN c * pow(0.5, days / 60) ELSE c END AS c FROM g)
SELECT user_id, event_type, round(c, 6) AS confidence FROM f WHERE c >= 0.15""")
def technology_decay(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.least(F.count("*") / 20, F.lit(1.0)).alias("c"), F.max("ts").alias("last"))
    c = feedback.decayed(F.col("c"), numeric.hours(newest(spark, d), F.col("last")) / 24)
    return g.select("user_id", "event_type", c.alias("c")).where("c >= 0.15").select("user_id", "event_type", F.round("c", 6).alias("confidence"))


@query("""SELECT event_id, round(CASE event_type WHEN 'click' THEN (0.5 + least(value / 60, 0.5)) * CASE user_id % 3 WHEN 0 THEN -0.4 WHEN 1 THEN 1.1 ELSE 1.0 END WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -0.8 WHEN 'view' THEN 0.3 + 0.4 * (event_id % 11) / 10.0 + least(value / 120, 0.3) ELSE 0.0 END, 6) AS strength FROM events""")
def interaction_strength(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "save").when(kind == "error", "dismiss").when(kind == "view", "complete").otherwise(kind)
    pattern = F.when(F.col("user_id") % 3 == 0, "bounced").when(F.col("user_id") % 3 == 1, "engaged")
    return table(spark, d, "events").select("event_id", F.round(feedback.strength(action, F.col("value"), pattern, (F.col("event_id") % 11) / 10.0), 6).alias("strength"))


@query("""WITH e AS (SELECT user_id, ts, event_type, min(ts) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS done FROM events)
SELECT user_id, count(*) AS resolved, round(avg((epoch_us(done) - epoch_us(ts)) / 3600000000.0), 6) AS hours FROM e WHERE event_type = 'error' AND done IS NOT NULL GROUP BY 1""")
def mean_time_to_resolve(spark: SparkSession, d: str) -> DataFrame:
    return feedback.time_to_resolve(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query("SELECT user_id, count(*) AS n, round((count(*) FILTER (event_type = 'purchase') + 0.5 * count(*) FILTER (event_type = 'click')) / count(*), 6) AS usefulness FROM events GROUP BY 1")
def agent_usefulness(spark: SparkSession, d: str) -> DataFrame:
    return feedback.usefulness(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "click")


@query("""WITH e AS (SELECT user_id, event_type, ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS missed, CASE WHEN event_type = 'click' THEN ts END AS clicked FROM events),
g AS (SELECT user_id, coalesce(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(clicked))) / 86400000000.0), 999) AS days, coalesce(bool_or(missed AND event_type = 'error'), false) AS sec, coalesce(bool_or(missed AND event_type = 'purchase'), false) AS brk,
  sum(CASE WHEN missed THEN CASE event_type WHEN 'error' THEN 3.0 WHEN 'purchase' THEN 2.5 WHEN 'signup' THEN 1.5 ELSE 0.5 END ELSE 0e0 END) AS w FROM e GROUP BY 1), f AS (SELECT *, w * CASE WHEN days >= 999 THEN 1.5 WHEN days > 30 THEN 1.2 ELSE 1.0 END AS score FROM g)
SELECT user_id, round(score, 6) AS score, CASE WHEN sec THEN 'critical' WHEN brk OR score >= 5 THEN 'high' WHEN score >= 2 OR days > 14 THEN 'medium' ELSE 'low' END AS severity FROM f""")
def gap_severity(spark: SparkSession, d: str) -> DataFrame:
    kind, now = F.col("event_type"), newest(spark, d)
    return feedback.gaps(table(spark, d, "events"), "user_id", F.col("ts") > now - F.expr("INTERVAL 3 DAYS"), F.when(kind == "error", "security").when(kind == "purchase", "breaking").when(kind == "signup", "version").otherwise("other"), F.when(kind == "click", F.col("ts")), now)


@query("""SELECT bin, round(bin * 0.2 + 0.1, 6) AS center, count(*) AS n, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT CAST(least(floor(least(greatest(value / 100, 0), 1) / 0.2), 4) AS INT) AS bin, event_type = 'purchase' AS y FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return feedback.curve(table(spark, d, "events").where("value is not null"), F.col("value") / 100, F.col("event_type") == "purchase")


@query("""WITH r AS (SELECT user_id, event_type AS t, 0.5 + 0.5 / (1 + value * 100 / 3000.0) AS power, event_id % 15 AS slot FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
l AS (SELECT user_id, persona, power, t, (1 + (slot * 7 + persona * 3) % 8) / 10.0 AS p FROM r, range(9) AS x(persona)),
s AS (SELECT user_id, persona, sum(power * ln(CASE t WHEN 'purchase' THEN p WHEN 'error' THEN 1 - p ELSE p * p / (p * p + (1 - p) * (1 - p)) END)) AS s FROM l GROUP BY 1, 2), m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS w FROM s)
SELECT user_id, CAST(persona AS BIGINT) AS persona, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS posterior FROM m""")
def persona_posterior(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, d, "events").where(kind.isin("purchase", "error", "signup")).withColumn("answer", F.when(kind == "purchase", "yes").when(kind == "error", "no").otherwise("strong"))
    slots = spark.range(15).select(F.col("id").alias("slot"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: (1 + (F.col("id") * 7 + p * 3) % 8) / 10.0).alias("likelihoods"))
    rows = e.withColumn("slot", F.col("event_id") % 15).join(F.broadcast(slots), "slot")  # 15 rows
    return feedback.personas(rows, "user_id", "answer", "likelihoods", F.col("value") * 100)


_PACKAGES = f"(SELECT topic, max(event_type = 'error') AS critical, bool_or(event_type = 'purchase') AS confirmed, bool_or(event_type = 'signup') AS fixable, count(DISTINCT user_id) AS projects, max(value) AS cvss FROM {_TOPICS} WHERE topic IS NOT NULL GROUP BY 1)"


@query(f"SELECT topic, row_number() OVER (ORDER BY critical DESC, confirmed DESC, fixable DESC, projects DESC, cvss DESC, topic) AS place FROM {_PACKAGES} QUALIFY place <= 50")
def upgrade_order(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    g = topics(spark, d).where("topic is not null").groupBy("topic").agg(F.bool_or(kind == "error").alias("critical"), F.bool_or(kind == "purchase").alias("confirmed"), F.bool_or(kind == "signup").alias("fixable"), F.countDistinct("user_id").alias("projects"), F.max("value").alias("cvss"))
    order = [F.desc(c) for c in ("critical", "confirmed", "fixable", "projects", "cvss")] + [F.asc("topic")]
    return g.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("topic", "place")


@query("SELECT event_id FROM events ORDER BY event_type = 'error', user_id % 2 DESC, value DESC, event_id LIMIT 100")
def excluded_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("event_type") == "error", F.desc(F.col("user_id") % 2), F.desc("value"), "event_id").limit(100).select("event_id")


@query(f"SELECT topic, count(DISTINCT user_id) AS members FROM {_TOPICS} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND topic IS NOT NULL GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def topics_of_members(spark: SparkSession, d: str) -> DataFrame:
    recent = topics(spark, d).where(F.col("topic").isNotNull() & (F.col("ts") >= newest(spark, d) - F.expr("INTERVAL 48 HOURS")))
    return recent.groupBy("topic").agg(F.countDistinct("user_id").alias("members")).where("members >= 3")


@query(f"""WITH u AS (SELECT DISTINCT user_id, topic FROM {_TOPICS} WHERE topic IS NOT NULL), n AS (SELECT topic, count(*) AS projects FROM u GROUP BY 1)
SELECT user_id, count(*) FILTER (projects > 1) AS shared, count(*) FILTER (projects = 1) AS own, round(count(*) FILTER (projects > 1) / count(*), 6) AS convergence FROM u JOIN n USING (topic) GROUP BY 1""")
def project_convergence(spark: SparkSession, d: str) -> DataFrame:
    return feedback.convergence(topics(spark, d).where("topic is not null"), "user_id", "topic")


@query(f"SELECT topic, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM {_TOPICS} WHERE topic IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT CAST(ts AS DATE)) >= 2")
def signal_chains(spark: SparkSession, d: str) -> DataFrame:
    return topics(spark, d).where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days")).where("n >= 2 and days >= 2")


@query(f"SELECT e.event_id, n.n_name FROM {_TOPICS} e JOIN nation n ON CAST(e.topic AS INT) = n.n_nationkey")
def joined_by_cast_key(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")  # 25 rows; Spark broadcasts by its size
    return topics(spark, d).join(n, F.col("topic").try_cast("int") == F.col("n_nationkey")).select("event_id", "n_name")


@query("SELECT round(avg(value), 6) AS mean, max(event_id) AS newest FROM (SELECT value, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def newest_hundred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("event_id").alias("newest"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS value, max(event_id) AS cursor FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1""")
def replicated_state(spark: SparkSession, d: str) -> DataFrame:
    return feedback.last_write(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "value", F.col("at.event_id").alias("cursor"))


@query("SELECT event_type, count(*) AS expired FROM events WHERE ts < (SELECT max(ts) FROM events) - CASE event_type WHEN 'view' THEN INTERVAL 1 DAY WHEN 'click' THEN INTERVAL 7 DAY ELSE INTERVAL 20 DAY END GROUP BY 1")
def expired_by_class(spark: SparkSession, d: str) -> DataFrame:
    days = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 7).otherwise(20)
    age: Column = numeric.hours(newest(spark, d), F.col("ts"))
    return table(spark, d, "events").where(age > days * 24).groupBy("event_type").agg(F.count("*").alias("expired"))


@query("""WITH w AS (SELECT DISTINCT doc_id, source, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2))) AS word FROM documents), s AS (SELECT source, count(DISTINCT doc_id) AS items FROM documents GROUP BY 1)
SELECT source, word, count(*) AS n FROM w JOIN s USING (source) GROUP BY 1, 2, items HAVING items >= 5 AND count(*) >= 0.4 * items""")
def boilerplate_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.array_distinct(ascii_words(F.col("text"), 2)).alias("words"))
    return feedback.common_terms(docs, "source", "doc_id", "words", 0.4, 5)


@query("""SELECT l.user_id, l.day, CAST(sum(r.n) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) l JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) r ON r.user_id = l.user_id AND r.day BETWEEN l.day - 6 AND l.day GROUP BY 1, 2""")
def sliding_week(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).count()
    back = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("user_id", "day", F.sum("count").over(back).alias("n"))
