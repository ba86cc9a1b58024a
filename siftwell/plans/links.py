"""Registered queries on topics, links to dependencies, near-duplicate headings, graphs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import analytics, dedup, graph, links, stories, topics
from siftwell.plans.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _names(values: tuple[str, ...]) -> str:
    return ", ".join(map(_q, values))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_BODY = r"regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')"
_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\pL\pN]+'), lambda w: w <> '')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), body.alias("body"))


_TOPICS_OF_PAGES = rf"""WITH p AS (SELECT page_id, {_TITLE} AS title, lower({_TITLE} || ' ' || {_BODY}) AS t, string_split(regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]*)', 1), ',') AS tags FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(t, '[^\pL\pN+#]'), lambda w: w IN ({_names(topics.WORDS)})) AS found, list_filter([{_names(topics.PHRASES)}], lambda p: contains(t, p)) AS phrases,
  list_filter(tags, lambda x: x IN ({_names(topics.WORDS + topics.PHRASES)})) AS tags,
  list_transform(list_filter(list_transform(regexp_split_to_array(title, '\s+'), lambda w: regexp_replace(w, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda w: strlen(w) > 2 AND regexp_matches(w, '^\p{{Lu}}') AND lower(w) NOT IN ({_names(topics.TITLE_STOP_WORDS)})), lambda w: lower(w)) AS capitals FROM p),
t AS (SELECT page_id, list_sort(list_distinct(tags || found || phrases || capitals)) AS topics FROM w)"""


def _topics_of_pages(spark: SparkSession, d: str) -> DataFrame:
    tags = F.split(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([^/?#]*)", 1), ",")
    return pages(spark, d).select("page_id", F.array_sort(topics.topics(F.col("title"), F.col("body"), tags)).alias("topics"))


@query(f"{_TOPICS_OF_PAGES} SELECT page_id, topics FROM t")
def topics_of_pages(spark: SparkSession, d: str) -> DataFrame:
    return _topics_of_pages(spark, d)


@query(f"{_TOPICS_OF_PAGES} SELECT topic, count(*) AS n FROM (SELECT page_id, unnest(topics) AS topic FROM t) GROUP BY 1 HAVING count(*) >= 3")
def trending_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.trending(_topics_of_pages(spark, d), "page_id", "topics")


#: The dictionary: long words of the benchmark, and pairs of neighbouring words.
_BOOK = rf"""WITH b AS (SELECT {_TOKENS.format('text')} AS w FROM benchmark), book AS (
  SELECT DISTINCT phrase, n_words FROM (SELECT unnest(list_filter(w, lambda x: length(x) >= 8)) AS phrase, 1 AS n_words FROM b
  UNION ALL SELECT unnest(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda p: length(p) >= 10)) AS phrase, 2 AS n_words FROM b))"""
_MATCHES = rf"""{_BOOK}, d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), g AS (
  SELECT doc_id, unnest(w) AS phrase, unnest(range(len(w))) AS start, 1 AS n_words FROM d
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), unnest(range(len(w) - 1)), 2 FROM d), m AS (SELECT g.* FROM g JOIN book USING (phrase, n_words)),
k AS (SELECT *, max(start + n_words) OVER (PARTITION BY doc_id ORDER BY start, n_words DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM m),
t AS (SELECT doc_id, phrase, start FROM k WHERE covered IS NULL OR covered < start + n_words)"""


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(text.words(F.col("text")).alias("w"))
    long = F.filter("w", lambda x: F.length(x) >= 8)
    pairs = F.filter(F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))), lambda p: F.length(p) >= 10)
    return w.select(F.explode(F.concat(long, pairs)).alias("phrase")).distinct()


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return topics.dictionary_matches(table(spark, d, "documents"), "doc_id", "text", dictionary(spark, d))


@query(f"{_MATCHES} SELECT doc_id, phrase, count(*) AS n, CAST(min(start) AS INTEGER) AS first FROM t GROUP BY 1, 2")
def dictionary_topics(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query(f"""{_MATCHES}, e AS (SELECT DISTINCT doc_id, phrase AS w, CAST(quality AS DOUBLE) AS q FROM t JOIN labels USING (doc_id)), often AS (SELECT w FROM e GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT e.* FROM e JOIN often USING (w)), p AS (
  SELECT x.w AS a, y.w AS b, count(*) AS n, avg(x.q) AS m FROM x JOIN x y ON x.doc_id = y.doc_id AND x.w < y.w GROUP BY 1, 2)
SELECT a, b, n, round(m, 6) AS quality, round(n * m, 6) AS weight FROM p ORDER BY round(n * m, 6) DESC, a, b LIMIT 500""")
def topic_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rated = _matches(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("q")), "doc_id")
    return analytics.cooccurrence(rated, "doc_id", "phrase", "q", 5, 500)


#: Items about parts: the part's entry in a registry, its order as an advisory, its line as a heading.
_KINDS = ("npm_registry", "crates_io", "pypi", "maven")
_ITEMS = rf"""WITH names AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type <> 'PROMO'), i AS (
  SELECT 3 * p_partkey AS item_id, k AS source_type, CASE k WHEN 'npm_registry' THEN p_name || '@' || p_size || '.0' WHEN 'crates_io' THEN 'crate-' || replace(p_name, ' ', '-') WHEN 'pypi' THEN p_name || '-' || p_size ELSE p_name END AS source_id,
    p_brand || ' ' || p_type AS title, '' AS content, NULL AS content_type FROM (SELECT *, [{_names(_KINDS)}][p_size % 4 + 1] AS k FROM part)
  UNION ALL SELECT 3 * l_orderkey + 1, CASE WHEN max(l_returnflag) = 'R' THEN 'osv' ELSE 'rss' END, '', 'Recall of ' || min(p_name) || ', see order ' || l_orderkey,
    CASE WHEN min(l_linenumber) < 4 THEN 'Advisory' || chr(10) || 'Affected: ' || string_agg(p_name || ' (' || p_type || ')', ', ' ORDER BY l_linenumber, p_partkey) ELSE 'no list' END, CASE WHEN max(l_linestatus) = 'F' THEN 'security_advisory' END
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 4)
    own = F.when(kind == "npm_registry", F.concat("p_name", F.lit("@"), "p_size", F.lit(".0"))).when(kind == "crates_io", F.concat(F.lit("crate-"), F.translate("p_name", " ", "-"))).when(kind == "pypi", F.concat("p_name", F.lit("-"), "p_size")).otherwise(F.col("p_name"))
    entries = part.select((3 * F.col("p_partkey")).alias("item_id"), kind.alias("source_type"), own.alias("source_id"), F.concat_ws(" ", "p_brand", "p_type").alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("content_type"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("one")))), lambda x: x["one"]), ", ")
    orders = lines.agg(F.max("l_returnflag").alias("flag"), F.min("p_name").alias("name"), F.min("l_linenumber").alias("line"), told.alias("told"), F.max("l_linestatus").alias("status"))
    content = F.when(F.col("line") < 4, F.concat(F.lit("Advisory\nAffected: "), "told")).otherwise("no list")
    recalls = orders.select((3 * F.col("l_orderkey") + 1).alias("item_id"), F.when(F.col("flag") == "R", "osv").otherwise("rss").alias("source_type"), F.lit("").alias("source_id"), F.concat(F.lit("Recall of "), "name", F.lit(", see order "), "l_orderkey").alias("title"), content.alias("content"), F.when(F.col("status") == "F", "security_advisory").alias("content_type"))
    return entries.union(recalls)


@query(rf"""{_ITEMS}, a AS (SELECT *, source_type IN ('osv', 'cve') OR coalesce(content_type, '') = 'security_advisory' AS adv, contains(content, 'Affected: ') AS has FROM i),
x AS (SELECT item_id, name, 'exact_registry' AS proof, 0.95::DOUBLE AS confidence FROM a JOIN names ON name = CASE source_type WHEN 'npm_registry' THEN string_split(source_id, '@')[1] WHEN 'pypi' THEN regexp_replace(source_id, '-[0-9]+$', '') WHEN 'maven' THEN source_id END
  UNION ALL SELECT a.item_id, name, 'advisory', 0.90 FROM (SELECT DISTINCT item_id, unnest(list_transform(string_split(regexp_extract(content, 'Affected: (.*)', 1), ','), lambda t: trim(regexp_replace(trim(t), ' \(.*$', '')))) AS name FROM a WHERE adv AND has) a JOIN names USING (name)
  UNION ALL SELECT item_id, name, CASE WHEN adv THEN 'advisory' ELSE 'title_heuristic' END, CASE WHEN adv THEN 0.75 ELSE 0.5 END FROM a JOIN names ON contains(' ' || lower(title) || ' ', ' ' || name || ',') WHERE NOT (adv AND has))
SELECT item_id, name, arg_max(proof, confidence) AS proof, max(confidence) AS confidence FROM x GROUP BY 1, 2""")
def dependency_links(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").where("p_type <> 'PROMO'").select(F.col("p_name").alias("name"))
    return links.dependency_links(_items(spark, d), names)


def _greedy(nodes: str, links: str) -> str:
    """Common tables that walk nodes (id, r) from r = 1 on over links (a, b) in both directions; the last, `heads`, has (id, kept_id)."""
    return f"""nodes AS ({nodes}), links AS ({links}), near AS (SELECT x.r, list(y.r) AS near FROM links JOIN nodes x ON x.id = links.a JOIN nodes y ON y.id = links.b GROUP BY 1), turn AS (SELECT *, row_number() OVER (ORDER BY r) AS t FROM near),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(near, kept)) > 0 THEN kept ELSE list_append(kept, r) END FROM walk JOIN turn ON turn.t = i + 1),
kept AS (SELECT arg_max(kept, i) AS kept FROM walk), heads AS (SELECT n.id, coalesce(h.id, n.id) AS kept_id FROM nodes n LEFT JOIN (SELECT near.r, CASE WHEN list_contains(kept, near.r) THEN near.r ELSE list_min(list_intersect(near, kept)) END AS head FROM near, kept) k ON k.r = n.r LEFT JOIN nodes h ON h.r = k.head)"""


_HEADINGS = rf"""h AS (SELECT page_id AS id, length({_BODY}) AS score, trim(regexp_replace(regexp_replace(lower({_TITLE}), '[^\pL\pN\s_-]+', '', 'g'), '[\s_-]+', ' ', 'g')) AS t FROM pages),
s AS (SELECT *, string_split(t, ' ') AS w FROM h WHERE t <> ''), x AS (SELECT *, list_filter(w, lambda v: NOT regexp_matches(v, '^[0-9]+$')) AS plain, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS two FROM s)"""


@query(f"""WITH RECURSIVE {_HEADINGS}, {_greedy("SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM h", """SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.id <> b.id WHERE (strlen(a.t) >= 10 AND strlen(b.t) >= 10 AND abs(strlen(a.t) - strlen(b.t)) <= 200 AND (starts_with(a.t, b.t) OR starts_with(b.t, a.t)))
  OR (len(a.plain) >= 2 AND a.plain = b.plain) OR len(list_intersect(a.two, b.two)) >= 0.55 * len(list_distinct(a.two || b.two))""")} SELECT id, kept_id FROM heads""")
def briefing_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dedup.briefing(pages(spark, d).withColumn("score", F.length("body")), "page_id", "title", "score")


_PAIR_SETS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3))"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, {_PAIR_SETS} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM w), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= 0.65 * (any_value(a.n) + any_value(b.n) - count(*))),
{_greedy("SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents", "SELECT a, b FROM p")} SELECT id, kept_id, (SELECT count(*) FROM heads x WHERE x.kept_id = heads.id AND x.id <> heads.id) AS similar_count FROM heads""")
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", text.ascii_words(F.col("text"), 3).alias("w"))
    return dedup.fuzzy(docs, "doc_id", "w", "n_chars")


_MUTUAL = """WITH RECURSIVE k AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), n AS (
  SELECT * FROM k WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, id) <= 3), m AS (
  SELECT x.q AS a, x.id AS b, x.c AS weight FROM n x JOIN n y ON x.q = y.id AND x.id = y.q WHERE x.q < x.id)"""


def mutual(spark: SparkSession, d: str) -> DataFrame:
    return graph.mutual_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 0.3)


@query(f"""{_MUTUAL}, e AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS r FROM m), s AS (SELECT r, a AS x, b AS y FROM e UNION ALL SELECT r, b, a FROM e),
reach AS (SELECT r, a AS at FROM e UNION SELECT reach.r, s.y FROM reach JOIN s ON s.x = reach.at AND s.r < reach.r),
forest AS (SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = e.r AND reach.at = e.b)),
best AS (SELECT r FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY r) <= 1)
SELECT a, b, round(weight, 6) AS weight FROM e WHERE (a, b) IN (SELECT a, b FROM forest) OR r IN (SELECT r FROM best)""")
def edge_backbone(spark: SparkSession, d: str) -> DataFrame:
    return graph.sparsified(mutual(spark, d), 1).withColumn("weight", F.round("weight", 6))


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(mutual(spark, d))


_CANDIDATES = f"""v AS (SELECT vec_id AS id, source, lower(regexp_extract(text, '^[^.\\n]*')) AS title, least(n_chars / 2000.0, 1.0) AS score, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = doc_id WHERE n_chars >= 400),
c AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '' AND w NOT IN ({_names(stories.LIGHT)})), lambda w: CASE WHEN regexp_matches(w, '^[0-9v]') THEN regexp_replace(w, '\\..*$', '') ELSE w END)) AS w,
  {" OR ".join(f"contains(title, '{w}')" for w in stories.GOOD)} AS good, {" OR ".join(f"contains(title, '{w}')" for w in stories.BAD)} AS bad FROM v)"""


@query(f"""WITH RECURSIVE {_CANDIDATES}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS cosine, CASE WHEN len(list_distinct(a.w || b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) ELSE 0 END AS shared FROM c a JOIN c b ON a.id <> b.id),
{_greedy("SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM c", "SELECT a, b FROM p WHERE cosine > 0.38 OR (cosine > 0.28 AND shared > 0.04)")}, g AS (SELECT kept_id AS cluster, count(*) AS size, count(DISTINCT source) AS sources, bool_or(good) AND bool_or(bad) AND count(*) > 1 AS mixed FROM heads JOIN c USING (id) GROUP BY 1)
SELECT id, cluster, size, sources, round(least((sources - 1) * 0.05, 0.15), 6)::DOUBLE AS bonus, mixed FROM heads JOIN g ON kept_id = cluster""")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("score"))
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(docs, "id")
    return stories.topic_clusters(items, alike=0.38, close=0.28, shared=0.04)


_STORY_KEYS = """keys AS (SELECT doc_id AS id, 'h:' || lower(regexp_extract(text, '^[^.\\n]*')) AS key FROM documents UNION ALL SELECT doc_id, 'n:' || source || ':' || lang || ':' || n_chars FROM documents)"""


@query(f"""WITH RECURSIVE {_STORY_KEYS}, links AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b USING (key)), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS id, min(b) AS story FROM reach GROUP BY 1""")
def story_collapse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    head = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("h:"), F.lower(F.regexp_extract("text", r"^[^.\n]*", 0))).alias("key"))
    size = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("n:"), "source", F.lit(":"), "lang", F.lit(":"), "n_chars").alias("key"))
    return stories.collapsed(head.union(size), graph.components)
