"""Registered queries on the form of pages, on interests and on competing technology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import content, interest
from siftwell.plans.content import _held
from siftwell.plans.links import _BODY, _TITLE, _names, pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_P = rf"p AS (SELECT page_id, url, {_TITLE} AS title, {_BODY} AS body, lower({_TITLE}) AS t, lower({_BODY}) AS c, lower({_TITLE} || ' ' || {_BODY}) AS x FROM pages)"
_TELLING = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\pL\pN]+'), lambda w: strlen(w) >= 4 AND w NOT IN ({_names(content.EMPTY_WORDS)}))"
_COUNT = "list_max(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda y: y = w))))"


@query(rf"""WITH {_P}, w AS (SELECT *, {_TELLING.format("title")} AS tw, list_distinct({_TELLING.format("body")}) AS bw, list_filter(regexp_split_to_array(t, '[^\pL\pN]+'), lambda w: w <> '') AS words, len(regexp_extract_all(body, '[^ \t\n\r\f]+')) AS n FROM p),
q AS (SELECT *, greatest(0, least(1, 1e0 - CASE WHEN len(regexp_extract_all(title, '[^ \t\n\r\f]{{2,}}')) < 4 THEN 0.35 ELSE 0 END
  - CASE WHEN len(regexp_replace(title, '[^\pL]', '', 'g')) >= 5 AND len(regexp_replace(title, '[^\p{{Lu}}]', '', 'g')) * 2 > len(regexp_replace(title, '[^\pL]', '', 'g')) THEN 0.3 ELSE 0 END
  - CASE WHEN len(title) - len(replace(title, '!', '')) > 1 OR len(title) - len(replace(title, '?', '')) > 2 THEN 0.2 ELSE 0 END - CASE WHEN {_held('t', content.BAIT)} THEN 0.3 ELSE 0 END
  - CASE WHEN regexp_matches(t, '^ *[0-9]+ *(things|ways|tips|reasons|tools|best)') THEN 0.15 ELSE 0 END + CASE WHEN {_held('t', content.EXACT)} THEN 0.1 ELSE 0 END)) AS titled,
  CASE WHEN body = '' THEN 0.3 ELSE greatest(0, least(1, 3e-1 + CASE WHEN n <= 50 THEN 0.0 WHEN n <= 200 THEN 0.1 WHEN n <= 500 THEN 0.2 WHEN n <= 1000 THEN 0.3 ELSE 0.4 END + CASE WHEN {_held('body', content.CODE)} THEN 0.15 ELSE 0 END + CASE WHEN {_held('body', content.STRUCTURE)} THEN 0.1 ELSE 0 END)) END AS deep,
  CASE WHEN {_held('lower(url)', content.TRUSTED)} THEN 1.15 WHEN {_held('lower(url)', content.GATHERED)} THEN 0.85 ELSE 1e0 END AS address,
  greatest(0, least(1, 5e-1 + CASE WHEN (contains(t, ' v') AND regexp_matches(t, '[0-9]')) OR regexp_matches(t, '[0-9]\.[0-9]') THEN 0.15 ELSE 0 END + CASE WHEN {_held('t', content.QUANTITIES)} THEN 0.1 ELSE 0 END + CASE WHEN {_held('t', content.COMPARISONS)} THEN 0.1 ELSE 0 END + CASE WHEN {_held('t', content.SPECIFIC)} THEN 0.1 ELSE 0 END - CASE WHEN {_held('t', content.VAGUE)} THEN 0.15 ELSE 0 END)) AS facts,
  CASE WHEN len(tw) = 0 THEN 0 WHEN {_COUNT.format("tw")} >= 4 THEN -0.2 WHEN {_COUNT.format("tw")} = 3 THEN -0.1 ELSE 0 END AS repeated,
  CASE WHEN len(list_distinct(tw)) < 3 OR len(bw) = 0 THEN 0 WHEN len(list_intersect(tw, bw)) / len(list_distinct(tw)) < 0.3 THEN -0.2 WHEN len(list_intersect(tw, bw)) / len(list_distinct(tw)) < 0.5 THEN -0.1 ELSE 0 END AS unlike,
  CASE WHEN len(words) > 0 AND len(list_distinct(words)) / len(words) < 0.5 THEN -0.15 ELSE 0 END AS few,
  CASE WHEN regexp_matches(ltrim(title), '^[0-9]{{1,3}}/') OR regexp_matches(ltrim(t), '^(day|week|part|episode|chapter|lesson)\s*[0-9]+\s*[·:\-—–|/]') OR contains(title, chr(129525)) OR contains(t, 'a thread') OR contains(t, '(thread)') THEN -0.25 ELSE 0 END AS part FROM w)
SELECT page_id, round(greatest(0.5, least(1.2, (titled * 0.5 + deep * 0.3 + address * 0.2) * 0.7 + 0.5 + (facts - 0.5) * 0.1 + repeated + unlike + few + part)), 6)::DOUBLE AS factor FROM q""")
def quality_factor(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.round(content.quality_factor(F.col("title"), F.col("body"), F.col("url")), 6).alias("factor"))


_STEM = r"regexp_replace(regexp_replace(regexp_replace(w, 'ies$', 'y'), '^(.{{3,}}?)(ing|edly|ed|ly|ers|er)$', '\1'), '^(.{{2,}}[^s])s$', '\1')".replace("{{", "{").replace("}}", "}")


def _away(term: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(x, '{(n + term).replace(chr(39), chr(39) * 2)}')" for n in interest.NEGATIONS) + " THEN 0.5 ELSE 1 END"


def _often(count: str) -> str:
    return f"CASE WHEN {count} <= 1 THEN 1 ELSE least(1 + 0.6 * ({count} / ({count} + 1.2 * (0.25 + 0.75 * size / 150.0))), 1.5) END"


def _word_sql(w: str) -> str:
    n, away = f"len(list_filter(xw, lambda y: y = '{w}'))", _away(w)
    return f"""CASE WHEN list_contains(tw, '{w}') THEN 0.8 * {_often(n)} * {away} WHEN list_contains(xw, '{w}') THEN (0.55 + CASE WHEN list_contains(regexp_split_to_array(left(c, 200), '[^\\pL\\pN]+'), '{w}') THEN 0.1 ELSE 0 END) * {_often(n)} * {away}
  WHEN list_contains(list_transform(list_filter(tw, lambda w: strlen(w) >= 3), lambda w: {_STEM}), '{interest._root(w)}') THEN 0.65 WHEN list_contains(list_transform(list_filter(xw, lambda w: strlen(w) >= 3), lambda w: {_STEM}), '{interest._root(w)}') THEN 0.45 ELSE 0 END"""


_SAME = r"len(regexp_extract_all(replace(x, ' ', '  '), '(?:^|[^\pL\pN])of the(?:$|[^\pL\pN])'))".replace("of the", "de  la")


@query(rf"""WITH {_P}, w AS (SELECT *, regexp_split_to_array(t, '[^\pL\pN]+') AS tw, regexp_split_to_array(x, '[^\pL\pN]+') AS xw, greatest(len(regexp_extract_all(x, '[^ \t\n\r\f]+')), 1) AS size FROM p),
s AS (SELECT page_id, {_word_sql('than')} AS a, {_word_sql('entions')} AS b, CASE WHEN contains(t, 'de la') THEN least(0.95 * {_often(_SAME)}, 1) * {_away('de la')} WHEN contains(x, 'de la') THEN least(0.8 * {_often(_SAME)}, 1) * {_away('de la')} ELSE least(({_word_sql('la')} * 0) / 1, 1) END AS phrase FROM w)
SELECT page_id, round(greatest(0, least(a, 1) * 1.0, least(b, 1) * 0.6, phrase * 0.9), 6)::DOUBLE AS score FROM s""")
def keyword_interest(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"than": 1.0, "entions": 0.6, "de la": 0.9}
    return pages(spark, d).select("page_id", F.round(interest.keyword_interest(F.col("title"), F.col("body"), wanted), 6).alias("score"))


_RIVALS = {"erthe": ("the", "thinand"), "ungen": ("und", "der")}


@query(rf"""WITH {_P}, w AS (SELECT page_id, t, c, regexp_split_to_array(t, '[^\pL\pN]+') AS tw, regexp_split_to_array(c, '[^\pL\pN]+') AS cw FROM p),
m AS (SELECT *, {" OR ".join(f"regexp_matches(t, '(^|[^a-z0-9]){k}($|[^a-z0-9])') OR contains(left(c, 500), '{k}')" for k in interest.COMPARING)} AS compares FROM w),
k AS (SELECT page_id, CASE WHEN (list_contains(tw, 'the') OR list_contains(tw, 'thinand')) AND NOT list_contains(tw, 'erthe') THEN CASE WHEN list_contains(cw, 'erthe') THEN 0.8 WHEN compares THEN 0.85 ELSE 0.5 END
  WHEN (list_contains(tw, 'und') OR list_contains(tw, 'der')) AND NOT list_contains(tw, 'ungen') THEN CASE WHEN list_contains(cw, 'ungen') THEN 0.8 WHEN compares THEN 0.85 ELSE 0.5 END ELSE 1e0 END AS factor FROM m)
SELECT page_id, factor::DOUBLE AS factor FROM k""")
def competing_factor(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return pages(spark, d).select("page_id", interest.competing_factor(F.col("title"), F.col("body"), none, tuple(_RIVALS), _RIVALS).alias("factor"))
