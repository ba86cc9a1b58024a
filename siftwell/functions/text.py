"""Text and address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that tell nothing about a page's identity.
TRACKING = ("ref", "fbclid", "gclid", "si", "igshid")
#: Character references decoded by `decode_entities`, the ampersand first.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
BOILERPLATE = r"(?i)(all rights reserved|cookie|subscribe|privacy policy|terms of service)"


def strip_html(html: Column) -> Column:
    """Scripts, styles and tags replaced by blanks."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")


def decode_entities(text: Column) -> Column:
    for code, plain in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^ \t\n\r\f]+", "")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def preprocess(html: Column, most: int = 2000) -> Column:
    """What an embedding model is given: no tags, references or addresses, single blanks, at most so many characters."""
    return F.left(collapse_space(strip_urls(decode_entities(strip_html(html)))), F.lit(most))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ascii_words(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


def normal_title(title: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Identity of an address: https, host in lower case without www, no fragment, no trailing slash, no tracking
    parameters, the others sorted with their values as they are."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.lit("https://"), domain(url), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))


def contains_word(text: Column, term: str) -> Column:
    """The term with neither a letter nor a digit on its sides."""
    import re

    return F.rlike(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(term.lower())}(?![\p{{L}}\p{{N}}])"))


def count_word(text: Column, term: str) -> Column:
    import re

    return F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(term.lower())}(?![\p{{L}}\p{{N}}])"))


def density(count: Column, length: Column, k1: float = 1.2, b: float = 0.75, mean: float = 150.0) -> Column:
    """A multiplier from 1 to 1.5 by the saturated frequency of a term."""
    tf = count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean))
    return F.when(count > 0, F.least(1 + 0.6 * tf, F.lit(1.5))).otherwise(F.lit(1.0))


def cve_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)CVE-[0-9]{4}-[0-9]{4,}"), F.lit(0)), F.upper)))


def stem(word: Column) -> Column:
    """Common English suffixes cut where at least three letters stay."""
    for suffix, to in (("ies$", "y"), ("(?<=.{3})(?:ing|edly|ed|ly|ers|er)$", ""), ("(?<=.{2}[^s])s$", "")):
        word = F.regexp_replace(word, suffix, to)
    return word


def is_boilerplate(chunk: Column, least: int = 50) -> Column:
    return (F.length(chunk) < least) | F.rlike(chunk, F.lit(BOILERPLATE))


def chunks(text: Column, most: int = 500) -> Column:
    """Paragraphs packed one after another into chunks of at most `most` characters; a longer paragraph is a chunk."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n[ \t]*\n|\n"), lambda p: F.btrim(p)), lambda p: p != "")

    def pack(state: Column, p: Column) -> Column:
        fits = (F.length(state["open"]) > 0) & (F.length(state["open"]) + 1 + F.length(p) <= most)
        done = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["open"], F.lit("\n"), p)).otherwise(p).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, pack, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def non_latin_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, (letters - F.regexp_count(text, F.lit(r"\p{IsLatin}"))) / letters).otherwise(F.lit(0.0))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def redact_fields(json: Column) -> Column:
    """Values of secret-like keys in a JSON text replaced, at any depth."""
    return F.regexp_replace(json, r'(?i)("(?:[^"]*(?:password|secret|token|api_?key)[^"]*)"\s*:\s*)("(?:[^"\\]|\\.)*"|[0-9.eE+-]+|true|false|null)', '$1"[REDACTED]"')
