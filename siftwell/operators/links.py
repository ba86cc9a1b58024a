"""Links from items to the dependencies that they are about, each with the best proof there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.staging import broadcast_within

#: Kinds of sources.
REGISTRIES = ("npm_registry", "npm", "crates_io", "crates", "pypi", "go_modules", "go", "maven", "nuget", "packagist", "rubygems", "cocoapods")
ADVISORIES = ("osv", "cve")
ADVISORY_CONTENT = ("security_advisory", "vulnerability_report", "cve")
#: Names that are common words, which a title alone does not prove.
COMMON_NAMES = tuple("image config log time rand error hash ring tower express tracing url http crypto lazy quote lock once pin signal sync bytes regex either paste clap nom base core test data utils proc-macro2 arbitrary router testing async clone read windows next motion profiling".split())
#: Confidence of each proof.
EXACT, ADVISORY, ADVISORY_TITLE, TITLE = 0.95, 0.90, 0.75, 0.50
#: What a written package name may consist of besides letters and digits.
INNER = r"\p{L}\p{N}\-_.@"
#: Forms of names up to which they are broadcast.
BROADCAST_NAMES = 200_000


def registry_package(source: Column, source_id: Column) -> Column:
    """The package of a registry's item: npm ids without their version, crates without prefix, PyPI without version."""
    npm = F.when(source_id.startswith("@"), F.regexp_replace(source_id, r"^(.+)@[^@]*$", "$1")).otherwise(F.regexp_replace(source_id, r"@.*$", ""))
    return F.when(source.isin("npm_registry", "npm"), npm).when(source.isin("crates_io", "crates"), F.regexp_replace(source_id, r"^crate-", "")).when(source == "pypi", F.regexp_replace(source_id, r"-[0-9][^-]*$", "")).when(source.isin(*REGISTRIES), source_id)


def affected_list(content: Column) -> Column:
    """The packages that the first line "Affected: a (x), b (y)" names; null without such a line, or if it is empty or unknown."""
    line = F.get(F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("Affected:")), F.lit(0))
    names = F.trim(F.substr(line, F.lit(10)))
    told = F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r" \(.*$", "")))
    return F.when(~F.lower(names).isin("unknown", ""), told)


def _exact(name: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(F.trim(name), "^@+", ""), "_", "-"))


def _forms(name: Column) -> Column:
    """How a name may be written: as it is, with underscores, with dashes."""
    low = F.lower(name)
    return F.array_distinct(F.array(low, F.translate(low, "-", "_"), F.translate(low, "_", "-")))


def _specific(name: Column) -> Column:
    return ~F.lower(F.translate(F.regexp_replace(F.trim(name), "^@+", ""), "/_", "--")).isin(*COMMON_NAMES) & (F.length(F.trim(name)) > 0)


def _in_title(items: DataFrame, forms: DataFrame) -> DataFrame:
    """(item_id, name) for names that a title holds between characters that no name consists of.

    A title is cut into runs of name characters and what parts them; a name of several runs (a scope, a path, words) is
    compared with as many pieces of the title. The first run is the key of the join; names that begin with another character
    are not found.
    """
    pieces = lambda c: F.regexp_extract_all(c, F.lit(f"[{INNER}]+|[^{INNER}]+"), F.lit(0))
    book = forms.withColumn("pieces", pieces(F.col("form"))).withColumn("first", F.get("pieces", F.lit(0))).where(F.rlike("form", F.lit(f"^[{INNER}]")))
    longest = book.agg(F.max(F.size("pieces"))).first()[0] or 1
    cut = items.select("item_id", pieces(F.lower("title")).alias("w"))
    grams = F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice("w", i + 1, F.lit(longest + 1)).alias("gram")))
    each = cut.select("item_id", F.explode(grams).alias("g")).select("item_id", "g.*")
    met = each.join(broadcast_within(book, BROADCAST_NAMES), "first")
    full = F.array_join("gram", "")
    n = F.length("form")
    ends = (F.length(full) == n) | ~F.rlike(F.substr(full, n + 1, F.lit(1)), F.lit(f"[{INNER}]"))
    return met.where(F.startswith(full, F.col("form")) & ends).select("item_id", "name").distinct()



def dependency_links(items: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (item_id, name, proof, confidence): the dependencies that each item is about, by its best proof.

    items: item_id, source_type, source_id, title, content, content_type; names: name. Proofs, best first: the item is the
    package's entry in a registry; an advisory lists it as affected; an advisory without such a list names it in its title;
    a title names it. An advisory whose list does not have the dependency proves nothing by its title. Names that are common
    words are not proved by titles. Names meet on equal forms (lower case, dashes and underscores alike), never by scanning
    all names. Nulls match nothing; repeated names count once.
    """
    known = names.select("name").where("name is not null").distinct()
    source = F.lower("source_type")
    forms = known.select("name", F.explode(_forms(F.col("name"))).alias("form"))
    entry = items.select("item_id", F.lower(registry_package(source, F.col("source_id"))).alias("form"))
    exact = entry.join(forms, "form").select("item_id", "name", F.lit("exact_registry").alias("proof"), F.lit(EXACT).alias("confidence"))
    advisory = F.coalesce(source.isin(*ADVISORIES), F.lit(False)) | F.coalesce(F.col("content_type").isin(*ADVISORY_CONTENT), F.lit(False))
    told = items.select("item_id", "title", advisory.alias("advisory"), F.when(advisory, affected_list(F.col("content"))).alias("affected"))
    listed = told.select("item_id", F.explode("affected").alias("one")).select("item_id", _exact(F.col("one")).alias("form"))
    listed = listed.join(known.select("name", _exact(F.col("name")).alias("form")), "form").select("item_id", "name", F.lit("advisory").alias("proof"), F.lit(ADVISORY).alias("confidence"))
    titled = _in_title(told.where("title is not null and affected is null"), forms.where(_specific(F.col("name"))))
    kinds = told.select("item_id", "advisory")
    graded = titled.join(kinds, "item_id").select("item_id", "name", F.when(F.col("advisory"), "advisory").otherwise("title_heuristic").alias("proof"), F.when(F.col("advisory"), ADVISORY_TITLE).otherwise(TITLE).alias("confidence"))
    proofs = exact.union(listed).union(graded)
    best = proofs.groupBy("item_id", "name").agg(F.max(F.struct("confidence", "proof")).alias("best"))
    return best.select("item_id", "name", "best.proof", "best.confidence")
