"""Dependencies against advisories, names and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.numeric import in_range, micros, version


def matched_advisories(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (name, ecosystem, version) affected by advisories (advisory_id, package, ecosystem, introduced, fixed, last).

    Names meet by equality of their lower-case forms with dashes as underscores; a dependency without a version, or with one
    that cannot be read, counts as affected, but not as confirmed.
    """
    norm = lambda c: F.lower(F.translate(c, "-", "_"))
    left = dependencies.withColumn("_n", norm(F.col("name")))
    right = advisories.withColumn("_n", norm(F.col("package"))).withColumnRenamed("ecosystem", "_e")
    met = left.join(right, (left["_n"] == right["_n"]) & (F.col("ecosystem") == F.col("_e")))
    hit = in_range(F.col("version"), F.col("introduced"), F.col("fixed"), F.col("last"))
    told = version(F.col("version")).isNotNull() & hit.isNotNull()
    return met.where(F.coalesce(hit, F.lit(True))).select("name", "ecosystem", "version", "advisory_id", "fixed", told.alias("confirmed"))


def upgrade_plan(matches: DataFrame) -> DataFrame:
    """By package: advisories, and the greatest version that fixes one."""
    return matches.groupBy("name", "ecosystem").agg(F.count("*").alias("advisories"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), version(F.col("fixed")))).alias("upgrade_to"))


def shared_packages(uses: DataFrame, project: str, package: str, least: int = 2) -> DataFrame:
    """Packages of several projects, with their number and sorted list."""
    return uses.groupBy(package).agg(F.countDistinct(project).alias("projects"), F.array_join(F.array_sort(F.collect_set(F.col(project).cast("string"))), ",").alias("project_list")).where(F.col("projects") >= least)


def named_in(names: DataFrame, name: str, texts: DataFrame, text_words: str) -> DataFrame:
    """Rows of texts joined with the names that are one of their words; an equality join on words."""
    return texts.withColumn("_w", F.explode(F.array_distinct(text_words))).join(names.withColumn("_w", F.lower(name)), "_w").drop("_w")


def paired_within(first: DataFrame, second: DataFrame, key: str, ts: str, hours: int, id_col: str = "event_id") -> DataFrame:
    """Interval join: each row of `first` with the rows of `second` of its key within the hours after it.

    Rows meet by key and stretch of time as long as the interval, so that a frequent key is spread over its stretches.
    """
    stretch = F.floor(micros(F.col(ts)) / (hours * 3_600_000_000))
    right = second.select(F.col(key).alias("_k"), F.col(ts).alias("later_ts"), F.col(id_col).alias("later_id"), stretch.alias("_s"))
    left = first.withColumn("_of", F.explode(F.array(stretch, stretch + 1)))
    limit = F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")
    return left.join(right, (F.col(key) == F.col("_k")) & (F.col("_of") == F.col("_s")) & F.col("later_ts").between(F.col(ts), limit)).drop("_k", "_s", "_of")
