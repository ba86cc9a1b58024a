"""Vectors, scores, versions and times as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or the widths differ."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def project(vector: Column, matrix: list[list[float]]) -> Column:
    """Fixed projection of a vector by a small matrix."""
    return F.array(*[dot(vector, F.array(*map(F.lit, row))) for row in matrix])


def sigmoid(x: Column, center: float = 0.48, scale: float = 20.0) -> Column:
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(1 / (1 + F.exp((center - x) * scale)))


def steps(x: Column, table: list[tuple[float, float]], last: float) -> Column:
    """The value of the first step whose bound exceeds x."""
    out = None
    for bound, value in table:
        out = F.when(x < bound, value) if out is None else out.when(x < bound, value)
    return out.otherwise(last)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation between points, constant outside."""
    out = F.when(x <= points[0][0], points[0][1])
    for (a, u), (b, v) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(points[-1][1])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def hours(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 3_600_000_000.0


def hotness(mentions: Column, sources: Column, age_hours: Column, hits: Column) -> Column:
    recency = F.when(age_hours < 24, 1.0).when(age_hours < 72, 0.5).otherwise(-F.least(age_hours / 168, F.lit(2.0)))
    return F.greatest(F.ln(mentions + 1) + 0.5 * sources + recency + 2.0 * hits, F.lit(0.0))


def version(text: Column) -> Column:
    """(major, minor, patch, release) of a version text; release sorts a pre-release before its release. Null for what does
    not begin as a version."""
    pattern = r"^[vV=]?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(-[0-9A-Za-z.-]+)?"
    part = lambda n: F.coalesce(F.regexp_extract(text, pattern, n).try_cast("long"), F.lit(0).cast("long"))
    tag = F.regexp_extract(text, pattern, 4)
    parts = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.when(tag == "", F.lit("~")).otherwise(tag).alias("release"))
    return F.when(F.rlike(text, F.lit(pattern)), parts)


def in_range(v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """introduced <= v < fixed, or v <= last where nothing is fixed; unknown bounds do not exclude. Null where a text that is
    there cannot be read as a version and nothing else excludes it."""
    return (introduced.isNull() | (version(introduced) <= version(v))) & F.when(fixed.isNotNull(), version(v) < version(fixed)).when(last.isNotNull(), version(v) <= version(last)).otherwise(True)


#: Metric weights of the CVSS v3.1 base score.
CVSS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
CVSS_PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def cvss_base(vector: Column) -> Column:
    """CVSS v3.1 base score of a vector text, rounded up to a tenth as the specification has it; null if a metric lacks."""

    def metric(name: str) -> Column:
        return F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])", 1)

    def weight(name: str, table: dict[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for letter, value in table.items():
            out = F.when(metric(name) == letter, F.lit(value)).otherwise(out)
        return out

    changed = metric("S") == "C"
    w = {name: weight(name, table) for name, table in CVSS.items()}
    pr = F.when(changed, weight("PR", CVSS_PR["C"])).when(metric("S") == "U", weight("PR", CVSS_PR["U"]))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(F.greatest(iss - 0.02, F.lit(0.0)), F.lit(15.0))).otherwise(6.42 * iss)
    exploit = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    raw = F.when(changed, F.least(1.08 * (impact + exploit), F.lit(10.0))).otherwise(F.least(impact + exploit, F.lit(10.0)))
    scaled = F.round(raw * 100000).cast("long")
    rounded = F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)
    return F.when(iss.isNull() | exploit.isNull(), F.lit(None).cast("double")).when(impact <= 0, 0.0).otherwise(rounded)


def novelty(security: Column, known: Column, release: Column, intro: Column, confidence: Column) -> Column:
    """A factor for what is new: security and releases of known technology up, introductions to known things down."""
    out = F.when(security & known, 1.30).when(security, 1.10).when(release & known, 1.25).when(release, 1.05)
    return out.when(intro & known, 1 - 0.5 * confidence).when(intro, 1 - 0.2 * confidence).otherwise(1.0)


def advantage(acted: Column, expired: Column, lead_hours: Column, calibration: Column, gaps: Column, n: Column) -> Column:
    """0 to 100 from the share of windows acted on, lead time, calibration, gaps closed and the number of items."""
    response = F.when(acted + expired > 0, acted / (acted + expired)).otherwise(0.5)
    volume = F.least(F.ln(n) / F.ln(F.lit(1000.0)), F.lit(1.0))
    return 100 * (0.30 * response + 0.20 * F.least(lead_hours / 168, F.lit(1.0)) + 0.25 * calibration + 0.15 * F.least(gaps / 5, F.lit(1.0)) + 0.10 * volume)
