"""Whether a dependency's target applies to a platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _atom(token: Column, system: Column, family: Column, arch: Column) -> Column:
    """A single condition; unknown ones hold."""
    key = F.trim(F.regexp_extract(token, r'^([a-z_ ]+)=\s*"[^"]*"$', 1))
    value = F.regexp_extract(token, r'=\s*"([^"]*)"$', 1)
    told = F.when(key == "target_os", value == system).when(key == "target_family", value == family).when(key == "target_arch", value == arch).when(key.isin("windows", "unix"), key == family).otherwise(F.lit(True))
    return F.when(key != "", told).when(token.isin("windows", "unix"), token == family).otherwise(F.lit(True))


def condition_holds(condition: Column, system: Column, family: Column, arch: Column) -> Column:
    """The value of a condition of not(...), all(...), any(...) and single tests, nested to any depth.

    Its tokens are folded with a stack: an opening call pushes what it starts from (any: false, all and not: true), a test
    or a closing call joins its value to the call above. Empty conditions and unknown tests hold.
    """
    tokens = F.regexp_extract_all(F.concat(F.lit("all("), F.coalesce(condition, F.lit("")), F.lit(")")), F.lit(r'\s*(?:all|any|not)\s*\(|\)|[^,()"]+(?:"[^"]*"[^,()"]*)?'), F.lit(0))
    tokens = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
    frame = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))

    def joined(stack: Column, value: Column) -> Column:
        top = F.element_at(stack, -1)
        new = F.when(top["kind"] == "any", top["value"] | value).when(top["kind"] == "not", ~value).otherwise(top["value"] & value)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(top["kind"], new)))

    def step(stack: Column, token: Column) -> Column:
        name = F.regexp_extract(token, r"^(all|any|not)\s*\($", 1)
        below = F.slice(stack, F.lit(1), F.size(stack) - 1)
        return F.when(name != "", F.concat(stack, F.array(frame(name, name != "any")))).when((token == ")") & (F.size(stack) > 1), joined(below, F.element_at(stack, -1)["value"])).when(token == ")", stack).otherwise(joined(stack, _atom(token, system, family, arch)))

    start = F.array(frame(F.lit("all"), F.lit(True)))
    return F.aggregate(tokens, start, step, lambda stack: F.forall(stack, lambda f: f["value"]))


def target_applies(target: Column, system: Column, family: Column, arch: Column) -> Column:
    """Whether a target (null: any; "cfg(...)"; or a triple such as x86_64-pc-windows-msvc) applies to a platform."""
    spec = F.trim(F.coalesce(target, F.lit("")))
    inside = F.regexp_extract(spec, r"(?s)^cfg\((.*)\)", 1)
    low = F.lower(spec)
    of = F.when(F.contains(low, F.lit("windows")), "windows").when(F.contains(low, F.lit("darwin")) | F.contains(low, F.lit("apple")), "macos").when(F.contains(low, F.lit("linux")), "linux")
    machine = F.when(low.startswith("x86_64"), "x86_64").when(low.startswith("aarch64"), "aarch64").when(low.startswith("i686") | low.startswith("i586"), "x86")
    triple = F.coalesce(of == system, F.lit(True)) & F.coalesce(machine == arch, F.lit(True))
    return F.when(spec == "", F.lit(True)).when(spec.startswith("cfg("), condition_holds(inside, system, family, arch)).otherwise(triple)
