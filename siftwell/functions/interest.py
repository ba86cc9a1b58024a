"""What a person declares against what an item says: keyword scores with negation, and competing technology."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import contains_word, count_word, stem

#: What stands before a name that a text turns away from.
NEGATIONS = (
    "not ", "no ", "don't ", "doesn't ", "didn't ", "won't ", "isn't ", "aren't ", "without ", "never ", "avoid ", "stop using ", "alternative to ", "instead of ", "replace ", "replacing ", "moved away from ", "moving away from ", "migrating from ",
    "leaving ", "dropped ", "dropping ", "removed ", "removing ", "don't use ", "doesn't use ", "didn't use ", "won't use ", "not using ", "stopped using ", "quit ", "quitting ",
)
#: Words of fewer than three letters, or just three, that name a technology.
SHORT_NAMES = ("ai", "ml", "go", "r", "c", "ui", "ux", "db", "os", "ci", "cd", "qa", "js", "ts", "py", "rx", "vm", "k8", "tf", "gcp", "aws", "api", "cli", "css", "sql", "llm", "nlp", "cv")
#: Technologies and those that compete with them.
COMPETITORS = {
    "tauri": ("electron", "nwjs", "neutralino", "wails", "cef"), "electron": ("tauri", "nwjs", "neutralino", "wails"),
    "react": ("vue", "angular", "svelte", "solid", "qwik"), "vue": ("react", "angular", "svelte", "solid"), "angular": ("react", "vue", "svelte", "solid"), "svelte": ("react", "vue", "angular"),
    "rust": ("go", "django", "laravel", "rails", "spring", "flask", "gin", "echo", "fastapi"),
    "axum": ("express", "fastify", "koa", "hapi", "django", "laravel", "rails", "spring", "flask", "gin", "echo", "fastapi", "fiber"),
    "next": ("nuxt", "remix", "gatsby", "astro", "sveltekit"), "nextjs": ("nuxt", "remix", "gatsby", "astro", "sveltekit"), "nuxt": ("next", "nextjs", "remix", "gatsby", "astro", "sveltekit"),
    "remix": ("next", "nextjs", "nuxt", "gatsby", "astro"), "gatsby": ("next", "nextjs", "nuxt", "remix", "astro"), "astro": ("next", "nextjs", "nuxt", "remix", "gatsby"),
    "tailwindcss": ("styled-components", "emotion", "css-modules", "bootstrap", "material-ui"), "tailwind": ("styled-components", "emotion", "css-modules", "bootstrap", "material-ui"), "styled-components": ("tailwindcss", "tailwind", "emotion", "css-modules"),
    "prisma": ("drizzle", "typeorm", "sequelize", "mongoose"), "drizzle": ("prisma", "typeorm", "sequelize", "mongoose"),
}
#: Words of an item that compares or moves.
COMPARING = ("vs", "versus", "compared to", "comparison", "alternative", "alternatives", "migrate", "migrating", "migration", "switching from", "moving from", "moved from", "switch to", "benchmark")


def negated(text: Column, term: str) -> Column:
    """Whether a lower-case text turns away from a term anywhere."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n + term)) for n in NEGATIONS])


def frequency_factor(text: Column, term: str) -> Column:
    """1 to 1.5 by how often a text has a term; once is 1."""
    n = count_word(text, term).cast("double")
    size = F.greatest(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(1))
    return F.when(n <= 1, 1.0).otherwise(F.least(1 + 0.6 * (n / (n + 1.2 * (0.25 + 0.75 * size / 150.0))), F.lit(1.5)))


def _in_words(text: Column, root: str) -> Column:
    return F.exists(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) >= 3) & (stem(w) == root))


def _root(word: str) -> str:
    """`stem` for a word that is known beforehand."""
    for suffix, to in (("ies$", "y"), ("(?<=.{3})(?:ing|edly|ed|ly|ers|er)$", ""), ("(?<=.{2}[^s])s$", "")):
        word = re.sub(suffix, to, word)
    return word


def _term_score(term: str, title: Column, content: Column, text: Column, others: tuple[str, ...], early: int) -> Column:
    """What one word of an interest counts: in the title, in the text, by another name, in the plural, or by its root."""
    start = F.left(content, F.lit(early))

    def found(value: float, effective: str) -> Column:
        raised = F.when(F.lit(value < 0.80) & (F.length(content) >= 3) & contains_word(start, effective), min(value + 0.10, 0.80)).otherwise(value)
        weight = raised * frequency_factor(text, effective)
        return weight * F.when(negated(text, effective), 0.5).otherwise(1.0) if len(effective) >= 3 else weight

    out = F.when(contains_word(title, term), found(0.80, term)).when(contains_word(text, term), found(0.55, term))
    for other in others:
        out = out.when(contains_word(title, other), found(0.80, other)).when(contains_word(text, other), found(0.55, other))
    if others:
        many = lambda t: contains_word(t, f"{term}s") | contains_word(t, f"{term}es")
        return out.when(many(title), found(0.80, term)).when(many(text), found(0.55, term)).otherwise(0.0)
    root = _root(term)
    if len(root) >= 3:
        # the beginning can hold the term only as part of a word that its end cuts
        out = out.when(_in_words(title, root), 0.65).when(_in_words(text, root), 0.45)
    return out.otherwise(0.0)


def keyword_interest(title: Column, content: Column, interests: dict[str, float], aliases: dict[str, tuple[str, ...]] | None = None, early: int = 200) -> Column:
    """0 to 1: the best score of a person's interests (topic to weight), a handful of expressions for each.

    A phrase of several words counts 0.95 in the title and 0.80 in the text, more if it comes often, half if the text turns
    away from it. Otherwise its words count each for itself, on average: whole words, other names, plurals of known names,
    roots; whole words with a little more at the beginning of the text. Nulls are empty.
    """
    title, content = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    text = F.concat(title, F.lit(" "), content)
    best = [F.lit(0.0)]
    for topic, weight in interests.items():
        terms = topic.lower().split()
        counted = [t for t in terms if len(t) >= 3 or t in SHORT_NAMES]
        each = sum((_term_score(t, title, content, text, (aliases or {}).get(t, ()), early) for t in counted), F.lit(0.0))
        score = F.least(each / max(1, len(counted)), F.lit(1.0))
        if len(terms) > 1:
            phrase = topic.lower()
            whole = F.when(F.contains(title, F.lit(phrase)), 0.95).when(F.contains(text, F.lit(phrase)), 0.80)
            score = F.when(whole.isNotNull(), F.least(whole * frequency_factor(text, phrase), F.lit(1.0)) * F.when(negated(text, phrase), 0.5).otherwise(1.0)).otherwise(score)
        best.append(score * float(weight))
    return F.greatest(*best) if len(best) > 1 else best[0]


def competing_factor(title: Column, content: Column, topics: Column, stack: tuple[str, ...], competitors: dict[str, tuple[str, ...]] = COMPETITORS, early: int = 500) -> Column:
    """1 for an item that is not about a competitor of a person's stack; else 0.85 to 0.5.

    The stack is asked in order. A competitor counts in the title or among the topics, unless it is in the stack itself or
    the title names the person's own technology: 0.8 if the text does, 0.85 if it compares or moves, 0.7 if the competitor
    is only a topic, 0.5 otherwise. Nulls are empty.
    """
    title, content = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    topics = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.lower(t))
    own = tuple(t.lower() for t in stack)
    out = F.when(F.lit(False), 1.0)
    begins = lambda c: F.exists(topics, lambda t: t.startswith(c))
    compares = reduce(lambda a, b: a | b, [contains_word(title, m) | F.contains(F.left(content, F.lit(early)), F.lit(m)) for m in COMPARING])
    for tech in own:
        if not competitors.get(tech):
            continue
        first = F.get(F.array_compact(F.array(*[F.when(contains_word(title, c) | begins(c), c) for c in competitors[tech]])), F.lit(0))
        counts = first.isNotNull() & ~first.isin(*own) & ~contains_word(title, tech)
        in_title = reduce(lambda a, b: a | b, [(first == c) & contains_word(title, c) for c in competitors[tech]])
        out = out.when(counts, F.when(contains_word(content, tech), 0.80).when(compares, 0.85).when(~in_title, 0.70).otherwise(0.50))
    return out.otherwise(1.0)
