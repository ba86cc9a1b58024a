"""What kind of item a title and a body are, how good, how new and how necessary, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, classes and weights that decide results.
#: Classes in the order in which they are tried: name, factor, and what the lower-cased title must start with, hold, end with
#: or match (one is enough).
CLASSES = (
    ("clickbait", 0.25, ("he just ", "she just ", "they just ", "this guy ", "this dev ", "this developer ", "this programmer ", "this engineer ", "this person ", "watch him ", "watch her ", "watch this "),
     ("you won't believe", "you wont believe", "will shock you", "will blow your mind", "mind-blowing", "mind blowing", "nobody is talking about", "no one is talking about", "what happens next", "you'll never guess", "youll never guess", "absolute madlad", "absolute mad lad", "absolute unit", "absolutely insane", "goes insane", "went insane", "goes viral", "went viral", "shocking truth", "the truth about", "secret trick", "one weird trick", "?!", "!!!", "!?", " hell ", "through hell", "into hell", "from hell", " wtf ", " omg ", " lmao ", " lol ", " wth "), (), ""),
    ("security_advisory", 1.30, (), (), (), r"cve[- ][0-9]{4}|(^|[^a-z0-9])(vulnerability|exploit|security advisory|zero-day|zero day|zeroday|ransomware|backdoor|supply chain attack|remote code execution|rce|privilege escalation)([^a-z0-9]|$)|(patch|update).*(security|critical)|(security|critical).*(patch|update)"),
    ("breaking_change", 1.25, (), ("breaking change", "deprecated", "end of life", "eol", "migration guide", "drops support", "removed in", "sunset", "backwards incompatible", "backward incompatible"), (), ""),
    ("hiring", 0.30, (), ("hiring", "job opening", "remote position", "join our team", "join the team", "(f/d)", "(m/f/d)", "(m/w/d)", "full-time", "part-time"), (), r"looking for.*(developer|engineer)|(developer|engineer).*looking for|(dev |developer|engineer|swe |sde ).*(switch|career|moving to|transitioning|job hunt|interview)|(switch|career|moving to|transitioning|job hunt|interview).*(dev |developer|engineer|swe |sde )"),
    ("release_notes", 1.15, (), ("changelog", "what's new in", "release notes"), (), r"[0-9]\.[0-9].*(released|is out|available|launched| beta| rc| alpha)"),
    ("show_and_tell", 0.85, ("i built", "i made", "i created", "i rebuilt", "i rewrote", "i redesigned", "i remade", "i ported", "show hn", "launch hn"),
     ("just launched", "open-sourced my", "open sourced my", "releasing my", "my new project", "i've been working on", "i have been working on", "check out my", "here's what i built", "here is what i built"), (), ""),
    ("tutorial", 0.80, (), (), (), r"★.*(roadmap|awesome-|learn-|cheatsheet|cheat-sheet|interview-prep|interview-questions|coding-interview|coding-challenges|free-programming-books|system-design-|design-patterns|freecodecamp|100-days-of-|project-based-learning|build-your-own-)|(roadmap|awesome-|learn-|cheatsheet|cheat-sheet|interview-prep|interview-questions|coding-interview|coding-challenges|free-programming-books|system-design-|design-patterns|freecodecamp|100-days-of-|project-based-learning|build-your-own-).*★"),
    ("help_request", 0.50, ("error when", "problem with", "issue with", "trouble with", "struggling with", "stuck on", "can't get", "cannot get", "unable to", "why does my", "why doesn't", "why won't", "why isn't"),
     ("doesn't work", "does not work", "not working", "broken after", "stopped working", "won't compile", "won't build", "can anyone explain"),
     ("(help!)", "(help?)", "(help)", "help!", "help?", "please help", "help needed", "help me", "any ideas?", "any suggestions?", "any thoughts?"), ""),
    ("question", 0.65, ("how do", "what's the", "what is the", "need advice", "help with", "is there", "can someone", "does anyone"), ("looking for suggestions", "recommendations for", "which should i", "ask hn:"), (), ""),
    ("tutorial", 0.80, ("how to",), ("getting started", "step by step", "step-by-step", "tutorial", "beginner guide", "beginner's guide", "introduction to", "learn to"), (), ""),
)
DEEP_DIVE, DISCUSSION, DEEP_BYTES, BODY_START = ("deep_dive", 1.15), ("discussion", 1.0), 2000, 500
AUTHORITY = {"cve": 1.0, "osv": 1.0, "arxiv": 0.9, "crates_io": 0.85, "npm_registry": 0.85, "pypi": 0.85, "go_modules": 0.85, "github": 0.85, "papers_with_code": 0.85, "hackernews": 0.75, "lobsters": 0.75, "rss": 0.7, "huggingface": 0.7, "reddit": 0.65, "stackoverflow": 0.65, "twitter": 0.6, "bluesky": 0.6, "youtube": 0.6, "mastodon": 0.55, "lemmy": 0.55, "devto": 0.5, "producthunt": 0.45}
BAIT = ("you won't believe", "mind-blowing", "shocking", "insane", "blown away", "will blow your mind", "game changer", "this one trick", "everything you need to know", "what nobody tells you", "the truth about", "stop doing this", "i was wrong about")
STRONG_BAIT = ("devs hate", "hate it", "you won't believe", "will blow your mind", "one weird trick", "what nobody tells you", "the truth about", "stop doing this", "doctors hate", "x faster", "x speedup")
EXACT = ("rfc ", "cve-", " v1", " v2", " v3", " v4")
QUANTITIES = ("mb ", "gb ", "kb ", "ms ", " seconds", " minutes", "x faster", "x slower", "x improvement", "x speed", "k stars", "k users", "% ", "10x", "100x")
COMPARISONS = (" vs ", " versus ", "benchmark", "comparison", "performance", "latency", "throughput")
SPECIFIC = ("migration", "changelog", "breaking change", "deprecat", "vulnerability", "advisory", "release", "architecture", "implementation", "production", "zero-day", "cve-")
VAGUE = ("interesting", "thoughts on", "opinions on", "what do you think", "anyone else", "is it just me", "am i the only", "hot take", "unpopular opinion")
CODE = ("```", "fn ", "function ", "const ", "import ", "class ")
STRUCTURE = ("## ", "### ", "- ")
INTRO = (
    (0.90, 0.05, 0.10, ("getting started", "beginner's guide", "beginners guide", "for beginners", "complete beginner", "absolute beginner", "hello world", "for dummies", "101:", " 101", "your first", "how to get started", "in 5 minutes", "in 10 minutes", "in 15 minutes", "made easy", "simplified", "quick start", "quickstart", "full project breakdown")),
    (0.50, 0.10, 0.20, ("introduction to", "intro to", "tutorial:", "tutorial for", "learn ", "learn how to", "from scratch", "step by step", "step-by-step", "basics of", "fundamentals of", "what is ", "crash course")),
    (0.30, 0.10, 0.20, ("a guide to", "complete guide", "ultimate guide", "cheat sheet")),
)
INTRO_BODY = ("in this tutorial", "in this beginner", "let's start from scratch", "first, install", "prerequisites:", "npm install", "pip install", "let's create a new", "open your terminal")
ECOSYSTEMS = {
    "npm": ("npm", "javascript", "typescript", "node", "js", "ts"), "crates.io": ("rust", "cargo", "crates.io", "crates"), "PyPI": ("python", "pypi", "pip", "py"), "Go": ("go", "golang"),
    "Maven": ("java", "maven", "kotlin", "gradle"), "NuGet": ("csharp", "c#", "dotnet", "nuget"), "Packagist": ("php", "composer", "packagist"), "RubyGems": ("ruby", "rubygems", "gem"), "Pub": ("dart", "flutter", "pub"),
}
NECESSITY_HIT = {"critical": (0.95, "immediate"), "high": (0.85, "this_week"), "medium": (0.60, "awareness")}
NECESSITY_NEAR = {"critical": 0.40, "high": 0.30}


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)))


def content_class(title: Column, body: Column) -> Column:
    """(name, factor) of an item: the first class of CLASSES that fits; else a deep dive if its body is long; else discussion."""
    title, body = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(body, F.lit(""))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit(0.0).alias("factor")))
    for name, factor, starts, holds, ends, pattern in CLASSES:
        fits = reduce(lambda a, b: a | b, [title.startswith(p) for p in starts] + [title.endswith(p) for p in ends], any_of(title, holds))
        fits = fits | F.rlike(title, F.lit(pattern)) if pattern else fits
        if name == "security_advisory":  # an identifier may also stand where the body begins
            fits = fits | F.rlike(F.lower(F.left(body, F.lit(BODY_START))), F.lit("cve[- ][0-9]{4}"))
        out = out.when(fits, F.struct(F.lit(name).alias("name"), F.lit(factor).alias("factor")))
    of = lambda c: F.struct(F.lit(c[0]).alias("name"), F.lit(c[1]).alias("factor"))
    return out.when(F.octet_length(body) > DEEP_BYTES, of(DEEP_DIVE)).otherwise(of(DISCUSSION))


def authority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair]), source), F.lit(0.5))


def title_quality(title: Column) -> Column:
    """0 to 1: down for few words, capitals, marks, bait and lists; up for versions and identifiers."""
    low, letters = F.lower(title), F.regexp_count(title, F.lit(r"\p{L}"))
    words = F.regexp_count(title, F.lit(r"[^ \t\n\r\f]{2,}"))
    loud = (letters >= 5) & (F.regexp_count(title, F.lit(r"\p{Lu}")) / letters > 0.5)
    marks = (F.regexp_count(title, F.lit("!")) > 1) | (F.regexp_count(title, F.lit(r"\?")) > 2)
    listed = F.rlike(low, F.lit(r"^ *[0-9]+ *(things|ways|tips|reasons|tools|best)"))
    score = 1.0 - _if(words < 4, 0.35) - _if(loud, 0.3) - _if(marks, 0.2) - _if(any_of(low, BAIT), 0.3) - _if(listed, 0.15) + _if(any_of(low, EXACT), 0.1)
    return _clamp(score, 0.0, 1.0)


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def strong_bait(title: Column) -> Column:
    low = F.lower(title)
    return any_of(low, STRONG_BAIT) | (F.contains(low, F.lit("this one")) & F.contains(low, F.lit("trick")))


def density_of_facts(title: Column) -> Column:
    """0 to 1 around 0.5: versions, quantities, comparisons and exact terms up, vague phrases down."""
    low = F.lower(title)
    version = (F.contains(low, F.lit(" v")) & F.rlike(low, F.lit("[0-9]"))) | F.rlike(low, F.lit(r"[0-9]\.[0-9]"))
    return _clamp(0.5 + _if(version, 0.15) + _if(any_of(low, QUANTITIES), 0.1) + _if(any_of(low, COMPARISONS), 0.1) + _if(any_of(low, SPECIFIC), 0.1) - _if(any_of(low, VAGUE), 0.15), 0.0, 1.0)


def depth(body: Column) -> Column:
    """0 to 1: length in words, code and headings or lists; 0.3 for no body."""
    n = F.regexp_count(body, F.lit(r"[^ \t\n\r\f]+"))
    length = F.when(n <= 50, 0.0).when(n <= 200, 0.1).when(n <= 500, 0.2).when(n <= 1000, 0.3).otherwise(0.4)
    return F.when(F.coalesce(body, F.lit("")) == "", 0.3).otherwise(_clamp(0.3 + length + _if(any_of(body, CODE), 0.15) + _if(any_of(body, STRUCTURE), 0.1), 0.0, 1.0))


#: Addresses of much and of little weight.
TRUSTED = ("github.com", "blog.rust-lang.org", "doc.rust-lang.org", "docs.rs", "arxiv.org", "research.google", "engineering.fb.com", "netflixtechblog.com", "blog.cloudflare.com", "webkit.org", "v8.dev", "chromium.org", "developer.mozilla.org", "web.dev")
GATHERED = ("medium.com", "dev.to", "hackernoon.com", "freecodecamp.org", "towardsdatascience.com", "geeksforgeeks.org", "w3schools.com")
#: Words that say nothing of a title.
EMPTY_WORDS = tuple(
    """the and for with how that this your from about into will have when what does more than just like also been were them they some each
    which their then there would could should being over most very only other using used here after before between where while because
    through during without again further once still can not but its are was has had all any who why our out off own too now new way""".split()
)


def weight_of_address(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(any_of(low, TRUSTED), 1.15).when(any_of(low, GATHERED), 0.85).otherwise(1.0)


def _telling(text: Column) -> Column:
    """The words of four bytes or more that say something."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) >= 4) & ~w.isin(*EMPTY_WORDS))


def repeated_words(title: Column) -> Column:
    """0, or what a title loses that says a word three times, or more often."""
    most = F.array_max(F.transform(_telling(title), lambda w: F.regexp_count(F.concat(F.lit(" "), F.array_join(_telling(title), "  "), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))))
    return F.when(most >= 4, -0.20).when(most == 3, -0.10).otherwise(0.0)


def unlike_body(title: Column, body: Column) -> Column:
    """0, or what an item loses whose body has few of its title's words; short titles and empty bodies lose nothing."""
    t, b = F.array_distinct(_telling(title)), F.array_distinct(_telling(body))
    share = F.size(F.array_intersect(t, b)) / F.size(t)
    return F.when((F.size(t) < 3) | (F.size(b) == 0), 0.0).when(share < 0.30, -0.20).when(share < 0.50, -0.10).otherwise(0.0)


def few_words(title: Column) -> Column:
    """0, or what a title loses of which more than half the words repeat others."""
    w = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when(F.size(w) == 0, 0.0).when(F.size(F.array_distinct(w)) / F.size(w) < 0.50, -0.15).otherwise(0.0)


def part_of_series(title: Column) -> Column:
    """0, or what a title loses that counts parts of a series (1/12, Day 3:, a thread)."""
    start = F.ltrim(title)
    low = F.lower(start)
    counted = F.rlike(start, F.lit("^[0-9]{1,3}/")) | F.rlike(low, F.lit(r"^(day|week|part|episode|chapter|lesson)\s*[0-9]+\s*[·:\-—–|/]"))
    thread = F.contains(start, F.lit("\U0001f9f5")) | F.contains(low, F.lit("a thread")) | F.contains(low, F.lit("(thread)"))
    return F.when(counted | thread, -0.25).otherwise(0.0)


def quality_factor(title: Column, body: Column, url: Column) -> Column:
    """0.5 to 1.2: what an item's form does to its score.

    Title, depth of the body and address make up the whole; facts in the title shift it a little; repeated words, a body that
    does not keep what the title says, few different words and parts of a series take from it. Nulls are empty.
    """
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    raw = title_quality(title) * 0.5 + depth(body) * 0.3 + weight_of_address(url) * 0.2
    losses = repeated_words(title) + unlike_body(title, body) + few_words(title) + part_of_series(title)
    return _clamp(raw * 0.7 + 0.5 + (density_of_facts(title) - 0.5) * 0.10 + losses, 0.5, 1.2)


def intro_confidence(title: Column, body: Column) -> Column:
    """0 to 1: how sure an item is an introduction, by the strongest kind of phrase in its title and by two in its body."""
    low, out = F.lower(title), F.lit(0.0)
    for base, each, most, phrases in reversed(INTRO):
        n = hits(low, phrases)
        out = F.when(n > 0, base + F.least(n * each, F.lit(most))).otherwise(out)
    return F.least(out + _if((out < 1) & (hits(F.lower(F.coalesce(body, F.lit(""))), INTRO_BODY) >= 2), 0.3), F.lit(1.0))


def ecosystem(alias: Column) -> Column:
    """The package ecosystem that a name or language stands for; an unknown one stays as it is."""
    pairs = [F.lit(x) for name, aliases in ECOSYSTEMS.items() for a in aliases for x in (a, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.btrim(alias))), alias)


def _bound(major: Column, minor: Column, patch: Column, release: Column | str = "~") -> Column:
    release = F.lit(release) if isinstance(release, str) else release
    return F.struct(*[c.cast("long").alias(n) for c, n in ((major, "major"), (minor, "minor"), (patch, "patch"))], release.alias("release"))


def meets(version: Column, requirement: Column) -> Column:
    """Whether a version text meets all comparators of a requirement (`>= 2.0.0, < 2.1.5`, `^1.2`, `~1`, `= 1.2.3`).

    A bare version means ^. Parts that a comparator leaves out are any. A pre-release only meets requirements that name one of
    the same three numbers. What cannot be read, an empty or a null text on either side, is met: better a false match than a miss.
    """
    shape = r"^\s*(<=|>=|<|>|=|\^|~)?\s*[vV]?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(-[0-9A-Za-z.-]+)?\s*$"
    number = lambda t, n: F.regexp_extract(t, shape, n).try_cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))

    def read(t: Column) -> Column:
        tag = F.regexp_extract(t, shape, 5)
        return F.struct(F.regexp_extract(t, shape, 1).alias("op"), number(t, 2).alias("major"), number(t, 3).alias("minor"), number(t, 4).alias("patch"), F.when(tag == "", "~").otherwise(tag).alias("release"))

    v = read(version)
    at = _bound(v["major"], zero(v["minor"]), zero(v["patch"]), v["release"])

    def fits(c: Column) -> Column:
        low, full, op = _bound(c["major"], zero(c["minor"]), zero(c["patch"]), c["release"]), c["patch"].isNotNull(), c["op"]
        # Bounds that are excluded stand before all pre-releases, whose tags begin with a hyphen.
        next_major, next_minor = _bound(c["major"] + 1, F.lit(0), F.lit(0), ""), _bound(c["major"], zero(c["minor"]) + 1, F.lit(0), "")
        after = F.when(c["minor"].isNull(), next_major).otherwise(next_minor)
        caret = F.when((c["major"] > 0) | c["minor"].isNull(), next_major).when((c["minor"] > 0) | ~full, next_minor).otherwise(_bound(c["major"], c["minor"], zero(c["patch"]) + 1, ""))
        exact = F.when(full, at == low).otherwise((low <= at) & (at < after))
        out = F.when(op == "<", at < low).when(op == ">=", at >= low).when(op == ">", F.when(full, at > low).otherwise(at >= after)).when(op == "<=", F.when(full, at <= low).otherwise(at < after))
        return out.when(op == "=", exact).when(op == "~", (low <= at) & (at < after)).otherwise((low <= at) & (at < caret))

    parts = F.transform(F.split(requirement, ","), read)
    same = F.exists(parts, lambda c: (c["release"] != "~") & (c["major"] == v["major"]) & (zero(c["minor"]) == zero(v["minor"])) & (zero(c["patch"]) == zero(v["patch"])))
    unread = v["major"].isNull() | F.exists(parts, lambda c: c["major"].isNull())
    return F.coalesce(F.when(unread, True).otherwise(F.forall(parts, fits) & ((v["release"] == "~") | same)), F.lit(True))


def necessity(*, dep: Column, severity: Column, signal: Column, content: Column, projects: Column, gap: Column, window: Column, named: Column, age_hours: Column, grounded: Column, affected: Column) -> Column:
    """(score, category, urgency): what would be missed most if it were not seen.

    The first path that fits counts: security, breaking change, deprecation, a release in one's own stack, an open decision, a
    gap. More projects raise the score by a tenth each, to one and a half; age lowers all but security, to one half in half a week.
    """
    has = dep > 0
    security = (signal == "security_alert") | severity.isNotNull() | (content == "security_advisory")
    breaking = (signal == "breaking_change") | (content == "breaking_change")
    ending = (F.contains(content, F.lit("deprecat")) | F.contains(signal, F.lit("deprecat"))) & has
    level = F.lower(F.coalesce(severity, F.lit("medium")))
    hit, near, soon = F.lit(0.5), F.lit(0.2), F.lit("awareness")
    for name, (score, urgency) in NECESSITY_HIT.items():
        hit, soon = F.when(level == name, score).otherwise(hit), F.when(level == name, urgency).otherwise(soon)
    for name, score in NECESSITY_NEAR.items():
        near = F.when(level == name, score).otherwise(near)
    paths = (
        (security & ~affected, F.lit(0.15), "security_vulnerability", F.lit("awareness")),
        (security & has, hit, "security_vulnerability", soon),
        (security, near, "security_vulnerability", F.lit("awareness")),
        (breaking & has, F.lit(0.8), "breaking_change", F.lit("this_week")),
        (breaking, F.lit(0.25), "breaking_change", F.lit("awareness")),
        (ending, F.lit(0.65), "deprecation_notice", F.lit("this_week")),
        (content.isin("release_notes", "platform_update") & has & grounded, F.least(0.45 + dep * 0.2, F.lit(0.65)), "ecosystem_shift", F.lit("awareness")),
        ((window > 0.1) & named, 0.5 + window, "decision_relevant", F.lit("awareness")),
        (gap > 0.1, 0.4 + gap, "blind_spot", F.lit("awareness")),
    )
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("score"), F.lit("").alias("category"), F.lit("").alias("urgency")))
    for fits, score, category, urgency in paths:
        out = out.when(fits, F.struct(score.cast("double").alias("score"), F.lit(category).alias("category"), urgency.alias("urgency")))
    out = out.otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("none").alias("category"), F.lit("none").alias("urgency")))
    wide = F.when(projects > 1, F.least(1 + (projects - 1) * 0.1, F.lit(1.5))).otherwise(1.0)
    old = F.when((out["category"] != "security_vulnerability") & (age_hours > 0), F.greatest(F.lit(0.5), 1 - age_hours / 168.0)).otherwise(1.0)
    return F.struct(_clamp(out["score"] * wide * old, 0.0, 1.0).alias("score"), out["category"].alias("category"), out["urgency"].alias("urgency"))
