"""Topics of items: from tags, from a fixed vocabulary, from capitals in titles, and from dictionaries of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import words
from siftwell.operators.staging import broadcast_within

#: Topics of one word.
WORDS = tuple(
    """rust python javascript typescript go golang java cpp react vue angular svelte solid qwik preact next nextjs nuxt remix gatsby astro
    node deno bun express fastify koa hapi nest nestjs ai ml neural gpt llm transformer database sql postgresql postgres mysql mongodb redis
    sqlite tauri electron vite webpack esbuild rollup turbopack parcel tailwind tailwindcss bootstrap prisma drizzle sequelize typeorm
    mongoose diesel sqlx django flask fastapi laravel rails spring gin fiber echo axum actix tokio reqwest serde warp rocket hyper tower
    tonic pnpm yarn npm cargo pip kubernetes k8s docker container terraform ansible pulumi aws azure gcp cloud vercel netlify cloudflare
    supabase firebase api rest graphql grpc microservice crypto cryptocurrency bitcoin ethereum blockchain nft web3 defi startup vc funding
    acquisition oss github git security vulnerability hack breach performance optimization scale scalability frontend backend fullstack
    devops sre linux unix windows macos mobile ios android flutter game gaming gamedev hardware chip semiconductor cpu gpu climate
    sustainability energy sports football basketball soccer politics election government architecture testing deployment monitoring
    accessibility debugging refactoring caching authentication authorization observability logging profiling benchmarking migration
    concurrency parallelism networking websocket streaming compiler interpreter documentation linting packaging""".split()
)
#: Topics of several words or with signs in them.
PHRASES = (
    "c++", "machine learning", "deep learning", "open source", "react native", "next.js", "nuxt.js", "vue.js", "node.js", "styled-components", "material-ui", "shadcn/ui", "ruby on rails",
    "unit testing", "integration testing", "load testing", "design patterns", "best practices", "code review", "continuous integration", "continuous deployment",
)
#: Words in capitals that are no topics.
TITLE_STOP_WORDS = tuple(
    """the and for how why what show ask with from into about this that your our their some any all every each more most many much also just
    very still not but yet here there when where will can should could would using building working making getting running creating
    developing announcing introducing launching deploying implementing understanding exploring discussing comparing improving fixing
    breaking starting looking moving keeping finding writing reading learning teaching testing trying adding removing setting built made
    released new best first free fast easy simple better modern full real good great top key big small open way part time year week month
    day thing guide tips tool tools list need help project projects update version""".split()
)

#: Phrases of a dictionary up to which it is broadcast.
BROADCAST_PHRASES = 200_000


def topics(title: Column, content: Column, tags: Column | None = None) -> Column:
    """The topics of an item in the order in which they are found, each once.

    First its tags: those that are topics, and the parts of hyphenated ones that are; then words of title and content that
    are topics; then phrases that these contain; then the words of the title of three bytes or more that begin with a
    capital, without stop words. Nulls count as empty.
    """
    title, content = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    text = F.lower(F.concat(title, F.lit(" "), content))
    found = F.filter(F.split(text, r"[^\p{L}\p{N}+#]"), lambda w: w.isin(*WORDS))
    phrases = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), p) for p in PHRASES]))
    bare = F.transform(F.split(title, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    capitals = F.filter(bare, lambda w: (F.octet_length(w) > 2) & F.rlike(w, F.lit(r"^\p{Lu}")) & ~F.lower(w).isin(*TITLE_STOP_WORDS))
    parts = [found, phrases, F.transform(capitals, lambda w: F.lower(w))]
    if tags is not None:
        low = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.lower(t))
        of_tag = F.transform(low, lambda t: F.when(t.isin(*WORDS, *PHRASES), F.array(t)).otherwise(F.array().cast("array<string>")))
        of_parts = F.transform(low, lambda t: F.filter(F.split(t, "-"), lambda p: F.contains(t, F.lit("-")) & p.isin(*WORDS)))
        both = F.flatten(F.zip_with(of_tag, of_parts, lambda a, b: F.concat(a, b)))
        parts.insert(0, F.coalesce(both, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def dictionary_matches(items: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Where texts hold phrases of a dictionary, word by word: (key, phrase, start, n_words), start in words from 0.

    A phrase within a longer one that matches is left out. Every word of a text goes with those behind it, as many as the
    longest phrase has, to the phrases that begin with it; the rest of the phrase is compared in the row. Phrases without
    letters and digits and null texts match nothing; repeated phrases count once.
    """
    book = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("tokens", words(F.col("phrase"))).where(F.size("tokens") > 0)
    book = book.select("phrase", "tokens", F.size("tokens").alias("n_words"), F.get("tokens", F.lit(0)).alias("first"))
    longest = book.agg(F.max("n_words")).first()[0] or 1
    grams = F.transform("w", lambda _, i: F.slice("w", i + 1, F.lit(longest)))
    each = items.select(F.col(key), words(F.col(text)).alias("w")).select(key, F.posexplode(grams).alias("start", "gram"))
    met = each.withColumn("first", F.get("gram", F.lit(0))).join(broadcast_within(book, BROADCAST_PHRASES), "first")
    met = met.where(F.slice("gram", F.lit(1), F.col("n_words")) == F.col("tokens")).select(key, "phrase", "start", "n_words")
    before = Window.partitionBy(key).orderBy("start", F.desc("n_words"), "phrase").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.col("start") + F.col("n_words")).over(before)
    return met.withColumn("covered", covered).where((F.col("covered").isNull()) | (F.col("covered") < F.col("start") + F.col("n_words"))).drop("covered")


def trending(items: DataFrame, key: str, topics_col: str, least: int = 3) -> DataFrame:
    """Topics of at least so many items: (topic, n)."""
    each = items.select(key, F.explode(F.array_distinct(topics_col)).alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
