"""Licences by sentence rules: known sentences give identifiers, ordered rules match sequences of identifiers.

A text is normalised with its sentence and line ends marked, and known licence sentences are looked for between marks;
they may run over line ends and clauses. The identifiers of a text, in order and without what lies between, are matched
against rules; longer rules come first and use up what they match.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import columns

#: Identifiers and normalised licence sentences, as the licences themselves have them.
SENTENCES = (
    ("apache-short", "licensed under the apache license version 2 0"),
    ("apache-grant", "licensed under the apache license version 2 0 the license"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-short", "released under the mit license"),
    ("mit-short", "licensed under the mit license"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("bsd-permit", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc-short", "licensed under cc by nc 4 0"),
    ("cc-by-nc-short", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-short", "licensed under cc by 4 0"),
    ("cc-by-short", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
)
#: Ordered rules: name, licence, identifiers that follow one another. Earlier rules use up what they match.
RULES = (
    ("apache-2.0-header", "Apache-2.0", ("apache-grant", "apache-comply", "apache-obtain", "apache-basis", "apache-see")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("mit-titled-text", "MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary")),
    ("apache-2.0-grant", "Apache-2.0", ("apache-grant", "apache-comply")),
    ("apache-2.0-short", "Apache-2.0", ("apache-short",)),
    ("mit-short", "MIT", ("mit-short",)),
    ("gpl-3.0-short", "GPL-3.0-only", ("gpl3-short",)),
    ("cc-by-nc-4.0-short", "CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("cc-by-4.0-short", "CC-BY-4.0", ("cc-by-short",)),
    ("cc0-1.0", "CC0-1.0", ("cc0",)),
    ("all-rights-reserved", "proprietary", ("reserved",)),
)
#: Marks in normalised text, capitals as all else is lower case: S ends a sentence, N a line, and W a clause. A known sentence
#: begins and ends at a mark. Inside it one N or a run of W may stand for a blank; S and a blank line (N twice) may not.
MARKS = ((r"[.!?][ \t\f\r\n]", "S"), (r"\n", "N"), (r"[;:][ \t\f\r]", "W"), (r"[^a-z0-9NSW]+", " "))


def marked(text: Column) -> Column:
    """Lower case, a mark for each end of a sentence, line or clause, other runs of anything but a-z and 0-9 as one blank."""
    text = F.lower(text)
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(F.concat(F.lit("S"), text, F.lit("S")), " ?([NSW]) ?", "$1")
    return F.regexp_replace(text, "(?<!W)W*+([NS])W*+", "$1")


def _known() -> str:
    """A pattern of all known sentences between marks, longer ones first."""
    texts = sorted({text for _, text in SENTENCES}, key=lambda t: (-len(t), t))
    return "(?<=[NSW])(?:" + "|".join(t.replace(" ", "(?: |N|W++)") for t in texts) + ")(?=[NSW])"


def _pattern(names: tuple[str, ...]) -> str:
    return "".join(f"<{n}>" for n in names)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sentence_ids (identifiers in order), rules (names in the order of RULES), licenses.

    sentence_ids holds every known sentence of the whole text, repeats included, also those wrapped over several lines. licenses is the sorted set of the matched
    rules' licences. Null, empty or blank texts give empty lists. Rows with a null id and repeated rows each give a row.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = columns(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    known = F.create_map(*[F.lit(x) for name, text in SENTENCES for x in (text, name)])
    hits = F.regexp_extract_all(marked(F.col("text")), F.lit(_known()), F.lit(0))
    ids = F.transform(hits, lambda s: F.element_at(known, F.regexp_replace(s, "[NW]+", " ")))
    rows = rows.select("doc_id", ids.alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(licence).alias("licence"), F.lit(_pattern(ids)).alias("pattern")) for name, licence, ids in RULES])
    sequence = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["pattern"])
        return F.struct(F.when(hit, F.replace(state["rest"], rule["pattern"], F.lit("<>"))).otherwise(state["rest"]).alias("rest"), F.when(hit, F.concat(state["hits"], F.array(rule))).otherwise(state["hits"]).alias("hits"))

    start = F.struct(sequence.alias("rest"), F.array().cast("array<struct<name:string,licence:string,pattern:string>>").alias("hits"))
    hits = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step, lambda s: s["hits"])).otherwise(start["hits"])
    rows = rows.withColumn("hits", hits)
    return rows.select("doc_id", "sentence_ids", F.transform("hits", lambda h: h["name"]).alias("rules"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"]))).alias("licenses"))


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, and sentence_ids, rules and licenses joined by commas."""
    rows = scan_licenses(docs)
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licenses")])


def duckdb_sql() -> str:
    """DuckDB twin: sentences by a line break after each mark, then the rules one after another.

    It knows only sentences that stand on one line without an inner `;` or `:`, and so is narrower than scan_licenses.
    """
    known = ", ".join(f"('{text}', '{name}')" for name, text in SENTENCES)
    steps, hits = ["q AS r0"], []
    for n, (name, licence, ids) in enumerate(RULES):
        steps.append(f"replace(r{n}, '{_pattern(ids)}', '<>') AS r{n + 1}")
        hits.append(f"CASE WHEN contains(r{n}, '{_pattern(ids)}') THEN {{'name': '{name}', 'licence': '{licence}'}} END")
    return f"""
WITH known(s, id) AS (VALUES {known}), cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\f\\r]+', '\\1\n', 'g'), chr(10))) AS s,
    generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\f\\r]+', '\\1\n', 'g'), chr(10)), 1) AS n FROM documents
), found AS (
  SELECT doc_id, list(id ORDER BY n) AS ids FROM (SELECT doc_id, n, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut WHERE length(s) >= 5) JOIN known USING (s) GROUP BY doc_id
), q AS (
  SELECT doc_id, coalesce(ids, []) AS ids, coalesce('<' || array_to_string(ids, '><') || '>', '') AS q FROM documents LEFT JOIN found USING (doc_id)
), r AS (
  SELECT doc_id, ids, {', '.join(steps)} FROM q
), h AS (
  SELECT doc_id, ids, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS h FROM r
)
SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_transform(h, lambda x: x.name), ','), '') AS rules,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.licence))), ','), '') AS licenses FROM h
"""
