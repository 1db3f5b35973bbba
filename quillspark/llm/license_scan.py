"""Licences in texts by sentence rules, with DataFrame functions only.

A text's lines are joined and cut into sentences (blank lines, list numbers, and `.`, `!` or `?` before white space cut; a single line end does not), so a notice is
the same however it is wrapped or commented; each is normalised to a-z, 0-9 and single spaces, and a name that it has a place for becomes `*`. Normalised sentences that are
known become identifiers; the identifiers of a text, in order, are matched against licence rules, each an ordered list of identifiers. Up to GAP unknown sentences may stand between two
known ones; more break the sequence. Rules are ordered, those with more identifiers first, then as they are listed (of a table: by name). From left to right, the first rule that fits at
an identifier wins and takes its identifiers, so a notice with three clauses is not one with two besides.

Sentences, rules and places for names are parameters. Up to MOST_IN_PLAN of each are part of the plan, and everything happens in the row, without a shuffle. Larger tables are joined: each
text's sentences and lines with the known sentences, and each text's first identifiers with the rules that begin so; the rows that come back are those of known sentences only.

Defined results: a null or empty text has no sentences and no licence; repeated rows are each judged; other columns are ignored; of equal known sentences the least
identifier counts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

GAP, MOST_IN_PLAN = 2, 1000

#: Known sentences, normalised; an identifier is a sentence's place, from 1.
SENTENCES = [
    "this work is licensed under the gnu general public license version 3",
    "released under the mit license",
    "licensed under cc by nc 4 0",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "see the license for the specific language governing permissions and limitations under the license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "released into the public domain",
    "this is free and unencumbered software released into the public domain",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 or later",
]
#: Licence, and the ordered identifiers that tell it.
RULES = [
    ("GPL-3.0", [1]),
    ("MIT", [2]),
    ("CC-BY-NC-4.0", [3]),
    ("Apache-2.0", [4]),
    ("Apache-2.0", [5, 6]),
    ("Apache-2.0", [6, 7]),
    ("Apache-2.0", [8, 9]),
    ("MIT", [10, 11]),
    ("MIT", [10, 12]),
    ("BSD-2-Clause", [13, 14, 15]),
    ("BSD-3-Clause", [13, 14, 15, 16]),
    ("GPL-3.0-or-later", [17, 18]),
    ("GPL-3.0-or-later", [17, 19]),
    ("CC-BY-4.0", [20]),
    ("CC-BY-SA-4.0", [21]),
    ("CC-BY-4.0", [22]),
    ("public-domain", [23]),
    ("Unlicense", [24]),
    ("MIT", [25]),
    ("Apache-2.0", [26]),
    ("GPL-3.0-or-later", [27]),
]

#: Whole sentences of the notices as they stand in them, numbered on from SENTENCES, and the rules with them.
NOTICE_SENTENCES = [
    *SENTENCES,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
]
NOTICE_RULES = [
    *RULES,
    ("MIT", [28, 11]),
    ("MIT", [28, 12]),
    ("MIT", [28, 29]),
    ("GPL-3.0-or-later", [30]),
    ("GPL-3.0-or-later", [17, 31]),
    ("Apache-2.0", [32]),
    ("Apache-2.0", [33, 9]),
]


#: Licences that have no notice above, each with the sentences, in order, that tell it; `*` stands for a name.
FREE = "{} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation {} of the license or at your option any later version"
NO_ENDORSEMENT = "may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_CLAUSES = SENTENCES[12:15]
ADVERTISING = "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by *"
#: The last clause, whole, or cut by the dots of a name.
LAST_CLAUSE = [[f"neither the name of * nor the names of its contributors {NO_ENDORSEMENT}"], ["neither the name of *", f"nor the names of its contributors {NO_ENDORSEMENT}"], ["neither the name of *", f"* nor the names of its contributors {NO_ENDORSEMENT}"], SENTENCES[15:16]]
MORE = [
    *(("BSD-4-Clause", [*BSD_CLAUSES, ADVERTISING, *last]) for last in (*LAST_CLAUSE, [])),
    *(("BSD-3-Clause", [*BSD_CLAUSES, *last]) for last in LAST_CLAUSE),
    ("BSD-3-Clause", [*BSD_CLAUSES, f"the name of * {NO_ENDORSEMENT.replace('may be', 'may not be')}"]),
    ("GPL-2.0-or-later", [FREE.format("this program", "", "either version 2")]),
    ("GPL-2.0-only", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"]),
    ("GPL-2.0-only", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"]),
    ("LGPL-2.1-or-later", [FREE.format("this library", "lesser ", "either version 2 1")]),
    ("LGPL-2.1-or-later", [FREE.format("this program", "lesser ", "either version 2 1")]),
    ("LGPL-3.0-or-later", [FREE.format("this library", "lesser ", "either version 3")]),
    ("LGPL-3.0-or-later", [FREE.format("this program", "lesser ", "either version 3")]),
    ("AGPL-3.0-or-later", [FREE.format("this program", "affero ", "either version 3")]),
    *(("MPL-2.0", ["this source code form is subject to the terms of the mozilla public license" + v]) for v in ("", " v")),
    ("MPL-2.0", ["this source code form is subject to the terms of the mozilla public license version 2 0"]),
    ("MPL-1.1", ["the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"]),
    ("ISC", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"]),
    ("ISC", ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"]),
    ("0BSD", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("Zlib", ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"]),
    ("EPL-2.0", ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"]),
    ("EPL-2.0", ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"]),
    ("EPL-1.0", ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"]),
    ("BSL-1.0", ["distributed under the boost software license version 1 0"]),
    ("BSL-1.0", ["boost software license version 1 0 august 17th 2003"]),
    ("CC0-1.0", ["to the extent possible under law * have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"]),
    ("WTFPL", ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"]),
    *((name, ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())]) for name in ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib")),
]
NOTICE_SENTENCES += [s for s in dict.fromkeys(s for _, parts in MORE for s in parts) if s not in NOTICE_SENTENCES]
NOTICE_RULES += [(name, [NOTICE_SENTENCES.index(s) + 1 for s in parts]) for name, parts in MORE]
#: Code points that a name may have.
LONGEST_NAME = 120


#: Comment words at the start of a line; and what cuts sentences: list numbers, ends of sentences, blank lines (also those of comment marks alone), with what stands for them.
LEADER = r"(?mi)^[ \t]*(?:rem|dnl)\b"
CUTS = (
    (r"(?:^|\n|:[ \t])[^A-Za-z0-9\n]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", "\x01"),
    (r"""[.!?]+["')\]]*(?:[ \t\n]|\z)""", "\x01\n"),
    (r"\n(?:[^A-Za-z0-9\n\x01]*\n)+", "\x01"),
)


def plain_sentences(text: Column) -> Column:
    """The sentences of a text, normalised, with the line ends inside them. Comment leaders go with the other marks."""
    cut = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), LEADER, "")
    for pattern, by in CUTS:
        cut = F.regexp_replace(cut, pattern, by)
    plain = F.regexp_replace(F.regexp_replace(F.translate(cut, UPPER, LOWER), r"[^a-z0-9\n\x01]+", " "), r" ?\n ?", "\n")
    return F.split(plain, "\x01", -1)


def whole(sentence: Column) -> Column:
    return F.trim(F.translate(sentence, "\n", " "))


def places(sentences: list[str]) -> list[tuple[str, str]]:
    """What stands before and behind the place for a name in the sentences that have one."""
    return [tuple(s.split("*", 1)) for s in sentences if "*" in s]


def fitting(sentence: Column, names: list[tuple[str, str]]) -> list[Column]:
    """Whether a sentence, a plain value, has a name in each of the places."""
    size = F.length(sentence)
    return [F.startswith(sentence, F.lit(a)) & F.endswith(sentence, F.lit(b)) & size.between(len(a) + len(b) + 1, len(a) + len(b) + LONGEST_NAME) for a, b in names]


def named(sentence: Column, names: list[tuple[str, str]]) -> Column:
    """The sentence, with `*` for a name that it has a place for."""
    out = sentence
    for (before, behind), fits in reversed(list(zip(names, fitting(sentence, names), strict=True))):
        out = F.when(fits, f"{before}*{behind}").otherwise(out)
    return out


def joined_sentences(text: Column, known: Column, names: list[tuple[str, str]]) -> Column:
    """The sentences of a text, none empty. A line that is a known sentence stands for itself where the sentence around it is none."""

    def is_known(x: Column) -> Column:
        return F.array_contains(known, x) | (reduce(Column.__or__, fitting(x, names), F.lit(False)) & F.array_contains(known, named(x, names)))

    def parts(s: Column) -> Column:
        marked = F.transform(F.transform(F.split(s["s"], "\n", -1), lambda x: F.trim(x)), lambda x: F.when(is_known(x), F.concat(F.lit("\x01"), x, F.lit("\x01"))).otherwise(x))
        alone = ~F.contains(s["s"], F.lit("\n")) | is_known(s["whole"])
        return F.when(alone, F.array(s["whole"])).otherwise(F.split(F.array_join(marked, " "), "\x01", -1))

    # each value is made once, and named before it is compared
    sentences = F.transform(plain_sentences(text), lambda s: F.struct(s.alias("s"), whole(s).alias("whole")))
    found = F.filter(F.transform(F.flatten(F.transform(sentences, parts)), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(found, lambda x: F.when(F.array_contains(known, x), x).otherwise(named(x, names)))


def ordered(rules: list[tuple[str, list[int]]]) -> list[tuple[str, str]]:
    """The rules in their order: name and pattern."""
    return [(name, pattern(ids)) for name, ids in sorted((r for r in rules if r[1]), key=lambda r: -len(r[1]))]


def pattern(ids: list[int]) -> str:
    return rf"\b{' '.join(map(str, ids))} "


def scan(docs: DataFrame, sentences: list[str] | DataFrame | None = None, rules: list[tuple[str, list[int]]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", names: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_sentences, n_known, sequence (like ` 4 3 | 5 6 `), licences (names of the rules that fit, sorted, comma-joined) of every row.

    sentences: normalised ones, numbered from 1, or a table (id int, sentence). rules: (name, identifiers), or a table (name, ids array<int>).
    names: what stands before and behind a name, for sentences with `*`; those of a list of sentences are taken from it."""
    sentences, rules = NOTICE_SENTENCES if sentences is None else sentences, NOTICE_RULES if rules is None else rules
    names = places(sentences) if names is None and isinstance(sentences, list) else names or []
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(sentences, list) and len(sentences) <= MOST_IN_PLAN:
        known = F.array(*map(F.lit, sentences)).cast("array<string>")
        found = numbered(rows, known, names, lambda x: F.array_position(known, x))
    else:
        if isinstance(sentences, list):
            sentences = spark.createDataFrame(list(enumerate(sentences, 1)), "id int, sentence string")
        table = sentences.groupBy("sentence").agg(F.min("id").cast("int").alias("id"))
        rows = rows.withColumn("key", F.xxhash64("text"))  # equal texts have equal sentences
        own = rows.select("key", "text").dropDuplicates(["key"])
        wanted = own.select("key", F.explode(F.array_distinct(F.flatten(F.transform(plain_sentences(F.col("text")), lambda y: F.concat(F.array(whole(y), named(whole(y), names)), F.transform(F.split(y, "\n", -1), lambda x: F.trim(x)), F.transform(F.split(y, "\n", -1), lambda x: named(F.trim(x), names))))))).alias("sentence"))
        hits = wanted.join(table, "sentence").groupBy("key").agg(F.collect_list(F.struct("sentence", "id")).alias("hits"))
        joined = rows.join(hits, "key", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<sentence: string, id: int>>")))
        texts = F.transform("hits", lambda h: h["sentence"])
        found = numbered(joined, texts, names, lambda x: F.coalesce(F.get(F.col("hits"), F.array_position(texts, x).cast("int") - 1)["id"], F.lit(0)))
    if isinstance(rules, list) and len(rules) <= MOST_IN_PLAN:
        listed = ordered(rules)
        fits = F.regexp_extract_all("sequence", F.lit("|".join(p for _, p in listed)), F.lit(0)) if listed else F.array().cast("array<string>")
        keys, values = (F.array(*map(F.lit, x)).cast("array<string>") for x in ([p.removeprefix("\\b") for _, p in listed], [name for name, _ in listed]))
        return found.withColumn("licences", F.when(F.col("n_known") > 0, licence_names(F.transform(fits, lambda m: F.get(values, F.array_position(keys, m).cast("int") - 1)))).otherwise("")).drop("k")
    if isinstance(rules, list):
        rules = spark.createDataFrame([(name, ids, k) for k, (name, ids) in enumerate(rules)], "name string, ids array<int>, place int")
    place = F.col("place") if "place" in rules.columns else F.lit(0)
    begin = rules.filter(F.size("ids") > 0).select(F.struct((-F.size("ids")).alias("size"), place.alias("place"), "name", F.concat(F.array_join(F.col("ids").cast("array<string>"), " "), F.lit(" ")).alias("key")).alias("rule"), F.get("ids", F.lit(0)).alias("id"))
    # sequences are few kinds next to the rows
    kinds = found.filter("n_known > 0").select("sequence", F.transform("k", lambda x: x["id"].cast("int")).alias("ids")).distinct()
    fits = kinds.select("sequence", F.explode(F.array_distinct("ids")).alias("id")).join(begin, "id").filter(F.contains("sequence", F.concat(F.lit(" "), F.col("rule.key"))))
    own = fits.groupBy("sequence").agg(F.sort_array(F.collect_set("rule")).alias("own"))
    found_rules = F.regexp_extract_all("sequence", F.array_join(F.transform("own", lambda r: F.concat(F.lit("\\b"), r["key"])), "|"), F.lit(0))
    names_of = own.select("sequence", F.transform(found_rules, lambda m: F.get(F.filter("own", lambda r: r["key"] == m), F.lit(0))["name"]).alias("names"))
    return found.join(names_of, "sequence", "left").select("doc_id", "n_sentences", "n_known", "sequence", F.coalesce(licence_names(F.col("names")), F.lit("")).alias("licences"))


def licence_names(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")


def numbered(rows: DataFrame, known: Column, names: list[tuple[str, str]], number) -> DataFrame:
    """doc_id, n_sentences, n_known, sequence and k (place and identifier of each known sentence) of rows of doc_id and text; number gives a sentence's identifier, or 0."""
    s = rows.withColumn("s", joined_sentences(F.col("text"), known, names))
    found = s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.filter(F.transform("s", lambda x, i: F.struct(i.alias("at"), number(x).alias("id"))), lambda x: x["id"] > 0).alias("k"))
    # a known sentence more than GAP unknown ones after the last known one begins a new stretch
    parts = F.transform("k", lambda x, i: F.concat(F.when((i > 0) & (x["at"] - F.get("k", i - 1)["at"] > GAP + 1), "| ").otherwise(""), x["id"].cast("string")))
    return found.select("doc_id", "n_sentences", F.size("k").cast("long").alias("n_known"), F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" ")).alias("sequence"), "k")


def oracle(sentences: list[str] | None = None, rules: list[tuple[str, list[int]]] | None = None) -> str:
    sentences, rules = sentences or NOTICE_SENTENCES, rules or NOTICE_RULES
    known = "[" + ", ".join(f"'{s}'" for s in sentences) + "]"
    listed = ordered(rules)
    keys, values = (f"[{', '.join(x)}]" for x in ([f"'{p[2:]}'" for _, p in listed], [f"'{name}'" for name, _ in listed]))

    def name(x: str) -> str:
        cases = " ".join(f"WHEN starts_with({x}, '{a}') AND ends_with({x}, '{b}') AND length({x}) - {len(a) + len(b)} BETWEEN 1 AND {LONGEST_NAME} THEN '{a}*{b}'" for a, b in places(sentences))
        return f"CASE {cases} ELSE {x} END"

    quote = CUTS[1][0].replace("'", "''")
    x = f"regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '{LEADER}', '', 'g')"
    for pattern_, by in ((CUTS[0][0], "chr(1)"), (quote, "chr(1) || chr(10)"), (CUTS[2][0], "chr(1)")):
        x = f"regexp_replace({x}, '{pattern_}', {by}, 'g')"
    x = f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9\n\x01]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return f"""
WITH n AS (SELECT {known} AS known),
cut AS (SELECT doc_id, string_split({x}, chr(1)) AS y FROM documents),
parts AS (SELECT doc_id, known, list_transform(list_filter(list_transform(flatten(list_transform(y, lambda q: CASE WHEN list_contains(known, trim(translate(q, chr(10), ' '))) OR list_contains(known, {name("trim(translate(q, chr(10), ' '))")}) THEN [trim(translate(q, chr(10), ' '))]
  ELSE string_split(array_to_string(list_transform(string_split(q, chr(10)), lambda z: CASE WHEN list_contains(known, trim(z)) OR list_contains(known, {name("trim(z)")}) THEN chr(1) || z || chr(1) ELSE z END), ' '), chr(1)) END)), lambda z: trim(z)), lambda z: z <> ''), lambda z: CASE WHEN list_contains(known, z) THEN z ELSE {name("z")} END) AS s FROM cut, n),
ids AS (SELECT doc_id, len(s) AS n_sentences, list_filter(list_transform(range(1, len(s) + 1), lambda i: {{'at': i, 'id': coalesce(list_position(known, s[i]), 0)}}), lambda z: z.id > 0) AS k FROM parts),
seqs AS (
  SELECT doc_id, n_sentences, len(k) AS n_known,
    ' ' || array_to_string(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN i > 1 AND k[i].at - k[i - 1].at > {GAP + 1} THEN '| ' ELSE '' END || k[i].id), ' ') || ' ' AS sequence
  FROM ids)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_known AS BIGINT) AS n_known, sequence,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(sequence, '{"|".join(p for _, p in listed)}'), lambda m: {values}[list_position({keys}, m)]))), ','), '') AS licences
FROM seqs"""
