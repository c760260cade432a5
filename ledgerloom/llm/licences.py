"""Licence scans: sentences become identifiers, and sequences of identifiers match ordered licence rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of licences and their identifiers. Case, punctuation and spacing do not matter.
SENTENCES = {
    "Released under the MIT License": "mit-ref",
    "Licensed under the MIT License": "mit-ref",
    "This software is released under the MIT License": "mit-ref",
    "MIT License": "mit-title",
    "The MIT License (MIT)": "mit-title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software": "mit-grant-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software": "mit-notice",
    "Licensed under the Apache License, Version 2.0": "apache-2-ref",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
    " with the License": "apache-2-grant",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
    " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-as-is",
    "See the License for the specific language governing permissions and limitations under the License": "apache-see",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3-ref",
    "This work is licensed under the GNU General Public License, version 2": "gpl-2-ref",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
    " later version": "gpl-3-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
    " later version": "gpl-2-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl-no-warranty",
    "See the GNU General Public License for more details": "gpl-see",
    "Licensed under CC BY 4.0": "cc-by-4-ref",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4-ref",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4-ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4-ref",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:": "bsd-grant",
    "All rights reserved": "all-rights",
    "SPDX-License-Identifier: MIT": "spdx-mit",
    "SPDX-License-Identifier: Apache-2.0": "spdx-apache-2",
    "SPDX-License-Identifier: GPL-3.0-only": "spdx-gpl-3",
}
#: Rules in order. Each takes its identifiers, which must follow each other, out of the sequence.
RULES = (
    (("mit-title", "copyright", "mit-grant", "mit-notice"), "MIT"),
    (("mit-title", "copyright", "mit-grant-notice"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-grant-notice",), "MIT"),
    (("apache-2-grant", "apache-2-copy", "apache-as-is", "apache-see"), "Apache-2.0"),
    (("apache-2-grant", "apache-2-copy"), "Apache-2.0"),
    (("apache-2-grant",), "Apache-2.0"),
    (("gpl-3-later", "gpl-no-warranty", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl-3-later",), "GPL-3.0-or-later"),
    (("gpl-2-later", "gpl-no-warranty", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl-2-later",), "GPL-2.0-or-later"),
    (("spdx-mit",), "MIT"),
    (("spdx-apache-2",), "Apache-2.0"),
    (("spdx-gpl-3",), "GPL-3.0-only"),
    (("mit-ref",), "MIT"),
    (("mit-title",), "MIT"),
    (("apache-2-ref",), "Apache-2.0"),
    (("gpl-3-ref",), "GPL-3.0-only"),
    (("gpl-2-ref",), "GPL-2.0-only"),
    (("cc-by-nc-4-ref",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-ref",), "CC-BY-SA-4.0"),
    (("cc-by-4-ref",), "CC-BY-4.0"),
    (("bsd-grant",), "BSD"),
)
#: What a sentence of a licence has in it. Other sentences are not looked up.
SIGNS = r"(?i)licen[cs]e|copyright|permission|warrant|redistribut|as is|rights reserved"
#: Ends of sentences, and a notice whose owner and years do not matter.
SENTENCE_END = r"[.!?]+(?:[ \t\r\n]|\z)"
NOTICE = r"^copyright .*$"


def normal(text: str) -> str:
    """A known sentence as it is looked up."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text).split()).lower()


def _normal(sentence: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))
    return F.regexp_replace(plain, NOTICE, "copyright")


def known_sentences(sentences: dict[str, str] | None = None) -> dict[str, str]:
    known = {normal(text): name for text, name in (sentences or SENTENCES).items()}
    return known | {"copyright": "copyright"}


def _pattern(known: dict[str, str]) -> str:
    """What finds the known sentences, the longest first, in a text whose sentences end in \\x01 and lines in \\x02. A
    sentence begins and ends where a sentence or a line does, and may run over lines, but for one that is made of
    two others: over lines these are found."""
    found = [NOTICE.replace("^", "").replace(".*$", r"[^\x01\x02]*+")]
    for words in sorted(known, key=lambda k: (-len(k), k)):
        double = any(words.startswith(k + " ") and words[len(k) + 1 :] in known for k in known)
        found.append(words if double else words.replace(" ", r"[ \x02]++"))
    return r"(?<=^|[\x01\x02]) ?(" + "|".join(found) + r")(?= ?(?:[\x01\x02]|\z))"


def licences(
    docs: DataFrame,
    sentences: dict[str, str] | None = None,
    rules: Sequence[tuple[Sequence[str], str]] = RULES,
    text: str = "text",
) -> DataFrame:
    """For each document: doc_id, n_signs (sentences that look like a licence's), sentence_ids (identifiers of the
    known ones, comma-joined in order), licences (the rules' names in order, each once, comma-joined), n_unmatched
    (known sentences that no rule took).

    A sentence ends with a line or with `.`, `!` or `?` before a blank; a known one is also found where it runs over
    lines, with comment marks and blank lines in it. Signs are counted by line. Sentences without a known identifier
    are left out of the sequence, so a rule's sentences may have others between them. Rules apply in order, each as
    often as it matches. Everything is built-in functions on one row: nothing is shuffled. A null or empty text has no sentences;
    repeated rows are scanned alike; other columns are not read.
    """
    known = known_sentences(sentences)
    lookup = F.create_map(*[F.lit(part) for pair in sorted(known.items()) for part in pair])
    steps = F.array(
        *[
            F.struct(F.lit(f",{',,'.join(ids)},").alias("ids"), F.lit(name).alias("name"))
            for ids, name in rules
        ]
    )
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.regexp_replace(body, SENTENCE_END, "\n"), "\n")
    # Where a sentence ended at a line's end, its mark stands for both.
    marked = F.regexp_replace(F.translate(body, "\x01\x02", "  "), SENTENCE_END, "\x01")
    marked = F.lower(F.regexp_replace(F.translate(marked, "\n", "\x02"), r"[^A-Za-z0-9\x01\x02]+", " "))
    rows = (
        docs.select(
            "doc_id",
            F.when(body.rlike(SIGNS), F.filter(lines, lambda s: s.rlike(SIGNS)))
            .otherwise(F.array().cast("array<string>")).alias("_signs"),
            F.when(body.rlike(SIGNS), F.regexp_extract_all(marked, F.lit(_pattern(known)), F.lit(1)))
            .otherwise(F.array().cast("array<string>")).alias("_known"),
        )
        .withColumn(
            "_ids",
            F.filter(F.transform("_known", lambda s: F.try_element_at(lookup, _normal(s))), lambda i: i.isNotNull()),
        )
    )
    start = F.struct(
        # Each identifier between commas of its own.
        F.array_join(F.transform("_ids", lambda i: F.concat(F.lit(","), i, F.lit(","))), "").alias("rest"),
        F.array().cast("array<string>").alias("found"),
    )

    def apply(state: Column, rule: Column) -> Column:
        return F.struct(
            F.replace(state["rest"], rule["ids"], F.lit("")).alias("rest"),
            F.when(F.contains(state["rest"], rule["ids"]), F.array_append(state["found"], rule["name"]))
            .otherwise(state["found"]).alias("found"),
        )

    return rows.withColumn("_end", F.aggregate(steps, start, apply)).select(
        "doc_id",
        F.size("_signs").cast("bigint").alias("n_signs"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("_end.found"), ",").alias("licences"),
        ((F.length("_end.rest") - F.length(F.replace(F.col("_end.rest"), F.lit(","), F.lit("")))) / 2)
        .cast("bigint").alias("n_unmatched"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same over the whole documents table, as DuckDB SQL."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(known_sentences().items()))
    rests = ["s0 as (select doc_id, signs, ids, coalesce(list_aggregate(list_transform(ids, lambda i: ',' || i || ','),"
             " 'string_agg', ''), '') as rest, []::varchar[] as found from named)"]  # fmt: skip
    for at, (ids, name) in enumerate(RULES):
        pattern = _quoted(f",{',,'.join(ids)},")
        rests.append(
            f"s{at + 1} as (select doc_id, signs, ids, replace(rest, {pattern}, '') as rest, case when contains(rest,"
            f" {pattern}) and not list_contains(found, {_quoted(name)}) then list_append(found, {_quoted(name)})"
            f" else found end as found from s{at})"
        )
    end = SENTENCE_END.replace("\\z", "$")
    return f"""with known as (select map_from_entries([{known}]) as lookup),
        lines as (select doc_id, case when regexp_matches(coalesce(text, ''), '{SIGNS}') then list_filter(
            string_split(regexp_replace(text, '{end}', chr(10), 'g'), chr(10)),
            lambda s: regexp_matches(s, '{SIGNS}')) else []::varchar[] end as signs from documents),
        named as (select doc_id, signs, list_filter(list_transform(signs, lambda s: lookup[regexp_replace(
            lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))), '{NOTICE}', 'copyright')]),
            lambda i: i is not null) as ids from lines, known),
        {', '.join(rests)}
        select doc_id, cast(len(signs) as bigint) as n_signs, coalesce(array_to_string(ids, ','), '') as sentence_ids,
            coalesce(array_to_string(found, ','), '') as licences,
            cast((length(rest) - length(replace(rest, ',', ''))) / 2 as bigint) as n_unmatched from s{len(RULES)}"""
