"""Licence scan by sentence rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import SPACE, documents, let

#: Sentences of public licences and notices, or the part of them that does not vary, as they stand in them.
SENTENCES = {
    "mit-reference": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "apache-reference": "Licensed under the Apache License, Version 2.0",
    "apache-terms": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-terms": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version",
    "gpl2-terms": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
    "License, or (at your option) any later version",
    "gpl2-only-terms": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl21-terms": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
    "the License, or (at your option) any later version",
    "lgpl3-terms": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of "
    "the License, or (at your option) any later version",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-terms": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
    "the License, or (at your option) any later version",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "unlicense-head": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-reference": "Licensed under CC BY-NC 4.0",
    "cc-by-reference": "Licensed under CC BY 4.0",
    "cc-by-sa-reference": "Licensed under CC BY-SA 4.0",
    "cc0-reference": "Released under CC0 1.0",
    "reserved": "All rights reserved",
}
#: Names that stand behind ``SPDX-License-Identifier:``.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "CC0-1.0", "Unlicense"]
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: Rules in the order in which they are tried; a rule needs its sentences one after the other.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-reference"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-terms", "apache-copy"]),
    ("Apache-2.0", ["apache-reference"]),
    ("Apache-2.0", ["apache-terms"]),
    ("GPL-3.0-or-later", ["gpl3-terms", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl2-terms", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-terms"]),
    ("GPL-2.0-only", ["gpl2-only-terms", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only-terms"]),
    ("LGPL-2.1-or-later", ["lgpl21-terms", "lgpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-terms"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["agpl3-terms", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-terms"]),
    ("GPL-3.0", ["gpl3-reference"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("Unlicense", ["unlicense-head"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-reference"]),
    ("CC-BY-4.0", ["cc-by-reference"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-reference"]),
    ("CC0-1.0", ["cc0-reference"]),
    *[(name, [f"spdx-{name}"]) for name in SPDX],
    ("MIT-incomplete", ["mit-grant"]),
    ("BSD-incomplete", ["bsd-head"]),
    ("all-rights-reserved", ["reserved"]),
]
#: A sentence ends with a mark before white space or the end, or with a blank line.
END = rf"[.!?]+(?:{SPACE}+|\z)|\n[\x20\x09\x0D]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of other words, in normal form, that may stand between two sentences of one licence (an address, a name).
GAP = 400
_OPEN, _CLOSE = "<", ">"


def _words(text: str) -> list[str]:
    """The normal form of a known sentence as words: that of ``_normal``."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def _normal(text: Column) -> Column:
    """Lower-case letters and digits, two blanks between words, one at either end: words of one sentence and the next share none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", "  ")), F.lit(" "))


def scan_licences(
    df: DataFrame, text: str = "text", sentences: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
) -> DataFrame:
    """Adds ``n_sentences``, ``sentence_ids``, ``licences`` and ``n_unmatched`` (columns of these names are replaced).

    A text is brought to a normal form (letters and digits, lower case), in which line breaks, comment marks and quotes
    are gone, and the known licence sentences are looked up in it as sequences of whole words, the longest first, wherever they
    stand. What lies between two of them is a gap if it is longer than ``GAP`` characters. Rules are tried in their order on
    the sequence of identifiers: a rule that finds its identifiers side by side names a licence and uses them up, wherever
    they stand. ``sentence_ids``: identifiers in text order; ``licences``: names in code point order, each once;
    ``n_unmatched``: known sentences that no rule used; ``n_sentences``: pieces of the text between sentence marks and blank lines.

    Every row is scanned where it lies: no shuffle. Null or empty text has no sentence and no licence.
    """
    known = sorted(((" " + "  ".join(_words(s)) + " ", name) for name, s in sentences.items()), key=lambda x: (-len(x[0]), x[0]))
    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(ids) + "|").alias("ids")) for name, ids in rules])

    def attempt(state: Column, rule: Column) -> Column:
        # Neighbours share a separator, so a run of one rule needs two passes.
        used = F.replace(F.replace(state["left"], rule["ids"], F.lit("|+|")), rule["ids"], F.lit("|+|"))
        names = F.when(used == state["left"], state["names"]).otherwise(F.array_append(state["names"], rule["name"]))
        return F.struct(used.alias("left"), names.alias("names"))

    def mark(line: Column, pair: Column) -> Column:
        return F.replace(line, pair["words"], F.concat(F.lit(_OPEN), pair["name"], F.lit(_CLOSE)))

    def sequence(marked: Column) -> Column:
        # Pieces alternate between other words and identifiers.
        pieces = F.transform(F.split(marked, f"[{_OPEN}{_CLOSE}]"), lambda s, i: F.when(i % 2 == 1, s).when(F.length(F.trim(s)) > GAP, "?").otherwise(""))
        return F.filter(pieces, lambda s: s != "")

    pairs = F.array(*[F.struct(F.lit(words).alias("words"), F.lit(name).alias("name")) for words, name in known])
    none = F.array().cast("array<string>")

    def of(marked: Column) -> Column:
        ids = F.when(F.contains(marked, F.lit(_OPEN)), sequence(marked)).otherwise(none)
        start = lambda ids: F.struct(F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("left"), none.alias("names"))
        return let(ids, lambda ids: let(F.when(F.size(ids) == 0, start(ids)).otherwise(F.aggregate(tried, start(ids), attempt)), lambda end: F.struct(
            F.array_join(F.filter(ids, lambda s: s != "?"), ",").alias("sentence_ids"),
            F.array_join(F.array_sort(F.array_distinct(end["names"])), ",").alias("licences"),
            F.size(F.filter(F.split(end["left"], "[|]"), lambda s: ~s.isin("", "?", "+"))).cast("long").alias("n_unmatched"))))

    whole = F.coalesce(F.col(text), F.lit(""))
    count = F.size(F.filter(F.split(whole, END), lambda s: s.rlike("[A-Za-z0-9]"))).cast("long")
    found = let(F.aggregate(pairs, _normal(whole), mark), of)
    kept = [c for c in df.columns if c not in ("n_sentences", "sentence_ids", "licences", "n_unmatched")]
    return df.select(*[F.col(f"`{c}`") for c in kept], count.alias("n_sentences"), found.alias("_found")).select(
        *[F.col(f"`{c}`") for c in kept], "n_sentences", "_found.sentence_ids", "_found.licences", "_found.n_unmatched")


def q_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _sql() -> str:
    """Finds the sentences as windows of a list of words, instead of in a normalised text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {_words(s)}::VARCHAR[], {len(' '.join(_words(s)))})" for name, s in SENTENCES.items())
    steps, names, last = [], [], "s0"
    for k, (name, ids) in enumerate(RULES):
        p = quote("|" + "|".join(ids) + "|")
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (replace(replace(l, {p}, '|+|'), {p}, '|+|') AS l), "
                     f"contains(l, {p}) AS r{k} FROM s{k})")
        names.append(f"CASE WHEN r{k} THEN {quote(name)} END")
        last = f"s{k + 1}"
    return f"""
WITH known(name, words, size) AS (VALUES {known}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), {quote(END)}), lambda s: regexp_matches(s, '[A-Za-z0-9]')))::BIGINT AS n_sentences,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents
), places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (
  SELECT r, i, i + len(words) - 1 AS e, name, size FROM places JOIN known ON w[i] = words[1] AND w[i:i + len(words) - 1] = words
), free AS (
  SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.r = h.r AND g.size > h.size AND g.i <= h.e AND g.e >= h.i)
), gaps AS (SELECT *, lag(e) OVER (PARTITION BY r ORDER BY i) AS before FROM free),
line AS (
  SELECT g.r, string_agg(name, ',' ORDER BY i) AS sentence_ids, max(e) AS last,
    '|' || string_agg(CASE WHEN length(array_to_string(w[coalesce(before, 0) + 1:i - 1], '  ')) > {GAP} THEN '?|' ELSE '' END || name, '|' ORDER BY i) || '|' AS l
  FROM gaps g JOIN docs USING (r) GROUP BY g.r
), s0 AS (
  SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
    coalesce(l || CASE WHEN length(array_to_string(w[last + 1:], '  ')) > {GAP} THEN '?|' ELSE '' END, '||') AS l FROM docs LEFT JOIN line USING (r)
), {', '.join(steps)}
SELECT doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL))), ','), '') AS licences,
  len(list_filter(string_split(l, '|'), lambda x: x NOT IN ('', '?', '+')))::BIGINT AS n_unmatched
FROM {last}
"""


SQL = _sql()
QUERIES = {"op8_licence_sentences": (q_licences, SQL)}
