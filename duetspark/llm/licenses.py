"""Licence scans: known licence sentences, then ordered rules over their identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

# Sentences of widely used public licences, by identifier.
SENTENCES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2.0-comply": "you may not use this file except in compliance with the License.",
    "apache-2.0-copy": "You may obtain a copy of the License at",
    "apache-2.0-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this program.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl-2.0-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-obtain-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

# Licence list identifiers of the one-line form "SPDX-License-Identifier: ...".
SPDX = ["Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense"]
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}

# A licence and its sentences in order; a rule that another one extends stands after it.
RULES = [
    ("apache-2.0", ["apache-2.0-line"]),
    ("apache-2.0", ["apache-2.0-grant", "apache-2.0-comply"]),
    ("mit", ["mit-line"]),
    ("mit", ["mit-licensed"]),
    ("mit", ["mit-grant", "mit-notice"]),
    ("gpl-2.0", ["gpl-2.0-line"]),
    ("gpl-2.0", ["gpl-2.0-redistribute", "gpl-warranty"]),
    ("gpl-3.0", ["gpl-3.0-line"]),
    ("gpl-3.0", ["gpl-redistribute", "gpl-warranty"]),
    ("lgpl-2.1", ["lgpl-2.1-redistribute", "lgpl-warranty"]),
    ("lgpl-3.0", ["lgpl-3.0-redistribute", "gpl-warranty"]),
    ("agpl-3.0", ["agpl-3.0-redistribute", "gpl-warranty"]),
    ("mpl-2.0", ["mpl-2.0-subject", "mpl-2.0-obtain"]),
    ("mpl-2.0", ["mpl-2.0-subject", "mpl-2.0-obtain-https"]),
    ("cc-by-nc-4.0", ["cc-by-nc-4.0-line"]),
    ("cc-by-4.0", ["cc-by-4.0-line"]),
    ("cc-by-sa-4.0", ["cc-by-sa-4.0-line"]),
    ("cc0-1.0", ["cc0-line"]),
    ("unlicense", ["unlicense-public"]),
    ("bsd-3-clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("isc", ["isc-grant"]),
]
RULES += [(x.lower().removesuffix("-only").removesuffix("-or-later"), [f"spdx-{x.lower()}"]) for x in SPDX]

#: A text is cut after each of these before white space and at every line end.
CUTS = r"[.:;!?]+\s+|[\r\n]+"
#: Pieces that a sentence may be put together from: headers are wrapped at will.
LINES = 24


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits, single spaces for whatever is between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _words(sentence: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


def _by_words(sentences: dict[str, str]) -> dict[str, str]:
    return {_words(x): name for name, x in sentences.items()}


def _known(pieces: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences among an array of normalised pieces, by where they start.

    A sentence starts at a piece with the first word of a known one, and is the longest run of
    pieces from there whose words are those of a known one.
    """
    known = _by_words(sentences)
    by_words = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    starts = sorted({k.split()[0] for k in known})
    lengths = sorted({len(k) for k in known})
    at = F.filter(F.transform(pieces, lambda p, i: F.when(F.substring_index(p, " ", 1).isin(starts), i)), lambda i: i.isNotNull())

    def longest(i: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.lit(LINES)), lambda n: F.array_join(F.slice(pieces, i + 1, n), " "))
        # only a string as long as a known one can be known: a cheap test before the look-up
        names = F.transform(F.filter(runs, lambda x: F.length(x).isin(lengths)), lambda x: F.try_element_at(by_words, x))
        return F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(-1))

    return F.filter(F.transform(at, longest), lambda x: x.isNotNull())


def _rule(own: list[str]) -> str:
    """A pattern for identifiers in this order, among others, in a chain ``,a,b,c,``."""
    return "," + "(?:[^,]+,)*?".join(re.escape(x) + "," for x in own)


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences), one row per row of ``docs``.

    A text is cut at line ends and after ``. : ; ! ?`` before white space; pieces are lower-cased and
    reduced to ASCII letters and digits, and those without any are left out. A sentence is a piece or
    a run of up to LINES pieces, as headers are wrapped and commented at will; identifiers of known
    ones are comma-joined in the order of where they start, each the longest that starts there. A rule
    holds if its identifiers occur in its order, whatever other known sentences stand between.
    licences are those of the rules that hold, each once, in the rules' order; a rule gives way
    to another licence's rule that holds and begins with its identifiers.

    Null and empty texts give empty strings. Every row is judged by itself, without a shuffle:
    ids may be null or repeated, an empty table gives an empty one, other columns are not read.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), CUTS), normalised), lambda p: p != "")
    cut = docs.select(F.col(id_col).alias("doc_id"), pieces.alias("pieces"))
    out = cut.select("doc_id", F.array_join(_known(F.col("pieces"), sentences), ",").alias("sentence_ids"))
    chain = F.concat(F.lit(","), "sentence_ids", F.lit(","))
    found = []
    for name in dict.fromkeys(licence for licence, _ in rules):
        holds = F.lit(False)
        for _, own in (r for r in rules if r[0] == name):
            one = chain.rlike(_rule(own))
            for other, longer in rules:
                if other != name and len(longer) > len(own) and longer[: len(own)] == own:
                    one = one & ~chain.rlike(_rule(longer))
            holds = holds | one
        found.append(F.when(holds, F.lit(name)))
    return out.withColumn("licences", F.when(F.col("sentence_ids") == "", "").otherwise(F.concat_ws(",", *found)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{_words(s)}', '{name}')" for name, s in SENTENCES.items())
    rule = lambda own: f"regexp_matches(c, '{_rule(own)}')"
    whens = []
    for name in dict.fromkeys(licence for licence, _ in RULES):
        ors = []
        for _, own in (r for r in RULES if r[0] == name):
            longer = [x for o, x in RULES if o != name and len(x) > len(own) and x[: len(own)] == own]
            ors.append(" AND ".join([rule(own), *[f"NOT {rule(x)}" for x in longer]]))
        whens.append(f"CASE WHEN {' OR '.join(ors)} THEN '{name}' END")
    return f"""
WITH known(s, name) AS (VALUES {known}),
p AS (SELECT doc_id, row_number() OVER () AS row, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{CUTS}'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS a FROM documents),
i AS (SELECT row, a, unnest(range(1, len(a) + 1)) AS i FROM p),
j AS (SELECT row, i, unnest(range(i, least(i + {LINES - 1}, len(a)) + 1)) AS j, a FROM i WHERE split_part(a[i], ' ', 1) IN (SELECT split_part(s, ' ', 1) FROM known)),
m AS (SELECT row, i, arg_max(name, j) AS name FROM j JOIN known ON array_to_string(a[i : j], ' ') = s GROUP BY row, i),
c AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids FROM p LEFT JOIN (SELECT row, string_agg(name, ',' ORDER BY i) AS ids FROM m GROUP BY row) USING (row)),
d AS (SELECT *, ',' || sentence_ids || ',' AS c FROM c)
SELECT doc_id, sentence_ids, CASE WHEN sentence_ids = '' THEN '' ELSE concat_ws(',', {', '.join(whens)}) END AS licences FROM d
"""


OP2_SQL = _sql()
