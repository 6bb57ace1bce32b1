"""License scans by sentence rules.

A text is cut at line feeds and after punctuation; the pieces are normalised, so comment marks go. Known licence sentences are looked
up from one cut to another, whatever cuts they hold themselves (wrapped lines, colons); the identifiers found, in order, make a
sequence. Ordered rules then match runs of identifiers; the first rule that fits takes its identifiers out, so a
general rule does not fire on what a specific one has used. Only DataFrame functions are used, row by row, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import common

#: Known sentences, as people write them: identifier, sentence. Fixed values (the wording of published licences).
SENTENCES = [
    ("apache-ref", "Licensed under the Apache License, Version 2.0."),
    ("apache-head", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-use", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy-s", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-ref", "Released under the MIT License."),
    ("mit-ref2", "Licensed under the MIT License."),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-name2", "MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("asis-software", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("isc-liability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-redist", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-implied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("lgpl-see", "See the GNU Lesser General Public License for more details."),
    ("agpl-see", "See the GNU Affero General Public License for more details."),
    ("mpl-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-copy-s", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0-ref", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("rights", "All rights reserved."),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("spdx-bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdx-mpl", "SPDX-License-Identifier: MPL-2.0"),
]

#: Ordered rules: licence, kind, run of identifiers.
RULES = [
    ("Apache-2.0", "permissive", ["apache-head", "apache-use", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-use", "apache-copy-s", "apache-asis", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-use", "apache-copy"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-use", "apache-copy-s"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-use"]),
    ("MIT", "permissive", ["mit-name", "mit-grant", "mit-notice", "asis-software", "mit-liability"]),
    ("MIT", "permissive", ["mit-name2", "mit-grant", "mit-notice", "asis-software", "mit-liability"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "asis-software", "mit-liability"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "asis-software"]),
    ("MIT", "permissive", ["mit-name", "mit-notice", "asis-software"]),
    ("MIT", "permissive", ["mit-notice", "asis-software"]),
    ("MIT", "permissive", ["mit-grant"]),
    ("ISC", "permissive", ["isc-grant", "isc-asis", "isc-liability"]),
    ("ISC", "permissive", ["isc-grant", "asis-software"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("BSD-3-Clause", "permissive", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability"]),
    ("BSD-3-Clause", "permissive", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability"]),
    ("BSD", "permissive", ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-warranty", "gpl-implied", "gpl-see"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free", "gpl-warranty", "gpl-implied", "gpl-see"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl-free", "lgpl-warranty", "gpl-implied", "lgpl-see"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl-free"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free", "gpl-warranty", "gpl-implied", "agpl-see"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free"]),
    ("Apache-2.0", "permissive", ["apache-ref"]),
    ("Apache-2.0", "permissive", ["apache-head"]),
    ("Apache-2.0", "permissive", ["spdx-apache"]),
    ("MIT", "permissive", ["mit-ref"]),
    ("MIT", "permissive", ["mit-ref2"]),
    ("MIT", "permissive", ["mit-name"]),
    ("MIT", "permissive", ["mit-name2"]),
    ("MIT", "permissive", ["spdx-mit"]),
    ("BSD-3-Clause", "permissive", ["spdx-bsd3"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-ref"]),
    ("GPL-3.0-only", "copyleft", ["spdx-gpl3"]),
    ("MPL-2.0", "copyleft", ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", "copyleft", ["mpl-subject", "mpl-copy-s"]),
    ("MPL-2.0", "copyleft", ["mpl-subject"]),
    ("MPL-2.0", "copyleft", ["spdx-mpl"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC0-1.0", "public-domain", ["cc0-ref"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("Proprietary", "proprietary", ["rights"]),
]

#: Each known sentence has one of these; other texts are not cut into sentences.
ANCHORS = ["licen", "copyright", "permi", "warrant", "redistrib", "software", "all rights reserved", "mozilla.org/mpl"]
_END = r"([.!?;:])[ \t\r\n]+"


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    return {normalise(s): i for i, s in SENTENCES}


def _pattern() -> str:
    """Any known sentence between two cuts, longest first; a cut within it (a wrapped line, a colon) is a space."""
    return "\n(" + "|".join(s.replace(" ", "[ \n]") for s in sorted(known(), key=len, reverse=True)) + ")(?=\n)"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text (A-Z already lower-cased), in order."""
    cut = F.split(F.regexp_replace(text, _END, "$1\n"), "\n", -1)
    plain = F.filter(F.transform(cut, lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")
    joined = F.concat(F.lit("\n"), F.array_join(plain, "\n"), F.lit("\n"))
    ids = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    found = F.transform(F.regexp_extract_all(joined, F.lit(_pattern()), F.lit(1)), lambda s: F.try_element_at(ids, F.translate(s, "\n", " ")))
    return F.when(text.rlike("|".join(ANCHORS)), found).otherwise(F.array().cast("array<string>"))


def apply_rules(ids: Column) -> Column:
    """``struct<rest, licences, kinds>``: what no rule used, and the licences in the order of the rules."""
    rules = F.array(*(F.struct(F.lit("".join(f"<{i}>" for i in run)).alias("run"), F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, run in RULES))
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    none = F.array().cast("array<string>")
    first = F.struct(sequence.alias("rest"), none.alias("licences"), none.alias("kinds"))

    def step(acc: Column, rule: Column) -> Column:
        fits = F.contains(acc["rest"], rule["run"])
        return F.struct(
            F.when(fits, F.replace(acc["rest"], rule["run"], F.lit("#"))).otherwise(acc["rest"]).alias("rest"),
            F.when(fits, F.array_union(acc["licences"], F.array(rule["name"]))).otherwise(acc["licences"]).alias("licences"),
            F.when(fits, F.array_union(acc["kinds"], F.array(rule["kind"]))).otherwise(acc["kinds"]).alias("kinds"),
        )

    return F.aggregate(rules, first, step)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, sentence_ids, licenses, kinds, n_unused`` (known sentences that no rule used).

    A null or empty text has none; a rule that fits twice names its licence once. Ids may be null or repeated, repeated rows each give
    a row, an empty table none. A text of any length is one row's arrays, if it says any of ``ANCHORS``. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"))
    rows = rows.select("doc_id", sentence_ids(F.col("_text")).alias("sentence_ids")).withColumn("_found", apply_rules(F.col("sentence_ids")))
    unused = F.regexp_count("_found.rest", F.lit("<")).cast("long")
    return rows.select("doc_id", "sentence_ids", F.col("_found.licences").alias("licenses"), F.col("_found.kinds").alias("kinds"), F.coalesce(unused, F.lit(0)).alias("n_unused"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("kinds", ",").alias("kinds"), "n_unused")


def _sql() -> str:
    """Cuts are doubled here, one for the sentence before and one for the one after."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quote(s)} THEN {quote(i)}" for s, i in known().items())
    pattern = "'\\n(" + "|".join(s.replace(" ", "( |\\n\\n)") for s in sorted(known(), key=len, reverse=True)) + ")\\n'"
    steps, last = [], "r0"
    for k, (name, kind, run) in enumerate(RULES):
        wanted = quote("".join(f"<{i}>" for i in run))
        fits = f"contains(rest, {wanted})"
        steps.append(f"r{k + 1} AS (SELECT rid, doc_id, ids, replace(rest, {wanted}, '#') AS rest, CASE WHEN {fits} AND NOT list_contains(l, {quote(name)}) THEN list_append(l, {quote(name)}) ELSE l END AS l, CASE WHEN {fits} AND NOT list_contains(c, {quote(kind)}) THEN list_append(c, {quote(kind)}) ELSE c END AS c FROM {last})")
        last = f"r{k + 1}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT rid, doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS cut FROM t),
j AS (SELECT rid, doc_id, chr(10) || chr(10) || coalesce(array_to_string(cut, chr(10) || chr(10)), '') || chr(10) || chr(10) AS joined FROM s WHERE regexp_matches(text, {quote("|".join(ANCHORS))})),
i AS (SELECT s.rid, s.doc_id, coalesce(list_transform(regexp_extract_all(joined, {pattern}, 1), lambda x: CASE replace(x, chr(10) || chr(10), ' ') {cases} END), CAST([] AS VARCHAR[])) AS ids FROM s LEFT JOIN j ON j.rid = s.rid),
r0 AS (SELECT rid, doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS l, CAST([] AS VARCHAR[]) AS c FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licenses,
  coalesce(array_to_string(c, ','), '') AS kinds, CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unused FROM {last}
"""


OP10_SQL = _sql()
