"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, copyright lines out,
punctuation to single spaces, equivalent spellings made one) and the SHA-256 of
the whole form is hash-joined to the digests of known licences. The same is done
for each line, so that a licence notice inside a document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import WHOLE

#: Equivalent spellings, other to canonical.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "customise": "customize", "emphasise": "emphasize",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful", "owner": "holder", "https": "http",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    f"substantial portions of the Software.\n\n{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    f"the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must "
    "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and "
    "must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
    "any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of "
    "our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
    f"to this software under copyright law.\n\n{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
    "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
    "following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
    "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    f"processor.\n\n{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
    "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_PERMISSION = "provided that the above copyright notice and this permission notice appear in all copies."
_OBSD = _ISC.replace("hereby granted, " + _PERMISSION, "hereby granted.")
_MIT_0 = _MIT.replace(
    ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.", ".",
)
#: Whole licences: id, names that may head the text, text.
_TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
    ("MIT-0", ("MIT No Attribution",), _MIT_0),
    ("ISC", ("ISC License", "The ISC License"), _ISC),
    ("ISC", ("ISC License", "The ISC License"), _ISC.replace("and/or distribute", "and distribute")),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), _OBSD),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), _BSD + _BSD_END),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), _BSD + _BSD_3 + _BSD_END),
    ("Zlib", ("zlib License", "The zlib License"), _ZLIB),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), _BOOST),
)
#: How licences are called in notices.
_NAMES = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU GPL v3"),
    ("GPL-2.0", "GNU GPL v2"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
)
_FORMS = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.",
    "This work is licensed under the {}.", "This software is licensed under the {}.", "This work is licensed under a {}.", "License: {}",
)
_IDS = sorted({i for i, _ in _NAMES} | {i for i, _, _ in _TEXTS} | {"GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later"})
#: (licence, text) of whole licences and of notices that stand on a line.
KNOWN = tuple(
    [(i, t) for i, _, t in _TEXTS]
    + [(i, f"{h}\n\n{t}") for i, heads, t in _TEXTS for h in heads]
    + [(i, form.format(name)) for i, name in _NAMES for form in _FORMS]
    + [(i.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {i}") for i in _IDS]
)
# A notice has a year, a sign or a place for them; other lines may begin with the word by the way they are wrapped.
COPYRIGHT_LINE = (
    r"(?m)^[\x20\x09#*/;%-]*(?:copyright\b[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9]{2}\b|<year>|\[year\]|\[yyyy\])[^\n]*"
    r"|(?:\(c\)|©)[\x20\x09]*(?:19|20)[0-9]{2}\b[^\n]*|all rights reserved[.]?[\x20\x09]*)$"
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form, with its lines kept apart by single newlines."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, NOT_WORD, " "), r" ?\n[\n ]*", "\n"), F.lit(" \n"))


def with_spelling(text: Column) -> Column:
    """text with the words of SPELLINGS made canonical."""
    one = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    any_ = r"\b(?:" + "|".join(SPELLINGS) + r")\b"
    fixed = F.array_join(
        F.transform(
            F.split(text, "\n"), lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(F.element_at(one, w), w)), " ")
        ),
        "\n",
    )
    return F.when(text.rlike(any_), fixed).otherwise(text)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | DataFrame = KNOWN) -> DataFrame:
    """(digest, n, license): a row for each known text; broadcast, as there are
    as many as the caller lists. known: pairs, or a table (license, text)."""
    rows = known.select("license", "text") if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    form = rows.select("license", canonical_lines(F.col("text")).alias("form"))
    form = form.select("license", F.translate(with_spelling(F.col("form")), "\n", " ").alias("form"))
    return form.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("n")).agg(F.min("license").alias("license"))


def default_digests(spark: SparkSession) -> DataFrame:
    """The digests of KNOWN and of the whole licences of WHOLE."""
    whole = spark.createDataFrame([(d, n, a) for a, n, d in WHOLE], "digest string, n int, license string")
    return known_digests(spark).unionByName(whole)


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, text_digest, license_id, n_notices, notices.

    license_id: the licence that the whole text is, null if none. n_notices:
    lines that are a known text by themselves, repeats counted; notices: their
    licences, distinct, sorted, comma-joined. Null is empty. A text that is
    empty in canonical form is no licence. Rows that repeat an id are scanned
    one by one. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    known = known if known is not None else default_digests(spark)
    sizes = [r["n"] for r in known.select("n").distinct().collect()]
    lines = docs.select(F.col(id).cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    lines = lines.select("doc_id", with_spelling(F.col("c")).alias("c"))
    # only lines as long as a known text are hashed
    parts = F.filter(F.split("c", "\n"), lambda x: (x != "") & F.length(x).isin(sizes))
    parts = F.transform(parts, lambda x: F.sha2(x, 256))
    lines = lines.select("doc_id", F.sha2(F.translate("c", "\n", " "), 256).alias("text_digest"), parts.alias("p"))
    # the known texts are as many as the caller lists: they come to the documents
    whole = F.broadcast(known.select(F.col("digest").alias("text_digest"), F.col("license").alias("license_id")))
    listed = [F.lit(x) for r in known.collect() for x in (r["digest"], r["license"])]
    single = F.filter(F.transform("p", lambda d: F.element_at(F.create_map(*listed), d)), lambda x: x.isNotNull()) if listed else F.array().cast("array<string>")
    return lines.join(whole, "text_digest", "left").withColumn("all", single).select(
        "doc_id",
        "text_digest",
        F.when(F.col("text_digest") != F.sha2(F.lit(""), 256), F.col("license_id")).alias("license_id"),
        F.size("all").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("all")), ",").alias("notices"),
    )


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same over the table documents, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spell = "map([" + ",".join(map(quote, SPELLINGS)) + "],[" + ",".join(map(quote, SPELLINGS.values())) + "])"
    values = ",".join(f"({quote(a)},{quote(b)})" for a, b in known)
    whole = ",".join(f"({quote(a)},{quote(d)})" for a, _, d in WHOLE)
    space = "' ' || chr(10)"
    lines = (
        "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), "
        + quote(COPYRIGHT_LINE).replace("{", "{{").replace("}", "}}") + ", '', 'g'), "
        "'[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n[\\n ]*', chr(10), 'g'), " + space + ")"
    ).replace("\\\\", "\\")
    words = "array_to_string(list_transform(string_split({0}, ' '), lambda w: coalesce(sp[w], w)), ' ')"
    form = "array_to_string(list_transform(string_split({0}, chr(10)), lambda x: " + words.format("x") + "), chr(10))"
    return f"""
WITH s AS (SELECT {spell} AS sp),
k AS (SELECT license, sha256(replace({form.format(lines.format("text"))}, chr(10), ' ')) AS digest
      FROM (VALUES {values}) v(license, text), s),
w AS (SELECT license, digest FROM k UNION ALL SELECT * FROM (VALUES {whole}) x(license, digest)),
kk AS (SELECT digest, min(license) AS license FROM w GROUP BY digest),
m AS (SELECT map_from_entries(list((digest, license))) AS known FROM kk),
d AS (SELECT doc_id, {form.format(lines.format("coalesce(text, '')"))} AS c FROM documents, s),
f AS (SELECT doc_id, sha256(replace(c, chr(10), ' ')) AS text_digest,
             list_filter(list_transform(list_filter(string_split(c, chr(10)), lambda x: x <> ''), lambda x: known[sha256(x)]), lambda x: x IS NOT NULL) AS found
      FROM d, m)
SELECT doc_id, text_digest, CASE WHEN text_digest <> sha256('') THEN license END AS license_id,
       len(found) AS n_notices, array_to_string(list_sort(list_distinct(found)), ',') AS notices
FROM f LEFT JOIN kk ON digest = text_digest"""
