"""Licence scan by canonical digests of whole texts (DataFrame functions only).

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, punctuation turned into single spaces.  The
SHA-256 of the whole canonical text is hash-joined to the digests of known
licences; the digests of its lines are looked up as well, so that a licence
statement that stands as a line of its own is reported.

Defined results: a null text counts as empty and matches nothing; repeated rows
are reported alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.licensedigests import DIGESTS

#: Equivalent spellings, applied in this order to lower-case text.
EQUIVALENTS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"),
    ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("http:", "https:"), ("per cent", "percent"),
    ("favour", "favor"), ("authorise", "authorize"), ("&", " and "), ("version ", "v"), ("creative commons ", "cc "),
)
COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright \(c\)|copyright ©|\(c\) [0-9]{4}|© ?[0-9]{4}|copyright [0-9]{4}|copyright <|copyright \[)[^\n]*$"
PUNCTUATION = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09\x0B-\x0D ]+"

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licence texts and statements, (identifier, text).
KNOWN = (
    ("MIT", _PERMISSION),
    ("MIT", "MIT License\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n" + _PERMISSION),
    ("ISC", _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR),
    ("ISC", "ISC License\n" + _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR),
    ("0BSD", _USE + ".\n" + _AUTHOR),
    ("0BSD", "BSD Zero Clause License\n" + _USE + ".\n" + _AUTHOR),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


def canonical_text(text: str) -> str:
    """The canonical form in Python, for the registry; lines stay lines."""
    t = text.lower()
    t = re.sub(COPYRIGHT_LINE, "", t)
    for a, b in EQUIVALENTS:
        t = t.replace(a, b)
    t = re.sub(PUNCTUATION, " ", t)
    return re.sub(r"(^ +)|( +$)|( *\n[ \n]*)", lambda m: "\n" if m[3] else "", t).strip("\n ")


def canonical(text: Column) -> Column:
    """The same form as a column."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for a, b in EQUIVALENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" *\n[ \n]*", "\n"), r"^\n+", ""), r"\n+$", ""))


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).replace("\n", " ").encode()).hexdigest()


def registry() -> list[tuple[str, str]]:
    """(digest, identifier) of the known texts, sorted; a few rows, fixed by KNOWN and DIGESTS."""
    return sorted({(digest_of(t), i) for i, t in KNOWN} | {(d, i) for i, d in DIGESTS})


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text or null), statements (comma-joined, sorted) per row."""
    known = docs.sparkSession.createDataFrame(registry(), "known_digest string, license string")
    lines = F.create_map(*[F.lit(x) for r in registry() for x in r])
    d = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("c"))
    d = d.select(
        "doc_id",
        F.sha2(F.translate("c", "\n", " "), 256).alias("digest"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split("c", "\n"), lambda x: F.try_element_at(lines, F.sha2(x, 256)))))).alias("s"),
    )
    return d.join(F.broadcast(known), d.digest == known.known_digest, "left").select("doc_id", "digest", "license", F.array_join("s", ",").alias("statements"))


def oracle_sql() -> str:
    rows = ", ".join(f"('{d}', '{i}')" for d, i in registry())
    t = f"regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g')"
    for a, b in EQUIVALENTS:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, '{PUNCTUATION}', ' ', 'g')"
    t = rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, ' *\n[ \n]*', chr(10), 'g'), '^\n+', ''), '\n+$', ''), ' ')"
    return f"""
WITH known(d, license) AS (VALUES {rows}),
c AS (SELECT row_number() OVER () AS rn, doc_id, {t} AS c FROM documents),
l AS (SELECT rn, string_agg(DISTINCT license, ',' ORDER BY license) AS statements
      FROM (SELECT rn, unnest(string_split(c, chr(10))) AS line FROM c) JOIN known ON sha256(line) = d GROUP BY rn)
SELECT doc_id, sha256(replace(c, chr(10), ' ')) AS digest, license, coalesce(statements, '') AS statements
FROM c LEFT JOIN known ON sha256(replace(c, chr(10), ' ')) = d LEFT JOIN l USING (rn)
"""
