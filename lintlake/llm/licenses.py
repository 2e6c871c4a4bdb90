"""Licence scans: whole texts and whole lines, brought to a canonical form, joined to known licences by digest.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything of ASCII
but letters and digits turned into single spaces. Units with an empty form match nothing. Null
and empty texts have no units. Repeated rows give equal rows; two known licences with equal forms both match. All of it is
DataFrame functions; ``oracle`` is the same in SQL.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COPYRIGHT = r"(^|\n)[ \t*#/]*(?:copyright|\(c\)|©)[^\n]*"
_OTHER = r"[\x01-\x2f\x3a-\x60\x7b-\x7f]+"
#: Pairs of a pattern and what stands for it, applied in this order to lower-cased text.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("non-commercial|noncommercial", "noncommercial"), ("sub-license", "sublicense"), ("copyright holders?", "copyright holder"), ("copyright owners?", "copyright holder"),
    ("&", " and "), ("https?://", ""), (r"\bv(?:ersion|er|\.)? ?([0-9])", "version {1}"), (r"\bversion ([0-9]+)\.0\b", "version {1}"),
    ("creative commons attribution-noncommercial|creative commons by-nc", "cc by-nc"), ("gnu gpl|gnu general public license", "gpl"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: One file for each further licence whose full text is known.
_TEXTS = Path(__file__).parent / "license_texts"
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"

_NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3", "MPL-2.0": "Mozilla Public License, version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "CC0-1.0": "CC0 1.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0", "Unlicense": "Unlicense",
}
_PHRASES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This software is licensed under the {}", "SPDX-License-Identifier: {}"]


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): usual notices of each licence, and full texts of those that have one here."""
    full = [
        ("MIT", _MIT), ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
        ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"), ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ]
    texts = {f.stem: f.read_text("utf-8") for f in sorted(_TEXTS.glob("*.txt"))}
    texts["BSD-3-Clause"] = texts["BSD-2-Clause"].replace("THIS SOFTWARE IS", _ENDORSEMENT + "THIS SOFTWARE IS", 1)
    full += texts.items()
    full += [(i, f"{_NAMES[i]}\n\n{texts[i]}") for i in ("BSD-2-Clause", "BSD-3-Clause")]
    end = "END OF TERMS AND CONDITIONS"
    full.append(("Apache-2.0", texts["Apache-2.0"].partition(end)[0] + end))
    notices = [(i, p.format(n)) for i, name in _NAMES.items() for p in _PHRASES for n in (name, i)]
    return full + notices


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def canonical_line(line: Column) -> Column:
    """Canonical form of a text without line breaks. The spellings are only gone through where one of them occurs."""
    line = F.lower(line)
    spelled = line
    for pattern, one in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, one.replace("{1}", "$1"))
    some = "(?=[lomnsch&vg])(?:" + "|".join(p for p, _ in SPELLINGS) + ")"
    spelled = F.when(line.rlike(some), spelled).otherwise(line)
    return F.when(line.rlike(_COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(spelled, _OTHER, " ")))


def forms(text: Column) -> Column:
    """Canonical forms of the lines. No spelling reaches over a line break, so a text's form is its lines' forms joined."""
    return F.transform(F.split(text, "\n", -1), canonical_line)


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form, null for an empty one."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, line (0 for the whole text), license_id, digest of every unit that is a known licence."""
    lines = docs.select("doc_id", forms(F.col("text")).alias("forms"))
    units = lines.select("doc_id", F.posexplode(F.concat(F.array(whole(F.col("forms"))), F.col("forms"))).alias("line", "form"))
    units = units.select("doc_id", "line", digest(F.col("form")).alias("digest")).where(F.col("digest").isNotNull())
    table = licenses.select("license_id", digest(whole(forms(F.col("text")))).alias("digest")).where(F.col("digest").isNotNull()).distinct()
    return units.join(table, "digest").select("doc_id", F.col("line").cast("long").alias("line"), "license_id", "digest")


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(lower({text}), {quote(_COPYRIGHT)}, '\\1', 'g')"
    for pattern, one in SPELLINGS:
        replacement = one.replace("{1}", "\\1")
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return f"trim(regexp_replace({text}, {quote(_OTHER)}, ' ', 'g'), ' ')"


def oracle() -> str:
    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in known_texts())
    return f"""
WITH licenses AS (SELECT DISTINCT license_id, sha256({_sql("text")}) AS digest FROM (VALUES {values}) AS t(license_id, text)),
units AS (
  SELECT doc_id, 0 AS line, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, line, parts[line] AS unit FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
),
forms AS (SELECT doc_id, line, {_sql("unit")} AS form FROM units WHERE unit <> '')
SELECT doc_id, CAST(line AS BIGINT) AS line, license_id, digest
FROM (SELECT doc_id, line, sha256(form) AS digest FROM forms WHERE form <> '') JOIN licenses USING (digest)
"""
