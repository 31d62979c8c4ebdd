r"""Licence scan by canonical digest.

A text is put into canonical form: lower-cased, copyright lines dropped,
equivalent spellings made one, punctuation turned to spaces, runs of blanks
closed. Its SHA-256 is then hash-joined to the digests of known licence texts
in the same form. The units looked up are the entire text of a document and,
as documents carry notices among other prose, each of its entire lines; those
that don't begin with a known text's first word need no digest.

The known texts are a parameter; the digest table holds one short row each and
is broadcast up to BROADCAST_TEXTS rows. Texts of one canonical form count as
the one with the first license_id.

Defined results: null and empty texts have no units that match (an empty
canonical form is never looked up); a document that matches several known
texts, or one text on several lines, has a row for each; repeated rows give
repeated results; extra columns are ignored. Empty tables give an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digest tables of at most so many rows (about 100 bytes each) are broadcast.
BROADCAST_TEXTS = 50_000


@dataclass(frozen=True)
class KnownText:
    license_id: str
    text: str


#: One-line notices of well-known licences.
LINES = (
    KnownText("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    KnownText("MIT", "Released under the MIT License."),
    KnownText("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    KnownText("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    KnownText("CC-BY-4.0", "Licensed under CC BY 4.0."),
    KnownText("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    KnownText("CC0-1.0", "Released under CC0 1.0."),
    KnownText("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    KnownText("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
)

#: Full texts, one file for each licence.
TEXTS = Path(__file__).parent / "license_texts"
#: Titles that may stand above a text that has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "ISC": ("ISC License", "The ISC License"),
}


def license_texts() -> tuple[KnownText, ...]:
    """The full texts as they are handed on: with and without title, numbers of conditions and appendix; Apache's standard header; SPDX lines."""
    out = []
    for file in sorted(TEXTS.glob("*.txt")):
        name, text = file.stem, file.read_text(encoding="utf-8").replace("'", " ")  # an apostrophe is a blank in canonical form
        forms = [text]
        if name.startswith("BSD"):
            forms.append(re.sub(r"(?m)^\d\. ", "* ", text))
        if name == "Apache-2.0":
            terms, appendix = text.split("   END OF TERMS AND CONDITIONS", 1)
            header = appendix[appendix.index("   Licensed under the Apache License") :]
            forms += [terms, terms + "   END OF TERMS AND CONDITIONS", header]
        forms += [f"{title}\n\n{form}" for form in forms for title in TITLES.get(name, ())]
        out += [KnownText(name, form) for form in [*forms, f"SPDX-License-Identifier: {name}"]]
    return tuple(out)


#: All known texts: the one-line notices and the full texts.
NOTICES = LINES + license_texts()

#: Spellings that count as the same, each with its canonical one.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("programme", "program"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
)

#: A line that starts so is a copyright line and not part of the terms.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Everything but ASCII letters, digits, line ends and characters beyond ASCII counts as a blank.
BLANKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _marked(text: Column) -> Column:
    """Lower case without copyright lines, blanks and punctuation closed to one space; line ends stay."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    return F.regexp_replace(c, BLANKS, " ")


def _form(c: Column) -> Column:
    """Canonical form of a marked text without line ends."""
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for spelling, one in SPELLINGS:
        c = F.replace(c, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null stays null."""
    return _form(F.replace(_marked(text), F.lit("\n"), F.lit(" ")))


def digests(spark: SparkSession, known: tuple[KnownText, ...]) -> DataFrame:
    """(license_id, digest); broadcast up to BROADCAST_TEXTS rows, beyond that a table like any other."""
    table = _forms(spark, known).select("license_id", F.sha2("form", 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(table) if len(known) <= BROADCAST_TEXTS else table


def _forms(spark: SparkSession, known: tuple[KnownText, ...]) -> DataFrame:
    table = spark.createDataFrame([(k.license_id, k.text) for k in known], "license_id string, known string")
    return table.select("license_id", canonical(F.col("known")).alias("form"))


def first_words(spark: SparkSession, known: tuple[KnownText, ...]) -> list[str]:
    """Words that a unit begins with, if it is a known text: theirs, and spellings of these. Only such units need a digest."""
    words = {r[0] for r in _forms(spark, known).select(F.substring_index("form", " ", 1)).distinct().collect()}  # no more than known texts
    return sorted(words | {spelling.split(" ")[0] for spelling, one in SPELLINGS if one.split(" ")[0] in words})


def scan_licenses(docs: DataFrame, known: tuple[KnownText, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, license_id, unit, line_no, matched, digest) for every unit that is a known text.

    ``unit`` is ``text`` (``line_no`` 0) or ``line`` (``line_no`` from 1).
    """
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).where(F.col("_text").isNotNull())
    # one pass of the costly expressions over a text serves the text and its lines
    base = base.withColumn("_marked", _marked(F.col("_text"))).withColumns({"_lines": F.split("_text", "\n"), "_forms": F.split("_marked", "\n")})
    unit = lambda kind, k, form, x: F.struct(F.lit(kind).alias("unit"), k.alias("line_no"), form.alias("form"), x.alias("matched"))
    lines = F.transform("_forms", lambda x, k: unit("line", k + 1, x, F.element_at("_lines", k + 1)))
    whole = F.array(unit("text", F.lit(0), F.replace("_marked", F.lit("\n"), F.lit(" ")), F.col("_text")))
    units = base.select(id_col, F.explode(F.concat(whole, lines)).alias("u")).select(id_col, "u.*")
    units = units.where(F.substring_index(F.trim("form"), " ", 1).isin(first_words(docs.sparkSession, known)) & (F.trim("form") != ""))
    units = units.withColumn("digest", F.sha2(_form(F.col("form")), 256)).drop("form")
    return units.join(digests(docs.sparkSession, known), "digest").select(id_col, "license_id", "unit", "line_no", "matched", "digest")
