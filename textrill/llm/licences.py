"""Licence scan by canonical digests (operator 7).

A text is brought into a canonical form and its digest looked up among those of known licences. The form
ignores what licence texts may differ in without being another licence: case, blanks,
punctuation, copyright lines, and spellings that count as equal. Texts match as a whole; a licence that is passed on
with or without its title, its appendix or the unfilled line of that is known in each of these forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import table

# Spellings that count as equal: fixed values.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "wilfull"),
)

# Texts of short licences, as published: fixed values.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

# Whole licences as published, a file each, named by licence.
TEXTS = Path(__file__).with_name("licence_texts")

# Titles that are put above texts published without one: fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}

# Texts whose first paragraph is their title.
TITLED = (
    "Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0",
)
END = "END OF TERMS AND CONDITIONS"
NUMBER = r"(?m)^\s*[0-9]\.\s"
UNFILLED = "Copyright [yyyy] [name of copyright owner]"

# A copyright line: behind signs at most, the word or sign with a year, another sign, a colon or "by".
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}\n(©]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|:|by )|(\(c\)|©)[ \t]*(copyright[ \t]*)?[0-9]{4})[^\n]*$"
)
RIGHTS_LINE = r"^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
NO_WORD = r"[^\p{L}\p{N}]+"
LINES = "(?m)"


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words with two blanks between, copyright lines left out."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = F.regexp_replace(out, LINES.replace("m", "md") + line, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NO_WORD, "  "), F.lit(" "))
    for theirs, ours in EQUIVALENT:
        out = F.replace(out, F.lit(_spaced(theirs)), F.lit(_spaced(ours)))
    return F.trim(out)


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _digest_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = f"regexp_replace({out}, '{LINES}{line}', '', 'g')"
    out = f"' ' || regexp_replace({out}, '{NO_WORD}', '  ', 'g') || ' '"
    for theirs, ours in EQUIVALENT:
        out = f"replace({out}, '{_spaced(theirs)}', '{_spaced(ours)}')"
    return f"sha256(trim({out}))"


def forms(name: str, body: str) -> Iterator[str]:
    """The forms in which a licence's whole text is passed on: title, appendix and its unfilled line kept or left out, clauses numbered or not."""
    starts = [body, *(f"{title}\n\n{body}" for title in TITLES.get(name, ()))]
    if name in TITLED:
        starts.append(body.lstrip().split("\n\n", 1)[1])
    for text in starts:
        yield text
        if END in text:
            yield text[: text.index(END) + len(END)]
        if name.startswith("BSD-"):
            yield re.sub(NUMBER, "", text)
        if UNFILLED in text:
            yield text.replace(UNFILLED, "")


def known_texts() -> list[tuple[str, str]]:
    """``(licence, text)``: the short texts and the whole licences, in all their forms."""
    whole = {p.stem: p.read_text(encoding="utf-8") for p in TEXTS.glob("*.txt")}
    return sorted((name, text) for name, body in (KNOWN | whole).items() for text in forms(name, body))


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(licence, licence_digest)`` of the known texts, one name per digest."""
    rows = spark.createDataFrame(sorted(texts.items()) if texts else known_texts(), "licence string, body string")
    return rows.groupBy(digest(F.col("body")).alias("licence_digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, digest, licence)`` of every row; ``licence`` is null where no known text matches.

    Null and empty texts, and texts of signs only, have the empty form, which is no licence. Repeated rows stay, an empty table gives
    none, other columns aren't read. Only digests meet: the known side is joined by hash, and broadcast only if
    Spark finds its measured size within its bound.
    """
    empty = F.sha2(F.lit(""), 256)
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return found.join(known.where(F.col("licence_digest") != empty), found["digest"] == F.col("licence_digest"), "left").select(
        "doc_id", "digest", "licence"
    )


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document's whole text is, if it is one."""
    return scan(table(spark, sf_dir, "documents"), known_licences(spark))


_KNOWN_SQL = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in sorted(KNOWN.items()))
OP7_SQL = f"""
WITH known AS (
  SELECT {_digest_sql("body")} AS licence_digest, min(licence) AS licence
  FROM (VALUES {_KNOWN_SQL}) AS t(licence, body) GROUP BY ALL),
docs AS (SELECT doc_id, {_digest_sql("text")} AS digest FROM documents)
SELECT d.doc_id, d.digest, k.licence FROM docs d
LEFT JOIN known k ON d.digest = k.licence_digest AND d.digest <> sha256('')
"""
