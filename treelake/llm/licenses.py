"""Licence scans by canonical digest: a text is a known licence when both have the same canonical form.

The canonical form has A-Z in lower case, no lines that start like a copyright notice, one spelling of words that licences spell in
several ways, and one space for each run of white space and punctuation. Its SHA-256 is joined to the
digests of known licences. Built-in functions only, for texts and for the known licences alike.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a holder aren't part of a licence.
COPYRIGHT_LINE = r"(^|\n)[ \t>*#/;%.-]*(copyright[ \t]*(\(c\)|©|[0-9]|by |<|\[|\{)|\(c\)|©|all rights reserved)[^\n]*"
#: Everything but letters, digits and what lies beyond ASCII, and typographic marks.
BETWEEN = r"[\x00-/:-@\[-`{-\x7f\x{80}-\x{bf}\x{2010}-\x{205e}\x{3000}-\x{3002}]+"
#: Pairs of equivalent spellings, matched as whole words.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owner"),
    ("copyright owners", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
]
#: Texts of known licences; their notices and punctuation don't matter.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
}
#: Whole texts as they are distributed, one file for each.
TEXTS = Path(__file__).parent / "license_texts"
#: Titles that these texts are distributed with, above the copyright notice.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License", "The BSD 3-Clause License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Words behind which some distributions leave out how to apply the licence, and the line that some put under the Unlicense.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
UNLICENSE_LINK = "For more information, please refer to <http://unlicense.org/>"
#: Notices of a holder without a mark or year, as a paragraph of their own, so that no wrapped line of a licence is one.
PLAIN_NOTICE = r"(?i)(^\s*|\n[ \t\r]*\n)([ \t]*copyright[ \t][^\n]{1,200}\n)+(?=[ \t\r]*(\n|all rights reserved))"


#: Each word stands between two spaces of its own while spellings are replaced.
PAIRS = [(f" {a} ".replace(" ", "  ")[1:-1], f" {b} ".replace(" ", "  ")[1:-1]) for a, b in EQUIVALENT]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form; a null text has the empty one."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, BETWEEN, "  "), F.lit(" "))
    for spelling, plain in PAIRS:
        out = F.replace(out, F.lit(spelling), F.lit(plain))
    return F.btrim(F.regexp_replace(out, " +", " "))


def canonical_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    out = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, '{BETWEEN}', '  ', 'g') || ' '"
    for spelling, plain in PAIRS:
        out = f"replace({out}, '{spelling}', '{plain}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def distributed() -> list[tuple[str, str]]:
    """(license, text) of every known licence: KNOWN and the files, each as it is, with its titles, and without what follows the terms."""
    texts = KNOWN | {f.stem: f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}
    out = []
    for name, body in sorted(texts.items()):
        forms = [body]
        if name == "Unlicense":
            forms.append(f"{body}\n{UNLICENSE_LINK}")
        if END_OF_TERMS in body:
            terms = body[: body.index(END_OF_TERMS)]
            forms += [terms, terms + END_OF_TERMS]
        out += [(name, form) for form in forms]
        out += [(name, f"{title}\n\n{form}") for title in TITLES.get(name, []) for form in forms]
    return out


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, digest); of licences with the same canonical form the first name."""
    listed = sorted(texts.items()) if texts else distributed()
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(body).alias("body")) for name, body in listed])
    listed = spark.range(1).select(F.inline(rows))
    return listed.select("license", F.sha2(canonical(F.col("body")).cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns, and canonical_chars, digest and license (null where no known licence has this digest).

    Null, empty and markless texts have canonical length 0 and match nothing. Columns of these names are replaced. `known` is a fixed list and
    small, so that its broadcast is bounded by the list, not by the documents; equal texts meet in no task.
    """
    keep = [c for c in docs.columns if c not in ("canonical_chars", "digest", "license")]
    text = F.col(f"`{text_col}`").cast("string")
    # only texts with a plain notice are brought into canonical form a second time
    bare = F.when(text.rlike(PLAIN_NOTICE), F.sha2(canonical(F.regexp_replace(text, PLAIN_NOTICE, "\n\n")).cast("binary"), 256))
    out = docs.select(*[F.col(f"`{c}`") for c in keep], canonical(text).alias("__form"), bare.alias("__bare"))
    out = out.select(*[F.col(f"`{c}`") for c in keep], F.length("__form").cast("long").alias("canonical_chars"), F.sha2(F.col("__form").cast("binary"), 256).alias("digest"), "__bare")
    names = known.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).select("digest", "license")
    other = names.select(F.col("digest").alias("__bare"), F.col("license").alias("__license"))
    out = out.join(F.broadcast(names), "digest", "left").join(F.broadcast(other), "__bare", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "canonical_chars", "digest", F.coalesce("license", "__license").alias("license"))


def oracle_sql() -> str:
    """Without the files, titles and plain notices, which tests cover by hand: on tables without such texts the rows are the same."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(b)})" for n, b in sorted(KNOWN.items()))
    return f"""
        WITH forms AS (SELECT doc_id, {canonical_sql("text")} AS form FROM documents),
        known AS (SELECT sha256({canonical_sql("body")}) AS digest, min(license) AS license FROM (VALUES {known}) AS k(license, body) GROUP BY 1)
        SELECT f.doc_id, length(f.form) AS canonical_chars, sha256(f.form) AS digest, k.license
        FROM forms f LEFT JOIN known k ON k.digest = sha256(f.form) AND f.form <> ''
    """
