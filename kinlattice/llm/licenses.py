"""Licence scans: entire texts, in canonical form, looked up by digest.

Case, punctuation, line breaks, copyright lines and equivalent spellings do not matter. Whole documents
are looked up, and their single lines against known one-line notices. Long licences are public texts in
``licence_texts``, a file each.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Shelf, ascii_lower, maybe_broadcast, spread_join, table

#: Fixed texts of public licences, without their copyright lines.
KNOWN = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: One-line notices (fixed texts).
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
}
#: Equivalent spellings (fixed values): the first becomes the second.
SPELLINGS = [("licence", "license"), ("noninfringement", "non infringement"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("https", "http")]
BROADCAST_ROWS = 200_000
#: What a copyright line has after the word: a sign, a year or a place for one.
_HELD = r"(?:\([Cc]\)|©|(?:19|20)[0-9][0-9]|\[yyyy\]|<year>)"
#: A line that names who holds the copyright (a sign, a year or a name follows), or only reserves all rights.
HOLDER = (
    rf"(?m)^[^\p{{L}}0-9©(\n]*(?:(?i:copyright)[ \t:,]*{_HELD}|\([Cc]\)[ \t]*(?:19|20)[0-9][0-9]|©"
    r"|[Cc]opyright[ \t:]+(?:(?:[Bb]y|[Tt]he) )*(?!(?i:holder|owner|notice|licen[cs]e|law|act))\p{Lu}\p{Ll})[^\n]*$"
    r"|^[^\p{L}0-9\n]*(?i:all rights reserved)[^\p{L}0-9\n]*$"
)
#: Texts without any of these have no such line.
MAY_HOLD = r"(?i)copyright|\(c\)|©|rights reserved"


def known_texts() -> dict[str, str | list[str]]:
    """The texts of this module and those of the folder beside it, by licence."""
    return KNOWN | {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _plain(text: Column) -> Column:
    """Without copyright lines, lower case (A-Z), one spelling, a blank for other characters than letters, digits and line breaks."""
    out = ascii_lower(F.when(text.rlike(MAY_HOLD), F.regexp_replace(text, HOLDER, "")).otherwise(text))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _one_line(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, one spelling, single blanks instead of punctuation and line breaks."""
    return _one_line(_plain(text))


def known(spark, texts: dict[str, str | list[str]] | None = None) -> DataFrame:
    """(digest, license, n_chars) of known texts, one row a digest; n_chars is the length of the canonical text."""
    rows = [(k, t) for k, v in (known_texts() if texts is None else texts).items() for t in ([v] if isinstance(v, str) else v)]
    out = spark.createDataFrame(rows, "license string, text string").select("license", canonical(F.col("text")).alias("t"))
    return out.groupBy(F.sha2("t", 256).alias("digest"), F.char_length("t").alias("n_chars")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses: DataFrame, notices: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without its text, with ``digest``, ``license`` and ``notices`` added.

    ``digest``: SHA-256 of the canonical text; ``license``: the known text it is, else null;
    ``notices``: the sorted distinct licences whose notice is one of the text's lines. Null texts have
    no digest; texts without a letter or digit have the digest of the empty text, which is no licence.
    Repeated rows are looked up each, other columns pass through, and those named like the added ones
    are replaced. ``licenses`` and ``notices``: (digest, license, n_chars), curated tables of any size, as ``known`` makes.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.drop("digest", "license", "notices")
    rest = [c for c in docs.columns if c != "text"]
    licenses, notices = (df.where("n_chars > 0") for df in (licenses, notices))
    # lines shorter or longer than every notice are none of them
    least, most = notices.agg(F.min("n_chars"), F.max("n_chars")).first()
    plain = docs.select(*rest, _plain(F.col("text")).alias("_plain"))
    lines = F.transform(F.split("_plain", "\n", -1), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: F.char_length(x).between(least or 0, most or 0))
    hashes = F.transform(F.array_distinct(lines), lambda x: F.sha2(x, 256))
    rows = shelf.put(plain.select(*rest, F.sha2(_one_line(F.col("_plain")), 256).alias("digest"), hashes.alias("_lines")).withColumn("_row", F.monotonically_increasing_id()))
    # a notice may stand in, and a licence be, a third of all rows
    side = lambda known, *c: maybe_broadcast(known.select(F.col("digest").alias("_d"), *c), known.count(), broadcast_rows)
    held = spread_join(rows.select("_row", F.explode("_lines").alias("_d")), side(notices, F.col("license").alias("_n")), ["_d"], "_row")
    held = held.groupBy("_row").agg(F.array_sort(F.collect_set("_n")).alias("notices"))
    out = spread_join(rows.drop("_lines").withColumn("_d", F.col("digest")), side(licenses, "license"), ["_d"], "_row", "left")
    out = out.join(held, "_row", "left")
    return out.select(*rest, "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), known(spark), known(spark, NOTICES))
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def sql() -> str:
    """Line by line: lines that name a holder are left out of the list, the others are spelt and joined."""
    held = r"^[^\pL0-9©(]*((?i:copyright)[ \t:,]*(\([Cc]\)|©|(19|20)[0-9][0-9]|\[yyyy\]|<year>)|\([Cc]\)[ \t]*(19|20)[0-9][0-9]|©)"
    named = r"^[^\pL0-9©(]*[Cc]opyright[ \t:]+(([Bb]y|[Tt]he) )*\p{Lu}\p{Ll}"
    of_law = r"^[^\pL0-9©(]*[Cc]opyright[ \t:]+(([Bb]y|[Tt]he) )*(?i:holder|owner|notice|licen[cs]e|law|act)"
    reserved = r"^[^\pL0-9]*(?i:all rights reserved)[^\pL0-9]*$"
    spelt = f"translate(x, '{UPPER}', '{UPPER.lower()}')"
    for a, b in SPELLINGS:
        spelt = f"replace({spelt}, '{a}', '{b}')"
    spelt = rf"trim(regexp_replace({spelt}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    holds = f"(regexp_matches(x, '{held}') OR (regexp_matches(x, '{named}') AND NOT regexp_matches(x, '{of_law}')) OR regexp_matches(x, '{reserved}'))"
    lines = f"list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT {holds}), lambda x: {spelt})"
    whole = f"array_to_string(list_filter({lines}, lambda y: y <> ''), ' ')"

    def rows(texts):
        pairs = [(k, t) for k, v in texts.items() for t in ([v] if isinstance(v, str) else v)]
        return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in pairs)

    return f"""
WITH lic AS (SELECT {whole} AS t, min(license) AS license FROM (VALUES {rows(known_texts())}) v(license, text) GROUP BY 1),
note AS (SELECT {whole} AS t, min(license) AS license FROM (VALUES {rows(NOTICES)}) v(license, text) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS ls, {whole} AS t FROM documents),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, unnest(ls) AS t FROM d) JOIN note USING (t) GROUP BY doc_id)
SELECT d.doc_id, sha256(d.t) AS digest, lic.license, coalesce(notices, '') AS notices FROM d LEFT JOIN lic ON lic.t = d.t LEFT JOIN named USING (doc_id)
"""
