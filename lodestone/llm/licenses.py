"""License scan by canonical digests.

A text is brought to a canonical form (case, equivalent spellings, copyright lines, punctuation and white space), and
the digest of the entire canonical text is joined with the digests of known licences. The same is done for each line
as an entire text, so that one-line notices inside a document are found too. Nothing is shuffled but the table of
known licences, which is fixed and small.

Defined cases: null, empty or blank text has no licence and a null digest (as has one of copyright lines only);
repeated rows each get a row; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import read_table

#: Equivalent spellings, replaced in this order in lower-cased text.
SPELLINGS = [
    ("licence", "license"), ("copyright holder", "copyright owner"), ("per cent", "percent"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("whilst", "while"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and "),
]
#: A line that starts so is a copyright line.
COPYRIGHT = r"^\s*(copyright|\(c\)|©|all rights reserved)"

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licence texts and usual one-line notices, under SPDX names.
KNOWN = [
    ("MIT", MIT_BODY),
    ("MIT", "The MIT License\n\n" + MIT_BODY),
    ("MIT", "MIT License\n\n" + MIT_BODY),
    ("ISC", ISC_BODY),
    ("ISC", "ISC License\n\n" + ISC_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]

BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THREE = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Further full texts. They stand apart from KNOWN, from which the check SQL is made.
FULL = [(n, head + body) for n, title, body in (("BSD-2-Clause", "BSD 2-Clause License", BSD_TWO + BSD_END), ("BSD-3-Clause", "BSD 3-Clause License", BSD_TWO + BSD_THREE + BSD_END)) for head in ("", title + "\n\n")]
#: Digests of the canonical forms of full texts as Debian ships them; "terms" ends with the terms and conditions.
DIGESTS = [
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),  # terms
    ("GPL-1.0-only", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0-only", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),  # terms
    ("GPL-2.0-only", "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a"),
    ("GPL-2.0-only", "5e9874a182b8e50f136aed39c11d5b872aaa6c94c59b0780c37559869ffd0faa"),  # terms
    ("GPL-3.0-only", "bd8a9678cc102044334826438740622a2d2bd3bcb7254d45d9ab87e1bfced4ed"),
    ("GPL-3.0-only", "502fa73c5788144cfc3b1b6c0f5f6f80fdf0eea24cd8697030ef964b7de67d2f"),  # terms
    ("LGPL-2.0-only", "82b9c718a1edbbe60a4f5828e6e8c8390d714f09bfee18638761bb3f8fdff504"),
    ("LGPL-2.0-only", "c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a"),  # terms
    ("LGPL-2.1-only", "8972cc10118fe8a142e8b2d34ba122d3a2c710126a256b6786246af9ae4cd5a6"),
    ("LGPL-2.1-only", "0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e"),  # terms
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),  # of the Regents
]


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that is neither blank nor a copyright line."""
    c = F.lower(text)
    for found, put in SPELLINGS:
        c = F.replace(c, F.lit(found), F.lit(put))
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(COPYRIGHT))
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    return F.filter(plain, lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """license, digest of the canonical text; made on the cluster by the same expressions as for documents."""
    own = spark.createDataFrame(known, "license string, text string")
    return own.select("license", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the canonical text, license of the entire text or null, notices: sorted licences of lines."""
    spark = docs.sparkSession
    table = known_digests(spark, KNOWN + FULL if known is None else known)
    if known is None:
        table = table.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string"))
    listed = table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("_known"))  # one row, as large as `known`
    own = docs.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("_lines"))
    own = own.withColumn("digest", F.when(F.size("_lines") > 0, F.sha2(F.array_join("_lines", " "), 256)))
    found = own.join(F.broadcast(table), "digest", "left").join(F.broadcast(listed))
    lines = F.transform(F.array_intersect(F.transform("_lines", lambda x: F.sha2(x, 256)), F.map_keys("_known")), lambda d: F.element_at("_known", d))
    return found.select(id_col, "digest", "license", F.coalesce(F.array_sort(F.array_distinct(lines)), F.array().cast("array<string>")).alias("notices"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    clean = "lower(text)"
    for found, put in SPELLINGS:
        clean = f"replace({clean}, {quoted(found)}, {quoted(put)})"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    lines = (
        f"list_filter(list_transform(list_filter(string_split({clean}, chr(10)), lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT)})), "
        r"lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '')"
    )
    return f"""
WITH k AS (SELECT DISTINCT license, sha256(array_to_string({lines}, ' ')) AS digest FROM (VALUES {known}) v(license, text)),
d AS (SELECT row_number() OVER () AS n, doc_id, {lines} AS lines FROM documents),
w AS (SELECT n, doc_id, lines, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest FROM d),
l AS (SELECT DISTINCT n, license FROM (SELECT n, sha256(unnest(lines)) AS digest FROM w) JOIN k USING (digest)),
a AS (SELECT n, string_agg(license, ',' ORDER BY license) AS notices FROM l GROUP BY n)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN a USING (n)
"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _sql()}
