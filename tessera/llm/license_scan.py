"""Operator 2, licence scans: canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, punctuation and
equivalent spellings folded away), hashed whole, and the digest is joined with
those of known licences, each with and without its usual titles. The known side
is a table of a few rows for each licence; it is joined by hash, and the planner
broadcasts it only below its own threshold.

Besides whole texts, ``license_notices`` looks up each line of a text the same
way, for notices within documents.

Defined cases: a null text counts as empty and matches nothing, as does any
text with an empty canonical form; of several licences with one canonical form
the least identifier is named; rows that repeat an id are looked up one by one;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import digest, table, text_of

# The texts of short, widely used licences.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
# The titles that such texts are found under.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Notices of one line.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Digests of the canonical forms of long licences, as Debian's base files have them.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["a4f874aaeee4dfe824fb3cc3dcca2009", "907c90224903199ffe6fc357841e86c5", "5d2795cb35f13d3f170c4a82e7d9f97f"],  # whole, without the appendix, without its last line
    "Artistic-1.0-Perl": ["c1b81bf4478b19597097b63e59382266"],
    "CC0-1.0": ["d2a76f70ce19809695b7fb93c6241c23"],
    "GFDL-1.2": ["f65a69ceeb8d59bf71c628734fd16e2a"],
    "GFDL-1.3": ["4a2b8a115ec9f701b75100ff194a1656"],
    "GPL-1.0": ["486813732101b0a91b2da6282549d2ef"],
    "GPL-2.0": ["3f856f52767322b9bde28951f3e6a334"],
    "GPL-3.0": ["b359bcdf94cbb843e4ccc834fd2f72f7"],
    "LGPL-2.0": ["6151612202041c2c6300ece4b302d965"],
    "LGPL-2.1": ["fe7ed1654a8bb40851da701339a8dbf8"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["a752086f6104469fe0aa23212fce940b"],
    "MPL-2.0": ["b5b7a0cf4994910cd0204fba4637d6ec"],
}
# Spellings that mean the same, as pattern and replacement, on lower-case words split by single blanks.
SPELLINGS = [
    ("licen[cs](e|es|ed|ing|or|ee)\\b", "licens$1"),
    ("\\bcopyright holder\\b", "copyright owner"),
    ("\\bsub license\\b", "sublicense"),
    ("\\bnon infringement\\b", "noninfringement"),
    ("\\backnowledgement\\b", "acknowledgment"),
    ("\\bfulfilment\\b", "fulfillment"),
    ("\\bfavour\\b", "favor"),
    ("\\b(autho|organi|utili)s(e|ed|es|ing|ation)\\b", "$1z$2"),
    ("\\bhttps\\b", "http"),
]


# A line of a copyright: by its sign or year, or by whose it is; the line that follows often reserves all rights.
COPYRIGHT = "^[^\\p{L}\\p{N}\\n]*((copyright|\\(c\\)|©)[^\\n]*(\\d|©|\\(c\\))|copyright +(the|by)\\b)[^\\n]*$(\\s*^[^\\p{L}\\p{N}\\n]*all rights reserved[^\\p{L}\\p{N}\\n]*$)?"


def canonical(text: str | Column) -> Column:
    """Lower case, no copyright lines, one blank between runs of letters and
    digits, one spelling."""
    out = F.regexp_replace(F.lower(text_of(text)), f"(?md){COPYRIGHT}", " ")
    out = F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))

    def spelled(x: Column) -> Column:
        y = x
        for pattern, to in SPELLINGS:
            y = F.regexp_replace(y, pattern, to)
        # Most texts have none of these words: one search is cheaper than nine replacements.
        return F.when(x.rlike("|".join(p for p, _ in SPELLINGS)), y).otherwise(x)

    return F.get(F.transform(F.array(out), spelled), 0)


def _rows(spark: SparkSession, names: tuple[str, str], rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def known_texts() -> list[tuple[str, str]]:
    """``license_id, text``: every known short text, alone and under each of its titles."""
    titled = [(k, f"{title}\n\n{text}") for k, text in LICENSES.items() for title in TITLES.get(k, [])]
    return sorted([*LICENSES.items(), *titled, *NOTICES.items()])


def known_licenses(spark: SparkSession) -> DataFrame:
    """``h, license_id`` of all known licences: from their texts, or by digest where those are long."""
    long = _rows(spark, ("digest", "license_id"), sorted((v, k) for k, vs in DIGESTS.items() for v in vs)).select(F.unhex("digest").alias("h"), "license_id")
    return digests(_rows(spark, ("license_id", "text"), known_texts())).union(long)


def digests(known: DataFrame) -> DataFrame:
    """``h, license_id`` for a table of licences' texts (``license_id, text``), such as a folder of them."""
    form = canonical("text")
    return known.filter(F.length(form) > 0).groupBy(digest(form).alias("h")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license_id`` for each row of ``docs``; ``license_id``
    is null where the whole text is no known licence (``h, license_id``)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(canonical(text_col)).alias("h"))
    return rows.join(known, "h", "left").select("doc_id", F.col("h").alias("digest"), "license_id")


def license_notices(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license_id, n_lines``: the lines of each text that are, whole,
    a known licence or notice."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\n")).alias("line"))
    found = lines.select("doc_id", digest(canonical("line")).alias("h")).join(known, "h")
    return found.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_lines"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs, known = table(spark, sf_dir, "documents"), known_licenses(spark)
    whole = license_scan(docs, known)
    return whole.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "license_id")


def license_notice_lines(spark, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '(?m){COPYRIGHT}', ' ', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return out


def _sql_values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_KNOWN_SQL = f"""known AS (
  SELECT md5({_sql_canonical("t.text")}) AS h, min(license_id) AS license_id FROM (VALUES {_sql_values(known_texts())}) t(license_id, text) GROUP BY 1
  UNION ALL SELECT * FROM (VALUES {_sql_values(sorted((v, k) for k, vs in DIGESTS.items() for v in vs))})
)"""
OP2_SQL = f"""
WITH {_KNOWN_SQL}, d AS (
  SELECT doc_id, md5({_sql_canonical("text")}) AS digest FROM documents
)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known ON d.digest = known.h
"""
NOTICES_SQL = f"""
WITH {_KNOWN_SQL}, l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
)
SELECT doc_id, license_id, count(*) AS n_lines FROM l JOIN known ON md5({_sql_canonical("line")}) = h GROUP BY doc_id, license_id
"""
