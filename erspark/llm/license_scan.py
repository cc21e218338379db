"""License scans by canonical digest, in DataFrame functions only.

A text is canonical once letters A-Z are lower-cased, copyright lines are gone,
equivalent spellings are one, and punctuation and white space are single
spaces.  The SHA-256 of the whole canonical text, and of each of its canonical
lines, is looked up among the digests of known licences and notices by a hash
join.  The known side is this module's fixed table (or the caller's), so it is
broadcast only if it is small.

Cases: null and empty texts match nothing and keep a row; a null doc_id is kept;
every row has its own findings, rows of one id too; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

# Public licence names, their identifiers and usual forms of notice.
NAMES = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
NOTICES = (
    "{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
    "Distributed under the {}", "Published under the {}", "This work is licensed under {}", "This work is licensed under the {}",
    "This program is licensed under the {}", "This file is licensed under the {}", "Available under the {}",
)
GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GRANT_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
HEADER_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
HEADER_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
HEADER_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.
This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.
You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."""
TEXT_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
TEXT_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXT_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GRANT_0BSD = GRANT_ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
#: Whole texts by licence, each with its usual headings; for licences of many
#: pages the header that files carry.  A caller's table can hold any others.
TEXTS = {
    "MIT": (GRANT_MIT, "MIT License\n" + GRANT_MIT, "The MIT License\n" + GRANT_MIT, "The MIT License (MIT)\n" + GRANT_MIT),
    "ISC": (GRANT_ISC, "ISC License\n" + GRANT_ISC),
    "0BSD": (GRANT_0BSD, "BSD Zero Clause License\n" + GRANT_0BSD),
    "BSD-2-Clause": (BSD_HEAD + BSD_TAIL, "BSD 2-Clause License\n" + BSD_HEAD + BSD_TAIL),
    "BSD-3-Clause": (BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    "Unlicense": (TEXT_UNLICENSE,),
    "Zlib": (TEXT_ZLIB, "zlib License\n" + TEXT_ZLIB),
    "BSL-1.0": (TEXT_BSL, "Boost Software License - Version 1.0 - August 17th, 2003\n" + TEXT_BSL),
    "Apache-2.0": (HEADER_APACHE,),
    "MPL-2.0": (HEADER_MPL,),
    "GPL-2.0": (HEADER_GNU.format("program", "General Public License", "2"),),
    "GPL-3.0": (HEADER_GNU.format("program", "General Public License", "3"),),
    "LGPL-2.1": (HEADER_GNU.format("library", "Lesser General Public License", "2.1"),),
    "LGPL-3.0": (HEADER_GNU.format("program", "Lesser General Public License", "3"),),
    "AGPL-3.0": (HEADER_GNU.format("program", "Affero General Public License", "3"),),
}

#: Equivalent spellings of canonical words, in this order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https ", "http "),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII marks and white space, and typographic quotes and dashes.
MARKS = "[\\x00-/:-@\\[-`{-\\x7F ©‐-‟…]+"
COPYRIGHT = "^ ?(copyright( c)? [0-9]|c [0-9]{4} |copyright c |copyright by |all rights reserved ?$)"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty and copyright lines."""

    def canon(line: Column) -> Column:
        out = F.regexp_replace(line, MARKS, " ")
        for a, b in SPELLINGS:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.trim(out)

    lines = F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), canon)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known_licenses(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(license, digest) of the fixed table, and of a caller's (license, text)
    table, such as a folder of licence files.  A text in both goes by the lesser
    name."""
    rows = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    rows += [(k, f"SPDX-License-Identifier: {k}") for k in NAMES] + [(k, t) for k, ts in TEXTS.items() for t in ts]
    made = spark.createDataFrame(rows, "license string, text string")
    if more is not None:
        made = made.unionByName(more.select("license", "text"))
    return made.select(F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, digest of the canonical text, license (of the
    whole text, else null), line_licenses (sorted, joined by commas; '' if none)
    and n_license_lines.  Texts are read and made canonical once; the digests of
    a row meet the table in one hash join and come together by a key of the row."""
    known = small(known if known is not None else known_licenses(docs.sparkSession), 100_000)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), canonical_lines(body).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), (F.size("lines") > 0).alias("some"), F.sha2(F.array_join("lines", " "), 256).alias("digest"))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.lit(True).alias("some"), F.sha2(x, 256).alias("digest")))
    digests = lines.select("row", "id", F.explode(F.concat(F.array(whole), each)).alias("d")).select("row", "id", "d.*")
    met = digests.join(known, "digest", "left").where("whole or license is not null")
    line = F.when(~F.col("whole"), F.col("license"))
    out = met.groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.struct("id", "digest", F.when(F.col("some"), F.col("license")).alias("license")))).alias("w"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("line_licenses"), F.count(line).alias("n_license_lines"),
    )
    return out.select(F.col("w.id").alias(id_col), "w.digest", "w.license", "line_licenses", "n_license_lines")


def oracle_sql() -> str:
    """The same in DuckDB SQL over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    rows += [(k, f"SPDX-License-Identifier: {k}") for k in NAMES] + [(k, t) for k, ts in TEXTS.items() for t in ts]

    def lines(text: str) -> str:
        canon = f"regexp_replace(l, '{MARKS}', ' ', 'g')"
        for a, b in SPELLINGS:
            canon = f"replace({canon}, '{a}', '{b}')"
        return f"list_filter(list_transform(string_split(translate({text}, '{UPPER}', '{LOWER}'), chr(10)), lambda l: trim({canon})), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"

    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in rows)
    return f"""
WITH known AS (SELECT sha256(array_to_string({lines('t')}, ' ')) AS digest, min(k) AS license FROM (VALUES {values}) v(k, t) GROUP BY 1),
 doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
 hit AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS a, count(*) AS n
  FROM (SELECT r, sha256(unnest(ls)) AS digest FROM doc) JOIN known USING (digest) GROUP BY r)
SELECT d.doc_id, sha256(array_to_string(d.ls, ' ')) AS digest, CASE WHEN len(d.ls) > 0 THEN k.license END AS license,
 coalesce(h.a, '') AS line_licenses, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines
FROM doc d LEFT JOIN known k ON k.digest = sha256(array_to_string(d.ls, ' ')) LEFT JOIN hit h USING (r)"""
