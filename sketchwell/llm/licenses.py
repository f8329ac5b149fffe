"""License scans by canonical digest: entire texts, and entire lines, hash-joined to known digests.

Canonical form: lower case; equivalent spellings made one; lines of copyright notices dropped;
everything but letters and digits is one blank. The SHA-256 of that is looked up among the digests of
known licence texts and notices, which go through the same expressions. Only DataFrame functions.

The list holds the texts of MIT, ISC, 0BSD, Zlib, BSD-2-Clause, BSD-3-Clause, BSL-1.0, Unlicense, WTFPL and the notice
of Apache-2.0, and one-line notices of some more. Longer licences (Apache-2.0, MPL-2.0, the GPLs and CC texts as a whole) aren't in it:
`known_digests` takes any table of (license, text), such as a folder of licence files read with `wholetext`.

Null and empty texts have the digest of the empty string and no licence. Whole texts of any length.
Rows that share doc_id and digest give one row; rows without a doc_id are told apart by their digest. Ties: a text has
one digest, a digest one licence. Empty input: no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgment", "acknowledgement"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("http://", "https://"),
    ("©", "(c)"),
    ("&", "and"),
]

#: A line that is a copyright notice: an owner's line, not a sentence about copyright.
NOTICE = r"(?m)^[^a-z0-9(\n]*(copyright[ \t]*(\(c\)|[0-9]{4}|:|[^\n]{0,80}[0-9]{4})|\(c\)[ \t]*[0-9]{4}|all rights reserved)[^\n]*$"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_BOOST = "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
_WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."

#: Known licence texts and one-line notices: (licence, text).
KNOWN = [
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holders>\n\n{_GRANT}\n\n{_AS_IS}"),
    ("MIT", f"{_GRANT}\n\n{_AS_IS}"),
    ("MIT", f"The MIT License (MIT)\n\n{_GRANT}\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC}\n\n{_AUTHOR}"),
    ("ISC", f"{_ISC}\n\n{_AUTHOR}"),
    ("0BSD", f"{_ZERO}\n\n{_AUTHOR}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD}\n\n{_HOLDER}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_HOLDER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD}\n\n{_NAMES}\n\n{_HOLDER}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_NAMES}\n\n{_HOLDER}"),
    ("Apache-2.0", _APACHE),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("WTFPL", _WTFPL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]


def folded(text: Column) -> Column:
    """Canonical but for line ends."""
    c = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, NOTICE, ""), r"[^\p{L}\p{N}\n]+", " ")


def closed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license): as many rows as there are known texts."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    return rows.select(F.sha2(closed(folded(F.col("text"))), 256).alias("digest"), "license").dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices): the licence that the entire text is, and those of entire lines, by name."""
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known  # our list is short; of a caller's Spark decides
    c = docs.select("doc_id", folded(F.col("text")).alias("c"))
    lines = F.transform(F.split("c", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("unit")))
    c = c.withColumn("text_digest", F.when(F.col("doc_id").isNull(), F.sha2(closed(F.col("c")), 256)))
    units = c.select("doc_id", "text_digest", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("line"), closed(F.col("c")).alias("unit"))), F.filter(lines, lambda x: x.unit != ""))).alias("u"))
    looked = units.select("doc_id", "text_digest", F.col("u.line").alias("line"), F.sha2("u.unit", 256).alias("digest")).join(known, "digest", "left").where("line = 0 or license is not null")
    whole = F.col("line") == 0
    own = F.when(F.col("doc_id").isNull(), F.col("text_digest"))  # no group of all rows without an id
    per = looked.groupBy("doc_id", own.alias("own")).agg(F.collect_set(F.when(whole, F.struct("digest", "license"))).alias("w"), F.sort_array(F.collect_set(F.when(~whole, F.col("license")))).alias("n"))
    return per.select("doc_id", F.explode("w").alias("w"), F.concat_ws(",", "n").alias("notices")).select("doc_id", "w.digest", "w.license", "notices")


def oracle(known: list[tuple[str, str]] | None = None) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def fold(c: str) -> str:
        c = f"lower(coalesce({c}, ''))"
        for a, b in SPELLINGS:
            c = f"replace({c}, {q(a)}, {q(b)})"
        notice = NOTICE.removeprefix("(?m)")
        return f"regexp_replace(regexp_replace({c}, {q('(?m)' + notice)}, '', 'g'), {q(r'[^\\p{L}\\p{N}\\n]+'.replace(chr(92) * 2, chr(92)))}, ' ', 'g')"

    shut = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    rows = ", ".join(f"({q(n)}, {q(t)})" for n, t in (KNOWN if known is None else known))
    return f"""WITH k AS (SELECT DISTINCT sha256({shut(fold('t'))}) AS digest, license FROM (VALUES {rows}) v(license, t)),
c AS (SELECT doc_id, {fold('text')} AS c FROM documents),
w AS (SELECT DISTINCT doc_id, sha256({shut('c')}) AS digest FROM c),
l AS (SELECT doc_id, own, sha256(trim(x)) AS digest FROM (SELECT doc_id, CASE WHEN doc_id IS NULL THEN sha256({shut('c')}) END AS own, unnest(string_split(c, chr(10))) AS x FROM c) WHERE trim(x) <> ''),
n AS (SELECT doc_id, own, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k USING (digest) GROUP BY doc_id, own)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM w.doc_id AND (n.own IS NULL OR n.own = w.digest)"""
