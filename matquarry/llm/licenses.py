"""License scans by canonical digest lookup.

A text is made canonical (case, punctuation, white space, copyright lines, equivalent spellings) and
its digest is looked up among those of known license texts by a hash join. Entire
texts are compared: the whole document, and each of its lines, as notices are
mostly a line of their own. A text that only quotes a license does not match.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copyright statements, which differ from holder to holder (lines that open with one and go on with a year, a sign or a
#: placeholder), and the numbers of list items, which some copies lack.
COPYRIGHT = (
    r"(?im)^[ \t#*/;-]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|[<\[{]y|[<\[{]c)[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved\.?[ \t\r]*|[0-9]{1,2}[.)](?:[ \t]|$))"
)
#: What separates words: ASCII other than letters and digits, and usual typographic marks.
MARKS = r"\x00-/:-@\[-`{-\x7F‘’“”–—©®·•"
GAP = f"[{MARKS}]+"
#: Spellings that count as one (the first is replaced by the second).
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

#: Names of licenses as they stand in notices, by SPDX identifier.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC0-1.0", "CC0 1.0"),
)
#: How notices name one; identifiers that SPDX lines use beside those above.
NOTICES = ("Licensed under {}.", "Released under {}.", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.")
SPDX = tuple((f"{name}-{v}", f"{name}-{v}-{how}") for name, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for how in ("only", "or-later")) + (("Zlib", "Zlib"), ("Unlicense", "Unlicense"), ("BSL-1.0", "BSL-1.0"))

#: Texts of licenses.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
    'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES_CLAUSE = (
    "3. Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software.\n3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of "
    "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
    "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
UNLICENSE_END = "For more information, please refer to <http://unlicense.org>"
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
    "is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
    "in the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    'required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS '
    'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License."
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
#: Texts with the titles that copies put before them.
TITLED = (
    ("MIT", MIT, ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    ("ISC", ISC, ("ISC License", "The ISC License", "ISC License (ISC)")),
    ("ISC", ISC.replace("modify, and/or distribute", "modify, and distribute"), ("ISC License", "The ISC License")),
    ("BSD-2-Clause", _BSD.format("", "HOLDER"), ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License')),
    ("BSD-2-Clause", _BSD.format("", "OWNER"), ("BSD 2-Clause License",)),
    ("BSD-3-Clause", _BSD.format(_NAMES_CLAUSE.format("copyright holder"), "HOLDER"), ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License')),
    ("BSD-3-Clause", _BSD.format(_NAMES_CLAUSE.format("copyright holder"), "OWNER"), ("BSD 3-Clause License",)),
    ("Zlib", ZLIB, ("zlib License", "The zlib License")),
    ("Unlicense", UNLICENSE, ("The Unlicense",)),
    ("Unlicense", f"{UNLICENSE}\n{UNLICENSE_END}", ("The Unlicense",)),
    ("BSL-1.0", BOOST, ("Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003")),
    ("Apache-2.0", APACHE_HEADER, ()),
    ("MPL-2.0", MPL_HEADER, ()),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ()),
)
#: Known texts by identifier: notices, SPDX lines, and texts with and without a title.
KNOWN = (
    *((i, n.format(name)) for i, name in NAMES for n in NOTICES),
    *((i, f"SPDX-License-Identifier: {x}") for i, x in (*((i, i) for i, _ in NAMES), *SPDX)),
    *((i, f"{title}\n{body}".strip()) for i, body, titles in TITLED for title in ("", *titles)),
)
#: SHA-256 of the canonical forms of long texts, complete, and without what follows their terms.
DIGESTS = (
    ("Apache-2.0", "ce29545242ed48bb7f7f04a356f55c9a2246e03dfdd8dd27d37b739ece19353f"),
    ("Apache-2.0", "e2dd391e2096d837a31cb11621a6d84f0c2877d01cc75b6857b0b20bb76f9b39"),
    ("Apache-2.0", "fb4d5641387b495ab9afeee8e70bc77277cd12a9b9b0e50298fcb5b2b5274fc6"),
    ("GPL-1.0", "312ed964c77e540bdb607f644cda48e580b88c9f8d91df1eee77c93245c8493a"),
    ("GPL-1.0", "956483ec2bc0684b00d833b623e409fc107f9e4ad46b269a97b85801b5e44d57"),
    ("GPL-1.0", "50af69451b4f4323042be2b48648be1ccf43ac320b71bd83ae265a91b55895f4"),
    ("GPL-2.0", "82a6cca2aba6d89ca2af2de0d09a06af62f784080c8095ea0b6303dfc3c0221a"),
    ("GPL-2.0", "9537015d562876ea89bd9d3f0949ceb470e54929f98bea5a587da9ee0a66a53a"),
    ("GPL-2.0", "c44c78fe989f55f2781e85f5ea3ad8563febdd7b092943641629c3e204d407f4"),
    ("GPL-3.0", "660e12dced1293a483ccf0eb440b0a80ea88e5604a209dcc1870402bc3474329"),
    ("GPL-3.0", "fd824e407ec533322baf271b37f188a2e017a14acc6651e2e0ccafe46913eb68"),
    ("GPL-3.0", "8b8a15a249d6df90360243b78b2a1a71debdeb809176e7d7441c8949da98a357"),
    ("LGPL-2.0", "ec44c766883b869bef6a328cf51aafbe256ee10744ba67af3472eda9d0446def"),
    ("LGPL-2.0", "c9e721088acba1d67965dec2f9c6178cb7bb2b9de97a87a39a2c02a2295fd000"),
    ("LGPL-2.0", "1e171ab9f596d207116d86bf27b99c05d8a6f40293600a2db16618fd81e3619d"),
    ("LGPL-2.1", "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9"),
    ("LGPL-2.1", "ff0a54abc5f9cfefbee802398fd1e6974a2b6d7892c9094410ad655c56e8d867"),
    ("LGPL-2.1", "dfb509c568fdca357b76a1c523438615ce8698edf63076cc8a224aac11a0199a"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("GFDL-1.2", "f48e356f25fcd212122463ee8f7893f9f8067df767a6755dba15c164d5912553"),
    ("GFDL-1.3", "4e5d8486df1fc3a8362698aa914078558c1afbfb7e77cc7391c5ca54ea97fc14"),
    ("MPL-1.1", "85900f26acfe47b84faf6e22eeafa01467a453c81d4bf027d4a293832329694f"),
    ("MPL-2.0", "32c6d656f15cd2ffee168f7e42b79233bc2e81584b17091840d449c48f044dd4"),
    ("CC0-1.0", "2106cd4f7c9f6d4a9e5f54c911e4ff372736db5467794e4b89bcea996afde21c"),
    ("Artistic-1.0-Perl", "0ce87c1a2f9de8bd07685d372028374149e71fffb4eab93598a4cdc00ed86780"),
)
#: Each known text holds one of these in lower case, and each of DIGESTS.
ANCHORS = ("licen", "software", "cc0", "cc by")


def _spelled(words: Column) -> Column:
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def canonical(text: Column) -> Column:
    """Canonical form of a text: words in lower case with single spaces between."""
    return _spelled(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "")), GAP, " ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def holds_anchor(text: Column) -> Column:
    lower = F.lower(text)
    return functools.reduce(Column.__or__, (F.contains(lower, F.lit(a)) for a in ANCHORS))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: tuple[tuple[str, str], ...] = KNOWN,
    digests: tuple[tuple[str, str], ...] = DIGESTS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, document_license, n_license_lines, licenses.

    document_license is the license whose text the document is as a whole, else null;
    n_license_lines counts its lines that are one (texts of several lines inside a longer document are not found);
    licenses lists the distinct
    identifiers of both, sorted and comma-joined ('' without any). Null and empty texts
    have none. Repeated rows return equal rows; rows that share an id but not a text are
    looked up each by itself; null ids are allowed; other columns are ignored; an empty
    table gives an empty result. ``known`` (identifier, text) and ``digests`` (identifier, SHA-256 of the canonical text) are
    broadcast: parameters of fixed size."""
    if odd := [body for _, body in known if not any(a in body.lower() for a in ANCHORS)]:
        raise ValueError(f"known texts must hold one of {ANCHORS}: {odd[0][:80]}")
    spark = docs.sparkSession
    texts = spark.createDataFrame([*known], "license string, body string").select("license", digest(F.col("body")).alias("digest"))
    catalogue = texts.union(spark.createDataFrame([*digests], "license string, digest string"))
    catalogue = F.broadcast(catalogue.groupBy("digest").agg(F.min("license").alias("license")))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    # position 0 is the document itself, its lines follow; the anchors tell most texts from licenses at little cost
    units = rows.where(holds_anchor(F.col("text"))).select(
        "doc_id", "text_hash", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("position", "body")
    )
    found = (
        units.where(holds_anchor(F.col("body")))
        .select("doc_id", "text_hash", "position", digest(F.col("body")).alias("digest"))
        .join(catalogue, "digest")
        .dropDuplicates(["doc_id", "text_hash", "position"])
        .groupBy("doc_id", "text_hash")
        .agg(
            F.min(F.when(F.col("position") == 0, F.col("license"))).alias("document_license"),
            F.count_if(F.col("position") > 0).alias("n_license_lines"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        )
        .withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    )
    ids = rows.select("doc_id", "text_hash")
    same = ids["doc_id"].eqNullSafe(found["found_id"]) & (ids["text_hash"] == found["found_hash"])
    return ids.join(found, same, "left").select(
        "doc_id",
        "document_license",
        F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> str:
    """DuckDB SQL for ``scan`` over documents with unique ids: every line made canonical, without anchors."""

    def canonical_sql(text: str) -> str:
        lower = f"lower(regexp_replace({text}, '{COPYRIGHT}', '', 'g'))"
        words = f"trim(regexp_replace({lower}, '{GAP}', ' ', 'g'))"
        for old, new in SPELLINGS:
            words = f"replace({words}, '{old}', '{new}')"
        return words

    def values(pairs: tuple[tuple[str, str], ...]) -> str:
        return ", ".join("('%s', '%s')" % tuple(x.replace("'", "''") for x in pair) for pair in pairs)

    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, sha256({canonical_sql("body")}) AS digest FROM (VALUES {values(known)}) k(license, body)
  UNION ALL SELECT license, digest FROM (VALUES {values(digests)}) d(license, digest)) GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, 0 AS position, text AS body FROM texts
  UNION ALL SELECT doc_id, 1 AS position, unnest(string_split(text, chr(10))) AS body FROM texts),
found AS (SELECT u.doc_id, u.position, k.license FROM (SELECT doc_id, position, sha256({canonical_sql("body")}) AS digest FROM units) u JOIN known k USING (digest)),
marked AS (
  SELECT doc_id, min(license) FILTER (WHERE position = 0) AS document_license, count(*) FILTER (WHERE position = 1) AS n,
         array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
  FROM found GROUP BY doc_id)
SELECT t.doc_id, m.document_license, coalesce(m.n, 0) AS n_license_lines, coalesce(m.licenses, '') AS licenses
FROM texts t LEFT JOIN marked m USING (doc_id)
"""
