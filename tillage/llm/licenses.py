"""Operator 10: licence scans by canonical digest lookup. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm.common import Scratch

#: Equivalent spellings of whole words, the right one first.
SPELLINGS = (
    ("license", "licence"), ("licenses", "licences"), ("licensed", "licenced"), ("licensor", "licencor"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("noncommercial", "non commercial"), ("sublicense", "sub license"), ("sublicense", "sub licence"), ("sublicense", "sublicence"), ("merchantability", "merchantibility"), ("whether", "wether"), ("while", "whilst"),
    ("favor", "favour"), ("behavior", "behaviour"), ("program", "programme"), ("programs", "programmes"), ("fulfill", "fulfil"), ("judgment", "judgement"), ("acknowledgment", "acknowledgement"),
    ("organization", "organisation"), ("organizations", "organisations"), ("authorized", "authorised"), ("noninfringement", "non infringement"), ("third party", "thirdparty"),
)
#: Texts of known licences and notices by name.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
)
#: sha256 of the canonical() whole texts of longer licences as published, and of those that have an appendix up to "END OF TERMS AND CONDITIONS".
DIGESTS = (
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def _stripped(text: str | Column) -> Column:
    """Lower case, lines that state a copyright emptied, all but letters, digits and line ends made one space."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?: \(c\)| ©|:)? *(?:\d|by\b|©|\(c\))|© *\d|\(c\) *\d|all rights reserved)[^\n]*$", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _doubled(text: str) -> str:
    return f" {text.replace(' ', '  ')} "


def _replaced(words: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Equivalent spellings become one; blanks stand doubled meanwhile and line ends apart, so that each word has its own on either side."""
    words = F.concat(F.lit(" "), F.replace(F.replace(words, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for right, other in pairs:
        words = F.replace(words, F.lit(_doubled(other)), F.lit(_doubled(right)))
    return F.replace(words, F.lit("  "), F.lit(" "))


def _spelled(stripped: Column) -> Column:
    """Lines with equivalent spellings made one in each."""
    return _replaced(stripped, SPELLINGS)


def _flat(spelled: Column) -> Column:
    """Spelled lines as one; only spellings of several words may still stand across two of them."""
    return F.trim(_replaced(F.trim(F.regexp_replace(spelled, r"[ \n]+", " ")), [pair for pair in SPELLINGS if " " in pair[1]]))


def canonical(text: str | Column) -> Column:
    """Lines that state a copyright go; lower case; all but letters and digits becomes one space; equivalent spellings become one."""
    return _flat(_spelled(_stripped(text)))


def digests(known: DataFrame) -> DataFrame:
    """(digest, license) of known(license, text): one row per digest, the first name by alphabet."""
    return known.where(canonical("text") != "").groupBy(F.sha2(canonical("text"), 256).alias("digest")).agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of licences that are known by their canonical digest alone."""
    return spark.createDataFrame(DIGESTS, "license string, digest string")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def licenses_of(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of a folder of texts, named by their files without the ending: what scan() takes beside or instead of known_licenses()."""
    texts = spark.read.text(folder, wholetext=True)
    return texts.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.txt)?$", 1).alias("license"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Which licence each row of documents(doc_id, text) is, and which it states on a line of its own.

    known has (license, text); listed, if given, has (license, digest) of further whole texts, which are no lines. Of two names of
    one digest the first by alphabet counts. Returns doc_id; digest (sha256 of the canonical whole text); license (the known licence whose whole text has that digest, else null);
    line_licenses (sorted names of the known texts that are a line of the document, comma-joined, else null; lines meet by a
    64-bit digest of their canonical form). One pass over the texts; the joins move digests only.

    Defined cases: null, empty and wordless texts have the empty text's digest and no licence; null and repeated doc_ids and
    repeated rows come out as they are; extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    lines = F.transform(F.split("plain", "\n"), lambda x: F.trim(x))
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))
    rows = docs.select("doc_id", _spelled(_stripped("text")).alias("plain")).select("doc_id", F.sha2(_flat(F.col("plain")), 256).alias("digest"), keys.alias("keys"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    stated = known.where(canonical("text") != "").select(F.xxhash64(canonical("text")).alias("key"), "license").distinct()
    stated = rows.select("row", F.explode("keys").alias("key")).join(stated, "key").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    whole = digests(known)
    if listed is not None:
        whole = whole.unionByName(listed.select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license"))
    return rows.select("row", "doc_id", "digest").join(whole, "digest", "left").join(stated, "row", "left").select("doc_id", "digest", "license", "line_licenses")


#: DuckDB SQL of the query's rows.
def oracle() -> str:
    def spelled(x: str) -> str:
        x = f"' ' || replace({x}, ' ', '  ') || ' '"
        for right, other in SPELLINGS:
            x = f"replace({x}, '{_doubled(other)}', '{_doubled(right)}')"
        return f"trim(replace({x}, '  ', ' '))"

    strip = r"""regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?m)^[^\p{L}\p{N}\n]*(?:copyright(?: \(c\)| ©|:)? *(?:\d|by\b|©|\(c\))|© *\d|\(c\) *\d|all rights reserved)[^\n]*$', '', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g')"""
    flat = spelled("trim(regexp_replace(plain, '[ \\n]+', ' ', 'g'))")
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    listed = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS)
    return f"""
WITH known AS (SELECT license, {flat} AS canon FROM (SELECT license, {strip} AS plain FROM (VALUES {values}) AS v(license, text))),
d AS (SELECT doc_id, row_number() OVER () AS rid, {strip} AS plain FROM documents),
whole AS (SELECT doc_id, rid, sha256({flat}) AS digest FROM d),
lines AS (SELECT DISTINCT rid, {spelled("trim(line)")} AS canon FROM (SELECT rid, unnest(string_split(plain, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
stated AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known USING (canon) GROUP BY rid),
texts AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256(canon) AS digest FROM known UNION ALL SELECT * FROM (VALUES {listed}) AS g(license, digest)) GROUP BY 1)
SELECT doc_id, digest, license, line_licenses FROM whole LEFT JOIN texts USING (digest) LEFT JOIN stated USING (rid)
"""
