"""Licence scans by canonical digest: normalise an entire text, digest it, hash-join to known digests.

DataFrame operations only. Normalising drops what may differ between two copies of one licence: case,
copyright lines, punctuation, spacing and equivalent spellings. Texts that are equal afterwards have equal
digests, so the scan is one equi-join with a registry of fixed size, whatever the corpus.

The same look-up is made of the parts that may hold a licence or a notice inside a longer document: every
line, and every block of several lines between blank lines, whose words hint at a licence (``HINT``, which
every known text holds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licences treat as equal.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "organisations": "organizations",
    "favour": "favor",
    "honour": "honor",
    "acknowledgement": "acknowledgment",
    "whilst": "while",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "non commercial": "noncommercial",
    "https": "http",
}

#: Public licence texts and notices, with the id that each stands for.
KNOWN_TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
}

#: Lines that name a holder: with a year anywhere, with the sign in front, or the word in front of a capital.
COPYRIGHT_LINE = (
    r"(?m)^[^\n]{0,200}(?i:copyright|\(c\)|©)[^\n]{0,200}(?:19|20)[0-9]{2}[^\n]{0,200}$"
    r"|^[^A-Za-z0-9\n]*(?i:copyright[ \t]+)?(?i:\(c\)|©)[^\n]{0,200}$"
    r"|^[^A-Za-z0-9\n]*(?i:copyright)[ \t]+(?:by[ \t]+)?[A-Z][^\n]{0,80}$"
    r"|^[ \t]*(?i:all rights reserved)\.?[ \t]*$"
)
#: Words of which every known text, and every paragraph that stands for one, holds one.
HINT = r"licen[cs]e|permission|permitted|software|warrant|domain|redistribut|notice"
#: Paragraphs of a licence of so many words or more stand for it, if no other licence has them.
PARAGRAPH_WORDS = 12
BLANK_LINE = r"\n[ \t\r]*\n"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, runs of anything but ASCII letters and digits as one space, one spelling."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " "))
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^a-z0-9]+", " "), F.lit(" "))
    for other, usual in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(known: dict[str, tuple[str, ...]] = KNOWN_TEXTS) -> list[tuple[str, str, bool]]:
    """(licence, text, whole): the texts, and their long paragraphs."""
    out = []
    for name, texts in known.items():
        for t in texts:
            parts = t.split("\n\n")
            out += [(name, t, True), *[(name, p, False) for p in parts if len(parts) > 1 and len(p.split()) >= PARAGRAPH_WORDS]]
    return out


def registry_of(texts: DataFrame) -> DataFrame:
    """digest, licence, whole of ``texts`` (licence, t, whole), normalised like the corpus. A digest that stands
    for several licences (a disclaimer that they share) names none; the whole text goes before a paragraph."""
    digests = texts.select(digest(F.col("t")).alias("digest"), "licence", "whole")
    one = digests.groupBy("digest").agg(F.min("licence").alias("licence"), F.max("licence").alias("other"), F.bool_or("whole").alias("whole"))
    return one.filter("licence = other").drop("other")


def registry(spark: SparkSession, known: dict[str, tuple[str, ...]] = KNOWN_TEXTS) -> DataFrame:
    values = [F.struct(F.lit(name).alias("licence"), F.lit(t).alias("t"), F.lit(whole).alias("whole")) for name, t, whole in known_texts(known)]
    return registry_of(spark.range(1).select(F.inline(F.array(*values))))


def registry_of_files(spark: SparkSession, path: str) -> DataFrame:
    """A registry of whole licence texts, a file each, named like the file: for bodies too long for a module."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("licence"), F.col("value").alias("t"), F.lit(True).alias("whole"))
    return registry_of(files)


def parts(text: Column) -> Column:
    """array<string>: lines, and blocks of several lines between blank lines, that hint at a licence."""
    hinting = lambda found: F.filter(found, lambda x: F.lower(x).rlike(HINT))
    blocks = F.filter(F.split(text, BLANK_LINE), lambda x: F.contains(F.trim(x, F.lit("\n")), F.lit("\n")))
    return F.when(F.lower(text).rlike(HINT), F.concat(hinting(F.split(text, "\n")), hinting(blocks))).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_canonical (characters), digest, licence (null where the text is no known
    licence), n_notices (lines and blocks inside it that are one), notices (their licences, distinct, ascending).

    Null texts are empty; an empty canonical text matches nothing. The registry has a fixed number of
    rows and is broadcast for that reason; a registry that the caller passes is joined as Spark sees fit.
    Repeated rows give repeated rows; extra columns are not read.
    """
    fixed = known is None
    known = registry(docs.sparkSession) if fixed else known.select("digest", "licence", "whole").dropDuplicates(["digest"])
    known = known.select(F.col("digest").alias("d"), "licence", "whole")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a number for each row of the scan, so that the parts of a document fold into a row again
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), canonical(text).alias("whole_text"), parts(text).alias("parts"))
    own = F.struct(F.sha2("whole_text", 256).alias("digest"), F.length("whole_text").cast("long").alias("n"))
    inside = F.transform("parts", lambda x: F.struct(digest(x).alias("digest"), F.lit(None).cast("long").alias("n")))
    rows = d.select("row", "doc_id", F.explode(F.concat(F.array(own), inside)).alias("x")).select("row", "doc_id", "x.*")
    met = rows.join(F.broadcast(known) if fixed else known, F.col("digest") == F.col("d"), "left")
    is_own = F.col("n").isNotNull()
    folded = met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n").alias("n_canonical"), F.max(F.when(is_own, F.col("digest"))).alias("digest"),
        F.max(F.when(is_own & F.col("whole"), F.col("licence"))).alias("licence"),
        F.count_if(~is_own & F.col("licence").isNotNull()).alias("n_notices"), F.array_join(F.array_sort(F.collect_set(F.when(~is_own, F.col("licence")))), ",").alias("notices"),
    )
    return folded.drop("row")
