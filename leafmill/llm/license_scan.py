"""License scan by canonical digest lookup.

A text is put into canonical form - lower case, no copyright lines, one spelling for words that are spelt in several ways,
only letters and digits with single spaces - and the digest of that form is looked up among the digests of known texts.
Two kinds of texts are looked up for each document: the whole document, and each of its lines. The lookup is a hash join
of digests with the table of known texts, which is a fixed list in this file and so small that every task has it.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word, as (pattern, word), applied in this order to lower-case text.
SPELLINGS = (
    (r"\b(licence|licences|licenses)\b", "license"),
    (r"\b(licenced)\b", "licensed"),
    (r"\b(sub-license|sub-licence|sublicence)\b", "sublicense"),
    (r"\b(version|ver\.|v\.)\s*(?=[0-9])", "version "),
    (r"\bv(?=[0-9])", "version "),
    (r"\b(favour)\b", "favor"),
    (r"\b(noncommercial|non commercial)\b", "non-commercial"),
    (r"https?://", ""),
    (r"&|\+", " and "),
)

# A line that opens like this is a copyright line. The word alone isn't enough: a wrapped text may have it at the
# start of a line; a sign, a year, who holds it or nothing must follow.
COPYRIGHT_LINE = (
    r"(?m)^[ \t]*(?:[#*/;%-]+[ \t]*)?(?:copyright(?:[ \t]*(?:\(c\)|©|[<\[{:]|$)|[ \t]+by\b|\b[^\n]*\b(?:19|20)[0-9][0-9]\b|\b[^\n]*\b(?:authors|developers|foundation)[ \t.,]*$)"
    r"|copr\.|\(c\)[^\n]*\b(?:19|20)[0-9][0-9]\b|©|all rights reserved)[^\n]*$"
)

# Known texts, as (license, text).
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# What stands above the short texts in a LICENSE file.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense",),
}

# Ids that an SPDX line names; those of GNU licenses have more forms.
GNU = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
IDS = (
    *GNU, "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "Unlicense", "CC0-1.0", "EPL-2.0", "BSL-1.0", "Zlib",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-3.0", "CC-BY-SA-3.0",
)

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""


def _more() -> list[tuple[str, str]]:
    """Whole texts with and without their titles, also without what follows the terms, and SPDX lines."""
    short = [(name, text) for name, text in KNOWN if name in TITLES and len(text) > 500]
    two = next(text for name, text in short if name == "BSD-2-Clause")
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS"
    short += [("BSD-3-Clause", two.replace(" THIS SOFTWARE IS", third, 1)), ("Unlicense", _UNLICENSE)]
    # without the numbers of the conditions, or with other marks
    short += [(name, re.sub(r" [123]\. ", " ", text)) for name, text in short if name.startswith("BSD")]
    out = [*short, *((name, f"{title}\n{text}") for name, text in short for title in TITLES[name])]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        full = path.read_text()
        for text in (full, full.partition("END OF TERMS AND CONDITIONS")[0], full.partition("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"):
            out += [(path.stem, text), (path.stem, text.strip().partition("\n\n")[2])]
    for name in IDS:
        forms = (name, f"{name}-only", f"{name}-or-later", f"{name}+") if name in GNU else (name,)
        out += [(name, f"SPDX-License-Identifier: {form}") for form in forms]
    return list(dict.fromkeys(out))


KNOWN = (*KNOWN, *_more())


def canonical(text: Column) -> Column:
    """The canonical form; null and texts without a letter or digit give the empty string, which no known text has."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for pattern, word in SPELLINGS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """license and digest of the known texts, each digest once."""
    rows = spark.createDataFrame(list(KNOWN), "license string, known string")
    return rows.select("license", F.sha2(canonical(F.col("known")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


# Every canonical form of a known text has one of these, and no step of canonical() makes one that the
# lower-case text lacked. A text without any of them equals no known text, so it needs no canonical form.
ANCHORS = ("licen", "permission", "redistribution", "unencumbered")


def anchored(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        out = out | low.contains(anchor)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, n_license_lines, whole_license, licenses (sorted, distinct, joined by commas), is_license.

    whole_license: the license whose known text is the whole document, else null. is_license: the document is one, or each
    of its lines with letters or digits is a known text or a copyright line and one is a known text.
    Nulls: a null text has no license. Rows that share an id, null included, count together; a whole_license is then the
    first in alphabetical order. Very long texts: whole, line by line. Empty table: empty result. Extra columns are left
    out, whatever they are called.
    """
    known = F.broadcast(known_digests(docs.sparkSession))  # one row for each text in KNOWN at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    # the whole text and its lines are pieces of one scan, put into canonical form by one expression; a text without an
    # anchor has no pieces, and its row stays
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[\p{L}\p{N}]"))
    piece = lambda whole, value: F.struct(F.lit(whole).alias("whole"), value.alias("value"))
    pieces = F.when(anchored(F.col("text")), F.concat(F.array(piece(True, F.col("text"))), F.transform(lines, lambda line: piece(False, line))))
    rows = texts.select("doc_id", F.explode_outer(pieces).alias("piece")).select("doc_id", "piece.*")
    value, is_line = F.col("value"), ~F.col("whole")
    digest = F.when(anchored(value), F.sha2(canonical(value), 256))
    noted = rows.select("doc_id", "whole", digest.alias("digest"), (is_line & F.lower(value).rlike(COPYRIGHT_LINE)).alias("notice")).join(known, "digest", "left")
    found = F.col("license").isNotNull()
    by_doc = noted.groupBy("doc_id").agg(
        F.count_if(is_line & found).alias("n_license_lines"),
        F.count_if(is_line & (found | F.col("notice"))).alias("n_told"),
        F.count_if(is_line).alias("n_lines"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    nothing_else = (F.col("n_license_lines") > 0) & (F.col("n_told") == F.col("n_lines"))
    return by_doc.select("doc_id", "n_license_lines", "whole_license", "licenses", (F.col("whole_license").isNotNull() | nothing_else).alias("is_license"))
