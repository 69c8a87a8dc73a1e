from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.llm import license_scan as L


def test_anchors(spark):
    """Every known text has an anchor, before and after it is put into canonical form."""
    rows = spark.createDataFrame(list(L.KNOWN), "license string, t string").select(L.anchored(F.col("t")).alias("a"), L.anchored(L.canonical(F.col("t"))).alias("b")).collect()
    assert all(r.a and r.b for r in rows)


MIT = next(t for n, t in L.KNOWN if n == "MIT" and len(t) > 500)


def test_variants(docs):
    rows = [
        "Released under the MIT Licence!",
        MIT.upper().replace("SUBLICENSE", "sub-licence"),
        "Copyright (c) 2020 Somebody\n\n" + MIT.replace(". ", ".\n"),
        "Some text.\nLicensed under the Apache Licence, Version 2.0\nMore text.",
        "(c) 2020 X\nlicensed under CC BY-NC 4.0\n\n",
        "Released under the MIT License, mostly.",
        "",
        None,
        "x" * 100_000,
        "This work is licensed under the GNU General Public License, v3.\nReleased under the MIT License.",
    ]
    got = [(r.n_license_lines, r.whole_license, r.licenses, r.is_license) for r in L.license_scan(docs(rows, more=("license", "digest"))).orderBy("doc_id").collect()]
    assert got == [
        (1, "MIT", "MIT", True), (1, "MIT", "MIT", True), (0, "MIT", "MIT", True), (1, None, "Apache-2.0", False), (1, "CC-BY-NC-4.0", "CC-BY-NC-4.0", True), (0, None, "", False), (0, None, "", False),
        (0, None, "", False), (0, None, "", False), (2, None, "GPL-3.0,MIT", True),
    ]


def test_edges(docs):
    assert L.license_scan(docs([])).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Licensed under CC BY 4.0."), (None, "Released under the MIT License.")]
    got = {r.doc_id: (r.n_license_lines, r.whole_license, r.licenses) for r in L.license_scan(docs(rows)).collect()}
    assert got == {1: (2, "CC-BY-4.0", "CC-BY-4.0,MIT"), None: (1, "MIT", "MIT")}


def test_whole_license_files(docs):
    """Files as they are, with titles, wrapped, and SPDX lines of all forms."""
    import textwrap
    from pathlib import Path

    rows = [(p.stem, p.read_text()) for p in sorted((Path(L.__file__).parent / "licenses").glob("*.txt"))]
    isc = next(t for n, t in L.KNOWN if n == "ISC" and len(t) > 500)
    isc_file = "ISC License\n\nCopyright (c) 2020, X\n\n" + isc.replace("the above copyright", "the above\ncopyright")
    bsd = next(t for n, t in L.KNOWN if n == "BSD-3-Clause" and len(t) > 500)
    rows += [("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + textwrap.fill(MIT, 79)), ("ISC", isc_file), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd.replace(". ", ".\n"))]
    rows += [(name, f"// SPDX-License-Identifier: {form}") for name, form in (("GPL-2.0", "GPL-2.0-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("ISC", "ISC"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"))]
    got = [(r.whole_license, r.is_license) for r in L.license_scan(docs([t for _, t in rows])).orderBy("doc_id").collect()]
    assert got == [(name, True) for name, _ in rows] and len(rows) == 17


ISC_FILE = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")
Copyright (c) 1995-2003 by Internet Software Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_a_cut_off_text_is_no_license(docs):
    """The official layout is known; what opens like it and ends before its terms do is not, whatever line follows."""
    cut = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"
    rows = [ISC_FILE, cut, f"{cut}\nCopyright law is another matter.", f"{cut}\ncopyright notice", f"{cut}\nCopyright (c) 2020 X", ISC_FILE.replace("in all copies", "in some copies")]
    got = [(r.whole_license, r.is_license) for r in L.license_scan(docs(rows)).orderBy("doc_id").collect()]
    assert got == [("ISC", True)] + [(None, False)] * 5


def test_every_wrap(docs):
    """Whole texts wrapped at any width, so that lines begin with any word, below copyright lines of several forms."""
    import textwrap

    known = {n: next(t for m, t in L.KNOWN if m == n and len(t) > 500) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    forms = ("Copyright (c) 2020 X", "Copyright 2020 Some Body <a@b.c>", "Copyright The Y Authors", "(c) 2021, 2022 Z\nAll rights reserved.", "Copyright [yyyy] [name]", "© 1999 Q", "Copyright X, 2001-2002")
    rows = [(name, f"{forms[(width + k) % len(forms)]}\n\n{textwrap.fill(text, width)}\n") for k, (name, text) in enumerate(known.items()) for width in range(60, 101)]
    got = [r.whole_license for r in L.license_scan(docs([t for _, t in rows])).orderBy("doc_id").collect()]
    assert got == [name for name, _ in rows]


def test_no_known_text_is_empty(spark):
    assert spark.createDataFrame(list(L.KNOWN), "license string, t string").where(L.canonical(F.col("t")) == "").count() == 0
