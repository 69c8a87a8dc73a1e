"""Each query with SQL, against DuckDB over the same tables."""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib

import pytest
from data_dir import SF

import __spark_entry__
from leafmill.plans import queries

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(autouse=True, scope="module")
def compiled(spark):
    """Registered queries run as in production, with compiled plans."""
    own = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert ours == theirs


def test_checksums(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.seq: r.crc for r in QUERIES["crc32_entries"](spark, SF).collect()} == {i: zlib.crc32(t) for i, t in docs.items()}


def stored_zip(entries):
    """The bytes of a stored archive as the standard library writes it, but for the time and system of each entry."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, data in entries:
            z.writestr(zipfile.ZipInfo(path), data)
    return out.getvalue()


def test_archives(spark):
    """Each page's archive holds the page's Markdown, and is as long as one that the standard library writes."""
    texts = {r.page_id: r.markdown for r in QUERIES["page_markdown"](spark, SF).collect()}
    got = {r.page_id: (r.n_entries, r.n_bytes) for r in QUERIES["zip_archives"](spark, SF).collect()}
    assert set(got) == set(texts) and {n for n, _ in got.values()} == {1}
    entries = queries._page_entries(spark, SF).collect()
    assert {r.archive_id: r.data for r in entries} == texts
    assert {r.archive_id: len(stored_zip([(r.path, r.data)])) for r in entries} == {i: n for i, (_, n) in got.items()}


def test_exports(spark):
    """The archives of documents with media against their entries, which media_localized's SQL holds."""
    found = {}
    for r in QUERIES["media_localized"](spark, SF).where("ok").collect():
        found[r.page_id] = found.get(r.page_id, 0) + 1
    got = {r.page_id: r.n_entries for r in QUERIES["export_archives"](spark, SF).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert got == {i: 1 + found.get(i, 0) for i in ids}


def squeezed(text):
    return " ".join(text.split())


def rounds(spark):
    """Each conversation's turns as lists of pieces, in order."""
    out = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, {}).setdefault(r.turn, []).extend(re.split(r"\n|(?<=\.) ", r.text or ""))
    return {c: list(t.values()) for c, t in out.items()}


def answers(spark, name):
    out = {}
    for r in QUERIES[name](spark, SF).orderBy("conv_id", "pos").collect():
        out.setdefault(r.conv_id, []).append(r.text)
    return out


def test_fragment_merge(spark):
    """Turns one after another: each text once, neighbours that overlap by twelve characters joined."""
    want = {}
    for conv, turns in rounds(spark).items():
        out, seen = [], set()
        for text in (t for turn in turns for t in turn):
            if squeezed(text) in seen:
                continue
            seen.add(squeezed(text))
            a, b = squeezed(out[-1]) if out else "", squeezed(text)
            size = next((n for n in range(min(len(a), len(b)), 11, -1) if a.endswith(b[:n])), 0)
            if size:
                out[-1] = a + b[size:]
                seen.add(out[-1])
            else:
                out.append(text)
        want[conv] = out
    assert answers(spark, "fragment_merge") == want


def test_ordered_snapshot_merge(spark):
    from test_operators import plain_ordered

    want = {}
    for conv, turns in rounds(spark).items():
        first = {}
        known = []
        for turn in turns:
            for t in turn:
                first.setdefault(squeezed(t), t)
            as_blocks = lambda texts: [{"type": "paragraph", "text": squeezed(t)} for t in texts]
            known = plain_ordered(as_blocks(known), as_blocks(turn))
        want[conv] = [first[t] for t in known]
    assert answers(spark, "ordered_snapshot_merge") == want


def test_collector_reads_folders(spark, tmp_path):
    """A table that is a folder of part files gives the same as one file."""
    (tmp_path / "sf").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "sf/events.parquet"))
    columns = ("page_id", "rounds", "n_blocks", "idle", "status")
    one, many = (sorted(map(tuple, QUERIES["collector_stream"](spark, at).select(*columns).collect())) for at in (SF, str(tmp_path / "sf")))
    assert len(one) and [r[0] for r in one] == [r[0] for r in many]


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "pos", "type", "level", "text"]


def test_entry_without_the_optional_folder():
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('leafmill.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'page_blocks' in e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    from data_dir import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
