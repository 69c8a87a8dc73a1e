from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts, or from (id, text) or (id, text, lang, source)."""

    def make(rows, more=()):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            text = row[1]
            full.append((row[0], text, row[2] if len(row) > 2 else "en", row[3] if len(row) > 3 else "s", None if text is None else len(text), *("x" for _ in more)))
        return spark.createDataFrame(full, DOCS + "".join(f", {m} string" for m in more))

    return make
