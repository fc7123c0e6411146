import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash with
    names the operators use."""

    def docs(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        made = spark.createDataFrame(full, SCHEMA).repartition(parts)
        for name in ("hash", "size", "key", "fp", "line", "steps", "range", "x", "content", "removed"):
            made = made.selectExpr("*", f"'clash' AS {name}")
        return made

    return docs
