"""Decontamination drops the rows with a hit, not others of their doc_id."""

from lotscope.llm import decontaminate


def test_a_hit_takes_only_its_own_row(spark, make, monkeypatch):
    bench = spark.createDataFrame([(1, "leaked words here"), (2, "another item")], "item_id bigint, text string")
    rows = [(None, "so leaked words here too"), (None, "clean"), (None, None), (7, "another item"), (7, "clean as well"), (8, "fine"), (9, "leaked words here"), (9, "leaked words here")]
    docs = make(rows)
    got = decontaminate.decontaminated(docs, bench)
    assert got.columns == docs.columns
    shown = lambda found: sorted((r.doc_id or 0, r.text or "") for r in found)
    assert shown(got.collect()) == [(0, ""), (0, "clean"), (7, "clean as well"), (8, "fine")]
    # Over several passes too.
    several = decontaminate.found_in(docs, bench, 8, content=True).filter("size(starts) = 0")
    assert sorted(r.doc_id or 0 for r in several.collect()) == [0, 0, 7, 8]
