"""Filters in every order, and how sources differ, against the definitions in plain Python."""

import gc
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lotscope.llm import divergence, filter_audit

LABELS = "doc_id bigint, quality int, toxic int"


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('abcAz')}{rng.randrange(words)}" for _ in range(n))


def failing(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(c for c, bad in zip("ABCDE", (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), doc_id is not None and least is not None and doc_id > least,
    ), strict=True) if bad)


def by_hand(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source in rows:
        parts[source or ""].append((failing(text or "", i, least.get(text or "")), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                left = [d for d in docs if not set(order[: step - 1]) & set(d[0])]
                gone = [d for d in left if c in d[0]]
                shapley[c] += len(gone)
                out[part, order, step] = [
                    len(left) - len(gone), len(gone), sum(c in d[0] for d in docs) - len(gone), sum(d[0] == c for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("size", [filter_audit.SHARD_BYTES, 700])
def test_filters_in_every_order(spark, make, monkeypatch, size):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([10, 49, 50, 90]), rng.choice([15, 400])) + rng.choice(["", " #1", " LOUD LOUD LOUD"]), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[4][1], "s1") for i in range(9)] + [(3, rows[4][1], None), (3, rows[4][1], None), (None, rows[4][1], "s2")]
    rows += [(200, None, ""), (201, "", None), (None, None, "only"), (-5, " \n", "s0"), (202, "é" * 30000 + " Ü|" * 2000, "s0")]
    labels = [(i, i % 2, (i % 3 == 0) + 0) for i in range(30)] + [(4, None, 1), (None, 1, 1), (7, 1, None), (7, 1, 0), (999, 1, 1)]
    docs, marks = make(rows), spark.createDataFrame(labels, LABELS)
    got = filter_audit.op12_filter_audit(docs, marks).collect()
    order = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in order] for r in got} == by_hand(rows, labels)
    assert len(got) == 600 * 5


@pytest.mark.parametrize("clashing", [False, True])
def test_columns_of_all_shards_are_numbered_as_one(spark, make, monkeypatch, clashing):
    if clashing:
        monkeypatch.setattr(filter_audit, "_hashed", lambda word: F.crc32(word) % 2)
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 30)
    texts = ["a b a c", "c d", "", None, "b b b e a", "x " * 50]
    made = filter_audit.matrix(make(list(enumerate(texts)))).collect()
    assert len(made) > 2
    seen = {}
    for shard in made:
        for at, doc in enumerate(shard.docs):
            low, high = shard.starts[at : at + 2]
            seen[doc.doc_id] = {shard.terms[c]: n for c, n in zip(shard.columns[low:high], shard.counts[low:high], strict=True)}
    assert sorted(map(sorted, (x.values() for x in seen.values()))) == sorted(sorted(Counter((t or "").split()).values()) for t in texts)
    a, b, c, d = seen[0], seen[1], seen[4], seen[5]
    assert len(a.keys() & b.keys()) == 1 and len(a.keys() & c.keys()) == 2 and not d.keys() & (a.keys() | b.keys() | c.keys())


def test_no_documents_no_rows(spark, make):
    docs = make([(1, "x")]).limit(0)
    assert filter_audit.op12_filter_audit(docs, spark.createDataFrame([], LABELS)).collect() == []
    assert divergence.op13_source_divergence(docs).collect() == []


def distances(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    groups, frequency, own, whole = sorted({d[:2] for d in docs}), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        frequency[lang].update(set(words))
        own[lang, source].update(words)
        whole[lang].update(words)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in frequency[lang].items() if n >= 10)

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(own[lang, source]), share(whole[lang])
        found = {"pair": [], "term": [(-f(p[t], q[t]), t.encode(), t) for t in kept if own[lang, source][t] and p[t] > q[t]]}
        for other in (s for g, s in groups if g == lang and s != source):
            r = share(own[lang, other])
            found["pair"].append((-sum(f(p[t], r[t]) for t in kept), other.encode(), other))
        for part, items in found.items():
            ranked = list(enumerate(sorted(items), 1))
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in ranked[: 10 if part == "term" else None]]
    return sorted(out)


@pytest.mark.parametrize("block, terms, compared, looked_at", [(32, 4096, 1 << 20, 1 << 14), (2, 5, 40, 12)])
def test_distances_of_sources(spark, monkeypatch, block, terms, compared, looked_at):
    for name, value in {"BLOCK": block, "TERMS": terms, "COMPARED": compared, "LOOKED_AT": looked_at, "COUNTED": 50 * looked_at}.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(2)
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    rows = []
    for i in range(260):
        source = f"s{i % 7}"
        words = [letters(int(rng.paretovariate(0.7)) % 60 + 20 * (rng.random() < 0.3) * (i % 7)) for _ in range(rng.randrange(120))]
        rows.append((rng.choice(["en", "fr"]), source, rng.choice([" ", ", ", "1"]).join(words).title()))
    rows += [("en", "silent", None), ("en", None, ""), (None, None, "x " * 5), (None, "b", "é y"), ("xx", "alone", "word"), ("yy", "", "1 2"), ("yy", "z", None)]
    rows += [("en", "s1", "Éa ÉA éa " * 4000)] * 11
    docs = spark.createDataFrame([(i, t, lang, s, "clash", "clash") for i, (lang, s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string, n string").repartition(5)
    got = divergence.op13_source_divergence(docs).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == distances(rows)


def test_band_keeps_what_can_be_ranked():
    rng = random.Random(4)
    for _ in range(40):
        size = rng.randrange(1, 120)
        n, lang_n = (np.array([rng.randrange(12) for _ in range(size)]) for _ in range(2))
        names = rng.sample([f"t{i}" for i in range(500)], size)
        ahead = [sum((n[i] >= n[j]) and (lang_n[i] <= lang_n[j]) and (names[i] < names[j]) for i in range(size)) for j in range(size)]
        assert sorted(divergence.skyband(n, lang_n, names, 4)) == [j for j in range(size) if ahead[j] < 4 or size <= 4]


@pytest.mark.parametrize("slice_", [1, 2, 1000])
def test_counted_terms_across_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    rows = [("en", "a", "Cat cat dog"), ("en", "b", None), ("en", "a", "dog  1 Dog"), (None, None, "É é x"), ("fr", "a", "...")]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string").repartition(2)
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.counted(docs).collect()}
    assert got == {
        ("en", "a", None): (0, 0), ("en", "a", "cat"): (2, 1), ("en", "a", "dog"): (3, 2),
        ("en", "b", None): (0, 0), ("", "", None): (0, 0), ("", "", "É"): (1, 1), ("", "", "é"): (1, 1), ("", "", "x"): (1, 1),
        ("fr", "a", None): (0, 0),
    }


def test_a_shard_goes_with_its_last_use():
    gc.collect()
    gc.disable()
    try:
        shard = filter_audit.Shard()
        shard.add({"doc_id": 1}, b"a b a c")
        assert shard.row(7)[1] == [b"a", b"b", b"c"]
        del shard
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_few_shards_are_in_memory_at_once(spark, make, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 30)
    files, written = [], filter_audit.written

    def seen(df, *args, **options):
        made = written(df, *args, **options)
        files.extend(f.removeprefix("file://") for f in made.inputFiles())
        return made

    monkeypatch.setattr(filter_audit, "written", seen)
    filter_audit.matrix(make([(i, f"some words of text {i} " * 2) for i in range(100)], parts=1))
    rows = [m.row_group(i).num_rows for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert sum(rows) > 50 and max(rows) <= 16


def test_words_that_share_a_hash_are_found_without_a_sort(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in (b"a", b"b", b"a", b"c", b"c")], "word binary").repartition(3)
    assert filter_audit.clashes(words).collect() == []
    assert "SortAggregate" not in filter_audit.clashes(words)._jdf.queryExecution().toString()
    monkeypatch.setattr(filter_audit, "_hashed", lambda word: F.when(word == b"c", F.lit(3)).otherwise(F.lit(1)))
    assert [r.hash for r in filter_audit.clashes(words).collect()] == [1]
