"""The text operators against brute force and on the edge cases their docstrings define."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lotscope.llm import (
    chat, decontaminate, language_model, line_dedup, mixing, pii, quality, queries, simhash, token_count, winnowing,
)

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "a b c"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "word " * 5000), (5, "\U0001F600\u00e9 \u00df")]


def words(seed, n, size=40):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(size)]) for _ in range(n))


# --- 1: fingerprints -----------------------------------------------------------------------


def winnowed(text):
    if not text:
        return []
    code = text.encode("utf-32-be")
    h = [xxhash.xxh64_intdigest(code[4 * i : 4 * (i + winnowing.K)], 42) for i in range(max(1, len(text) - winnowing.K + 1))]
    chosen = set()
    for i in range(max(1, len(h) - winnowing.W + 1)):
        window = range(i, min(i + winnowing.W, len(h)))
        chosen.add(min(window, key=lambda j: (h[j] >> 32 & 0x7FFFFFFF, -j)))
    return [(p, h[p]) for p in sorted(chosen)]


def test_fingerprints_equal_brute_force_also_for_edited_texts(make, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 8)
    rng = random.Random(1)
    lengths = [0, 1, 2, 15, 16, 17, 46, 47, 48, 93, 94, 95, 130, 300] * 4
    rows = [(i * 7 - 50, "".join(rng.choice("ab \u00e9\U0001F600") for _ in range(n))) for i, n in enumerate(lengths)]
    rows += [(9000, "a" * 300), (9001, "a" * 300), (9005, None), (None, "ab" * 80)]
    got = {r.doc_id: r for r in winnowing.op1_winnowing(make(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    shown = lambda f: "".join(f"{h >> 32:08X}" for _, h in f)
    for at, (doc, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, of_next = winnowed(text), winnowed(edited), winnowed(following)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[doc].fingerprint, got[doc].edited_fingerprint) == (shown(own), shown(other))
        a, b = {h for _, h in own}, {h for _, h in of_next}
        assert got[doc].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert got[doc].n_chars == len(text)


def test_fingerprints_of_odd_tables(make):
    assert winnowing.op1_winnowing(make([(7, "alone " * 20)])).first().near_next == 1
    assert winnowing.op1_winnowing(make([(1, "x")]).filter("false")).collect() == []
    assert winnowing.op1_winnowing(make(ODD)).count() == len(ODD)


# --- 2: quality ----------------------------------------------------------------------------


def test_quality_separates_held_out_rows(spark, make):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        text = words(i, rng.randint(5, 200))
        rows.append((i, text if good else "".join(w.upper() + rng.choice(["!!", "$$$ ", "### "]) for w in text.split())))
        labels.append((i, int(good), 0))
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.op2_quality_rff(make(rows), frame).collect()
    assert len(got) == 400 and all(0 < r.score < 1 for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_quality_of_odd_tables(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.op2_quality_rff(make(ODD), none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.op2_quality_rff(make(ODD), one).count() == len(ODD)
    assert quality.op2_quality_rff(make(ODD).filter("false"), one).count() == 0


def test_isotonic_is_the_best_rising_fit():
    centre, value = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([3.0, 1, 2, 9]), np.array([10.0, 10, 10, 10]))
    assert len(centre) == 2 and value[0] == pytest.approx(6.5 / 31) and value[1] == pytest.approx(9.5 / 11)


# --- 3: chat -------------------------------------------------------------------------------


def digests(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back_what_was_formatted(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 7)
    rows = [
        (1, 0, "user", "a\\ <turn> \\</turn> <text>"), (1, 1, "assistant", "\\\\<turn>\\"), (1, 2, "assistant", None),
        (2, 0, None, "</turn"), (2, 1, "assistant", "\u00e9\U0001F600\n" * 50), (3, 0, "as</turn>sistant", ""),
        (None, 0, "assistant", "x"), (4, None, "user", "first"), (4, 0, "user", "then"),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    got = {r.conv_id: r for r in chat.op3_chat_tokens(turns, path, queries.BYTE_PATTERN).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None, -7}
    for conv in set(got) - {-7}:
        of = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(of)
    planted = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    assert got[-7].turns_sha256 == digests(planted)[1]
    assert chat.op3_chat_tokens(turns.filter("false"), path, queries.BYTE_PATTERN).count() == 1


def test_masks_cover_the_answer_and_its_end():
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = chat.Codec(f.read(), queries.BYTE_PATTERN)
    ids, mask = codec.turn_ids("assistant", "hello <turn> there")
    assert ids[0] == codec.turn and ids[-1] == codec.end and ids.count(codec.turn) == 1
    learnt = [i for i, m in zip(ids, mask, strict=True) if m]
    assert codec.decode(learnt[:-1]) == b"hello \\<turn> there" and learnt[-1] == codec.end
    assert not any(codec.turn_ids("user", "hello")[1])


# --- 4: lines ------------------------------------------------------------------------------


def cut_by_hand(rows, least):
    """Every shortest run from and to each line, in order; all but the first of each is cut."""
    seen, gone = {}, {}
    runs = []
    for doc, text in rows:
        own = [(i, x, len(BLANKS.findall(x))) for i, x in enumerate((text or "").split("\n"))]
        own = [x for x in own if x[2]]
        found = set()
        for i in range(len(own)):
            for order in (range(i, len(own)), range(i, -1, -1)):
                n = 0
                for j in order:
                    n += own[j][2]
                    if n >= least:
                        found.add((min(i, j), max(i, j)))
                        break
        runs += [(doc, own[a][0], own[b][0], tuple(x for _, x, _ in own[a : b + 1])) for a, b in found]
    for doc, a, b, content in sorted(runs, key=lambda r: r[:3]):
        first = seen.setdefault(content, (doc, a, b))
        if first != (doc, a, b):
            start = max(a, first[2] + 1) if first[0] == doc else a
            gone.setdefault(doc, set()).update(range(start, b + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows if t is not None}


def test_repeated_runs_go_and_first_ones_stay(make):
    rng = random.Random(5)
    lines = [words(i, rng.randint(1, 9)) for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, "\n".join(lines)), (101, "\n".join(lines)), (102, "\n".join([lines[0]] * 30)), (103, None), (104, "")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(make(rows), 12).collect()}
    want = cut_by_hand(rows, 12)
    assert got == want | {103: None}
    assert any(want[d] != t for d, t in rows if t)


def test_lines_of_odd_tables(make):
    passage = words(1, 60)
    rows = [(None, passage), (1, passage), (1, passage), (2, f"own\n{passage}\nend")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.op4_line_winnowing(make(rows)).collect())
    assert got == [(0, passage), (1, ""), (1, ""), (2, "own\nend")]
    assert line_dedup.op4_line_winnowing(make(ODD)).count() == len(ODD)
    assert line_dedup.op4_line_winnowing(make(ODD).filter("false")).count() == 0


# --- 5: decontamination --------------------------------------------------------------------


def hit_by_hand(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, named = split(text), set(), set()
    for item, t in items:
        of = split(t)
        size = min(10, len(of))
        for i in range(len(of) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == of[i : i + size]:
                    hit.update(range(at, at + size))
                    named.add(item)
    return len(own), len(hit), ",".join(sorted(map(str, named - {None})))


@pytest.mark.parametrize("part_bytes", [1 << 20, 64])
def test_search_equals_brute_force(spark, make, part_bytes):
    items = [(i, words(i, n, 6)) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 30])] + [(8, None), (9, "  "), (None, words(3, 12, 6)), (10, words(7, 30, 6).upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, words(1000 + i, n, 6)) for i, n in enumerate([0, 1, 9, 10, 50, 200, 400])]
    rows += [(20, f"x {items[7][1]} y"), (21, items[6][1].replace(" ", ".\n")), (22, None)]
    found = decontaminate.found_in(make(rows), bench, part_bytes).collect()
    for r in found:
        n, hit, names = hit_by_hand(dict(rows)[r.doc_id], items)
        assert (r.n_words, sum(e - s for s, e in zip(r.starts, r.ends, strict=True))) == (n, hit)
        assert ",".join(sorted(map(str, r["items"]))) == names
    assert len(found) == len(rows)


def test_decontamination_of_odd_tables(spark, make):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.op5_wu_manber(make(ODD), bench).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
    one = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.decontaminated(make(ODD), one).collect()} == {1, 2, 3, 4, 5}


# --- 6: near duplicates --------------------------------------------------------------------


def test_codewords_meet_one_bit_apart():
    v = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    home = simhash.codewords(v)[:, :1]
    for bit in range(23):
        assert (home == simhash.codewords(v ^ (1 << bit))).any(axis=1).all()


@pytest.mark.parametrize("compared", [64, 2])
def test_links_equal_brute_force(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(4)
    values = {0}
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    assert all(bin((e.a ^ e.b) & ((1 << 64) - 1)).count("1") <= 2 for e in found)

    def groups(pairs):
        root = {v: v for v in signed}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {v: top(v) for v in signed}

    near = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    assert groups(near) == groups((e.a, e.b) for e in found)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(near, "a bigint, b bigint")).collect()}
    assert {v: roots.get(v, v) for v in signed} == groups(near)


def test_near_duplicates_and_their_representatives(make):
    text = words(9, 4000, 300)
    near = text.replace("w7 ", "other ", 1)
    rows = [(5, text), (9, text), (7, near), (8, words(10, 300, 300)), *ODD]
    got = simhash.op6_simhash_golay(make(rows)).collect()
    of = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and of[9] == of[7] == of[5] == 5 and of[8] == 8 and of[1] == of[2] == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    kept = simhash.deduplicated(make(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted({c for c in of.values() if c})
    assert simhash.op6_simhash_golay(make(rows).filter("false")).count() == 0


# --- 7: language model ---------------------------------------------------------------------


def test_base_scores_are_exact_and_the_model_is_better(make, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_SHARE", 0.01)
    rng = random.Random(6)
    phrases = [words(i, 6, 500) for i in range(40)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(30))) for i in range(80)] + [(100, None), (101, ""), (102, "Never SEEN"), (103, "x"), (103, "x")]
    docs = make(rows)
    got = language_model.op7_bloom_lm(docs).collect()
    tokens = {i: [w.lower() for w in BLANKS.findall(t or "")] + [""] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(t for i, _ in rows if not out[i] for t in tokens[i])
    total, distinct = sum(c.values()), len(c)
    for r in got:
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens[r.doc_id])
        assert r.base_score == pytest.approx(base)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            out[r.doc_id], len(tokens[r.doc_id]), sum(c[t] > 0 for t in tokens[r.doc_id]), total
        )
    held = [r for r in got if r.held_out and r.doc_id < 100]
    assert len(got) == len(rows) and sum(r.score for r in held) > sum(r.base_score for r in held)
    # Rounds over parts of the filter give what one round gives.
    model = language_model.train(docs.filter(~language_model.held_out(F.col("doc_id"))), 500)
    once, parts = (
        {r.doc_id: r.score for r in language_model.scores(docs, model, n).collect()} for n in (1 << 20, 300)
    )
    assert len(language_model._rounds(model, 300)) > 2 and parts == pytest.approx(once)
    assert language_model.op7_bloom_lm(docs.filter("false")).count() == 0


def test_filter_never_reads_too_small_a_step():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 20000).astype(np.uint64))
    counts = rng.integers(1, 500, len(keys))
    held = language_model.Held(0, {0: len(b := language_model.built(keys, counts).tobytes())}, b)
    for shift, least in ((0, language_model.steps_of(counts)), (1, 0)):
        found = np.zeros(len(keys), np.int64)
        held.fill((keys + np.uint64(shift * 7919)) << np.uint64(16), found)
        assert (found >= least).all()
    assert (found > 0).mean() < 0.05


# --- 8: mixing -----------------------------------------------------------------------------


def test_targets_and_taken_words(make):
    rng = random.Random(8)
    rows = [(i, words(i, rng.randint(0, 50)), rng.choice(["a", "b", "\u00e9", None, "c"])) for i in range(900)]
    rows += [(i, "tiny", "z") for i in range(1000, 1003)] + [(2000, None, "b")]
    got = mixing.op8_hash_mixing(make(rows)).collect()
    sizes = {i: len(BLANKS.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s}) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    size = Counter()
    for i, _, s in rows:
        size[s] += sizes[i]
    open_, budget, target = set(sources), 1.5 * sum(size.values()), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken, largest = Counter(), max(sizes.values())
    of = {i: s for i, _, s in rows}
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[of[r.doc_id]], abs=1e-5) and r.source_size == size[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= largest for s in sources)
    assert sorted(got) == sorted(mixing.op8_hash_mixing(make(rows, 5)).collect())


def test_mixing_of_odd_tables(make):
    assert mixing.op8_hash_mixing(make(ODD)).count() == len(ODD)
    assert mixing.op8_hash_mixing(make(ODD).filter("false")).count() == 0
    assert {r.taken for r in mixing.op8_hash_mixing(make([(1, None), (2, "")])).collect()} == {0}


# --- 9: personal data ----------------------------------------------------------------------


def base_by_hand(text):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.passes_luhn(d):
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    pieces = ["a.b@c.d", "@", "x@y", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+49 (151) 23456789", "0", " ", "-", "+", "\u00e9", "00012.9.9.9"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.detect(text) == base_by_hand(text), text


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("write to john [at] mail (dot) com now", "email", "john [at] mail (dot) com"),
        ("reach bob at mail dot example dot com ok", "email", "bob at mail dot example dot com"),
        ("\u0430nna@m\u0430il.com", "email", "\u0430nna@m\u0430il.com"),
        ("plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
        ("four" + " one" * 15, "card", "four" + " one" * 15),
        ("ip \uff11\uff19\uff12.168.0.1 x", "ip", "\uff11\uff19\uff12.168.0.1"),
    ],
)
def test_disguises_are_found_at_their_source(text, kind, shown):
    base, every = pii.spans(text)
    assert base == [] and [(text[s:e], k) for s, e, k in every] == [(shown, kind)]


def test_plain_prose_stays_clean(make):
    for text in ("he was at home and one two three went", "1 2 3 4 5 6 7 8 9 1 2 3 4 5", "look at it. dot the i", "\u0430\u0435\u043e"):
        base, every = pii.spans(text)
        assert base == every
    got = pii.op9_pii_offsets(make([*ODD, (6, "a@b.c +1 234 567 8901")])).collect()
    assert len(got) == len(ODD) + 1
    one = next(r for r in got if r.doc_id == 6)
    assert (one.n_email, one.n_phone, one.spans) == (1, 1, "email:0:5,phone:6:21")
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "@" * 300_000, " " * 300_000 + "[", "+1" * 100_000, "1." * 100_000):
        pii.spans(text)


# --- 10: token counts ----------------------------------------------------------------------


def test_counts_equal_the_library(make):
    from sentencepiece import SentencePieceProcessor

    path = queries.vocabulary("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), token_count.PieceCounter(token_count.read_pieces(path))
    rng = random.Random(10)
    texts = ["", " ", "   ", "\u2581\u2581a", "<s> x</s> <unk>", "a" * 5000, "\u65e5\u672c\u8a9e \U0001F600", "\ta\n\n  b", *(t or "" for _, t in ODD)]
    texts += ["".join(rng.choice("ab  \n\u2581\u00e9\U0001F600\u2028\u00dftheing0<>x\u65e5") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert [own.count(t) for t in texts] == [len(x) for x in library.encode(texts)]
    got = token_count.op10_token_counts(make(ODD), path).collect()
    assert len(got) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert next(r for r in got if r.doc_id == 4).over_limit


# --- queries -------------------------------------------------------------------------------


def test_every_operator_has_a_query_and_a_clean_plan(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    for build in (winnowing.op1_winnowing, line_dedup.op4_line_winnowing):
        plan = build(docs)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    json.dumps(names)
