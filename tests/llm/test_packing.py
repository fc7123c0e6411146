"""Packing: the ids are the tokenizer's, every id lies in one piece, the cuts cost the least."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lotscope.llm import packing, queries

PATH = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(3)
    odd = [*"abcDE'stS rvldm \n\t.,!?»…é́ÅẞİΣΑσ中文  \u001c\u0085‍😀12½<|>क़", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL", "..."]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += [" ".join(rng.choice(odd) * 3 for _ in range(900)), "", " "]
    encoder = packing.Encoder(tokenizer.to_str())
    made = [ids.tolist() for k in range(0, len(texts), 50) for ids, _ in encoder.encode([t.encode() for t in texts[k : k + 50]])]
    assert made == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sentences_end_after_their_marks(tokenizer):
    encoder = packing.Encoder(tokenizer.to_str())
    (ids, ends), = encoder.encode([b'One two. Three 3.5 four!) five "six?" seven'])
    words = [tokenizer.id_to_token(i) for i in ids]
    assert [words[e - 1].removesuffix("</w>")[0] for e in ends] == [".", "!", "?"]


def cost_of(at, cost, cuts, context):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        size = b - a
        total += packing.WINDOW + (0 if size & (size - 1) == 0 else context - size) + cost[at.index(b)]
    return total


def test_cuts_cost_the_least():
    rng = random.Random(5)
    for _ in range(150):
        context = rng.choice([8, 16, 32])
        at = [0]
        while len(at) < rng.randrange(2, 60):
            at.append(at[-1] + rng.randint(1, rng.choice([2, context])))
        cost = [rng.choice([0, 2, 9]) for _ in at]
        least = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            least[j] = min(least[i] + cost_of(at, cost, [at[i], at[j]], context) for i in range(j) if at[j] - at[i] <= context)
        cuts = packing.best_cuts(np.array(at), np.array(cost), context).tolist()
        assert cuts[0] == 0 and cuts[-1] == at[-1] and max(np.diff(cuts), default=0) <= context
        assert cost_of(at, cost, cuts, context) == least[-1]


@pytest.mark.parametrize("line", [packing.LINE, packing.CONTEXT * 2])
def test_every_id_lies_in_one_piece(spark, make, tokenizer, monkeypatch, line):
    monkeypatch.setattr(packing, "LINE", line)
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "sat.", "Under", "mats,", "again!"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(400))) for i in range(60)] + [(5, None), (6, ""), (None, None), (None, prose(30)), (7, " \n ")]
    rows += [(100, prose(20000)), (101, "word " * 9000), (102, rows[3][1]), (102, rows[3][1]), (103, "<|endoftext|> x")]
    got = packing.packed(make(rows), PATH).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for doc_id, wholes in want.items():
        assert sum(n for _, n, _, _ in pieces[doc_id]) == sum(len(w) // 4 for w in wholes)
        if len(wholes) == 1:
            assert b"".join(p[2] for p in sorted(pieces[doc_id])) == wholes[0]
            assert {p[3] for p in pieces[doc_id]} == {len(wholes[0]) // 4}
    padded = total = 0
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= packing.CONTEXT
        total += at
        padded += 0 if at & (at - 1) == 0 else packing.CONTEXT - at
    assert padded < (0.08 if line == packing.LINE else 0.2) * total


def test_query_gives_digests_of_the_pieces(spark, make):
    docs = make([(1, "Some words here."), (2, None)])
    ids = {(r.doc_id, r.start): r.ids for r in packing.packed(docs, PATH).collect()}
    got = packing.op11_packing(docs, PATH).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got} == {k: zlib.crc32(v) for k, v in ids.items()}
    assert packing.op11_packing(docs.limit(0), PATH).collect() == []
