import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tessella.llm import _text as X
from tessella.llm import pieces

PATH = pieces.model_path()


def encode(texts, dropout=0.0, seed=1, docs=None):
    data, off = X.utf8(pa.array(texts))
    drawn = X.mix(np.array(docs if docs is not None else range(len(texts)), np.uint64))
    ids, count = pieces.load(PATH).encode(data, off, drawn, dropout, seed)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def slow(model, segment, salt, limit):
    """The agenda by its definition: again and again the best candidate of all neighbours."""
    symbol, place = list(segment), list(range(len(segment)))
    while len(symbol) > 1:
        n = len(symbol) - 1
        made, best = model.candidates(np.array(symbol[:-1], np.int32), np.array(symbol[1:], np.int32), np.array(place[:-1]), np.full(n, salt, np.uint64), limit)
        i = int(best.argmin())
        if made[i] < 0:
            break
        symbol[i : i + 2] = [int(made[i])]
        del place[i + 1]
    return symbol


TEXTS = ["", "a", " ", "  Hello  world\n\tx", "élan über señor 漢字 €😀", "x" * 700, "the quick brown fox " * 40, "\n\n  \n", "aa" + " " * 37 + "b", "worthless|idiot;clown_" * 30]


def test_without_dropout_it_is_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = TEXTS + [t or "" for _, t in texts]
    assert encode(own) == [sp.encode(t) for t in own]


@pytest.mark.parametrize("long", [4, 10_000])
def test_dropout_follows_the_agenda(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    model, r = pieces.load(PATH), random.Random(2)
    words = ["".join(r.choice("thenationrs") for _ in range(r.randint(1, 14))) for _ in range(150)]
    symbol = [model.char[[ord(c) for c in w]] for w in words]
    salt = X.mix(np.arange(len(words), dtype=np.uint64))
    size = np.array([len(s) for s in symbol])
    for dropout in (0.0, 0.3, 0.8):
        got, count = model.cut(np.concatenate(symbol), size, salt, dropout)
        limit = X.U64(int(dropout * 2**64))
        assert [x.tolist() for x in np.split(got, np.cumsum(count)[:-1])] == [slow(model, s, h, limit) for s, h in zip(symbol, salt, strict=True)]


def test_dropout_varies_and_is_lossless(texts):
    own = TEXTS + ["▁ literal ▁▁", "\u0000﻿"] + [t or "" for _, t in texts]
    model = pieces.load(PATH)
    a, b, c = encode(own, 0.3, 1), encode(own, 0.3, 1), encode(own, 0.3, 2)
    assert a == b and a != c
    for x in (a, c, encode(own, 0.99, 5)):
        assert [model.decode(ids).decode() for ids in x] == own
    assert encode(["the nation " * 50] * 2, 0.3)[0] != encode(["the nation " * 50] * 2, 0.3)[1]


def test_tables(odd_docs):
    found = pieces.encode(odd_docs)
    assert found.columns == [c for c in odd_docs.columns if c != "text"] + ["ids"]
    back = {(r.doc_id, r.text) for r in pieces.decode(found).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    got = pieces.digests(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.lossless for r in got)
    assert pieces.encode(odd_docs.limit(0)).count() == 0


def test_every_segment_draws_its_own_skips():
    model, docs, seed = pieces.load(PATH), 300, 7
    got = encode(["international international"] * docs, 0.1, seed)
    symbol = model.char[[ord(c) for c in " international"]]
    with np.errstate(over="ignore"):
        base = X.mix(X.mix(np.arange(docs, dtype=np.uint64)) + X.U64(seed) * X.STEP)
        cuts = [[slow(model, symbol, s, X.U64(int(0.1 * 2**64))) for s in X.mix(base + X.U64(k))] for k in range(2)]
    assert got == [a + b for a, b in zip(*cuts, strict=True)]
    assert len({tuple(x) for x in cuts[0] + cuts[1]}) > 4
