"""Texts that polynomial hashes modulo a power of two can't tell apart: a Thue-Morse text and its complement."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessella.llm import _spark as S
from tessella.llm import _text as X
from tessella.llm import byte_ids, ngram_join, pieces, quality, substring, suffix_dedup

PATH = public_tokenizers.path(byte_ids.FILE)


def pair(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module", params=[9, 10, 11, 12])
def both(request):
    return pair(request.param)


def test_words_and_lines(both):
    words = X.Words(*X.utf8(pa.array([" ".join(both)])))
    assert len(set(words.hashes().tolist())) == len(set(words.ids().tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(9))
    m = dict(zip(quality.MEASURES, quality._measure(*X.utf8(pa.array([f"{both[0]} {rest}\n{both[1]} {rest}"]))), strict=True))
    assert m["n_dup_lines"].tolist() == [0] and m["n_repeat_words"].tolist() == [18]


def test_pieces(both):
    model = pieces.load(pieces.model_path())
    data, off = X.utf8(pa.array([*both, *both]))
    for dropout in (0.0, 0.1):
        ids, count = model.encode(data, off, X.mix(np.arange(4, dtype=np.uint64)), dropout, 3)
        assert [model.decode(x.tolist()).decode() for x in np.split(ids, np.cumsum(count)[:-1])] == [*both, *both]


def test_ids(both):
    encoder = byte_ids.Encoder(PATH)
    want = [e.ids for e in encoder.library.encode_batch(list(both), add_special_tokens=False)]
    for texts in ([both[0]], [both[1]], list(both)):
        ids, count = encoder.encode(*X.utf8(pa.array(texts)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [want[both.index(t)] for t in texts]


def test_equal_hashes_do_not_make_equal_texts(monkeypatch):
    """All hashes collide; results of what compares bytes stay right."""
    texts = ["one two two three one two", "x\ny z\nx\ny  z", "the the then"]
    model, encoder = pieces.load(pieces.model_path()), byte_ids.Encoder(PATH)
    data, off = X.utf8(pa.array(texts * 3))
    want = [quality._measure(data, off), encoder.encode(data, off), model.encode(data, off, np.arange(9, dtype=np.uint64), 0.3, 1)]
    monkeypatch.setattr(X, "run_hashes", lambda eight, start, length, kind=0: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(X, "windows", lambda h, first, k, f=X.windows: (np.zeros(len(f(h, first, k)[1]), np.uint64), f(h, first, k)[1]))
    encoder._forget()
    got = [quality._measure(data, off), encoder.encode(data, off), model.encode(data, off, np.arange(9, dtype=np.uint64), 0.3, 1)]
    for a, b in zip(want, got, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_joins(spark):
    t, u = pair(11)
    rest = " ".join(f"w{i}" for i in range(30))
    rows = [(0, f"{t} {rest}"), (1, " ".join([u, *[f"v{i}" for i in range(12)]])), (2, " ".join([t, *[f"v{i}" for i in range(12)]])), (3, t), (4, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.groups(df, 4, 85).collect()} == {i: i for i in range(5)}
    assert {r.row.doc_id: r.n_removed for r in substring.removed(df).collect()} == {i: 0 for i in range(5)}
    found = {r.row.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.removed(df, 1025).collect()}
    assert found[3][0] == len(t) and found[4][0] == len(u)
    assert {r.doc_id: r.component_id for r in ngram_join.groups(spark.createDataFrame([(1, f"{t} x"), (2, f"{u} x"), (3, f"{t} x")], "doc_id long, text string"), 4, 85).collect()} == {1: 1, 2: 2, 3: 1}


def test_hot_keys_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3 if i % 2 else 5) for i in range(3000)], "i long, k long")
    counts = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "10 * k as v")
    want = {(r.i, None if r.k is None else 10 * r.k) for r in rows.collect()}
    for keys in (2, 10**6):
        monkeypatch.setattr(S, "HOT_KEYS", keys)
        assert {(r.i, r.v) for r in S.looked_up(rows, counts, "k", "n").collect()} == want
        assert {(r.i, r.v) for r in S.looked_up(rows, counts, "k", "n", inner=True).collect()} == {x for x in want if x[1] is not None}


def test_signatures_that_clash_are_told_apart():
    doc, key = np.array([0, 0, 1, 2, 2]), np.array([1, 2, 3, 1, 2], np.uint64)
    size, sig, check = ngram_join._signatures(doc, key, 3)
    assert size.tolist() == [2, 1, 2] and sig[0] == sig[2] != sig[1] and check[0] == check[2] != check[1]
    _, now, _ = ngram_join._signatures(doc, key, 3, sig[1:2])
    assert now.tolist() == [sig[0], sig[1] ^ check[1], sig[2]]
