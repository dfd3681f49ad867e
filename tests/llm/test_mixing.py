import hashlib
import math
from collections import Counter

import duckdb
import pytest

from tessella.llm import mixing


def draw(label, *parts):
    return int(hashlib.md5(":".join([label, *["" if p is None else str(p) for p in parts]]).encode()).hexdigest()[:13], 16)


def brute(rows, shares, seed=17):
    """rows: (doc_id, text, source); shares: by source."""
    size = Counter()
    for _, t, s in rows:
        size[s] += max(len(t or ""), 1)
    all_shares = sum(shares[s] for s in size)
    out = []
    for i, _, s in rows:
        rate, u = sum(size.values()) * shares[s] / all_shares / size[s], (draw(f"n{seed}", i) + 0.5) / 2**52
        k, c = 0, math.exp(-rate)
        while rate and c < u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out += [(i, j, k, draw(f"k{seed}", i, j)) for j in range(1, k + 1)]
    return sorted(out)


@pytest.mark.parametrize("salted", [False, True])
def test_copies_match_brute_force(odd_docs, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    size = Counter()
    for _, t, s in rows:
        size[s] += max(len(t or ""), 1)
    got = mixing.mix(odd_docs)
    assert got.columns == [*odd_docs.columns, "copy", "n_copies", "mix_key"]
    assert sorted((r.doc_id, r.copy, r.n_copies, r.mix_key) for r in got.collect()) == brute(rows, {s: n**0.5 for s, n in size.items()})


def test_null_source_and_weights(spark):
    rows = [(i, "x" * (i % 7), None if i % 3 == 0 else f"s{i % 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = {None: 3.0, "s0": 1.0, "s1": 0.0}
    got = mixing.mix(df, weights=shares)
    assert sorted((r.doc_id, r.copy, r.n_copies, r.mix_key) for r in got.collect()) == brute(rows, shares)
    assert got.filter("source = 's1'").count() == 0
    assert got.filter("source is null").count() > 100


def test_shares_come_close_to_their_targets(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('x', 100) as text", "if(id % 10 < 8, 'a', 'b') as source")
    got = {r.source: r.n for r in mixing.mix(df, weights={"a": 0.5, "b": 0.5}).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(got["a"] - 3000) < 200 and abs(got["b"] - 3000) < 200


def test_empty_table(odd_docs):
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(mixing.OP2_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.op2_mixing_sources(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(i, "x", "s", 5, 6.0) for i in range(20)], "doc_id long, text string, source string, copy int, Mix_Key double")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "copy", "Mix_Key", "copy_", "n_copies", "mix_key_"]
    assert {r["copy"] for r in got.collect()} == {5}


def test_high_rates(spark):
    """A tiny source beside a large one, up to thousands of copies a document."""
    rows = [(i, "x" * 3000, "big") for i in range(300)] + [(1000 + i, "y", "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = {"big": 0.9, "tiny": 0.1}
    got = mixing.mix(df, weights=shares).filter("source = 'tiny' and copy = 1").collect()
    want = {i: k for i, j, k, _ in brute(rows, shares) if i >= 1000}
    assert {r.doc_id: r.n_copies for r in got} == want and min(want.values()) > 1000
