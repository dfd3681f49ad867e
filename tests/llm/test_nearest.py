import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessella.llm import nearest


def inner(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def test_bounds_hold():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 64)) * 10 ** r.uniform(-3, 3, (50, 1)), r.normal(size=(80, 64))
    (qi, qs, qn, qe), (ci, cs, _, ce) = nearest.quantised(x), nearest.quantised(y)
    about = qi.astype(float) @ ci.T.astype(float) * qs[:, None] * cs
    bound = qe[:, None] * np.linalg.norm(y, axis=1) + qn[:, None] * ce
    assert (np.abs(about - x @ y.T) <= bound * (1 + 1e-9)).all()


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(nearest, "ROWS", 30)
        monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
        monkeypatch.setattr(nearest, "FAN", 2)
    r = np.random.default_rng(4)
    same = r.normal(size=8)
    rows = [(i, (same if i % 3 == 0 else r.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(200)]
    rows += [(300, None, 1), (320, [], 1), (340, [0.0] * 8, 1), (360, [float("nan")] + [1.0] * 7, 1), (380, [None] + [1.0] * 7, 1), (400, [float("inf")] * 8, 1), (420, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (421, [3.0, 2.0], 1), rows[33]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = nearest.usable(df)
    got = [tuple(x) for x in nearest.search(v, v.filter("vec_id % 20 = 0"), 20).collect()]
    ok = [(i, np.array(x, np.float64)) for i, x, _ in rows if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    want = []
    for i, x in ok:
        if i % 20 == 0:
            scores = sorted((-inner(x.tolist(), y.tolist()), j) for j, y in ok if j != i and len(y) == len(x))[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_sql_agrees_and_empty(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = sorted(con.execute(nearest.OP9_SQL).fetchall())
    got = sorted(tuple(r) for r in nearest.op9_nearest_neighbours(spark, "/root/testdata/sf0.001").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want, strict=True)) < 1e-12
    print("equal scores:", sum(g[3] == w[3] for g, w in zip(got, want, strict=True)), "of", len(want))
    v = nearest.usable(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).limit(0)
    assert nearest.search(v, v).count() == 0


def test_vectors_of_every_finite_magnitude_take_part(spark):
    r = np.random.default_rng(7)
    rows = [(0, [1e200, 2.0]), (1, [1e-323, 1e-323]), (2, [3.0, 4.0]), (3, [-1e300, 1e-300]), (4, [1e300, 1e300]), (20, [1e-320, -2e-320]), (40, [1.7e308, -1.7e308]), (60, [1e-200, 1e-200])]
    rows += [(100 + i, (r.normal(size=2) * 10.0 ** r.uniform(-320, 300)).tolist()) for i in range(120)]
    rows = [(i, v) for i, v in rows if any(v)]
    v = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in nearest.search(v, v.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    big = [(i, [Fraction(x) for x in y]) for i, y in rows]
    for i, q in big:
        if i % 20:
            continue
        want = []
        for j, c in big:
            if j != i:
                whole = inner([float(x) for x in q], [float(x) for x in c])
                if not math.isfinite(whole):
                    exact = sum(a * b for a, b in zip(q, c, strict=True))
                    whole = math.inf if exact >= 2**1024 else -math.inf if exact <= -(2**1024) else float(exact)
                want.append((-whole, j))
        found = sorted(got[i])
        assert [(n + 1, j) for n, (_, j) in enumerate(sorted(want)[:20])] == [x[:2] for x in found]
        assert [x[2] for x in found] == pytest.approx([-s for s, _ in sorted(want)[:20]], rel=1e-12)
