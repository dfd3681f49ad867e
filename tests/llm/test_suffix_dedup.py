import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import _suffix, suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[j : j + length] for _, t in texts for j in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def found(df, *a):
    return sorted(tuple(r) for r in suffix_dedup.removed(df, *a).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect())


@pytest.mark.parametrize(("length", "seed"), [(200, 32), (40, 8)])
def test_matches_brute_force(odd_docs, texts, length, seed):
    assert found(odd_docs, length, seed) == brute(texts, length)


def test_edges_of_shared_passages(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(420)
    rows = []
    for i in range(60):
        a = r.randint(0, 210)
        b = r.randint(a + 150, 420)
        rows.append((i, noise(r.randint(0, 300)) + passage[a:b] + noise(r.randint(0, 300)) + (passage[:230] if i % 5 == 0 else "")))
    rows.append((99, "ab" * 500))
    rows.append((98, "z" * 199))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows, 200)
    assert found(df, 60, 16) == brute(rows, 60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=60)), min_size=1, max_size=25))
def test_deep_shallow_sort(items):
    items = [(g, ("a" * 25 if i % 2 else "") + s) for i, (g, s) in enumerate(items)]
    text = np.frombuffer("".join(s for _, s in items).encode() + b"x", np.uint8)
    size = np.array([len(s) for _, s in items])
    order, lcp = _suffix.sort(text, np.cumsum(size) - size, size, np.array([g for g, _ in items]))
    got = [items[i] for i in order]
    assert got == sorted(items)
    for j in range(1, len(got)):
        if got[j][0] != got[j - 1][0]:
            assert lcp[j] == -1
        else:
            n = 0
            while n < min(len(got[j][1]), len(got[j - 1][1])) and got[j][1][n] == got[j - 1][1][n]:
                n += 1
            assert lcp[j] == n


def test_empty_table(odd_docs):
    assert suffix_dedup.removed(odd_docs.limit(0)).count() == 0


def test_anchors_are_dealt_evenly():
    """Anchors are least hashes, and must not all lie in the first ranges of buckets."""
    import pyarrow as pa

    from tessella.llm import _seeds, _spark

    r = np.random.default_rng(0)
    text = r.integers(97, 123, 400_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([5])], names=["doc_id", "text", "key"])
    for units, k, w in ((suffix_dedup._bytes, 32, 169), (suffix_dedup._bytes, 12, 20)):
        sizes = Counter()
        for out in _seeds.send_anchors(units, k, w, 16, 1 << 20)(iter([batch])):
            for bucket, places in zip(out.column("bucket").to_pylist(), out.column("places").to_pylist(), strict=True):
                sizes[bucket] += len(_spark.unplanes(places, np.uint32))
        assert len(sizes) == 16 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 16


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", max_size=30)), min_size=1, max_size=200))
def test_multikey_quicksort_parts_at_the_shallow_depth(items):
    text = np.frombuffer("".join(s for _, s in items).encode() + b"x", np.uint8)
    size = np.array([len(s) for _, s in items])
    group = np.array([g for g, _ in items])
    order = np.argsort(group, kind="stable")
    first = np.append(True, group[order][1:] != group[order][:-1])
    _suffix._quicksort(text, np.cumsum(size) - size, size, order, first)
    got = [(items[i][0], items[i][1][: _suffix.SHALLOW]) for i in order]
    assert got == sorted(got)
    assert [j for j in range(len(got)) if first[j]] == [j for j in range(len(got)) if j == 0 or got[j] != got[j - 1]]
