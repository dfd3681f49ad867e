import re

import pytest

from tessella.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= percent * either:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_match_brute_force(odd_docs, texts, k, percent):
    want = brute(texts, k, percent)
    got = ngram_join.groups(odd_docs, k, percent).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Chains of edits of one base text: lists far beyond SMALL, links that only the second round sees."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(40)] = f"x{r.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_empty_table(odd_docs):
    assert ngram_join.groups(odd_docs.limit(0), 4, 85).count() == 0
