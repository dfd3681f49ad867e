import hashlib
import re

import pytest

from tessella.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    least = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - length + 1):
            x = tuple(w[j : j + length])
            least[x] = min(i, least.get(x, i))
    out = {}
    for i, w in words:
        gone = set()
        for j in range(len(w) - length + 1):
            if least[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), sum(j - 1 not in gone for j in gone))
    return out


@pytest.mark.parametrize(("length", "seed"), [(13, 4), (6, 2), (20, 4)])
def test_matches_brute_force(odd_docs, texts, length, seed):
    got = substring.removed(odd_docs, length, seed).selectExpr("row.doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256) as h", "n_spans").collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.h, r.n_spans) for r in got} == brute(texts, length)


def test_repeated_word_and_shared_lines(spark):
    rows = [(i, "a " * (5 * i) + "x" + str(i)) for i in range(8)] + [(20 + i, f"u{i} " + " ".join(f"w{j}" for j in range(i, 40 - i)) + f" v{i}") for i in range(12)]
    got = substring.removed(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("row.doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256) as h", "n_spans").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.h, r.n_spans) for r in got} == brute(rows, 13)


def test_dedup_keeps_columns(odd_docs):
    out = substring.dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == odd_docs.count()
    assert out.filter("text is null").count() == 1


def test_empty_table(odd_docs):
    assert substring.removed(odd_docs.limit(0)).count() == 0
