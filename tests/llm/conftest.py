import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with every odd case: nulls, empty and long texts, copies, repeated rows, clashing names of extra columns."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [None, "", " \t\n", "one", "one two three", "x" * 5000, "a b c d e f g h\n" * 30, "line one here\nother\nline one here\n\n"]
    for b in base:
        w = b.split()
        rows += [b, b, b.upper(), b + " end", " ".join([*w[:60], "zz", *w[61:]]), "\n".join(w), " ".join(w[20:70]), " ".join([word() for _ in range(30)] + w[30:80] + [word() for _ in range(20)])]
    rows += [" ".join(word() for _ in range(4000)), "𝔘ñï %% $$ <b> |&| ​x y"]
    docs = [(i, t, "en", f"s{i % 3}", 7, f"k{i}") for i, t in enumerate(rows)]
    docs.append(docs[10])
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_words int, key string")


@pytest.fixture(scope="session")
def texts(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect()]
