import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
import test_mixing
import test_ngram_join
import test_quality
from tessella.llm import pieces, quality


def kept(text):
    m = test_quality.brute(text)
    if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 100 * m["dup_line_chars"] > quality.MOST_IN_LINES * m["line_chars"]:
        return False
    return all(100 * m[f"repeat_chars_{k}"] <= quality.MOST_REPEATED[k] * m["word_chars"] for k in quality.LENGTHS)


def without_repeats(rows, length=13):
    least, words = {}, {i: test_quality.WORD.findall(t) for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - length + 1):
            x = tuple(w[j : j + length])
            least[x] = min(i, least.get(x, i))
    out = {}
    for i, t in rows:
        w = words[i]
        gone = {p for j in range(len(w) - length + 1) if least[tuple(w[j : j + length])] < i for p in range(j, j + length)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    return out


def test_stages_match_brute_force(spark, odd_docs, tmp_path):
    docs = odd_docs.dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [(i, r.text) for i, r in rows.items() if kept(r.text)]
    group = test_ngram_join.brute(good, 5, 80)
    single = [(i, t) for i, t in good if group[i][1] == i]
    left = without_repeats(single)
    size = Counter()
    for i, t in left.items():
        size[rows[i].source] += max(len(t), 1)
    copies = test_mixing.brute([(i, t, rows[i].source) for i, t in left.items()], {s: n**0.5 for s, n in size.items()})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in copies)
    model = pieces.load(pieces.model_path())
    assert len(good) > len(single) > 3
    for r in got:
        assert model.decode(r.ids).decode() == left[r.doc_id]


def test_empty_documents(spark, odd_docs, tmp_path):
    odd_docs.limit(0).selectExpr("doc_id", "text", "lang", "source", "0L as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_row(spark):
    """Repeated rows, rows that share an id, nulls and clashing names."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "x", 1), (1, a, "x", 1), (1, a, "y", 2), (2, a + " end", "x", 3), (1, b, "x", 4), (3, b, "x", 5), (None, "z " + a, "x", 6), (4, None, "x", 7), (4, None, "x", 7), (5, "", "x", 8), (6, "", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `first` int").withColumnRenamed("lang", "key")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(None, "z " + a, "x", 6), (1, b, "x", 4), (4, None, "x", 7), (5, "", "x", 8), (6, "", "x", 9)]))


def test_run_with_nulls_repeated_rows_and_clashing_names(spark, odd_docs, tmp_path):
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "1 as copy", "2 as row", "3 as ids", "4 as n_words")
    extra = spark.createDataFrame([(None, " ".join(f"null{i}" for i in range(50)), None, None, None, 1, 2, 3, 4), (7, None, "en", "s", 0, 1, 2, 3, 4)], docs.schema)
    docs.unionByName(extra).unionByName(docs.filter("doc_id < 20")).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "ids"]
    rows = got.collect()
    once = corpus_pipeline.near_duplicates(spark, docs.unionByName(extra).unionByName(docs.filter("doc_id < 20")).transform(quality.keep), "")
    assert once.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    assert {r.doc_id for r in rows} <= {r.doc_id for r in once.collect()}
