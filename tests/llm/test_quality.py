import re

from tessella.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def hit(k, first):
        seen, count, mark = {}, {}, set()
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            count.setdefault(w, []).append(i)
        for at in count.values():
            if len(at) > 1:
                for i in at if first else at[1:]:
                    mark.update(range(i, i + k))
        return mark

    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit(5, True)),
        "dup_line_chars": sum(len(x) for i, x in enumerate(lines) if x in lines[:i]), "line_chars": sum(map(len, lines)),
    } | {f"repeat_chars_{k}": sum(len(words[i]) for i in hit(k, False)) for k in quality.LENGTHS}


def test_measures_match_brute_force(odd_docs):
    got = quality.measure(odd_docs).join(odd_docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = brute(r.text)
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.base_failed == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (r.kept and r.base_failed)


def test_keep_returns_the_columns_it_was_given(odd_docs):
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == quality.measure(odd_docs).filter("kept").count()


def test_empty_table(spark, odd_docs):
    assert quality.measure(odd_docs.limit(0)).count() == 0


def test_coverage_rejects_what_the_base_rule_passes(spark):
    passage = " ".join(f"again{i}" for i in range(12))
    rest = [" ".join(f"w{k}x{i}" for i in range(55)) for k in range(5)]
    got = quality.measure(spark.createDataFrame([(1, " ".join(f"{r} {passage}" for r in rest)), (2, " ".join([passage, *rest]))], "doc_id long, text string"))
    assert {r.doc_id: (r.n_repeat_words, r.base_failed, r.kept) for r in got.collect()} == {1: (60, False, False), 2: (0, False, True)}
