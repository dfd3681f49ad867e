"""Quality rules by repetition coverage.

Rolling hashes of word windows of several lengths are taken over many texts at once in numpy. A text's coverage at a
length is the share of its word characters that lie in windows which occur twice or more in the text, and its line
coverage the share of characters in lines equal to an earlier line. Hashes only propose that words, windows and lines are
equal: their bytes are compared.

Defined cases: a null text is an empty one; a text without words has zero counts, fails the base rule (too few words)
and is not kept; ties do not matter; repeated rows give repeated results; extra columns are ignored by `measure` and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _text as X

#: Fixed values of the rules: window lengths in words, and the largest share (percent) of word characters in repeated windows of that length, every occurrence but the first counted: those of MassiveText (Rae et al. 2021, arXiv 2112.11446, table A1).
LENGTHS = (5, 7, 10)
MOST_REPEATED = {5: 15, 7: 13, 10: 10}
#: The largest share (percent) of characters in lines equal to an earlier line, from the same table.
MOST_IN_LINES = 20
LEAST_WORDS, MOST_IN_WINDOWS = 10, 20
SYMBOLS = b"#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars", *[f"repeat_chars_{n}" for n in LENGTHS]]


def _lines(data: np.ndarray, off: np.ndarray, text_points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: lines with a word that equal an earlier line, the code points in those, the code points in all lines with a word."""
    n = len(data)
    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([off[:-1], ends + 1])) if n else np.zeros(0, np.int64)
    start = start[start < n]
    if not len(start):
        z = np.zeros(len(off) - 1, np.int64)
        return z, z, z
    doc = np.searchsorted(off, start, "right") - 1
    stop = np.append(start[1:], n)
    stop = np.where((stop > start) & (data[stop - 1] == 10) & (stop - 1 >= start), stop - 1, stop)
    head = np.zeros(n + 1, np.int64)
    np.cumsum(~X.spaces(data), out=head[1:])
    real = head[stop] > head[start]
    start, stop, doc = start[real], stop[real], doc[real]
    if not len(start):
        z = np.zeros(len(off) - 1, np.int64)
        return z, z, z
    eight, length = X.eights(data), stop - start
    kind = X.alike(eight, start, length, X.run_hashes(eight, start, length))
    order = np.lexsort((kind, doc))
    later = np.zeros(len(kind), bool)
    later[order[1:]] = (kind[order[1:]] == kind[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    points = text_points[stop] - text_points[start]
    size = len(off) - 1
    return np.bincount(doc[later], minlength=size), np.bincount(doc[later], points[later], size).astype(np.int64), np.bincount(doc, points, size).astype(np.int64)


def _equal_windows(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of k words, given by their first words, with equal ones of a text next to each other in their order;
    and of each but the first whether it equals the one before, word for word. ids: equal for equal words only."""
    key, at = X.windows(X.mix(ids.astype(np.uint64) + X.U64(1)), first, k)
    key = key ^ X.mix(doc[at] + X.U64(1))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    for a in range(0, len(same), 1 << 18):
        i = a + np.flatnonzero(same[a : a + (1 << 18)])
        fine = doc[at[i]] == doc[at[i + 1]]
        for j in range(k):
            fine &= ids[at[i] + j] == ids[at[i + 1] + j]
        if not fine.all():  # the hash has failed, so words are compared instead
            order = np.lexsort((at, *[ids[at + j] for j in range(k)], doc[at]))
            at = at[order]
            same = doc[at[1:]] == doc[at[:-1]]
            for j in range(k):
                same &= ids[at[1:] + j] == ids[at[:-1] + j]
            break
    return at, same


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    words = X.Words(data, off)
    points, doc, n = words.points(), words.text_of().astype(np.uint64), len(words.start)
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    dup_lines, dup_chars, line_chars = _lines(data, off, head)
    ids = words.ids()
    repeat_words, repeat_chars = np.zeros(len(off) - 1, np.int64), []
    for k in LENGTHS:
        order, same = _equal_windows(ids, words.first, doc, k)
        later = order[1:][same]
        if k == LENGTHS[0]:
            every = np.union1d(later, order[:-1][same])
            repeat_words = X.sums(X.covered(n, every, k), words.first)
        repeat_chars.append(X.sums(np.where(X.covered(n, later, k), points, 0), words.first))
    return [words.count, X.sums(points, words.first), X.sums(symbol, off), dup_lines, repeat_words, dup_chars, line_chars, *repeat_chars]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = X.utf8(batch.column("text"))
        parts = [_measure(d, o) for _, _, d, o in X.chunks(data, off)]
        if parts:
            found = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *MEASURES])


def judge(df: DataFrame) -> DataFrame:
    """With base_failed and kept, from the measures; whole numbers only."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_IN_WINDOWS * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= MOST_IN_LINES * F.col("line_chars")
    for n in LENGTHS:
        fine = fine & (100 * F.col(f"repeat_chars_{n}") <= MOST_REPEATED[n] * F.col("word_chars"))
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in MEASURES]])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept) of each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text")
    return judge(rows.mapInArrow(_measured, _schema(rows)).drop("text"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return judge(inner.mapInArrow(_measured, _schema(inner))).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *[f"repeat_chars_{n}" for n in LENGTHS])
