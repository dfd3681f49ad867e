"""Substring dedup by seed and extend, over words.

Documents meet at winnowed word anchors (see _seeds). Around an anchor that documents share, the match is extended
word by word to both sides against the other contexts of the same seed, and what reaches `LENGTH` words or more and
also starts in a document with a smaller doc_id is a repeat; overlapping repeats are merged to maximal ones. Repeats
are judged on the input, not on what is left.

Defined cases: null, empty and blank texts have no words; texts shorter than LENGTH words lose nothing; rows with equal
doc_id never remove each other's words; a null doc_id counts as smaller than all others; extra columns stay as they are.
Words are compared by 64-bit hashes of their bytes: two windows count as equal if all of their 13 words agree in them;
contexts that are settled without being sent agree in 128 bits more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _seeds as A
from tessella.llm import _spark as S
from tessella.llm import _text as X

#: Words of a window, and of a seed within it.
LENGTH, SEED = 13, 4
CHUNK = 2 << 20


def _words(data: np.ndarray, off: np.ndarray, k: int) -> A.Sequence:
    words = X.Words(data, off)
    h = words.hashes()
    return A.Sequence(X.grams(h, k), X.eights(h.view(np.uint8)), 8, words.first)


def _send_contexts(length: int, seed: int, buckets: int):
    """Round two, at the block: of every anchor asked for, the words of its context."""
    w = length - seed + 1

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(A.replies(asked))
        wanted = np.unique(np.concatenate([r[(y & A.SEND) > 0] for _, r, _, y in found])) if found else np.zeros(0, np.int64)
        docs = A.rows_of(docs, wanted)
        row, place, _ = A.places(docs, found, {1: A.SEND})
        data, off = X.utf8(docs.column("text"))
        own, key, doc = docs.column("key").to_numpy(), [], A.ids(docs)
        parts: list = [[], [], [], [], [], [], []]
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        for a, b, d, o in X.chunks(data, off, CHUNK):
            lo, hi = np.searchsorted(row, [a, b])
            words = X.Words(d, o)
            h = words.hashes()
            first = words.first.astype(np.int64)
            at = first[row[lo:hi] - a] + place[lo:hi]
            left, right = np.minimum(place[lo:hi], w - 1), np.minimum(first[row[lo:hi] - a + 1] - at - seed, w - 1)
            step = np.arange(1 - w, seed + w - 1)
            around = at[:, None] + step
            word = np.zeros(around.shape, np.uint64)
            inside = (step >= -left[:, None]) & (step < seed + right[:, None])
            word[inside] = h[around[inside]]
            gram = X.run_hashes(X.eights(h.view(np.uint8)), 8 * at, np.full(len(at), 8 * seed))
            for to, v in zip(parts, (own[row[lo:hi]], doc[row[lo:hi]], gram, place[lo:hi], left, right, word), strict=True):
                to.append(v)
        if not parts[0]:
            return A.no_rows(_CONTEXTS)
        r, doc, key, place, left, right, word = (np.concatenate(x) for x in parts)
        order = np.argsort(key)
        out = []
        for b, lo, hi in S.bounds(key[order], buckets):
            i = order[lo:hi]
            out.append((b, r[i].tobytes(), doc[i].tobytes(), key[i].tobytes(), place[i].astype(np.uint32).tobytes(), left[i].astype(np.uint8).tobytes(), right[i].astype(np.uint8).tobytes(), word[i].tobytes()))
        return pa.Table.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(_CONTEXTS)], schema=_CONTEXTS)

    return run


CONTEXTS = "bucket int, rows binary, ids binary, keys binary, places binary, lefts binary, rights binary, words binary"
_CONTEXTS = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("rows", "ids", "keys", "places", "lefts", "rights", "words")]])


def _runs(key: np.ndarray, doc: np.ndarray, word: np.ndarray, at: np.ndarray, place: slice) -> tuple[np.ndarray, np.ndarray]:
    """The order of runs word[at, place] in which equal ones are together, by doc, and where others begin. Equal keys only
    propose equal runs: the hashes of all their words are compared."""
    order = np.lexsort((doc, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    same = np.flatnonzero(~new)
    for a in range(0, len(same), 1 << 16):
        i = same[a : a + (1 << 16)]
        if (word[at[order[i]], place] != word[at[order[i - 1]], place]).any():
            order = np.lexsort((doc, *word[at, place].T))
            new[1:] = (word[at[order[1:]], place] != word[at[order[:-1]], place]).any(axis=1)
            break
    return order, new


def _extend(length: int, seed: int, blocks: int):
    """Round two, at a range of seeds: extends each context to both sides and replies the runs that a smaller doc_id has too."""
    w = length - seed + 1

    def run(table: pa.Table) -> pa.Table:
        kinds = {"rows": np.int64, "ids": np.int64, "keys": np.uint64, "places": np.uint32, "lefts": np.uint8, "rights": np.uint8, "words": np.uint64}
        row, doc, key, place, left, right, word = (np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()]) for n, t in kinds.items())
        word, place = word.reshape(-1, 2 * w + seed - 2), place.astype(np.int64)
        # Extension to the left and to the right by j words: hashes of the words in between, from the seed outwards.
        lefts, rights = [X.mix(key)], [X.mix(~key)]
        with np.errstate(over="ignore"):
            for j in range(1, w):
                lefts.append(X.mix(lefts[-1] * X.STEP + word[:, w - 1 - j]))
                rights.append(X.mix(rights[-1] * X.STEP + word[:, w + seed - 2 + j]))
            starts, ends, rows = [], [], []
            for j in range(w):
                at = np.flatnonzero((left >= j) & (right >= w - 1 - j))
                run_key = lefts[j][at] ^ X.mix(rights[w - 1 - j][at] + X.U64(j))
                order, new = _runs(run_key, doc[at], word, at, slice(w - 1 - j, w - 1 - j + length))
                d = doc[at][order]
                first = d[new][np.cumsum(new) - 1] if len(d) else d
                hit = at[order[d > first]]
                rows.append(row[hit])
                starts.append(place[hit] - j)
                ends.append(place[hit] - j + length)
        return A.reply(blocks, 2, np.concatenate(rows), np.concatenate(starts), np.concatenate(ends))

    return run


def _remove(length: int, seed: int):
    """Of a block's rows, the words that are left."""
    w = length - seed + 1

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found = list(A.replies(told))
        data, off = X.utf8(docs.column("text"))
        full_row, full, _ = A.places(docs, found, {1: A.FULL})
        run_row, start, end = A.places(docs, found, {2: 0})
        kept, n_words, n_removed, n_spans = [], [], [], []
        full_order, run_order = np.argsort(full_row, kind="stable"), np.argsort(run_row, kind="stable")
        full_row, full, run_row, start, end = full_row[full_order], full[full_order], run_row[run_order], start[run_order], end[run_order]
        for a, b, d, o in X.chunks(data, off, CHUNK):
            words = X.Words(d, o)
            lo, hi = np.searchsorted(full_row, [a, b])
            r, at = full_row[lo:hi] - a, full[lo:hi]
            s1, e1 = words.first[r] + np.maximum(at - w + 1, 0), np.minimum(words.first[r] + at + seed + w - 1, words.first[r + 1])
            lo, hi = np.searchsorted(run_row, [a, b])
            r = run_row[lo:hi] - a
            s2, e2 = words.first[r] + start[lo:hi], words.first[r] + end[lo:hi]
            gone = X.covered(len(words.start), np.concatenate([s1, s2]), np.concatenate([e1 - s1, e2 - s2]))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = words.first[:-1][words.count > 0]
            begins[inner] = gone[inner]
            n_words.append(words.count)
            n_removed.append(X.sums(gone, words.first))
            n_spans.append(X.sums(begins, words.first))
            buffer, left = d.tobytes(), ~gone
            for i in range(b - a):
                x, y = words.first[i], words.first[i + 1]
                text = buffer[o[i] : o[i + 1]].split()
                kept.append(b" ".join(text if n_removed[-1][i] == 0 else compress(text, left[x:y].tolist())))
        counts = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_words, n_removed, n_spans)]
        return pa.Table.from_arrays([docs.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), *counts], names=["row", "kept", "n_words", "n_removed", "n_spans"])

    return run


def removed(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, kept, n_words, n_removed, n_spans) of each row of docs: all its columns, its remaining words joined by one
    space, its number of words, of removed words and of maximal removed runs."""
    n, buckets = S.partitions(docs, A.BLOCK_MB), S.partitions(docs, A.BUCKET_MB)
    w = length - seed + 1
    rows = A.keyed(docs)
    anchors = rows.select("doc_id", "text", "key").mapInArrow(A.send_anchors(_words, seed, w, buckets, CHUNK), A.SENT)
    first = S.table(anchors.groupBy("bucket").applyInArrow(S.frugal(A.settle(n, by_id=True)), A.REPLY))
    del anchors
    S.release()
    blocks = A.in_blocks(rows, n)
    contexts = blocks.drop("row").groupBy("block").cogroup(first.groupBy("block")).applyInArrow(S.frugal_pair(_send_contexts(length, seed, buckets)), CONTEXTS)
    second = S.table(contexts.groupBy("bucket").applyInArrow(S.frugal(_extend(length, seed, n)), A.REPLY))
    del contexts
    S.release()
    schema = T.StructType([blocks.schema["row"], T.StructField("kept", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_spans")]])
    told = first.unionByName(second)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(S.frugal_pair(_remove(length, seed)), schema)


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The rows of docs with repeats taken out of their texts; a text that loses nothing stays as it is, and one that loses all is empty."""
    found = removed(docs, length, seed)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_spans")
