"""Suffix-array dedup of bytes, sorted by the deep-shallow method.

Every byte goes that lies in a LENGTH-byte string which starts at two places or more, in one document or in several.
The suffixes that can take part are found by winnowed anchors (see _seeds): equal strings of LENGTH bytes have an anchor
at the same place. At each range of anchors a sparse suffix array is built: the suffixes that follow an anchor, and the
reversed ones that precede it, are sorted within the anchor's group by _suffix.sort. From the common prefixes of both
orders follows, for each place at which a string of LENGTH bytes can lie over the anchor, which documents share it.

Anchors with equal contexts (LENGTH - SEED bytes to either side) are found by hashes of 128 bits, and one of them stands
for all in the sorting, so that thousands of copies cost one suffix.

Defined cases: a null text is empty; texts shorter than LENGTH bytes lose nothing; repeated rows hold the same strings
and lose them all; a removed run may end within a character, so what is left is binary; extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _seeds as A
from tessella.llm import _spark as S
from tessella.llm import _suffix
from tessella.llm import _text as X

#: Bytes of a string, and of an anchor within it.
LENGTH, SEED = 200, 32
CHUNK = 1 << 20

CONTEXTS = "bucket int, rows binary, keys binary, places binary, lefts binary, rights binary, texts binary"
_CONTEXTS = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("rows", "keys", "places", "lefts", "rights", "texts")]])


def _bytes(data: np.ndarray, off: np.ndarray, k: int) -> A.Sequence:
    eight = X.eights(data)
    return A.Sequence(A.byte_grams(eight, len(data), k), eight, 1, off)


def _send_contexts(length: int, seed: int, buckets: int):
    """Round two, at the block: of every anchor asked for, the bytes of its context."""
    w = length - seed + 1

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(A.replies(asked))
        wanted = np.unique(np.concatenate([r[(y & A.SEND) > 0] for _, r, _, y in found])) if found else np.zeros(0, np.int64)
        docs = A.rows_of(docs, wanted)
        row, place, _ = A.places(docs, found, {1: A.SEND})
        if not len(row):
            return A.no_rows(_CONTEXTS)
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        data, off = X.utf8(docs.column("text"))
        at = off[row] + place
        left, right = np.minimum(place, w - 1), np.minimum(off[row + 1] - at - seed, w - 1)
        key = X.run_hashes(X.eights(data), at, np.full(len(at), seed))
        own, out, buffer = docs.column("key").to_numpy(), [], data.tobytes()
        order = np.argsort(key)
        lo_at, hi_at = at - left, at + seed + right
        for b, lo, hi in S.bounds(key[order], buckets):
            i = order[lo:hi]
            texts = b"".join([buffer[x:y] for x, y in zip(lo_at[i].tolist(), hi_at[i].tolist(), strict=True)])
            out.append((b, own[row[i]].tobytes(), key[i].tobytes(), place[i].astype(np.uint32).tobytes(), left[i].astype(np.uint32).tobytes(), right[i].astype(np.uint32).tobytes(), texts))
        return pa.Table.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(_CONTEXTS)], schema=_CONTEXTS)

    return run


def _restricted(order: np.ndarray, lcp: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of those kept and their common prefixes with the one kept before."""
    at = np.flatnonzero(keep[order])
    if not len(at):
        return order[:0], lcp[:0]
    # segment j: after the one kept before, to its own place
    return order[at], np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))


def shared_runs(text: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors at text[at : at + seed], with so many bytes to the left and right: the least and the greatest o for which
    the string of `length` bytes from o bytes before the anchor lies over another anchor of the group too; -1 where none does."""
    n, w = len(at), length - seed + 1
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    after = _suffix.sort(text, at + seed, right, group)
    before = _suffix.sort(text[::-1], len(text) - at, left, group)
    most = []
    for order, lcp in (before, after):
        best = np.maximum(lcp, np.append(lcp[1:], -1))
        m = np.empty(n, np.int64)
        m[order] = best
        most.append(m)
    keep = (most[0] >= 0) & (most[0] + most[1] >= w - 1)
    idx = np.flatnonzero(keep)
    if not len(idx):
        return low, high
    (lo_order, lo_lcp), (hi_order, hi_lcp) = _restricted(*before, keep), _restricted(*after, keep)
    label_lo, label_hi = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(w):
        rest = w - 1 - o
        i = idx[(left[idx] >= o) & (right[idx] >= rest) & (most[0][idx] >= o) & (most[1][idx] >= rest)]
        if len(i) < 2:
            continue
        label_lo[lo_order] = np.cumsum(lo_lcp < o)
        label_hi[hi_order] = np.cumsum(hi_lcp < rest)
        hit = i[X.repeated(label_lo[i] * (n + 1) + label_hi[i])]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high


def _extend(length: int, seed: int, blocks: int):
    """Round two, at a range of anchors."""

    def run(table: pa.Table) -> pa.Table:
        kinds = {"rows": np.int64, "keys": np.uint64, "places": np.uint32, "lefts": np.uint32, "rights": np.uint32}
        row, key, place, left, right = (np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()]) for n, t in kinds.items())
        place, left, right = (x.astype(np.int64) for x in (place, left, right))
        text = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("texts").to_pylist()])
        size = left + seed + right
        at = np.cumsum(size) - size + left
        group = X.alike(X.eights(text), at, np.full(len(at), seed), key)
        low, high = shared_runs(text, at, left, right, group, length, seed)
        hit = np.flatnonzero(high >= 0)
        return A.reply(blocks, 2, row[hit], place[hit] - high[hit], place[hit] - low[hit] + length)

    return run


def _remove(length: int, seed: int):
    """Of a block's rows, the bytes that are left."""
    w = length - seed + 1

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found = list(A.replies(told))
        data, off = X.utf8(docs.column("text"))
        r, at, _ = A.places(docs, found, {1: A.FULL})
        run_row, start, end = A.places(docs, found, {2: 0})
        size = np.diff(off)
        row = np.concatenate([r, run_row])
        begin = np.concatenate([np.maximum(at - w + 1, 0), start])
        stop = np.concatenate([np.minimum(at + seed + w - 1, size[r]), end])
        order = np.argsort(row, kind="stable")
        row, begin, stop = row[order], begin[order], stop[order]
        left, counts = [], []
        for a, b, d, o in X.chunks(data, off, CHUNK):
            lo, hi = np.searchsorted(row, [a, b])
            base = o[row[lo:hi] - a]
            gone = X.covered(len(d), base + begin[lo:hi], stop[lo:hi] - begin[lo:hi])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = o[:-1][np.diff(o) > 0]
            begins[inner] = gone[inner]
            left.append(d[~gone])
            counts.append((X.sums(gone, o), X.sums(begins, o)))
        removed_, spans = (np.concatenate(x) for x in zip(*counts, strict=True)) if counts else (size, size)
        ends = np.concatenate([[0], np.cumsum(size - removed_)]).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(left) if left else np.zeros(0, np.uint8))]).cast(pa.binary())
        return pa.Table.from_arrays([docs.column("row"), kept, *[pa.array(x, pa.int64()) for x in (size, removed_, spans)]], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def removed(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans) of each row of docs: all its columns, the bytes that are left, the number of
    bytes, of removed bytes and of maximal removed runs."""
    n, buckets = S.partitions(docs, A.BLOCK_MB), S.partitions(docs, A.BUCKET_MB)
    w = length - seed + 1
    rows = A.keyed(docs)
    anchors = rows.select("doc_id", "text", "key").mapInArrow(A.send_anchors(_bytes, seed, w, buckets, CHUNK), A.SENT)
    first = S.table(anchors.groupBy("bucket").applyInArrow(S.frugal(A.settle(n, by_id=False)), A.REPLY))
    del anchors
    S.release()
    blocks = A.in_blocks(rows, n)
    contexts = blocks.drop("row").groupBy("block").cogroup(first.groupBy("block")).applyInArrow(S.frugal_pair(_send_contexts(length, seed, buckets)), CONTEXTS)
    second = S.table(contexts.groupBy("bucket").applyInArrow(S.frugal(_extend(length, seed, n)), A.REPLY))
    del contexts
    S.release()
    schema = T.StructType([blocks.schema["row"], T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])
    told = first.unionByName(second)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(S.frugal_pair(_remove(length, seed)), schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
