"""Winnowed anchors: the seeds by which texts meet, without any text being sent.

A text is a sequence of units (bytes or words). Of every `w` consecutive k-grams the one with the least hash is an
anchor (the rightmost of equal ones), so that any two equal runs of  span = k + w - 1  units have an anchor at the same
place, and whatever runs around an anchor can match within its context: w - 1 units to either side.

Round one sends (56 bits of the k-gram's hash, 128 bits of the context's, place) of each anchor to ranges of hashes.
Anchors with equal contexts are settled there; of different contexts with the same k-gram, one for each (see settle())
is asked for. Round two sends the contexts asked for, and the operator extends them against each other, unit by unit.
Replies go to blocks of rows. What a k-gram's hash brings together wrongly costs time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _spark as S
from tessella.llm import _text as X

FULL, SEND = 1, 2
#: Anchors that a task gathers before it sends them, in all and for each bucket: packed rows are not to be nearly empty.
FLUSH, FLUSH_BUCKET = 600_000, 16
#: Stored input, in MB, whose anchors make a bucket, and whose texts make a block.
BUCKET_MB, BLOCK_MB = 256, 64
SHIFT = np.uint64(8)
NO_ID = -(2**63)


def byte_grams(eight: np.ndarray, n: int, k: int) -> np.ndarray:
    """A hash of each k bytes in a row of n bytes."""
    if n < k:
        return np.zeros(0, np.uint64)
    if k % 8:
        return X.grams(X.mix((eight[:n] & X.U64(255)) + X.U64(1)), k)
    return X.grams(X.mix(eight[: n - 7]), k // 8, 8)


class Sequence:
    """Units of a run of texts. gram: a hash of the k-gram at each place; eight: the units' bytes, `width` of them each;
    first: the place of each text's first unit, one more at the end."""

    def __init__(self, gram: np.ndarray, eight: np.ndarray, width: int, first: np.ndarray):
        self.gram, self.eight, self.width, self.first = gram, eight, width, first.astype(np.int64)
        self.n = int(self.first[-1])

    def hashes(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hashes of the runs [start, end)."""
        return X.run_hashes(self.eight, self.width * start, self.width * (end - start), kind)

    def anchors(self, k: int, w: int) -> np.ndarray:
        """Places of the anchors, in order."""
        span, m = k + w - 1, self.n - k + 1
        if self.n < span:
            return np.zeros(0, np.int64)
        mask = X.U64((1 << self.n.bit_length()) - 1)
        gram = self.gram[:m] & ~mask
        gram |= mask - np.arange(m, dtype=np.uint64)
        least, size = gram, 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if w > size:
            least = np.minimum(least[: size - w], least[w - size :])
        room = np.repeat(self.first[1:], np.diff(self.first))[: len(least)] - np.arange(len(least))
        at = (mask - (least[room >= span] & mask)).astype(np.int64)
        return at[np.append(True, at[1:] != at[:-1])] if len(at) else at

    def contexts(self, at: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors: the text, the units to the left and to the right that a match within the context can take."""
        text = np.searchsorted(self.first, at, "right") - 1
        return text, np.minimum(at - self.first[text], w - 1), np.minimum(self.first[text + 1] - at - k, w - 1)


SENT = "bucket int, rows binary, ids binary, items binary, keys binary, places binary, contexts binary"
_SENT = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("rows", "ids", "items", "keys", "places", "contexts")]])
REPLY = "block int, kind int, rows binary, items binary, a binary, b binary"
_REPLY = pa.schema([("block", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("rows", "items", "a", "b")]])


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, key): every column of docs, and a key that equal rows share."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(n).cast("long"), 32).cast("int"))


def ids(batch) -> np.ndarray:
    """The doc_ids of a table or record batch; null comes before all."""
    return np.asarray(batch.column("doc_id").fill_null(NO_ID), np.int64)


def send_anchors(units: Callable, k: int, w: int, buckets: int, chunk: int):
    """Round one, at the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            data, off = X.utf8(batch.column("text"))
            row, doc = batch.column("key").to_numpy(), ids(batch)
            for a, _, d, o in X.chunks(data, off, chunk):
                seq = units(d, o, k)
                at = seq.anchors(k, w)
                if not len(at):
                    continue
                text, left, right = seq.contexts(at, k, w)
                around = X.mix((left * w + right).astype(np.uint64))
                contexts = [seq.hashes(at - left, at + k + right, kind) ^ around for kind in (0, 1)]
                # anchors are least hashes, so ranges of those would be far from equal
                held.append((row[a + text], doc[a + text], X.mix(seq.gram[at] ^ X.KIND[0]), at - seq.first[text], *contexts))
                if sum(len(x[0]) for x in held) >= max(FLUSH, FLUSH_BUCKET * buckets):
                    yield from _scatter(held, buckets)
                    held = []
            seq = at = text = left = right = around = contexts = None
            S.trim()
        if held:
            yield from _scatter(held, buckets)
            held = []
            S.trim()

    return run


def _scatter(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    row, doc, key, place, context, more = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    row, doc, key, place, context, more = (x[order] for x in (row, doc, key, place, context, more))
    out = []
    for b, lo, hi in S.bounds(key, buckets):
        _, at, item = np.unique(row[lo:hi], return_index=True, return_inverse=True)
        out.append((b, row[lo:hi][at].tobytes(), S.planes(doc[lo:hi][at]), S.planes(item.astype(np.uint32)), S.deltas(key[lo:hi] >> SHIFT), S.planes(place[lo:hi].astype(np.uint32)), context[lo:hi].tobytes() + more[lo:hi].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j] for x in out], pa.binary()) for j in range(1, 7)]], schema=_SENT)


def reply(blocks: int, kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    order = np.argsort(row.view(np.uint64), kind="stable")
    row, a, b = row[order], a[order], b[order]
    out = []
    for block, lo, hi in S.bounds(row.view(np.uint64), blocks):
        u, item = np.unique(row[lo:hi], return_inverse=True)
        out.append((block, kind, u.tobytes(), S.planes(item.astype(np.uint32)), S.planes(a[lo:hi].astype(np.uint32)), S.planes(b[lo:hi].astype(np.uint32))))
    return pa.Table.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(_REPLY)], schema=_REPLY)


def no_rows(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def settle(blocks: int, by_id: bool):
    """Round one, at a range of hashes. Rule: with by_id, an anchor is settled if a smaller doc_id has the same context, and
    the rest are asked for; else it is settled if anything has the same context, and one anchor for each context is asked for.
    Nothing is asked for where a k-gram has a single context, or (with by_id) a single document."""

    def run(table: pa.Table) -> pa.Table:
        cols = [[], [], [], [], [], [], []]
        base = 0
        for r, d, i, x, p, c in zip(*[table.column(n).to_pylist() for n in ("rows", "ids", "items", "keys", "places", "contexts")], strict=True):
            r, c = np.frombuffer(r, np.int64), np.frombuffer(c, np.uint64).reshape(2, -1)
            for to, v in zip(cols, (r, S.unplanes(d, np.int64), S.unplanes(i, np.uint32).astype(np.int64) + base, S.undeltas(x, np.uint64), S.unplanes(p, np.uint32), *c), strict=True):
                to.append(v)
            base += len(r)
        row, doc, item, key, place, context, more = (np.concatenate(x) for x in cols)
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[1:] |= same
        many[:-1] |= same
        at = order[many]
        own = doc[item[at]]
        order = np.lexsort((own, more[at], context[at], key[at]))
        at, own = at[order], own[order]
        k, c, m = key[at], context[at], more[at]
        n = len(at)
        if not n:
            return reply(blocks, 1, at, at, at)
        new_key, new_context = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = k[1:] != k[:-1]
        new_context[1:] = new_key[1:] | (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new_context) - 1
        contexts = np.bincount(of_key[new_context])
        ask = (contexts > 1)[of_key]
        if by_id:
            first = own[new_context][of_context]
            several = np.zeros(len(contexts), bool)
            np.logical_or.at(several, of_key, own != own[new_key][of_key])
            what = np.where(own > first, FULL, np.where(ask & several[of_key], SEND, 0))
        else:
            size = np.bincount(of_context)[of_context]
            what = np.where(size > 1, FULL, 0) | np.where(ask & new_context, SEND, 0)
        hit = what > 0
        return reply(blocks, 1, row[item[at[hit]]], place[at[hit]], what[hit])

    return run


def replies(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, key of the row, a, b) of a block's replies."""
    for kind, r, i, a, b in zip(*[table.column(n).to_pylist() for n in ("kind", "rows", "items", "a", "b")], strict=True):
        yield kind, np.frombuffer(r, np.int64)[S.unplanes(i, np.uint32)], S.unplanes(a, np.uint32).astype(np.int64), S.unplanes(b, np.uint32).astype(np.int64)


def rows_of(table: pa.Table, wanted: np.ndarray) -> pa.Table:
    """One row for each wanted key that the table has, in order of the keys."""
    key = table.column("key").to_numpy()
    u, first = np.unique(key, return_index=True)
    return table.take(pa.array(first[np.isin(u, wanted)]))


def places(table: pa.Table, found: list, kinds: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the table, a, b) of the replies whose b has the bits named for their kind (0: all); every row with the key gets them."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    k, a, b = [], [], []
    for kind, r, x, y in found:
        if kind in kinds:
            hit = (y & kinds[kind]) > 0 if kinds[kind] else np.ones(len(y), bool)
            k.append(r[hit])
            a.append(x[hit])
            b.append(y[hit])
    if not k:
        z = np.zeros(0, np.int64)
        return z, z, z
    k, a, b = np.concatenate(k), np.concatenate(a), np.concatenate(b)
    lo, hi = np.searchsorted(key[order], k), np.searchsorted(key[order], k, "right")
    times = hi - lo
    which = np.repeat(np.arange(len(k)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return order[lo[which] + step], a[which], b[which]
