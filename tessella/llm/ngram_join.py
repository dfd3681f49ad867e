"""N-gram Jaccard self-join under several global token orders.

A document's set holds the hashes of its distinct word n-grams. Documents with equal sets form a class, and classes are
joined. Three global orders of the tokens are used: by corpus frequency (rarest first), by ascending and by descending
hash. For a pair that reaches the threshold t, both sides share a token within their first  m - ceil(t n) + 1  tokens
under every order, where n is the set's size and m the number of its tokens that occur in two classes or more (others
can't be shared). Candidates come from the prefixes under the first order, must pass bitmaps of the prefixes under the
other two and a bitmap bound on the symmetric difference, and before the overlap is counted their exact prefixes under
the other two orders are intersected.

What grows with the data is exchanged by hash ranges: tokens travel as sorted 64-bit keys in packed blocks. Frequencies
are of all documents. Within the list of a token, up to `SMALL` classes are paired fully; of a longer list, at first only
neighbours in order of size and a hub are paired, and after the components of these links are known, only classes of
different components are compared: those outside the list's largest component with each other and with it, in blocks of
bounded size and of sizes that can reach the threshold. Links inside a component can't change it, so none is lost.

Defined cases: null, empty and blank texts have an empty set, 0 shingles and are linked with nothing; a text with fewer
than n words has its whole sequence as one shingle; equal rows belong to one class; extra columns are ignored.
Tokens are 64-bit hashes of words' bytes (see _text). Sets are taken as equal when sums of 128 bits agree: where the first
64 do and the others do not, classes are named by both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _spark as S
from tessella.llm import _text as X
from tessella.operators.graph import connected as components

#: Lists up to this length are paired fully in the first round.
SMALL = 24
#: Classes of a block in the second round.
BLOCK = 2048
#: Tokens that a task gathers before it sends them, in all and for each bucket: packed rows are not to be nearly empty.
FLUSH, FLUSH_BUCKET = 2_000_000, 16
WORDS = 8  # 64-bit words of the bitmap of a set
#: Different sets whose first 64 bits agree, at most; about n * n / 2**65 of n sets are expected, some dozens of 10**11.
CLASHES = 1_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text."""
    words = X.Words(data, off)
    h = words.hashes(lower)
    doc = words.text_of()
    key, at = X.windows(h, words.first, k)
    d = doc[at]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        whole = X.run_hashes(X.eights(h.view(np.uint8)), 8 * words.first[few], 8 * words.count[few])
        key, d = np.concatenate([key, whole]), np.concatenate([d, few])
    order = np.lexsort((key, d))
    key, d = key[order], d[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
    return d[new], key[new]


def _signatures(doc: np.ndarray, key: np.ndarray, n: int, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each text's set and two signatures of it, which equal sets share. Empty sets: size 0. Where the first one is
    in `odd`, it is taken together with the second."""
    size = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for kind in X.KIND:
        total = np.zeros(len(key) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(X.mix(key + kind), out=total[1:])
            out.append(X.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * kind))
    sig, check = out
    if odd is not None and len(odd):
        sig = np.where(np.isin(sig, odd), sig ^ check, sig)
    return size, sig, check


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = X.utf8(batch.column("text"))
            parts = [_signatures(*shingle_sets(d, o, k), b - a) for a, b, d, o in X.chunks(data, off)]
            if parts:
                size, sig, check = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size, pa.int64()), *[pa.array(x.view(np.int64), mask=size == 0) for x in (sig, check)]], names=["doc_id", "key", "n_shingles", "class", "check"])

    return run


def _send(buckets: int, sig: np.ndarray, size: np.ndarray, item: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sigs, sizes, items, keys): of each bucket, the keys in order and the item of each; items not used in a bucket stay behind."""
    order = np.argsort(key)
    out: dict[str, list] = {n: [] for n in ("bucket", "sigs", "sizes", "items", "keys", "extra")}
    key, item = key[order], item[order]
    mark = np.zeros(len(sig), np.uint32)
    for b, lo, hi in S.bounds(key, buckets):
        i, x = item[lo:hi], key[lo:hi]
        used = np.unique(i)
        mark[used] = np.arange(len(used), dtype=np.uint32)
        out["bucket"].append(b)
        out["sigs"].append(sig[used].tobytes())
        out["sizes"].append(S.planes(size[used].astype(np.uint32)))
        out["items"].append(S.planes(mark[i].astype(np.uint32)))
        out["keys"].append(S.deltas(x))
        out["extra"].append(b"")
    if out["bucket"]:
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[n], pa.binary()) for n in ("sigs", "sizes", "items", "keys", "extra")]], names=list(out))


SENT = "bucket int, sigs binary, sizes binary, items binary, keys binary, extra binary"


def _tokens(k: int, buckets: int, odd: np.ndarray):
    """Sends every class's tokens to the ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size_held = 0

        def flush():
            doc, key, size, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            _, keep = np.unique(sig, return_index=True)
            once = np.zeros(len(sig), bool)
            once[keep] = True
            own = once[doc]
            yield from _send(buckets, sig, size, doc[own], key[own])

        for batch in batches:
            data, off = X.utf8(batch.column("text"))
            for a, b, d, o in X.chunks(data, off):
                doc, key = shingle_sets(d, o, k)
                size, sig, _ = _signatures(doc, key, b - a, odd)
                base = sum(len(x[2]) for x in held)
                held.append((doc + base, key, size, sig))
                size_held += len(key)
                if size_held >= max(FLUSH, FLUSH_BUCKET * buckets):
                    yield from flush()
                    held, size_held = [], 0
                    S.trim()
        if size_held:
            yield from flush()
            held = []
            S.trim()

    return run


def _received(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(sigs, sizes, item, key) of a bucket; items count through."""
    sigs, sizes, items, keys, base = [], [], [], [], 0
    cols = [table.column(n).to_pylist() for n in ("sigs", "sizes", "items", "keys")]
    for g, z, i, x in zip(*cols, strict=True):
        sigs.append(np.frombuffer(g, np.uint64))
        sizes.append(S.unplanes(z, np.uint32))
        items.append(S.unplanes(i, np.uint32).astype(np.int64) + base)
        keys.append(S.undeltas(x, np.uint64))
        base += len(sigs[-1])
    return tuple(np.concatenate(x) for x in (sigs, sizes, items, keys))


def _shared(buckets: int):
    """Keeps the tokens that two classes or more have, and sends them with their frequency to the ranges of the classes."""

    def run(table: pa.Table) -> pa.Table:
        sigs, sizes, item, key = _received(table)
        order = np.argsort(key)
        key, item = key[order], item[order]
        same = key[1:] == key[:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        key, item = key[many], item[many]
        order = np.lexsort((sigs[item], key))
        key, item = key[order], item[order]
        s = sigs[item]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
        key, item = key[new], item[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        run_length = np.diff(np.append(first, len(key)))
        df = np.repeat(run_length, run_length)
        two = df > 1
        key, item, df = key[two], item[two], df[two]
        # by class, so that keys are in order within a class
        u, inv = np.unique(sigs, return_inverse=True)
        size = np.zeros(len(u), np.int64)
        size[inv] = sizes
        who = inv[item]
        order = np.lexsort((key, who))
        return pa.Table.from_batches(list(_send_classes(buckets, u, size, who[order], key[order], df[order])), schema=_SENT)

    return run


_SENT = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("sigs", "sizes", "items", "keys", "extra")]])


def _send_classes(buckets: int, sig: np.ndarray, size: np.ndarray, who: np.ndarray, key: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """As _send(), by the class's own range; `who` is in order, and sig too."""
    out: dict[str, list] = {n: [] for n in ("bucket", "sigs", "sizes", "items", "keys", "extra")}
    for b, lo, hi in S.bounds(sig, buckets):
        x, y = np.searchsorted(who, [lo, hi])
        if x == y:
            continue
        used, item = np.unique(who[x:y], return_inverse=True)
        out["bucket"].append(b)
        out["sigs"].append(sig[used].tobytes())
        out["sizes"].append(S.planes(size[used].astype(np.uint32)))
        out["items"].append(S.deltas(item.astype(np.uint32)))
        out["keys"].append(S.planes(key[x:y]))
        out["extra"].append(S.planes(df[x:y].astype(np.uint32)))
    if out["bucket"]:
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[n], pa.binary()) for n in ("sigs", "sizes", "items", "keys", "extra")]], schema=_SENT)


RECORD = "class long, n int, m int, tokens binary, prefix binary, bits binary"


def _records(percent: int):
    """Of each class that may have a partner: its shared tokens in order of hash, its prefix under the order of frequency, its bitmaps."""

    def run(table: pa.Table) -> pa.Table:
        sigs, sizes, items, keys, dfs, base = [], [], [], [], [], 0
        cols = [table.column(n).to_pylist() for n in ("sigs", "sizes", "items", "keys", "extra")]
        for g, z, i, x, e in zip(*cols, strict=True):
            sigs.append(np.frombuffer(g, np.uint64))
            sizes.append(S.unplanes(z, np.uint32))
            items.append(S.undeltas(i, np.uint32).astype(np.int64) + base)
            keys.append(S.unplanes(x, np.uint64))
            dfs.append(S.unplanes(e, np.uint32))
            base += len(sigs[-1])
        sig, size, item, key, df = (np.concatenate(x) for x in (sigs, sizes, items, keys, dfs))
        u, inv = np.unique(sig, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        n[inv] = size
        who = inv[item]
        m = np.bincount(who, minlength=len(u))
        q = m - (percent * n + 99) // 100 + 1
        fit = (q > 0)[who]
        who, key, df = who[fit], key[fit], df[fit]
        order = np.lexsort((key, who))
        who, key, df = who[order], key[order], df[order]
        by_df = np.lexsort((X.mix(key ^ X.KIND[0]), df, who))  # not by the hash itself, whose least values would all be in the first buckets
        out: dict[str, list] = {c.split()[0]: [] for c in RECORD.split(", ")}
        ids = np.flatnonzero((q > 0) & (m > 0))
        first = np.searchsorted(who, ids)
        last = np.searchsorted(who, ids, "right")
        for c, a, b in zip(ids.tolist(), first.tolist(), last.tolist(), strict=True):
            t, p = key[a:b], int(q[c])
            out["class"].append(int(u[c : c + 1].view(np.int64)[0]))
            out["n"].append(int(n[c]))
            out["m"].append(b - a)
            out["tokens"].append(t.tobytes())
            out["prefix"].append(key[by_df[a : a + p]].tobytes())
            out["bits"].append(_bitmaps(t, p))
        return pa.Table.from_arrays([pa.array(out["class"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["m"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("tokens", "prefix", "bits")]], names=list(out))

    return run


def _bitmaps(tokens: np.ndarray, p: int) -> bytes:
    """Parities of the tokens over 64 * WORDS bits, and the bits set by the first and by the last p tokens over 256 bits each."""
    at = (X.mix(tokens) & X.U64(64 * WORDS - 1)).astype(np.int64)
    parity = (np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)
    ends = np.zeros((2, 256), np.uint8)
    ends[0, (tokens[:p] & X.U64(255)).astype(np.int64)] = 1
    ends[1, (tokens[-p:] & X.U64(255)).astype(np.int64)] = 1
    return np.packbits(np.concatenate([parity, ends.reshape(-1)])).tobytes()


BITS = WORDS * 8 + 64


def _fits(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of classes, whether sizes, prefixes under the second and third order and bitmaps let them reach the threshold."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = 100 * small >= percent * large
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 200_000):
        i = at[lo : lo + 200_000]
        x, y = a[i], b[i]
        both = n[x] + n[y]
        most = both - 2 * ((percent * both + 99 + percent) // (100 + percent))
        differ = np.bitwise_count(bits[x, :WORDS] ^ bits[y, :WORDS]).sum(axis=1, dtype=np.int64) + (both - m[x] - m[y])
        common = bits[x, WORDS:] & bits[y, WORDS:]
        ok[i] = (differ <= most) & common[:, :4].any(axis=1) & common[:, 4:].any(axis=1)
    return ok


def _postings(buckets: int):
    """Sends each class with its sizes and bitmaps to the ranges of its prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, m = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("class", "n", "m"))
            prefix = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            bits = batch.column("bits").to_pylist()
            if not len(sig):
                continue
            key = np.concatenate(prefix)
            item = np.repeat(np.arange(len(sig)), [len(x) for x in prefix])
            order = np.argsort(key)
            key, item = key[order], item[order]
            out = []
            for b, lo, hi in S.bounds(key, buckets):
                used, local = np.unique(item[lo:hi], return_inverse=True)
                out.append((b, sig[used].tobytes(), np.stack([n[used], m[used]]).astype(np.int32).tobytes(), local.astype(np.uint32).tobytes(), key[lo:hi].tobytes(), b"".join(bits[i] for i in used)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j] for x in out], pa.binary()) for j in range(1, 6)]], schema=_SENT)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("heavy", pa.int64())])


def _listed(table: pa.Table):
    sigs, ns, ms, items, keys, bits, base = [], [], [], [], [], [], 0
    for g, z, i, x, e in zip(*[table.column(c).to_pylist() for c in ("sigs", "sizes", "items", "keys", "extra")], strict=True):
        sigs.append(np.frombuffer(g, np.int64))
        nm = np.frombuffer(z, np.int32).reshape(2, -1).astype(np.int64)
        ns.append(nm[0])
        ms.append(nm[1])
        items.append(np.frombuffer(i, np.uint32).astype(np.int64) + base)
        keys.append(np.frombuffer(x, np.uint64))
        bits.append(np.frombuffer(e, np.uint64).reshape(-1, BITS // 8))
        base += len(sigs[-1])
    return tuple(np.concatenate(x) for x in (sigs, ns, ms, items, keys, bits))


def _first_pairs(percent: int):
    """Pairs from the lists of tokens: all of a short list; neighbours and the hub of a long one, whose token is named too."""

    def run(table: pa.Table) -> pa.Table:
        sig, n, m, item, key, bits = _listed(table)
        order = np.lexsort((sig[item], n[item], key))
        key, item = key[order], item[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(key)))
        size, hub = np.repeat(length, length), np.repeat(first, length)
        small = size <= SMALL
        a, b = [hub[~small]], [np.flatnonzero(~small)]
        for d in range(1, SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & (small[d:] | (d < 3))) if len(key) > d else np.zeros(0, np.int64)
            a.append(i)
            b.append(i + d)
        a, b = item[np.concatenate(a)], item[np.concatenate(b)]
        differ = sig[a] != sig[b]
        a, b = a[differ], b[differ]
        ok = _fits(a, b, n, m, bits, percent)
        x, y = np.minimum(sig[a[ok]], sig[b[ok]]), np.maximum(sig[a[ok]], sig[b[ok]])
        pairs = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        heavy = key[first[length > SMALL]].view(np.int64)
        columns = [np.concatenate([pairs[:, 0], length[length > SMALL]]), np.concatenate([pairs[:, 1], np.zeros(len(heavy), np.int64)])]
        token = pa.array([None] * len(pairs) + heavy.tolist(), pa.int64())
        return pa.Table.from_arrays([pa.array(columns[0]), pa.array(columns[1]), token], schema=_PAIRS)

    return run


def _verified(percent: int):
    """Pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*[batch.column(c).to_pylist() for c in ("n", "tokens", "n2", "tokens2")], strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([_reaches(*x, percent) for x in sides], pa.bool_()))

    return run


def _reaches(n: int, s: bytes, p: int, t: bytes, percent: int) -> bool:
    """Whether two sets reach the threshold: their prefixes under the second and third order must meet, then the overlap is counted."""
    x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
    i, j = len(x) - (percent * n + 99) // 100 + 1, len(y) - (percent * p + 99) // 100 + 1
    if i <= 0 or j <= 0 or not _meet(x[:i], y[:j]) or not _meet(x[-i:], y[-j:]):
        return False
    return (100 + percent) * _meet(x, y) >= percent * (n + p)


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    z = np.sort(np.concatenate([x, y]), kind="stable")
    return int((z[1:] == z[:-1]).sum())


def _cross_links(percent: int):
    """Links between different components within a block of a long list, or between two blocks of it; as many as it takes to join them."""

    def run(table: pa.Table) -> pa.Table:
        own, sig, n, m, root = (np.asarray(table.column(c), np.int64) for c in ("own", "class", "n", "m", "root"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 8)
        tokens = table.column("tokens").to_pylist()
        one = table.column("one")[0].as_py()
        parent = np.unique(root, return_inverse=True)[1].tolist()
        at_root = np.array(parent)
        parent = list(range(len(parent)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        order = np.argsort(n, kind="stable")
        left, right = order[own[order] == 0], order if one else order[own[order] == 1]
        sizes, out = n[right], []
        for i in left.tolist():
            least = n[i] if one else -(-percent * n[i] // 100)
            j = right[int(np.searchsorted(sizes, least, "left")) : int(np.searchsorted(sizes, 100 * n[i] // percent, "right"))]
            j = j[root[j] != root[i]]
            if len(j):
                for x in j[_fits(np.full(len(j), i), j, n, m, bits, percent)].tolist():
                    a, b = find(at_root[i]), find(at_root[x])
                    if a != b and _reaches(int(n[i]), tokens[i], int(n[x]), tokens[x], percent):
                        parent[a] = b
                        out.append((min(sig[i], sig[x]), max(sig[i], sig[x])))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    left = records.select(F.col("class").alias("a"), "n", "tokens")
    right = records.select(F.col("class").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "tokens", "n2", "tokens2").mapInArrow(_verified(percent), "a long, b long")


def class_links(docs: DataFrame, k: int = 5, percent: int = 80, odd: np.ndarray | None = None) -> DataFrame:
    """(a, b): links between classes of equal sets that join the same classes as all links at `percent` or more do."""
    n = 2 * S.partitions(docs)
    tokens = docs.select("text").mapInArrow(_tokens(k, n, np.zeros(0, np.uint64) if odd is None else odd), SENT)
    shared = tokens.groupBy("bucket").applyInArrow(S.frugal(_shared(n)), SENT)
    records = S.table(shared.groupBy("bucket").applyInArrow(S.frugal(_records(percent)), RECORD))
    del tokens, shared
    S.release()
    sent = records.select("class", "n", "m", "prefix", "bits").mapInArrow(_postings(n), SENT)
    found = S.cut(sent.groupBy("bucket").applyInArrow(S.frugal(_first_pairs(percent)), "a long, b long, heavy long"))
    pairs = found.filter("heavy is null").select("a", "b").distinct()
    links = S.cut(_links(pairs, records, percent))
    heavy = found.filter("heavy is not null").select(F.col("heavy").alias("token"), F.col("a").alias("length"))
    if heavy.isEmpty():
        S.drop(records)
        return links
    roots = components(links).withColumnRenamed("node", "class")
    listed = records.select("class", "n", "prefix").mapInArrow(_exploded, "class long, n int, token long")
    listed = S.looked_up(S.cut(listed), heavy, "token", "length", inner=True).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    more = S.cut(_blocks(S.cut(listed), records, percent).groupBy("task").applyInArrow(S.frugal(_cross_links(percent)), "a long, b long"))
    S.drop(records)
    return links.unionByName(more)


def _blocks(listed: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of the classes of a long list, as rows (task, one: whether the blocks are the same, own: 0 or 1, and
    the class's root and record).

    Classes of the list's largest component lie in blocks that meet only blocks of others. A block holds sizes of one band,
    which is so wide that classes more than one band apart can't reach the threshold.
    """
    by_root = listed.groupBy("token", "root").agg(F.count("*").alias("c"))
    per = by_root.groupBy("token").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("c").alias("length")).filter("roots > 1").drop("roots")
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    sided = S.looked_up(listed, per, "token", "length", inner=True).withColumn("side", (F.col("root") == F.col("main")).cast("int")).withColumn("band", band)
    shape = S.cut(sided.groupBy("token", "side", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")))
    left = shape.filter("side = 0").select("token", F.col("band").alias("band0"), F.col("blocks").alias("blocks0"))
    right = shape.select("token", "side", F.col("band").alias("band1"), F.col("blocks").alias("blocks1"))
    # each pair of bands once: others with others upwards, others with the main component both ways
    meets = left.join(right, "token").filter("(side = 0 and band1 in (band0, band0 + 1)) or (side = 1 and abs(band1 - band0) <= 1)")
    tasks = meets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks0") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)).alias("j"))
    tasks = tasks.filter("side = 1 or band1 > band0 or j >= i").withColumn("one", F.expr("side = 0 and band1 = band0 and i = j"))
    tasks = S.cut(tasks.select("token", F.col("band0"), "i", "side", "band1", "j", "one", F.xxhash64("token", "band0", "i", "side", "band1", "j").alias("task")))
    ends = tasks.select("token", F.lit(0).alias("side"), F.col("band0").alias("band"), F.col("i").alias("block"), F.lit(0).alias("own"), "one", "task").unionByName(
        tasks.filter("not one").select("token", "side", F.col("band1").alias("band"), F.col("j").alias("block"), F.lit(1).alias("own"), "one", "task")
    )
    dealt = S.looked_up(sided.drop("length"), shape.withColumn("part", F.xxhash64("token", "side", "band")).select("part", "blocks", "rows"), "part", "rows", inner=True, made=F.xxhash64("token", "side", "band"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).select("class", "root", "token", "side", "band", "block")
    return dealt.join(ends, ["token", "side", "band", "block"]).select("task", "one", "own", "class", "root").join(records.select("class", "n", "m", "bits", "tokens"), "class")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(prefix)), [len(x) for x in prefix]))
        token = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("class").take(at), batch.column("n").take(at), token], names=["class", "n", "token"])


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, class_id, component_id, first) of each row of docs(doc_id, text).

    class_id is the smallest doc_id with an equal set, component_id the smallest one reachable by links. Both are the
    row's own doc_id where the set is empty. key is a hash of doc_id and text, by which rows with one doc_id are told
    apart, and `first` is true for the row of least (doc_id, key) of each component, all equal rows, and empty sets.
    """
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(_sets(k), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_shingles long, class long, check long")
    own = S.cut(own)
    clash = own.filter("class is not null").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("class")
    odd = [r[0] for r in clash.limit(CLASHES + 1).collect()]
    if len(odd) > CLASHES:
        raise ValueError("too many different sets share a signature")
    if odd:
        own = own.withColumn("class", F.when(F.col("class").isin(odd), F.col("class").bitwiseXOR(F.col("check"))).otherwise(F.col("class")))
    links = class_links(docs, k, percent, np.array(odd, np.int64).view(np.uint64))
    S.release()
    classes = own.filter("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("copies"))
    rooted = S.cut(classes.join(components(links).withColumnRenamed("node", "class"), "class", "left"))
    S.release()
    least = S.cut(rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("reached"), F.count("*").alias("classes")))
    named = S.looked_up(rooted, least, "root", "classes").select("class", F.col("least").alias("of_class"), F.coalesce("reached", "least").alias("of_all"), "copies")
    found = S.looked_up(own.select("doc_id", "key", "n_shingles", "class"), S.cut(named), "class", "copies")
    least = lambda c: F.when(F.col(c).isNull(), F.col("doc_id")).otherwise(F.col(f"{c}.doc_id"))
    first = F.col("of_all").isNull() | F.col("of_all").eqNullSafe(F.struct("doc_id", "key"))
    return found.select("doc_id", "key", "n_shingles", least("of_class").alias("class_id"), least("of_all").alias("component_id"), first.alias("first"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "class_id", "component_id")
