"""SentencePiece encoding and decoding with seeded merge-dropout.

A BPE model of the sentencepiece library is read for its pieces and scores; the agenda is worked here, for many segments
of a batch at once in numpy: in each round every segment makes its best merge (highest score, leftmost among equals)
until none is left. With dropout, a candidate merge is skipped if a keyed hash of the seed, the document, the segment's
place in it, the two pieces and their place falls under `dropout`; a candidate is skipped always or never, so it leaves
the agenda for good. Every segment of every document has draws of its own, the same in every run. Equal segments share
their work only where none of the candidates that they meet without dropout is skipped, as their agenda is the same then.

A segment is a run of spaces with the characters up to the next one; no piece of the model crosses its end, which is
checked when the model is read. Without dropout the ids are the library's own. Characters that are no piece become byte
pieces, and so does U+2581 itself, which the library would turn into a space: decoding gives every text back.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows with equal doc_id and text are cut in
the same way; a null doc_id draws as 0; texts are cut whole, however long, one after another where they are long; extra columns stay as
they are, and where one is called ids (or text, on decoding), the result is ids_ (text_).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _spark as S
from tessella.llm import _text as X

#: The vocabulary file; a parameter of every operator.
MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 29
#: Segments that occur less often than this in a batch are cut one by one; results do not depend on it.
SHARED = 4
#: Segments of more symbols than this go through a heap one by one.
LONG = 192
CHUNK = 2 << 20
NONE = np.int64(2**62)
SPACE = "▁"


def _limit(dropout: float) -> np.uint64:
    return X.U64(min(int(dropout * 2**64), 2**64 - 1))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """Pieces of a BPE model with byte fallback, and a table of what two pieces merge to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this model has a space after another character")
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
        if not self.byte.all():
            raise ValueError("this model has no byte fallback")
        of = {names[i]: i for i in plain}
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in of.items():
            if len(s) == 1 and s != SPACE:
                self.char[ord(s)] = i
        self.space = of[SPACE]
        self.char[32] = self.space
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in range(n)], kind="stable"), kind="stable")
        pairs = [(of[s[:k]], of[s[k:]], i) for s, i in of.items() for k in range(1, len(s)) if s[:k] in of and s[k:] in of]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.rank, self.n = rank.astype(np.int64), n
        self._tables(left * n + right, made)
        self.text = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" for i in range(n)]
        for s, i in of.items():
            self.text[i] = s.replace(SPACE, " ").encode()

    def _tables(self, key: np.ndarray, made: np.ndarray) -> None:
        """Open tables of keys, each with what collided in the one before."""
        self.tables, bits = [], 20
        while len(key):
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            with np.errstate(over="ignore"):
                slot = ((key.astype(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            keys[slot[first]], values[slot[first]] = key[first], made[first]
            self.tables.append((odd, np.uint64(64 - bits), keys, values))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, made, bits = key[rest], made[rest], max(bits - 4, 8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours merge to, or -1."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.n + right)
        out = np.full(len(key), -1, np.int32)
        with np.errstate(over="ignore"):
            for odd, shift, keys, values in self.tables:
                slot = ((key.astype(np.uint64) * odd) >> shift).astype(np.int64)
                hit = keys[slot] == key
                out[hit] = values[slot[hit]]
        return out

    @staticmethod
    def _mark(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A hash of a candidate within its segment."""
        with np.errstate(over="ignore"):
            return X.mix((left.astype(np.uint64) << X.U64(40)) ^ (right.astype(np.uint64) << X.U64(20)) ^ place.astype(np.uint64) * X.STEP)

    def candidates(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, salt: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of neighbours: what they merge to (-1: nothing, or skipped) and its priority, least first."""
        made = self.merged(left, right)
        if limit:
            some = np.flatnonzero(made >= 0)
            drawn = X.mix(salt[some] ^ self._mark(left[some], right[some], place[some]))
            made[some[drawn < limit]] = -1
        return made, np.where(made >= 0, (self.rank[made] << 32) | place, NONE)

    def cut(self, symbol: np.ndarray, size: np.ndarray, salt: np.ndarray, dropout: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of segments given as runs of symbols of these sizes: (pieces one after another, number of each).

        To `met` go (segment, mark) of all candidates that come up; for segments of up to LONG symbols only.
        """
        limit = _limit(dropout)
        done_seg, done_place, done_symbol = [], [], []
        seg = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
        long = size > LONG
        start = np.cumsum(size) - size
        for s in np.flatnonzero(long).tolist():
            a = int(start[s])
            p, c = self._agenda(symbol[a : a + size[s]], salt[s], limit)
            done_seg.append(np.full(len(p), s))
            done_place.append(p)
            done_symbol.append(c)
        live = ~long[seg]
        seg, place, symbol = seg[live], place[live], symbol[live]
        made, best = self._pairs(symbol, seg, place, salt, limit, met)
        while len(seg):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            least = np.minimum.reduceat(best, first)
            width = np.diff(np.append(first, len(seg)))
            over = np.repeat(least == NONE, width)
            if over.any():
                done_seg.append(seg[over])
                done_place.append(place[over])
                done_symbol.append(symbol[over])
                go = ~over
                seg, place, symbol, made, best = seg[go], place[go], symbol[go], made[go], best[go]
                least, width = least[least != NONE], width[least != NONE]
                if not len(seg):
                    break
            at = np.flatnonzero(best == np.repeat(least, width))
            symbol[at] = made[at]
            keep = np.ones(len(seg), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            seg, place, symbol, made, best = seg[keep], place[keep], symbol[keep], made[keep], best[keep]
            for i in (at, at - 1):
                inside = (i >= 0) & (i + 1 < len(seg))
                inside[inside] = seg[i[inside]] == seg[i[inside] + 1]
                alone = i[~inside & (i >= 0)]
                best[alone] = NONE
                j = i[inside]
                made[j], best[j] = self.candidates(symbol[j], symbol[j + 1], place[j], salt[seg[j]], limit)
                self._meet(met, j, made, symbol, seg, place)
        if not done_seg:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        seg, place, symbol = np.concatenate(done_seg), np.concatenate(done_place), np.concatenate(done_symbol)
        order = np.lexsort((place, seg))
        return symbol[order], np.bincount(seg, minlength=len(size))

    def _meet(self, met, j, made, symbol, seg, place):
        if met is not None:
            j = j[made[j] >= 0]
            met.append((seg[j], self._mark(symbol[j], symbol[j + 1], place[j])))

    def _pairs(self, symbol, seg, place, salt, limit, met):
        made, best = np.full(len(symbol), -1, np.int32), np.full(len(symbol), NONE)
        j = np.flatnonzero(seg[1:] == seg[:-1])
        made[j], best[j] = self.candidates(symbol[j], symbol[j + 1], place[j], salt[seg[j]], limit)
        self._meet(met, j, made, symbol, seg, place)
        return made, best

    def _agenda(self, symbol: np.ndarray, salt: np.uint64, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """One long segment, by a heap of candidates."""
        n = len(symbol)
        symbol, after, before = symbol.copy(), list(range(1, n + 1)), list(range(-1, n - 1))
        one = np.zeros(1, np.int64)
        salts = np.full(n, salt, np.uint64)
        made, best = self.candidates(symbol[:-1], symbol[1:], np.arange(n - 1), salts[: n - 1], limit)
        heap = [(int(b), i, i + 1, int(symbol[i]), int(symbol[i + 1]), int(m)) for i, (m, b) in enumerate(zip(made.tolist(), best.tolist(), strict=True)) if m >= 0]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if gone[i] or j >= n or gone[j] or after[i] != j or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], after[i] = m, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n:
                    made, best = self.candidates(symbol[x : x + 1], symbol[y : y + 1], one + x, salts[:1], limit)
                    if made[0] >= 0:
                        heapq.heappush(heap, (int(best[0]), x, y, int(symbol[x]), int(symbol[y]), int(made[0])))
        left = np.flatnonzero(~np.array(gone))
        return left, symbol[left]

    def encode(self, data: np.ndarray, off: np.ndarray, drawn: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as UTF-8, one after another, and the number of each text's; drawn: a hash of each text's document."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        first = head[off]
        size = np.diff(first)
        # a space goes before each text
        full = size > 0
        total = len(points) + int(full.sum())
        shift = np.cumsum(full)
        start = first[:-1] + shift - full
        symbol, code = np.empty(total, np.int32), np.empty(total, np.uint32)
        own = np.ones(total, bool)
        own[start[full]] = False
        code[own], code[~own] = points, 32
        symbol[:] = self.char[code]
        space = symbol == self.space
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[start[full]] = True
        seg_at = np.flatnonzero(begins)
        seg_size = np.diff(np.append(seg_at, total))
        text = np.flatnonzero(full)[np.searchsorted(start[full], seg_at, "right") - 1]
        ordinal = np.arange(len(seg_at)) - np.searchsorted(seg_at, start)[text]
        with np.errstate(over="ignore"):
            base = X.mix(drawn + X.U64(seed) * X.STEP)
            salt = X.mix(base[text] + ordinal.astype(np.uint64))
        eight = X.eights(code.view(np.uint8))
        which, back = X.representatives(eight, 4 * seg_at, 4 * seg_size, X.run_hashes(eight, 4 * seg_at, 4 * seg_size))
        often = np.bincount(back, minlength=len(which))
        # what is no piece stands for its bytes: it keeps its code point, negative, and merges with nothing
        raw = np.where(symbol >= 0, symbol, -2 - code.astype(np.int64).astype(np.int32))
        if dropout > 0:
            shared = (often >= SHARED) & (seg_size[which] <= LONG)
            met: list = []
            pieces, count = self._cut_at(raw, seg_at, seg_size, which[shared], salt, 0.0, met)
            back = np.where(shared, np.cumsum(shared) - 1, -1)[back]
            own = np.flatnonzero(back < 0)
            like = np.flatnonzero(back >= 0)
            own = np.concatenate([own, like[self._skips(met, back[like], salt[like], dropout)]])
            back[own] = len(count) + np.arange(len(own))
            more, n_more = self._cut_at(raw, seg_at, seg_size, own, salt, dropout)
            pieces, count = np.concatenate([pieces, more]), np.concatenate([count, n_more])
        else:
            pieces, count = self._cut_at(raw, seg_at, seg_size, which, salt, 0.0)
        pieces, count = self._bytes(pieces, count)
        begin = np.cumsum(count) - count
        times = count[back]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[back], times)
        return pieces[at], np.bincount(text, times, n).astype(np.int64)

    def _cut_at(self, raw: np.ndarray, seg_at: np.ndarray, seg_size: np.ndarray, which: np.ndarray, salt: np.ndarray, dropout: float, met: list | None = None):
        """The pieces of some of the segments."""
        size = seg_size[which]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.cut(raw[place + np.repeat(seg_at[which], size)], size, salt[which], dropout, met)

    @staticmethod
    def _skips(met: list, seg: np.ndarray, salt: np.ndarray, dropout: float, step: int = 1 << 16) -> np.ndarray:
        """Of segments given by their numbers in `met`, whether any candidate there is skipped with their salts."""
        out = np.zeros(len(seg), bool)
        if not len(seg) or not met:
            return out
        limit = _limit(dropout)
        of, mark = (np.concatenate(x) for x in zip(*met, strict=True))
        mark = mark[np.argsort(of, kind="stable")]
        n = np.bincount(of, minlength=int(seg.max()) + 1)
        begin = np.cumsum(n) - n
        for a in range(0, len(seg), step):
            own, times = seg[a : a + step], n[seg[a : a + step]]
            first = np.concatenate([[0], np.cumsum(times)])
            at = np.arange(first[-1]) + np.repeat(begin[own] - first[:-1], times)
            out[a : a + step] = X.sums(X.mix(np.repeat(salt[a : a + step], times) ^ mark[at]) < limit, first) > 0
        return out

    def _bytes(self, pieces: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, count
        u, back = np.unique(-2 - pieces[odd], return_inverse=True)
        as_bytes = [self.byte[np.frombuffer(chr(c).encode(), np.uint8)] for c in u.tolist()]
        length = np.ones(len(pieces), np.int64)
        length[odd] = np.array([len(x) for x in as_bytes])[back]
        out = np.repeat(pieces, length)
        at = (np.cumsum(length) - length)[odd]
        for j in range(4):
            has = length[odd] > j
            out[at[has] + j] = np.array([x[min(j, len(x) - 1)] for x in as_bytes])[back[has]]
        seg = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(seg, length, len(count)).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The text that was encoded, as UTF-8."""
        return b"".join([self.text[i] for i in ids])[1:]


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def _drawn(batch: pa.RecordBatch) -> np.ndarray:
    return X.mix(np.asarray(batch.column("id").fill_null(0), np.int64).view(np.uint64) + X.U64(1))


def _encoded(path: str, dropout: float, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            data, off = X.utf8(batch.column("text"))
            drawn = _drawn(batch)
            for a, b, d, o in X.chunks(data, off, CHUNK):
                ids, count = model.encode(d, o, drawn[a:b], dropout, seed)
                ends = np.concatenate([[0], np.cumsum(count)])
                rows = batch.slice(a, b - a)
                if not digest:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([rows.column("row"), lists], names=["row", "ids"])
                    S.trim()
                    continue
                crc, whole, buffer, values = [], [], d.tobytes(), ids.astype("<u4")
                for i in range(b - a):
                    own = values[ends[i] : ends[i + 1]]
                    crc.append(zlib.crc32(own.tobytes()))
                    whole.append(model.decode(own.tolist()) == buffer[o[i] : o[i + 1]])
                n_bytes = pa.array(np.diff(o), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("row"), n_bytes, pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(whole, pa.bool_())], names=["row", "n_bytes", "n_tokens", "ids_crc32", "lossless"])
                S.trim()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")


def encode(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Every column of docs but text, and ids array<int> (ids_ where they have ids): the text's pieces. With dropout 0, the library's own."""
    rows = _rows(docs)
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    out = rows.mapInArrow(_encoded(path or model_path(), dropout, seed, False), schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text"], F.col("ids").alias(S.free(docs.columns, "ids")))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Every column but ids, and text; null ids give the empty text."""
    kept = [c for c in encoded.columns if c != "ids"]
    rows = encoded.select(F.struct(*kept).alias("row"), "ids")
    out = rows.mapInArrow(_decoded(path or model_path()), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("text").alias(S.free(kept, "text")))


def digests(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(row, n_bytes, n_tokens, ids_crc32, lossless): what encoding and decoding each text gave."""
    rows = _rows(docs)
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "ids_crc32")], T.StructField("lossless", T.BooleanType())])
    return rows.mapInArrow(_encoded(path or model_path(), dropout, seed, True), schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs).select("row.doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless")
