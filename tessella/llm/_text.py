"""Words, lines and hashes of whole texts, for many texts at once, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. All of these are single bytes in UTF-8, so texts are
never decoded. Hashes are 64 bits wide, taken from blocks of eight bytes that are each mixed with their place, so that
no structure of a text makes them collide; two of them with different `kind` are independent. Where texts are at hand,
equal hashes only propose that runs are equal, and unlike() compares their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x7E55E11A)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = U64(0x9E3779B97F4A7C15)
#: Independent hashes differ by these.
KIND = _RNG.integers(1, 2**63, 2, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of a block that begin a run of so many bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Runs of more blocks than this are taken one after another.
_BLOCKS = 64
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()  # the texts themselves are not copied
    width = np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64
    off = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows, each of about `size` bytes or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words:
    """Words of a run of texts: `start`, `end` (byte places), `first` (of each text, the place of its first word; one more at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        ws = spaces(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        inside = ~ws
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = ws[:-1], ws[1:]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.inside = inside

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each word's bytes; with `lower`, of those with A-Z in lower case."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        return run_hashes(eights(data), self.start, self.end - self.start)

    def ids(self) -> np.ndarray:
        """A number of each word: words have the same one if and only if their bytes are equal."""
        return alike(eights(self.data), self.start, self.end - self.start, self.hashes())

    def points(self) -> np.ndarray:
        """Code points of each word."""
        head = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=head[1:])
        return head[self.end] - head[self.start]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def run_hashes(eight: np.ndarray, start: np.ndarray, length: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of each run of bytes: a sum over its blocks, each mixed with its place in the run."""
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64) * KIND[kind]
        at, j = np.arange(len(start)), 0
        while len(at) and j < _BLOCKS:
            left = length[at] - 8 * j
            total[at] += mix((eight[start[at] + 8 * j] & _FIRST[np.minimum(left, 8)]) + KIND[kind] * U64(j + 1))
            at = at[left > 8]
            j += 1
        for i in at.tolist():
            place = np.arange(8 * j, int(length[i]), 8)
            block = eight[int(start[i]) + place] & _FIRST[np.minimum(int(length[i]) - place, 8)]
            total[i] += mix(block + KIND[kind] * (place // 8 + 1).astype(np.uint64)).sum(dtype=np.uint64)
        return mix(total ^ KIND[1 - kind])


def unlike(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Of pairs of runs of one length, whether any of their bytes differ; the second ones lie in `other` if that is given."""
    out, to = np.zeros(len(a), bool), eight if other is None else other
    at, j = np.flatnonzero((a != b) & (length > 0)) if other is None else np.flatnonzero(length > 0), 0
    while len(at) and j < _BLOCKS:
        left = length[at] - 8 * j
        bad = ((eight[a[at] + 8 * j] ^ to[b[at] + 8 * j]) & _FIRST[np.minimum(left, 8)]) != 0
        out[at[bad]] = True
        at = at[~bad & (left > 8)]
        j += 1
    for i in at.tolist():
        place = np.arange(0, int(length[i]), 8)
        out[i] = bool(((eight[int(a[i]) + place] ^ to[int(b[i]) + place]) & _FIRST[np.minimum(int(length[i]) - place, 8)]).any())
    return out


def representatives(eight: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the list of one run of each kind, the number of each run's kind); runs are of a kind if and only if their bytes are equal.

    Equal keys propose kinds. Runs that differ from the one that stands for their key are told apart by their bytes.
    """
    _, which, back = np.unique(key, return_index=True, return_inverse=True)
    like = which[back]
    odd = length != length[like]
    odd |= unlike(eight, start, start[like], np.where(odd, 0, length))
    odd = np.flatnonzero(odd)
    if len(odd):
        buffer = np.asarray(eight.base).tobytes()
        known: dict[bytes, int] = {}
        for i in odd.tolist():
            back[i] = known.setdefault(buffer[start[i] : start[i] + length[i]], len(which) + len(known))
        _, first = np.unique(back[odd], return_index=True)
        which = np.concatenate([which, odd[first]])
    return which, back


def alike(eight: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    return representatives(eight, start, length, key)[1]


def grams(h: np.ndarray, k: int, stride: int = 1) -> np.ndarray:
    """A hash of each k values in a row (`stride` places apart), by halves: every step mixes, so that none is linear in the values."""
    if k == 1:
        return h
    x, a = (grams(h, k - 1, stride), k - 1) if k % 2 else (grams(h, k // 2, stride), k // 2)
    n = len(h) - (k - 1) * stride
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(x[:n] * STEP + (h if k % 2 else x)[a * stride : a * stride + n])


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words within one text, and the place of each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= k)
    return grams(h, k)[at], at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Of each key, whether it occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        hit = np.zeros(len(k), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[order[hit]] = True
    return out


def covered(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Of n places, whether one of the intervals [start, start + width) holds it."""
    if not len(start):
        return np.zeros(n, bool)
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + width, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, where row i has the values first[i] to first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
