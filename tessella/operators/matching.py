"""Matching one after another on points, so that no table of pairs is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Points of a leaf at most.
LEAF = 512
_NONE = np.iinfo(np.int64).max


def _length(x: np.ndarray) -> np.ndarray:
    """Of each row, summed in the order of the columns, as Spark and SQL do."""
    s = x[:, 0] * x[:, 0]
    for c in range(1, x.shape[1]):
        s = s + x[:, c] * x[:, c]
    return np.sqrt(s)


class Pool:
    """Points of numbered owners (ascending), from which owners are taken; nearest() looks into leaves of near points only."""

    def __init__(self, owner: np.ndarray, points: np.ndarray) -> None:
        self.free = np.ones(int(owner[-1]) + 1, bool)
        self.left = len(self.free)
        self.leaves, todo = [], [np.arange(len(owner))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append((owner[at], points[at]))
                continue
            part = points[at]
            order = np.argsort(part[:, np.ptp(part, axis=0).argmax()], kind="stable")  # equal points stay in order of owners
            todo += [np.sort(at[order[len(at) // 2 :]]), np.sort(at[order[: len(at) // 2]])]
        self._boxes()

    def _boxes(self) -> None:
        self.low, self.high = (np.array([f(x, axis=0) for _, x in self.leaves]) for f in (np.min, np.max))
        self.first, self.empty = np.array([own[0] for own, _ in self.leaves]), 0

    def _shrink(self, j: int, free: np.ndarray) -> None:
        """Leaf j loses what has been taken; empty leaves are out of reach."""
        own, points = self.leaves[j] = tuple(x[free] for x in self.leaves[j])
        if len(own):
            self.low[j], self.high[j], self.first[j] = points.min(axis=0), points.max(axis=0), own[0]
        else:
            self.low[j], self.high[j], self.empty = np.inf, -np.inf, self.empty + 1

    def take(self, owner: int) -> None:
        self.free[owner] = False
        self.left -= 1

    def nearest(self, p: np.ndarray, best: tuple[float, int]) -> tuple[float, int]:
        """(distance, owner) of the free point nearest to p, ties to the smaller owner; best, if none is before it."""
        if self.left and self.empty * 2 > len(self.leaves):
            self.leaves = [x for x in self.leaves if len(x[0])]
            self._boxes()
        # rounding keeps order, so no point of a leaf is nearer than its box, and none has a smaller owner than its first
        bound = _length(np.maximum(np.maximum(self.low - p, p - self.high), 0.0))
        near = np.flatnonzero(bound <= best[0])
        for j in near[np.lexsort((self.first[near], bound[near]))].tolist() if self.left else ():
            if (bound[j], self.first[j]) > best:
                break
            own, points = self.leaves[j]
            free = self.free[own]
            d = _length(p - points)
            d[~free] = np.inf
            i = d.argmin()
            if free[i]:
                best = min(best, (float(d[i]), int(own[i])))
            if 2 * np.count_nonzero(free) <= len(own):
                self._shrink(j, free)
        return best


class Greedy:
    """Gives each positive in order of its key the nearest negative within the caliper that is not yet taken.

    Rows are (root, side, key, features) in order of root, side (0: negatives) and key. The negatives of one root are held
    as points, its positives go by as a stream. A key with several rows is one case: it has all of its points.
    """

    def __init__(self, caliper: float) -> None:
        self.caliper = caliper

    def _start(self, held: list[pa.RecordBatch]) -> tuple[Pool, pa.ChunkedArray]:
        rows = pa.Table.from_batches(held)
        key = rows.column(2)
        new = np.ones(len(key), bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()
        return Pool(np.cumsum(new) - 1, _points(rows)), key.filter(pa.array(new))

    def match(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (float(self.caliper), _NONE)
        root, held, pool, keys, now, best, found = None, [], None, None, None, none, []

        def settle() -> None:
            nonlocal best
            if best[1] != _NONE:
                pool.take(best[1])
                found.append((now, *best))
                best = none

        def out() -> pa.RecordBatch:
            nonlocal found
            done, found = found, []
            p, d, n = zip(*done, strict=True)
            n = keys.take(pa.array(n, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(p, keys.type), n, pa.array(d, pa.float64())], ["positive", "negative", "distance"])

        for run in (run for b in batches for run in _runs(b)):
            if (of := run.column(0)[0].as_py()) != root:
                settle()
                if found:
                    yield out()
                root, held, pool, now = of, [], None, None
            if run.column(1)[0].as_py() == 0:
                held.append(run)
                continue
            if pool is None and held:
                (pool, keys), held = self._start(held), []
            if pool is None:
                continue
            for key, p in zip(run.column(2).to_pylist(), _points(run), strict=True):
                if key != now:
                    settle()
                    now = key
                best = pool.nearest(p, best) if pool.left else best
            if len(found) >= 10_000:
                yield out()
        settle()
        if found:
            yield out()


def _points(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([c.to_numpy() for c in rows.columns[3:]])


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of one root and side."""
    n = b.num_rows
    if not n:
        return
    new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]]
    edges = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), n]
    for i, j in zip(edges, edges[1:], strict=False):
        yield b.slice(i, j - i)
