"""Suffix sorting by the deep-shallow method, for suffixes that start in groups and end at their own limit.

Shallow: multikey quicksort whose character is seven bytes. Every segment of suffixes that agree so far picks a pivot, the
median of three drawn characters, and parts into those below, equal and above; the equal ones go on at the next character,
up to `SHALLOW` bytes. All segments of all groups are parted in the same step. Deep: what still agrees there goes through
a blind trie for each group; a suffix goes down by the branching bytes alone, is compared with one leaf, and enters at the
first place of difference.
"""

from __future__ import annotations

import numpy as np

CHARACTER, SHALLOW = 7, 28


def _characters(text: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next seven bytes of each suffix and how many of them there are, as one number; an end comes before any byte."""
    out = np.zeros(len(start), np.uint64)
    have = np.clip(left, 0, CHARACTER)
    for j in range(CHARACTER):
        byte = text[np.minimum(start + j, len(text) - 1)]
        out = (out << np.uint64(8)) | np.where(have > j, byte, 0).astype(np.uint64)
    return (out << np.uint64(8)) | have.astype(np.uint64)


def _common(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of the strings; equal ones stay together."""
    same: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        same.setdefault(s, []).append(i)
    u = list(same)
    if not u:
        return []
    root: list | int = 0  # a node: [place of the branch, child by byte (-1: the end), a leaf]; or a leaf
    for i in range(1, len(u)):
        s = u[i]
        node = root
        while type(node) is list:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1, node[2])
        at = _common(s, u[node])
        leaf, above, node = node, None, root
        while type(node) is list and node[0] < at:
            above, node = node, node[1][s[node[0]]]
        c = s[at] if at < len(s) else -1
        if type(node) is list and node[0] == at:
            node[1][c] = i
            continue
        t = u[leaf]
        new = [at, {(t[at] if at < len(t) else -1): node, c: i}, leaf]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        if type(node) is list:
            rest.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out += same[u[node]]
    return out


def _quicksort(text: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray, first: np.ndarray) -> None:
    """Parts the segments that `first` begins until each has suffixes that agree in SHALLOW bytes, or one suffix."""
    begin = np.flatnonzero(first)
    size, depth, draw = np.diff(np.append(begin, len(order))), np.zeros(len(begin), np.int64), np.random.default_rng(len(order))
    while True:
        go = (size > 1) & (depth < SHALLOW)
        begin, size, depth = begin[go], size[go], depth[go]
        if not len(begin):
            return
        of = np.repeat(np.arange(len(begin)), size)
        base = np.cumsum(size) - size
        at = np.arange(len(of)) + np.repeat(begin - base, size)
        i = order[at]
        c = _characters(text, start[i] + depth[of], length[i] - depth[of])
        x, y, z = (c[base + (draw.random(len(size)) * size).astype(np.int64)] for _ in range(3))
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[of]
        part = 3 * of + 1 + (c > pivot) - (c < pivot)
        order[at] = i[np.argsort(part, kind="stable")]
        size = np.bincount(part, minlength=3 * len(begin))
        begin = np.repeat(begin, 3) + np.cumsum(size) - size - np.repeat(base, 3)
        depth = np.repeat(depth, 3)
        depth[1::3] += CHARACTER
        first[begin[size > 0]] = True


def sort(text: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes text[start : start + length] within their groups, groups in order; and of each place in
    it the common prefix with the place before, -1 at a group's first."""
    n = len(start)
    order = np.argsort(group, kind="stable")
    first = np.ones(n, bool)
    first[1:] = group[order][1:] != group[order][:-1]
    head = first.copy()
    _quicksort(text, start, length, order, first)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    buffer = text.tobytes()
    for a, m in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        i = order[a : a + m]
        deep = i[length[i] > SHALLOW]
        by = blind_trie([buffer[s + SHALLOW : s + k] for s, k in zip(start[deep].tolist(), length[deep].tolist(), strict=True)])
        order[a : a + m] = np.concatenate([i[length[i] <= SHALLOW], deep[by]])
    return order, _prefixes(text, start, length, order, head)


def _prefixes(text: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    lcp = np.full(len(order), -1, np.int64)
    at = np.flatnonzero(~head)
    for lo in range(0, len(at), 16384):
        p = at[lo : lo + 16384]
        a, b = order[p - 1], order[p]
        most = np.minimum(length[a], length[b])
        lcp[p] = most
        todo, depth = np.arange(len(p)), 0
        while len(todo):
            step = np.arange(depth, depth + 32)
            x = text[np.minimum(start[a[todo], None] + step, len(text) - 1)] != text[np.minimum(start[b[todo], None] + step, len(text) - 1)]
            hit = x.any(axis=1)
            found = depth + x.argmax(axis=1)
            lcp[p[todo[hit]]] = np.minimum(found[hit], most[todo[hit]])
            depth += 32
            todo = todo[~hit & (most[todo] > depth)]
    return lcp
