"""Ids of a byte-level BPE tokenizer of the tokenizers library, for whole batches of texts.

The tokenizer cuts a text by a fixed pattern (contractions, letters, digits, other signs, white space) and merges within
each part. Parts are found here in numpy by the classes of their characters, and each distinct part goes to the library
once, so that the ids are the library's own. Parts are remembered by hashes, and their characters are compared wherever
hashes agree, so a part never gets the ids of another. A text with a character outside the ranges below goes to it as a whole, and
so does one with the literal of an added token, unless literals count as plain text.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from tessella.llm import _text as X

FILE = "byte_bpe_50k.json"
#: Ranges of code points whose classes are the same in all versions of Unicode that matter here.
SAFE = ((0x00, 0x250), (0x370, 0x374), (0x384, 0x530), (0x2010, 0x2028), (0x2030, 0x205F))
LIMIT = 0x2060
#: Fixed value: white space.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
OTHER, LETTER, NUMBER, SPACE, UNSAFE = range(5)
#: Fixed value of the pattern: what follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct parts that a worker remembers.
REMEMBER = 2_000_000


def _classes() -> np.ndarray:
    out = np.full(LIMIT + 1, UNSAFE, np.uint8)
    for a, b in SAFE:
        for c in range(a, b):
            kind = unicodedata.category(chr(c))
            out[c] = UNSAFE if kind == "Cn" else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    for c in WHITE:
        out[c] = SPACE
    return out


class Encoder:
    def __init__(self, path: str, plain: bool = True):
        """plain: literals of added tokens are plain text, the library's `encode_special_tokens`."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.literals = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size()
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.at, self.size, self.begin, self.length = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.ids, self.used = np.zeros(1 << 14, np.int32), 0
        self.text, self.filled = np.zeros(1 << 15, np.uint16), 0

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the parts of the texts begin."""
        n = len(points)
        kind = self.classes[points]
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        run = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]) | edge[:n])
        end = np.append(run[1:], n)
        is_space = kind[run] == SPACE
        last = np.zeros(len(run), bool)  # of its text
        last[:-1] = edge[run[1:]]
        last[-1] = True
        blank = points[end - 1] == 32
        begins = np.zeros(n + 1, bool)
        begins[run[~is_space]] = True
        s = np.flatnonzero(is_space)
        joins = s[~last[s] & blank[s]]
        begins[run[s]] = True
        begins[end[joins] - 1] = True
        begins[end[joins]] = False
        split = s[~last[s] & ~blank[s]]
        begins[end[split] - 1] = True
        # contractions: a lone apostrophe that no space is joined to, before letters of its text
        lone = np.flatnonzero((points[run] == 39) & (end - run == 1) & ~last & begins[run])
        lone = lone[lone + 1 < len(run)]
        lone = lone[kind[run[lone + 1]] == LETTER]
        if len(lone):
            p, stop = run[lone] + 1, end[lone + 1]
            a, b = points[p], np.where(p + 1 < stop, points[np.minimum(p + 1, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in CONTRACTIONS if len(c) == 1])
            two = np.zeros(len(lone), bool)
            for c in CONTRACTIONS:
                if len(c) == 2:
                    two |= (a == ord(c[0])) & (b == ord(c[1]))
            size = np.where(one, 1, np.where(two, 2, 0))
            hit = size > 0
            begins[p[hit]] = False
            rest = hit & (p + size < stop)
            begins[p[rest] + size[rest]] = True
        return np.flatnonzero(begins[:n])

    def _learn(self, keys: np.ndarray, parts: list[str], points: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Remembers the ids of new parts, whose characters are given too, and returns their entries."""
        found = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total, k, n = int(size.sum()), self.count, len(keys)
        while k + n > len(self.at):
            self.at, self.size, self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.begin, self.length))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.filled + len(points) + 4 > len(self.text):  # a block may be read beyond the last part
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.size[k : k + n], self.length[k : k + n] = size, length
        self.at[k : k + n] = self.used + np.cumsum(size) - size
        self.begin[k : k + n] = self.filled + np.cumsum(length) - length
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.text[self.filled : self.filled + len(points)] = points
        self.used, self.filled, self.count = self.used + total, self.filled + len(points), k + n
        held, entry = np.concatenate([self.keys, keys]), np.arange(k, k + n, dtype=np.int32)
        order = np.argsort(held, kind="stable")  # two runs in order, or nearly so
        self.keys, self.entry = held[order], np.concatenate([self.entry, entry])[order]
        return entry

    def _known(self, keys: np.ndarray, eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of parts given by their keys and bytes, and which of them are known; equal keys alone do not count."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        entry = self.entry[at]
        known = (self.keys[at] == keys) & (2 * self.length[entry] == length)
        held = self.text.view(np.uint8)
        held = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
        i = np.flatnonzero(known)
        known[i[X.unlike(eight, start[i], 2 * self.begin[entry[i]], length[i], held)]] = False
        return entry, known

    def _with_literals(self, whole: str, first: np.ndarray) -> np.ndarray:
        """Of each text, whether a literal begins in it."""
        out = np.zeros(len(first) - 1, bool)
        for literal in self.literals:
            at = whole.find(literal)
            while at >= 0:
                i = int(np.searchsorted(first, at, "right")) - 1
                out[i] = True
                at = whole.find(literal, int(first[i + 1]))
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as UTF-8, one text after another, and the number of each text's."""
        n = len(off) - 1
        whole = data.tobytes().decode("utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        first = head[off]
        points = np.minimum(points, np.uint32(LIMIT))
        odd = np.flatnonzero((X.sums(self.classes[points] == UNSAFE, first) > 0) | self._with_literals(whole, first))
        own = {}
        if len(odd):
            texts = [whole[first[i] : first[i + 1]] for i in odd.tolist()]
            own = {i: np.array(e.ids, np.int32) for i, e in zip(odd.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
            keep = np.ones(n, bool)
            keep[odd] = False
            mask = np.repeat(keep, np.diff(first))
            points = points[mask]
            size = np.where(keep, np.diff(first), 0)
            whole = "".join(whole[first[i] : first[i + 1]] for i in np.flatnonzero(keep).tolist())
            first = np.concatenate([[0], np.cumsum(size)])
        if len(points):
            start = self._starts(points, first)
            size = np.diff(np.append(start, len(points)))
            points = points.astype(np.uint16)
            eight, begin, width = X.eights(points.view(np.uint8)), 2 * start, 2 * size
            key = X.run_hashes(eight, begin, width)
            which, back = X.representatives(eight, begin, width, key)
            entry, known = self._known(key[which], eight, begin[which], width[which])
            if not known.all() and self.count + len(which) - int(known.sum()) > REMEMBER:
                self._forget()
                known[:] = False
            if not known.all():
                new = which[~known]
                at, n_points = start[new], size[new]
                place = np.arange(n_points.sum()) + np.repeat(at - (np.cumsum(n_points) - n_points), n_points)
                entry[~known] = self._learn(key[new], [whole[a:b] for a, b in zip(at.tolist(), (at + n_points).tolist(), strict=True)], points[place], n_points)
            entry = entry[back]
            times = self.size[entry]
            place = np.arange(times.sum()) + np.repeat(self.at[entry] - (np.cumsum(times) - times), times)
            ids = self.ids[place]
            count = X.sums(times, np.searchsorted(start, first))
        else:
            ids, count = np.zeros(0, np.int32), np.zeros(n, np.int64)
        if own:
            split = np.split(ids, np.cumsum(count)[:-1])
            parts = [own.get(i, split[i]) for i in range(n)]
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, count


@lru_cache(maxsize=2)
def load(path: str, plain: bool = True) -> Encoder:
    return Encoder(path, plain)
