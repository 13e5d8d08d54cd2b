"""A compressed FM-index over integer sequences: packed wavelet matrix with
block ranks, backward search, and a range minimum over owners."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; suffixes that differ sort within log2(length of the
    longest repeat) rounds."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """``text`` holds symbols from 1 up; symbols below ``first`` are separators,
    each used once, and never searched.  ``owner`` gives every position a rank;
    searches keep to occurrences of smaller owners."""

    def __init__(self, text: np.ndarray, first: int, owner: np.ndarray):
        n = len(text)
        sa = suffix_array(text)
        symbol = np.where(text < first, 0, text - first + 1)
        self.n, self.sigma = n, int(symbol.max()) + 1
        counts = np.bincount(symbol, minlength=self.sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        bwt = symbol[sa - 1]
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.bits, self.blocks, self.zeros = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])
        every = np.arange(self.sigma)
        self.origin = self._descend(every, np.zeros(self.sigma, np.int64))
        table = [owner[sa].astype(np.int32)]
        while 2 << len(table) - 1 <= n:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.smallest = table
        self.log = np.zeros(n + 2, np.int8)
        self.log[1:] = np.floor(np.log2(np.arange(1, n + 2))).astype(np.int8)
        width = len(table[0])
        self.flat = np.full((len(table), width), np.iinfo(np.int32).max, np.int32)
        for k, t in enumerate(table):
            self.flat[k, : len(t)] = t
        self.smallest = None

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            at = i >> 6
            ones = self.blocks[level][at] + np.bitwise_count(self.bits[level][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where(c >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix intervals of ``c`` + pattern."""
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        shift = self.before[c] - self.origin[c]
        return shift + both[: len(c)], shift + both[len(c) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in each non-empty suffix interval."""
        k = self.log[hi - lo].astype(np.int64)
        return np.minimum(self.flat[k, lo], self.flat[k, hi - (1 << k)])


def repeated_windows(passages: list[np.ndarray], owners: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """``(passage, first start, last start)`` of the windows of each passage that
    also occur in a passage of a smaller owner.

    Passages are streamed against the index of all of them, many at once.  A
    test reads backward from the end of a range's first window.  Where it fails,
    no window over the failing string occurs and the range begins anew behind
    its first symbol.  Where it reaches the start, the rest of the range is
    tested as one string, and what is left of that is tested again.
    """
    if not passages:
        return []
    sizes = np.array([len(p) for p in passages])
    words = np.concatenate(passages)
    _, ids = np.unique(words, return_inverse=True)
    m = len(passages)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.empty(int(sizes.sum()) + m, np.int64)
    ends = base + sizes
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = ids + m + 1
    text[ends] = np.arange(1, m + 1)
    rank = np.unique(owners, return_inverse=True)[1]
    index = FmIndex(text, m + 1, np.repeat(rank, sizes + 1))
    symbol = text - m

    found: list[tuple[int, int, int]] = []
    use = np.flatnonzero(sizes >= window)
    p, a, b = use, np.zeros(len(use), np.int64), (sizes[use] - window).astype(np.int64)
    whole = np.zeros(len(use), bool)
    while len(p):
        # one test per lane; lanes drop out as they are decided
        right = np.where(whole, b, a) + window - 1
        j = right.copy()
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), index.n)
        live = np.arange(len(p))
        while len(live):
            l2, h2 = index.extend(symbol[base[p[live]] + j[live]], lo[live], hi[live])
            ok = h2 > l2
            ok[ok] = index.least_owner(l2[ok], h2[ok]) < rank[p[live[ok]]]
            live, l2, h2 = live[ok], l2[ok], h2[ok]
            lo[live], hi[live] = l2, h2
            j[live] -= 1
            live = live[j[live] >= a[live]]
        hit = j < a
        # a lane that did not reach its start failed on reading position j
        done = hit & whole
        found += zip(p[done].tolist(), a[done].tolist(), b[done].tolist(), strict=True)
        start = hit & ~whole
        found += zip(p[start].tolist(), a[start].tolist(), a[start].tolist(), strict=True)
        part = ~hit & whole & (j < b)
        found += zip(p[part].tolist(), (j[part] + 1).tolist(), b[part].tolist(), strict=True)
        nxt = [
            (p[start], a[start] + 1, b[start], np.ones(int(start.sum()), bool)),
            (p[part], a[part], j[part], np.zeros(int(part.sum()), bool)),
        ]
        tail = ~hit & whole & (j >= b)
        nxt.append((p[tail], a[tail], b[tail] - 1, np.zeros(int(tail.sum()), bool)))
        skip = ~hit & ~whole
        nxt.append((p[skip], j[skip] + 1, b[skip], np.zeros(int(skip.sum()), bool)))
        p, a, b, whole = (np.concatenate([x[i] for x in nxt]) for i in range(4))
        keep = a <= b
        p, a, b, whole = p[keep], a[keep], b[keep], whole[keep]
    return found
