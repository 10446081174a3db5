"""FM-index over a sequence of small integers, in numpy; all queries are answered in bulk."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector with running counts per bit of the alphabet, highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ones[at + 1] - ones[at] > 0
            symbol = symbol * 2 + up
            at = np.where(up, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; a suffix that ends first comes first."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        fresh = np.empty(n, dtype=np.int64)
        ordered = key[order]
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Burrows-Wheeler transform of `symbols` (each at least 1), ranks by a wavelet tree, every `step`-th suffix position kept."""

    def __init__(self, symbols: np.ndarray, step: int = 8):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_array(text)
        last = text[order - 1]
        alphabet = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])  # symbols smaller than each
        self.tree = WaveletTree(last, max(1, int(alphabet - 1).bit_length()))
        self.alphabet, self.size = alphabet, len(text)
        self.sampled = order % step == 0
        self.slot = np.concatenate([[0], np.cumsum(self.sampled)])
        self.kept = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: rows [low, high) whose suffixes begin with each.

        `phrases` is a matrix padded on the left; symbols outside the alphabet end a phrase's search.
        """
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            go = np.flatnonzero((width - k <= lengths) & (high > low))
            if not len(go):
                continue
            symbol = phrases[go, k]
            known = (symbol > 0) & (symbol < self.alphabet)
            safe = np.where(known, symbol, 0)
            base = self.before[safe]
            low[go], high[go] = (np.where(known, base + self.tree.rank(safe, low[go]), 0),
                                 np.where(known, base + self.tree.rank(safe, high[go]), 0))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a kept position and count the steps."""
        rows = rows.copy()
        out = np.full(len(rows), -1, dtype=np.int64)
        walked = 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.kept[self.slot[at[done]]] + walked
            open_ = open_[~done]
            at = at[~done]
            symbol = self.tree.access(at)
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, at)
            walked += 1
        return out
