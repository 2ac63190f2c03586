"""FM-index over sequences of small whole numbers: wavelet matrix, backward search, numpy throughout."""

import numpy as np


class WaveletMatrix:
    """Bit-packed levels of a sequence; rank of any symbol before any position, for arrays of both."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        self.bits = max(1, int(top).bit_length())
        values = values.astype(np.int64)
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int32)
            self.levels.append((shift, words, before, int((~bit).sum())))
            values = np.concatenate([values[~bit], values[bit]])

        # Where each symbol's places begin on the last level.
        self.base = self._follow(np.arange(int(top) + 1), np.zeros(int(top) + 1, dtype=np.int64))

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._follow(symbols, positions) - self.base[symbols]

    def _follow(self, symbols, at):
        for shift, words, before, zeros in self.levels:
            ones = self._ones(words, before, at)
            at = np.where(symbols >> shift & 1, ones + zeros, at - ones)
        return at

    @staticmethod
    def _ones(words, before, at):
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)


class FMIndex:
    """Index of several sequences of symbols 1..top, searched by all sequences of one length at once."""

    def __init__(self, sequences: list[np.ndarray], top: int):
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes + 1) - 1  # where each sequence's end mark stands
        text = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.int64)
        body = np.ones(len(text), dtype=bool)
        body[ends] = False
        text[body] = np.concatenate(sequences) if sequences else []
        self.text, self.starts = text, ends - sizes
        self.sequence = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.suffixes = self._sorted(text, ends)
        self.bwt = WaveletMatrix(text[self.suffixes - 1], top)
        # Suffixes that begin with an end mark come first, one per sequence.
        counts = np.bincount(text[body], minlength=top + 2)
        self.first = len(ends) + np.r_[0, np.cumsum(counts)[:-1]]

    @staticmethod
    def _sorted(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; end marks are all different, so suffixes end at theirs."""
        n = len(text)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step, bits = 1, int(rank.max(initial=0) + 1).bit_length()
        if 3 * bits < 64:  # three symbols fit into one number
            padded = np.r_[rank + 1, 0, 0]
            rank = rank << 2 * bits | padded[1:-1] << bits | padded[2:]
            step = 3
        while True:
            rank = np.unique(rank, return_inverse=True)[1]
            if rank.max(initial=-1) == n - 1 or step >= 2 * n:
                break
            follow = np.zeros(n, dtype=np.int64)
            follow[:-step] = rank[step:] + 1
            rank = rank * (n + 1) + follow
            step *= 2
        return np.argsort(rank)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the rows of `patterns`, by backward search."""
        n = len(patterns)
        at = np.repeat(np.array([0, len(self.text)], dtype=np.int64), n)  # both ends in one pass
        for column in patterns.T[::-1]:
            column = np.tile(column, 2)
            at = self.first[column] + self.bwt.rank(column, at)
        return at[:n], at[n:]

    def least(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least of `values` (one per sequence) over the occurrences in each interval; intervals must be equal or apart."""
        at, back = np.unique(low, return_inverse=True)
        upto = np.zeros(len(at), dtype=np.int64)
        upto[back] = high
        own = values[self.sequence[self.suffixes]]
        cuts = np.stack([at, upto], 1).ravel()
        padded = np.r_[own, own[-1:]]
        return np.minimum.reduceat(padded, cuts)[::2][back] if len(at) else np.zeros(0, dtype=values.dtype)
