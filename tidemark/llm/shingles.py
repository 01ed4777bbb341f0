"""Shingle sets and their parity sketches (helpers of the n-gram Jaccard join)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import mix, row_slices, split_words, utf8, window_hash

_U = np.uint64


def shingle_sets(column, size: int):
    """(first, shingles): the distinct shingles of row r are ``shingles[first[r]:first[r + 1]]``,
    sorted.  Words are lower-cased (A-Z) runs of non-space bytes; a text with fewer words than
    ``size`` (but some) has its whole sequence as its one shingle."""
    data, off = utf8(column)
    sets, counts = [], []
    for lo, hi in row_slices(off):
        w = split_words(data, off, lo, hi, lower=True)
        n = w.count
        rows, hashes = [], []
        for width in range(1, size + 1):
            h = window_hash(w.hash, width, seed=3)
            r = w.row[: len(h)]
            if width < size:
                at = w.first[:-1][n == width]
            else:
                at = np.flatnonzero(r == w.row[width - 1 :]) if len(h) else np.zeros(0, np.int64)
            rows.append(w.row[at])
            hashes.append(h[at] if len(h) else np.zeros(0, np.uint64))
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort([h, row])
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        sets.append(h[new])
        counts.append(np.bincount(row[new], minlength=hi - lo))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return first.astype(np.int64), (np.concatenate(sets) if sets else np.zeros(0, np.uint64))


class Bands:
    """Size bands of a Jaccard threshold ``num / den``.

    A pair belongs to the band of its smaller set (size a).  Its intersection is at most a and at least
    the threshold times its union, so the union is at most a / t and the symmetric difference at
    most (1 - t) / t * a: ``most(k)`` is the largest such difference in band k.
    """

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("needs a threshold above 0, at most 1")
        self.num, self.den = num, den
        ratio = max(1.5, den / num)  # a partner is at most one band below
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * ratio)))
        self.low = np.array(lows, np.int64)
        self.spare = self._spare_share(ratio)

    def _spare_share(self, ratio: float) -> float:
        """Spare blocks for each block that may differ: enough for the empty blocks (which meet those of any other
        text) that the smallest sets of a band are to be expected to have, and some more."""
        if self.num == self.den:
            return 0.06
        shingles = self.num / ((self.den - self.num) * ratio)  # of the smallest set for each block that may differ
        shares = np.arange(6, 101) / 100
        enough = shares[1.15 * (1 + shares) * np.exp(-shingles / (1 + shares)) <= shares]
        return float(enough[0]) if len(enough) else 0.06  # for low thresholds none of these shares is enough

    def of(self, n):
        return np.searchsorted(self.low, n, side="right") - 1

    def most(self, k):
        return (self.den - self.num) * (self.low[np.asarray(k) + 1] - 1) // self.num

    def blocks(self, k):
        """(blocks, spare) of band k's sketch: of d + 1 + spare blocks at most d differ in a linked
        pair, so more than ``spare`` are equal."""
        d = self.most(k)
        spare = np.where(d > 0, np.ceil(self.spare * (d + 1)).astype(np.int64) + 2, 0)
        return d + 1 + spare, spare

    def of_pairs(self, n):
        """The bands in which a set of size n meets partners: its own, and the one below if a set
        there is large enough."""
        k = self.of(n)
        below = (k > 0) & (self.num * n <= self.den * (self.low[k] - 1))
        return k, below


@lru_cache
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def sketch_keys(first: np.ndarray, shingles: np.ndarray, b: Bands):
    """(row, key): the block keys of every row's parity sketches, one sketch for each band of the row."""
    return sketches(first, shingles, b)[:2]


def sketches(first: np.ndarray, shingles: np.ndarray, b: Bands):
    """(row, key, left): ``sketch_keys`` and, for each row, how many more of its keys of even and of odd bands it may
    leave out.  A key's highest bit is set in odd bands; a row has one even band and one odd at most.

    A sketch has one bit for each 32-bit value in each of its blocks; every shingle flips one bit, so
    the number of bits in which two sketches differ never exceeds the symmetric difference of the
    sets.  The sketch is sparse and kept by blocks: a block's value is the XOR of a hash of each set
    bit (a bit flipped twice cancels).  The key is the block's value with its band and place.

    Blocks without a set bit say nothing: they are alike in unrelated texts, and their keys' buckets grow with the
    number of texts.  A row leaves its first ``spare`` empty blocks out.  At most d blocks of a linked pair
    differ, so more than ``spare`` are equal.  If one of these has a set bit, both rows keep it; else all are empty in
    both, and the last of them has ``spare`` others before it in either row, so both keep that.

    The same holds for any order of blocks and their values, say the empty ones first and then the rest by how many
    texts have their keys: the last of the equal blocks in that order has ``spare`` others before it in either row.  So
    a row with e empty blocks may also leave out the first ``spare - e`` of its other keys, in an order that is the
    same for all rows.
    """
    n = np.diff(first)
    rows = np.arange(len(n))
    row_of = np.repeat(rows, n)
    bit = mix(shingles >> _U(32))
    where = mix(shingles ^ _U(0xA5A5A5A5DEADBEEF))
    own, below = b.of_pairs(np.maximum(n, 1))
    out_row, out_key = [], []
    left = np.zeros((len(n), 2), np.int64)
    for band, member in ((own, n > 0), (np.maximum(own - 1, 0), below & (n > 0))):
        blocks, spare = b.blocks(band)
        blocks = np.where(member, blocks, 0)
        base = np.concatenate([[0], np.cumsum(blocks)])
        value = np.zeros(int(base[-1]), np.uint64)
        m = member[row_of]
        r = row_of[m]
        place = (where[m] % blocks[r].astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(value, base[r] + place, bit[m])
        owner = np.repeat(rows, blocks)
        index = np.arange(len(value)) - base[owner]
        empty = value == 0
        before = np.cumsum(empty) - empty  # empty blocks before each block
        keep = ~empty | (before - before[base[owner]] >= spare[owner])
        tag = mix((band[owner].astype(np.uint64) << _U(40)) + index.astype(np.uint64))
        out_row.append(owner[keep])
        odd = (band & 1).astype(np.uint64)
        out_key.append((mix(value ^ tag) >> _U(1) | odd[owner] << _U(63))[keep])
        left[member, (band & 1)[member]] = np.maximum(0, spare - np.bincount(owner[empty], minlength=len(n)))[member]
    return np.concatenate(out_row), np.concatenate(out_key), left


def dense_sketches(first: np.ndarray, shingles: np.ndarray) -> list[bytes]:
    """A parity sketch of each set as bytes; its bits are the power of two at or above the set's size (256 or
    more), so the larger of two sketches folds (XOR of its halves) to the size of the smaller."""
    n = np.diff(first)
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    flips = np.bincount(base[row] + (mix(shingles ^ _U(0x51)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(base[-1]))
    packed = np.packbits((flips & 1).astype(np.uint8))
    return [packed[i:j].tobytes() for i, j in zip(base[:-1] // 8, base[1:] // 8)]


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes.  Bits are numbered by the low bits of one hash, so folding
    gives the sketch that the smaller size would have had."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch
