"""Periodic run detection: branching tandems on an enhanced suffix array.

A run is a stretch of words with smallest period q and length of at least twice q that no neighbour
extends.  Its last square (two equal halves of q words that end with the run) is a branching tandem: the suffixes at
its start and q words later agree in exactly q words, so they lie in different children of one LCP interval of
depth q.

1. Suffix array and ISA of the words, by prefix doubling; the texts of a slice are sorted together, and words of
   different texts differ, so no comparison crosses texts.  Only suffixes that are not yet alone are sorted again.
2. LCP array, from the ranks of the doubling rounds.
3. LCP intervals and their children, as four numbers per LCP entry: one pass with a stack, no tree nodes.
4. Branching tandems.  For each interval of depth d every suffix i outside of its largest child is tested: does ISA[i + d]
   or ISA[i - d] lie in the interval, in another child?  That is n log n tests at most, in numpy.
5. Rotation.  A square that goes on being one when rotated to the left is one run with its rotations; squares that end at
   one word are merged, the least period first, which also removes powers of a shorter period.

Texts are analysed where they lie, in slices of about a megabyte (or one longer text); nothing is shuffled.

Defined results: NULL and empty texts have no words and no runs; a text that is one word over and over is one run of
period 1; repeated rows give equal rows, NULL ids are carried; an empty table gives no rows; other columns are
ignored whatever their names.  A very long text takes about 150 bytes a word in its task.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import give_back, row_slices, split_words, utf8

MIN_LENGTH = 12
#: tandem tests done at once
TESTS = 1 << 21


def number_words(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Numbers of the words, by row first: equal words of one row are equal, words of different rows differ."""
    order = np.lexsort([hashes, row])
    h, r = hashes[order], row[order]
    new = np.zeros(len(h), np.int64)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_array(symbols: np.ndarray, end: np.ndarray):
    """(SA, ISA, ranks by the first 1, 2, 4, ... symbols) of texts written one after the other.  ``end``: for each place the
    end of its text; symbols of different texts differ and ascend with the text.  A text's end is less than any symbol."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = start
    rank[n] = -1
    alone = head & np.append(head[1:], True)
    active = order[~alone]
    levels, h = [], 1
    while len(active):
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        # the rank h symbols on, 0 beyond the text
        on = np.minimum(active + h, n)
        second = np.where(active + h < end[active], rank[on] + 1, 0)
        first = rank[active]
        by = np.lexsort([second, first])
        active, first, second = active[by], first[by], second[by]
        group = np.ones(len(active), bool)
        group[1:] = first[1:] != first[:-1]
        head = group.copy()
        head[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        of_group = np.maximum.accumulate(np.where(group, at, 0))
        of_head = np.maximum.accumulate(np.where(head, at, 0))
        rank[active] = first + of_head - of_group
        alone = head & np.append(head[1:], True)
        active = active[~alone]
        h *= 2
    isa = rank[:n]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    return sa, isa, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[k]: symbols that the suffixes at k - 1 and k share (0 at k = 0)."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    # pairs that share a first symbol; a text's end never equals another place
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1 if levels else np.zeros(0, np.int64)
    i, j = sa[pair], sa[pair - 1]
    got = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i] == levels[k][j]
        step = same.astype(np.int64) << k
        i, j, got = np.minimum(i + step, n), np.minimum(j + step, n), got + step
    lcp[pair] = got
    return lcp


def lcp_intervals(lcp: np.ndarray):
    """For each entry k with lcp[k] > 0: ``parent`` (the first entry of its interval), ``after`` (the entry that ends the child
    that begins at k); for first entries also ``left`` and ``right``, the interval's bounds (right excluded)."""
    n = len(lcp)
    parent, after, left, right = (array("q", bytes(8 * n)) for _ in range(4))
    value, first, last = [0], [0], [0]  # open intervals, depth ascending; depth 0 is the root
    for k, v in enumerate(array("q", lcp.astype(np.int64).tobytes())):
        top = value[-1]
        while top > v:
            right[first[-1]] = k
            after[last[-1]] = k
            value.pop()
            first.pop()
            last.pop()
            top = value[-1]
        if top == v:
            if v:
                after[last[-1]] = k
                parent[k] = first[-1]
            last[-1] = k
        else:
            left[k] = last[-1]
            parent[k] = k
            value.append(v)
            first.append(k)
            last.append(k)
    for f, e in zip(first[1:], last[1:]):
        right[f] = after[e] = n
    return tuple(np.frombuffer(x, np.int64) if n else np.zeros(0, np.int64) for x in (parent, after, left, right))


def branching_tandems(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, end: np.ndarray):
    """(start, half) of every branching tandem: 2 * half symbols of which the halves are equal and that the next symbol
    does not go on."""
    parent, after, left, right = lcp_intervals(lcp)
    entry = np.flatnonzero(lcp > 0)
    head = entry[parent[entry] == entry]
    # children: to the right of each entry, and to the left of an interval's first
    lo = np.concatenate([entry, left[head]])
    hi = np.concatenate([after[entry], head])
    of = np.concatenate([parent[entry], head])
    # all but the largest child of each interval
    order = np.lexsort([hi - lo, of])
    lo, hi, of = lo[order], hi[order], of[order]
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = np.append(of[1:] == of[:-1], False)
    lo, hi, of = lo[small], hi[small], of[small]
    size = hi - lo
    total = np.cumsum(size)
    starts, halves = [], []
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TESTS, side="right")))
        s = slice(at, to)
        each = np.repeat(np.arange(at, to), size[s])
        k = np.repeat(lo[s], size[s]) + np.arange(len(each)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        i, d = sa[k], lcp[of[each]]
        low, high = left[of[each]], right[of[each]]
        a, b = lo[each], hi[each]
        for other, first in ((i + d, i), (i - d, i - d)):
            ok = (other >= 0) & (other < len(sa))
            r = isa[np.where(ok, other, 0)]
            ok &= (r >= low) & (r < high) & ((r < a) | (r >= b))
            starts.append(first[ok])
            halves.append(d[ok])
        at = to
    start, half = np.concatenate(starts), np.concatenate(halves)
    # between two smaller children a tandem is found from both ends
    both = np.unique(np.stack([start, half], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """How far to the left the period of a square goes on."""
    step = 32
    while start:
        lo = max(0, start - step)
        differ = np.flatnonzero(symbols[lo:start] != symbols[lo + period : start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, step = lo, 4 * step
    return 0


def runs_of(symbols: np.ndarray, end: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of every run of ``min_length`` symbols or more, by start, then period; places count through all
    texts.  ``symbols`` and ``end`` as for ``suffix_array``."""
    sa, isa, levels = suffix_array(symbols, end)
    lcp = lcp_array(sa, levels)
    del levels
    start, half = branching_tandems(sa, isa, lcp, end)
    stop = start + 2 * half
    out = []
    order = np.lexsort([half, stop])
    found: list[int] = []  # starts of the runs that end at ``last``
    last = -1
    for s, d, e in zip(start[order].tolist(), half[order].tolist(), stop[order].tolist()):
        if e != last:
            found, last = [], e
        # a run of a shorter period that ends here and holds the whole square: a power of that period
        if any(x <= s for x in found):
            continue
        first = _rotated(symbols, s, d)
        found.append(first)
        if e - first >= min_length:
            out.append((first, e - first, d))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _find(min_length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, off = utf8(batch.column(1))
            for lo, hi in row_slices(off):
                w = split_words(data, off, lo, hi)
                found = runs_of(number_words(w.hash, w.row), w.first[w.row + 1] if len(w) else np.zeros(0, np.int64), min_length)
                row = w.row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                # words after a run's first period go
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(edge)[:-1] == 0
                runs, texts = [], []
                for r in range(hi - lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    runs.append([{"start": int(s) - a, "length": int(n), "period": int(q)} for s, n, q in found[cut[r] : cut[r + 1]]])
                    k = kept[a:b]
                    texts.append(b" ".join([data[i:j].tobytes() for i, j in zip(w.start[a:b][k].tolist(), w.end[a:b][k].tolist())]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(w.count, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                give_back()

    return run


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per input row: id, ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``: the words
    outside of runs and of each run's first period, joined by one space."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_find(min_length), f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
