"""Line dedup by a deletion-neighbourhood join.

A line is removed when an earlier line (by document id, then line number) has the same words, or is at most one edit
away: one unit replaced, inserted or deleted.  The units of a line of ``edit_words`` words or more are its words, those
of a shorter one (or of text without spaces) its characters, its words joined by one space.  Words are compared with
words and characters with characters; a line of fewer than ``edit_chars`` characters and ``edit_words`` words needs
the same words.  So the bound is one edit in eight words, or in sixteen characters.

1. Same words.  Lines meet under the hash of their words; the earliest stays.
2. Candidates.  Two lines one edit apart share their first or their last half of units (of the
   shorter one), so only lines with a half that another line has can have a partner.  This loses
   nothing and spares most lines the next step.
3. Deletion neighbourhood.  A candidate emits, as hashed keys, itself and every variant with one unit
   deleted.  A replaced unit gives equal variants at equal places, an inserted one a variant equal to
   the other line; all lines that share a variant and its place are one edit apart, so the earliest of
   them decides for all others.
4. Verify.  Each claim (line, earlier line) is checked by the edit distance of the units.

Keys are dealt out as packed arrays after a local round in each batch: of the lines of a batch under one
key only the earliest travels, the others are decided on the spot.  A line that a third of all documents
hold is one entry per batch; no group is gathered and no pairs are listed.  Texts move twice: those with candidate
lines to their candidates, and all of them to what was decided for them.

Defined results: NULL text stays NULL, empty text stays empty; NULL ids come last in the order;
repeated rows count as later copies (of rows that agree in id and text the first stays); ties cannot
happen otherwise (id, text and line number order the lines); an empty table gives no rows; columns other
than id and text are carried unchanged whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import KEY, discard, pack_columns, shuffle_partitions, staged, unpack_columns, with_key
from .words import _random_odd, give_back, mix, row_slices, split_words, utf8

EDIT_WORDS = 8
EDIT_CHARS = 16

_U = np.uint64
_BASE = int(_random_odd(501, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)

#: an entry: a line (owner, number) under a key.  kind 0: the line's own words; 1: half of its units, ``tell``
#: is the line's hash; 2 to 4: decided in its batch (2 removed, 3 candidate, 4 a row that occurs again)
_LINE = np.dtype([("key", "<u8"), ("tell", "<u8"), ("owner", "<u4"), ("line", "<u4"), ("kind", "u1")])
_SAME, _HALF, _REMOVED, _CANDIDATE, _COPIED = 0, 1, 2, 3, 4
_ENTRY = "bucket int, owners binary, entries binary"
_OWNER = ["_id", *KEY]


def _owners(batch) -> np.ndarray:
    """(id, key, key) of the rows; a NULL id comes last."""
    cols = [batch.column(batch.schema.get_field_index(c)).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) for c in _OWNER]
    return np.stack(cols, axis=1).astype("<i8") if len(batch) else np.zeros((0, 3), "<i8")


def _rank(owners: np.ndarray) -> np.ndarray:
    """Place of each owner in the order; equal owners share one."""
    return np.unique(owners, axis=0, return_inverse=True)[1].reshape(-1)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.multiply.accumulate(np.full(max(n, 1), _BASE, np.uint64))])


class Lines:
    """Some lines as runs ``a .. b`` of units (words, or characters): polynomial hashes of unit runs in constant time."""

    def __init__(self, units: np.ndarray, a, b, row, number, tag: int = 0):
        self.a, self.b, self.row, self.number, self.tag = a, b, row, number, _U(tag)
        self.n = b - a
        # prefix[i]: sum of units[k] * base ** (k - first unit of the line) for the line's units before i
        nth = np.arange(len(units)) - np.repeat(a, self.n) if len(units) else np.zeros(0, np.int64)
        self.power = _powers(int(self.n.max(initial=0)))
        self.prefix = np.concatenate([[_U(0)], np.cumsum(units * self.power[nth], dtype=np.uint64)])
        # base ** -n brings a run to its own start
        self.down = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(len(self.power), _INVERSE & (2**64 - 1), np.uint64))])

    def run(self, line, start, size):
        """Hash of ``size`` words of a line from its word ``start``."""
        i = self.a[line] + start
        h = (self.prefix[i + size] - self.prefix[i]) * self.down[start]
        return mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ self.tag)

    def variants(self, line):
        """(line, place, hash) of the words of ``line`` without the word at each place."""
        n = self.n[line]
        each = np.repeat(line, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, a, b = self.a[each] + place, self.a[each], self.b[each]
        before = self.prefix[i] - self.prefix[a]
        after = (self.prefix[b] - self.prefix[i + 1]) * _U(_INVERSE)
        return each, place, mix(before + after + (self.n[each] - 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ self.tag)


def word_lines(data, off, lo, hi):
    """(the words, the lines of the rows as runs of words): lines without a word are left out."""
    w = split_words(data, off, lo, hi)
    line = split_words(data, off, lo, hi, separators=b"\n", hashes=False)
    a, b = np.searchsorted(w.start, line.start), np.searchsorted(w.start, line.end)
    full = b > a
    start, row = line.start[full], line.row[full]
    # the number of a line among the row's \n-separated pieces: line breaks before it
    br = np.concatenate([[0], np.cumsum(data[int(off[lo]) : int(off[hi])] == 0x0A)])
    number = br[start - int(off[lo])] - br[off[lo:hi][row] - int(off[lo])]
    return w, Lines(w.hash, a[full], b[full], row, number)


def char_lines(data, w, lines: Lines, pick: np.ndarray, edit_chars: int):
    """(places in ``pick``, lines) of the picked lines with at least ``edit_chars`` characters, as runs of characters."""
    n = lines.n[pick]
    word = np.repeat(lines.a[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    later = word != np.repeat(lines.a[pick], n)  # a space stands before each word but the first
    size = w.end[word] - w.start[word] + later
    at = np.cumsum(size) - size
    source = np.repeat(w.start[word] - later - at, size) + np.arange(int(size.sum()))
    b = data[source].astype(np.uint64)
    b[at[later]] = 0x20
    head = np.flatnonzero((b & _U(0xC0)) != _U(0x80))
    place = np.arange(len(b)) - np.repeat(head, np.diff(np.append(head, len(b))))
    units = np.add.reduceat(b << (place.astype(np.uint64) * _U(8)), head) if len(b) else b
    # characters of each line
    of_line = np.repeat(np.arange(len(pick)), n)
    chars = np.bincount(np.repeat(of_line, size)[head], minlength=len(pick)) if len(b) else np.zeros(len(pick), np.int64)
    long = chars >= edit_chars
    units = mix(units[np.repeat(long, chars)] + _U(0xC0DE))
    end = np.cumsum(chars[long])
    keep = pick[long]
    return np.flatnonzero(long), Lines(units, end - chars[long], end, lines.row[keep], lines.number[keep], tag=0xC0DEC0DEC0DE)


def _deal(e: np.ndarray, owners: np.ndarray, home: np.ndarray, buckets: int):
    order = np.argsort(home, kind="stable")
    e, home = e[order], home[order]
    cut = np.searchsorted(home, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        part = e[cut[b] : cut[b + 1]].copy()
        own, part["owner"] = np.unique(part["owner"], return_inverse=True)
        out.append((int(b), owners[own].tobytes(), pack_columns(part)))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["bucket", "owners", "entries"],
        )


def _heads(*columns) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _halves(x: Lines, line: np.ndarray, tell: np.ndarray, lo: int):
    """Entries of the halves of some lines, and of the halves of one unit less (where a line is the longer of a pair)."""
    n = x.n[line]
    even = n % 2 == 0  # of an odd number of units, both halves below are the same
    for pick, size in ((np.ones(len(line), bool), n // 2), (even, (n - 1) // 2)):
        i, size, count = line[pick], size[pick], n[pick]
        for tail, start in ((0x4EAD, np.zeros(len(i), np.int64)), (0x1A1F, count - size)):
            e = np.zeros(len(i), _LINE)
            e["key"] = mix(x.run(i, start, size) ^ _U(tail))
            e["tell"], e["owner"], e["line"], e["kind"] = tell[pick], x.row[i] + lo, x.number[i], _HALF
            yield e


def _line_entries(edit_words: int, edit_chars: int, buckets: int):
    def run(batches):
        for batch in batches:
            owners = _owners(batch)
            rank = _rank(owners)
            data, off = utf8(batch.column(batch.schema.get_field_index("_text")))
            parts = []
            for lo, hi in row_slices(off):
                w, x = word_lines(data, off, lo, hi)
                every = np.arange(len(x.n))
                whole = x.run(every, np.zeros(len(every), np.int64), x.n)
                e = np.zeros(len(every), _LINE)
                e["key"], e["owner"], e["line"], e["kind"] = whole, x.row + lo, x.number, _SAME
                parts.append(e)
                long = np.flatnonzero(x.n >= edit_words)
                parts += _halves(x, long, whole[long], lo)
                short = np.flatnonzero(x.n < edit_words)
                at, c = char_lines(data, w, x, short, edit_chars)
                parts += _halves(c, np.arange(len(at)), whole[short[at]], lo)
            e = np.concatenate(parts) if parts else np.zeros(0, _LINE)
            del parts
            yield from _first_round(e, owners, rank, buckets)
            del e
            give_back()

    return run


def _first_round(e, owners, rank, buckets):
    """Decides what the batch alone decides; deals out one entry per key (two for a shared half)."""
    same, half = e[e["kind"] == _SAME], e[e["kind"] == _HALF]
    first, later, copied = _earliest(same, rank)
    # only the earliest line of equal ones looks for partners
    half = half[np.isin(_place(half, rank), _place(first, rank))]
    half = half[np.lexsort([half["tell"], half["key"]])]
    head = _heads(half["key"])
    last = np.concatenate([head[1:], [True]])[: len(half)]
    shared = _shared(half)
    known = half[shared]
    known["kind"] = _CANDIDATE
    known = known[np.unique(_place(known, rank), return_index=True)[1]]
    # first and last of a shared half are different lines, which is all that others need to know
    out = np.concatenate([first, later, copied, half[head | (last & shared)], known])
    home = np.where(out["kind"] <= _HALF, out["key"], owners[out["owner"], 1].astype("<u8")) % _U(buckets)
    yield from _deal(out, owners, home, buckets)


def _place(e: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of each entry's line in the order of all lines at hand."""
    return rank[e["owner"]].astype(np.uint64) << _U(32) | e["line"].astype(np.uint64)


def _earliest(same: np.ndarray, rank: np.ndarray):
    """(earliest line of each key, later lines, lines met twice at one place): the last are lines of rows
    that agree in id and text, which are one row to all others."""
    at = _place(same, rank)
    order = np.lexsort([at, same["key"]])
    same, at = same[order], at[order]
    new = _heads(same["key"])
    head = at[np.flatnonzero(new)][np.cumsum(new) - 1] if len(same) else at
    later, copied = same[at != head], same[~new & (at == head)]
    later["kind"], copied["kind"] = _REMOVED, _COPIED
    return same[new], later, copied


def _shared(half: np.ndarray) -> np.ndarray:
    """Whether two different lines have each entry's half; ``half`` is sorted by key and line hash."""
    if not len(half):
        return np.zeros(0, bool)
    group = np.cumsum(_heads(half["key"])) - 1
    return np.bincount(group[_heads(half["key"], half["tell"])])[group] > 1


def _gather(batches, dtype):
    owners, parts, base = [np.zeros((0, 3), "<i8")], [np.zeros(0, dtype)], 0
    for batch in batches:
        for own, ent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            k = np.frombuffer(own, "<i8").reshape(-1, 3)
            e = unpack_columns(ent, dtype)
            e["owner"] += base
            base += len(k)
            owners.append(k)
            parts.append(e)
    return np.concatenate(owners), np.concatenate(parts)


def _second_round(buckets: int):
    """Of one partition (all entries of its buckets): later copies, and lines with a shared half, dealt
    out by their row."""

    def run(batches):
        owners, e = _gather(batches, _LINE)
        _, later, copied = _earliest(e[e["kind"] == _SAME], _rank(owners))
        half = e[e["kind"] == _HALF]
        half = half[np.lexsort([half["tell"], half["key"]])]
        half = half[_shared(half)]
        half["kind"] = _CANDIDATE
        found = np.concatenate([later, copied, half, e[e["kind"] > _HALF]])
        out = np.zeros(len(found), _FOUND)
        for c in _FOUND.names:
            out[c] = found[c]
        yield from _deal(out, owners, owners[out["owner"], 1].astype("<u8") % _U(buckets), buckets)

    return run


_FOUND = np.dtype([("owner", "<u4"), ("line", "<u4"), ("kind", "u1")])
_DECIDED = "_id long, ka long, kb long, _removed binary, _candidates binary, _copied boolean"


def _decided(batches):
    """Of one partition (all that was found for its rows): one row (owner, removed, candidates, copied) each."""
    owners, e = _gather(batches, _FOUND)
    if not len(e):
        return
    owners, row = np.unique(owners, axis=0, return_inverse=True)
    row = row.reshape(-1)[e["owner"]]
    order = np.lexsort([e["line"], row])
    row, line, kind = row[order], e["line"][order].astype("<u4"), e["kind"][order]
    cut = np.flatnonzero(_heads(row))
    ends = np.append(cut[1:], len(row))
    for s in range(0, len(cut), 5_000):
        span = list(zip(cut[s : s + 5_000], ends[s : s + 5_000]))
        own = owners[row[cut[s : s + 5_000]]]
        of = lambda i, j, k: np.unique(line[i:j][kind[i:j] == k]).tobytes() or None
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(own[:, k], pa.int64()) for k in range(3)), pa.array([of(i, j, _REMOVED) for i, j in span], pa.binary()),
             pa.array([of(i, j, _CANDIDATE) for i, j in span], pa.binary()), pa.array([bool((kind[i:j] == _COPIED).any()) for i, j in span], pa.bool_())],
            names=["_id", *KEY, "_removed", "_candidates", "_copied"],
        )


# --- deletion neighbourhood -----------------------------------------------------------------------

#: place 0xFFFFFFFF: the line itself; claims carry the earlier line
_WHOLE = 0xFFFFFFFF
_VARIANT = np.dtype([("key", "<u8"), ("place", "<u4"), ("owner", "<u4"), ("line", "<u4"), ("by", "<u4"), ("by_line", "<u4"), ("claim", "u1")])


def _claims(e: np.ndarray, rank: np.ndarray):
    """(earliest entry per key and place, claims): lines with an earlier line one edit away.

    Under one key: lines with the variant at the same place are one edit apart from each other, the line that
    is the variant itself is one edit apart from all."""
    at = _place(e, rank)
    order = np.lexsort([at, e["place"], e["key"]])
    e, at = e[order], at[order]
    if not len(e):
        return e, e
    new = _heads(e["key"], e["place"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = at != at[head]  # entries of one and the same line are not later
    found = [_claim(e[late], e[head[late]])]
    first, at = e[new], at[new]
    # the line itself (its place is the last of its key) against the variants equal to it
    group = np.cumsum(_heads(first["key"])) - 1
    itself = np.flatnonzero(first["place"] == _WHOLE)
    of_group = np.full(int(group[-1]) + 1, -1)
    of_group[group[itself]] = itself
    variant = np.flatnonzero((of_group[group] >= 0) & (first["place"] != _WHOLE))
    line = of_group[group[variant]]
    after = at[variant] > at[line]
    found.append(_claim(first[variant[after]], first[line[after]]))
    found.append(_claim(first[line[~after]], first[variant[~after]]))
    return first, np.concatenate(found)


def _claim(late: np.ndarray, early: np.ndarray) -> np.ndarray:
    c = late.copy()
    c["by"], c["by_line"], c["claim"] = early["owner"], early["line"], 1
    return c


def _wanted_lines(batch, edit_words: int, edit_chars: int):
    """(first row, words, lines by words, those wanted, lines by characters) of each slice of rows with candidate lines."""
    data, off = utf8(batch.column(batch.schema.get_field_index("_text")))
    wanted = batch.column(batch.schema.get_field_index("_candidates")).to_pylist()
    for lo, hi in row_slices(off):
        w, x = word_lines(data, off, lo, hi)
        want = np.concatenate([np.zeros(0, np.uint64), *((np.uint64(r - lo) << _U(32)) | np.frombuffer(wanted[r] or b"", "<u4") for r in range(lo, hi))])
        line = np.flatnonzero(np.isin(x.row.astype(np.uint64) << _U(32) | x.number.astype(np.uint64), want))
        yield data, lo, w, x, line[x.n[line] >= edit_words], char_lines(data, w, x, line[x.n[line] < edit_words], edit_chars)[1]


def _variants(edit_words: int, edit_chars: int, buckets: int):
    """Deals out the variants of each row's candidate lines; claims go to the claimed line's bucket."""

    def run(batches):
        for batch in batches:
            owners = _owners(batch)
            rank = _rank(owners)
            parts = []
            for _, lo, _, words, line, chars in _wanted_lines(batch, edit_words, edit_chars):
                for x, line in ((words, line), (chars, np.arange(len(chars.n)))):
                    each, place, h = x.variants(line)
                    e = np.zeros(len(each) + len(line), _VARIANT)
                    e["key"] = np.concatenate([h, x.run(line, np.zeros(len(line), np.int64), x.n[line])])
                    e["place"] = np.concatenate([place, np.full(len(line), _WHOLE)])
                    e["owner"] = np.concatenate([x.row[each], x.row[line]]) + lo
                    e["line"] = np.concatenate([x.number[each], x.number[line]])
                    parts.append(e)
            e = np.concatenate(parts) if parts else np.zeros(0, _VARIANT)
            first, claims = _claims(e, rank)
            out = np.concatenate([first, claims])
            home = np.where(out["claim"] == 0, out["key"], owners[out["owner"], 1].astype("<u8")) % _U(buckets)
            yield from _deal_claims(out, owners, home, buckets)

    return run


def _deal_claims(e, owners, home, buckets):
    order = np.argsort(home, kind="stable")
    e, home = e[order], home[order]
    cut = np.searchsorted(home, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        part = e[cut[b] : cut[b + 1]].copy()
        own, inverse = np.unique(np.concatenate([part["owner"], part["by"]]), return_inverse=True)
        part["owner"], part["by"] = inverse[: len(part)], inverse[len(part) :]
        out.append((int(b), owners[own].tobytes(), pack_columns(part)))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["bucket", "owners", "entries"],
        )


_CLAIM = "_id long, ka long, kb long, line int, by_id long, by_ka long, by_kb long, by_line int"


def _meet(batches):
    """Of one partition (all entries of its buckets): the claims."""
    owners, parts, base = [np.zeros((0, 3), "<i8")], [np.zeros(0, _VARIANT)], 0
    for batch in batches:
        for own, ent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            k = np.frombuffer(own, "<i8").reshape(-1, 3)
            e = unpack_columns(ent, _VARIANT)
            e["owner"] += base
            e["by"] += base
            base += len(k)
            owners.append(k)
            parts.append(e)
    owners, e = np.concatenate(owners), np.concatenate(parts)
    if not len(e):
        return
    known = e[e["claim"] == 1]
    c = np.concatenate([known, _claims(e[e["claim"] == 0], _rank(owners))[1]])
    x, by = owners[c["owner"]], owners[c["by"]]
    for lo in range(0, len(c), 50_000):
        s = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(x[s, k], pa.int64()) for k in range(3)), pa.array(c["line"][s].astype(np.int32), pa.int32()),
                *(pa.array(by[s, k], pa.int64()) for k in range(3)), pa.array(c["by_line"][s].astype(np.int32), pa.int32()),
            ],
            names=["_id", *KEY, "line", "by_id", "by_ka", "by_kb", "by_line"],
        )


def one_edit_apart(a, b) -> bool:
    """Whether one replaced, inserted or deleted unit (or none) turns ``a`` into ``b``: lists of words, or strings."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def units_of(words: list[str], edit_words: int):
    return words if len(words) >= edit_words else " ".join(words)


def _candidate_lines(edit_words: int, edit_chars: int):
    """(owner, line, words) of the candidate lines."""

    def run(batches):
        for batch in batches:
            owners = _owners(batch)
            ids, numbers, words = [], [], []
            for data, lo, w, x, line, chars in _wanted_lines(batch, edit_words, edit_chars):
                short = np.flatnonzero(np.isin(x.row.astype(np.uint64) << _U(32) | x.number.astype(np.uint64), chars.row.astype(np.uint64) << _U(32) | chars.number.astype(np.uint64)))
                for k in [*line.tolist(), *short.tolist()]:
                    ids.append(int(x.row[k]) + lo)
                    numbers.append(int(x.number[k]))
                    s = slice(int(x.a[k]), int(x.b[k]))
                    words.append([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(w.start[s], w.end[s])])
            own = owners[ids] if ids else owners[:0]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(own[:, k], pa.int64()) for k in range(3)), pa.array(numbers, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["_id", *KEY, "line", "words"]
            )

    return run


def _verified(edit_words: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("words", "by_words"))
            near = [(len(x) >= edit_words) == (len(y) >= edit_words) and one_edit_apart(units_of(x, edit_words), units_of(y, edit_words)) for x, y in zip(a, b)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["_id", *KEY, "line"])

    return run


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rewrite(batches):
    """Each row's text without its removed lines (as it was where none is)."""
    for batch in batches:
        col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
        texts, removed, near, later = (col(c).to_pylist() for c in ("_text", "_removed", "_near", "_later"))
        out, n_lines, n_removed = [], [], []
        for r, t in enumerate(texts):
            lines = t.split("\n") if t else []
            gone = set(near[r] or [])
            gone.update(np.frombuffer(removed[r] or b"", "<u4").tolist())
            if later[r]:
                gone = {i for i, x in enumerate(lines) if _WORD.search(x)}
            n_lines.append(len(lines))
            n_removed.append(len(gone))
            out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
        keep = [c for c in batch.schema.names if c.startswith("_c")]
        yield pa.RecordBatch.from_arrays(
            [*(col(c) for c in keep), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())],
            names=[*keep, "_text", "_n_lines", "_n_removed"],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_words: int = EDIT_WORDS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """The input rows with ``text_col`` cleaned, and ``n_lines``, ``n_removed`` after them.

    ``id_col`` is an integer column."""
    if edit_words < 4 or edit_chars < 4:
        raise ValueError("needs edit_words and edit_chars of 4 or more")
    n = shuffle_partitions(docs.sparkSession)
    buckets = 2 * n
    src = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = src[text_col]
    named = docs.toDF(*src.values())
    row = ["_id", *KEY]
    rows = with_key(named, text).withColumns({"_id": F.col(src[id_col]).cast("long"), "_text": F.col(text).cast("string")}).drop(text)
    slim = rows.select(*row, "_text")
    dealt = slim.mapInArrow(_line_entries(edit_words, edit_chars, buckets), _ENTRY).repartition(n, "bucket")
    found = dealt.mapInArrow(_second_round(buckets), _ENTRY).repartition(n, "bucket").mapInArrow(_decided, _DECIDED)
    marks = staged(found, "lines")
    # texts with candidate lines are looked at again (rows that agree in id and text once)
    of = marks.where("_candidates is not null").select(*row, "_candidates")
    wanted = staged(_inner_join(slim, of, row).dropDuplicates(row), "wanted")
    claims = staged(wanted.mapInArrow(_variants(edit_words, edit_chars, buckets), _ENTRY).repartition(n, "bucket").mapInArrow(_meet, _CLAIM).distinct(), "claims")
    lines = staged(wanted.mapInArrow(_candidate_lines(edit_words, edit_chars), "_id long, ka long, kb long, line int, words array<string>"), "candidates")
    by = lines.select(F.col("_id").alias("by_id"), F.col("ka").alias("by_ka"), F.col("kb").alias("by_kb"), F.col("line").alias("by_line"), F.col("words").alias("by_words"))
    # NULL ids were replaced by the greatest number on the way
    checked = claims.join(lines, [*row, "line"]).join(by, ["by_id", "by_ka", "by_kb", "by_line"]).mapInArrow(_verified(edit_words), "_id long, ka long, kb long, line int")
    near = checked.groupBy(*row).agg(F.collect_set("line").alias("_near"))
    decided = staged(marks.select(F.coalesce("_id", _last()).alias("_id"), *KEY, "_removed", "_copied").join(near, row, "full_outer"), "decided")
    discard(marks, wanted, claims, lines)
    kept = [c for c in rows.columns if c.startswith("_c")]
    need = [*kept, "_text", "_removed", "_near", "_later"]
    copied = decided.where("_copied")
    both = _left_join(rows, decided, row)
    if copied.isEmpty():
        both = both.withColumn("_later", F.lit(False)).select(*need)
    else:  # of rows that agree in id and text the first stays
        again = staged(_inner_join(rows, copied, row).withColumn("_row", F.monotonically_increasing_id()), "copied")
        first = staged(again.groupBy(*row).agg(F.min("_row").alias("_first")), "first", small=True)
        again = _left_join(again, first, row).withColumn("_later", F.col("_row") > F.col("_first"))
        both = both.where("not coalesce(_copied, false)").withColumn("_later", F.lit(False)).select(*need).unionByName(again.select(*need))
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    done = both.mapInArrow(_rewrite, f"{ddl}, _text string, _n_lines long, _n_removed long")
    out = [F.col("_text" if a == text else a).alias(c) for c, a in src.items()]
    return done.select(*out, F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def _last():
    """Stands for a NULL id on the way."""
    return F.lit(2**63 - 1)


def _left_join(left: DataFrame, right: DataFrame, row: list[str], how: str = "left") -> DataFrame:
    """Join on the row's identity; a NULL id is the greatest number on the right."""
    r = right.select(*[F.coalesce(c, _last()).alias(f"_r{i}") if c == "_id" else F.col(c).alias(f"_r{i}") for i, c in enumerate(row)], *[c for c in right.columns if c not in row])
    on = [F.coalesce(left[c], _last()) == r[f"_r{i}"] if c == "_id" else left[c] == r[f"_r{i}"] for i, c in enumerate(row)]
    return left.join(r, on, how).drop(*[f"_r{i}" for i in range(len(row))])


def _inner_join(left: DataFrame, right: DataFrame, row: list[str]) -> DataFrame:
    return _left_join(left, right, row, "inner")
