"""Word splitting and hashing over Arrow bytes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from edge import WORD, texts

from tidemark.llm import words as W


def _split(values, **options):
    data, off = W.utf8(pa.array(values, pa.string()))
    for lo, hi in W.row_slices(off, 2000):
        w = W.split_words(data, off, lo, hi, **options)
        for r in range(lo, hi):
            s = slice(int(w.first[r - lo]), int(w.first[r - lo + 1]))
            yield [data[i:j].tobytes().decode() for i, j in zip(w.start[s], w.end[s])], w.hash[s]


def test_words_are_those_of_the_pattern():
    values = texts()
    got = list(_split(values))
    assert len(got) == len(values)
    for (found, _), t in zip(got, values):
        assert found == WORD.findall(t or "")


def test_equal_words_hash_alike_wherever_they_stand():
    seen: dict[str, int] = {}
    for found, hashes in _split(texts()):
        for w, h in zip(found, hashes):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_lower_casing_folds_ascii_only():
    (a, ha), (b, hb), (_, hc), (_, hd) = _split(["ABC ÄX", "abc Äx", "äx", "Äx"], lower=True)
    assert list(ha) == list(hb) and hc[0] != hd[0]


def test_lines_as_words():
    got = [x for x, _ in _split(["a b\n\nc\r\n", None, "\n"], separators=b"\n")]
    assert got == [["a b", "c\r"], [], []]


def test_windows():
    h = np.arange(20, dtype=np.uint64)
    w = W.window_hash(np.concatenate([h[:5], h[:5]]), 3)
    assert w[0] == w[5] and len(set(w[:5].tolist())) == 5
    assert len(W.window_hash(h[:2], 3)) == 0
    assert W.inside(np.array([0, 0, 0, 1, 1]), 2).tolist() == [True, True, False, True]


def test_sliced_and_empty_columns():
    a = pa.array(["x y", None, "z"], pa.string()).slice(1)
    data, off = W.utf8(a)
    assert len(off) == 3 and W.split_words(data, off, 0, 2).count.tolist() == [0, 1]
    data, off = W.utf8(pa.array([], pa.string()))
    assert list(W.row_slices(off)) == [] and re.match("", "") is not None
