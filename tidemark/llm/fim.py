"""Fill-in-the-middle transformation: cuts found by a piecewise-linear learned rank index.

A text is a sequence of units (lines, or characters); a cut before unit k lies at the k-th boundary offset.
All boundary offsets of a text are one learned index: segments of straight lines, each as long as the error
bound allows (a cone of slopes that narrows point by point), and for every boundary a residual in the
fewest bytes.  A cut is predicted from its segment and set right by the residual, so it is exact.

Two units drawn by a digest of seed and id bound the middle.  The forms are ``psm`` (prefix, suffix, middle), ``spm``
(suffix, prefix, middle) and ``plain`` (the text as it is: empty, with a marker in it, or not drawn).  Texts are
transformed where they lie: no shuffle, one text at a time.

Defined results: NULL text counts as empty and is plain; a NULL id is drawn like an empty one; repeated rows
give equal rows; texts of any length are cut whole; an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the markers
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: bound of a prediction's error, in code points
ERROR = 64


@dataclass
class RankIndex:
    """Error-bounded segments over sorted offsets, with a residual for each."""

    first: np.ndarray  # rank of each segment's first boundary
    base: np.ndarray  # its offset
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        first, base, slope = [], [], []
        at, n = 0, len(offsets)
        while at < n:
            first.append(at)
            base.append(int(offsets[at]))
            low, high = -np.inf, np.inf
            end, step = at + 1, 32
            while end < n:  # the cone narrows over some points at a time
                to = min(end + step, n)
                run = np.arange(end - at, to - at)
                rise = offsets[end:to] - offsets[at]
                lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
                highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
                shut = np.flatnonzero(lows > highs)
                stop = int(shut[0]) if len(shut) else to - end
                if stop:
                    low, high, end = lows[stop - 1], highs[stop - 1], end + stop
                if len(shut):
                    break
                step *= 2
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        index = cls(np.array(first, np.int64), np.array(base, np.int64), np.array(slope), np.zeros(0, np.int8))
        rest = offsets - index.predict(np.arange(n))
        most = int(np.abs(rest).max(initial=0))
        index.residual = rest.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int64)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.floor(self.slope[s] * (rank - self.first[s]) + 0.5).astype(np.int64)

    def locate(self, rank: int) -> int:
        """The exact offset of a boundary."""
        return int(self.predict(np.array([rank]))[0]) + int(self.residual[rank])


def boundaries(text: str, unit: str = "line") -> np.ndarray:
    """Offsets (code points) of all unit boundaries: 0, the end of each unit."""
    if not text:
        return np.zeros(1, np.int64)
    if unit == "char":
        return np.arange(len(text) + 1, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 0x0A) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends]).astype(np.int64)


def _transform(seed: str, unit: str, rate: int, spm_rate: int, error: int):
    def one(doc_id: str | None, text: str):
        offsets = boundaries(text, unit)
        n = len(offsets) - 1
        h = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
            return n, "plain", None, None, text, None
        index = RankIndex.fit(offsets, error)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = index.locate(a), index.locate(b)
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if h4 % 100 < spm_rate:
            return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", len(index.first)
        return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", len(index.first)

    def run(batches):
        for batch in batches:
            key, texts = batch.column(batch.schema.get_field_index("_key")), batch.column(batch.schema.get_field_index("_text"))
            for lo in range(0, len(batch), 512):  # outputs of a few rows at a time
                k, t = key.slice(lo, 512).to_pylist(), texts.slice(lo, 512)
                out = [one(x, y.as_py() or "") for x, y in zip(k, t)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 512), *(pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds))],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"],
                )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", unit: str = "line", rate: int = 100, spm_rate: int = 50, error: int = ERROR,
) -> DataFrame:
    """One row per input row: id, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (NULL if plain), ``output`` and
    ``n_segments`` (of the text's index; NULL if plain).

    ``rate``: per cent of texts that are transformed, ``spm_rate``: per cent of those in the form spm."""
    if unit not in ("line", "char"):
        raise ValueError("unit must be 'line' or 'char'")
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, n_segments int"
    return rows.mapInArrow(_transform(seed, unit, rate, spm_rate, error), schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from output and form: no marker stands in a transformed text, so each occurs once."""
    o = F.col(output)
    p, s, m = (F.instr(o, x) for x in (PREFIX, SUFFIX, MIDDLE))
    tail = F.length(o)
    middle = F.substring(o, m + 3, tail)
    psm = F.concat(F.substring(o, p + 3, s - p - 3), middle, F.substring(o, s + 3, m - s - 3))
    spm = F.concat(F.substring(o, p + 3, m - p - 3), middle, F.substring(o, s + 3, p - s - 3))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)
