"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good or bad, or abstains where the measure says
little.  No rule decides alone: expectation-maximisation over the votes of all texts estimates how
often each rule votes good, bad or not at all for good and for bad texts, and the posterior
probability of quality, given a text's votes, replaces "every rule must pass".

The measures are counted per text in Arrow batches.  The votes of a text are one number (base 3), so
the corpus enters the estimate as a table of at most ``3 ** len(RULES)`` vote patterns with counts,
however large it is; that table is what the driver fits.

Base rules come first: a text with fewer than ``min_words`` words, or with more than half of its words
in repeated 3-word windows, fails whatever the votes say and takes no part in the estimate.

Defined results: NULL and empty texts have no words and fail the base rules; texts of any length are
measured whole; a tie (posterior exactly at the threshold) is kept; repeated rows each get their
row and each count in the estimate; an empty table gives no rows; a corpus without usable votes keeps
the starting estimates; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged
from .words import row_slices, split_words, utf8, window_hash

MIN_WORDS = 50
#: fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 3

#: measures per text, all whole numbers
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_closed_lines", "n_letter_words", "n_odd_words", "n_top_word", "n_upper", "n_lower", "n_marks",
)


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL = _flags(SYMBOLS)
_IS_UPPER = _flags(bytes(range(0x41, 0x5B)))
_IS_LOWER = _flags(bytes(range(0x61, 0x7B)))
_IS_MARK = _flags(b"!?")
_IS_LETTER = _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_IS_ODD = _flags(bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"))
_CLOSES = _flags(b".!?:;\"')")


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _groups(row: np.ndarray, h: np.ndarray):
    """(order, group of each ordered entry, size of each group) of equal hashes within a row."""
    order = np.lexsort([h, row])
    r, v = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    g = np.cumsum(new) - 1
    return order, g, np.bincount(g) if len(g) else np.zeros(0, np.int64)


def measure_rows(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> dict[str, np.ndarray]:
    n = hi - lo
    w = split_words(data, off, lo, hi)
    b0 = int(off[lo])
    part = data[b0 : int(off[hi])]
    at = off[lo : hi + 1] - b0
    per_row = lambda flags: np.diff(_running(flags)[at])
    m = {"n_words": w.count}
    lead = _running((part & 0xC0) != 0x80)
    chars = lead[w.end - b0] - lead[w.start - b0]
    m["word_chars"] = np.bincount(w.row, chars, n).astype(np.int64)
    m["n_symbols"] = per_row(_IS_SYMBOL[part])
    m["n_upper"], m["n_lower"], m["n_marks"] = per_row(_IS_UPPER[part]), per_row(_IS_LOWER[part]), per_row(_IS_MARK[part])
    letters = _running(_IS_LETTER[part])
    m["n_letter_words"] = np.bincount(w.row, (letters[w.end - b0] > letters[w.start - b0]), n).astype(np.int64)
    odd = _running(_IS_ODD[part])
    m["n_odd_words"] = np.bincount(w.row, (odd[w.end - b0] > odd[w.start - b0]), n).astype(np.int64)
    # words inside a 3-word window that the text has twice or more
    h = window_hash(w.hash, REPEAT_WIDTH)
    whole = np.flatnonzero(w.row[: len(h)] == w.row[REPEAT_WIDTH - 1 :]) if len(h) else np.zeros(0, np.int64)
    order, g, size = _groups(w.row[whole], h[whole])
    twice = whole[order[size[g] > 1]]
    covered = np.zeros(len(w), bool)
    for k in range(REPEAT_WIDTH):
        covered[twice + k] = True
    m["n_repeat_words"] = np.bincount(w.row[covered], minlength=n)
    # the most frequent word
    order, g, size = _groups(w.row, w.hash)
    top = np.zeros(n, np.int64)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        np.maximum.at(top, w.row[order[first]], size)
    m["n_top_word"] = top
    # lines with a word: equal to an earlier one, closed by a mark
    line = split_words(data, off, lo, hi, separators=b"\n")
    a, b = np.searchsorted(w.start, line.start), np.searchsorted(w.start, line.end)
    full = np.flatnonzero(b > a)
    m["n_lines"] = np.bincount(line.row[full], minlength=n)
    order, g, size = _groups(line.row[full], line.hash[full])
    m["n_dup_lines"] = m["n_lines"] - np.bincount(line.row[full][order[np.concatenate([[True], g[1:] != g[:-1]])]] if len(order) else order, minlength=n)
    closed = _CLOSES[data[w.end[b[full] - 1] - 1]] if len(full) else np.zeros(0, bool)
    m["n_closed_lines"] = np.bincount(line.row[full][closed], minlength=n)
    return m


def _measure(batches):
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index("text")))
        parts = [measure_rows(data, off, lo, hi) for lo, hi in row_slices(off)]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *MEASURES])


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond ``bad``, good up to ``good`` (in percent of ``of``), else abstains."""

    name: str
    measure: str
    of: str
    good: float
    bad: float
    least: int = 1  # abstains where ``of`` is smaller
    upward: bool = True  # large shares are bad; else small ones

    def vote(self) -> Column:
        share = 100.0 * F.col(self.measure) / F.col(self.of)
        bad, good = (share > self.bad, share <= self.good) if self.upward else (share < self.bad, share >= self.good)
        return F.when(F.col(self.of) < self.least, 0).when(bad, 2).when(good, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", good=2, bad=15),
    Rule("repeats", "n_repeat_words", "n_words", good=10, bad=30),
    Rule("lines_repeated", "n_dup_lines", "n_lines", good=5, bad=30, least=3),
    Rule("one_word", "n_top_word", "n_words", good=10, bad=20, least=20),
    Rule("shouting", "n_upper", "n_letters", good=15, bad=50),
    Rule("marks", "n_marks", "n_words", good=5, bad=50),
    Rule("odd_words", "n_odd_words", "n_words", good=5, bad=25),
    Rule("letters", "n_letter_words", "n_words", good=90, bad=70, upward=False),
    Rule("closed_lines", "n_closed_lines", "n_lines", good=60, bad=10, upward=False),
    Rule("word_length", "word_chars", "n_words", good=1000, bad=1500),
)


@dataclass
class Estimate:
    """``vote[c, r, v]``: the probability that rule r votes v (0 none, 1 good, 2 bad) for class c
    (0 bad, 1 good); ``prior``: the share of good texts."""

    vote: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        p = np.log(np.array([1 - self.prior, self.prior]))[:, None] + sum(np.log(self.vote[:, r, votes[:, r]]) for r in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(p[0] - p[1], -700, 700)))

    def accuracy(self) -> np.ndarray:
        """How often each rule is right where it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = weight[0] * self.vote[0, :, 2] + weight[1] * self.vote[1, :, 1]
        return right / (weight[:, None] * self.vote[:, :, 1:].sum(2)).sum(0)


def decode(pattern: np.ndarray, rules: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(rules)) % 3


#: vote shares (none, good, bad) that a rule is believed to have for bad and for good texts
BELIEF = np.array([(0.10, 0.55, 0.35), (0.13, 0.85, 0.02)])
#: weight of that belief, as a share of the texts (so that it means the same at every size)
BELIEF_WEIGHT = 0.05
PRIOR = 0.85


def fit(votes: np.ndarray, count: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> Estimate:
    """Expectation-maximisation over vote patterns with counts, from the belief that a rule's bad vote
    is rare for good texts.  The belief keeps its weight in every round: else the two classes may
    settle on any two groups of texts, good ones and one kind of bad ones with all the others."""
    rules = votes.shape[1]
    belief = np.repeat(BELIEF[:, None, :], rules, axis=1)
    e = Estimate(belief, PRIOR)
    if not len(count):
        return e
    weight = BELIEF_WEIGHT * count.sum()
    last = -np.inf
    for _ in range(rounds):
        good = e.posterior(votes)
        share = np.stack([(1 - good) * count, good * count])
        vote = np.stack([[np.bincount(votes[:, r], w, 3) for r in range(rules)] for w in share]) + weight * belief
        vote /= vote.sum(2, keepdims=True)
        e = Estimate(vote, float((share[1].sum() + weight * PRIOR) / (count.sum() + weight)))
        now = float(share[1].sum())
        if abs(now - last) <= tolerance * count.sum():
            break
        last = now
    return e


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, the base measures, ``base_failed``, ``p_good`` (NULL where the base
    rules fail) and ``kept``."""
    spark = docs.sparkSession
    m = text_measures(docs, id_col, text_col).withColumn("n_letters", F.col("n_upper") + F.col("n_lower"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    pattern = sum((r.vote().cast("long") * F.lit(3**i) for i, r in enumerate(rules)), F.lit(0).cast("long"))
    m = staged(m.withColumns({"base_failed": failed, "pattern": pattern}), "measures")
    # at most 3 ** len(rules) rows, whatever the corpus
    seen = m.where("not base_failed").groupBy("pattern").count().orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in seen], np.int64)
    votes = decode(patterns, len(rules))
    e = fit(votes, np.array([r["count"] for r in seen], float))
    table = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, e.posterior(votes))] if len(seen) else [], "pattern long, p_good double")
    out = m.join(F.broadcast(table), "pattern", "left")
    p_good = F.when(F.col("base_failed"), F.lit(None)).otherwise(F.col("p_good"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        p_good.alias("p_good"), F.coalesce(p_good >= threshold, F.lit(False)).alias("kept"),
    )
