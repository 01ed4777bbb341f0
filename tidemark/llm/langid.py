"""Language ID: a linear-chain conditional random field over the words of a text.

Every word gets a score for each language from its character n-grams, its affixes (n-grams that touch
a word edge) and a lexicon of frequent words per language; learned transitions tie neighbouring
words together.  Forward-backward gives each word's language probabilities, so a text that switches
language is labelled word by word.  A text's language is the one with the most words in
expectation, its score that share.

Words are runs of letters, lower-cased.  A chain is ``CHAIN`` consecutive words; a longer text is
several chains.

The model is learned from a bounded sample of labelled texts: per language ``sample_texts`` texts
(chosen by a hash) and ``sample_words`` consecutive words of each (from a place chosen by a hash).
Half of the training chains join pieces of different languages, so that transitions learn what a
switch looks like.  The model has a fixed size (``BITS``, at most ``MAX_LANGS`` languages) and is
sent to the tasks; prediction is one pass over the texts without a shuffle.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; ties go to the
first language by name; with no labelled text every text is ``und``; labelled rows whose text has no
letter teach nothing; repeated rows each get their row; an empty table gives no rows; other columns
are carried or ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _random_odd, mix

_U = np.uint64
BITS = 18
MAX_LANGS = 64
CHAIN = 48
ORDERS = (1, 2, 3, 4)
#: characters handled at once
SLICE_CHARS = 1 << 20
SAMPLE_TEXTS = 400
SAMPLE_WORDS = 150
UNDETERMINED = "und"


@lru_cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, and their bounds."""
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)


def _words(codes: np.ndarray, off: np.ndarray):
    """(start, end, row) of the words; a row's end ends its last word."""
    m = _letters()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _flat(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters between edge marks (1 before, 2 after each word), and their bounds."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    c = codes[np.clip(np.repeat(start, size) + at - 1, 0, max(len(codes) - 1, 0))].astype(np.uint64) + _U(3)
    c[first[:-1]] = 1
    c[first[1:] - 1] = 2
    return c, first


def _word_hash(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = np.arange(len(flat)) - np.repeat(first[:-1], np.diff(first))
    power = np.multiply.accumulate(np.full(int(np.diff(first).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    return mix(np.add.reduceat(mix(flat) * power[at], first[:-1])) if len(first) > 1 else np.zeros(0, np.uint64)


def _grams(flat: np.ndarray, first: np.ndarray):
    """(word, feature) of the n-grams and affixes: an n-gram with an edge mark is an affix."""
    word_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n in ORDERS:
        k = len(flat) - n + 1
        if k <= 0:
            continue
        r = _random_odd(77 + n, n)
        h = flat[:k] * r[0]
        for i in range(1, n):
            h = h + flat[i : k + i] * r[i]
        inside = word_of[:k] == word_of[n - 1 :]
        yield word_of[:k][inside], (mix(h)[inside] & _U((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """Languages (sorted), n-gram weights, lexicon (word hashes, one column per language), lexicon and
    transition weights."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    of_lexicon: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Lexicon flags of the words, shape (words, languages)."""
        if not len(self.lexicon):
            return np.zeros((len(h), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == h)[:, None]

    def scores(self, codes, start, end) -> np.ndarray:
        """Emission scores of the words, shape (words, languages); each different word once."""
        out = np.zeros((len(start), len(self.langs)), np.float32)
        if not len(start):
            return out
        flat, first = _flat(codes, start, end)
        h = _word_hash(flat, first)
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        flat, first = _flat(codes, start[one], end[one])
        total, count = np.zeros((len(one), len(self.langs)), np.float32), np.zeros(len(one))
        for word, feature in _grams(flat, first):
            bounds = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
            if len(bounds):
                total[word[bounds]] += np.add.reduceat(self.grams[feature], bounds, axis=0)
                count[word[bounds]] += np.diff(np.append(bounds, len(word)))
        total /= np.sqrt(np.maximum(count, 1))[:, None]
        total += self.lookup(h[one]) @ self.of_lexicon
        return total[inverse]


def _chains(row: np.ndarray):
    """(chain, place in the chain) of each word: ``CHAIN`` words of a row at a time."""
    first = np.searchsorted(row, row, side="left")
    nth = np.arange(len(row)) - first
    new = (nth % CHAIN == 0)
    return np.cumsum(new) - 1, nth % CHAIN


def forward_backward(e: np.ndarray, length: np.ndarray, step: np.ndarray, begin: np.ndarray):
    """Word posteriors of many chains at once.  ``e``: scores, shape (chains, places, languages)."""
    c, t, n = e.shape
    live = np.arange(t)[None, :] < length[:, None]
    p = np.exp(e - e.max(axis=2, keepdims=True))
    p = np.where(live[:, :, None], p, 1.0)
    move = np.exp(step - step.max())
    alpha, beta = np.empty((c, t, n)), np.ones((c, t, n))
    a = p[:, 0] * np.exp(begin - begin.max())
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ move) * p[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = np.where(live[:, i, None], a, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        b = (p[:, i + 1] * beta[:, i + 1]) @ move.T
        b /= b.sum(1, keepdims=True)
        beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    return gamma, alpha, beta, p, move, live


def train(samples: list[tuple[str, str]], rounds: int = 6, batch: int = 64, rate: float = 0.3, seed: int = 7) -> Model | None:
    """Fits the model on (language, piece of text); None without usable samples."""
    samples = sorted(samples)
    codes, off = _codes([s for _, s in samples])
    start, end, row = _words(codes, off)
    langs = sorted({samples[r][0] for r in np.unique(row)})
    if not langs:
        return None
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the model's bound is {MAX_LANGS}")
    n = len(langs)
    lang = np.array([langs.index(samples[r][0]) if samples[r][0] in langs else -1 for r in range(len(samples))])
    flat, first = _flat(codes, start, end)
    h = _word_hash(flat, first)
    # lexicon: words seen three times or more in a language's sample
    pairs, count = np.unique(np.stack([h, lang[row].astype(np.uint64)], 1), axis=0, return_counts=True)
    pairs = pairs[count >= 3]
    lexicon = np.unique(pairs[:, 0])
    member = np.zeros((len(lexicon), n), np.float32)
    member[np.searchsorted(lexicon, pairs[:, 0]), pairs[:, 1].astype(int)] = 1
    m = Model(langs, np.zeros((1 << BITS, n), np.float32), lexicon, member, np.zeros((n, n), np.float32), np.zeros((n, n)), np.zeros(n))
    # features of every sample word, once
    gw, gf = (np.concatenate(x) for x in zip(*_grams(flat, first)))
    order = np.argsort(gw, kind="stable")
    gw, gf = gw[order], gf[order]
    g0 = np.searchsorted(gw, np.arange(len(start) + 1))
    scale = 1 / np.sqrt(np.maximum(np.diff(g0), 1))
    flags = m.lookup(h)
    rng = np.random.Generator(np.random.PCG64(seed))
    pure = [np.arange(a, b) for a, b in zip(np.searchsorted(row, np.arange(len(samples))), np.searchsorted(row, np.arange(len(samples)), side="right")) if b > a]
    pieces = [p[i : i + CHAIN] for p in pure for i in range(0, len(p), CHAIN)]
    seen = [np.zeros_like(m.grams), np.zeros_like(m.of_lexicon), np.zeros_like(m.step), np.zeros_like(m.begin)]

    def update(i, w, g, at=slice(None)):
        seen[i][at] += g * g
        w[at] += rate * g / np.sqrt(seen[i][at] + 1e-6)

    for _ in range(rounds):
        mixed = []
        for i in rng.permutation(len(pieces)):  # pieces of two texts, cut where a hash says
            other = pieces[rng.integers(len(pieces))]
            a, b = rng.integers(1, CHAIN // 2 + 1, 2)
            mixed.append(np.concatenate([pieces[i][:a], other[:b], pieces[i][a : a + CHAIN - a - b]]))
        todo = pieces + mixed
        order = rng.permutation(len(todo))
        for lo in range(0, len(order), batch):
            chains = [todo[k] for k in order[lo : lo + batch]]
            length = np.array([len(x) for x in chains])
            words = np.concatenate(chains)
            ci, ti = np.repeat(np.arange(len(chains)), length), np.concatenate([np.arange(k) for k in length])
            k = np.concatenate([np.arange(g0[w], g0[w + 1]) for w in words])
            f, fw = gf[k], np.repeat(np.arange(len(words)), g0[words + 1] - g0[words])
            e = np.zeros((len(words), n))
            np.add.at(e, fw, m.grams[f])
            e = e * scale[words][:, None] + flags[words] @ m.of_lexicon
            box = np.zeros((len(chains), length.max(), n))
            box[ci, ti] = e
            gamma, alpha, beta, p, move, live = forward_backward(box, length, m.step, m.begin)
            gold = np.eye(n)[lang[row[words]]]
            diff = gold - gamma[ci, ti]
            # expected and observed transitions
            joint = alpha[:, :-1, :, None] * move[None, None] * (p[:, 1:] * beta[:, 1:])[:, :, None, :]
            joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
            joint = (joint * live[:, 1:, None, None]).sum((0, 1))
            follows = (ti[1:] > 0)
            observed = np.zeros((n, n))
            np.add.at(observed, (lang[row[words[:-1]]][follows], lang[row[words[1:]]][follows]), 1)
            update(2, m.step, (observed - joint) / len(chains))
            update(3, m.begin, diff[ti == 0].sum(0) / len(chains))
            update(1, m.of_lexicon, (flags[words].T @ diff / len(chains)).astype(np.float32))
            uniq, inv = np.unique(f, return_inverse=True)
            g = np.zeros((len(uniq), n), np.float32)
            np.add.at(g, inv, (diff * scale[words][:, None])[fw].astype(np.float32) / len(chains))
            update(0, m.grams, g, uniq)
    return m


def label_texts(m: Model, texts: list[str | None]):
    """(share of each language per row, words per row, words' rows, words' languages)."""
    n = len(m.langs)
    share, words = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
    rows, labels = [], []
    lo = 0
    while lo < len(texts):  # rows of about SLICE_CHARS characters
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= SLICE_CHARS):
            held += len(texts[hi] or "")
            hi += 1
        codes, off = _codes(texts[lo:hi])
        start, end, row = _words(codes, off)
        chain, place = _chains(row)
        for a, b in _chain_ranges(chain, place, start):
            e = m.scores(codes, start[a:b], end[a:b])
            c, t = chain[a:b] - chain[a], place[a:b]
            box = np.zeros((int(c[-1]) + 1, CHAIN, n))
            box[c, t] = e
            gamma = forward_backward(box, np.bincount(c), m.step, m.begin)[0][c, t]
            np.add.at(share, row[a:b] + lo, gamma)
            rows.append(row[a:b] + lo)
            labels.append(gamma.argmax(1).astype(np.int8))
        words[lo:hi] = np.bincount(row, minlength=hi - lo)
        lo = hi
    share /= np.maximum(words, 1)[:, None]
    return share, words, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(labels) if labels else np.zeros(0, np.int8)


def _chain_ranges(chain, place, start):
    """Whole chains, about ``SLICE_CHARS`` characters at a time."""
    heads = np.flatnonzero(place == 0)
    lo = 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(start[heads], start[heads[lo]] + SLICE_CHARS, side="right")))
        yield int(heads[lo]), int(heads[hi]) if hi < len(heads) else len(place)
        lo = hi


_SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())])


def _spans(m: Model, n_rows: int, rows: np.ndarray, labels: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n_rows)]
    if len(rows):
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (labels[1:] != labels[:-1])]))
        first = np.searchsorted(rows, rows[cut])
        for a, b, f in zip(cut, np.append(cut[1:], len(rows)), first):
            out[rows[a]].append({"first_word": int(a - f), "end_word": int(b - f), "lang": m.langs[labels[a]]})
    return out


def _predict(model, with_spans: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            i = batch.schema.get_field_index("_text")
            texts = batch.column(i).to_pylist()
            if m is None:
                pred, score, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            else:
                share, words, rows, labels = label_texts(m, texts)
                best = share.argmax(1) if len(texts) else np.zeros(0, int)
                pred = [m.langs[b] if w else UNDETERMINED for b, w in zip(best, words)]
                score = [float(min(1.0, s[b])) if w else 0.0 for s, b, w in zip(share, best, words)]
                spans = _spans(m, len(texts), rows, labels) if with_spans else []
            cols = [batch.column(k) for k in range(batch.num_columns) if k != i]
            names = [k for k in batch.schema.names if k != "_text"]
            extra = [(pa.array(pred, pa.string()), "_lang_pred"), (pa.array(score, pa.float64()), "_score")]
            if with_spans:
                extra.append((pa.array(spans, pa.list_(_SPAN)), "_spans"))
            yield pa.RecordBatch.from_arrays([*cols, *(a for a, _ in extra)], names=[*names, *(k for _, k in extra)])

    return run


def sample_labelled(labelled: DataFrame, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS) -> list[tuple[str, str]]:
    """The bounded training sample: about ``texts`` different texts per language and ``words`` words of each."""
    t = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    # copies of a text are one choice, so the rate is that of the different texts
    h = F.xxhash64(F.lit(41), "text")
    count = {r["lang"]: r["n"] for r in t.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(count) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not count:
        return []
    u = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, texts / n))])
    chosen = t.where(u < F.element_at(rate, F.col("lang")))
    # a piece of the text: ``words`` words from a place chosen by a hash
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    piece = chosen.select("lang", w.alias("w"), F.xxhash64(F.lit(43), "text").alias("h"))
    at = F.pmod(F.col("h"), F.greatest(F.size("w") - words, F.lit(0)) + 1) + 1
    piece = piece.select("lang", F.array_join(F.slice("w", at.cast("int"), words), " ").alias("piece")).distinct()
    # the rates make this bound all but certain
    rows = piece.limit(4 * texts * len(count)).collect()
    return sorted((r["lang"], r["piece"]) for r in rows)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", **sample) -> Model | None:
    """The model of the rows to learn from; None if no labelled text has a letter."""
    return train(sample_labelled(labelled, text_col, lang_col, **sample))


def identify(
    docs: DataFrame, labelled: DataFrame | Model | None, id_col: str | None = "doc_id", text_col: str = "text", lang_col: str = "lang", with_spans: bool = False, **sample,
) -> DataFrame:
    """One row per input row: id (all columns if ``id_col`` is None), ``lang_pred``, ``score`` and, on
    request, ``spans`` (word ranges by language).  ``labelled`` holds the rows to learn from, or is
    what ``learn`` made of them."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(labelled, text_col, lang_col, **sample) if isinstance(labelled, DataFrame) else labelled)
    own = docs.columns if id_col is None else [id_col]
    src = {c: f"_c{i}" for i, c in enumerate(own)}
    df = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in src.items()], F.col(text_col).cast("string").alias("_text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    spans = ", _spans array<struct<first_word:int,end_word:int,lang:string>>" if with_spans else ""
    out = df.mapInArrow(_predict(model, with_spans), f"{kept}, _lang_pred string, _score double{spans}")
    cols = [F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score")] + ([F.col("_spans").alias("spans")] if with_spans else [])
    return out.select(*[F.col(a).alias(c) for c, a in src.items()], *cols)
