"""Substring dedup: difference-cover anchors.

A passage is repeated when the same ``width`` consecutive words start at two places of the corpus.
Hashing every such window of every text would move the whole corpus many times over.  Instead:

1. Anchors.  A set ``COVER`` of residues modulo ``PERIOD`` is a difference cover: for any two
   places i and j some shift below the period brings both, i + s and j + s, onto cover residues.
   Shorter windows of ``width - PERIOD + 1`` words are hashed only where the word's place is in the
   cover (5 of 21 places).  Two equal long windows contain equal anchors at one and the same shift.
2. Shared anchors.  The hashes are dealt out by value as packed arrays, each hash at most once
   per task and batch, so that a passage found in a third of all documents is not a hot key.  A hash
   found twice is shared.
3. Extension.  Only windows of ``width`` words around a shared anchor can be repeated; they are
   hashed (96 bits), dealt out in the same way, and those found at two places are repeated.
4. The words of repeated windows are removed, from every copy.

Both hashing steps work on the distinct texts (``DistinctTexts``); a text with copies elsewhere
repeats in all its windows.

Defined results: NULL and empty texts have no words and nothing removed; texts shorter than the
window keep every word; repeated rows count as separate occurrences, whatever their ids; a NULL id
is returned as it is; an empty table gives no rows; other columns, whatever they are called, are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import KEY, DistinctTexts, pack_columns, shuffle_partitions, staged, unpack_columns, with_key
from .words import cover_spans, give_back, inside, row_slices, split_words, utf8, window_hash

#: a perfect difference set: every residue modulo 21 is a difference of two members
PERIOD = 21
COVER = (0, 1, 6, 8, 18)
WIDTH = 35

_IS_COVER = np.zeros(PERIOD, bool)
_IS_COVER[list(COVER)] = True

_ENTRY = "bucket int, owners binary, entries binary"
_ANCHOR = np.dtype([("h", "<u8"), ("owner", "<u4"), ("pos", "<u4"), ("known", "u1")])
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u4"), ("owner", "<u4"), ("pos", "<u4"), ("known", "u1")])
_PLACE = np.dtype([("owner", "<u4"), ("pos", "<u4")])
_FOUND = "ka long, kb long, places binary"


def _keys(batch) -> np.ndarray:
    """The 128-bit keys of a batch's rows, shape (rows, 2)."""
    cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in KEY]
    return np.stack(cols, axis=1).astype("<i8") if len(batch) else np.zeros((0, 2), "<i8")


def _anchor_batches(width: int):
    """Rows (bucket, owners, entries) of the anchors of each batch of texts.

    A hash found several times in the batch is already known to be shared: all its places are sent
    to the buckets of their owners (they need no further comparison), and one entry still goes to
    the hash's own bucket so that other batches learn of it.
    """
    size = width - PERIOD + 1

    def run(batches, buckets: int):
        for batch in batches:
            keys = _keys(batch)
            data, off = utf8(batch.column(batch.schema.get_field_index("text")))
            parts = []
            for lo, hi in row_slices(off):
                w = split_words(data, off, lo, hi)
                pos = np.arange(len(w)) - w.first[w.row]
                fits = inside(w.row, size)
                # an anchor matters only in a text that is long enough for a whole window
                at = np.flatnonzero(fits & _IS_COVER[pos[: len(fits)] % PERIOD] & (w.count[w.row[: len(fits)]] >= width))
                e = np.zeros(len(at), _ANCHOR)
                e["h"] = window_hash(w.hash, size)[at]
                e["owner"] = w.row[at] + lo
                e["pos"] = pos[at]
                parts.append(e)
            yield from _deal(np.concatenate(parts) if parts else np.zeros(0, _ANCHOR), keys, buckets, ("h",))
            del parts
            give_back()

    return run


def _window_batches(width: int):
    """The same for the windows of ``width`` words around the shared anchors of each text."""

    def run(batches, buckets: int):
        for batch in batches:
            keys = _keys(batch)
            data, off = utf8(batch.column(batch.schema.get_field_index("text")))
            places = batch.column(batch.schema.get_field_index("places")).to_pylist()
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi in row_slices(off):
                w = split_words(data, off, lo, hi)
                ok = inside(w.row, width)
                near = np.zeros(len(w) + 1, np.int64)
                for r in range(lo, hi):
                    first = int(w.first[r - lo])
                    if copies[r] > 1:  # every window of a text with copies is repeated
                        near[first] += 1
                        near[int(w.first[r - lo + 1])] -= 1
                        continue
                    at = np.frombuffer(places[r] or b"", "<u4").astype(np.int64)
                    np.add.at(near, first + np.maximum(at - (PERIOD - 1), 0), 1)
                    np.add.at(near, first + at + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[: len(ok)] > 0) & ok)
                e = np.zeros(len(at), _WINDOW)
                e["h"] = window_hash(w.hash, width)[at]
                e["g"] = window_hash(w.hash, width, seed=2)[at] >> np.uint64(32)
                e["owner"] = w.row[at] + lo
                e["pos"] = at - w.first[w.row[at]]
                e["known"] = copies[e["owner"]] > 1
                parts.append(e)
            yield from _deal(np.concatenate(parts) if parts else np.zeros(0, _WINDOW), keys, buckets, ("h", "g"))
            del parts
            give_back()

    return run


def _same(e: np.ndarray, by: tuple[str, ...]) -> np.ndarray:
    """Group number of each entry; ``e`` is sorted by ``by``."""
    if not len(e):
        return np.zeros(0, np.int64)
    new = np.zeros(len(e), bool)
    for c in by:
        new[1:] |= e[c][1:] != e[c][:-1]
    return np.cumsum(new)


def _deal(e: np.ndarray, keys: np.ndarray, buckets: int, by: tuple[str, ...]):
    """One row per bucket: each hash once, plus the places known to be shared by now."""
    e = e[np.lexsort([e[c] for c in by[::-1]])]
    g = _same(e, by)
    n = np.bincount(g) if len(g) else np.zeros(0, np.int64)
    known = e["known"].astype(bool)
    if len(g):
        known |= n[g] > 1
    first = np.ones(len(e), bool)
    first[1:] = g[1:] != g[:-1]
    # a place known to be shared travels by its owner, so its bucket is no hot one
    extra = e[known & ~first]
    e["known"] = known
    e = e[first]
    home = np.concatenate([e["h"] % np.uint64(buckets), keys[extra["owner"], 0].astype("<u8") % np.uint64(buckets)]).astype(np.int64)
    kind = np.concatenate([e["known"], np.full(len(extra), 2)]).astype("u1")
    e = np.concatenate([e, extra])
    e["known"] = kind
    yield from _rows(e, keys, home, buckets)


def _rows(e: np.ndarray, keys: np.ndarray, home: np.ndarray, buckets: int):
    """One row (bucket, owners, entries) for each bucket that has entries."""
    order = np.argsort(home, kind="stable")
    e, home = e[order], home[order]
    cut = np.searchsorted(home, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        part = e[cut[b] : cut[b + 1]].copy()
        own, part["owner"] = np.unique(part["owner"], return_inverse=True)
        out.append((int(b), keys[own].tobytes(), pack_columns(part)))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["bucket", "owners", "entries"],
        )


def _gather(batches, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The keys and entries of a partition's rows; an entry's owner is a place among the keys."""
    owners, parts, base = [np.zeros((0, 2), "<i8")], [np.zeros(0, dtype)], 0
    for batch in batches:
        for own, ent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            k = np.frombuffer(own, "<i8").reshape(-1, 2)
            e = unpack_columns(ent, dtype)
            e["owner"] += base
            base += len(k)
            owners.append(k)
            parts.append(e)
    return np.concatenate(owners), np.concatenate(parts)


def _shared_places(dtype: np.dtype, by: tuple[str, ...], buckets: int):
    """Of one partition (all entries of its buckets): the places whose hash is found twice, dealt out
    by their text."""

    def run(batches):
        keys, e = _gather(batches, dtype)
        sent = e[e["known"] == 2]
        e = e[e["known"] < 2]
        e = e[np.lexsort([e[c] for c in by[::-1]])]
        g = _same(e, by)
        if len(e):
            e = e[(e["known"] == 1) | (np.bincount(g)[g] > 1)]
        e = np.concatenate([e, sent])
        place = np.zeros(len(e), _PLACE)
        place["owner"], place["pos"] = e["owner"], e["pos"]
        del e, sent
        yield from _rows(place, keys, (keys[place["owner"], 0].astype("<u8") % np.uint64(buckets)).astype(np.int64), buckets)

    return run


def _places_of_texts(batches):
    """Of one partition (all places of its texts): one row per text."""
    keys, e = _gather(batches, _PLACE)
    if not len(e):
        return
    keys, text = np.unique(keys, axis=0, return_inverse=True)
    text = text.reshape(-1)[e["owner"]]
    order = np.lexsort([e["pos"], text])
    text, pos = text[order], e["pos"][order].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    ends = np.append(cut[1:], len(text))
    for lo in range(0, len(cut), 5_000):
        s = slice(lo, lo + 5_000)
        own = keys[text[cut[s]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[:, 0], pa.int64()), pa.array(own[:, 1], pa.int64()), pa.array([pos[i:j].tobytes() for i, j in zip(cut[s], ends[s])], pa.binary())],
            names=["ka", "kb", "places"],
        )


def _deal_shared(texts: DataFrame, emit, dtype: np.dtype, by: tuple[str, ...], name: str) -> DataFrame:
    """(ka, kb, places) of what is found at two places, written out, one row per text."""
    n = shuffle_partitions(texts.sparkSession)
    buckets = 2 * n

    def run(batches):
        yield from emit(batches, buckets)

    dealt = texts.mapInArrow(run, _ENTRY).repartition(n, "bucket")
    shared = dealt.mapInArrow(_shared_places(dtype, by, buckets), _ENTRY).repartition(n, "bucket")
    return staged(shared.mapInArrow(_places_of_texts, _FOUND), name)


def _removal(width: int):
    """(ka, kb, n_words, n_removed, kept_sha256, spans) of each distinct text."""

    def run(batches):
        for batch in batches:
            keys = _keys(batch)
            col = batch.column(batch.schema.get_field_index("text"))
            data, off = utf8(col)
            places = batch.column(batch.schema.get_field_index("windows")).to_pylist()
            n_words, n_removed, sha, spans = [], [], [], []
            for lo, hi in row_slices(off):
                w = split_words(data, off, lo, hi, hashes=False)
                for r in range(lo, hi):
                    a, b = int(w.first[r - lo]), int(w.first[r - lo + 1])
                    gone = np.zeros(b - a, bool)
                    if places[r]:
                        gone = cover_spans(np.frombuffer(places[r], "<u4").astype(np.int64), width, b - a)
                    kept = np.flatnonzero(~gone)
                    s, e = w.start[a:b][kept], w.end[a:b][kept]
                    text = b" ".join([data[i:j].tobytes() for i, j in zip(s, e)])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    spans.append([{"first_word": int(i), "end_word": int(j)} for i, j in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[:, 0], pa.int64()),
                    pa.array(keys[:, 1], pa.int64()),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))),
                ],
                names=["ka", "kb", "n_words", "n_removed", "kept_sha256", "removed_spans"],
            )

    return run


_RESULT = "ka long, kb long, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<first_word:int,end_word:int>>"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words,
    joined by one space) and ``removed_spans`` (word ranges, end excluded)."""
    if width < PERIOD + 3:
        raise ValueError(f"width must be at least {PERIOD + 3}: an anchor has width - {PERIOD} + 1 words")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = DistinctTexts(rows)
    ids = with_key(rows).select("id", *KEY)
    copies = ids.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    # anchors that are shared between places of distinct texts, and every anchor of a copied text
    anchors = _deal_shared(texts.table, _anchor_batches(width), _ANCHOR, ("h",), "anchors")
    around = copies.where("copies > 1").join(anchors, KEY, "full_outer").select(
        *KEY, F.coalesce("copies", F.lit(1)).alias("copies"), "places"
    )
    active = texts.table.join(around, KEY)
    windows = _deal_shared(active, _window_batches(width), _WINDOW, ("h", "g"), "windows")
    out = texts.table.join(windows.withColumnRenamed("places", "windows"), KEY, "left")
    per_text = staged(out.select(*KEY, "text", "windows").mapInArrow(_removal(width), _RESULT), "removed")
    texts.drop()
    return ids.join(per_text, KEY).select(
        F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "removed_spans"
    )
