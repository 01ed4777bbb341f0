"""Benchmark decontamination: training suffix arrays, searched with every test suffix.

Every task builds suffix arrays over its shard of the training texts (the words of a slice of
documents, one after the other) and looks up every suffix of every test item in them by binary
search.  A shard's array holds only suffixes that can match: a match of ``window`` words consists
of test-set words alone, so a place whose run of test-set words is shorter than the shortest window
is left out.  That keeps the arrays a few percent of the text and loses nothing.

The range of places that a search gives are the occurrences of the test suffix's window.  What is kept of them
are the covered words of each document and the set of its items: windows that the same items hold are one
class, so neither places nor items are ever paired.  The longest verbatim matches come from one suffix array of a
shard's runs with hits and the items that hit them: a place's match is the longest prefix that it shares with the
test suffixes next to it in the order.  Documents with a hit are contaminated; ``decontaminate`` removes them.

Words: A-Z lower-cased, then runs of characters other than ASCII characters that are no digit or
letter.  A window is ``window`` consecutive words of an item; an item with fewer words (but some) is
one window as a whole.

The test set travels to the tasks in slices of at most ``SLICE_LIMIT`` bytes, so what is sent at once
has a fixed bound whatever the test set's size.  With one slice the training text is not shuffled.  With several,
each slice's findings (only of texts with hits, once per text) are written to the shared folder before the next
slice is fetched, and the documents meet them by the key of their text.

Defined results: NULL and empty texts have no words and no hits; items without words match
nothing; repeated documents each get their row, repeated items count once by id; a NULL item id is
not counted or listed, though its hits are; an empty test set hits nothing; other columns are
carried or ignored whatever their names.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import lcp_array, suffix_array
from .tables import KEY, staged, with_key
from .words import LOWER

WINDOW = 10
#: most bytes of test text sent to the tasks at once
SLICE_LIMIT = 16 << 20
#: words of training text in one suffix array
SHARD_WORDS = 1_000_000

#: bytes to words: letters and digits stay, A-Z fold, other ASCII separates
_FOLD = bytes(
    int(LOWER[b]) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Tests:
    """One slice of the test set: word numbers, items as number arrays, and their windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        self.items: list[np.ndarray] = []
        for item_id, text in items:
            words = item_words(text)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4"))
        self.shortest = min([min(len(i), window) for i in self.items], default=0)
        # each different window once, with the test suffixes (item, place) that begin with it
        self.suffixes: dict[bytes, list[tuple[int, int]]] = {}
        for n, i in enumerate(self.items):
            size = min(window, len(i))
            for k in range(len(i) - size + 1):
                self.suffixes.setdefault(i[k : k + size].tobytes(), []).append((n, k))

        # windows that the same items hold are one class
        self.items_of: list[np.ndarray] = []
        self.windows: list[tuple[bytes, int]] = []
        classes: dict[tuple[int, ...], int] = {}
        for prefix, found in self.suffixes.items():
            items = tuple(sorted({n for n, _ in found}))
            if items not in classes:
                classes[items] = len(classes)
                self.items_of.append(np.array(items))
            self.windows.append((prefix, classes[items]))

    def search(self, ids: np.ndarray, first: np.ndarray):
        """What one shard's rows hold: (row, covered spans, items, longest matches) of each row with a hit.

        ``ids``: word numbers (0: not a test word) of the shard's rows, ``first`` their bounds."""
        n = len(ids)
        # length of the run of test words from each place to the run's end, within its row
        stop = np.ones(n + 1, bool)
        stop[:-1] = ids == 0
        stop[first[1:]] |= True
        bounds = np.flatnonzero(stop)
        end = bounds[np.searchsorted(bounds, np.arange(n), side="right")] if n else bounds[:0]
        # a run goes on from its row's first place, which may be a bound of the row before
        run = np.where(ids == 0, 0, end - np.arange(n))
        place = np.flatnonzero(run >= self.shortest)
        if not len(place):
            return
        raw, width = ids.astype(">u4").tobytes(), 4 * self.window
        order = sorted((raw[4 * p : 4 * p + min(width, 4 * r)], p) for p, r in zip(place.tolist(), run[place].tolist()))
        heads, places = [o[0] for o in order], np.array([o[1] for o in order])
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        covered = np.zeros(n + 1, np.int64)
        longest = np.zeros(n, np.int64)  # size of the window found at each place
        hits: dict[int, set[int]] = {}
        for prefix, kind in self.windows:
            lo = bisect_left(heads, prefix)
            if lo == len(heads) or not heads[lo].startswith(prefix):
                continue
            at = places[lo : bisect_left(heads, prefix + b"\xff" * (width + 4))]
            size = len(prefix) // 4
            np.add.at(covered, at, 1)
            np.add.at(covered, at + size, -1)
            longest[at] = np.maximum(longest[at], size)
            for r in np.unique(row_of[at]).tolist():
                hits.setdefault(r, set()).add(kind)
        mask = np.cumsum(covered[:-1]) > 0
        if not hits:
            return
        matches = self._longest(ids, first, end, longest, hits)
        known: dict[frozenset, np.ndarray] = {}
        for r in sorted(hits):
            kinds = frozenset(hits[r])
            if kinds not in known:
                known[kinds] = np.unique(np.concatenate([self.items_of[k] for k in kinds]))
            a, b = int(first[r]), int(first[r + 1])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[a:b].view(np.int8), [0]]))).reshape(-1, 2)
            yield r, edge, known[kinds], matches.get(r, [])

    def _longest(self, ids, first, end, found, hits) -> dict[int, list[dict]]:
        """The maximal verbatim matches of each row: (item, its place, the row's place, words)."""
        items = np.unique(np.concatenate([self.items_of[k] for kinds in hits.values() for k in kinds]))
        hit = np.flatnonzero(found)
        run_end = np.unique(end[hit])
        # each run of test words with a hit, from its first hit on
        run_start = np.array([int(hit[np.searchsorted(end[hit], e)]) for e in run_end])
        texts = [ids[a:b] for a, b in zip(run_start, run_end)] + [self.items[i].astype(np.int64) for i in items]
        n_texts, size = len(texts), np.array([len(t) for t in texts])
        base = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.empty(int(base[-1]), np.int64)
        for k, t in enumerate(texts):
            symbols[base[k] : base[k + 1] - 1] = t + n_texts
            symbols[base[k + 1] - 1] = k  # every text ends with a symbol of its own
        sa, isa, levels = suffix_array(symbols, np.full(len(symbols), len(symbols)))
        lcp = lcp_array(sa, levels)
        test = sa >= base[len(run_end)]
        best, where = np.zeros(len(sa), np.int64), np.zeros(len(sa), np.int64)
        for step in (1, -1):  # the nearest test suffix above, then below
            at, shared = -1, 0
            for k in range(len(sa)) if step == 1 else range(len(sa) - 1, -1, -1):
                shared = min(shared, int(lcp[k] if step == 1 else lcp[k + 1] if k + 1 < len(sa) else 0))
                if test[k]:
                    at, shared = int(sa[k]), 1 << 60
                elif shared > best[k]:
                    best[k], where[k] = shared, at
        out: dict[int, list[dict]] = {}
        for k, (a, b) in enumerate(zip(run_start.tolist(), run_end.tolist())):
            row = int(np.searchsorted(first, a, side="right")) - 1
            rank = isa[base[k] : base[k] + b - a]
            length = np.where(best[rank] >= self.window, best[rank], 0)
            short = found[a:b] * (found[a:b] < self.window)
            reach = np.maximum.accumulate(np.arange(b - a) + length)
            for p in np.flatnonzero((length > 0) | (short > 0)).tolist():
                words = int(length[p])
                if words:
                    if p and length[p - 1] == words + 1:
                        continue  # part of the match that begins a word earlier
                    text = int(np.searchsorted(base, where[rank[p]], side="right")) - 1
                    item, place = int(items[text - len(run_end)]), int(where[rank[p]] - base[text])
                else:  # a whole short item outside of longer matches
                    words = int(short[p])
                    if p and reach[p - 1] >= p + words:
                        continue
                    item, place = self.suffixes[ids[a + p : a + p + words].astype(">u4").tobytes()][0]
                out.setdefault(row, []).append({"item_id": self.ids[item], "item_word": place, "doc_word": a + p - int(first[row]), "longest": words})
        return out


def _search_rows(t: _Tests, texts):
    """(words, findings by row) of some texts; shards of about ``SHARD_WORDS`` words."""
    number = t.vocabulary.get
    n_words, found = [], {}
    shard: list[np.ndarray] = []
    rows: list[int] = []

    def finish():
        if shard:
            first = np.concatenate([[0], np.cumsum([len(x) for x in shard])])
            for row, spans, items, matches in t.search(np.concatenate(shard), first):
                found[rows[row]] = {
                    "spans": [{"first_word": int(a), "end_word": int(b)} for a, b in spans], "items": sorted({t.ids[i] for i in items} - {None}), "matches": matches,
                }
        shard.clear()
        rows.clear()

    held = 0
    for r, text in enumerate(texts):
        words = item_words(text.as_py())
        n_words.append(len(words))
        ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
        if t.shortest and np.count_nonzero(ids) >= t.shortest:
            shard.append(ids)
            rows.append(r)
            held += len(ids)
            if held >= SHARD_WORDS:
                finish()
                held = 0
    finish()
    return n_words, found


def _searcher(tests, window: int, only_hits: bool):
    """Adds ``_n_words`` and ``_found`` (NULL without a hit) to the rows; ``only_hits``: of texts with a hit, their key
    and what was found."""

    def run(batches):
        t = _Tests(tests.value, window)
        for batch in batches:
            n_words, found = _search_rows(t, batch.column(batch.schema.get_field_index("_text")))
            of = [found.get(r) for r in range(len(batch))]
            if only_hits:
                keep = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(k)).take(pa.array(keep, pa.int64())) for k in KEY), pa.array([of[r] for r in keep], _FOUND)], names=[*KEY, "_found"]
                )
            else:
                kept = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n_words, pa.int64()), pa.array(of, _FOUND)], names=[*kept, "_n_words", "_found"]
                )

    return run


_FOUND = pa.struct([
    ("spans", pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))),
    ("items", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("longest", pa.int32())]))),
])
_FOUND_DDL = (
    "struct<spans:array<struct<first_word:int,end_word:int>>,items:array<string>,"
    "matches:array<struct<item_id:string,item_word:int,doc_word:int,longest:int>>>"
)


def _merged(batches):
    """Of the findings of several slices for each text: spans united, items and matches of all."""
    for batch in batches:
        out = []
        for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
            spans: list[dict] = []
            for s in sorted((x for p in parts for x in p["spans"]), key=lambda x: (x["first_word"], x["end_word"])):
                if spans and s["first_word"] <= spans[-1]["end_word"]:
                    spans[-1]["end_word"] = max(spans[-1]["end_word"], s["end_word"])
                else:
                    spans.append(dict(s))
            matches = sorted((m for p in parts for m in p["matches"]), key=lambda m: (m["doc_word"], -m["longest"]))
            out.append({"spans": spans, "items": sorted({i for p in parts for i in p["items"]}), "matches": matches})
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in KEY), pa.array(out, _FOUND)], names=[*KEY, "_found"])


def _count_words(batches):
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "_text"]
        n = [len(item_words(t.as_py())) for t in batch.column(batch.schema.get_field_index("_text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n, pa.int64())], names=[*kept, "_n_words"])


def _test_slices(tests: DataFrame, item_col: str, text_col: str, limit: int):
    """The distinct items, in slices of at most ``limit`` bytes of text each (one longer item is a
    slice of its own), and whether there are several; only one slice at a time is on the driver."""
    t = tests.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * int(total) // limit)) if total > limit else 1
    for k in range(n):
        part = t if n == 1 else t.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = [(r["item"], r["text"]) for r in part.toLocalIterator()]
        size = held = 0
        for i, (_, text) in enumerate(rows):  # an uneven slice is cut again
            size += len(text)
            if size > limit and i > held:
                yield rows[held:i], n > 1
                held, size = i, len(text)
        yield rows[held:], n > 1


def find_matches(
    docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, keep_cols: bool = False, slice_limit: int = SLICE_LIMIT,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items``, ``items_sha256``, ``contaminated``, ``longest_match`` (words), ``spans`` (covered word ranges, end excluded) and
    ``matches`` (maximal verbatim matches: item, place in the item, place in the document, words; of several items
    that match alike, one).

    With ``keep_cols`` the input's columns come first, as they were."""
    own = docs.columns if keep_cols else [id_col]
    src = {c: f"_c{i}" for i, c in enumerate(own)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in src.items()], F.col(text_col).cast("string").alias("_text"))
    spark, parts = docs.sparkSession, []
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    for items, several in _test_slices(tests, item_col, item_text_col, slice_limit):
        sent = spark.sparkContext.broadcast(items)
        if not several:
            found = rows.mapInArrow(_searcher(sent, window, False), f"{kept}, _n_words long, _found {_FOUND_DDL}")
            break
        texts = with_key(rows.select("_text"), "_text").select(*KEY, "_text")
        parts.append(staged(texts.mapInArrow(_searcher(sent, window, True), f"ka long, kb long, _found {_FOUND_DDL}").dropDuplicates(KEY), "matches"))
        sent.unpersist()
    else:
        every = functools.reduce(DataFrame.unionByName, parts)
        merged = every.groupBy(*KEY).agg(F.collect_list("_found").alias("parts")).mapInArrow(_merged, f"ka long, kb long, _found {_FOUND_DDL}")
        # pinned, so that the join can split the copies of one text
        per_text = staged(merged, "found").toDF("_ka", "_kb", "_found")
        keyed = with_key(rows, "_text").withColumnsRenamed({"ka": "_ka", "kb": "_kb"})
        counted = keyed.mapInArrow(_count_words, f"{kept}, _ka long, _kb long, _n_words long")
        found = counted.join(per_text, ["_ka", "_kb"], "left").drop("_ka", "_kb")
    f = F.col("_found")
    n_hit = F.coalesce(F.aggregate(f["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"]), F.lit(0).cast("long"))
    longest = F.coalesce(F.array_max(F.transform(f["matches"], lambda m: m["longest"])), F.lit(0))
    return found.select(
        *[F.col(a).alias(c) for c, a in src.items()],
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size(f["items"]).cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join(f["items"], ","), F.lit("")), 256).alias("items_sha256"),
        f.isNotNull().alias("contaminated"),
        longest.alias("longest_match"),
        F.coalesce(f["spans"], F.array().cast("array<struct<first_word:int,end_word:int>>")).alias("spans"),
        F.coalesce(f["matches"], F.array().cast("array<struct<item_id:string,item_word:int,doc_word:int,longest:int>>")).alias("matches"),
    )


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents without a verbatim window of a test item, with their own columns."""
    found = find_matches(docs, tests, keep_cols=True, **options)
    n = len(docs.columns)
    clean = found.toDF(*[f"_{i}" for i in range(len(found.columns))]).where(~F.col(f"_{n + 4}"))
    return clean.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
