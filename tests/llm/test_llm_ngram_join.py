import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import WORD, collect, documents, sentence, vocabulary

from tidemark.llm import ngram_join, tables
from tidemark.llm.ngram_join import one_of_each_group, similar_groups
from tidemark.llm.shingles import bands, dense_sketches, fold, shingle_sets, sketch_keys, sketches
from tidemark.llm.tables import components
from tidemark.llm.words import mix


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(data, size, num, den):
    sets = [shingles(t, size) for _, t in data]
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets)))


def family(seed=3, members=40):
    """Copies of one text with few to many changed words, so that some links join only by others."""
    r = random.Random(seed)
    words = vocabulary(seed)
    base = sentence(r, words, 150).split()
    out = [" ".join(base)]
    for _ in range(members):
        w = list(r.choice(out).split()) if r.random() < 0.4 else list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words) + str(r.randint(0, 9))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,num,small", [(4, 85, 64), (5, 80, 4)])
def test_against_brute_force(spark, monkeypatch, size, num, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)  # 4: large buckets are divided too
    docs = documents(spark).select("doc_id", "text", "part", "ka")
    extra = spark.createDataFrame([(1000 + i, t, 1, 2) for i, t in enumerate(family())], "doc_id long, text string, part long, ka long")
    docs = docs.unionByName(extra)
    got = collect(similar_groups(docs, size=size, num=num, den=100))
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(data, size, num, 100)


def test_linked_pairs_share_a_key_and_sketches_bound_the_difference():
    values = family(9, 60)
    first, s = shingle_sets(pa.array(values), 4)
    row, key = sketch_keys(first, s, bands(85, 100))
    keys = [set(key[row == i].tolist()) for i in range(len(values))]
    sets = [set(s[i:j].tolist()) for i, j in zip(first[:-1], first[1:])]
    dense = dense_sketches(first, s)
    linked = 0
    for i in range(len(values)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            x, y = (np.frombuffer(dense[k], np.uint8) for k in (i, j))
            size = min(len(x), len(y))
            assert np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= len(sets[i] ^ sets[j])
            if 100 * both >= 85 * len(sets[i] | sets[j]):
                linked += 1
                assert keys[i] & keys[j]
    assert linked > 50


def test_empty_blocks_of_unrelated_texts_do_not_meet():
    b = bands(80, 100)
    n = int(b.low[b.low <= 300][-1])  # a band's smallest sets have the most empty blocks
    sets = np.sort(np.random.default_rng(4).integers(0, 2**64, (400, n), dtype=np.uint64), axis=1)
    key = sketch_keys(np.arange(401) * n, sets.ravel(), b)[1]
    assert np.unique(key, return_counts=True)[1].max() < 8


@pytest.mark.parametrize("num", [70, 80, 85])
def test_linked_sets_with_many_empty_blocks_share_a_key(num):
    r, b = np.random.default_rng(num), bands(num, 100)
    for n in (5, 12, 40, 100, 300):
        blocks = int(b.blocks(b.of(n))[0])
        pool = np.unique(r.integers(0, 2**64, 400_000, dtype=np.uint64))
        place = mix(pool ^ np.uint64(0xA5A5A5A5DEADBEEF)) % np.uint64(blocks)
        for used in {min(blocks, 2), -(-blocks // 3), -(-blocks // 2), blocks}:
            a = r.permutation(pool[place < used])
            swap, drop = n * (100 - num) // (100 + num), n * (100 - num) // 100
            for x in (a[:n], a[swap : n + swap], a[drop:n]):
                pair = [np.sort(a[:n]), np.sort(x)]
                assert 100 * len(np.intersect1d(*pair)) >= num * len(np.union1d(*pair))
                row, key = sketch_keys(np.cumsum([0, *map(len, pair)]), np.concatenate(pair), b)
                assert np.intersect1d(key[row == 0], key[row == 1]).size


def test_one_of_each_group_keeps_own_columns(spark):
    docs = documents(spark)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = {(r["doc_id"]): r["component_id"] for r in collect(similar_groups(docs))}
    assert {r["doc_id"] for r in collect(kept.select("doc_id"))} == {d for d, c in groups.items() if d is None or d == c}
    assert collect(one_of_each_group(docs.limit(0))) == []


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in collect(components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_exactly_one_row_of_each_group(spark):
    r = random.Random(12)
    words = vocabulary(12)
    a, b, c, d = (sentence(r, words, 60) for _ in range(4))
    data = [(5, a, "x"), (9, a + " end", "x"), (5, b, "x"), (3, b + " end", "x")]  # one id on two texts
    data += [(20, c, "x"), (20, c, "y"), (21, c, "x"), (20, c, "x")]  # repeated rows
    data += [(None, d, "x"), (None, d, "x"), (None, d + " end", "x")]  # NULL ids
    data += [(30, "", "x"), (30, " ", "x"), (None, None, "x")]  # no words
    for limit in (ngram_join.SEND_LIMIT, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ngram_join, "SEND_LIMIT", limit)
            got = Counter((x["doc_id"], x["text"]) for x in collect(one_of_each_group(spark.createDataFrame(data, "doc_id long, text string, ka string").repartition(3))))
        without = Counter({(30, ""): 1, (30, " "): 1, (None, None): 1})
        first = got - without
        assert without <= got and first in [Counter({(5, a): 1, (3, b + " end"): 1, (20, c): 1, (None, x): 1}) for x in (d, d + " end")]


def test_low_thresholds_lose_no_link(spark):
    r = random.Random(13)
    words = vocabulary(13)
    data = []
    for i in range(0, 60, 2):  # one text of a pair holds the other: 8/13, 5/8, 2/5, 3/9, ...
        w = list(dict.fromkeys(r.choice(words) for _ in range(60)))
        few, many = ((8, 13), (5, 8), (13, 21), (2, 5), (3, 9), (7, 20))[i // 2 % 6]
        data += [(i, " ".join(w[:few])), (i + 1, " ".join(w[:many]))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for num in (60, 33):
        got = collect(similar_groups(docs, size=1, num=num, den=100))
        assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(data, 1, num, 100)
    with pytest.raises(ValueError):
        bands(0, 100)


def test_pairs_and_difference_sets_in_slices(spark, monkeypatch):
    """Large buckets whose pairs are decided, and whose difference sets are made, in several slices."""
    one_go, rows = ngram_join._slices_of, []
    next_keys = ngram_join._next_keys
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "_slices_of", lambda pairs, kept: max(2, one_go(pairs, kept)))

    def counted(*args):
        keys = next_keys(*args)
        rows.append(keys.count())
        return keys

    monkeypatch.setattr(ngram_join, "_next_keys", counted)
    r = random.Random(8)
    passage = [f"s{i}" for i in range(14)]
    texts = family(members=20) + [" ".join(passage + [f"o{r.randrange(4000)}" for _ in range(30)]) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[21::3]]  # near copies that share the passage with all others
    data = list(enumerate(texts))
    got = collect(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), size=4, num=85, den=100))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(data, 4, 85, 100)
    assert sum(rows) > 0


def test_no_difference_set_is_written_and_batches_are_small(spark, monkeypatch):
    """Difference sets move to their pivot's task only; wide rows go to the workers few at a time."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(batch), []
    monkeypatch.setattr(ngram_join, "SMALL", 3)

    def recording(f):
        def g(*args, **kwargs):
            out = f(*args, **kwargs)
            seen.append((args[1], out.columns, spark.conf.get(batch)))
            return out

        return g

    for name in ("staged", "staged_parts"):
        monkeypatch.setattr(ngram_join, name, recording(getattr(ngram_join, name)))
    passage = [f"s{i}" for i in range(14)]
    r = random.Random(8)
    texts = [" ".join(passage + [f"o{r.randrange(4000)}" for _ in range(30)]) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[::3]]
    data = list(enumerate(texts))
    got = collect(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), size=4, num=85, den=100))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(data, 4, 85, 100)
    inside = [x for x in seen if x[0] != "groups"]
    assert "keys" in [name for name, _, _ in inside] and all("difference" not in columns for _, columns, _ in inside)
    assert all(int(size) <= 8 << 20 for _, _, size in inside) and spark.conf.get(batch) == before


def test_elements_of_one_member_are_no_keys():
    def table(chunks, members):
        as_set = lambda x: np.array(x, "<u8").tobytes()
        of = pa.table({"xa": [1, 2, 3], "xb": [0] * 3, "far": [True] * 3, "least": [1] * 3, "x_set": [as_set(x) for x in members]})
        pivot = pa.table({"p_set": [as_set([1, 2, 3])], "chunks": [chunks], "elements": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary())})
        key = (pa.scalar(7), pa.scalar(8))
        counts = ngram_join._element_counts(key, of, pivot)
        for c in ("elements", "counts"):
            pivot = pivot.set_column(pivot.column_names.index(c), c, counts.column(c))
        return {r["xa"]: set(np.frombuffer(r["keys"], "<u8").tolist()) for r in ngram_join._first_elements(key, of, pivot).to_pylist()}

    members = [[1, 2, 3, 10, 11], [1, 2, 3, 11, 12], [1, 2, 3, 13]]
    some, every = table(1, members), table(2, members)  # with further chunks an element may be another's too
    assert set(some) == {1, 2} and len(some[1]) == 1 and some[1] == some[2] == every[1] & every[2]
    assert {x: len(k) for x, k in every.items()} == {1: 2, 2: 2, 3: 1}


def test_scratch_tables_are_written_by_few_tasks(spark, monkeypatch):
    # one file for each of many shuffle partitions took most of the time of a small join
    monkeypatch.setattr(tables, "WRITERS_PER_CORE", 1, raising=False)
    most, plain, files = spark.sparkContext.defaultParallelism, ngram_join.staged, {}

    def counted(df, name, **more):
        out = plain(df, name, **more)
        files.setdefault(name, []).append(out.rdd.getNumPartitions() and len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    data = [(i, t) for i, t in enumerate(family(members=20))]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(2 * most + 3))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = collect(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), size=4, num=85, den=100))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(data, 4, 85, 100)
    files.pop("groups")  # of the result, after the join
    assert {"met", "members", "weight", "buckets", "possible", "parts"} <= set(files)
    assert all(n <= most for counts in files.values() for n in counts), files


def test_more_links_join_known_components(spark, monkeypatch):
    plain, worked_on = ngram_join.components, []

    def spied(edges):
        worked_on.append(sorted(map(tuple, edges.collect())))
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", spied)
    links = lambda *pairs: spark.createDataFrame([(x, -x, p, -p) for x, p in pairs], "xa long, xb long, pa long, pb long")

    def groups(parts):
        out = {}
        for r in parts.collect():
            assert r.kb == -r.ka
            out.setdefault(r.part, []).append(r.ka)
        return sorted(sorted(g) for g in out.values())

    parts = ngram_join._more_links(None, links((2, 1), (3, 2), (4, 3), (11, 10), (12, 11), (21, 20)))
    assert groups(parts) == [[1, 2, 3, 4], [10, 11, 12], [20, 21]]
    assert len(worked_on.pop()) == 6
    same = ngram_join._more_links(parts, links((4, 1), (12, 10)))  # inside components: nothing to do
    assert same is parts and not worked_on
    parts = ngram_join._more_links(parts, links((4, 2), (12, 4), (31, 30), (41, 20)))
    assert groups(parts) == [[1, 2, 3, 4, 10, 11, 12], [20, 21, 41], [30, 31]]
    assert len(worked_on.pop()) == 3  # no link inside a component
    parts = ngram_join._more_links(parts, links((50, 41), (31, 50), (61, 60)))
    assert groups(parts) == [[1, 2, 3, 4, 10, 11, 12], [20, 21, 30, 31, 41, 50], [60, 61]]
    assert ngram_join._more_links(parts, links()) is parts


def test_many_rounds_with_new_links_in_each(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)  # all larger buckets are divided
    more, calls = ngram_join._more_links, []

    def counted(parts, found):
        out = more(parts, found)
        calls.append(out is not parts)
        return out

    monkeypatch.setattr(ngram_join, "_more_links", counted)
    data = [(i, t) for i, t in enumerate(family(seed=11, members=60) + family(seed=12, members=30))]
    got = collect(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), size=4, num=85, den=100))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(data, 4, 85, 100)
    assert sum(calls) > 1  # components were joined after the first round


def test_keys_left_out_lose_no_link():
    """Whatever the common order, a linked pair shares a key that both texts keep."""
    values = family(9, 60) + family(10, 20)
    first, s = shingle_sets(pa.array(values), 4)
    b = bands(85, 100)
    row, key, left = sketches(first, s, b)
    assert all(np.array_equal(x, y) for x, y in zip((row, key), sketch_keys(first, s, b))) and left.max() > 0
    sets = [set(s[i:j].tolist()) for i, j in zip(first[:-1], first[1:])]
    names, count = np.unique(key, return_counts=True)
    rank = np.random.default_rng(5).permutation(len(names))
    for order in (np.lexsort([names, -count]), np.lexsort([names, count]), rank):
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        keys = []
        for i in range(len(values)):
            own = key[row == i]
            own = own[np.argsort(place[np.searchsorted(names, own)])]
            keys.append({int(k) for odd in (0, 1) for k in own[own >> np.uint64(63) == odd][left[i, odd] :]})
        linked = [(i, j) for i in range(len(values)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert len(linked) > 50 and all(keys[i] & keys[j] for i, j in linked)


def _with_steps(spark, monkeypatch, data):
    """The result as counts, and how many rows of which scratch tables were written."""
    plain, written = ngram_join.staged, {}

    def counted(df, name, **more):
        out = plain(df, name, **more)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    got = collect(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), size=4, num=85, den=100))
    return Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), written


def test_many_unrelated_texts_with_a_passage_take_one_round(spark, monkeypatch):
    # the texts of a large bucket moved all their sets to the pivot's and went on to many small rounds
    monkeypatch.setattr(ngram_join, "SMALL", 16)
    r = random.Random(21)
    passage = [f"s{i}" for i in range(9)]
    texts = [" ".join(passage + [f"o{r.randrange(10**6)}" for _ in range(60)]) for _ in range(400)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[::40]]
    data = list(enumerate(texts))
    got, written = _with_steps(spark, monkeypatch, data)
    assert got == brute(data, 4, 85, 100)
    assert "level" not in written and max(written["possible"]) < 100, written


@pytest.mark.parametrize("small,listed", [(64, 3), (2, 1 << 15)])
def test_buckets_with_many_possible_pairs_are_divided(spark, monkeypatch, small, listed):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    data = list(enumerate(family(seed=11, members=50) + family(seed=12, members=30)))
    got, written = _with_steps(spark, monkeypatch, data)
    assert got == brute(data, 4, 85, 100)
    assert "level" in written
