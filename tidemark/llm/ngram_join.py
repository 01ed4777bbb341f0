"""N-gram Jaccard join by parity sketches.

Two texts link when the Jaccard similarity of their shingle sets reaches ``num / den``; texts are grouped
by the connected components of the links.

1. Sketch.  Each set's shingles flip bits of a parity sketch (``shingles.sketch_keys``), one sketch
   size per size band.  The Hamming distance of two sketches is a lower bound of the symmetric
   difference of the sets, so a linked pair has equal blocks: texts meet under their blocks' keys.
   Keys are dealt out as packed arrays after a local round in each batch: a key that a third of all texts
   share sends one entry per batch.  A linked pair has more equal blocks than one, so each text then leaves out
   some keys that most texts share: unrelated texts with a passage or a common phrase in common seldom meet.
2. Stars.  The members of a key's bucket are compared with one of them, the pivot: work linear in the
   bucket whatever its size; the pivot is the most central member.  A second, dense sketch rejects most pairs, the exact sets decide the rest.
   Most buckets are copies of one another or of one text, and now lie in one component.
3. Small buckets (up to ``SMALL`` members) whose members are still in different components compare
   these members by their dense sketches inside one task; what the bound lets through is decided on the
   exact sets.  A bucket that would list more than ``LISTED`` pairs is treated as a large one.
4. Large buckets are divided.  Relative to the pivot a member is its difference set, and the
   symmetric difference of two members is that of their difference sets.  A link with a "far" member
   (one that does not link with the pivot) needs a known least overlap of the difference sets, so both hold a
   common element among the first few of them (prefix filter; rare elements
   come first).  (pivot, element) are the keys of the next round, which goes on at 2.

No link that could join two components is lost: buckets whose members are in one component, pairs that the
bounds rule out and pairs already in one component are all that is passed over.  No bucket is cut or
capped, and none is listed pair by pair.

Defined results: NULL texts and texts without words have no shingles, link with nothing and are
their own component; copies of a text with words link; repeated ids are separate rows with the
same component as their text; NULL ids take no part in the least id (a component of NULL ids only
has a NULL id); an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import bands, dense_sketches, fold, shingle_sets, sketches
from .tables import KEY, Bucketed, DistinctTexts, components, delete_scratch, discard, few_files, pack_columns, recorded, release, shuffle_partitions, small_batches, staged, staged_parts, unpack_columns, with_key
from .words import give_back, mix, row_slices, utf8

_U = np.uint64
_ENTRY = "bucket int, owners binary, entries binary"
#: kind 0 and 1: a key's local pivot (1: some local member is far); 2 and 3: a member and its local
#: pivot (3: some local member is far); 4: the size of a text's set and the keys that it may leave out
_DTYPE = np.dtype([("key", "<u8"), ("pivot", "<u4"), ("text", "<u4"), ("kind", "u1")])
_PIVOT, _MEMBER, _SIZE = 0, 2, 4
_MET = "kind int, key long, xa long, xb long, pa long, pb long, far boolean"
_PAIR = ["xa", "xb", "pa", "pb"]
_KEYS = "xa long, xb long, far boolean, keys binary"
#: of the key of kind 4: the size, then the numbers of keys of even and of odd bands
_SIZE_BITS, _LEFT_BITS = 42, 10
#: buckets of up to this many members are compared inside one task, unless more than ``LISTED`` pairs of one are possible
SMALL = 4096
LISTED = 1 << 15
#: members of one pivot handled together when large buckets are divided
CHUNK = 512


def _longs(batch, names) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
    return np.stack(cols, axis=1).astype("<i8") if len(batch) else np.zeros((0, len(names)), "<i8")


def _deal(owners: np.ndarray, row: np.ndarray, key: np.ndarray, far: np.ndarray, buckets: int, sizes: np.ndarray | None = None):
    """One row per bucket: each key of the batch once with its local pivot, and the pairs of the
    batch's other members with it (dealt by member, so that a common key's bucket stays small)."""
    rank = np.empty(len(owners), np.int64)
    rank[np.lexsort([owners[:, 1], owners[:, 0]])] = np.arange(len(owners))
    order = np.lexsort([rank[row], key])
    row, key, far = row[order], key[order], far[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    group = np.cumsum(first) - 1
    any_far = np.zeros(int(first.sum()), bool)
    np.logical_or.at(any_far, group, far)
    pivot = row[first][group]
    # one member may hold a key twice; only different texts make a pair
    member = ~first & (row != pivot)
    e = np.zeros(int(first.sum()) + int(member.sum()), _DTYPE)
    k = int(first.sum())
    e["key"][:k], e["pivot"][:k], e["text"][:k], e["kind"][:k] = key[first], row[first], row[first], _PIVOT + any_far
    e["key"][k:], e["pivot"][k:], e["text"][k:], e["kind"][k:] = key[member], pivot[member], row[member], _MEMBER + any_far[group[member]]
    if sizes is not None:
        s = np.zeros(len(sizes), _DTYPE)
        s["key"], s["text"], s["pivot"], s["kind"] = sizes, np.arange(len(sizes)), np.arange(len(sizes)), _SIZE
        e = np.concatenate([e, s])
    home = np.where(e["kind"] < _MEMBER, e["key"], owners[e["text"], 0].astype("<u8")) % _U(buckets)
    order = np.argsort(home, kind="stable")
    e, home = e[order], home[order]
    cut = np.searchsorted(home, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        part = e[cut[b] : cut[b + 1]].copy()
        own, inverse = np.unique(np.concatenate([part["pivot"], part["text"]]), return_inverse=True)
        part["pivot"], part["text"] = inverse[: len(part)], inverse[len(part) :]
        out.append((int(b), owners[own].tobytes(), pack_columns(part)))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["bucket", "owners", "entries"],
        )


#: texts are shingled in slices of about this many bytes, which bounds a task's memory
SLICE_BYTES = 4 << 20


def _slices(column):
    """(first row, slice of the column): about ``SLICE_BYTES`` of text each."""
    off = utf8(column)[1]
    for lo, hi in row_slices(off, SLICE_BYTES):
        yield lo, column.slice(lo, hi - lo)


def _sketches(size: int, num: int, den: int, buckets: int):
    def run(batches):
        b = bands(num, den)
        for batch in batches:
            owners = _longs(batch, KEY)
            rows, keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for lo, part in _slices(batch.column(batch.schema.get_field_index("text"))):
                first, shingles = shingle_sets(part, size)
                row, key, left = sketches(first, shingles, b)
                rows.append(row + lo)
                keys.append(key)
                even, odd = np.minimum(left, (1 << _LEFT_BITS) - 1).astype(np.uint64).T  # leaving out fewer loses nothing
                sizes.append(np.diff(first).astype(np.uint64) | even << _U(_SIZE_BITS) | odd << _U(_SIZE_BITS + _LEFT_BITS))
            row = np.concatenate(rows)
            yield from _deal(owners, row, np.concatenate(keys), np.ones(len(row), bool), buckets, np.concatenate(sizes))
            del rows, keys, row
            give_back()

    return run


def _differences(buckets: int):
    """The same for the difference keys of the members of large buckets."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            owners, row = np.unique(_longs(batch, ["xa", "xb"]), axis=0, return_inverse=True)
            keys = [np.frombuffer(k, "<u8") for k in batch.column(batch.schema.get_field_index("keys")).to_pylist()]
            n = np.array([len(k) for k in keys])
            far = np.array(batch.column(batch.schema.get_field_index("far")).to_pylist(), bool)
            yield from _deal(owners, np.repeat(row.reshape(-1), n), np.concatenate(keys), np.repeat(far, n), buckets)

    return run


def _difference_sets(members, pivot):
    """The difference set of each member's set and the pivot's."""
    p = np.frombuffer(pivot.column("p_set")[0].as_buffer(), "<u8")
    return [np.setxor1d(np.frombuffer(x.as_buffer(), "<u8"), p, assume_unique=True) for x in members.column("x_set")]


def _element_counts(key, members, pivot):
    """How many of some of a pivot's members have each element in their difference sets (elements of
    two or more)."""
    e, n = np.unique(np.concatenate(_difference_sets(members, pivot)), return_counts=True)
    e, n = e[n > 1], n[n > 1]
    return pa.table({
        "pa": pa.array([key[0].as_py()], pa.int64()), "pb": pa.array([key[1].as_py()], pa.int64()),
        "elements": pa.array([e.tobytes()], pa.binary()), "counts": pa.array([n.astype("<u4").tobytes()], pa.binary()),
    })


def _first_elements(key, members, pivot):
    """The keys of each member: the first elements of its difference set, rare ones first.  Where all members were
    counted, an element that only one of them has meets nothing and is no key."""
    known, n = (np.frombuffer(pivot.column(c)[0].as_py() or b"", t) for c, t in (("elements", "<u8"), ("counts", "<u4")))
    all_counted = pivot.column("chunks")[0].as_py() == 1
    tag = mix(np.array([key[0].as_py()], np.int64).view(np.uint64) ^ mix(np.array([key[1].as_py()], np.int64).view(np.uint64)))
    keys = []
    for d, least in zip(_difference_sets(members, pivot), members.column("least").to_pylist()):
        at = np.minimum(np.searchsorted(known, d), max(len(known) - 1, 0))
        often = np.where(known[at] == d, n[at], 0) if len(known) else np.zeros(len(d), np.uint32)
        first = np.lexsort([d, often])[: max(0, len(d) - least + 1)]
        if all_counted:
            first = first[often[first] > 0]
        keys.append(mix(d[first] ^ tag).tobytes())
    some = pa.array([len(k) > 0 for k in keys], pa.bool_())
    return pa.table({**{c: members.column(c) for c in ("xa", "xb", "far")}, "keys": pa.array(keys, pa.binary())}).filter(some)


def _meet(batches):
    """Of one partition (all entries of its buckets): keys with two or more local pivots, with the
    least of them; members and sizes pass through."""
    owners, parts, base = [], [], 0
    for batch in batches:
        for own, ent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            k = np.frombuffer(own, "<i8").reshape(-1, 2)
            e = unpack_columns(ent, _DTYPE)
            e["pivot"] += base
            e["text"] += base
            base += len(k)
            owners.append(k)
            parts.append(e)
    if not parts:
        return
    names = np.concatenate(owners)
    e = np.concatenate(parts)
    del owners, parts
    # one text may come under several numbers (from several batches): number them by their order
    _, rank = np.unique(names, axis=0, return_inverse=True)
    rank = rank.reshape(-1)
    rest = e[e["kind"] >= _MEMBER]
    e = e[e["kind"] < _MEMBER]
    e = e[np.lexsort([rank[e["pivot"]], e["key"]])]
    first = np.ones(len(e), bool)
    first[1:] = e["key"][1:] != e["key"][:-1]
    group = np.cumsum(first) - 1
    n = np.bincount(group) if len(e) else np.zeros(0, np.int64)
    any_far = np.zeros(len(n), bool)
    np.logical_or.at(any_far, group, e["kind"] == 1)
    least = e["pivot"][first][group] if len(e) else e["pivot"]
    met = n[group] > 1 if len(e) else np.zeros(0, bool)
    kind = np.concatenate([np.full(int(met.sum()), _PIVOT), np.where(rest["kind"] < _SIZE, _MEMBER, _SIZE)])
    key = np.concatenate([e["key"][met], rest["key"]])
    x = np.concatenate([e["pivot"][met], rest["text"]])
    p = np.concatenate([least[met], rest["pivot"]])
    far = np.concatenate([any_far[group[met]], rest["kind"] == _MEMBER + 1])
    for lo in range(0, len(key), 50_000):
        s = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind[s], pa.int32()), pa.array(key[s].astype(np.int64), pa.int64()),
                pa.array(names[x[s], 0], pa.int64()), pa.array(names[x[s], 1], pa.int64()),
                pa.array(names[p[s], 0], pa.int64()), pa.array(names[p[s], 1], pa.int64()),
                pa.array(far[s], pa.bool_()),
            ],
            names=["kind", "key", "xa", "xb", "pa", "pb", "far"],
        )
    del names, e, rest, kind, key, x, p, far
    give_back()


def _members(met: DataFrame) -> DataFrame:
    """(key, xa, xb): the members of the buckets that have a far member."""
    g = met.where(F.col("kind") == _PIVOT).select("key", F.col("xa").alias("la"), F.col("xb").alias("lb"), F.col("far").alias("gfar"))
    m = met.where(F.col("kind") == _MEMBER).alias("m").join(g.alias("g"), F.expr("m.key = g.key and m.pa = g.la and m.pb = g.lb"), "left")
    m = m.where(F.coalesce("gfar", "far")).select("m.key", "xa", "xb", "pa", "pb", F.col("la").isNull().alias("alone"))
    # a bucket known to one batch only has its local pivot in no other row
    own = m.where("alone").select("key", F.col("pa").alias("xa"), F.col("pb").alias("xb")).distinct()
    return g.where("gfar").select("key", F.col("la").alias("xa"), F.col("lb").alias("xb")).unionByName(m.select("key", "xa", "xb")).unionByName(own)


def _rarer_keys(members: DataFrame, left: DataFrame) -> DataFrame:
    """The members without the keys that a text may leave out (``shingles.sketches``): those of the largest buckets."""
    n = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    odd = F.col("key") < 0
    place = F.row_number().over(Window.partitionBy("xa", "xb", odd).orderBy(F.desc("n"), "key"))
    m = members.join(n, "key").join(left, ["xa", "xb"], "left").withColumn("place", place)
    return m.where(F.col("place") > F.coalesce(F.when(odd, F.col("odd")).otherwise(F.col("even")), F.lit(0))).select("key", "xa", "xb")


def _centrality(members: DataFrame) -> DataFrame:
    """(xa, xb, weight): a text weighs more the more and the larger buckets it shares.  The text that others
    are copies of shares all its blocks with most of them, and makes the best pivot."""
    n = members.groupBy("key").agg(F.log(F.count(F.lit(1))).alias("w"))
    return members.join(n, "key").groupBy("xa", "xb").agg(F.sum("w").alias("weight"))


def _buckets(members: DataFrame, weight: DataFrame, parts: DataFrame | None, name: str) -> DataFrame:
    """(key, x, p, n): each member with its bucket's pivot and size; only buckets of several components.

    The order of pivots is fixed, and a bucket's pivot is its greatest member: along the rounds pivots
    descend, so the rounds end."""
    m = members.join(weight, ["xa", "xb"])
    m = _with_part(m, parts) if parts is not None else m.withColumn("part", F.col("xa"))
    of = m.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "xa", "xb")).alias("top"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    of = of.where("n > 1 and lo <> hi").select("key", "n", F.col("top.xa").alias("pa"), F.col("top.xb").alias("pb"))
    return staged(m.select("key", "xa", "xb").join(of, "key"), name)


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            for lo, part in _slices(batch.column(batch.schema.get_field_index("text"))):
                first, shingles = shingle_sets(part, size)
                sets = [shingles[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(k)).slice(lo, len(part)) for k in KEY), pa.array(np.diff(first), pa.int64()), pa.array(dense_sketches(first, shingles), pa.binary()), pa.array(sets, pa.binary())],
                    names=[*KEY, "n", "sketch", "set"],
                )
            give_back()

    return run


class Sets(Bucketed):
    """(ka, kb, n, sketch, set) of texts; ``elements`` counts the members of all sets."""

    def __init__(self, texts: DataFrame, size: int):
        super().__init__(texts.mapInArrow(_set_rows(size), "ka long, kb long, n long, sketch binary, set binary"), "sets")
        self.elements = self.table.agg(F.sum("n")).first()[0] or 0


def _most(n, m, num: int, den: int):
    """The largest symmetric difference of linked sets of sizes n and m."""
    return (den - num) * (n + m) // (den + num)


def _possible(num: int, den: int):
    """Keeps pairs that the sketches do not rule out, and all pairs of large buckets."""

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            n, m = (np.array(col(c).to_pylist(), np.int64) for c in ("xn", "pn"))
            keep = np.array(col("large").to_pylist(), bool)
            most = _most(n, m, num, den)
            for i in np.flatnonzero(~keep):
                x, p = (np.frombuffer(col(c)[i].as_buffer(), np.uint8) for c in ("xs", "ps"))
                size = min(len(x), len(p))
                keep[i] = int(np.bitwise_count(fold(x, size) ^ fold(p, size)).sum()) <= most[i]
            yield batch.filter(pa.array(keep, pa.bool_())).select([*_PAIR, "large", "xn"])

    return run


def _inside_buckets(num: int, den: int):
    """Pairs of a bucket's members in different components that the sketches do not rule out; of a bucket with more
    than ``listed`` of them only the key."""
    listed = LISTED

    def run(batches):
        for batch in batches:
            found, dense = [], []
            for key, column in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "members"))):
                members, before = column.as_py(), len(found)
                n = np.array([x["n"] for x in members], np.int64)
                part = np.array([x["part"] for x in members], np.int64)
                size = min(len(x["sketch"]) for x in members)
                bits = np.stack([fold(np.frombuffer(x["sketch"], np.uint8), size) for x in members])
                for i in range(len(members) - 1):
                    rest = slice(i + 1, None)
                    differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
                    ok = (part[rest] != part[i]) & (differ <= _most(n[rest], n[i], num, den)) & (den * np.minimum(n[rest], n[i]) >= num * np.maximum(n[rest], n[i]))
                    a = (members[i]["xa"], members[i]["xb"])
                    for j in np.flatnonzero(ok):
                        b = (members[i + 1 + j]["xa"], members[i + 1 + j]["xb"])
                        found.append((*max(a, b), *min(a, b)))
                    if len(found) - before > listed:
                        del found[before:]
                        dense.append(key.as_py())
                        break
            rows = [(None, *f) for f in found] + [(k, None, None, None, None) for k in dense]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["dense", *_PAIR])

    return run


def _set_pairs(batch):
    for x, p in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("x_set", "p_set"))):
        yield np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(p.as_buffer(), "<u8")


def _verify(num: int, den: int):
    """Decides each pair on its sets.  Also the least overlap of the member's difference set with that of any
    partner that the next round is to find."""

    def run(batches):
        for batch in batches:
            far, leasts = [], []
            for x, p in _set_pairs(batch):
                differ = len(np.setxor1d(x, p, assume_unique=True))
                both = (len(x) + len(p) - differ) // 2
                linked = den * both >= num * (len(x) + len(p) - both)
                if linked:  # a far partner shares more than num / (num + den) of the difference
                    least = num * differ // (num + den) + 1
                else:  # any partner differs from x in at most this many shingles
                    least = max(1, differ - (den - num) * len(x) // num)
                far.append(not linked)
                leasts.append(least)
            give_back()
            kept = batch.select([*_PAIR, "large", "xn"])
            yield kept.append_column("far", pa.array(far, pa.bool_())).append_column("least", pa.array(leasts, pa.int32()))

    return run


def _slices_of(pairs: DataFrame, kept: Sets) -> int:
    """In how many slices pairs are to be joined with their sets."""
    return max(1, -(-(pairs.agg(F.sum("xn")).first()[0] or 0) // max(1, kept.elements)))


def _slice(pairs: DataFrame, by: list[str], slices: int, i: int) -> DataFrame:
    return pairs.where(F.pmod(F.xxhash64(*by), F.lit(slices)) == i) if slices > 1 else pairs


def _on_sets(pairs: DataFrame, kept: Sets, task, schema: str, name: str) -> DataFrame:
    """``task`` over the pairs (x, p, xn, ...) with both sets.

    A text may be in many pairs, and each moves its set to the partner's: pairs go in slices that move about as
    many bytes of sets as all texts have, however many pairs there are."""

    def both(these: DataFrame) -> DataFrame:
        for end in "xp":
            own = kept.table.select(F.col("ka").alias(f"{end}a"), F.col("kb").alias(f"{end}b"), F.col("set").alias(f"{end}_set"))
            these = these.join(own, [f"{end}a", f"{end}b"])
        return these.mapInArrow(task, schema)

    slices = _slices_of(pairs, kept)
    return staged_parts((both(_slice(pairs, _PAIR, slices, i)) for i in range(slices)), name)


def _decide(pairs: DataFrame, kept: Sets, num: int, den: int, name: str) -> DataFrame:
    """The pairs (x, p, large) that the sketches let through, with the verdict of the exact sets."""
    for end in "xp":
        own = kept.table.select(F.col("ka").alias(f"{end}a"), F.col("kb").alias(f"{end}b"), F.col("n").alias(f"{end}n"), F.col("sketch").alias(f"{end}s"))
        pairs = pairs.join(own, [f"{end}a", f"{end}b"])
    possible = staged(pairs.mapInArrow(_possible(num, den), "xa long, xb long, pa long, pb long, large boolean, xn long"), "possible", small=True)
    out = _on_sets(possible, kept, _verify(num, den), "xa long, xb long, pa long, pb long, large boolean, xn long, far boolean, least int", name)
    discard(possible)
    return out


def _parts(links: DataFrame) -> DataFrame:
    """(ka, kb, part): the component of every linked text, as the number of one of its texts."""
    ends = links.select(F.col("xa").alias("ka"), F.col("xb").alias("kb")).unionByName(links.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"))).distinct()
    nodes = staged(ends.withColumn("node", F.monotonically_increasing_id()), "nodes", small=True)
    u = nodes.select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), F.col("node").alias("u"))
    v = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("node").alias("v"))
    with recorded() as rounds:
        roots = components(links.join(u, ["xa", "xb"]).join(v, ["pa", "pb"]).select("u", "v"))
    parts = staged(nodes.join(roots, "node").select(*KEY, F.col("root").alias("part")), "parts", small=True)
    delete_scratch(links.sparkSession, [nodes._scratch, *rounds])
    return parts


def _with_part(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds each member's component; a text without links is a component of its own."""
    of = parts.select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), "part")
    return members.join(of, ["xa", "xb"], "left").withColumn("part", F.coalesce("part", "xa"))


def _next_keys(verified: DataFrame, parts: DataFrame, kept: Sets) -> DataFrame:
    """(x, far, keys) of the members of large buckets whose pivot has a far member and members of several
    components.

    The elements of a pivot's members are ordered by how often they occur in some ``CHUNK`` of the members
    (any order gives the same links; rare elements first make small buckets).  Members are taken ``CHUNK``
    at a time, so a pivot with any number of them is no large group.  The members' sets meet the pivot's there, some
    pivots at a time, and difference sets are never written."""
    large = _with_part(verified.where("large"), parts)
    of = large.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("members"), F.max("far").alias("any_far"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    of = of.where("members > 1 and any_far and lo <> hi").select("pa", "pb", F.ceil(F.col("members") / CHUNK).alias("chunks"))
    pairs = large.join(of, ["pa", "pb"]).select(*_PAIR, "far", "least", "chunks", "xn")
    pairs = staged(pairs.withColumn("chunk", F.pmod(F.xxhash64("xa", "xb"), F.col("chunks"))), "open", small=True)
    if pairs.isEmpty():
        discard(pairs)
        return staged(pairs.sparkSession.createDataFrame([], _KEYS), "keys", small=True)
    slices = _slices_of(pairs, kept)
    group = ["pa", "pb", "chunk"]
    x_sets = kept.table.select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), F.col("set").alias("x_set"))
    p_sets = kept.table.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("set").alias("p_set"))

    def keys_of_slices():
        for i in range(slices):
            these = _slice(pairs, ["pa", "pb"], slices, i)
            members = these.join(x_sets, ["xa", "xb"]).select(*group, "xa", "xb", "far", "least", "x_set")
            pivots = these.select(*group, "chunks").distinct().join(p_sets, ["pa", "pb"]).toDF("pa", "pb", "chunk", "chunks", "p_set")
            counts = members.where("chunk = 0").groupBy(*group).cogroup(pivots.where("chunk = 0").groupBy(*group))
            counts = staged(counts.applyInArrow(_element_counts, "pa long, pb long, elements binary, counts binary"), "counts", small=True)
            pivots = pivots.join(counts, ["pa", "pb"], "left")
            yield members.groupBy(*group).cogroup(pivots.groupBy(*group)).applyInArrow(_first_elements, _KEYS)
            discard(counts)

    keys = staged_parts(keys_of_slices(), "keys")
    discard(pairs)
    return keys


def _components_of_texts(rows: DataFrame, size: int, num: int, den: int):
    """((ka, kb, n_shingles) of the texts of ``rows(id, text)``, (ka, kb, part) of those with links)."""
    with small_batches(rows.sparkSession):
        return _linked_texts(rows, size, num, den)


def _linked_texts(rows: DataFrame, size: int, num: int, den: int):
    texts = DistinctTexts(rows)
    with few_files(rows.sparkSession, texts.path):
        return _links_found(texts, size, num, den)


def _links_found(texts: DistinctTexts, size: int, num: int, den: int):
    n = shuffle_partitions(texts.spark)
    buckets = 2 * n
    dealt = texts.table.mapInArrow(_sketches(size, num, den, buckets), _ENTRY).repartition(n, "bucket")
    met = staged(dealt.mapInArrow(_meet, _MET), "met")
    del dealt
    of_texts = met.where(F.col("kind") == _SIZE)
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    sizes = staged(of_texts.select(F.col("xa").alias("ka"), F.col("xb").alias("kb"), low(F.col("key"), _SIZE_BITS).alias("n_shingles")), "sizes", small=True)
    left = of_texts.select("xa", "xb", *(low(F.shiftright("key", _SIZE_BITS + i * _LEFT_BITS), _LEFT_BITS).alias(c) for i, c in enumerate(("even", "odd"))))
    shared = staged(_members(met), "shared")
    members = staged(_rarer_keys(shared, left.where("even > 0 or odd > 0")), "members")
    discard(met, shared)
    weight = staged(_centrality(members), "weight", small=True)
    ends = weight.select(F.col("xa").alias("ka"), F.col("xb").alias("kb"))
    kept = Sets(texts.table.join(ends, KEY, "left_semi"), size)
    texts.drop()
    parts = todo = None
    while True:
        buckets_of = _buckets(members, weight, parts, "buckets")
        discard(members)
        if parts is not None and buckets_of.isEmpty():
            discard(buckets_of)
            break
        stars = buckets_of.where("not (xa = pa and xb = pb)").groupBy(*_PAIR).agg(F.max(F.col("n") > SMALL).alias("large"))
        verified = _decide(stars, kept, num, den, "stars")
        parts = _more_links(parts, verified.where("not far").select(*_PAIR))
        labelled = staged(_with_part(buckets_of.where(F.col("n").between(3, SMALL)), parts), "labelled", small=True)
        discard(buckets_of)
        mixed = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
        light = kept.table.select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), F.col("n").alias("size"), "sketch")
        # at most SMALL members each
        of_key = labelled.join(mixed, "key").join(light, ["xa", "xb"]).groupBy("key").agg(F.collect_list(F.struct("xa", "xb", "part", F.col("size").alias("n"), "sketch")).alias("members"))
        found = staged(of_key.mapInArrow(_inside_buckets(num, den), "dense long, xa long, xb long, pa long, pb long"), "found", small=True)
        more = _decide(found.where("dense is null").select(*_PAIR, F.lit(False).alias("large")).distinct(), kept, num, den, "inside")
        parts = _more_links(parts, more.where("not far").select(*_PAIR))
        dense = found.where("dense is not null").select(F.col("dense").alias("key"))
        if not dense.isEmpty():
            rays = labelled.join(dense, "key").where("not (xa = pa and xb = pb)").select(*_PAIR, F.lit(True).alias("large")).distinct()
            again = _decide(rays, kept, num, den, "dense")
            both = staged(verified.where("large").unionByName(again).dropDuplicates(_PAIR), "stars", small=True)
            discard(verified, again)
            verified = both
        discard(more, labelled, found)
        todo = _next_keys(verified, parts, kept)
        discard(verified)
        if todo.isEmpty():
            break
        level = staged(todo.mapInArrow(_differences(buckets), _ENTRY).repartition(n, "bucket").mapInArrow(_meet, _MET), "level")
        discard(todo)
        members = staged(_members(level), "members")
        discard(level)
    kept.drop()
    discard(weight, todo)
    return sizes, parts


def _more_links(parts: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components that the links found make with those known; what they replace is deleted.

    Known components are single nodes here, so the work is that of the links between different ones."""
    if parts is None:
        links = staged(found, "links", small=True)
        parts = _parts(links)
        discard(links)
        return parts
    for end in "xp":
        of = parts.select(F.col("ka").alias(f"{end}a"), F.col("kb").alias(f"{end}b"), F.col("part").alias(f"{end}_part"))
        found = found.join(of, [f"{end}a", f"{end}b"], "left")
    links = staged(found.where("x_part is null or p_part is null or x_part <> p_part"), "links", small=True)
    if links.isEmpty():
        discard(links)
        return parts
    # texts without links up to now get numbers above all in use
    ends = [links.where(f"{end}_part is null").select(F.col(f"{end}a").alias("ka"), F.col(f"{end}b").alias("kb")) for end in "xp"]
    above = parts.agg(F.max("part")).first()[0]
    above = 0 if above is None else above + 1
    first = staged(ends[0].unionByName(ends[1]).distinct().withColumn("node", F.monotonically_increasing_id() + F.lit(above)), "nodes", small=True)
    edges = links
    for end, node in zip("xp", "uv"):
        of = first.select(F.col("ka").alias(f"{end}a"), F.col("kb").alias(f"{end}b"), F.col("node").alias(node))
        edges = edges.join(of, [f"{end}a", f"{end}b"], "left").withColumn(node, F.coalesce(f"{end}_part", node))
    with recorded() as rounds:
        roots = components(edges.select("u", "v"))
    nodes = parts.withColumnRenamed("part", "node").unionByName(first)
    now = staged(nodes.join(roots, "node", "left").select(*KEY, F.coalesce("root", "node").alias("part")), "parts", small=True)
    discard(parts, links, first)
    delete_scratch(parts.sparkSession, rounds)
    return now


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100,
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (its set's size) and ``component_id`` (the least
    id that links reach from it, its own included)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = with_key(rows).select("id", *KEY)
    sizes, parts = _components_of_texts(rows, size, num, den)
    # the least id of each component
    least = ids.groupBy(*KEY).agg(F.min("id").alias("least"))
    member = parts.join(least, KEY)
    of_part = member.groupBy("part").agg(F.min("least").alias("component"))
    grouped = member.join(of_part, "part").select(*KEY, "component")
    per_text = staged(
        least.join(sizes, KEY).join(grouped, KEY, "left").select(*KEY, "n_shingles", F.coalesce("component", "least").alias("component")), "groups"
    )
    release(docs.sparkSession)
    return ids.join(per_text, KEY).select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


#: most rows with copies that are sent to the tasks
SEND_LIMIT = 100_000


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of linked texts (own columns, own order of columns): that of the least id
    (NULL comes last), then of the least text key; of rows that agree in id and text one stays.

    Rows whose text has no words are similar to nothing and all stay."""
    sizes, parts = _components_of_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, num, den)
    src = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = with_key(docs.toDF(*src.values()), src[text_col])
    has_words = F.coalesce(F.col(src[text_col]).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = rows.select(F.col(src[id_col]).alias("_id"), *KEY, has_words.alias("words"))
    own = staged(own.groupBy("_id", *KEY, "words").agg(F.count(F.lit(1)).alias("copies")), "rows")
    first = own.where("words").groupBy(*KEY).agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", *KEY, "copies")).alias("first"))
    texts = first.join(parts, KEY, "left")
    linked = texts.where("part is not null").groupBy("part").agg(F.min("first").alias("first"))
    pick = ["_id", F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "copies"]
    chosen = texts.where("part is null").select("first.*").unionByName(linked.select("first.*")).select(*pick)
    chosen = staged(chosen.unionByName(own.where("not words").select("_id", *pick[1:3], F.lit(1).cast("long").alias("copies"))), "chosen")

    def of(these: DataFrame) -> DataFrame:
        same = rows[src[id_col]].eqNullSafe(these["_id"]) & (rows["ka"] == these["_ka"]) & (rows["kb"] == these["_kb"])
        return rows.join(these, same, "left_semi")

    out = of(chosen.where("copies = 1"))
    repeated = chosen.where("copies > 1")
    n = repeated.count()
    if n:
        out = out.unionByName(of(F.broadcast(repeated) if n <= SEND_LIMIT else repeated).dropDuplicates([src[id_col], *KEY]))
    return out.select(*[F.col(a).alias(c) for c, a in src.items()])
