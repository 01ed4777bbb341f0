"""Property tests: random lakes and libraries with many collisions (equal
sizes, equal first 1 KB, exact copies), run through the real hashing, cascade and dedup, compared
with a brute-force model; the result must not depend on partitioning or input order."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import compare as cmp
from tidemark.operators import dedup as dd
from tidemark.sources.tables import table_manifest

HEAD = "h" * 1024  # a shared first kilobyte makes stage-2 collisions likely


def _texts():
    body = st.text(alphabet="ab", min_size=0, max_size=4)
    return st.lists(st.tuples(st.booleans(), body), min_size=0, max_size=12).map(
        lambda xs: [(HEAD + b) if long else b for long, b in xs]
    )


def _model(lake, lib):
    enc = lambda t: t.encode()
    sizes = {len(enc(t)) for t in lib}
    pref = {(len(enc(t)), hashlib.sha256(enc(t)[:1024]).hexdigest()) for t in lib}
    full = {hashlib.sha256(enc(t)).hexdigest() for t in lib}
    stages = {}
    for i, t in enumerate(lake):
        b = enc(t)
        if len(b) not in sizes:
            s = "size"
        elif (len(b), hashlib.sha256(b[:1024]).hexdigest()) not in pref:
            s = "prefix"
        elif hashlib.sha256(b).hexdigest() not in full:
            s = "full"
        else:
            s = "duplicate"
        stages[i] = s
    order = {"size": 1, "prefix": 2, "full": 3}
    keep = {}
    for i, t in enumerate(lake):
        if stages[i] == "duplicate":
            continue
        k = hashlib.sha256(enc(t)).hexdigest()
        cand = (order[stages[i]], f"/lake/{i:04d}.txt", i)
        keep[k] = min(keep.get(k, cand), cand)
    return stages, {c[2] for c in keep.values()}


def _manifest(spark, texts, root, order):
    rows = [(i, t) for i, t in enumerate(texts)]
    if order:
        rows = rows[::-1]
    df = spark.createDataFrame(rows, "id bigint, text string")
    rel = F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".txt"))
    return table_manifest(df, "text", root, rel, "id", keep=("id",))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lake=_texts(), lib=_texts(), parts=st.sampled_from([1, 3, 8]), reverse=st.booleans())
def test_cascade_and_dedup_match_brute_force(spark, lake, lib, parts, reverse):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        lk = _manifest(spark, lake, "/lake", reverse).repartition(parts)
        lb = _manifest(spark, lib, "/lib", not reverse)
        flagged = cmp.classify(lk, lb)
        got = {r["id"]: r["stage"] for r in flagged.collect()}
        kept = {r["id"] for r in dd.dedup_content(cmp.missing_only(flagged)).kept.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    stages, keep = _model(lake, lib)
    assert got == stages
    assert kept == keep


def _copy_model(rows, existing, mode):
    """Sequential copier: rows in position order; a name taken (existing or written earlier) is a
    conflict.  Returns outcome per position (rename targets are checked separately)."""
    taken = set(existing)
    out = {}
    live_by_name = {}
    for pos, name, live in rows:
        if live:
            live_by_name.setdefault(name, []).append(pos)
    for pos, name, live in rows:
        if not live:
            out[pos] = "failed"
        elif mode == "skip":
            out[pos] = "skipped" if name in taken else "copied"
            taken.add(name)
        elif mode == "overwrite":
            if pos != live_by_name[name][-1]:
                out[pos] = "superseded"
            else:
                out[pos] = "overwritten" if name in existing else "copied"
        else:
            out[pos] = "renamed" if name in taken else "copied"
            taken.add(name)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from(["a.pdf", "b.pdf", "c", "a_x.pdf"]), st.booleans()), min_size=1, max_size=15),
    existing=st.sets(st.sampled_from(["a.pdf", "c", "z.pdf"]), max_size=3),
    mode=st.sampled_from(["skip", "overwrite", "rename"]),
)
def test_copy_plan_matches_sequential_model(spark, rows, existing, mode):
    from tidemark.operators.copyplan import plan_copy

    data = [(f"/src/d{i}/{name}", f"d{i}/{name}", name, 1, i) for i, (name, _) in enumerate(rows)]
    m = spark.createDataFrame(data, "full_path string, relative_path string, filename string, file_size bigint, position bigint")
    sources = spark.createDataFrame([(d[0],) for d, (_, live) in zip(data, rows) if live] or [("/none",)], "full_path string")
    ex = spark.createDataFrame([(e,) for e in existing] or [("/none",)], "filename string")
    plan = {r["position"]: r for r in plan_copy(m, "/t", mode, sources=sources, existing=ex).collect()}
    model = _copy_model([(i, name, live) for i, (name, live) in enumerate(rows)], existing, mode)
    assert {p: r["outcome"] for p, r in plan.items()} == model
    written = [r["target"] for r in plan.values() if r["outcome"] in ("copied", "renamed", "overwritten")]
    assert len(written) == len(set(written))  # no target named twice
    if mode == "rename":
        assert not ({t.rsplit("/", 1)[-1] for t in written} & set(existing))  # nothing existing is overwritten
