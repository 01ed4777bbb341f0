"""Dedup inside the result."""

from pyspark.sql import functions as F

from tidemark.operators import compare as cmp
from tidemark.operators import dedup as dd


def _flag(mk, data):
    lake = mk(data)
    lib = mk([("zz.pdf", 999999, "q", "q")], "/lib")
    return cmp.missing_from(lake, lib)


def test_content_dedup_keeps_min_path_and_reports(mk):
    m = _flag(mk, [("b.pdf", 10, "p", "h1"), ("a.pdf", 10, "p", "h1"), ("c.pdf", 10, "p", "h2")])
    res = dd.dedup_content(m)
    assert sorted(r["filename"] for r in res.kept.collect()) == ["a.pdf", "c.pdf"]
    rep = [r.asDict() for r in res.duplicates.collect()]
    assert rep == [{"duplicate_path": "/lake/b.pdf", "original_path": "/lake/a.pdf", "method": "full_hash",
                    "file_size": "10", "filename": "b.pdf"}]
    s = res.summary.first()
    assert (s["before"], s["after"], s["removed"]) == (3, 2, 1)


def test_tiered_dedup_drops_equal_sizes_never_compared(mk):
    # all decided at stage 1 (size not in library): the tiered rule keys them by size only
    m = _flag(mk, [("a.pdf", 10, "p1", "h1"), ("b.pdf", 10, "p2", "h2"), ("c.pdf", 11, "p3", "h3")])
    tiered = dd.dedup_tiered(m)
    assert sorted(r["filename"] for r in tiered.kept.collect()) == ["a.pdf", "c.pdf"]
    assert {r["method"] for r in tiered.duplicates.collect()} == {"size_only"}
    # content dedup keeps the different contents
    assert dd.dedup_content(m).kept.count() == 3


def test_tiers_do_not_cross(mk):
    lib = mk([("l1.pdf", 10, "p", "hx"), ("l2.pdf", 20, "q", "hy")], "/lib")
    lake = mk([("a.pdf", 10, "p", "h1"),  # stage 3 -> full_hash tier
               ("b.pdf", 20, "z", "h1"),  # stage 2 -> size+1k tier (inconsistent hash on purpose)
               ("c.pdf", 30, "p", "h1")])  # stage 1 -> size tier
    m = cmp.missing_from(lake, lib)
    got = {r["filename"]: r["method"] for r in dd.dedup_tiered(m).kept.collect()}
    assert got == {"a.pdf": "full_hash", "b.pdf": "size+1k_hash", "c.pdf": "size_only"}


def test_hot_key_is_aggregated(mk):
    # one content a thousand times: one keeper, 999 report rows
    m = _flag(mk, [(f"d{i:04d}.pdf", 10, "p", "same") for i in range(1000)])
    res = dd.dedup_content(m)
    assert res.kept.count() == 1
    assert res.kept.first()["filename"] == "d0000.pdf"
    assert res.duplicates.count() == 999
    assert res.duplicates.where(F.col("original_path") != "/lake/d0000.pdf").count() == 0


def test_complete_hashes_reads_only_colliding_sizes(mk):
    m = _flag(mk, [("a.pdf", 10, None, None), ("b.pdf", 10, None, None), ("c.pdf", 11, None, None)])
    asked = []

    def add(df, stage):
        asked.append((stage, sorted(r["filename"] for r in df.collect())))
        col = "prefix_hash" if stage == "1k" else "full_hash"
        return df.withColumn(col, F.lit("same"))

    done = dd.complete_hashes(m, add, pin=lambda d: d)
    assert ("1k", ["a.pdf", "b.pdf"]) in asked
    assert dd.dedup_content(done).kept.count() == 2
