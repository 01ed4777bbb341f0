"""Cascade on constructed rows: one case per stage, both NULL policies (FIXTURES 1)."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare as cmp


def stages(df):
    return {r["filename"]: r["stage"] for r in df.select("filename", "stage").collect()}


def test_all_equal_is_duplicate(mk):
    lake = mk([("a.pdf", 100, "p", "f")])
    lib = mk([("b.pdf", 100, "p", "f")], "/lib")
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "duplicate"}
    assert cmp.missing_from(lake, lib).count() == 0


def test_empty_library_everything_unique_by_size(mk, spark):
    lake = mk([("a.pdf", 100, None, None), ("b.pdf", 200, None, None)])
    lib = spark.createDataFrame([], lake.schema)
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "size", "b.pdf": "size"}


def test_size_differs(mk):
    lake = mk([("a.pdf", 100, "p", "f")])
    lib = mk([("b.pdf", 200, "p", "f")], "/lib")
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "size"}


def test_prefix_differs(mk):
    lake = mk([("a.pdf", 100, "p1", "f")])
    lib = mk([("b.pdf", 100, "p2", "f2")], "/lib")
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "prefix"}


def test_full_differs(mk):
    lake = mk([("a.pdf", 100, "p", "f1")])
    lib = mk([("b.pdf", 100, "p", "f2")], "/lib")
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "full"}


def test_full_hash_missing_policies(mk):
    lake = mk([("a.pdf", 100, "p", None)])
    lib = mk([("b.pdf", 100, "p", None)], "/lib")
    assert stages(cmp.classify(lake, lib, "keep")) == {"a.pdf": "full"}
    assert stages(cmp.classify(lake, lib, "drop")) == {"a.pdf": "unhashed"}
    assert cmp.missing_from(lake, lib, "drop").count() == 0


def test_prefix_hash_missing_policies(mk):
    lake = mk([("a.pdf", 100, None, None)])
    lib = mk([("b.pdf", 100, "p", "f")], "/lib")
    assert stages(cmp.classify(lake, lib, "keep")) == {"a.pdf": "prefix"}
    assert stages(cmp.classify(lake, lib, "drop")) == {"a.pdf": "unhashed"}


def test_library_null_hash_matches_nothing(mk):
    lake = mk([("a.pdf", 100, "p", "f")])
    lib = mk([("b.pdf", 100, None, None)], "/lib")
    assert stages(cmp.classify(lake, lib)) == {"a.pdf": "prefix"}


def test_status_per_stage(mk):
    lake = mk([("s.pdf", 1, "p", "f"), ("p.pdf", 100, "x", "f"), ("f.pdf", 100, "p", "y"), ("d.pdf", 100, "p", "f")])
    lib = mk([("b.pdf", 100, "p", "f")], "/lib")
    got = {r["filename"]: (r["stage"], r["stage_no"], r["processing_status"]) for r in cmp.classify(lake, lib).collect()}
    assert got == {
        "s.pdf": ("size", 1, "size_checked"),
        "p.pdf": ("prefix", 2, "1k_hashed"),
        "f.pdf": ("full", 3, "full_hashed"),
        "d.pdf": ("duplicate", 3, "full_hashed"),
    }


def test_each_row_in_exactly_one_stage_and_split_functions_agree(mk):
    # consistent hashes: equal content has equal size and prefix
    data = [(f"f{i}.pdf", 100 + i % 3, f"p{i % 4}", f"h{100 + i % 3}{i % 4}{i % 2}") for i in range(40)]
    libdata = [(f"g{i}.pdf", 100 + i % 2, f"p{i % 3}", f"h{100 + i % 2}{i % 3}0") for i in range(10)]
    lake, lib = mk(data), mk(libdata, "/lib")
    flagged = cmp.classify(lake, lib)
    assert flagged.count() == 40
    assert flagged.select("full_path").distinct().count() == 40
    u1, c1 = cmp.stage_size(lake, lib)
    u2, c2 = cmp.stage_prefix(c1, lib)
    u3, d3 = cmp.stage_full(c2, lib)
    by = lambda st: {r[0] for r in flagged.where(F.col("stage") == st).select("full_path").collect()}
    paths = lambda df: {r[0] for r in df.select("full_path").collect()}
    assert by("size") == paths(u1)
    assert by("prefix") == paths(u2)
    assert by("full") == paths(u3)
    assert by("duplicate") == paths(d3)


def test_library_equal_to_lake_gives_nothing(mk):
    data = [(f"f{i}.pdf", 10 + i, f"p{i}", f"h{i}") for i in range(12)]
    assert cmp.missing_from(mk(data), mk(data, "/lib")).count() == 0


def test_bad_policy_rejected(mk):
    lake = mk([("a.pdf", 1, "p", "f")])
    with pytest.raises(ValueError):
        cmp.classify(lake, lake, "maybe")


def test_last_added_wins_in_full_hash_index(mk):
    lib = mk([("x.pdf", 5, "p", "same"), ("y.pdf", 5, "p", "same")], "/lib")
    lake = mk([("a.pdf", 5, "p", "same")])
    got = cmp.lookup_by_full_hash(lake, lib).collect()
    assert [r["library_full_path"] for r in got] == ["/lib/y.pdf"]


def test_staged_cascade_equals_one_pass(mk):
    data = [(f"f{i}.pdf", 100 + i % 3, f"p{i % 4}", f"h{100 + i % 3}{i % 4}{i % 2}") for i in range(30)]
    libdata = [(f"g{i}.pdf", 100 + i % 2, f"p{i % 3}", f"h{100 + i % 2}{i % 3}0") for i in range(10)]
    lake, lib = mk(data), mk(libdata, "/lib")

    # hashes "computed" by a lookup into the known values: the staged form must reach the same verdicts
    known = {**{f"/lake/{d[0]}": d for d in data}, **{f"/lib/{d[0]}": d for d in libdata}}

    def add(df, stage):
        col = "prefix_hash" if stage == "1k" else "full_hash"
        idx = 2 if stage == "1k" else 3
        m = df.sparkSession.createDataFrame([(k, v[idx]) for k, v in known.items()], f"full_path string, _h string")
        return df.join(m, "full_path", "left").withColumn(col, F.coalesce(F.col(col), F.col("_h"))).select(*df.columns)

    blank = lambda d: d.withColumn("prefix_hash", F.lit(None).cast("string")).withColumn("full_hash", F.lit(None).cast("string"))
    staged = cmp.classify_staged(blank(lake), blank(lib), add)
    one = cmp.classify(lake, lib)
    s = {r["full_path"]: r["stage"] for r in staged.collect()}
    o = {r["full_path"]: r["stage"] for r in one.collect()}
    assert s == o
