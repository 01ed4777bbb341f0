"""E1/E2 and R1 on temp trees: analyse -> manifest -> copy; resume keeps prior rows."""

import os

from tidemark.plans.analyze import run_analysis
from tidemark.plans.copy import copy_manifest
from tidemark.sources.manifest_io import read_manifest


def _w(p, data):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def _trees(tmp_path):
    lake, lib = tmp_path / "lake", tmp_path / "lib"
    big = os.urandom(3000)
    _w(lib / "A" / "have.pdf", b"same content")          # equal content in both
    _w(lake / "x" / "have_too.pdf", b"same content")
    _w(lake / "only.epub", b"only in the lake")          # size unique: stage 1
    _w(lib / "B" / "pref.pdf", b"P" * 1024 + b"lib-tail!")  # same size, same first 1 KB, differs later
    _w(lake / "pref.pdf", b"P" * 1024 + b"lake-tail")
    _w(lib / "C" / "head.pdf", b"a" * 50)                # same size, other prefix: stage 2
    _w(lake / "head.pdf", b"b" * 50)
    _w(lake / "d1" / "big.pdf", big)                     # two copies inside the lake, not in library
    _w(lake / "d2" / "big.pdf", big)
    _w(lake / "notes.doc", b"not a requested type")
    return lake, lib


def test_analyze_then_copy(spark, tmp_path):
    lake, lib = _trees(tmp_path)
    out = str(tmp_path / "missing")
    counts = run_analysis(spark, str(lake), str(lib), out, large_threshold=2000)
    assert counts["duplicate"] == 1 and counts["size"] == 3 and counts["prefix"] == 1 and counts["full"] == 1
    assert (counts["route_large"], counts["route_small"]) == (2, 4)  # the two 3000-byte copies are large
    good, _ = read_manifest(spark, out)
    rel = sorted(r["relative_path"] for r in good.collect())
    assert rel == ["d1/big.pdf", "head.pdf", "only.epub", "pref.pdf"]  # d2/big.pdf is a duplicate of d1
    dup_dir = out + "_duplicates"
    assert os.path.isfile(dup_dir)
    results, summary = copy_manifest(spark, out, str(tmp_path / "import"), mode="rename")
    s = summary.first()
    assert (s["total"], s["success"], s["failed"]) == (4, 4, 0)
    assert sorted(os.listdir(tmp_path / "import")) == ["big.pdf", "head.pdf", "only.epub", "pref.pdf"]


def test_tiered_parity_loses_equal_sizes(spark, tmp_path):
    lake, lib = tmp_path / "lake", tmp_path / "lib"
    _w(lib / "x.pdf", b"z")
    _w(lake / "a.pdf", b"1234")
    _w(lake / "b.pdf", b"5678")  # same size, different content, never compared
    safe = run_analysis(spark, str(lake), str(lib), str(tmp_path / "o1"))
    tiered = run_analysis(spark, str(lake), str(lib), str(tmp_path / "o2"), dedup="tiered")
    assert safe["written"] == 2 and tiered["written"] == 1


def test_resume_keeps_prior_rows(spark, tmp_path):
    lake, lib = _trees(tmp_path)
    first = str(tmp_path / "m1")
    run_analysis(spark, str(lake), str(lib), first)
    _w(lake / "new" / "late.pdf", b"arrived later")
    second = str(tmp_path / "m2")
    counts = run_analysis(spark, str(lake), str(lib), second, resume_from=first)
    rel = sorted(r["relative_path"] for r in read_manifest(spark, second)[0].collect())
    assert rel == ["d1/big.pdf", "head.pdf", "new/late.pdf", "only.epub", "pref.pdf"]
    assert counts["written"] == 5
    assert counts["route_skip"] == 4 and counts["route_small"] == 3  # paths of the prior manifest are skipped


def test_empty_library(spark, tmp_path):
    lake = tmp_path / "lake"
    _w(lake / "a.pdf", b"1")
    (tmp_path / "lib").mkdir()
    counts = run_analysis(spark, str(lake), str(tmp_path / "lib"), str(tmp_path / "o"))
    assert counts == {"size": 1, "written": 1, "route_small": 1}


def test_resume_rechecks_prior_rows_against_a_changed_library(spark, tmp_path):
    from tidemark.sources.manifest_io import read_manifest as rm

    lake, lib = _trees(tmp_path)
    first = str(tmp_path / "state1")
    run_analysis(spark, str(lake), str(lib), first, fmt="parquet")
    prior_rel = sorted(r["relative_path"] for r in rm(spark, first, fmt="parquet")[0].collect())
    assert "only.epub" in prior_rel
    # the library gains a copy of an item the first run found missing
    _w(lib / "D" / "only_copy.epub", b"only in the lake")
    second = str(tmp_path / "state2")
    run_analysis(spark, str(lake), str(lib), second, resume_from=first, fmt="parquet")
    rel = sorted(r["relative_path"] for r in rm(spark, second, fmt="parquet")[0].collect())
    assert rel == [p for p in prior_rel if p != "only.epub"]


def test_file_vanishing_before_hashing_is_kept_with_error(spark, tmp_path):
    from tidemark.plans.analyze import analyze
    from tidemark.session import materialize
    from tidemark.sources.files import scan_manifest
    from tidemark.sources.readers import file_hasher

    lake, lib = tmp_path / "lake", tmp_path / "lib"
    _w(lib / "a.pdf", b"x" * 40)
    _w(lake / "gone.pdf", b"y" * 40)  # same size: needs a prefix hash
    lake_m = materialize(scan_manifest(spark, str(lake)))
    lib_m = materialize(scan_manifest(spark, str(lib)))
    lake_m.count()
    (lake / "gone.pdf").unlink()
    res = analyze(lake_m, lib_m, add_hashes=file_hasher())
    rows = res.flagged.collect()
    assert [(r["filename"], r["stage"]) for r in rows] == [("gone.pdf", "prefix")]
    assert rows[0]["prefix_hash"] is None and "FileNotFoundError" in rows[0]["error_message"]
    drop = analyze(lake_m, lib_m, add_hashes=file_hasher(), on_unhashed="drop")
    assert drop.missing.count() == 0


def test_file_path_agrees_with_table_path(spark, tmp_path):
    """The documents of sf0.01 written as two trees: the file cascade (listing, ranged and chunked
    reads in Python) gives the same stages and the same kept items as the table cascade (JVM
    digests in the scan projection)."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tidemark.plans.analyze import analyze
    from tidemark.plans.catalog import lake_library

    sf = "/root/testdata/sf0.01"
    root = str(tmp_path)

    def write(batches):
        for pdf in batches:
            for doc_id, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                side = "lake" if doc_id % 2 else "library"
                d = os.path.join(root, side, str(source), str(doc_id))
                os.makedirs(d, exist_ok=True)
                with open(os.path.join(d, f"doc_{doc_id % 100}.txt"), "wb") as f:
                    f.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    docs.repartition(4).mapInPandas(write, "n long").collect()
    counts = run_analysis(spark, f"{root}/lake", f"{root}/library", f"{root}/out")
    counts = {k: v for k, v in counts.items() if not k.startswith("route_")}
    files_kept = {r["relative_path"] for r in read_manifest(spark, f"{root}/out")[0].collect()}

    lake, lib = lake_library(spark, sf)
    res = analyze(lake, lib)
    table_counts = {r["stage"]: r["n_files"] for r in res.summary.collect()}
    table_kept = {r["relative_path"] for r in res.missing.collect()}
    assert {k: v for k, v in counts.items() if k != "written"} == table_counts
    assert files_kept == table_kept and counts["written"] == len(table_kept)


def test_binary_file_listing_gives_the_same_result(spark, tmp_path):
    lake, lib = _trees(tmp_path)
    a = run_analysis(spark, str(lake), str(lib), str(tmp_path / "o1"))
    b = run_analysis(spark, str(lake), str(lib), str(tmp_path / "o2"), include_hidden=False)
    assert a == b
    rel = lambda p: sorted(r["relative_path"] for r in read_manifest(spark, p)[0].collect())
    assert rel(str(tmp_path / "o1")) == rel(str(tmp_path / "o2"))


def test_duplicates_report_of_a_file_run(spark, tmp_path):
    lake, lib = _trees(tmp_path)
    out = str(tmp_path / "m")
    run_analysis(spark, str(lake), str(lib), out)
    rep = spark.read.option("header", True).csv(out + "_duplicates").collect()
    assert [(r["duplicate_path"], r["original_path"], r["method"], r["file_size"], r["filename"]) for r in rep] == [
        (str(lake / "d2" / "big.pdf"), str(lake / "d1" / "big.pdf"), "full_hash", "3000", "big.pdf")
    ]
