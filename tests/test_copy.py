"""Copy plan and copy job."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import copyplan as cp
from tidemark.operators.copyjob import run_copy
from tidemark.operators.metrics import copy_summary
from tidemark.plans.copy import copy_manifest
from tidemark.session import materialize


def _plan_rows(plan):
    return {r["source"]: r for r in plan.collect()}


def _m(mk, names):
    return mk([(n, 1, None, None) for n in names])


def test_invalid_mode(mk):
    with pytest.raises(ValueError):
        cp.plan_copy(_m(mk, ["a.pdf"]), "/t", "merge")


def test_flat_target_from_nested_source(mk):
    plan = _plan_rows(cp.plan_copy(_m(mk, ["x/y/z/book.pdf"]), "/t"))
    r = plan["/lake/x/y/z/book.pdf"]
    assert (r["target"], r["outcome"], r["success"]) == ("/t/book.pdf", "copied", True)
    assert r["message"] == "Would copy to: /t/book.pdf"


def test_skip_mode_conflicts(spark, mk):
    existing = spark.createDataFrame([("taken.pdf",)], "filename string")
    m = _m(mk, ["a/taken.pdf", "a/dup.pdf", "b/dup.pdf"])
    plan = _plan_rows(cp.plan_copy(m, "/t", "skip", existing=existing))
    assert plan["/lake/a/taken.pdf"]["outcome"] == "skipped"
    assert plan["/lake/a/taken.pdf"]["message"] == "Target file exists, skipping: /t/taken.pdf"
    assert plan["/lake/a/dup.pdf"]["outcome"] == "copied"  # first in the batch takes the name
    assert plan["/lake/b/dup.pdf"]["outcome"] == "skipped"


def test_overwrite_mode_last_wins(spark, mk):
    existing = spark.createDataFrame([("dup.pdf",)], "filename string")
    plan = _plan_rows(cp.plan_copy(_m(mk, ["a/dup.pdf", "b/dup.pdf"]), "/t", "overwrite", existing=existing))
    assert plan["/lake/a/dup.pdf"]["outcome"] == "superseded"
    assert plan["/lake/b/dup.pdf"]["outcome"] == "overwritten"


def test_rename_mode_unique_targets(spark, mk):
    existing = spark.createDataFrame([("dup.pdf",), ("x.pdf",)], "filename string")
    names = [f"d{i}/dup.pdf" for i in range(20)] + ["x.pdf", "y"]
    plan = cp.plan_copy(_m(mk, names), "/t", "rename", existing=existing)
    rows = plan.collect()
    targets = [r["target"] for r in rows]
    assert len(set(targets)) == len(targets)
    assert all(r["outcome"] == "renamed" for r in rows if r["filename"] in ("dup.pdf", "x.pdf"))
    r = {x["relative_path"]: x for x in rows}
    assert r["y"]["target"] == "/t/y"
    assert r["d0/dup.pdf"]["target"].startswith("/t/dup_") and r["d0/dup.pdf"]["target"].endswith(".pdf")


def test_rename_residual_clash_uses_long_digest(spark, mk):
    # a natural name equal to another row's short renamed name
    m = _m(mk, ["a/dup.pdf", "b/dup.pdf"])
    short = cp.plan_copy(m, "/t", "rename").where(F.col("relative_path") == "b/dup.pdf").first()["target"]
    clash = short.rsplit("/", 1)[-1]
    m2 = _m(mk, ["a/dup.pdf", "b/dup.pdf", f"c/{clash}"])
    rows = {r["relative_path"]: r["target"] for r in cp.plan_copy(m2, "/t", "rename").collect()}
    assert rows[f"c/{clash}"] == short  # the natural name wins
    assert rows["b/dup.pdf"] != short and len(rows["b/dup.pdf"]) > len(short)


def test_missing_source(spark, mk):
    sources = spark.createDataFrame([("/lake/a.pdf",)], "full_path string")
    plan = _plan_rows(cp.plan_copy(_m(mk, ["a.pdf", "b.pdf"]), "/t", sources=sources))
    b = plan["/lake/b.pdf"]
    assert (b["target"], b["outcome"], b["success"]) == (None, "failed", False)
    assert b["message"] == "Source file does not exist: /lake/b.pdf"
    s = copy_summary(cp.plan_copy(_m(mk, ["a.pdf", "b.pdf"]), "/t", sources=sources)).first()
    assert (s["total"], s["success"], s["failed"], s["skipped"], s["ok"]) == (2, 1, 1, 0, False)


def _tree(tmp_path):
    src = tmp_path / "src"
    for rel, data in {"x/book.pdf": b"one", "y/book.pdf": b"two", "z/other.epub": b"three"}.items():
        (src / rel).parent.mkdir(parents=True, exist_ok=True)
        (src / rel).write_bytes(data)
    return src


def _manifest(spark, src):
    from tidemark.sources.files import scan_manifest

    return scan_manifest(spark, str(src))


@pytest.mark.parametrize("mode", ["rename", "skip", "overwrite"])
def test_run_copy_modes(spark, tmp_path, mode):
    src = _tree(tmp_path)
    tgt = tmp_path / "tgt"
    tgt.mkdir()
    (tgt / "other.epub").write_bytes(b"old")
    results, summary = copy_manifest(spark, _manifest(spark, src), str(tgt), mode=mode)
    res = {r["relative_path"]: r for r in results.collect()}
    s = summary.first()
    files = sorted(os.listdir(tgt))
    assert not [f for f in files if f.endswith(".part")]
    if mode == "rename":
        assert len(files) == 4 and s["success"] == 3 and s["failed"] == 0
        assert (tgt / "other.epub").read_bytes() == b"old"
    elif mode == "skip":
        assert res["z/other.epub"]["outcome"] == "skipped"
        assert (s["success"], s["skipped"]) == (1, 2)
        assert files == ["book.pdf", "other.epub"]
    else:
        assert (tgt / "other.epub").read_bytes() == b"three"
        assert (tgt / "book.pdf").read_bytes() in (b"one", b"two")
        assert res["z/other.epub"]["outcome"] == "overwritten"
    for r in results.collect():
        if r["outcome"] in ("copied", "renamed", "overwritten"):
            assert r["message"] == "Copied successfully"
            assert open(r["target"], "rb").read() == open(r["source"], "rb").read()


def test_copy_missing_source_and_rerun_is_idempotent(spark, tmp_path):
    src = _tree(tmp_path)
    manifest = _manifest(spark, src)
    plan = materialize(cp.plan_copy(manifest, str(tmp_path / "tgt"), "rename"))  # the plan is fixed here
    os.remove(src / "z" / "other.epub")  # vanishes between planning and copying
    res = {r["relative_path"]: r for r in run_copy(plan).collect()}
    assert res["z/other.epub"]["outcome"] == "failed"
    assert res["z/other.epub"]["message"].startswith("Source file does not exist")
    again = {r["relative_path"]: r for r in run_copy(plan).collect()}  # a retried job: same targets
    assert again["x/book.pdf"]["target"] == res["x/book.pdf"]["target"]
    assert sorted(os.listdir(tmp_path / "tgt")) == sorted({r["target"].rsplit("/", 1)[-1] for r in res.values() if r["target"] and r["success"]})


def test_dry_run_writes_nothing(spark, tmp_path):
    src = _tree(tmp_path)
    results, summary = copy_manifest(spark, _manifest(spark, src), str(tmp_path / "tgt"), dry_run=True)
    assert not (tmp_path / "tgt").exists()
    assert all(r["message"].startswith("Would copy to") for r in results.collect())


def test_target_is_a_file(spark, tmp_path):
    src = _tree(tmp_path)
    (tmp_path / "tfile").write_text("x")
    with pytest.raises(FileExistsError):
        copy_manifest(spark, _manifest(spark, src), str(tmp_path / "tfile"))


def test_rebase_sources_onto_another_mount(spark, tmp_path):
    moved = _tree(tmp_path)  # the tree as mounted here
    # the manifest was written where the tree lived under another root
    manifest = spark.createDataFrame(
        [("/old/mount/x/book.pdf", "x/book.pdf", "book.pdf", 3, 0)],
        "full_path string, relative_path string, filename string, file_size bigint, position bigint",
    )
    results, summary = copy_manifest(spark, manifest, str(tmp_path / "tgt"), source_root=str(moved))
    r = results.first()
    assert r["source"] == str(moved / "x/book.pdf") and r["success"]
    assert (tmp_path / "tgt" / "book.pdf").read_bytes() == b"one"


def test_overwrite_onto_itself_is_failed(mk):
    m = mk([("book.pdf", 1, None, None)], "/t")  # the source already lives in the target folder
    r = cp.plan_copy(m, "/t", "overwrite").first()
    assert (r["outcome"], r["success"]) == ("failed", False)
    assert r["message"] == "Source and target are the same file: /t/book.pdf"
