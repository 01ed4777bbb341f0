"""Cases that once lost or overwrote data: copy, resume, manifest fidelity, scan, stream replay."""

import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import MANIFEST_DDL
from tidemark.functions.hashing import Hasher
from tidemark.operators import copyjob, copyplan
from tidemark.plans.analyze import run_analysis
from tidemark.plans.copy import copy_manifest, existing_names
from tidemark.sources.files import list_files, scan_manifest
from tidemark.sources.manifest_io import read_manifest, write_manifest
from tidemark.sources.readers import hash_files
from tidemark.streaming.ingest import process_batch, read_state

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def manifest(spark, paths, position=0):
    rows = [(str(p), str(r), os.path.basename(str(p)), ".pdf", os.path.getsize(p) if os.path.exists(p) else 1, None, None, position) for p, r in paths]
    return spark.createDataFrame(rows, MANIFEST_DDL)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def outcomes(results):
    return sorted((os.path.basename(r["source"]), r["outcome"], os.path.basename(r["target"] or "")) for r in results.collect())


def test_tied_positions_give_two_targets(spark, tmp_path):
    a, b = put(tmp_path / "x/book.pdf", "first"), put(tmp_path / "y/book.pdf", "second")
    out = tmp_path / "t"
    results, summary = copy_manifest(spark, manifest(spark, [(b, "y/book.pdf"), (a, "x/book.pdf")]), str(out))
    assert sorted(p.read_text() for p in out.iterdir()) == ["first", "second"]
    assert (out / "book.pdf").read_text() == "first" and summary.first()["ok"]


def test_rows_with_one_target_are_refused(spark):
    plan = spark.createDataFrame([("a", "/t/x", "copied"), ("b", "/t/x", "copied")], "source string, target string, outcome string")
    with pytest.raises(ValueError, match="/t/x"):
        copyplan.check_unique_targets(plan)


def test_target_uris(spark, tmp_path):
    a = put(tmp_path / "x/a.pdf", "a")
    copy_manifest(spark, manifest(spark, [(a, "a.pdf")]), f"file://{tmp_path}/t1")
    assert (tmp_path / "t1/a.pdf").read_text() == "a"
    with pytest.raises(ValueError, match="s3://"):
        copy_manifest(spark, manifest(spark, [(a, "a.pdf")]), "s3://bucket/t")


@pytest.mark.parametrize("mode", ["rename", "skip"])
def test_a_file_that_arrives_after_planning_is_kept(spark, tmp_path, mode):
    a = put(tmp_path / "x/a.pdf", "mine")
    plan = copyplan.plan_copy(manifest(spark, [(a, "a.pdf")]), str(tmp_path / "t"), mode)
    put(tmp_path / "t/a.pdf", "late")
    done = copyjob.run_copy(plan, mode=mode)
    assert (tmp_path / "t/a.pdf").read_text() == "late"
    assert done.first()["outcome"] == ("renamed" if mode == "rename" else "skipped")
    again = copyjob.run_copy(plan, mode=mode)  # a retry finds its own copy
    assert len(list((tmp_path / "t").iterdir())) == (2 if mode == "rename" else 1)
    assert again.first()["target"] == done.first()["target"]


def test_a_folder_with_the_name_is_a_conflict(spark, tmp_path):
    a = put(tmp_path / "x/a.pdf", "a")
    (tmp_path / "t/a.pdf").mkdir(parents=True)
    assert [r[0] for r in existing_names(spark, str(tmp_path / "t")).collect()] == ["a.pdf"]
    results, summary = copy_manifest(spark, manifest(spark, [(a, "a.pdf")]), str(tmp_path / "t"))
    assert results.first()["outcome"] == "renamed" and summary.first()["ok"]


def test_superseded_rows_fail_with_their_winner(spark, tmp_path):
    a, b = put(tmp_path / "x/a.pdf", "a"), put(tmp_path / "y/a.pdf", "b")
    plan = copyplan.plan_copy(manifest(spark, [(a, "x/a.pdf"), (b, "y/a.pdf")]), str(tmp_path / "t"), "overwrite")
    b.unlink()
    assert [r["outcome"] for r in copyjob.run_copy(plan, mode="overwrite").collect()] == ["failed", "failed"]


def test_rejected_rows_are_counted(spark, tmp_path):
    a = put(tmp_path / "x/a.pdf", "a")
    (tmp_path / "m.csv").write_text(f"relative_path,filename,file_size,full_path,processed_at\na.pdf,a.pdf,1,{a},\nshort,row\n")
    summary = copy_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path / "t"))[1].first()
    assert (summary["total"], summary["success"], summary["rejected"], summary["ok"]) == (1, 1, 1, False)


def test_no_checkpoint_folder_named(tmp_path):
    """A local session without a folder still works eagerly; a cluster session is told what to set."""
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake/a.pdf").write_text("a")
    code = f"""
import sys; sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tidemark import session
from tidemark.plans.copy import copy_manifest
from tidemark.sources.files import scan_manifest
copy_manifest(spark, scan_manifest(spark, {str(tmp_path / 'lake')!r}), {str(tmp_path / 't')!r})
session._is_local = lambda s: False
session.checkpoint_dir = lambda s: None
try:
    session.materialize(spark.range(1))
except ValueError as e:
    print("SAYS", e)
"""
    env = {**os.environ, "PYTHONPATH": HERE, "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=200)
    assert "SAYS set spark.checkpoint.dir" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "t/a.pdf").read_text() == "a"


NAMES = [" lead.pdf", "trail .pdf", "com,ma.pdf", 'quo"te.pdf', "new\nline.pdf", "back\\slash.pdf", "'s.pdf", "é ü.pdf", "#x.pdf", '".pdf', "a\tb.pdf"]


def test_csv_round_trip_of_awkward_names(spark, tmp_path):
    rows = [(f"/x/ d/{n}", f" d/{n}", n, ".pdf", i, None, None, 0) for i, n in enumerate(NAMES)]
    write_manifest(spark.createDataFrame(rows, MANIFEST_DDL), str(tmp_path / "m"))
    good, bad = read_manifest(spark, str(tmp_path / "m"))
    assert bad.count() == 0
    assert sorted((r["full_path"], r["relative_path"], r["filename"], r["file_size"]) for r in good.collect()) == sorted((r[0], r[1], r[2], r[4]) for r in rows)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_resume_into_the_same_manifest(spark, tmp_path, fmt):
    lake, lib, out = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "missing")
    put(lake / "m.pdf", "same content")
    put(lib / "z.pdf", "library")
    run_analysis(spark, str(lake), str(lib), out, fmt=fmt)
    put(lake / "a.pdf", "same content")  # a smaller path with the prior keeper's content
    put(lake / "n.pdf", "new")
    counts = run_analysis(spark, str(lake), str(lib), out, fmt=fmt, resume_from=out)
    kept = read_manifest(spark, out, fmt)[0]
    assert sorted(r["filename"] for r in kept.collect()) == ["m.pdf", "n.pdf"]
    assert counts["route_skip"] == 1 and not [p for p in os.listdir(tmp_path) if "writing" in p]


def test_resume_refuses_a_missing_manifest_and_other_digests(spark, tmp_path):
    put(tmp_path / "lake/a.pdf", "a")
    put(tmp_path / "lake/b.pdf", "a")
    put(tmp_path / "lib/b.pdf", "a")
    put(tmp_path / "lib/c.pdf", "b")
    put(tmp_path / "lake/d.pdf", "c")
    args = (spark, str(tmp_path / "lake"), str(tmp_path / "lib"), str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        run_analysis(*args, resume_from=str(tmp_path / "none"))
    run_analysis(*args, fmt="parquet")
    with pytest.raises(ValueError, match="sha256"):
        run_analysis(*args, fmt="parquet", hasher="md5", resume_from=str(tmp_path / "out"))


def test_own_hasher_on_files(spark, tmp_path):
    class Sum:
        def __init__(self):
            self.n = 0

        def update(self, b):
            self.n += sum(b)

        def hexdigest(self):
            return f"{self.n:x}"

    p = put(tmp_path / "a.pdf", "abc")
    own = Hasher("sum", lambda c: F.sha2(c, 256), Sum)
    m = manifest(spark, [(p, "a.pdf")])
    assert hash_files(m, "full", own).first()["full_hash"] == f"{sum(b'abc'):x}"
    results, _ = copy_manifest(spark, m, str(tmp_path / "t"), verify="hash")
    assert results.first()["success"]


def test_one_folder_gives_one_set_of_paths(spark, tmp_path, monkeypatch):
    put(tmp_path / "l/a.pdf", "a")
    monkeypatch.chdir(tmp_path)
    paths = {scan_manifest(spark, r).first()["full_path"] for r in ("l", "./l/", f"{tmp_path}/./l", f"{tmp_path}/x/../l", f"file:{tmp_path}/l")}
    assert paths == {str(tmp_path / "l/a.pdf")}
    with pytest.raises(Exception, match="cannot list"):
        list_files(spark, str(tmp_path / "gone"))


def test_a_replayed_batch_that_became_empty(spark, tmp_path):
    put(tmp_path / "lake/a.pdf", "content")
    (tmp_path / "lib").mkdir()
    listing = list_files(spark, str(tmp_path / "lake"))
    state = str(tmp_path / "state")

    def batch():
        process_batch(spark, listing, 0, str(tmp_path / "lake"), scan_manifest(spark, str(tmp_path / "lib")), state)
        return read_state(spark, state).count()

    assert batch() == 1
    put(tmp_path / "lib/b.pdf", "content")
    assert batch() == 0


def test_unreadable_state_is_an_error(spark, tmp_path):
    assert read_state(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "state").mkdir()
    (tmp_path / "state/part-0.parquet").write_bytes(hashlib.sha256(b"").digest())
    with pytest.raises(Exception):
        read_state(spark, str(tmp_path / "state")).count()


# --- resumed runs look at what the files are now ---------------------------------------------------


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_resume_analyses_changed_files_anew_and_drops_vanished_ones(spark, tmp_path, fmt):
    lake, lib, out = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "missing")
    put(lib / "z.pdf", "library content")
    put(lake / "a.pdf", "abc")
    put(lake / "same_size.pdf", "12345")
    put(lake / "gone.pdf", "goes away")
    put(lake / "kept.pdf", "stays as it is")
    run_analysis(spark, str(lake), str(lib), out, fmt=fmt)
    assert read_manifest(spark, out, fmt)[0].count() == 4
    # rewritten with content that the library has now, also at equal size; one path is gone
    put(lake / "a.pdf", "library content")
    put(lake / "same_size.pdf", "54321")
    put(lib / "y.pdf", "54321")
    later = os.stat(lake / "same_size.pdf").st_mtime + 5
    os.utime(lake / "same_size.pdf", (later, later))
    (lake / "gone.pdf").unlink()
    counts = run_analysis(spark, str(lake), str(lib), out, fmt=fmt, resume_from=out)
    assert [r["filename"] for r in read_manifest(spark, out, fmt)[0].collect()] == ["kept.pdf"]
    assert (counts["prior_changed"], counts["prior_vanished"], counts["written"]) == (2, 1, 1)


def test_a_changed_item_that_is_still_missing_has_its_new_size(spark, tmp_path):
    lake, lib, out = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "missing")
    put(lib / "z.pdf", "l")
    put(lake / "a.pdf", "abc")
    run_analysis(spark, str(lake), str(lib), out)
    put(lake / "a.pdf", "longer now")
    run_analysis(spark, str(lake), str(lib), out, resume_from=out)
    assert [r["file_size"] for r in read_manifest(spark, out)[0].collect()] == [10]
