"""CSV manifest sink and source."""

import os

import pytest

from tidemark.sources import manifest_io
from tidemark.sources.versions import Versions
from tidemark.sources.manifest_io import (
    manifest_count,
    processed_paths,
    read_manifest,
    write_csv_file,
    write_duplicates,
    write_manifest,
)


def _csv_text(path):
    if os.path.isfile(path):
        return open(path).read()
    return "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))


def test_round_trip(spark, mk, tmp_path):
    m = mk([("sub/a.pdf", 100, "p", "f"), ('q, "x".pdf', 7, None, None)])
    out = str(tmp_path / "m")
    write_manifest(m, out)
    text = _csv_text(out)
    assert text.startswith("relative_path,filename,file_size,full_path,processed_at")
    good, bad = read_manifest(spark, out)
    assert bad.count() == 0
    got = {r["filename"]: r for r in good.collect()}
    assert got['q, "x".pdf']["file_size"] == 7
    assert got["a.pdf"]["full_path"] == "/lake/sub/a.pdf"
    assert got["a.pdf"]["file_extension"] == ".pdf"
    assert got["a.pdf"]["processed_at"] is not None
    assert manifest_count(spark, out) == 2
    assert sorted(r[0] for r in processed_paths(good).collect()) == ['/lake/q, "x".pdf', "/lake/sub/a.pdf"]


def test_invalid_and_short_rows_rejected(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(
        "relative_path,filename,file_size,full_path,processed_at\n"
        "file0.pdf,file0.pdf,100,/x/file0.pdf,2024-01-01T00:00:00+00:00\n"
        "invalid,data,missing,fields,row\n"
        "short,row\n"
        "e.pdf,,5,/x/e.pdf,\n"
    )
    good, bad = read_manifest(spark, str(p))
    assert sorted(r["filename"] for r in good.collect()) == ["file0.pdf"]
    reasons = {r["relative_path"]: r["reason"] for r in bad.collect()}
    # Spark's CSV reader gives NULL for an empty unquoted field, so an empty name counts as missing
    assert reasons == {"invalid": "file_size is not an integer", "short": "missing field", "e.pdf": "missing field"}
    assert manifest_count(spark, str(p)) == 4


def test_header_only_and_missing_file(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("relative_path,filename,file_size,full_path,processed_at\n")
    assert read_manifest(spark, str(p))[0].count() == 0
    assert read_manifest(spark, str(tmp_path / "none.csv"))[0].count() == 0
    assert manifest_count(spark, str(tmp_path / "none.csv")) == 0


def test_overwrite_and_empty_result_keeps_header(spark, mk, tmp_path):
    out = str(tmp_path / "m")
    write_manifest(mk([("a.pdf", 1, None, None)]), out)
    write_manifest(mk([("a.pdf", 1, None, None)]).limit(0), out)
    assert _csv_text(out).strip() == "relative_path,filename,file_size,full_path,processed_at"
    assert read_manifest(spark, out)[0].count() == 0


def test_duplicates_written_only_when_present(spark, tmp_path):
    cols = "duplicate_path string, original_path string, method string, file_size string, filename string"
    assert write_duplicates(spark.createDataFrame([], cols), str(tmp_path / "d")) is False
    assert not (tmp_path / "d").exists()
    rep = spark.createDataFrame([("/l/b.pdf", "/l/a.pdf", "full_hash", "3", "b.pdf")], cols)
    assert write_duplicates(rep, str(tmp_path / "d")) is True
    assert "duplicate_path,original_path,method,file_size,filename" in _csv_text(str(tmp_path / "d"))


def test_parquet_state_keeps_hashes(spark, mk, tmp_path):
    out = str(tmp_path / "s")
    write_manifest(mk([("a.pdf", 1, "p", "f")]), out, fmt="parquet")
    good, _ = read_manifest(spark, out, fmt="parquet")
    r = good.first()
    assert (r["prefix_hash"], r["full_hash"]) == ("p", "f")


def test_one_ordered_csv_file_equals_its_parts(spark, tmp_path):
    import csv

    rows = [(f"/x/{(7 * i) % 501:05d}", f"{(7 * i) % 501:05d} ü", f'n "{i}",\n{i}.pdf', str(i), "2024") for i in range(501)]
    cols = "full_path string, relative_path string, filename string, file_size string, processed_at string"
    df = spark.createDataFrame(rows, cols).repartition(7).orderBy("full_path")
    write_csv_file(df, str(tmp_path / "one.csv"))
    with open(tmp_path / "one.csv", newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == df.columns and [tuple(r) for r in got[1:]] == sorted(rows)
    df.write.option("escape", '"').csv(str(tmp_path / "parts"))
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert (tmp_path / "one.csv").read_bytes() == (",".join(df.columns) + "\n").encode() + parts
    # replaced in one step, by a file also where a folder was
    write_csv_file(df.limit(0), str(tmp_path / "one.csv"))
    write_csv_file(df.limit(0), str(tmp_path / "parts"))
    assert (tmp_path / "one.csv").read_text() == (tmp_path / "parts").read_text() == ",".join(df.columns) + "\n"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one.csv", "parts"]


@pytest.mark.parametrize("fmt", ["csv", "csv_parts", "parquet"])
def test_a_write_that_dies_leaves_the_old_manifest(spark, mk, tmp_path, monkeypatch, fmt):
    out = str(tmp_path / "m")
    write_manifest(mk([("old.pdf", 1, "p", "f")]), out, fmt)
    new = mk([("new.pdf", 2, "p", "f")])
    for step in ("_publish_file", "_swap", "_join_parts") if fmt != "parquet" else ("publish", "vacuum"):
        with monkeypatch.context() as m:
            def die(*_a, **_k):
                raise RuntimeError("killed")

            m.setattr(Versions if fmt == "parquet" else manifest_io, step, die)
            try:
                write_manifest(new, out, fmt)
                assert (fmt, step) in (("csv", "_swap"), ("csv_parts", "_publish_file"), ("csv_parts", "_join_parts"))
                write_manifest(mk([("old.pdf", 1, "p", "f")]), out, fmt)
            except RuntimeError:
                pass
        # what is published counts, and the old one does until then
        want = ["new.pdf"] if step == "vacuum" else ["old.pdf"]
        assert [r["filename"] for r in read_manifest(spark, out, "parquet" if fmt == "parquet" else "csv")[0].collect()] == want


def test_a_reader_of_a_manifest_keeps_its_version(spark, mk, tmp_path):
    out = str(tmp_path / "m")
    write_manifest(mk([("a.pdf", 1, "p", "f")]), out, "parquet")
    old = read_manifest(spark, out, "parquet")[0]
    write_manifest(mk([("b.pdf", 1, "p", "f"), ("c.pdf", 1, "p", "f")]), out, "parquet")
    assert [r["filename"] for r in old.collect()] == ["a.pdf"] and read_manifest(spark, out, "parquet")[0].count() == 2
