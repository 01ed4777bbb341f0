"""R2: files arriving in two waves; the second run sees only new files, duplicates of recorded
items are not recorded again, a replayed batch is idempotent."""

from tidemark.session import materialize
from tidemark.sources.files import scan_manifest
from tidemark.streaming.ingest import read_state, start_ingest


def _w(p, data):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def test_two_waves(spark, tmp_path):
    lake, lib = tmp_path / "lake", tmp_path / "lib"
    _w(lib / "have.pdf", b"library copy")
    _w(lake / "w1" / "a.pdf", b"first wave a")
    _w(lake / "w1" / "have.pdf", b"library copy")
    library = materialize(scan_manifest(spark, str(lib)))
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    q = start_ingest(spark, str(lake), library, state, ckpt)
    q.awaitTermination()
    first = {r["relative_path"] for r in read_state(spark, state).collect()}
    assert first == {"w1/a.pdf"}
    _w(lake / "w2" / "b.pdf", b"second wave b")
    _w(lake / "w2" / "a_again.pdf", b"first wave a")  # same content as an item already recorded
    q = start_ingest(spark, str(lake), library, state, ckpt)
    q.awaitTermination()
    rows = read_state(spark, state).collect()
    assert sorted(r["relative_path"] for r in rows) == ["w1/a.pdf", "w2/b.pdf"]
    assert len({r["batch_id"] for r in rows}) == 2


def test_library_digests_are_cached_across_batches(spark, tmp_path):
    from tidemark.streaming.ingest import read_library

    lake, lib = tmp_path / "lake", tmp_path / "lib"
    content = b"L" * 2000
    _w(lib / "book.pdf", content)
    _w(lake / "w1" / "copy1.pdf", content)  # a duplicate: the library file's full digest is computed
    library = materialize(scan_manifest(spark, str(lib)))
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    start_ingest(spark, str(lake), library, state, ckpt).awaitTermination()
    cached = read_library(spark, state).where("full_hash is not null").collect()
    assert {r["full_path"] for r in cached} == {str(lib / "book.pdf")}
    assert read_state(spark, state).count() == 0
    # the library file can no longer be read: only the cached digest can show that the next
    # lake copy is a duplicate (re-reading would leave the hash NULL and record it as missing)
    (lib / "book.pdf").unlink()
    _w(lake / "w2" / "copy2.pdf", content)
    start_ingest(spark, str(lake), library, state, ckpt).awaitTermination()
    assert read_state(spark, state).count() == 0


def test_stream_records_the_same_contents_as_a_batch_run(spark, tmp_path):
    from tidemark.plans.analyze import run_analysis
    from tidemark.sources.manifest_io import read_manifest

    lake, lib = tmp_path / "lake", tmp_path / "lib"
    _w(lib / "have.pdf", b"library copy")
    _w(lib / "same_size.pdf", b"L" * 30)
    waves = [
        {"w1/a.pdf": b"alpha", "w1/b.pdf": b"library copy", "w1/c.pdf": b"M" * 30, "w1/c2.pdf": b"M" * 30},
        {"w2/a_again.pdf": b"alpha", "w2/d.pdf": b"delta", "w2/e.pdf": b"N" * 30},
    ]
    library = materialize(scan_manifest(spark, str(lib)))
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    for wave in waves:
        for rel, data in wave.items():
            _w(lake / rel, data)
        start_ingest(spark, str(lake), library, state, ckpt).awaitTermination()
    streamed = sorted(open(r["full_path"], "rb").read() for r in read_state(spark, state).collect())
    run_analysis(spark, str(lake), str(lib), str(tmp_path / "batch"))
    batch = sorted(open(r["full_path"], "rb").read() for r in read_manifest(spark, str(tmp_path / "batch"))[0].collect())
    assert streamed == batch == sorted([b"alpha", b"M" * 30, b"delta", b"N" * 30])
