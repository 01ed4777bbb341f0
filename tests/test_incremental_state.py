"""R2: library changes between batches, state by size, replay, versions that survive a crash."""

import random

import pytest

from tidemark.operators import compare as cmp
from tidemark.operators import dedup as dd
from tidemark.session import materialize
from tidemark.sources import versions as vs
from tidemark.sources.files import scan_manifest
from tidemark.streaming import ingest
from tidemark.streaming.delta import MISSING
from tidemark.streaming.state import KeyedState

LISTING = "full_path string, file_size bigint, mtime_ms bigint"


def _w(p, data):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def _listing(spark, paths):
    return spark.createDataFrame([(str(p), p.stat().st_size, 0) for p in paths], LISTING)


def _contents(spark, state):
    return sorted(open(r["full_path"], "rb").read() for r in ingest.read_state(spark, state).collect())


def _full_run(lake, lib):
    """Each content of the lake that the library does not have."""
    have = {p.read_bytes() for p in lib.rglob("*.pdf")}
    return sorted({p.read_bytes() for p in lake.rglob("*.pdf")} - have)


def test_library_changes_between_batches_equal_a_full_run(spark, tmp_path):
    r = random.Random(3)
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    # contents of few sizes, some equal in their first kilobyte
    contents = [bytes([65 + k % 5]) * n for k in range(5) for n in (10, 11, 1500)]
    contents += [b"A" * 1400 + bytes([48 + k]) * 100 for k in range(4)] + [b"tiny%d" % k for k in range(6)]
    lib.mkdir()
    for i, c in enumerate(r.sample(contents, 9)):
        _w(lib / f"l{i}.pdf", c)
    seen = retracted = 0
    for batch in range(4):
        new = []
        for i in range(r.randint(0, 5)):
            p = lake / f"w{batch}" / f"{i}.pdf"
            _w(p, r.choice(contents))
            new.append(p)
        lake.mkdir(exist_ok=True)
        if batch:
            gone = r.sample(sorted(lib.iterdir()), 3)
            for p in gone:
                p.unlink()
            for i in range(3):
                _w(lib / f"b{batch}_{i}.pdf", r.choice(contents))
        listing = _listing(spark, new) if new else spark.createDataFrame([], LISTING)
        info = ingest.process_batch(spark, listing, batch, str(lake), materialize(scan_manifest(spark, str(lib))), state)
        assert _contents(spark, state) == _full_run(lake, lib), batch
        seen, retracted = seen + info["recorded"], retracted + info["retracted"]
        assert {x["full_path"] for x in ingest.read_library(spark, state).collect()} == {str(p) for p in lib.iterdir()}
    assert retracted > 0
    # the signed changes add up to the state
    signs = {}
    for x in ingest.read_changes(spark, state).collect():
        signs[x["full_path"]] = signs.get(x["full_path"], 0) + x["sign"]
    assert {p for p, n in signs.items() if n} == {x["full_path"] for x in ingest.read_state(spark, state).collect()}
    assert set(signs.values()) <= {0, 1} and seen - retracted == sum(signs.values())


def test_given_changes_need_no_library_snapshot(spark, tmp_path):
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    _w(lake / "a.pdf", b"alpha")
    _w(lake / "b.pdf", b"betas")
    _w(lib / "x.pdf", b"alpha")
    manifest = scan_manifest(spark, str(lib)).selectExpr("1 as sign", "*")
    first = ingest.process_batch(spark, _listing(spark, [lake / "a.pdf", lake / "b.pdf"]), 0, str(lake), None, state, changes=manifest)
    assert (first["recorded"], first["retracted"]) == (1, 0) and _contents(spark, state) == [b"betas"]
    gone = scan_manifest(spark, str(lib)).selectExpr("-1 as sign", "*")
    second = ingest.process_batch(spark, spark.createDataFrame([], LISTING), 1, str(lake), None, state, changes=gone)
    assert (second["recorded"], second["retracted"]) == (1, 0) and _contents(spark, state) == [b"alpha", b"betas"]
    third = ingest.process_batch(spark, spark.createDataFrame([], LISTING), 2, str(lake), None, state, changes=manifest)
    assert (third["recorded"], third["retracted"]) == (0, 1) and _contents(spark, state) == [b"betas"]


def test_rows_read_and_written_do_not_grow_with_history(spark, tmp_path):
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    for i in range(8):
        _w(lib / f"{i}.pdf", b"L" * (100 + i))
    library = materialize(scan_manifest(spark, str(lib)))
    infos = []
    for batch in range(10):
        new = []
        for i in range(6):  # sizes that no other batch has, but one that comes back
            p = lake / f"w{batch}" / f"{i}.pdf"
            _w(p, bytes([65 + batch]) * (1000 + 10 * batch + i if i else 100))
            new.append(p)
        infos.append(ingest.process_batch(spark, _listing(spark, new), batch, str(lake), library, state, library_token="one", rows_per_bucket=4, max_parts=3))
    assert ingest.read_state(spark, state).count() == 60
    read = [x["rows_read"] for x in infos]
    # ten items of the size that comes back, and a few rows of each bucket
    assert max(read[5:]) < 45 and read[-1] < 60
    # the library's digests are written once, when they become known
    assert [x["library_rows"] for x in infos[2:]] == [0] * 8 and infos[0]["library_rows"] == 8
    assert [x["lake_rows"] for x in infos] == [6] * 10
    snapshot = KeyedState(spark, state).current()
    assert snapshot.n_buckets > 16 and all(len(p) <= 4 for p in snapshot.parts.values())
    assert ingest.batch_counts(spark, state)[9]["recorded"] == 6


def test_a_replayed_batch_replaces_its_own_version(spark, tmp_path):
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    lib.mkdir()
    library = materialize(scan_manifest(spark, str(lib)))
    paths = []
    for batch, data in enumerate((b"one", b"two", b"three")):
        _w(lake / f"{batch}.pdf", data)
        paths.append(lake / f"{batch}.pdf")
        ingest.process_batch(spark, _listing(spark, paths[-1:]), batch, str(lake), library, state)
    before = sorted(tuple(x) for x in KeyedState(spark, state).rows().collect())
    numbers = vs.Versions(spark, state).numbers()
    ingest.process_batch(spark, _listing(spark, paths[-1:]), 2, str(lake), library, state)
    assert sorted(tuple(x) for x in KeyedState(spark, state).rows().collect()) == before
    assert vs.Versions(spark, state).numbers() == numbers and ingest.read_changes(spark, state).count() == 3
    with pytest.raises(ValueError):
        ingest.process_batch(spark, _listing(spark, paths[:1]), 1, str(lake), library, state)


@pytest.mark.parametrize("step", ["write", "publish", "rename"])
def test_a_batch_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    _w(lib / "x.pdf", b"library")
    library = materialize(scan_manifest(spark, str(lib)))
    _w(lake / "a.pdf", b"alpha")
    _w(lake / "b.pdf", b"beta")
    ingest.process_batch(spark, _listing(spark, [lake / "a.pdf"]), 0, str(lake), library, state)

    def die(*_a, **_k):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(KeyedState, "_write", die)
        elif step == "publish":
            m.setattr(vs.Versions, "publish", die)
        else:  # the version file was written aside, not yet renamed
            real = vs.hadoop

            class Fs:
                def __init__(self, fs):
                    self.fs = fs

                def rename(self, *_a):
                    raise RuntimeError("killed")

                def __getattr__(self, name):
                    return getattr(self.fs, name)

            m.setattr(vs, "hadoop", lambda spark, path: (Fs(real(spark, path)[0]), real(spark, path)[1]))
        with pytest.raises(RuntimeError):
            ingest.process_batch(spark, _listing(spark, [lake / "b.pdf"]), 1, str(lake), library, state)
    assert _contents(spark, state) == [b"alpha"]
    ingest.process_batch(spark, _listing(spark, [lake / "b.pdf"]), 1, str(lake), library, state)
    assert _contents(spark, state) == [b"alpha", b"beta"]


def test_a_reader_keeps_its_version_while_newer_ones_appear(spark, tmp_path):
    lake, lib, state = tmp_path / "lake", tmp_path / "lib", str(tmp_path / "state")
    lib.mkdir()
    library = materialize(scan_manifest(spark, str(lib)))
    _w(lake / "0.pdf", b"zero")
    ingest.process_batch(spark, _listing(spark, [lake / "0.pdf"]), 0, str(lake), library, state)
    old = ingest.read_state(spark, state)
    _w(lake / "1.pdf", b"first")
    ingest.process_batch(spark, _listing(spark, [lake / "1.pdf"]), 1, str(lake), library, state)
    assert old.count() == 1 and ingest.read_state(spark, state).count() == 2


def test_the_stream_follows_a_library_that_changes(spark, tmp_path):
    lake, lib = tmp_path / "lake", tmp_path / "lib"
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    _w(lib / "have.pdf", b"alpha")
    _w(lake / "w1" / "a.pdf", b"alpha")
    _w(lake / "w1" / "b.pdf", b"betas")
    now = lambda: scan_manifest(spark, str(lib))
    ingest.start_ingest(spark, str(lake), now, state, ckpt).awaitTermination()
    assert _contents(spark, state) == [b"betas"]
    (lib / "have.pdf").unlink()
    _w(lib / "new.pdf", b"betas")
    _w(lake / "w2" / "c.pdf", b"gamma")
    ingest.start_ingest(spark, str(lake), now, state, ckpt).awaitTermination()
    assert _contents(spark, state) == _full_run(lake, lib) == [b"alpha", b"gamma"]
    counts = ingest.batch_counts(spark, state)
    assert sum(c["recorded"] for c in counts.values()) == 3 and sum(c["retracted"] for c in counts.values()) == 1


def test_hot_size_in_two_waves_of_tables(spark):
    """Tables: digests are there, a third of the rows have one size."""
    from tidemark.plans.catalog import two_waves

    from conftest import MANIFEST_DDL

    def rows(names, offset):
        return spark.createDataFrame([(f"/{n}", n, n, ".pdf", 7 if i % 3 else 8 + i, f"p{i % 5}", f"f{i % 11}", offset + i) for i, n in enumerate(names)], MANIFEST_DDL)

    waves = [rows([f"a{i}" for i in range(60)], 0), rows([f"b{i}" for i in range(60)], 100)]
    libraries = [rows([f"l{i}" for i in range(9)], 0), rows([f"m{i}" for i in range(4, 13)], 0)]
    got = two_waves(spark, waves, libraries).where(f"outcome = '{MISSING}'")
    every = waves[0].unionByName(waves[1])
    want = dd.dedup_content(cmp.missing_from(every, libraries[1])).kept
    key = ["file_size", "full_hash"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
