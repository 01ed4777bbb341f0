"""Digests: column expressions and file readers agree with hashlib (prefix boundaries, empty,
large, missing files)."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import as_bytes, full_hash, get_hasher, prefix_hash, size_of
from tidemark.sources.readers import hash_files

PREFIX = 1024


def _sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("n", [0, 5, 1023, 1024, 1025, 2048])
def test_column_keys_match_hashlib(spark, n):
    text = ("é" * n)[:n]  # multi-byte characters: the prefix cuts bytes, not characters
    b = text.encode("utf-8")
    df = spark.createDataFrame([(text,)], "t string")
    c = as_bytes("t", df.schema["t"].dataType)
    r = df.select(size_of(c).alias("s"), prefix_hash(c).alias("p"), full_hash(c).alias("f")).first()
    assert r["s"] == len(b)
    assert r["p"] == _sha(b[:PREFIX])
    assert r["f"] == _sha(b)


def test_other_hashers(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    c = as_bytes("t", df.schema["t"].dataType)
    assert df.select(full_hash(c, "md5")).first()[0] == hashlib.md5(b"abc").hexdigest()
    with pytest.raises(ValueError):
        get_hasher("crc0")


def _manifest(spark, paths):
    return spark.createDataFrame(
        [(p, None, None, i) for i, p in enumerate(paths)],
        "full_path string, prefix_hash string, full_hash string, position bigint",
    ).withColumn("file_size", F.lit(0).cast("bigint"))


def test_file_readers(spark, tmp_path):
    blobs = {
        "small.pdf": b"hello",
        "exact.pdf": os.urandom(1024),
        "two_k.pdf": os.urandom(2048),
        "empty.pdf": b"",
        "big.pdf": os.urandom(2 * 1024 * 1024 + 7),
    }
    for name, b in blobs.items():
        (tmp_path / name).write_bytes(b)
    paths = [str(tmp_path / n) for n in blobs] + [str(tmp_path / "missing.pdf")]
    m = _manifest(spark, paths)
    pre = {r["full_path"]: r for r in hash_files(m, "1k").collect()}
    full = {r["full_path"]: r for r in hash_files(m, "full").collect()}
    for name, b in blobs.items():
        p = str(tmp_path / name)
        assert pre[p]["prefix_hash"] == _sha(b[:PREFIX])
        assert full[p]["full_hash"] == _sha(b)
    miss = str(tmp_path / "missing.pdf")
    assert pre[miss]["prefix_hash"] is None and "FileNotFoundError" in pre[miss]["error_message"]
    assert full[miss]["full_hash"] is None


def test_known_hash_is_not_recomputed(spark, tmp_path):
    m = spark.createDataFrame([(str(tmp_path / "gone.pdf"), "kept", None, 0)],
                              "full_path string, prefix_hash string, full_hash string, position bigint")
    assert hash_files(m, "1k").first()["prefix_hash"] == "kept"


def test_unknown_stage_rejected(spark):
    m = _manifest(spark, ["/x"])
    with pytest.raises(ValueError):
        hash_files(m, "half")


def test_pluggable_hasher_gives_same_membership(spark):
    """Another digest (md5, xxhash64) decides the same rows as sha256."""
    from tidemark.operators import compare as cmp
    from tidemark.plans.catalog import documents, doc_relative_path
    from tidemark.sources.tables import table_manifest

    docs = documents(spark, "/root/testdata/sf0.001")
    out = {}
    for h in ("sha256", "md5", "xxhash64"):
        lake = table_manifest(docs.where(F.col("doc_id") % 2 == 1), "text", "/lake", doc_relative_path(), "doc_id",
                              keep=("doc_id",), hasher=h)
        lib = table_manifest(docs.where(F.col("doc_id") % 2 == 0), "text", "/lib", doc_relative_path(), "doc_id",
                             keep=("doc_id",), hasher=h)
        out[h] = {(r["doc_id"], r["stage"]) for r in cmp.classify(lake, lib).collect()}
    assert out["sha256"] == out["md5"] == out["xxhash64"]


def test_xxhash64_file_reader_matches_column(spark, tmp_path):
    data = os.urandom(5000)
    (tmp_path / "x.bin").write_bytes(data)
    col = spark.createDataFrame([(bytearray(data),)], "b binary").select(full_hash(F.col("b"), "xxhash64")).first()[0]
    m = _manifest(spark, [str(tmp_path / "x.bin")])
    assert hash_files(m, "full", "xxhash64").first()["full_hash"] == col


def test_prefix_reads_are_spread_over_tasks(spark, tmp_path):
    paths = []
    for i in range(40):
        p = tmp_path / f"f{i}.bin"
        p.write_bytes(os.urandom(10))
        paths.append(str(p))
    m = _manifest(spark, paths).coalesce(1)  # all rows in one partition, as a byte-sized one could be
    out = hash_files(m, "1k", reads_per_task=5)
    per_task = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert out.rdd.getNumPartitions() == 8
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 40
    assert out.where(F.col("prefix_hash").isNull()).count() == 0
