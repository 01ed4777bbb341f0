"""Routing (P6, A6)."""

import pytest

from tidemark.operators.metrics import route_summary
from tidemark.operators.routing import route_files


def test_threshold_boundary_and_skip(spark, mk):
    m = mk([("a.pdf", 100, None, None), ("b.pdf", 99, None, None), ("c.pdf", 500, None, None)])
    done = spark.createDataFrame([("/lake/c.pdf",)], "full_path string")
    got = {r["filename"]: r["route"] for r in route_files(m, done, threshold=100).collect()}
    assert got == {"a.pdf": "large", "b.pdf": "small", "c.pdf": "skip"}
    s = {r["route"]: (r["n_files"], r["total_bytes"]) for r in route_summary(route_files(m, done, 100)).collect()}
    assert s == {"large": (1, 100), "small": (1, 99), "skip": (1, 500)}


def test_bad_threshold(mk):
    with pytest.raises(ValueError):
        route_files(mk([("a.pdf", 1, None, None)]), None, -1)


def test_large_files_get_their_own_partitions(spark, mk):
    from pyspark.sql import functions as F

    from tidemark.operators.routing import balance_by_bytes

    rows = [(f"s{i}.pdf", 10, None, None) for i in range(200)] + [(f"L{i}.pdf", 1000, None, None) for i in range(3)]
    out = balance_by_bytes(mk(rows), bytes_per_task=1000, large_threshold=1000)
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
        F.count_if(F.col("file_size") >= 1000).alias("large"), F.count_if(F.col("file_size") < 1000).alias("small")
    ).collect()
    assert out.count() == 203
    # every large file sits in a partition without small files
    assert all(r["small"] == 0 for r in parts if r["large"] > 0)
    assert out.rdd.getNumPartitions() == 2 + 3
