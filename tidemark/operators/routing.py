"""Routing (P6) and byte-balanced partitioning for the file readers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import LARGE_FILE_BYTES

# Route names.  The reference's "cpu"/"gpu" split is re-aimed at the reader: a
# "large" file is hashed by the chunked reader in a task of its own byte budget.
ROUTE_SKIP = "skip"
ROUTE_LARGE = "large"
ROUTE_SMALL = "small"


def route_files(df: DataFrame, processed: DataFrame | None = None, threshold: int = LARGE_FILE_BYTES) -> DataFrame:
    """Add ``route``: ``skip`` when the path is in ``processed`` (a prior manifest), else
    ``large`` when ``file_size >= threshold``, else ``small``."""
    if threshold is None or threshold < 0:
        raise ValueError("threshold must be a non-negative byte count")
    out = df
    if processed is not None:
        seen = processed.select("full_path").distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, "full_path", "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean"))
    route = (
        F.when(F.col("_seen").isNotNull(), ROUTE_SKIP)
        .when(F.col("file_size") >= threshold, ROUTE_LARGE)
        .otherwise(ROUTE_SMALL)
    )
    return out.withColumn("route", route).drop("_seen").select(*df.columns, "route")


def balance_by_bytes(
    df: DataFrame,
    bytes_per_task: int = 512 * 1024 * 1024,
    max_tasks: int | None = None,
    large_threshold: int | None = LARGE_FILE_BYTES,
) -> DataFrame:
    """Repartition a manifest so each task reads about ``bytes_per_task`` bytes.

    One aggregate gives the totals (a few numbers to the driver).  Rows of the ``small`` route
    are spread by a hash of the path over ``ceil(small_bytes / bytes_per_task)`` partitions, so by
    the law of large numbers each gets its share of bytes.  Rows of the ``large`` route (P6:
    ``file_size >= large_threshold``) get partitions of their own, one per large file up to
    ``max_tasks``, so a huge file never holds up a task full of small ones (a digest is
    sequential, so one file cannot be split further).
    """
    big = F.col("file_size") >= F.lit(large_threshold if large_threshold is not None else 1 << 62)
    t = df.agg(
        F.sum(F.when(~big, F.col("file_size"))).alias("small_bytes"),
        F.count_if(big).alias("n_large"),
    ).first()
    small_bytes, n_large = (t["small_bytes"] or 0), (t["n_large"] or 0)
    n_small = max(1, math.ceil(small_bytes / max(1, bytes_per_task)))
    if max_tasks:
        n_small = min(n_small, max_tasks)
        n_large = min(n_large, max_tasks)
    # a union keeps the partitions of both sides: large files never share a task with small ones
    small = df.where(~big).repartition(n_small, F.xxhash64("full_path"))
    if n_large == 0:
        return small
    # by range of (size, path): a hash or round-robin start would put several large files in one task
    return small.unionByName(df.where(big).repartitionByRange(n_large, "file_size", "full_path"))
