"""Aggregations over manifests and results (A1-A6, A8-A10).  All are ``groupBy``/``agg`` with
partial aggregation; nothing is collected except where a caller asks for a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_sizes(df: DataFrame) -> DataFrame:
    """A1: distinct sizes."""
    return df.select("file_size").distinct()


def size_groups(df: DataFrame) -> DataFrame:
    """A2: files and bytes per size, with the first and last position of the group.
    (The member list of a group is not collected: a group is unbounded.)"""
    return df.groupBy("file_size").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )


def prefix_groups(df: DataFrame) -> DataFrame:
    """A3: files per (size, prefix hash); unhashed rows are not indexed."""
    return (
        df.where(F.col("prefix_hash").isNotNull())
        .groupBy("file_size", "prefix_hash")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def full_groups(df: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """A4: one row per full hash; the last added file (highest position) represents it."""
    return (
        df.where(F.col("full_hash").isNotNull())
        .groupBy("full_hash")
        .agg(F.count(F.lit(1)).alias("n_files"), F.max(F.struct("position", *[c for c in carry if c != "position"])).alias("_last"))
        .select("full_hash", "n_files", *[F.col(f"_last.{c}").alias(c) for c in carry])
    )


def stage_summary(flagged: DataFrame) -> DataFrame:
    """A5: files and bytes decided at each stage."""
    return flagged.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("file_size").cast("bigint").alias("total_bytes"),
    )


def route_summary(routed: DataFrame) -> DataFrame:
    """Files and bytes per route."""
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("file_size").cast("bigint").alias("total_bytes"),
    )


def side_summary(lake: DataFrame, lib: DataFrame) -> DataFrame:
    """A10: files and bytes found on each side."""
    both = lake.select(F.lit("lake").alias("side"), "file_size").unionByName(
        lib.select(F.lit("library").alias("side"), "file_size")
    )
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("file_size").cast("bigint").alias("total_bytes"),
    )


def copy_summary(results: DataFrame) -> DataFrame:
    """A8 + A9: total / success / failed / skipped over an explicit ``outcome`` column (never a
    message substring), and ``ok`` = nothing failed."""
    agg = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
    return agg.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("total", "success", "failed", "skipped")],
        (F.col("failed") == 0).alias("ok"),
    )
