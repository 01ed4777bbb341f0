"""Dedup inside the lake result (W1, W2, W4) and its summary.

Keeper choice is deterministic: rows of a prior run first (negative ``position``), then the lowest
``(stage_no, full_path, position)`` of a group (the reference keeps the first in list order, which
depends on the filesystem; see SURVEY Q7).

No window is used: a window over a hot key (the same content a million times) would put the
whole group in one task.  The kept set is one ``groupBy`` whose ``min(struct(...))`` carries the
whole keeper row, so partial aggregation collapses a hot key map-side.  The duplicates report
joins every row to its group's keeper (one row per key on the right; a hot key on the left is
split by AQE's skew-join handling).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Method names of the duplicates report, as in the reference.
METHOD_FULL = "full_hash"
METHOD_PREFIX = "size+1k_hash"
METHOD_SIZE = "size_only"

REPORT_COLUMNS = ("duplicate_path", "original_path", "method", "file_size", "filename")


@dataclass
class DedupResult:
    kept: DataFrame  # one row per group, input columns plus ``method``
    duplicates: DataFrame  # the report (W2)
    summary: DataFrame  # before / after / removed (A7)


def _visible_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Hashes as the reference would hold them: a row decided at stage 1 was never hashed, one
    decided at stage 2 has only its prefix hash."""
    sn = F.col("stage_no")
    return F.when(sn >= 2, F.col("prefix_hash")), F.when(sn >= 3, F.col("full_hash"))


def tiered_key(df: DataFrame) -> DataFrame:
    """W1 key: full hash if known, else (size, prefix hash), else size; one namespace per tier."""
    vp, vf = _visible_hashes(df)
    method = F.when(vf.isNotNull(), METHOD_FULL).when(vp.isNotNull(), METHOD_PREFIX).otherwise(METHOD_SIZE)
    key = (
        F.when(vf.isNotNull(), vf)
        .when(vp.isNotNull(), F.concat_ws(":", F.col("file_size").cast("string"), vp))
        .otherwise(F.col("file_size").cast("string"))
    )
    return df.withColumn("method", method).withColumn("_key", key)


def content_key(df: DataFrame) -> DataFrame:
    """W4 key: the full hash (and the size, for short digests).  A row without a full hash cannot be proven equal to any other
    and stays its own group."""
    digest = F.concat_ws(":", F.col("full_hash"), F.col("file_size").cast("string"))
    key = F.when(F.col("full_hash").isNotNull(), digest).otherwise(F.concat(F.lit("\u0000path:"), F.col("full_path")))
    return df.withColumn("method", F.lit(METHOD_FULL)).withColumn("_key", key)


def _dedup(keyed: DataFrame, cols: list[str], pin: bool = True) -> DedupResult:
    order = ["stage_no", "full_path", "position"] if "stage_no" in cols else ["full_path", "position"]
    rest = [c for c in cols if c not in order]
    groups = keyed.groupBy("method", "_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct((F.col("position") >= 0).alias("_new"), *order, *rest)).alias("_k"),
    )
    if pin:
        # one row per group, pinned: the kept set, the report and the summary read it without
        # recomputing, and the report's join to it can be split by AQE when one group is hot
        from ..session import materialize

        groups = materialize(groups)
    kept = groups.select(*[F.col(f"_k.{c}").alias(c) for c in cols], "method")
    originals = groups.where(F.col("_n") > 1).select("method", "_key", F.col("_k.full_path").alias("original_path"), F.col("_k.position").alias("_at"))
    report = (
        keyed.join(originals, ["method", "_key"], "inner")
        .where((F.col("full_path") != F.col("original_path")) | (F.col("position") != F.col("_at")))
        .select(
            F.col("full_path").alias("duplicate_path"),
            "original_path",
            "method",
            F.col("file_size").cast("string").alias("file_size"),
            "filename",
        )
    )
    summary = groups.agg(
        F.sum("_n").cast("bigint").alias("before"),
        F.count(F.lit(1)).cast("bigint").alias("after"),
    ).select(
        F.coalesce("before", F.lit(0).cast("bigint")).alias("before"),
        "after",
        (F.coalesce("before", F.lit(0).cast("bigint")) - F.col("after")).alias("removed"),
    )
    return DedupResult(kept, report, summary)


def dedup_tiered(missing: DataFrame, pin: bool = True) -> DedupResult:
    """W1 + W2: the reference's tiered first-seen dedup.  Unsafe by design: files of equal size
    that were never compared are dropped as duplicates (SURVEY Q3); kept for parity."""
    return _dedup(tiered_key(missing), missing.columns, pin)


def dedup_content(missing: DataFrame, pin: bool = True) -> DedupResult:
    """Dedup by full content hash only (the safe default)."""
    return _dedup(content_key(missing), missing.columns, pin)


def complete_hashes(missing: DataFrame, add_hashes, pin=None) -> DataFrame:
    """Make content dedup exact for file manifests without hashing every file.

    Rows decided at stage 1 or 2 carry no full hash.  A file can only equal another whose size
    it shares, so the same cheap-first cascade runs inside the lake: rows whose size occurs more
    than once get a prefix hash, rows whose (size, prefix) occurs more than once get a full hash.
    A row left without a full hash is then provably unique.  Group counts are aggregates (hot
    sizes are pre-aggregated), and only the rows that need bytes are read.  ``pin`` (default:
    :func:`tidemark.session.materialize`) keeps each hashed set so no file is read twice.
    """
    if pin is None:
        from ..session import materialize as pin
    cols = missing.columns
    multi_size = pin(
        missing.groupBy("file_size").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("file_size")
    )
    need1 = missing.join(multi_size, "file_size", "left_semi")
    rest1 = missing.join(multi_size, "file_size", "left_anti")
    with_prefix = pin(add_hashes(need1, "1k").select(*cols))
    keys = ["file_size", "prefix_hash"]
    multi_pref = pin(
        with_prefix.where(F.col("prefix_hash").isNotNull())
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    )
    need2 = with_prefix.join(multi_pref, keys, "left_semi")
    rest2 = with_prefix.join(multi_pref, keys, "left_anti")
    with_full = pin(add_hashes(need2, "full").select(*cols))
    return rest1.unionByName(rest2).unionByName(with_full)
