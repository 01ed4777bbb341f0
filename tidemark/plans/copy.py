"""Copy the items of a manifest into one flat target folder.

    results, summary = copy_manifest(spark, "missing.csv", "/library/import", mode="rename")

Steps, all on Spark: read the manifest (C1) -> list the names already in the target folder
(J12) -> probe which sources still exist (J11, executors) -> plan (C2-C7, W3) -> copy (C8,
tasks) or, for a dry run, the plan itself (C7) -> summary (A8, A9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..operators import copyjob, copyplan
from ..operators.metrics import copy_summary
from ..sources import fs
from ..sources.files import list_names
from ..sources.manifest_io import read_manifest, rebase
from ..sources.readers import probe_exists
from ..session import materialize


def existing_names(spark: SparkSession, target_root: str) -> DataFrame:
    """Names already taken at the top of the target folder (the copy target is flat), by files or
    folders; listed by a task, which fails if it cannot read the folder."""
    root = copyplan.target_folder(target_root)
    if fs.kind(root) != "dir":
        return spark.createDataFrame([], "filename string")
    return list_names(spark, root, folders=True)


def plan(
    spark: SparkSession,
    manifest: DataFrame,
    target_root: str,
    mode: str = "rename",
    check_sources: bool = True,
) -> DataFrame:
    """The dry-run plan of ``manifest`` (C7): where each item would go and why."""
    copyplan.check_mode(mode)
    sources = None
    if check_sources:
        sources = probe_exists(manifest.select("full_path").distinct()).where(F.col("_exists")).select("full_path")
    return copyplan.plan_copy(manifest, target_root, mode, sources=sources,
                              existing=existing_names(spark, target_root))


def copy_manifest(
    spark: SparkSession,
    manifest: DataFrame | str,
    target_root: str,
    mode: str = "rename",
    dry_run: bool = False,
    verify: str = "size",
    source_root: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Returns (results, summary).  ``manifest`` is a DataFrame or the path of a CSV manifest (rows that do
    not parse cannot be copied; the summary counts them as ``rejected``).  ``source_root`` rebases the
    sources onto ``source_root/relative_path`` (SURVEY Q13)."""
    copyplan.check_mode(mode)
    copyplan.target_folder(target_root)
    rejected = 0
    if isinstance(manifest, str):
        manifest, rejects = read_manifest(spark, manifest)
        rejected = rejects.count()
    if source_root is not None:
        manifest = rebase(manifest, source_root)
    if "relative_path" not in manifest.columns:
        manifest = manifest.withColumn("relative_path", file_name("full_path"))
    # The plan is fixed (written to the shared checkpoint folder) before any copy starts: a copy
    # task retried after an executor loss must not re-plan against a target folder that earlier
    # tasks have already filled, or its rename decisions could change.
    p = materialize(plan(spark, manifest, target_root, mode))
    if dry_run:
        return p, _counted(copy_summary(p), rejected)
    copyjob.check_target_root(target_root)
    results = copyjob.run_copy(p, mode=mode, verify=verify, pinned=True)
    return results, _counted(copy_summary(results), rejected)


def _counted(summary: DataFrame, rejected: int) -> DataFrame:
    return summary.withColumn("rejected", F.lit(rejected).cast("bigint")).withColumn("ok", F.col("ok") & (F.col("rejected") == 0))
