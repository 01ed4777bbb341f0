"""Incremental analysis: batch resume (J10, R1) and continuous arrival (R2).

The reference's resume drops already-listed paths and then overwrites its manifest with only the
new rows (SURVEY Q4).  Here the prior rows are kept and merged, and, because the library may have
changed between runs, prior verdicts are re-checked against the current library
(``recheck_prior=True``): the prior state carries both hashes, so the re-check joins digests
and reads no bytes.  Prior rows have the position ``PRIOR_POSITION``, before every new row: an item that
was kept once stays the keeper of its content, since it may have been imported already.

A prior row stands for its file only while the file is as it was: one whose size, time or (for tables) digest differs
now is analysed anew like a new path, one whose path is gone is dropped; :func:`prior_changes` names both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..plans.analyze import AnalyzeResult, analyze, finish
from ..session import materialize as _materialize


PRIOR_POSITION = -1


def resume(lake: DataFrame, prior: DataFrame) -> DataFrame:
    """Lake rows whose path is not in the prior manifest (``left_anti`` on ``full_path``)."""
    seen = prior.select("full_path").where(F.col("full_path").isNotNull()).distinct()
    return lake.join(seen, "full_path", "left_anti")


def prior_changes(lake: DataFrame, prior: DataFrame) -> DataFrame:
    """The prior rows with ``change``: NULL for a file that is as it was, ``changed`` for one of another size, time or digest,
    ``vanished`` for a path that the lake no longer has.

    Times are compared where both sides have ``mtime_ms``; a prior manifest with ``processed_at`` only (CSV) has its file changed
    if that is newer."""
    cols = {"file_size": "_size", "full_hash": "_full", "prefix_hash": "_prefix"}
    if "mtime_ms" in lake.columns:
        cols["mtime_ms"] = "_time"
    now = lake.select("full_path", *[F.col(c).alias(a) for c, a in cols.items()], F.lit(True).alias("_there"))
    j = prior.join(now, "full_path", "left")
    differs = ~F.col("file_size").eqNullSafe(F.col("_size"))
    differs = differs | F.coalesce(F.col("full_hash") != F.col("_full"), F.lit(False)) | F.coalesce(F.col("prefix_hash") != F.col("_prefix"), F.lit(False))
    if "mtime_ms" in lake.columns:
        if "mtime_ms" in prior.columns:
            differs = differs | F.coalesce(F.col("mtime_ms") != F.col("_time"), F.lit(False))
        if "processed_at" in prior.columns:
            exact = F.col("mtime_ms").isNotNull() if "mtime_ms" in prior.columns else F.lit(False)
            differs = differs | F.coalesce(~exact & (F.col("_time") > F.unix_millis("processed_at")), F.lit(False))
    change = F.when(F.col("_there").isNull(), "vanished").when(differs, "changed")
    return j.withColumn("change", change).drop(*cols.values(), "_there")


def resume_merge(
    lake: DataFrame,
    lib: DataFrame,
    prior: DataFrame,
    *,
    dedup: str = "content",
    on_unhashed: str = "keep",
    recheck_prior: bool = True,
    add_hashes=None,
) -> AnalyzeResult:
    """Analyse only new and changed paths, merge with the prior result, dedup over both.  ``lake`` is the whole lake as it
    is now; the result's ``changes`` lists prior paths that changed or vanished.

    With ``recheck_prior`` the prior rows go through the cascade again together with the new
    rows (one pass, the library's key sets read once); their known hashes are reused, so only
    rows that now need a hash they lack are read."""
    cols = lake.columns
    prior = _materialize(prior_changes(lake, prior))
    changes = prior.where("change is not null").select("full_path", "change")
    prior = prior.where("change is null")
    new = resume(lake, prior)
    prior_rows = prior.select(*cols).withColumn("position", F.lit(PRIOR_POSITION).cast("bigint"))
    pin = _materialize if add_hashes is not None else None
    if recheck_prior:
        rows = new.unionByName(prior_rows)
        flagged = (cmp.classify(rows, lib, on_unhashed) if add_hashes is None
                   else cmp.classify_staged(rows, lib, add_hashes, on_unhashed, materialize=pin))
    else:
        flagged_new = (cmp.classify(new, lib, on_unhashed) if add_hashes is None
                       else cmp.classify_staged(new, lib, add_hashes, on_unhashed, materialize=pin))
        flagged = flagged_new.unionByName(
            prior.select(*cols, "stage", "stage_no", "processing_status").withColumn("position", F.lit(PRIOR_POSITION).cast("bigint"))
        )
    # pinned: the summary, the dedup keepers and the report all read it
    out = finish(_materialize(flagged), dedup, add_hashes, materialize=True)
    out.changes = changes
    return out


__all__ = ["resume", "resume_merge", "analyze"]
