"""Incremental anti-join: what signed changes of lake and library do to the recorded result (R2).

A lake item's verdict depends only on files of its own size.  So a change touches the items of the sizes that changed:
new items are classified; items of a size whose library files changed are classified again against the library as
it is now (known digests are reused); the others of a touched size only meet the new items in the dedup.  An item that was
recorded and now has its content in the library is retracted, one whose last library copy went is recorded.

Outcomes of lake items: ``missing`` (recorded: no library file has the content, first of its content in the lake),
``in_lake`` (the content of an item that is recorded), ``in_library``.  Library rows are ``present`` or ``absent``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as st
from ..operators import compare as cmp
from ..operators import dedup as dd
from ..session import materialize

MISSING, IN_LAKE, IN_LIBRARY = "missing", "in_lake", "in_library"
PRESENT, ABSENT = "present", "absent"
_ROW = ["full_path", "file_size"]
_VERDICT = ["outcome", "stage", "stage_no", "processing_status", "prefix_hash", "full_hash"]


@dataclass
class Delta:
    lake: DataFrame  # lake rows that are new or whose verdict or digests changed, with ``outcome``
    library: DataFrame  # library rows that came, went or got a digest, with ``outcome``
    events: DataFrame  # signed changes of the recorded items: sign, and the item's columns


def library_delta(library: DataFrame, recorded: DataFrame) -> DataFrame:
    """The signed changes (``sign`` +1 or -1) that turn the recorded library into ``library``; a file whose time differs at
    equal size is +1 again (its digests are computed anew)."""
    cols = [c for c in recorded.columns if c not in ("outcome", "side")]
    now = library
    for c in cols:
        if c not in now.columns:
            now = now.withColumn(c, F.lit(None).cast(recorded.schema[c].dataType))
    old = recorded.select(*_ROW, F.col("mtime_ms").alias("_t"), F.lit(True).alias("_old"))
    came = now.select(*cols).join(old, _ROW, "left").where(F.col("_old").isNull() | (F.col("mtime_ms") != F.col("_t")))
    gone = recorded.select(*cols).join(now.select(*_ROW), _ROW, "left_anti")
    return came.select(F.lit(1).alias("sign"), *cols).unionByName(gone.select(F.lit(-1).alias("sign"), *cols))


def apply_delta(prior_lake: DataFrame, prior_library: DataFrame, new: DataFrame, changes: DataFrame, add_hashes=None, on_unhashed: str = "keep") -> Delta:
    """``prior_*``: the state's rows of all touched sizes (``outcome`` included; absent library rows may be left out);
    ``new``: lake items not seen before; ``changes``: signed library rows.  With ``add_hashes`` digests are filled in stage by
    stage; without, all rows carry theirs (tables)."""
    cols = new.columns
    changes = materialize(changes)
    came = changes.where("sign > 0")
    there = prior_library.where(F.col("outcome") == PRESENT)
    kept_library = there.join(changes.select(*_ROW).distinct(), _ROW, "left_anti")
    library_cols = [c for c in cols if c in there.columns]
    library = materialize(kept_library.select(*library_cols).unionByName(came.select(*library_cols)))

    changed_sizes = materialize(changes.select("file_size").distinct())
    fresh = prior_lake.join(new.select(*_ROW), _ROW, "left_anti")  # a replayed path counts as new
    affected = fresh.join(changed_sizes, "file_size", "left_semi")
    again = materialize(new.unionByName(affected.select(*cols)))
    hashed: list[DataFrame] = []
    if add_hashes is None:
        flagged = cmp.classify(again, library, on_unhashed)
    else:
        flagged = cmp.classify_staged(again, library, add_hashes, on_unhashed, materialize=materialize, hashed_library=hashed)
    flagged = materialize(flagged)

    # dedup over the missing items of the touched sizes; recorded ones stay the keepers of their content
    verdict = [*cols, "stage", "stage_no", "processing_status"]
    rest = fresh.join(changed_sizes, "file_size", "left_anti").where(F.col("outcome").isin(MISSING, IN_LAKE))
    was = fresh.where(F.col("outcome") == MISSING).select(*_ROW, F.lit(True).alias("_was"))
    missing = cmp.missing_only(flagged).select(*verdict).unionByName(rest.select(*verdict))
    missing = missing.join(was, _ROW, "left").withColumn("_real_position", F.col("position"))
    missing = missing.withColumn("position", F.when(F.col("_was"), F.lit(-1).cast("bigint")).otherwise(F.col("position")))
    if add_hashes is not None:
        missing = dd.complete_hashes(missing, add_hashes)
    missing = materialize(missing)
    first = materialize(dd.dedup_content(missing).kept.select(*_ROW, F.lit(MISSING).alias("_first")))
    missing = missing.join(first, _ROW, "left").withColumn("position", F.col("_real_position"))
    missing = missing.select(*verdict, F.coalesce("_first", F.lit(IN_LAKE)).alias("outcome"))
    found = flagged.where(~F.col("stage").isin(*st.MISSING_STAGES)).select(*verdict, F.lit(IN_LIBRARY).alias("outcome"))
    lake = missing.unionByName(found)

    before = fresh.select(*_ROW, *[F.col(c).alias(f"_old_{c}") for c in _VERDICT])
    lake = lake.join(before, _ROW, "left")
    differs = F.lit(False)
    for c in _VERDICT:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    lake = materialize(lake.where(differs))
    is_in, was_in = F.col("outcome") == MISSING, F.coalesce(F.col("_old_outcome") == MISSING, F.lit(False))
    events = lake.where(is_in != was_in).select(F.when(is_in, 1).otherwise(-1).alias("sign"), *cols)

    # library rows: those that came (with the digests found now), those that got a digest, those that went
    now = came.select(*library_cols, F.lit(True).alias("_came")).unionByName(kept_library.select(*library_cols, F.lit(False).alias("_came")))
    if hashed:
        known = hashed[0].select(*_ROW, "prefix_hash", "full_hash").unionByName(hashed[1].select(*_ROW, "prefix_hash", "full_hash"))
        known = known.groupBy(*_ROW).agg(F.max("prefix_hash").alias("_p"), F.max("full_hash").alias("_f"))
        now = now.join(known, _ROW, "left")
        learned = (F.col("prefix_hash").isNull() & F.col("_p").isNotNull()) | (F.col("full_hash").isNull() & F.col("_f").isNotNull())
        now = now.where(F.col("_came") | learned)
        now = now.withColumns({"prefix_hash": F.coalesce("prefix_hash", "_p"), "full_hash": F.coalesce("full_hash", "_f")})
    else:
        now = now.where("_came")
    now = now.select(*library_cols, F.lit(PRESENT).alias("outcome"))
    back = came.select(*_ROW)  # gone and come again in one step
    gone = changes.where("sign < 0").join(back, _ROW, "left_anti").select(*library_cols, F.lit(ABSENT).alias("outcome"))
    return Delta(lake.drop(*[f"_old_{c}" for c in _VERDICT]), materialize(now.unionByName(gone)), events)


def advance(lake: DataFrame | None, library: DataFrame | None, new: DataFrame, library_now: DataFrame, on_unhashed: str = "keep") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step over tables whose rows carry their digests: the state (lake rows with verdict, library rows) after new lake
    items came and the library became ``library_now``, and the signed changes.  ``None`` stands for an empty state."""
    spark, cols = new.sparkSession, new.columns
    if library is None:
        library = library_now.limit(0).withColumns({"mtime_ms": F.lit(None).cast("bigint"), "outcome": F.lit(PRESENT)})
    if lake is None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema)
        lake = spark.createDataFrame([], f"{fields}, stage string, stage_no int, processing_status string, outcome string")
    changes = materialize(library_delta(library_now, library.where(F.col("outcome") == PRESENT)))
    sizes = materialize(new.select("file_size").unionByName(changes.select("file_size")).distinct())
    delta = apply_delta(lake.join(sizes, "file_size", "left_semi"), library.join(sizes, "file_size", "left_semi"), new, changes, None, on_unhashed)
    lake_after = lake.join(delta.lake.select(*_ROW), _ROW, "left_anti").unionByName(delta.lake.select(*lake.columns))
    rows = delta.library.withColumn("mtime_ms", F.lit(None).cast("bigint"))
    library_after = library.join(rows.select(*_ROW), _ROW, "left_anti").unionByName(rows, allowMissingColumns=True)
    return materialize(lake_after), materialize(library_after), delta.events.select("sign", *cols)
