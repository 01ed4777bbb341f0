"""R2: continuous arrival.  New lake files are analysed as they land, and library changes as they come.

    q = start_ingest(spark, "/lake", library_manifest, "/state/missing", "/state/_checkpoint")
    q.awaitTermination()

Structured Streaming's ``binaryFile`` source lists the lake (only ``path``/``length``/
``modificationTime`` are used; the ``content`` column is never read) and remembers in its
checkpoint which files it has seen, so each file is handled once.  Every micro-batch
(``foreachBatch``):

1. builds the manifest rows of the new files, and the signed changes of the library (new snapshot against the
   recorded library, or changes that the caller gives);
2. reads the state's rows of the sizes that the batch touches, and nothing else of its history
   (:mod:`tidemark.streaming.state`);
3. classifies the new items, and again the items of a size whose library files changed; dedups by content among
   the items of the touched sizes (:mod:`tidemark.streaming.delta`).  Digests known from earlier batches are
   reused, only survivors are hashed;
4. commits the changed rows as one version named by the batch, so a batch replayed after a failure replaces its
   own version (also with no rows): idempotent.  The recorded and retracted items are also written as signed rows to
   ``<state>_changes/batch_id=<n>``, for consumers that follow the result.

The numbers of each batch (rows read and written, items recorded and retracted, library files that came and went) come from
the pass that writes, by Spark's ``observe``; :func:`batch_counts` returns them.

Spark's file index skips zero-byte files and names starting with ``.`` or ``_`` (SURVEY Q1).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import get_hasher
from ..functions.paths import DEFAULT_EXTENSIONS
from ..session import materialize
from ..sources import fs
from ..sources.files import manifest_from_listing
from ..sources.manifest_io import check_hasher, path_exists
from ..sources.readers import file_hasher
from .delta import MISSING, PRESENT, apply_delta, library_delta
from .state import COLUMNS, STATE_DDL, KeyedState

_CHANGE_DDL = "sign int, " + ", ".join(c for c in STATE_DDL.split(", ") if not c.startswith(("side ", "outcome ", "batch_id ")))


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The items recorded so far (no rows when nothing was recorded yet; any other trouble with the
    state is an error, never an empty state)."""
    rows = KeyedState(spark, state_path).rows()
    return rows.where((F.col("side") == "lake") & (F.col("outcome") == MISSING)).drop("side", "outcome")


def read_library(spark: SparkSession, state_path: str) -> DataFrame:
    """The library as recorded, with the digests known so far."""
    rows = KeyedState(spark, state_path).rows()
    return rows.where((F.col("side") == "library") & (F.col("outcome") == PRESENT)).drop("side", "outcome")


def read_changes(spark: SparkSession, state_path: str) -> DataFrame:
    """Signed changes of the recorded items, by batch: +1 recorded, -1 retracted."""
    path = changes_path(state_path)
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{_CHANGE_DDL}, batch_id bigint")
    return spark.read.schema(f"{_CHANGE_DDL}, batch_id bigint").parquet(path)


def changes_path(state_path: str) -> str:
    return state_path.rstrip("/") + "_changes"


def batch_counts(spark: SparkSession, state_path: str) -> dict[int, dict]:
    """The numbers of the batches whose versions are kept."""
    versions = KeyedState(spark, state_path).versions
    return {c["batch"]: c["info"] for c in (versions.read(n) for n in versions.numbers())}


def _conform(df: DataFrame, side: str, batch_id: int, hasher: str) -> DataFrame:
    """Rows in the layout of the state."""
    fixed = {"side": F.lit(side), "hasher": F.lit(hasher), "batch_id": F.lit(batch_id).cast("bigint")}
    kinds = dict(c.split(" ") for c in STATE_DDL.split(", "))
    return df.select(*[
        fixed[c].alias(c) if c in fixed else (F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS
    ])


def process_batch(spark: SparkSession, listing: DataFrame, batch_id: int, lake_root: str, library: DataFrame | None,
                  state_path: str, extensions=DEFAULT_EXTENSIONS, hasher=None, changes: DataFrame | None = None,
                  library_token: str | None = None, **state_options) -> dict:
    """One micro-batch (also usable on its own for a batch of new paths); returns its numbers.

    ``library``: the library's manifest as it is now.  It is compared with the recorded library, unless ``library_token`` says
    that the recorded one is this very snapshot.  ``changes`` (``sign`` +1 or -1 and manifest columns) gives the library's
    changes instead, so that no batch reads the whole library."""
    add = file_hasher(hasher)
    name = get_hasher(hasher).name
    state = KeyedState(spark, state_path, **state_options)
    base = state.before(batch_id)
    new = manifest_from_listing(listing, lake_root, extensions)
    new = materialize(new.withColumn("position", F.lit(batch_id).cast("bigint") * F.lit(1 << 40) + F.col("position")))
    token = base.info.get("library")
    if changes is None:
        if library is None or library_token is not None and library_token == token:
            changes = spark.createDataFrame([], f"sign int, {STATE_DDL}")
        else:
            recorded = state.rows(base).where((F.col("side") == "library") & (F.col("outcome") == PRESENT))
            changes, token = library_delta(library, recorded), library_token
    for c in new.columns:
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    changes = materialize(changes)
    sizes = materialize(new.select("file_size").unionByName(changes.select("file_size")).distinct())
    buckets = state.buckets(base, sizes)
    prior = materialize(state.rows(base, buckets).join(sizes, "file_size", "left_semi"))
    check_hasher(prior.where(F.col("side") == "lake"), hasher)
    lake, lib = (prior.where(F.col("side") == side) for side in ("lake", "library"))
    delta = apply_delta(lake, lib, new, changes, add)
    # a row keeps the batch that recorded it while it stays recorded
    since = lake.where(F.col("outcome") == MISSING).select("full_path", "file_size", F.col("batch_id").alias("_since"))
    rows = _conform(delta.lake, "lake", batch_id, name).join(since, ["full_path", "file_size"], "left")
    rows = rows.withColumn("batch_id", F.when(F.col("outcome") == MISSING, F.coalesce("_since", "batch_id")).otherwise(F.col("batch_id")))
    rows = rows.select(*COLUMNS).unionByName(_conform(delta.library, "library", batch_id, name))

    seen, told = Observation(), Observation()
    is_lake = F.col("side") == "lake"
    rows = rows.observe(
        seen, F.count_if(is_lake).alias("lake_rows"), F.count_if(~is_lake).alias("library_rows"),
        F.coalesce(F.sum(F.when(is_lake & (F.col("outcome") == MISSING), F.col("file_size"))), F.lit(0).cast("bigint")).alias("missing_bytes"),
    )
    events = delta.events
    for c in [c.split(" ")[0] for c in _CHANGE_DDL.split(", ")]:
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(dict(x.split(" ") for x in _CHANGE_DDL.split(", "))[c]))
    events = events.select(*[c.split(" ")[0] for c in _CHANGE_DDL.split(", ")]).observe(
        told, F.count_if(F.col("sign") > 0).alias("recorded"), F.count_if(F.col("sign") < 0).alias("retracted"))
    # the changes go first: the version file, which is last, decides whether the batch happened
    events.write.mode("overwrite").parquet(f"{changes_path(state_path)}/batch_id={batch_id}")
    info = {"library": token, "rows_read": sum(base.rows.get(b, 0) for b in buckets), "buckets_read": len(buckets), **told.get}
    done = state.commit(base, rows, batch_id, info, lambda: seen.get)
    return done.info


def start_ingest(
    spark: SparkSession,
    lake_root: str,
    library: DataFrame | Callable[[], DataFrame],
    state_path: str,
    checkpoint_location: str,
    extensions=DEFAULT_EXTENSIONS,
    hasher=None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    library_changes: Callable[[int], DataFrame] | None = None,
    **state_options,
):
    """Start the ingest query.

    ``library`` is a library manifest (pinned by the caller), compared with the recorded library once per start, or a
    function that gives the manifest as it is at each batch.  ``library_changes(batch_id)`` gives the signed changes
    themselves instead."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(lake_root)
    path = F.col("path")
    listing = stream.select(
        F.when(path.startswith("file:"), F.regexp_replace(path, r"^file:(//)?", "")).otherwise(path).alias("full_path"),
        F.col("length").cast("bigint").alias("file_size"),
        F.unix_millis(F.col("modificationTime")).alias("mtime_ms"),
    )
    root = fs.strip_file_scheme(lake_root)
    token = uuid.uuid4().hex

    def each(batch_df: DataFrame, batch_id: int) -> None:
        given = library_changes(batch_id) if library_changes is not None else None
        now = library() if callable(library) else library
        process_batch(batch_df.sparkSession, batch_df, batch_id, root, now, state_path, extensions, hasher, given,
                      None if callable(library) else token, **state_options)

    w = listing.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
