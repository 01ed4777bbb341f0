"""File sources (S1-S4): a recursive scan of a root into a manifest.

Two listers:

* ``include_hidden=True`` (default, parity with a tree walk): a walk in rounds by Spark tasks
  (``mapInPandas``), each task bounded by an entry budget, so listing a tree of millions of files
  is spread over the cluster.  Empty files and names starting with ``.`` or ``_`` are included.
* ``include_hidden=False``: Spark's ``binaryFile`` source with only ``path, length,
  modificationTime`` selected (the ``content`` column is pruned, never read).  Spark's file
  index skips zero-byte files and names starting with ``.`` or ``_`` (SURVEY Q1).

Both give one row per path, even when requested extensions overlap.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import DEFAULT_EXTENSIONS, extension_match, file_name, matched_extension, relative_to
from . import fs



def check_root(root: str) -> None:
    """A missing root raises FileNotFoundError, a root that is a file NotADirectoryError."""
    k = fs.kind(root)
    if k == "missing":
        raise FileNotFoundError(f"Base path does not exist: {root}")
    if k != "dir":
        raise NotADirectoryError(f"Base path is not a directory: {root}")


ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("full_path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("mtime_ms", T.LongType(), False),
    ]
)
UNREADABLE = -1  # size of the entry of a folder that could not be listed
_CHUNK = 50_000  # rows per Arrow batch out of a listing task
WALK_BUDGET = 100_000  # entries one task lists before handing the rest of its subtree on


def _walker(budget: int, root: str):
    """Walk the batch's directories depth first (an unreadable one gives an entry with size -1, the root
    must be readable); after ``budget`` entries the directories not yet
    opened are emitted (``is_dir``) for the next round, so one task never walks an unbounded
    subtree.  Rows stream out in chunks."""
    cols = list(ENTRY_SCHEMA.fieldNames())

    def run(batches):
        for pdf in batches:
            pending = list(pdf["dir"])[::-1]
            listed, buf = 0, []
            while pending:
                d = pending.pop()
                if listed >= budget:
                    buf.append((d, True, 0, 0))
                    continue
                try:
                    for full, is_dir, size, mt in fs.list_dir(d):
                        listed += 1
                        if is_dir and listed < budget:
                            pending.append(full)
                        else:  # a file, or a folder for the next round
                            buf.append((full, is_dir, size, mt))
                        if len(buf) >= _CHUNK:
                            yield pd.DataFrame(buf, columns=cols)
                            buf = []
                except OSError as e:
                    if d == root:
                        raise OSError(f"cannot list {d} on this executor: {e}") from e
                    buf.append((d, False, UNREADABLE, 0))
            yield pd.DataFrame(buf, columns=cols).astype({"is_dir": bool, "file_size": "int64", "mtime_ms": "int64"})

    return run


def _one_level(batches):
    cols = list(ENTRY_SCHEMA.fieldNames())
    for pdf in batches:
        buf = []
        for d in pdf["dir"]:
            for entry in fs.list_dir(d):
                buf.append(entry)
                if len(buf) >= _CHUNK:
                    yield pd.DataFrame(buf, columns=cols)
                    buf = []
        yield pd.DataFrame(buf, columns=cols).astype({"is_dir": bool, "file_size": "int64", "mtime_ms": "int64"})


def list_files(spark: SparkSession, root: str, dirs_per_task: int = 16, max_tasks: int | None = None,
               budget: int = WALK_BUDGET) -> DataFrame:
    """Every regular file below ``root`` (hidden and empty ones included).

    Rounds of a walk on the executors: the directories still to open are a DataFrame, spread over
    tasks; each task walks its directories until it has listed ``budget`` entries and hands the
    unopened ones to the next round.  Each round's output is pinned (shared checkpoint folder).
    A small tree is listed in one round; a deep or wide tree spreads over the cluster round by round.
    One folder is listed by one task (a directory can only be read in sequence), entry by entry.
    The root must be readable on the executors; folders below it that are not are counted and
    reported in a warning.  Neither the listing nor the directory set
    passes through the driver, which only asks whether another round is needed.
    """
    from ..session import materialize

    root = fs.normalize(root)
    cap = max_tasks or max(1, spark.sparkContext.defaultParallelism * 4)
    frontier = spark.createDataFrame([(root,)], "dir string")
    n_dirs = 1
    files = None
    while n_dirs > 0:
        parts = max(1, min(cap, -(-n_dirs // dirs_per_task)))
        entries = materialize(frontier.repartition(parts).mapInPandas(_walker(budget, root), ENTRY_SCHEMA))
        unreadable = entries.where(F.col("file_size") == UNREADABLE).count()
        if unreadable:
            warnings.warn(f"{unreadable} folders below {root} cannot be read and were left out", stacklevel=2)
        level_files = entries.where(~F.col("is_dir") & (F.col("file_size") != UNREADABLE)).select("full_path", "file_size", "mtime_ms")
        files = level_files if files is None else files.unionByName(level_files)
        frontier = entries.where(F.col("is_dir")).select(F.col("full_path").alias("dir"))
        n_dirs = 0 if frontier.isEmpty() else frontier.count()
    return files


def list_names(spark: SparkSession, folder: str, folders: bool = False) -> DataFrame:
    """Names of the files (and, on request, folders) directly in ``folder``: one listing task that streams
    the entries; nothing on the driver."""
    folder = fs.normalize(folder)
    entries = spark.createDataFrame([(folder,)], "dir string").mapInPandas(_one_level, ENTRY_SCHEMA)
    if not folders:
        entries = entries.where(~F.col("is_dir"))
    return entries.select(F.element_at(F.split("full_path", "/"), -1).alias("filename"))


def list_files_binary(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Listing through Spark's ``binaryFile`` source; ``content`` is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    path = F.col("path")
    local = F.when(path.startswith("file:"), F.regexp_replace(path, r"^file:(//)?", "")).otherwise(path)
    return df.select(
        local.alias("full_path"),
        F.col("length").cast("bigint").alias("file_size"),
        (F.unix_millis(F.col("modificationTime"))).alias("mtime_ms"),
    )


def manifest_from_listing(listing: DataFrame, root: str, extensions=DEFAULT_EXTENSIONS,
                          case_sensitive: bool = False, with_time: bool = False) -> DataFrame:
    """S2 + P1: filter by extension and derive the manifest columns (``with_time``: ``mtime_ms`` last).  Manifest order is the order of
    ``full_path``, whatever the listing's partitions, so every position is 0 here and readers that need one
    row of many break ties by path."""
    root = fs.normalize(root)
    name = file_name("full_path")
    df = listing
    if extensions is not None:
        df = df.where(extension_match(name, extensions, case_sensitive))
        ext = matched_extension(name, extensions, case_sensitive)
    else:
        from ..functions.paths import lower_suffix

        ext = lower_suffix(name)
    return df.select(
        "full_path",
        relative_to("full_path", root).alias("relative_path"),
        name.alias("filename"),
        ext.alias("file_extension"),
        F.col("file_size").cast("bigint").alias("file_size"),
        F.lit(None).cast("string").alias("prefix_hash"),
        F.lit(None).cast("string").alias("full_hash"),
        F.lit(0).cast("bigint").alias("position"),
        F.lit(None).cast("string").alias("error_message"),
        *([F.col("mtime_ms")] if with_time else []),
    )


def scan_manifest(
    spark: SparkSession,
    root: str,
    extensions=DEFAULT_EXTENSIONS,
    exclude: DataFrame | None = None,
    case_sensitive: bool = False,
    include_hidden: bool = True,
    with_time: bool = False,
) -> DataFrame:
    """Manifest of the files below ``root`` whose extension is requested.

    ``exclude`` (a DataFrame with ``full_path``) drops known paths (S3) with a ``left_anti``.
    """
    root = fs.normalize(root)
    check_root(root)
    listing = list_files(spark, root) if include_hidden else list_files_binary(spark, root)
    m = manifest_from_listing(listing, root, extensions, case_sensitive, with_time)
    if exclude is not None:
        m = m.join(exclude.select("full_path").distinct(), "full_path", "left_anti")
    return m
