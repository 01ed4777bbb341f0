"""Byte readers for file manifests (P3-P5): digests computed on the executors, by path.

* stage ``"1k"``: a ranged read of the first ``PREFIX_BYTES`` bytes, never the whole file;
* stage ``"full"``: a chunked read (``READ_CHUNK_BYTES`` at a time), so a file of any size
  streams through a constant buffer and never becomes a row; before it the rows are
  repartitioned so each task reads about the same number of bytes.

Only rows whose hash is still NULL are read, so hashes already known (a resumed state table)
are never recomputed.  A read failure leaves the hash NULL and fills ``error_message`` (the
reference stores nothing on failure; SURVEY 1.4).  An unknown stage is rejected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import LARGE_FILE_BYTES, PREFIX_BYTES, READ_CHUNK_BYTES, get_hasher
from ..operators.routing import balance_by_bytes
from ..session import materialize
from . import fs

STAGES = {"1k": "prefix_hash", "full": "full_hash"}


def digest_prefix(path: str, hasher, n: int = PREFIX_BYTES) -> str:
    h = hasher.new()
    with fs.open_read(path) as f:
        h.update(f.read(n))
    return h.hexdigest()


def digest_full(path: str, hasher, chunk: int = READ_CHUNK_BYTES) -> str:
    h = hasher.new()
    with fs.open_read(path) as f:
        while True:
            b = f.read(chunk)
            if not b:
                break
            h.update(b)
    return h.hexdigest()


def _reader(stage: str, hasher, path_col: str, prefix_bytes: int, io_threads: int):
    target = STAGES[stage]

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def one(path):
            try:
                if stage == "1k":
                    return digest_prefix(path, hasher, prefix_bytes), None
                return digest_full(path, hasher), None
            except Exception as e:  # noqa: BLE001 - any failure isolates one file
                return None, f"{type(e).__name__}: {e}"

        # reads are I/O bound (a small ranged read per file, or a stream): a few threads per task
        # keep several reads in flight; hashlib releases the GIL on large buffers
        with ThreadPoolExecutor(max_workers=max(1, io_threads)) as pool:
            for pdf in batches:
                hashes = pdf[target].astype(object).tolist()
                errors = pdf["error_message"].astype(object).tolist() if "error_message" in pdf else [None] * len(pdf)
                todo = [i for i, cur in enumerate(hashes) if cur is None or (isinstance(cur, float) and pd.isna(cur))]
                paths = pdf[path_col].tolist()
                for i, (h, err) in zip(todo, pool.map(one, [paths[i] for i in todo])):
                    hashes[i] = h
                    if err is not None:
                        errors[i] = err
                pdf[target] = pd.Series(hashes, index=pdf.index, dtype=object)
                pdf["error_message"] = pd.Series(errors, index=pdf.index, dtype=object)
                yield pdf

    return run


def hash_files(
    df: DataFrame,
    stage: str,
    hasher=None,
    path_col: str = "full_path",
    balance: bool = True,
    bytes_per_task: int = 512 * 1024 * 1024,
    prefix_bytes: int = PREFIX_BYTES,
    large_threshold: int = LARGE_FILE_BYTES,
    io_threads: int = 8,
    reads_per_task: int = 2_000,
) -> DataFrame:
    """P5: fill ``prefix_hash`` (``stage='1k'``) or ``full_hash`` (``stage='full'``) by reading
    the files; returns the same columns plus ``error_message``.

    The rows to read are spread first: prefix reads (tiny, latency bound) by a hash of the path, about
    ``reads_per_task`` of them a task; full reads by bytes (:func:`balance_by_bytes`).  The
    incoming partitioning is sized by manifest bytes (about 300 B per row), which would hand one
    task far too many files."""
    if stage not in STAGES:
        raise ValueError(f"Unknown stage: {stage}")
    h = get_hasher(hasher)
    out = df if "error_message" in df.columns else df.withColumn("error_message", F.lit(None).cast("string"))
    if balance:
        # pinned: counting, and splitting into rows to read and rows already known, would evaluate the
        # joins that chose the candidates again and again
        out = materialize(out)
    if stage == "1k" and balance:
        # the reader passes over known hashes, so all rows go the same way
        out = out.repartition(max(1, -(-out.count() // reads_per_task)), F.xxhash64(path_col))
    if stage == "full" and balance:
        todo = out.where(F.col("full_hash").isNull())
        # O3 re-aimed: inside each byte-balanced task the largest files go first, so the task's
        # longest reads start early (longest-processing-time-first) instead of ending it late
        todo = balance_by_bytes(todo, bytes_per_task, large_threshold=large_threshold).sortWithinPartitions(
            F.col("file_size").desc()
        )
        out = todo.unionByName(out.where(F.col("full_hash").isNotNull()))
    return out.mapInPandas(_reader(stage, h, path_col, prefix_bytes, io_threads), out.schema)


def file_hasher(hasher=None, **kw):
    """``add_hashes`` callable for :func:`tidemark.operators.compare.classify_staged`."""

    def add(df: DataFrame, stage: str) -> DataFrame:
        return hash_files(df, stage, hasher, **kw).select(*df.columns)

    return add


def _exists_reader(path_col: str):
    def run(batches):
        for pdf in batches:
            pdf["_exists"] = [fs.exists(p) for p in pdf[path_col].tolist()]
            yield pdf

    return run


def probe_exists(df: DataFrame, path_col: str = "full_path") -> DataFrame:
    """Adds ``_exists``: whether the path exists now, checked by the executors."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField("_exists", T.BooleanType(), True)])
    return df.mapInPandas(_exists_reader(path_col), schema)
