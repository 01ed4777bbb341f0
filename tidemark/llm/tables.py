"""Scratch tables in the shared folder, distinct texts, and connected components.

A step that is read more than once, or that ends a long lineage, is written as Parquet below the
session's shared folder (``spark.checkpoint.dir``) and read back, so a lost executor costs at most
the step that runs just then.  Nothing is kept in a machine-local folder.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_recording: ContextVar[tuple[list[str], ...]] = ContextVar("llm_scratch", default=())
_roots: dict[str, str] = {}  # by application


def _root(spark: SparkSession) -> str:
    """This application's folder of scratch tables, deleted when the application ends.  Only a local session without
    a shared folder gets one of its own; a cluster session without it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        shared = ensure_checkpoint_dir(spark, allow_local=local)
        if not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{shared.rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        p, fs = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _roots[app] = path
    return _roots[app]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _recording.get():
        paths.append(path)
    return path


@contextmanager
def recorded():
    """The paths of the scratch tables made inside, for ``delete_scratch`` once the results read from them are written."""
    paths: list[str] = []
    token = _recording.set((*_recording.get(), paths))
    try:
        yield paths
    finally:
        _recording.reset(token)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made inside at its end; results must be written by then."""
    with recorded() as paths:
        try:
            yield
        finally:
            delete_scratch(spark, paths)


def delete_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; every result read from them must be written by then."""
    for path in paths:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)
    release(spark)


#: Spark deletes the shuffle files of an execution at its end
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of what is written inside go when it is written; nothing reads them again, and they would
    stay until the JVM's next collection but one."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


#: Spark sends rows to Python workers in batches of up to this many bytes (and 10,000 rows)
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """What is written inside sends texts and sets to Python workers in small batches: 10,000 wide rows fill both the
    worker and native memory of the executor, much of which stays taken."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_writers: ContextVar[int | None] = ContextVar("llm_writers", default=None)
#: tasks that write a scratch table for each core, and bytes of the texts for each of these tasks
WRITERS_PER_CORE, WRITER_BYTES = 4, 8 << 20


@contextmanager
def few_files(spark: SparkSession, path: str):
    """Scratch tables made inside, none much larger than the table at ``path``, are written by as many tasks as keep all
    cores busy, and more where that table is large; not by one for each shuffle partition, each with a file of its own.
    A task then takes several partitions, one after another, so that it holds no more than before."""
    p, fs = _hadoop(spark, path)
    size = fs.getContentSummary(p).getLength()
    token = _writers.set(max(WRITERS_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // WRITER_BYTES)))
    try:
        yield
    finally:
        _writers.reset(token)


def _for_writing(df: DataFrame) -> DataFrame:
    n = _writers.get()
    return df.coalesce(n) if n else df


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back (``small``: nothing worth releasing)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        _for_writing(df).write.parquet(path)
    schema = df.schema
    del df
    if not small:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def staged_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema written one after another into one scratch table; the shuffle files of each go before
    the next begins, so the disk holds those of one part at a time."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch_path(spark, name)
        with shuffles_freed(spark):
            _for_writing(df).write.mode("append").parquet(path)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete frames that ``staged`` returned, as soon as all that is read from them is written."""
    for df in frames:
        if df is not None:
            p, fs = _hadoop(df.sparkSession, df._scratch)
            fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that nothing refers to any more (it
    works on garbage that the JVM has found)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: the 128-bit identity of a text, as two columns
KEY = ["ka", "kb"]


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``ka, kb``: two 64-bit hashes that name the text (NULL counts as empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({"ka": F.xxhash64(text), "kb": F.xxhash64(F.lit(0x5EED), text)})


#: texts of one task whose copies are dropped before the shuffle; a memory bound only, since a
#: copy that comes later than that is dropped after the shuffle
SEEN = 200_000


def _first_of_each(batches):
    """Keeps the first row of each key that this task sees (``SEEN`` latest keys remembered)."""
    seen: dict[tuple[int, int], None] = {}
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in KEY)
        keep = []
        for i, k in enumerate(zip(a, b)):
            if k not in seen:
                seen[k] = None
                keep.append(i)
        if len(seen) > SEEN:
            for k in list(seen)[: len(seen) - SEEN]:
                del seen[k]
        yield batch if len(keep) == len(batch) else batch.take(pa.array(keep, pa.int64()))


def _all_distinct(batches):
    """Keeps the first row of each key; a partition holds all rows of its keys."""
    seen = set()
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in KEY)
        keep = []
        for i, k in enumerate(zip(a, b)):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


class Bucketed:
    """A scratch table bucketed by ``KEY``: joining it with per-text results moves the results and not
    its rows, however often a method comes back to it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.name = f"llm_{name}_{uuid.uuid4().hex}"
        self.path = scratch_path(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.bucketBy(shuffle_partitions(self.spark), *KEY).option("path", self.path).saveAsTable(self.name)
        release(self.spark)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files; every result read from it must be written by then."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_scratch(self.spark, [self.path])


class DistinctTexts(Bucketed):
    """The distinct texts of a column.  Copies (one text may be a third of all rows) are dropped per task
    before the one shuffle of the texts."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        texts = with_key(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))).select(*KEY, "text")
        once = texts.mapInArrow(_first_of_each, texts.schema).repartition(shuffle_partitions(docs.sparkSession), *KEY)
        super().__init__(once.mapInArrow(_all_distinct, texts.schema), "texts")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)`` (longs): root is the least node reachable.

    Alternating large-star and small-star rounds: each round points every node's larger
    neighbours, then its smaller ones, at the least of them.  Work per round is linear in the edges
    and the number of rounds grows with the logarithm of the longest path.  Minima are aggregated
    before the shuffle, so a hub of any degree is no hot task; each round is written out.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", small=True)
    for _ in range(rounds):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = staged(small.where("u <> v").distinct(), "small", small=True)
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points at one other node, and those point at none: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    n = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return n.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def pack_columns(records: np.ndarray) -> bytes:
    """Structured records as bytes, column after column (high bytes of small numbers end up next to
    each other, which the shuffle's compression removes)."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def unpack_columns(data: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(data) // sum(dtype[f].itemsize for f in dtype.names)
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        out[f] = np.frombuffer(data, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return out
