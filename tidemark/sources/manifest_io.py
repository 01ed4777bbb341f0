"""Manifest sources and sinks.

The CSV form keeps the reference's layout: header ``relative_path,filename,file_size,full_path,
processed_at``, UTF-8, every field text, ``processed_at`` an ISO-8601 UTC stamp, one file (``csv``): tasks write
ordered parts, and tasks join them, each part at its own place of the file, which takes its name when it is whole.
``csv_parts`` leaves the parts as a folder, which a cluster also reads in parallel.  The Parquet
form is the state table: it also carries both hashes, so a resumed run never re-reads bytes.  It is published as a
version (:mod:`tidemark.sources.versions`), so a reader finds the old or the new manifest at any moment.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import get_hasher
from ..functions.paths import file_name, lower_suffix
from . import fs as files
from .versions import Versions, hadoop

# The CSV manifest layout.
CSV_COLUMNS = ("relative_path", "filename", "file_size", "full_path", "processed_at")
REPORT_COLUMNS = ("duplicate_path", "original_path", "method", "file_size", "filename")
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
_NULL_SENTINEL = "\u0000"  # an empty CSV field stays an empty string, a missing one is NULL

CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in CSV_COLUMNS])

REASON_FIELD = "missing field"
REASON_SIZE = "file_size is not an integer"


def manifest_rows(df: DataFrame) -> DataFrame:
    """The CSV row of each manifest row (S5): text columns in the fixed order, stamped now."""
    return df.select(
        F.col("relative_path").cast("string"),
        F.col("filename").cast("string"),
        F.col("file_size").cast("string"),
        F.col("full_path").cast("string"),
        F.date_format(F.current_timestamp(), ISO_UTC).alias("processed_at"),
    )


# Names may hold blanks, quotes, commas and line breaks; all of them survive a round trip.
_CSV_OPTIONS = {
    "header": "true", "escape": '"', "encoding": "UTF-8", "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


FORMATS = ("csv", "csv_parts", "parquet")


def write_manifest(df: DataFrame, path: str, fmt: str = "csv", hasher=None) -> None:
    """S5 + S10: write the manifest; an existing output is replaced, and an empty result still gets its
    header / schema (SURVEY Q5).

    Rows are in the order of their stage (where it is known), then path.  The new manifest is written
    aside and takes the old one's place when it is complete, so ``df`` may be derived from the manifest
    that it replaces, and a failed run leaves the old one.  The Parquet form names the ``hasher`` of its
    digests."""
    if fmt not in FORMATS:
        raise ValueError(f"Unknown manifest format: {fmt}")
    order = [c for c in ("stage_no", "full_path", "relative_path") if c in df.columns]
    rows = df.orderBy(*order)
    spark = df.sparkSession
    if fmt == "csv":
        write_csv_file(manifest_rows(rows), path)
    elif fmt == "csv_parts":
        aside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
        manifest_rows(rows).write.options(**_CSV_OPTIONS).csv(aside)
        _swap(spark, aside, path)
    else:
        name = get_hasher(hasher).name
        versions = Versions(spark, path)
        data = versions.new_data("manifest")
        rows.withColumns({"processed_at": F.current_timestamp(), "hasher": F.lit(name)}).write.parquet(versions.absolute(data))
        versions.publish({"data": data, "hasher": name})
        versions.vacuum(lambda content: [content["data"]])


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """The folder ``new`` takes the place of ``path``."""
    fs, target = hadoop(spark, path)
    old = hadoop(spark, f"{new}.old")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} out of the way")
    if not fs.rename(hadoop(spark, new)[1], target):
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(old, True)


_COPY_BYTES = 8 << 20


def _join_parts(target: str):
    """Copies each part (path, place) to its place of the target file; the file has its full size already."""

    def run(batches):
        for pdf in batches:
            done = []
            for path, place in zip(pdf["path"], pdf["place"]):
                n = 0
                with files.open_read(path) as source, open(target, "r+b") as out:
                    out.seek(int(place))
                    while chunk := source.read(_COPY_BYTES):
                        out.write(chunk)
                        n += len(chunk)
                    out.flush()
                    os.fsync(out.fileno())
                done.append(n)
            pdf["bytes"] = pd.Series(done, index=pdf.index, dtype="int64")
            yield pdf[["path", "bytes"]]

    return run


def _stream_parts(target: str, head: bytes):
    """The whole file through one task, part after part (stores where a file has one writer)."""

    def run(batches):
        store, path, _ = files._arrow_fs(target)
        with store.open_output_stream(path) as out:
            out.write(head)
            for pdf in batches:
                done = []
                for part in pdf["path"]:
                    n = 0
                    with files.open_read(part) as source:
                        while chunk := source.read(_COPY_BYTES):
                            out.write(chunk)
                            n += len(chunk)
                    done.append(n)
                pdf["bytes"] = pd.Series(done, index=pdf.index, dtype="int64")
                yield pdf[["path", "bytes"]]

    return run


def write_csv_file(rows: DataFrame, path: str) -> None:
    """One CSV file with one header, its rows in the order of ``rows``.

    Tasks write the parts of the ordered rows; the parts' sizes give each its place in the file, and tasks copy them
    there at the same time (on a path that all executors mount; in an object store one task streams them).  The file
    gets its name by a rename at the end: until then ``path`` is what it was."""
    spark = rows.sparkSession
    tag = uuid.uuid4().hex
    parts, aside = f"{path.rstrip('/')}.parts-{tag}", f"{path.rstrip('/')}.writing-{tag}"
    head = (",".join(rows.columns) + "\n").encode("utf-8")
    rows.write.options(**{**_CSV_OPTIONS, "header": "false"}).csv(parts)
    fs, folder = hadoop(spark, parts)
    found = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    place, listed = len(head), []
    for part, size in found:
        if size:
            listed.append((part, place, size))
            place += size
    table = spark.createDataFrame(listed, "path string, place bigint, size bigint")
    if fs.getUri().getScheme() == "file":
        target = files.strip_file_scheme(aside)
        with open(target, "wb") as f:
            f.write(head)
            f.truncate(place)
        copied = table.repartitionByRange(max(1, min(len(listed), 1024)), "place").mapInPandas(_join_parts(target), "path string, bytes bigint")
    else:
        copied = table.coalesce(1).sortWithinPartitions("place").mapInPandas(_stream_parts(fs.makeQualified(hadoop(spark, aside)[1]).toString(), head), "path string, bytes bigint")
    sizes = {r["path"]: r["bytes"] for r in copied.collect()}
    if {p: n for p, _, n in listed} != sizes:
        raise OSError(f"the parts of {path} changed while they were joined")
    _publish_file(spark, aside, path)
    fs.delete(folder, True)


def _publish_file(spark: SparkSession, new: str, path: str) -> None:
    """The file ``new`` takes the place of ``path``, in one rename where a file was there."""
    fs, target = hadoop(spark, path)
    old = None
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        old = hadoop(spark, f"{new}.old")[1]
        if not fs.rename(target, old):
            raise OSError(f"cannot move {path} out of the way")
    if fs.getUri().getScheme() == "file":
        place = files.strip_file_scheme(path)
        checksum = os.path.join(os.path.dirname(place), f".{os.path.basename(place)}.crc")
        if os.path.exists(checksum):  # of a file that Hadoop wrote here before
            os.remove(checksum)
        os.replace(files.strip_file_scheme(new), place)
    else:
        if old is None and fs.exists(target):
            fs.delete(target, False)  # other stores do not rename onto a file
        if not fs.rename(hadoop(spark, new)[1], target):
            raise OSError(f"cannot move {new} to {path}")
    if old is not None:
        fs.delete(old, True)


def check_hasher(prior: DataFrame, hasher) -> None:
    """A prior manifest's digests can only be compared with digests of the same kind."""
    if "hasher" not in prior.columns:
        return
    name = get_hasher(hasher).name
    other = prior.select("hasher").where((F.col("hasher") != name) & (F.col("prefix_hash").isNotNull() | F.col("full_hash").isNotNull())).first()
    if other is not None:
        raise ValueError(f"the prior manifest holds {other['hasher']} digests, this run uses {name}")


def write_duplicates(report: DataFrame, path: str) -> bool:
    """Write the duplicates report only when it has rows; returns whether it was written."""
    if report.isEmpty():
        return False
    write_csv_file(report.select(*REPORT_COLUMNS).orderBy("duplicate_path", "original_path"), path)
    return True


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """All-string read of a CSV manifest.  Order is that of the paths (as written), not of the input
    splits: ``position`` is 0 for all rows and ties are broken by path.  A missing path gives no rows, as
    the reference does."""
    try:
        raw = (
            spark.read.schema(CSV_SCHEMA)
            .options(**_CSV_OPTIONS).option("mode", "PERMISSIVE").option("multiLine", True)
            .option("nullValue", _NULL_SENTINEL)
            .csv(path)
        )
        raw.schema  # noqa: B018 - resolve now so a missing path raises here
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raw = _empty(spark, CSV_SCHEMA)
        else:
            raise
    return raw.withColumn("position", F.lit(0).cast("bigint"))


def _flag(text: DataFrame) -> DataFrame:
    size = F.col("file_size").try_cast("bigint")
    missing = (
        F.col("relative_path").isNull() | F.col("filename").isNull()
        | F.col("full_path").isNull() | F.col("file_size").isNull()
    )
    reason = F.when(missing, REASON_FIELD).when(size.isNull(), REASON_SIZE)
    return text.withColumn("reason", reason).withColumn("_size", size)


def parse_manifest(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type the text rows.  Returns (manifest, rejects); a row is rejected when a field is
    missing (short row) or the size is not an integer.  Extension = lower suffix of the path."""
    flagged = _flag(text)
    good = flagged.where(F.col("reason").isNull()).select(
        "full_path",
        "relative_path",
        "filename",
        lower_suffix(file_name("full_path")).alias("file_extension"),
        F.col("_size").alias("file_size"),
        F.lit(None).cast("string").alias("prefix_hash"),
        F.lit(None).cast("string").alias("full_hash"),
        F.col("position").cast("bigint").alias("position"),
        F.try_to_timestamp(F.col("processed_at")).alias("processed_at"),
    )
    bad = flagged.where(F.col("reason").isNotNull()).drop("_size")
    return good, bad


def manifest_counts(text: DataFrame) -> DataFrame:
    """S8 (+ rejects): ``total`` data rows as the reference counts them, ``valid``, ``rejected``;
    one aggregate pass."""
    flagged = _flag(text)
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


def read_manifest(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(manifest, rejects) from a written manifest."""
    if fmt == "parquet":
        content = Versions(spark, path).read()
        try:
            df = spark.read.parquet(path if content is None else f"{path.rstrip('/')}/{content['data']}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return parse_manifest(_empty(spark, CSV_SCHEMA).withColumn("position", F.lit(0).cast("bigint")))
            raise
        return df, df.where(F.lit(False))
    return parse_manifest(read_manifest_text(spark, path))


def processed_paths(manifest: DataFrame) -> DataFrame:
    """The set of paths a prior manifest holds."""
    return manifest.select("full_path").where(F.col("full_path").isNotNull()).distinct()


def manifest_count(spark: SparkSession, path: str) -> int:
    """Number of data rows of a prior manifest (0 when it does not exist)."""
    return read_manifest_text(spark, path).count()


def rebase(manifest: DataFrame, root: str) -> DataFrame:
    """Q13: point ``full_path`` at ``root``/``relative_path`` (a manifest written on one machine,
    used where the lake is mounted elsewhere).  Rows without a relative path keep their path."""
    r = root.rstrip("/") + "/"
    return manifest.withColumn(
        "full_path",
        F.when(F.col("relative_path").isNotNull(), F.concat(F.lit(r), F.col("relative_path"))).otherwise(
            F.col("full_path")
        ),
    )
