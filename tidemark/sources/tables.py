"""Manifest built from a table of content (re-aimed source).

Each row of the table plays the part of one file: its content column is the file's bytes.
All three content keys are computed in the scan projection (one read of the content column,
hashes inside whole-stage codegen); the content itself is dropped right there so no shuffle
ever carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PREFIX_BYTES, as_bytes, full_hash, get_hasher, prefix_hash, size_of
from ..functions.paths import file_name, lower_suffix

MANIFEST_COLUMNS = (
    "full_path",
    "relative_path",
    "filename",
    "file_extension",
    "file_size",
    "prefix_hash",
    "full_hash",
    "position",
)


def table_manifest(
    df: DataFrame,
    content_col: str,
    root: str,
    relative_path: Column,
    position: Column | str,
    keep: tuple[str, ...] = (),
    hasher=None,
    prefix_bytes: int = PREFIX_BYTES,
    with_hashes: bool = True,
) -> DataFrame:
    """One manifest row per table row.

    ``relative_path`` names the item below ``root``; ``position`` is the explicit input order
    (ties are broken by path).  ``keep`` carries extra columns (ids) through unchanged.
    """
    h = get_hasher(hasher)
    content = as_bytes(content_col, df.schema[content_col].dataType)
    rel = relative_path.alias("relative_path")
    pos = F.col(position) if isinstance(position, str) else position
    base = df.select(*keep, rel, content.alias("_content"), pos.cast("bigint").alias("position"))
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.col("relative_path"))
    cols = [
        *[F.col(k) for k in keep],
        full.alias("full_path"),
        F.col("relative_path"),
        file_name("relative_path").alias("filename"),
        lower_suffix(file_name("relative_path")).alias("file_extension"),
        size_of(F.col("_content")).alias("file_size"),
    ]
    if with_hashes:
        cols += [
            prefix_hash(F.col("_content"), prefix_bytes, h).alias("prefix_hash"),
            full_hash(F.col("_content"), h).alias("full_hash"),
        ]
    else:
        cols += [F.lit(None).cast("string").alias("prefix_hash"), F.lit(None).cast("string").alias("full_hash")]
    cols.append(F.col("position"))
    return base.select(*cols)
