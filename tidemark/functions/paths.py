"""Path columns (P1): relative path, file name and extension, all JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default extensions of the scan (S2), as in the reference.
DEFAULT_EXTENSIONS = (
    ".pdf", ".cbr", ".cbz", ".epub", ".mobi", ".azw", ".azw3", ".fb2",
    ".lit", ".prc", ".txt", ".rtf", ".djvu", ".chm", ".html", ".htm",
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_name(path: Column | str) -> Column:
    """Last element of a ``/``-separated path."""
    return F.element_at(F.split(_c(path), "/"), -1)


def suffix(name: Column | str) -> Column:
    """Extension of a file name with its dot, like ``pathlib.PurePath.suffix``: ``''`` when there
    is none, and a leading dot alone (``.bashrc``) is not an extension."""
    return F.regexp_extract(_c(name), r"^.+(\.[^./]+)$", 1)


def lower_suffix(name: Column | str) -> Column:
    return F.lower(suffix(name))


def relative_to(path: Column | str, root: str) -> Column:
    """Path below ``root`` (given without a trailing slash); NULL outside ``root``."""
    r = root.rstrip("/")
    p = _c(path)
    return F.when(p.startswith(r + "/"), F.substring(p, len(r) + 2, 1 << 30))


def path_columns(df: DataFrame, root: str | None = None, path_col: str = "full_path") -> DataFrame:
    """Add ``relative_path`` (when ``root`` is given), ``filename`` and ``file_extension``."""
    out = df
    if root is not None:
        out = out.withColumn("relative_path", relative_to(path_col, root))
    return out.withColumn("filename", file_name(path_col)).withColumn(
        "file_extension", lower_suffix(file_name(path_col))
    )


def normalize_extensions(exts) -> list[str]:
    """Lower-case, add the leading dot, drop repeats."""
    out: list[str] = []
    for e in exts:
        e = e.lower()
        if not e.startswith("."):
            e = "." + e
        if e not in out:
            out.append(e)
    return out


def extension_match(name: Column | str, exts=DEFAULT_EXTENSIONS, case_sensitive: bool = False) -> Column:
    """True when the name ends with one of ``exts``.

    ``case_sensitive=False`` (default) is the documented intent: ``BOOK.PDF`` matches ``pdf``.
    ``case_sensitive=True`` mirrors a case-sensitive glob on Linux, where only the lower-cased
    requested extension is matched literally.
    """
    n = _c(name)
    subject = n if case_sensitive else F.lower(n)
    cond = F.lit(False)
    for e in normalize_extensions(exts):
        cond = cond | subject.endswith(e)
    return cond


def matched_extension(name: Column | str, exts=DEFAULT_EXTENSIONS, case_sensitive: bool = False) -> Column:
    """The longest requested extension the name ends with (one row per path even when
    extensions overlap, e.g. ``gz`` and ``tar.gz``)."""
    n = _c(name)
    subject = n if case_sensitive else F.lower(n)
    expr = F.lit(None).cast("string")
    for e in sorted(normalize_extensions(exts), key=len):
        expr = F.when(subject.endswith(e), F.lit(e)).otherwise(expr)
    return expr
