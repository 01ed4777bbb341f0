"""Content keys as column expressions (P2-P4) and the pluggable hasher.

Key 1 is the size in bytes, key 2 a digest of the first ``PREFIX_BYTES`` bytes, key 3 a digest
of every byte.  For content held in a table the three keys are plain JVM expressions
(``octet_length``, ``substring`` on binary, ``sha2``) evaluated inside whole-stage codegen while
the column is scanned, so only 64-character digests travel through later shuffles.  For files,
the same digests are computed by the byte readers in :mod:`tidemark.sources.readers`, which use
``Hasher.new`` so both paths agree bit for bit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

# Fixed values that must equal the reference's behaviour.
PREFIX_BYTES = 1024  # key 2 hashes this many leading bytes (fewer when the content is shorter)
READ_CHUNK_BYTES = 1024 * 1024  # chunk size of the full-content reader
LARGE_FILE_BYTES = 100 * 1024 * 1024  # default threshold of the "large" route


@dataclass(frozen=True)
class Hasher:
    """A digest available both as a Spark column function and as a streaming Python digest."""

    name: str
    column: Callable[[Column], Column]  # binary column -> lower-case hex string column
    new: Callable[[], object]  # object with update(bytes) and hexdigest()


def _xxh64_new():
    import xxhash  # optional; baked into the image

    class _X:
        def __init__(self):
            self._h = xxhash.xxh64(seed=42)  # Spark's xxhash64 seed

        def update(self, b):
            self._h.update(b)

        def hexdigest(self):
            return self._h.hexdigest()

    return _X()


SHA256 = Hasher("sha256", lambda c: F.sha2(c, 256), hashlib.sha256)
MD5 = Hasher("md5", F.md5, hashlib.md5)
XXHASH64 = Hasher("xxhash64", lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")), _xxh64_new)

HASHERS = {h.name: h for h in (SHA256, MD5, XXHASH64)}


def get_hasher(hasher: Hasher | str | None) -> Hasher:
    if hasher is None:
        return SHA256
    if isinstance(hasher, Hasher):
        return hasher
    try:
        return HASHERS[hasher]
    except KeyError:
        raise ValueError(f"Unknown hasher: {hasher!r}; choose one of {sorted(HASHERS)}") from None


def as_bytes(col: Column | str, dtype: DataType | None = None) -> Column:
    """UTF-8 bytes of a string column; binary columns pass through."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, BinaryType):
        return c
    if dtype is None or isinstance(dtype, StringType):
        return F.encode(c, "UTF-8")
    return c


def size_of(content: Column) -> Column:
    """Key 1: length in bytes (``content`` must already be binary)."""
    return F.octet_length(content).cast("bigint")


def prefix_hash(content: Column, n: int = PREFIX_BYTES, hasher: Hasher | str | None = None) -> Column:
    """Key 2: digest of the first ``n`` bytes."""
    return get_hasher(hasher).column(F.substring(content, 1, n))


def full_hash(content: Column, hasher: Hasher | str | None = None) -> Column:
    """Key 3: digest of every byte."""
    return get_hasher(hasher).column(content)
