"""Atomic publishing: data first, then one small version file that names it.

    root/data/<name>/...            Parquet (or other) files, never changed once written
    root/_versions/<number>.json    what the version consists of; written aside, renamed into place last

A version exists when its file does, so a run that is killed between any two steps leaves the version before it as
the current one, and a reader that has read a version file reads on from the same data while newer versions appear.
Data that no kept version names is deleted by the next commit.  There is one writer at a time (a batch
run, or one streaming query).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: versions whose data is kept (the current one and those before it, for readers that are under way)
KEEP_VERSIONS = 3


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path or URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Versions:
    """The versions below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def check(self) -> None:
        """A root that holds anything but versions is an error, not an empty one."""
        fs, p = hadoop(self.spark, self.root)
        if fs.exists(p) and any(s.getPath().getName() not in ("data", "_versions") for s in fs.listStatus(p)):
            raise ValueError(f"{self.root} holds something else than versions")

    def numbers(self) -> list[int]:
        fs, p = hadoop(self.spark, self._path("_versions"))
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())

    def read(self, number: int | None = None) -> dict | None:
        """The version's content (default: the current one), None where there is none."""
        if number is None:
            every = self.numbers()
            if not every:
                return None
            number = every[-1]
        fs, p = hadoop(self.spark, self._path(f"_versions/{number:020d}.json"))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_data(self, name: str = "data") -> str:
        """A name for new data, relative to the root."""
        return f"data/{name}-{uuid.uuid4().hex}"

    def absolute(self, name: str) -> str:
        return self._path(name)

    def publish(self, content: dict, replace: int | None = None) -> int:
        """Make ``content`` the current version and return its number.  ``replace``: a version that a replayed step
        writes again."""
        every = self.numbers()
        number = replace if replace is not None else (every[-1] + 1 if every else 1)
        fs, aside = hadoop(self.spark, self._path(f"_versions/.{number:020d}-{uuid.uuid4().hex}.tmp"))
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps({**content, "version": number}).encode("utf-8")))
        finally:
            out.close()
        final = hadoop(self.spark, self._path(f"_versions/{number:020d}.json"))[1]
        if fs.exists(final):
            if replace is None:
                raise FileExistsError(f"{self.root}: version {number} was written by someone else")
            # the version before it stays readable in between
            fs.delete(final, False)
        if not fs.rename(aside, final):
            raise OSError(f"cannot publish version {number} of {self.root}")
        return number

    def vacuum(self, data_of, keep: int = KEEP_VERSIONS) -> None:
        """Delete versions older than the last ``keep`` and data that none of those names; ``data_of(content)``: names of
        a version's data."""
        every = self.numbers()
        fs, folder = hadoop(self.spark, self._path("data"))
        if not every or not fs.exists(folder):
            return
        used = {name.split("/")[1] for n in every[-keep:] for name in data_of(self.read(n))}
        for n in every[:-keep]:
            fs.delete(hadoop(self.spark, self._path(f"_versions/{n:020d}.json"))[1], False)
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
