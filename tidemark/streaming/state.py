"""Keyed state of the ingest: rows by file size, in buckets, with versions.

Everything that the ingest compares (sizes, digests, contents) is equal only among files of one size, so a batch needs the
rows of its own sizes only.  Rows lie in buckets by a hash of the size; a batch reads the buckets of its sizes and
appends its changed rows to them.  A row's latest state counts (``seq``, the version that wrote it).  A bucket of many
parts is rewritten with its latest rows in the same commit, and when buckets hold more than
``rows_per_bucket`` on average their number doubles, so what a batch reads depends on its sizes and not on history.

Each commit is one version (:mod:`tidemark.sources.versions`), named by its batch: a batch that is replayed after a
failure starts from the version before it and replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions

FIRST_BUCKETS = 16
ROWS_PER_BUCKET = 50_000
#: parts of a bucket after which it is rewritten
MAX_PARTS = 8

# Fixed layout, so an empty state still reads.  side: lake or library; outcome: of a lake row (see streaming.ingest), or
# whether a library row is present.
STATE_DDL = (
    "side string, full_path string, relative_path string, filename string, file_extension string, file_size bigint, "
    "prefix_hash string, full_hash string, position bigint, mtime_ms bigint, error_message string, stage string, stage_no int, "
    "processing_status string, hasher string, outcome string, batch_id bigint"
)
COLUMNS = [c.strip().split(" ")[0] for c in STATE_DDL.split(",")]
_KEY = ["side", "full_path", "file_size"]


@dataclass
class Snapshot:
    """One version of the state: what its buckets consist of."""

    n_buckets: int = FIRST_BUCKETS
    parts: dict[int, list[str]] = field(default_factory=dict)  # bucket -> folders
    rows: dict[int, int] = field(default_factory=dict)  # bucket -> rows in them
    batch: int = -1
    version: int = 0
    info: dict = field(default_factory=dict)

    @classmethod
    def of(cls, content: dict | None) -> Snapshot:
        if content is None:
            return cls()
        return cls(
            content["n_buckets"], {int(b): p for b, p in content["parts"].items()}, {int(b): n for b, n in content["rows"].items()},
            content["batch"], content["version"], content["info"],
        )

    def data(self) -> list[str]:
        return [p for parts in self.parts.values() for p in parts]


def bucket_of(n_buckets: int, size_col: str = "file_size"):
    return F.pmod(F.xxhash64(size_col), F.lit(n_buckets)).cast("int")


class KeyedState:
    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = ROWS_PER_BUCKET, max_parts: int = MAX_PARTS):
        self.spark, self.versions = spark, Versions(spark, root)
        self.rows_per_bucket, self.max_parts = rows_per_bucket, max_parts

    # --- reading ---------------------------------------------------------------------------

    def current(self) -> Snapshot:
        """The last version; no rows where nothing was written yet (a folder of something else is an error)."""
        self.versions.check()
        return Snapshot.of(self.versions.read())

    def before(self, batch: int) -> Snapshot:
        """The last version of a batch before ``batch``."""
        self.versions.check()
        for n in reversed(self.versions.numbers()):
            s = Snapshot.of(self.versions.read(n))
            if s.batch < batch:
                return s
        return Snapshot()

    def buckets(self, snapshot: Snapshot, sizes: DataFrame) -> list[int]:
        """The buckets of some sizes (numbers of buckets only)."""
        found = sizes.select(bucket_of(snapshot.n_buckets).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found if r["b"] is not None)

    def stored(self, snapshot: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        """All stored rows of some buckets, superseded ones too, with ``seq``."""
        parts = [p for b, ps in snapshot.parts.items() if buckets is None or b in set(buckets) for p in ps]
        schema = f"{STATE_DDL}, seq bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.versions.absolute(p) for p in parts])

    def rows(self, snapshot: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The latest state of each row."""
        return latest(self.stored(snapshot or self.current(), buckets)).select(*COLUMNS)

    # --- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, n_buckets: int, name: str) -> tuple[dict[int, str], dict[int, int]]:
        """Rows written by bucket: folder and number of rows of each."""
        data = self.versions.new_data(name)
        out = rows.withColumn("bucket", bucket_of(n_buckets))
        # a hot size may be most of a bucket: AQE splits what it rebalances
        out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.versions.absolute(data))
        counts = self.spark.read.parquet(self.versions.absolute(data)).groupBy("bucket").count().collect() if _has_rows(self.spark, self.versions.absolute(data)) else []
        return {r["bucket"]: f"{data}/bucket={r['bucket']}" for r in counts}, {r["bucket"]: r["count"] for r in counts}

    def commit(self, base: Snapshot, changed: DataFrame, batch: int, info: dict | None = None, observed=None) -> Snapshot:
        """``base`` with the rows of ``changed`` (``STATE_DDL``) in place of those with the same side, path and size.

        ``observed()`` gives numbers that are known once the rows are written."""
        seq = batch + 1
        folders, counts = self._write(changed.withColumn("seq", F.lit(seq).cast("bigint")), base.n_buckets, f"batch-{batch}")
        info = {**(info or {}), **(observed() if observed else {})}
        parts = {b: list(p) for b, p in base.parts.items()}
        rows = dict(base.rows)
        for b, folder in folders.items():
            parts.setdefault(b, []).append(folder)
            rows[b] = rows.get(b, 0) + counts[b]
        new = Snapshot(base.n_buckets, parts, rows, batch)
        written = sum(counts.values())
        if sum(rows.values()) > new.n_buckets * self.rows_per_bucket:
            new = self._rewritten(new, list(parts), batch, 2 * new.n_buckets)
        else:
            many = [b for b, p in parts.items() if len(p) > self.max_parts]
            if many:
                new = self._rewritten(new, many, batch, new.n_buckets)
        new.info = {**info, "rows_written": written}
        existing = {Snapshot.of(self.versions.read(n)).batch: n for n in self.versions.numbers()}
        later = [n for b, n in existing.items() if b > batch]
        if later:
            raise ValueError(f"batch {batch} comes after a later one")
        new.version = self.versions.publish(
            {"n_buckets": new.n_buckets, "parts": new.parts, "rows": new.rows, "batch": batch, "info": new.info}, existing.get(batch)
        )
        self.versions.vacuum(lambda c: Snapshot.of(c).data())
        return new

    def _rewritten(self, s: Snapshot, buckets: list[int], batch: int, n_buckets: int) -> Snapshot:
        """The buckets with their latest rows only; ``n_buckets`` may be twice the number (then all are rewritten)."""
        rows = latest(self.stored(s, buckets))
        folders, counts = self._write(rows, n_buckets, f"merged-{batch}")
        kept = {} if n_buckets != s.n_buckets else {b: p for b, p in s.parts.items() if b not in set(buckets)}
        return Snapshot(
            n_buckets, {**kept, **{b: [f] for b, f in folders.items()}}, {**{b: s.rows[b] for b in kept}, **counts}, batch,
        )


def _has_rows(spark: SparkSession, path: str) -> bool:
    from ..sources.versions import hadoop

    fs, p = hadoop(spark, path)
    return any(s.isDirectory() and s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p))


def latest(stored: DataFrame) -> DataFrame:
    """The row with the greatest ``seq`` of each side, path and size."""
    rest = [c for c in stored.columns if c not in (*_KEY, "seq")]
    top = stored.groupBy(*_KEY).agg(F.max(F.struct("seq", *rest)).alias("_r"))
    return top.select(*[F.col(c) if c in _KEY else F.col(f"_r.{c}").alias(c) for c in stored.columns])
