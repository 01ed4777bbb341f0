"""WARC archives: records, their layout in files, and a Merkle fixity audit between replicas.

``layout`` puts pages into archive files as WARC records and gives each record's file, offset and
length; ``read_warc`` reads such files.  The audit works on any table of records of a replica:
(file, offset, length, digest).

Tree.  Records are leaves, in the order of their offsets.  Each file is divided into ranges of
``RANGE_BYTES`` of offsets; a range's hash is that of its records' hashes in order, and ``FAN`` ranges
make one of the next level, up to a file's root.  Every node has a bounded number of children.

Audit.  The roots of two replicas are compared; only nodes whose parents differ are looked at on the next
level down, so equal files (and equal parts of files) cost nothing but their root.  At the bottom the
differing records are reported: changed, missing (in the second replica) or extra.

Defined results: NULL page fields are written as empty ones; equal rows are one record (``copies``
counts them); an empty table has no files and no findings; a replica without a file misses all its
records; two records of a replica at one offset are compared by their digests in order; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import staged

RANGE_BYTES = 64 << 10
FAN = 8
RECORDS_PER_FILE = 500


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC record (header, payload, two line ends) as bytes."""
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), payload, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = RECORDS_PER_FILE, replica_html: Column | None = None) -> DataFrame:
    """(file, offset, length, digest, id, url, copies) of each record.

    Files hold about ``per_file`` records each, dealt by a hash; inside, records are ordered by id, url
    and digest.  Only digests and lengths are shuffled, never the payloads.  With ``replica_html`` (the
    page as a second replica holds it; NULL where it lost the record) the column ``replica_digest`` is
    added, from the same pass."""
    body = record_bytes(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    r = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("length"), *(
        [F.when(replica_html.isNotNull(), F.sha2(record_bytes(F.col(id_col), F.col(url_col).cast("string"), replica_html), 256)).alias("replica_digest")] if replica_html is not None else []
    ))
    more = [F.first("replica_digest").alias("replica_digest")] if replica_html is not None else []
    r = staged(r.groupBy("id", "url", "digest", "length").agg(F.count(F.lit(1)).alias("copies"), *more), "records")
    files = max(1, -(-r.count() // per_file))
    r = r.withColumn("file", (F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") % files).cast("long"))
    order = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest")
    return r.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def warc_files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, content): the bytes of each archive file (about ``per_file`` records)."""
    place = layout(pages, id_col, url_col, html_col, per_file).select("file", "offset", "digest", F.col("id").alias("_id"), F.col("url").alias("_url"))
    rows = pages.select(F.col(id_col).alias("_i"), F.col(url_col).cast("string").alias("_u"), F.col(html_col).cast("string").alias("_h")).distinct()
    body = rows.withColumn("body", record_bytes(F.col("_i"), F.col("_u"), F.col("_h"))).withColumn("d", F.sha2("body", 256))
    both = place.join(body, (place["digest"] == body["d"]) & place["_id"].eqNullSafe(body["_i"]) & place["_url"].eqNullSafe(body["_u"]))
    parts = F.sort_array(F.collect_list(F.struct("offset", "body")))
    # joined as hex because there is no aggregate that joins bytes
    return both.groupBy("file").agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["body"])), "")).alias("content"))


def _records(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file", "offset", "length", "uri", "payload")}
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = 0
            while (start := content.find(b"WARC/", at)) >= 0 and (end := content.find(b"\r\n\r\n", start)) >= 0:
                fields = dict(line.split(b":", 1) for line in content[start:end].split(b"\r\n")[1:] if b":" in line)
                fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
                size = int(fields.get(b"content-length", b"0"))
                at = min(end + 4 + size + 4, len(content))
                for k, v in (("file", path), ("offset", start), ("length", at - start), ("uri", fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")), ("payload", content[end + 4 : end + 4 + size])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["file"], pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["uri"], pa.string()), pa.array(out["payload"], pa.binary())],
            names=list(out),
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, uri, payload) of uncompressed WARC files; a task holds one file at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records, "file string, offset long, length long, uri string, payload binary")


def merkle_levels(records: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Trees of all files of a replica, level by level: (file, node, parent, hash), leaves first.

    The leaves (records) also have offset, length and digest.  The number of levels follows from the longest
    file; every file has one root, node 0 of the last level."""
    r = records.where("digest is not null").select("file", "offset", "length", "digest")
    top = r.agg(F.max("offset")).first()[0]
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    levels = [r.select("file", F.col("offset").alias("node"), F.floor(F.col("offset") / range_bytes).cast("long").alias("parent"), leaf.alias("hash"), "offset", "length", "digest")]
    width = (top or 0) // range_bytes
    while True:
        below = levels[-1]
        # a node's children: the records of one range, or ``fan`` nodes
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        joined = F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256)
        nodes = below.groupBy("file", "parent").agg(joined.alias("hash")).select("file", F.col("parent").alias("node"), F.floor(F.col("parent") / fan).cast("long").alias("parent"), "hash")
        levels.append(staged(nodes, "merkle"))
        if width == 0:
            return levels
        width //= fan


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """(file, offset, length, kind, first_digest, second_digest) of the records in which two replicas differ.

    ``first``, ``second``: (file, offset, length, digest); a NULL digest is a record that is not there."""
    a, b = merkle_levels(first, range_bytes, fan), merkle_levels(second, range_bytes, fan)
    while len(a) < len(b):  # the replica with the shorter files gets roots above its roots
        a.append(_lifted(a[-1], fan))
    while len(b) < len(a):
        b.append(_lifted(b[-1], fan))
    suspects = None
    for x, y in zip(reversed(a[1:]), reversed(b[1:])):
        if suspects is not None:
            x, y = (t.join(suspects, (t["file"] == suspects["_file"]) & (t["parent"] == suspects["_node"]), "left_semi") for t in (x, y))
        x, y = x.select("file", "node", F.col("hash").alias("_x")), y.select("file", "node", F.col("hash").alias("_y"))
        differ = x.join(y, ["file", "node"], "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y")))
        suspects = staged(differ.select(F.col("file").alias("_file"), F.col("node").alias("_node")), "suspects")
    sides = []
    for t, name in ((a[0], "first"), (b[0], "second")):
        t = t.join(suspects, (t["file"] == suspects["_file"]) & (t["parent"] == suspects["_node"]), "left_semi")
        # several records at one offset are numbered by their digests
        same = Window.partitionBy("file", "offset").orderBy("digest", "length")
        sides.append(t.select("file", "offset", F.row_number().over(same).alias("_n"), F.col("length").alias(f"_{name}"), F.col("digest").alias(f"{name}_digest")))
    both = sides[0].join(sides[1], ["file", "offset", "_n"], "full_outer")
    both = both.where(~(F.col("first_digest").eqNullSafe(F.col("second_digest")) & F.col("_first").eqNullSafe(F.col("_second"))))
    kind = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", F.coalesce("_first", "_second").alias("length"), kind.alias("kind"), "first_digest", "second_digest")


def _lifted(level: DataFrame, fan: int) -> DataFrame:
    return level.select("file", F.col("parent").alias("node"), F.floor(F.col("parent") / fan).cast("long").alias("parent"), F.sha2(F.col("hash"), 256).alias("hash"))
