"""Bench: headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run to completion with the ``noop`` sink (every row computed, nothing collected
to the driver).  An untimed warm-up pass of the same queries on the smallest data set (sf0.001)
loads and JIT-compiles the JVM code paths, so the timings are steady-state throughput.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "analyze_documents",  # E1: cascade + content dedup, the flagship
    "analyze_documents_tiered",  # E1 with the reference's tiered dedup
    "stage_summary",  # A5 over J6
    "missing_drop",  # J6 with the library-API NULL policy
    "duplicates_report",  # W2
    "lookup_size",  # J7
    "copy_plan_rename",  # C5 + W3 + J11 + J12
    "resume_merge",  # R1
    "analyze_pages",  # E1 over pages.html
    "content_hashes",  # P2-P4 over every document
)


def _replicated_analyze(spark, sf_dir: str, k: int) -> float:
    """E1 over ``k`` replicas of the documents (derived by Spark: ids shifted, a replica marker
    appended to the text so contents stay distinct): how throughput grows with the data."""
    from pyspark.sql import functions as F

    from tidemark.plans.analyze import analyze
    from tidemark.plans.catalog import LAKE_ROOT, LIBRARY_ROOT, _doc_manifest

    # one scan; each row expands into its k replicas (a generator, no join)
    docs = (
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .select(
            (F.col("doc_id") + F.col("r") * 10_000_000).alias("doc_id"),
            F.when(F.col("r") == 0, F.col("text"))
            .otherwise(F.concat(F.col("text"), F.lit(" ~r"), F.col("r").cast("string"))).alias("text"),
            "source",
        )
    )
    t0 = time.perf_counter()
    lake = _doc_manifest(docs.where(F.col("doc_id") % 2 == 1), LAKE_ROOT)
    lib = _doc_manifest(docs.where(F.col("doc_id") % 2 == 0), LIBRARY_ROOT)
    analyze(lake, lib).missing.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def _write_tree(spark, sf_dir: str, root: str) -> None:
    """Untimed setup of the file benchmark: every document becomes a file, odd doc_id under
    ``root/lake``, even under ``root/library`` (written by Spark tasks, one file per row)."""
    import pandas as pd
    from pyspark.sql import functions as F

    def write(batches):
        for pdf in batches:
            for doc_id, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                side = "lake" if doc_id % 2 else "library"
                d = os.path.join(root, side, str(source), str(doc_id))
                os.makedirs(d, exist_ok=True)
                with open(os.path.join(d, f"doc_{doc_id % 100}.txt"), "wb") as f:
                    f.write((text or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    docs.repartition(8).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def _files_bench(spark, sf_dir: str) -> float:
    import tempfile

    from tidemark.plans.analyze import run_analysis

    scratch = tempfile.mkdtemp(prefix="tidemark-bench-")
    _write_tree(spark, sf_dir, scratch)
    t0 = time.perf_counter()
    run_analysis(spark, f"{scratch}/lake", f"{scratch}/library", f"{scratch}/out/missing")
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tidemark-bench")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    if os.environ.get("BENCH_FILES", "1") == "1":
        # E1 over file trees (the reference's own workload): listing, ranged/chunked reads, cascade,
        # dedup and the manifest write; the trees are written from the same documents, untimed
        if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
            _files_bench(spark, warm)
        times["analyze_files"] = _files_bench(spark, sf_dir)
    reps = int(os.environ.get("BENCH_REPLICAS", "16"))
    if reps > 1:
        if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
            _replicated_analyze(spark, warm, reps)
        times[f"analyze_documents_x{reps}"] = _replicated_analyze(spark, sf_dir, reps)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
