"""Registered queries over the driver's tables.

Sides: where a query compares two sides, the lake is the odd ``doc_id`` rows of ``documents`` and the
library the even ones (every row takes part; the parity only assigns a side); other queries take all
documents as lake items.  Each row is one item: its bytes are the UTF-8
text, its path ``<root>/<source>/<doc_id>/doc_<doc_id % 100>.txt`` so that file names collide
and the copy plan meets conflicts.  Every query runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension_match, lower_suffix
from ..operators import compare as cmp
from ..operators import copyplan as cp
from ..operators import dedup as dd
from ..operators import metrics as mt
from ..operators.routing import route_files
from ..sources.manifest_io import manifest_counts, parse_manifest
from ..sources.manifest_io import processed_paths as processed_paths_of
from ..sources.tables import table_manifest
from ..streaming.delta import advance
from ..streaming.incremental import resume
from ..session import materialize
from .analyze import analyze

# Fixed parameters of the registered queries.
LAKE_ROOT = "/lake"
LIBRARY_ROOT = "/library"
TARGET_ROOT = "/import"
PAGES_LAKE_ROOT = "/lake/pages"
PAGES_LIBRARY_ROOT = "/library/pages"
ROUTE_THRESHOLD = 8192  # bytes; the default 100 MiB would route every test row the same way
ALTERED_ID_OFFSET = 1_000_000_000  # ids of lake rows altered in their last byte (stage-3 test)
EXT_CYCLE = (".pdf", ".EPUB", ".txt", ".Mobi", ".xyz")  # extension by doc_id % 5 (S2 test)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_relative_path() -> Column:
    return F.concat(
        F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
        F.lit("/doc_"), (F.col("doc_id") % 100).cast("string"), F.lit(".txt"),
    )


def _doc_manifest(docs: DataFrame, root: str) -> DataFrame:
    return table_manifest(docs, "text", root, doc_relative_path(), "doc_id", keep=("doc_id",))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text", "source")


def lake_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    lake = _doc_manifest(docs.where(F.col("doc_id") % 2 == 1), LAKE_ROOT)
    lib = _doc_manifest(docs.where(F.col("doc_id") % 2 == 0), LIBRARY_ROOT)
    return lake, lib


def altered_rows(docs: DataFrame) -> DataFrame:
    """Library texts over 1 KB whose last character is one byte and not ``#``, with that
    character replaced by ``#``: same size, same first 1 KB, different content."""
    last = F.expr("right(text, 1)")
    return docs.where(
        (F.col("doc_id") % 2 == 0)
        & (F.octet_length(F.encode("text", "UTF-8")) > 1024)
        & (F.octet_length(F.encode(last, "UTF-8")) == 1)
        & (last != "#")
    ).select(
        (F.col("doc_id") + ALTERED_ID_OFFSET).alias("doc_id"),
        F.expr("concat(left(text, char_length(text) - 1), '#')").alias("text"),
        "source",
    )


def lake_plus_altered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    lake_docs = docs.where(F.col("doc_id") % 2 == 1).unionByName(altered_rows(docs))
    lake = _doc_manifest(lake_docs, LAKE_ROOT)
    lib = _doc_manifest(docs.where(F.col("doc_id") % 2 == 0), LIBRARY_ROOT)
    return lake, lib


def _null_some_hashes(m: DataFrame) -> DataFrame:
    """Hash failures for the NULL-policy test: no prefix hash when doc_id % 7 = 0, no full hash
    when doc_id % 11 = 0 (both sides)."""
    return m.withColumn(
        "prefix_hash", F.when(F.col("doc_id") % 7 != 0, F.col("prefix_hash"))
    ).withColumn("full_hash", F.when(F.col("doc_id") % 11 != 0, F.col("full_hash")))


def every_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lake items: for queries that need no second side."""
    return _doc_manifest(documents(spark, sf_dir), LAKE_ROOT)


def processed_paths(spark: SparkSession, sf_dir: str, lake: DataFrame | None = None) -> DataFrame:
    """Stand-in for a prior manifest: lake paths of the documents that ``labels`` covers."""
    labels = _read(spark, sf_dir, "labels").select("doc_id")
    if lake is None:
        lake, _ = lake_library(spark, sf_dir)
    return lake.join(labels, "doc_id", "left_semi")


# --- P1-P4 ------------------------------------------------------------------------------


def q_manifest_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lake = _doc_manifest(docs.where(F.col("doc_id") % 2 == 1), LAKE_ROOT).withColumn("side", F.lit("lake"))
    lib = _doc_manifest(docs.where(F.col("doc_id") % 2 == 0), LIBRARY_ROOT).withColumn("side", F.lit("library"))
    return lake.unionByName(lib).select(
        "doc_id", "side", "full_path", "relative_path", "filename", "file_extension", "file_size"
    )


def q_content_hashes(spark, sf_dir):
    m = _doc_manifest(documents(spark, sf_dir), LAKE_ROOT)
    return m.select("doc_id", "file_size", "prefix_hash", "full_hash")


# --- S2, S3 -----------------------------------------------------------------------------


def _ext_rows(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT_CYCLE]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", name.alias("filename"), F.concat(F.lit(LAKE_ROOT + "/"), name).alias("full_path"))


def _excluded(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return _ext_rows(spark, sf_dir).join(labels, "doc_id", "left_semi").select("full_path")


def q_extension_filter(spark, sf_dir):
    rows = _ext_rows(spark, sf_dir)
    kept = rows.where(extension_match("filename")).join(_excluded(spark, sf_dir), "full_path", "left_anti")
    return kept.select("doc_id", "filename", lower_suffix("filename").alias("file_extension"))


def q_extension_filter_exact(spark, sf_dir):
    rows = _ext_rows(spark, sf_dir)
    kept = rows.where(extension_match("filename", case_sensitive=True)).join(
        _excluded(spark, sf_dir), "full_path", "left_anti"
    )
    return kept.select("doc_id", "filename", lower_suffix("filename").alias("file_extension"))


# --- P6, A6 -----------------------------------------------------------------------------


def q_route_counts(spark, sf_dir):
    lake = every_item(spark, sf_dir)
    routed = route_files(lake, processed_paths(spark, sf_dir, lake), ROUTE_THRESHOLD)
    return mt.route_summary(routed)


# --- A1-A4 ------------------------------------------------------------------------------


def q_unique_sizes(spark, sf_dir):
    return mt.unique_sizes(every_item(spark, sf_dir))


def q_size_groups(spark, sf_dir):
    return mt.size_groups(every_item(spark, sf_dir))


def q_prefix_groups(spark, sf_dir):
    return mt.prefix_groups(every_item(spark, sf_dir))


def q_full_groups(spark, sf_dir):
    return mt.full_groups(every_item(spark, sf_dir), carry=("doc_id",))


# --- J1-J5 ------------------------------------------------------------------------------


def _chain(spark, sf_dir, altered=False):
    """Lake, library and the library's key triples read once (pinned) for a chain of stages."""
    lake, lib = (lake_plus_altered if altered else lake_library)(spark, sf_dir)
    return lake, lib, cmp.library_keys(lib)


def q_stage1_unique(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir)
    return cmp.stage_size(lake, lib, keys)[0].select("doc_id", "file_size")


def q_stage1_candidates(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir)
    return cmp.stage_size(lake, lib, keys)[1].select("doc_id", "file_size")


def q_stage2_library_pruned(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir)
    cand = cmp.stage_size(lake, lib, keys)[1]
    return cmp.prune_library_by_size(lib, cand).select("doc_id", "file_size")


def q_stage2_unique(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir)
    cand = cmp.stage_size(lake, lib, keys)[1]
    return cmp.stage_prefix(cand, lib, keys=keys)[0].select("doc_id", "file_size", "prefix_hash")


def q_stage2_candidates(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir)
    cand = cmp.stage_size(lake, lib, keys)[1]
    return cmp.stage_prefix(cand, lib, keys=keys)[1].select("doc_id", "file_size", "prefix_hash")


def _stage3_candidates(spark, sf_dir):
    lake, lib, keys = _chain(spark, sf_dir, altered=True)
    cand = cmp.stage_prefix(cmp.stage_size(lake, lib, keys)[1], lib, keys=keys)[1]
    return cand, lib, keys


def q_stage3_library_pruned(spark, sf_dir):
    cand, lib, _ = _stage3_candidates(spark, sf_dir)
    return cmp.prune_library_by_prefix(lib, cand).select("doc_id", "file_size", "prefix_hash")


def q_stage3_unique(spark, sf_dir):
    cand, lib, keys = _stage3_candidates(spark, sf_dir)
    return cmp.stage_full(cand, lib, keys=keys)[0].select("doc_id", "full_hash")


def q_stage3_duplicates(spark, sf_dir):
    cand, lib, keys = _stage3_candidates(spark, sf_dir)
    return cmp.stage_full(cand, lib, keys=keys)[1].select("doc_id", "full_hash")


# --- J6, P7, P8 -------------------------------------------------------------------------


def _nulled(spark, sf_dir):
    lake, lib = lake_plus_altered(spark, sf_dir)
    return _null_some_hashes(lake), _null_some_hashes(lib)


def q_missing_keep(spark, sf_dir):
    lake, lib = _nulled(spark, sf_dir)
    return cmp.missing_from(lake, lib, "keep").select("doc_id", "stage", "processing_status")


def q_missing_drop(spark, sf_dir):
    lake, lib = _nulled(spark, sf_dir)
    return cmp.missing_from(lake, lib, "drop").select("doc_id", "stage", "processing_status")


def q_cascade_flags(spark, sf_dir):
    lake, lib = _nulled(spark, sf_dir)
    return cmp.classify(lake, lib, "drop").select("doc_id", "stage", "stage_no", "processing_status")


# --- J7-J9, J13 -------------------------------------------------------------------------


def q_lookup_size(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return cmp.lookup_by_size(lake, lib, carry=("doc_id",)).select("doc_id", "library_matches", "library_doc_id")


def q_lookup_prefix(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return cmp.lookup_by_prefix(lake, lib, carry=("doc_id",)).select("doc_id", "library_matches", "library_doc_id")


def q_lookup_full(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return cmp.lookup_by_full_hash(lake, lib, carry=("doc_id",)).select("doc_id", "library_doc_id")


def q_lookup_size_members(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return cmp.members_by_size(lake, lib).select("doc_id", "file_size")


def q_lookup_prefix_members(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return cmp.members_by_prefix(lake, lib).select("doc_id", "file_size", "prefix_hash")


def q_content_hashes_md5(spark, sf_dir):
    """The same manifest with another digest."""
    rows = table_manifest(documents(spark, sf_dir), "text", LAKE_ROOT, doc_relative_path(), "doc_id", keep=("doc_id",), hasher="md5")
    return rows.select("doc_id", "prefix_hash", "full_hash")


def q_processed_set(spark, sf_dir):
    """The distinct paths of a manifest."""
    return processed_paths_of(_manifest_text(spark, sf_dir))


def q_matched_in_library(spark, sf_dir):
    lake, lib = lake_plus_altered(spark, sf_dir)
    flagged = cmp.classify(lake, lib)
    return cmp.matched_in_library(flagged, lib, carry=("doc_id",)).select("doc_id", "library_doc_id")


# --- A5, A7, A10 ------------------------------------------------------------------------


def q_stage_summary(spark, sf_dir):
    lake, lib = lake_plus_altered(spark, sf_dir)
    return mt.stage_summary(cmp.classify(lake, lib))


def q_side_summary(spark, sf_dir):
    lake, lib = lake_library(spark, sf_dir)
    return mt.side_summary(lake, lib)


def _missing_plain(spark, sf_dir):
    """Missing rows, pinned: dedup reads them twice (keepers, then the report's join back)."""
    lake, lib = lake_library(spark, sf_dir)
    return materialize(cmp.missing_from(lake, lib))


def q_dedup_summary(spark, sf_dir):
    return dd.dedup_tiered(_missing_plain(spark, sf_dir)).summary


def q_dedup_content_summary(spark, sf_dir):
    return dd.dedup_content(_missing_plain(spark, sf_dir)).summary


# --- W1, W2, W4 -------------------------------------------------------------------------


def q_dedup_tiered(spark, sf_dir):
    return dd.dedup_tiered(_missing_plain(spark, sf_dir)).kept.select("doc_id", "stage", "method")


def q_duplicates_report(spark, sf_dir):
    return dd.dedup_tiered(_missing_plain(spark, sf_dir)).duplicates


def q_dedup_content(spark, sf_dir):
    return dd.dedup_content(_missing_plain(spark, sf_dir)).kept.select("doc_id", "stage")


def q_duplicates_report_content(spark, sf_dir):
    return dd.dedup_content(_missing_plain(spark, sf_dir)).duplicates


# --- J10, R1 ----------------------------------------------------------------------------


def q_resume_anti(spark, sf_dir):
    lake = every_item(spark, sf_dir)
    return resume(lake, processed_paths(spark, sf_dir, lake)).select("doc_id")


def q_resume_merge(spark, sf_dir):
    """Prior run over the labelled lake rows, then the new run over the rest, merged."""
    lake, lib = lake_library(spark, sf_dir)
    prior_lake = processed_paths(spark, sf_dir)
    prior = analyze(prior_lake, lib, dedup="content").missing
    merged = analyze(lake, lib, prior=prior, dedup="content")
    return merged.missing.select("doc_id", "stage")


def two_waves(spark, waves, libraries):
    """R2 over tables: the lake's rows with their outcome after each wave came and the library became the next one."""
    lake = library = None
    for new, library_now in zip(waves, libraries):
        lake, library, _ = advance(lake, library, new, library_now)
    return lake


def _waves(spark, sf_dir):
    """Odd documents arrive in two waves; between them a tenth of the library's documents go and others come."""
    lake, lib = lake_library(spark, sf_dir)
    d = F.col("doc_id")
    return [lake.where(d % 4 == 1), lake.where(d % 4 == 3)], [lib.where(d % 6 != 0), lib.where(d % 10 != 0)]


def q_ingest_two_waves(spark, sf_dir):
    state = two_waves(spark, *_waves(spark, sf_dir))
    recorded = state.where(F.col("outcome") == "missing").groupBy("file_size", "full_hash").agg(F.count(F.lit(1)).alias("n_recorded"))
    same = state.where(F.col("outcome") != "in_library").groupBy("file_size", "full_hash").agg(F.count(F.lit(1)).alias("n_items"))
    return recorded.join(same, ["file_size", "full_hash"]).select("file_size", "full_hash", "n_recorded", "n_items")


def q_ingest_changes(spark, sf_dir):
    """The second step's signed changes: contents whose last library copy went, and contents that came to the library."""
    (first, second), (before, after) = _waves(spark, sf_dir)
    lake, library, _ = advance(None, None, first.unionByName(second), before)
    events = advance(lake, library, first.limit(0), after)[2]
    return events.select("sign", "file_size", "full_hash")


# --- S6, S8 -----------------------------------------------------------------------------


def _manifest_text(spark, sf_dir):
    """Manifest rows as text, as a CSV read with an all-string schema gives them: a size that is
    not a number when doc_id % 13 = 0, a short row (no file name and beyond) when % 17 = 0."""
    lake = every_item(spark, sf_dir)
    short = F.col("doc_id") % 17 == 0
    return lake.select(
        "relative_path",
        F.when(~short, F.col("filename")).alias("filename"),
        F.when(short, None).when(F.col("doc_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("file_size").cast("string")).alias("file_size"),
        F.when(~short, F.col("full_path")).alias("full_path"),
        F.when(~short, F.lit("2024-01-01T00:00:00+00:00")).alias("processed_at"),
        F.col("position"),
    )


def q_manifest_rejects(spark, sf_dir):
    good, bad = parse_manifest(_manifest_text(spark, sf_dir))
    return bad.select("relative_path", "file_size", "reason")


def q_manifest_parsed(spark, sf_dir):
    good, bad = parse_manifest(_manifest_text(spark, sf_dir))
    return good.select("relative_path", "filename", "file_size", "full_path", "file_extension")


def q_manifest_count(spark, sf_dir):
    return manifest_counts(_manifest_text(spark, sf_dir))


# --- C1-C7, J11, J12, W3, A8, A9 --------------------------------------------------------


def _plan(spark, sf_dir, mode, ties=False):
    lake = every_item(spark, sf_dir)
    if ties:  # every row at the same position: paths decide who is first
        lake = lake.withColumn("position", F.lit(0).cast("bigint"))
    gone = _read(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    sources = lake.join(gone, "doc_id", "left_anti").select("full_path")
    existing = _read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("doc_"), (F.col("item_id") % 100).cast("string"), F.lit(".txt")).alias("filename")
    )
    return cp.plan_copy(lake, TARGET_ROOT, mode, sources=sources, existing=existing, carry=("doc_id",))


_PLAN_OUT = ("doc_id", "source", "target", "success", "message", "outcome")


def q_copy_plan_skip(spark, sf_dir):
    return _plan(spark, sf_dir, "skip").select(*_PLAN_OUT)


def q_copy_plan_overwrite(spark, sf_dir):
    return _plan(spark, sf_dir, "overwrite").select(*_PLAN_OUT)


def q_copy_plan_rename(spark, sf_dir):
    return _plan(spark, sf_dir, "rename").select(*_PLAN_OUT)


def q_copy_plan_rename_ties(spark, sf_dir):
    return _plan(spark, sf_dir, "rename", ties=True).select(*_PLAN_OUT)


def q_copy_plan_overwrite_ties(spark, sf_dir):
    return _plan(spark, sf_dir, "overwrite", ties=True).select(*_PLAN_OUT)


def q_copy_summary(spark, sf_dir):
    return mt.copy_summary(_plan(spark, sf_dir, "rename"))


# --- E1 ---------------------------------------------------------------------------------


def q_analyze_documents(spark, sf_dir):
    lake, lib = lake_plus_altered(spark, sf_dir)
    res = analyze(lake, lib, dedup="content")
    return res.missing.select("relative_path", "filename", "file_size", "full_path", "stage")


def q_analyze_documents_tiered(spark, sf_dir):
    lake, lib = lake_plus_altered(spark, sf_dir)
    res = analyze(lake, lib, dedup="tiered")
    return res.missing.select("relative_path", "filename", "file_size", "full_path", "stage")


def _pages_manifest(pages: DataFrame, root: str) -> DataFrame:
    rel = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    return table_manifest(pages, "html", root, rel, "page_id", keep=("page_id",))


def q_analyze_pages(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "html")
    lake = _pages_manifest(pages.where(F.col("page_id") % 2 == 1), PAGES_LAKE_ROOT)
    lib = _pages_manifest(pages.where(F.col("page_id") % 2 == 0), PAGES_LIBRARY_ROOT)
    res = analyze(lake, lib, dedup="content")
    return res.missing.select("page_id", "file_size", "full_path", "stage")


def q_analyze_against_benchmark(spark, sf_dir):
    """Lake = all documents, library = the benchmark passages (an alternative library)."""
    docs = documents(spark, sf_dir)
    lake = _doc_manifest(docs, LAKE_ROOT)
    bench = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    lib = table_manifest(
        bench, "text", LIBRARY_ROOT,
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")),
        "item_id", keep=("item_id",),
    )
    res = analyze(lake, lib, dedup="content")
    return res.summary


def q_stage1_dedup_counts(spark, sf_dir):
    """Stage-1 survivors: how many the tiered rule keeps (one per size) against how many distinct
    contents there are (SURVEY Q3: the difference is what the tiered rule loses).  One aggregate
    pass; the distinct counts are exact."""
    lake, lib = lake_library(spark, sf_dir)
    s1 = cmp.missing_from(lake, lib).where(F.col("stage") == "size")
    return s1.agg(
        F.count(F.lit(1)).alias("stage1_unique"),
        F.count_distinct("full_hash").alias("distinct_contents"),
        F.count_distinct("file_size").alias("kept_by_size_only"),
    )


def _conv_manifest(conv: DataFrame, root: str) -> DataFrame:
    rel = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/t"), F.col("turn").cast("string"), F.lit(".txt"))
    pos = F.col("conv_id") * 100000 + F.col("turn")
    return table_manifest(conv, "text", root, rel, pos, keep=("conv_id", "turn"))


def q_analyze_conversations(spark, sf_dir):
    """Turns of odd conversations (lake) against turns of even ones (library)."""
    conv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lake = _conv_manifest(conv.where(F.col("conv_id") % 2 == 1), LAKE_ROOT)
    lib = _conv_manifest(conv.where(F.col("conv_id") % 2 == 0), LIBRARY_ROOT)
    res = analyze(lake, lib, dedup="content")
    return res.missing.select("conv_id", "turn", "file_size", "stage")


QUERIES = {
    "manifest_table": q_manifest_table,
    "content_hashes": q_content_hashes,
    "extension_filter": q_extension_filter,
    "extension_filter_exact": q_extension_filter_exact,
    "route_counts": q_route_counts,
    "unique_sizes": q_unique_sizes,
    "size_groups": q_size_groups,
    "prefix_groups": q_prefix_groups,
    "full_groups": q_full_groups,
    "stage1_unique": q_stage1_unique,
    "stage1_candidates": q_stage1_candidates,
    "stage2_library_pruned": q_stage2_library_pruned,
    "stage2_unique": q_stage2_unique,
    "stage2_candidates": q_stage2_candidates,
    "stage3_library_pruned": q_stage3_library_pruned,
    "stage3_unique": q_stage3_unique,
    "stage3_duplicates": q_stage3_duplicates,
    "missing_keep": q_missing_keep,
    "missing_drop": q_missing_drop,
    "cascade_flags": q_cascade_flags,
    "lookup_size": q_lookup_size,
    "lookup_prefix": q_lookup_prefix,
    "lookup_full": q_lookup_full,
    "matched_in_library": q_matched_in_library,
    "stage_summary": q_stage_summary,
    "side_summary": q_side_summary,
    "dedup_summary": q_dedup_summary,
    "dedup_content_summary": q_dedup_content_summary,
    "dedup_tiered": q_dedup_tiered,
    "duplicates_report": q_duplicates_report,
    "dedup_content": q_dedup_content,
    "duplicates_report_content": q_duplicates_report_content,
    "resume_anti": q_resume_anti,
    "resume_merge": q_resume_merge,
    "ingest_two_waves": q_ingest_two_waves,
    "ingest_changes": q_ingest_changes,
    "manifest_rejects": q_manifest_rejects,
    "manifest_parsed": q_manifest_parsed,
    "manifest_count": q_manifest_count,
    "copy_plan_skip": q_copy_plan_skip,
    "copy_plan_overwrite": q_copy_plan_overwrite,
    "copy_plan_rename": q_copy_plan_rename,
    "copy_plan_rename_ties": q_copy_plan_rename_ties,
    "copy_plan_overwrite_ties": q_copy_plan_overwrite_ties,
    "copy_summary": q_copy_summary,
    "lookup_size_members": q_lookup_size_members,
    "lookup_prefix_members": q_lookup_prefix_members,
    "content_hashes_md5": q_content_hashes_md5,
    "processed_set": q_processed_set,
    "analyze_documents": q_analyze_documents,
    "analyze_documents_tiered": q_analyze_documents_tiered,
    "analyze_pages": q_analyze_pages,
    "analyze_against_benchmark": q_analyze_against_benchmark,
    "stage1_dedup_counts": q_stage1_dedup_counts,
    "analyze_conversations": q_analyze_conversations,
}
