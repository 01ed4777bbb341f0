"""Analyse a lake against a library: cascade -> dedup -> (missing, duplicates, summary).

All outputs are lazy DataFrames derived from one flagged frame.  With ``materialize=True`` that
frame is computed once and its lineage cut (checkpoint to the cluster's shared folder), so
writing ``missing`` and ``duplicates`` and counting the summary never re-reads or re-hashes
content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import dedup as dd
from ..operators import metrics as mt
from ..session import materialize as _materialize

DEDUP_MODES = ("content", "tiered", "none")


@dataclass
class AnalyzeResult:
    flagged: DataFrame  # every lake row with its stage
    missing: DataFrame  # lake items the library lacks, deduplicated
    duplicates: DataFrame  # duplicates report (empty when dedup='none')
    summary: DataFrame  # files and bytes per stage (A5)
    dedup_summary: DataFrame | None  # before / after / removed (A7)
    changes: DataFrame | None = None  # of a resumed run: prior paths that changed or vanished


def analyze(
    lake: DataFrame,
    lib: DataFrame,
    *,
    prior: DataFrame | None = None,
    dedup: str = "content",
    on_unhashed: str = "keep",
    add_hashes=None,
    materialize: bool = True,
) -> AnalyzeResult:
    """``lake``/``lib`` are manifests.  Table manifests carry both hashes already (one pass);
    file manifests pass ``add_hashes`` (see :func:`tidemark.sources.readers.hash_files`) and are
    hashed stage by stage, survivors only.

    ``dedup='content'`` (default) dedups by full content hash; ``'tiered'`` reproduces the
    reference's size / size+1k / full tiers (drops never-compared files of equal size: SURVEY Q3).

    ``prior`` (a previous result with the lake's columns) turns this into a resumed run (R1).

    ``materialize`` (default) pins the flagged frame: the dedup reads it twice (keepers, then
    the report's join back), and without the pin the lake's content would be read twice.
    """
    if dedup not in DEDUP_MODES:
        raise ValueError(f"dedup must be one of {DEDUP_MODES}, got {dedup!r}")
    if prior is not None:
        # Only paths absent from the prior result are new; prior rows are kept and re-checked
        from ..streaming.incremental import resume_merge

        return resume_merge(lake, lib, prior, dedup=dedup, on_unhashed=on_unhashed, add_hashes=add_hashes)
    if add_hashes is None:
        flagged = cmp.classify(lake, lib, on_unhashed)
    else:
        flagged = cmp.classify_staged(
            lake, lib, add_hashes, on_unhashed, materialize=_materialize if materialize else None
        )
    if materialize:
        # the flagged rows feed the summary, the dedup keepers and the report: pin them once
        # (for tables they hold the digests computed while reading the content)
        flagged = _materialize(flagged)
    return finish(flagged, dedup, add_hashes, materialize)


def finish(flagged: DataFrame, dedup: str = "content", add_hashes=None, materialize: bool = False) -> AnalyzeResult:
    """Dedup and summaries over a flagged frame.  For file manifests (``add_hashes`` given) the
    content dedup first completes the hashes that can matter (:func:`dd.complete_hashes`)."""
    missing = cmp.missing_only(flagged)
    if add_hashes is not None and dedup == "content":
        missing = dd.complete_hashes(missing, add_hashes)
        if materialize:
            missing = _materialize(missing)
    summary = mt.stage_summary(flagged)
    if dedup == "none":
        empty = missing.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in dd.REPORT_COLUMNS))
        return AnalyzeResult(flagged, missing, empty, summary, None)
    res = dd.dedup_content(missing) if dedup == "content" else dd.dedup_tiered(missing)
    return AnalyzeResult(flagged, res.kept, res.duplicates, summary, res.summary)


def run_analysis(
    spark,
    lake_root: str,
    library_root: str,
    output: str,
    *,
    extensions=None,
    resume_from: str | None = None,
    dedup: str = "content",
    on_unhashed: str = "keep",
    fmt: str = "csv",
    include_hidden: bool = True,
    hasher=None,
    large_threshold: int | None = None,
) -> dict:
    """E1 over file trees: scan both roots, compare, dedup, write the manifest of missing items
    (``output``) and, when there are any, the duplicates report (``output + '_duplicates'``).

    ``resume_from`` is a prior manifest: its paths are not analysed again and its rows are kept
    (re-checked against the current library); it may be ``output`` itself.  Returns the per-stage counts and the per-route
    counts of the lake (A6: ``route_skip`` already in the prior manifest, ``route_large`` at or
    over ``large_threshold``, ``route_small``), a few numbers.
    """
    from ..functions.paths import DEFAULT_EXTENSIONS
    from ..sources.files import scan_manifest
    from ..sources.manifest_io import check_hasher, path_exists, read_manifest, write_duplicates, write_manifest
    from ..functions.hashing import LARGE_FILE_BYTES
    from ..operators.metrics import route_summary
    from ..operators.routing import route_files
    from ..sources.readers import file_hasher
    from ..streaming.incremental import resume_merge

    exts = DEFAULT_EXTENSIONS if extensions is None else extensions
    threshold = LARGE_FILE_BYTES if large_threshold is None else large_threshold
    add = file_hasher(hasher, large_threshold=threshold)
    lake = _materialize(scan_manifest(spark, lake_root, exts, include_hidden=include_hidden, with_time=True))
    lib = _materialize(scan_manifest(spark, library_root, exts, include_hidden=include_hidden, with_time=True))
    prior = None
    if resume_from is not None:
        if not path_exists(spark, resume_from):
            raise FileNotFoundError(f"Manifest to resume from does not exist: {resume_from}")
        prior, _ = read_manifest(spark, resume_from, fmt)
        check_hasher(prior, hasher)
        stamp = ["processed_at"] if "processed_at" in prior.columns else []
        prior = prior.select(*[c for c in lake.columns if c in prior.columns], *stamp)
        for c in lake.columns:
            if c not in prior.columns:
                prior = prior.withColumn(c, F.lit(None).cast(lake.schema[c].dataType))
        prior = _materialize(prior.select(*lake.columns, *stamp))  # ``output`` may be the same manifest
        res = resume_merge(lake, lib, prior, dedup=dedup, on_unhashed=on_unhashed,
                           add_hashes=add)
    else:
        res = analyze(lake, lib, dedup=dedup, on_unhashed=on_unhashed, add_hashes=add, materialize=True)
    missing = res.missing
    write_manifest(missing, output, fmt, hasher)
    write_duplicates(res.duplicates, output + "_duplicates")
    counts = {r["stage"]: int(r["n_files"]) for r in res.summary.collect()}
    counts["written"] = missing.count()
    if res.changes is not None:
        counts.update({f"prior_{r['change']}": int(r["count"]) for r in res.changes.groupBy("change").count().collect()})
    routed = route_files(lake, prior.select("full_path") if prior is not None else None, threshold)
    for r in route_summary(routed).collect():
        counts[f"route_{r['route']}"] = int(r["n_files"])
    return counts
