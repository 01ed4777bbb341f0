"""The content anti-join cascade, lake against library.

Every join here is an equi-join of the (large) lake manifest against a *distinct* key set of the
library, so a join never fans out, whatever the skew of the keys.  The physical strategy is
left to Catalyst and AQE: a key set that turns out small at runtime is broadcast (AQE measures
it first, so the broadcast is size-checked), otherwise both sides are hash-partitioned on the
key; a hot lake key (one size shared by a third of the files) is split by AQE's skew-join
handling, which is valid for the left outer / semi / anti joins used here and applies because
the library's key sets are pinned (see :func:`library_keys`).

Two NULL policies mirror the two entry points of the reference:

``keep``  a lake row whose hash for a stage is missing is unique at that stage (command line).
``drop``  such a row is neither unique nor a duplicate (library API); stage ``unhashed``.

A library row with a NULL hash never matches anything.  ``NOT IN`` is never used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as st
from ..session import materialize as _materialize

POLICIES = ("keep", "drop")


def _check_policy(on_unhashed: str) -> None:
    if on_unhashed not in POLICIES:
        raise ValueError(f"on_unhashed must be one of {POLICIES}, got {on_unhashed!r}")


def key_set(df: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Distinct non-NULL keys of ``df`` (A1 for ``['file_size']``), optionally with a TRUE flag."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    out = df.where(cond).select(*keys).distinct()
    return out.withColumn(flag, F.lit(True)) if flag else out


# --- stage by stage (J1-J5) -------------------------------------------------------------


def stage_size(lake: DataFrame, lib: DataFrame, keys=None) -> tuple[DataFrame, DataFrame]:
    """(unique by size, candidates for stage 2).

    ``keys`` (all stages): the library's pinned :class:`LibraryKeys` (so a chain of stages reads
    the library once), or this stage's distinct key set (exactly its key columns), or ``None`` to
    derive the keys from ``lib``."""
    sizes = _keys_for(keys, lib, "sizes", ["file_size"])
    return lake.join(sizes, "file_size", "left_anti"), lake.join(sizes, "file_size", "left_semi")


def stage_prefix(candidates: DataFrame, lib: DataFrame, on_unhashed: str = "keep",
                 keys=None) -> tuple[DataFrame, DataFrame]:
    """(unique by size and prefix hash, candidates for stage 3)."""
    _check_policy(on_unhashed)
    return _unique_and_matched(candidates, _keys_for(keys, lib, "prefixes", ["file_size", "prefix_hash"]),
                               ["file_size", "prefix_hash"], "prefix_hash", on_unhashed)


def stage_full(candidates: DataFrame, lib: DataFrame, on_unhashed: str = "keep",
               keys=None) -> tuple[DataFrame, DataFrame]:
    """(unique by full hash, duplicates of a library file)."""
    _check_policy(on_unhashed)
    return _unique_and_matched(candidates, _keys_for(keys, lib, "fulls", ["file_size", "full_hash"]),
                               ["file_size", "full_hash"], "full_hash", on_unhashed)


def _unique_and_matched(candidates: DataFrame, distinct_keys: DataFrame, keys: list[str], hash_col: str,
                        on_unhashed: str) -> tuple[DataFrame, DataFrame]:
    """(unique, matched) of one stage; each output reads ``candidates`` once.  ``unique`` is a
    left join with a NULL flag (a NULL hash never matches, so policy ``keep`` keeps such rows
    and ``drop`` filters them); ``matched`` is a semi join.  ``distinct_keys`` has no repeats."""
    ks = distinct_keys.withColumn("_m", F.lit(True))
    unique = candidates.join(ks, keys, "left").where(F.col("_m").isNull())
    if on_unhashed == "drop":
        unique = unique.where(F.col(hash_col).isNotNull())
    return unique.select(*candidates.columns), candidates.join(distinct_keys, keys, "left_semi")


def prune_library_by_size(lib: DataFrame, candidates: DataFrame) -> DataFrame:
    """Library rows whose size occurs among the stage-2 candidates (only these need a
    prefix hash)."""
    return lib.join(_materialize(key_set(candidates, ["file_size"])), "file_size", "left_semi")


def prune_library_by_prefix(lib: DataFrame, candidates: DataFrame) -> DataFrame:
    """Library rows whose (size, prefix hash) occurs among the stage-3 candidates (only
    these need a full hash)."""
    return lib.join(_materialize(key_set(candidates, ["file_size", "prefix_hash"])), ["file_size", "prefix_hash"], "left_semi")


# --- whole cascade (J6) -----------------------------------------------------------------


def _stage_column(on_unhashed: str):
    unhashed_prefix = st.STAGE_PREFIX if on_unhashed == "keep" else st.STAGE_UNHASHED
    unhashed_full = st.STAGE_FULL if on_unhashed == "keep" else st.STAGE_UNHASHED
    return (
        F.when(F.col("_m1").isNull(), st.STAGE_SIZE)
        .when(F.col("prefix_hash").isNull(), unhashed_prefix)
        .when(F.col("_m2").isNull(), st.STAGE_PREFIX)
        .when(F.col("full_hash").isNull(), unhashed_full)
        .when(F.col("_m3").isNull(), st.STAGE_FULL)
        .otherwise(st.STAGE_DUPLICATE)
    )


def _reached(on_unhashed: str):
    """Last stage number that looked at the row (for ``unhashed`` rows of policy drop)."""
    return (
        F.when(F.col("_m1").isNull(), 1)
        .when(F.col("prefix_hash").isNull() | F.col("_m2").isNull(), 2)
        .otherwise(3)
    )


@dataclass
class LibraryKeys:
    """The library's distinct key sets, each with a TRUE flag column (``_m1``/``_m2``/``_m3``)."""

    sizes: DataFrame  # file_size
    prefixes: DataFrame  # file_size, prefix_hash
    fulls: DataFrame  # file_size, full_hash


def library_keys(lib: DataFrame, pin: bool = True) -> LibraryKeys:
    """The three key sets of the library from one read of its content.

    The three sets are one ``GROUPING SETS`` aggregation (one scan, partial aggregation, one
    shuffle), pinned once.  Pinning matters twice at scale: Catalyst would otherwise re-derive
    each set from the scan (three reads of the library), and a join whose build side is an
    aggregate directly on its shuffle cannot be split by AQE's skew handling, while a join
    against a pinned set can (``SortMergeJoin(skew=true)``): a hot size or content in the lake
    is spread over several tasks.  A small set is broadcast by AQE after it measured it.
    """
    # one pass, one shuffle: GROUPING SETS (size), (size, prefix), (size, full), tagged by grouping_id
    g = lib.groupingSets(
        [["file_size"], ["file_size", "prefix_hash"], ["file_size", "full_hash"]],
        "file_size", "prefix_hash", "full_hash",
    ).agg(F.grouping_id().alias("_g"))
    if pin:
        g = _materialize(g)
    size_ok = F.col("file_size").isNotNull()
    return LibraryKeys(
        g.where((F.col("_g") == 3) & size_ok).select("file_size", F.lit(True).alias("_m1")),
        g.where((F.col("_g") == 1) & size_ok & F.col("prefix_hash").isNotNull())
        .select("file_size", "prefix_hash", F.lit(True).alias("_m2")),
        g.where((F.col("_g") == 2) & size_ok & F.col("full_hash").isNotNull())
        .select("file_size", "full_hash", F.lit(True).alias("_m3")),
    )


def _keys_for(keys, lib: DataFrame, which: str, cols: list[str]) -> DataFrame:
    """Distinct keys of one stage: from pinned :class:`LibraryKeys`, from a DataFrame that already
    holds exactly these distinct keys, or computed from the library rows."""
    if isinstance(keys, LibraryKeys):
        return getattr(keys, which).select(*cols)
    if keys is not None and sorted(keys.columns) == sorted(cols):
        return keys
    return key_set(keys if keys is not None else lib, cols)


def classify(lake: DataFrame, lib: DataFrame, on_unhashed: str = "keep", keys: LibraryKeys | None = None,
             pin: bool = True) -> DataFrame:
    """J6 for manifests that already carry both hashes (tables): one pass, one row per lake row,
    with ``stage``, ``stage_no`` and ``processing_status``.

    Three left joins to the library's distinct key sets (:func:`library_keys`, read once); each
    lake row is shuffled as a narrow row (paths, size, two digests), never its content.  Stage 3
    joins on ``(file_size, full_hash)``: equal content has equal size, and the size in the key
    spreads a hot digest no worse than the digest alone.
    """
    _check_policy(on_unhashed)
    k = keys if keys is not None else library_keys(lib, pin)
    j = (
        lake.join(k.sizes, "file_size", "left")
        .join(k.prefixes, ["file_size", "prefix_hash"], "left")
        .join(k.fulls, ["file_size", "full_hash"], "left")
    )
    stage = _stage_column(on_unhashed)
    out = (
        j.withColumn("stage", stage)
        .withColumn("stage_no", st.stage_no("stage"))
        .withColumn("processing_status", st.processing_status("stage", _reached(on_unhashed)))
    )
    # keep the lake's own column order, flags dropped
    return out.select(*lake.columns, "stage", "stage_no", "processing_status")


def classify_staged(lake: DataFrame, lib: DataFrame, add_hashes, on_unhashed: str = "keep", materialize=None,
                    hashed_library: list | None = None) -> DataFrame:
    """J6 for manifests whose hashes are expensive (files): stage by stage, hashing only
    survivors, and on the library side only rows that can still match (J4, J5).

    ``add_hashes(df, stage)`` returns ``df`` with ``prefix_hash`` (stage ``"1k"``) or
    ``full_hash`` (stage ``"full"``) filled in.  ``materialize`` (e.g.
    :func:`tidemark.session.materialize`) pins each hashed set so no file is read twice.
    ``hashed_library``, when a list, receives the library rows hashed here (stage 2 and 3) so a
    caller can keep their digests (the stream ingest caches them across batches).
    """
    _check_policy(on_unhashed)
    pin = materialize or (lambda d: d)
    cols = lake.columns

    def tag(df, stage):
        return (
            df.select(*cols)
            .withColumn("stage", F.lit(stage))
            .withColumn("stage_no", st.stage_no(F.lit(stage)))
            .withColumn("processing_status", st.processing_status(F.lit(stage)))
        )

    # key sets of each stage are pinned (one row per key) so AQE can split a hot lake key; the flagged rows of each
    # stage are pinned too: both outcomes and the library's pruning read them, the lake is joined once a stage
    f1 = _flagged(lake, _materialize(key_set(lib, ["file_size"])), ["file_size"], pin)
    unique1, cand1 = f1.where("_hit is null").drop("_hit"), f1.where("_hit").drop("_hit")
    cand1h, lib2 = _hash_together(cand1, prune_library_by_size(lib, cand1), "1k", add_hashes, pin)
    f2 = _flagged(cand1h, _materialize(key_set(lib2, ["file_size", "prefix_hash"])), ["file_size", "prefix_hash"], pin)
    unique2, cand2 = f2.where("_hit is null").drop("_hit"), f2.where("_hit").drop("_hit")
    cand2h, lib3 = _hash_together(cand2, prune_library_by_prefix(lib2, cand2), "full", add_hashes, pin)
    f3 = _flagged(cand2h, _materialize(key_set(lib3, ["file_size", "full_hash"])), ["file_size", "full_hash"], pin)
    unique3, dup3 = f3.where("_hit is null").drop("_hit"), f3.where("_hit").drop("_hit")
    if on_unhashed == "drop":
        unique2, unique3 = unique2.where("prefix_hash is not null"), unique3.where("full_hash is not null")
    if hashed_library is not None:
        hashed_library.extend([lib2, lib3])
    parts = [
        tag(unique1, st.STAGE_SIZE),
        tag(unique2, st.STAGE_PREFIX),
        tag(unique3, st.STAGE_FULL),
        tag(dup3, st.STAGE_DUPLICATE),
    ]
    if on_unhashed == "drop":
        for rows, status in ((cand1h.where(F.col("prefix_hash").isNull()), st.STATUS_SIZE),
                             (cand2h.where(F.col("full_hash").isNull()), st.STATUS_PREFIX)):
            parts.append(
                rows.select(*cols)
                .withColumn("stage", F.lit(st.STAGE_UNHASHED))
                .withColumn("stage_no", F.lit(None).cast("int"))
                .withColumn("processing_status", F.lit(status))
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _flagged(rows: DataFrame, distinct_keys: DataFrame, keys: list[str], pin) -> DataFrame:
    """``rows`` with ``_hit``: TRUE where the library has the key, else NULL (one left join, pinned)."""
    return pin(rows.join(distinct_keys.withColumn("_hit", F.lit(True)), keys, "left").select(*rows.columns, "_hit"))


def _hash_together(lake_rows: DataFrame, lib_rows: DataFrame, stage: str, add_hashes, pin):
    """Hash the lake candidates and the library rows of one stage in a single reader pass (one
    set of byte-balanced tasks, one pin), then split them by side again."""
    both = lake_rows.withColumn("_side", F.lit(0)).unionByName(
        lib_rows.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    hashed = pin(add_hashes(both, stage))
    return (
        hashed.where(F.col("_side") == 0).select(*lake_rows.columns),
        hashed.where(F.col("_side") == 1).select(*lib_rows.columns),
    )


def missing_only(flagged: DataFrame) -> DataFrame:
    """Rows unique at some stage: the lake items the library lacks."""
    return flagged.where(F.col("stage").isin(*st.MISSING_STAGES))


def missing_from(lake: DataFrame, lib: DataFrame, on_unhashed: str = "keep") -> DataFrame:
    """Lake rows that are not in the library by content (tables: hashes present)."""
    return missing_only(classify(lake, lib, on_unhashed))


# --- lookups (J7-J9, J13) ---------------------------------------------------------------


def _order_struct(carry: tuple[str, ...]):
    """(position, full_path, carried...) without repeats: ``min``/``max`` of it picks the first/last
    row in input order and carries the wanted columns along."""
    fields = ["position", "full_path"] + [c for c in carry if c not in ("position", "full_path")]
    return F.struct(*fields)


def members_by_size(wanted: DataFrame, lib: DataFrame) -> DataFrame:
    """J7, all members: every library row whose size is wanted, once each (no pairs)."""
    return lib.join(_materialize(key_set(wanted, ["file_size"])), "file_size", "left_semi")


def members_by_prefix(wanted: DataFrame, lib: DataFrame) -> DataFrame:
    """J8, all members: every library row whose (size, prefix hash) is wanted, once each."""
    keys = ["file_size", "prefix_hash"]
    return lib.join(_materialize(key_set(wanted, keys)), keys, "left_semi")


def lookup_by_size(lake: DataFrame, lib: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """For each lake row, how many library files share its size and the first of them
    (lowest position).  Pairs are never materialised: the library is reduced to one row per size
    first (partial aggregation handles a hot size) and pinned, so the join to it can be split by
    AQE when a size is hot on the lake side."""
    per_size = _materialize(lib.groupBy("file_size").agg(
        F.count(F.lit(1)).alias("library_matches"),
        F.min(_order_struct(carry)).alias("_first"),
    ))
    out = lake.join(per_size, "file_size", "inner")
    return out.select(*lake.columns, "library_matches", *[F.col(f"_first.{c}").alias(f"library_{c}") for c in carry])


def lookup_by_prefix(lake: DataFrame, lib: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """As J7 on (size, prefix hash)."""
    keys = ["file_size", "prefix_hash"]
    per_key = _materialize(lib.where(F.col("prefix_hash").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("library_matches"),
        F.min(_order_struct(carry)).alias("_first"),
    ))
    out = lake.join(per_key, keys, "inner")
    return out.select(*lake.columns, "library_matches", *[F.col(f"_first.{c}").alias(f"library_{c}") for c in carry])


def last_by_full_hash(lib: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """A4/J9 index: one library row per full hash, the last one added (highest position) wins."""
    return (
        lib.where(F.col("full_hash").isNotNull())
        .groupBy("full_hash")
        .agg(F.count(F.lit(1)).alias("library_copies"), F.max(_order_struct(carry)).alias("_last"))
        .select("full_hash", "library_copies", *[F.col(f"_last.{c}").alias(f"library_{c}") for c in carry])
    )


def lookup_by_full_hash(lake: DataFrame, lib: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """For each lake row, the library file with the same full hash (last added wins)."""
    return lake.join(_materialize(last_by_full_hash(lib, carry)), "full_hash", "inner").select(
        *lake.columns, *[f"library_{c}" for c in carry]
    )


def matched_in_library(flagged: DataFrame, lib: DataFrame, carry: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """Which library file each lake duplicate equals."""
    dups = flagged.where(F.col("stage") == st.STAGE_DUPLICATE)
    return lookup_by_full_hash(dups, lib, carry)
