"""Copy execution (C8, C9): the plan's rows are copied by Spark tasks (``mapInPandas``).

Each row is copied to a temporary name next to its target and then renamed onto the target
(atomic on POSIX filesystems), so a task that is retried after an executor loss writes the same
bytes to the same fixed target: the job is idempotent.  The copy is verified by length (and,
with ``verify='hash'``, by digest).  Every outcome, failures included, is one result row.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import get_hasher
from ..session import materialize
from ..sources import fs
from ..sources.readers import digest_full
from .copyplan import COPIED, FAILED, OVERWRITTEN, RENAMED, SKIPPED, SUPERSEDED, check_mode, check_unique_targets

WRITES = (COPIED, RENAMED, OVERWRITTEN)

# Result messages (wording follows the reference).
MSG_OK = "Copied successfully"
MSG_MISSING = "Source file does not exist: "
MSG_SKIP = "Target file exists, skipping: "
MSG_PERM_DIR = "Permission denied creating target directory "
MSG_DIR = "Failed to create target directory "
MSG_PERM = "Permission denied copying file: "
MSG_FS = "Filesystem error copying file: "
MSG_OTHER = "Error copying: "
MSG_NO_TARGET = "Copy appeared to succeed but target file does not exist"
MSG_EMPTY = "Copy appeared to succeed but target file is empty"
MSG_SIZE = "Copy verification failed: size differs"
MSG_LOST = "The later file of the same name was not copied: "
MSG_HASH = "Copy verification failed: content differs"


class _Taken(Exception):
    """The target appeared after planning."""


def _place(tmp: str, dst: str, replace: bool) -> None:
    """Give the finished copy its name; without ``replace`` a name taken meanwhile is left alone."""
    if replace:
        os.replace(tmp, dst)
        return
    try:
        os.link(tmp, dst)  # fails, atomically, if the name is taken
    except FileExistsError:
        raise _Taken(dst) from None
    except OSError:  # no hard links here
        if os.path.lexists(dst):
            raise _Taken(dst) from None
        os.rename(tmp, dst)
        return
    os.remove(tmp)


def _copy_one(src: str, dst: str, size: int, verify: str, hasher, replace: bool = False) -> tuple[bool, str, str]:
    """Returns (success, message, outcome-override or '')."""
    parent = os.path.dirname(dst)
    try:
        os.makedirs(parent, exist_ok=True)
    except PermissionError as e:
        return False, f"{MSG_PERM_DIR}{parent}: {e}", FAILED
    except OSError as e:
        return False, f"{MSG_DIR}{parent}: {e}", FAILED
    tmp = f"{dst}.{uuid.uuid4().hex}.part"
    try:
        shutil.copyfile(src, tmp)
        shutil.copystat(src, tmp)
        _place(tmp, dst, replace)
    except _Taken:
        _silent_remove(tmp)
        raise
    except PermissionError as e:
        _silent_remove(tmp)
        return False, f"{MSG_PERM}{e}", FAILED
    except OSError as e:
        _silent_remove(tmp)
        return False, f"{MSG_FS}{e}", FAILED
    except Exception as e:  # noqa: BLE001
        _silent_remove(tmp)
        return False, f"{MSG_OTHER}{e}", FAILED
    if not os.path.exists(dst):
        return False, MSG_NO_TARGET, FAILED
    got = os.path.getsize(dst)
    if got == 0 and size > 0:
        return False, MSG_EMPTY, FAILED
    if verify in ("size", "hash") and got != os.path.getsize(src):
        return False, MSG_SIZE, FAILED
    if verify == "hash" and digest_full(src, hasher) != digest_full(dst, hasher):
        return False, MSG_HASH, FAILED
    return True, MSG_OK, ""


def _silent_remove(p: str) -> None:
    try:
        os.remove(p)
    except OSError:
        pass


def _other_name(dst: str, src: str, k: int) -> str:
    """A name for a row whose planned one was taken after planning: the same on every retry."""
    folder, name = os.path.split(dst)
    base, ext = os.path.splitext(name)
    return os.path.join(folder, f"{base}_{hashlib.sha256(f'{src}|{dst}|{k}'.encode()).hexdigest()[:16]}{ext}")


def _execute(src: str, dst: str, size: int, outcome: str, mode: str, verify: str, hasher) -> tuple[bool, str, str, str]:
    """One row: (success, message, outcome, target)."""
    if not fs.exists(src):
        return False, f"{MSG_MISSING}{src}", FAILED, dst
    local = fs.strip_file_scheme(src)
    planned = dst
    for k in range(1, 100):
        if mode != "overwrite" and os.path.lexists(dst):
            if _is_own_retry(dst, src):
                return True, MSG_OK, outcome if dst == planned else RENAMED, dst
            if mode == "skip":
                return False, f"{MSG_SKIP}{dst}", SKIPPED, dst
            dst = _other_name(planned, src, k)
            continue
        try:
            ok, msg, override = _copy_one(local, dst, size, verify, hasher, replace=mode == "overwrite")
        except _Taken:
            continue
        return ok, msg, override or (outcome if dst == planned else RENAMED), dst
    return False, f"{MSG_FS}no free name for {planned}", FAILED, planned


def _runner(mode: str, verify: str, hasher):
    def run(batches):
        for pdf in batches:
            done = [
                _execute(r.source, r.target, int(r.file_size or 0), r.outcome, mode, verify, hasher)
                if r.outcome in WRITES  # skipped / failed / superseded: decided by the plan
                else (r.success, r.message, r.outcome, r.target)
                for r in pdf.itertuples(index=False)
            ]
            for i, c in enumerate(("success", "message", "outcome", "target")):
                pdf[c] = pd.Series([d[i] for d in done], index=pdf.index, dtype=bool if c == "success" else object)
            yield pdf

    return run


def fail_superseded(results: DataFrame) -> DataFrame:
    """Overwrite mode: a row that gave way to a later one has no copy of its own, so it fails where
    the later one did."""
    lost = materialize(
        results.where((F.col("outcome") == FAILED) & F.col("target").isNotNull()).select("target").distinct().withColumn("_lost", F.lit(True))
    )
    gone = F.col("_lost").isNotNull() & (F.col("outcome") == SUPERSEDED)
    return results.join(lost, "target", "left").withColumns({
        "success": F.col("success") & ~gone,
        "message": F.when(gone, F.concat(F.lit(MSG_LOST), F.col("target"))).otherwise(F.col("message")),
        "outcome": F.when(gone, FAILED).otherwise(F.col("outcome")),
    }).select(*results.columns)


def _is_own_retry(dst: str, src: str) -> bool:
    """A target written by an earlier attempt of this very task (same bytes) is not a conflict."""
    try:
        return os.path.getsize(dst) == os.path.getsize(fs.strip_file_scheme(src)) and \
            digest_full(dst, get_hasher("sha256")) == digest_full(src, get_hasher("sha256"))
    except OSError:
        return False


def run_copy(plan: DataFrame, mode: str = "rename", verify: str = "size", hasher=None,
             pinned: bool = False) -> DataFrame:
    """Execute a plan from :func:`tidemark.operators.copyplan.plan_copy`; returns one
    result row per plan row (same columns, ``success``/``message``/``outcome`` updated).

    The plan is pinned first (unless ``pinned``): a retried copy task must see the same targets,
    not a plan recomputed against a target folder that other tasks have already filled."""
    check_mode(mode)
    if verify not in ("none", "size", "hash"):
        raise ValueError("verify must be 'none', 'size' or 'hash'")
    h = get_hasher(hasher)
    if not pinned:
        plan = materialize(plan)
    check_unique_targets(plan)
    results = materialize(plan.mapInPandas(_runner(mode, verify, h), plan.schema))  # copy once
    return fail_superseded(results) if mode == "overwrite" else results


def check_target_root(target_root: str) -> None:
    """The target folder may not be an existing file (the reference raises the same)."""
    p = fs.strip_file_scheme(target_root)
    if os.path.exists(p) and not os.path.isdir(p):
        raise FileExistsError(f"Cannot create target directory: {p} exists as a file")
