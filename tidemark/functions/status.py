"""Stage flags and processing status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stage names of the cascade and the processing status each implies.
STAGE_SIZE = "size"  # unique by size (stage 1)
STAGE_PREFIX = "prefix"  # unique by (size, prefix hash) (stage 2)
STAGE_FULL = "full"  # unique by full hash (stage 3)
STAGE_DUPLICATE = "duplicate"  # same content is in the library
STAGE_UNHASHED = "unhashed"  # policy "drop": a needed hash is missing, row is neither unique nor duplicate
MISSING_STAGES = (STAGE_SIZE, STAGE_PREFIX, STAGE_FULL)

STATUS_SIZE = "size_checked"
STATUS_PREFIX = "1k_hashed"
STATUS_FULL = "full_hashed"


def stage_no(stage: Column | str) -> Column:
    s = F.col(stage) if isinstance(stage, str) else stage
    return (
        F.when(s == STAGE_SIZE, 1)
        .when(s == STAGE_PREFIX, 2)
        .when(s.isin(STAGE_FULL, STAGE_DUPLICATE), 3)
        .otherwise(F.lit(None))
        .cast("int")
    )


def processing_status(stage: Column | str, reached_stage_no: Column | None = None) -> Column:
    """Status of a row after the cascade: the last stage that looked at it."""
    s = F.col(stage) if isinstance(stage, str) else stage
    base = (
        F.when(s == STAGE_SIZE, STATUS_SIZE)
        .when(s == STAGE_PREFIX, STATUS_PREFIX)
        .when(s.isin(STAGE_FULL, STAGE_DUPLICATE), STATUS_FULL)
    )
    if reached_stage_no is None:
        return base
    return base.otherwise(
        F.when(reached_stage_no == 2, STATUS_SIZE).when(reached_stage_no == 3, STATUS_PREFIX)
    )
