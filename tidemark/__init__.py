"""tidemark: content reconciliation on Spark.

Which items of a *lake* are not, by content, in a *library*?  Manifests (one row per item) are
compared by a cascade of anti/semi joins on size, prefix digest and full digest; the result is
deduplicated, written as a manifest, resumable, and turned into a conflict-free copy plan that
Spark tasks execute.
"""

__version__ = "0.1.0"

from .operators.compare import classify, library_keys, missing_from  # noqa: E402,F401
from .operators.copyplan import plan_copy  # noqa: E402,F401
from .operators.dedup import dedup_content, dedup_tiered  # noqa: E402,F401
from .plans.analyze import AnalyzeResult, analyze, run_analysis  # noqa: E402,F401
from .plans.copy import copy_manifest  # noqa: E402,F401
from .sources.files import scan_manifest  # noqa: E402,F401
from .sources.manifest_io import read_manifest, write_manifest  # noqa: E402,F401
from .sources.tables import table_manifest  # noqa: E402,F401
from .streaming.incremental import resume, resume_merge  # noqa: E402,F401
from .streaming.ingest import start_ingest  # noqa: E402,F401
