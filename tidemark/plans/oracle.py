"""DuckDB SQL for each registered query (the driver's correctness oracle).

Written independently of the Spark code: ``NOT EXISTS``/``EXISTS`` for the anti/semi joins,
``row_number``/``first_value`` windows for dedup, ``GROUP BY`` for everything else.  Column
names equal the Spark ones.  Tables are the driver's views (``documents``, ``labels``, ...).
"""

from __future__ import annotations

from ..functions.paths import DEFAULT_EXTENSIONS
from .catalog import ALTERED_ID_OFFSET, EXT_CYCLE, ROUTE_THRESHOLD


def _mk(src: str) -> str:
    return f"""SELECT doc_id, source,
      source || '/' || CAST(doc_id AS VARCHAR) || '/doc_' || CAST(doc_id % 100 AS VARCHAR) || '.txt' AS relative_path,
      'doc_' || CAST(doc_id % 100 AS VARCHAR) || '.txt' AS filename,
      CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
      sha256(encode(text)[1:1024]) AS prefix_hash,
      sha256(encode(text)) AS full_hash
    FROM {src}"""


ALT = f"""alt AS (
    SELECT doc_id + {ALTERED_ID_OFFSET} AS doc_id, left(text, length(text) - 1) || '#' AS text, source
    FROM documents
    WHERE doc_id % 2 = 0 AND octet_length(encode(text)) > 1024
      AND octet_length(encode(right(text, 1))) = 1 AND right(text, 1) <> '#')"""

# lake = odd doc_id, library = even doc_id
LL = f"""WITH mk AS ({_mk('documents')}),
  lake AS (SELECT *, '/lake/' || relative_path AS full_path FROM mk WHERE doc_id % 2 = 1),
  lib AS (SELECT *, '/library/' || relative_path AS full_path FROM mk WHERE doc_id % 2 = 0)"""

# every document is a lake item
EVERY = f"""WITH mk AS ({_mk('documents')}),
  lake AS (SELECT *, '/lake/' || relative_path AS full_path FROM mk)"""

# lake plus the rows altered in their last byte
LL2 = f"""WITH {ALT},
  mk AS ({_mk('documents')}),
  mk2 AS ({_mk('(SELECT doc_id, text, source FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, text, source FROM alt)')}),
  lake AS (SELECT *, '/lake/' || relative_path AS full_path FROM mk2),
  lib AS (SELECT *, '/library/' || relative_path AS full_path FROM mk WHERE doc_id % 2 = 0)"""


def _flags(lake: str, lib: str) -> str:
    return f"""SELECT l.*,
      EXISTS (SELECT 1 FROM {lib} b WHERE b.file_size = l.file_size) AS m1,
      EXISTS (SELECT 1 FROM {lib} b WHERE b.file_size = l.file_size AND b.prefix_hash = l.prefix_hash) AS m2,
      EXISTS (SELECT 1 FROM {lib} b WHERE b.full_hash = l.full_hash) AS m3
    FROM {lake} l"""


def _stage(policy: str) -> str:
    up = "'prefix'" if policy == "keep" else "'unhashed'"
    uf = "'full'" if policy == "keep" else "'unhashed'"
    return f"""CASE WHEN NOT m1 THEN 'size'
      WHEN prefix_hash IS NULL THEN {up}
      WHEN NOT m2 THEN 'prefix'
      WHEN full_hash IS NULL THEN {uf}
      WHEN NOT m3 THEN 'full'
      ELSE 'duplicate' END"""


STATUS = """CASE WHEN stage = 'size' THEN 'size_checked' WHEN stage = 'prefix' THEN '1k_hashed'
      WHEN stage IN ('full', 'duplicate') THEN 'full_hashed'
      WHEN NOT m1 THEN 'size_checked'
      WHEN prefix_hash IS NULL OR NOT m2 THEN 'size_checked' ELSE '1k_hashed' END"""

STAGE_NO = "CAST(CASE stage WHEN 'size' THEN 1 WHEN 'prefix' THEN 2 WHEN 'full' THEN 3 WHEN 'duplicate' THEN 3 END AS INTEGER)"

NULLED = """lakeN AS (SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN prefix_hash END AS prefix_hash,
                                 CASE WHEN doc_id % 11 <> 0 THEN full_hash END AS full_hash) FROM lake),
  libN AS (SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN prefix_hash END AS prefix_hash,
                                CASE WHEN doc_id % 11 <> 0 THEN full_hash END AS full_hash) FROM lib)"""


def _classified(lake: str, lib: str, policy: str) -> str:
    return f"""f AS ({_flags(lake, lib)}),
  s AS (SELECT *, {_stage(policy)} AS stage FROM f),
  c AS (SELECT *, {STAGE_NO} AS stage_no, {STATUS} AS processing_status FROM s)"""


def _suffix(col: str) -> str:
    return f"regexp_extract({col}, '^.+(\\.[^./]+)$', 1)"


def _stem(col: str) -> str:
    return f"CASE WHEN {_suffix(col)} = '' THEN {col} ELSE left({col}, length({col}) - length({_suffix(col)})) END"


def _tiered(missing: str) -> str:
    return f"""mm AS (SELECT *, CASE WHEN stage_no >= 3 THEN full_hash END AS vf,
                         CASE WHEN stage_no >= 2 THEN prefix_hash END AS vp FROM {missing}),
  k AS (SELECT *, CASE WHEN vf IS NOT NULL THEN 'full_hash' WHEN vp IS NOT NULL THEN 'size+1k_hash' ELSE 'size_only' END AS method,
                  CASE WHEN vf IS NOT NULL THEN vf WHEN vp IS NOT NULL THEN CAST(file_size AS VARCHAR) || ':' || vp
                       ELSE CAST(file_size AS VARCHAR) END AS dkey FROM mm),
  r AS (SELECT *, row_number() OVER w AS rn, first_value(full_path) OVER w AS original_path FROM k
        WINDOW w AS (PARTITION BY method, dkey ORDER BY stage_no, full_path, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _content(missing: str) -> str:
    return f"""k AS (SELECT *, 'full_hash' AS method, full_hash AS dkey FROM {missing}),
  r AS (SELECT *, row_number() OVER w AS rn, first_value(full_path) OVER w AS original_path FROM k
        WINDOW w AS (PARTITION BY method, dkey ORDER BY stage_no, full_path, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


MISSING_PLAIN = f"""{LL},
  {_classified('lake', 'lib', 'keep')},
  missing AS (SELECT * FROM c WHERE stage IN ('size', 'prefix', 'full'))"""

MISSING_ALT = f"""{LL2},
  {_classified('lake', 'lib', 'keep')},
  missing AS (SELECT * FROM c WHERE stage IN ('size', 'prefix', 'full'))"""

REPORT_SELECT = """SELECT full_path AS duplicate_path, original_path, method, CAST(file_size AS VARCHAR) AS file_size, filename
FROM r WHERE rn > 1"""

DEDUP_SUMMARY = """SELECT count(*) AS "before", count(*) FILTER (WHERE rn = 1) AS "after",
       count(*) FILTER (WHERE rn > 1) AS removed FROM r"""

_ext_list = ", ".join(f"'{e}'" for e in EXT_CYCLE)
_any_ext_ci = " OR ".join(f"ends_with(lower(filename), '{e}')" for e in DEFAULT_EXTENSIONS)
_any_ext_cs = " OR ".join(f"ends_with(filename, '{e}')" for e in DEFAULT_EXTENSIONS)

EXT_ROWS = f"""WITH r AS (SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || ([{_ext_list}])[doc_id % 5 + 1] AS filename FROM documents),
  r2 AS (SELECT *, '/lake/' || filename AS full_path FROM r),
  ex AS (SELECT full_path FROM r2 WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = r2.doc_id AND labels.toxic = 1))"""


def _ext_query(cond: str) -> str:
    return f"""{EXT_ROWS}
SELECT doc_id, filename, lower({_suffix('filename')}) AS file_extension FROM r2
WHERE ({cond}) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.full_path = r2.full_path)"""


PLAN_BASE = f"""{EVERY},
  gone AS (SELECT doc_id FROM labels WHERE toxic = 1),
  src AS (SELECT full_path FROM lake WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = lake.doc_id)),
  exn AS (SELECT DISTINCT 'doc_' || CAST(item_id % 100 AS VARCHAR) || '.txt' AS filename FROM benchmark),
  p AS (SELECT lake.*, EXISTS (SELECT 1 FROM src WHERE src.full_path = lake.full_path) AS live,
               EXISTS (SELECT 1 FROM exn WHERE exn.filename = lake.filename) AS ex FROM lake),
  e AS (SELECT filename, min(doc_id) AS first_pos, max(doc_id) AS last_pos FROM p WHERE live GROUP BY filename),
  q AS (SELECT p.*, e.first_pos, e.last_pos FROM p LEFT JOIN e USING (filename))"""


def _plan_select(name_col: str, src: str) -> str:
    tgt = f"'/import/' || {name_col}"
    return f"""SELECT doc_id, full_path AS source,
  CASE WHEN live THEN {tgt} END AS target,
  outcome IN ('copied', 'renamed', 'overwritten', 'superseded') AS success,
  CASE WHEN NOT live THEN 'Source file does not exist: ' || full_path
       WHEN outcome = 'failed' THEN 'Source and target are the same file: ' || full_path
       WHEN outcome = 'skipped' THEN 'Target file exists, skipping: ' || {tgt}
       WHEN outcome = 'superseded' THEN 'Superseded by a later file with the same name: ' || {tgt}
       ELSE 'Would copy to: ' || {tgt} END AS message,
  outcome
FROM {src}"""


PLAN_SKIP = f"""{PLAN_BASE},
  o AS (SELECT *, CASE WHEN NOT live THEN 'failed' WHEN ex OR doc_id <> first_pos THEN 'skipped' ELSE 'copied' END AS outcome FROM q)
{_plan_select('filename', 'o')}"""

PLAN_OVERWRITE = f"""{PLAN_BASE},
  o AS (SELECT *, CASE WHEN NOT live THEN 'failed' WHEN full_path = '/import/' || filename THEN 'failed'
                       WHEN doc_id <> last_pos THEN 'superseded' WHEN ex THEN 'overwritten' ELSE 'copied' END AS outcome FROM q)
{_plan_select('filename', 'o')}"""

PLAN_RENAME_CTE = f"""{PLAN_BASE},
  r1 AS (SELECT *, CASE WHEN NOT live THEN 'failed' WHEN NOT ex AND doc_id = first_pos THEN 'copied' ELSE 'renamed' END AS outcome,
                   {_stem('filename')} || '_' || left(sha256(relative_path), 8) || {_suffix('filename')} AS short FROM q),
  uses AS (SELECT short, count(*) AS n FROM r1 WHERE outcome = 'renamed' GROUP BY short),
  taken AS (SELECT filename AS short FROM r1 WHERE outcome = 'copied' UNION SELECT filename FROM exn),
  o AS (SELECT r1.*, CASE WHEN outcome = 'copied' THEN filename
                          WHEN coalesce(uses.n, 0) > 1 OR EXISTS (SELECT 1 FROM taken t WHERE t.short = r1.short)
                            THEN {_stem('filename')} || '_' || sha256(relative_path || '|' || CAST(doc_id AS VARCHAR)) || {_suffix('filename')}
                          ELSE r1.short END AS name
        FROM r1 LEFT JOIN uses ON uses.short = r1.short)"""

PLAN_RENAME = f"""{PLAN_RENAME_CTE}
{_plan_select('name', 'o')}"""

# all positions tied: the path decides
PLAN_OVERWRITE_TIES = PLAN_OVERWRITE.replace("min(doc_id)", "min(relative_path)").replace("max(doc_id)", "max(relative_path)").replace("doc_id <> last_pos", "relative_path <> last_pos")
PLAN_RENAME_TIES = PLAN_RENAME.replace("min(doc_id)", "min(relative_path)").replace("max(doc_id)", "max(relative_path)").replace("doc_id = first_pos", "relative_path = first_pos")

MANIFEST_TEXT = f"""{EVERY},
  t AS (SELECT relative_path,
               CASE WHEN doc_id % 17 <> 0 THEN filename END AS filename,
               CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'n/a' ELSE CAST(file_size AS VARCHAR) END AS file_size,
               CASE WHEN doc_id % 17 <> 0 THEN full_path END AS full_path FROM lake),
  tf AS (SELECT *, CASE WHEN relative_path IS NULL OR filename IS NULL OR full_path IS NULL OR file_size IS NULL THEN 'missing field'
                        WHEN TRY_CAST(file_size AS BIGINT) IS NULL THEN 'file_size is not an integer' END AS reason FROM t)"""


def _pages(parity: int, root: str) -> str:
    return f"""SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS file_size,
      sha256(encode(html)[1:1024]) AS prefix_hash, sha256(encode(html)) AS full_hash,
      '{root}/p' || CAST(page_id AS VARCHAR) || '.html' AS full_path, page_id AS doc_id
    FROM pages WHERE page_id % 2 = {parity}"""


def _conv(parity: int, root: str) -> str:
    return f"""SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
      sha256(encode(text)[1:1024]) AS prefix_hash, sha256(encode(text)) AS full_hash,
      '{root}/c' || CAST(conv_id AS VARCHAR) || '/t' || CAST(turn AS VARCHAR) || '.txt' AS full_path,
      conv_id * 100000 + turn AS doc_id
    FROM conversations WHERE conv_id % 2 = {parity}"""


ORACLE = {
    "manifest_table": f"""WITH mk AS ({_mk('documents')})
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'lake' ELSE 'library' END AS side,
       CASE WHEN doc_id % 2 = 1 THEN '/lake/' ELSE '/library/' END || relative_path AS full_path,
       relative_path, filename, lower({_suffix('filename')}) AS file_extension, file_size FROM mk""",
    "content_hashes": f"""WITH mk AS ({_mk('documents')}) SELECT doc_id, file_size, prefix_hash, full_hash FROM mk""",
    "extension_filter": _ext_query(_any_ext_ci),
    "extension_filter_exact": _ext_query(_any_ext_cs),
    "route_counts": f"""{EVERY},
  processed AS (SELECT full_path FROM lake WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = lake.doc_id))
SELECT route, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM processed p WHERE p.full_path = lake.full_path) THEN 'skip'
              WHEN file_size >= {ROUTE_THRESHOLD} THEN 'large' ELSE 'small' END AS route, file_size FROM lake)
GROUP BY route""",
    "unique_sizes": f"{EVERY} SELECT DISTINCT file_size FROM lake",
    "size_groups": f"""{EVERY} SELECT file_size, count(*) AS n_files, min(doc_id) AS first_position, max(doc_id) AS last_position
FROM lake GROUP BY file_size""",
    "prefix_groups": f"""{EVERY} SELECT file_size, prefix_hash, count(*) AS n_files FROM lake WHERE prefix_hash IS NOT NULL
GROUP BY file_size, prefix_hash""",
    "full_groups": f"""{EVERY} SELECT full_hash, count(*) AS n_files, max(doc_id) AS doc_id FROM lake
WHERE full_hash IS NOT NULL GROUP BY full_hash""",
    "stage1_unique": f"""{LL} SELECT doc_id, file_size FROM lake
WHERE NOT EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size)""",
    "stage1_candidates": f"""{LL} SELECT doc_id, file_size FROM lake
WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size)""",
    "stage2_library_pruned": f"""{LL},
  cand AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size))
SELECT doc_id, file_size FROM lib WHERE EXISTS (SELECT 1 FROM cand WHERE cand.file_size = lib.file_size)""",
    "stage2_unique": f"""{LL},
  cand AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size))
SELECT doc_id, file_size, prefix_hash FROM cand
WHERE prefix_hash IS NULL OR NOT EXISTS (SELECT 1 FROM lib WHERE lib.file_size = cand.file_size AND lib.prefix_hash = cand.prefix_hash)""",
    "stage2_candidates": f"""{LL},
  cand AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size))
SELECT doc_id, file_size, prefix_hash FROM cand
WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = cand.file_size AND lib.prefix_hash = cand.prefix_hash)""",
    "stage3_library_pruned": f"""{LL2},
  cand2 AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size AND lib.prefix_hash = lake.prefix_hash))
SELECT doc_id, file_size, prefix_hash FROM lib
WHERE EXISTS (SELECT 1 FROM cand2 WHERE cand2.file_size = lib.file_size AND cand2.prefix_hash = lib.prefix_hash)""",
    "stage3_unique": f"""{LL2},
  cand2 AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size AND lib.prefix_hash = lake.prefix_hash))
SELECT doc_id, full_hash FROM cand2 WHERE NOT EXISTS (SELECT 1 FROM lib WHERE lib.full_hash = cand2.full_hash)""",
    "stage3_duplicates": f"""{LL2},
  cand2 AS (SELECT * FROM lake WHERE EXISTS (SELECT 1 FROM lib WHERE lib.file_size = lake.file_size AND lib.prefix_hash = lake.prefix_hash))
SELECT doc_id, full_hash FROM cand2 WHERE EXISTS (SELECT 1 FROM lib WHERE lib.full_hash = cand2.full_hash)""",
    "missing_keep": f"""{LL2}, {NULLED}, {_classified('lakeN', 'libN', 'keep')}
SELECT doc_id, stage, processing_status FROM c WHERE stage IN ('size', 'prefix', 'full')""",
    "missing_drop": f"""{LL2}, {NULLED}, {_classified('lakeN', 'libN', 'drop')}
SELECT doc_id, stage, processing_status FROM c WHERE stage IN ('size', 'prefix', 'full')""",
    "cascade_flags": f"""{LL2}, {NULLED}, {_classified('lakeN', 'libN', 'drop')}
SELECT doc_id, stage, stage_no, processing_status FROM c""",
    "lookup_size": f"""{LL},
  g AS (SELECT file_size, count(*) AS library_matches, min(doc_id) AS library_doc_id FROM lib GROUP BY file_size)
SELECT lake.doc_id, g.library_matches, g.library_doc_id FROM lake JOIN g ON g.file_size = lake.file_size""",
    "lookup_prefix": f"""{LL},
  g AS (SELECT file_size, prefix_hash, count(*) AS library_matches, min(doc_id) AS library_doc_id FROM lib
        WHERE prefix_hash IS NOT NULL GROUP BY file_size, prefix_hash)
SELECT lake.doc_id, g.library_matches, g.library_doc_id FROM lake
JOIN g ON g.file_size = lake.file_size AND g.prefix_hash = lake.prefix_hash""",
    "lookup_full": f"""{LL},
  g AS (SELECT full_hash, max(doc_id) AS library_doc_id FROM lib WHERE full_hash IS NOT NULL GROUP BY full_hash)
SELECT lake.doc_id, g.library_doc_id FROM lake JOIN g ON g.full_hash = lake.full_hash""",
    "matched_in_library": f"""{LL2}, {_classified('lake', 'lib', 'keep')},
  g AS (SELECT full_hash, max(doc_id) AS library_doc_id FROM lib WHERE full_hash IS NOT NULL GROUP BY full_hash)
SELECT c.doc_id, g.library_doc_id FROM c JOIN g ON g.full_hash = c.full_hash WHERE c.stage = 'duplicate'""",
    "stage_summary": f"""{LL2}, {_classified('lake', 'lib', 'keep')}
SELECT stage, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM c GROUP BY stage""",
    "side_summary": f"""{LL}
SELECT 'lake' AS side, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM lake
UNION ALL
SELECT 'library' AS side, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM lib""",
    "dedup_summary": f"""{MISSING_PLAIN}, {_tiered('missing')}
{DEDUP_SUMMARY}""",
    "dedup_content_summary": f"""{MISSING_PLAIN}, {_content('missing')}
{DEDUP_SUMMARY}""",
    "dedup_tiered": f"""{MISSING_PLAIN}, {_tiered('missing')}
SELECT doc_id, stage, method FROM r WHERE rn = 1""",
    "duplicates_report": f"""{MISSING_PLAIN}, {_tiered('missing')}
{REPORT_SELECT}""",
    "dedup_content": f"""{MISSING_PLAIN}, {_content('missing')}
SELECT doc_id, stage FROM r WHERE rn = 1""",
    "duplicates_report_content": f"""{MISSING_PLAIN}, {_content('missing')}
{REPORT_SELECT}""",
    "resume_anti": f"""{EVERY},
  processed AS (SELECT full_path FROM lake WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = lake.doc_id))
SELECT doc_id FROM lake WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.full_path = lake.full_path)""",
    "resume_merge": f"""{MISSING_PLAIN},
  prior AS (
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY full_hash ORDER BY stage_no, full_path, doc_id) AS rn
      FROM missing WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE rn = 1),
  ranked AS (
    SELECT m.doc_id, m.stage, row_number() OVER (PARTITION BY full_hash ORDER BY p.doc_id IS NULL, stage_no, full_path, m.doc_id) AS rn
    FROM missing m LEFT JOIN prior p ON p.doc_id = m.doc_id)
SELECT doc_id, stage FROM ranked WHERE rn = 1""",
    "ingest_two_waves": f"""{LL}
SELECT file_size, full_hash, CAST(1 AS BIGINT) AS n_recorded, count(*) AS n_items FROM lake l
WHERE NOT EXISTS (SELECT 1 FROM lib b WHERE b.full_hash = l.full_hash AND b.doc_id % 10 <> 0) GROUP BY file_size, full_hash""",
    "ingest_changes": f"""{LL},
  contents AS (
    SELECT DISTINCT file_size, full_hash,
      EXISTS (SELECT 1 FROM lib b WHERE b.full_hash = l.full_hash AND b.doc_id % 6 <> 0) AS had,
      EXISTS (SELECT 1 FROM lib b WHERE b.full_hash = l.full_hash AND b.doc_id % 10 <> 0) AS has FROM lake l)
SELECT CAST(CASE WHEN has THEN -1 ELSE 1 END AS INTEGER) AS sign, file_size, full_hash FROM contents WHERE had <> has""",
    "manifest_rejects": f"""{MANIFEST_TEXT}
SELECT relative_path, file_size, reason FROM tf WHERE reason IS NOT NULL""",
    "manifest_parsed": f"""{MANIFEST_TEXT}
SELECT relative_path, filename, CAST(file_size AS BIGINT) AS file_size, full_path,
       lower({_suffix("regexp_extract(full_path, '[^/]*$')")}) AS file_extension
FROM tf WHERE reason IS NULL""",
    "manifest_count": f"""{MANIFEST_TEXT}
SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS valid,
       count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM tf""",
    "copy_plan_skip": PLAN_SKIP,
    "copy_plan_overwrite": PLAN_OVERWRITE,
    "copy_plan_rename": PLAN_RENAME,
    "copy_plan_rename_ties": PLAN_RENAME_TIES,
    "copy_plan_overwrite_ties": PLAN_OVERWRITE_TIES,
    "lookup_size_members": f"{LL} SELECT doc_id, file_size FROM lib WHERE file_size IN (SELECT file_size FROM lake)",
    "lookup_prefix_members": f"""{LL} SELECT doc_id, file_size, prefix_hash FROM lib
WHERE EXISTS (SELECT 1 FROM lake WHERE lake.file_size = lib.file_size AND lake.prefix_hash = lib.prefix_hash)""",
    "content_hashes_md5": "SELECT doc_id, md5(encode(text)[1:1024]) AS prefix_hash, md5(encode(text)) AS full_hash FROM documents",
    "processed_set": f"{MANIFEST_TEXT} SELECT DISTINCT full_path FROM t WHERE full_path IS NOT NULL",
    "copy_summary": f"""{PLAN_RENAME_CTE},
  pl AS ({_plan_select('name', 'o')})
SELECT count(*) AS total, count(*) FILTER (WHERE success) AS success,
       count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
       count(*) FILTER (WHERE outcome = 'failed') = 0 AS ok FROM pl""",
    "analyze_documents": f"""{MISSING_ALT}, {_content('missing')}
SELECT relative_path, filename, file_size, full_path, stage FROM r WHERE rn = 1""",
    "analyze_documents_tiered": f"""{MISSING_ALT}, {_tiered('missing')}
SELECT relative_path, filename, file_size, full_path, stage FROM r WHERE rn = 1""",
    "analyze_pages": f"""WITH lake AS ({_pages(1, '/lake/pages')}), lib AS ({_pages(0, '/library/pages')}),
  {_classified('lake', 'lib', 'keep')},
  missing AS (SELECT * FROM c WHERE stage IN ('size', 'prefix', 'full')), {_content('missing')}
SELECT page_id, file_size, full_path, stage FROM r WHERE rn = 1""",
    "analyze_against_benchmark": f"""WITH mk AS ({_mk('documents')}),
  lake AS (SELECT *, '/lake/' || relative_path AS full_path FROM mk),
  lib AS (SELECT item_id AS doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
                 sha256(encode(text)[1:1024]) AS prefix_hash, sha256(encode(text)) AS full_hash FROM benchmark),
  {_classified('lake', 'lib', 'keep')}
SELECT stage, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM c GROUP BY stage""",
    "stage1_dedup_counts": f"""{LL},
  {_classified('lake', 'lib', 'keep')},
  s1 AS (SELECT * FROM c WHERE stage = 'size')
SELECT count(*) AS stage1_unique, count(DISTINCT full_hash) AS distinct_contents,
       count(DISTINCT file_size) AS kept_by_size_only FROM s1""",
    "analyze_conversations": f"""WITH lake AS ({_conv(1, '/lake')}), lib AS ({_conv(0, '/library')}),
  {_classified('lake', 'lib', 'keep')},
  missing AS (SELECT * FROM c WHERE stage IN ('size', 'prefix', 'full')), {_content('missing')}
SELECT conv_id, turn, file_size, stage FROM r WHERE rn = 1""",
}
