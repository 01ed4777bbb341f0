"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table; the columns a query adds are derived from the operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import find_matches
from .fim import fill_in_middle, restored
from .langid import identify
from .line_dedup import dedup_lines
from .ngram_join import similar_groups
from .packing import pack
from .pages import main_text
from .quality import quality
from .runs import periodic_runs
from .substring import repeated_passages
from .tables import scratch_path
from .token_file import read_documents, write_token_ids
from .url_rules import judge
from .warc import audit, layout

# pieces of the DuckDB statements
_SPLIT = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_read(spark, sf_dir, "documents"), size=4, num=85, den=100)


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM doc_windows JOIN item_windows USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("matches", "spans", "longest_match")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents")).drop("removed_spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = identify(docs, docs.where(~_held_out()))
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "pages")).drop("pattern_rules")


OP6_SQL = """
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.v, length(r.h || r.p) AS n
  FROM split s LEFT JOIN rules r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND starts_with(s.path, r.p))
SELECT page_id, host, path, arg_max(rule, n) AS rule,
  coalesce(arg_max(v, n), CASE WHEN regexp_matches(any_value(host || path),
    '(?i)(^|[^a-z0-9])(spam[^a-z0-9]farm|casino|porn|xxx|viagra|payday[^a-z0-9]loans|free[^a-z0-9]download|wp[^a-z0-9]login|phishing|malware)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM fits GROUP BY page_id, host, path
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP3_SQL = rf"""
WITH pieces AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> '')),
lines AS (
  SELECT doc_id, n, w, row_number() OVER (ORDER BY doc_id, n) AS place
  FROM (SELECT doc_id, n, regexp_extract_all(line, {_SPLIT}) AS w FROM pieces) WHERE len(w) >= 1),
same AS (SELECT array_to_string(w, ' ') AS k, min(place) AS place FROM lines GROUP BY k),
short AS (SELECT place, array_to_string(w, ' ') AS s FROM lines WHERE len(w) < 8 AND length(array_to_string(w, ' ')) >= 16),
forms AS (
  SELECT place, array_to_string(list_concat(list_concat(w[1:i - 1], [chr(9)]), w[i + 1:]), ' ') AS k
  FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS i FROM lines WHERE len(w) >= 8)
  UNION ALL
  SELECT place, array_to_string(list_concat(list_concat(w[1:i], [chr(9)]), w[i + 1:]), ' ') AS k
  FROM (SELECT place, w, unnest(range(0, len(w) + 1)) AS i FROM lines WHERE len(w) >= 8)
  UNION ALL SELECT place, s[1:i - 1] || chr(10) || s[i + 1:] AS k FROM (SELECT place, s, unnest(range(1, length(s) + 1)) AS i FROM short)
  UNION ALL SELECT place, s[1:i] || chr(10) || s[i + 1:] AS k FROM (SELECT place, s, unnest(range(0, length(s) + 1)) AS i FROM short)),
near AS (SELECT k, min(place) AS place FROM forms GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT l.place FROM lines l JOIN same s ON s.k = array_to_string(l.w, ' ') WHERE s.place < l.place
  UNION SELECT f.place FROM forms f JOIN near n USING (k) WHERE n.place < f.place),
marked AS (SELECT p.doc_id, p.n, p.line, g.place IS NOT NULL AS gone FROM pieces p LEFT JOIN lines l USING (doc_id, n) LEFT JOIN gone g ON g.place = l.place),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(done.text, '')) AS text_md5
FROM documents d LEFT JOIN done USING (doc_id)
"""


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the archive of all pages; the second has lost some records and has a wrong
    byte in the middle of others."""
    html = F.coalesce("html", F.lit(""))
    middle = (F.length(html) / 2).cast("int") + 1
    damaged = (
        F.when(F.col("page_id") % 503 == 11, F.lit(None).cast("string"))
        .when(F.col("page_id") % 211 == 7, F.overlay(html, F.lit("\x01"), middle, F.lit(1)))
        .otherwise(html)
    )
    place = layout(_read(spark, sf_dir, "pages"), replica_html=damaged)
    return audit(place, place.withColumn("digest", F.col("replica_digest")))


OP4_SQL = r"""
WITH crlf AS (SELECT chr(13) || chr(10) AS e),
pages_b AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    CASE WHEN page_id % 503 = 11 THEN NULL WHEN page_id % 211 = 7
      THEN substr(html, 1, length(html) // 2) || chr(1) || substr(html, length(html) // 2 + 2) ELSE coalesce(html, '') END AS other FROM pages),
records AS (
  SELECT DISTINCT page_id, url,
    'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
      || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' AS head, html, other, e FROM pages_b, crlf),
hashed AS (
  SELECT page_id, url, sha256(head || strlen(html) || e || e || html || e || e) AS digest, strlen(head || strlen(html) || e || e || html || e || e) AS length,
    sha256(head || strlen(other) || e || e || other || e || e) AS replica FROM records),
placed AS (
  SELECT *, ('0x' || substr(digest, 1, 12))::BIGINT % greatest(1, (SELECT (count(*) + 499) // 500 FROM hashed)) AS file FROM hashed),
laid AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id, url, digest) - length)::BIGINT AS "offset" FROM placed)
SELECT file, "offset", length, CASE WHEN replica IS NULL THEN 'missing' ELSE 'changed' END AS kind, digest AS first_digest, replica AS second_digest
FROM laid WHERE replica IS DISTINCT FROM digest
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def _planted_periods(docs: DataFrame) -> DataFrame:
    """The documents of the query's contract: a tenth of them with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = docs.select("doc_id", "text", words.alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("long"))
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    split = split.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    periodic = F.concat_ws(" ", F.slice("w", 1, F.col("a").cast("int")), places)
    return split.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_planted_periods(_read(spark, sf_dir, "documents")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.l")
    return out.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"),
        F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


# crc32 bit by bit: a byte is taken in, then eight shifts
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS w, {_CRC32} AS h FROM documents),
n AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM n),
t AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w FROM a),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM stretches GROUP BY doc_id, s, length),
best AS (
  SELECT doc_id, count(*) AS n_runs, first(s ORDER BY length DESC, s, q) AS "start", max(length) AS length, first(q ORDER BY length DESC, s, q) AS period,
    string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS list FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, "start", length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(_read(spark, sf_dir, "documents"), seed="7", unit="line", rate=100, spm_rate=50)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(h1, h2)], '') AS pre, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS mid,
    array_to_string(u[greatest(h1, h2) + 1:], '') AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    written = write_token_ids(docs, scratch_path(spark, "token_ids"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(written, docs.schema["doc_id"].dataType.simpleString())


QUERIES = {
    f.__name__: f
    for f in (
        op2_best_fit_packing,
        op4_warc_fixity,
        op3_line_dedup,
        op6_url_filters,
        op7_html_extraction,
        op1_language_id,
        op5_quality_rules,
        op8_ngram_jaccard_join,
        op9_benchmark_decontamination,
        op10_substring_dedup,
        op11_periodic_runs,
        op12_fill_in_middle,
        op13_token_ids,
    )
}

ORACLE: dict[str, str] = {
    "op4_warc_fixity": OP4_SQL,
    "op3_line_dedup": OP3_SQL,
    "op6_url_filters": OP6_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
