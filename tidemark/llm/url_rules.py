"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict.  Its literal tokens (runs of
letters and digits that every matching url must contain as whole tokens) are known; how many urls
hold each of them is counted in Spark, and the rule is filed under the rarest.  Each url's tokens then
fetch the rules filed under them, and only those run their expressions.  A rule without a literal
token cannot be filed and is tried on every url.

Host rules (host and path prefix; the longest that fits decides) come before pattern rules.

Defined results: a NULL url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; of pattern rules that fit, any block wins; of host rules of equal length the first by text
wins; repeated urls each get their row; an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: most rules whose index is sent to every task; beyond, the index is joined by a shuffle
SEND_LIMIT = 50_000

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    """``pattern``: regular expression for ``host + path``; ``tokens``: literal tokens of every match;
    ``text``: the rule as written; ``rank``: 0 for pattern rules, else the host rule's length."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    text: str
    rank: int = 0


def literal_tokens(*literals: str) -> tuple[str, ...]:
    return tuple(sorted({t for s in literals for t in re.findall(r"[a-z0-9]+", s.lower())}))


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits the host and its subdomains where the url's path starts with ``path``."""
    whole = path if path.endswith("/") else path[: path.rfind("/") + 1]  # a last piece may go on in the url
    # paths keep their case, tokens are folded: only folded tokens are compared
    return UrlRule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", literal_tokens(host, whole), f"{host}{path}", len(host) + len(path))


def word_rule(verdict: str, words: str) -> UrlRule:
    """Fits urls that hold the words, in this order, with single separators between them."""
    parts = re.findall(r"[a-z0-9]+", words.lower())
    return UrlRule(verdict, r"(?i)(?:^|[^a-z0-9])" + r"[^a-z0-9]".join(parts) + r"(?:$|[^a-z0-9])", tuple(sorted(set(parts))), words)


# fixed values: the rules of the registered query
HOST_RULES = (
    host_rule(ALLOW, "com", "/"),
    host_rule(BLOCK, "example.com", "/en/"),
    host_rule(ALLOW, "www.example.com", "/en/"),
    host_rule(BLOCK, "net", "/es/"),
    host_rule(BLOCK, "net", "/fr/"),
)
#: the method's own rules, where no host rule fits
WORD_RULES = tuple(word_rule(BLOCK, w) for w in ("spam-farm", "casino", "porn", "xxx", "viagra", "payday-loans", "free-download", "wp-login", "phishing", "malware"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(F.lower(F.concat(host, F.lit("/"), path)), r"[^a-z0-9]+", " "), " "))


def rule_index(urls: DataFrame, rules: tuple[UrlRule, ...]) -> list[tuple[str | None, UrlRule]]:
    """(rarest token, rule).  Only the rules' own tokens are counted."""
    vocabulary = sorted({t for r in rules for t in r.tokens})
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    wanted = F.broadcast(wanted) if len(vocabulary) <= SEND_LIMIT else wanted
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    n = {r["token"]: r["count"] for r in seen.toLocalIterator()}  # one row per token of a rule
    return [(min(r.tokens, key=lambda t: (n.get(t, 0), t)) if r.tokens else None, r) for r in rules]


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[UrlRule, ...] = HOST_RULES, other_rules: tuple[UrlRule, ...] = WORD_RULES,
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule`` (the host rule that decides),
    ``verdict`` and ``pattern_rules`` (the other rules that fit)."""
    spark = pages.sparkSession
    rules = (*host_rules, *other_rules)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    # each different url is judged once
    urls = rows.select("url").where("url is not null").distinct()
    host, path = host_and_path(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path")).where("host <> '' or path <> ''")
    urls = urls.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    filed = rule_index(urls, rules)
    index = spark.createDataFrame(
        [(token, i, r.verdict, r.pattern, r.text, r.rank) for i, (token, r) in enumerate(filed)],
        "token string, number int, verdict string, pattern string, text string, rank int",
    )
    small = len(rules) <= SEND_LIMIT
    send = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    fetched = urls.select("url", F.concat("host", "path").alias("place"), F.explode("tokens").alias("token")).join(send(index.where("token is not null")), "token")
    free = [r for token, r in filed if token is None]
    if free:
        every = F.array(*[F.struct(*[F.lit(getattr(r, k)).alias(k) for k in ("verdict", "pattern", "text", "rank")]) for r in free])
        extra = urls.select("url", F.concat("host", "path").alias("place"), F.explode(every).alias("r")).select("url", "place", "r.*")
        fetched = fetched.select("url", "place", "verdict", "pattern", "text", "rank").unionByName(extra)
    fits = fetched.where(F.expr("place rlike pattern"))
    by_url = fits.groupBy("url").agg(
        F.max(F.when(F.col("rank") > 0, F.struct("rank", "text", "verdict"))).alias("best"),
        F.sort_array(F.collect_set(F.when(F.col("rank") == 0, F.col("text")))).alias("pattern_rules"),
        F.max(F.when(F.col("rank") == 0, F.col("verdict"))).alias("other"),  # "block" after "allow"
    )
    host, path = host_and_path(F.col("url"))
    joined = rows.join(by_url, "url", "left")
    return joined.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.col("best.text").alias("rule"),
        F.coalesce("best.verdict", "other", F.lit(ALLOW)).alias("verdict"),
        F.coalesce("pattern_rules", F.array().cast("array<string>")).alias("pattern_rules"),
    )
