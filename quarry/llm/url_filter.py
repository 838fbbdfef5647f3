"""URL filters [native]: rules indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run a regular expression.

Before an expression runs, a candidate's host and the literal beginning of its
path are looked at, so few are compiled.

A rule has an action (allow or block), a host and a path.  It fits its host and
all subdomains (an empty host: every host) when the URL's path starts with its
path, in which ``*`` stands for any run of characters.  Tokens are runs of
characters other than ``./?=&#:*`` that delimiters bound on both sides, tagged
``h`` for host and ``p`` for path.  Of a rule's tokens the index takes the one
that the fewest distinct URL rows hold, counted over all URLs, so a rule's
expression runs on as few of them as possible; a rule without a whole token is
filed under the empty token, which every URL has.  The rule with the longest
host and path wins, then the one first by text; without a rule the verdict is
``default``.

The rule index is broadcast only when it was counted to have at most
``BROADCAST_RULES`` rows; a larger one joins by shuffle.

Defined cases: a null URL and one without ``://`` have an empty host and path,
and get ``default`` (unless a rule has neither host nor path); repeated rows are
judged once and returned as often as they came; other columns are not touched;
without rules all rows get ``default``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

BROADCAST_RULES = 100_000
_SPLIT = r"[./?=&#:*]+"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(text: Column, tag: str) -> Column:
    return F.transform(F.filter(F.split(text, _SPLIT), lambda t: t != ""), lambda t: F.concat(F.lit(tag), t))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), _tokens(host, "h"), _tokens(path, "p")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) of each rule as a table."""
    if not rules:
        return spark.sql("SELECT '' AS action, '' AS host, '' AS path WHERE false")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])))


def _quoted(text: Column) -> Column:
    """``text`` for a regular expression, with ``*`` as any run."""
    return F.replace(F.regexp_replace(text, r"([^A-Za-z0-9*])", r"\\$1"), F.lit("*"), F.lit(".*"))


def compiled(rules: DataFrame) -> DataFrame:
    """action, rule, pattern, host, head (the path up to its first ``*``) and the whole literal tokens of each distinct rule; the pattern is for ``host + '\\n' + path``."""
    r = rules.select("action", lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    any_host, whole = F.col("host") == "", F.regexp_extract("path", r"(?s)^(.*[./?=&#:])[^./?=&#:]*$", 1)  # a path's last run may go on in the URL
    cut = F.regexp_replace(whole, r"[^./?=&#:]*\*[^./?=&#:]*", "")
    pattern = F.concat(F.lit("(?s)^"), F.when(any_host, F.lit("[^\n]*")).otherwise(F.concat(F.lit("(?:[^\n]*\\.)?"), _quoted(F.col("host")))), F.lit("\n"), _quoted(F.col("path")))
    head = F.substring_index("path", "*", 1)
    return r.select("action", F.concat("host", "path").alias("rule"), pattern.alias("pattern"), "host", head.alias("head"), F.concat(_tokens(F.col("host"), "h"), _tokens(cut, "p")).alias("tokens"))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """token and its rules array<struct<action, rule, pattern, host, head>>: each rule under its token with the fewest ``urls`` (a column ``_tokens``)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("_tokens").alias("token")).join(_sized(wanted), "token", "left_semi").groupBy("token").count()
    best = rules.select("action", "rule", "pattern", "host", "head", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    chosen = best.groupBy("action", "rule", "pattern", "host", "head").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("_best"))
    return chosen.groupBy(F.col("_best.token").alias("token")).agg(F.collect_list(F.struct("action", "rule", "pattern", "host", "head")).alias("rules"))


def _sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has at most BROADCAST_RULES rows; a rule's rows are short."""
    return F.broadcast(df) if df.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of every row of ``pages``."""
    rows = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("_tokens", url_tokens(F.col("host"), F.col("path")))
    rules = compiled(rules)
    index = materialise(rule_index(rules, rows), "rules").withColumnRenamed("token", "_token")
    fetched = rows.select("_key", "host", "path", F.posexplode("_tokens").alias("_pos", "_token")).join(_sized(index), "_token", "left")
    subject = F.concat(F.translate("host", "\n", " "), F.lit("\n"), F.col("path"))
    fits = F.filter(F.coalesce("rules", F.expr("cast(array() AS array<struct<action: string, rule: string, pattern: string, host: string, head: string>>)")), lambda r: F.endswith(F.col("host"), r["host"]) & F.startswith(F.col("path"), r["head"]) & F.rlike(subject, r["pattern"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("order"), r["rule"].alias("rule"), r["action"].alias("action"))))
    judged = fetched.groupBy("_key", "host", "path").agg(F.min(best).alias("_best"), F.sum(F.when(F.col("_pos") == 0, 1).otherwise(0)).alias("_rows"))
    return judged.select(F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")
