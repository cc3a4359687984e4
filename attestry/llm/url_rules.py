r"""Operator 13: pattern rules for URLs, indexed by their rarest literal token.

A rule is a pattern over host and path: literal text, ``*`` for anything, ``^`` for a sign that separates words or the end, ``||``
in front for the host or a domain above it, ``|`` in front or behind for the beginning or end. Its tokens are the runs of letters
and digits that a URL must hold as whole runs wherever the pattern matches. Each rule is filed under the token that the
fewest URLs hold; a URL's tokens fetch the rules filed under them, and only those run their regular expression. Rules
without any such token are filed under the empty one, which every URL has. All in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import small, table, written

RULES = "rule string, verdict string, site boolean"

#: Rules of the query by host and path, in the words of its contract.
SITES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: What no site rule knows: hosts of advertising, tracking, betting and the like are blocked, all else is allowed.
PATTERNS = [("||ads.*", "block"), ("||adserver.*", "block"), ("||casino-*", "block"), ("||free-bets.*", "block"), ("||track.*", "block"), ("||doubleclick.net^", "block"), ("||poker.*", "block"), ("^wp-login.php|", "block"), ("^banner^*^click^", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """The distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda t: t != ""))


def site_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules such as ``example.org/en``: that host and its subdomains, paths that begin so."""
    return spark.createDataFrame([(r, v, True) for r, v in rules], RULES)


def pattern_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(r, v, False) for r, v in rules], RULES)


def _quoted(text: Column) -> Column:
    """A literal as a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()+*?^$|&~#-])", r"\\$1")


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict, site, regex, tokens: the expression of each rule over host and path, and the tokens a URL must hold for it.

    A site rule's host and all its path but the last run are whole tokens, since host and path there are cut by signs; a
    pattern's run at an open end or beside ``*`` may be a part of a longer one, so it is none.
    """
    rule = F.col("rule")
    host, path = lower_ascii(F.substring_index(rule, "/", 1)), F.substring(rule, F.length(F.substring_index(rule, "/", 1)) + 1, F.length(rule))
    site = F.concat(F.lit(r"^(?s:(?:[^/]*\.)?"), _quoted(host), F.when(path == "", r"(?=/|$)").otherwise(_quoted(path)), F.lit(")"))
    body = F.regexp_replace(rule, r"^\|{1,2}|\|$", "")
    parts = F.transform(F.split(body, r"\*"), lambda p: F.array_join(F.transform(F.split(p, r"\^"), _quoted), r"(?:[^A-Za-z0-9_.%-]|$)"))
    start = F.when(rule.startswith("||"), r"^(?:[^/]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    end = F.when(rule.rlike(r"[^|]\|$"), "$").otherwise("")
    pattern = F.concat(F.lit("(?s)"), start, F.array_join(parts, ".*"), end)
    # Open ends get a letter, which makes the run there a longer one that the last step drops with its mark.
    marked = F.concat(F.when(rule.startswith("|"), "/").otherwise("\u0001"), F.replace(body, F.lit("*"), F.lit("\u0001")), F.when(rule.endswith("|"), "/").otherwise("\u0001"))
    whole = F.regexp_replace(lower_ascii(F.when(F.col("site"), F.concat(host, F.lit("/"), path, F.lit("\u0001"))).otherwise(marked)), "[a-z0-9]*\u0001[a-z0-9]*", "/")
    return rules.select("rule", "verdict", "site", F.when(F.col("site"), site).otherwise(pattern).alias("regex"), tokens(whole).alias("tokens"))


def indexed(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """token, rule, verdict, site, regex: each rule of ``rules`` under that of its tokens which the fewest ``subjects`` (tokens) hold.

    Ties go to the smaller token; a rule without tokens is filed under the empty one.
    """
    known = written(compiled(rules), "url-rules")
    asked = small(written(known.select(F.explode("tokens").alias("token")).distinct(), "url-rule-tokens"))
    counts = subjects.select(F.explode("tokens").alias("token")).join(asked, "token").groupBy("token").agg(F.count("*").alias("n"))
    each = known.select("rule", "verdict", "site", "regex", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")
    return each.groupBy("rule", "verdict", "site", "regex").agg(best).select(F.coalesce("best.token", F.lit("")).alias("token"), "rule", "verdict", "site", "regex")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row of ``pages`` (page_id, url), by ``rules`` (``RULES``).

    ``rule`` is the longest site rule that fits, ties to the smaller text, then to allow; its verdict holds. Where none fits, rule is null and the longest
    pattern (``pattern``) decides by the same order, else ``default``. Null URLs and those without ``://`` have an empty host and path;
    of them a rule without tokens may still hold. Repeated rows are judged each; other columns are left behind. Rules
    are matched to tokens by broadcast where they are few, else by a shuffle in which a frequent token's URLs may be split.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    subject = F.concat("host", "path")
    urls = urls.withColumn("tokens", tokens(subject))
    index = small(written(indexed(rules, urls), "url-index"))
    fetched = urls.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")).join(index, "token", "left")
    fits = F.regexp_like(subject, F.col("regex"))
    order = F.struct((-F.length("rule")).alias("size"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    best = lambda kind: F.min(F.when(fits & kind, order))
    found = fetched.groupBy("row", "page_id", "host", "path").agg(best(F.col("site")).alias("own"), best(~F.col("site")).alias("other"))
    return found.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "other.verdict", F.lit(default)).alias("verdict"), F.col("other.rule").alias("pattern"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` by ``SITES`` and ``PATTERNS``."""
    return judge(table(spark, sf_dir, "pages"), site_rules(spark, SITES).unionByName(pattern_rules(spark, PATTERNS)))


OP13_SQL = r"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), sites(h, p, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), patterns(rule, regex) AS (
  VALUES ('||ads.*', '^([^/]*\.)?ads\.'), ('||adserver.*', '^([^/]*\.)?adserver\.'), ('||casino-*', '^([^/]*\.)?casino-'), ('||free-bets.*', '^([^/]*\.)?free-bets\.'),
         ('||track.*', '^([^/]*\.)?track\.'), ('||doubleclick.net^', '^([^/]*\.)?doubleclick\.net([^A-Za-z0-9_.%-]|$)'), ('||poker.*', '^([^/]*\.)?poker\.'),
         ('^wp-login.php|', '([^A-Za-z0-9_.%-]|$)wp-login\.php$'), ('^banner^*^click^', '(?s)([^A-Za-z0-9_.%-]|$)banner([^A-Za-z0-9_.%-]|$).*([^A-Za-z0-9_.%-]|$)click([^A-Za-z0-9_.%-]|$)')
), judged AS (
  SELECT page_id, host, path,
         (SELECT arg_min(struct_pack(rule := h || p, verdict := verdict), struct_pack(a := -length(h || p), b := h || p)) FROM sites WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS own,
         (SELECT arg_min(rule, struct_pack(a := -length(rule), b := rule)) FROM patterns WHERE regexp_matches(host || path, regex)) AS pattern
  FROM urls
)
SELECT page_id, host, path, own.rule AS rule, CASE WHEN own IS NOT NULL THEN own.verdict WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM judged
"""
