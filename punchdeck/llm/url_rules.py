"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that every match must hold whole. Of
these the one found in the fewest URLs becomes the rule's index token; a URL's tokens fetch the rules indexed
under them, and only fetched rules run their expression. Of the rules that match, the one of the highest rank wins
(ties: the longer expression, then the rule's name). Everything is a DataFrame expression.

While there are at most ``LITERAL_RULES`` rules the index is a map in the plan and each URL fetches its rules inside
its own row, so no page is shuffled. A longer list is joined with the exploded tokens of the distinct URLs: broadcast
up to ``BROADCAST_RULES`` rows, shuffled beyond. Token counts come from all URLs, summed before the shuffle.

Cases: a null URL or one without ``://`` has an empty host and path and no rule; a rule without a literal token is
tried on every URL; each row of pages gives one row, however often it repeats; empty tables give an empty
result; other columns are not read, so clashing names do no harm; a very long URL is judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LITERAL_RULES, BROADCAST_RULES = 256, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY = ""


@dataclass(frozen=True)
class Rule:
    rule: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    verdict: str


def site_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start with the rule's; longer rules rank higher.

    The last token of the path may go on in the URL, so only tokens before a delimiter are literal.
    """
    host, slash, path = rule.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.translate(str.maketrans(UPPER, LOWER)))
    return Rule(rule, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole), len(rule), verdict)


def pattern_rule(name: str, pattern: str, tokens: Sequence[str], verdict: str) -> Rule:
    """A free expression, below every site rule. ``tokens``: lower-case tokens that each match holds whole."""
    return Rule(name, pattern, tuple(tokens), 0, verdict)


def lower(c: Column) -> Column:
    """A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a table of literals, for short lists; long lists are read from a table of the same schema."""
    rows = [F.struct(F.lit(r.rule), F.lit(r.pattern), F.array(*map(F.lit, r.tokens)).cast("array<string>"), F.lit(r.rank), F.lit(r.verdict)) for r in rules]
    if not rows:
        return spark.sql("SELECT '' rule, '' pattern, array('') tokens, 0 rank, '' verdict").limit(0)
    return spark.range(1).select(F.inline(F.array(*rows))).toDF("rule", "pattern", "tokens", "rank", "verdict")


def indexed(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """``(token, rule, pattern, rank, verdict)``: each rule under the token of its own that the fewest URLs hold."""
    literal = rules.select("rule", F.explode_outer(F.filter("tokens", lambda t: t != "")).alias("token"))
    held = urls.select(F.explode(tokens_of(F.concat("host", "path"))).alias("token"))
    seen = held.join(broadcast_if(literal.select("token").distinct(), n_rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(rarest, "rule").select(F.coalesce("best.token", F.lit(ANY)).alias("token"), "rule", "pattern", "rank", "verdict")


def fetching(index: DataFrame) -> Column:
    """The rules that the tokens of a row's host and path fetch from a short index."""
    rules: dict[str, list] = {}
    for r in index.collect():  # at most ``LITERAL_RULES``
        rules.setdefault(r.token, []).append(F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.pattern)).alias("long"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")))
    pairs = [x for token, found in rules.items() for x in (F.lit(token), F.array(*found))]
    fetched = F.transform(F.concat(F.array(F.lit(ANY)), tokens_of(F.concat("host", "path"))), lambda t: F.try_element_at(F.create_map(*pairs), t))
    return F.flatten(F.filter(fetched, lambda x: x.isNotNull()))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern_rule)``; ``rule`` is the site rule that decided, if one did."""
    url = F.col("url")
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    urls = urls.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    told = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    n_rules = rules.count()
    index = indexed(urls, rules, n_rules)
    if not n_rules:
        judged = urls.withColumn("best", F.lit(None).cast("struct<rank:int,long:int,rule:string,verdict:string>"))
    elif n_rules <= LITERAL_RULES:
        hits = F.filter(fetching(index), lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
        judged = urls.withColumn("best", F.when(told, F.array_max(F.transform(hits, lambda r: F.struct(r["rank"], r["long"], r["rule"], r["verdict"])))))
    else:
        once = urls.filter(told).select("url", "host", "path").distinct()
        fetched = once.withColumn("token", F.explode(F.concat(F.array(F.lit(ANY)), tokens_of(F.concat("host", "path"))))).join(broadcast_if(index, n_rules), "token")
        found = fetched.filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        best = found.groupBy("url").agg(F.max(F.struct("rank", F.length("pattern").alias("long"), "rule", "verdict")).alias("best"))
        judged = urls.join(best, "url", "left")
    return judged.select(
        F.col("page_id").alias(id_column), "host", "path",
        F.when(F.col("best.rank") > 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("best.rank") == 0, F.col("best.rule")).alias("pattern_rule"),
    )


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df
