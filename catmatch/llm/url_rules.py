"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `.host/path` and the literal tokens (runs of ASCII
letters and digits) that any match must hold whole. A rule is filed under the one that the
fewest distinct URLs hold. The tokens of a URL fetch candidate rules, and only those run.

Defined cases: a null URL, or one without `://`, has an empty host and path and meets no
rule; equal URLs are judged once and all their rows stay; a rule without a whole token is
tried on every URL; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catmatch.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
_SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    rule: str
    verdict: str
    pattern: str
    tokens: list[str]
    base: bool


def whole_tokens(literal: str) -> list[str]:
    """Tokens of a literal that starts after a separator; its last one is whole only before a separator."""
    return sorted(set(re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", literal)))


def host_path_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`."""
    return Rule(host + path, verdict, rf"^[^/]*\.{re.escape(host)}{re.escape(path)}", whole_tokens(host + path), True)


def host_label_rule(label: str, verdict: str) -> Rule:
    """Fits every host that has the label anywhere."""
    return Rule(label, verdict, rf"^[^/]*\.{re.escape(label)}(?:[./]|$)", whole_tokens(label + "."), False)


#: (host, path, verdict); the longest that fits wins.
BASE_RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
#: Host labels of link farms and pill shops, blocked where no base rule fits.
BLOCKED_LABELS = ["spam-farm", "cheap-pills", "free-casino", "adult-chat"]


def default_rules() -> list[Rule]:
    return [host_path_rule(*rule) for rule in BASE_RULES] + [host_label_rule(x, BLOCK) for x in BLOCKED_LABELS]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _SPLIT_URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT_URL, 2), F.lit(""))


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with its rarest token; `tokens` has a row for each distinct URL and token.

    Only tokens that some rule holds are counted, so the counts are as few as the rules.
    """
    of_rules = rules.select("rule", F.explode("tokens").alias("token"))
    counts = (tokens.join(of_rules.select("token").distinct(), "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n")))
    rarest = (of_rules.join(counts, "token", "left").groupBy("rule")
              .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token")))
    return (rules.join(rarest, "rule", "left")
            .select(F.coalesce("token", F.lit("")).alias("token"), "rule", "verdict", "pattern", "base"))


def judge_urls(spark: SparkSession, urls: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """urls with host and path → distinct (host, path), rule, verdict.

    The longest base rule decides; where none fits, the longest other rule, then `default`.
    """
    schema = "rule string, verdict string, pattern string, tokens array<string>, base boolean"
    table = spark.createDataFrame([tuple(r) for r in rules], schema)
    targets = (urls.select("host", "path").distinct()
               .withColumn("target", F.concat(F.lit("."), F.col("host"), F.col("path"))))
    tokens = targets.select("host", "path", "target", F.explode(
        F.array_distinct(F.split("target", "[^A-Za-z0-9]+"))).alias("token"))  # the part before the first dot is empty
    index = index_rules(table, tokens.filter(F.col("token") != ""))
    hit = F.struct(F.length("rule").alias("length"), "rule", "verdict")
    found = (tokens.join(index, "token").filter(F.expr("rlike(target, pattern)")).groupBy("host", "path")
             .agg(F.max(F.when(F.col("base"), hit)).alias("base"), F.max(F.when(~F.col("base"), hit)).alias("other")))
    return found.select("host", "path", F.col("base.rule").alias("rule"),
                        F.coalesce("base.verdict", "other.verdict", F.lit(default)).alias("verdict"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule] | None = None, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (of the base rules, else null) and verdict for every page row."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judge_urls(spark, parts, default_rules() if rules is None else rules, default)
    return (parts.join(judged, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
