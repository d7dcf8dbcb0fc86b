"""URL rules by host suffix and path prefix, found through short hash prefixes.

Each distinct (host, path) is expanded into its expressions: every suffix of
the host at label borders with every prefix of the path whose length some rule
has.  Expressions and rules meet in an equi-join on the first four bytes of
their SHA-256; the full digest then confirms a hit and the longest rule wins
(ties: longer host, then block before allow, then the rule's text).  Only
DataFrame functions are used.  Work grows with the number of distinct
addresses; a frequent address is expanded once, and the join back to the
pages can be split by Spark where one address is very frequent.

Defined results: a null url or one without ``://`` has an empty host and path,
matches nothing and gets ``default``; empty host labels are kept as they are;
equal rows stay equal rows; other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES = 4
#: Rules up to this many are sent to every executor (about 200 bytes each); more are shuffled.
BROADCAST_RULES = 10_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows with their digests."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _digest(host: Column, path: Column) -> Column:
    # A host has no "/", so the first one in a rule begins its path; "\n" keeps paths without it apart.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
    rules = rules.withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    facts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("sizes")).first()
    if facts["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    sizes = F.array(*[F.lit(x) for x in sorted(facts["sizes"])]) if facts["sizes"] else F.array().cast("array<int>")
    each = pages.where("host <> ''").select("host", "path").distinct()
    each = each.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    each = each.select("host", "path", "suffix", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))).alias("n"))
    each = each.select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), F.col("path").substr(F.lit(1), F.col("n"))), 256).alias("full"))
    hits = each.withColumn("short", F.substring("full", 1, 2 * PREFIX_BYTES)).join(rules, "short").where("full = digest")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("long"), F.length("rule_host").alias("host_long"), (F.col("verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
