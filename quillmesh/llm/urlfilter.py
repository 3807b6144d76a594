"""URL filters by host-suffix and path-prefix expressions.

A rule names a host and a path. It fits a URL whose host is the rule's host or
one of its subdomains and whose path starts with the rule's path. Each URL is
expanded into every ``host suffix + path prefix`` it could be listed under; the
first 32 bits of the SHA-256 of an expression are the join key, and a hit counts
only when the whole digest agrees. Of the rules that fit, the longest decides.

Everything is built-in expressions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (about 120 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    all_of = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_of))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge every URL of ``pages`` by ``rules`` (action, host, path).

    Returns one row per row of ``pages``: id_col, host, path, rule, verdict.
    ``rule`` is host + path of the longest rule that fits, or null; ``verdict``
    is its action, or ``default``. Of rules equally long the one with the longer
    host wins, then the lower action by name, so that allow precedes block.

    A null URL, or one without ``://``, has empty host and path, fits no rule and
    gets the default. Rules with a null in any field, or an empty host, fit
    nothing. Repeated rows, repeated ids and null ids are each judged; other
    columns are left out, so their names cannot clash. Empty tables are fine.
    """
    spark = pages.sparkSession
    rule = rules.select(*(column(rules, c).alias(c) for c in ("action", "host", "path"))).where("action is not null and path is not null and host != ''")
    rule = rule.select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    # One number for each length of a path in the rules: at most as many as a URL has characters.
    depths = rule.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("d"), F.count("*").alias("n")).first()
    judged = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).cast("string").alias("url")).select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not depths["n"]:
        return judged.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    text = F.concat("rule_host", "rule_path")
    digest = rule.select("action", text.alias("rule"), F.length("rule_host").alias("host_len"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"))
    digest = digest.withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))

    # A URL listed many times is looked up once: the hot hosts of a crawl shrink before the join.
    sites = judged.select("host", "path").where("host != ''").distinct()
    cuts = F.array(*(F.lit(int(d)) for d in depths["d"]))
    site = sites.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    site = site.select("host", "path", "suffix", F.explode(F.filter(cuts, lambda d: d <= F.length("path"))).alias("depth"))
    site = site.select("host", "path", F.sha2(F.concat_ws("\n", "suffix", F.substring(F.col("path"), F.lit(1), F.col("depth"))), 256).alias("seen"))
    site = site.withColumn("prefix", F.conv(F.substring("seen", 1, 8), 16, 10).cast("long"))
    hits = site.join(F.broadcast(digest) if depths["n"] <= broadcast_rules else digest, "prefix").where(F.col("seen") == F.col("digest"))
    order = F.struct(-F.length("rule"), -F.col("host_len"), "action", "rule")
    best = hits.groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    # A page without a host fits nothing; there may be any number, and they would share one key.
    out = judged.where("host != ''").join(best, ["host", "path"], "left").unionByName(judged.where("host = ''"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
