"""URL filters by expanded expressions.

A URL is expanded into expressions: each suffix of its host with each prefix of
its path that is as long as some rule's path. The expressions meet the rules by
an equi-join on a short prefix of their SHA-256; the full digest confirms, and
the longest rule that fits wins. The plan has the same size for any rules; of
these the driver sees only the distinct lengths of their paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules broadcast up to this count (about 200 bytes each); beyond it the join shuffles.
RULES_BROADCAST = 100_000
#: Hexadecimal digits of the short prefix: 32 bits.
SHORT = 8
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url):
    """Host (A-Z in lower case) and path columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _AZ.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of pages by rules (host, path, verdict).

    A rule fits its host and all subdomains where the URL's path starts with
    the rule's path (which starts with /, or is empty); of those that fit the
    longest wins, and of equally long ones block before allow. One row per row
    of pages: page_id, host, path, rule (host and path joined; null if none
    fits) and verdict (the rule's, else default).

    A null URL or one without :// has an empty host and path, and no rule; a
    rule with a null or empty host fits nothing; A-Z in hosts are lower case, and
    no other letters change; equal rows are judged each for itself; an empty
    table, or no rules, is fine; further columns are ignored.
    """
    rules = rules.select(F.translate("host", _AZ, _AZ.lower()).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).filter("r_host <> ''")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block over allow
    n_rules, lengths = rules.agg(F.count("*"), F.array_sort(F.collect_set(F.length("r_path")))).first()
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("/"), path), 256)  # noqa: E731  a host has no slash
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, SHORT))
    rules = F.broadcast(rules) if n_rules <= RULES_BROADCAST else rules
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = url_parts(F.col("__url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", "\\."))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    made = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digest(h, p))))
    made = F.when(F.col("host") != "", made)
    rows = base.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.explode_outer(made).alias("digest"))
    met = rows.withColumn("short", F.substring("digest", 1, SHORT)).join(rules, "short", "left")
    fits = F.when(F.col("digest") == F.col("r_digest"), F.struct((F.length("r_host") + F.length("r_path")).alias("l"), F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
