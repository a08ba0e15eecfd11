"""Operator 10: URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could match: each host
suffix at a dot boundary with as many labels as some rule host, combined with
each path prefix as long as some rule path. Expressions meet the rules in an
equi-join on a short prefix of their SHA-256 digest; the full digest confirms
a hit and the longest rule wins. Built-in functions only.

Cases: a null url or one without ``://`` has empty host and path, matches no
rule and gets the default verdict; repeated rows are judged one by one; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8                              # 32 bits of the digest are the join key
# Fixed values of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT_VERDICT = "allow"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end, A-Z lowered) and path (then up to ? or #)."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict), one row per input row.

    ``rules`` is a configuration list of (verdict, host, path); only distinct
    label counts and path lengths of it steer the expansion, so a URL makes at
    most (label counts x path lengths) expressions however long it is."""
    spark = pages.sparkSession
    bad = [r for r in rules if r[0] not in ("allow", "block")]
    if bad:
        raise ValueError(f"verdict must be allow or block: {bad}")
    host, path = host_path(F.col("_url"))
    base = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    base = base.select("_key", "_url", host.alias("host"), path.alias("path"))
    if not rules:
        return base.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    rule_df = spark.createDataFrame([(h + p, v) for v, h, p in rules], "rule string, rule_verdict string") \
        .withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX)) \
        .groupBy("short", "digest", "rule").agg(F.min("rule_verdict").alias("rule_verdict"))
    # A suffix or prefix longer than the whole would repeat the whole: keep only exact sizes.
    suffix = F.array(*[F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n))
                       for n in labels])
    prefix = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    expr = base.filter("host <> ''").select("host", "path").distinct() \
        .withColumn("_s", F.explode(F.array_compact(suffix))) \
        .withColumn("_p", F.explode(F.array_compact(prefix))) \
        .withColumn("full", F.sha2(F.concat("_s", "_p"), 256)) \
        .withColumn("short", F.substring("full", 1, PREFIX_HEX)).drop("_s", "_p")
    hit = expr.join(rule_df, "short").filter(F.col("full") == F.col("digest"))
    best = hit.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.char_length("rule"), "rule")).alias("_r"))
    out = base.join(best, ["host", "path"], "left")
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_r.rule").alias("rule"),
                      F.coalesce(F.col("_r.rule_verdict"), F.lit(default)).alias("verdict"))
