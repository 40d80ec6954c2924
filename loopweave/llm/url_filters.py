"""URL rules by hashed expressions: expand, join on short prefixes, confirm, choose.

Every rule is an expression ``host + path``. A URL is expanded into its host's
suffixes of as many labels, times its path's prefixes of as many characters, as
occur among the rules, so its expansion is in proportion to its length. Expressions meet rules in an equi-join on the first bytes of
their SHA-256; the full digests and the expressions themselves confirm; the
longest rule wins. Only distinct (host, path) pairs that met a rule are grouped,
and grouping keeps one row per task and pair, so a hot host or URL is no hot task.

Defined cases: a null url, or one without ``://``, has an empty host and path and
meets no rule; without a rule the verdict is ``allow``; of fitting rules of equal
length, the one with the longer host wins, then ``block``; rules that repeat count
once; rows that repeat are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hexadecimal digits of the short key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER),
                      F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def expressions(host: Column, path: Column, labels: list[int], lengths: Column) -> Column:
    """array<struct(host, path)>: suffixes of the host times prefixes of the path."""
    suffixes = F.filter(F.array(*[F.when(labels_of(host) >= n, F.substring_index(host, ".", -n))
                                  for n in labels]), lambda h: h.isNotNull())
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)),
                           lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    ``rules`` has host, path and verdict. Its distinct path lengths and numbers of host
    labels (a few, however many rules there are) limit the expansion.
    """
    listed = rules.select("host", "path", "verdict").distinct().withColumn(
        "sha", digest(F.concat("host", "path"))).select(
        F.substring("sha", 1, PREFIX).alias("short"), F.col("sha").alias("rule_sha"),
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()
               if r.n is not None]
    labels = [r.n for r in rules.select(labels_of(F.col("host")).alias("n")).distinct().collect()
              if r.n is not None]
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    if not lengths or not labels:
        return rows.select("*", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    sized = F.array(*[F.lit(n) for n in sorted(lengths)])
    tried = (rows.filter("host != ''").select("host", "path", F.explode(
        expressions(F.col("host"), F.col("path"), sorted(labels), sized)).alias("e"))
        .withColumn("sha", digest(F.concat("e.host", "e.path")))
        .withColumn("short", F.substring("sha", 1, PREFIX)))
    fits = ((F.col("sha") == F.col("rule_sha")) & (F.col("e.host") == F.col("rule_host"))
            & (F.col("e.path") == F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
                    F.col("verdict"))  # 'block' sorts after 'allow'
    met = (tried.join(listed, "short").filter(fits)
           .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
           .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"),
                         rank).alias("best")))
    judged = rows.join(met, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")),
                       "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
