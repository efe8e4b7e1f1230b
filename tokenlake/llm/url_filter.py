"""URL rules by host suffix and path prefix, in DataFrame functions only.

Each distinct (host, path) is expanded into the expressions it can fit: every suffix of its host
that begins after a dot and has no more labels than a rule's host, with every prefix of its path
whose length a rule has. Expressions and
rules are joined on the first characters of their SHA-256 digests; the full digests then confirm,
and of the rules that fit the longest expression wins, on equal expressions the one that blocks.

Verdict without a rule: `allow`, or the `otherwise` given. Defined results: a null URL or one without `://` has an
empty host and path, which fit no rule; repeated rows and null ids keep their rows; either
table may be empty; extra columns are not looked at; a URL of any length costs its own length for each of those suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url); rules(verdict, host, path)."""
    url = F.col("url")
    seen = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rules = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")).withColumn("digest", F.sha2("rule", 256))
    lengths = F.array_sort(F.collect_set("n"))
    sizes = rules.agg(lengths).scalar()  # one value: the path lengths that rules have
    most = rules.agg(F.max("labels")).scalar()  # no suffix of more labels than any rule's host has can fit
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.coalesce("most", F.lit(1)) + 1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    wanted = F.filter("sizes", lambda k: k <= F.length("path"))
    urls = seen.filter("host != ''").distinct().withColumn("sizes", sizes).withColumn("most", most)
    expressions = urls.select("host", "path", "most", F.explode(F.transform(wanted, lambda k: F.substring("path", F.lit(1), k))).alias("prefix")).select(
        "host", "path", F.explode(F.transform(suffixes, lambda s: F.concat(s, F.col("prefix")))).alias("expression")
    )
    expressions = expressions.withColumn("digest", F.sha2("expression", 256))
    near = expressions.join(
        rules.select("verdict", "rule", F.col("digest").alias("rule_digest"), F.substring("digest", 1, PREFIX).alias("short")),
        F.substring("digest", 1, PREFIX) == F.col("short"),
    )
    confirmed = near.filter((F.col("digest") == F.col("rule_digest")) & (F.col("expression") == F.col("rule")))
    best = confirmed.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == "block").alias("blocks"))).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.blocks"), "block").otherwise("allow").alias("ruled"))
    return seen.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(otherwise)).alias("verdict"))
