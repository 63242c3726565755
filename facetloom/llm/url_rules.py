"""URL rules by a sort-merge range join.

The labels of a host in reverse order, each with a closing dot, make a key; all hosts below a
domain have keys that begin with the domain's key, so a rule covers an interval of keys. URLs are
range-partitioned by key, each rule goes to the parts its interval meets, and a sweep through
a sorted part keeps the stack of rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.session import pin

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A rules table: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The reversed labels, each closed by a dot; empty for no host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", "").otherwise(F.concat(F.concat_ws(".", labels), F.lit(".")))


class _Node:
    """The rules of one host: paths in order, each with the nearest rule that it extends."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.outer = key, [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in order; of equal ones the first stays."""
        if self.paths and self.paths[-1] == path:
            return
        outer = len(self.paths) - 1
        while outer >= 0 and not path.startswith(self.paths[outer]):
            outer = self.outer[outer]
        self.paths.append(path)
        self.rules.append((rule, verdict))
        self.outer.append(outer)

    def longest(self, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that ``path`` starts with."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.rules[at] if at >= 0 else None


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rules open the interval of their host; a URL closes those that end before it."""
    stack: list[_Node] = []
    part = None
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.part != part:
                part, stack = row.part, []
            while stack and not row.key.startswith(stack[-1].key):
                stack.pop()
            if row.rule is not None:
                if not stack or stack[-1].key != row.key:
                    stack.append(_Node(row.key))
                stack[-1].add(row.path, row.rule, row.verdict)
                continue
            found = [r for node in stack if (r := node.longest(row.path))] if row.key else []
            # Of equal lengths the more special host, which is higher on the stack.
            best = max(reversed(found), key=lambda r: len(r[0]), default=(None, None))
            out.append((None if row.page_id is None else int(row.page_id), row.host, row.path, *best))
        names = ["page_id", "host", "path", "rule", "verdict"]
        yield pd.DataFrame(out, columns=names, dtype=object)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The longest rule that fits each page's url: page_id, host, path, rule, verdict.

    ``rules`` has verdict, host and path; a rule fits its host and the hosts below it, if the
    url's path starts with its path. Longest goes by host and path together, of equal ones the
    longer host wins; of rules with the same host and path the smaller verdict. Null hosts or paths
    in a rule count as empty, and an empty host fits none. A url without ``://`` has an
    empty host and path and gets ``default`` like any that no rule fits. One row per page.
    """
    spark = pages.sparkSession
    urls = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    ).withColumn("key", host_key(F.col("host")))
    # The salt splits a url that very many pages share.
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    sorted_urls = pin(
        urls.withColumn("salt", salt)
        .repartitionByRange("key", "path", "salt")
        .withColumn("part", F.spark_partition_id())
    )
    # One row per shuffle part.
    spans = sorted_urls.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    spans = [tuple(r) for r in spans.orderBy("low", "high").collect()]
    lows, highs = [s[1] for s in spans], [s[2] for s in spans]

    @F.pandas_udf("array<int>")
    def met(keys: pd.Series) -> pd.Series:
        """Parts whose keys meet the interval of a rule's key."""
        out = []
        for key in keys:
            first = bisect_left(highs, key)
            end = bisect_left(lows, key + "\U0010ffff")
            out.append([spans[i][0] for i in range(first, end)])
        return pd.Series(out)

    named = rules.select(
        F.coalesce("host", F.lit("")).alias("_host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    ).withColumn("host", F.translate("_host", _UPPER, _UPPER.lower())).where("host != ''")
    opened = (
        named.withColumn("key", host_key(F.col("host")))
        .withColumn("part", F.explode(met("key")))
        .select(
            "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("page_id"),
            "host", "path", F.concat("host", "path").alias("rule"), "verdict",
        )
    )
    none = F.lit(None).cast("string")
    rows = sorted_urls.select(
        "part", "key", F.lit(1).alias("kind"), F.col("page_id").cast("string"), "host", "path",
        none.alias("rule"), none.alias("verdict"),
    ).unionByName(opened)
    judged = (
        rows.repartition(max(len(spans), 1), "part")
        .sortWithinPartitions("part", "key", "kind", "path", "verdict")
        .select("part", "key", "page_id", "host", "path", "rule", "verdict")
        .mapInPandas(_sweep, "page_id long, host string, path string, rule string, verdict string")
    )
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
