"""Cluster profiles: sizes, crosstabs, tests of association, percentages, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.functions.numeric import round_half_even
from facetloom.operators.lookups import fits_broadcast, lookup
from facetloom.session import pin

#: Bits that a pass of a median adds to the digits found; a group has at most 2^bits cells.
DIGIT_BITS = 16


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster, null cluster included."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Cell counts ``cluster, feature, value, n`` of all features in one pass.

    Rows with a null on either side are left out. Only cells that occur are listed.
    """
    texts = df.select(
        F.col(cluster).alias("cluster"),
        *[F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(features)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"_f{i}").alias("value"))
            for i, c in enumerate(features)
        ]
    )
    return (
        texts.where(F.col("cluster").isNotNull())
        .select("cluster", F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("cluster", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: From here on the uniform expansion is exact to about 1e-9.
LARGE_GAMMA = 1e5


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if a > LARGE_GAMMA:
        return _upper_gamma_large(a, x)
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        step = a
        while abs(term) > abs(total) * 1e-17:
            step += 1.0
            term *= x / step
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in count(1):
        weight = -i * (i - a)
        b += 2.0
        d = 1.0 / (weight * d + b or tiny)
        c = b + weight / c or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value


def _upper_gamma_large(a: float, x: float) -> float:
    """The same for large ``a``: the first two terms of the uniform expansion."""
    mu = x / a - 1.0
    eta = math.copysign(math.sqrt(2.0 * max(0.0, mu - math.log1p(mu))), mu)
    # Near 0 the difference of the inverses is taken from its series.
    first = -1 / 3 + eta / 12 - 2 * eta * eta / 135 if abs(mu) < 1e-3 else 1.0 / mu - 1.0 / eta
    tail = 0.5 * math.erfc(eta * math.sqrt(a / 2.0))
    return min(1.0, max(0.0, tail + math.exp(-a * eta * eta / 2.0) * first / math.sqrt(2.0 * math.pi * a)))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail probability of the chi-square distribution; one value per feature."""
    return pd.Series(
        [
            None if pd.isna(x) or pd.isna(k) else 1.0 if k == 0 else _upper_gamma(k / 2.0, x / 2.0)
            for x, k in zip(chi2, dof, strict=True)
        ],
        dtype="float64",
    )


def _over(value: Column, by: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return value / F.nullif(by, F.lit(0.0))


def association_parts(
    df: DataFrame, features: Sequence[str], cluster: str, cells: DataFrame | None = None
) -> DataFrame:
    """Per feature: ``n``, rows and columns of the crosstab, chi-square with its correction.

    The crosstab stays in long form. Cells that do not occur count through exact integer
    totals of each row, so nothing is made dense and no digits cancel at large n. ``cells`` may give a
    crosstab that was made before.
    """
    cells = crosstab(df, features, cluster) if cells is None else cells
    by_row = cells.groupBy("feature", "cluster").agg(F.sum("n").alias("row_n"))
    by_value = cells.groupBy("feature", "value").agg(F.sum("n").alias("value_n"))
    totals = by_row.groupBy("feature").agg(
        F.sum("row_n").alias("total"), F.count(F.lit(1)).alias("rows")
    )
    # AQE broadcasts the totals by their measured size; the value side is hashed on
    # (feature, value), of which no key has more rows than there are clusters.
    expected = F.col("row_n") * F.col("value_n").cast("double") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    seen = (
        cells.join(by_value, ["feature", "value"])
        .join(by_row.join(totals, "feature"), ["feature", "cluster"])
        .groupBy("feature", "cluster")
        .agg(
            F.sum(gap * gap / expected).alias("seen"),
            F.sum("value_n").alias("covered"),
            F.max(gap).alias("gap"),
            F.max("value_n").alias("value_max"),
            F.first("row_n").alias("row_n"),
            F.first("total").alias("total"),
        )
    )
    unseen = F.col("row_n") * (F.col("total") - F.col("covered")).cast("double") / F.col("total")
    values = by_value.groupBy("feature").agg(F.count(F.lit(1)).alias("cols"))
    parts = (
        seen.groupBy("feature")
        .agg(
            F.sum(F.col("seen") + unseen).alias("plain"),
            F.max("gap").alias("gap"),
            F.max("value_max").alias("value_max"),
            F.max("row_n").alias("row_max"),
            F.first("total").alias("n"),
            F.count(F.lit(1)).alias("rows"),
        )
        .join(values, "feature")
    )
    # In a 2x2 table all four gaps are equal, and the inverse expected counts add up to
    # n^3 over the product of the four margins.
    n = F.col("n").cast("double")
    margins = (
        F.col("row_max").cast("double") * (n - F.col("row_max"))
        * F.col("value_max").cast("double") * (n - F.col("value_max"))
    )
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = shrunk * shrunk * _over(n * n * n, margins)
    two_by_two = (F.col("rows") == 2) & (F.col("cols") == 2)
    return parts.select(
        "feature",
        "n",
        "rows",
        "cols",
        F.when(two_by_two, corrected).otherwise(F.col("plain")).alias("chi2"),
    )


def chi_square(
    df: DataFrame, features: Sequence[str], cluster: str = "cluster", cells: DataFrame | None = None
) -> DataFrame:
    """Tests of each feature against the cluster.

    ``feature, chi2, dof, p_value, cramers_v, effect``: chi-square with the continuity
    correction for 2x2 tables, bias-corrected Cramér's V (null where its denominator is
    not positive) and the plain V. A feature without any cell has nulls.
    """
    parts = association_parts(df, features, cluster, cells)
    names = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    n = F.col("n").cast("double")
    r, k = F.col("rows").cast("double"), F.col("cols").cast("double")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - _over((k - 1) * (r - 1), n - 1))
    r_corrected = r - _over((r - 1) * (r - 1), n - 1)
    k_corrected = k - _over((k - 1) * (k - 1), n - 1)
    room = F.least(k_corrected - 1, r_corrected - 1)
    v = F.when((n > 1) & (room > 0), F.sqrt(phi2 / room))
    effect = F.sqrt(F.col("chi2") / n / F.nullif(F.least(r - 1, k - 1), F.lit(0.0)))
    return (
        F.broadcast(names)
        .join(parts, "feature", "left")
        .select(
            "feature",
            "chi2",
            dof.cast("bigint").alias("dof"),
            chi_square_tail("chi2", dof.cast("double")).alias("p_value"),
            v.alias("cramers_v"),
            effect.alias("effect"),
        )
    )


def order_tests(tests: DataFrame) -> DataFrame:
    """By p-value, nulls last."""
    return tests.orderBy(F.asc_nulls_last("p_value"), "feature")


def diag_profiles(tests: DataFrame) -> DataFrame:
    """``feature, type, p_value, effect`` of categorical tests, by p-value."""
    return order_tests(tests).select(
        "feature", F.lit("categorical").alias("type"), "p_value", "effect"
    )


def strongest_associations(tests: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` features by Cramér's V, nulls last."""
    return tests.orderBy(F.desc_nulls_last("cramers_v"), "feature").limit(top)


def value_profiles(
    df: DataFrame,
    features: Sequence[str],
    cluster: str = "cluster",
    zeros: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """``cluster, feature, value, pct``: percentage of each value within a cluster.

    Rows with a null value do not count. Only values that occur in a cluster are listed: the table grows with the
    cells, not with clusters times values. With ``zeros`` the values that a cluster lacks are listed with 0.
    ``cells`` may give a crosstab that was made before.
    """
    cells = crosstab(df, features, cluster) if cells is None else cells
    by_row = cells.groupBy("feature", "cluster").agg(F.sum("n").alias("row_n"))
    if zeros:
        values = cells.select("feature", "value").distinct()
        # The result itself is values x clusters; the cluster side is small or salted.
        grid = lookup(values, by_row, ["feature"], "inner", spread_by=["value"], pinned=True)
        listed = grid.join(cells, ["feature", "cluster", "value"], "left")
    else:
        listed = lookup(cells, by_row, ["feature", "cluster"], "inner", spread_by=["value"], pinned=True)
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("row_n") * F.lit(100.0)
    return listed.select("cluster", "feature", "value", round_half_even(share, 2).alias("pct"))


def order_profiles(profiles: DataFrame) -> DataFrame:
    """By feature, cluster, highest percentage, value."""
    return profiles.orderBy("feature", "cluster", F.desc("pct"), "value")


def _ordered_bits(values: pd.Series) -> pd.Series:
    """Doubles as whole numbers in the same order; both zeros are one."""
    bits = (values.to_numpy(dtype="float64") + 0.0).view("int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def _from_bits(keys: pd.Series) -> pd.Series:
    """The doubles back."""
    bits = keys.to_numpy(dtype="int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view("float64"))


def exact_medians(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """``cluster, column, median`` with exact medians of large groups.

    Radix selection for all groups at once: values become whole numbers of 64 bits in the same order, and
    each of four passes counts those that share the digits found so far by their next ``DIGIT_BITS`` bits.
    Counts are summed in the tasks, so a group is never held in one place, sorted or sketched.
    """
    to_key = F.pandas_udf(_ordered_bits, "bigint")
    to_value = F.pandas_udf(_from_bits, "double")
    groups = ["cluster", "column"]
    long = pin(
        df.where(F.col(cluster).isNotNull())
        .select(
            F.col(cluster).alias("cluster"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"), F.col(c).cast("double").alias("x")
                        )
                        for c in columns
                    ]
                )
            ),
        )
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
        .select(*groups, to_key("x").alias("key"))
    )
    rows = F.count(F.lit(1))
    none = F.lit(0).cast("bigint")
    # Of each middle value the digits found so far, and its rank among the values that share them.
    state = pin(
        long.groupBy(*groups).agg(
            none.alias("low"), F.floor((rows + 1) / 2).alias("low_rank"),
            none.alias("high"), (F.floor(rows / 2) + 1).alias("high_rank"),
        )
    )
    few = fits_broadcast(state)

    def with_state(rows: DataFrame) -> DataFrame:
        """The state has a line for each group in every pass, so its size is checked once."""
        return rows.join(F.broadcast(state), groups) if few else lookup(rows, state, groups, "inner", spread_by=["key"])

    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        shared = shift + DIGIT_BITS
        found = none if shared == 64 else F.shiftright("key", shared)
        cells = (
            with_state(long.select(*groups, "key", found.alias("found")))
            .where((F.col("found") == F.col("low")) | (F.col("found") == F.col("high")))
            .groupBy(*groups, "found", F.shiftright("key", shift).alias("digits"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        upto = Window.partitionBy(*groups, "found").orderBy("digits")
        ranked = cells.withColumn("last", F.sum("n").over(upto)).withColumn("key", F.col("digits"))
        counted = with_state(ranked)

        def at(side: str) -> Column:
            """The first digits that reach the rank, and the rank among their values."""
            rank = F.col(f"{side}_rank")
            reached = (F.col("found") == F.col(side)) & (F.col("last") >= rank)
            return F.min(F.when(reached, F.struct("digits", (rank - F.col("last") + F.col("n")).alias("rank"))))

        state = pin(
            counted.groupBy(*groups)
            .agg(at("low").alias("l"), at("high").alias("h"))
            .select(
                *groups, F.col("l.digits").alias("low"), F.col("l.rank").alias("low_rank"),
                F.col("h.digits").alias("high"), F.col("h.rank").alias("high_rank"),
            )
        )
    return state.select(*groups, ((to_value("low") + to_value("high")) / 2).alias("median"))


def without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def numeric_summary(
    df: DataFrame, columns: Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """``cluster`` and ``<col>_mean, _std, _median, _min, _max`` per numeric column.

    Sample standard deviation (null for one row), exact median, null cluster left out. NaN
    counts as null.
    """
    numbers = df.where(F.col(cluster).isNotNull()).select(
        F.col(cluster).alias("cluster"), *[without_nan(F.col(c).cast("double")).alias(c) for c in columns]
    )
    stats = numbers.groupBy("cluster").agg(
        *[
            agg
            for c in columns
            for agg in (
                F.avg(c).alias(f"{c}_mean"),
                F.stddev_samp(c).alias(f"{c}_std"),
                F.min(c).alias(f"{c}_min"),
                F.max(c).alias(f"{c}_max"),
            )
        ]
    )
    medians = (
        exact_medians(numbers, columns)
        .groupBy("cluster")
        .agg(
            *[
                F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{c}_median")
                for c in columns
            ]
        )
    )
    kinds = ("mean", "std", "median", "min", "max")
    return stats.join(medians, "cluster", "left").select(
        "cluster", *[f"{c}_{kind}" for c in columns for kind in kinds]
    )
