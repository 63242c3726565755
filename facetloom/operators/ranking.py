"""Which features tell the personas apart."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.operators.blocks import blocks_of, unpacked
from facetloom.operators.forests import coded, codes_of, grow_forest, thresholds_of
from facetloom.operators.ordering import global_index
from facetloom.operators.profiles import crosstab
from facetloom.operators.features import vector_width
from facetloom.operators.trees import Tree, block_losses, features_of
from facetloom.session import pin

#: Bytes of a block's values, of one kind, that a task holds, and rows that make a block worth a pass of the forest.
HELD = 1 << 25
LEAST_ROWS = 1 << 12

def binned(
    df: DataFrame, columns: Sequence[str], bins: int = 10, method: str = "width"
) -> DataFrame:
    """Replace numeric columns by their bin number.

    ``width`` cuts the range into equal parts, ``quantile`` at approximate quantiles. A
    constant column has one bin. Edges come from one aggregate.
    """
    if method == "width":
        edges = df.agg(
            *[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns)
              for n, f in (("low", F.min), ("high", F.max))]
        ).first()
        out = {}
        for i, c in enumerate(columns):
            low, high = edges[f"low{i}"], edges[f"high{i}"]
            if low is None or low == high:
                out[c] = F.when(F.col(c).isNotNull(), F.lit(0))
            else:
                place = F.floor((F.col(c) - F.lit(low)) * F.lit(float(bins)) / F.lit(high - low))
                out[c] = F.least(place, F.lit(bins - 1)).cast("int")
        return df.withColumns(out)
    if method != "quantile":
        raise ValueError(f"unknown binning method: {method}")
    shares = [i / bins for i in range(1, bins)]
    cuts = df.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    out = {}
    for i, c in enumerate(columns):
        place = F.lit(0)
        for cut in sorted(set(cuts[f"q{i}"] or [])):
            place = place + (F.col(c) > F.lit(cut)).cast("int")
        out[c] = F.when(F.col(c).isNotNull(), place)
    return df.withColumns(out)


def mutual_information(
    df: DataFrame, features: Sequence[str], label: str = "persona_id", top: int = 30
) -> DataFrame:
    """``feature, score, rank``: mutual information with the label in nats.

    The plug-in estimate over the values as they are; bin numeric columns first. Equal
    scores keep the order of ``features``.
    """
    return _most_informative(crosstab(df, features, label), [(c, c) for c in features], top)


def vector_information(
    df: DataFrame,
    names: Sequence[str],
    label: str = "persona_id",
    features: str = "features",
    bins: int = 10,
    top: int = 30,
) -> DataFrame:
    """``feature, score, rank``: mutual information with the label of every vector position.

    The range of each position is cut into ``bins`` equal parts; a constant position scores
    0, and NaN is left out. One pass finds the ranges, another counts the stored entries in the tasks.
    ``names`` holds a name per position; names may repeat, and equal scores keep their order.
    """
    rows = df.select(F.col(label).alias("cluster"), features).dropna()
    if rows.isEmpty():
        low = high = [0.0] * len(names)
    else:
        summary = Summarizer.metrics("min", "max").summary(F.col(features))
        low, high = rows.select(summary.alias("s")).select("s.min", "s.max").first()
    if len(names) != len(low):
        raise ValueError("names must match the width of the feature vectors")
    lows, widths = np.array(low), np.array(high) - np.array(low)
    cells = _histograms(rows, features, lows, widths, bins).select(
        "cluster", F.col("position").cast("string").alias("feature"), F.col("bin").alias("value"), "n"
    )
    return _most_informative(cells, [(str(i), name) for i, name in enumerate(names)], top)


def _bins(x: np.ndarray, low: np.ndarray, width: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each value in its position's range; 0 in a constant position, -1 for NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        place = np.floor((x - low) * float(bins) / width)
    place = np.where(width > 0, np.minimum(place, bins - 1), 0.0)
    return np.where(np.isnan(x), -1.0, place).astype(np.int64)


def _histograms(rows: DataFrame, features: str, low: np.ndarray, width: np.ndarray, bins: int) -> DataFrame:
    """``cluster, position, bin, n``: the values of every vector position by bin and cluster.

    Stored entries are counted in the tasks; a zero that is not stored follows from the rows of the cluster
    less the entries. Only cells are shuffled.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((low, width))
    cluster = rows.schema["cluster"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, width = sent.value
        for batch in batches:
            labels = batch.column("cluster").dictionary_encode()
            code = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for part, block in blocks_of(batch):
                if block.at is None:
                    at = np.tile(np.arange(len(low)), block.rows)
                    values, owner = block.values.ravel(), np.repeat(code[part], len(low))
                else:
                    at, values, owner = block.at, block.values, code[part][block.row_of()]
                key = (owner * len(low) + at) * (bins + 1) + _bins(values, low[at], width[at], bins) + 1
                found, n = np.unique(key, return_counts=True)
                whole, bin_ = np.divmod(found, bins + 1)
                owner, at = np.divmod(whole, max(1, len(low)))
                yield pa.RecordBatch.from_arrays(
                    [labels.dictionary.take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(bin_ - 1, pa.int32()), pa.array(n)],
                    names=["cluster", "position", "bin", "n"],
                )

    kind = T.StructType([
        T.StructField("cluster", cluster), T.StructField("position", T.IntegerType()),
        T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType()),
    ])
    stored = pin(
        unpacked(rows, features, "cluster").mapInArrow(count, kind)
        .groupBy("cluster", "position", "bin").agg(F.sum("n").alias("n"))
    )
    # One row per position of the vector, and one per cluster and position.
    zero = _bins(np.zeros(len(low)), low, width, bins)
    spans = spark.createDataFrame([(i, int(b)) for i, b in enumerate(zero)], "position int, bin int")
    everywhere = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).select(
        "cluster", "rows", F.explode(F.sequence(F.lit(0), F.lit(len(low) - 1)) if len(low) else F.array().cast("array<int>")).alias("position")
    )
    seen = stored.groupBy("cluster", "position").agg(F.sum("n").alias("seen"))
    rest = (
        everywhere.join(seen, ["cluster", "position"], "left")
        .select("cluster", "position", (F.col("rows") - F.coalesce("seen", F.lit(0))).alias("n"))
        .where("n > 0")
        .join(F.broadcast(spans), "position")
        .select("cluster", "position", "bin", "n")
    )
    return stored.where("bin >= 0").unionByName(rest).groupBy("cluster", "position", "bin").agg(F.sum("n").alias("n"))


def _most_informative(cells: DataFrame, names: Sequence[tuple[str, str]], top: int) -> DataFrame:
    """The ranking by the cells ``cluster, feature, value, n``; ``names`` pairs feature and name."""
    by_row = cells.groupBy("feature", "cluster").agg(F.sum("n").alias("row_n"))
    by_value = cells.groupBy("feature", "value").agg(F.sum("n").alias("value_n"))
    totals = by_row.groupBy("feature").agg(F.sum("row_n").alias("total"))
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    joint = n * total / (F.col("row_n").cast("double") * F.col("value_n"))
    scores = (
        cells.join(by_value, ["feature", "value"])
        .join(by_row.join(totals, "feature"), ["feature", "cluster"])
        .groupBy("feature")
        .agg(F.sum(n / total * F.ln(joint)).alias("score"))
    )
    listed = cells.sparkSession.createDataFrame(
        [(i, *pair) for i, pair in enumerate(names)], "position int, feature string, name string"
    )
    scored = F.broadcast(listed).join(scores, "feature", "left").select(
        F.col("name").alias("feature"),
        "position",
        F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"),
    )
    return top_features(scored, top)


def top_features(scores: DataFrame, top: int = 30) -> DataFrame:
    """``feature, score, rank`` of the ``top`` scores; equal scores keep their position."""
    best = scores.orderBy(F.desc("score"), "position").limit(top)
    ranks = Window.orderBy(F.desc("score"), "position")
    return best.select("feature", "score", F.row_number().over(ranks).alias("rank"))


def _affine_shuffle(rows: int, rng: random.Random) -> tuple[int, int]:
    """A step and a shift so that position -> (step * position + shift) mod rows is one to one."""
    step = rng.randrange(1, rows) if rows > 1 else 1
    while math.gcd(step, rows) != 1:
        step = rng.randrange(1, rows)
    return step, rng.randrange(rows)


def _losses(
    table: DataFrame, thresholds: list[np.ndarray], used: list[int], sents: list[Broadcast], shuffles: list[tuple[int, int]],
    rows: int, classes: int,
) -> list[tuple[int, int]]:
    """Each used feature and what its shuffles lose, in rows, by the groups of trees that were sent."""
    width, repeats, all_features = len(used), len(shuffles), len(thresholds)
    placed = global_index(coded(table, "_x", thresholds, used), ["_id"], "at")
    wide = F.col("at").cast("decimal(38,0)")
    targets = [((wide * F.lit(step) + F.lit(shift)) % F.lit(rows)).cast("bigint") for step, shift in shuffles]
    # As many rows as memory allows; fewer, if there are cores without a block.
    cores = table.sparkSession.sparkContext.defaultParallelism
    most = max(1, HELD // max(width * -(-repeats // 8) * 8, 8 * repeats, 8 * classes))
    size = min(most, max(LEAST_ROWS, -(-rows // (2 * cores))))
    blocks = -(-rows // size)
    # A row goes to its own block, and as a donor to those of its targets.
    dealt = placed.select("_label", "codes", F.posexplode(F.array("at", *targets)).alias("slot", "at")).select(
        (F.col("at") / F.lit(size)).cast("int").alias("block"), "*"
    )

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renamed = np.full(all_features, -1)
        renamed[used] = np.arange(width)

        def trees() -> Iterator[Tree]:
            for sent in sents:
                for _, top, parts in sent.value:
                    yield Tree.unpacked(top, parts, all_features, classes, renamed)
                if getattr(sent, "_path", None):
                    # One group at a time is in memory; it is read again from the executor's disk.
                    vars(sent).pop("_value", None)

        total = np.zeros(width, dtype=np.int64)
        last = held = None
        for batch in batches:
            block, at, slot, label = (batch.column(c).to_numpy() for c in ("block", "at", "slot", "_label"))
            codes = codes_of(batch.column("codes"), width)
            for number in np.unique(block).tolist():
                if number != last:
                    if held:
                        total += block_losses(trees, *held, classes)
                    n, last = min(size, rows - number * size), number
                    held = np.empty((n, width), np.uint8), np.empty((n, width, repeats), np.uint8), np.empty(n, np.int64)
                own = np.flatnonzero((block == number) & (slot == 0))
                held[0][at[own] - number * size] = codes[own]
                held[2][at[own] - number * size] = label[own]
                others = np.flatnonzero((block == number) & (slot > 0))
                held[1][at[others] - number * size, :, slot[others] - 1] = codes[others]
        if held:
            total += block_losses(trees, *held, classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(used), pa.int32()), pa.array(total)], names=["feature", "lost"])

    after = (
        dealt.repartitionByRange(blocks, "block").sortWithinPartitions("block")
        .select("block", "at", "slot", "_label", "codes")
        .mapInArrow(lost, "feature int, lost long")
        .groupBy("feature").agg(F.sum("lost").alias("lost"))
    )
    # One row per feature.
    return [(r["feature"], r["lost"]) for r in after.collect()]


def permutation_importance(
    df: DataFrame,
    names: Sequence[str],
    label: str = "persona_id",
    row_id: str = "row_id",
    features: str = "features",
    repeats: int = 8,
    trees: int = 250,
    depth: int = 30,
    top: int = 30,
    seed: int = 42,
) -> DataFrame:
    """``feature, score, rank``: mean loss of accuracy of a random forest on its own rows
    when one feature is shuffled.

    Rows are coded by the thresholds that splits can have, and trees are grown in the tasks, see ``fit_forest``.
    Each repeat gives every row a donor row by its position; one shuffle brings rows and the donors of all repeats together in
    blocks. A row takes over one feature of its donor at a time. The forest is sent in groups of trees, which go past each
    block one tree at a time, see ``block_losses``; neither the driver nor a task holds it whole. A feature that no tree splits on cannot
    change a guess and scores 0.
    """
    spark = df.sparkSession
    width = vector_width(df, features)
    if len(names) != width:
        raise ValueError("names must match the width of the feature vectors")
    table = df.select(
        F.col(row_id).alias("_id"), F.col(label).cast("double").alias("_label"), F.col(features).alias("_x"),
    )
    known = F.col("_x").isNotNull() & F.col("_label").isNotNull() & (F.col("_label") >= 0) & (F.col("_label") == F.floor("_label"))
    rows, good, most = table.agg(F.count(F.lit(1)), F.count(F.when(known, 1)), F.max("_label")).first()
    if good < rows or not rows:
        raise ValueError("a forest needs rows, each with a feature vector and a whole label from 0 on")
    thresholds = thresholds_of(table.select("_x"), "_x", width)
    classes = int(most) + 1
    forest = grow_forest(table, "_x", "_label", thresholds, classes, trees, depth, seed)
    drops = dict.fromkeys(range(width), 0.0)
    if repeats and rows > 1:
        sents, used = [], set()
        for group in forest.groups():
            for _, head, parts in group:
                used |= {f for f, _ in head.splits.values()}
                used.update(*[features_of(p, width).tolist() for p in parts.values()])
            sents.append(spark.sparkContext.broadcast(group))
        if used:
            rng = random.Random(seed)
            shuffles = [_affine_shuffle(rows, rng) for _ in range(repeats)]
            for f, lost in _losses(table, thresholds, sorted(used), sents, shuffles, rows, classes):
                drops[f] = lost / rows / repeats
        for sent in sents:
            sent.destroy()
    scores = spark.createDataFrame(
        [(i, names[i], float(drops[i])) for i in range(width)],
        T.StructType([
            T.StructField("position", T.IntegerType()),
            T.StructField("feature", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]),
    )
    return top_features(scores, top)
