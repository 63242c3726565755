"""Mixing sources by temperature: how often every document is seen, and where.

Source weights are the token shares to the power of an exponent, normalised. The exponent is
found by bisection, as the smallest (the flattest mix) that keeps to a limit of repetitions, or
the largest that reaches a target entropy. Weights become documents by block permutations: a
source runs through whole epochs of its documents in the order of a keyed hash, and a last,
partial epoch up to its budget.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches, whole_row
from facetloom.llm.packing import WordIds
from facetloom.operators.lookups import lookup
from facetloom.session import pin

REPETITIONS = 1.5
BLOCKS = 1024
SEED = "mix"
SLICES = 4096
_BISECTIONS = 50
_UNIT = 1 << 32


def word_count(text: Column) -> Column:
    """Words between runs of ASCII white space; 0 for null, empty or blank."""
    flat = text
    for mark in "\t\n\x0b\f\r":
        flat = F.replace(flat, F.lit(mark), F.lit(" "))
    # Few texts have two blanks in a row; only those need the slower pattern.
    single = F.when(flat.contains("  "), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)
    bare = F.trim(single)
    words = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    return F.when(F.char_length(bare) > 0, words).otherwise(0).cast("long")


def _place(doc_id: Column, *more: Column) -> Column:
    """A keyed uniform whole number below 2**32."""
    said = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-")), *more)
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def fit_exponent(
    sources: DataFrame, repetitions: float | None = REPETITIONS, entropy: float | None = None
) -> float:
    """Bisect the exponent over the sources' ``tokens``, in [0, 1].

    With ``repetitions``: the smallest exponent at which no source is seen more than so many
    times while the source that is seen least is seen once. With ``entropy`` (in nats): the
    largest exponent whose weights have that entropy at least (0 if none has). Each step sums over the
    sources table, which stays distributed.
    """
    log = F.ln(F.col("tokens").cast("double"))
    least, top = sources.agg(F.min(log), F.max(log)).first()
    if top is None:
        return 1.0
    if entropy is None:
        # A source is seen in proportion to its tokens to the power of the exponent less one.
        return _bisect(lambda e: (1.0 - e) * (top - least) <= math.log(repetitions), 1.0, 0.0)

    def reaches(exponent: float) -> bool:
        scaled = F.lit(exponent) * (log - F.lit(top))
        total, mean = sources.agg(F.sum(F.exp(scaled)), F.sum(scaled * F.exp(scaled))).first()
        return math.log(total) - mean / total >= entropy

    return _bisect(reaches, 0.0, 1.0)


def _bisect(holds: Callable[[float], bool], good: float, bad: float) -> float:
    """The last exponent on the way from ``good`` to ``bad`` for which ``holds`` is true."""
    if holds(bad):
        return bad
    for _ in range(_BISECTIONS):
        middle = (good + bad) / 2
        good, bad = (middle, bad) if holds(middle) else (good, middle)
    return good


def mix(
    docs: DataFrame,
    tokens: Column | None = None,
    tie: Column | None = None,
    repetitions: float | None = REPETITIONS,
    entropy: float | None = None,
    budget: float | None = None,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Repeat the rows of ``docs`` by the weight of their source.

    Adds ``_epoch`` (from 0) and ``_block`` (from 0), the block of the mixed order that a
    row falls in; each block holds the sources by their weights. ``budget`` is the number of tokens
    of the mix; without one it is the smallest that leaves no document out. A source's last epoch takes the
    documents whose hash comes first, while the tokens before them are below the rest of the
    budget. Rows without a token (null or blank text) take no budget and come once, in epoch
    0; a null source is a source of its own; rows that are alike share their place. ``tokens`` and
    ``tie`` (what tells rows of one doc_id apart) are taken from the text by default.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    tie = F.md5("text") if tie is None else tie
    rows = docs.select(
        whole_row(docs).alias("_row"),
        source_key(F.col("source")).alias("_source"),
        tokens.alias("_tokens"),
        _place(F.col("doc_id"), F.coalesce(tie, F.lit("-"))).alias("_at"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"),
    )
    light = pin(rows.where(F.col("_tokens") > 0).select("_source", "_tokens", "_at", "_doc"))
    # Tokens by source and slice of the hash; slices are whole parts of the permutation.
    slice_ = F.floor(F.col("_at") * F.lit(SLICES) / F.lit(_UNIT)).cast("int")
    cells = pin(
        light.groupBy("_source", slice_.alias("_cell")).agg(F.sum("_tokens").alias("tokens"))
    )
    sources = pin(cells.groupBy("_source").agg(F.sum("tokens").alias("tokens")))
    exponent = fit_exponent(sources, repetitions, entropy)
    weight = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    total = sources.agg(F.sum(weight)).first()[0] or 1.0
    share = sources.withColumn("weight", weight / F.lit(total))
    if budget is None:
        budget = share.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    times = F.round(F.lit(budget) * F.col("weight") / F.col("tokens"), 9)
    plan = share.select("_source", times.alias("_times"), F.col("tokens").alias("_size"))
    plan = pin(plan.withColumn("_left", (F.col("_times") - F.floor("_times")) * F.col("_size")))

    # The slice in which the last epoch ends, and in it the last row that the epoch takes.
    running = Window.partitionBy("_source").orderBy("_cell")
    ends = (
        cells.withColumn("_before", F.sum("tokens").over(running) - F.col("tokens"))
        .join(plan, "_source")
        .where(F.col("_before") < F.col("_left"))
        .groupBy("_source", "_left")
        .agg(F.max_by(F.struct("_cell", "_before"), "_cell").alias("_end"))
        .select("_source", "_left", "_end._cell", "_end._before")
    )
    order = ["_at", "_doc", "_tokens"]
    inside = lookup(
        light.withColumn("_slice", slice_), ends, ["_source"], how="inner", spread_by=["_at"], pinned=True
    )
    inside = inside.where(F.col("_slice") == F.col("_cell")).groupBy("_source", "_before", "_left", *order)
    along = Window.partitionBy("_source").orderBy(*order)
    last = (
        inside.agg(F.sum("_tokens").alias("_here"))
        .withColumn("_before", F.col("_before") + F.sum("_here").over(along) - F.col("_here"))
        .where(F.col("_before") < F.col("_left"))
        .groupBy("_source")
        .agg(F.max(F.struct(*order)).alias("_last"))
    )
    plan = plan.join(last, "_source", "left").select("_source", "_times", "_last")
    placed = lookup(rows, plan, ["_source"], spread_by=["_at"], pinned=True)
    more = F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False)).cast("int")
    epochs = F.when(F.col("_tokens") == 0, 1).otherwise(F.floor("_times") + more).cast("int")
    counted = placed.withColumn("_epochs", epochs).where(F.col("_epochs") > 0)
    repeated = counted.withColumn(
        "_epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1))
    )
    passed = (F.col("_epoch") + F.col("_at") / F.lit(_UNIT)) / F.coalesce("_times", F.lit(1.0))
    block = F.least(F.floor(passed * blocks), F.lit(blocks - 1)).cast("int")
    return repeated.select("_row", "_source", "_tokens", "_epoch", block.alias("_block"))


def mix_documents(docs: DataFrame, repetitions: float = REPETITIONS) -> DataFrame:
    """Returns doc_id, source, n_tokens, epoch, block: one row per time a document is seen."""
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("n_tokens"), F.md5("text").alias("tie")
    )
    mixed = mix(rows, F.col("n_tokens"), F.col("tie"), repetitions)
    return mixed.select(
        "_row.doc_id",
        "_row.source",
        "_row.n_tokens",
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
    )


def mixed_rows(
    docs: DataFrame, repetitions: float = REPETITIONS, tokenizer_path: str | None = None
) -> DataFrame:
    """The rows of ``docs`` as often as the mix sees them; all columns as they were.

    With a tokenizer, sources are weighed by its ids, counted once per document.
    """
    if tokenizer_path is None:
        return mix(docs, repetitions=repetitions).select("_row.*")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds(tokenizer_path)
        for texts in batches:
            yield pd.Series([len(ids.ids(t)) // 4 if t else 0 for t in texts], dtype="int64")

    rows = small_batches(docs).select(
        whole_row(docs).alias("whole"), "doc_id", "source", F.md5("text").alias("tie"), count("text").alias("n_tokens")
    )
    mixed = mix(pin(rows), F.col("n_tokens"), F.col("tie"), repetitions)
    return mixed.select("_row.whole.*")
