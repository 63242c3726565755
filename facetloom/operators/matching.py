"""Nearest rows of a persona and the records made from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom import constants as C
from facetloom.functions import prompts as P
from facetloom.functions.labels import high_conf_emotions
from facetloom.functions.numeric import clamp01
from facetloom.operators.lookups import fits_broadcast, lookup
from facetloom.operators.ordering import global_index
from facetloom.operators.scoring import Model, _model_column
from facetloom.session import ensure_checkpoint_dir, pin

# Similarities equal to this many decimals are ties, whatever order they were summed in.
TIE_DIGITS = 12
NO_MATCH = "no row of the persona to match"
#: Queries of one pass over the index, by number and by the bytes of their vectors.
PASS_QUERIES = 32_768
PASS_BYTES = 64 * 1024 * 1024
#: Passes that a number of queries may ask for; beyond, a pass takes more and compares that number at a time.
PASSES = 8
PAIR_BLOCK = 1 << 21
#: Index rows up to which they are sent to a large number of matches.
MATCHED_ROWS = 100_000


class _Best:
    """The best ``k`` rows so far for each of a set of queries; only rows that can get in are sorted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.owner = np.empty(0, dtype=np.int64)
        self.similarity = np.empty(0)
        self.rows: np.ndarray | None = None
        self.floor = np.full(len(ids), -np.inf)

    def add(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        most = max(256, PAIR_BLOCK // max(1, len(self.ids)))
        # The first steps are short: they set the floor that later rows have to reach.
        low, step = 0, 16 if self.rows is None else most
        while low < len(rows):
            part = slice(low, low + step)
            near = self.vectors @ vectors[part].T
            # Only what may reach the floor is rounded.
            owner, at = np.nonzero(near >= (self.floor - 10.0 ** (1 - TIE_DIGITS))[:, None])
            found = np.round(near[owner, at], TIE_DIGITS)
            enough = found >= self.floor[owner]
            if enough.any():
                self._merge(owner[enough], found[enough], rows[part][at[enough]])
            low, step = low + step, min(4 * step, most)

    def _merge(self, owner: np.ndarray, similarity: np.ndarray, rows: np.ndarray) -> None:
        if self.rows is not None:
            owner = np.concatenate([self.owner, owner])
            similarity = np.concatenate([self.similarity, similarity])
            rows = np.concatenate([self.rows, rows])
        # Ids of any type that has an order, by their place in it.
        places = np.unique(rows, return_inverse=True)[1]
        order = np.lexsort((places, -similarity, owner))
        owner, similarity, rows = owner[order], similarity[order], rows[order]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff([*starts, len(owner)]))
        last = rank == self.k - 1
        self.floor[owner[last]] = similarity[last]
        held = rank < self.k
        self.owner, self.similarity, self.rows = owner[held], similarity[held], rows[held]

    def table(self) -> pd.DataFrame:
        if self.rows is None:
            return _nothing()
        return pd.DataFrame(
            {
                "query_id": _as_is(self.ids[self.owner]),
                "row_id": _as_is(self.rows),
                "similarity": self.similarity,
            }
        )


def _as_is(values: np.ndarray) -> pd.Series:
    """Values of any type, without a type that pandas would choose."""
    return pd.Series(values.tolist(), dtype=object)


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "row_id": [], "similarity": []}, dtype=object)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _one_pass(queries: DataFrame, index: DataFrame, k: int, most: int = PASS_QUERIES) -> tuple[DataFrame, Broadcast]:
    """The index rows stay where they are: every task compares them with the queries of the pass, up to ``most``
    at a time, and sends only the best."""
    few = queries.toPandas()
    groups = {
        persona: (group["query_id"].to_numpy(), _matrix(group["vector"]))
        for persona, group in few.groupby("persona_id")
    }
    shared = queries.sparkSession.sparkContext.broadcast(groups)
    # The literal list of personas prunes the folders of the index.
    values = [p.item() if hasattr(p, "item") else p for p in groups]
    wanted = index.where(F.col("persona_id").isin(values))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {
            p: [_Best(ids[low : low + most], vectors[low : low + most], k) for low in range(0, len(ids), most)]
            for p, (ids, vectors) in shared.value.items()
        }
        for batch in batches:
            for persona, rows in batch.groupby("persona_id"):
                ids, vectors = rows["row_id"].to_numpy(), _matrix(rows["vector"])
                for part in best[persona]:
                    part.add(ids, vectors)
        for parts in best.values():
            for part in parts:
                yield part.table()

    return wanted.mapInPandas(search, _found_schema(queries, index)), shared


def _found_schema(queries: DataFrame, index: DataFrame) -> T.StructType:
    """Ids keep the types that they have in the two tables."""
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("row_id", index.schema["row_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query over all tasks."""
    if k == 1:
        best = found.groupBy("query_id").agg(
            F.min_by(
                F.struct("row_id", "similarity"), F.struct(-F.col("similarity"), F.col("row_id"))
            ).alias("b")
        )
        return best.select("query_id", "b.row_id", "b.similarity", F.lit(1).alias("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(queries: DataFrame, most: int) -> list[DataFrame]:
    """The queries cut into passes of a bounded size, written by pass.

    They are cut in order of their persona, so that a pass reads the index of few personas.
    """
    rows, size = queries.agg(
        F.count(F.lit(1)), F.sum(8 * F.size("vector") + 64).cast("long")
    ).first()
    number = max(1, min(PASSES, -(-rows // max(1, most))), -(-(size or 0) // PASS_BYTES))
    if number == 1:
        return [queries]
    placed = global_index(queries, ["persona_id", F.xxhash64("query_id")], "_at")
    path = f"{ensure_checkpoint_dir(queries.sparkSession)}/match-{uuid.uuid4().hex}"
    at = F.floor(F.col("_at") / F.lit(-(-rows // number))).cast("int")
    placed.withColumn("_pass", at).drop("_at").write.partitionBy("_pass").parquet(path)
    kind = T.StructType([*queries.schema, T.StructField("_pass", T.IntegerType())])
    written = queries.sparkSession.read.schema(kind).parquet(path)
    return [written.where(F.col("_pass") == i).drop("_pass") for i in range(number)]


def match(
    queries: DataFrame,
    index: DataFrame,
    k: int = 1,
    pass_queries: int = PASS_QUERIES,
    keep_unmatched: bool = False,
) -> DataFrame:
    """``query_id, persona_id, row_id, similarity, rank``: exact nearest rows in a persona.

    ``queries`` has ``query_id, persona_id, vector`` and ``index`` has ``row_id,
    persona_id, vector``, with unit vectors. Every row of the persona is compared by inner
    product; the lowest row id wins ties.

    The index is never shuffled. Queries are sent to it in passes of at most ``pass_queries`` queries and
    ``PASS_BYTES`` bytes, in order of their persona; a pass reads the personas of its queries once, and a task
    sends on its best ``k`` per query, not the pairs. Where the number asks for more than ``PASSES`` passes, passes
    hold more queries, and a task compares ``pass_queries`` of them at a time; so only bytes add passes.

    Ids and personas may be of any type that has an order. Index rows whose vector is null or
    not finite are no candidates. A query without a persona, with such a vector, or
    whose persona has no rows, has no match: with ``keep_unmatched`` it stays with null
    ``row_id``, ``similarity`` and ``rank``, else it is left out.
    """
    every = pin(queries.select("query_id", "persona_id", "vector"))
    asked = every.where(F.col("persona_id").isNotNull() & finite(F.col("vector")))
    held = index.select("row_id", "persona_id", "vector").where(finite(F.col("vector")))
    passes = _passes(asked, pass_queries)
    ranked = None
    for part in passes:
        found, sent = _one_pass(part, held, k, max(1, pass_queries))
        best = _ranked(found, k)
        if len(passes) > 1:
            # The few results are kept, and the queries leave the executors before the next pass.
            best = pin(best)
            sent.destroy()
        ranked = best if ranked is None else ranked.unionByName(best)
    return every.select("query_id", "persona_id").join(
        ranked, "query_id", "left" if keep_unmatched else "inner"
    ).select(
        "query_id", "persona_id", "row_id", "similarity", "rank"
    )


def similarity_gate(df: DataFrame, threshold: float = C.SIMILARITY_MIN) -> DataFrame:
    """Clamp ``similarity`` to 0..1 and add ``used_attributes``."""
    return df.withColumn("similarity", clamp01(F.col("similarity"))).withColumn(
        "used_attributes", F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    )


def with_card_traits(df: DataFrame, cards: DataFrame, persona: str = "persona_id") -> DataFrame:
    """Add ``traits``, the description of each row's persona from its card."""
    known = cards.select(
        F.col("persona_id").cast("string").alias("_card_id"),
        F.transform("top_emotions", lambda e: e["emotion"]).alias("_emotions"),
        F.col("top_words").alias("_words"),
        F.col("avg_sentiment_score").alias("_sentiment"),
        F.lit(True).alias("_known"),
    )
    keyed = df.withColumn("_card_id", F.col(persona).cast("string"))
    joined = lookup(keyed, known, ["_card_id"], pinned=True)
    traits = P.persona_traits(
        F.col(persona),
        F.coalesce(F.col("_known"), F.lit(False)),
        F.col("_emotions"),
        F.col("_words"),
        F.col("_sentiment"),
    )
    return joined.select(*df.columns, traits.alias("traits"))


def match_records(
    queries: DataFrame,
    index: DataFrame,
    cards: DataFrame,
    text: str = "text",
    threshold: float = C.SIMILARITY_MIN,
    min_confidence: float = C.ATTRIBUTE_MIN_CONFIDENCE,
    make_generator: Callable[[], Model] | None = None,
) -> DataFrame:
    """One record per query: nearest row, its attributes if near enough, and the prompt.

    ``queries`` has ``query_id, text, persona_id, vector``. ``index`` has ``row_id,
    persona_id, vector``, the text and any attributes; neither text nor vector of the
    matched row goes into the record. ``make_generator`` makes a function from prompts
    (JSON) to replies; without one ``reaction`` is null and ``error`` says so.
    """
    near = pin(similarity_gate(match(queries, index, keep_unmatched=True), threshold))
    unmatched = near.where(F.col("row_id").isNull())
    near = near.where(F.col("row_id").isNotNull())
    attributes = [c for c in index.columns if c not in (text, "vector")]
    slots = all(
        f"emo{i}_{part}" in index.columns
        for i in range(1, C.ATTRIBUTE_SLOTS + 1)
        for part in ("label", "conf")
    )
    emotion_kind = "array<struct<label: string, confidence: double>>"
    sure = high_conf_emotions(min_confidence) if slots else F.array().cast(emotion_kind)
    # Few matches go to the index, and only matched rows are described. Many meet it in a shuffle, in which the
    # matches of a row that very many queries share are spread.
    found = near.select(
        "row_id", "persona_id", *[F.col(c).alias(f"_{c}") for c in ("query_id", "similarity", "used_attributes")]
    )
    keys = ["row_id", "persona_id"]
    if fits_broadcast(found):
        matched = index.select(*attributes).join(F.broadcast(found), keys)
    else:
        matched = lookup(found, index.select(*attributes), keys, "inner", spread_by=["_query_id"], max_rows=MATCHED_ROWS)
    described = matched.select(
        F.col("_query_id").alias("query_id"),
        "persona_id",
        "row_id",
        F.col("_similarity").alias("similarity"),
        F.col("_used_attributes").alias("used_attributes"),
        P.attributes_json(attributes, text, min_confidence).alias("_attributes"),
        sure.alias("_sure"),
    )
    described = described.unionByName(
        unmatched.select(
            "query_id", "persona_id", "row_id", "similarity", "used_attributes",
            F.lit(None).cast("string").alias("_attributes"),
            F.lit(None).cast(emotion_kind).alias("_sure"),
        )
    )
    asked = queries.select("query_id", F.col(text).alias("_asked"))
    shown = with_card_traits(described.join(asked, "query_id"), cards)
    used = F.col("used_attributes")
    gated = shown.withColumn("attributes_sent", F.when(used, F.col("_attributes"))).withColumn(
        "high_conf_emotions_sent", F.when(used, F.col("_sure"))
    )
    prompted = gated.withColumn(
        "prompt_preview",
        P.build_prompt(
            F.col("_asked"),
            F.col("traits"),
            F.col("similarity"),
            F.col("attributes_sent"),
            F.col("high_conf_emotions_sent"),
            threshold,
        ),
    )
    if make_generator is None:
        reaction = F.lit(None).cast("string")
        error = F.lit("no generator given")
    else:
        generate = _model_column(
            make_generator, C.SCORING_BATCH, lambda reply: str(reply).strip(), T.StringType()
        )
        prompted = prompted.withColumn("_reply", generate(F.to_json("prompt_preview")))
        reaction = F.col("_reply")
        error = F.when(reaction.isNull(), "generator failed")
    error = F.when(F.col("row_id").isNull(), F.lit(NO_MATCH)).otherwise(error)
    return prompted.select(
        "query_id",
        "persona_id",
        "similarity",
        F.col("row_id").alias("matched_row_id"),
        "used_attributes",
        "attributes_sent",
        "high_conf_emotions_sent",
        reaction.alias("reaction"),
        error.alias("error"),
        "prompt_preview",
    )
