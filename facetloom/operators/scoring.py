"""Label scores and text vectors from a lexicon, from hashing or from a given model.

Scores are ``array<struct<label, score>>``. A model is a function from a list of texts to
one result per text, made once per worker by a factory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions import labels as L
from facetloom.functions import text as X
from facetloom.functions.text import strip
from facetloom.operators.columns import with_settled
from facetloom.operators.lookups import lookup
from facetloom.operators.ordering import row_range
from facetloom.schemas import SCORES
from facetloom.session import small_batches

Model = Callable[[list[str]], Sequence[Any]]


_HEX = "0123456789abcdef"
#: Labels that words can vote for, and rows of a batch whose votes are counted at a time.
MAX_VOTES = 52
VOTE_ROWS = 1000


def _digest_bucket(digest: Column, buckets: int) -> Column:
    high = F.position(F.substring(digest, 1, 1), F.lit(_HEX)) - 1
    low = F.position(F.substring(digest, 2, 1), F.lit(_HEX)) - 1
    return (high * 16 + low) % F.lit(buckets)


def hashed_bucket(word: Column, buckets: int) -> Column:
    """A number from 0 to ``buckets`` - 1 from the first byte of the word's MD5."""
    return _digest_bucket(F.md5(word), buckets)


def _voted(words: pa.Array, labels: pa.Array) -> pa.Array:
    """The scores of some rows of words; each different word is hashed once."""
    size, n = len(labels), len(words)
    coded = words.flatten().dictionary_encode()
    bucket = np.array(
        [hashlib.md5(w.encode()).digest()[0] % size for w in coded.dictionary.to_pylist()], dtype=np.int64
    )
    counts = pa.compute.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(n) * size, counts) + bucket[coded.indices.to_numpy(zero_copy_only=False)]
    votes = np.bincount(place, minlength=n * size).reshape(n, size)
    row, label = np.nonzero(votes)
    score = votes[row, label] / counts[row]
    ends = np.concatenate(([0], np.cumsum(np.count_nonzero(votes, axis=1))))
    entries = pa.StructArray.from_arrays([labels.take(pa.array(label)), pa.array(score)], names=["label", "score"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


@dataclass(frozen=True)
class HashScorer:
    """Each word votes for the label its hash falls on; score = votes / words.

    A deterministic stand-in for a model that needs no table: all work stays in the row.
    The words of a batch are counted by label as whole columns. Labels without a vote are left out.
    """

    labels: Sequence[str] = C.EMOTION_LABELS

    def score(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        if len(self.labels) > MAX_VOTES:
            raise ValueError(f"at most {MAX_VOTES} labels")
        labels = list(self.labels)

        def voted(words: pa.Array) -> pa.Array:
            names = pa.array(labels, pa.string())
            parts = [_voted(words.slice(low, VOTE_ROWS), names) for low in range(0, max(1, len(words)), VOTE_ROWS)]
            return pa.concat_arrays(parts)

        voted.__annotations__ = {"words": pa.Array, "return": pa.Array}
        return small_batches(df).withColumn(out, F.arrow_udf(voted, SCORES)(X.tokens(text)))


@dataclass(frozen=True)
class LexiconScorer:
    """Words joined to a lexicon (term, label, weight); score = sum of weights / words.

    ``row_id`` names the unique key of the scored table. The lexicon is broadcast when it
    passes the size check of ``lookup``, else joined with its frequent words salted. Only
    keys and scores are shuffled until the last join. Scores come in label order.
    """

    lexicon: DataFrame
    row_id: str

    def score(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        words = df.select(self.row_id, X.tokens(text).alias("_words")).select(
            self.row_id,
            F.size("_words").alias("_count"),
            F.posexplode("_words").alias("_pos", "term"),
        )
        hits = lookup(
            words,
            self.lexicon.select("term", "label", "weight"),
            ["term"],
            "inner",
            spread_by=[self.row_id, "_pos"],
            pinned=True,
        )
        per_label = hits.groupBy(self.row_id, "label").agg(
            (F.sum("weight") / F.first("_count")).alias("score")
        )
        # At most one entry per label of the lexicon.
        scores = per_label.groupBy(self.row_id).agg(
            F.sort_array(F.collect_list(F.struct("label", "score"))).alias(out)
        )
        empty = F.array().cast(SCORES)
        return df.join(scores, self.row_id, "left").withColumn(
            out, F.coalesce(F.col(out), empty)
        )


def _isolated(model: Model, texts: list[str], convert: Callable[[Any], Any]) -> list[Any]:
    """One converted result per text; texts the model fails on give None."""

    def one(result: Any) -> Any:
        try:
            return convert(result)
        except Exception:
            return None

    try:
        results = list(model(texts))
        if len(results) == len(texts):
            return [one(r) for r in results]
    except Exception:
        pass
    out = []
    for text in texts:
        try:
            out.append(one(model([text])[0]))
        except Exception:
            out.append(None)
    return out


def _as_scores(result: Any) -> list[dict[str, Any]]:
    entries = [result] if isinstance(result, dict) else result
    return [{"label": str(e["label"]), "score": float(e["score"])} for e in entries]


def _as_unit_vector(result: Any) -> np.ndarray:
    vector = np.asarray(result, dtype="float64")
    norm = float(np.sqrt((vector * vector).sum()))
    return (vector / norm if norm > 0 else vector).astype("float32")


def _model_column(
    make_model: Callable[[], Model], batch_size: int, convert: Callable[[Any], Any], kind: Any
) -> Callable[[Column], Column]:
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            values: list[Any] = []
            for at in range(0, len(texts), batch_size):
                chunk = texts.iloc[at : at + batch_size].tolist()
                values.extend(_isolated(model, chunk, convert))
            yield pd.Series(values, dtype="object")

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(apply, returnType=kind)


@dataclass(frozen=True)
class ModelScorer:
    """Scores by a model: per text one ``{label, score}`` or a list of them.

    A failing batch is tried again text by text, and a failing text gives null.
    """

    make_model: Callable[[], Model]
    batch_size: int = C.SCORING_BATCH

    def score(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        column = _model_column(self.make_model, self.batch_size, _as_scores, SCORES)
        return df.withColumn(out, column(text))


Scorer = HashScorer | LexiconScorer | ModelScorer


def score_labels(
    df: DataFrame, text: str, scorer: Scorer, out: str = "scores", missing: str = ""
) -> DataFrame:
    """Add all label scores of a text column."""
    return scorer.score(df, X.scoring_text(F.col(text), missing), out)


def score_emotions(
    df: DataFrame, text: str, scorer: Scorer, slots: int = C.EMOTION_SLOTS, missing: str = ""
) -> DataFrame:
    """Add ``top_emotion, emotion_conf, emotion_sentiment`` and the best slots."""
    scored = score_labels(df, text, scorer, "_scores", missing)
    ranked = with_settled(scored, "_ranked", L.top_k_labels(F.col("_scores"), slots))
    best = F.get("_ranked", F.lit(0))
    return ranked.select(
        *df.columns,
        best["label"].alias("top_emotion"),
        best["score"].alias("emotion_conf"),
        L.emotion_to_sentiment(best["label"]).alias("emotion_sentiment"),
        *L.slot_columns(F.col("_ranked"), slots),
    )


def score_sentiment(
    df: DataFrame,
    text: str,
    scorer: Scorer,
    max_tokens: int | None = None,
    missing: str = "",
) -> DataFrame:
    """Add ``reddit_sentiment, reddit_conf`` from the best sentiment class.

    ``max_tokens`` cuts the text after that many words, for models with a short window.
    """
    source, work = text, df
    if max_tokens is not None:
        source = "_cut"
        words = F.split(strip(F.col(text)), r"\s+")
        work = df.withColumn("_cut", F.array_join(F.slice(words, 1, max_tokens), " "))
    scored = score_labels(work, source, scorer, "_scores", missing)
    best = F.get(L.top_k_labels(F.col("_scores"), 1), F.lit(0))
    ranked = with_settled(scored, "_best", best)
    return ranked.select(
        *df.columns,
        L.map_sentiment_label(F.col("_best")["label"]).alias("reddit_sentiment"),
        F.col("_best")["score"].alias("reddit_conf"),
    )


def add_top_emotion(
    df: DataFrame, text: str, scorer: Scorer, limit: int | None = None, order_by: str = "row_id"
) -> DataFrame:
    """Add only the best label; ``limit`` keeps the first rows, for a trial run."""
    first = row_range(df, order_by=order_by, limit=limit) if limit else df
    scored = score_labels(first, text, scorer, "_scores")
    return scored.withColumn("top_emotion", L.top_label(F.col("_scores"))).drop("_scores")


def corpus_lexicon(df: DataFrame, text: str, labels: Sequence[str] = C.EMOTION_LABELS) -> DataFrame:
    """A lexicon of every word of the corpus, with its hashed label and weight 1."""
    names = F.array(*[F.lit(label) for label in labels])
    terms = df.select(F.explode(X.tokens(F.col(text))).alias("term")).distinct()
    return terms.select(
        "term",
        F.get(names, hashed_bucket(F.col("term"), len(labels))).alias("label"),
        F.lit(1.0).alias("weight"),
    )


def fit_text_encoder(df: DataFrame, text: str, dimensions: int = 256) -> PipelineModel:
    """A text encoder without a model: hashed word counts, weighted by rarity, unit length.

    The same fitted encoder serves index and queries. It reads column ``text``.
    """
    stages = [
        RegexTokenizer(
            inputCol="_text", outputCol="_words", pattern=X.TOKEN_PATTERN, gaps=False
        ),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(X.embed_text(F.col(text)).alias("_text")))


def embed(
    df: DataFrame,
    text: str,
    encoder: PipelineModel | Callable[[], Model],
    out: str = "vector",
    max_chars: int | None = None,
    batch_size: int = C.EMBEDDING_BATCH,
) -> DataFrame:
    """Add a unit vector (``array<float>``) per text, by a fitted encoder or a model."""
    source = X.embed_text(F.col(text), max_chars)
    if isinstance(encoder, PipelineModel):
        encoded = encoder.transform(df.withColumn("_text", source))
        return encoded.select(*df.columns, vector_to_array("_unit", "float32").alias(out))
    column = _model_column(encoder, batch_size, _as_unit_vector, "array<float>")
    return df.withColumn(out, column(source))
