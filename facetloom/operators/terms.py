"""Term weights of a corpus and of its groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from facetloom import constants as C
from facetloom.functions import text as X
from facetloom.operators.columns import with_settled
from facetloom.session import small_batches


#: Rows whose terms are counted at a time.
COUNTED_ROWS = 1000


def with_terms(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """Add ``_terms``: the words of the text, its word pairs, or both."""
    low, high = ngrams
    if not 1 <= low <= high <= 2:
        raise ValueError("ngrams must lie between 1 and 2")
    worded = with_settled(df, "_words", X.tokens(F.coalesce(F.col(text), F.lit(""))))
    words, pairs = F.col("_words"), X.bigrams(F.col("_words"))
    terms = words if high == 1 else pairs if low == 2 else F.concat(words, pairs)
    return worded.withColumn("_terms", terms).drop("_words")


def term_stats(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """``term, tf, df``: occurrences and documents of every term of the corpus.

    One pass: the terms of some rows are counted as whole columns, and the counts of a task are
    summed before the shuffle, so frequent terms cost one record per task.
    """
    return _count_terms(with_terms(df, text, ngrams).select("_terms"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows of each term, for some rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, COUNTED_ROWS):
            terms = batch.column("_terms").slice(low, COUNTED_ROWS)
            coded = terms.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pa.compute.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False)
            n = len(coded.dictionary)
            row = np.repeat(np.arange(len(terms)), lengths)
            once = np.unique(row * max(1, n) + code) % max(1, n)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(once, minlength=n))],
                names=["term", "tf", "df"],
            )


def _count_terms(terms: DataFrame) -> DataFrame:
    return _summed(terms.mapInArrow(_counted, "term string, tf long, df long"))


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _frequent_pairs(df: DataFrame, text: str, words: list[str]) -> DataFrame:
    """``term, tf, df`` of the word pairs of which both words are in ``words``, counted by the words' places in the list."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            for low in range(0, batch.num_rows, COUNTED_ROWS):
                at, row = _places(batch.column("_words").slice(low, COUNTED_ROWS), known)
                both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]))
                pair, code, tf = np.unique(at[both] * len(words) + at[both + 1], return_inverse=True, return_counts=True)
                once = np.unique(row[both] * max(1, len(pair)) + code) % max(1, len(pair))
                left, right = (known.take(pa.array(x)) for x in np.divmod(pair, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.compute.binary_join_element_wise(left, right, " "), pa.array(tf), pa.array(np.bincount(once, minlength=len(pair)))],
                    names=["term", "tf", "df"],
                )

    worded = df.select(X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    return _summed(worded.mapInArrow(counted, "term string, tf long, df long"))


def _top(stats: DataFrame, size: int, min_df: int) -> list[Row]:
    best = stats.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(size)
    return best.collect()


def _places(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``known`` (-1: none) and row of the words of some rows."""
    coded = words.flatten().dictionary_encode()
    place = pa.compute.fill_null(pa.compute.index_in(coded.dictionary, known), -1)
    at = place.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = pa.compute.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return at, np.repeat(np.arange(len(words)), lengths)


def _entries(terms: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``known`` and number of the known terms of some rows, in order of row and place."""
    at, row = _places(terms, known)
    key, count = np.unique((row * len(known) + at)[at >= 0], return_counts=True)
    return key // len(known), key % len(known), count


class _Vocabulary:
    """Counts the terms of a vocabulary in rows of words; a pair is found by the places of its words, not as text."""

    def __init__(self, terms: Sequence[str], ngrams: tuple[int, int]) -> None:
        self.size = len(terms)
        parts = [t.split(" ") for t in terms]
        words = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(words)}
        self.words, self.known = len(words), pa.array(words, pa.string())
        self.single = np.full(self.words + 1, -1, dtype=np.int64)
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1 and ngrams[0] == 1:
                self.single[place[p[0]]] = i
            elif len(p) == 2 and ngrams[1] == 2:
                pairs.append((place[p[0]] * self.words + place[p[1]], i))
        pairs.sort()
        self.codes = np.array([c for c, _ in pairs] or [-1], dtype=np.int64)
        self.pair = np.array([i for _, i in pairs] or [-1], dtype=np.int64)

    def entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the vocabulary and number of its terms, in order of row and place."""
        at, row = _places(words, self.known)
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]))
        code = at[both] * self.words + at[both + 1]
        near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[near] == code
        place = np.concatenate([self.single[at], self.pair[near[found]]])
        owner = np.concatenate([row, row[both[found]]])
        key, count = np.unique((owner * self.size + place)[place >= 0], return_counts=True)
        return key // self.size, key % self.size, count


@dataclass(frozen=True)
class TfidfModel:
    """A vocabulary with its inverse document frequencies."""

    text: str
    ngrams: tuple[int, int]
    terms: tuple[str, ...]
    idf: tuple[float, ...]
    documents: int

    def transform(self, df: DataFrame, out: str = "tfidf") -> DataFrame:
        """Add the unit-length sparse vector of term weights; rows stay where they are."""
        counter = CountVectorizerModel.from_vocabulary(
            list(self.terms), "_terms", "_counts"
        )
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_scaled"
        )
        unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=out)
        counted = counter.transform(with_terms(df, self.text, self.ngrams)).drop("_terms")
        return unit.transform(scale.transform(counted)).drop("_counts", "_scaled")

    def entries(self, df: DataFrame, out: str) -> DataFrame:
        """Add the vector of ``transform`` as a struct ``indices, values``, made of whole columns of words.

        Only words leave the row's expressions: pairs are never written as text.
        """
        idf, vocabulary = np.array(self.idf), _Vocabulary(self.terms, self.ngrams)

        def some(words: pa.Array) -> pa.Array:
            row, at, count = vocabulary.entries(words)
            weight = count * idf[at]
            norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
            ends = pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), weight / norm[row])]
            return pa.StructArray.from_arrays(lists, names=["indices", "values"])

        def vectors(words: pa.Array) -> pa.Array:
            return pa.concat_arrays([some(words.slice(low, COUNTED_ROWS)) for low in range(0, max(1, len(words)), COUNTED_ROWS)])

        vectors.__annotations__ = {"words": pa.Array, "return": pa.Array}
        made = F.arrow_udf(vectors, "indices array<int>, values array<double>")(X.tokens(F.coalesce(F.col(self.text), F.lit(""))))
        return small_batches(df).select("*", made.alias(out, metadata={"ml_attr": {"num_attrs": len(self.terms)}}))

    def terms_table(self, df: DataFrame) -> DataFrame:
        """``at, term``: the vocabulary, which the vocabulary size bounds."""
        return df.sparkSession.createDataFrame(
            list(enumerate(self.terms)), "at int, term string"
        )

    def long(self, df: DataFrame, row_id: str) -> DataFrame:
        """``row_id, term, weight`` of the stored entries; words become entries as whole columns."""
        worded = with_terms(df.select(row_id, self.text), self.text, self.ngrams)
        idf, vocabulary = np.array(self.idf), list(self.terms)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(vocabulary, pa.string())
            for batch in batches:
                for low in range(0, batch.num_rows, COUNTED_ROWS):
                    part = batch.slice(low, COUNTED_ROWS)
                    row, at, count = _entries(part.column("_terms"), known)
                    weight = count * idf[at]
                    norm = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(row_id).take(pa.array(row)), known.take(pa.array(at)), pa.array(weight / norm[row])],
                        names=[row_id, "term", "weight"],
                    )

        kind = T.StructType([
            df.schema[row_id], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType()),
        ])
        return worded.select(row_id, "_terms").mapInArrow(weigh, kind)


def fit_tfidf(
    df: DataFrame,
    text: str,
    max_features: int = C.VOCABULARY_SIZE,
    ngrams: tuple[int, int] = (1, 2),
    min_df: int = 1,
) -> TfidfModel:
    """Learn the vocabulary: the most frequent terms in at least ``min_df`` documents.

    Equal counts go by term. Only the vocabulary comes to the driver.

    A pair occurs no more often than either of its words. So once the words alone fill
    the vocabulary, a pair with a word below the least frequent of them cannot get in,
    and only the pairs of frequent words have to be counted.
    """
    documents = df.count()
    if ngrams == (1, 2):
        singles = term_stats(df, text, (1, 1)).where(F.col("df") >= min_df)
        singles = singles.persist(StorageLevel.MEMORY_AND_DISK)
        rows = _top(singles, max_features, min_df)
        full = len(rows) == max_features
        least = rows[-1]["tf"] if full else 0
        # Words as frequent as the last one may be cut off above; with more of them than
        # the limit nothing is pruned.
        ties = (
            [r["term"] for r in singles.where(F.col("tf") == least).limit(max_features + 1).collect()]
            if full
            else []
        )
        if full and len(ties) <= max_features:
            frequent = sorted({r["term"] for r in rows} | set(ties))
            pairs = _frequent_pairs(df, text, frequent)
            found = _top(pairs.where(F.col("tf") >= least), max_features, min_df)
        else:
            found = _top(term_stats(df, text, (2, 2)), max_features, min_df)
        singles.unpersist()
        merged = sorted([*rows, *found], key=lambda r: (-r["tf"], r["term"]))
        rows = merged[:max_features]
    else:
        rows = _top(term_stats(df, text, ngrams), max_features, min_df)
    if not rows:
        raise ValueError("no terms left for the vocabulary")
    vocabulary = sorted((r["term"], r["df"]) for r in rows)
    return TfidfModel(
        text,
        ngrams,
        tuple(term for term, _ in vocabulary),
        tuple(math.log((1 + documents) / (1 + n)) + 1 for _, n in vocabulary),
        documents,
    )


def top_terms(
    df: DataFrame, model: TfidfModel, group: str = "persona_id", top: int = 12
) -> DataFrame:
    """``group, term, weight, rank``: the terms with the highest mean weight of a group.

    The mean is over all rows of the group. Sparse vectors are summed in the tasks, so the
    shuffle holds one vector per group and task.
    """
    weighted = model.transform(df.where(F.col(group).isNotNull()).select(group, model.text))
    means = weighted.groupBy(group).agg(Summarizer.mean(F.col("tfidf")).alias("mean"))
    spread = means.select(
        group, F.posexplode(vector_to_array("mean")).alias("at", "weight")
    )
    best = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return (
        spread.join(F.broadcast(model.terms_table(df)), "at")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select(group, "term", "weight", "rank")
    )


def ranked_array(value: Column, rank: str = "rank") -> Column:
    """Aggregate: the values of a ranked group as an array in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return F.transform(ordered, lambda e: e["v"])
