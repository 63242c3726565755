"""Language ID with language-bitmask filters over character n-grams.

Every slot of a Bloom filter holds one bit per language. An n-gram looks up a few slots; the
bits set in all of them are the languages that contain it. The bits of a text's n-grams are
counted by language, corrected for the false positives of the filter, and the language with
the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches, whole_row
from facetloom.llm.shingles import mix

GRAM = 4
#: Labelled documents of each language that the filter learns from (a documented bound).
SAMPLE = 2000
#: Tasks that share the ranking of one language; the last ranking sees ``SLICES * sample`` rows of it.
SLICES = 64
SLOT_BITS = 21
PROBES = 3
#: An n-gram belongs to a language if this share of its sampled documents has it, and at
#: least ``CONTRAST`` of the share that it has in any other language.
MIN_SHARE = 0.002
CONTRAST = 0.25
UNKNOWN = "und"
#: Standard deviations of the share of false positives that a share must exceed to be evidence.
EVIDENCE = 3.0


@dataclass
class LanguageFilter:
    """``slots``: (2**SLOT_BITS, words) masks; languages with most documents come first."""

    languages: list[str]
    slots: np.ndarray

    def false_positives(self) -> np.ndarray:
        """Per language, the chance that an n-gram it lacks passes all probes."""
        filled = [
            np.count_nonzero(self.slots[:, i // 64] & np.uint64(1 << (i % 64)))
            for i in range(len(self.languages))
        ]
        return (np.array(filled, dtype=float) / len(self.slots)) ** PROBES


def gram_hashes(text: str) -> np.ndarray:
    """Hash of every run of ``GRAM`` characters of the lower-cased text, padded with blanks."""
    padded = f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(padded, dtype=np.uint32).astype(np.uint64)
    n = len(points) - GRAM + 1
    value = points[:n].copy()
    for i in range(1, GRAM):
        value = (value << np.uint64(16)) * np.uint64(31) + points[i : i + n]
    return mix(value)


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(hashes >> np.uint64(SLOT_BITS * i)) & mask for i in range(PROBES)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; false for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each n-gram, by language, summed over a batch."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            found = np.concatenate([np.unique(gram_hashes(t)) for t in texts])
            grams, counts = np.unique(found, return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": counts})


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageFilter:
    """Fit the filter on up to ``sample`` labelled documents of each language.

    Uses documents with a text and a language that are not held out; the ones with the
    smallest hash of the id are taken, so the sample is the same on every run. Without
    such documents no language is known.
    """
    labelled = small_batches(docs).select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    labelled = labelled.withColumn("at", F.xxhash64(F.lit("language"), "doc_id"))
    # A language is ranked in slices of the hash first, which leave a bounded rest to rank whole.
    sliced = Window.partitionBy("lang", "slice").orderBy("at")
    whole = Window.partitionBy("lang").orderBy("at")
    limits = (
        labelled.select("lang", "at", F.pmod("at", F.lit(SLICES)).alias("slice"))
        .withColumn("rank", F.row_number().over(sliced))
        .where(F.col("rank") <= sample)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= sample)
        .groupBy("lang")
        .agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("docs"))
        .collect()
    )
    if not limits:
        return LanguageFilter([], np.zeros((1 << SLOT_BITS, 1), dtype=np.uint64))
    limits.sort(key=lambda r: (-r["docs"], r["lang"]))
    languages = [r["lang"] for r in limits]
    # One row per language.
    table = docs.sparkSession.createDataFrame(
        [(r["lang"], r["last"], r["docs"]) for r in limits], "lang string, last long, docs long"
    )
    chosen = labelled.join(F.broadcast(table), "lang").where(F.col("at") <= F.col("last"))
    counts = (
        chosen.where(F.col("text").isNotNull())
        .select("lang", "text")
        .mapInPandas(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .join(F.broadcast(table), "lang")
        .withColumn("share", F.col("n") / F.col("docs"))
    )
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = (
        counts.withColumn("most", most)
        .where((F.col("n") >= 2) | (F.col("docs") < 2 / MIN_SHARE))
        .where(F.col("share") >= MIN_SHARE)
        .where(F.col("share") >= CONTRAST * F.col("most"))
        .select("lang", "gram")
        .toPandas()
    )
    slots = np.zeros((1 << SLOT_BITS, -(-len(languages) // 64)), dtype=np.uint64)
    for i, lang in enumerate(languages):
        grams = kept.loc[kept["lang"] == lang, "gram"].to_numpy(dtype=np.int64).view(np.uint64)
        for at in _probes(grams):
            slots[at.astype(np.int64), i // 64] |= np.uint64(1 << (i % 64))
    return LanguageFilter(languages, slots)


def shares(text: str, model: LanguageFilter, wrong: np.ndarray) -> np.ndarray:
    """The corrected share of the text's n-grams that each language contains."""
    hashes = gram_hashes(text)
    found = None
    for at in _probes(hashes):
        rows = model.slots[at.astype(np.int64)]
        found = rows if found is None else found & rows
    hits = np.array(
        [
            np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64)))
            for i in range(len(model.languages))
        ]
    )
    return np.clip((hits / len(hashes) - wrong) / (1 - wrong), 0, 1)


def is_evidence(text: str, share: float, wrong: float) -> bool:
    """Whether false positives of the filter do not explain a corrected share."""
    if share <= 0:
        return False
    different = len(np.unique(gram_hashes(text)))
    return share * (1 - wrong) > EVIDENCE * np.sqrt(wrong * (1 - wrong) / different)


def predict(docs: DataFrame, model: LanguageFilter, strict: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``, from the text alone.

    A null text, one without a letter, or an empty filter gives ``und`` with score 0. Of
    equal shares the language with more learned documents wins, then the smaller name. With ``strict``
    a text whose share is zero or no more than false positives give is ``und`` too.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.false_positives()))

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known, wrong = shared.value
        out = []
        for text in texts:
            if not known.languages or not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            share = shares(text, known, wrong)
            best = int(np.argmax(share))
            if strict and not is_evidence(text, share[best], wrong[best]):
                out.append((UNKNOWN, 0.0))
                continue
            out.append((known.languages[best], float(share[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return (
        docs.withColumn("_judged", judge("text"))
        .withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")})
        .drop("_judged")
    )


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Predict the language of every document with a filter learned from the others.

    Returns doc_id, held_out, lang_pred, score; one row per input row.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, learn(docs, sample)).drop("text")


def keep_known(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is known; all their columns stay as they are.

    If no language was learned, the documents with a letter are kept.
    """
    model = learn(docs, sample)
    rows = docs.select(whole_row(docs).alias("_row"), "text")
    if not model.languages:
        return rows.where(F.udf(has_letter, "boolean")("text")).select("_row.*")
    return predict(rows, model, strict=True).where(F.col("lang_pred") != UNKNOWN).select("_row.*")
