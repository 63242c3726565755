"""Locality-sensitive document fingerprints: a quartile bucket digest.

Every run of three bytes is hashed to a bucket. The digest says for each bucket in which
quartile of all bucket counts its count lies, and how long the text is. Two digests are
compared by a score that adds the quartile steps between them, with a bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches
from facetloom.session import pin

BUCKETS = 256
#: Price of buckets 0 to 3 quartiles apart, and of one step of the length.
STEPS = np.array([0, 1, 2, 6])
LENGTH_STEP = 2
LENGTH_BOUND = 24
#: The expected price of two unrelated digests; likeness is 0 from there on.
BOUND = BUCKETS * 1.625 + LENGTH_BOUND

_ROWS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_NAMES = [part.split()[0] for part in _ROWS.split(", ")]


def digest(data: bytes) -> str:
    """The digest of a text's bytes, in hexadecimal: length byte, then two bits a bucket.

    Under three bytes all buckets are equal and only the length tells texts apart.
    """
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    length = min(255, round(8 * math.log2(1 + len(raw))))
    if len(raw) < 3:
        codes = np.zeros(BUCKETS, dtype=np.uint8)
    else:
        mixed = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        mixed *= np.uint32(0x9E3779B1)
        counts = np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
        low, middle, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes = ((counts > low).astype(np.uint8) + (counts > middle) + (counts > high)).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return f"{length:02x}{packed.tobytes().hex()}"


def difference(one: str, other: str) -> float:
    """The bounded difference of two digests; 0 for equal ones."""
    def parts(text: str) -> tuple[int, np.ndarray]:
        packed = np.frombuffer(bytes.fromhex(text[2:]), dtype=np.uint8)
        return int(text[:2], 16), np.concatenate([(packed >> s) & 3 for s in (0, 2, 4, 6)])

    (a, x), (b, y) = parts(one), parts(other)
    steps = STEPS[np.abs(x.astype(int) - y.astype(int))].sum()
    return float(min(BOUND, steps + min(LENGTH_BOUND, LENGTH_STEP * abs(a - b))))


def likeness(one: str, other: str) -> float:
    """From 1 for equal digests to 0 for the difference of unrelated ones."""
    return 1.0 - difference(one, other) / BOUND


def _id(said: str | None) -> int | None:
    """Ids travel as text: pandas would make numbers with nulls inexact."""
    return None if said is None else int(said)


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _compare(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
    half = len(text) // 2
    edited = _encode(text[: len(text) - half] + after[:half])
    other = digest(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, other,
        likeness(mark, other), likeness(mark, after_mark),
    )


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted part, each with the next; the first and last texts as edges."""
    part, before, first = TaskContext.get().partitionId(), None, None
    columns = [*_NAMES, "part", "edge", "text"]
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            now = (_id(doc_id), text, digest(_encode(text)))
            if before is None:
                first = now
            else:
                out.append((*_compare(*before, now[1], now[2]), part, None, None))
            before = now
        yield pd.DataFrame(out, columns=columns, dtype=object)
    if before is not None:
        edges = [(kind, doc_id, text) for kind, (doc_id, text, _) in (("first", first), ("last", before))]
        yield pd.DataFrame(
            [(d, None, None, None, None, None, None, part, kind, t) for kind, d, t in edges],
            columns=columns,
            dtype=object,
        )


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            _compare(_id(d), t, digest(_encode(t)), n, digest(_encode(n)))
            for d, t, n in zip(pdf["doc_id"], pdf["text"], pdf["after"], strict=True)
        ]
        yield pd.DataFrame(rows, columns=_NAMES, dtype=object)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and compare both with the next document.

    The edited text has its last half (rounded down) replaced by the first as many
    characters of the next document by doc_id; the first follows the last. A null text
    counts as empty, a null doc_id comes first, equal ids go by the hash of the text; every
    row gives one row. One range shuffle sorts the texts; each part compares neighbours as they
    stream by, and only the texts at the ends of the parts meet in a second, small step.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    parts = spark.sparkContext.defaultParallelism
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    done = pin(
        order.select(F.col("doc_id").cast("string"), "text").mapInPandas(_along, f"{_ROWS}, part int, edge string, text string")
    )
    # One number per shuffle part.
    numbers = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    pairs = spark.createDataFrame(
        list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "part int, follower int"
    )
    firsts = done.where("edge = 'first'").select(
        F.col("part").alias("follower"), F.col("text").alias("after")
    )
    ends = (
        done.where("edge = 'last'")
        .select("doc_id", "text", "part")
        .join(F.broadcast(pairs), "part")
        .join(firsts, "follower")
        .select(F.col("doc_id").cast("string"), "text", "after")
        .mapInPandas(_ends, _ROWS)
    )
    return done.where(F.col("edge").isNull()).select(*_NAMES).unionByName(ends)
