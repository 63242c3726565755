"""Lines that several documents share stay in the first of them, as one keep bitmap a document.

Hashes of the lines are range-partitioned and sorted by hash, document and position. A task streams
over its range: the first document of a hash keeps its lines, all later ones lose theirs. A hash that
very many lines share is cut over several ranges, so one row for each range carries the first document
over the borders. Only line numbers leave this stage; they become a compressed bitmap for each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches
from facetloom.operators.lookups import lookup
from facetloom.session import pin

#: Keys with fewer code points are never dropped.
LEAST_CHARS = 10
#: Lines in one Arrow batch of hashes.
BATCH_LINES = 200_000

# What is stripped from a key, and the letters that are folded.
_SPACE = b" \t\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_KEYS = "high long, low long, none boolean, doc_id long, row long, line long"
_ORDER = ["high", "low", "none", "doc_id", "row", "line"]
#: What carries over the border of a range: the last hash and the first document that has it.
Carry = tuple[int, int, bool, int]


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def line_key(line: bytes) -> bytes | None:
    """The key of a line in UTF-8, or None if it is too short to be dropped."""
    key = line.strip(_SPACE)
    if len(key) < LEAST_CHARS:
        return None
    if len(key) < 4 * LEAST_CHARS and not key.isascii():
        # Bytes that start a code point.
        if sum(b & 0xC0 != 0x80 for b in key) < LEAST_CHARS:
            return None
    return key.translate(_FOLD)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that is long enough: hash, document, position."""
    names = [part.split()[0] for part in _KEYS.split(", ")]

    def made(digests: list[bytes], at: list[tuple]) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        columns = [halves[:, 0], halves[:, 1], *zip(*at, strict=True)] if at else [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    for batch in batches:
        digests, at = [], []
        table = batch.to_pydict()
        for none, doc_id, row, text in zip(table["none"], table["doc_id"], table["row"], table["text"], strict=True):
            for number, line in enumerate(_encode(text).split(b"\n")):
                if (key := line_key(line)) is not None:
                    digests.append(xxhash.xxh3_128_digest(key))
                    at.append((none, doc_id, row, number))
            if len(at) >= BATCH_LINES:
                yield made(digests, at)
                digests, at = [], []
        yield made(digests, at)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for a range: its first and last hash, and the first document of the last hash."""
    first = last = None
    for pdf in batches:
        if not len(pdf):
            continue
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        if first is None:
            first = (high[0], low[0])
        start = len(pdf) - 1
        same = (high == high[-1]) & (low == low[-1])
        start = int(np.flatnonzero(same)[0])
        if last is None or last[:2] != (high[-1], low[-1]):
            last = (high[-1], low[-1], pdf["none"].iloc[start], pdf["doc_id"].iloc[start])
    if first is not None:
        part = TaskContext.get().partitionId()
        yield pd.DataFrame(
            [(part, *map(int, first), *map(int, last))],
            columns=["part", "high", "low", "last_high", "last_low", "none", "doc_id"],
        )


def carried(edges: list[tuple]) -> dict[int, Carry]:
    """For each range the hash and first document that the ranges before it hand over."""
    out: dict[int, Carry] = {}
    before: Carry | None = None
    for part, high, low, last_high, last_low, none, doc_id in sorted(edges):
        if before is not None:
            out[part] = before
        whole = (high, low) == (last_high, last_low)
        if not (whole and before is not None and before[:2] == (high, low)):
            before = (last_high, last_low, bool(none), doc_id)
    return out


def _later(carry: dict[int, Carry]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lines of a hash that are not in its first document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = carry.get(TaskContext.get().partitionId())
        for pdf in batches:
            if not len(pdf):
                continue
            high, low, none, doc_id = (pdf[c].to_numpy() for c in ("high", "low", "none", "doc_id"))
            fresh = np.ones(len(pdf), dtype=bool)
            fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            owner_none, owner = none[start], doc_id[start]
            if before is not None and before[:2] == (high[0], low[0]):
                head = start == 0
                owner_none = np.where(head, before[2], owner_none)
                owner = np.where(head, before[3], owner)
            before = (high[-1], low[-1], owner_none[-1], owner[-1])
            gone = (owner_none != none) | (owner != doc_id)
            yield pdf.loc[gone, ["none", "doc_id", "row", "line"]]

    return run


def pack_keep(dropped: np.ndarray) -> bytes:
    """The keep bitmap: a bit for each line up to the last dropped one, compressed; the last byte is filled up with ones."""
    keep = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_keep(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """A flag for each line; lines beyond the bitmap stay, and without one all do."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def _packed(lists: pd.Series) -> pd.Series:
    return pd.Series([pack_keep(np.asarray(x, dtype=np.int64)) for x in lists], dtype=object)


def _with_row(docs: DataFrame) -> DataFrame:
    """The texts, with what tells rows apart: the id (null or not) and a hash of the text."""
    return small_batches(docs).select(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.xxhash64("text").alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """One row for each document that loses lines: none (whether the id is null), doc_id, row (hash of the text), keep.

    A null id counts as larger than all others, and all rows with the same id (or none) are one
    document. Line hashes have 128 bits.
    """
    lines = _with_row(docs).mapInArrow(_hashes, _KEYS)
    ranges = pin(lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER))
    # One row for each shuffle part.
    edges = ranges.mapInPandas(
        _edges, "part int, high long, low long, last_high long, last_low long, none int, doc_id long"
    ).collect()
    later = ranges.mapInPandas(
        _later(carried([tuple(e) for e in edges])), "none boolean, doc_id long, row long, line long"
    )
    packed = F.pandas_udf(_packed, "binary")
    return (
        # Rows that repeat id and text repeat their lines as well.
        later.groupBy("none", "doc_id", "row")
        .agg(F.collect_set("line").alias("lines"))
        .select("none", "doc_id", "row", packed("lines").alias("keep"))
    )


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep"]
    for pdf in batches:
        out = []
        for doc_id, none, text, bitmap in zip(pdf["doc_id"], pdf["none"], pdf["text"], pdf["keep"], strict=True):
            data = _encode(text)
            kept, n_lines, n_dropped = data, data.count(b"\n") + 1, 0
            if bitmap is not None:
                keep = unpack_keep(bitmap, n_lines)
                n_dropped = int(n_lines - keep.sum())
                kept = b"\n".join(x for x, k in zip(data.split(b"\n"), keep.tolist(), strict=True) if k)
            sha = hashlib.sha256(kept).hexdigest()
            out.append((None if none else int(doc_id), n_lines, n_dropped, sha, bitmap))
        yield pd.DataFrame(out, columns=names, dtype=object)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Drop lines whose key an earlier document has: doc_id, n_lines, n_dropped, kept_sha256, keep.

    A text is split at newlines. The key of a line has white space stripped and A-Z folded; keys with
    fewer than ``LEAST_CHARS`` code points stay. Of a key in several documents, only the document with
    the smallest doc_id keeps its lines. ``keep`` is the compressed bitmap (null: all lines stay), see
    ``unpack_keep``; lines that stay are joined by newlines for the hash. A null or empty text is one
    empty line. Rows with the same doc_id are one document, and so are those with none, which comes
    last; every row gives one row. Very long texts give one bit a line; other columns are ignored.

    Hashes, not texts, are shuffled to find the lines. The bitmaps are sent to the texts if they are
    small, else joined to them.
    """
    found = lookup(
        _with_row(docs), keep_bitmaps(docs), ["none", "doc_id", "row"], spread_by=["row"], pinned=True
    )
    return found.select("doc_id", "none", "text", "keep").mapInPandas(
        _applied, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep binary"
    )
