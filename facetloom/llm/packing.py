"""Packing tokenised documents into sequences: dominance reduction, then best fit.

The lengths of the pieces are counted; with a capacity of some thousand tokens there are only
that many different lengths, whatever the number of documents. The reduction fixes, for the
largest length left, a bin content that dominates every other (Martello and Toth), as often as
the counts allow, and so shrinks the instance; what it cannot prove is packed by best fit.
The bins that come out are patterns with multiplicities; every piece finds its bin by its
rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches
from facetloom.session import pin

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
#: Parts in which the pieces of one length are numbered.
RANK_PARTS = 128

_ODD_BLANK = re.compile(r" \s")
# Fixed value: how byte-level tokenizers cut a text before merging.
_CUTS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

Pattern = tuple[tuple[int, ...], int]


class WordIds(dict):
    """Ids of a text, word by word: the bytes of each blank-separated word are remembered.

    A byte-level tokenizer cuts before every single blank, so the ids of a text are those of
    its words, each with the blank before it. That does not hold for blanks next to other white space nor
    for special tokens: such texts are encoded whole. New words are merged by the ranks of the
    same vocabulary where its merges are in the order of the ids.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Two bytes an id, if the vocabulary lets them.
        self.kept_as = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        self._merge = _ranked(json.loads(self.tokenizer.to_str()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = " " + word
        made = self[word] = _packed(self._merge(text)) if self._merge else self._encode(text)
        return made

    def _encode(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        words = text.split(" ")
        if not any(s in text for s in self.special) and not _ODD_BLANK.search(text):
            return self._encode(words[0]) + b"".join(map(self.__getitem__, words[1:]))
        return self._encode(text)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _ranked(said: dict) -> Callable[[str], list[int]] | None:
    """A quick encoder for a byte-level vocabulary without a normalizer, if the ids rank its merges."""
    import tiktoken

    cutter, model = said.get("pre_tokenizer") or {}, said["model"]
    plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space")
    if said.get("normalizer") or not plain or not cutter.get("use_regex", True) or model["type"] != "BPE":
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    # Bytes that have no printable character stand for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in vocabulary.items()
        if all(c in byte_of for c in token) and i < 256 + len(pairs)
    }
    return tiktoken.Encoding(
        "ranked", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n_tokens], strict=True)]


def tokenize(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` its ids. A null text is empty.

    Every document ends with the id 0, so an empty one has one token.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(tokenizer_path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = words.ids(text) + END
                key = None if doc_id is None else int(doc_id)
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (key, i, start, length, zlib.crc32(own))
                    out.append((*row, np.frombuffer(own, "<u4").astype(words.kept_as).tobytes()) if with_ids else row)
            yield pd.DataFrame(out, columns=names, dtype=object)

    # Ids travel as text: pandas would make numbers with nulls inexact.
    rows = small_batches(docs).select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInPandas(run, schema)


class _Counts:
    """Counts by length, with the next smaller length that still has pieces."""

    def __init__(self, counts: dict[int, int]):
        self.of = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.of)

    def take(self, length: int, n: int) -> None:
        self.of[length] -= n
        if not self.of[length]:
            del self.of[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)

    def largest(self, limit: int, without: dict[int, int] | None = None) -> int:
        """The largest length up to ``limit``, when the pieces ``without`` are gone; or 0."""
        i = bisect_right(self.lengths, limit) - 1
        while i >= 0 and without and self.of[self.lengths[i]] <= without.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def smallest(self, n: int, without: int) -> int | None:
        """Sum of the ``n`` smallest pieces, one piece of length ``without`` being gone."""
        total = 0
        for length in self.lengths:
            here = min(n, self.of[length] - (length == without))
            total, n = total + here * length, n - here
            if not n:
                return total
        return None


def _dominant(counts: _Counts, top: int, capacity: int) -> tuple[int, ...] | None:
    """A content with a piece of length ``top`` that dominates all others, or None if unproven.

    With the room left beside it: nothing fits; the largest fitting piece fills it, or no
    two fit; or no three fit, and the largest fitting piece with the largest beside it is
    at least as large, piece by piece, as every other pair that fits, or the one piece is as
    large as any such pair.
    """
    room = capacity - top
    gone = {top: 1}
    one = counts.largest(room, gone)
    if not one:
        return (top,)
    two = counts.smallest(2, top)
    if one == room or two is None or two > room:
        return (top, one)
    three = counts.smallest(3, top)
    if three is not None and three <= room:
        return None
    gone[one] = gone.get(one, 0) + 1
    other = counts.largest(room - one, gone)
    if other:
        return (top, one, other) if other >= counts.largest(room // 2, gone) else None
    pair = 0
    for length in counts.lengths[: bisect_right(counts.lengths, room)]:
        left = {top: 1}
        if counts.of[length] > left.get(length, 0):
            left[length] = left.get(length, 0) + 1
            mate = counts.largest(min(length, room - length), left)
            pair = max(pair, length + mate if mate else 0)
    return (top, one) if pair <= one else None


def _times(counts: _Counts, content: tuple[int, ...]) -> int:
    return min(counts.of[k] // content.count(k) for k in set(content))


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bin contents and how often each is used, for the counted lengths.

    Goes through the lengths from the largest. A fixed content is repeated while its pieces
    last: fewer pieces only mean fewer rivals. Lengths without a proof stay in the instance as
    partners of smaller ones; the rest is packed by best fit, longest first, over groups of
    equal bins. Work and memory depend on the capacity, not on the number of pieces.
    """
    left = _Counts(counts)
    fixed: list[Pattern] = []
    for top in sorted(left.of, reverse=True):
        while top in left.of:
            content = _dominant(left, top, capacity)
            if content is None:
                break
            n = _times(left, content)
            fixed.append((content, n))
            for k in content:
                left.take(k, n)
    return _best_fit(fixed, dict(left.of), capacity)


def _best_fit(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of the counted lengths, also into the room that fixed contents leave."""
    rooms: dict[int, list[Pattern]] = {}
    for content, n in patterns:
        rooms.setdefault(capacity - sum(content), []).append((content, n))
    order = sorted(rooms)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_right(order, length - 1)
            if i == len(order):
                each = capacity // length
                full, rest = divmod(n, each)
                made = [((length,) * each, full)] if full else []
                made += [((length,) * rest, 1)] if rest else []
                n = 0
            else:
                room = order[i]
                content, many = rooms[room].pop()
                each = min(room // length, n)
                used = min(many, n // each)
                made = [(content + (length,) * each, used)]
                if used < many:
                    rooms[room].append((content, many - used))
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
                n -= each * used
            for content, many in made:
                room = capacity - sum(content)
                if room not in rooms:
                    order.insert(bisect_right(order, room), room)
                rooms.setdefault(room, []).append((content, many))
    return [pattern for room in order for pattern in rooms[room]]


def slots_of(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) of each place.

    ``copies`` pieces of the same length lie side by side in every sequence of the pattern.
    """
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for content, n in patterns:
        offset = 0
        for length, copies in Counter(content).items():
            first = used.get(length, 0)
            used[length] = first + n * copies
            slots.append((length, first, used[length], copies, sequence, offset))
            offset += length * copies
        sequence += n
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32, maybe ids).

    Pieces with ids also get ``copy``, which tells the copies of a document apart that are packed several times (from 0).
    Sequences are filled without gaps from offset 0; their numbers are any. Pieces of the same length are
    interchangeable; their ranks go by the doc_id. An empty table gives no rows.
    """
    pieces = pin(pieces)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    split = pieces.withColumn("_part", part)
    sizes = split.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    # At most RANK_PARTS rows per length of the capacity, however many the pieces.
    sizes = pin(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = pieces.sparkSession
    slots = spark.createDataFrame(
        slots_of(reduce_and_fit(counts, capacity)),
        "length long, _first long, _end long, _copies long, _sequence long, _offset long",
    )
    earlier = Window.partitionBy("length").orderBy("_part")
    starts = sizes.select(
        "length", "_part", (F.sum("n").over(earlier) - F.col("n")).alias("_start")
    )
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        split.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_start"))
    )
    if "ids" in pieces.columns:
        alike = Window.partitionBy("length", "_part", "doc_id", "piece", "ids_crc32").orderBy("_rank")
        ranked = ranked.withColumn("copy", F.row_number().over(alike) - 1)
    rank = F.col("_rank")
    placed = ranked.join(F.broadcast(slots), "length").where(
        (rank >= F.col("_first")) & (rank < F.col("_end"))
    )
    at = rank - F.col("_first")
    places = [
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_copies") * F.col("length")).alias("offset"),
    ]
    more = ["copy", "ids"] if "ids" in pieces.columns else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *places, *more)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Tokenise and pack whole documents; one row per piece of a document.

    ``with_ids`` adds ``copy`` and ``ids``, the piece's ids as ``unpack`` reads them, so that the sequences can be
    written out: the pieces of a sequence in the order of their offsets.
    """
    return pack(tokenize(docs, tokenizer_path, capacity, with_ids), capacity)


def unpack(ids: bytes, length: int) -> np.ndarray:
    """The ids of a piece of this length, kept in two or four bytes each, little-endian."""
    return np.frombuffer(ids, f"<u{len(ids) // length}").astype(np.int64)
