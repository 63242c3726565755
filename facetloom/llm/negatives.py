"""Hard negatives for contrastive training, by exact integer products of tiles.

Anchors come in chunks of bounded bytes, candidates stay in their partitions. A tile of anchors times a
tile of candidates is one Strassen product of whole numbers. Each task keeps a heap of the best
candidates for every anchor (its positives), then, once the positives are known, one for
every window that a positive opens; heaps of different tasks merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.session import pin

#: Positives of an anchor, and negatives of each.
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components are ``floor(SCALE * x)``.
SCALE = 256
#: Anchors are the rows whose id is divisible by this.
EVERY = 100
#: Bytes of anchors in a chunk, anchors and candidates in a tile, and the side of products that are not split.
CHUNK_BYTES = 32 * 1024 * 1024
ANCHOR_TILE = 512
CANDIDATE_TILE = 2048
LEAF = 32
#: Products whose entries stay below this are made with 64-bit numbers.
SAFE = 2.0**60


def _small_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product that is not split: in doubles where no sum can reach 2^53."""
    if a.dtype == np.int64 and a.size and b.size:
        most = max(float(a.max()), -float(a.min())) * max(float(b.max()), -float(b.min())) * a.shape[1]
        if most < 2.0**53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices of whole numbers, by seven half-sized products each time.

    Odd sides are padded with zeros. All steps are exact modulo 2^64.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _small_product(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :c], b[:j, c:], b[j:, :c], b[j:, c:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * c), dtype=p1.dtype)
    out[:i, :c] = p1 + p4 - p5 + p7
    out[:i, c:] = p3 + p5
    out[i:, :c] = p2 + p4
    out[i:, c:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers given as doubles.

    The shorter rows count as filled up with zeros. Numbers too large for 64-bit sums are multiplied as numbers
    of any length; scores beyond 64 bits become the nearest that fits.
    """
    width = max(anchors.shape[1], candidates.shape[1], 1)
    a, b = _padded(anchors, width), _padded(candidates, width)
    top = [float(np.abs(x).max(initial=0.0)) for x in (a, b)]
    # Sums inside the recursion may wrap around; results that fit are exact all the same.
    if max(top) < SAFE and top[0] * top[1] * width < SAFE:
        return strassen(a.astype(np.int64), b.astype(np.int64).T)
    whole = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    limit = 2**63 - 1
    return np.clip(strassen(whole[0], whole[1].T), -limit - 1, limit).astype(np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers, in doubles; short ones are filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(lengths.max(initial=0))
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Heaps:
    """The best ``size`` entries of each owner: highest score first, then smallest id."""

    def __init__(self, owners: int, size: int):
        self.size = size
        self.owner, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        #: An entry below this score cannot get in.
        self.floor = np.full(owners, np.iinfo(np.int64).min)

    def add(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Merge entries in."""
        if not len(owner):
            return
        owner, score, id_ = (
            np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, id_))
        )
        # ~score turns the order of whole numbers around without an overflow.
        order = np.lexsort((id_, ~score, owner))
        owner, score, id_ = owner[order], score[order], id_[order]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        place = np.arange(len(owner)) - np.repeat(starts, np.diff([*starts, len(owner)]))
        stay = place < self.size
        full = place == self.size - 1
        self.floor[owner[full]] = score[full]
        self.owner, self.score, self.id = owner[stay], score[stay], id_[stay]


def valid_rows(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label (one in seven moved on), embedding."""

    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    label = F.col("label").cast("long")
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", fine)
    ).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        "embedding",
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, labels and vectors, in tiles that grow so that the heaps fill on little work."""
    size = ANCHOR_TILE // 4
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        rows = _matrix(batch.column("embedding"))
        low = 0
        while low < len(ids):
            cut = slice(low, low + size)
            yield ids[cut], labels[cut], rows[cut]
            low, size = low + size, min(2 * size, CANDIDATE_TILE)


def _out(owner: np.ndarray, heaps: Heaps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.int64()), pa.array(heaps.id, pa.int64()), pa.array(heaps.score, pa.int64())],
        names=["owner", "id", "score"],
    )


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _positive_heaps(chunk) -> Run:
    """For each anchor the best other rows with its label, among a task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = chunk.value
        lows = range(0, len(ids), ANCHOR_TILE)
        held = [Heaps(min(ANCHOR_TILE, len(ids) - low), POSITIVES) for low in lows]
        for their_ids, their_labels, their_rows in _tiles(batches):
            for low, heaps in zip(lows, held, strict=True):
                mine = slice(low, low + ANCHOR_TILE)
                score = scores(rows[mine], their_rows)
                fit = (labels[mine][:, None] == their_labels) & (ids[mine][:, None] != their_ids)
                i, j = np.nonzero(fit & (score >= heaps.floor[:, None]))
                heaps.add(i, score[i, j], their_ids[j])
        for low, heaps in zip(lows, held, strict=True):
            yield _out(low + heaps.owner, heaps)

    return run


def _window_heaps(chunk, opened) -> Run:
    """For each anchor and positive the best rows of other labels inside the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = chunk.value
        least, most = opened.value
        lows = range(0, len(ids), ANCHOR_TILE)
        held = [[Heaps(min(ANCHOR_TILE, len(ids) - low), NEGATIVES) for _ in range(POSITIVES)] for low in lows]
        for their_ids, their_labels, their_rows in _tiles(batches):
            for low, windows in zip(lows, held, strict=True):
                mine = slice(low, low + ANCHOR_TILE)
                score = scores(rows[mine], their_rows)
                other = labels[mine][:, None] != their_labels
                for place, heaps in enumerate(windows):
                    floor = np.maximum(heaps.floor, least[mine, place])[:, None]
                    i, j = np.nonzero(other & (score >= floor) & (score <= most[mine, place][:, None]))
                    heaps.add(i, score[i, j], their_ids[j])
        for low, windows in zip(lows, held, strict=True):
            for place, heaps in enumerate(windows):
                yield _out((low + heaps.owner) * POSITIVES + place, heaps)

    return run


def _merged(rows: DataFrame, run: Run, size: int) -> DataFrame:
    """The heaps of all tasks as one for each owner, with ranks from 1."""
    found = rows.mapInArrow(run, "owner long, id long, score long")
    best = Window.partitionBy("owner").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def _mine_chunk(rows: DataFrame, anchors: pa.Table) -> DataFrame:
    """The result for one chunk of anchors: two passes over the candidates where they lie."""
    spark = rows.sparkSession
    ids, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    matrix = _matrix(anchors.column("embedding").combine_chunks())
    chunk = spark.sparkContext.broadcast((ids, labels, matrix))
    # At most POSITIVES rows for each anchor of the chunk.
    found = _merged(rows, _positive_heaps(chunk), POSITIVES).toArrow()
    owner, place, id_, score = (found.column(c).to_numpy() for c in ("owner", "rank", "id", "score"))
    least = np.ones((len(ids), POSITIVES), dtype=np.int64)
    most = np.zeros((len(ids), POSITIVES), dtype=np.int64)
    # Whole numbers of any length: 90 times a score may not fit into 64 bits.
    least[owner, place - 1] = [-(-LOW * s // 100) for s in score.tolist()]
    most[owner, place - 1] = [HIGH * s // 100 for s in score.tolist()]
    opened = spark.sparkContext.broadcast((least, most))
    windows = _merged(rows, _window_heaps(chunk, opened), NEGATIVES)
    positives = spark.createDataFrame(
        pa.table({
            "owner": owner * POSITIVES + place - 1, "anchor_id": ids[owner], "positive_id": id_, "positive_score": score,
        })
    )
    done = pin(
        windows.join(F.broadcast(positives), "owner").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    opened.destroy()
    chunk.destroy()
    return done


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``EVERY``.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components
    become ``floor(SCALE * x)``; a score is the exact inner product with the anchor; high scores come first, then
    small ids. The positives of an anchor are its first ``POSITIVES`` other rows with its label; each has
    the first ``NEGATIVES`` rows of other labels with ``LOW * positive <= 100 * negative <= HIGH *
    positive``. Where vec_id is divisible by 7, the label first becomes ``(label + 1) % 10``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of
    different lengths are filled up with zeros; scores beyond 64 bits become the nearest that fits. Rows that repeat an
    id are rows of their own as candidates, never of an anchor with that id; equal anchors are asked once.
    Other columns are ignored; an empty table gives no row.

    Chunks of anchors are broadcast; candidates are read twice for each chunk and never shuffled.
    """
    spark = vectors.sparkSession
    rows = valid_rows(vectors)
    anchors = rows.where(F.col("vec_id") % EVERY == 0).distinct()
    size = anchors.agg(F.sum(F.size("embedding") * 8 + 24)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    if chunks > 1:
        anchors = pin(anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(chunks))))
    done = spark.createDataFrame([], _RESULT)
    for number in range(chunks):
        asked = anchors.where(F.col("chunk") == number) if chunks > 1 else anchors
        table = asked.select("vec_id", "label", "embedding").toArrow()
        if len(table):
            done = done.unionByName(_mine_chunk(rows, table))
    return done
