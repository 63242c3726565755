"""Approximate nearest neighbours over balanced posting lists.

Vectors are dealt to the lists of their nearest centroids; a vector near a boundary goes to
several lists. The centroids are searched through a neighbour graph in memory. A query reads the lists
whose centroid is at most a ratio farther than its nearest one, however many they are. The ratio is measured on the
table: some queries are compared with all vectors, and the lists that hold their neighbours
tell which ratio reaches the recall. The vectors of these lists are compared exactly. Long lists are
cut into blocks, so no list has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.session import pin

#: Documented bounds of the fit: centroids, and sampled vectors per centroid.
CENTROIDS = 8192
SAMPLE_EACH = 25
#: Vectors per centroid, until there are ``CENTROIDS``.
LIST = 100
#: A vector also goes to lists whose centroid is at most this much farther than the nearest.
BOUNDARY = 1.10
COPIES = 3
#: The ratio gives the measured queries (at most so many) this recall.
RECALL = 0.97
MEASURED = 100
#: Edges of a centroid to near ones, and to any, which keep the graph in one piece.
NEIGHBOURS = 16
SHORTCUTS = 4
#: Centroids that a search takes up first, and expands at once.
WIDTH = 64
EXPANDED = 4
BLOCK = 4096
#: Found neighbours that a task holds before it keeps the best of each query.
COMBINED = 200_000
#: Vectors whose centroids are searched at once.
AT_ONCE = 1024
TOP = 10
QUERY_EVERY = 100


@dataclass
class Centroids:
    """Centroid vectors and, for each, the numbers of the centroids that its edges lead to."""

    vectors: np.ndarray
    graph: np.ndarray

    def nearest(self, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``n`` nearest centroids of each point, nearest first.

        A best-first search in the graph, for all points in step: each expands the nearest centroids it has not
        expanded, until those it would return all are.
        """
        k, n = len(self.vectors), min(n, len(self.vectors))
        square = (self.vectors**2).sum(1)
        entries = np.unique(np.linspace(0, k - 1, max(WIDTH, math.isqrt(k))).astype(int))
        ids = np.tile(entries, (len(points), 1))
        far = _distances(points, self.vectors[entries])
        expanded = np.zeros(ids.shape, dtype=bool)
        seen = np.zeros((len(points), k), dtype=bool)
        seen[:, entries] = True
        width = max(n, WIDTH)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            ids, far, expanded = (np.take_along_axis(x, order, axis=1) for x in (ids, far, expanded))
            rows = np.flatnonzero((~expanded & np.isfinite(far)).any(axis=1))
            if not len(rows):
                break
            waiting = np.where(expanded[rows], np.inf, far[rows])
            take = np.argsort(waiting, axis=1, kind="stable")[:, :EXPANDED]
            expanded[rows[:, None], take] = True
            new = np.sort(self.graph[ids[rows[:, None], take]].reshape(len(rows), -1), axis=1)
            known = seen[rows[:, None], new]
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            seen[rows[:, None], new] = True
            there = square[new] - 2 * np.einsum("pd,pnd->pn", points[rows], self.vectors[new])
            there = np.maximum(there + (points[rows] ** 2).sum(1)[:, None], 0)
            added = np.full((len(points), new.shape[1]), np.inf)
            added[rows] = np.where(known, np.inf, there)
            more = np.zeros((len(points), new.shape[1]), dtype=ids.dtype)
            more[rows] = new
            ids, far = np.hstack((ids, more)), np.hstack((far, added))
            expanded = np.hstack((expanded, np.zeros(more.shape, dtype=bool)))
        return ids[:, :n], np.sqrt(far[:, :n])

    def within(self, points: np.ndarray, ratio: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, centroid) pairs: the centroids at most ``ratio`` farther than each point's nearest one.

        A nearest distance below ``floor`` counts as this. The search widens until it leaves the ratio behind.
        """
        left, n = np.arange(len(points)), WIDTH
        out = []
        while len(left):
            ids, far = self.nearest(points[left], n)
            reach = ratio * np.maximum(far[:, 0], floor) * (1 + 1e-9)
            row, rank = np.nonzero(far <= reach[:, None])
            done = (far[:, -1] > reach) | (n >= len(self.vectors))
            here = done[row]
            out.append((left[row[here]], ids[row[here], rank[here]]))
            left, n = left[~done], 2 * n
        if not out:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, for choosing centroids."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.maximum(square, 0)


def _nearest(vectors: np.ndarray, centres: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, float]:
    """The cheapest centre of each vector, in blocks, and the mean squared distance to it."""
    owner, total = [], 0.0
    for low in range(0, len(vectors), 4096):
        square = _distances(vectors[low : low + 4096], centres)
        best = (square + extra).argmin(1)
        owner.append(best)
        total += square[np.arange(len(best)), best].sum()
    return np.concatenate(owner), total / max(1, len(vectors))


def _edges(centres: np.ndarray) -> np.ndarray:
    """The edges of each centroid: near ones in different directions, then the nearest of the rest.

    One that is nearer to a chosen one than to the centroid can be reached through that.
    """
    k = len(centres)
    m, n = min(4 * NEIGHBOURS, k), min(NEIGHBOURS, k)
    graph = np.empty((k, n), dtype=np.int64)
    for low in range(0, k, 512):
        square = _distances(centres[low : low + 512], centres)
        some = np.argpartition(square, m - 1, axis=1)[:, :m]
        there = np.take_along_axis(square, some, axis=1)
        order = np.argsort(there, axis=1, kind="stable")
        some, there = (np.take_along_axis(x, order, axis=1) for x in (some, there))
        for i in range(len(some)):
            between = _distances(centres[some[i]], centres[some[i]])
            free = np.ones(m, dtype=bool)
            chosen = []
            while free.any() and len(chosen) < n:
                chosen.append(int(free.argmax()))
                free &= between[chosen[-1]] >= there[i]
                free[chosen[-1]] = False
            rest = np.setdiff1d(np.arange(m), chosen)[: n - len(chosen)]
            graph[low + i] = some[i][np.concatenate((np.array(chosen, dtype=int), rest))]
    return graph


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> Centroids:
    """Balanced k-means: a full cluster makes itself dearer, so lists stay of like length."""
    random = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    k = min(k, len(distinct))
    centres = distinct[random.choice(len(distinct), k, replace=False)].astype(float)
    extra = np.zeros(k)
    for _ in range(rounds):
        owner, step = _nearest(sample, centres, extra)
        sizes = np.bincount(owner, minlength=k)
        extra = np.clip(extra + 0.1 * step * (sizes / max(1.0, len(sample) / k) - 1), 0, step)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
    return Centroids(centres, np.hstack((_edges(centres), random.integers(0, k, (k, SHORTCUTS)))))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part.

    Null and empty vectors, zero vectors, null ids, and vectors with null or non-finite components are
    left out; so are vectors whose width is not the most frequent one.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    infinite = float("inf")
    good = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(infinite))
    )
    rows = rows.where(good).where(F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("embedding") == (width["w"] if width else 0))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def build_lists(rows: DataFrame, n_rows: int) -> tuple[DataFrame, Centroids]:
    """Posting lists (list, block, vec_id, embedding) of every vector, and their centroids."""
    spark = rows.sparkSession
    k = min(CENTROIDS, max(1, n_rows // LIST))
    share = min(1.0, SAMPLE_EACH * k / max(n_rows, 1))
    at = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(at < share) if share < 1 else rows
    sample = _matrix(chosen.select("embedding").toPandas()["embedding"])
    centroids = fit_centroids(sample, k)
    shared = spark.sparkContext.broadcast(centroids)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            for low in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[low : low + AT_ONCE]
                near, there = known.nearest(_matrix(part["embedding"]), COPIES)
                row, rank = np.nonzero(there <= BOUNDARY * there[:, :1])
                made = part.iloc[row].copy()
                made["list"] = near[row, rank]
                yield made[["list", "vec_id", "embedding"]]

    lists = rows.mapInPandas(deal, "list int, vec_id long, embedding array<double>")
    return lists, centroids


def _best(found: pd.DataFrame, top: int) -> pd.DataFrame:
    """The nearest of each query; ties go to the smaller id."""
    order = found.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
    return order.groupby("query_id", sort=False).head(top)


def _nearest_of_all(rows: DataFrame, asked: DataFrame, top: int) -> pd.DataFrame:
    """query_id, vec_id, score: the nearest of few queries among all rows."""
    queries = asked.toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(
        (queries["vec_id"].to_numpy(), _matrix(queries["embedding"]))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, points = shared.value
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            own, there = pdf["vec_id"].to_numpy(), _matrix(pdf["embedding"])
            for low in range(0, len(own), 2048):
                part = own[low : low + 2048]
                square = _distances(points, there[low : low + 2048])
                found = pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, len(part)),
                        "vec_id": np.tile(part, len(ids)),
                        "score": np.sqrt(square).reshape(-1),
                    }
                )
                found = found[found["query_id"] != found["vec_id"]]
                best = _best(found if best is None else pd.concat([best, found]), top)
        if best is not None:
            yield best

    schema = "query_id long, vec_id long, score double"
    parts = rows.mapInPandas(compare, schema)
    return parts.groupBy("query_id").applyInPandas(lambda pdf: _best(pdf, top), schema).toPandas()


def ratio_to_read(
    rows: DataFrame, lists: DataFrame, centroids: Centroids, every: int, top: int
) -> tuple[float, float]:
    """The distance ratio that gives the measured queries the recall ``RECALL``, and the floor below it.

    A neighbour is found if one of the lists that hold it is within the ratio. The quantile of the ratios
    that this takes is where the ratio starts; it grows until the search in the graph finds as much. The floor, for
    queries that lie on a centroid, is the tenth of the measured queries' distances to their nearest centroids.
    """
    spark, k = rows.sparkSession, len(centroids.vectors)
    asked = (
        rows.where(F.col("vec_id") % every == 0)
        .dropDuplicates(["vec_id"])
        .orderBy(F.xxhash64(F.lit("measured"), "vec_id"), "vec_id")
        .limit(MEASURED)
    )
    asked = pin(asked)
    near = _nearest_of_all(rows, asked, top)
    if not len(near):
        return 1.0, 0.0
    ids = spark.createDataFrame([(int(i),) for i in near["vec_id"].unique()], "vec_id long")
    held = lists.join(F.broadcast(ids), "vec_id").select("vec_id", "list").distinct().toPandas()
    places = held.groupby("vec_id")["list"].apply(lambda x: x.to_numpy()).to_dict()
    queries = asked.toPandas()
    points = _matrix(queries["embedding"])
    far = np.sqrt(_distances(points, centroids.vectors))
    floor = float(np.quantile(far.min(axis=1), 0.1))
    at = {int(q): i for i, q in enumerate(queries["vec_id"])}
    wanted = [(at[q], places[i]) for q, i in zip(near["query_id"], near["vec_id"], strict=True)]
    base = np.maximum(far.min(axis=1), floor)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = sorted(max(1.0, float(np.nan_to_num(far[q, own].min() / base[q], nan=1.0))) for q, own in wanted)
    ratio = needed[math.ceil(RECALL * len(needed)) - 1]
    while math.isfinite(ratio):
        read = np.zeros(far.shape, dtype=bool)
        read[centroids.within(points, ratio, floor)] = True
        if read.all() or sum(bool(read[q, own].any()) for q, own in wanted) >= RECALL * len(wanted):
            break
        ratio *= 1.02
    return ratio, floor


def search(vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP) -> DataFrame:
    """The ``top`` nearest vectors of each vector whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the Euclidean distance in double precision,
    nearest first, ties to the smaller id, the query's own id left out. Rows that repeat an id count once. All
    vectors are indexed; see ``usable`` for those that take no part. A query that reads fewer than ``top``
    vectors reads all lists.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = pin(usable(vectors))
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt, centroids = build_lists(rows, n_rows)
    lists = pin(dealt)
    # One row per centroid, at most ``CENTROIDS``.
    sizes = pin(lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")))
    counted = sizes.toPandas()
    many = np.zeros(len(centroids.vectors), dtype=np.int64)
    many[counted["list"].to_numpy(dtype=int)] = counted["size"]
    ratio, floor = ratio_to_read(rows, lists, centroids, every, top)
    shared = spark.sparkContext.broadcast((centroids, many))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, many = shared.value
        everything = np.arange(len(many))
        for pdf in batches:
            for low in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[low : low + AT_ONCE].rename(columns={"vec_id": "query_id", "embedding": "vector"})
                point, at = known.within(_matrix(part["vector"]), ratio, floor)
                read = np.bincount(point, weights=many[at], minlength=len(part))
                few = np.flatnonzero(read <= COPIES * (top + 1))
                stays = ~np.isin(point, few)
                point = np.concatenate((point[stays], np.repeat(few, len(many))))
                at = np.concatenate((at[stays], np.tile(everything, len(few))))
                blocks = -(-many[at] // BLOCK)
                block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                made = part.iloc[np.repeat(point, blocks)][["query_id", "vector"]]
                yield made.assign(list=np.repeat(at, blocks), block=block)

    queries = (
        rows.where(F.col("vec_id") % every == 0)
        .dropDuplicates(["vec_id", "embedding"])
        .mapInPandas(route, "query_id long, vector array<double>, list int, block int")
    )
    # A long list is cut by the hash of the id; a query goes to all its blocks.
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / F.lit(BLOCK))).cast("int")
    posted = lists.join(F.broadcast(sizes), "list").withColumn("block", block).drop("size")

    def nearest_held(asked: pd.DataFrame, ids: np.ndarray, there: np.ndarray) -> pd.DataFrame:
        out = []
        for query, vector in zip(asked["id"], asked["vector"], strict=True):
            far = np.sqrt(((there - np.asarray(vector, dtype=np.float64)) ** 2).sum(1))
            order = np.lexsort((ids, far))
            order = order[ids[order] != query]
            first = np.sort(np.unique(ids[order], return_index=True)[1])
            order = order[first[:top]]
            out.append((np.full(len(order), query), ids[order], far[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block's vectors come before its queries; a task sends the best of a query over its blocks once."""
        place, held, found, n = None, [], [], 0
        for pdf in batches:
            marks = pdf[["list", "block", "asked"]].to_numpy(dtype=np.int64)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if low == high:
                    continue
                some = pdf.iloc[low:high]
                if tuple(marks[low, :2]) != place:
                    place, held = tuple(marks[low, :2]), []
                if not marks[low, 2]:
                    held.append((some["id"].to_numpy(), _matrix(some["vector"])))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    found.append(nearest_held(some, *held[0]))
                    n += len(found[-1])
                if n > COMBINED:
                    found = [_best(pd.concat(found), top)]
                    n = len(found[0])
                    if n > COMBINED // 2:
                        yield found.pop()
                        n = 0
        if found:
            yield _best(pd.concat(found), top)

    both = posted.select("list", "block", F.lit(0).alias("asked"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    both = both.unionByName(queries.select("list", "block", F.lit(1).alias("asked"), F.col("query_id").alias("id"), "vector"))
    ordered = both.repartition("list", "block").sortWithinPartitions("list", "block", "asked")
    found = ordered.mapInPandas(compare, schema)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        best = _best(pdf, top)
        return best.assign(rank=range(1, len(best) + 1))[["query_id", "rank", "vec_id", "score"]]

    return found.groupBy("query_id").applyInPandas(
        finish, "query_id long, rank int, vec_id long, score double"
    )
