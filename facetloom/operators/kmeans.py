"""Many K-means models at once: all of them share every pass over the rows.

Seeds are drawn by k-means|| (Bahmani et al., 2012) for all restarts together; every step of Lloyd's
algorithm moves the centres of all models that still move; silhouettes of the winners take two passes.
Tasks send sums for each centre, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from facetloom.operators.blocks import Block, blocks_of, slot_batch, summed, unpacked

#: Rounds of seeding, and candidates drawn in each for every centre of the largest model.
ROUNDS = 3
OVERSAMPLE = 2
#: Steps of Lloyd's algorithm, and the squared move below which a model has settled.
STEPS = 30
SETTLED = 1e-8

# Multipliers of a 64-bit finalizer.
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Centres:
    """A fitted model; a row belongs to its nearest centre, the first of equally near ones."""

    centres: np.ndarray
    features: str = "features"
    out: str = "cluster"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the number of the nearest centre; null without a vector."""
        turned, lengths = self.centres.T.copy(), (self.centres**2).sum(axis=1)

        @F.pandas_udf(T.IntegerType())
        def nearest(vectors: pd.Series) -> pd.Series:
            known = vectors.notna()
            out = pd.Series([None] * len(vectors), dtype="Int32")
            if known.any():
                x = np.stack(vectors[known].to_list())
                out[known] = (lengths - 2.0 * (x @ turned)).argmin(axis=1)
            return out

        vector = F.col(self.features)
        if not isinstance(df.schema[self.features].dataType, T.ArrayType):
            vector = F.when(vector.isNotNull(), vector_to_array(vector))
        return df.withColumn(self.out, nearest(vector))


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row hash, the same wherever the row lies."""
    x = hashes.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return (x ^ (x >> np.uint64(31))) / 2.0**64


class _Rows:
    """The vectors of a table, kept for many passes."""

    def __init__(self, df: DataFrame, features: str):
        self.spark = df.sparkSession
        hashed = df.select(features, F.xxhash64(features).alias("_hash"))
        # Narrow rows of many passes lie in few files: without this, a few tasks would do all the work. Dealt in
        # turn, so that equal rows do not meet in one task.
        cores = self.spark.sparkContext.defaultParallelism
        if hashed.rdd.getNumPartitions() < cores:
            hashed = hashed.repartition(cores)
        self.table = unpacked(hashed, features, "_hash").persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, given: object, work: Callable[[object, Block, np.ndarray, dict], None]) -> dict[int, np.ndarray]:
        """Slots filled by ``work(given, block, hashes, slots)``, summed over all rows."""
        sent = self.spark.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                hashes = batch.column("_hash").to_numpy()
                for part, block in blocks_of(batch):
                    work(sent.value, block, hashes[part], held)
            yield slot_batch(held)

        found = summed(self.table.mapInArrow(run, "slot int, total array<double>")).collect()
        sent.destroy()
        return {r["slot"]: np.array(r["total"]) for r in found}

    def drawn(self, given: tuple, width: int) -> list[tuple[int, np.ndarray]]:
        """Candidates of a round of seeding: restart and vector, each different row once."""
        sent = self.spark.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            candidates, costs, number, salt = sent.value
            seen: set[tuple[int, int]] = set()
            rows: list[tuple[int, np.ndarray]] = []
            for batch in batches:
                hashes = batch.column("_hash").to_numpy()
                for part, block in blocks_of(batch):
                    norms = block.norms()
                    for restart, centres in enumerate(candidates):
                        far = _squared(block, norms, centres).min(axis=1)
                        chance = number * far / max(costs[restart], 1e-300)
                        some = np.flatnonzero(_uniform(hashes[part], salt * 1009 + restart) < chance)
                        for i in some.tolist():
                            key = (restart, int(hashes[part][i]))
                            if key not in seen:
                                seen.add(key)
                                one = np.zeros(block.rows)
                                one[i] = 1.0
                                vector = np.zeros((width, 1))
                                block.add_turned(one[:, None], vector)
                                rows.append((restart, vector[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))],
                names=["slot", "total"],
            )

        # About ``number`` rows for each restart.
        found = self.table.mapInArrow(run, "slot int, total array<double>").distinct().collect()
        sent.destroy()
        return sorted(((r["slot"], np.array(r["total"])) for r in found), key=lambda r: (r[0], r[1].tolist()))


def _squared(block: Block, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    near = norms[:, None] + (centres**2).sum(axis=1) - 2.0 * block.times(centres.T)
    return np.maximum(near, 0.0)


def _moments(width: int, block: Block, hashes: np.ndarray, held: dict) -> None:
    total = held.setdefault(0, np.zeros(width + 2))
    line = np.zeros((1, width))
    block.add_by_label(np.zeros(block.rows, dtype=np.int64), line)
    total[:width] += line[0]
    total[width] += block.norms().sum()
    total[width + 1] += block.rows


def _candidate_costs(candidates: list[np.ndarray], block: Block, hashes: np.ndarray, held: dict) -> None:
    """For each restart the rows nearest to each candidate, and the cost of all."""
    norms = block.norms()
    for restart, centres in enumerate(candidates):
        near = _squared(block, norms, centres)
        total = held.setdefault(restart, np.zeros(len(centres) + 1))
        total[:-1] += np.bincount(near.argmin(axis=1), minlength=len(centres))
        total[-1] += near.min(axis=1).sum()


def _assigned(models: list[np.ndarray], block: Block, hashes: np.ndarray, held: dict) -> None:
    """For each model and centre the sum and number of its rows, their squared lengths, and the cost."""
    norms = block.norms()
    near = _squared(block, norms, np.concatenate(models))
    low = 0
    for slot, centres in enumerate(models):
        k, width = centres.shape
        mine = near[:, low : low + k]
        label = mine.argmin(axis=1)
        total = held.setdefault(slot, np.zeros((k, width + 3)))
        sums = np.zeros((k, width))
        block.add_by_label(label, sums)
        total[:, :width] += sums
        total[:, width] += np.bincount(label, minlength=k)
        total[:, width + 1] += np.bincount(label, norms, k)
        total[:, width + 2] += np.bincount(label, mine[np.arange(block.rows), label], k)
        low += k


def _silhouettes(given: list[tuple], block: Block, hashes: np.ndarray, held: dict) -> None:
    """For each model the sum of the rows' silhouettes by squared distance."""
    norms = block.norms()
    for slot, (centres, sums, sizes, lengths) in enumerate(given):
        label = _squared(block, norms, centres).argmin(axis=1)
        # The squared distances of a row to all rows of a cluster follow from the cluster's sums.
        all_ = np.maximum(sizes * norms[:, None] + lengths - 2.0 * block.times(sums.T), 0.0)
        here = np.arange(block.rows)
        own = all_[here, label] / np.maximum(sizes[label] - 1, 1)
        mean = np.divide(all_, sizes, out=np.full_like(all_, np.inf), where=sizes > 0)
        mean[here, label] = np.inf
        other = mean.min(axis=1)
        most = np.maximum(own, other)
        score = np.divide(other - own, most, out=np.zeros_like(own), where=(most > 0) & np.isfinite(most))
        score[sizes[label] <= 1] = 0.0
        held.setdefault(slot, np.zeros(1))[0] += score.sum()


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` starting centres from weighted candidates: each drawn far from those before, then moved a little."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        far = ((points[:, None] - np.array(chosen)) ** 2).sum(axis=2).min(axis=1) * weights
        total = far.sum()
        chosen.append(points[rng.choice(len(points), p=far / total)] if total > 0 else chosen[0])
    centres = np.array(chosen)
    for _ in range(5):
        label = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if weights[label == c].sum() > 0:
                centres[c] = np.average(points[label == c], axis=0, weights=weights[label == c])
    return centres


def fit_many(
    df: DataFrame, ks: list[int], restarts: int, features: str = "features", seed: int = 42
) -> dict[int, tuple[np.ndarray, float, int, float]]:
    """For each k the centres of the restart with the least cost, the cost, the clusters with rows, and the silhouette.

    The rows are read about ten times and once for each step, whatever the number of models. Centres without rows
    stay where they are.
    """
    rows = _Rows(df, features)
    try:
        first = rows.table.select(F.size("values").alias("n"), F.array_max("indices").alias("m")).agg(
            F.max(F.when(F.col("m").isNull(), F.col("n"))), F.max("m")
        ).first()
        width = max(first[0] or 0, (first[1] if first[1] is not None else -1) + 1)
        moments = rows.sums(width, _moments).get(0)
        if moments is None or not moments[-1]:
            return {}
        count, mean = moments[-1], moments[:width] / moments[-1]
        cost = max(0.0, float(moments[width] - count * (mean**2).sum()))
        candidates = [mean[None, :] for _ in range(restarts)]
        costs = [cost] * restarts
        number = OVERSAMPLE * max(ks)
        for round_ in range(ROUNDS):
            drawn = rows.drawn((candidates, costs, number, seed * 101 + round_), width)
            for restart in range(restarts):
                new = [vector for slot, vector in drawn if slot == restart]
                # The mean only starts the draw: as a centre it would hold nearly all rows of wide data.
                old = candidates[restart] if round_ or not new else candidates[restart][:0]
                candidates[restart] = np.concatenate([old, *[v[None, :] for v in new]])
            found = rows.sums(candidates, _candidate_costs)
            costs = [found[r][-1] for r in range(restarts)]
        weights = [found[r][:-1] for r in range(restarts)]
        models = {}
        for k in ks:
            for restart in range(restarts):
                rng = np.random.default_rng([seed, k, restart])
                known = weights[restart] > 0
                models[k, restart] = _plus_plus(candidates[restart][known], weights[restart][known], k, rng)

        moving = list(models)
        for _ in range(STEPS):
            found = rows.sums([models[m] for m in moving], _assigned)
            still = []
            for slot, m in enumerate(moving):
                k = m[0]
                total = found[slot].reshape(k, width + 3)
                sizes = total[:, width]
                moved = np.where(sizes[:, None] > 0, total[:, :width] / np.maximum(sizes, 1)[:, None], models[m])
                if ((moved - models[m]) ** 2).sum(axis=1).max() > SETTLED:
                    still.append(m)
                models[m] = moved
            moving = still
            if not moving:
                break

        names = list(models)
        found = rows.sums([models[m] for m in names], _assigned)
        best = {}
        for slot, m in enumerate(names):
            total = found[slot].reshape(m[0], width + 3)
            cost = float(total[:, width + 2].sum())
            if m[0] not in best or cost < best[m[0]][1]:
                best[m[0]] = (models[m], cost, total)
        given = [
            (centres, total[:, :width], total[:, width], total[:, width + 1]) for centres, _, total in best.values()
        ]
        scores = rows.sums(given, _silhouettes)
        return {
            k: (centres, cost, int((total[:, width] > 0).sum()), float(scores[slot][0] / count))
            for slot, (k, (centres, cost, total)) in enumerate(best.items())
        }
    finally:
        rows.table.unpersist()
