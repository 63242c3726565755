"""Random forests of deep trees, fitted by Spark tasks, as flat arrays; what their votes lose when one feature changes.

Features are cut at up to 31 thresholds, and equal rows become one cell with a count. Nodes of many cells are split by
histograms that Spark sums over all tasks, a level at a time. As soon as a node's cells fit a task, one shuffle brings
them together and its whole subtree is grown there, so that the number of passes does not grow with the number of nodes.
A grown forest stays where the tasks wrote it; ``FlatForest`` holds a small one in memory.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.operators.blocks import Block, blocks_of, unpacked
from facetloom.operators.trees import Packed, Top, Tree, pack
from facetloom.session import ensure_checkpoint_dir, pin

#: (row, tree) pairs that are walked through the forest at a time.
PAIRS = 1 << 18
#: Values of a feature that a split can tell apart.
BINS = 32
#: Codes (cells times features) of a node that one task may hold; larger nodes are split by all tasks.
LOCAL = 1 << 25
#: Numbers of cells up to which nodes are split by sorted cells, not by bins.
FEW = (2, 4, 8)
#: Bytes of packed trees that the driver holds and sends at a time.
SENT = 1 << 25
#: Codes of a piece that is shuffled as one row, and counters of the histograms that are scored at a time.
PIECE = 1 << 20
COUNTERS = 1 << 20


@dataclass
class FlatForest:
    """All nodes of all trees in one set of arrays; leaves have no feature (-1).

    ``kind`` is the line of ``votes`` that a node gives; equal votes share a line.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    kind: np.ndarray
    votes: np.ndarray

    def walk(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The leaf that each pair ends in, and for each step the pairs still on their way and their nodes."""
        node = node.copy()
        active = np.flatnonzero(self.feature[node] >= 0)
        steps = []
        while len(active):
            here = node[active]
            steps.append((active, here))
            lower = x[row[active], self.feature[here]] <= self.threshold[here]
            node[active] = np.where(lower, self.left[here], self.right[here])
            active = active[self.feature[node[active]] >= 0]
        return node, steps

    def guesses(self, x: np.ndarray) -> np.ndarray:
        """The class of each row: the most votes, the first of equal ones."""
        trees = len(self.roots)
        row, root = np.repeat(np.arange(len(x)), trees), np.tile(self.roots, len(x))
        leaf, _ = self.walk(x, row, root)
        return self.votes[self.kind[leaf]].reshape(len(x), trees, -1).sum(axis=1).argmax(axis=1)

    def known_guesses(self, x: np.ndarray) -> np.ndarray | None:
        """The class of each row, if so many rows are equal that each distinct one is walked once; else None."""
        if x.dtype == np.uint8 and x.shape[1] <= 8:
            packed = np.zeros((len(x), 8), dtype=np.uint8)
            packed[:, : x.shape[1]] = x
            _, first, place = np.unique(packed.view(np.uint64).ravel(), return_index=True, return_inverse=True)
            found = x[first]
        else:
            found, place = np.unique(x, axis=0, return_inverse=True)
        if len(found) * 8 > len(x):
            return None
        step = max(1, PAIRS // len(self.roots))
        return np.concatenate([self.guesses(found[low : low + step]) for low in range(0, len(found), step)])[place.ravel()]

    def losses(self, x: np.ndarray, donor: np.ndarray, label: np.ndarray) -> np.ndarray:
        """For each feature the rows guessed right that the donor's value makes wrong, less the reverse.

        A tree is walked again only for rows whose path meets the feature, and only from there on; the votes
        of its old leaf are replaced by those of the new one. No tree is walked again for a row that keeps its guess
        even if all the trees that meet the feature change sides.
        """
        total = np.zeros(x.shape[1], dtype=np.int64)
        # A changed row is made of values that rows have, so few distinct rows mostly mean few changed ones.
        guessed = self.known_guesses(x) if len(x) else None
        if guessed is not None:
            for f in range(x.shape[1]):
                changed = x.copy()
                changed[:, f] = donor[:, f]
                after = self.known_guesses(changed)
                if after is None:
                    break
                total[f] = int((guessed == label).sum()) - int((after == label).sum())
            else:
                return total
            total[:] = 0
        step = max(1, PAIRS // len(self.roots))
        for low in range(0, len(x), step):
            part = slice(low, low + step)
            self._add_losses(x[part], donor[part], label[part], total)
        return total

    def _add_losses(self, x: np.ndarray, donor: np.ndarray, label: np.ndarray, total: np.ndarray) -> None:
        trees = len(self.roots)
        row = np.repeat(np.arange(len(x)), trees)
        leaf, steps = self.walk(x, row, np.tile(self.roots, len(x)))
        if not steps:
            return
        votes = self.votes[self.kind[leaf]].reshape(len(x), trees, -1).sum(axis=1)
        right = votes.argmax(axis=1) == label
        # Where each pair first meets each feature: steps are in order, so the first entry counts.
        pair = np.concatenate([p for p, _ in steps])
        node = np.concatenate([n for _, n in steps])
        feature = self.feature[node]
        changes = x[row[pair], feature] != donor[row[pair], feature]
        pair, node, feature = pair[changes], node[changes], feature[changes]
        # A tree that changes sides takes at most one vote from the guess and gives at most one to another class.
        ranked = np.sort(votes, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if votes.shape[1] > 1 else 0)
        met = np.bincount(row[pair] * x.shape[1] + feature, minlength=x.size).reshape(x.shape)
        open_ = (2 * met >= lead[:, None])[row[pair], feature]
        pair, node, feature = pair[open_], node[open_], feature[open_]
        order = np.lexsort((np.arange(len(pair)), pair, feature))
        pair, node, feature = pair[order], node[order], feature[order]
        first = np.ones(len(pair), dtype=bool)
        first[1:] = (pair[1:] != pair[:-1]) | (feature[1:] != feature[:-1])
        pair, node, feature = pair[first], node[first], feature[first]
        if not len(feature):
            return
        cuts = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
        for low, high in zip(cuts, [*cuts[1:], len(feature)], strict=True):
            f, pairs = feature[low], pair[low:high]
            kept = x[:, f].copy()
            x[:, f] = donor[:, f]
            moved, _ = self.walk(x, row[pairs], node[low:high])
            x[:, f] = kept
            new, old = self.kind[moved], self.kind[leaf[pairs]]
            other = np.flatnonzero(new != old)
            if not len(other):
                continue
            rows, starts = np.unique(row[pairs[other]], return_index=True)
            change = np.add.reduceat(self.votes[new[other]] - self.votes[old[other]], starts, axis=0)
            after = (votes[rows] + change).argmax(axis=1) == label[rows]
            total[f] += int(right[rows].sum()) - int(after.sum())


def flatten(spark: SparkSession, forest: RandomForestClassificationModel, used: list[int]) -> FlatForest:
    """The forest with features numbered by their place in ``used``, read from its saved form.

    Its size is that of the model, which a fit holds on the driver anyway. Votes are rounded to the 40th
    binary place: sums of them are exact, so replaced votes give the same ties as counted ones.
    """
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
    ).toPandas().sort_values(["treeID", "id"], ignore_index=True)
    tree = nodes["treeID"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    begin = np.repeat(start, np.diff([*start, len(tree)]))
    inner = nodes["leftChild"].to_numpy() >= 0
    place = np.full(max(used, default=0) + 1, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    feature = np.full(len(nodes), -1, dtype=np.int64)
    feature[inner] = place[nodes["featureIndex"].to_numpy(dtype=np.int64)[inner]]
    threshold = np.array([
        t[0] if i else 0.0 for i, t in zip(inner, nodes["leftCategoriesOrThreshold"], strict=True)
    ])
    counts = np.stack([np.asarray(s, dtype=np.float64) for s in nodes["impurityStats"]])
    sums = counts.sum(axis=1, keepdims=True)
    votes = np.divide(counts, sums, out=np.zeros_like(counts), where=sums > 0)
    votes = np.round(votes * 2.0**40) / 2.0**40
    # Ids within a tree are its places, from 0 for the root.
    return FlatForest(
        start, feature, threshold, begin + nodes["leftChild"].to_numpy(), begin + nodes["rightChild"].to_numpy(),
        np.arange(len(nodes)), votes,
    )


def thresholds_of(rows: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """Where each feature can be split: between all values of up to ``BINS``, else at quantiles of all rows."""

    def some_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.empty(0) for _ in range(width)]
        for batch in batches:
            for _, block in blocks_of(batch):
                x = dense(block, width)
                if not np.isfinite(x).all():
                    raise ValueError("feature vectors must not hold NaN or infinity")
                for i in range(width):
                    if len(known[i]) <= BINS:
                        known[i] = np.unique(np.concatenate((known[i], x[:, i])))[: BINS + 1]
        at = np.repeat(np.arange(width), [len(k) for k in known])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.concatenate([*known, np.empty(0)]))], names=["position", "value"]
        )

    # At most BINS + 1 values of each feature and task.
    seen = unpacked(rows, features).mapInArrow(some_values, "position int, value double").distinct().toPandas()
    values = {i: np.unique(part) for i, part in seen.groupby("position")["value"]}
    cuts = [np.empty(0)] * width
    many = []
    for i, v in values.items():
        if len(v) > BINS:
            many.append(int(i))
        else:
            cuts[i] = (v[1:] + v[:-1]) / 2
    if many:
        wanted = np.zeros(width, dtype=bool)
        wanted[many] = True

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, block in blocks_of(batch):
                    x = dense(block, width)[:, wanted]
                    at = np.tile(np.flatnonzero(wanted), len(x))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(x.ravel())], names=["position", "value"])

        shares = [i / BINS for i in range(1, BINS)]
        found = (
            unpacked(rows, features).mapInArrow(entries, "position int, value double")
            .groupBy("position").agg(F.percentile_approx("value", shares, 1000).alias("cuts"))
        )
        for r in found.collect():
            cuts[r["position"]] = np.unique(r["cuts"])
    return cuts


def dense(block: Block, width: int) -> np.ndarray:
    """The rows of a block with all their values."""
    if block.at is None:
        return block.values
    x = np.zeros((block.rows, width))
    x[block.row_of(), block.at] = block.values
    return x


def coded(rows: DataFrame, features: str, thresholds: list[np.ndarray], used: list[int] | None = None) -> DataFrame:
    """The rows with ``codes`` instead of the vector: a byte per feature, its thresholds below the value."""
    spark, width = rows.sparkSession, len(thresholds)
    kept = list(range(width)) if used is None else used
    others = [c for c in rows.columns if c != features]
    sent = spark.sparkContext.broadcast(thresholds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            for part, block in blocks_of(batch):
                x = dense(block, width)
                codes = np.empty((len(x), len(kept)), dtype=np.uint8)
                for j, i in enumerate(kept):
                    codes[:, j] = np.searchsorted(cuts[i], x[:, i], side="left")
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in others], pa.array([r.tobytes() for r in codes], pa.binary())], names=[*others, "codes"]
                )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return unpacked(rows, features, *others).mapInArrow(code, f"{kinds}, codes binary")


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of codes as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Grower:
    """How trees grow. A node is numbered by its way from the root: 1, then 2i to the left and 2i + 1 to the right.

    Its features are drawn by a hash of the seed, the tree and this number, so a tree does not depend on where it grows.
    """

    trees: int
    depth: int
    seed: int
    width: int
    classes: int

    def subsets(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        """The features that each node may be split by: the root of their number, rounded up; all for a single tree."""
        n = self.width if self.trees == 1 else math.ceil(math.sqrt(self.width))
        start = _mix(np.array([self.seed * 1_000_003 + tree + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        drawn = _mix(_mix(nodes.astype(np.uint64) ^ start)[:, None] + np.arange(1, self.width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return np.sort(np.argpartition(drawn, n - 1, axis=1)[:, :n], axis=1)

    def weights(self, codes: bytes, label: int, rows: int) -> np.ndarray:
        """How often each tree draws the equal rows of a cell: a Poisson number with their count as its mean."""
        if self.trees == 1:
            return np.array([rows])
        digest = hashlib.blake2b(codes, digest_size=16, salt=label.to_bytes(8, "little")).digest()
        return np.random.default_rng([self.seed, int.from_bytes(digest, "little")]).poisson(rows, self.trees)

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best split of each node by ``counts`` (node, feature, bin, class): feature's place, bin, whether it gains."""
        low = counts.cumsum(axis=2)
        total = low[:, :1, -1, :]
        low = low[:, :, :-1]
        n, square = total.sum(axis=2), (total**2).sum(axis=2)
        left = low.sum(axis=3)
        right = n[:, :, None] - left
        own = np.einsum("akbc,akbc->akb", low, low)
        rest = square[:, :, None] - 2 * np.einsum("akbc,ac->akb", low, total[:, 0]) + own
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((left > 0) & (right > 0), own / left + rest / right, -np.inf).reshape(len(counts), -1)
        at = score.argmax(axis=1)
        most = score[np.arange(len(at)), at]
        gains = most - (square / n)[:, 0] > 1e-12 * n[:, 0]
        place, cut = np.divmod(at, BINS - 1)
        return place, cut, gains

    def grow(self, tree: int, root: int, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """The subtree of a node by its cells: feature (-1: leaf), cut, left child's place (the right one follows), counts."""
        features, cuts, lefts, counts = [], [], [], []
        ids, slot, rows, made = np.array([root], dtype=np.int64), np.zeros(len(label), dtype=np.int64), np.arange(len(label)), 1
        level = root.bit_length() - 1
        while len(ids):
            totals = np.bincount(slot * self.classes + label[rows], weight[rows], len(ids) * self.classes).reshape(len(ids), -1)
            feature, cut, left = np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.uint8), np.zeros(len(ids), np.int32)
            opened = np.flatnonzero(((totals > 0).sum(axis=1) > 1) & (level < self.depth))
            if len(opened):
                self._split(tree, ids, opened, slot, codes[rows], label[rows], weight[rows], feature, cut)
            split = feature >= 0
            rank = np.cumsum(split) - 1
            left[split] = made + 2 * rank[split]
            made += 2 * int(split.sum())
            features.append(feature)
            cuts.append(cut)
            lefts.append(left)
            counts.append(totals)
            stays = split[slot]
            rows, slot = rows[stays], slot[stays]
            right = codes[rows, feature[slot]] > cut[slot]
            slot = 2 * rank[slot] + right
            order = np.argsort(slot, kind="stable")
            rows, slot = rows[order], slot[order]
            ids = np.repeat(2 * ids[split], 2)
            ids[1::2] += 1
            level += 1
        return tuple(np.concatenate(x) for x in (features, cuts, lefts, counts))

    def best_of_few(self, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` for nodes of a few cells: ``codes`` (node, cell, feature), ``label`` and ``weight`` (node, cell), filled up with
        code 255 and weight 0. Cells are sorted by code instead of counted by bin; sums and order are the same."""
        nodes, cells, _ = codes.shape
        order = codes.argsort(axis=1, kind="stable")
        codes = np.take_along_axis(codes, order, axis=1)
        # Classes are named by their first cell.
        own = (label[:, :, None] == label[:, None, :]).argmax(axis=2)
        by_class = np.zeros((nodes, cells, cells))
        by_class[np.arange(nodes)[:, None], np.arange(cells), own] = weight
        total = by_class.sum(axis=1)
        low = by_class[np.arange(nodes)[:, None, None], order[:, :-1]].cumsum(axis=1)
        n, square = total.sum(axis=1), (total**2).sum(axis=1)
        left = low.sum(axis=3)
        right = n[:, None, None] - left
        inside = np.einsum("npkc,npkc->npk", low, low)
        rest = square[:, None, None] - 2 * np.einsum("npkc,nc->npk", low, total) + inside
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((left > 0) & (right > 0) & (codes[:, 1:] > codes[:, :-1]), inside / left + rest / right, -np.inf)
        score = score.transpose(0, 2, 1).reshape(nodes, -1)
        at = score.argmax(axis=1)
        most = score[np.arange(nodes), at]
        place, cell = np.divmod(at, cells - 1)
        return place, codes[np.arange(nodes), cell, place], most - square / n > 1e-12 * n

    def _split(self, tree, ids, opened, slot, codes, label, weight, feature, cut) -> None:  # noqa: ANN001
        """Fill in feature and cut of the nodes that gain by a split; rows are in the order of their node."""
        begins, ends = np.searchsorted(slot, opened), np.searchsorted(slot, opened, side="right")
        sizes = ends - begins
        n = self.width if self.trees == 1 else math.ceil(math.sqrt(self.width))
        least = 0
        for most in FEW:
            few = np.flatnonzero((sizes > least) & (sizes <= most))
            step = max(1, COUNTERS // (n * most * most))
            for low in range(0, len(few), step):
                some = few[low : low + step]
                at = begins[some][:, None] + np.arange(most)
                beyond = at >= ends[some][:, None]
                at[beyond] = 0
                subset = self.subsets(tree, ids[opened[some]])
                cells = codes[at[:, :, None], subset[:, None, :]]
                cells[beyond] = 255
                place, best, gains = self.best_of_few(cells, label[at], np.where(beyond, 0.0, weight[at]))
                feature[opened[some[gains]]] = subset[np.flatnonzero(gains), place[gains]]
                cut[opened[some[gains]]] = best[gains]
            least = most
        many = sizes > least
        opened, begins, sizes = opened[many], begins[many], sizes[many]
        step = max(1, COUNTERS // (n * BINS * self.classes))
        for low in range(0, len(opened), step):
            some = opened[low : low + step]
            size = sizes[low : low + step]
            at = np.repeat(np.arange(len(some)), size)
            rows = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[low : low + step], size)
            subset = self.subsets(tree, ids[some])
            place, best, gains = self.best(self.histogram(subset, at, codes[rows], label[rows], weight[rows]))
            feature[some[gains]] = subset[np.flatnonzero(gains), place[gains]]
            cut[some[gains]] = best[gains]

    def histogram(self, subset: np.ndarray, at: np.ndarray, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weights by node, feature of its subset, bin and class; row ``i`` is in node ``at[i]``."""
        n, k = subset.shape
        key = (at[:, None] * k + np.arange(k)) * BINS + np.take_along_axis(codes, subset[at], axis=1)
        key = key * self.classes + label[:, None]
        return np.bincount(key.ravel(), np.repeat(weight, k), n * k * BINS * self.classes).reshape(n, k, BINS, self.classes)


def _down(top: Top, codes: np.ndarray) -> np.ndarray:
    """The number of the node below the split ones that each cell is in."""
    node = np.ones(len(codes), dtype=np.int64)
    for number in sorted(top.splits):
        feature, cut = top.splits[number]
        here = np.flatnonzero(node == number)
        node[here] = 2 * number + (codes[here, feature] > cut)
    return node


def _drawn(batches: Iterator[pa.RecordBatch], grower: Grower) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, labels and each tree's weights of some cells at a time."""
    step = max(1, PIECE // max(grower.width, grower.trees))
    for whole in batches:
        for low in range(0, whole.num_rows, step):
            batch = whole.slice(low, step)
            raw = batch.column("codes").to_pylist()
            label = batch.column("label").to_numpy()
            weights = [grower.weights(*r) for r in zip(raw, label.tolist(), batch.column("n").to_pylist(), strict=True)]
            yield np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), grower.width), label, np.stack(weights)


def _tops(cells: DataFrame, grower: Grower) -> list[Top]:
    """Split nodes by sums over all tasks until each node's cells fit one."""
    spark = cells.sparkSession
    tops = [Top() for _ in range(grower.trees)]
    # A tree has no more cells than there are.
    large = {(t, 1) for t in range(grower.trees)} if cells.count() * grower.width > LOCAL else set()
    while large:
        sent = spark.sparkContext.broadcast((tops, large))

        def count(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            tops, large = sent.value
            held: dict[tuple[int, int], np.ndarray] = {}
            nodes: dict[int, list[int]] = {}
            for t, number in sorted(large):
                nodes.setdefault(t, []).append(number)
            for codes, label, weights in _drawn(batches, grower):
                for t, numbers in nodes.items():
                    at = _down(tops[t], codes)
                    for number in numbers:
                        rows = np.flatnonzero((at == number) & (weights[:, t] > 0))
                        if not len(rows):
                            continue
                        subset, one = grower.subsets(t, np.array([number])), np.zeros(len(rows), dtype=np.int64)
                        added = np.stack([
                            grower.histogram(subset, one, codes[rows], label[rows], w)[0]
                            for w in (weights[rows, t], np.ones(len(rows)))
                        ])
                        held[t, number] = held[t, number] + added if (t, number) in held else added
            for (t, number), total in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([number], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))],
                    names=["tree", "node", "total"],
                )

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for t, number, total in zip(*(batch.column(c) for c in ("tree", "node", "total")), strict=True):
                    key, values = (t.as_py(), number.as_py()), total.values.to_numpy()
                    held[key] = held[key] + values if key in held else values
            out = []
            for (t, number), values in held.items():
                weight, one = values.reshape(2, 1, -1, BINS, grower.classes)
                place, cut, gains = grower.best(weight)
                p, c = int(place[0]), int(cut[0])
                cells = one[0, p].sum(axis=1)
                split = gains[0] and number.bit_length() - 1 < grower.depth
                feature = int(grower.subsets(t, np.array([number]))[0, p]) if split else -1
                by_class = weight[0, 0].sum(axis=0).tolist()
                out.append((t, number, feature, c, int(cells[: c + 1].sum()), int(cells[c + 1 :].sum()), by_class))
            names = ["tree", "node", "feature", "cut", "low", "high", "counts"]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names
            )

        parts = cells.mapInArrow(count, "tree int, node long, total array<double>")
        # One row per node that is too large for a task.
        found = parts.repartition("tree", "node").mapInArrow(
            choose, "tree int, node long, feature int, cut int, low long, high long, counts array<double>"
        ).collect()
        sent.destroy()
        large = set()
        for t, number, feature, cut, low, high, counts in found:
            if feature < 0:
                tops[t].leaves[number] = counts
                continue
            tops[t].splits[number] = (feature, cut)
            large |= {(t, child) for child, n in ((2 * number, low), (2 * number + 1, high)) if n * grower.width > LOCAL}
    return tops


def grow_forest(
    rows: DataFrame, features: str, label: str, thresholds: list[np.ndarray], classes: int, trees: int, depth: int, seed: int
) -> GrownForest:
    """A random forest over coded features, left where the tasks wrote it.

    Trees are grown as Spark's ``RandomForestClassifier`` does: Poisson draws of the rows for each tree, the best Gini gain among
    the root of the number of features at each node, until nodes are pure, no split gains or ``depth`` is reached. The
    trees do not depend on how the rows are dealt to tasks.
    """
    spark = rows.sparkSession
    grower = Grower(trees, depth, seed, len(thresholds), classes)
    cores = spark.sparkContext.defaultParallelism
    cells = pin(
        coded(rows.select(F.col(label).cast("int").alias("label"), features), features, thresholds)
        .groupBy("label", "codes").agg(F.count(F.lit(1)).alias("n"))
        .repartition(cores, "label", "codes")
    )
    tops = _tops(cells, grower)
    sent = spark.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, label, weights in _drawn(batches, grower):
            for t, top in enumerate(sent.value):
                at = _down(top, codes)
                drawn = weights[:, t] > 0
                for number in set(np.unique(at[drawn]).tolist()) - top.leaves.keys():
                    own = np.flatnonzero(drawn & (at == number))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([t], pa.int32()), pa.array([number], pa.int64()), pa.array([codes[own].tobytes()], pa.binary()),
                            pa.array([label[own].astype(np.int32).tobytes()], pa.binary()),
                            pa.array([weights[own, t].astype(np.int64).tobytes()], pa.binary()),
                        ],
                        names=["tree", "node", "codes", "label", "weight"],
                    )

    def grown(tree: int, number: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        codes, label, weight = (b"".join(x) for x in zip(*held, strict=True))
        feature, cut, _, counts = grower.grow(
            tree, number, np.frombuffer(codes, np.uint8).reshape(-1, grower.width),
            np.frombuffer(label, np.int32).astype(np.int64), np.frombuffer(weight, np.int64).astype(np.float64),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([tree], pa.int32()), pa.array([number], pa.int64()), *[pa.array([p], pa.binary()) for p in pack(feature, cut, counts, grower.width)]],
            names=["tree", "node", "feature", "value", "mixed"],
        )

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for t, number, *blobs in zip(*batch.to_pydict().values(), strict=True):
                if held and (t, number) != last:
                    yield grown(*last, held)
                    held = []
                last = (t, number)
                held.append(tuple(blobs))
        if held:
            yield grown(*last, held)

    parts = max(2 * cores, min(2000, sum(len(t.splits) + 1 for t in tops)))
    built = pin(
        cells.mapInArrow(deal, "tree int, node long, codes binary, label binary, weight binary")
        .repartition(parts, "tree", "node").sortWithinPartitions("tree", "node")
        .mapInArrow(subtrees, "tree int, node long, feature binary, value binary, mixed binary")
    )
    sent.destroy()
    return GrownForest(built, tops, grower)


@dataclass
class GrownForest:
    """The subtrees of a forest as packed rows in the shared folder, below the nodes that all tasks split."""

    built: DataFrame
    tops: list[Top]
    grower: Grower

    def groups(self) -> Iterator[list[tuple[int, Top, Packed]]]:
        """All trees that drew a row, some at a time: ``SENT`` bytes of subtrees, or one tree if that is larger."""
        size = F.octet_length("feature") + F.octet_length("value") + F.octet_length("mixed")
        whole = self.built.agg(F.sum(size.cast("long"))).first()[0] or 0
        dealt = self.built.repartition(-(-2 * whole // SENT) or 1, "tree").sortWithinPartitions("tree")
        left = {t for t, top in enumerate(self.tops) if top.splits or top.leaves}
        group: dict[int, Packed] = {}
        held = 0
        # One part at a time comes to the driver.
        for r in dealt.toLocalIterator():
            if r["tree"] not in group and held >= SENT:
                yield [(t, self.tops[t], parts) for t, parts in group.items()]
                group, held = {}, 0
            packed = tuple(bytes(r[c]) for c in ("feature", "value", "mixed"))
            group.setdefault(r["tree"], {})[r["node"]] = packed
            held += sum(map(len, packed))
            left.discard(r["tree"])
        # Trees of large leaves alone.
        group |= {t: {} for t in left}
        if group:
            yield [(t, self.tops[t], parts) for t, parts in group.items()]


def fit_forest(
    rows: DataFrame, features: str, label: str, thresholds: list[np.ndarray], classes: int, trees: int, depth: int, seed: int
) -> tuple[FlatForest, list[int]]:
    """The forest of ``grow_forest`` in the driver's memory, and the features that it uses, by which its nodes number them."""
    grown = grow_forest(rows, features, label, thresholds, classes, trees, depth, seed)
    width = grown.grower.width
    found = {t: Tree.unpacked(top, parts, width, classes) for group in grown.groups() for t, top, parts in group}
    # A tree that drew no row votes for no class.
    each = [found[t] if t in found else Tree.unpacked(Top(), {}, width, classes) for t in range(trees)]
    begins = np.cumsum([0, *[len(t.feature) for t in each]])
    lines = np.cumsum([classes, *[len(t.table) for t in each]])
    feature = np.concatenate([t.feature for t in each])
    used = np.unique(feature[feature >= 0])
    renamed = np.full(width + 1, -1)
    renamed[used] = np.arange(len(used))
    left = np.concatenate([t.left + begin for t, begin in zip(each, begins, strict=False)])
    kind = np.concatenate([np.where(t.kind < classes, t.kind, t.kind + line - classes) for t, line in zip(each, lines, strict=False)])
    votes = np.concatenate([np.eye(classes), *[t.table for t in each]])
    return FlatForest(begins[:-1], renamed[feature], np.concatenate([t.cut for t in each]), left, left + 1, kind, votes), used.tolist()
