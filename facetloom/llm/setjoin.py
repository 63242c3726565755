"""Exact verification of similar sets inside buckets, and components of their links.

Shared by the joins that find candidates: they give buckets of items that may be similar. Items
of a bucket are compared by blocks, so a large bucket is spread over many tasks; a pair is
looked at in the smallest bucket that both items are in and nowhere else. Only counts and
star edges leave a block, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.groups import Columns, each_group
from facetloom.session import pin

SKETCH = 128
SKETCH_BLOCK = 2048
SET_BLOCK = 1024
#: Standard errors below the threshold at which a sketch rules a pair out.
MARGIN = 5.0


def sketch_of(hashes: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of ``SKETCH`` bins; empty bins borrow the next."""
    place = (hashes >> np.uint64(57)).astype(np.int64)
    lowest = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(lowest, place, hashes & np.uint64((1 << 57) - 1))
    filled = np.flatnonzero(lowest != np.iinfo(np.uint64).max)
    if not len(filled):
        return bytes(SKETCH)
    source = filled[np.searchsorted(filled, np.arange(SKETCH)) % len(filled)]
    # A borrowed value depends on the distance too, so that borrowings agree only if both are such.
    apart = ((source - np.arange(SKETCH)) % SKETCH).astype(np.uint64)
    value = (lowest[source] + apart * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(56)).astype(np.uint8).tobytes()


def in_blocks(members: DataFrame, block: int, id_column: str) -> DataFrame:
    """Every member once per pair of blocks of its bucket: adds ``_pair`` and ``_side``.

    A bucket of up to ``block`` members is one block. ``_side`` is 0 for members of the
    first block of the pair, 1 for the second, and 2 where a block meets itself.
    """
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    sized = members.join(size, "bucket")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(id_column), F.lit("block")), F.col("_blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(
            (F.least(F.col("_mine"), other) * F.col("_blocks") + F.greatest(F.col("_mine"), other)).alias("_pair"),
            F.when(F.col("_mine") == other, 2).otherwise((F.col("_mine") > other).cast("int")).alias("_side"),
        ),
    )
    return (
        sized.withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .withColumn("_at", F.explode(pairs))
        .withColumns({"_pair": F.col("_at._pair"), "_side": F.col("_at._side")})
        .drop("_n", "_blocks", "_mine", "_at")
    )


def likely_members(members: DataFrame, threshold: float) -> DataFrame:
    """Members (bucket, node, size, sketch) with a partner that a sketch does not rule out.

    Returns distinct bucket, node.
    """
    def judge(group: Columns) -> Columns | None:
        keep = _distinct(group["node"], group["_side"])
        node, size, side = group["node"][keep], group["size"][keep], group["_side"][keep]
        if len(node) < 2:
            return None
        raw = b"".join(group["sketch"][keep])
        rows = np.frombuffer(raw, dtype=np.uint8).reshape(len(node), SKETCH)
        within = (side == 2).all()
        left = np.flatnonzero(side != 1)
        right = left if within else np.flatnonzero(side == 1)
        found = np.zeros(len(node), dtype=bool)
        columns = np.ascontiguousarray(rows[right].T)
        for low in range(0, len(left), 128):
            at = left[low : low + 128]
            if len(at) * len(right) <= 4096:
                same = (rows[at][:, None, :] == rows[right][None, :, :]).sum(2)
            else:
                same = np.zeros((len(at), len(right)), dtype=np.uint8)
                for i in range(SKETCH):
                    same += rows[at, i][:, None] == columns[i][None, :]
            small = np.minimum(size[at][:, None], size[right][None, :])
            large = np.maximum(size[at][:, None], size[right][None, :])
            error = MARGIN * np.sqrt(threshold * (1 - threshold) / np.minimum(SKETCH, small))
            ok = (small >= threshold * large - 1e-9) & (same / SKETCH >= threshold - error)
            ok &= at[:, None] != right[None, :]
            found[at] |= ok.any(1)
            found[right] |= ok.any(0)
        if not found.any():
            return None
        bucket = np.full(int(found.sum()), group["bucket"][0])
        return {"bucket": bucket, "node": node[found]}

    blocked = in_blocks(members, SKETCH_BLOCK, "node")
    return each_group(blocked, ["bucket", "_pair"], judge, "bucket long, node long").distinct()


def _distinct(node: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places of the first row of every node and side, by side and node."""
    order = np.lexsort((node, side))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (node[order][1:] != node[order][:-1]) | (side[order][1:] != side[order][:-1])
    return order[new]


def without_repeats(members: DataFrame) -> DataFrame:
    """Of buckets (bucket, node) with the same nodes only one, and none with a single node."""
    signed = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64("node")).alias("_one"),
        F.bit_xor(F.xxhash64(F.lit("other"), "node")).alias("_two"),
    )
    chosen = (
        signed.where(F.col("_n") > 1)
        .groupBy("_n", "_one", "_two")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    return members.join(chosen, "bucket")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``."""
    both = np.concatenate([left, right[~np.isin(right, left)]])
    place = {int(k): i for i, k in enumerate(both)}
    owner = np.repeat(np.arange(len(both)), [len(sets[k]) for k in both])
    tokens = np.concatenate([sets[k] for k in both])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(starts, len(tokens)))
    a = np.array([place[int(k)] for k in left])
    b = np.array([place[int(k)] for k in right])
    total = np.zeros((len(both), len(both)), dtype=np.float32)
    # Tokens of few sets are added pair by pair, the others by products of 0/1 blocks.
    for n in range(2, 9):
        first = starts[counts == n]
        if len(first):
            of = owner[first[:, None] + np.arange(n)]
            for i in range(n):
                for j in range(n):
                    if i != j:
                        np.add.at(total, (of[:, i], of[:, j]), 1)
    many = np.flatnonzero(counts > 8)
    for low in range(0, len(many), 2048):
        some = many[low : low + 2048]
        block = np.zeros((len(both), len(some)), dtype=np.float32)
        for column, k in enumerate(some):
            block[owner[starts[k] : starts[k] + counts[k]], column] = 1
        total += block @ block.T
    return total[np.ix_(a, b)]


def verify(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of similar sets: node, links (weighted by the partner's copies), root (a connected node).

    ``members`` has bucket and node; ``sets`` has node, tokens (binary: sorted distinct
    64-bit hashes) and copies. A link joins two nodes that share a bucket and whose Jaccard
    similarity is at least ``threshold``. Several rows of a node add up.
    """
    own = members.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    # Blocks are dealt before the sets come in, which are then shuffled by node and by block only.
    blocked = in_blocks(members, SET_BLOCK, "node").join(sets.join(own, "node"), "node")

    def check(group: Columns) -> Columns | None:
        keep = _distinct(group["node"], group["_side"])
        node, side, copies = group["node"][keep], group["_side"][keep], group["copies"][keep]
        bucket = int(group["bucket"][0])
        within = (side == 2).all()
        left = np.flatnonzero(side != 1)
        right = left if within else np.flatnonzero(side == 1)
        if not len(left) or not len(right) or len(node) < 2:
            return None
        items = [np.frombuffer(t, dtype=np.uint64) for t in group["tokens"][keep]]
        size = np.array([len(s) for s in items])
        small = np.minimum(size[left][:, None], size[right][None, :])
        large = np.maximum(size[left][:, None], size[right][None, :])
        fresh = small >= threshold * large - 1e-9
        if within:
            np.fill_diagonal(fresh, False)
        # Pairs that share a smaller bucket are looked at there.
        sharing: dict[int, list[int]] = {}
        for i, mine in enumerate(group["buckets"][keep]):
            for b in mine:
                if b < bucket:
                    sharing.setdefault(int(b), []).append(i)
        edge = len(left)
        for at in sharing.values():
            if len(at) > 1:
                # Rows are in the order of their side, so the places follow from the row number.
                one = [i for i in at if i < edge]
                two = one if within else [i - edge for i in at if i >= edge]
                fresh[np.ix_(one, two)] = False
        rows, columns = np.flatnonzero(fresh.any(1)), np.flatnonzero(fresh.any(0))
        if not len(rows):
            return None
        linked = np.zeros_like(fresh)
        common = _overlaps(items, left[rows], right[columns])
        union = size[left[rows]][:, None] + size[right[columns]][None, :] - common
        linked[np.ix_(rows, columns)] = common >= threshold * union - 1e-6
        linked &= fresh
        if not linked.any():
            return None
        links = np.zeros(len(node), dtype=np.int64)
        links[left] += linked @ copies[right]
        if not within:
            links[right] += linked.T @ copies[left]
        one, two = np.nonzero(linked)
        one, two = left[one], right[two]
        root = np.arange(len(node))
        while True:
            before = root.copy()
            np.minimum.at(root, one, before[two])
            np.minimum.at(root, two, before[one])
            root = root[root]
            if (root == before).all():
                break
        found = links > 0
        return {"node": node[found], "links": links[found], "root": node[root[found]]}

    return each_group(blocked, ["bucket", "_pair"], check, "node long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: node, root for every node of ``edges`` (columns a, b).

    ``root`` is the smallest node of the component. Alternates between linking larger
    neighbours and smaller neighbours to the smallest one until nothing changes; each round
    writes the edges, and no node's neighbours are gathered in one row.
    """
    now = pin(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m"))
        now = pin(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def first_of(order: list[Column], by: list[str]) -> Column:
    """Whether a row is the first of its group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
