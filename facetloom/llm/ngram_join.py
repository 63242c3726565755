"""Jaccard self-join of word n-gram sets by chosen paths.

Each run splits the documents by sampled shared tokens: a set of ``n`` tokens follows each token
with the chance ``1 / (threshold * n)``, decided by a hash that all sets share, so that two sets of at
least that similarity follow a common token about once or more. Buckets that are small
are compared by brute force; in larger ones the sets follow a second token. Runs are
repeated until the chance that a pair at the threshold is missed in all is below the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.groups import Shelf, small_batches, whole_row
from facetloom.llm.setjoin import (
    components,
    first_of,
    likely_members,
    sketch_of,
    verify,
    without_repeats,
)
from facetloom.llm.shingles import mix, shingle_set
from facetloom.operators.lookups import lookup

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Buckets of more sets than this are split once more.
SMALL = 256
#: Bits of the filter of documents whose texts are read again: so many for each of them, in bitmaps of the size that Spark
#: makes, and at most so many bitmaps (32 MB), which are broadcast.
BITS_EACH = 64
BITMAP_BITS = 1 << 15
MOST_BITMAPS = 1 << 13


def runs_for(recall: float) -> int:
    """Runs that reach ``recall`` for pairs at the threshold that need both levels.

    Of a set's Poisson number of common tokens, with mean 1, one must lead on to another.
    """
    one = 1 - math.exp(-1)
    both = 1 - math.exp(-one)
    return math.ceil(math.log(1 - recall) / math.log(1 - both))


def _followed(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths that the set follows on from each of ``paths``: place of the old path, new path."""
    limit = min(1.0, 1.0 / (threshold * len(tokens)))
    bound = np.uint64(int(limit * 2**53))
    step = max(1, (1 << 20) // len(tokens))
    places, made = [], []
    for low in range(0, len(paths), step):
        some = paths[low : low + step]
        drawn = mix(tokens[None, :] ^ some[:, None])
        row, column = np.nonzero((drawn >> np.uint64(11)) < bound)
        places.append(row + low)
        made.append(mix(drawn[row, column] + some[row]))
    if not made:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(places), np.concatenate(made)


def paths_of(tokens: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the first level, and for the second level the bucket before and the bucket."""
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = _followed(tokens, seeds, threshold)
    place, second = _followed(tokens, first, threshold)
    return first, first[place], second


def set_hash(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _tokens_table(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Per document its set's hash, size, sketch and paths; a null hash if it has no word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "tie", "node", "size", "sketch", "first", "parents", "second"]
        for pdf in batches:
            out = []
            for doc_id, tie, text in zip(pdf["doc_id"], pdf["tie"], pdf["text"], strict=True):
                tokens = shingle_set(text, WIDTH)
                if not len(tokens):
                    out.append((doc_id, tie, None, 0, None, None, None, None))
                    continue
                paths = [p.view(np.int64) for p in paths_of(tokens, runs, threshold)]
                out.append((doc_id, tie, set_hash(tokens), len(tokens), sketch_of(tokens), *paths))
            yield pd.DataFrame(out, columns=names, dtype=object)

    schema = (
        "doc_id long, tie long, node long, size int, sketch binary, first array<long>, "
        "parents array<long>, second array<long>"
    )
    return docs.select("doc_id", "tie", "text").mapInPandas(run, schema)


def _passing(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id the filter of the doc_ids of ``wanted`` passes, where they lie.

    All wanted rows pass, and of the others the share of bits that are set, about one in ``BITS_EACH``, so that what
    follows shuffles little more than the sets it needs.
    """
    bitmaps = min(MOST_BITMAPS, max(1, math.ceil(wanted.count() * BITS_EACH / BITMAP_BITS)))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bitmaps * BITMAP_BITS)) + 1
    number, place = F.bitmap_bucket_number(slot).alias("_number"), F.bitmap_bit_position(slot).alias("_place")
    # Dealt by bitmap first, so that places are shuffled and not bitmaps.
    marks = wanted.select(number, place).repartition("_number").groupBy("_number")
    marks = marks.agg(F.bitmap_construct_agg("_place").alias("_marks"))
    byte = F.substring("_marks", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod("_place", F.lit(8)).cast("int"))
    found = docs.select("*", number, place).join(F.broadcast(marks), "_number").where(bit == 1)
    return found.select(*docs.columns)


def _sets_of(texts: DataFrame) -> DataFrame:
    """doc_id, node, tokens from doc_id, text; texts without words drop out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = shingle_set(text, WIDTH)
                if len(tokens):
                    out.append((doc_id, set_hash(tokens), tokens.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "node", "tokens"])

    return texts.mapInPandas(run, "doc_id long, node long, tokens binary")


def classify(docs: DataFrame, threshold: float, recall: float, shelf: Shelf) -> DataFrame:
    """doc_id, tie (hash of the text), root (null without words), class_id, n_links.

    Reads ``table`` and ``named`` of the shelf; each other table goes, with the shuffle files behind it, as soon as the next
    step has read it.
    """
    rows = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text"
    )
    known = rows.where(F.col("doc_id").isNotNull())
    table = shelf.keep("table", _tokens_table(known, threshold, runs_for(recall)))
    nodes = shelf.keep(
        "nodes",
        table.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("size").alias("size"),
            F.first("sketch").alias("sketch"),
            F.first("first").alias("first"),
            F.first("parents").alias("parents"),
            F.first("second").alias("second"),
        ),
    )

    # First level: buckets of one set are done, large ones are split by a second token.
    first = nodes.select("node", F.explode("first").alias("bucket"))
    sizes = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = shelf.keep("sizes", sizes.where(F.col("n") > 1))
    small = first.join(sizes.where(F.col("n") <= SMALL).select("bucket"), "bucket")
    steps = nodes.select("node", F.explode(F.arrays_zip("parents", "second")).alias("step")).select(
        "node", F.col("step.parents").alias("parent"), F.col("step.second").alias("bucket")
    )
    large = sizes.where(F.col("n") > SMALL).select(F.col("bucket").alias("parent"))
    second = lookup(steps, large, ["parent"], how="inner", spread_by=["node"]).select("node", "bucket")
    buckets = shelf.keep("buckets", small.select("node", "bucket").unionByName(second).distinct())
    members = shelf.keep("members", without_repeats(buckets))
    del first, sizes, small, steps, large, second, buckets
    shelf.drop("sizes", "buckets")

    # Brute force, by sketches first, then by whole sets where the sketches leave a partner.
    parts = members.join(nodes.select("node", "size", "sketch"), "node")
    met = shelf.keep("met", likely_members(parts, threshold))
    likely = shelf.keep("likely", without_repeats(met))
    del members, parts, met
    shelf.drop("members", "met")
    wanted = likely.select("node").distinct().join(nodes.select("node", "rep", "copies"), "node")
    wanted = shelf.keep("wanted", wanted)
    made = _sets_of(_passing(known.select("doc_id", "text"), wanted.select(F.col("rep").alias("doc_id"))))
    # No document of a node is below its rep. Equal doc_ids as a second key would have the sets shuffled once more.
    sets = made.join(wanted, "node").where(F.col("doc_id") <= F.col("rep"))
    links = shelf.keep("links", verify(likely, sets.select("node", "copies", "tokens"), threshold))
    del likely, wanted, made, sets
    shelf.drop("likely", "wanted")

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = (
        nodes.select("node", "rep", "copies")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = classed.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_node = classed.join(lowest, "root").select(
        "node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    texted = table.select("doc_id", "tie", "node").where(F.col("node").isNotNull())
    named = shelf.keep("named", by_node)
    found = lookup(texted, named, ["node"], how="inner", spread_by=["doc_id"])
    del nodes, links, counts, roots, classed, lowest, by_node
    shelf.drop("nodes", "links")
    alone = (
        table.where(F.col("node").isNull())
        .select("doc_id", "tie")
        .unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "tie"))
    )
    alone = alone.select(
        "doc_id", "tie", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return found.select("doc_id", "tie", "root", "class_id", "n_links").unionByName(alone)


def similar_documents(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """Classes of documents linked by similar sets of five-word shingles.

    Returns doc_id, class_id (the smallest doc_id of the class) and n_links (other documents
    with a similarity of at least ``threshold``), a row per input row. Words are compared in
    lower case; a text of fewer than five words is one shingle of them. Texts with the same shingles
    are one class from the start and are not compared. A null, empty or blank text, and a row
    with a null doc_id, has no links; its class is its own doc_id. A pair at the
    threshold is found with the chance ``recall`` at least; what is found is verified exactly.
    """
    return classify(docs, threshold, recall, Shelf(docs.sparkSession)).select("doc_id", "class_id", "n_links")


def one_of_each_class(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """The document with the smallest doc_id of each class, with all its columns.

    Rows without words or without a doc_id stay. Of several rows with the smallest doc_id of a class
    the one with the smallest text hash stays.
    """
    shelf = Shelf(docs.sparkSession)
    classes = shelf.keep("classes", classify(docs, threshold, recall, shelf).where(F.col("doc_id").isNotNull()))
    # The files of all steps before go before whole rows are shuffled.
    shelf.drop("table", "named")
    keepers = (
        classes.where(F.col("root").isNotNull() & (F.col("class_id") == F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_doc"), "root")
        .agg(F.min("tie").alias("_tie"))
        .select("_doc", "_tie", F.lit(False).alias("_wordless"))
    )
    bare = classes.where(F.col("root").isNull()).select(
        F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.lit(True).alias("_wordless")
    )
    packed = docs.where(F.col("doc_id").isNotNull()).select(
        whole_row(docs).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"),
        F.xxhash64("text").alias("_tie"),
    )
    joined = packed.join(keepers.unionByName(bare.distinct()), ["_doc", "_tie"])
    once = joined.withColumn("_once", first_of([F.col("_tie")], ["_doc", "_tie"]))
    kept = once.where(F.col("_once") | F.col("_wordless")).select("_row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
