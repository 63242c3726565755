"""How far the word use of a language's sources differs: joint tables from matrix products.

For every kept term the sources of a language have a count level. An indicator column says for each
(source, level) which terms have that level there. The columns times their transpose give, for all
pairs of sources at once, how many terms have which pair of levels: the joint tables. A difference is
then a price for each cell, times its count. Products are made block by block: terms in blocks,
columns in slabs of sources. A level of zero has no column; its cells follow from the margins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.groups import Columns, each_group, small_batches
from facetloom.operators.lookups import lookup
from facetloom.session import pin

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCS = 10
#: Terms listed for each source.
TOP_TERMS = 10
#: Scale of the rounded probabilities.
SCALE = 1_000_000_000
#: Terms in a block of a product, and sources in a slab of its columns.
BLOCK_TERMS = 256
SLAB_SOURCES = 64
#: Columns in a tile of a product.
TILE = 2048
#: Counted (source, term) entries that a task holds before it hands them on.
HELD_TERMS = 1_000_000

# Bytes of a term are ASCII letters, folded to lower case, and all bytes beyond ASCII.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())]
)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term of a task's documents, by language and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(times), pa.string()),
                    pa.array([source] * len(times), pa.string()),
                    pa.array(list(times), pa.binary()).cast(pa.string()),
                    pa.array(list(times.values()), pa.int64()),
                    pa.array([docs[t] for t in times], pa.int64()),
                ],
                schema=_COUNTS,
            )
        held.clear()

    for batch in batches:
        columns = batch.to_pydict()
        for lang, source, text in zip(columns["lang"], columns["source"], columns["text"], strict=True):
            terms = terms_of(text)
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            times.update(terms)
            docs.update(set(terms))
        if sum(len(times) for times, _ in held.values()) >= HELD_TERMS:
            yield from handed()
    yield from handed()


def probability(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * kept))``, exactly; null if no term is kept."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(2)).cast("decimal(20,0)")
    below = (total + F.lit(2) * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", scaled, below) + F.lit(1))


def price(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def kept_terms(docs: DataFrame) -> DataFrame:
    """A row for each kept term: lang, term, n, and entries (source, n) where it occurs."""
    counted = small_batches(docs).select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(_count, "lang string, source string, term string, n long, d long")
    # Both sums use the one shuffle by language and term.
    return (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("entries"))
        .where(F.col("d") >= LEAST_DOCS)
        .select("lang", "term", "n", "entries")
    )


def joint_tables(term: np.ndarray, group: np.ndarray, level: np.ndarray) -> Iterator[tuple]:
    """The joint tables of all pairs of groups over one block of terms, tile by tile.

    Each entry says that a term has a level in a group. Yields, for the cells that occur, the numbers of
    two columns (of different groups, the smaller group first) and the number of terms that have
    both; the columns come first, as their group and level and an entry that has them.
    """
    order = np.lexsort((level, group))
    fresh = np.ones(len(order), dtype=bool)
    g, v = group[order], level[order]
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    column = np.empty(len(order), dtype=np.int64)
    column[order] = np.cumsum(fresh) - 1
    sample = order[fresh]
    yield group[sample], level[sample], sample
    terms, row = np.unique(term, return_inverse=True)
    # A column holds zeros and ones and a block has fewer than 2^24 terms: the sums are exact.
    shown = np.zeros((len(terms), len(sample)), dtype=np.float32)
    shown[row, column] = 1
    groups = group[sample]
    for a in range(0, len(sample), TILE):
        for b in range(a, len(sample), TILE):
            product = shown[:, a : a + TILE].T @ shown[:, b : b + TILE]
            i, j = np.nonzero(product)
            apart = groups[a + i] < groups[b + j]
            i, j = i[apart], j[apart]
            yield a + i, b + j, product[i, j].astype(np.int64)


def _priced(columns: Columns) -> Columns | None:
    """What the joint tables of a block add to each pair, beyond the margins."""
    group, slab = columns["group"], columns["slab"]
    a, b = columns["a"][0], columns["b"][0]
    tables = joint_tables(columns["term"], group, columns["n"])
    groups, _, sample = next(tables)
    p, zero, slab = columns["p"][sample], columns["zero"][sample], slab[sample]
    found = []
    for i, j, times in tables:
        if a != b:
            # Pairs inside a slab belong to the block of that slab alone.
            across = slab[i] != slab[j]
            i, j, times = i[across], j[across], times[across]
        more = _price(p[i], p[j]) - _price(p[i], zero[j]) - _price(zero[i], p[j]) + _price(zero[i], zero[j])
        found.append((groups[i], groups[j], times * more))
    one, other, value = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(one):
        return None
    order = np.lexsort((other, one))
    one, other, value = one[order], other[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (other[1:] != other[:-1]))))
    return {"one": one[start], "other": other[start], "value": np.add.reduceat(value, start)}


def _groups(docs: DataFrame, kept: DataFrame, entries: DataFrame) -> DataFrame:
    """Every group: lang, source, group (its hash), total, kept (terms of the language), slabs, zero."""
    named = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    ).distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    sources = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    return pin(
        named.join(totals, ["lang", "source"], "left")
        .join(sources, "lang")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("group", F.xxhash64("lang", "source"))
        .withColumn("slabs", F.ceil(F.col("sources") / SLAB_SOURCES))
        .withColumn("zero", probability(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    )


def _joint_part(entries: DataFrame) -> DataFrame:
    """What the joint tables add to the value of each pair: one, other (groups), value."""
    slab = F.pmod("group", "slabs")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slabs") - 1))
    dealt = (
        entries.where("slabs > 1 OR sources > 1")
        .withColumn("slab", slab)
        .withColumn("with", each)
        .select(
            F.xxhash64("lang").alias("lang"),
            F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / BLOCK_TERMS)).alias("block"),
            F.least("slab", "with").alias("a"),
            F.greatest("slab", "with").alias("b"),
            F.xxhash64("lang", "term").alias("term"),
            "group", "slab", "n", "p", "zero",
        )
    )
    found = each_group(dealt, ["lang", "block", "a", "b"], _priced, "one long, other long, value long")
    return found.groupBy("one", "other").agg(F.sum("value").alias("value"))


def _margin_part(entries: DataFrame, others: DataFrame) -> DataFrame:
    """What the levels of a source add where the other source has none: lang, source, other, value."""
    levels = entries.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    pairs = lookup(pin(levels), others, ["lang"], how="inner", spread_by=["source", "p"])
    more = price(F.col("p"), F.col("other_zero")) - price(F.col("zero"), F.col("other_zero"))
    return (
        pairs.where("source != other")
        .groupBy("lang", "source", "other")
        .agg(F.sum(F.col("terms") * more).alias("value"))
    )


def source_divergence(docs: DataFrame) -> DataFrame:
    """Differences between the sources of a language: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters (A-Z folded) and characters beyond ASCII; a language keeps those
    in at least ``LEAST_DOCS`` of its documents (rows). A source, or the language as a whole, gives a kept term
    that occurs n times there ``p = 1 + floor(SCALE * (n + 2) / (N + 2 * V))``, with N its kept
    occurrences and V the kept terms. The value of p against q is ``floor((p - q)^2 / (p + q))``.
    Part ``pair`` has, for each other source of the language, the sum over the kept terms (0 without any);
    part ``term`` the ``TOP_TERMS`` terms of the source that it uses more than the language does.

    Null lang, source and text count as empty; doc_id is not read, so repeated rows count as often as they occur; very
    long texts count whole; other columns are ignored; an empty table gives no row. Groups are told apart by
    64-bit hashes of their names inside the products. The joint tables never leave their task: prices are
    linear, so each block sends a sum for each pair.
    """
    docs = docs.select("lang", "source", "text")
    kept = pin(kept_terms(docs))
    plain = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("entries"))
    groups = _groups(docs, kept, plain)
    entries = lookup(
        plain, groups, ["lang", "source"], how="inner", spread_by=["term"]
    ).withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept")))

    # Values of the pairs, as a sum of three parts.
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    all_pairs = lookup(
        groups.select("lang", "source", "zero", "kept"), others, ["lang"], how="inner", spread_by=["source"]
    ).where("source != other")
    empty = all_pairs.select(
        "lang", "source", "other",
        F.coalesce(F.col("kept") * price(F.col("zero"), F.col("other_zero")), F.lit(0)).alias("value"),
    )
    margin = pin(_margin_part(entries, others))
    joint = _joint_part(entries)
    one = groups.select(F.col("group").alias("one"), "lang", "source")
    other = groups.select(F.col("group").alias("other"), F.col("source").alias("other_source"))
    joint = pin(
        lookup(lookup(joint, one, ["one"], how="inner"), other, ["other"], how="inner").select(
            "lang", "source", F.col("other_source").alias("other"), "value"
        )
    )
    turned = [F.col("lang"), F.col("other").alias("source"), F.col("source").alias("other"), F.col("value")]
    pairs = empty
    for part in (margin, joint):
        pairs = pairs.unionByName(part).unionByName(part.select(*turned))
    pairs = pairs.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))

    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = (
        entries.withColumn("q", q)
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank")
        )

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))
