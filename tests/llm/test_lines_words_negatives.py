"""Line dedup, source divergence and hard negatives against brute force and on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from facetloom.llm import divergence, lines, negatives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, high long, `a.b` string, rank int"


def odd_rows():
    """Nulls everywhere, empty and long texts, repeated rows and ids, lines that many documents share."""
    made = random.Random(3)
    shared = [f"  Shared LINE number {i}\t" for i in range(6)] + ["short", "neun zeich", "äöüäöüäöü", "äöüäöüäöüß"]
    rows = [
        (5, None), (6, ""), (7, "\n\n"), (None, "shared line number 0\nalone here, long"), (None, None),
        (9, "one line, the same\n" * 3000), (4, "x\nONE LINE, the same\ny"), (4, "one line, the same"),
        (9, "\x1f one line, the same"), (-3, "shared line number 5\r"), (2**60 + 1, "Shared LINE number 1"),
    ]
    for i in range(20, 60):
        rows.append((i, "\n".join(made.choice([*shared, f"own line of {i}", ""]) for _ in range(made.randint(1, 9)))))
    rows.append(rows[-1])
    langs, sources = itertools.cycle(["en", "fr", None]), itertools.cycle(["a", "a", None, "b", "", "c"])
    return [(d, t, next(langs), next(sources), None, 7, None, "x", None) for d, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Lines.


def expected_lines(rows):
    """doc_id, n_lines, n_dropped and kept text, from one dictionary of first documents."""
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), bare) if len(bare) >= 10 else None

    def place(doc_id):
        return (doc_id is None, doc_id or 0)

    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if (k := key(line)) is not None:
                first[k] = min(first.get(k, place(doc_id)), place(doc_id))
    out = []
    for doc_id, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if key(x) is None or first[key(x)] == place(doc_id)]
        out.append((doc_id, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_equal_brute_force(odd):
    found = lines.drop_repeated_lines(odd).collect()
    assert Counter(tuple(r)[:4] for r in found) == expected_lines([r[:2] for r in odd_rows()])
    for r in found:
        assert int((~lines.unpack_keep(r["keep"], r["n_lines"])).sum()) == r["n_dropped"]


def test_a_line_over_many_ranges(spark):
    """One line fills several ranges; its first document is carried over their borders."""
    rows = [(i, f"everyone has this line\nonly {i} has this one\n\nand everyone this, too") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = Counter(tuple(r)[:4] for r in lines.drop_repeated_lines(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == expected_lines(rows)


def test_carried():
    edges = [(0, 1, 1, 5, 5, 0, 7), (1, 5, 5, 5, 5, 0, 70), (2, 5, 5, 6, 6, 0, 3), (4, 6, 6, 6, 6, 1, 0)]
    assert lines.carried(edges) == {
        1: (5, 5, False, 7), 2: (5, 5, False, 7), 4: (6, 6, False, 3),
    }


@pytest.mark.parametrize("dropped", [[0], [7], [8], [0, 3, 17], list(range(100))])
def test_keep_bitmap_and_back(dropped):
    keep = lines.unpack_keep(lines.pack_keep(np.array(dropped)), 120)
    assert np.flatnonzero(~keep).tolist() == dropped
    assert lines.unpack_keep(None, 3).all()


# Source divergence.


def expected_divergence(rows, least):
    """All values from dictionaries of counts, with Python's whole numbers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in rows]
    docs = [(a, b, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]) for a, b, ws in docs]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for a, _, ws in docs if a == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for a, b, ws in docs:
            if a == lang:
                counts[b].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())

        def p(c, kept=kept):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        given, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(o, sum(f(given[s][w], given[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, f(given[s][w], q[w])) for w in kept if counts[s][w] and given[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items[: None if part == "pair" else 10], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def word_rows(n, seed, n_sources=7):
    made = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Über", "the", "of", "x", "naïve", "日本") for b in "abcdefghijk"]
    rows = []
    for _ in range(n):
        source = made.choice([None, "", *[f"s{i}" for i in range(n_sources)]])
        spread = made.randint(1, len(vocabulary))
        words = [made.choice(vocabulary[:spread]) for _ in range(made.randint(0, 60))]
        rows.append((made.choice([" ", "-", "1 ", "@"]).join(words) or None, made.choice(["en", "en", "fr", None]), source))
    return [*rows, ("only once", "xx", "a"), (None, "xx", "b"), ("", "yy", "c"), ("of " * 50_000, "en", "s1")]


@pytest.mark.parametrize(("slab", "block", "tile"), [(64, 256, 2048), (2, 5, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, slab, block, tile):
    monkeypatch.setattr(divergence, "SLAB_SOURCES", slab)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = word_rows(300, 1)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == expected_divergence(rows, 10)


def test_joint_tables_count_terms():
    made = np.random.default_rng(2)
    level = made.integers(0, 4, (50, 5))
    term, group = np.nonzero(level)
    tables = divergence.joint_tables(term, group, level[term, group])
    groups, levels, _ = next(tables)
    found = {}
    for i, j, times in tables:
        for a, b, n in zip(i, j, times, strict=True):
            found[groups[a], levels[a], groups[b], levels[b]] = n
    assert found == Counter(
        (a, level[t, a], b, level[t, b])
        for t in range(50) for a in range(5) for b in range(a + 1, 5) if level[t, a] and level[t, b]
    )


def test_divergence_of_large_counts(spark):
    """Probabilities are exact where the product would leave 64 bits."""
    n, total, kept = 3 * 10**13 + 7, 9 * 10**14 + 1, 1234
    row = spark.range(1).select(*[
        divergence.F.lit(x).cast("long").alias(c) for c, x in (("n", n), ("total", total), ("kept", kept))
    ])
    found = row.select(divergence.probability(*[divergence.F.col(c) for c in ("n", "total", "kept")])).first()[0]
    assert found == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_divergence_on_odd_rows(odd):
    rows = [(r[1], r[2], r[3]) for r in odd_rows()]
    assert sorted(map(tuple, divergence.source_divergence(odd).collect())) == expected_divergence(rows, 10)


# Hard negatives.


def expected_negatives(rows):
    valid = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        valid.append((vec_id, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)))
    limit = 2**63 - 1
    out = []
    for anchor in sorted({v for v in valid if v[0] % 100 == 0}):
        scored = sorted(
            (-max(-limit - 1, min(limit, sum(a * b for a, b in zip(anchor[2], v, strict=False)))), i, label)
            for i, label, v in valid if i != anchor[0]
        )
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:5]:
            fits = [x for x in scored if x[2] != anchor[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(anchor[0], p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return Counter(out)


def vector_rows(n, seed, width=12, few=3):
    """Vectors with few different values, so that scores tie; invalid and odd rows among them."""
    made = np.random.default_rng(seed)
    rows = [
        (int(i), [float(x) for x in made.integers(-few, few + 1, width) / 16 + 0.25], int(made.integers(0, 4)))
        for i in made.permutation(n) * 4
    ]
    return rows + [
        (None, rows[0][1], 1), (100, None, 1), (200, rows[0][1], None), (301, [float("nan")] * width, 1),
        (303, [float("inf")] * width, 1), (305, [None] * width, 1), (307, [], 1), (309, rows[0][1][:5], 2),
        (311, [*rows[0][1], 1.0], 2), rows[3], rows[3], (-700, rows[5][1], 2), (400, rows[6][1], 3),
    ]


VECTORS = "vec_id long, embedding array<float>, label int, owner long, `a.b` string"


@pytest.mark.parametrize("chunk", [negatives.CHUNK_BYTES, 600])
def test_negatives_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
    rows = vector_rows(600, 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(5)
    assert Counter(map(tuple, negatives.hard_negatives(df).collect())) == expected_negatives(rows)


def test_huge_components(spark):
    """Scores beyond 64 bits become the nearest that fits; smaller ones stay exact."""
    made = np.random.default_rng(5)
    rows = [(i, [float(x) for x in made.normal(size=3) * 10.0 ** made.integers(-2, 20)], i % 3) for i in range(0, 120, 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert Counter(map(tuple, negatives.hard_negatives(df).collect())) == expected_negatives(rows)


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 40, 35), (70, 64, 130), (100, 33, 257), (0, 40, 40), (40, 0, 40)])
def test_strassen_equals_the_product(monkeypatch, shape):
    monkeypatch.setattr(negatives, "LEAF", 8)
    made = np.random.default_rng(sum(shape))
    m, k, n = shape
    for top in (500, 2**28):
        a, b = made.integers(-top, top, (m, k)), made.integers(-top, top, (k, n))
        assert (negatives.strassen(a, b) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge():
    made = np.random.default_rng(8)
    owner, score, id_ = made.integers(0, 6, 500), made.integers(0, 9, 500), made.integers(0, 300, 500)
    heaps = negatives.Heaps(6, 4)
    for part in np.array_split(np.arange(500), 7):
        enough = part[score[part] >= heaps.floor[owner[part]]]
        heaps.add(owner[enough], score[enough], id_[enough])
    found = sorted(zip(heaps.owner.tolist(), (-heaps.score).tolist(), heaps.id.tolist(), strict=True))
    rows = sorted(zip(owner.tolist(), (-score).tolist(), id_.tolist(), strict=True))
    assert found == [x for o in range(6) for x in [r for r in rows if r[0] == o][:4]]


def test_empty_tables(spark, none):
    assert lines.drop_repeated_lines(none).collect() == []
    assert divergence.source_divergence(none).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
