"""The operators against brute force, and on nulls, empty and long texts, ties and clashes."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from facetloom.llm import (
    digests,
    groups,
    languages,
    mixing,
    ngram_join,
    packing,
    paragraphs,
    postings,
    pseudonyms,
    setjoin,
    shingles,
    substrings,
    url_rules,
)
from facetloom.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, `a.b` string"
LONG = "lorem ipsum dolor " * 20_000


def words(n, seed):
    made = random.Random(seed)
    return " ".join(made.choice("abcdefgh") * made.randint(1, 3) + str(made.randint(0, 400)) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and very long texts, repeated rows, a repeated id, ties."""
    base = words(120, 1)
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "  ", 1)), (4, base + " more"), (5, None), (6, ""),
        (7, " \n "), (8, "123 456"), (9, LONG), (10, LONG + "x"), (11, words(3, 2)), (11, words(90, 3)),
        (12, words(80, 4)), (12, words(80, 4)), (None, base), (None, None), (2**60 + 1, words(60, 5) + " " + base),
    ]
    langs = itertools.cycle(["en", "fr", None])
    sources = itertools.cycle(["a", "a", "a", None, "b"])
    return [(d, t, next(langs), next(sources), None, 7, None, "x") for d, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def text_shingles(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


# Oracles.


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len([n for n in QUERIES if n.startswith("op")]) == 13 and "pipeline" in QUERIES


# Empty tables and odd rows, for all that take documents.

ON_DOCUMENTS = {
    "ngram": ngram_join.similar_documents,
    "pack": lambda d: packing.pack_documents(d, tokenizer_path()),
    "substrings": substrings.remove_repeats,
    "pii": pseudonyms.pseudonymize_documents,
    "mix": mixing.mix_documents,
    "digest": digests.fingerprint_documents,
    "paragraphs": paragraphs.removed_paragraphs,
    "language": languages.language_id,
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_table(none, name):
    assert ON_DOCUMENTS[name](none).collect() == []


@pytest.mark.parametrize("name", ["ngram", "substrings", "pii", "digest", "paragraphs", "language"])
def test_a_row_for_every_odd_row(odd, name):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in ON_DOCUMENTS[name](odd).collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in odd_rows())


# 1: n-gram join.


def test_ngram_join_on_odd_rows(odd):
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar_documents(odd).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 3)} <= got
    assert {(5, 5, 0), (6, 6, 0), (7, 7, 0), (None, None, 0), (12, 12, 1), (11, 11, 0)} <= got
    kept = [r["doc_id"] for r in ngram_join.one_of_each_class(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 5, 6, 7, 8, 9, 10, 11, 11, 12, 2**60 + 1]
    assert kept.count(None) == 2


def test_ngram_join_equals_brute_force_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(setjoin, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(setjoin, "SET_BLOCK", 8)
    made = random.Random(3)
    base = words(150, 7).split()
    rows = []
    for i in range(60):
        copy = base[:]
        for _ in range(made.randint(0, 6)):
            copy[made.randrange(len(copy))] = f"new{made.randint(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, words(50, i)) for i in range(60, 90)]
    sets = {i: text_shingles(t) for i, t in rows}
    links = {i: [j for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.8] for i in sets}
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: len(v) for i, v in links.items()}
    for r in got:
        seen, todo = {r["doc_id"]}, [r["doc_id"]]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        assert r["class_id"] == min(seen)


def test_filter_of_documents_passes_the_wanted_and_few_others(spark):
    docs = spark.range(-5000, 5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    for wanted in (docs.where("doc_id % 5 = 0"), docs.where("doc_id = 7"), docs.where("false")):
        got = ngram_join._passing(docs.unionByName(docs), wanted.select("doc_id"))
        n = wanted.count()
        assert got.columns == docs.columns and got.join(wanted, "doc_id", "left_semi").count() == 2 * n
        assert got.join(wanted, "doc_id", "left_anti").count() < 2 * (0.15 * n + 5)


@pytest.mark.parametrize("slots", [ngram_join.BITMAP_BITS, 1])
def test_ngram_join_reads_texts_with_likely_partners_only(spark, monkeypatch, slots):
    passing, passed = ngram_join._passing, []

    def counted(docs, wanted):
        passed.append(passing(docs, wanted).count())
        return passing(docs, wanted)

    monkeypatch.setattr(ngram_join, "_passing", counted)
    monkeypatch.setattr(ngram_join, "BITMAP_BITS", slots)
    monkeypatch.setattr(ngram_join, "MOST_BITMAPS", 1)
    rows = [(i - 200, words(40, i)) for i in range(400)]
    copies = {1000 + i: 40 * i - 200 for i in range(10)}
    rows += [(k, f"{dict(rows)[first]} more") for k, first in copies.items()]
    linked = {*copies, *copies.values()}
    want = sorted((i, copies.get(i, i), int(i in linked)) for i, _ in rows)
    # Another text of the doc_id of a first document: it passes the filter and is no copy.
    rows.append((-160, words(40, 1000)))
    want.insert(want.index((-160, -160, 1)), (-160, -160, 0))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == want
    # With a single slot every document passes, and the join after it finds the same.
    assert passed == [len(rows)] if slots == 1 else 21 <= passed[0] < 40


def test_sketches_rule_out_only_unlike_sets():
    made = random.Random(5)
    for n in (1, 3, 20, 400):
        tokens = np.array([made.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        assert setjoin.sketch_of(tokens) == setjoin.sketch_of(tokens[::-1])
    assert len(setjoin.sketch_of(np.empty(0, dtype=np.uint64))) == setjoin.SKETCH
    assert ngram_join.runs_for(0.9995) > ngram_join.runs_for(0.9)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (100, 3), (4, 100)]
    got = setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 100: 1, 10: 10, 11: 10, 12: 10}


# 2: URL rules.


def judged(url, rules):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"), key=lambda f: f[:2])
    return host, path, best[2], best[3]


def test_url_rules_equal_brute_force(spark):
    made = random.Random(1)
    rules = list(url_rules.RULES) + [("block", "a.org", ""), ("allow", "b.a.org", "/x"), ("block", "b.a.org", "/x/y/"), ("allow", None, "/")]
    hosts = ["org", "a.org", "b.a.org", "xa.org", "Example.ORG", "sub.example.org", "z.com", "com", "", "net"]
    paths = ["", "/", "/x", "/x/y", "/x/y/z", "/es/", "/es", "/en/12", "/fr/?/de/", "/de/#a", "?q=/es/"]
    urls = [f"http://{made.choice(hosts)}{made.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme.org/es/", "http://", "://org/", "x://a://org/es/"] + ["http://example.org/es/1"] * 50
    rows = [(None if i == 3 else i // 2, u, "h") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(5)
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = sorted(map(tuple, url_rules.judge_urls(pages, given).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((i, *judged(u, [(v, h or "", p) for v, h, p in rules])) for i, u, _ in rows), key=str)
    assert url_rules.judge_urls(pages.limit(0), given).collect() == []
    assert url_rules.judge_urls(pages, given.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


# 3: packing.


def test_packing_is_whole(spark, documents):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(documents, tokenizer_path()).toPandas()
    for doc_id, text in documents.select("doc_id", "text").collect():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = rows[rows.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.piece) == list(range(len(mine)))
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    check_sequences(rows)
    assert rows.sequence_id.nunique() <= 1.01 * -(-rows.length.sum() // 2048) + 1


def check_sequences(rows, capacity=2048):
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= capacity


def test_packing_odd_rows(odd):
    rows = packing.pack_documents(odd, tokenizer_path()).toPandas()
    check_sequences(rows)
    assert len(rows[rows.piece == 0]) == len(odd_rows())
    assert list(rows[rows.doc_id == 5].length) == [1]
    ids = {r["doc_id"] for r in packing.tokenize(odd, tokenizer_path()).select("doc_id").collect()}
    assert ids == {r[0] for r in odd_rows()}


def test_sequences_hold_every_text_as_often_as_it_comes(spark, odd):
    """Decoded by copy and place, the ids are the texts, also of repeated rows and null ids."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    long = [(1, "one two " * 3000), (1, "one two " * 3000), (1, "other"), (2, None), (2, None), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path(), with_ids=True).toPandas()
    check_sequences(rows)
    made = []
    rows["ids"] = [packing.unpack(bytes(r.ids), r.length).tolist() for r in rows.itertuples()]
    assert [zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows.itertuples()] == list(rows.ids_crc32)
    assert not rows.duplicated(["doc_id", "piece", "ids_crc32", "copy"]).any()
    big = rows[(rows.doc_id == 1) & ((rows.piece > 0) | (rows.length > 100))]
    for _, own in big.groupby("copy"):
        made.append((1, encoder.decode([i for ids in own.sort_values("piece").ids for i in ids][:-1])))
    for r in rows.drop(big.index).itertuples():
        made.append((None if np.isnan(r.doc_id) else int(r.doc_id), encoder.decode(r.ids[:-1])))
    assert sorted(made, key=str) == sorted(((i, t or "") for i, t in long), key=str)
    assert packing.pack_documents(odd, tokenizer_path(), with_ids=True).count() >= len(odd_rows())
    assert packing.pack_documents(docs.limit(0), tokenizer_path(), with_ids=True).count() == 0


def test_words_give_the_ids_of_the_text():
    from tokenizers import Tokenizer

    encoder, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    for text in ["a b", " a", "a ", "a  b", "a \nb", "a\n b", "it's 'tis", "é ñ\u00a0x", "a<|endoftext|>b", "\n\n x  ", "1234 a1", "日本 語", "\U0001f600 x"]:
        want = np.array(encoder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert ids.ids(text) == want, text


def fewest(items, capacity):
    """Bins of an exact packing, by trying all places."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_and_fit_near_the_optimum(seed):
    made = random.Random(seed)
    items = sorted((made.randint(1, 20) for _ in range(made.randint(1, 9))), reverse=True)
    counts = {k: items.count(k) for k in items}
    patterns = packing.reduce_and_fit(counts, 20)
    used = [k for content, n in patterns for _ in range(n) for k in content]
    assert sorted(used, reverse=True) == items and all(sum(c) <= 20 for c, _ in patterns)
    assert fewest(items, 20) <= sum(n for _, n in patterns) <= fewest(items, 20) + 1


@pytest.mark.parametrize("seed", range(40))
def test_fixed_contents_leave_the_optimum_as_it_is(seed):
    made = random.Random(100 + seed)
    items = [made.randint(3, 20) for _ in range(8)]
    counts = packing._Counts({k: items.count(k) for k in items})
    content = packing._dominant(counts, max(items), 20)
    if content:
        rest = items[:]
        for k in content:
            rest.remove(k)
        assert fewest(sorted(rest, reverse=True), 20) + 1 == fewest(sorted(items, reverse=True), 20)


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


# 4: substrings.


def removed(rows):
    """doc_id -> covered places, by a table of all strings."""
    first = {}
    for doc_id, text in rows:
        for i in range(len(text) - 49):
            first[text[i : i + 50]] = min(doc_id, first.get(text[i : i + 50], doc_id))
    out = []
    for doc_id, text in rows:
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < doc_id:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 3000)
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    monkeypatch.setattr(substrings, "SYMBOLS", 500)
    made = random.Random(seed)
    parts = ["".join(made.choice("ab é") for _ in range(made.randint(30, 160))) for _ in range(12)]
    rows = []
    for i in range(40):
        text = "".join(made.choice(parts)[made.randint(0, 20) :] for _ in range(made.randint(0, 5)))
        rows.append((made.randint(0, 30), text + made.choice(["", "x", "ab" * 60])))
    rows += [(50, "ab" * 80), (51, "a" * 49), (52, "a" * 50), (53, "a" * 500), (53, "a" * 500), (54, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans")
    want = removed([(d, (t or "").encode()) for d, t in rows])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_runs_of_a_text_are_the_same_wherever_it_lies(monkeypatch):
    """Executors get the texts of a block in another order in each pass; runs once depended on it."""
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    made = random.Random(4)
    texts = [bytes(made.choice(b"abcdefgh") for _ in range(made.randint(40, 400))) for _ in range(20)]
    texts += [b"ab" * 200, b"x" * 333, b""]

    def runs(order):
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        ends = np.cumsum([len(texts[i]) for i in order])
        start, windows, anchor, hashes = substrings.anchored_runs(data, ends)
        place = np.searchsorted(ends, start, side="right")
        begin = np.concatenate(([0], ends[:-1]))[place]
        owner = np.array(order)[place]
        return sorted(zip(owner, start - begin, windows, anchor, hashes, strict=True))

    order = list(range(len(texts)))
    found = runs(order)
    assert sum(w for _, _, w, _, _ in found) == sum(max(0, len(t) - 49) for t in texts)
    for _ in range(5):
        made.shuffle(order)
        assert runs(order) == found


def test_suffix_order_equals_sorting():
    made = random.Random(2)
    strings = [bytes(made.choice(b"abc") for _ in range(made.randint(1, 12))) for _ in range(30)]
    string, size, common = substrings.suffix_order(
        np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(s) for s in strings])
    )
    found = [strings[i][len(strings[i]) - n :] for i, n in zip(string, size, strict=True)]
    assert found == sorted(found) and len(found) == sum(map(len, strings)) + len(strings)
    for a, b, n in zip(found, found[1:], common[1:], strict=False):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# 5: pseudonyms.

PRIVATE = (
    "mail jane.doe+1@mail7.example.com or +1 (663) 555-6869, (212) 555-0100; card 4465758382889437, "
    "4111 1111 1111 1111. Born 1987-03-14, 14.03.1987, 3/14/1987, ssn 123-45-6789, ip 152.143.123.131, "
    'iban DE89370400440532013000, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff".'
)
KEPT = "id 4465758382889438, ip 300.1.1.1, date 1987-02-30, ssn 000-12-3456, version 1.2.3, iban DE00370400440532013000, 12345"


def test_pseudonyms_and_back():
    text, kinds = pseudonyms.Pseudonymizer().replace(PRIVATE)
    assert kinds == ["email", "phone", "phone", "card", "card", "date", "date", "date", "ssn", "ip", "iban", "secret"]
    assert not set(PRIVATE.replace(",", " ").split()) & set(text.replace(",", " ").split()) & {
        "4465758382889437", "152.143.123.131", "123-45-6789", "1987-03-14", "DE89370400440532013000",
    }
    assert "jane.doe+1@mail7.example.com" not in text and "555-6869" not in text
    assert pseudonyms.Pseudonymizer(back=True).replace(text)[0] == PRIVATE
    assert pseudonyms.Pseudonymizer().replace(KEPT) == (KEPT, [])
    assert pseudonyms.Pseudonymizer(b"other").replace(PRIVATE)[0] != text


@pytest.mark.parametrize("size", [1, 2, 7, 10, 99, 1000])
def test_permutation_is_one(size):
    made = pseudonyms.Permutation(b"k", "x", size)
    assert sorted(map(made, range(size))) == list(range(size))
    assert all(made.inverse(made(i)) == i for i in range(size))


@pytest.mark.parametrize(
    "piece", ["a%", "12 3456 78 ", "+1 23 23 ", "a.", "a@b.", "4111 1111 1111 1112 ", "DE89 3704 ", "1.2.", "12/12/", "x+y-", "212-555-"]
)
def test_long_texts_take_linear_time(piece):
    """Long texts of what looks like the start of a value; a scan that starts over takes minutes."""
    maker = pseudonyms.Pseudonymizer(pseudonyms.KEY)
    begun = time.perf_counter()
    text, kinds = maker.replace(piece * (200_000 // len(piece)) + " last@example.org")
    assert kinds[-1:] == ["email"] and not text.endswith("last@example.org")
    assert time.perf_counter() - begun < 30


def test_digits_of_other_scripts_stay():
    maker = pseudonyms.Pseudonymizer(pseudonyms.KEY)
    wide = "\uff14\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11"
    assert maker.replace(wide) == (wide, [])


def test_pseudonyms_link_documents(spark):
    rows = [(1, "a 4465758382889437 b"), (2, "4465758382889437"), (3, None), (4, "clean text")]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"].split()[1] == got[2]["text"] != "4465758382889437"
    assert got[3]["text"] is None and got[3]["n_values"] == 0 and got[4]["text"] == "clean text"


@pytest.mark.parametrize(
    "before, value, after",
    [
        ("", "4111 1111 1111 1111", " 123"), ("", "4111 1111 1111 1111", " 12/27"), ("", "4111 1111 1111 1111", " 5 items"),
        ("order 12 ", "4111 1111 1111 1111", ""), ("no 7-", "4111-1111-1111-1111", "-99"), ("", "+1 663 555 6869", " 2024"),
        ("", "+44 20 7946 0958", " 2024"), ("", "+1 (663) 555-6869", " 17"),
        ("1 2 3 4 5 6 7 ", "4111 1111 1111 1111", ""),
    ],
)
def test_values_between_other_numbers(before, value, after):
    maker = pseudonyms.Pseudonymizer()
    alone, kinds = maker.replace(value)
    assert len(kinds) == 1 and alone != value
    assert maker.replace(before + value + after) == (before + alone + after, kinds)


@pytest.mark.parametrize(
    "value, kind",
    [
        ("DE89 3704 0044 0532 0130 00", "iban"), ("ES91 2100 0418 4502 0005 1332", "iban"), ("25/12/1985", "date"), ("31/1/1985", "date"),
        ("josé@x.com", "email"), ("李雷@example.com", "email"),
    ],
)
def test_other_forms_and_back(value, kind):
    text, kinds = pseudonyms.Pseudonymizer().replace(f"at {value} PAGO")
    assert kinds == [kind] and value not in text and text.startswith("at ") and text.endswith(" PAGO")
    assert pseudonyms.Pseudonymizer(back=True).replace(text)[0] == f"at {value} PAGO"


# 6: nearest vectors.


def test_nearest_on_odd_vectors(spark):
    made = np.random.default_rng(0)
    rows = [(int(i), made.normal(size=6).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 6) for i in range(40)]
    odd = [(400, None), (500, []), (600, [0.0] * 6), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [1.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = postings.search(frame).toPandas()
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    assert sorted(set(got.query_id)) == [0, 100, 200, 300]
    hits = 0
    for query, own in got.groupby("query_id"):
        far = sorted((float(np.sqrt(((v - vectors[query]) ** 2).sum())), i) for i, v in vectors.items() if i != query)
        assert list(own.sort_values("rank")["rank"]) == list(range(1, 11))
        hits += len({i for _, i in far[:10]} & set(own.vec_id))
        for r in own.itertuples():
            assert r.score == pytest.approx(np.linalg.norm(vectors[query] - vectors[r.vec_id]), abs=1e-12)
    assert hits >= 36
    assert list(got[got.query_id == 300].sort_values("rank").vec_id) == list(range(301, 311))
    assert postings.search(frame.limit(0)).count() == 0
    assert postings.search(frame.where("vec_id in (100, 101)")).count() == 1


def test_recall_on_the_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = postings.search(frame).toPandas()
    held = frame.toPandas()
    matrix, ids = np.stack(held.embedding).astype(float), held.vec_id.to_numpy()
    hits = 0
    for query, own in got.groupby("query_id"):
        far = np.sqrt(((matrix - matrix[ids == query][0]) ** 2).sum(1))
        far[ids == query] = np.inf
        hits += len(set(ids[np.lexsort((ids, far))[:10]]) & set(own.vec_id))
    assert hits >= 0.9 * len(got) and len(got) == 10 * (held.vec_id % 100 == 0).sum()


def test_recall_with_many_lists(spark, monkeypatch):
    """The lists that are read grow with the number of lists."""
    monkeypatch.setattr(postings, "LIST", 8)
    matrix = np.random.default_rng(3).normal(size=(6000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    got = postings.search(frame).toPandas()
    hits = 0
    for query, own in got.groupby("query_id"):
        far = np.sqrt(((matrix - matrix[query]) ** 2).sum(1))
        far[query] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & set(own.vec_id))
    assert len(got) == 600 and hits >= 0.9 * len(got)


def clustered(n, clusters, width=16):
    made = np.random.default_rng(5)
    return made.normal(size=(clusters, width))[made.integers(0, clusters, n)] + 0.15 * made.normal(size=(n, width))


def test_the_graph_finds_near_centroids():
    points = clustered(6000, 300)
    fitted = postings.fit_centroids(points, 1500, rounds=2)
    asked = points[::37]
    far = np.sqrt(postings._distances(asked, fitted.vectors))
    ids, found = fitted.nearest(asked, 10)
    best = np.argsort(far, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, best)]) >= 9.5
    assert np.allclose(found, np.take_along_axis(far, ids, axis=1), atol=1e-6)
    point, at = fitted.within(asked, 2.0, 0.0)
    wanted = set(zip(*np.nonzero(far <= 2.0 * far.min(axis=1, keepdims=True))))
    got = set(zip(point.tolist(), at.tolist()))
    assert len(got) == len(point) and len(got & wanted) >= 0.98 * len(wanted) and len(got - wanted) <= 0.02 * len(wanted)
    # Without a limit on the ratio all centroids are within it, also for a point that lies on one.
    point, at = fitted.within(fitted.vectors[:2], 1e9, 1.0)
    assert len(set(zip(point, at))) == 2 * len(fitted.vectors)


def test_the_ratio_prunes_lists(spark, monkeypatch):
    """Few of many lists are read where vectors have structure, and the recall holds."""
    monkeypatch.setattr(postings, "LIST", 8)
    matrix = clustered(8000, 200)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    rows = postings.usable(frame)
    lists, centroids = postings.build_lists(rows, 8000)
    ratio, floor = postings.ratio_to_read(rows, lists.cache(), centroids, 100, 10)
    point, _ = centroids.within(matrix[::100], ratio, floor)
    assert len(centroids.vectors) == 1000 and np.bincount(point).mean() < 200
    got = postings.search(frame).toPandas()
    hits = 0
    for query, own in got.groupby("query_id"):
        far = np.sqrt(((matrix - matrix[query]) ** 2).sum(1))
        far[query] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & set(own.vec_id))
    assert len(got) == 800 and hits >= 0.93 * len(got)


def test_equal_vectors_only(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1200)]
    got = postings.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 120 and (got.score == 0).all()
    own = got[got.query_id == 300].sort_values("rank").vec_id.tolist()
    assert own == list(range(10))


# 7: mixing.


def test_mix_keeps_to_its_weights(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(docs, repetitions=3.0).toPandas()
    size = docs.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").sum("n").toPandas().set_index("source")["sum(n)"]
    seen = got.groupby("source").n_tokens.sum()
    assert seen["big"] == size["big"] and seen["small"] / size["small"] == pytest.approx(3.0, abs=0.05)
    share = got.assign(half=got.block < mixing.BLOCKS // 2).groupby(["source", "half"]).n_tokens.sum()
    assert share["big", True] / share["big", False] == pytest.approx(1, abs=0.15)


def test_words_are_counted_by_white_space(spark):
    texts = ["a b c d e", "a\nb\nc\td\r\ne", "a     b", " \n\t ", "", None, "\x0bone\x0c two ", "x\u00a0y", "z" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["text"]: r["n"] for r in df.select("text", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert [found[t] for t in texts] == [5, 5, 2, 0, 0, 0, 2, 1, 1]


def test_mix_odd_rows(odd):
    got = mixing.mix_documents(odd).where("epoch = 0").collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows()} and len(got) == len(odd_rows())
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_the_stage_weighs_sources_by_token_ids(spark):
    """Lines, blanks and indentation do not make a source look small or large."""
    texts = {"lines": "\n".join(["word"] * 60), "blanks": " ".join(["word"] * 60), "indented": "word " + " " * 400 + " word" * 59}
    rows = [(i, text, source) for k, (source, text) in enumerate(texts.items()) for i in range(1000 * k, 1000 * k + 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = packing.WordIds(tokenizer_path())
    size = {source: 40 * len(ids.ids(text)) // 4 for source, text in texts.items()}
    got = {r["source"]: r["count"] for r in corpus_pipeline.source_mix(spark, docs, SF).groupBy("source").count().collect()}
    top, least = max(size.values()), min(size.values())
    exponent = max(0.0, 1 - np.log(1.5) / np.log(top / least))
    for source, n in size.items():
        assert got[source] == pytest.approx(40 * (n / top) ** (exponent - 1), abs=1.01)


def test_exponent_for_an_entropy(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1)], "_source string, tokens long")
    exponent = mixing.fit_exponent(sources, entropy=0.9)
    weights = np.array([100.0, 10.0, 1.0]) ** exponent
    weights /= weights.sum()
    assert -(weights * np.log(weights)).sum() == pytest.approx(0.9, abs=1e-9)
    assert mixing.fit_exponent(sources, entropy=5.0) == 0.0
    assert mixing.fit_exponent(sources, repetitions=10.0) == pytest.approx(0.5, abs=1e-9)


# 8: fingerprints.


def test_fingerprints_equal_brute_force(odd):
    got = {r["edited_sha256"]: r for r in digests.fingerprint_documents(odd).collect()}
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["t"]))
    for now, after in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(now["text"]) // 2
        edited = (now["text"][: len(now["text"]) - half] + after["text"][:half]).encode()
        row = got[hashlib.sha256(edited).hexdigest()]
        mark, other, then = (digests.digest(x) for x in (now["text"].encode(), edited, after["text"].encode()))
        assert row["edited_fingerprint"] == other and 0 <= row["near_next"] <= 1
        if row["doc_id"] == now["doc_id"]:
            assert (row["fingerprint"], row["n_chars"]) == (mark, len(now["text"]))
            assert row["near_edited"] == pytest.approx(digests.likeness(mark, other))
            assert row["near_next"] == pytest.approx(digests.likeness(mark, then))


def test_edited_texts_are_nearer_than_the_next(spark):
    got = digests.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    own = got[got.n_chars > 200]
    assert (own.near_edited > own.near_next).mean() > 0.85
    assert digests.likeness(digests.digest(b"abc" * 9), digests.digest(b"abc" * 9)) == 1.0
    assert digests.digest(b"") == digests.digest(b"")


# 9: paragraphs.


def test_paragraphs_find_passages_inside_lines(spark):
    passage = words(70, 11)
    rows = [(i, f"{words(60 + i, 100 + i)} {passage} {words(50, 200 + i)}") for i in range(6)]
    rows += [(10 + i, words(200, 300 + i)) for i in range(4)] + [(20, rows[0][1]), (21, "same line here\n" * 2)]
    got = {r["doc_id"]: r for r in paragraphs.removed_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["class_id"] == 0 and got[i]["n_words_removed"] >= 30 for i in range(1, 6))
    assert all(got[10 + i]["n_removed"] == 0 for i in range(4)) and got[21]["n_removed"] == 0
    assert got[20]["n_removed"] == got[20]["n_paragraphs"]
    text = rows[1][1]
    left = paragraphs.without_paragraphs(text, got[1]["removed"])
    assert len(left.split()) == len(text.split()) - got[1]["n_words_removed"]
    assert paragraphs.without_paragraphs("", []) == "" and paragraphs.without_paragraphs("a b ", []) == "a b "


def test_near_paragraphs_equal_brute_force(spark):
    """Every pair of different paragraphs that are similar enough is linked."""
    made = random.Random(4)
    base = words(400, 21).split()
    rows = []
    for i in range(12):
        copy = [w if made.random() > 0.01 else f"new{made.randint(0, 99999)}" for w in base]
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands, band_rows = paragraphs.bands_for(0.8, 0.99)
    table = paragraphs._cut_table(docs.withColumn("tie", F.lit(0).cast("long")), bands, band_rows)
    found = paragraphs._colliding(table, bands, 2, 0.8).collect()
    together = {}
    for r in found:
        together.setdefault(r["bucket"], set()).add(r["node"])
    sets = {}
    for _, text in rows:
        cut = paragraphs.Paragraphs(text)
        hashes, first = cut.shingles(np.arange(len(cut.units)))
        for unit, part in zip(cut.units.view(np.int64).tolist(), np.split(hashes, first[1:]), strict=True):
            sets[unit] = set(part.tolist())
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    hit = sum(any(a in g and b in g for g in together.values()) for a, b in pairs)
    assert not pairs or hit >= 0.95 * len(pairs)


def test_planted_paragraphs_of_any_length_are_removed(spark):
    """Exact and near copies of lines of 10 to 150 words, between lines of their own."""
    made, rows, exact, near = random.Random(9), [], {}, {}
    for i, n in enumerate(range(10, 151, 5)):
        line = words(n, 1000 + i)
        rows.append((i, f"{words(40, 2000 + i)}\n{line}\n{words(30, 3000 + i)}"))
        rows.append((100 + i, f"{words(35, 4000 + i)}\n{line}\n{words(45, 5000 + i)}"))
        exact[100 + i] = n
        copy = line.split()
        # A changed word in the middle is in five shingles; from 50 words on the copy is near enough.
        copy[made.choice([0, n - 1]) if n < 50 else n // 2] = "changed"
        if jaccard(text_shingles(line), text_shingles(" ".join(copy))) >= 0.8:
            rows.append((200 + i, f"{words(33, 6000 + i)}\n{' '.join(copy)}\n{words(41, 7000 + i)}"))
            near[200 + i] = n
    got = {r["doc_id"]: r for r in paragraphs.removed_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_words_removed"] == n and got[i]["class_id"] == i - 100 for i, n in exact.items())
    assert len(near) >= 20 and sum(got[i]["n_words_removed"] >= n for i, n in near.items()) >= 0.95 * len(near)


def test_runs_reach_the_ends_of_the_passage(spark):
    passage = words(60, 31)
    rows = [(i, f"{words(50, 400 + i)} {passage} {words(50, 500 + i)}") for i in range(8)]
    got = {r["doc_id"]: r for r in paragraphs.removed_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_words_removed"] == 0
    # A chunk over the border that is nearly equal goes whole, with a word or two beyond.
    assert all(60 <= got[i]["n_words_removed"] <= 64 for i in range(1, 8))
    assert not any(passage.split()[0] in paragraphs.without_paragraphs(t, got[i]["removed"]) for i, t in rows[1:])


def test_bands():
    bands, rows = paragraphs.bands_for(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= paragraphs.MAX_BANDS


# 10: languages.


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    for r in got.head(50).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_of_odd_rows(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in languages.language_id(odd).collect() if r["doc_id"]}
    assert [got[i] for i in (5, 6, 7, 8)] == ["und"] * 4 and got[9] in ("en", "fr")
    kept = languages.keep_known(odd)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0


def test_filter_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert languages.language_id(docs).first()["lang_pred"] == "und"


def test_the_stage_rejects_unknown_scripts_only(spark):
    made = random.Random(2)
    known = [(i, " ".join(made.choice(["the", "house", "garden", "walked", "river"]) for _ in range(30)), "en") for i in range(40)]
    rows = [*known, (100, "今日は天気がいいですね散歩に行きましょう", "ja"), (101, "the garden river", None), (102, "12 34", None)]
    rows = [(d, t, lang if d < 100 else None) for d, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in languages.keep_known(docs).collect()} == {*range(40), 101}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in languages.keep_known(bare).collect()} == {*range(40), 100, 101}


def test_more_than_64_languages():
    slots = np.zeros((1 << languages.SLOT_BITS, 2), dtype=np.uint64)
    for at in languages._probes(languages.gram_hashes("hello")):
        slots[at.astype(np.int64), 1] |= np.uint64(1 << 5)
    model = languages.LanguageFilter([str(i) for i in range(70)], slots)
    assert int(np.argmax(languages.shares("hello", model, model.false_positives()))) == 69


# The pipeline.


def test_stages_and_pipeline(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "sequences"]
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    again = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(rows.doc_id) == sorted(again.doc_id) and rows.length.sum() == again.length.sum()
    check_sequences(again)


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == odd.columns and docs.count() > 0


def test_shingle_hashes_depend_on_words_only():
    a, b = shingles.shingle_set("One two  three four five six"), shingles.shingle_set("one TWO three\nfour five six")
    assert len(a) == 2 and (a == b).all() and len(shingles.shingle_set("")) == 0


def test_tables_of_the_near_duplicate_join_go_before_rows_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(groups, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text + " more"), (3, "some other words that are alone here"), (4, None), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.one_of_each_class(docs)
    assert [f.name for f in tmp_path.glob("shelf-*/*")] == ["classes"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4]
