"""Exact substring dedup with the suffix order of a collection, built column by column.

Bytes are removed where a string of ``WIDTH`` bytes also starts in an earlier document. Strings
that may repeat are found by anchors: the smallest hash of the short windows inside a string
is the same wherever the string stands, so only anchors that several documents have matter. The
text around those makes a collection of short strings, dealt by anchor. In each part the
collection's Burrows-Wheeler transform and common prefixes are built by rounds: every round puts one
more symbol in front of the suffixes of all strings, and a stable sort of the transform is their new order.
Suffixes in a row with ``WIDTH`` common symbols are the repeated strings.

The rounds are as many as the longest string has symbols. Over whole documents that would be the length of
the longest text with a pass over all data each; around anchors it is at most ``2 * WIDTH``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.groups import Columns, each_group
from facetloom.llm.shingles import prefix_sums, span_hashes, window_hashes

WIDTH = 50
ANCHOR = 24
#: Windows that a string around an anchor can have.
REACH = WIDTH - ANCHOR + 1
SEGMENT = 1 << 16
BLOCK_BYTES = 6_000_000
#: Input bytes whose anchors go to one part.
PART_BYTES = 24_000_000
#: Symbols whose suffix order is built at once.
SYMBOLS = 400_000

_LOG = np.zeros(1, dtype=np.int64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, span, out = len(values) - width + 1, 1, values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def anchored_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor in texts that lie end to end.

    Returns start (of the first window), number of windows, anchor, and hash of the bytes of
    the whole run. Windows do not cross the ``ends`` of texts; runs have at most ``REACH`` windows.
    """
    starts = np.concatenate(([0], ends[:-1]))
    whole = ends - starts >= WIDTH
    steps = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(steps, starts[whole], 1)
    np.add.at(steps, ends[whole] - WIDTH + 1, -1)
    valid = np.cumsum(steps[:-1]) > 0
    found: list[tuple[np.ndarray, ...]] = []
    low, total = 0, len(data) - WIDTH + 1
    while low < total:
        part = data[low : low + SEGMENT + WIDTH - 1]
        sums = prefix_sums(part)
        least = _sliding_min(window_hashes(sums, ANCHOR), REACH)
        ok = valid[low : low + len(least)]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(least)))
        following = low + len(least)
        if following < total:
            # The last run may go on: what is not a whole piece of it is left to the next segment, so that
            # runs depend on their text alone, not on the texts that lie before it.
            length[-1] -= length[-1] % REACH
            following = low + int(first[-1] + length[-1])
        keep = ok[first] & (length > 0)
        first, length = first[keep], length[keep]
        # Periodic text keeps one anchor for long; such runs are cut.
        pieces = -(-length // REACH)
        inside = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = np.repeat(first, pieces) + inside * REACH, np.repeat(length, pieces) - inside * REACH
        length = np.minimum(left, REACH)
        hashes = span_hashes(sums, first, first + length + WIDTH - 1)
        found.append((first + low, length, least[first], hashes))
        low = following
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, bytes end to end, and ends, of the rows that have a doc_id."""
    table = table.filter(pa.compute.is_valid(table["doc_id"]))
    ids = table["doc_id"].to_numpy()
    texts = table["bytes"].to_pylist()
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return ids, data, np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``data`` end to end."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return data[shift + np.arange(len(shift))]


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each group of equal, sorted keys begins."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _anchors_of_block(parts: int):
    """Of a block of texts: the anchors of one document and those of several, by part."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, data, ends = _texts(table)
        start, _, anchor, _ = anchored_runs(data, ends)
        doc = ids[np.searchsorted(ends, start, side="right")]
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        first = _groups(anchor)
        anchor = anchor[first]
        several = (
            np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            if len(first)
            else np.empty(0, dtype=bool)
        )
        part = ((anchor >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        rows = []
        for p in range(parts):
            mine = part == p
            if mine.any():
                one, more = anchor[mine & ~several], anchor[mine & several]
                rows.append((p, key[0].as_py(), one.tobytes(), more.tobytes()))
        names = {"part": pa.int32(), "block": pa.int32(), "one": pa.binary(), "more": pa.binary()}
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names.items())})

    return run


def _repeated_anchors(group: Columns) -> Columns | None:
    """Anchors of several documents, back to the blocks that have them."""
    blocks, anchors, several = [], [], []
    for block, one, more in zip(group["block"], group["one"], group["more"], strict=True):
        for raw, many in ((one, False), (more, True)):
            values = np.frombuffer(raw, dtype=np.uint64)
            anchors.append(values)
            blocks.append(np.full(len(values), block))
            several.append(np.full(len(values), many))
    anchor, block, many = (np.concatenate(x) for x in (anchors, blocks, several))
    order = np.argsort(anchor, kind="stable")
    anchor, block, many = anchor[order], block[order], many[order]
    first = _groups(anchor)
    count = np.diff(np.append(first, len(anchor)))
    keep = np.repeat((count > 1) | np.logical_or.reduceat(many, first), count)
    if not keep.any():
        return None
    anchor, block = anchor[keep], block[keep]
    order = np.argsort(block, kind="stable")
    anchor, block = anchor[order], block[order]
    first = _groups(block)
    out = np.empty(len(first), dtype=object)
    out[:] = [a.tobytes() for a in np.split(anchor, first[1:])]
    return {"block": block[first].astype(np.int32), "anchors": out}


_STRINGS = {
    "part": pa.int32(), "block": pa.int32(), "anchors": pa.binary(), "hashes": pa.binary(),
    "windows": pa.binary(), "low": pa.binary(), "high": pa.binary(), "data": pa.binary(),
}


def _strings_of_block(parts: int):
    """Of a block of texts: the different strings around repeated anchors, by part."""
    def run(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = np.frombuffer(b"".join(asked["anchors"].to_pylist()), dtype=np.uint64)
        rows = []
        if len(wanted) and table.num_rows:
            wanted = np.sort(wanted)
            ids, data, ends = _texts(table)
            start, windows, anchor, hashes = anchored_runs(data, ends)
            place = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
            keep = wanted[place] == anchor
            start, windows, anchor, hashes = (x[keep] for x in (start, windows, anchor, hashes))
            doc = ids[np.searchsorted(ends, start, side="right")]
            order = np.lexsort((hashes, anchor))
            start, windows, anchor, hashes, doc = (x[order] for x in (start, windows, anchor, hashes, doc))
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(new)
            low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            start, windows, anchor, hashes = (x[first] for x in (start, windows, anchor, hashes))
            part = ((anchor >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            packer = zstandard.ZstdCompressor(level=6)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                raw = _gather(data, start[at], windows[at] + WIDTH - 1).tobytes()
                rows.append(
                    (
                        p, key[0].as_py(), packer.compress(anchor[at].tobytes()), hashes[at].tobytes(),
                        windows[at].astype(np.uint8).tobytes(), packer.compress(low[at].tobytes()),
                        packer.compress(high[at].tobytes()), packer.compress(raw),
                    )
                )
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_STRINGS.items())})

    return run


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest value of each range ``[low, high]``, from minima over powers of two."""
    n = len(values)
    levels = np.empty((n.bit_length(), n), dtype=np.uint8)
    levels[0] = values
    for k in range(1, len(levels)):
        span, last = 1 << (k - 1), levels[k - 1]
        np.minimum(last[: n - span], last[span:], out=levels[k, : n - span])
    level = _LOG[high - low + 1]
    flat, row = levels.reshape(-1), level * n
    return np.minimum(flat[row + low], flat[row + high - (1 << level) + 1])


def suffix_order(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection of strings in order: string, length, common prefix.

    The common prefix is that with the suffix before, at most 255. In each round every string gives
    its next symbol from the right; the transform holds the symbol in front of each suffix, and sorting it
    stably puts the suffixes that it makes in order. Their common prefixes are one more than the
    smallest between the suffixes they come from.
    """
    global _LOG
    n, total = len(lengths), len(data) + len(lengths)
    if len(_LOG) <= total:
        _LOG = np.frexp(np.arange(2 * total + 2, dtype=np.float64))[1].astype(np.int64) - 1
    # Every string begins with a 0, its other symbols are larger.
    ends = np.cumsum(lengths + 1)
    text = np.zeros(total, dtype=np.uint8)
    inside = np.ones(total, dtype=bool)
    inside[ends - lengths - 1] = False
    text[inside] = data + np.uint8(1)
    last = (ends - 1).astype(np.int32)
    before, common = last, np.zeros(n, dtype=np.uint8)
    for _ in range(int(lengths.max(initial=0))):
        transform = text[before]
        order = np.argsort(transform, kind="stable")
        order = order[int(np.count_nonzero(transform == 0)) :]
        symbol = transform[order]
        prefix = np.zeros(n + len(order), dtype=np.uint8)
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        if len(same):
            between = _range_minima(common, order[same] + 1, order[same + 1])
            prefix[n + 1 + same] = np.minimum(between, 254) + 1
        before = np.concatenate((last, before[order] - 1))
        common = prefix
    string = np.searchsorted(ends, before, side="right")
    return string, ends[string] - 1 - before, common


def first_documents(data: np.ndarray, windows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each window of each string the smallest document of all strings that have it."""
    lengths = windows + WIDTH - 1
    strings, size, common = suffix_order(data, lengths)
    base = np.cumsum(windows) - windows
    out = np.repeat(low, windows)
    group = np.cumsum(common < WIDTH)
    held = size >= WIDTH
    group, strings, size = group[held], strings[held], size[held]
    first = _groups(group)
    least = np.minimum.reduceat(low[strings], first)
    out[base[strings] + lengths[strings] - size] = np.repeat(least, np.diff(np.append(first, len(group))))
    return out


def _shared_windows(
    data: np.ndarray, starts: np.ndarray, windows: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the windows of each string up to the last one whose hash is not alone."""
    lengths = windows + WIDTH - 1
    text = _gather(data, starts, lengths)
    place = _gather(np.arange(len(text)), np.cumsum(lengths) - lengths, windows)
    hashes = span_hashes(prefix_sums(text), place, place + WIDTH)
    order = np.argsort(hashes, kind="stable")
    first = _groups(hashes[order])
    count = np.diff(np.append(first, len(hashes)))
    at = np.sort(order[np.repeat(count > 1, count)])
    owner = np.repeat(np.arange(len(windows)), windows)[at]
    inside = at - (np.cumsum(windows) - windows)[owner]
    offset, n = np.zeros(len(windows), dtype=np.int64), np.zeros(len(windows), dtype=np.int64)
    begin = _groups(owner)
    if len(begin):
        who, last = owner[begin], np.append(begin[1:], len(owner)) - 1
        offset[who] = inside[begin]
        n[who] = inside[last] - inside[begin] + 1
    return offset, n


def _whole_anchors(
    values: np.ndarray, anchor: np.ndarray, symbols: np.ndarray, limit: int
) -> list[np.ndarray]:
    """``values`` in parts of about ``limit`` symbols that never split the strings of an anchor."""
    if not len(values):
        return []
    first = _groups(anchor)
    sums = np.add.reduceat(symbols, first)
    turn = (np.cumsum(sums) - sums) // limit
    return np.split(values, first[_groups(turn)[1:]])


def _meet(group: Columns) -> Columns | None:
    """Which windows of each block's strings an earlier document has."""
    unpack = zstandard.ZstdDecompressor().decompress
    anchor = np.frombuffer(b"".join(map(unpack, group["anchors"])), dtype=np.uint64)
    hashes = np.frombuffer(b"".join(group["hashes"]), dtype=np.uint64)
    windows = np.frombuffer(b"".join(group["windows"]), dtype=np.uint8).astype(np.int64)
    low = np.frombuffer(b"".join(map(unpack, group["low"])), dtype=np.int64)
    high = np.frombuffer(b"".join(map(unpack, group["high"])), dtype=np.int64)
    data = np.frombuffer(b"".join(map(unpack, group["data"])), dtype=np.uint8)
    block = np.repeat(group["block"], [len(h) // 8 for h in group["hashes"]])
    lengths = windows + WIDTH - 1
    starts = np.cumsum(lengths) - lengths

    # Equal strings of several blocks are one string of their first document.
    order = np.lexsort((hashes, anchor))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    first = np.flatnonzero(new)
    string = np.empty(len(order), dtype=np.int64)
    string[order] = np.cumsum(new) - 1
    some = order[first]
    least = np.minimum.reduceat(low[order], first)
    count = windows[some]
    base = np.cumsum(count) - count
    earliest = np.repeat(least, count)

    # Anchors with one string need no order, nor do strings without a window that another
    # string has by its hash. The others are cut to the windows that may be shared.
    begin = _groups(anchor[some])
    alike = np.diff(np.append(begin, len(some)))
    at = _gather(np.arange(len(some)), begin[alike > 1], alike[alike > 1])
    for turn in _whole_anchors(at, anchor[some[at]], lengths[some[at]], 8 * SYMBOLS):
        offset, n = _shared_windows(data, starts[some[turn]], count[turn])
        turn, offset, n = turn[n > 0], offset[n > 0], n[n > 0]
        places = np.arange(len(turn))
        for part in _whole_anchors(places, anchor[some[turn]], n + WIDTH - 1, SYMBOLS):
            text = _gather(data, starts[some[turn[part]]] + offset[part], n[part] + WIDTH - 1)
            where = _gather(np.arange(len(earliest)), base[turn[part]] + offset[part], n[part])
            earliest[where] = first_documents(text, n[part], least[turn[part]])

    # Runs of windows with the same first document, for the entries that have a later one.
    owner = np.repeat(np.arange(len(some)), count)
    new = np.ones(len(earliest), dtype=bool)
    new[1:] = (earliest[1:] != earliest[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    run_end = np.append(run[1:], len(earliest))
    run_owner = owner[run]
    runs_of = np.searchsorted(run_owner, np.arange(len(some) + 1))
    n_runs = np.diff(runs_of)[string]
    entry = np.repeat(np.arange(len(string)), n_runs)
    pick = _gather(np.arange(len(run)), runs_of[string], n_runs)
    keep = earliest[run[pick]] < high[entry]
    entry, pick = entry[keep], pick[keep]
    if not len(entry):
        return None
    order = np.argsort(block[entry], kind="stable")
    entry, pick = entry[order], pick[order]
    cuts = _groups(block[entry])[1:]
    shift = base[run_owner[pick]]

    def split(values: np.ndarray) -> np.ndarray:
        made = np.split(values, cuts)
        out = np.empty(len(made), dtype=object)
        out[:] = [m.tobytes() for m in made]
        return out

    return {
        "block": block[entry][np.append(0, cuts)].astype(np.int32),
        "hashes": split(hashes[entry]),
        "begin": split((run[pick] - shift).astype(np.uint8)),
        "until": split((run_end[pick] - shift).astype(np.uint8)),
        "docs": split(earliest[run[pick]]),
    }


_RESULT = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
    "kept_sha256": pa.string(), "spans": pa.list_(pa.int64()),
}


def _removals(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
    """The covered bytes of every text of a block."""
    ids, data, ends = _texts(table)
    cover = np.zeros(len(data) + 1, dtype=np.int32)
    hashes, low, high, docs = (
        np.frombuffer(b"".join(found[n].to_pylist()), dtype=t)
        for n, t in (("hashes", np.uint64), ("begin", np.uint8), ("until", np.uint8), ("docs", np.int64))
    )
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        hashes, low, high, docs = (x[order] for x in (hashes, low, high, docs))
        start, _, _, here = anchored_runs(data, ends)
        left = np.searchsorted(hashes, here, side="left")
        many = np.searchsorted(hashes, here, side="right") - left
        pick = _gather(np.arange(len(hashes)), left, many)
        start = np.repeat(start, many)
        later = docs[pick] < ids[np.searchsorted(ends, start, side="right")]
        start, pick = start[later], pick[later]
        np.add.at(cover, start + low[pick], 1)
        np.add.at(cover, start + high[pick] + WIDTH - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    rows = []

    def row(doc_id, begin: int, end: int, data: np.ndarray, gone: np.ndarray) -> tuple:
        mine = gone[begin:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
        kept = data[begin:end][~mine].tobytes()
        return (
            doc_id, end - begin, int(mine.sum()), len(edges) // 2,
            hashlib.sha256(kept).hexdigest(), edges.tolist(),
        )

    begin = 0
    for doc_id, end in zip(ids.tolist(), ends.tolist(), strict=True):
        rows.append(row(doc_id, begin, end, data, gone))
        begin = end
    for text in table.filter(pa.compute.is_null(table["doc_id"]))["bytes"].to_pylist():
        raw = np.frombuffer(text, dtype=np.uint8)
        rows.append(row(None, 0, len(raw), raw, np.zeros(len(raw), dtype=bool)))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_RESULT.items())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove the bytes covered by a ``WIDTH``-byte string that starts in an earlier document.

    Earlier means a smaller doc_id; all strings are judged on the input. Returns doc_id,
    n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256 (of the bytes left) and spans (begin and end
    of each run), a row per input row. A null text is empty. Rows that repeat a doc_id leave each
    other alone; a row with a null doc_id takes no part.

    The texts are dealt to blocks of a bounded size once, and all three passes over them share that shuffle.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(size)).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    parts = max(1, -(-total // PART_BYTES))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    by_block = texts.groupBy("block")
    anchors = by_block.applyInArrow(
        _anchors_of_block(parts), "part int, block int, one binary, more binary"
    )
    repeated = each_group(anchors, ["part"], _repeated_anchors, "block int, anchors binary")
    strings = by_block.cogroup(repeated.groupBy("block")).applyInArrow(
        _strings_of_block(parts),
        "part int, block int, anchors binary, hashes binary, windows binary, low binary, high binary, data binary",
    )
    found = each_group(
        strings, ["part"], _meet, "block int, hashes binary, begin binary, until binary, docs binary"
    )
    return by_block.cogroup(found.groupBy("block")).applyInArrow(
        _removals,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>",
    )
