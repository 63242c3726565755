"""Trees of a forest one at a time: their packed form, the leaves rows end in, and what votes lose when one feature changes.

A packed node takes two bytes in most forests. A whole forest is never unpacked: rows are held in blocks, and the trees go
past them in groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Rows that go down a tree at a time.
ROWS = 1 << 12
#: Changed rows whose votes are held at a time.
CASES = 1 << 18
#: The highest bit, and the lowest one, of each byte of a word.
HIGH = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)

#: Subtrees by the number of their node: feature, cut or class, and counts of the mixed leaves.
Packed = dict[int, tuple[bytes, bytes, bytes]]


@dataclass
class Top:
    """The large nodes of a tree: feature and cut of those that are split, counts by class of those that are leaves."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, list[float]] = field(default_factory=dict)


def _small(most: int) -> type:
    """The kind of number for 0 to ``most`` and one mark beyond."""
    return np.uint8 if most < 255 else np.int32


def pack(feature: np.ndarray, cut: np.ndarray, counts: np.ndarray, width: int) -> tuple[bytes, bytes, bytes]:
    """A subtree in order of its levels, as ``Grower.grow`` gives it; left children follow from that order."""
    classes = counts.shape[1]
    places, values = _small(width), _small(max(classes, 32))
    leaf = feature < 0
    mixed = leaf & ((counts > 0).sum(axis=1) != 1)
    value = np.where(leaf, np.where(mixed, classes, counts.argmax(axis=1)), cut)
    held = counts[mixed]
    # Counts are whole numbers.
    kind = np.float32 if held.max(initial=0) < 2**24 else np.float64
    return np.where(leaf, width, feature).astype(places).tobytes(), value.astype(values).tobytes(), held.astype(kind).tobytes()


def shares(counts: np.ndarray) -> np.ndarray:
    """Votes by counts, rounded to the 40th binary place: sums of them are exact, so they give the same ties in any order."""
    sums = counts.sum(axis=1, keepdims=True)
    return np.round(np.divide(counts, sums, out=np.zeros_like(counts), where=sums > 0) * 2.0**40) / 2.0**40


def features_of(subtree: tuple[bytes, bytes, bytes], width: int) -> np.ndarray:
    """The features that a packed subtree splits by."""
    seen = np.bincount(np.frombuffer(subtree[0], _small(width)), minlength=width + 1)
    return np.flatnonzero(seen[:width])


@dataclass
class Tree:
    """A tree as arrays: feature of each node (-1: leaf), cut, left child (the right one follows it), and votes.

    A leaf votes for the class ``kind``; from the number of classes on, ``kind`` is a line of ``table``. The root is the first node.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    kind: np.ndarray
    table: np.ndarray

    @staticmethod
    def unpacked(top: Top, parts: Packed, width: int, classes: int, renamed: np.ndarray | None = None) -> Tree:
        """The tree of its large nodes and packed subtrees; features get the names ``renamed`` gives to their places."""
        order = [1]
        lefts = {}
        for number in order:
            if number in top.splits:
                lefts[number] = len(order)
                order += [2 * number, 2 * number + 1]
        head = np.zeros((len(order), 4), dtype=np.int64)
        bodies, tables = [], [np.empty((0, classes))]
        begin, lines = len(order), classes
        for slot, number in enumerate(order):
            if number in top.splits:
                f, c = top.splits[number]
                head[slot] = f, c, lefts[number], 0
                continue
            if number not in parts:
                # A large leaf; a tree that drew no row votes for no class.
                tables.append(np.array([top.leaves.get(number, [0.0] * classes)], dtype=np.float64))
                head[slot] = width, 0, 0, lines
                lines += 1
                continue
            first, value, held = parts[number]
            feature = np.frombuffer(first, _small(width)).astype(np.int64)
            value = np.frombuffer(value, _small(max(classes, 32))).astype(np.int64)
            inner = feature < width
            mixed = np.flatnonzero(~inner & (value == classes))
            size = len(held) // max(1, len(mixed) * classes)
            tables.append(np.frombuffer(held, np.float64 if size == 8 else np.float32).astype(np.float64).reshape(-1, classes))
            kind = np.where(inner, 0, value)
            kind[mixed] = lines + np.arange(len(mixed))
            lines += len(mixed)
            # Children of the n-th split node are the nodes 1 + 2n and 2 + 2n; the root lies with the large nodes.
            left = np.where(inner, begin + 2 * (np.cumsum(inner) - 1), 0)
            body = np.stack([feature, np.where(inner, value, 0), left, kind], axis=1)
            head[slot] = body[0]
            bodies.append(body[1:])
            begin += len(body) - 1
        whole = np.concatenate([head, *bodies])
        names = np.append(np.arange(width) if renamed is None else renamed, -1)
        return Tree(names[whole[:, 0]], whole[:, 1].astype(np.uint8), whole[:, 2], whole[:, 3], shares(np.concatenate(tables)))

    def follow(self, x: np.ndarray, donors: np.ndarray | None = None, seen: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row. A byte of ``donors`` is another value of a feature: its highest bit in ``seen``, which has the
        same form, is set where a node on the way would send that value to the other side."""
        rows, width = x.shape
        flat, leaf, active = x.ravel(), np.zeros(rows, dtype=np.int64), np.arange(rows)
        here = np.zeros(rows, dtype=np.int64)
        if seen is not None:
            donors, seen = donors.reshape(rows * width, -1), seen.reshape(rows * width, -1)
        while True:
            feature = self.feature[here]
            inner = feature >= 0
            if not inner.all():
                leaf[active[~inner]] = here[~inner]
                active, here, feature = active[inner], here[inner], feature[inner]
                if not len(active):
                    return leaf
            at, cut = active * width + feature, self.cut[here]
            right = flat[at] > cut
            if seen is not None:
                # Values lie below 128: a byte keeps its high bit exactly if the value is above the cut.
                over = (donors[at] | HIGH) - ((cut.astype(np.uint64) + np.uint64(1)) * ONES)[:, None]
                seen[at] |= (over & HIGH) ^ (right.astype(np.uint64) * HIGH)[:, None]
            here = self.left[here] + right

    def follow_changed(self, x: np.ndarray, row: np.ndarray, feature: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The leaf that each of the rows ``x[row]`` ends in if it has ``code`` in one feature."""
        width, flat = x.shape[1], x.ravel()
        leaf, active, here = np.zeros(len(row), dtype=np.int64), np.arange(len(row)), np.zeros(len(row), dtype=np.int64)
        while True:
            asked = self.feature[here]
            inner = asked >= 0
            if not inner.all():
                leaf[active[~inner]] = here[~inner]
                active, here, asked = active[inner], here[inner], asked[inner]
                if not len(active):
                    return leaf
            value = np.where(asked == feature[active], code[active], flat[row[active] * width + asked])
            here = self.left[here] + (value > self.cut[here])

    def vote(self, votes: np.ndarray, at: np.ndarray, leaf: np.ndarray, sign: int = 1) -> None:
        """Add the votes of the leaves to the lines ``at``, no two of which are the same."""
        kind, classes = self.kind[leaf], votes.shape[1]
        pure = kind < classes
        votes[at[pure], kind[pure]] += sign
        if not pure.all():
            votes[at[~pure]] += sign * self.table[kind[~pure] - classes]


def _parts(rows: int, step: int) -> Iterator[slice]:
    for low in range(0, rows, step):
        yield slice(low, min(rows, low + step))


#: Gives all trees of the forest, one after another, each time it is called.
Trees = Callable[[], Iterator[Tree]]


def block_losses(trees: Trees, x: np.ndarray, donor: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """For each feature the rows guessed right that another value makes wrong, less the reverse, over all other values.

    ``x`` is rows by features, ``donor`` rows by features by repeats, both in bytes below 128. The trees go past the
    rows once, which gives the votes and, for each changed row, how many trees it leaves its way in. A tree that it leaves takes at
    most one vote from the guess and gives at most one to another class; only changed rows that could lose their lead
    go down again, in the trees that they leave. Where many rows are equal, each different one goes down once.
    """
    total = np.zeros(x.shape[1], dtype=np.int64)
    if not x.size or not donor.size:
        return total
    if not _few_losses(trees, x, donor, label, classes, total):
        _far_losses(trees, x, donor, label, classes, total)
    return total


def _few_losses(trees: Trees, x: np.ndarray, donor: np.ndarray, label: np.ndarray, classes: int, total: np.ndarray) -> bool:
    """Add the losses if so many rows, and changed rows, are equal that it pays to vote once for all that are."""
    packed = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()
    if x.shape[1] <= 8:
        wide = np.zeros((len(x), 8), dtype=np.uint8)
        wide[:, : x.shape[1]] = x
        packed = wide.view(np.uint64).ravel()
    _, first, place = np.unique(packed, return_index=True, return_inverse=True)
    if len(first) * 8 > len(x):
        return False
    rows, features, codes, labels, counts = [], [], [], [], []
    for f in range(x.shape[1]):
        differs = donor[:, f] != x[:, f, None]
        key = ((place.ravel()[:, None] * 128 + donor[:, f]) * classes + label[:, None])[differs]
        key, n = np.unique(key, return_counts=True)
        if sum(map(len, rows)) + len(key) > len(x):
            return False
        changed, of = np.divmod(key, classes)
        rows.append(changed // 128)
        codes.append(changed % 128)
        features.append(np.full(len(key), f))
        labels.append(of)
        counts.append(n)
    known = x[first]
    votes = np.zeros((len(known), classes))
    for tree in trees():
        tree.vote(votes, np.arange(len(known)), tree.follow(known))
    guess = votes.argmax(axis=1)
    row, feature, code, of, n = (np.concatenate(a) for a in (rows, features, codes, labels, counts))
    for part in _parts(len(row), max(1, CASES * 8 // classes)):
        after = np.zeros((part.stop - part.start, classes))
        for tree in trees():
            tree.vote(after, np.arange(len(after)), tree.follow_changed(known, row[part], feature[part], code[part]))
        lost = (guess[row[part]] == of[part]).astype(np.int64) - (after.argmax(axis=1) == of[part])
        np.add.at(total, feature[part], lost * n[part])
    return True


def _far_losses(trees: Trees, x: np.ndarray, donor: np.ndarray, label: np.ndarray, classes: int, total: np.ndarray) -> None:
    rows, width = x.shape
    # Eight repeats in a word; those that are filled up change nothing.
    words = -(-donor.shape[2] // 8)
    full = donor
    if donor.shape[2] % 8:
        full = np.repeat(x[:, :, None], words * 8, axis=2)
        full[:, :, : donor.shape[2]] = donor
    donors = np.ascontiguousarray(full).view(np.uint64)
    votes, met, wide = np.zeros((rows, classes)), np.zeros_like(donors), None
    seen = np.empty((min(rows, ROWS), width, words), dtype=np.uint64)
    for done, tree in enumerate(trees(), 1):
        for part in _parts(rows, ROWS):
            own = seen[: part.stop - part.start]
            own[:] = 0
            tree.vote(votes[part], np.arange(len(own)), tree.follow(x[part], donors[part], own))
            own >>= np.uint64(7)
            met[part] += own
        if done % 255 == 0:
            # A byte counts no further.
            wide = met.view(np.uint8).astype(np.uint32) if wide is None else wide + met.view(np.uint8)
            met[:] = 0
    ranked = np.partition(votes, -2, axis=1)[:, -2:] if classes > 1 else np.insert(votes, 0, 0.0, axis=1)
    lead, guess = ranked[:, 1] - ranked[:, 0], votes.argmax(axis=1)

    def resolve(row: np.ndarray, feature: np.ndarray, repeat: np.ndarray) -> None:
        """Go down again for the changed rows; equal ones go once."""
        code = full[row, feature, repeat].astype(np.int64)
        _, first, n = np.unique((row * width + feature) * 128 + code, return_index=True, return_counts=True)
        row, feature, repeat, code = row[first], feature[first], repeat[first], code[first]
        for cases in _parts(len(row), max(1, CASES * 8 // classes)):
            own, at = np.unique(row[cases], return_inverse=True)
            f, r, c = feature[cases], repeat[cases], code[cases]
            after = votes[row[cases]]
            for tree in trees():
                for low in range(0, len(own), ROWS):
                    # Cases are in order of their row.
                    some = slice(*np.searchsorted(at, [low, low + ROWS]))
                    here = x[own[low : low + ROWS]]
                    marks = seen[: len(here)]
                    marks[:] = 0
                    leaf = tree.follow(here, donors[own[low : low + ROWS]], marks)
                    place = at[some] - low
                    left = np.flatnonzero(marks.view(np.uint8)[place, f[some], r[some]])
                    if not len(left):
                        continue
                    to = tree.follow_changed(here, place[left], f[some][left], c[some][left])
                    tree.vote(after, some.start + left, to)
                    tree.vote(after, some.start + left, leaf[place[left]], -1)
            of = label[row[cases]]
            lost = (guess[row[cases]] == of).astype(np.int64) - (after.argmax(axis=1) == of)
            np.add.at(total, f, lost * n[cases])

    held: list[np.ndarray] = []
    count = 0
    for part in _parts(rows, max(1, min(ROWS, 4 * CASES // (width * words * 8)))):
        times = met[part].view(np.uint8)
        if wide is not None:
            times = wide[part] + times
        open_ = np.argwhere((times > 0) & (times.astype(np.float64) * 2 >= lead[part, None, None]))
        open_[:, 0] += part.start
        held.append(open_)
        count += len(open_)
        if count >= CASES or part.stop == rows:
            resolve(*np.concatenate(held).T)
            held, count = [], 0
