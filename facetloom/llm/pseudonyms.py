"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and addresses are replaced by a keyed permutation of the values of
the same format: a Feistel network, repeated until the result is in the format's domain. Equal
values get equal pseudonyms in every document, and the key gives the values back.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.groups import small_batches, whole_row

ROUNDS = 10
#: For tests and examples; give a secret key of your own.
KEY = b"facetloom pseudonyms"

_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())
_AREAS = [a for a in range(1, 900) if a != 666]
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

_PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}"
    r"(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    r"|(?<![\w.+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
    r"|(?<![\w./])[0-9]{1,2}(?P<mark>[./])[0-9]{1,2}(?P=mark)[0-9]{4}(?![0-9]|[./][0-9]))"
)

#: The forms in which cards are printed; they go before groups of other lengths.
_PRINTED = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])"
)
#: More characters than a printed card and what has to follow it.
_CARD_REACH = 24
_GROUP = re.compile(r"[0-9A-Za-z]+")


class Permutation:
    """A keyed permutation of ``range(size)`` for any size, and its inverse."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size = size
        self.low = max(1, math.isqrt(max(size - 1, 0)) + 1)
        self.high = max(1, -(-size // self.low))
        self.key = hashlib.blake2b(key, digest_size=32, person=name.encode()[:16]).digest()

    def _round(self, i: int, value: int) -> int:
        said = b"%d:%d:%d" % (self.size, i, value)
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=64).digest(), "big")

    def __call__(self, value: int) -> int:
        while True:
            high, low = divmod(value, self.low)
            for i in range(ROUNDS):
                high = (high + self._round(2 * i, low)) % self.high
                low = (low + self._round(2 * i + 1, high)) % self.low
            value = high * self.low + low
            if value < self.size:
                return value

    def inverse(self, value: int) -> int:
        while True:
            high, low = divmod(value, self.low)
            for i in reversed(range(ROUNDS)):
                low = (low - self._round(2 * i + 1, high)) % self.low
                high = (high - self._round(2 * i, low)) % self.high
            value = high * self.low + low
            if value < self.size:
                return value


def luhn_digit(payload: str) -> int:
    """The check digit that follows ``payload``."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_digits(country: str, body: str) -> str:
    """The two check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


@functools.cache
def _letters_like(c: str) -> str | None:
    """The letters of the same kind on the same page of Unicode as a letter beyond ASCII."""
    if c.isascii() or not c.isalnum():
        return None
    page, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(x for x in map(chr, range(page, page + 256)) if not x.isascii() and x.isalnum() and unicodedata.category(x) == kind)


@functools.cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """The days after the twelfth of a month, counted from the first day, and their places."""
    days = [d for d in range(_DAYS[1] - _DAYS[0] + 1) if datetime.date.fromordinal(d + _DAYS[0]).day > 12]
    return days, {d: i for i, d in enumerate(days)}


def _refill(shape: str, chars: str) -> str:
    """``chars`` in the places of the digits of ``shape``."""
    rest = iter(chars)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


class Pseudonymizer:
    """Replaces every validated value of a text. ``back`` undoes it."""

    def __init__(self, key: bytes = KEY, back: bool = False):
        self.key, self.back = key, back
        self._known: dict[tuple[str, int], Callable[[int], int]] = {}

    def _move(self, name: str, value: int, size: int) -> int:
        made = self._known.get((name, size))
        if made is None:
            if len(self._known) > 10_000:
                self._known.clear()
            permutation = Permutation(self.key, name, size)
            made = self._known[name, size] = permutation.inverse if self.back else permutation
        return made(value)

    def _by_class(self, name: str, text: str) -> str:
        """Digits, small and capital letters stay such; other characters stay."""
        kinds = [next((k for k in _CLASSES if c in k), None) or _letters_like(c) for c in text]
        value, size = 0, 1
        for c, kind in zip(text, kinds, strict=True):
            if kind:
                value, size = value * len(kind) + kind.index(c), size * len(kind)
        value = self._move(name, value, size)
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                value, rest = divmod(value, len(kind))
                c = kind[rest]
            out.append(c)
        return "".join(reversed(out))

    def email(self, text: str) -> str:
        name, dot, top = text.rpartition(".")
        return self._by_class("email", name) + dot + top

    def secret(self, text: str) -> str:
        value = self._move("secret", int(text, 16), 16 ** len(text))
        made = f"{value:0{len(text)}x}"
        return made if text == text.lower() else made.upper()

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, body = plain[:2], plain[4:]
        if not 11 <= len(body) <= 30 or iban_digits(country, body) != plain[2:4]:
            return None
        body = self._by_class("iban" + country, body)
        rest = iter(country + iban_digits(country, body) + body)
        return "".join(c if c == " " else next(rest) for c in text)

    def phone(self, text: str) -> str | None:
        """The country code (before the first gap, or one digit of eleven) stays."""
        digits = re.sub(r"\D", "", text)
        if not 9 <= len(digits) <= 15 or (re.match(r"\+1[ .(-]", text) and len(digits) > 11):
            return None
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        own = len(code[1]) if code else (1 if text[0] == "+" else 0)
        body = digits[own:]
        moved = self._move("phone", int(body), 10 ** len(body))
        return _refill(text, digits[:own] + f"{moved:0{len(body)}d}")

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        moved = f"{self._move('card', int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
        return _refill(text, moved + str(luhn_digit(moved)))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        at = area - 1 - (area > 666)
        value = (at * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._move("ssn", value, len(_AREAS) * 99 * 9999), 9999)
        at, group = divmod(value, 99)
        return f"{_AREAS[at]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self._move("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        """A day of 1900 to 2099; ``.`` has the day first, ``/`` the month, or the day where that is no date.

        A day-first date with ``/`` gets a day after the twelfth too, so that it is still read that way.
        """
        a, b, c = map(int, re.split(r"[-./]", text))
        day_first = "/" in text and a > 12
        year, month, day = (a, b, c) if "-" in text else (c, a, b) if "/" in text and not day_first else (c, b, a)
        try:
            at = datetime.date(year, month, day).toordinal() - _DAYS[0]
        except ValueError:
            return None
        size = _DAYS[1] - _DAYS[0] + 1
        if not 0 <= at < size:
            return None
        if day_first:
            days, places = _late_days()
            moved = days[self._move("date/", places[at], len(days))]
        else:
            moved = self._move("date", at, size)
        new = datetime.date.fromordinal(moved + _DAYS[0])
        if "-" in text:
            return new.isoformat()
        mark = "/" if "/" in text else "."
        short = min(len(p) for p in text.split(mark)[:2]) < 2
        first, second = (new.month, new.day) if mark == "/" and not day_first else (new.day, new.month)
        width = 1 if short else 2
        return f"{first:0{width}d}{mark}{second:0{width}d}{mark}{new.year}"

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds that were replaced, in order."""
        kinds: list[str] = []

        out, at = [], 0
        while match := _PATTERN.search(text, at):
            reach = match.end() + _CARD_REACH
            card = _PRINTED.search(text, match.start(), reach) if match.lastgroup == "card" else None
            if card and card.start() < match.end() and (made := self.card(card[0])):
                head, before = self.replace(text[match.start() : card.start()])
                out += [text[at : match.start()], head, made]
                kinds += [*before, "card"]
                at = card.end()
                continue
            start, end, kind, made = match.start(), *self._first_valid(match)
            if made is None:
                # No value begins here; one may begin at a later group of the match.
                later = _GROUP.search(text, start + 1, match.end())
                while later and text[later.start() - 1].isalnum():
                    later = _GROUP.search(text, later.end(), match.end())
                found = self._inside(text, later.start(), match.end()) if later else None
                if found is None:
                    out.append(text[at : match.end()])
                    at = match.end()
                    continue
                start, end, kind, made = found
            out += [text[at:start], made]
            kinds.append(kind)
            at = end
        return "".join(out) + text[at:], kinds

    def _made(self, match: re.Match | None) -> tuple[str, str | None]:
        if match is None:
            return "", None
        kind = match.lastgroup if match.lastgroup != "mark" else "date"
        return kind, getattr(self, kind)(match[0])

    def _first_valid(self, match: re.Match) -> tuple[int, str, str | None]:
        """End, kind and pseudonym of the longest valid value that begins with the match, ending at a group."""
        kind, made = self._made(match)
        if made is not None:
            return match.end(), kind, made
        return self._shorter(match.string, match.start(), match.end() - 1)

    def _shorter(self, text: str, start: int, last: int) -> tuple[int, str, str | None]:
        ends = [m.end() for m in _GROUP.finditer(text, start, last + 1) if m.end() <= last]
        for end in reversed(ends):
            if end < len(text) and text[end].isalnum():
                continue
            kind, made = self._made(_PATTERN.fullmatch(text[start:end]))
            if made is not None:
                return end, kind, made
        return last, "", None

    def _inside(self, text: str, start: int, end: int) -> tuple[int, int, str, str] | None:
        """The first valid value that begins at a group between the two places."""
        for group in _GROUP.finditer(text, start, end):
            match = _PATTERN.match(text, group.start())
            to, kind, made = self._first_valid(match) if match else (end, "", None)
            if made is None:
                to, kind, made = self._shorter(text, group.start(), end)
            if made is not None:
                return group.start(), to, kind, made
        return None


def pseudonymize(docs: DataFrame, column: str = "text", key: bytes = KEY) -> DataFrame:
    """Replace the personal data in ``column`` and add ``pii_kinds`` (array of strings).

    Cards and account numbers need a right check digit, addresses and dates real parts;
    what is not valid stays as it is. A null text stays null, with no kinds. Texts without a
    digit or ``@`` are not sent to Python.
    """
    @F.pandas_udf("text string, kinds array<string>")
    def change(texts: pd.Series) -> pd.DataFrame:
        maker = Pseudonymizer(key)
        rows = [(None, None) if t is None else maker.replace(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "kinds"])

    at = F.col(column)
    some = F.when(at.rlike("[0-9@]"), at)
    return (
        small_batches(docs).withColumn("_changed", change(some))
        .withColumn(column, F.coalesce("_changed.text", at))
        .withColumn("pii_kinds", F.coalesce("_changed.kinds", F.array().cast("array<string>")))
        .drop("_changed")
    )


def pseudonymize_documents(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Returns doc_id, text with pseudonyms, n_values and pii_kinds; one row per input row."""
    changed = pseudonymize(docs.select("doc_id", "text"), "text", key)
    return changed.select("doc_id", "text", F.size("pii_kinds").alias("n_values"), "pii_kinds")


def without_personal_data(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """All columns of ``docs``, with pseudonyms in ``text`` and ``n_chars`` to match."""
    rows = docs.select(whole_row(docs).alias("_row"), "text")
    changed = pseudonymize(rows, "text", key)
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col("text"))
        elif name == "n_chars":
            out.append(F.when(F.size("pii_kinds") > 0, F.char_length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col(f"_row.`{name}`").alias(name))
    return changed.select(*out)
