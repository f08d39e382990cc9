"""PII pseudonyms that keep their format: a keyed Feistel permutation within the set of valid values.

Card, phone and social security numbers, IPv4 addresses, e-mail names and calendar dates are found and validated in whole texts. A value's index among the valid values of its kind is
permuted by a Feistel network under a secret key, walking on until the result is valid again, and written back in the same places, signs and style. Equal values
have equal pseudonyms in any document and any style, and who has the key can undo them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

ROUNDS = 8

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

#: Years of dates that count as personal.
FIRST_YEAR, YEARS = 1900, 200

#: Remembered values per worker.
MEMO = 100_000


def feistel(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of the values of ``range(size)`` that ``valid`` accepts; ``value`` is one of them."""
    from hashlib import blake2b

    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    width = -(-half // 8)

    def once(x: int) -> int:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right, left
            out, count = b"", 0
            while len(out) < width:
                out += blake2b(right.to_bytes(width, "big") + bytes([r, count]), key=key, person=tweak[:16]).digest()
                count += 1
            left ^= int.from_bytes(out[:width], "big") & mask
            if not inverse:
                left, right = right, left
        return left << half | right

    x = once(value)
    while x >= size or valid and not valid(x):
        x = once(x)
    return x


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def permuted_digits(digits: str, key: bytes, tweak: bytes, inverse: bool, valid: Callable[[str], bool] | None = None) -> str:
    n = len(digits)
    return str(feistel(int(digits), 10**n, key, tweak, inverse, valid and (lambda x: valid(str(x).zfill(n))))).zfill(n)


def card(digits: str, key: bytes, inverse: bool) -> str | None:
    """Thirteen to nineteen digits with a valid check digit: all but the first are permuted, and the check digit follows."""
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or len(set(digits)) < 2 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[0] + permuted_digits(digits[1:-1], key, b"card%d" % len(digits), inverse)
    return body + str(luhn(body))


def phone(digits: str, key: bytes, inverse: bool) -> str | None:
    """Ten digits, area and exchange from 2 to 9 on; a leading 1 stays."""
    lead, digits = (digits[0], digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)
    if len(digits) != 10 or digits[0] in "01" or digits[3] in "01":
        return None
    return lead + permuted_digits(digits, key, b"phone", inverse, lambda d: d[0] not in "01" and d[3] not in "01")


def odd_phone(digits: str, key: bytes, inverse: bool) -> str | None:
    """Ten digits in the style of a phone number; those that :func:`phone` has no place for are permuted among themselves."""
    lead, rest = (digits[0], digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)
    if len(rest) != 10 or phone(digits, key, inverse) is not None:
        return phone(digits, key, inverse)
    return lead + permuted_digits(rest, key, b"odd phone", inverse, lambda d: d[0] in "01" or d[3] in "01")


def foreign_phone(digits: str, key: bytes, inverse: bool) -> str | None:
    """Eight to fifteen digits behind a plus sign: the last seven are permuted."""
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    return digits[:-7] + permuted_digits(digits[-7:], key, b"foreign" + digits[:-7].encode(), inverse)


def social(digits: str, key: bytes, inverse: bool) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    return permuted_digits(digits, key, b"social", inverse, ok) if len(digits) == 9 and ok(digits) else None


def address(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if len(parts) != 4 or any(len(p) > 3 or int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    if not 1 <= int(parts[0]) <= 223:  # 0 and 224 to 255 are a domain of their own
        first = int(parts[0]) and int(parts[0]) - 223
        x = feistel(int.from_bytes(bytes([first, *map(int, parts[1:])]), "big"), 33 << 24, key, b"ipv4 odd", inverse)
        first, *rest = x.to_bytes(4, "big")
        return ".".join(map(str, [first and first + 223, *rest]))
    x = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 224 << 24, key, b"ipv4", inverse, lambda v: v >> 24 > 0)
    return ".".join(map(str, x.to_bytes(4, "big")))


def mail_name(name: str, key: bytes, inverse: bool) -> str | None:
    """The part before the @: letters become letters of the same case and digits become digits."""
    lowered = name.lower()
    radix = [26 if "a" <= c <= "z" else 10 if c.isascii() and c.isdigit() else 1 for c in lowered]
    value, size = 0, 1
    for c, r in zip(lowered, radix):
        value = value * r + (ord(c) - (97 if r == 26 else 48) if r > 1 else 0)
        size *= r
    if size < 2:
        return None
    value = feistel(value, size, key, b"mail", inverse)
    out = []
    for c, r in zip(reversed(name), reversed(radix)):
        value, d = divmod(value, r)
        new = chr(97 + d) if r == 26 else chr(48 + d) if r == 10 else c
        out.append(new.upper() if c.isupper() and r == 26 else new)
    return "".join(reversed(out))


def late_days() -> list[tuple[int, int]]:
    """Month and day of the days after a month's twelfth, leap days last."""
    lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return [(m + 1, d) for m in range(12) for d in range(13, lengths[m] + 1)] + [(2, 29)]


def moved_date(y: int, m: int, d: int, key: bytes, inverse: bool) -> tuple[int, int, int] | None:
    """Another date; days up to the 12th, which two orders of day and month can read, stay such days."""
    try:
        date(y, m, d)
    except ValueError:
        return None
    if not FIRST_YEAR <= y < FIRST_YEAR + YEARS:
        return None
    if d <= 12:
        x = feistel(((y - FIRST_YEAR) * 12 + m - 1) * 12 + d - 1, YEARS * 144, key, b"early", inverse)
        return FIRST_YEAR + x // 144, x // 12 % 12 + 1, x % 12 + 1
    late = late_days()
    leap = lambda v: (v % 4 == 0 and v % 100 != 0) or v % 400 == 0
    n = len(late)
    x = feistel((y - FIRST_YEAR) * n + late.index((m, d)), YEARS * n, key, b"late", inverse, lambda v: v % n < n - 1 or leap(FIRST_YEAR + v // n))
    return FIRST_YEAR + x // n, *late[x % n]


class Pseudonymiser:
    """Replaces the values in texts; counts numbers, dates and e-mail names."""

    def __init__(self, key: bytes, inverse: bool = False):
        import re

        self.key, self.inverse = key[:64], inverse
        month = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS)
        self.candidate = re.compile(
            rf"(?<![\w.+-])(?:(?P<iso>[0-9]{{4}}([-/.])[0-9]{{1,2}}\2[0-9]{{1,2}})|(?P<dmy>[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\4[0-9]{{4}})|(?P<named>[0-9]{{1,2}} (?:{month}) [0-9]{{4}})"
            r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})|(?P<social>[0-9]{3}-[0-9]{2}-[0-9]{4})|(?P<phone>(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4})"
            r"|(?P<foreign>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6})|(?P<card>[0-9](?:[ -]?[0-9]){12,18}))(?(iso)(?!(?![Tt][0-9]{2})\w|[.-][0-9])|(?!\w|[.-][0-9]))",
        )
        self.month_first = re.compile(rf"\b(?P<m>{month}) (?P<d>[0-9]{{1,2}}), (?P<y>[0-9]{{4}})(?!\w)")
        self.mail = re.compile(r"(?<![\w.%+-])(?P<name>[A-Za-z0-9][\w.%+-]*)@(?P<host>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])", re.ASCII)
        self.more_path = re.compile("/[0-9]")
        self.any_digit = re.compile("[0-9]")
        self.numbers = self.dates = self.mails = 0
        self.memo: dict[tuple, str | None] = {}

    def known(self, make: Callable, *value):
        at = (make, *value)
        if at not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[at] = make(*value, self.key, self.inverse)
        return self.memo[at]

    def in_place(self, text: str, make: Callable) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        new = self.known(make, digits)
        if new is None:
            return None
        self.numbers += 1
        rest = iter(new)
        return "".join(next(rest) if c.isdigit() else c for c in text)

    def day(self, y: str, m: int, d: str, write: Callable) -> str | None:
        new = self.known(moved_date, int(y), m, int(d))
        if new is None:
            return None
        self.dates += 1
        return write(new[0], new[1], f"{new[2]:02d}" if len(d) == 2 else str(new[2]))

    def dated(self, text: str, sign: str, order: str) -> str | None:
        import re

        parts = dict(zip(order, re.split(r"[-/.]", text)))
        pad = len(parts["m"]) == 2
        return self.day(parts["y"], int(parts["m"]), parts["d"], lambda y, m, d: sign.join({"y": str(y), "m": f"{m:02d}" if pad else str(m), "d": d}[k] for k in order))

    def replaced(self, match) -> str:
        text, kind = match[0], match.lastgroup
        new = None
        if (match[2] or match[4]) == "/" and (match.string.endswith("/", 0, match.start()) or self.more_path.match(match.string, match.end())):
            return text  # part of a longer path
        if kind == "iso":
            new = self.dated(text, match[2], "ymd")
        elif kind == "dmy":
            for order in ("mdy", "dmy") if match[4] == "/" else ("dmy", "mdy"):
                if new := self.dated(text, match[4], order):
                    break
        elif kind == "named":
            d, m, y = text.split(" ")
            new = self.day(y, self.month(m), d, lambda y, k, d: f"{d} {self.named(k, m)} {y}")
        elif kind == "ip":
            if (new := self.known(address, text)) is not None:
                self.numbers += 1
        elif kind == "social":
            new = self.in_place(text, social)
        elif kind == "phone":
            new = self.in_place(text, odd_phone if text[0] in "+(" or "(" in text else phone)
        elif kind == "foreign":
            new = self.in_place(text, foreign_phone)
        elif kind == "card":
            new = self.in_place(text, card)
        return text if new is None else new

    @staticmethod
    def month(name: str) -> int:
        return next(k for k, m in enumerate(MONTHS, 1) if m[:3] == name[:3])

    @staticmethod
    def named(k: int, like: str) -> str:
        return MONTHS[k - 1][:3] if len(like) == 3 and like != "May" else MONTHS[k - 1]

    def mailed(self, match) -> str:
        new = self.known(mail_name, match["name"])
        if new is None:
            return match[0]
        self.mails += 1
        return f"{new}@{match['host']}"

    def __call__(self, text: str) -> tuple[str, int, int, int]:
        """The text with pseudonyms, and how many numbers, dates and e-mail names it had."""
        self.numbers = self.dates = self.mails = 0
        if not self.any_digit.search(text) and "@" not in text:
            return text, 0, 0, 0
        out, at = [], 0
        for match in self.mail.finditer(text) if "@" in text else ():
            out += [self.scan(text[at : match.start()]), self.mailed(match)]
            at = match.end()
        out.append(self.scan(text[at:]))
        return "".join(out), self.numbers, self.dates, self.mails

    def scan(self, text: str) -> str:
        """Numbers and dates of a text between e-mail names."""
        text = self.candidate.sub(self.replaced, text)
        return self.month_first.sub(lambda m: self.day(m["y"], self.month(m["m"]), m["d"], lambda y, k, d: f"{self.named(k, m['m'])} {d}, {y}") or m[0], text)


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with pseudonyms, n_numbers, n_dates, n_mails.

    Digits that are no valid value (a wrong check digit, a day that no calendar has) stay as they are. List commas, slashes (but not next to a
    date with slashes) and the time of an ISO date end a value; a hyphen, or a full stop before a digit, does not. A null text stays null and has
    no values; an empty one stays empty. Repeated rows are treated alike; an empty table gives no rows. ``inverse`` undoes the same key.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        replace = worker_cache("pii", (key, inverse), lambda: Pseudonymiser(key, inverse))
        for batch in batches:
            out = [(None, 0, 0, 0) if t is None else replace(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", "text", "n_numbers", "n_dates", "n_mails"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, text string, n_numbers long, n_dates long, n_mails long")


def digest(replaced: DataFrame) -> DataFrame:
    return replaced.select("doc_id", "n_numbers", "n_dates", "n_mails", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
