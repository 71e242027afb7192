"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and mail addresses are replaced by a keyed permutation of their own format: a Feistel network
over the format's domain, with cycle walking down to the domain's size. Equal values get equal pseudonyms in every
document, different values different ones, and whoever holds the key can invert them.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm.common import read

#: The key of the registered query; a real run passes its own secret.
DEMONSTRATION_KEY = b"shutterlake demonstration key"
ROUNDS = 8
#: Dates are permuted within their 200 years; these spans begin at FIRST_YEAR and by so many years from it.
FIRST_YEAR, SPAN = 1900, 200
#: Country codes of one and two digits; all others have three.
_SHORT_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


def _round(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    digest = hashlib.blake2b(b"%s|%d|%d" % (tweak, i, value), key=key, digest_size=32).digest()
    return int.from_bytes(digest, "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of the numbers below `size`: Feistel over a square at least as large, walked until below it."""
    if size < 2:
        return value
    key = hashlib.sha256(key).digest()
    side = 1
    while side * side < size:
        side <<= 1
    while True:
        a, b = divmod(value, side)
        if inverse:
            for i in reversed(range(ROUNDS)):
                a, b = (b - _round(key, tweak, i, a, side)) % side, a
        else:
            for i in range(ROUNDS):
                a, b = b, (a + _round(key, tweak, i, b, side)) % side
        value = a * side + b
        if value < size:
            return value


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _refill(pattern: str, digits: str) -> str:
    """The digits in the places of the pattern's digits, separators kept."""
    new = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(new), pattern)


def luhn_digit(payload: str) -> str:
    """The check digit that completes a card number."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


class Kind:
    """One format: what it looks like, whether a match is valid, and how a valid value is permuted."""

    def __init__(self, name: str, pattern: str, change: Callable[[str, bytes, bool], str | None]) -> None:
        self.name, self.pattern, self.change = name, pattern, change


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1 or d[0] == "0":
        return None
    n = len(d) - 1
    payload = int(d[:-1])
    while True:  # a number of one repeated digit or with a leading zero is no valid value, so the walk goes past it
        payload = permute(payload, 10**n, key, b"card%d" % n, inverse)
        new = f"{payload:0{n}d}"
        new += luhn_digit(new)
        if len(set(new)) > 1 and new[0] != "0":
            return _refill(text, new)


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    """A number of ten digits after the country code, if it has one, gets the same ten in every form."""
    if text[0] == "+":
        return _phone_abroad(text, key, inverse)
    country, local = _digits(text)[:-10], _digits(text)[-10:]
    return _refill(text, country + f"{permute(int(local), 10**10, key, b'phone10', inverse):010d}")


def _phone_abroad(text: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    code = m.end() if (m := _SHORT_CODES.match(d)) else 3
    trunk = re.search(r"\(0\)", text)  # stays
    at = code if trunk is None else len(_digits(text[: trunk.end()]))
    n = len(d) - at
    return _refill(text, d[:at] + f"{permute(int(d[at:]), 10**n, key, b'phone%d' % n, inverse):0{n}d}") if n > 3 else None


def _phone_zeros(text: str, key: bytes, inverse: bool) -> str | None:
    """With 00 for +; the same number gets the same pseudonym in both forms."""
    new = _phone_abroad("+" + text[2:], key, inverse)
    return None if new is None else "00" + new[1:]


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(text)
    if not _ssn_valid(d):
        return None
    while True:
        d = f"{permute(int(d), 10**9, key, b'ssn', inverse):09d}"
        if _ssn_valid(d):
            return _refill(text, d)


def _ipv4(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = 0
    for p in parts:
        value = value * 256 + int(p)
    value = permute(value, 1 << 32, key, b"ipv4", inverse)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str, key: bytes, inverse: bool) -> str | None:
    """Told in the short form, so that an address is linked however it is written."""
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if not _IPV6(text):
        return None
    while True:  # past what would not be taken for an address
        value = permute(value, 1 << 128, key, b"ipv6", inverse)
        if _IPV6(new := str(ipaddress.IPv6Address(value))):
            return new


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    d = text.replace(" ", "")
    if _iban_number(d) % 97 != 1:
        return None
    body = _classes(d[4:], key, b"iban" + d[:2].encode(), inverse)
    check = 98 - _iban_number(d[:2] + "00" + body) % 97
    new = iter(d[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _classes(text: str, key: bytes, tweak: bytes, inverse: bool) -> str:
    """Permutes a text within its pattern of digits, small and capital letters; other characters stay."""
    size, value, bases = 1, 0, []
    for c in text:
        first, base = ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (c, 1)
        bases.append((first, base))
        value, size = value * base + ord(c) - ord(first), size * base
    shape = "".join(first for first, _ in bases).encode()
    value = permute(value, size, key, tweak + b"|" + shape, inverse)
    out = []
    for first, base in reversed(bases):
        value, digit = divmod(value, base)
        out.append(chr(ord(first) + digit))
    return "".join(reversed(out))


def _mail(text: str, key: bytes, inverse: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_classes(local, key, b'mail' + domain.lower().encode(), inverse)}@{domain}"


#: Classes of months and of days within which every form can write every date: of one digit or two, and days that can
#: be no month apart from those that can.
MONTHS, DAYS = (range(1, 10), range(10, 13)), (range(1, 10), range(10, 13), range(13, 32))


@lru_cache(maxsize=1 << 14)
def permuted_day(day: datetime.date, key: bytes, inverse: bool) -> datetime.date:
    """The day that stands for a day, whatever form it is written in: of the same span of years and the same classes."""
    since = FIRST_YEAR + (day.year - FIRST_YEAR) // SPAN * SPAN
    years = range(max(datetime.MINYEAR, since), min(datetime.MAXYEAR, since + SPAN - 1) + 1)
    months, days = next(m for m in MONTHS if day.month in m), next(d for d in DAYS if day.day in d)
    tweak = b"date%d|%d|%d" % (since, months[0], days[0])
    at = ((day.year - years[0]) * len(months) + day.month - months[0]) * len(days) + day.day - days[0]
    while True:  # past what is no day of its month
        at = permute(at, len(years) * len(months) * len(days), key, tweak, inverse)
        rest, d = divmod(at, len(days))
        year, m = divmod(rest, len(months))
        try:
            return datetime.date(years[year], months[m], days[d])
        except ValueError:
            continue


def _date(order: str) -> Callable[[str, bytes, bool], str | None]:
    def change(text: str, key: bytes, inverse: bool) -> str | None:
        part = dict(zip(order, re.findall(r"[0-9]+", text), strict=True))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
        except ValueError:
            return None
        if order == "mdy" and day.day <= 12:
            return None  # read as dmy
        new = permuted_day(day, key, inverse)
        value = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(part['m'])}d}", "d": f"{new.day:0{len(part['d'])}d}"}
        numbers = iter(value[c] for c in order)
        return re.sub(r"[0-9]+", lambda _: next(numbers), text)

    return change


#: Words with colons that look like an address have fewer groups or no digit.
_IPV6 = lambda text: sum(map(bool, text.split(":"))) >= 3 and any(c.isdigit() for c in text)
_BEFORE, _AFTER = r"(?<![0-9A-Za-z])(?<![0-9][.,-])", r"(?![0-9A-Za-z])(?![.,-][0-9])"
#: A time may follow a date.
_AFTER_DATE = r"(?:(?=[Tt][0-9]{2}:?[0-9]{2})|" + _AFTER + ")"
_DAY_YEAR = _BEFORE + r"[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}" + _AFTER_DATE
#: In order of precedence where matches begin at the same place.
KINDS = [
    Kind("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _mail),
    Kind("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _AFTER, _phone),
    Kind("phone_plain", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _AFTER, _phone),
    *(Kind(f"phone_abroad{n}", r"(?<![0-9A-Za-z+])\+[0-9]{1,7}(?:[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{1,14}|[ .-][0-9]{1,14}){1,%d}" % n + _AFTER, _phone_abroad) for n in range(6, 0, -1)),  # fewer groups if 15 digits are passed
    Kind("phone_abroad", r"(?<![0-9A-Za-z+])\+[0-9]{8,15}" + _AFTER, _phone_abroad),
    Kind("phone_groups", _BEFORE + r"(?:1[-.])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}" + _AFTER, _phone),
    Kind("phone_spaced", _BEFORE + r"(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}" + _AFTER + r"(?! [0-9])", _phone),
    Kind("date_ymd", _BEFORE + r"[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/)[0-9]{1,2}" + _AFTER_DATE, _date("ymd")),
    Kind("date_dmy", _DAY_YEAR, _date("dmy")),
    Kind("date_mdy", _DAY_YEAR, _date("mdy")),
    Kind("card_grouped", _BEFORE + r"(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})" + _AFTER, _card),
    Kind("card", _BEFORE + r"[0-9]{13,19}" + _AFTER, _card),
    Kind("ssn", _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER, _ssn),
    Kind("ipv4", r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])", _ipv4),
    Kind("phone_zeros", _BEFORE + r"00[1-9](?:[0-9]{7,14}|[0-9]{0,5}(?:[ .-][0-9]{1,14}){1,6})" + _AFTER, _phone_zeros),
    Kind("ipv6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])", _ipv6),
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", _iban),
]
#: What a text must hold for kinds whose names begin so to be in it.
_NEEDED = {"mail": "@", "phone_plain": "+", "phone_abroad": "+", "phone_zeros": "00"}
_NEEDED_BY = {k.name: next((c for n, c in _NEEDED.items() if k.name.startswith(n)), "") for k in KINDS} | {"ipv6": ":"}
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:").search


@cache
def _any(held: tuple[bool, ...]) -> re.Pattern:
    """All kinds that a text can have, given which of the needed strings it holds."""
    have = {c for c, h in zip([*_NEEDED.values(), ":"], held, strict=True) if h} | {""}
    return re.compile("|".join(f"(?P<{k.name}>{k.pattern})" for k in KINDS if _NEEDED_BY[k.name] in have))


_BY_NAME = {k.name: k for k in KINDS}
_DIGIT = re.compile("[0-9]").search
_HINT = re.compile(r"[0-9]{4}|[0-9][.][0-9]|\+[0-9]|:[0-9A-Fa-f]{0,4}:").search


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, end) of each in the old text."""
    if "@" not in text and (_DIGIT(text) is None or _HINT(text) is None):
        return text, []
    search = _any((*(c in text for c in _NEEDED.values()), _COLONS(text) is not None)).search
    out, found, at, done = [], [], 0, 0
    while m := search(text, at):
        kind = _BY_NAME[m.lastgroup]
        new = kind.change(m[0], key, inverse)
        if new is None:
            # Not valid as what it looks like; another kind may hold at this place, or further within it.
            other = None
            for k in KINDS[KINDS.index(kind) + 1 :]:
                if (o := re.compile(k.pattern).match(text, m.start())) and (new := k.change(o[0], key, inverse)) is not None:
                    other = o, k
                    break
            if other is None:
                at = m.start() + 1
                continue
            m, kind = other
        out += [text[done : m.start()], new]
        found.append((kind.name, m.start(), m.end()))
        at = done = m.end()
    return "".join(out) + text[done:], found


def _stage(key: bytes, names: list[str]):
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column("text").to_pylist():
                new, found = (None, []) if t is None else pseudonymise(t, key)
                texts.append(new)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*names, "text", "n_replaced"])

    return change


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """docs(text, ...) with the pseudonyms in its texts, and n_replaced; one row for each of its rows.

    Null and empty texts stay as they are; so do numbers and dates that fail validation. Texts are read whole, whatever
    their length. Where two values overlap the one that begins first is replaced, of those that begin together the one
    whose kind comes first in KINDS. Repeated rows get the same text; an empty table gives no rows. All other columns
    pass unchanged, but for one named n_replaced, which is replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "n_replaced")]
    rows = docs.select(*names, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_replaced long"])
    return rows.mapInArrow(_stage(key, names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document with pseudonyms for its personal numbers, dates and addresses."""
    return pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)
