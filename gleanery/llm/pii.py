"""Format-preserving pseudonyms for personal data in text."""

from __future__ import annotations

import ipaddress
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import strings
from gleanery.llm.feistel import invert, permute

#: The session setting that names the key, as hexadecimal digits.
KEY_SETTING = "spark.gleanery.pseudonym.key"
_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
Step = Callable[[int, int, bytes, str], int]
_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in ``KEY_SETTING``; else one drawn for this application, with
    which pseudonyms are linked within it but not beyond."""
    named = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(named) if named else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


# ---------------------------------------------------------------- checks
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


#: Lengths of account numbers by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of telephone numbers: of one, of two and of three digits.
_CALLING = re.compile(
    r"1|7|2[07]|3[0-4689]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|(?:2[2-689]|3[57]|42|5[09]|6[789]|8[058]|9[679])[0-9]"
)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


# ---------------------------------------------------------------- formats
def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _within(value: int, domain: int, key: bytes, tweak: str, step: Step, kind: Callable[[int], object]) -> int:
    """The keyed permutation among the numbers of the domain that are of the value's ``kind``."""
    mine = kind(value)
    while True:
        value = step(value, domain, key, tweak)
        if kind(value) == mine:
            return value


def _number(text: str, key: bytes, tweak: str, step: Step) -> str:
    d = _digits(text)
    return _refill(text, str(step(int(d), 10 ** len(d), key, f"{tweak}{len(d)}")).zfill(len(d)))


def _card(text: str, key: bytes, step: Step) -> str:
    """All digits but the last are permuted, and the last is their check digit."""
    d = _digits(text)
    body = str(step(int(d[:-1]), 10 ** (len(d) - 1), key, f"card{len(d)}")).zfill(len(d) - 1)
    return _refill(text, body + _luhn_digit(body))


def _calling_code(text: str) -> int:
    """How many characters a number that begins with + spends on its country code; 0 for others."""
    found = _CALLING.match(text, 1) if text[0] == "+" else None
    return found.end() if found else 0


def _dialled(value: int) -> bool:
    """Whether a number of ten digits has an area and an exchange that are in use."""
    return value >= 2 * 10**9 and value // 10**6 % 10 >= 2


def _phone(text: str, key: bytes, step: Step) -> str:
    """The country code stays, the other digits are permuted; of ten digits among those that could be
    dialled in North America or among the rest, of seven among those that begin with 2 and above."""
    keep = _calling_code(text)
    d = _digits(text[keep:])
    kind = {10: _dialled, 7: lambda v: v >= 2 * 10**6}.get(len(d), lambda v: True)
    moved = _within(int(d), 10 ** len(d), key, f"phone{len(d)}", step, kind)
    return text[:keep] + _refill(text[keep:], str(moved).zfill(len(d)))


def _ssn(text: str, key: bytes, step: Step) -> str:
    """Permuted among the numbers that are in use: area 001-665 or 667-899, group 01-99, serial 0001-9999."""
    area, group, serial = (int(x) for x in re.split(r"[- ]", text))
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at = step(at, 898 * 99 * 9999, key, "ssn")
    rest, serial = divmod(at, 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area >= 665)
    return _refill(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _ip(text: str, key: bytes, step: Step) -> str:
    a, b, c, d = (int(x) for x in text.split("."))
    at = step(((a * 256 + b) * 256 + c) * 256 + d, 1 << 32, key, "ip")
    return ".".join(str(at >> s & 255) for s in (24, 16, 8, 0))


def _ip6_kind(value: int) -> tuple[bool, bool]:
    """Whether the first group has four digits, and whether all have, so that it has no short form."""
    return value >> 124 > 0, all(value >> k & 0xF000 for k in range(0, 128, 16))


def _ip6(text: str, key: bytes, step: Step) -> str:
    """Permuted among the addresses of its kind; written in full or in short as it was, in lower case."""
    fresh = ipaddress.IPv6Address(_within(int(ipaddress.IPv6Address(text)), 1 << 128, key, "ip6", step, _ip6_kind))
    return fresh.exploded if len(text) == 39 else str(fresh)


def _iban(text: str, key: bytes, step: Step) -> str:
    """Country stays, account digits are permuted, check digits are computed anew."""
    plain = text.replace(" ", "")
    body = plain[:2] + "00" + _number(plain[4:], key, "iban" + plain[:2], step)
    fresh = body[:2] + f"{98 - _iban_rest(body):02d}" + body[4:]
    chars = iter(fresh)
    return "".join(c if c == " " else next(chars) for c in text)


def _day(text: str, key: bytes, step: Step) -> str:
    """Days up to the twelfth are permuted among themselves, as they may be written in an order that
    could be another's, and so are the later ones: the order is read from a pseudonym as from its date."""
    order, at = _day_order(text)
    late = lambda n: (_EPOCH + timedelta(days=n)).day > 12
    moved = _EPOCH + timedelta(days=_within((at - _EPOCH).days, _DAYS, key, "date", step, late))
    return _refill(text, "".join({"y": f"{moved.year:04d}", "m": f"{moved.month:02d}", "d": f"{moved.day:02d}"}[o] for o in order))


def _day_order(text: str) -> tuple[str, date]:
    parts = re.split(r"[-/.]", text)
    orders = ("ymd",) if len(parts[0]) == 4 else (("mdy", "dmy") if "/" in text else ("dmy",))
    for order in orders:
        p = dict(zip(order, map(int, parts)))
        try:
            found = date(p["y"], p["m"], p["d"])
        except ValueError:
            continue
        if 0 <= (found - _EPOCH).days < _DAYS:
            return order, found
    raise ValueError(text)


_LOWER, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _letters(text: str, key: bytes, tweak: str, step: Step) -> str:
    """Runs of ASCII letters and of digits are permuted among runs of that kind, length and case pattern."""

    def run(m: re.Match) -> str:
        part = m.group()
        if part[0].isdigit():
            return _number(part, key, tweak, step)
        out = []
        for i in range(0, len(part), 16):  # 26 ** 16 is within the hash's reach
            piece = part[i : i + 16]
            value = 0
            for c in piece.lower():
                value = value * 26 + ord(c) - 97
            value = step(value, 26 ** len(piece), key, f"{tweak}{len(piece)}.{i}")
            fresh = ""
            for _ in piece:
                value, k = divmod(value, 26)
                fresh = _LOWER[k] + fresh
            out += [f.upper() if c.isupper() else f for c, f in zip(piece, fresh)]
        return "".join(out)

    return re.sub(r"[A-Za-z]+|[0-9]+", run, text)


def _email(text: str, key: bytes, step: Step) -> str:
    """The local part and the domain's names are permuted, each by itself; the last name stays."""
    local, _, domain = text.rpartition("@")
    names, _, last = domain.rpartition(".")
    return _letters(local, key, "mail", step) + "@" + _letters(names, key, "host", step) + "." + last


def _secret(text: str, key: bytes, step: Step) -> str:
    """Hexadecimal digits are permuted in pieces of up to 24. Where small and capital letters are
    mixed, letters are permuted among letters, each in its case, and figures among figures."""
    mixed = text != text.lower() and text != text.upper()
    out = []
    for i in range(0, len(text), 24):
        piece = text[i : i + 24].lower()
        if not mixed:
            out.append(f"{step(int(piece, 16), 16 ** len(piece), key, f'hex{len(piece)}.{i}'):0{len(piece)}x}")
            continue
        fresh = {}
        for base, first, where in ((6, 97, [k for k, c in enumerate(piece) if c > "9"]), (10, 48, [k for k, c in enumerate(piece) if c <= "9"])):
            value = 0
            for k in where:
                value = value * base + ord(piece[k]) - first
            value = step(value, base ** len(where), key, f"hex{base}.{len(where)}.{i}") if where else 0
            for k in reversed(where):
                value, digit = divmod(value, base)
                fresh[k] = chr(first + digit)
        out.append("".join(fresh[k] for k in range(len(piece))))
    fresh = "".join(out)
    if mixed:
        return "".join(f.upper() if c.isupper() else f for f, c in zip(fresh, text))
    return fresh.upper() if text != text.lower() else fresh


# ---------------------------------------------------------------- finding
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\ ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
_PATTERN = re.compile(
    rf"""
    (?P<email>[^\W_](?:[\w.%+-]{{0,63}})@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9]))
  | (?<![A-Za-z0-9])(?P<iban>{_IBAN})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9])(?P<secret>[0-9a-fA-F]{{32,}})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9:.])(?P<ip6>[0-9A-Fa-f]{{4}}:(?:[0-9A-Fa-f]{{0,4}}:){{1,6}}[0-9A-Fa-f]{{0,4}})(?![A-Za-z0-9:])
  | (?<![0-9.])(?P<ip>[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?!\.?[0-9])
  | (?<![A-Za-z0-9./-])(?P<date>[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}})(?![A-Za-z0-9]|[-/.][0-9])
  | (?<![A-Za-z0-9-])(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![A-Za-z0-9]|-[0-9])
  | (?<![A-Za-z0-9])(?P<phone>\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}
      |\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}
      |\([0-9]{{3}}\)\ ?[0-9]{{3}}[ .-][0-9]{{4}}
      |[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}
      |(?<!-)[0-9]{{3}}-[0-9]{{4}}(?!-[0-9]))(?![A-Za-z0-9])
  | (?<![A-Za-z0-9-])(?P<card>[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{3}}|[0-9]{{4}}[ -]?[0-9]{{6}}[ -]?[0-9]{{5}}|[0-9]{{13,19}})(?![A-Za-z0-9]|-[0-9])
    """,
    re.VERBOSE,
)
_SIGN = re.compile(r"[0-9@:]")
KINDS = ("email", "iban", "secret", "ip6", "ip", "date", "ssn", "phone", "card")


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "date":
        try:
            _day_order(text)
        except ValueError:
            return False
        return len(set(re.findall(r"[-/.]", text))) == 1
    if kind == "ssn":
        area, group, serial = (int(x) for x in text.split("-"))
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0
    if kind == "iban":
        return _iban_rest(text.replace(" ", "")) == 1
    if kind == "secret":
        return not text.isdigit()
    if kind == "ip6":
        try:
            return int(ipaddress.IPv6Address(text)) >> 124 > 0
        except ValueError:
            return False
    if kind == "card":
        return luhn(_digits(text)) and len(set(_digits(text))) > 1
    if kind == "phone":
        keep = _calling_code(text)
        d = _digits(text[keep:])
        if text[0] == "+":
            return keep > 0 and (len(d) == 10 if text[1] == "1" else 6 <= len(d) <= 16 - keep)
        return text[0] == "(" or (_dialled(int(d)) if len(d) == 10 else d[0] > "1")
    return True


_CHANGE: dict[str, Callable[[str, bytes, Step], str]] = {
    "email": _email, "iban": _iban, "secret": _secret, "ip6": _ip6, "ip": _ip, "date": _day, "ssn": _ssn, "phone": _phone, "card": _card,
}


@lru_cache(maxsize=1 << 15)
def _changed(kind: str, text: str, key: bytes, back: bool) -> str:
    return _CHANGE[kind](text, key, invert if back else permute)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """``text`` with every finding replaced, and how many of each kind there were.

    A pseudonym has the format of its value and passes the same check, so it is found again and
    ``back`` restores the text (IPv6 addresses come back in their usual spelling). Equal values get
    equal pseudonyms everywhere, numbers and dates also where they are written differently.
    """
    counts: Counter = Counter()
    if not _SIGN.search(text):
        return text, counts

    def change(m: re.Match) -> str:
        kind, found = m.lastgroup, m.group()
        if not _valid(kind, found):
            return found
        counts[kind] += 1
        return _changed(kind, found, key, back)

    return _PATTERN.sub(change, text), counts


def _rewritten(batch: pa.RecordBatch, at: int, key: bytes, size: int = 256) -> Iterator[tuple[pa.RecordBatch, pa.Array, list[Counter]]]:
    """Slices of a batch, their texts with pseudonyms, and what was found in each. Bytes that are not
    UTF-8 stay as they are."""
    for low in range(0, batch.num_rows, size):
        part = batch.slice(low, size)
        out: list[bytes | None] = []
        counts = []
        for raw in part.column(at).cast(pa.large_binary()).to_pylist():
            text, found = (None, Counter()) if raw is None else pseudonymise(raw.decode("utf-8", "surrogateescape"), key)
            out.append(None if text is None else text.encode("utf-8", "surrogateescape"))
            counts.append(found)
        yield part, strings(out), counts


def pseudonymise_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, n_<kind> for every kind): one row per row of ``docs``.

    A null text stays null and an empty one empty, with counts of 0; repeated rows are treated
    alike; an empty table gives an empty table; other columns are not read. Numbers and dates that
    fail their check are no findings and stay: card numbers with a wrong check digit (Luhn), bank
    account numbers with wrong check digits or another length than their country's, telephone
    numbers with an unknown country code or too many or few digits, addresses with a part over
    255, days that do not exist, area 000.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, changed, found in _rewritten(batch, 1, key):
                counts = [pa.array([c[k] for c in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), changed, *counts], [id_col, text_col, *(f"n_{k}" for k in KINDS)])

    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, " + ", ".join(f"n_{k} long" for k in KINDS))


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts pseudonymised in place (:func:`pseudonymise_texts`); every other column
    unchanged, whatever its name, in the same order. Lengths are kept but for addresses."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, changed, _ in _rewritten(batch, at, key):
                yield part.set_column(at, batch.schema.field(at).with_type(pa.string()), changed)

    return docs.mapInArrow(run, docs.schema)
