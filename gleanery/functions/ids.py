"""Document ids from strings, and numbers for people."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = (1 << 64) - 1


def siphash13(data: bytes, k0: int = 0, k1: int = 0) -> int:
    """SipHash with one compression and three finalisation rounds."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rotate(x: int, n: int) -> int:
        return (x << n | x >> (64 - n)) & _M

    def mix() -> None:
        v[0] = (v[0] + v[1]) & _M
        v[2] = (v[2] + v[3]) & _M
        v[1], v[3] = rotate(v[1], 13) ^ v[0], rotate(v[3], 16) ^ v[2]
        v[0] = rotate(v[0], 32)
        v[2], v[0] = (v[2] + v[1]) & _M, (v[0] + v[3]) & _M
        v[1], v[3] = rotate(v[1], 17) ^ v[2], rotate(v[3], 21) ^ v[0]
        v[2] = rotate(v[2], 32)

    whole = len(data) // 8 * 8
    blocks = [int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)]
    blocks.append(int.from_bytes(data[whole:], "little") | (len(data) & 0xFF) << 56)
    for m in blocks:
        v[3] ^= m
        mix()
        v[0] ^= m
    v[2] ^= 0xFF
    for _ in range(3):
        mix()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def parse_id(text: str) -> int:
    """The number in an id, behind its only hyphen if it has just one; else a hash of the whole."""
    parts = text.split("-")
    number = parts[1] if len(parts) == 2 else text
    digits = number[1:] if number[:1] == "+" else number
    if digits.isascii() and digits.isdigit() and int(digits) <= _M:
        return int(digits)
    return siphash13(text.encode())


@F.pandas_udf(T.DecimalType(20, 0))
def _hashed(text: pd.Series) -> pd.Series:
    from decimal import Decimal

    return text.map(lambda x: None if x is None else Decimal(parse_id(x)))


def parse_id_column(text: Column) -> Column:
    """:func:`parse_id` as a DECIMAL(20, 0), since ids reach beyond a signed 64-bit number.

    Plain numbers, and numbers behind one hyphen, stay in the JVM; only the rest is hashed.
    """
    number = F.regexp_extract(text, r"^(?:[^-]*-)?\+?([0-9]{1,19})$", 1)
    return F.when(text.isNull(), None).when(number != "", number.cast("decimal(20,0)")).otherwise(_hashed(text))


def format_si(value: float, unit: str) -> str:
    """Two decimals, and K, M, G, ... for powers of a thousand."""
    scaled, prefix = float(value), ""
    for larger in ("K", "M", "G", "T", "P", "E", "Z", "Y"):
        if abs(scaled) < 1000:
            break
        scaled, prefix = scaled / 1000, larger
    return f"{scaled:.2f} {prefix}{unit}"
