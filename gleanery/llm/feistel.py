"""Keyed permutations of decimal numbers: a balanced-as-can-be Feistel network with cycle walking."""

from __future__ import annotations

from hashlib import blake2b


def _round(key: bytes, tweak: bytes, turn: int, value: int, modulus: int) -> int:
    digest = blake2b(value.to_bytes(16, "big"), digest_size=16, key=key, salt=bytes([turn]), person=tweak[:16]).digest()
    return int.from_bytes(digest, "big") % modulus


def _sizes(domain: int) -> tuple[int, int]:
    a = max(1, round(domain**0.5))
    while a * a < domain:
        a += 1
    return a, -(-domain // a)


def permute(value: int, domain: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """The image of ``value`` under a keyed permutation of 0 .. domain - 1.

    The number is split into a quotient and a remainder, each changed in turn by a keyed hash of
    the other; results at or beyond ``domain`` are permuted again until one falls below it.
    """
    if not 0 <= value < domain:
        raise ValueError("value outside its domain")
    a, b = _sizes(domain)
    label = tweak.encode()
    while True:
        left, right = value // b, value % b
        for turn in range(rounds):
            if turn % 2:
                right = (right + _round(key, label, turn, left, b)) % b
            else:
                left = (left + _round(key, label, turn, right, a)) % a
        value = left * b + right
        if value < domain:
            return value


def invert(value: int, domain: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """The number that :func:`permute` takes to ``value``."""
    a, b = _sizes(domain)
    label = tweak.encode()
    while True:
        left, right = value // b, value % b
        for turn in reversed(range(rounds)):
            if turn % 2:
                right = (right - _round(key, label, turn, left, b)) % b
            else:
                left = (left - _round(key, label, turn, right, a)) % a
        value = left * b + right
        if value < domain:
            return value
