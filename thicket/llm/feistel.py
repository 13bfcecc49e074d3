"""Keyed permutations within a format.

A value is read as a number in the mixed radix of its letters and digits and sent through a
Feistel network over the smallest even number of bits that holds the format; results
outside the format walk on along the cycle until they fall inside. The map is a bijection of
the format for every key, so equal values stay equal and different ones different.
"""

from __future__ import annotations

import datetime as dt
import hashlib

ROUNDS = 8
#: Dates are permuted within this range.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str = "") -> int:
    """A bijection of 0 ... size-1."""
    if size < 2:
        return value
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            f = hashlib.blake2b(f"{tweak}|{size}|{i}|{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_text(text: str, key: bytes, tweak: str = "") -> str:
    """ASCII letters and digits are permuted, each place within its own alphabet; the rest stays."""
    digits, radix = [], []
    for ch in text:
        if "0" <= ch <= "9":
            digits.append(ord(ch) - 48)
            radix.append(10)
        elif "a" <= ch.lower() <= "z":
            digits.append(ord(ch.lower()) - 97)
            radix.append(26)
    value, size = 0, 1
    for d, r in zip(digits, radix):
        value, size = value * r + d, size * r
    value = permute(value, size, key, tweak)
    new = []
    for r in reversed(radix):
        value, d = divmod(value, r)
        new.append(d)
    new.reverse()
    out, it = [], iter(new)
    for ch in text:
        if "0" <= ch <= "9":
            out.append(chr(48 + next(it)))
        elif "a" <= ch.lower() <= "z":
            c = chr(97 + next(it))
            out.append(c.upper() if ch.isupper() else c)
        else:
            out.append(ch)
    return "".join(out)


def permute_date(day: dt.date, key: bytes) -> dt.date:
    n = LAST_DAY - FIRST_DAY + 1
    at = (day.toordinal() - FIRST_DAY) % n
    return dt.date.fromordinal(FIRST_DAY + permute(at, n, key, "date"))


def token(text: str, key: bytes, bits: int = 96) -> str:
    """A keyed name for a value that has no numeric format; of 10^10 values no two are likely to share one."""
    return hashlib.blake2b(text.encode(), key=key, digest_size=bits // 8).hexdigest()
