"""Deterministic hash families, the same in any engine that has md5 and 64-bit integers."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def family(n: int, seed: int = 553, prime: int = PRIME) -> list[tuple[int, int]]:
    """n pairs (a, b) of h(x) = (a x + b) mod prime."""
    draw = random.Random(seed)
    return [(draw.randrange(1, prime), draw.randrange(prime)) for _ in range(n)]


def universal(x: Column, a: int, b: int, prime: int = PRIME) -> Column:
    """(a x + b) mod prime; x is reduced first, so nothing overflows."""
    return F.pmod(F.lit(a) * F.pmod(x.cast("long"), F.lit(prime).cast("long")) + F.lit(b), F.lit(prime))


def text_number(text: Column) -> Column:
    """32 bits of md5 as a number; SQL: ('0x' || substr(md5(s), 1, 8))::BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bytes_mod(text: Column, prime: int) -> Column:
    """The text's UTF-8 bytes as one big integer, modulo prime."""
    code = F.hex(F.encode(text, "UTF-8"))
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda k: F.conv(code.substr(k, F.lit(1)), 16, 10).cast("long"))
    return F.when(F.length(code) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(digits, F.lit(0).cast("long"), lambda total, d: F.pmod(total * 16 + d, F.lit(prime).cast("long"))))


def trailing_zeros(h: Column) -> Column:
    """Zero bits at the end of h; 1 for 0."""
    return F.when(h == 0, F.lit(1)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("long")
