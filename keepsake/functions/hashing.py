"""Perceptual and content hashes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .numbers import let

HEX = "0123456789abcdef"


def difference_hash(grid: Column, size: int = 8) -> Column:
    """Hex hash of ``size`` rows of ``size + 1`` grey values: one bit per rise from left to right."""

    def bit(g, i):
        # bit i compares positions i + row and i + row + 1, a row being one value longer than its bits
        at = (i + F.floor(i / size)).cast("int")
        return (F.get(g, at) < F.get(g, at + 1)).cast("int")

    def digit(g, first):
        value = reduce(lambda acc, k: acc * 2 + bit(g, first * 4 + k), range(4), F.lit(0))
        return F.substring(F.lit(HEX), value + 1, F.lit(1))

    count = F.sequence(F.lit(0), F.lit(size * size // 4 - 1))
    return let(grid, lambda g: F.array_join(F.transform(count, lambda d: digit(g, d)), ""))


def hamming(h1: Column, h2: Column, mode: str = "char", length: int | None = None,
            strict: bool = True) -> Column:
    """Differing hex characters (``char``) or differing bits (``bit``).

    A known ``length`` unrolls the comparison into generated code.
    """
    if mode == "char":
        if length is not None:
            return reduce(lambda x, y: x + y,
                          [(F.substring(h1, i, 1) != F.substring(h2, i, 1)).cast("int")
                           for i in range(1, length + 1)])
        unequal = F.zip_with(F.split(h1, ""), F.split(h2, ""),
                             lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.lit(1)))
        value = F.aggregate(unequal, F.lit(0), lambda acc, x: acc + x)
    elif mode == "bit":
        # 32 bits at a time: a full 64-bit value would overflow the signed cast
        def half(h, at):
            return F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
        value = (F.bit_count(half(h1, 1).bitwiseXOR(half(h2, 1)))
                 + F.bit_count(half(h1, 9).bitwiseXOR(half(h2, 9))))
    else:
        raise ValueError(f"unknown hamming mode: {mode}")
    fail = F.raise_error(F.lit("hashes must have the same length")).cast("int")
    return F.when(F.length(h1) == F.length(h2), value).otherwise(fail if strict else F.lit(None))


def hash_similarity(h1: Column, h2: Column, mode: str = "char", length: int | None = None) -> Column:
    """One minus distance over four times the hash length, for either distance."""
    return F.lit(1.0) - hamming(h1, h2, mode, length) / (F.length(h1) * 4)


def content_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))
