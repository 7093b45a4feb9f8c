"""Bit maps of 64-bit names: which rows may be in a set, without shuffling the others.

A map is a table of parts of 4 KB. It has 16 to 32 bits for each name, but never over ``MOST_BITS`` (64 MB) in all, so it may be broadcast whatever
the set's size; beyond that it lets more pass. What passes is only a candidate: the caller joins it with the set itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 29
PART_BITS = 15


def leading_bits(names: int) -> int:
    """How many leading bits of a name are its place in a map of so many names."""
    return min(MOST_BITS.bit_length() - 1, max(PART_BITS, (16 * names).bit_length()))


def bit_map(names: DataFrame, power: int) -> DataFrame:
    """part, bits of the names in the first column."""
    at = F.shiftrightunsigned(names.columns[0], 64 - power)
    return names.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))


def part_of(name: Column | str, power: Column | int) -> Column:
    return _place(name, power, PART_BITS)


def _place(name: Column | str, power: Column | int, drop: int) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    power = F.lit(power) if isinstance(power, int) else power
    # a shift by a column; the top bit is taken off first, so that nothing is negative
    top = F.shiftrightunsigned(name, 1)
    return F.call_function("shiftright", top, (F.lit(63 + drop) - power).cast("int"))


def bit_is_set(bits: Column | str, name: Column | str, power: Column | int) -> Column:
    """Whether the bit of ``name`` is set in its part; false where there is no such part."""
    at = _place(name, power, 0)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) % 4096 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")), F.lit(0)) != 0
