"""Small string hashes as column expressions, in 64-bit arithmetic that wraps by hand."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def code_points(text: Column) -> Column:
    """The code point of each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def tag_hue(tag: Column) -> Column:
    """Degrees of a colour circle from the top segment of a tag: base 37, unsigned 32 bits."""
    top = F.element_at(F.split(tag, "/"), 1)
    return F.aggregate(code_points(top), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 37 + c, F.lit(4294967296))) % 360


def djb2(text: Column) -> Column:
    """Base 33 from 5381 in signed 32 bits, without sign."""
    wrapped = F.aggregate(code_points(text), F.lit(5381).cast("bigint"), lambda h, c: F.pmod(h * 33 + c + 2147483648, F.lit(4294967296)) - 2147483648)
    return F.abs(wrapped)


def digit_hash(text: Column) -> Column:
    """Base 31, modulo 10 at each step."""
    return F.aggregate(code_points(text), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % 10)
