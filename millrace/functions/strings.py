"""Scalar column functions on strings, paths, sizes and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column | str) -> Column:
    """Without white space at both ends: Unicode's and U+001C..U+001F."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _ENDS, "")


def basename_key(path: Column | str) -> Column:
    """The last path component up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def drop_last(c: Column, n: int) -> Column:
    """Without the last ``n`` characters."""
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def one_line(c: Column) -> Column:
    """Without carriage returns, tabs and line feeds."""
    return F.regexp_replace(c, r"[\r\t\n]", "")


def int_or_zero(c: Column) -> Column:
    """The integer in a string; 0 for null and empty; other text is an error."""
    return F.coalesce(F.when(c != "", c).cast("int"), F.lit(0))


def ceil_div(a: Column | str, b: Column | int) -> Column:
    """a / b rounded up, on integers of a positive divisor."""
    a, b = F.col(a) if isinstance(a, str) else a, F.lit(b) if isinstance(b, int) else b
    return ((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")


def line_count(text: Column) -> Column:
    """Line feeds, and one more for a last line without one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return (feeds + F.when((F.length(text) > 0) & (~text.endswith("\n")), 1).otherwise(0)).cast("long")


def wrap_unsigned_byte(c: Column) -> Column:
    """A value stored as uint8: modulo 256."""
    return F.pmod(c, F.lit(256)).cast("smallint")


def wrap_int(c: Column) -> Column:
    """A 64-bit value stored as int32: its low 32 bits as a signed number."""
    low = c.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low > 0x7FFFFFFF, low - 0x100000000).otherwise(low).cast("int")


def percent(x: Column, y: Column) -> Column:
    return x * 100 / y


def is_power_of_two(x: Column) -> Column:
    """Whether log2 is within 1e-4 of its integer part."""
    lg = F.log2(x)
    return F.abs(lg - lg.cast("int")) < 1e-4


def square_side(n: Column) -> Column:
    """The side of a square of ``n`` cells; an error if there is none."""
    side = (F.sqrt(n) + 1e-4).cast("int")
    return F.when(side * side == n, side).otherwise(F.raise_error(F.lit("not a square")).cast("int"))


def format_size(n: float) -> str:
    """Bytes in steps of 1024 with one decimal place and no space before the unit."""
    units = iter(("Bytes", "KB", "MB", "GB", "TB"))
    unit = next(units)
    while abs(n) >= 1024 and unit != "TB":
        n, unit = n / 1024, next(units)
    return f"{n:3.1f}{unit}"


def sqrt_int(n: int) -> int:
    """The exact integer root; ValueError if there is none."""
    root = math.isqrt(n)
    if root * root != n:
        raise ValueError(f"{n} isn't a square")
    return root
