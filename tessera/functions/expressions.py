"""Scalar expressions that the operators' formulas use, by class.

Everything is a composition of built-in functions and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def toward_zero(x: Column) -> Column:
    return x.cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def remainder(x: Column, by: Column | float) -> Column:
    """Float remainder with the divisor's sign."""
    return x - by * F.floor(x / by)


def hypotenuse(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a, 2) + F.pow(b, 2))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.least(F.lit(1.0), 4 * F.pi() * area / F.pow(perimeter, 2))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def steps(values: Column) -> Column:
    """Differences of neighbouring elements."""
    return F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)


def gradient(values: Column) -> Column:
    """Central differences, one-sided at both ends."""
    last = F.size(values) - 1
    at = lambda i: F.get(values, i)
    return F.transform(values, lambda _, i: F.when(i == 0, at(F.lit(1)) - at(F.lit(0))).when(i == last, at(last) - at(last - 1)).otherwise((at(i + 1) - at(i - 1)) / 2))


def running_sum(values: Column) -> Column:
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x))


def index_of(values: Column, x) -> Column:
    """Position from 0, null if absent."""
    return F.nullif(F.array_position(values, x), F.lit(0)) - 1


def chosen(values: Column, flags: Column) -> Column:
    """Elements whose flag is set."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), flags.alias("f")), lambda p: p["f"]), lambda p: p["v"])


def joined(parts: Column) -> Column:
    """A list of lists as one."""
    return F.flatten(parts)


def without_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def with_entry(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def by_value(m: Column) -> Column:
    """Entries by value, largest first, then by key."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def delete(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def part(text: Column, separator: str, at: int) -> Column:
    """A part by position from 0, from the end if negative, null beyond."""
    return F.try_element_at(F.split(text, separator), F.lit(at + 1 if at >= 0 else at))


def stripped(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def mentions(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def hex_rgb(text: Column) -> Column:
    """``#rrggbb`` as three integers."""
    plain = F.ltrim(text, F.lit("#"))
    return F.array(*[F.conv(F.substring(plain, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def percent(x: Column, digits: int = 2) -> Column:
    """A share as text with a percent sign."""
    return F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))


def number(text: Column) -> Column:
    """Text as a number, null if it is none."""
    return F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")


def optional(json: Column, path: str, default: str) -> Column:
    """A JSON field or a default."""
    return F.coalesce(F.get_json_object(json, path), F.lit(default))
