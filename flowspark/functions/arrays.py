"""Arrays, JSON and maps as columns, and rounding as Python does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """Two numbers of half the digits that sum to ``x`` exactly."""
    c = x * 134217729.0
    high = c - (c - x)
    return high, x - high


def half_even(x: Column, digits: int) -> Column:
    """Python's round: by the exact binary value, ties to the even one.

    bround decides on the decimal text of a number. Where that ends in a 5 one place further, the error of its product
    with a power of ten, taken exactly in halves, tells whether the binary value lies above or below.
    """
    scale = float(10 ** (digits + 1))
    p = x * scale
    k = F.rint(p)
    (xh, xl), (sh, sl) = _halves(x), _halves(F.lit(scale))
    above = (p - k) + (((xh * sh - p) + xh * sl + xl * sh) + xl * sl)
    close = (F.abs(k) % 10 == 5) & (F.abs(p - k) < 1e-3) & (F.abs(k) < float(1 << 52))
    to = lambda n: n / 10 / float(10**digits)
    return F.when(F.isnan(x), x).when(close & (above > 0), to(k + 5)).when(close & (above < 0), to(k - 5)).otherwise(F.bround(x, digits))


def digest_number(*parts: Column | str) -> Column:
    """52 bits of a digest of the parts as a number, which other engines can compute too."""
    return F.conv(F.left(F.md5(F.concat_ws("-", *parts)), F.lit(13)), 16, 10).cast("long")


def pairwise_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def every_third(a: Column) -> Column:
    return F.filter(a, lambda x, i: i % 3 == 0)


def merged_intervals(a: Column, gap: float = 1e-9) -> Column:
    """Sorted intervals (struct a, b) with those that touch made one."""
    empty = F.array().cast("array<struct<a:double,b:double>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    return F.aggregate(F.array_sort(a), empty, lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= last(acc)["b"] + gap), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))))


def with_forecast(series: Column, value: Column) -> tuple[Column, Column]:
    """The series with a null at its end, and a second series that is null but for its end."""
    return F.array_append(series, F.lit(None).cast("double")), F.array_append(F.transform(series, lambda x: F.lit(None).cast("double")), value)


def lane_range(cameras: Column, group: str, lanes: Column) -> Column:
    """First to last lane (from 1) of a camera group; without groups the lanes are halved between A and B."""
    at = F.filter(F.transform(cameras, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) == group, i + 1)), lambda i: i.isNotNull())
    half = F.floor(lanes / 2)
    halves = F.when(F.lit(group.endswith("A")), F.when(half > 0, F.concat(F.lit("1-"), half.cast("string"))).otherwise("1")).otherwise(F.concat((half + 1).cast("string"), F.lit("-"), lanes.cast("string")))
    return F.when(F.size(at) > 0, F.concat(F.array_min(at).cast("string"), F.lit("-"), F.array_max(at).cast("string"))).otherwise(halves)


def tolerant_json(text: Column, schema: str) -> Column:
    """Parsed JSON, or null where it doesn't parse."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def tolerant_style(text: Column) -> Column:
    """A style as a map, given as JSON text: null for null, empty and broken texts, and for JSON that is no object."""
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def sorted_json(*columns: str) -> Column:
    """The columns as compact JSON with sorted names, nulls included. Sort the fields of nested structs alike."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; those of the second win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def blank_to_null(c: Column, kind: str = "int") -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)
