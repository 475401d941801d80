"""Numeric, date and geographic functions on columns; no NaN leaves them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OFFER, SALE, bound, norm

EARTH_KM = 6371.0088
FIRST_YEAR = 1500
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def finite(c: Column) -> Column:
    """The number as double; NaN and infinities are null."""
    return bound(c.cast("double"), _finite)


def _finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def parse_number(c: Column) -> Column:
    """Numbers in text: currency signs and units are dropped; with both separators the
    last is the decimal one, a lone comma is decimal, dots in groups of three are
    thousands.  Null if there is no number."""
    bare = F.regexp_replace(F.replace(F.replace(c, F.lit("R$"), F.lit("")), F.lit("r$"), F.lit("")), r"(?U)\s+", "")
    drop = lambda x, s: F.replace(x, F.lit(s), F.lit(""))

    def plain(n: Column) -> Column:
        comma, dot = n.contains(","), n.contains(".")
        last = lambda s: F.length(n) - F.locate(s, F.reverse(n))
        as_decimal = F.replace(drop(n, "."), F.lit(","), F.lit("."))
        text = (
            F.when(comma & dot, F.when(last(",") > last("."), as_decimal).otherwise(drop(n, ",")))
            .when(comma, F.replace(n, F.lit(","), F.lit("."))).when(dot & n.rlike(r"^[-+]?\d{1,3}(\.\d{3})+$"), drop(n, ".")).otherwise(n)
        )
        return text.try_cast("double")

    return finite(bound(F.regexp_substr(bare, F.lit(r"[-+]?\d[\d.,]*")), plain))


def number(c: Column, dtype: str) -> Column:
    """parse_number() for text; columns of numbers as finite() has them."""
    return _finite(c.cast("double")) if dtype.startswith(NUMERIC) else parse_number(c.cast("string"))


def coordinate(c: Column) -> Column:
    """A coordinate in text: a comma is a decimal point, there are no thousands."""
    return finite(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double"))


def first_positive(*cs: Column) -> Column:
    return F.coalesce(*(F.when(c > 0, c) for c in cs)) if cs else F.lit(None).cast("double")


def by_information_type(kind: Column, offer: Column, sale: Column, other: Column) -> Column:
    """Offers and sales take their own list even if it is empty; others the third."""
    t = norm(kind)
    return F.when(t == norm(F.lit(OFFER)), offer).when(t == norm(F.lit(SALE)), sale).otherwise(other)


def valid_year(y: Column, last_year: int) -> Column:
    """Near-integers (relative tolerance 1e-5) from 1500 to the last year."""
    near = F.abs(y - F.rint(y)) <= 1e-9 + 1e-5 * F.abs(F.rint(y))
    return F.coalesce(near & F.rint(y).between(FIRST_YEAR, last_year), F.lit(False))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def local_xy_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular kilometres about a point."""
    return F.lit(EARTH_KM) * F.cos(F.radians(lat0)) * F.radians(lon - lon0), F.lit(EARTH_KM) * F.radians(lat - lat0)


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


DATE_PATTERNS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy")


def parse_date(c: Column, dtype: str) -> Column:
    """Dates in text, day first; numbers from 1 to 100000 are spreadsheet serial days."""
    if dtype.startswith(("timestamp", "date")):
        return c.cast("timestamp")
    text = F.trim(c.cast("string"))
    serial = text.try_cast("double")
    day = F.when(serial.between(1, 100_000), F.timestamp_seconds(F.unix_timestamp(F.lit("1899-12-30 00:00:00")) + (serial * 86_400).cast("long")))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS), day)


def transmitted_share(c: Column, header: str) -> Column:
    """a/b as a ratio; percentages (by sign, header, or above 1) over 100; else as is."""
    text = F.trim(c.cast("string"))
    ratio = r"^\s*([\d.,]+)\s*/\s*([\d.,]+)\s*$"
    over = F.try_divide(parse_number(F.nullif(F.regexp_extract(text, ratio, 1), F.lit(""))), parse_number(F.nullif(F.regexp_extract(text, ratio, 2), F.lit(""))))
    percent = text.contains("%") | F.lit("percentual" in header.casefold())
    return F.when(text.rlike(ratio), over).otherwise(bound(parse_number(text), lambda n: F.when(percent | (n > 1), n / 100).otherwise(n)))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
