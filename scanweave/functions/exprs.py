"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

PI = math.pi


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """True where the value is present, not NaN and not infinite."""
    v = col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def nan_to_null(c: str | Column) -> Column:
    return F.when(finite(c), col(c))


def wrap_angle(a: str | Column) -> Column:
    """Angle in [-pi, pi); the modulus takes the sign of the divisor."""
    return F.pmod(col(a) + F.lit(PI), F.lit(2 * PI)) - F.lit(PI)


def wrap_degrees(a: str | Column) -> Column:
    return F.pmod(col(a) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def cell(c: str | Column, width: float) -> Column:
    """Floor bin of a coordinate; negative values go to the lower cell."""
    return F.floor(col(c) / F.lit(float(width))).cast("long")


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Value held in [lo, hi]; missing stays missing."""
    v = col(c)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a naive timestamp (session zone must be UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def time_bucket(us: str | Column, width_s: float) -> Column:
    """Number of the time bucket a microsecond clock value falls in."""
    return F.floor(col(us) / F.lit(int(round(width_s * 1_000_000)))).cast("long")


def hash_order(seed: str, *parts: str | Column) -> Column:
    """Partition-independent pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[col(p).cast("string") for p in parts]))


def hash_unit(seed: str, *parts: str | Column) -> Column:
    """Pseudo-random number in [0, 1) from the first 32 bits of an md5."""
    return (F.conv(F.substring(hash_order(seed, *parts), 1, 8), 16, 10).cast("double")
            / F.lit(4294967296.0))


def text_seed(s: str | Column) -> Column:
    """32-bit number from the leading bytes of a SHA-256."""
    return F.conv(F.substring(F.sha2(col(s), 256), 1, 8), 16, 10).cast("long")


def near(a: str | Column, b: str | Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Null-safe equality within tolerance."""
    a, b = col(a), col(b)
    return F.coalesce(a.eqNullSafe(b) | (F.abs(a - b) <= F.lit(abs_) + F.lit(rel) * F.abs(b)),
                      F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conds)


def joined_flags(pairs: list[tuple[Column, str]], sep: str = "|", none: str | None = None) -> Column:
    """Names of the true conditions joined by ``sep``."""
    text = F.concat_ws(sep, *[F.when(c, F.lit(name)) for c, name in pairs])
    return text if none is None else F.when(text == "", F.lit(none)).otherwise(text)


def parse_flag(c: str | Column) -> Column:
    """'True'/'true' is true; everything else, blank and missing included, is false."""
    return F.coalesce(F.lower(F.trim(col(c))) == "true", F.lit(False))


def parse_number(c: str | Column) -> Column:
    """Number or null; NaN text counts as missing."""
    return nan_to_null(F.trim(col(c)).try_cast("double"))


def signed_duration(seconds: str | Column) -> Column:
    """'+HH:MM:SS.mmm' from seconds."""
    s = col(seconds)
    ms = F.round(F.abs(s) * 1000).cast("long")
    return F.concat(F.when(s < 0, F.lit("-")).otherwise(F.lit("+")),
                    F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000),
                                    F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000))
