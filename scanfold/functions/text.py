"""Strings, paths, colours and nanosecond times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s: Column, separators: str) -> Column:
    """Pieces of a string between any of the separators, without an empty first piece."""
    cls = "[" + "".join("\\" + c for c in separators) + "]"
    parts = F.split(s, cls)
    return F.when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_folder(path: Column) -> Column:
    """Everything up to and with the last slash."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def file_extension(path: Column) -> Column:
    """The last extension with its dot, or nothing."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def parse_ns(s: Column, now_ns: Column | None = None) -> Column:
    """Nanoseconds since 1970 of ``Y-m-d H:M:S.fraction`` (space, ``_`` or ``T`` between), of a whole number above 9999, or
    of signed seconds from ``now_ns`` if that is given; else 0. The session's time zone applies."""
    pat = r"^(\d{4}-\d{1,2}-\d{1,2})[ _T](\d{1,2}:\d{1,2}:\d{1,2})(?:\.(\d{1,9}))?$"
    secs = F.unix_timestamp(F.concat_ws(" ", F.regexp_extract(s, pat, 1), F.regexp_extract(s, pat, 2)), "y-M-d H:m:s")
    frac = F.rpad(F.regexp_extract(s, pat, 3), 9, "0").cast("long")
    number = F.when(s.rlike(r"^\d{5,18}$"), s.cast("long"))
    if now_ns is not None:
        number = F.coalesce(number, F.when(s.rlike(r"^[+-]\d{1,9}(\.\d+)?$"), now_ns + F.floor(s.try_cast("decimal(28,9)") * 1_000_000_000).cast("long")))
    return F.when(s.rlike(pat), secs * 1_000_000_000 + frac).otherwise(F.coalesce(number, F.lit(0)))


def format_clock(ns: Column) -> Column:
    """``hh:mm:ss.mls`` of a duration in nanoseconds."""
    ms = F.floor(ns / 1_000_000)
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3_600_000), 2), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def hue_of(x: Column, low: float, high: float) -> Column:
    """Hue in degrees of a value: 0 at ``low`` and 240 at ``high``, held outside."""
    return 240 * F.least(F.greatest((x - low) / F.lit(high - low), F.lit(0.0)), F.lit(1.0))


def hsv_to_rgb(h: Column, s: Column | float = 1.0, v: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 1, of a hue in degrees."""
    s, v = (x if isinstance(x, Column) else F.lit(x) for x in (s, v))

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)
