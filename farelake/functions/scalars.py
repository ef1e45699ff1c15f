"""Row-level column expressions. All stay inside JVM code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

OPEN_END = "9999-12-31 00:00:00"
UNKNOWN_MEMBER = -1


def col_of(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clock(as_of: str | dt.datetime | Column | None = None) -> Column:
    """The ``as_of`` clock as a zone-less timestamp; the session clock if None."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def months_before(as_of, months: int) -> Column:
    """Same time of day ``months`` earlier, the day clamped to the month's end."""
    return clock(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))


def days_before(as_of, days: int) -> Column:
    return clock(as_of) - F.make_dt_interval(days=F.lit(days))


def plus_minutes(ts: str | Column, minutes: int) -> Column:
    return col_of(ts) + F.make_dt_interval(mins=F.lit(minutes))


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first last``; NULL when either part is NULL."""
    return F.concat(col_of(first), F.lit(" "), col_of(last))


def code(value: str | Column) -> Column:
    """Upper-case code without trailing blanks, for loosely collated input."""
    return F.upper(F.rtrim(col_of(value)))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed minutes; independent of the session's zone."""
    return (col_of(end) - col_of(start)).cast("interval minute").cast("int")


def time_key(ts: str | Column) -> Column:
    """``YYYYMMDDHH24MI`` as a long."""
    return F.date_format(col_of(ts), "yyyyMMddHHmm").cast("bigint")


def location_key(lat: str | Column, lng: str | Column) -> Column:
    """Hash of the fixed 8-decimal text ``lat_lng``; NULL when either is NULL."""
    text = F.concat(col_of(lat).cast("decimal(10,8)").cast("string"), F.lit("_"),
                    col_of(lng).cast("decimal(11,8)").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 50)


def password_digest(password: str | Column, salt: str | Column) -> Column:
    """Hex SHA-256 of password followed by salt."""
    return F.sha2(F.concat(col_of(password), col_of(salt)), 256)


def is_json_document(text: str | Column) -> Column:
    """True for a JSON object or array, NULL for NULL (a check passes NULL).

    Spark's reader stops at the end of a document. The text is therefore put
    into an array with a mark behind it: the mark is the second element only where
    the text is one whole document. The mark is a hash of the text, which the text cannot hold.
    """
    value = col_of(text)
    mark = F.xxhash64(value).cast("string")
    behind = F.get_json_object(F.concat(F.lit("["), value, F.lit(',"'), mark, F.lit('"]')), "$[1]")
    return F.when(value.isNotNull(), F.substring(F.ltrim(value), 1, 1).isin("{", "[") & F.coalesce(behind == mark, F.lit(False)))


def default_to(value: str | Column, fallback) -> Column:
    return F.coalesce(col_of(value), fallback if isinstance(fallback, Column) else F.lit(fallback))
