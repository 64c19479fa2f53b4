"""Timestamps are kept as raw strings and parsed where they are compared, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The shapes of timestamps that are read.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
SPOKEN = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy")
WEEKDAY = r"\s*\([A-Za-z]+\)\s*"
SLASHED = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$"


def parse(raw: str | Column, lenient: bool = True) -> Column:
    """A timestamp, or null for what is blank, unknown or in no known shape. lenient also reads
    year/month/day (weekday) hour:minute."""
    x = strip(F.col(raw) if isinstance(raw, str) else raw)
    # Bound to a variable, so that what raw is made of is evaluated once and not in every branch.
    return F.get(F.transform(F.array(x), lambda s: _read(s, lenient)), F.lit(0))


def _read(x: Column, lenient: bool) -> Column:
    known = F.when((x != "") & (F.lower(x) != "unknown"), x)
    iso = F.try_to_timestamp(F.when(known.rlike(ISO), F.regexp_replace(F.upper(known), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    spoken = F.regexp_replace(F.regexp_replace(known, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    is_spoken = known.rlike(r"(?i)^\d{1,2}:\d{2}\s[ap]m on ")
    out = [iso, F.try_to_timestamp(F.when(known.rlike(r"^\d{8}$"), known), F.lit("yyyyMMdd"))]
    out += [F.try_to_timestamp(F.when(is_spoken, spoken), F.lit(f)) for f in SPOKEN]
    if lenient:
        plain = F.regexp_replace(known, WEEKDAY, " ")
        out.append(F.try_to_timestamp(F.when(plain.rlike(SLASHED), plain), F.lit("yyyy/MM/dd HH:mm")))
    return F.coalesce(*out)


def visible(available_raw: Column, timestamp_raw: Column, query_time_raw: Column) -> Column:
    """Whether a unit can be seen at the query's time. Without a query time all can; where either
    side can't be read, none can."""
    return no_cutoff(query_time_raw) | F.coalesce(available_at(available_raw, timestamp_raw) <= parse(query_time_raw), F.lit(False))


def no_cutoff(query_time_raw: str | Column) -> Column:
    raw = F.col(query_time_raw) if isinstance(query_time_raw, str) else query_time_raw
    return raw.isNull() | (strip(raw) == "")


def available_at(available_raw: Column, timestamp_raw: Column) -> Column:
    return parse(F.coalesce(F.nullif(available_raw, F.lit("")), timestamp_raw))


def earliest(raw: str, order: str) -> Column:
    """The raw string of the least timestamp, the first of those that tie; if none can be read,
    the first that isn't blank. An aggregate; order is the column of positions, of any kind that
    has an order."""
    ts = parse(raw)
    plain = F.when(strip(raw) != "", F.col(raw))
    return F.coalesce(F.min_by(F.col(raw), F.when(ts.isNotNull(), F.struct(ts, F.col(order)))), F.min_by(plain, F.when(plain.isNotNull(), F.col(order))))


def latest(raw: str, order: str) -> Column:
    """As earliest(), of the greatest; if none can be read, the last that isn't blank."""
    ts = parse(raw)
    plain = F.when(strip(raw) != "", F.col(raw))
    return F.coalesce(F.min_by(F.col(raw), F.when(ts.isNotNull(), F.struct(-F.unix_micros(ts), F.col(order)))), F.max_by(plain, F.when(plain.isNotNull(), F.col(order))))
