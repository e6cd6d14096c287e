"""Time columns: CF decoding, snapping, synthesis, range text.

All instants are ``TIMESTAMP_NTZ`` in UTC with microsecond precision, so results do not
depend on the session time zone.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# Microseconds per CF time unit, with the accepted spellings.
CF_UNIT_MICROS = {
    "days": 86_400_000_000, "day": 86_400_000_000, "d": 86_400_000_000,
    "hours": 3_600_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000,
    "hrs": 3_600_000_000, "h": 3_600_000_000,
    "minutes": 60_000_000, "minute": 60_000_000, "min": 60_000_000, "mins": 60_000_000,
    "seconds": 1_000_000, "second": 1_000_000, "sec": 1_000_000, "secs": 1_000_000,
    "s": 1_000_000,
    "milliseconds": 1_000, "millisecond": 1_000, "msec": 1_000, "ms": 1_000,
    "microseconds": 1, "microsecond": 1, "us": 1,
}

# Calendars that agree with timestamps.
STANDARD_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast(NTZ)


def micros(instant: Column) -> Column:
    """Microseconds since 1970-01-01."""
    return F.timestamp_diff("MICROSECOND", _epoch(), instant)


def from_micros(value: Column) -> Column:
    """Instant from microseconds since 1970-01-01."""
    return F.timestamp_add("MICROSECOND", value, _epoch())


def parse_instant(text: Column) -> Column:
    """ISO text → instant in UTC, or null. ``Z``, ``UTC`` and numeric offsets are honoured."""
    tidy = F.trim(text)
    offset = F.regexp_extract(tidy, r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*([+-]\d{2}):?\d{2}$", 1)
    minutes = F.regexp_extract(tidy, r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*[+-]\d{2}:?(\d{2})$", 1)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    shift = F.when(
        offset != "",
        offset.try_cast("int") * 60 + sign * minutes.try_cast("int"),
    ).otherwise(0)
    bare = F.regexp_replace(tidy, r"\s*(?:Z|z|UTC)$", "")
    bare = F.regexp_replace(bare, r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*[+-]\d{2}:?\d{2}$", "$1")
    return F.timestamp_add("MINUTE", -shift, bare.try_cast(NTZ))


def decode_cf_time(value: Column, units: Column, calendar: Column | None = None) -> Column:
    """``value`` counted in ``"<unit> since <epoch>"`` → instant.

    Null when the units are missing or not understood. A calendar that does not match
    real dates stops the job instead of giving wrong days.
    """
    unit = F.lower(F.regexp_extract(units, r"^\s*([A-Za-z]+)\s+since\s+", 1))
    epoch = parse_instant(F.regexp_extract(units, r"\s+since\s+(.+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in CF_UNIT_MICROS.items() for x in pair])
    decoded = F.timestamp_add(
        "MICROSECOND", F.round(value.cast("double") * F.try_element_at(table, unit)).cast("long"), epoch
    )
    if calendar is None:
        return decoded
    odd = calendar.isNotNull() & ~F.lower(calendar).isin(*STANDARD_CALENDARS)
    return F.when(
        odd, F.raise_error(F.concat(F.lit("unsupported calendar: "), calendar)).cast(NTZ)
    ).otherwise(decoded)


def synthesize_time(time: Column, begin_date: Column, begin_clock: Column) -> Column:
    """``time`` where known, else the granule's own begin date and clock time.

    The clock defaults to midnight and may end in ``Z``; without a date the time stays
    unknown.
    """
    clock = F.coalesce(F.rtrim(begin_clock, F.lit("Z")), F.lit("00:00:00"))
    return F.coalesce(time, F.concat(begin_date, F.lit("T"), clock).try_cast(NTZ))


def snap_time(instant: Column, freq_ns: int) -> Column:
    """Round to the nearest multiple of ``freq_ns`` nanoseconds, ties to even.

    Integer arithmetic throughout, so the tie rule is exact.
    """
    if freq_ns <= 0:
        raise ValueError("snap frequency must be a positive number of nanoseconds")
    ns = micros(instant) * F.lit(1000).cast("long")
    step = F.lit(freq_ns).cast("long")
    rest = F.pmod(ns, step)
    floor = ns - rest
    odd = F.pmod(floor, step * 2) != 0
    up = (rest * 2 > step) | ((rest * 2 == step) & odd)
    snapped = F.when(up, floor + step).otherwise(floor)
    return from_micros(F.floor(snapped / F.lit(1000)).cast("long") if freq_ns % 1000 else
                       (F.expr("1L") * snapped / F.lit(1000)).cast("long"))


def parse_range(text: Column) -> Column:
    """``start/end`` text → ``struct<start, end>``; nulls where the text has no ``/``."""
    has_end = F.contains(text, F.lit("/")) & (F.substring_index(text, "/", -1) != "")
    start = parse_instant(F.substring_index(text, "/", 1))
    # Everything after the first slash, so a second slash makes the end unreadable.
    end = parse_instant(F.regexp_extract(text, r"^[^/]*/(.*)$", 1))
    return F.struct(
        F.when(has_end, start).alias("start"), F.when(has_end, end).alias("end")
    )


def format_range(start: Column, end: Column) -> Column:
    """Two instants → ``start/end`` text with a ``Z`` suffix."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    return F.concat(
        F.date_format(start, pattern), F.lit("Z/"), F.date_format(end, pattern), F.lit("Z")
    )


_PARTIAL = re.compile(
    r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(\.\d{1,6})?)?)?)?)?)?Z?$"
)


def _span(text: str) -> tuple[datetime, datetime]:
    """First instant of the period a partial date names, and of the next period."""
    match = _PARTIAL.match(text.strip())
    if not match:
        raise ValueError(f"not a date or time: {text!r}")
    year, month, day, hour, minute, second, fraction = match.groups()
    start = datetime(
        int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0),
        int(second or 0), int(float(fraction or 0) * 1_000_000 + 0.5),
    )
    if month is None:
        return start, start.replace(year=start.year + 1)
    if day is None:
        return start, (start.replace(day=28) + timedelta(days=4)).replace(day=1)
    width = (
        timedelta(microseconds=1) if fraction
        else timedelta(seconds=1) if second
        else timedelta(minutes=1) if minute
        else timedelta(hours=1) if hour
        else timedelta(days=1)
    )
    return start, start + width


def time_bounds(time_range: str) -> tuple[datetime | None, datetime | None]:
    """``start/end`` text → half-open bounds; an end date covers its whole period.

    Either side may be empty. ``"2020-01-01/2020-01-02"`` covers both days.
    """
    start, _, end = time_range.partition("/")
    low = _span(start)[0] if start.strip() else None
    high = _span(end)[1] if end.strip() else None
    return low, high
