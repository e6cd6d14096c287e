"""Temporal resampling to means and block coarsening."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.quality import nan_to_null
from graticule.functions.temporal import from_micros, micros
from graticule.operators.axes import find_horizontal
from graticule.operators.grid import decoded_time

# Microseconds per fixed-width frequency alias.
FIXED_MICROS = {
    "D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000,
    "ms": 1_000, "us": 1,
}
# Months per calendar alias, by where the label sits.
END_MONTHS = {"ME": 1, "QE": 3, "YE": 12}
START_MONTHS = {"MS": 1, "QS": 3, "YS": 12}
# Last day of a week alias, as Spark's dayofweek (Sunday = 1).
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEK_ENDS = {"SUN": 1, "MON": 2, "TUE": 3, "WED": 4, "THU": 5, "FRI": 6, "SAT": 7}

_DAY = 86_400_000_000


@dataclass(frozen=True)
class Frequency:
    """A parsed alias. ``micros`` for fixed widths, ``months`` for calendar ones."""

    kind: str  # fixed | week | month_end | month_start
    micros: int = 0
    months: int = 0
    week_end: int = 1
    #: Months of one period without a multiple, and the month (0 to 11) that a period begins in.
    natural: int = 1
    anchor: int = 0


def parse_frequency(alias: str) -> Frequency:
    """Frequency alias, with an optional whole multiple in front."""
    match = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", alias.strip())
    if match:
        count, unit, anchor = int(match.group(1) or 1), match.group(2), match.group(3)
        if count > 0:
            if unit in FIXED_MICROS and anchor is None:
                return Frequency("fixed", micros=count * FIXED_MICROS[unit])
            if unit == "W" and (anchor or "SUN") in WEEK_ENDS:
                return Frequency("week", micros=count * 7 * _DAY, week_end=WEEK_ENDS[anchor or "SUN"])
            for kind, table in (("month_end", END_MONTHS), ("month_start", START_MONTHS)):
                if unit in table and (anchor is None or (anchor in MONTHS and table[unit] > 1)):
                    natural = table[unit]
                    # An end alias names the last month of a period, a start alias the first.
                    month = MONTHS.index(anchor) + (kind == "month_end") if anchor else 0
                    return Frequency(kind, months=count * natural, natural=natural, anchor=month % natural)
    raise ValueError(
        f"time_freq {alias!r} is not a known frequency alias. Try one of: 'D' (daily), "
        "'h' (hourly), 'ME' (month-end)"
    )


def bin_label(time: Column, freq: Frequency, first: Column | None = None) -> Column:
    """Label of the bin ``time`` falls into.

    Days and shorter: bins open at midnight of the first day (``first``), closed left,
    labelled by their start. Month, quarter and year ends and weeks: labelled by their last
    day at midnight, and a time on that day still belongs to it. Quarters and years may be
    anchored to a month (``QS-DEC`` are the seasons), weeks to a day. ``first`` may be omitted
    when bins cannot depend on it.
    """
    if freq.kind == "fixed":
        origin = micros(F.to_date(first).cast("timestamp_ntz")) if first is not None else F.lit(0)
        return from_micros(micros(time) - F.pmod(micros(time) - origin, F.lit(freq.micros)))
    if freq.kind == "week":
        def last_day(t: Column) -> Column:
            ahead = F.pmod(F.lit(freq.week_end) - F.dayofweek(t), F.lit(7))
            return F.date_add(F.to_date(t), ahead.cast("int"))

        weeks = freq.micros // (7 * _DAY)
        if weeks == 1:
            return last_day(time).cast("timestamp_ntz")
        # Several weeks: bins are counted from the week of the first time.
        apart = F.date_diff(last_day(time), last_day(first))
        more = F.pmod(-apart, F.lit(7 * weeks))
        return F.date_add(last_day(time), more.cast("int")).cast("timestamp_ntz")
    month = F.year(time) * 12 + F.month(time) - 1
    start = F.lit(0)
    natural = freq.natural
    if freq.kind == "month_end":
        if first is not None:
            base = F.year(first) * 12 + F.month(first) - 1
            start = base - F.pmod(base - freq.anchor, F.lit(natural)) + (natural - 1)
        else:
            start = F.lit(freq.anchor + natural - 1)
        target = month + F.pmod(start - month, F.lit(freq.months))
        return F.last_day(_month_start(target)).cast("timestamp_ntz")
    if first is not None:
        base = F.year(first) * 12 + F.month(first) - 1
        start = base - F.pmod(base - freq.anchor, F.lit(natural))
    else:
        start = F.lit(freq.anchor)
    return _month_start(month - F.pmod(month - start, F.lit(freq.months))).cast("timestamp_ntz")


def _month_start(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def _needs_first(freq: Frequency) -> bool:
    if freq.kind == "fixed":
        return _DAY % freq.micros != 0
    if freq.kind == "week":
        return freq.micros != 7 * _DAY
    return freq.months != freq.natural


def _all_labels(low: Column, high: Column, freq: Frequency) -> Column:
    """Array with one entry per label from ``low`` to ``high``; see :func:`_as_label`."""
    if freq.micros:
        step = F.make_dt_interval(secs=F.lit(freq.micros / 1_000_000).cast("decimal(18,6)"))
        return F.sequence(low, high, step)
    step = F.make_ym_interval(F.lit(0), F.lit(freq.months))
    return F.sequence(F.trunc(low.cast("date"), "MM"), F.trunc(high.cast("date"), "MM"), step)


def _as_label(entry: Column, freq: Frequency) -> Column:
    """Exploded entry → label; month entries are first days until here."""
    return (F.last_day(entry) if freq.kind == "month_end" else entry).cast("timestamp_ntz")


def resample_time(
    grid: DataFrame,
    time_freq: str,
    variables: list[str],
    cell: list[str],
    fill_gaps: bool = True,
) -> DataFrame:
    """Mean per bin and cell. Missing values are skipped.

    Every bin between the first and last appears for every cell, empty ones as nulls, as a
    cube has no holes; ``fill_gaps=False`` returns only bins with data and saves the wider
    result. A grid without ``time`` is returned unchanged.

    Data rows and empty gap rows go through one grouping, so the data is shuffled once, as
    partial means; gap rows are made per distinct cell where that cell is.
    """
    if "time" not in grid.columns:
        parse_frequency(time_freq)
        return grid
    freq = parse_frequency(time_freq)
    types = {f.name: f.dataType for f in grid.schema}
    first = grid.agg(F.min("time")).scalar() if _needs_first(freq) else None
    binned = grid.where(F.col("time").isNotNull()).select(
        bin_label(F.col("time"), freq, first).alias("time"),
        *cell,
        *[nan_to_null(F.col(v), types[v]).alias(v) for v in variables],
    )
    averages = [F.avg(v).alias(v) for v in variables]
    if not fill_gaps:
        return binned.groupBy("time", *cell).agg(*averages)
    bounds = (
        grid.agg(F.min("time").alias("a"), F.max("time").alias("b"))
        .select(
            F.struct(
                bin_label(F.col("a"), freq, F.col("a")).alias("low"),
                bin_label(F.col("b"), freq, F.col("a")).alias("high"),
            ).alias("span")
        )
        .scalar()
    )
    gaps = grid.where(F.col("time").isNotNull()).select(*cell).distinct().select(
        F.explode(_all_labels(bounds["low"], bounds["high"], freq)).alias("_entry"), *cell
    ).select(
        _as_label(F.col("_entry"), freq).alias("time"),
        *cell,
        *[F.lit(None).cast(types[v]).alias(v) for v in variables],
    )
    return binned.unionByName(gaps).groupBy("time", *cell).agg(*averages)


def subset_axis(axis: DataFrame, low: float, high: float) -> DataFrame:
    """The part of an axis table (``<dim>, idx``) that a box leaves of it."""
    dim = next(c for c in axis.columns if c != "idx")
    return axis.where(F.col(dim).between(low, high))


def coarsen(
    grid: DataFrame,
    factor: int,
    variables: list[str],
    axes: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Block means over ``factor`` cells along lon and lat.

    Blocks follow the stored order of each axis from where the grid begins: the grid carries
    ``<dim>_idx`` columns, and ``axes`` may give the ``<dim>, idx`` tables of its axes, cut as
    the grid was (:func:`subset_axis`). Without a table an axis is what the cells have of it. A
    trailing partial block is trimmed. A block's coordinate is the mean of its axis values; with
    a table also of those that no cell has. The result keeps the block number as the new index.
    """
    if factor is None or factor < 1:
        raise ValueError("coarsening needs a whole factor of at least 1")
    lon, lat = find_horizontal(grid.columns)
    dims = [d for d in (lon, lat) if d is not None]
    others = [c for c in grid.columns if c not in dims and c not in variables
              and c not in {f"{d}_idx" for d in dims}]
    types = {f.name: f.dataType for f in grid.schema}
    out, blocks, keys = grid, {}, []
    for d in dims:
        idx = f"{d}_idx"
        if axes and d in axes:
            table = axes[d].select(d, F.col("idx").alias(idx))
            if idx not in out.columns:
                out = out.join(table, d)
        else:
            table = grid.groupBy(idx).agg(F.any_value(d).alias(d))
        span = table.agg(F.struct(F.min(idx).alias("low"), (F.max(idx) - F.min(idx) + 1).alias("size"))).scalar()
        place = F.col(idx) - span["low"]
        whole = (place >= 0) & (place < span["size"] - F.pmod(span["size"], F.lit(factor)))
        key = F.floor(place / factor).cast("long").alias(idx)
        out = out.where(whole)
        keys.append(key)
        blocks[d] = table.where(whole).groupBy(key).agg(F.avg(d).alias(d))
    result = out.groupBy(*others, *keys).agg(
        *[F.avg(nan_to_null(F.col(v), types[v])).alias(v) for v in variables]
    )
    for d in dims:
        result = result.join(blocks[d], f"{d}_idx")
    return result


def resample(
    grid: DataFrame,
    variables: list[str],
    time_freq: str | None = None,
    spatial_factor: int | None = None,
    fill_gaps: bool = True,
    axes: dict[str, DataFrame] | None = None,
    units: str | None = None,
    calendar: str | None = None,
) -> DataFrame:
    """Time first, then space; at least one must be asked for. Raw CF times are decoded."""
    if not time_freq and not spatial_factor:
        raise ValueError("give a time_freq, a spatial_factor or both")
    out = decoded_time(grid, units, calendar) if time_freq else grid
    if time_freq:
        cell = [c for c in grid.columns if c != "time" and c not in variables]
        out = resample_time(out, time_freq, variables, cell, fill_gaps)
    return coarsen(out, spatial_factor, variables, axes) if spatial_factor else out
