"""Quality rules for stored values: masking, unpacking, widening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = Column | float | int | None


def _column(value: Value) -> Column | None:
    if value is None or isinstance(value, Column):
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    return F.lit(value)


def quality_mask(
    stored: Column,
    fill: Value = None,
    missing: Value = None,
    valid_min: Value = None,
    valid_max: Value = None,
    valid_range: tuple | list | None = None,
) -> Column:
    """``stored`` where it is real data, else null.

    A value must differ from ``fill`` and ``missing`` (NaN markers are skipped) and lie in
    the inclusive valid range. A two-value ``valid_range`` replaces the separate limits.
    Limits may be numbers or columns; a null limit does not restrict.
    """
    if valid_range is not None and len(valid_range) == 2:
        valid_min, valid_max = valid_range
    ok = F.lit(True)
    for marker in (_column(fill), _column(missing)):
        if marker is not None:
            ok = ok & F.coalesce(F.isnan(marker.cast("double")) | (stored != marker), F.lit(True))
    low, high = _column(valid_min), _column(valid_max)
    if low is not None:
        ok = ok & F.coalesce(stored >= low, F.lit(True))
    if high is not None:
        # NaN counts as larger than any number in Spark, so it falls out here too.
        ok = ok & F.coalesce(stored <= high, F.lit(True))
    return F.when(ok, stored)


def unpack(stored: Column, scale: Value = None, offset: Value = None, fill: Value = None) -> Column:
    """Packed value → physical value: fill becomes null, then scale, then offset."""
    marker, factor, shift = _column(fill), _column(scale), _column(offset)
    value = stored.cast("double")
    if factor is not None:
        value = value * F.coalesce(factor.cast("double"), F.lit(1.0))
    if shift is not None:
        value = value + F.coalesce(shift.cast("double"), F.lit(0.0))
    if marker is None:
        return value
    return F.when(F.coalesce(stored != marker, F.lit(True)), value)


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """NaN → null for float columns; other types unchanged."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def widened_type(dtype: T.DataType) -> T.DataType | None:
    """Float type an integer variable takes before alignment; None when it stays."""
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return T.FloatType()
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return T.DoubleType()
    return None
