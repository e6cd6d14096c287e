"""Subsetting and per-cell rules on long-form grids and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.quality import nan_to_null, quality_mask, unpack, widened_type
from graticule.functions.temporal import decode_cf_time, time_bounds
from graticule.operators.axes import find_axis, find_horizontal
from graticule.session import by_shuffle, is_small, spread_out

INDEX_SUFFIX = "_idx"


# -- names -------------------------------------------------------------------


def resolve_variables(available: list[str], requested: list[str]) -> list[str]:
    """Requested names → column names: as given, else the group path joined by ``__``.

    All unknown names are reported in one error.
    """
    def match(name: str) -> str | None:
        flat = name.strip("/").replace("/", "__")
        return name if name in available else flat if flat in available else None

    found = {name: match(name) for name in requested}
    unknown = [name for name, column in found.items() if column is None]
    if unknown:
        raise ValueError(
            f"unknown variable(s) {unknown!r}; available variables are {sorted(available)!r}"
        )
    return [found[name] for name in requested]


def subset_variables(grid: DataFrame, variables: list[str], dims: list[str]) -> DataFrame:
    """Keep the axes and the named variables; the scan reads no other column."""
    kept = resolve_variables(grid.columns, variables)
    axes = [c for c in grid.columns if c in dims or c in {d + INDEX_SUFFIX for d in dims}]
    return grid.select(*axes, *[c for c in kept if c not in axes])


def subset_table(table: DataFrame, variables: list[str] | None) -> DataFrame:
    """Column selection only; a table has no known place or time columns."""
    return table.select(*variables) if variables else table


def flatten_group(grid: DataFrame, group_path: str, dims: list[str]) -> DataFrame:
    """Prefix a group's variables with ``path__``; axes and root names stay."""
    prefix = group_path.strip("/").replace("/", "__")
    if not prefix:
        return grid
    fixed = set(dims) | {d + INDEX_SUFFIX for d in dims}
    return grid.withColumnsRenamed({c: f"{prefix}__{c}" for c in grid.columns if c not in fixed})


# -- place and time ------------------------------------------------------------


def bbox_condition(lon: str | None, lat: str | None, bbox: tuple, wrap: bool = False) -> Column:
    """Inclusive box test on whichever axes exist.

    West beyond east selects nothing, unless ``wrap`` asks for the box across the
    antimeridian. Storage order of either axis does not matter.
    """
    west, south, east, north = (float(x) for x in bbox)
    keep = F.lit(True)
    if lon is not None:
        keep = (
            (F.col(lon) >= west) | (F.col(lon) <= east) if wrap and west > east
            else F.col(lon).between(west, east)
        )
    if lat is not None:
        inside = F.col(lat).between(south, north)
        keep = inside if lon is None else keep & inside
    return keep


def subset_bbox(grid: DataFrame, bbox: tuple, wrap: bool = False) -> DataFrame:
    """Cells inside ``(W, S, E, N)``; the comparison reaches the Parquet scan."""
    lon, lat = find_horizontal(grid.columns)
    return grid.where(bbox_condition(lon, lat, bbox, wrap))


def decoded_time(grid: DataFrame, units: str | None, calendar: str | None = None) -> DataFrame:
    """The grid with numbers in ``time`` decoded by their CF units; instants stay as they are."""
    if "time" not in grid.columns or not isinstance(grid.schema["time"].dataType, T.NumericType):
        return grid
    if units is None:
        raise ValueError("time holds numbers; give their units, like 'seconds since 2020-01-01'")
    return grid.withColumn("time", decode_cf_time(F.col("time"), F.lit(units), None if calendar is None else F.lit(calendar)))


def subset_time(
    grid: DataFrame,
    time_range: str,
    has_time_dim: bool | None = None,
    units: str | None = None,
    calendar: str | None = None,
) -> DataFrame:
    """Cells inside ``start/end``; an end date covers its whole day (month, year).

    A grid without a time dimension is returned unchanged; one with a time dimension but
    no time values cannot be subset. Raw CF times are decoded first.
    """
    grid = decoded_time(grid, units, calendar)
    if has_time_dim is None:
        has_time_dim = any(c in grid.columns for c in ("time", "time" + INDEX_SUFFIX))
    if not has_time_dim:
        return grid
    if "time" not in grid.columns:
        raise ValueError("the time dimension has no values; cannot select a time range")
    low, high = time_bounds(time_range)
    # Typed literals: on a timestamp_ntz column the comparison needs no cast, so it is pushed.
    if low is not None:
        grid = grid.where(F.col("time") >= F.lit(low.isoformat(sep=" ")).cast("timestamp_ntz"))
    if high is not None:
        grid = grid.where(F.col("time") < F.lit(high.isoformat(sep=" ")).cast("timestamp_ntz"))
    return grid


def subset(
    grid: DataFrame,
    dims: list[str],
    bbox: tuple | None = None,
    variables: list[str] | None = None,
    time_range: str | None = None,
    units: str | None = None,
    calendar: str | None = None,
) -> DataFrame:
    """Variables, then box, then time; each part optional."""
    if variables:
        grid = subset_variables(grid, variables, dims)
    if bbox is not None:
        grid = subset_bbox(grid, bbox)
    return subset_time(grid, time_range, units=units, calendar=calendar) if time_range else grid


def subset_by_requests(cells: DataFrame, requests: DataFrame, tile: float = 5.0) -> DataFrame:
    """Box and time subset for many requests at once → cells with ``request_id``.

    ``requests``: ``request_id, w, s, e, n, t_low, t_high`` (``t_high`` exclusive, time
    limits may be null). Requests are spread over lat/lon tiles and meet the cells by an
    equi-join on the tile; every cell lies in one tile, so no pair appears twice. Requests stay
    dealt over tasks where the cells are few (counted), else both sides meet by shuffle; copies of
    requests are never held whole in one task.
    """
    lon, lat = find_horizontal(cells.columns)
    if lon is None or lat is None:
        raise ValueError("subsetting by requests needs both a lon and a lat axis")

    def tiles(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor(F.col(high) / tile)))

    spread = (
        spread_out(requests.where((F.col("w") <= F.col("e")) & (F.col("s") <= F.col("n"))))
        .withColumn("_tx", tiles("w", "e")).withColumn("_ty", tiles("s", "n"))
    )
    keyed = cells.withColumn("_tx", F.floor(F.col(lon) / tile)).withColumn(
        "_ty", F.floor(F.col(lat) / tile)
    )
    inside = F.col(lon).between(F.col("w"), F.col("e")) & F.col(lat).between(F.col("s"), F.col("n"))
    if "time" in cells.columns:
        inside = (
            inside
            & (F.col("t_low").isNull() | (F.col("time") >= F.col("t_low")))
            & (F.col("t_high").isNull() | (F.col("time") < F.col("t_high")))
        )
    met = spread.join(F.broadcast(keyed), ["_tx", "_ty"]) if is_small(cells) else keyed.join(by_shuffle(spread), ["_tx", "_ty"])
    return met.where(inside).select("request_id", *cells.columns)


# -- values --------------------------------------------------------------------


def mask_variables(grid: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Apply :func:`quality_mask` to the named variables of a wide grid."""
    return grid.withColumns({v: quality_mask(F.col(v), **rule) for v, rule in rules.items()})


def unpack_long(cells: DataFrame, variables: DataFrame) -> DataFrame:
    """Mask and unpack ``(variable, value)`` rows with the facts of a variables table.

    ``variables``: ``name, scale, offset, fill, valid_min, valid_max``. The table is small
    metadata joined on the name; Spark broadcasts it by its size. Valid limits apply to the
    stored number, so masking comes first.
    """
    v = variables.withColumnRenamed("name", "variable")
    kept = quality_mask(
        F.col("value"), fill=F.col("fill"), valid_min=F.col("valid_min"), valid_max=F.col("valid_max")
    )
    return cells.join(v, "variable", "left").select(
        *[c for c in cells.columns if c != "value"],
        unpack(kept, F.col("scale"), F.col("offset")).alias("value"),
    )


def widen_integers(grid: DataFrame, dims: list[str]) -> DataFrame:
    """Integer variables → float types that can hold a gap; axes stay as they are."""
    fixed = set(dims) | {d + INDEX_SUFFIX for d in dims}
    casts = {
        f.name: F.col(f.name).cast(widened_type(f.dataType))
        for f in grid.schema
        if f.name not in fixed and widened_type(f.dataType) is not None
    }
    return grid.withColumns(casts) if casts else grid


def missing_to_null(grid: DataFrame, dims: list[str]) -> DataFrame:
    """NaN → null in every float variable, as grids use NaN for a missing cell."""
    return grid.withColumns({
        f.name: nan_to_null(F.col(f.name), f.dataType)
        for f in grid.schema
        if f.name not in dims and isinstance(f.dataType, (T.FloatType, T.DoubleType))
    })


def tag_crs(grid: DataFrame, crs: str, dims: list[str]) -> DataFrame:
    """Record a target CRS on every variable; values do not change.

    The tag is column metadata, which Parquet keeps.
    """
    if find_axis(grid.columns, ("lon", "longitude", "x")) is None and find_axis(
        grid.columns, ("lat", "latitude", "y")
    ) is None:
        raise ValueError("reprojection needs a grid; this table has no lon/lat axis")
    fixed = set(dims) | {d + INDEX_SUFFIX for d in dims}
    return grid.select(*[
        F.col(f.name) if f.name in fixed
        else F.col(f.name).alias(f.name, metadata={**f.metadata, "crs": crs, "spatial_ref": crs})
        for f in grid.schema
    ])
