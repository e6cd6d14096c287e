"""Axes: index tables, index ranges, geometry from metadata, dense cell grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.text import leaf_name
from graticule.session import BROADCAST_ROWS, by_shuffle

# Accepted axis names, in the order they are tried.
LON_NAMES = ("lon", "longitude", "x")
LAT_NAMES = ("lat", "latitude", "y")


def find_axis(columns: list[str], names: tuple[str, ...]) -> str | None:
    """Column whose whole name matches one of ``names``, case-insensitive."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def find_horizontal(columns: list[str]) -> tuple[str | None, str | None]:
    """``(lon, lat)`` column names, either may be missing but not both."""
    lon, lat = find_axis(columns, LON_NAMES), find_axis(columns, LAT_NAMES)
    if lon is None and lat is None:
        raise ValueError(
            f"no lon/lat dimension found (looked for {LON_NAMES + LAT_NAMES}, "
            f"case-insensitive, among {sorted(columns)})"
        )
    return lon, lat


# -- index tables ------------------------------------------------------------


def axis_values(grid: DataFrame, dim: str) -> DataFrame:
    """Distinct non-null values of one axis. Partial aggregation keeps the shuffle to at
    most one copy of the axis per input split."""
    return grid.where(F.col(dim).isNotNull()).select(dim).distinct()


def index_axis(values: DataFrame, dim: str, descending: bool = False, small: bool = False) -> DataFrame:
    """Distinct axis values → ``dim, idx`` with idx counted from 0 in axis order.

    A global rank without a global sort: values fall into buckets (one per hour, tenth of a
    unit or first letter), the bucket sizes give each bucket's offset, and ranks are taken
    inside buckets in parallel. Only the list of buckets passes one task. ``small`` says the
    caller has counted the axis and it is short enough to rank in one task.
    """
    if small:
        order = Window.orderBy(F.col(dim).desc() if descending else F.col(dim))
        return values.select(dim, (F.row_number().over(order) - 1).cast("long").alias("idx"))
    dtype = values.schema[dim].dataType
    bucket = (
        F.date_trunc("HOUR", dim) if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType))
        else F.substring(dim, 1, 1) if isinstance(dtype, T.StringType)
        else F.floor(F.col(dim) * 10)
    )
    v = values.withColumn("_bucket", bucket)
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        v.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("_bucket").orderBy(F.col(dim).desc() if descending else F.col(dim))
    return (
        v.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, "_bucket")
        .select(dim, (F.col("_rank") + F.col("_offset")).cast("long").alias("idx"))
    )


def dense_grid(axes: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """All cells of the grid spanned by indexed axes (``dim, idx`` tables).

    Cells are numbered, so ``spark.range`` spreads them evenly whatever the axes look like,
    and each axis is an equi-join on its index. An axis is broadcast only when its counted
    size is under the limit; a longer one is joined by shuffle.
    """
    dims = list(axes)
    spark = axes[dims[0]].sparkSession
    cells = spark.range(reduce(lambda a, d: a * sizes[d], dims, 1)).withColumnRenamed("id", "_cell")
    stride = 1
    for d in reversed(dims):
        idx = F.pmod(F.floor(F.col("_cell") / F.lit(stride)), F.lit(sizes[d])).cast("long")
        cells = cells.withColumn(f"_i_{d}", idx)
        stride *= sizes[d]
    for d in dims:
        side = axes[d].select(F.col("idx").alias(f"_i_{d}"), d)
        side = F.broadcast(side) if sizes[d] <= BROADCAST_ROWS else side
        cells = cells.join(side, f"_i_{d}")
    return cells.select(*dims)


# -- index ranges and geometry -------------------------------------------------


def index_range(origin: Column, step: Column, length: Column, low: Column, high: Column) -> Column:
    """Degree window → inclusive ``struct<low, high: bigint>`` of cell indexes.

    Floor and ceiling keep a cell that is only touched; the result is clamped to the axis
    and holds at least one cell. Works for descending axes; null for a malformed one.
    """
    a, b = (low - origin) / F.nullif(step, F.lit(0.0)), (high - origin) / F.nullif(step, F.lit(0.0))
    first = F.when(step > 0, a).otherwise(b)
    last = F.when(step > 0, b).otherwise(a)

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), length.cast("long") - 1))

    lo, hi = clamp(F.floor(first)), clamp(F.ceil(last))
    return F.when(
        (step != 0) & (length > 0),
        F.struct(lo.alias("low"), F.greatest(lo, hi).alias("high")),
    )


def longitude_index_range(
    origin: Column, step: Column, length: Column, west: Column, east: Column
) -> Column:
    """As :func:`index_range`; a box across the antimeridian takes all longitudes (null)."""
    return F.when(west <= east, index_range(origin, step, length, west, east))


def hyperslab(cells: DataFrame, axes: dict[str, tuple[float, float, int]], box: dict[str, tuple]) -> DataFrame:
    """Index-range subset of a regular grid stored with ``<dim>_idx`` columns.

    ``axes`` maps a dim to ``(origin, step, length)``, ``box`` to ``(low, high)``. The
    ranges are plain numbers, so the filters are pushed into the scan.
    """
    import math

    out = cells
    for dim, (low, high) in box.items():
        origin, step, length = axes[dim]
        if step == 0 or length <= 0 or (dim.lower() in LON_NAMES and low > high):
            continue
        a, b = (low - origin) / step, (high - origin) / step
        first, last = (a, b) if step > 0 else (b, a)
        lo = max(0, min(math.floor(first), length - 1))
        hi = max(lo, max(0, min(math.ceil(last), length - 1)))
        out = out.where(F.col(f"{dim}_idx").between(lo, hi))
    return out


def axis_geometry(edge_low: Column, edge_high: Column, length: Column) -> Column:
    """Outer edges and cell count → ``struct<origin, step, length>`` of cell centres.

    Null when the extent or length is missing or the step would be zero.
    """
    step = (edge_high - edge_low) / F.nullif(length.cast("double"), F.lit(0.0))
    return F.when(
        (step != 0) & (length != 0),
        F.struct(
            (edge_low + step / 2).alias("origin"), step.alias("step"), length.cast("long").alias("length")
        ),
    )


def discover_coordinates(variables: DataFrame) -> DataFrame:
    """Per collection the names of its coordinate variables.

    ``variables``: ``collection_id, pos, name, standard_name``. A variable is a coordinate
    by standard name or leaf name; latitude is tested before longitude before time, and the
    last match in list order wins. Defaults: ``lat``, ``lon``, no time.
    """
    std = F.lower(F.coalesce("standard_name", F.lit("")))
    leaf = leaf_name(F.coalesce("name", F.lit("")))
    role = (
        F.when((std == "latitude") | leaf.isin("lat", "latitude"), "lat")
        .when((std == "longitude") | leaf.isin("lon", "longitude"), "lon")
        .when((std == "time") | (leaf == "time"), "time")
    )
    v = variables.withColumn("_role", role)

    def last(kind: str) -> Column:
        return F.max_by(F.when(F.col("_role") == kind, F.col("name")),
                        F.when(F.col("_role") == kind, F.col("pos")))

    return v.groupBy("collection_id").agg(
        F.coalesce(last("lat"), F.lit("lat")).alias("coord_lat"),
        F.coalesce(last("lon"), F.lit("lon")).alias("coord_lon"),
        last("time").alias("coord_time"),
    )


def first_by_leaf(variables: DataFrame) -> DataFrame:
    """First variable in list order per ``(collection_id, leaf)`` with its dimensions."""
    return (
        variables.withColumn("leaf", leaf_name(F.coalesce("name", F.lit(""))))
        .groupBy("collection_id", "leaf")
        .agg(F.min_by("dimensions", "pos").alias("dimensions"))
    )


def own_dimension_length(dimensions: Column, leaf: Column) -> Column:
    """Size of a coordinate variable's dimension of its own name; null for 0 or none."""
    own = F.filter(dimensions, lambda d: leaf_name(F.coalesce(d["name"], F.lit(""))) == leaf)
    return F.nullif(F.try_element_at(own, F.lit(1))["size"], F.lit(0))


def axis_lengths(variables: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Adds ``lat_length, lon_length`` to ``coordinates``, from the coordinate variables.

    Variables meet the names of their collection and are grouped by it, on one partitioning; of
    those with the name asked for the first in list order counts.
    """
    leaf = leaf_name(F.coalesce("name", F.lit("")))
    lengths = variables.select(
        "collection_id", leaf.alias("leaf"), "pos", own_dimension_length(F.col("dimensions"), leaf).alias("n"))
    axis = {a: leaf_name(F.col(f"coord_{a}")).alias(f"_{a}") for a in ("lat", "lon")}
    named = lengths.join(by_shuffle(coordinates.select("collection_id", *axis.values())), "collection_id")
    found = named.groupBy("collection_id").agg(*[
        F.min_by("n", F.when(F.col("leaf") == F.col(f"_{a}"), F.col("pos"))).alias(f"{a}_length") for a in axis])
    return coordinates.join(by_shuffle(found), "collection_id", "left")


def collection_axes(extents: DataFrame, lengths: DataFrame) -> DataFrame:
    """Join extents (``collection_id, spatial_extent``) with axis lengths → both geometries.

    Either axis missing leaves both null: half a geometry cannot bracket a variable.
    """
    x = F.col("spatial_extent")
    g = lengths.join(by_shuffle(extents), "collection_id", "left").select(
        "collection_id", "coord_lat", "coord_lon", "coord_time",
        axis_geometry(x["s"], x["n"], F.col("lat_length")).alias("lat_axis"),
        axis_geometry(x["w"], x["e"], F.col("lon_length")).alias("lon_axis"),
    )
    both = F.col("lat_axis").isNotNull() & F.col("lon_axis").isNotNull()
    return g.withColumn("_both", both).select(
        "collection_id", "coord_lat", "coord_lon", "coord_time",
        F.when(F.col("_both"), F.col("lat_axis")).alias("lat_axis"),
        F.when(F.col("_both"), F.col("lon_axis")).alias("lon_axis"),
    )


def dimension_plan(dimensions: Column, lat_leaf: Column, lon_leaf: Column) -> Column:
    """A variable's ordered dims as ``array<struct<leaf, size>>``, or null.

    Spatial dims carry no size; every other dim needs one; both spatial dims must be there.
    """
    leaves = F.transform(
        dimensions,
        lambda d: F.struct(
            leaf_name(F.coalesce(d["name"], F.lit(""))).alias("leaf"),
            F.nullif(d["size"], F.lit(0)).alias("size"),
        ),
    )

    def spatial(d: Column) -> Column:
        return (d["leaf"] == lat_leaf) | (d["leaf"] == lon_leaf)

    usable = (
        F.exists(leaves, lambda d: d["leaf"] == lat_leaf)
        & F.exists(leaves, lambda d: d["leaf"] == lon_leaf)
        & F.forall(leaves, lambda d: spatial(d) | d["size"].isNotNull())
    )
    return F.when(
        usable,
        F.transform(
            leaves,
            lambda d: F.struct(
                d["leaf"].alias("leaf"), F.when(~spatial(d), d["size"]).alias("size")
            ),
        ),
    )
