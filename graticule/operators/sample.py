"""Point sampling on grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.location import bbox_from_geojson
from graticule.session import cut_lineage, is_small


def point_of_aoi(geojson: Column, bbox: Column) -> Column:
    """Sample point of an area: a Point geometry (bare or in a Feature), else the box centre."""
    kind = F.coalesce(
        F.get_json_object(geojson, "$.geometry.type"), F.get_json_object(geojson, "$.type")
    )
    at = bbox_from_geojson(geojson)
    return F.when(
        kind == "Point", F.struct(at["w"].alias("lon"), at["s"].alias("lat"))
    ).when(
        bbox.isNotNull(),
        F.struct(((bbox["w"] + bbox["e"]) / 2).alias("lon"), ((bbox["s"] + bbox["n"]) / 2).alias("lat")),
    )


def nearest_index(coord: Column, origin: float, step: float, length: int) -> Column:
    """Index of the nearest cell on a regular axis; a tie takes the lower index.

    Points beyond the axis take its end cell.
    """
    raw = F.ceil((coord - origin) / step - 0.5).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(raw, F.lit(length - 1).cast("long")))


def sample_points(
    cells: DataFrame,
    points: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    variables: list[str],
) -> DataFrame:
    """Time series of the nearest cell for every point of a regular grid.

    ``points``: ``point_id, lon, lat, t0, t1`` (``t1`` inclusive); ``cells`` carry
    ``lat_idx, lon_idx, time``. The cell of a point is arithmetic, so this is one equi-join;
    few points (counted) are broadcast and the cells are not shuffled.
    """
    keyed = points.select(
        "point_id", "t0", "t1",
        nearest_index(F.col("lat"), *lat_axis).alias("lat_idx"),
        nearest_index(F.col("lon"), *lon_axis).alias("lon_idx"),
    )
    side = F.broadcast(keyed) if is_small(points, 100_000) else keyed
    return (
        cells.join(side, ["lat_idx", "lon_idx"])
        .where(F.col("time").between(F.col("t0"), F.col("t1")))
        .select("point_id", "lat_idx", "lon_idx", "time", *variables)
    )


def nearest_on_axis(points: DataFrame, axis: DataFrame, coord: str, dim: str, span: tuple[int, int]) -> DataFrame:
    """Nearest value of an irregular axis for every point; a tie takes the lower value.

    ``span`` bounds the coordinate in whole degrees. The axis is cut into one-degree
    buckets; each bucket also knows the closest values outside it, so a point needs only its
    own bucket, found by an equi-join. The bucket table has one row per degree.
    """
    low, high = span
    spark = points.sparkSession
    buckets = spark.range(low, high + 1).select(F.col("id").alias("_b"))
    per_bucket = axis.groupBy(F.floor(dim).cast("long").alias("_b")).agg(
        F.min(dim).alias("_lo"), F.max(dim).alias("_hi"),
        # A degree of one axis: the group is as long as the axis is fine, not the data.
        F.collect_set(dim).alias("_in"),
    )
    from pyspark.sql import Window

    along = Window.orderBy("_b")
    known = buckets.join(per_bucket, "_b", "left").select(
        "_b",
        F.array_compact(
            F.concat(
                F.coalesce("_in", F.array().cast("array<double>")),
                F.array(
                    F.last("_hi", True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
                    F.first("_lo", True).over(along.rowsBetween(1, Window.unboundedFollowing)),
                ),
            )
        ).alias("_near"),
    )
    at = F.greatest(F.lit(low).cast("long"), F.least(F.floor(coord).cast("long"), F.lit(high).cast("long")))
    best = F.array_min(
        F.transform("_near", lambda v: F.struct(F.abs(v - F.col(coord)).alias("d"), v.alias("v")))
    )["v"]
    return points.withColumn("_b", at).join(known, "_b", "left").select(
        *points.columns, best.alias(dim)
    )


def sample_points_irregular(
    cells: DataFrame, points: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame, variables: list[str]
) -> DataFrame:
    """As :func:`sample_points` for irregular axes given as value tables ``lat`` and ``lon``."""
    p = points.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    p = nearest_on_axis(p, lat_axis, "p_lat", "lat", (-90, 90))
    p = nearest_on_axis(p, lon_axis, "p_lon", "lon", (-180, 360))
    side = p.select("point_id", "t0", "t1", "lat", "lon")
    return (
        cells.join(F.broadcast(side) if is_small(points, 100_000) else side, ["lat", "lon"])
        .where(F.col("time").between(F.col("t0"), F.col("t1")))
        .select("point_id", "lat", "lon", "time", *variables)
    )


# -- scattered cells -------------------------------------------------------------------------

#: Halvings of the cube around the globe; the smallest tiles are about 80 km wide.
_LEVELS = 7
EARTH_KM = 6371.0088
#: Digits of the squared chord that count; beyond them lies the rounding of sines and cosines.
_DIGITS = 13


def _unit(lat: Column, lon: Column) -> list[Column]:
    """The point of the unit sphere; poles and the antimeridian are places like any other there."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _tile(xyz: list[Column], level: int) -> list[Column]:
    # The far ends of the cube belong to the last tiles.
    return [F.least(F.floor((c + 1.0) * float(2 ** (level - 1))), F.lit(2**level - 1)).cast("int") for c in xyz]


def nearest_scattered(points: DataFrame, cells: DataFrame, by: list[str] | None = None, levels: int = _LEVELS) -> DataFrame:
    """The nearest cell of each point among cells without regular axes, as in swaths.

    ``points``: ``point_id, lat, lon``; ``cells``: ``cell_id, lat, lon``; with ``by`` both have
    those columns too (a granule, say) and meet only within them. Gives ``point_id``, ``by``,
    ``cell_id`` and ``distance_km`` along the globe; equal distances, which are those with the same squared chord on the unit
    sphere to 13 digits, take the lower ``cell_id``. Points
    and cells without a place take no part. Exact, poles and antimeridian included.

    Occupied tiles form a tree of boxes around the cells. Points go down it by equi-joins on the parent tile; a
    tile is left out if even its nearest corner is farther than the farthest corner of another
    one, so each point holds a handful of tiles on each level, and meets only the cells of the last ones.
    """
    by = by or []
    axes = ("x", "y", "z")
    placed = cells.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("cell_id", *by, *[c.alias(a) for c, a in zip(_unit(F.col("lat"), F.col("lon")), axes, strict=True)])
    own = lambda level: [F.struct(*_tile([F.col(a) for a in axes], level)).alias("tile")]
    placed = cut_lineage(placed.withColumn("tile", own(levels)[0]), "scattered_cells")
    # Boxes of each level from those of the level below, the smallest from the cells.
    bounds = [F.min(a).alias(f"{a}0") for a in axes] + [F.max(a).alias(f"{a}1") for a in axes]
    again = [F.min(f"{a}0").alias(f"{a}0") for a in axes] + [F.max(f"{a}1").alias(f"{a}1") for a in axes]
    half = F.transform(F.array("tile.col1", "tile.col2", "tile.col3"), lambda t: F.floor(t / 2).cast("int"))
    parent = F.struct(half[0].alias("col1"), half[1].alias("col2"), half[2].alias("col3"))
    boxes = {levels: cut_lineage(placed.groupBy(*by, "tile").agg(*bounds).withColumn("parent", parent), "tiles")}
    for level in range(levels - 1, 0, -1):
        boxes[level] = cut_lineage(boxes[level + 1].groupBy(*by, F.col("parent").alias("tile")).agg(*again).withColumn("parent", parent), "tiles")
    p = [F.col(f"p{a}") for a in axes]
    asked = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "point_id", *by, *[c.alias(f"p{a}") for c, a in zip(_unit(F.col("lat"), F.col("lon")), axes, strict=True)])
    zero = F.lit(0).cast("int")
    open_tiles = asked.withColumn("tile", F.struct(zero.alias("col1"), zero.alias("col2"), zero.alias("col3")))
    square = lambda parts: reduce(lambda a, b: a + b, [d * d for d in parts])
    nearest = square([F.greatest(F.lit(0.0), F.col(f"{a}0") - c, c - F.col(f"{a}1")) for a, c in zip(axes, p, strict=True)])
    farthest = square([F.greatest(F.abs(F.col(f"{a}0") - c), F.abs(c - F.col(f"{a}1"))) for a, c in zip(axes, p, strict=True)])
    keys = ["point_id", *by, *[f"p{a}" for a in axes]]
    for level in range(1, levels + 1):
        met = open_tiles.withColumnRenamed("tile", "parent").join(boxes[level], [*by, "parent"]).select(*keys, "tile", nearest.alias("_near"), farthest.alias("_far"))
        bound = met.groupBy("point_id", *by).agg(F.min("_far").alias("_bound"))
        # A little slack, so rounding never drops the tile of the nearest cell.
        kept = met.join(bound, ["point_id", *by]).where(F.col("_near") <= F.col("_bound") + 1e-12).select(*keys, "tile")
        open_tiles = cut_lineage(kept, "open_tiles") if level % 3 == 0 else kept
    apart = square([F.col(a) - c for a, c in zip(axes, p, strict=True)])
    best = (open_tiles.join(placed, [*by, "tile"]).withColumn("_apart", apart)
            .groupBy("point_id", *by).agg(F.min(F.struct(F.round("_apart", _DIGITS).alias("_apart"), "cell_id")).alias("_best"), F.min("_apart").alias("_least")))
    distance = 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("_least") / 2))
    return best.select("point_id", *by, F.col("_best.cell_id").alias("cell_id"), distance.alias("distance_km"))


def sample_scattered(cells: DataFrame, points: DataFrame, variables: list[str]) -> DataFrame:
    """Time series of the nearest cell of each point on a grid whose places are tables themselves.

    ``cells``: ``cell_id, lat, lon, time`` and variables, a cell's place the same at all times;
    ``points``: ``point_id, lat, lon, t0, t1`` (``t1`` inclusive).
    """
    places = cells.groupBy("cell_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    near = nearest_scattered(points, places)
    asked = points.select("point_id", "t0", "t1").join(near, "point_id")
    return (cells.select("cell_id", "time", *variables).join(asked, "cell_id").where(F.col("time").between(F.col("t0"), F.col("t1")))
            .select("point_id", "cell_id", "distance_km", "time", *variables))
