"""Bulk request manifests: subset URLs, preview URLs, point tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions import text as tx
from graticule.operators.axes import dimension_plan, first_by_leaf, index_range, longitude_index_range
from graticule.session import by_shuffle

#: Granules taken into one subset request.
GRANULES_PER_REQUEST = 50

#: Most requests that go with one URL.
_IDS = 1_000

# Preview endpoint, image size, and the world box.
PREVIEW_ENDPOINT = "https://gibs.earthdata.nasa.gov/wms/epsg4326/best/wms.cgi"
PREVIEW_SIZE = 512
WORLD = (-180.0, -90.0, 180.0, 90.0)


# -- subset requests -----------------------------------------------------------------------


def _bracket(span: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("["), span["low"].cast("string"), F.lit(":"), span["high"].cast("string"), F.lit("]")),
        F.lit(""),
    )


def _variable_slices(plan: Column, lat_leaf: Column, lon_leaf: Column, lat: Column, lon: Column) -> Column:
    """One bracket per dimension in the variable's own order; none without a plan."""
    return F.coalesce(
        F.array_join(
            F.transform(
                plan,
                lambda d: F.when(d["leaf"] == lat_leaf, lat).when(d["leaf"] == lon_leaf, lon).otherwise(
                    F.coalesce(
                        F.concat(F.lit("[0:"), (d["size"] - 1).cast("string"), F.lit("]")), F.lit("")
                    )
                ),
            ),
            "",
        ),
        F.lit(""),
    )


def with_dimension_plans(requested: DataFrame, variables: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Add each requested variable's own dimension plan.

    ``requested``: ``request_id, pos, collection_id, resolved``; ``variables``:
    ``collection_id, pos, name, dimensions``; ``coordinates``: ``collection_id, coord_lat,
    coord_lon``.
    """
    dims = first_by_leaf(variables)
    keyed = requested.withColumn("leaf", tx.leaf_name(F.col("resolved")))
    return (
        keyed.join(by_shuffle(dims), ["collection_id", "leaf"], "left")
        .join(by_shuffle(coordinates.select("collection_id", "coord_lat", "coord_lon")), "collection_id", "left")
        .withColumn(
            "dim_plan",
            dimension_plan(
                F.col("dimensions"), tx.leaf_name(F.col("coord_lat")), tx.leaf_name(F.col("coord_lon"))
            ),
        )
        .drop("leaf", "dimensions", "coord_lat", "coord_lon")
    )


def constraint_expressions(requests: DataFrame) -> DataFrame:
    """Adds ``constraint`` to request rows.

    ``requests``: ``needs_bbox, bbox STRUCT<w,s,e,n>, output_shape, coord_lat, coord_lon,
    coord_time, lat_axis, lon_axis STRUCT<origin, step, length>, variables ARRAY<STRUCT<
    name, dim_plan>>``. The list is lat, lon, time, then variables, each once, as absolute
    names joined by ``;``. With a box and both axes of a grid, coordinates and planned
    variables are cut to index ranges; a box across the antimeridian keeps all longitudes;
    a variable without a plan is taken whole. Without variables the expression is empty, which
    asks for the whole file; a request with an ``ambiguous`` name (a boolean column) has none
    and the status ``ambiguous``.
    """
    c = F.col
    sliced = (
        c("needs_bbox") & (c("output_shape") == "grid") & c("lat_axis").isNotNull()
        & c("lon_axis").isNotNull() & c("bbox").isNotNull()
    )
    lat = F.when(sliced, index_range(
        c("lat_axis.origin"), c("lat_axis.step"), c("lat_axis.length"), c("bbox.s"), c("bbox.n")))
    lon = F.when(sliced, longitude_index_range(
        c("lon_axis.origin"), c("lon_axis.step"), c("lon_axis.length"), c("bbox.w"), c("bbox.e")))
    r = requests.withColumns({"_lat": _bracket(lat), "_lon": _bracket(lon)})
    lat_leaf, lon_leaf = tx.leaf_name(c("coord_lat")), tx.leaf_name(c("coord_lon"))
    gridded = (c("output_shape") == "grid") & c("lat_axis").isNotNull() & c("lon_axis").isNotNull()

    def item(name: Column, cut: Column) -> Column:
        return F.struct(name.alias("name"), cut.alias("cut"))

    none = F.array().cast("array<struct<name:string,cut:string>>")
    spatial = F.when(
        c("needs_bbox"), F.array(item(c("coord_lat"), c("_lat")), item(c("coord_lon"), c("_lon")))
    ).otherwise(none)
    temporal = F.when(c("coord_time").isNotNull(), F.array(item(c("coord_time"), F.lit("")))).otherwise(none)
    wanted = F.transform(
        "variables",
        lambda v: item(
            v["name"],
            F.when(
                c("needs_bbox") & gridded,
                _variable_slices(v["dim_plan"], lat_leaf, lon_leaf, c("_lat"), c("_lon")),
            ).otherwise(F.lit("")),
        ),
    )
    r = r.withColumn("_items", F.concat(spatial, temporal, wanted))
    ambiguous = F.coalesce(c("ambiguous"), F.lit(False)) if "ambiguous" in requests.columns else F.lit(False)
    names = F.transform("_items", lambda x: x["name"])
    once = F.filter("_items", lambda x, i: F.array_position(names, x["name"]) == i + 1)
    parts = F.transform(once, lambda x: F.concat(tx.qualified_name(x["name"]), x["cut"]))
    return r.withColumn(
        "constraint",
        F.when(ambiguous, F.lit(None).cast("string"))
        .when(F.size("variables") > 0, F.array_join(parts, ";")).otherwise(""),
    ).withColumn("status", F.when(ambiguous, "ambiguous").otherwise("ok")).drop("_lat", "_lon", "_items")


def subset_query(constraint: Column) -> Column:
    """Constraint → what stands behind a granule's endpoint in a request URL; null without a known constraint."""
    return F.when(constraint == "", F.lit(".dap.nc4")).otherwise(F.concat(F.lit(".dap.nc4?dap4.ce="), tx.percent_encode(constraint)))


def subset_url(base: Column, constraint: Column) -> Column:
    """Granule endpoint and constraint → request URL; no constraint known gives no URL."""
    return F.concat(base, subset_query(constraint))


def subset_manifest(constrained: DataFrame, granules: DataFrame, by: str = "request_id") -> DataFrame:
    """One row per request and granule with its URL and file name.

    ``constrained``: ``request_id, constraint, status``, at most one row each; ``granules``:
    all granules of a request with ``request_id, rank, granule_ur, access_url``. ``batch``
    numbers the retrievals of at most 50 granules. Granules without an endpoint give no row;
    those of a request whose status is not ``ok`` have no URL. Where requests share their granules,
    ``by`` names the column of both tables that says whose. If granules were ranked by that column they
    are not shuffled again, and a URL is made once for the sharing requests with the same constraint.
    """
    g = granules.where(F.col("access_url").isNotNull()).select(
        by, "rank", F.floor((F.col("rank") - 1) / GRANULES_PER_REQUEST).alias("batch"), "granule_ur", "access_url")
    asked = constrained.select(F.col(by).alias("_by"), "request_id", "status", subset_query(F.col("constraint")).alias("_query"))
    same = ("_by", "status", "_query")
    place = F.row_number().over(Window.partitionBy(*same).orderBy("request_id"))
    alike = asked.withColumn("_list", F.floor((place - 1) / _IDS)).groupBy(*same, "_list").agg(F.collect_list("request_id").alias("_ids"))
    # The file name does not depend on what is behind the question mark.
    name = F.when(F.col("_query").isNotNull(), tx.file_name_from_url(subset_url(F.col("access_url"), F.lit(""))))
    made = g.join(by_shuffle(alike), F.col(by) == F.col("_by")).select(
        "_ids", "rank", "batch", "granule_ur", "status", F.concat("access_url", "_query").alias("url"), name.alias("file_name"))
    return made.select(F.explode("_ids").alias("request_id"), "rank", "batch", "granule_ur", "status", "url", "file_name")


# -- previews --------------------------------------------------------------------------------


def preview_box(aoi: Column, extent: Column) -> Column:
    """Area of interest, else collection extent, else the world."""
    w, s, e, n = (F.lit(x) for x in WORLD)
    world = F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))
    return F.coalesce(aoi, extent, world)


def preview_manifest(requests: DataFrame) -> DataFrame:
    """Preview rows → layer, where it came from, box, date and image URL.

    ``requests``: ``request_id, explicit_layer, payload_layer, tag_layer, short_name, aoi,
    extent`` (boxes as ``w,s,e,n`` structs or null) and ``time_range``. The first layer known
    wins; the short name is a guess. Without any layer the URL is null.
    """
    c = F.col
    tag, short = F.nullif(c("tag_layer"), F.lit("")), F.nullif(c("short_name"), F.lit(""))
    layer = F.coalesce("explicit_layer", "payload_layer", tag, short)
    source = (
        F.when(c("explicit_layer").isNotNull(), "explicit")
        .when(c("payload_layer").isNotNull(), "handle_payload")
        .when(tag.isNotNull(), "cmr_tags")
        .otherwise("short_name_guess")
    )
    r = requests.withColumns({
        "layer": F.nullif(layer, F.lit("")), "lookup_source": source,
        "_box": preview_box(c("aoi"), c("extent")), "time": tx.start_date(c("time_range")),
    })
    # Number texts are made once and used in both the box and the URL.
    r = r.withColumns({f"_{x}": tx.plain_number(c(f"_box.{x}")) for x in ("w", "s", "e", "n")})
    corner = lambda sep, *k: F.concat_ws(sep, *[c(f"_{x}") for x in k])
    query = F.concat(
        F.lit("SERVICE=WMS&REQUEST=GetMap&VERSION=1.3.0&LAYERS="), tx.form_encode(c("layer")),
        F.lit("&CRS=EPSG%3A4326&BBOX="), corner("%2C", "s", "w", "n", "e"),
        F.lit(f"&WIDTH={PREVIEW_SIZE}&HEIGHT={PREVIEW_SIZE}&FORMAT=image%2Fpng"),
        F.coalesce(F.concat(F.lit("&TIME="), tx.form_encode(F.nullif(c("time"), F.lit("")))), F.lit("")),
    )
    return r.select(
        "request_id", "layer", "lookup_source",
        (c("lookup_source") == "short_name_guess").alias("layer_is_guess"),
        corner(",", "w", "s", "e", "n").alias("bbox"), "time",
        F.concat(F.lit(PREVIEW_ENDPOINT + "?"), query).alias("url"),
    )


# -- point tasks -------------------------------------------------------------------------------


def point_tasks(requests: DataFrame) -> DataFrame:
    """Point-sample rows → task JSON.

    ``requests``: ``request_id, short_name, version, lat, lon, layers ARRAY<STRING>, start,
    end`` (both null for no dates).
    """
    version = F.nullif("version", F.lit(""))
    product = F.concat("short_name", F.coalesce(F.concat(F.lit("."), version), F.lit("")))
    r = requests.withColumn("product", product)
    dates = F.when(
        F.col("start").isNotNull(),
        F.array(F.struct(tx.us_date(F.col("start")).alias("startDate"), tx.us_date(F.col("end")).alias("endDate"))),
    )
    site = F.struct(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.lit("0").alias("id"), F.lit("site").alias("category"),
    )
    layers = F.transform(
        "layers", lambda x: F.struct(F.col("product").alias("product"), x.alias("layer"))
    )
    body = F.struct(
        F.lit("point").alias("task_type"),
        F.concat(F.lit("graticule "), F.col("product")).alias("task_name"),
        F.struct(F.array(site).alias("coordinates"), layers.alias("layers"), dates.alias("dates")).alias("params"),
    )
    return r.select("request_id", "product", F.to_json(body).alias("task"))
