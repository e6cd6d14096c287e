"""Request routing: service matching, paths and explanations, name resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.text import layer_key, leaf_name
from graticule.session import by_shuffle
from graticule.sources.metadata import NEEDS

def _unmet(service: Column) -> Column:
    """First need of the request a service lacks, in fixed order; null when it fits."""
    chain = reduce(
        lambda acc, need: acc.when(F.col(f"needs_{need}") & ~service[need], need)
        if acc is not None
        else F.when(F.col(f"needs_{need}") & ~service[need], need),
        NEEDS,
        None,
    )
    return chain.when(~F.array_contains(service["output_formats"], F.col("output_format")), "output_format")


def match_services(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Join each request with its collection and the first service that fits it whole.

    ``requests``: ``request_id, collection_id, needs_*, needs_point_sample, output_format``;
    ``capabilities``: as :func:`merge_capabilities`, keyed ``concept_id``. Adds ``service``
    (a struct, null when no single service fits) and the collection's fields. The services
    of a collection are one short array from one document, so choosing is a column
    expression after one equi-join.
    """
    caps = capabilities.withColumnRenamed("concept_id", "collection_id")
    joined = requests.join(caps, "collection_id", "left")
    services = F.coalesce("services", F.array().cast(capabilities.schema["services"].dataType))
    joined = joined.withColumn("services", services)
    return joined.withColumn(
        "service",
        F.try_element_at(F.filter("services", lambda s: _unmet(s).isNull()), F.lit(1)),
    )


def _any_need(*needs: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"needs_{n}") for n in needs])


def route_requests(
    matched: DataFrame,
    direct_enabled: bool = False,
    region: str | None = None,
    service_available: bool = True,
    point_available: bool = True,
    subset_available: bool = True,
) -> DataFrame:
    """One path per request: ``appeears``, ``direct``, ``harmony``, ``opendap`` or null.

    In order: a point sample; data as it is, readable directly in this region; the
    transform service, pinned when one of its services fits; and only when that service is
    not available at all, a fitting service, then a plain subset of a grid or swath to
    netCDF where the request has access URLs (``has_urls``). Null means nothing can serve it.
    """
    as_is = ~_any_need(*NEEDS)
    here = (region or "").strip().lower()
    direct = (
        F.lit(direct_enabled)
        & as_is
        & F.coalesce("direct_access", F.lit(False))
        & (F.coalesce(F.lower(F.trim("direct_region")), F.lit("")) == here)
        & F.lit(bool(here))
    )
    subset = (
        F.lit(subset_available)
        & F.col("has_urls")
        & ~F.col("needs_point_sample")
        & F.coalesce("output_shape", F.lit("grid")).isin("grid", "swath")
        & _any_need("variable", "bbox", "temporal")
        & F.contains(F.lower("output_format"), F.lit("netcdf"))
    )
    route = (
        F.when(F.lit(point_available) & F.col("needs_point_sample"), "appeears")
        .when(direct, "direct")
        .when(F.lit(service_available) | F.col("service").isNotNull(), "harmony")
        .when(subset, "opendap")
    )
    return matched.withColumn("route", route)


def explain_routes(routed: DataFrame) -> DataFrame:
    """Why a request took its route: pinned service and met needs, or what each service lacks.

    ``reason`` is ``pinned``, ``no_registered_services`` or ``no_single_service_satisfies``
    for the transform service, ``point_sample_intent`` and ``data_as_is_in_region`` for the
    two shortcuts, ``harmony_not_wired`` for the subset path, ``not_retrievable`` else.
    """
    met = F.array_compact(
        F.array(*[F.when(F.col(f"needs_{n}"), n) for n in NEEDS], F.lit("output_format"))
    )
    on_service = F.col("route") == "harmony"
    pinned = on_service & F.col("service").isNotNull()
    unmet = F.transform(
        "services",
        lambda s: F.struct(s["service_name"].alias("service_name"), _unmet(s).alias("first_unmet_need")),
    )
    return routed.select(
        "request_id", "collection_id", "route",
        F.when(pinned, F.col("service.service_name")).alias("pinned_service"),
        F.when(pinned, F.col("service.service_id")).alias("pinned_id"),
        F.when(pinned, met).alias("satisfied_needs"),
        F.when(F.col("route") == "appeears", "point_sample_intent")
        .when(F.col("route") == "direct", "data_as_is_in_region")
        .when(pinned, "pinned")
        .when(on_service & (F.size("services") == 0), "no_registered_services")
        .when(on_service, "no_single_service_satisfies")
        .when(F.col("route") == "opendap", "harmony_not_wired")
        .otherwise("not_retrievable").alias("reason"),
        F.when(~pinned & ~F.col("route").isin("appeears", "direct") | F.col("route").isNull(), unmet).alias("unmet"),
    )


# -- names -----------------------------------------------------------------------------


def resolve_paths(requested: DataFrame, variables: DataFrame) -> DataFrame:
    """Requested variable names → full paths in their collection.

    ``requested``: ``request_id, pos, collection_id, variable``; ``variables``:
    ``collection_id, name``. A leading slash passes through; else the leaf name must match
    exactly one variable (status ``ok``); none leaves the name (``unmatched``); several are
    an ``ambiguous`` error, listed by :func:`ambiguous_paths`.
    """
    by_leaf = (
        variables.select("collection_id", "name", leaf_name(F.col("name")).alias("leaf"))
        .groupBy("collection_id", "leaf")
        .agg(F.count(F.lit(1)).alias("n_paths"), F.min("name").alias("path"))
    )
    keyed = requested.withColumn("leaf", F.lower("variable"))
    full = F.startswith("variable", F.lit("/"))
    n = F.coalesce("n_paths", F.lit(0))
    return keyed.join(by_shuffle(by_leaf), ["collection_id", "leaf"], "left").select(
        "request_id", "pos", "collection_id", "variable",
        F.when(full | (n == 0), F.col("variable")).when(n == 1, F.col("path")).alias("resolved"),
        F.when(full, "full_path").when(n == 0, "unmatched").when(n == 1, "ok")
        .otherwise("ambiguous").alias("status"),
        F.when(full, 0).otherwise(n).cast("long").alias("n_paths"),
    )


def ambiguous_paths(resolved: DataFrame, variables: DataFrame) -> DataFrame:
    """Every path an ambiguous name could mean, one row each."""
    keyed = resolved.where(F.col("status") == "ambiguous").select(
        "request_id", "collection_id", "variable", F.lower("variable").alias("leaf")
    )
    paths = variables.select("collection_id", leaf_name(F.col("name")).alias("leaf"), F.col("name").alias("path"))
    return keyed.join(by_shuffle(paths), ["collection_id", "leaf"]).select("request_id", "collection_id", "variable", "path")


def match_layers(requested: DataFrame, layers: DataFrame) -> DataFrame:
    """Variable names → layer names of their product, compared in a common form.

    ``requested``: ``request_id, product, variable``; ``layers``: ``product, layer, pos``.
    Of layers with the same form the last listed wins. Unmatched names get status
    ``no_layer``; :func:`available_layers` lists what there is.
    """
    by_key = (
        layers.withColumn("_key", layer_key(F.col("layer")))
        .groupBy("product", "_key").agg(F.max_by("layer", "pos").alias("layer"))
    )
    keyed = requested.withColumn("_key", layer_key(F.col("variable")))
    matched = keyed.join(by_key, ["product", "_key"], "left")
    return matched.select(
        "request_id", "product", "variable", "layer",
        F.when(F.col("layer").isNull(), "no_layer").otherwise("ok").alias("status"),
    )


def available_layers(matched: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers of the products that had an unmatched name, one row each."""
    wanting = matched.where(F.col("status") == "no_layer").select("product").distinct()
    return layers.select("product", "layer").distinct().join(wanting, "product", "left_semi")
