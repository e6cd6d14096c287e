"""Catalog records in JSON → typed tables. Input: one record per row in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URLS = "ARRAY<STRUCT<URL: STRING, Type: STRING, Subtype: STRING>>"

GRANULE_SCHEMA = f"""
meta STRUCT<`concept-id`: STRING>,
umm STRUCT<
  GranuleUR: STRING, RelatedUrls: {_URLS}, CloudCover: DOUBLE,
  DataGranule: STRUCT<DayNightFlag: STRING, ArchiveAndDistributionInformation:
    ARRAY<STRUCT<SizeInBytes: DOUBLE, Size: STRING, SizeUnit: STRING>>>>
"""

COLLECTION_SCHEMA = """
meta STRUCT<`concept-id`: STRING, `provider-id`: STRING, `revision-id`: BIGINT,
  associations: STRUCT<variables: ARRAY<STRING>, services: ARRAY<STRING>, citations: ARRAY<STRING>>>,
umm STRUCT<
  ShortName: STRING, Version: STRING, EntryTitle: STRING, Abstract: STRING,
  ProcessingLevel: STRUCT<Id: STRING>,
  DOI: STRUCT<DOI: STRING, Authority: STRING>,
  CollectionCitations: STRING, ScienceKeywords: STRING, TemporalExtents: STRING,
  ArchiveAndDistributionInformation: STRUCT<FileDistributionInformation:
    ARRAY<STRUCT<Format: STRING, Media: STRING>>>,
  DirectDistributionInformation: STRUCT<Region: STRING,
    S3BucketAndObjectPrefixNames: ARRAY<STRING>, S3CredentialsAPIEndpoint: STRING>,
  StandardProduct: BOOLEAN, Purpose: STRING, CollectionProgress: STRING,
  SpatialExtent: STRUCT<HorizontalSpatialDomain: STRUCT<Geometry: STRUCT<
    BoundingRectangles: ARRAY<STRUCT<
      WestBoundingCoordinate: DOUBLE, SouthBoundingCoordinate: DOUBLE,
      EastBoundingCoordinate: DOUBLE, NorthBoundingCoordinate: DOUBLE>>,
    GPolygons: ARRAY<STRUCT<Boundary: STRUCT<Points: ARRAY<STRUCT<
      Longitude: DOUBLE, Latitude: DOUBLE>>>>>>>>>
"""

VARIABLE_SCHEMA = """
meta STRUCT<`concept-id`: STRING>,
umm STRUCT<
  Name: STRING, LongName: STRING, Definition: STRING, DataType: STRING, Units: STRING,
  Scale: DOUBLE, Offset: DOUBLE,
  FillValues: ARRAY<STRUCT<Value: DOUBLE, Type: STRING>>,
  ValidRanges: ARRAY<STRUCT<Min: DOUBLE, Max: DOUBLE>>,
  StandardName: STRING,
  Dimensions: ARRAY<STRUCT<Name: STRING, Size: BIGINT>>>
"""

SERVICE_SCHEMA = """
meta STRUCT<`concept-id`: STRING>,
umm STRUCT<Name: STRING, LongName: STRING, Type: STRING, Version: STRING, ServiceOptions: STRING>
"""

CAPABILITY_SCHEMA = """
conceptId STRING, shortName STRING, capabilitiesVersion STRING,
services ARRAY<STRUCT<name: STRING, href: STRING, capabilities: STRUCT<
  subsetting: STRUCT<bbox: BOOLEAN, variable: BOOLEAN, temporal: BOOLEAN,
    shape: BOOLEAN, dimension: BOOLEAN>,
  concatenation: BOOLEAN, reprojection: BOOLEAN, output_formats: ARRAY<STRING>>>>
"""

#: Capability flags in the order a request's needs are checked.
NEEDS = ("bbox", "variable", "temporal", "shape", "dimension", "reproject")


def parse_granules(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Granule JSON → ``concept_id, granule_ur, related_urls, cloud_cover,
    day_night_flag, size_mb, unsized_entries``.

    Size sums the archive entries: bytes when given, else ``Size`` when its unit is
    exactly ``MB``. Entries in other units add nothing and are counted in
    ``unsized_entries``.
    """
    doc = F.from_json(F.col(raw), GRANULE_SCHEMA)
    granule = records.select(doc.alias("d"))
    entries = F.coalesce(
        F.col("d.umm.DataGranule.ArchiveAndDistributionInformation"), F.array()
    )

    def entry_mb(x: Column) -> Column:
        return F.when(F.coalesce(x["SizeInBytes"], F.lit(0.0)) != 0, x["SizeInBytes"] / (1024 * 1024)) \
            .when(x["SizeUnit"] == "MB", x["Size"].try_cast("double"))

    return granule.select(
        F.col("d.meta.concept-id").alias("concept_id"),
        F.col("d.umm.GranuleUR").alias("granule_ur"),
        F.coalesce(F.col("d.umm.RelatedUrls"), F.array()).alias("related_urls"),
        F.col("d.umm.CloudCover").alias("cloud_cover"),
        F.col("d.umm.DataGranule.DayNightFlag").alias("day_night_flag"),
        F.aggregate(
            entries, F.lit(0.0), lambda acc, x: acc + F.coalesce(entry_mb(x), F.lit(0.0))
        ).alias("size_mb"),
        F.size(F.filter(entries, lambda x: entry_mb(x).isNull())).cast("long").alias("unsized_entries"),
    )


def spatial_extent(umm: Column) -> Column:
    """Box of a collection: first rectangle, else around the first polygon, else null."""
    geometry = umm["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]
    rect = F.try_element_at(geometry["BoundingRectangles"], F.lit(1))
    points = F.try_element_at(geometry["GPolygons"], F.lit(1))["Boundary"]["Points"]
    lons = F.transform(points, lambda p: p["Longitude"])
    lats = F.transform(points, lambda p: p["Latitude"])
    return F.when(
        rect.isNotNull(),
        F.struct(
            rect["WestBoundingCoordinate"].alias("w"), rect["SouthBoundingCoordinate"].alias("s"),
            rect["EastBoundingCoordinate"].alias("e"), rect["NorthBoundingCoordinate"].alias("n"),
        ),
    ).when(
        F.size(points) > 0,
        F.struct(
            F.array_min(lons).alias("w"), F.array_min(lats).alias("s"),
            F.array_max(lons).alias("e"), F.array_max(lats).alias("n"),
        ),
    )


def advisories(umm: Column) -> Column:
    """Maturity notes a collection record carries, in fixed order."""
    progress = F.nullif(umm["CollectionProgress"], F.lit(""))
    return F.array_compact(
        F.array(
            F.concat(F.lit("CollectionProgress: "), progress),
            F.when(
                umm["StandardProduct"] == F.lit(False),
                "Not flagged as the standard product (StandardProduct=false).",
            ),
            F.nullif(umm["Purpose"], F.lit("")),
        )
    )


def parse_collections(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Collection JSON → flat record plus derived columns.

    Derived: ``output_shape`` (level ``2`` is a swath, all else a grid),
    ``native_formats`` (distinct names), ``direct_*``, ``spatial_extent``, ``advisory``.
    """
    c = records.select(F.from_json(F.col(raw), COLLECTION_SCHEMA).alias("d"))
    umm = F.col("d.umm")
    files = F.coalesce(
        umm["ArchiveAndDistributionInformation"]["FileDistributionInformation"], F.array()
    )
    level = umm["ProcessingLevel"]["Id"]
    return c.select(
        F.col("d.meta.concept-id").alias("concept_id"),
        F.col("d.meta.provider-id").alias("provider_id"),
        F.col("d.meta.revision-id").alias("revision_id"),
        F.col("d.meta.associations").alias("associations"),
        umm["ShortName"].alias("short_name"),
        umm["Version"].alias("version"),
        umm["EntryTitle"].alias("entry_title"),
        umm["Abstract"].alias("abstract"),
        level.alias("processing_level"),
        F.when(level == "2", "swath").otherwise("grid").alias("output_shape"),
        F.array_distinct(
            F.filter(F.transform(files, lambda f: f["Format"]), lambda f: F.coalesce(f, F.lit("")) != "")
        ).alias("native_formats"),
        umm["DirectDistributionInformation"].isNotNull().alias("direct_access"),
        umm["DirectDistributionInformation"]["Region"].alias("direct_region"),
        umm["DirectDistributionInformation"]["S3BucketAndObjectPrefixNames"].alias("direct_prefixes"),
        umm["StandardProduct"].alias("standard_product"),
        umm["Purpose"].alias("purpose"),
        umm["CollectionProgress"].alias("collection_progress"),
        umm["ScienceKeywords"].alias("science_keywords"),
        umm["TemporalExtents"].alias("temporal_extents"),
        umm["DOI"]["DOI"].alias("doi"),
        umm["DOI"]["Authority"].alias("doi_authority"),
        F.coalesce(umm["CollectionCitations"], F.lit("[]")).alias("collection_citations"),
        spatial_extent(umm).alias("spatial_extent"),
        advisories(umm).alias("advisory"),
    )


def parse_variables(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Variable JSON → names, packing facts and ordered dimensions."""
    v = records.select(F.from_json(F.col(raw), VARIABLE_SCHEMA).alias("d"))
    umm = F.col("d.umm")
    return v.select(
        F.col("d.meta.concept-id").alias("concept_id"),
        umm["Name"].alias("name"),
        umm["LongName"].alias("long_name"),
        umm["Definition"].alias("definition"),
        umm["DataType"].alias("data_type"),
        umm["Units"].alias("units"),
        umm["Scale"].alias("scale"),
        umm["Offset"].alias("offset"),
        F.coalesce(umm["FillValues"], F.array()).alias("fill_values"),
        F.coalesce(umm["ValidRanges"], F.array()).alias("valid_ranges"),
        umm["StandardName"].alias("standard_name"),
        F.transform(
            F.coalesce(umm["Dimensions"], F.array()),
            lambda d: F.struct(d["Name"].alias("name"), d["Size"].alias("size")),
        ).alias("dimensions"),
    )


def parse_services(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Service JSON → id, names, type, version; the options stay raw JSON."""
    s = records.select(F.from_json(F.col(raw), SERVICE_SCHEMA).alias("d"))
    umm = F.col("d.umm")
    return s.select(
        F.col("d.meta.concept-id").alias("concept_id"),
        umm["Name"].alias("name"),
        umm["LongName"].alias("long_name"),
        umm["Type"].alias("type"),
        umm["Version"].alias("version"),
        F.coalesce(umm["ServiceOptions"], F.lit("{}")).alias("service_options"),
    )


def _service_struct(s: Column, pos: Column | None = None) -> Column:
    caps = s["capabilities"]
    subset = caps["subsetting"]
    href = F.regexp_replace(F.coalesce(s["href"], F.lit("")), r"/+$", "")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    fields = [
        F.coalesce(s["name"], F.lit("")).alias("service_name"),
        F.substring_index(href, "/", -1).alias("service_id"),
        *[flag(subset[k]).alias(k) for k in ("bbox", "variable", "temporal", "shape", "dimension")],
        flag(caps["reprojection"]).alias("reproject"),
        flag(caps["concatenation"]).alias("concatenate"),
        F.array_distinct(F.coalesce(caps["output_formats"], F.array().cast("array<string>"))).alias("output_formats"),
    ]
    return F.struct(*([pos.cast("int").alias("pos")] if pos is not None else []), *fields)


def parse_capabilities(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Capability documents → ``concept_id, short_name, capabilities_version, services``.

    ``services`` keeps the document's order in one array. Only the per-service blocks are
    read: the rolled-up flags at the top promise combinations no single service can do.
    """
    d = F.from_json(F.col(raw), CAPABILITY_SCHEMA)
    doc = records.select(*[c for c in records.columns if c != raw], d.alias("d"))
    return doc.select(
        *[c for c in records.columns if c != raw],
        F.col("d.conceptId").alias("doc_concept_id"),
        F.col("d.shortName").alias("doc_short_name"),
        F.coalesce(F.col("d.capabilitiesVersion"), F.lit("")).alias("capabilities_version"),
        F.transform(
            F.coalesce(F.col("d.services"), F.array()), lambda s, i: _service_struct(s, i)
        ).alias("services"),
    )


def explode_services(capabilities: DataFrame) -> DataFrame:
    """One row per service; a document without services keeps one row of nulls."""
    kept = [c for c in capabilities.columns if c != "services"]
    return capabilities.select(*kept, F.explode_outer("services").alias("s")).select(*kept, "s.*")


def merge_capabilities(collections: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Collection layer joined with its service document on ``concept_id``.

    ``capabilities`` carries the id that was asked for in ``concept_id``. The document's
    short name wins when not empty; the collection's own id wins when the record exists.
    Ids with only one side are kept.
    """
    c = collections.withColumn("_found", F.lit(True))
    merged = c.join(capabilities, "concept_id", "full_outer")
    text = lambda name: F.nullif(F.col(name), F.lit(""))
    return merged.select(
        F.when(F.col("_found"), F.col("concept_id"))
        .otherwise(F.coalesce(text("doc_concept_id"), F.col("concept_id"))).alias("concept_id"),
        F.coalesce(text("doc_short_name"), F.col("short_name"), F.lit("")).alias("short_name"),
        F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce("processing_level", F.lit("")).alias("processing_level"),
        F.coalesce("output_shape", F.lit("grid")).alias("output_shape"),
        F.coalesce("native_formats", F.array().cast("array<string>")).alias("native_formats"),
        F.coalesce("direct_access", F.lit(False)).alias("direct_access"),
        "direct_region",
        "spatial_extent",
        F.coalesce("advisory", F.array().cast("array<string>")).alias("advisory"),
        F.coalesce("capabilities_version", F.lit("")).alias("capabilities_version"),
        F.coalesce("services", F.array().cast(capabilities.schema["services"].dataType)).alias("services"),
    )


def citation_summary(collections: DataFrame) -> DataFrame:
    """DOI, authority, citation list and the number of works that cite a collection."""
    return collections.select(
        "concept_id", "doi", "doi_authority", "collection_citations",
        F.coalesce(F.array_size(F.col("associations.citations")), F.lit(0)).cast("long")
        .alias("reference_citation_count"),
    )


def parse_keyword_labels(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Keyword dumps → one row per ``label``.

    A dump is ``{"concepts": [...]}`` or a bare list. Items are texts, or objects whose
    label is ``prefLabel``, else ``label``, else (object form only) ``text``.
    """
    doc = payloads.select(F.try_parse_json(F.col(raw)).alias("v"))
    listed = doc.select(
        F.expr("try_variant_get(v, '$.concepts', 'array<variant>')").alias("in_object"),
        F.expr("try_variant_get(v, '$', 'array<variant>')").alias("bare"),
    ).select(
        F.explode(F.coalesce("in_object", "bare")).alias("item"),
        F.col("in_object").isNotNull().alias("wrapped"),
    )

    def member(name: str) -> Column:
        return F.nullif(F.expr(f"try_variant_get(item, '$.{name}', 'string')"), F.lit(""))

    kind = F.schema_of_variant("item")
    label = F.when(kind == "STRING", F.expr("try_variant_get(item, '$', 'string')")).when(
        F.startswith(kind, F.lit("OBJECT")),
        F.coalesce(member("prefLabel"), member("label"), F.when(F.col("wrapped"), member("text"))),
    )
    return listed.select(label.alias("label")).where(F.col("label").isNotNull())
