"""Queries over catalog records: ingest, search, associations, notes, keywords, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators import bulk_search as bulk
from graticule.operators import catalog as cat
from graticule.operators import stats as st
from graticule.plans import fixtures as fx
from graticule.plans.fixtures import DUCK, SPARK, table, view
from graticule.plans.registry import query
from graticule.session import cut_lineage
from graticule.sources import lookups as lk
from graticule.sources import metadata as md



@query("granule_ingest", "SRC-1", sql=f"""SELECT granule_ur AS concept_id, granule_ur, cloud_cover, day_night_flag,
  round(size_mb, 9) AS size_mb, CAST(CASE WHEN unit_kind = 2 THEN 1 ELSE 0 END AS BIGINT) AS unsized_entries,
  CASE WHEN url IS NULL THEN 1 ELSE 2 END AS n_urls FROM {DUCK.granules()}""")
def granule_ingest(spark, sf):
    g = md.parse_granules(fx.granule_records(spark, sf))
    return g.select(
        "concept_id", "granule_ur", "cloud_cover", "day_night_flag", F.round("size_mb", 9).alias("size_mb"),
        "unsized_entries", F.size("related_urls").alias("n_urls"),
    )




@query("collection_ingest", "SRC-2", "AGG-12", sql=f"""SELECT concept_id, provider_id, revision_id, short_name, version, entry_title, abstract,
    processing_level, CASE WHEN processing_level = '2' THEN 'swath' ELSE 'grid' END AS output_shape,
    concat_ws(',', fmt1, CASE WHEN fmt2 <> '' AND fmt2 IS DISTINCT FROM fmt1 THEN fmt2 END) AS native_formats,
    direct_region IS NOT NULL AS direct_access, direct_region, doi,
    concat_ws(' | ', 'CollectionProgress: ' || collection_progress,
      CASE WHEN standard_product = false THEN 'Not flagged as the standard product (StandardProduct=false).' END, purpose) AS advisory,
    CASE WHEN extent_kind < 2 THEN w END AS w, CASE WHEN extent_kind < 2 THEN s END AS s,
    CASE WHEN extent_kind < 2 THEN e END AS e, CASE WHEN extent_kind < 2 THEN n END AS n
  FROM {DUCK.collections()}""")
def collection_ingest(spark, sf):
    c = md.parse_collections(fx.collection_records(spark, sf))
    return c.select(
        "concept_id", "provider_id", "revision_id", "short_name", "version", "entry_title", "abstract", "processing_level",
        "output_shape", F.array_join("native_formats", ",").alias("native_formats"), "direct_access", "direct_region", "doi",
        F.array_join("advisory", " | ").alias("advisory"), "spatial_extent.w", "spatial_extent.s", "spatial_extent.e", "spatial_extent.n",
    )


@query("variable_ingest", "SRC-3", sql=f"""SELECT concept_id, name, standard_name, units, CAST(scale AS DOUBLE) AS scale, CAST(fill AS DOUBLE) AS fill, CASE WHEN pos = 3 THEN 100.0::DOUBLE END AS valid_max,
  concat_ws(',', d1 || '=' || coalesce(CAST(n1 AS VARCHAR), '?'), d2 || '=' || n2, d3 || '=' || n3) AS dimensions FROM {DUCK.variables()}""")
def variable_ingest(spark, sf):
    v = md.parse_variables(fx.variable_records(spark, sf))
    dims = F.transform("dimensions", lambda d: F.concat(d["name"], F.lit("="), F.coalesce(d["size"].cast("string"), F.lit("?"))))
    return v.select(
        "concept_id", "name", "standard_name", "units", "scale",
        F.try_element_at("fill_values", F.lit(1))["Value"].alias("fill"),
        F.try_element_at("valid_ranges", F.lit(1))["Max"].alias("valid_max"), F.array_join(dims, ",").alias("dimensions"),
    )


def catalog_tables(spark, sf):
    """Collections and variables ingested to tables, as later queries read them.

    Joins on parsed fields would otherwise push their null tests into the JSON parse and run
    it again.
    """
    return (
        cut_lineage(md.parse_collections(fx.collection_records(spark, sf)), "collections"),
        cut_lineage(md.parse_variables(fx.variable_records(spark, sf)), "variables"),
    )


def _service_records(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.to_json(F.struct(
        F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("concept-id")).alias("meta"),
        F.struct(
            F.col("s_name").alias("Name"), F.lit("1.2").alias("Version"),
            F.when(F.col("s_suppkey") % 2 == 0, "Harmony").otherwise("OPeNDAP").alias("Type"),
            F.when(F.col("s_suppkey") % 3 > 0, F.struct(F.col("s_nationkey").alias("Max"))).alias("ServiceOptions"),
        ).alias("umm"),
    )).alias("raw"))


@query("service_ingest", "SRC-4", sql="""SELECT 'S' || s_suppkey AS concept_id, s_name AS name, CAST(NULL AS VARCHAR) AS long_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Harmony' ELSE 'OPeNDAP' END AS type, '1.2' AS version,
  CASE WHEN s_suppkey % 3 > 0 THEN '{"Max":' || s_nationkey || '}' ELSE '{}' END AS service_options FROM supplier""")
def service_ingest(spark, sf):
    return md.parse_services(_service_records(spark, sf))


_FLAGS = ("bbox", "variable", "temporal", "shape", "dimension", "reproject", "concatenate")


@query("service_capability_rows", "SRC-5", sql=f"""SELECT c.concept_id, pos, service_name, service_id, {', '.join(f's.{f}' for f in _FLAGS)},
    CASE WHEN pos IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN has_nc THEN 'application/netcdf4' END, CASE WHEN has_png THEN 'image/png' END) END AS output_formats
  FROM {DUCK.collections()} c LEFT JOIN {DUCK.services()} s ON s.collection_id = c.concept_id""")
def service_capability_rows(spark, sf):
    rows = md.explode_services(md.parse_capabilities(fx.capability_records(spark, sf)))
    return rows.select("concept_id", F.col("pos").cast("long").alias("pos"), "service_name", "service_id", *_FLAGS, F.array_join("output_formats", ",").alias("output_formats"))


def capabilities(spark, sf):
    """Collections merged with their service documents; a tenth of each side has another name.

    So some collections are without a document and some documents without a collection, and
    all rows of both take part.
    """
    def renamed(df: DataFrame, digit: str, prefix: str) -> DataFrame:
        odd = F.substring("concept_id", -1, 1) == digit
        return df.withColumn("concept_id", F.when(odd, F.concat(F.lit(prefix), F.col("concept_id"))).otherwise(F.col("concept_id")))

    c = renamed(md.parse_collections(fx.collection_records(spark, sf)), "3", "R")
    d = renamed(md.parse_capabilities(fx.capability_records(spark, sf)), "7", "D")
    d = d.withColumn("doc_concept_id", F.col("concept_id"))
    return md.merge_capabilities(c, d)


def _merged_sql(concept_id: str, record: str, doc: str, where: str) -> str:
    return f"""SELECT {concept_id} AS concept_id, k, {record} AS has_record, {doc} AS has_doc,
    CASE WHEN {doc} AND k % 2 = 0 THEN 'HSN' || (k % 10) WHEN {record} THEN short_name ELSE '' END AS short_name,
    CASE WHEN {record} AND processing_level = '2' THEN 'swath' ELSE 'grid' END AS output_shape,
    CASE WHEN {record} THEN direct_region END AS direct_region,
    CASE WHEN {doc} THEN '2' ELSE '' END AS capabilities_version,
    CASE WHEN {record} THEN version ELSE '' END AS version
  FROM {DUCK.collections()} WHERE {where}"""


CAPABILITIES_SQL = "(" + " UNION ALL ".join((
    _merged_sql("concept_id", "k % 10 <> 3", "k % 10 <> 7", "true"),
    _merged_sql("'R' || concept_id", "true", "false", "k % 10 = 3"),
    _merged_sql("'D' || concept_id", "false", "true", "k % 10 = 7"),
)) + ")"


@query("capability_merge", "SRC-12", sql=f"""SELECT concept_id, short_name, version, output_shape, direct_region IS NOT NULL AS direct_access,
    capabilities_version, CASE WHEN has_doc THEN k % 4 ELSE 0 END AS n_services FROM {CAPABILITIES_SQL}""")
def capability_merge(spark, sf):
    return capabilities(spark, sf).select(
        "concept_id", "short_name", "version", "output_shape", "direct_access", "capabilities_version", F.size("services").cast("long").alias("n_services")
    )


@query("citation_summary", "AGG-11", sql=f"""SELECT concept_id, doi, CASE WHEN doi IS NOT NULL THEN 'https://doi.org' END AS doi_authority,
  '[]' AS collection_citations, n_citing AS reference_citation_count FROM {DUCK.collections()}""")
def citation_summary(spark, sf):
    return md.citation_summary(md.parse_collections(fx.collection_records(spark, sf)))


@query("dataset_summary", "AGG-9", sql=f"""SELECT short_name, concept_id, processing_level, CASE WHEN extent_kind < 2 THEN w END AS west,
  concat_ws(',', fmt1, CASE WHEN fmt2 <> '' AND fmt2 IS DISTINCT FROM fmt1 THEN fmt2 END) AS native_formats FROM {DUCK.collections()}""")
def dataset_summary(spark, sf):
    s = st.dataset_summary(md.parse_collections(fx.collection_records(spark, sf)))
    return s.select("short_name", "concept_id", "processing_level", F.col("bbox.w").alias("west"), F.array_join("native_formats", ",").alias("native_formats"))


# -- lookups -------------------------------------------------------------------------------


@query("region_key_use", "SRC-10", "JOIN-7", sql=f"""WITH r(key, west) AS (VALUES {', '.join(
    f"('{key}', CAST({w} AS DOUBLE))" for k, w, _, _, _, aliases in lk.REGIONS for key in [k, *[a.lower() for a in aliases]])})
  SELECT id, text, west FROM {DUCK.locations()} JOIN r ON r.key = lower(trim(text))""")
def region_key_use(spark, sf):
    from graticule.operators.area import lookup_regions

    keys = lk.region_keys(lk.region_entries(spark))
    return lookup_regions(view(spark, sf, SPARK.locations()), keys).select("id", "text", F.col("w").alias("west"))


def _label_payloads(spark, sf):
    """One keyword dump per region of parts, alternating between the two forms."""
    p = table(spark, sf, "part").withColumn("g", F.floor(F.col("p_partkey") / 10))
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    item = F.struct(
        F.when(k % 4 == 0, F.concat("p_name", F.lit(" "), k.cast("string"))).otherwise(none).alias("prefLabel"),
        F.when(k % 4 < 2, F.concat(F.lit("label "), k.cast("string"))).otherwise(none).alias("label"),
        F.when(k % 4 < 3, F.concat(F.lit("text "), k.cast("string"))).otherwise(none).alias("text"),
    )
    grouped = p.groupBy("g").agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_list("p_type")).alias("names"))
    return grouped.select("g", F.when(F.col("g") % 3 == 0, F.to_json(F.struct(F.col("items").alias("concepts"))))
                          .when(F.col("g") % 3 == 1, F.to_json("items")).otherwise(F.to_json("names")).alias("raw"))


@query("keyword_label_ingest", "SRC-11", sql="""SELECT * FROM (SELECT CASE
    WHEN (p_partkey // 10) % 3 = 2 THEN p_type
    WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_partkey WHEN p_partkey % 4 = 1 THEN 'label ' || p_partkey
    WHEN p_partkey % 4 = 2 AND (p_partkey // 10) % 3 = 0 THEN 'text ' || p_partkey END AS label FROM part) WHERE label IS NOT NULL""")
def keyword_label_ingest(spark, sf):
    return md.parse_keyword_labels(_label_payloads(spark, sf))


def _labels(spark, sf):
    return table(spark, sf, "part").select(
        F.upper(F.concat("p_name", F.lit(" > "), "p_type", F.lit(" "), (F.col("p_partkey") % 40).cast("string"))).alias("label"),
        F.col("p_partkey").alias("pos"),
    )


def _terms(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(k % 5 == 0, " Rain").when(k % 5 == 1, F.concat(F.lit("ring > economy "), (k % 40).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("red widget > Small "), (k % 40).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("no such thing "), k.cast("string"))).otherwise(F.concat(F.lit("y "), (k % 40).cast("string"))).alias("term")
    )


_TERMS_SQL = """SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN ' Rain' WHEN 1 THEN 'ring > economy ' || (c_custkey % 40)
    WHEN 2 THEN 'red widget > Small ' || (c_custkey % 40) WHEN 3 THEN 'no such thing ' || c_custkey ELSE 'y ' || (c_custkey % 40) END AS term FROM customer"""
_KEYWORDS_SQL = f"""WITH t AS ({_TERMS_SQL}), l AS (
    SELECT upper(p_name || ' > ' || p_type || ' ' || (p_partkey % 40)) AS label, min(p_partkey) AS pos FROM part GROUP BY 1),
  syn AS (SELECT term, 'synonym' AS rule, x.pos, x.keyword FROM t, (VALUES ('rain', 0, 'PRECIPITATION AMOUNT'), ('rain', 1, 'PRECIPITATION RATE')) x(k, pos, keyword)
    WHERE lower(trim(term)) = x.k),
  ex AS (SELECT term, 'exact' AS rule, pos, label AS keyword FROM t JOIN l ON lower(label) = lower(trim(term)) WHERE term NOT IN (SELECT term FROM syn)),
  sub AS (SELECT term, 'substring' AS rule, pos, label AS keyword FROM t JOIN l ON contains(lower(label), lower(trim(term)))
    WHERE term NOT IN (SELECT term FROM syn) AND term NOT IN (SELECT term FROM ex)),
  allk AS (SELECT * FROM syn UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM sub),
  full_k AS (SELECT * FROM allk UNION ALL SELECT term, 'passthrough', 0, term FROM t WHERE term NOT IN (SELECT term FROM allk))"""


@query("keyword_normalization", "JOIN-6", sql=f"{_KEYWORDS_SQL} SELECT term, rule, pos, keyword FROM full_k")
def keyword_normalization(spark, sf):
    return cat.normalize_keywords(_terms(spark, sf), lk.synonym_keys(spark), _labels(spark, sf))


@query("search_keywords", "JOIN-6", sql=f"{_KEYWORDS_SQL} SELECT term, min_by(rule, pos) AS rule, min_by(keyword, pos) AS keyword FROM full_k GROUP BY 1")
def search_keywords(spark, sf):
    return cat.search_keywords(keyword_normalization(spark, sf))


# -- search and associations -------------------------------------------------------------------


@query("collection_search", "FLT-4", sql=f"""SELECT concept_id, short_name, entry_title FROM {DUCK.collections()}
  WHERE contains(lower(short_name || ' ' || entry_title || ' ' || abstract), 'daily')
    AND contains(lower(short_name || ' ' || entry_title || ' ' || abstract), 'furniture')
    AND processing_level IN ('2', '3', '4') AND time_start <= TIMESTAMP '1998-06-01' AND time_end >= TIMESTAMP '1996-01-01'
    AND has_granules AND s <= 40 AND n >= 30 AND ((w <= 180 AND e >= 170) OR (w <= -170 AND e >= -180))
  ORDER BY concept_id LIMIT 20""")
def collection_search(spark, sf):
    found = cat.search_collections(
        view(spark, sf, SPARK.collections()), "Furniture DAILY",
        {"processing_level_id": ["2", "3", "4"], "temporal": ("1996-01-01", "1998-06-01"), "has_granules": True,
         "bounding_box": (170.0, 30.0, -170.0, 40.0), "limit": 20, "colour": "red"},
    )
    return found.select("concept_id", "short_name", "entry_title")


@query("catalog_search_bulk", "FLT-4", sql=f"""WITH q AS (SELECT *, string_split(trim(regexp_replace(lower(keyword), '\\s+', ' ', 'g')), ' ') AS words,
      least(coalesce("limit", 10), 50) AS most FROM {DUCK.catalog_searches()})
  SELECT search_id, rank, concept_id, short_name, entry_title FROM (
    SELECT q.search_id, q.most, c.concept_id, c.short_name, c.entry_title, row_number() OVER (PARTITION BY q.search_id ORDER BY c.concept_id) AS rank
    FROM q JOIN {DUCK.collections()} c
      ON (q.keyword IS NULL OR len(list_filter(q.words, lambda x: NOT contains(lower(c.short_name || ' ' || c.entry_title || ' ' || c.abstract), x))) = 0)
      AND (q.concept_id IS NULL OR q.concept_id = c.concept_id) AND (q.short_name IS NULL OR q.short_name = c.short_name)
      AND (q.provider IS NULL OR q.provider = c.provider_id) AND (q.levels IS NULL OR list_contains(q.levels, c.processing_level))
      AND (q.has_granules IS NULL OR q.has_granules = c.has_granules)
      AND (q.t1 IS NULL OR c.time_start <= q.t1) AND (q.t0 IS NULL OR c.time_end >= q.t0)
      AND (q.w IS NULL OR (c.s <= q.n AND c.n >= q.s AND CASE WHEN q.w <= q.e THEN c.w <= q.e AND c.e >= q.w
        ELSE (c.w <= 180 AND c.e >= q.w) OR (c.w <= q.e AND c.e >= -180) END)))
  WHERE rank <= most""")
def catalog_search_bulk(spark, sf):
    return bulk.search_catalog(view(spark, sf, SPARK.collections()), view(spark, sf, SPARK.catalog_searches()))


@query("associated_variables", "JOIN-4", sql=f"""SELECT collection_id, concept_id, pos, name FROM {DUCK.variables()} WHERE k0 % 4 <> 3""")
def associated_variables(spark, sf):
    c, v = catalog_tables(spark, sf)
    return cat.associated_records(c, v, "variables").select(
        "collection_id", "concept_id", F.col("pos").cast("long").alias("pos"), "name"
    )


@query("associated_services", "JOIN-4", sql="""SELECT 'C' || c_custkey AS collection_id, 'S' || s_suppkey AS concept_id, s_name AS name
  FROM customer JOIN supplier ON s_suppkey = c_custkey % 120""")
def associated_services(spark, sf):
    c = md.parse_collections(fx.collection_records(spark, sf))
    return cat.associated_records(c, md.parse_services(_service_records(spark, sf)), "services").select("collection_id", "concept_id", "name")


def _curated(spark, sf):
    """Curated notes on a third of the short names, derived from the customer table."""
    names = table(spark, sf, "customer").select((F.col("c_custkey") % 97).alias("m")).distinct().where("m % 3 = 0")
    short = F.concat(F.lit("SN"), F.col("m").cast("string")).alias("short_name")
    meta = (F.lit("curator").alias("owner"), F.lit("2026-01-15").alias("last_reviewed"))
    products = names.select(short, F.array(F.concat(F.lit("note "), F.col("m").cast("string")), F.lit("see guide")).alias("notes"), *meta)
    variables = names.select(short, F.lit("ndvi").alias("name"), F.when(F.col("m") % 2 == 0, "mask first").otherwise("").alias("note"), *meta)
    return products, variables


@query("collection_notes", "JOIN-5", sql=f"""SELECT concept_id, short_name, version, CASE WHEN (k % 97) % 3 = 0 THEN 2 ELSE 0 END AS n_notes,
    CASE WHEN (k % 97) % 3 = 0 THEN 'note ' || (k % 97) END AS first_note, CASE WHEN (k % 97) % 3 = 0 THEN false END AS authoritative
  FROM {DUCK.collections()}""")
def collection_notes(spark, sf):
    c = md.parse_collections(fx.collection_records(spark, sf))
    out = cat.attach_notes(c, cat.collection_notes(_curated(spark, sf)[0]), ["short_name"])
    first = F.try_element_at("advisory_notes", F.lit(1))
    return out.select("concept_id", "short_name", "version", F.size("advisory_notes").alias("n_notes"),
                      first["note"].alias("first_note"), first["authoritative"].alias("authoritative"))


@query("dataset_description", "LIN-13", "JOIN-4", "JOIN-5", sql=f"""SELECT c.concept_id AS collection_id, c.short_name, CASE WHEN (c.k % 97) % 3 = 0 THEN 2 ELSE 0 END AS n_notes,
    v.pos, v.name AS variable, v.units, CAST(v.scale AS DOUBLE) AS scale,
    CASE WHEN (c.k % 97) % 6 = 0 AND v.name = 'ndvi' THEN 'mask first' END AS variable_note
  FROM {DUCK.collections()} c LEFT JOIN {DUCK.variables()} v ON v.collection_id = c.concept_id AND c.k % 4 <> 3""")
def dataset_description(spark, sf):
    products, variables = _curated(spark, sf)
    collections, records = catalog_tables(spark, sf)
    d = cat.describe_datasets(collections, records, cat.collection_notes(products), variables)
    return d.select("collection_id", "short_name", F.size("advisory_notes").alias("n_notes"), F.col("pos").cast("long").alias("pos"), "variable", "units", "scale",
                    F.try_element_at("variable_notes", F.lit(1))["note"].alias("variable_note"))


@query("imagery_layer_choice", "WIN-2", sql="""WITH l AS (SELECT o_custkey AS collection_id, o_orderkey AS pos,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'L' || o_orderkey || '_Night' ELSE 'L' || o_orderkey END AS layer,
    o_orderkey % 2 = 0 AS arctic, o_orderkey % 7 = 0 AS antarctic FROM orders)
  SELECT collection_id, min_by(layer, ((arctic OR antarctic)::INT, contains(layer, '_Night')::INT, pos)) FILTER (layer IS NOT NULL) AS layer FROM l GROUP BY 1""")
def imagery_layer_choice(spark, sf):
    k = F.col("o_orderkey")
    layers = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("collection_id"), k.alias("pos"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.concat(F.lit("L"), k.cast("string"), F.lit("_Night")))
        .otherwise(F.concat(F.lit("L"), k.cast("string"))).alias("layer"),
        (k % 2 == 0).alias("arctic"), (k % 7 == 0).alias("antarctic"),
    )
    return cat.select_imagery_layers(layers)
