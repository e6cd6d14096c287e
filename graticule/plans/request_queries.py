"""Queries over request tables: axes, routing, names, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from graticule.functions import temporal
from graticule.functions import text as tx
from graticule.operators import axes as ax
from graticule.operators import coverage as cov
from graticule.operators import manifest as mf
from graticule.operators import routing as rt
from graticule.plans import fixtures as fx
from graticule.plans.catalog_queries import CAPABILITIES_SQL, capabilities
from graticule.plans.fixtures import DUCK, SPARK, table, view
from graticule.plans.place_queries import PAIRS_SQL
from graticule.plans.registry import query
from graticule.session import by_shuffle, cut_lineage
from graticule.sources import metadata as md
from graticule.sources.metadata import NEEDS

# -- axes -------------------------------------------------------------------------------


def _names(k: str) -> str:
    """SQL: coordinate names of a collection with key ``k``."""
    return f"""CASE WHEN {k} % 3 = 1 THEN '/product/latitude' ELSE 'lat' END AS coord_lat,
      CASE WHEN {k} % 3 = 1 THEN '/product/longitude' ELSE 'lon' END AS coord_lon,
      CASE WHEN {k} % 2 = 0 THEN CASE WHEN {k} % 3 = 1 THEN '/product/time' ELSE 'time' END END AS coord_time"""


@query("coordinate_discovery", "AX-4", sql=f"SELECT concept_id AS collection_id, {_names('k')} FROM {DUCK.collections()}")
def coordinate_discovery(spark, sf):
    return ax.discover_coordinates(fx.variable_table(spark, sf))


@query("axis_lengths", "AX-2", sql=f"SELECT concept_id AS collection_id, n_lat AS lat_length, nullif(n_lon, 0) AS lon_length FROM {DUCK.collections()}")
def axis_lengths(spark, sf):
    v = fx.variable_table(spark, sf)
    return ax.axis_lengths(v, ax.discover_coordinates(v)).select("collection_id", "lat_length", "lon_length")


AXES_SQL = f"""(SELECT *, extent_kind < 2 AND n_lon > 0 AS known, (n - s) / n_lat AS lat_step, (e - w) / nullif(n_lon, 0) AS lon_step
  FROM {DUCK.collections()})"""


def _extents(spark, sf):
    box = F.struct("w", "s", "e", "n")
    return view(spark, sf, SPARK.collections()).select(
        F.col("concept_id").alias("collection_id"), F.when(F.col("extent_kind") < 2, box).alias("spatial_extent")
    )


def collection_axes(spark, sf):
    v = fx.variable_table(spark, sf)
    return ax.collection_axes(_extents(spark, sf), ax.axis_lengths(v, ax.discover_coordinates(v)))


@query("axis_geometry", "AX-1", sql=f"""SELECT concept_id AS collection_id, CASE WHEN known THEN s + lat_step / 2 END AS lat_origin, CASE WHEN known THEN lat_step END AS lat_step,
  CASE WHEN known THEN w + lon_step / 2 END AS lon_origin, CASE WHEN known THEN lon_step END AS lon_step FROM {AXES_SQL}""")
def axis_geometry(spark, sf):
    return collection_axes(spark, sf).select(
        "collection_id", F.col("lat_axis.origin").alias("lat_origin"), F.col("lat_axis.step").alias("lat_step"),
        F.col("lon_axis.origin").alias("lon_origin"), F.col("lon_axis.step").alias("lon_step"),
    )


@query("dimension_plans", "AX-3", sql=f"""SELECT concept_id, CASE WHEN pos = 3 OR (pos = 4 AND n1 IS NOT NULL)
    THEN d1 || '=' || n1 || ',' || d2 || '=,' || d3 || '=' END AS dims FROM {DUCK.variables()}""")
def dimension_plans(spark, sf):
    v = fx.variable_table(spark, sf)
    c = ax.discover_coordinates(v).select("collection_id", tx.leaf_name(F.col("coord_lat")).alias("la"), tx.leaf_name(F.col("coord_lon")).alias("lo"))
    plan = ax.dimension_plan(F.col("dimensions"), F.col("la"), F.col("lo"))
    joined = v.join(by_shuffle(c), "collection_id").withColumn("plan", plan)
    dims = F.transform("plan", lambda d: F.concat(d["leaf"], F.lit("="), F.coalesce(d["size"].cast("string"), F.lit(""))))
    return joined.select(
        F.concat(F.lit("V"), F.substring("collection_id", 2, 20), F.lit("_"), F.col("pos").cast("string")).alias("concept_id"),
        F.when(F.col("plan").isNotNull(), F.array_join(dims, ",")).alias("dims"),
    )


def _range_sql(x: str) -> str:
    f = lambda v: f"(({v} - (-59.875)) / 0.25)"
    lo = f"greatest(0, least(599, CAST(floor({f('r.s')}) AS BIGINT)))"
    hi = f"greatest(0, least(599, CAST(ceil({f('r.n')}) AS BIGINT)))"
    return f"{lo}" if x == "low" else f"greatest({lo}, {hi})"


@query("index_ranges", "FLT-3", sql=f"""SELECT request_id, {_range_sql('low')} AS lat_low, {_range_sql('high')} AS lat_high,
    CASE WHEN w <= e THEN greatest(0, least(1439, CAST(floor((w + 179.875) / 0.25) AS BIGINT))) END AS lon_low,
    CASE WHEN w <= e THEN greatest(0, least(1439, CAST(ceil((e + 179.875) / 0.25) AS BIGINT))) END AS lon_high,
    greatest(0, least(599, CAST(floor((n - 89.875) / -0.25) AS BIGINT))) AS down_low
  FROM {DUCK.requests()} r""")
def index_ranges(spark, sf):
    lit = F.lit
    r = view(spark, sf, SPARK.requests()).select(
        "request_id",
        ax.index_range(lit(-59.875), lit(0.25), lit(600), F.col("s"), F.col("n")).alias("a"),
        ax.longitude_index_range(lit(-179.875), lit(0.25), lit(1440), F.col("w"), F.col("e")).alias("o"),
        ax.index_range(lit(89.875), lit(-0.25), lit(600), F.col("s"), F.col("n")).alias("d"),
    )
    return r.select("request_id", F.col("a.low").alias("lat_low"), F.col("a.high").alias("lat_high"),
                    F.col("o.low").alias("lon_low"), F.col("o.high").alias("lon_high"), F.col("d.low").alias("down_low"))


# -- routing ---------------------------------------------------------------------------------

_UNMET = lambda r, s: "CASE " + " ".join(
    f"WHEN {r}.needs_{n} AND NOT {s}.{n} THEN '{n}'" for n in NEEDS
) + f" WHEN NOT ((r.output_format = 'application/netcdf4' AND {s}.has_nc) OR (r.output_format = 'image/png' AND {s}.has_png)) THEN 'output_format' END"
_ROUTE_CTE = f"""r AS (SELECT * FROM {DUCK.requests()}), c AS (SELECT * FROM {CAPABILITIES_SQL} WHERE has_record OR has_doc),
  s AS (SELECT s.* FROM {DUCK.services()} s WHERE CAST(substr(collection_id, 2) AS BIGINT) % 10 <> 7),
  u AS (SELECT r.request_id, s.pos, s.service_name, s.service_id, {_UNMET('r', 's')} AS unmet FROM r JOIN s ON s.collection_id = r.collection_id),
  m AS (SELECT request_id, min_by(service_name, pos) FILTER (unmet IS NULL) AS service_name, min_by(service_id, pos) FILTER (unmet IS NULL) AS service_id,
    string_agg(service_name || ':' || coalesce(unmet, ''), ',' ORDER BY pos) AS trace FROM u GROUP BY 1),
  j AS (SELECT r.*, c.output_shape, c.direct_region, m.service_name, m.service_id, m.trace, {' OR '.join(f'needs_{n}' for n in NEEDS)} AS any_need
    FROM r LEFT JOIN c ON c.concept_id = r.collection_id LEFT JOIN m ON m.request_id = r.request_id)"""


def _matched(spark, sf):
    return rt.match_services(view(spark, sf, SPARK.requests()), cut_lineage(capabilities(spark, sf), "capabilities"))


@query("service_match", "JOIN-11", "WIN-1", sql=f"WITH {_ROUTE_CTE} SELECT request_id, collection_id, service_name, service_id FROM j")
def service_match(spark, sf):
    return _matched(spark, sf).select(
        "request_id", "collection_id", F.col("service.service_name").alias("service_name"), F.col("service.service_id").alias("service_id")
    )


_DIRECT = "NOT any_need AND lower(trim(direct_region)) = 'us-west-2'"


@query("request_routes", "LIN-10", "JOIN-11", sql=f"""WITH {_ROUTE_CTE}
  SELECT request_id, CASE WHEN needs_point_sample THEN 'appeears' WHEN {_DIRECT} THEN 'direct' ELSE 'harmony' END AS route, service_name FROM j""")
def request_routes(spark, sf):
    routed = rt.route_requests(_matched(spark, sf), direct_enabled=True, region="US-West-2 ")
    return routed.select("request_id", "route", F.col("service.service_name").alias("service_name"))


@query("request_routes_without_service", "LIN-10", sql=f"""WITH {_ROUTE_CTE}
  SELECT request_id, CASE WHEN needs_point_sample THEN 'appeears' WHEN service_name IS NOT NULL THEN 'harmony'
    WHEN has_urls AND (needs_variable OR needs_bbox OR needs_temporal) AND output_format = 'application/netcdf4' THEN 'opendap' END AS route FROM j""")
def request_routes_without_service(spark, sf):
    return rt.route_requests(_matched(spark, sf), service_available=False).select("request_id", "route")


_MET = ", ".join(f"CASE WHEN needs_{n} THEN '{n}' END" for n in NEEDS)


@query("route_explanations", "LIN-11", sql=f"""WITH {_ROUTE_CTE}, k AS (SELECT *, CASE WHEN needs_point_sample THEN 'appeears' WHEN {_DIRECT} THEN 'direct' ELSE 'harmony' END AS route FROM j)
  SELECT request_id, route, CASE WHEN route = 'harmony' THEN service_name END AS pinned_service,
    CASE WHEN route = 'harmony' AND service_name IS NOT NULL THEN concat_ws(',', {_MET}, 'output_format') END AS satisfied_needs,
    CASE WHEN route = 'appeears' THEN 'point_sample_intent' WHEN route = 'direct' THEN 'data_as_is_in_region' WHEN service_name IS NOT NULL THEN 'pinned'
      WHEN trace IS NULL THEN 'no_registered_services' ELSE 'no_single_service_satisfies' END AS reason,
    CASE WHEN route = 'harmony' AND service_name IS NULL THEN coalesce(trace, '') END AS unmet FROM k""")
def route_explanations(spark, sf):
    routed = rt.route_requests(_matched(spark, sf), direct_enabled=True, region="us-west-2")
    x = rt.explain_routes(routed)
    trace = F.transform("unmet", lambda u: F.concat(u["service_name"], F.lit(":"), F.coalesce(u["first_unmet_need"], F.lit(""))))
    return x.select("request_id", "route", "pinned_service", F.array_join("satisfied_needs", ",").alias("satisfied_needs"),
                    "reason", F.array_join(trace, ",").alias("unmet"))


# -- names ---------------------------------------------------------------------------------------


def _wanted(v) -> str:
    return f"""(SELECT o_orderkey AS request_id, CAST(0 AS BIGINT) AS pos, 'C' || o_custkey AS collection_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'NDVI' WHEN 1 THEN '/product/ndvi' WHEN 2 THEN 'qa flag' WHEN 3 THEN 'albedo' ELSE 'Lat' END AS variable
      FROM {v.t('orders')})"""


@query("variable_paths", "JOIN-12", sql=f"""WITH v AS (SELECT collection_id, name, lower(string_split(name, '/')[-1]) AS leaf FROM {DUCK.variables()}),
    n AS (SELECT collection_id, leaf, count(*) AS k, min(name) AS path FROM v GROUP BY 1, 2)
  SELECT request_id, variable, CASE WHEN variable LIKE '/%' OR k IS NULL THEN variable WHEN k = 1 THEN path END AS resolved,
    CASE WHEN variable LIKE '/%' THEN 'full_path' WHEN k IS NULL THEN 'unmatched' WHEN k = 1 THEN 'ok' ELSE 'ambiguous' END AS status
  FROM {_wanted(DUCK)} w LEFT JOIN n ON n.collection_id = w.collection_id AND n.leaf = lower(variable)""")
def variable_paths(spark, sf):
    return rt.resolve_paths(view(spark, sf, _wanted(SPARK)), fx.variable_table(spark, sf)).select(
        "request_id", "variable", "resolved", "status"
    )


@query("ambiguous_variable_paths", "JOIN-12", sql=f"""WITH v AS (SELECT collection_id, name, lower(string_split(name, '/')[-1]) AS leaf FROM {DUCK.variables()}),
    w AS (SELECT * FROM {_wanted(DUCK)} WHERE variable NOT LIKE '/%'), n AS (SELECT collection_id, leaf FROM v GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT request_id, variable, name AS path FROM w JOIN n ON n.collection_id = w.collection_id AND n.leaf = lower(variable)
    JOIN v ON v.collection_id = w.collection_id AND v.leaf = n.leaf""")
def ambiguous_variable_paths(spark, sf):
    v = fx.variable_table(spark, sf)
    return rt.ambiguous_paths(rt.resolve_paths(view(spark, sf, _wanted(SPARK)), v), v).select("request_id", "variable", "path")


def _layer_rows(v) -> tuple[str, str]:
    layers = f"""(SELECT p_brand AS product, CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END || p_type || ' ' || (p_partkey % 60) AS layer, p_partkey AS pos FROM {v.t('part')})"""
    asks = f"""(SELECT o_orderkey AS request_id, 'Brand#' || (o_custkey % 25 + 1) AS product,
        CASE o_orderkey % 4 WHEN 0 THEN 'economy_' WHEN 1 THEN 'Small ' WHEN 2 THEN '__STANDARD ' ELSE 'none ' END || (o_orderkey % 60) AS variable FROM {v.t('orders')})"""
    return layers, asks


_LAYERS, _ASKS = _layer_rows(DUCK)
_LAYER_KEY = lambda x: f"replace(lower(ltrim({x}, '_')), ' ', '_')"


@query("layer_match", "JOIN-13", sql=f"""WITH l AS (SELECT product, {_LAYER_KEY('layer')} AS key, max_by(layer, pos) AS layer FROM {_LAYERS} GROUP BY 1, 2)
  SELECT request_id, a.product, variable, layer, CASE WHEN layer IS NULL THEN 'no_layer' ELSE 'ok' END AS status
  FROM {_ASKS} a LEFT JOIN l ON l.product = a.product AND l.key = {_LAYER_KEY('variable')}""")
def layer_match(spark, sf):
    layers, asks = _layer_rows(SPARK)
    return rt.match_layers(view(spark, sf, asks), view(spark, sf, layers))


@query("available_layers", "JOIN-13", sql=f"""WITH l AS (SELECT product, {_LAYER_KEY('layer')} AS key FROM {_LAYERS}),
    bad AS (SELECT DISTINCT a.product FROM {_ASKS} a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.product = a.product AND l.key = {_LAYER_KEY('a.variable')}))
  SELECT DISTINCT product, layer FROM {_LAYERS} WHERE product IN (SELECT product FROM bad)""")
def available_layers(spark, sf):
    layers = view(spark, sf, _layer_rows(SPARK)[0])
    return rt.available_layers(layer_match(spark, sf), layers)


# -- column steps -----------------------------------------------------------------------------------


@query("time_range_text", "SCL-5", sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END AS start,
    CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate + INTERVAL 1 DAY END AS end,
    CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') END AS text
  FROM orders""")
def time_range_text(spark, sf):
    k = F.col("o_orderkey")
    a, b = F.col("o_orderdate"), F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate"))
    written = F.when(k % 4 == 0, temporal.format_range(a, b)).when(
        k % 4 == 1, F.concat(F.date_format(a, "yyyy-MM-dd"), F.lit("/"), F.date_format(b, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    ).when(k % 4 == 2, F.concat(F.date_format(a, "yyyy-MM-dd'T'02:00:00+02:00"), F.lit("/"), F.date_format(b, "yyyy-MM-dd"))
    ).otherwise(F.date_format(a, "yyyy-MM-dd"))
    r = table(spark, sf, "orders").select(k, temporal.parse_range(written).alias("r"))
    return r.select("o_orderkey", "r.start", "r.end", temporal.format_range(F.col("r.start"), F.col("r.end")).alias("text"))


@query("url_steps", "SCL-8", "SCL-9", "SCL-10", "SCL-12", sql=f"""SELECT k, CASE k % 4 WHEN 0 THEN regexp_replace(url, '\\.html$', '') WHEN 1 THEN url END AS access_url,
    CASE WHEN k % 5 = 0 THEN 'G' || k || '.nc4' WHEN k % 5 = 1 THEN 'G' || k || '.nc4' WHEN k % 5 = 2 THEN 'subset.nc4' ELSE 'plain.HDF5' END AS file_name,
    CASE WHEN k % 3 < 2 THEN 'j' || k END AS job_id,
    CASE WHEN k % 5 = 2 THEN 'application/octet-stream' ELSE 'application/netcdf4' END AS media_type
  FROM {DUCK.granules()}""")
def url_steps(spark, sf):
    g = view(spark, sf, SPARK.granules())
    k, text = F.col("k"), F.col("k").cast("string")
    entry = lambda u, s: F.struct(u.alias("URL"), F.lit("GET DATA").alias("Type"), s.alias("Subtype"))
    urls = F.array(entry(F.lit("https://example.org/page"), F.lit(None).cast("string")), entry(F.col("url"), F.col("subtype")))
    sub = (
        F.when(k % 5 == 0, F.concat(F.lit("https://h.example/a/G"), text, F.lit(".dap.nc4?dap4.ce=%2Fx")))
        .when(k % 5 == 1, F.concat(F.lit("https://h.example/a/G"), text, F.lit(".nc4.dap.nc4")))
        .when(k % 5 == 2, F.lit("https://h.example/a/")).otherwise(F.lit("https://h.example/plain.HDF5#x"))
    )
    job = F.when(k % 3 == 0, F.concat(F.lit("https://h.example/jobs/j"), text, F.lit("/?linktype=https"))).when(
        k % 3 == 1, F.concat(F.lit("https://h.example/jobs/j"), text, F.lit("#top")))
    stored = F.when(k % 5 == 2, F.lit("cube.zarr.zip")).otherwise(tx.file_name_from_url(sub))
    return g.select("k", tx.access_url(urls).alias("access_url"), tx.file_name_from_url(sub).alias("file_name"),
                    tx.job_id_from_url(job).alias("job_id"), tx.media_type_of(stored).alias("media_type"))


@query("name_steps", "SCL-11", "SCL-13", sql=f"""SELECT concept_id, CASE WHEN name LIKE '/%' THEN name ELSE '/' || name END AS qualified,
    lower(string_split(name, '/')[-1]) AS leaf, CASE WHEN pos < 3 THEN 'obs' WHEN pos = 3 THEN 'cube' END AS kind FROM {DUCK.variables()}""")
def name_steps(spark, sf):
    v = view(spark, sf, SPARK.variables())
    prefix = F.when(F.col("pos") < 3, "obs_").when(F.col("pos") == 3, "cube_").when(F.col("pos") == 4, "thing_").otherwise("obs")
    return v.select("concept_id", tx.qualified_name(F.col("name")).alias("qualified"), tx.leaf_name(F.col("name")).alias("leaf"),
                    tx.handle_kind(F.concat(prefix, F.lit("12ab"))).alias("kind"))


_WORDS = ("accepted", "RUNNING", "running_with_errors", "previewing", "Successful", "complete_with_errors", "failed", "canceled", "odd", "done", "queued", "deleted")


@query("status_words", "SCL-14", sql="""SELECT o_orderkey, w AS word, CASE w WHEN 'accepted' THEN 'submitted' WHEN 'Successful' THEN 'ready' WHEN 'complete_with_errors' THEN 'ready'
    WHEN 'failed' THEN 'failed' WHEN 'canceled' THEN 'cancelled' ELSE 'running' END AS service_state,
    CASE w WHEN 'done' THEN 'ready' WHEN 'queued' THEN 'submitted' WHEN 'deleted' THEN 'cancelled' ELSE 'running' END AS point_state
  FROM (SELECT o_orderkey, [{}][o_orderkey % 12 + 1] AS w FROM orders)""".format(", ".join(f"'{w}'" for w in _WORDS)))
def status_words(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", word.alias("word")).select(
        "o_orderkey", "word", tx.job_state_of(F.col("word"), tx.SERVICE_STATES).alias("service_state"),
        tx.job_state_of(F.col("word"), tx.POINT_STATES).alias("point_state"),
    )


@query("date_steps", "SCL-6", "SCL-7", sql="""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS preview_date,
  strftime(o_orderdate, '%m-%d-%Y') AS task_date FROM orders""")
def date_steps(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 1, F.date_format("o_orderdate", " yyyy-MM-dd'T'HH:mm:ss'Z/2030-01-01'")).when(
        k % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.start_date(text).alias("preview_date"), tx.us_date(F.col("o_orderdate")).alias("task_date")
    )


# -- manifests -----------------------------------------------------------------------------------------


def _subset_requests(v) -> str:
    """One subset request per area of interest: the same boxes, two variables."""
    return f"""(SELECT a.*, s_suppkey AS k FROM {v.aois()} a JOIN {v.t('supplier')} ON s_suppkey = request_id)"""


def _ce_sql() -> str:
    lat = "'[' || la0 || ':' || greatest(la0, la1) || ']'"
    lon = "CASE WHEN w <= e THEN '[' || lo0 || ':' || greatest(lo0, lo1) || ']' ELSE '' END"
    clamp = lambda f, x, o, st, n: f"greatest(0, least({n} - 1, CAST({f}(({x} - {o}) / {st}) AS BIGINT)))"
    fq = lambda x: f"CASE WHEN {x} LIKE '/%' THEN {x} ELSE '/' || {x} END"
    return f"""x AS (SELECT r.*, c.k AS ck, c.w AS cw, c.s AS cs, c.known AND output_shape = 'grid' AS cut, c.n_lat, c.n_lon, c.lat_step, c.lon_step, {_names('c.k')}
      FROM {_subset_requests(DUCK)} r JOIN (SELECT *, CASE WHEN processing_level = '2' THEN 'swath' ELSE 'grid' END AS output_shape FROM {AXES_SQL}) c ON c.concept_id = r.collection_id),
    y AS (SELECT *, {clamp('floor', 's', '(cs + lat_step / 2)', 'lat_step', 'n_lat')} AS la0, {clamp('ceil', 'n', '(cs + lat_step / 2)', 'lat_step', 'n_lat')} AS la1,
      {clamp('floor', 'w', '(cw + lon_step / 2)', 'lon_step', 'n_lon')} AS lo0, {clamp('ceil', 'e', '(cw + lon_step / 2)', 'lon_step', 'n_lon')} AS lo1,
      CASE WHEN ck % 7 = 0 THEN NULL WHEN ck % 3 = 1 THEN '/product/ndvi' ELSE 'ndvi' END AS v1,
      CASE WHEN ck % 3 = 1 THEN '/support/QA Flag' ELSE 'QA Flag' END AS v2 FROM x),
    z AS (SELECT *, CASE WHEN cut THEN {lat} ELSE '' END AS la, CASE WHEN cut THEN {lon} ELSE '' END AS lo FROM y),
    ce AS (SELECT request_id, CASE WHEN ck % 7 > 0 THEN concat_ws(';', {fq('coord_lat')} || la, {fq('coord_lon')} || lo, {fq('coord_time')},
      {fq('v1')} || CASE WHEN cut THEN '[0:0]' || la || lo ELSE '' END,
      {fq('v2')} || CASE WHEN cut AND ck % 5 > 0 THEN '[0:2]' || la || lo ELSE '' END) END AS expr FROM z)"""


def _constrained(spark, sf):
    """Requests for ``ndvi`` and ``qa flag`` with resolved names, plans and constraints."""
    r = view(spark, sf, _subset_requests(SPARK))
    v = cut_lineage(fx.variable_table(spark, sf), "variables")
    wanted = r.select("request_id", "collection_id", F.posexplode(F.array(F.lit("ndvi"), F.lit("qa flag"))).alias("pos", "variable"))
    resolved = rt.resolve_paths(wanted, v)
    coordinates = ax.discover_coordinates(v)
    plans = mf.with_dimension_plans(resolved, v, coordinates).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("resolved").alias("name"), "dim_plan"))).alias("variables"),
        F.bool_or(F.col("status") == "ambiguous").alias("ambiguous"),
    )
    axes = ax.collection_axes(_extents(spark, sf), ax.axis_lengths(v, coordinates))
    shape = view(spark, sf, SPARK.collections()).select(
        F.col("concept_id").alias("collection_id"),
        F.when(F.col("processing_level") == "2", "swath").otherwise("grid").alias("output_shape"),
    )
    full = (
        r.join(by_shuffle(plans), "request_id", "left").join(by_shuffle(axes), "collection_id").join(by_shuffle(shape), "collection_id")
        .select("request_id", "variables", "ambiguous", "coord_lat", "coord_lon", "coord_time", "lat_axis", "lon_axis", "output_shape",
                F.lit(True).alias("needs_bbox"), F.struct("w", "s", "e", "n").alias("bbox"))
    )
    return mf.constraint_expressions(full)


@query("constraint_expressions", "MAN-1", "FLT-3", "AX-1", "AX-3", sql=f"WITH {_ce_sql()} SELECT request_id, expr AS constraint, CASE WHEN expr IS NULL THEN 'ambiguous' ELSE 'ok' END AS status FROM ce")
def constraint_expressions(spark, sf):
    return _constrained(spark, sf).select("request_id", "constraint", "status")


_ENC = "replace(replace(replace(replace(replace(replace(expr, '/', '%2F'), ' ', '%20'), ';', '%3B'), '[', '%5B'), ']', '%5D'), ':', '%3A')"


@query("subset_manifest", "MAN-1", "SCL-8", "SCL-9", sql=f"""WITH {_ce_sql()}, p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY time_start, granule_ur) AS rank FROM ({PAIRS_SQL})),
    q AS (SELECT p.request_id, rank, p.granule_ur, CASE g.k % 4 WHEN 0 THEN regexp_replace(url, '\\.html$', '') WHEN 1 THEN url END AS base
      FROM p JOIN {DUCK.granules()} g ON g.granule_ur = p.granule_ur)
  SELECT q.request_id, rank, (rank - 1) // 50 AS batch, granule_ur, CASE WHEN expr IS NULL THEN 'ambiguous' ELSE 'ok' END AS status,
    base || '.dap.nc4' || '?dap4.ce=' || {_ENC} AS url,
    CASE WHEN expr IS NULL THEN NULL WHEN base LIKE '%.nc4' THEN string_split(base, '/')[-1] ELSE string_split(base, '/')[-1] || '.nc4' END AS file_name
  FROM q JOIN ce ON ce.request_id = q.request_id WHERE base IS NOT NULL""")
def subset_manifest(spark, sf):
    # Equal requests meet the granules once. Names only go through the overlap join; the URLs are attached to what it found.
    g = md.parse_granules(fx.granule_records(spark, sf)).select("granule_ur", tx.access_url(F.col("related_urls")).alias("access_url"))
    boxes = view(spark, sf, SPARK.granules()).select("granule_ur", "collection_id", "w", "s", "e", "n", "time_start", "time_end")
    distinct, members = cov.like_requests(view(spark, sf, SPARK.aois()))
    pairs = cov.overlap_join(distinct.withColumnRenamed("_asked", "request_id"), boxes).select("request_id", "granule_ur", "time_start")
    ranked = cov.first_granules(pairs.join(by_shuffle(g), "granule_ur"), None).withColumn("rank", F.col("rank").cast("long"))
    constrained = _constrained(spark, sf).join(by_shuffle(members), "request_id")
    return mf.subset_manifest(constrained, ranked.withColumnRenamed("request_id", "_asked"), "_asked")


def _preview_rows(v) -> str:
    k = "o_orderkey"
    return f"""(SELECT {k} AS request_id, CASE WHEN {k} % 5 = 0 THEN 'My Layer*~' END AS explicit_layer, CASE WHEN {k} % 5 = 1 THEN 'Stored' END AS payload_layer,
        CASE WHEN {k} % 5 = 2 THEN 'Tagged_' || o_custkey WHEN {k} % 5 = 3 THEN '' END AS tag_layer, CASE WHEN {k} % 7 > 0 THEN 'SN' || o_custkey END AS short_name,
        {k} % 3 AS box_kind, CAST(-180 + {k} % 300 AS DOUBLE) / 2 AS w, CAST(-90 + {k} % 100 AS DOUBLE) AS s, CAST(-180 + {k} % 300 AS DOUBLE) / 2 + 7.25 AS e, CAST(-80 + {k} % 100 AS DOUBLE) AS n,
        CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 4 = 1 THEN '' ELSE '2024-03-0' || (1 + {k} % 9) || 'T05:00:00Z/2024-04-01' END AS time_range FROM {v.t('orders')})"""


def _preview_sql() -> str:
    layer = "coalesce(explicit_layer, payload_layer, nullif(tag_layer, ''), short_name)"
    num = lambda x: f"CAST({x} AS VARCHAR)"
    return f"""WITH p AS (SELECT *, {layer} AS layer, CASE WHEN explicit_layer IS NOT NULL THEN 'explicit' WHEN payload_layer IS NOT NULL THEN 'handle_payload'
        WHEN nullif(tag_layer, '') IS NOT NULL THEN 'cmr_tags' ELSE 'short_name_guess' END AS lookup_source,
        CASE WHEN box_kind = 2 THEN -180.0::DOUBLE ELSE w END AS bw, CASE WHEN box_kind = 2 THEN -90.0::DOUBLE ELSE s END AS bs,
        CASE WHEN box_kind = 2 THEN 180.0::DOUBLE ELSE e END AS be, CASE WHEN box_kind = 2 THEN 90.0::DOUBLE ELSE n END AS bn,
        substr(nullif(time_range, ''), 1, 10) AS time FROM {_preview_rows(DUCK)})
      SELECT request_id, layer, lookup_source, lookup_source = 'short_name_guess' AS layer_is_guess,
        {num('bw')} || ',' || {num('bs')} || ',' || {num('be')} || ',' || {num('bn')} AS bbox, time,
        '{mf.PREVIEW_ENDPOINT}?SERVICE=WMS&REQUEST=GetMap&VERSION=1.3.0&LAYERS=' || replace(replace(layer, ' ', '+'), '*', '%2A') || '&CRS=EPSG%3A4326&BBOX='
          || {num('bs')} || '%2C' || {num('bw')} || '%2C' || {num('bn')} || '%2C' || {num('be')} || '&WIDTH=512&HEIGHT=512&FORMAT=image%2Fpng'
          || coalesce('&TIME=' || time, '') AS url FROM p"""


@query("preview_manifest", "MAN-2", "SCL-6", "SCL-15", sql=_preview_sql())
def preview_manifest(spark, sf):
    box = F.struct("w", "s", "e", "n")
    p = view(spark, sf, _preview_rows(SPARK))
    return mf.preview_manifest(p.withColumns({
        "aoi": F.when(F.col("box_kind") == 0, box), "extent": F.when(F.col("box_kind") == 1, box),
    }))


@query("point_tasks", "MAN-3", "SCL-7", "JOIN-13", sql="""SELECT o_orderkey AS request_id, 'P' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.061' ELSE '' END AS product,
    '{"task_type":"point","task_name":"graticule P' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.061' ELSE '' END
    || '","params":{"coordinates":[{"latitude":' || (o_orderkey % 90) || '.5,"longitude":' || (o_orderkey % 180) || '.25,"id":"0","category":"site"}],"layers":[{"product":"P'
    || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.061' ELSE '' END || '","layer":"_ndvi"}]'
    || CASE WHEN o_orderkey % 3 > 0 THEN ',"dates":[{"startDate":"' || strftime(o_orderdate, '%m-%d-%Y') || '","endDate":"' || strftime(o_orderdate + INTERVAL 30 DAY, '%m-%d-%Y') || '"}]' ELSE '' END
    || '}}' AS task FROM orders""")
def point_tasks(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dated = k % 3 > 0
    return mf.point_tasks(table(spark, sf, "orders").select(
        k.alias("request_id"), F.concat(F.lit("P"), c.cast("string")).alias("short_name"),
        F.when(c % 2 == 0, "061").otherwise("").alias("version"),
        ((k % 90) + 0.5).cast("double").alias("lat"), ((k % 180).cast("double") + 0.25).alias("lon"), F.array(F.lit("_ndvi")).alias("layers"),
        F.when(dated, F.col("o_orderdate")).alias("start"), F.when(dated, F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate"))).alias("end"),
    ))
