"""Queries over lineage tables and job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graticule.operators import jobs as jb
from graticule.operators import lineage as ln
from graticule.operators import stats as st
from graticule.plans.fixtures import DUCK, SPARK, table, view
from graticule.plans.registry import query
from graticule.session import cut_lineage

_WALK = f"""WITH RECURSIVE e AS (SELECT DISTINCT ws, target, source FROM {DUCK.edges()}),
  up(ws, handle, ancestor, depth) AS (
    SELECT ws, target, source, 1 FROM e {{start}}
    UNION
    SELECT up.ws, up.handle, e.source, up.depth + 1 FROM up JOIN e ON e.ws = up.ws AND e.target = up.ancestor WHERE up.depth < {{limit}})
  SELECT ws, handle, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2, 3"""


@query("ancestry_closure", "LIN-1", sql=_WALK.format(start="", limit=160))
def ancestry_closure(spark, sf):
    return ln.ancestry_closure(view(spark, sf, SPARK.edges()))


def _handles(v) -> str:
    return f"""(SELECT 'b' AS ws, 't' || conv_id || '_' || turn AS handle FROM {v.t('conversations')}
      UNION ALL SELECT 'a', 'c' || c_custkey FROM {v.t('customer')})"""


@query("ancestry_of_handles", "LIN-1", sql=_WALK.format(start=f"SEMI JOIN {_handles(DUCK)} h ON h.ws = e.ws AND h.handle = e.target", limit=40))
def ancestry_of_handles(spark, sf):
    return ln.ancestry(view(spark, sf, SPARK.edges()), view(spark, sf, _handles(SPARK)))


@query("ancestry_extended", "LIN-1", "LIN-2", sql=_WALK.format(start="", limit=160))
def ancestry_extended(spark, sf):
    """The closure of six sevenths of the edges, then the rest appended."""
    edges = view(spark, sf, SPARK.edges()).select("ws", "target", "source")
    late = F.pmod(F.xxhash64("target", "source"), F.lit(7)) == 0
    stored = cut_lineage(ln.ancestry_closure(edges.where(~late)), "stored_closure")
    return ln.extended_closure(stored, edges.where(late))


_RESULTS = "(SELECT 'obs_' || user_id AS target, 'a' AS ws, 'dataset_' || (user_id % 20) AS source, user_id AS id FROM {events})"


@query("provenance_view", "LIN-14", "WIN-4", "LIN-1", sql=f"""WITH h AS (SELECT DISTINCT ws, handle FROM {DUCK.events_log()})
  SELECT ws, handle, 'ancestor' AS part, ancestor, 1 AS depth, NULL AS event_type, CAST(NULL AS TIMESTAMP) AS created_at, NULL AS id FROM (
    SELECT DISTINCT h.ws, h.handle, 'dataset_' || (user_id % 20) AS ancestor FROM events JOIN h ON h.handle = 'obs_' || user_id AND h.ws = 'a')
  UNION ALL SELECT ws, handle, 'event', NULL, NULL, event_type, created_at, id FROM {DUCK.events_log()}""")
def provenance_view(spark, sf):
    log = view(spark, sf, SPARK.events_log())
    return ln.provenance_view(view(spark, sf, _RESULTS), log, log.select("ws", "handle").distinct())


# -- edges and events ----------------------------------------------------------------------


@query("edge_acceptance", "LIN-2", sql=f"SELECT id, spec_kind NOT IN (1, 2) AS accepted FROM {DUCK.spec_edges()}")
def edge_acceptance(spark, sf):
    good, bad = ln.split_edges(view(spark, sf, SPARK.spec_edges()))
    return good.select("id", F.lit(True).alias("accepted")).unionByName(bad.select("id", F.lit(False).alias("accepted")))


@query("derived_edges", "LIN-3", "LIN-2", "LIN-6", sql="""WITH r AS (SELECT o_orderkey, 'cube_' || o_orderkey AS target, 'obs_' || o_custkey AS s0, 'obs_x' || (o_orderkey % 9) AS s1,
    CASE WHEN o_orderkey % 6 = 0 THEN '"https://h.example/' || o_orderkey || '"' WHEN o_orderkey % 6 = 1 THEN 'null' ELSE '"a=b"' END AS origin FROM orders),
  k AS (SELECT *, substr(sha256('{"operation":"resample","parameters":[{"key":"freq","value":"' || (o_orderkey % 3) || 'h"},{"key":"origin","value":' || origin || '}],"sources":["' || s0 || '","' || s1 || '"]}'), 1, 24) AS key FROM r)
  SELECT target, unnest([s0, s1]) AS source, o_orderkey % 6 > 0 AS accepted, '{"operation":"resample","freq":"' || (o_orderkey % 3) || 'h","origin":' || origin
    || ',"workspace_id":"a","cube_handle":"' || target || '","output_format":"application/netcdf4","cache_key":"' || key || '"}' AS spec FROM k""")
def derived_edges(spark, sf):
    k = F.col("o_orderkey")
    origin = F.when(k % 6 == 0, F.concat(F.lit("https://h.example/"), k.cast("string"))).when(k % 6 > 1, "a=b")
    results = table(spark, sf, "orders").select(
        F.lit("a").alias("ws"), F.concat(F.lit("cube_"), k.cast("string")).alias("target"),
        F.array(F.concat(F.lit("obs_"), F.col("o_custkey").cast("string")), F.concat(F.lit("obs_x"), (k % 9).cast("string"))).alias("sources"),
        F.lit("resample").alias("operation"),
        F.create_map(F.lit("origin"), origin, F.lit("freq"), F.concat((k % 3).cast("string"), F.lit("h"))).alias("parameters"),
        F.lit("application/netcdf4").alias("output_format"), F.col("o_orderdate").alias("created_at"),
    )
    return ln.derived_edges(results).select("target", "source", "spec", "accepted")


@query("event_acceptance", "LIN-4", sql=f"SELECT id, event_type, coalesce(detail, '{{}}') AS detail, event_type <> 'deleted' AS accepted FROM {DUCK.events_log()}")
def event_acceptance(spark, sf):
    good, bad = ln.split_events(view(spark, sf, SPARK.events_log()))
    pick = lambda df, ok: df.select("id", "event_type", "detail", F.lit(ok).alias("accepted"))
    return pick(good, True).unionByName(pick(bad, False))


@query("latest_specs", "WIN-3", sql=f"""WITH h AS (SELECT DISTINCT ws, target FROM {DUCK.spec_edges()}),
    s AS (SELECT ws, target, max_by(spec, (created_at, id)) FILTER (spec IS NOT NULL) AS spec FROM {DUCK.spec_edges()} GROUP BY 1, 2)
  SELECT h.ws, h.target AS handle, spec, CASE WHEN spec IS NULL THEN 'none' ELSE 'ok' END AS status FROM h LEFT JOIN s ON s.ws = h.ws AND s.target = h.target""")
def latest_specs(spark, sf):
    e = view(spark, sf, SPARK.spec_edges())
    return ln.latest_specs(e, e.select("ws", F.col("target").alias("handle")).distinct())


@query("event_timeline", "WIN-4", sql=f"SELECT handle, event_type, created_at, id FROM {DUCK.events_log()} WHERE ws = 'a' ORDER BY handle, created_at DESC, id DESC")
def event_timeline(spark, sf):
    return ln.event_timeline(view(spark, sf, SPARK.events_log()), "a").select("handle", "event_type", "created_at", "id")


# -- keys and specs ---------------------------------------------------------------------------


@query("retrieval_keys", "LIN-5", sql="""SELECT o_orderkey, substr(sha256(concat_ws(':', 'SN' || o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'text/csv' ELSE 'image/png' END,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(-(o_orderkey % 180) AS DOUBLE) / 4 AS VARCHAR) || ',0.0005,' || CAST(CAST(o_orderkey % 180 AS DOUBLE) AS VARCHAR) || ',90.0' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '2024-01-01/2024-01-' || (10 + o_orderkey % 20) END, 'a' || (o_orderkey % 7) || ',b,c', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'svc' END, '2')), 1, 24) AS key
  FROM orders""")
def retrieval_keys(spark, sf):
    k = F.col("o_orderkey")
    box = F.struct((-(k % 180).cast("double") / 4).alias("w"), F.lit(0.0005).alias("s"), (k % 180).cast("double").alias("e"), F.lit(90.0).alias("n"))
    return table(spark, sf, "orders").select(k, ln.retrieval_key(
        F.concat(F.lit("SN"), F.col("o_custkey").cast("string")), F.when(k % 2 == 0, "text/csv").otherwise("image/png"),
        F.when(k % 3 > 0, box), F.when(k % 5 > 0, F.concat(F.lit("2024-01-01/2024-01-"), (10 + k % 20).cast("string"))),
        F.array(F.lit("c"), F.concat(F.lit("a"), (k % 7).cast("string")), F.lit("b")), F.when(k % 2 == 1, "svc"), F.lit("2"),
    ).alias("key"))


@query("transform_keys", "LIN-6", sql="""SELECT o_orderkey, substr(sha256('{"operation":"subset","parameters":[{"key":"a=b","value":null},{"key":"bbox","value":"' || (o_orderkey % 50) || '"},{"key":"vars","value":"x=y"}],"sources":["obs_' || o_custkey || '"]}'), 1, 24) AS key FROM orders""")
def transform_keys(spark, sf):
    k = F.col("o_orderkey")
    params = F.create_map(F.lit("vars"), F.lit("x=y"), F.lit("bbox"), (k % 50).cast("string"), F.lit("a=b"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select(k, ln.transform_key(
        F.lit("subset"), F.array(F.concat(F.lit("obs_"), F.col("o_custkey").cast("string"))), params).alias("key"))


def _legacy_specs(v) -> str:
    """Specs as stored over time: full, without flags and provider, with a lone URL."""
    k, o, c = "o_orderkey", v.json_open, v.json_close
    return f"""(SELECT {k} AS id, '{o}"concept_id":"C' || o_custkey || '"' || CASE {k} % 3
        WHEN 0 THEN ',"output_format":"image/png","needs_bbox":true,"aoi_bbox":[-1.5,2.0,3.0,4.0],"variables":["a","b"],"provider":"opendap","opendap_urls":["u1","u2"],"lat_axis":{o}"name":"lat","origin":-59.875,"step":0.25,"length":600{c},"var_dims":{o}"a":[["lat",null]]{c},"cache_key":"k"'
        WHEN 1 THEN ',"output_format":"","opendap_url":"only","aoi_bbox":[]' ELSE '' END || '{c}' AS spec FROM {v.t('orders')})"""


@query("spec_upgrade", "LIN-9", sql="""SELECT o_orderkey AS id, 'C' || o_custkey AS concept_id, CASE WHEN o_orderkey % 3 = 0 THEN 'image/png' ELSE 'application/netcdf4' END AS output_format,
    o_orderkey % 3 = 0 AS needs_bbox, false AS needs_point_sample, CASE WHEN o_orderkey % 3 = 0 THEN -1.5::DOUBLE END AS west, CASE WHEN o_orderkey % 3 = 0 THEN 'a,b' ELSE '' END AS variables,
    CASE WHEN o_orderkey % 3 = 0 THEN 'opendap' ELSE 'harmony' END AS provider, CASE o_orderkey % 3 WHEN 0 THEN 'u1,u2' WHEN 1 THEN 'only' ELSE '' END AS urls,
    CASE WHEN o_orderkey % 3 = 0 THEN 600::BIGINT END AS lat_length, CASE WHEN o_orderkey % 3 = 0 THEN 'k' ELSE '' END AS cache_key FROM orders""")
def spec_upgrade(spark, sf):
    s = ln.read_specs(view(spark, sf, _legacy_specs(SPARK)))
    return s.select("id", "concept_id", "output_format", "needs_bbox", "needs_point_sample", F.col("aoi_bbox")[0].alias("west"),
                    F.array_join("variables", ",").alias("variables"), "provider", F.array_join("opendap_urls", ",").alias("urls"),
                    F.col("lat_axis.length").alias("lat_length"), "cache_key")


@query("spec_round_trip", "LIN-9", sql="""SELECT o_orderkey AS id, 25 AS n_keys, CASE o_orderkey % 3 WHEN 0 THEN 'u1' WHEN 1 THEN 'only' END AS opendap_url,
    true AS same FROM orders""")
def spec_round_trip(spark, sf):
    first = ln.read_specs(view(spark, sf, _legacy_specs(SPARK)))
    written = ln.write_specs(first, "json")
    again = ln.write_specs(ln.read_specs(written.withColumn("_first", F.col("json")), "json"), "json")
    return again.select("id", F.json_object_keys("json").alias("keys"), "json", "_first").select(
        "id", F.size("keys").alias("n_keys"), F.get_json_object("json", "$.opendap_url").alias("opendap_url"), (F.col("json") == F.col("_first")).alias("same"))


# -- handles ---------------------------------------------------------------------------------------


def _lookups(v) -> str:
    return f"""(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS ws, CASE o_orderkey % 11 WHEN 0 THEN 'nonsense' WHEN 1 THEN 'thing_1'
        WHEN 2 THEN 'obs_missing' ELSE CASE o_custkey % 4 WHEN 0 THEN 'obs_' WHEN 1 THEN 'cube_' WHEN 2 THEN 'dataset_' ELSE 'aoi_' END || o_custkey END AS handle FROM {v.t('orders')})"""


@query("handle_resolution", "LIN-7", "SCL-13", sql=f"""SELECT ws, l.handle, CASE WHEN o.k % 11 IN (0, 1) THEN NULL ELSE string_split(l.handle, '_')[1] END AS kind,
    CASE WHEN o.k % 11 IN (0, 1) THEN 'not_a_handle' WHEN l.handle LIKE 'aoi%' THEN 'wrong_kind' WHEN h.owner IS NULL THEN 'not_found'
      WHEN h.owner <> ws THEN 'other_workspace' WHEN l.handle NOT LIKE 'dataset%' AND (h.k % 5 = 0 OR h.k % 7 = 0) THEN 'not_ready' ELSE 'ok' END AS status
  FROM {_lookups(DUCK)} l JOIN (SELECT o_orderkey AS k FROM orders) o ON o.k = l.id LEFT JOIN {DUCK.handles()} h ON h.handle = l.handle""")
def handle_resolution(spark, sf):
    found = ln.resolve_handles(view(spark, sf, _lookups(SPARK)), view(spark, sf, SPARK.handles()), ("obs", "cube", "dataset"))
    return found.select("ws", "handle", "kind", "status")


@query("handle_listing", "LIN-7", sql=f"SELECT handle, created_at FROM {DUCK.handles()} WHERE owner = 'b' AND handle LIKE 'obs%' ORDER BY created_at, handle")
def handle_listing(spark, sf):
    return ln.list_handles(view(spark, sf, SPARK.handles()), "b", "obs").select("handle", "created_at")


@query("payload_merge", "LIN-8", sql="""WITH u AS (SELECT user_id, event_id, unnest(['last', 'k' || (event_id % 3)]) AS key,
    unnest([CAST(event_id AS VARCHAR), CASE WHEN event_id % 4 > 0 THEN event_type END]) AS value FROM events),
  m AS (SELECT user_id, key, arg_max_null(value, event_id) AS value FROM u GROUP BY 1, 2)
  SELECT 'obs_' || user_id AS handle, string_agg(key || '=' || coalesce(value, ''), ',' ORDER BY key) AS payload FROM m GROUP BY 1""")
def payload_merge(spark, sf):
    k = F.col("event_id")
    updates = table(spark, sf, "events").select(
        F.concat(F.lit("obs_"), F.col("user_id").cast("string")).alias("handle"), k.alias("seq"),
        F.create_map(F.lit("last"), k.cast("string"), F.concat(F.lit("k"), (k % 3).cast("string")), F.when(k % 4 > 0, F.col("event_type"))).alias("payload"),
    )
    merged = ln.merge_payloads(updates)
    pairs = F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return merged.select("handle", F.array_join(pairs, ",").alias("payload"))


@query("materialization_summary", "AGG-9", sql=f"""SELECT handle, CASE WHEN k % 5 = 0 THEN 'pending' ELSE 'ready' END AS status,
  CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN 'text/csv' END AS media_type, k % 5 > 0 AND k % 7 > 0 AS summarizable FROM {DUCK.handles()}""")
def materialization_summary(spark, sf):
    h = view(spark, sf, SPARK.handles())
    part = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    return st.materialization_summary(h.select("handle", part("status"), part("storage_key"), part("media_type")))


# -- job logs -----------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, targets in jb.LEGAL.items() for b in targets)


@query("illegal_transitions", "WIN-5", sql=f"""SELECT job_id, seq, previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS previous FROM {DUCK.job_log()})
  WHERE previous IS NOT NULL AND (previous, state) NOT IN ({_PAIRS})""")
def illegal_transitions(spark, sf):
    return jb.illegal_transitions(view(spark, sf, SPARK.job_log())).drop("created_at")


@query("job_status", "WIN-6", sql=f"SELECT job_id, max_by(state, seq) AS state, max_by(progress, seq) AS progress, arg_max_null(error, seq) AS error, min(created_at) AS first_seen FROM {DUCK.job_log()} GROUP BY 1")
def job_status(spark, sf):
    return jb.job_status(view(spark, sf, SPARK.job_log())).drop("created_at")


@query("unfinished_jobs", "WIN-6", sql=f"""SELECT job_id, first_seen, state, CASE state WHEN 'pending' THEN 'submit_job' WHEN 'submitted' THEN 'poll_job' WHEN 'running' THEN 'poll_job'
    ELSE 'materialize_job' END AS resume_step FROM (SELECT job_id, max_by(state, seq) AS state, min(created_at) AS first_seen FROM {DUCK.job_log()} GROUP BY 1)
  WHERE state IN ('pending', 'submitted', 'running', 'materializing') ORDER BY first_seen, job_id""")
def unfinished_jobs(spark, sf):
    return jb.unfinished_jobs(view(spark, sf, SPARK.job_log()))


@query("failure_reports", "LIN-12", sql="""WITH f AS (SELECT event_id AS job_id, CASE WHEN event_id % 2 = 0 THEN 'submit' ELSE 'poll' END AS stage, 'harmony' AS provider,
    CASE WHEN event_id % 4 = 0 THEN 'no fallback' END AS prefix, CASE event_id % 3 WHEN 0 THEN 'Bad: ' || event_type WHEN 1 THEN 'Timeout' ELSE 'lost ' || event_id END AS message FROM events)
  SELECT job_id, message, coalesce(prefix, stage || '/' || provider || ' failed') || ': ' || message AS error FROM f""")
def failure_reports(spark, sf):
    k = F.col("event_id")
    failures = table(spark, sf, "events").select(
        k.alias("job_id"), F.when(k % 2 == 0, "submit").otherwise("poll").alias("stage"), F.lit("harmony").alias("provider"),
        F.when(k % 4 == 0, "no fallback").alias("error_prefix"), F.lit("Timeout").alias("error_type"),
        F.when(k % 3 == 0, F.array(F.lit("Bad"), F.col("event_type"))).when(k % 3 == 1, F.array(F.lit("")))
        .otherwise(F.array(F.concat(F.lit("lost "), k.cast("string")))).alias("messages"),
    )
    return jb.failure_reports(failures).select("job_id", "message", "error")
