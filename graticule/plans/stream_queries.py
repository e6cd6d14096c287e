"""Queries that run a stream over the driver tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from graticule.operators.jobs import LEGAL
from graticule.plans.fixtures import DUCK, SPARK, table, view
from graticule.plans.registry import query
from graticule.session import scratch_path
from graticule.streaming import ingest, job_state, means


def _stream(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_granule_ingest", "STR-1", sql="SELECT DISTINCT 'G' || (o_orderkey // 3) AS concept_id FROM orders")
def stream_granule_ingest(spark, sf):
    ident = F.concat(F.lit("G"), F.floor(F.col("o_orderkey") / 3).cast("string"))
    raw = F.to_json(F.struct(F.struct(ident.alias("concept-id")).alias("meta"), F.struct(ident.alias("GranuleUR")).alias("umm")))
    records = _stream(spark, sf, "orders").select(raw.alias("raw"), F.col("o_orderdate").cast("timestamp").alias("received_at"))
    path = scratch_path(spark, "granules")
    ingest.append_batches(
        ingest.ingest_granules(records, "4000 days"), path, scratch_path(spark, "granules-progress")
    ).awaitTermination()
    return spark.read.option("basePath", path).parquet(path).select("concept_id")


def _in_batches(spark, frame, label: str, consume) -> str:
    """Write ``frame`` batch by batch (column ``_batch``, 0 to 2); run a stream to its end after each."""
    folder = scratch_path(spark, label)
    for batch in range(3):
        frame.where(F.col("_batch") == batch).drop("_batch").write.mode("append").parquet(folder)
        consume(spark.readStream.schema(frame.drop("_batch").schema).parquet(folder)).awaitTermination()
    return folder


# Rows of the first sixth whose number is 4 modulo 9 come with the last third: long too late.
_HELD = "event_id % 9 = 4 AND 6 * (second - low) < high - low"
_TIMED = f"""(SELECT *, CASE WHEN {_HELD} THEN 2 ELSE least(2, 3 * (second - low) // (high - low + 1)) END AS _batch, {_HELD} AS held
  FROM (SELECT *, CAST(epoch(ts) AS BIGINT) AS second, CAST(epoch((SELECT min(ts) FROM events)) AS BIGINT) AS low,
    CAST(epoch((SELECT max(ts) FROM events)) AS BIGINT) AS high FROM events))"""


def _timed_cells(spark, sf):
    """Events as cells in three batches."""
    events = table(spark, sf, "events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    bounds = events.agg(F.struct(F.min("second").alias("low"), F.max("second").alias("high"))).scalar()
    since, span = F.col("second") - bounds["low"], bounds["high"] - bounds["low"]
    held = (F.col("event_id") % 9 == 4) & (6 * since < span)
    batch = F.when(held, 2).otherwise(F.least(F.lit(2), F.floor(3 * since / (span + 1))))
    return events.select(
        F.col("ts").cast("timestamp").alias("time"), (F.col("user_id") % 6).alias("lat_idx"),
        F.round(F.col("value") * 100).cast("long").alias("v"), batch.cast("int").alias("_batch"),
    )


@query("stream_running_means", "STR-2", sql=f"""WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM {_TIMED})
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, user_id % 6 AS lat_idx, avg(v) AS v FROM e
  WHERE NOT held AND CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY 1, 2""")
def stream_running_means(spark, sf):
    path, progress = scratch_path(spark, "means"), scratch_path(spark, "means-progress")

    def consume(stream):
        out = means.stream_means(stream, "h", ["v"], ["lat_idx"], "2 hours")
        return out.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", progress).trigger(availableNow=True).start()

    _in_batches(spark, _timed_cells(spark, sf), "timed-events", consume)
    return spark.read.parquet(path).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("stream_means_view", "STR-2", sql=f"""WITH e AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, user_id % 6 AS lat_idx, CAST(round(value * 100) AS BIGINT) AS v FROM events),
    b AS (SELECT unnest(generate_series((SELECT min(time) FROM e), (SELECT max(time) FROM e), INTERVAL 1 HOUR)) AS time)
  SELECT b.time, c.lat_idx, avg(v) AS v FROM b CROSS JOIN (SELECT DISTINCT lat_idx FROM e) c LEFT JOIN e ON e.time = b.time AND e.lat_idx = c.lat_idx GROUP BY 1, 2""")
def stream_means_view(spark, sf):
    """Sums of three micro-batches, the last with rows that come long too late, read as means without gaps."""
    path, progress = scratch_path(spark, "sums"), scratch_path(spark, "sums-progress")

    def consume(stream):
        return means.append_sums(means.stream_sums(stream, "h", ["v"], ["lat_idx"]), ["v"], ["lat_idx"], path, progress)

    _in_batches(spark, _timed_cells(spark, sf), "summed-events", consume)
    return means.means_view(spark, path, "h", ["v"], ["lat_idx"])


_PAIRS_OK = "(previous, state) IN (" + ", ".join(
    f"('{a}', '{b}')" for a, targets in LEGAL.items() for b in targets
) + ")"


@query("stream_job_states", "STR-3", sql=f"""WITH b AS (SELECT *, (SELECT max(event_id) FROM events) AS m FROM {DUCK.job_log()}),
    l AS (SELECT *, seq % 7 = 3 AND 3 * seq <= m AS held, max(CASE WHEN 3 * seq <= 2 * m AND NOT (seq % 7 = 3 AND 3 * seq <= m) THEN seq END) OVER (PARTITION BY job_id) AS known FROM b),
    k AS (SELECT *, held AND coalesce(known >= seq, false) AS too_late FROM l),
    p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS previous FROM k WHERE NOT too_late),
    n AS (SELECT job_id, count(*) AS late FROM k WHERE too_late GROUP BY 1)
  SELECT job_id, max(seq) AS seq, max_by(state, seq) AS state, count(*) FILTER (previous IS NOT NULL AND NOT {_PAIRS_OK}) AS illegal, coalesce(max(late), 0) AS late
  FROM p LEFT JOIN n USING (job_id) GROUP BY 1""")
def stream_job_states(spark, sf):
    # A seventh of the first third of all events comes with the last third, out of order.
    log = view(spark, sf, SPARK.job_log()).select("job_id", "seq", "state")
    last = log.agg(F.max("seq")).scalar()
    held = (F.col("seq") % 7 == 3) & (3 * F.col("seq") <= last)
    batch = F.when(held, 2).when(3 * F.col("seq") <= last, 0).when(3 * F.col("seq") <= 2 * last, 1).otherwise(2)
    path, progress = scratch_path(spark, "job-states"), scratch_path(spark, "job-progress")
    _in_batches(spark, log.withColumn("_batch", batch), "job-events", lambda stream: job_state.track_jobs(stream, path, progress))
    return job_state.current_state(spark, path)
