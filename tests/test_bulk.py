"""Bulk searches, manifest-driven files, tiled grids, cut chunks, scattered cells, growing lineage, state that leaves."""

from __future__ import annotations

import math
import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graticule.operators import bulk_search as bulk
from graticule.operators import axes as ax
from graticule.operators import area, catalog, coverage, lineage, manifest, routing, sample, tiles
from graticule.operators import grid as gr
from graticule.session import cut_lineage, scratch_path
from graticule.sources import chunks, files
from graticule.streaming import job_state, means
from tests.compare import difference


def plan_of(df):
    return df._jdf.queryExecution().toString()


# -- searches ------------------------------------------------------------------------------------

COLLECTION = ("concept_id string, short_name string, provider_id string, entry_title string, abstract string, processing_level string, "
              "time_start timestamp_ntz, time_end timestamp_ntz, w double, s double, e double, n double, has_granules boolean")


@pytest.fixture(scope="module")
def collections(spark):
    rng = random.Random(3)
    words = ["sea", "surface", "temperature", "MODIS", "daily", "x-band", "Land-Cover", "l2", "30%_off", "süd"]
    rows = []
    for i in range(120):
        start = f"20{rng.randint(10, 20)}-01-01"
        w, s = rng.uniform(-180, 170), rng.uniform(-90, 60)
        rows.append((f"C{i:03}", f"SN{i % 9}", f"P{i % 4}", " ".join(rng.sample(words, 3)), None if i % 11 == 0 else " ".join(rng.sample(words, 4)),
                     rng.choice(["2", "3", "4", None]), start, f"20{rng.randint(21, 24)}-01-01", w, s, rng.choice([w + 8, w - 100]), s + 20, i % 3 > 0))
    return spark.createDataFrame(rows, COLLECTION.replace("timestamp_ntz", "string")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")}).cache()


def test_catalog_searches_equal_single_ones(spark, collections):
    rng = random.Random(4)
    searches = []
    for i in range(60):
        ask = {"keyword": rng.choice([None, "SEA  daily", "temp", "a", "cover x-b", "%_o", "nothing", "süd", " ", "daily DAILY"]), "concept_id": rng.choice([None] * 6 + ["C007", "none"]),
               "short_name": rng.choice([None] * 4 + ["SN3"]), "provider": rng.choice([None, None, "P1", "P9"]), "levels": rng.choice([None, None, ["2", "3"], ["4", "4"], []]),
               "has_granules": rng.choice([None, None, True, False]), "box": rng.choice([None, None, (170.0, -40.0, -150.0, 50.0), (0.0, 0.0, 40.0, 30.0)]),
               "times": rng.choice([None, None, ("2012-06-01", "2013-01-01")]), "limit": rng.choice([None, 3, 80])}
        searches.append((i, ask))
    rows = [(i, a["keyword"], a["concept_id"], a["short_name"], a["provider"], a["levels"], a["has_granules"], *(a["times"] or (None, None)), *(a["box"] or (None,) * 4), a["limit"], "red")
            for i, a in searches]
    table = spark.createDataFrame(rows, "search_id long, keyword string, concept_id string, short_name string, provider string, levels array<string>, has_granules boolean, "
                                  "t0 string, t1 string, w double, s double, e double, n double, limit long, colour string")
    got = defaultdict(list)
    for r in bulk.search_catalog(collections, table).orderBy("search_id", "rank").collect():
        got[r.search_id].append(r.concept_id)
    hits = 0
    for i, a in searches:
        filters = {"concept_id": a["concept_id"], "short_name": a["short_name"], "provider": a["provider"], "processing_level_id": a["levels"], "has_granules": a["has_granules"],
                   "bounding_box": a["box"], "temporal": a["times"], "limit": min(a["limit"] or 10, 50)}
        want = [r.concept_id for r in catalog.search_collections(collections, a["keyword"], filters if a["levels"] != [] else filters | {"processing_level_id": ["-"]}).collect()]
        assert got[i] == want, a
        hits += len(want)
    assert hits > 50


def test_catalog_search_has_no_product_and_takes_empty_tables(spark, collections):
    asks = spark.createDataFrame([(1, "sea"), (2, None)], "search_id long, keyword string")
    plan = plan_of(bulk.search_catalog(collections, asks))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert bulk.search_catalog(collections, asks.limit(0)).count() == 0
    assert bulk.search_catalog(collections.limit(0), asks).count() == 0


def test_granule_searches_equal_single_ones(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = rng.uniform(-180, 180)
        rows.append((f"G{i:03}", f"C{i % 3}", w, -10.0 + i % 30, w + 5 if w < 175 else w - 355, 5.0 + i % 30, f"2020-{1 + i % 12:02}-01", f"2020-{1 + i % 12:02}-03",
                     None if i % 13 == 0 else float(i % 7), rng.choice(["DAY", "NIGHT", None]), float(i % 5)))
    granules = spark.createDataFrame(rows, "granule_ur string, collection_id string, w double, s double, e double, n double, time_start string, time_end string, cloud_cover double, day_night_flag string, size_mb double")
    granules = granules.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")}).cache()
    asks = []
    for i in range(30):
        asks.append((i, f"C{i % 4}", *rng.choice([(None, None), ("2020-03-01", "2020-08-02")]), *rng.choice([(None,) * 4, (170.0, -20.0, -120.0, 20.0)]),
                     rng.choice([None, 2.0]), rng.choice([None, 5.0]), rng.choice([None, "day"]), rng.choice([None, "cloud_cover", "-cloud_cover", "-time_start", "size_mb", "-granule_ur"]), rng.choice([None, 4])))
    table = spark.createDataFrame(asks, "request_id long, collection_id string, t0 string, t1 string, w double, s double, e double, n double, cloud_min double, cloud_max double, day_night_flag string, sort_key string, limit long")
    got = defaultdict(list)
    for r in bulk.search_granules_in_bulk(granules, table).orderBy("request_id", "rank").collect():
        got[r.request_id].append(r.granule_ur)
    for i, c, t0, t1, w, s, e, n, low, high, flag, key, limit in asks:
        order = key if key in (None, "-granule_ur") else key
        found = coverage.search_granules(granules, c, (t0, t1) if t0 else None, (w, s, e, n) if w is not None else None, (low, high), flag, None, None)
        column = (order or "").lstrip("-")
        by = [F.col(column).desc() if order.startswith("-") else F.col(column)] if order else []
        want = [r.granule_ur for r in found.orderBy(*by, "time_start", "granule_ur").limit(limit or 10).collect()]
        assert got[i] == want, (i, key)
    assert "WindowGroupLimit" in plan_of(bulk.search_granules_in_bulk(granules, table))


def test_boxes_are_copied_only_to_levels_that_the_other_side_has(spark):
    rng = random.Random(11)

    def boxes(n, size, days, prefix):
        rows = []
        for i in range(n):
            w, s, t = rng.uniform(-180, 120), rng.uniform(-90, 20), rng.randint(1, 200)
            rows.append((i, w, s, w + size, s + size, f"2020-01-{1 + t % 28:02}", days))
        frame = spark.createDataFrame(rows, f"{prefix}id long, {prefix}w double, {prefix}s double, {prefix}e double, {prefix}n double, d string, days int")
        start = F.col("d").cast("timestamp_ntz")
        frame = frame.withColumn(f"{prefix}t0", start).withColumn(f"{prefix}t1", start + F.make_dt_interval("days")).drop("d", "days")
        return coverage._leveled(frame, prefix)

    small, wide = boxes(80, 3.0, 2, "g_"), boxes(30, 50.0, 400, "r_")
    for frame, prefix, other, own in ((small, "g_", wide, "r_"), (wide, "r_", small, "g_")):
        copies = [r["count"] for r in coverage._spread(frame, prefix, other, own).groupBy(f"{prefix}id").count().collect()]
        assert len(copies) == frame.count() and max(copies) <= 4 * 14
    # Both sides small: one level of place and time, so four tiles and two buckets at most.
    copies = [r["count"] for r in coverage._spread(small, "g_", boxes(5, 2.0, 1, "r_"), "r_").groupBy("g_id").count().collect()]
    assert max(copies) <= 8


# -- files ---------------------------------------------------------------------------------------


def test_result_files_with_odd_contents(spark, tmp_path):
    texts = {
        (1, "a-results.csv"): "﻿ID, value,ID\r\n1,2.5,9\r\n\r\n2,,8\n", (2, "A-RESULTS.CSV"): "value,\"name, full\",day\n7,\"Doe, J\",2020-01-02\n8,x\n",
        (3, "results.csv"): "", (4, "list.csv"): "nothing\n1\n", (5, "results.csv"): "flag\ntrue\n", (5, "more-results.csv"): "other\n1\n", (6, "results.json"): "{}\n"}
    rows = []
    for pos, ((task, name), text) in enumerate(texts.items()):
        place = tmp_path / f"t{task}" / name
        place.parent.mkdir(exist_ok=True)
        place.write_bytes(text.encode())
        rows.append((task, pos, f"f{pos}", name, "json" if name.endswith("json") else "csv", f"file://{place}"))
    manifest = spark.createDataFrame(rows, "task_id long, pos long, file_id string, file_name string, file_type string, path string")
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("_metadata.file_path")
    manifest = manifest.withColumn("end", F.regexp_extract("path", "(t[0-9]/[^/]+)$", 1)).drop("path").join(
        named.select(F.col("file_path").alias("path"), F.regexp_extract("file_path", "(t[0-9]/[^/]+)$", 1).alias("end")), "end").drop("end")
    got = files.result_files_to_parquet(spark, manifest, str(tmp_path), scratch_path(spark, "odd"))
    assert dict(got.dtypes) == {"task_id": "bigint", "ID": "bigint", "day": "date", "flag": "boolean", "name, full": "string", "value": "double"}
    assert sorted((r.task_id, r.ID, r.value, r["name, full"], str(r.day), r.flag) for r in got.collect()) == [
        (1, 1, 2.5, None, "None", None), (1, 2, None, None, "None", None), (2, None, 7.0, "Doe, J", "2020-01-02", None), (2, None, 8.0, "x", "None", None), (5, None, None, None, "None", True)]
    assert files.result_files_to_parquet(spark, manifest.limit(0), str(tmp_path), scratch_path(spark, "none")).count() == 0


# -- tiles and chunks -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiled(spark):
    cells = spark.range(40_000).select(
        (F.col("id") % 360 - 179.5).cast("double").alias("lon"), (F.floor(F.col("id") / 360) % 180 - 89.5).cast("double").alias("lat"),
        F.expr("timestamp_ntz'2019-06-15' + make_interval(0, cast(id % 30 as int))").alias("time"), F.col("id").alias("v"))
    layout = tiles.TileLayout(30.0, 6)
    path = scratch_path(spark, "tiled")
    tiles.write_tiled(cells, path, layout)
    return cells.cache(), tiles.read_tiled(spark, path), layout


def values(df):
    return sorted(r.v for r in df.collect())


@pytest.mark.parametrize(("box", "span", "wrap"), [((-20.0, 10.0, 44.0, 31.0), "2020-01-01/2020-08-31", False), ((150.0, -90.0, -150.0, 90.0), None, True),
                                                    ((150.0, -90.0, -150.0, 90.0), None, False), (None, "2020-12-01/", False)])
def test_tiled_subset(tiled, box, span, wrap):
    cells, grid, layout = tiled
    want = gr.subset_bbox(cells, box, wrap) if box else cells
    want = gr.subset_time(want, span) if span else want
    got = tiles.subset_tiled(grid, box, span, layout, wrap)
    assert values(got) == values(want) and got.columns == cells.columns
    if box and box[0] < box[2]:
        held = grid.inputFiles()
        assert "PartitionFilters: [isnotnull" in plan_of(got)
        read = got.select(F.input_file_name()).distinct().count()
        assert 0 < read <= len(held) / 10


def test_tiled_requests(spark, tiled):
    cells, grid, layout = tiled
    asks = spark.createDataFrame([(1, -20.0, 10.0, 44.0, 31.0, "2020-01-01", "2020-09-01"), (2, 100.0, -80.0, 101.0, -79.0, None, None), (3, 10.0, 0.0, 5.0, 9.0, None, None), (4, -179.0, -89.0, 179.0, 89.0, "2021-05-01", None)],
                                 "request_id long, w double, s double, e double, n double, t_low string, t_high string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("t_low", "t_high")})
    got = tiles.subset_tiled_by_requests(grid, asks, layout)
    pairs = lambda df: sorted((r.request_id, r.v) for r in df.collect())
    assert pairs(got) == pairs(gr.subset_by_requests(cells, asks)) and {r.request_id for r in got.collect()} == {1, 2, 4}
    assert "dynamicpruning" in plan_of(got).lower()


def test_many_tiled_requests_are_not_broadcast(spark, tiled, monkeypatch):
    """Copies by tile grow with the requests: only the touched partitions are broadcast, and like requests are tested once."""
    cells, grid, layout = tiled
    asks = spark.range(300).selectExpr("id AS request_id", "CAST(-170 + id % 60 AS DOUBLE) AS w", "CAST(-80 + id % 30 AS DOUBLE) AS s", "CAST(-120 + id % 60 AS DOUBLE) AS e", "CAST(-40 + id % 30 AS DOUBLE) AS n",
                                       "IF(id % 4 = 1, NULL, TIMESTAMP_NTZ '2019-08-01') AS t_low", "IF(id % 4 = 2, NULL, TIMESTAMP_NTZ '2020-09-01') AS t_high")
    asks = asks.unionByName(spark.createDataFrame([(900, 10.0, 0.0, 5.0, 9.0)], "request_id long, w double, s double, e double, n double"), allowMissingColumns=True)
    pairs = lambda df: sorted((r.request_id, r.v) for r in df.collect())
    want = pairs(gr.subset_by_requests(cells, asks))
    monkeypatch.setattr(tiles, "_FEW_COPIES", 100)
    monkeypatch.setattr(tiles, "_IDS", 2)
    got = tiles.subset_tiled_by_requests(grid, asks, layout)
    assert pairs(got) == want and len(want) > 100_000
    assert "dynamicpruning" in plan_of(got).lower() and "BroadcastHashJoin" in plan_of(got)
    plan = plan_of(got)
    assert "SortMergeJoin" in plan and "LeftSemi, BuildRight" in plan and "Inner, Build" not in plan
    assert tiles._alike(asks).agg(F.max(F.size("_ids"))).first()[0] == 2 and tiles._alike(asks).count() == 60 * 3 + 1


def test_many_tiled_requests_keep_their_tasks(spark, tiled, monkeypatch):
    """The shuffles are small beside the result, so they are not merged to a few tasks."""
    _, grid, layout = tiled
    asks = spark.range(300).selectExpr("id AS request_id", "CAST(-170 + id % 60 AS DOUBLE) AS w", "CAST(-80 + id % 30 AS DOUBLE) AS s", "CAST(-120 + id % 60 AS DOUBLE) AS e", "CAST(-40 + id % 30 AS DOUBLE) AS n",
                                       "CAST(NULL AS TIMESTAMP_NTZ) AS t_low", "CAST(NULL AS TIMESTAMP_NTZ) AS t_high")
    monkeypatch.setattr(tiles, "_FEW_COPIES", 100)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert tiles.subset_tiled_by_requests(grid, asks, layout).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


@pytest.mark.parametrize("small", [True, False])
def test_requests_are_never_held_whole(spark, tiled, monkeypatch, small):
    """Their copies by tile grow with the requests: not broadcast, and dealt over tasks before they are made."""
    cells, _, _ = tiled
    asks = spark.range(400).selectExpr("id AS request_id", "CAST(-170 + id % 300 AS DOUBLE) AS w", "CAST(-80 + id % 90 AS DOUBLE) AS s", "CAST(-150 + id % 300 AS DOUBLE) AS e",
                                       "CAST(-60 + id % 90 AS DOUBLE) AS n", "CAST(NULL AS TIMESTAMP_NTZ) AS t_low", "TIMESTAMP_NTZ '2020-09-01' AS t_high")
    monkeypatch.setattr(gr, "is_small", lambda df: small)
    got = gr.subset_by_requests(cells, asks)
    want = cells.join(F.broadcast(asks), F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")) & (F.col("time") < F.col("t_high")))
    pairs = lambda df: sorted((r.request_id, r.v) for r in df.select("request_id", "v").collect())
    assert pairs(got) == pairs(want) != []
    plan = plan_of(got).split("== Physical Plan ==")[1]
    assert ("BroadcastHashJoin" in plan) == small and "REPARTITION_BY_NUM" in plan


def test_chunks_are_cut_before_cells_are_made(spark):
    shape = (3, 4, 5)
    rows, axes = [], []
    for z in range(0, 6, 3):
        for y in range(0, 8, 4):
            for x in range(0, 10, 5):
                rows.append((1, "v", [z, y, x], list(shape), [float((z + a) * 10_000 + (y + b) * 100 + x + c) for a in range(3) for b in range(4) for c in range(5)]))
    for name, n, step in (("z", 6, 1.0), ("y", 8, -2.0), ("x", 10, 0.5)):
        axes += [(1, name, i, i * step) for i in range(n)]
    held = spark.createDataFrame(rows, "source_id long, variable string, chunk_origin array<int>, shape array<int>, values array<double>")
    ax = spark.createDataFrame(axes, "source_id long, axis string, idx int, value double")
    limits = {"z": (2.0, 3.0), "y": (-9.0, -3.0), "x": (None, 1.0)}
    got = chunks.flatten_chunks_within(held, ax, ["z", "y", "x"], ["v"], limits).collect()
    whole = chunks.flatten_chunks(held, ax, ["z", "y", "x"], ["v"]).where("z between 2 and 3 and y between -9 and -3 and x <= 1").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 2 * 3 * 3
    cut = chunks.cut_chunks(held, ax, ["z", "y", "x"], limits)
    assert cut.agg(F.sum(F.size("values"))).head()[0] == len(got) and cut.count() == 4
    assert chunks.flatten_chunks_within(held, ax, ["z", "y", "x"], ["v"], {"x": (99.0, None)}).count() == 0


# -- scattered cells ------------------------------------------------------------------------------


def test_nearest_scattered_cell(spark):
    rng = random.Random(6)
    cells = [(i, rng.choice(["a", "b"]), max(-90.0, min(90.0, rng.gauss(60, 12))), rng.uniform(-180, 180)) for i in range(600)] + [(700, "b", -90.0, 0.0), (701, "a", 10.0, 180.0), (702, "a", 10.0, -180.0), (703, "a", None, 1.0)]
    points = [(i, rng.choice(["a", "b"]), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(900, "a", 90.0, 5.0), (901, "b", -90.0, 77.0), (902, "a", 10.0, 179.9), (903, "c", 0.0, 0.0), (904, "a", None, 0.0)]
    place = lambda lat, lon: (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    want = {}
    for p, g, lat, lon in points:
        near = [(math.dist(place(lat, lon), place(y, x)), c) for c, h, y, x in cells if h == g and y is not None] if lat is not None else []
        if near:
            want[p] = min(near, key=lambda t: (round(t[0], 12), t[1]))
    schema = "{} long, granule string, lat double, lon double"
    df = sample.nearest_scattered(spark.createDataFrame(points, schema.format("point_id")), spark.createDataFrame(cells, schema.format("cell_id")), ["granule"])
    got = {r.point_id: (r.distance_km, r.cell_id) for r in df.collect()}
    assert set(got) == set(want)
    for p, (apart, cell) in want.items():
        assert got[p][0] == pytest.approx(2 * sample.EARTH_KM * math.asin(min(1, apart / 2)), abs=1e-5)
        assert got[p][1] == cell or got[p][1] in (701, 702)
    assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df)


# -- lineage --------------------------------------------------------------------------------------


def plain_closure(edges):
    out = {}
    by = defaultdict(set)
    for ws, t, s in edges:
        by[ws, t].add(s)
    for ws, t in list(by):
        front, depth, seen = {t}, 0, {}
        while front:
            depth += 1
            front = {s for a in front for s in by.get((ws, a), ()) if s not in seen}
            seen |= dict.fromkeys(front, depth)
        out |= {(ws, t, a): d for a, d in seen.items()}
    return out


def test_growing_closure_and_long_chains(spark):
    rng = random.Random(7)
    edges = [("a", f"c{i}", f"c{i + 1}") for i in range(70)] + [("a", f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(25)] + [("b", "c1", "c2"), ("b", "c2", "c1"), ("a", "c70", "n1")]
    edges = sorted(set(edges))
    frame = lambda rows: spark.createDataFrame(rows, "ws string, target string, source string")
    tuples = lambda df: {(r.ws, r.handle, r.ancestor): r.depth for r in df.collect()}
    want = plain_closure(edges)
    handles = spark.createDataFrame([("a", "c0"), ("a", "n3"), ("b", "c1"), ("a", "none"), ("a", "c66")], "ws string, handle string")
    asked = {tuple(r) for r in handles.collect()}
    assert tuples(lineage.ancestry(frame(edges), handles)) == {k: d for k, d in want.items() if k[:2] in asked}
    for most in (1, 3, 4, 6, 21):
        assert tuples(lineage.ancestry(frame(edges), handles, most)) == {k: d for k, d in want.items() if k[:2] in asked and d <= most}
    late = [e for e in edges if rng.random() < 0.3]
    early = [e for e in edges if e not in late]
    stored = spark.createDataFrame([(*k, d) for k, d in plain_closure(early).items()], "ws string, handle string, ancestor string, depth int")
    changed = lineage.extend_closure(stored, frame(late + early[:2]))
    before = plain_closure(early)
    assert tuples(changed) == {k: d for k, d in want.items() if before.get(k) != d}
    assert tuples(lineage.merge_closure(stored, changed)) == want
    assert lineage.extend_closure(stored, frame(early)).count() == 0


# -- streams --------------------------------------------------------------------------------------


def test_finished_jobs_leave_the_state(spark):
    folder, path, progress = (scratch_path(spark, x) for x in ("jobs", "states", "progress"))
    over = next(s for s in ("materialized", "successful", "succeeded", "done", "failed", "expired", *job_state.LEGAL) if job_state.is_terminal(s))
    start = next(iter(job_state.LEGAL))

    def batch(rows):
        spark.createDataFrame(rows, "job_id long, seq long, state string").coalesce(1).write.mode("append").parquet(folder)
        query = job_state.track_jobs(spark.readStream.schema("job_id long, seq long, state string").parquet(folder), path, progress, keep="20 seconds")
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    held = batch([(j, 1, start) for j in range(40)] + [(j, 2, over) for j in range(30)])
    rows = {r.job_id: r for r in job_state.current_state(spark, path).collect()}
    assert (rows[3].state, rows[3].seq, rows[35].state) == (over, 2, start)
    batch([(3, 1, start), (3, None, start), (35, 2, over)])
    rows = {r.job_id: r for r in job_state.current_state(spark, path).collect()}
    assert (rows[3].state, rows[3].late, rows[35].state) == (over, 2, over)
    time.sleep(21)
    batch([(50, 1, start)])
    left = batch([(51, 1, start)])
    assert left < held, (left, held)
    batch([(4, 1, start)])  # long over and forgotten: it begins anew
    row = next(r for r in spark.read.parquet(path).where("job_id = 4 and events = 1").collect() if r.state == start)
    assert (row.seq, row.late) == (1, 0)


def test_sums_are_corrected_and_compacted(spark):
    folder, path, progress = (scratch_path(spark, x) for x in ("cells", "sums", "sums-progress"))
    schema = "time timestamp, cell long, v double"
    at = lambda h: f"2024-01-01 {h:02}:10:00"
    for rows in ([(at(1), 1, 2.0), (at(1), 1, None), (at(5), 2, 4.0)], [(at(1), 1, 6.0), (at(3), 2, None)]):
        spark.createDataFrame([(t, c, v) for t, c, v in rows], "time string, cell long, v double").withColumn("time", F.col("time").cast("timestamp")).write.mode("append").parquet(folder)
        means.append_sums(means.stream_sums(spark.readStream.schema(schema).parquet(folder), "h", ["v"], ["cell"]), ["v"], ["cell"], path, progress).awaitTermination()
    want = {(h, c): None for h in range(1, 6) for c in (1, 2)} | {(1, 1): 4.0, (5, 2): 4.0}
    seen = lambda p, **k: {(r.time.hour, r.cell): r.v for r in means.means_view(spark, p, "h", ["v"], ["cell"], **k).collect()}
    assert seen(path) == want
    assert seen(path, fill_gaps=False) == {(1, 1): 4.0, (5, 2): 4.0, (3, 2): None}
    compact = scratch_path(spark, "compact")
    means.compact_sums(spark, path, ["v"], ["cell"], compact)
    assert seen(compact) == want and spark.read.parquet(compact).count() == 3


# -- sides that grow ---------------------------------------------------------------------------


def test_axis_tables_are_not_collected_by_the_driver(spark):
    dims = "array<struct<name:string,size:bigint>>"
    v = spark.createDataFrame([
        ("C1", 0, "lat", None, [("lat", 4)]), ("C1", 1, "LON", None, [("x", 2), ("lon", 8)]), ("C1", 2, "/b/lat", None, [("lat", 9)]),
        ("C1", 3, "ndvi", None, [("time", 3), ("lat", 4), ("lon", 8)]), ("C2", 0, "lat", None, [("lat", 0)]), ("C3", 0, "ndvi", None, None),
    ], f"collection_id string, pos long, name string, standard_name string, dimensions {dims}")
    names = ax.discover_coordinates(v)
    lengths = ax.axis_lengths(v, names)
    found = {r.collection_id: (r.lat_length, r.lon_length) for r in lengths.collect()}
    assert found == {"C1": (4, 8), "C2": (None, None), "C3": (None, None)}
    asked = spark.createDataFrame([(1, 0, "C1", "ndvi"), (2, 0, "C2", "lat")], "request_id long, pos long, collection_id string, variable string")
    resolved = routing.resolve_paths(asked, v)
    planned = manifest.with_dimension_plans(resolved, v, names)
    for df in (lengths, planned, routing.ambiguous_paths(resolved, v)):
        df.collect()
        assert "Broadcast" not in plan_of(df)


def test_equal_distances_take_the_lower_cell(spark):
    # At a pole all cells of a latitude are equally far, but for rounding.
    cells = spark.createDataFrame([(i, 80.5, -180 + (i * 7919) % 36000 * 0.01) for i in range(200)], "cell_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 90.0, 0.0), (2, 90.0, 77.0), (3, 90.0, -180.0)], "point_id long, lat double, lon double")
    assert [r.cell_id for r in sample.nearest_scattered(points, cells).collect()] == [0, 0, 0]


def test_searches_with_their_rows_meet_no_further_records(spark, collections, monkeypatch):
    monkeypatch.setattr(bulk, "_ROUNDS", (4, 16, 64))
    met = []
    hits = bulk._hits
    monkeypatch.setattr(bulk, "_hits", lambda routes, index, *a: (met.append((routes.select("ask").distinct().count(), index.select("concept_id").distinct().count())), hits(routes, index, *a))[1])
    asks = [(1, "a", 2), (2, None, 5), (3, "daily", 50), (4, "nowhere", 5)]
    searches = spark.createDataFrame(asks, "search_id long, keyword string, limit long")
    got = defaultdict(list)
    for r in bulk.search_catalog(collections, searches).orderBy("search_id", "rank").collect():
        got[r.search_id].append(r.concept_id)
    text = {r.concept_id: " ".join(x for x in (r.short_name, r.entry_title, r.abstract) if x is not None).lower() for r in collections.collect()}
    assert got == {i: ids for i, word, n in asks if (ids := [k for k in sorted(text) if word is None or word in text[k]][:n])}
    assert [m[1] for m in met] == [4, 12, 48, 56] and met[-1][0] < met[0][0]


def test_rounds_go_on_beyond_the_first_ones(spark, collections, monkeypatch):
    """The records behind the first rounds are not met in one leap, and a record that stands twice is found twice."""
    monkeypatch.setattr(bulk, "_ROUNDS", (2, 4))
    met, hits = [], bulk._hits
    monkeypatch.setattr(bulk, "_hits", lambda routes, index, *a: (met.append(index.select("concept_id").distinct().count()), hits(routes, index, *a))[1])
    asks = [(1, "sea daily", None, 9), (2, None, "P1", 20), (3, "no such", None, 5), (4, None, None, 50)]
    searches = spark.createDataFrame(asks, "search_id long, keyword string, provider string, limit long")
    twice = collections.unionByName(collections.where("concept_id IN ('C001', 'C119')"))
    got = defaultdict(list)
    for r in bulk.search_catalog(twice, searches).orderBy("search_id", "rank").collect():
        got[r.search_id].append(r.concept_id)
    rows = sorted((r.concept_id, " ".join(x for x in (r.short_name, r.entry_title, r.abstract) if x is not None).lower(), r.provider_id) for r in twice.collect())
    assert got == {i: ids for i, words, provider, n in asks
                   if (ids := [k for k, text, by in rows if all(w in text for w in (words or "").split()) and provider in (None, by)][:n])}
    assert met[:2] == [2, 1] and sum(met) == 120 and len(met) > 3


def test_names_are_routed_by_long_pieces(spark, monkeypatch):
    """3,000 names share all three-letter pieces of a query; it meets only those with its longer one."""
    written = {}

    def keep(df, label="stage"):
        written[label] = cut_lineage(df, label)
        return written[label]

    monkeypatch.setattr(area, "cut_lineage", keep)
    names = spark.createDataFrame([(i, f"Aa Creek 1232341{i:04d}") for i in range(3000)] + [(5000, "Bb Creek 12341 12341"), (5001, "x")], "code long, name string")
    asked = [("12341",), ("creek",), ("9",), ("k 12",), ("341 1",), ("nowhere",), ("bb creek 12341 12",), ("",)]
    queries = spark.createDataFrame(asked, "text string").withColumn("parts", F.array("text"))
    found = area.contains_join(queries, names, "parts", "name").select("text", "match_code")
    rows = [(r["code"], r["name"].lower()) for r in names.collect()]
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted((q, code) for (q,) in asked for code, name in rows if q and q in name)
    routed = {r["_parts"][0]: r["_gram"] for r in written["rarest"].collect()}
    assert routed["12341"] == "12341" and len(routed["bb creek 12341 12"]) == 8 and "nowhere" not in routed


def test_result_files_come_from_an_archive(spark):
    """2,000 tasks of one small file each, in one table; before, every file was one on disk."""
    lines = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("path"), F.expr(
        "explode(array(struct(-1L as at, if(id % 2 = 0, '﻿ID,v', 'v,\"a, b\",ID') as value), struct(7L as at, '' as value), "
        "struct(3L as at, if(id % 2 = 0, id || ',1.5', ',\"x, y\",' || id) as value)))").alias("x")).select("path", "x.*")
    manifest = spark.range(2000).select(F.col("id").alias("task_id"), F.lit(0).alias("pos"), F.lit("f").alias("file_id"), F.lit("Results.csv").alias("file_name"), F.lit("csv").alias("file_type"), F.concat(F.lit("t"), "id").alias("path"))
    got = files.result_files_to_parquet(spark, manifest, lines, scratch_path(spark, "archived"))
    assert dict(got.dtypes) == {"task_id": "bigint", "ID": "bigint", "a, b": "string", "v": "double"}
    even = {(r.task_id, r.ID, r.v, r["a, b"]) for r in got.collect()}
    assert even == {(i, i, 1.5, None) if i % 2 == 0 else (i, i, None, "x, y") for i in range(2000)}


def test_equal_requests_are_answered_once(spark):
    """1,000 requests of four kinds meet the granules as four; open ones meet them as boxes and times."""
    asked = spark.range(1000).selectExpr(
        "id AS request_id", "'C1' AS collection_id", "if(id % 4 < 2, -10D, null) AS w", "if(id % 4 < 2, -10D, null) AS s", "if(id % 4 < 2, 10D, null) AS e", "if(id % 4 < 2, 10D, null) AS n",
        "if(id % 2 = 0, timestamp_ntz'2020-01-02', null) AS t0", "if(id % 2 = 0, timestamp_ntz'2020-01-05', null) AS t1")
    granules = spark.range(300).selectExpr(
        "concat('G', id) AS granule_ur", "'C1' AS collection_id", "id % 40D - 20 AS w", "-5D AS s", "id % 40D - 19 AS e", "5D AS n",
        "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 10 as int)) AS time_start", "if(id % 7 = 0, null, timestamp_ntz'2020-01-02' + make_dt_interval(cast(id % 10 as int))) AS time_end")
    seen = []

    def pairs(requests):
        seen.append(requests.count())
        return coverage.availability(requests, coverage.overlap_join(requests, granules))

    counts = {r.request_id: r.granule_count for r in coverage.once_each(asked, pairs).collect()}
    assert seen == [4] and len(counts) == 1000
    assert counts == {r.request_id: r.granule_count for r in coverage.availability(asked, coverage.overlap_join(asked, granules)).collect()}
    plain = coverage.overlap_join(asked, granules).groupBy("request_id").agg(F.count("*"), F.min("granule_ur"), F.max("granule_ur"))
    assert sorted(map(tuple, coverage.name_ranges(asked, granules).collect())) == sorted(map(tuple, plain.collect()))


def test_chunks_are_filled_in_order_of_place(spark):
    """Every chunk has all its places, filled without a search of a map for each of them."""
    from graticule.plans import grid_queries as gq
    from graticule.plans.fixtures import SPARK, view

    sf = "/root/testdata/sf0.001"
    made, _ = gq._wide_chunks(spark, sf)
    assert "map_from_entries" not in plan_of(made)
    total = view(spark, sf, SPARK.wide_grid()).agg(F.sum("amount")).first()[0]
    assert made.agg(F.min(F.size("values")), F.max(F.size("values")), F.sum(F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))))).first() == (800, 800, total)


def test_equal_requests_share_the_granules_of_a_manifest(spark, tmp_path, monkeypatch):
    """The pairs that are ranked are those of distinct requests, and are not shuffled again for the requests that share them."""
    sf = "/root/testdata/sf0.001"
    for name in ("customer", "orders", "part", "nation", "region", "lineitem", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    n = suppliers.count()  # areas come again after 19,800 keys
    repeated = suppliers.join(spark.range(3)).withColumn("s_suppkey", F.expr("s_suppkey + id * 19800")).drop("id")
    repeated.write.parquet(str(tmp_path / "supplier.parquet"))
    met, join = [], coverage.overlap_join
    monkeypatch.setattr(coverage, "overlap_join", lambda requests, *more: met.append(requests.count()) or join(requests, *more))
    found = entry.queries()["subset_manifest"](spark, str(tmp_path))
    assert met == [n]
    con = duckdb.connect()
    for name, at in (("customer", ""), ("orders", ""), ("part", ""), ("supplier", "/*.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet{at}')")
    assert difference(found, con, entry.oracle_sql()["subset_manifest"]) is None
    plan = plan_of(found).split("== Physical Plan ==")[1]
    assert found.count() > 0 and "Exchange" not in plan.split("SortMergeJoin [_asked", 1)[1].split("Window", 1)[0]
    # URLs are made before the requests that share them are told apart.
    assert "concat(access_url" in plan.split("Generate explode(_ids", 1)[1].split("SortMergeJoin [_asked", 1)[0]
