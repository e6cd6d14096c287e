from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import align as al
from graticule.operators import axes as ax
from graticule.operators import grid as gr
from graticule.operators import resample as rs
from graticule.operators import stats as st
from graticule.sources import files as fl

LAT, LON = [37.0, 38.0, 39.0], [-105.0, -104.5, -104.0]


def small_grid(spark, name="ndvi", lons=LON):
    rows = [(i, j, lat, lon, float(3 * i + j)) for i, lat in enumerate(LAT) for j, lon in enumerate(lons)]
    return spark.createDataFrame(rows, f"lat_idx BIGINT, lon_idx BIGINT, lat DOUBLE, lon DOUBLE, {name} DOUBLE")


def series(spark, stamps, name="v", values=None):
    rows = [(t, 0.0, float(i) if values is None else values[i]) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, f"time TIMESTAMP_NTZ, lat DOUBLE, {name} DOUBLE")


def test_bbox_keeps_one_latitude(spark):
    out = gr.subset_bbox(small_grid(spark), (-105, 37.5, -104, 38.5))
    assert {r["lat"] for r in out.collect()} == {38.0} and out.count() == 3


def test_bbox_needs_an_axis_and_finds_capitals(spark):
    with pytest.raises(ValueError, match="no lon/lat"):
        gr.subset_bbox(spark.range(1), (0, 0, 1, 1))
    caps = small_grid(spark).withColumnsRenamed({"lat": "Latitude", "lon": "Longitude"})
    assert gr.subset_bbox(caps, (-105, 37, -104.5, 37)).count() == 2


def test_time_range_covers_the_end_day(spark):
    g = series(spark, [datetime(2020, 1, 1), datetime(2020, 1, 2), datetime(2020, 1, 3)])
    assert [r["v"] for r in gr.subset_time(g, "2020-01-01/2020-01-02").collect()] == [0.0, 1.0]
    with pytest.raises(ValueError, match="no values"):
        gr.subset_time(g.drop("time"), "2020-01-01/", has_time_dim=True)
    assert gr.subset_time(small_grid(spark), "2020-01-01/").count() == 9


def test_unknown_variables_are_listed_together():
    assert gr.resolve_variables(["a", "g__b"], ["/g/b", "a"]) == ["g__b", "a"]
    with pytest.raises(ValueError, match=r"\['x', 'y'\].*\['a'\]"):
        gr.resolve_variables(["a"], ["x", "a", "y"])


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "g")
    small_grid(spark).withColumn("extra", F.lit(1)).write.parquet(path)
    out = gr.subset(spark.read.parquet(path), ["lat", "lon"], bbox=(-105, 37.5, -104, 38.5), variables=["ndvi"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon" in plan and "extra" not in plan


def test_coarsen_trims_in_stored_order(spark):
    out = rs.coarsen(small_grid(spark), 2, ["ndvi"]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["lat"], r["lon"], r["ndvi"]) == (37.5, -104.75, 2.0)
    flipped = small_grid(spark).withColumn("lat_idx", 2 - F.col("lat_idx"))
    assert rs.coarsen(flipped, 2, ["ndvi"]).first()["lat"] == 38.5
    with pytest.raises(ValueError):
        rs.resample(small_grid(spark), ["ndvi"])


def test_hourly_values_make_one_day(spark):
    g = series(spark, [datetime(2020, 1, 1) + timedelta(seconds=s) for s in (0, 3600, 7200)])
    assert [(str(r["time"]), r["v"]) for r in rs.resample_time(g, "1D", ["v"], ["lat"]).collect()] == [("2020-01-01 00:00:00", 1.0)]


@pytest.mark.parametrize("alias", ["D", "5h", "2D", "90min", "W", "W-WED", "ME", "MS", "QE", "QS", "YE", "YS", "2ME", "2MS", "2QE"])
def test_bins_match_pandas(spark, alias):
    rng = np.random.default_rng(7)
    stamps = pd.Timestamp("2021-01-30 23:30") + pd.to_timedelta(np.sort(rng.integers(0, 500 * 86400, 40)), unit="s")
    if alias in ("5h", "90min"):
        stamps = pd.Timestamp("2021-01-30 23:30") + pd.to_timedelta(np.sort(rng.integers(0, 4 * 86400, 40)), unit="s")
    values = rng.integers(0, 100, 40).astype(float)
    values[3] = np.nan
    want = pd.Series(values, index=stamps).resample(alias).mean()
    g = series(spark, [t.to_pydatetime() for t in stamps], values=[float(v) for v in values])
    got = sorted((r["time"], r["v"]) for r in rs.resample_time(g, alias, ["v"], ["lat"]).collect())
    assert [t for t, _ in got] == [t.to_pydatetime() for t in want.index]
    assert [v for _, v in got] == [None if np.isnan(v) else pytest.approx(v) for v in want]


@pytest.mark.parametrize("alias", ["M", "H", "bogus", "0D", "T", "D-MON"])
def test_bad_alias_is_named(alias):
    with pytest.raises(ValueError, match=alias):
        rs.parse_frequency(alias)


# -- statistics -----------------------------------------------------------------------------


def test_masked_statistics(spark):
    v = spark.createDataFrame([(x, "s") for x in (-1e30, 1.0, 2.0, 3.0, 4.0, 999.0)], "v DOUBLE, s STRING")
    rows = {r["variable"]: r for r in st.grid_statistics(v, ["v", "s"], {"v": {"fill": -1e30, "valid_range": [0, 10]}}).collect()}
    assert (rows["v"]["min"], rows["v"]["max"], rows["v"]["mean"], rows["v"]["count"]) == (1, 4, 2.5, 4)
    assert rows["v"]["std"] == pytest.approx(np.std([1, 2, 3, 4])) and rows["s"]["count"] == 6 and rows["s"]["min"] is None


def test_table_statistics_keep_nan_as_a_value(spark):
    t = spark.createDataFrame([(1.0, 1, None), (float("nan"), 2, None), (None, 3, None)], "a DOUBLE, b INT, c DOUBLE")
    rows = {r["variable"]: r for r in st.table_statistics(t).collect()}
    a = rows["a"]
    assert (a["min"], a["max"], a["count"]) == (1, 1, 2) and np.isnan(a["mean"]) and np.isnan(a["std"])
    assert (rows["b"]["mean"], rows["c"]["count"], rows["c"]["mean"]) == (2, 0, None)


# -- alignment ---------------------------------------------------------------------------------


def test_snap_collapses_half_second_offsets(spark):
    base = [datetime(2020, 1, 1, h) for h in range(3)]
    a, b = series(spark, base, "a"), series(spark, [t + timedelta(milliseconds=500) for t in base], "b")
    out, report = al.align([a, b], ["time", "lat"], snap_ns=60 * 10**9)
    rows = out.collect()
    assert len(rows) == 3 and all(r["a"] is not None and r["b"] is not None for r in rows)
    assert report["shape_after"] == {"time": 3, "lat": 1}
    assert al.align([a, b], ["time", "lat"])[0].count() == 6


def test_outer_union_of_days(spark):
    days = [datetime(2020, 9, d) for d in (15, 16, 17)]
    out, _ = al.align([series(spark, days[:2], "a"), series(spark, days, "u")], ["time", "lat"])
    rows = out.collect()
    assert len(rows) == 3 and all(r["u"] is not None for r in rows)


def test_outer_is_per_axis_and_first_wins_with_nulls(spark):
    a = small_grid(spark, "x").drop("lat_idx", "lon_idx")
    b = small_grid(spark, "x", [-104.5, -104.0, -103.5]).drop("lat_idx", "lon_idx").where("lat > 37").withColumn("y", F.lit(1).cast("short"))
    out, _ = al.align([a.where("NOT (lat = 37 AND lon = -105)"), b], ["lat", "lon"])
    rows = {(r["lat"], r["lon"]): r for r in out.collect()}
    assert len(rows) == 12
    assert rows[(37.0, -105.0)]["x"] is None and rows[(39.0, -103.5)]["x"] is None and rows[(39.0, -103.5)]["y"] == 1.0
    assert dict(out.dtypes)["y"] == "float"


def test_align_errors(spark):
    a, b = small_grid(spark).drop("lat_idx", "lon_idx"), small_grid(spark, "z", LON[:2]).drop("lat_idx", "lon_idx")
    for method in ("exact", "override"):
        with pytest.raises(ValueError, match=method):
            al.align([a, b], ["lat", "lon"], method)
    with pytest.raises(ValueError, match="two"):
        al.align([a], ["lat", "lon"])
    with pytest.raises(ValueError, match="axis"):
        al.align([a, b.drop("lat")], ["lat", "lon"])
    same, _ = al.align([a, a.withColumnRenamed("ndvi", "w")], ["lat", "lon"], "exact")
    assert same.where("ndvi = w").count() == 9


# -- axes and ranges ------------------------------------------------------------------------------


@pytest.mark.parametrize(("origin", "step", "length", "low", "high", "want"), [
    (-59.875, 0.25, 600, 38.0, 43.0, (391, 412)), (89.875, -0.25, 600, 38.0, 43.0, (187, 208)),
    (-179.875, 0.25, 1440, -95.0, -90.0, (339, 360)), (-59.875, 0.25, 600, -90.0, 100.0, (0, 599)),
    (-59.875, 0.25, 600, 40.125, 40.125, (400, 400)), (0.0, 0.0, 5, 1.0, 2.0, None), (0.0, 1.0, 0, 1.0, 2.0, None),
])
def test_index_ranges(spark, origin, step, length, low, high, want):
    lits = [F.lit(x) for x in (origin, step, length, low, high)]
    got = spark.range(1).select(ax.index_range(*lits).alias("r")).first()["r"]
    assert (got and tuple(got)) == want


def test_geometry_from_extent(spark):
    g = spark.range(1).select(ax.axis_geometry(F.lit(-60.0), F.lit(90.0), F.lit(600)).alias("a"),
                              ax.axis_geometry(F.lit(-180.0), F.lit(180.0), F.lit(1440)).alias("o")).first()
    assert tuple(g["a"]) == (-59.875, 0.25, 600) and tuple(g["o"]) == (-179.875, 0.25, 1440)


def test_axis_index_is_a_global_rank(spark):
    rng = np.random.default_rng(3)
    values = sorted({float(v) for v in rng.uniform(-90, 90, 2000)})
    got = {r["lat"]: r["idx"] for r in ax.index_axis(spark.createDataFrame([(v,) for v in values], "lat DOUBLE").repartition(7), "lat").collect()}
    assert [got[v] for v in values] == list(range(len(values)))
    down = {r["lat"]: r["idx"] for r in ax.index_axis(spark.createDataFrame([(v,) for v in values], "lat DOUBLE"), "lat", True).collect()}
    assert [down[v] for v in reversed(values)] == list(range(len(values)))


# -- files -----------------------------------------------------------------------------------------


def test_stacked_granules_use_their_own_epochs(spark):
    cells = spark.createDataFrame([("g1", 180.0, 1.0), ("g2", 180.0, 2.0), ("g3", None, 3.0)], "granule STRING, time_raw DOUBLE, v DOUBLE")
    attrs = spark.createDataFrame(
        [("g1", "minutes since 2020-09-15", None, None, None), ("g2", "minutes since 2020-09-16", None, None, None), ("g3", None, None, "2020-09-17", "05:00:00Z")],
        "granule STRING, units STRING, calendar STRING, begin_date STRING, begin_clock STRING")
    got = [str(r["time"]) for r in fl.stack_granules([cells], attrs).orderBy("granule").collect()]
    assert got == ["2020-09-15 03:00:00", "2020-09-16 03:00:00", "2020-09-17 05:00:00"]
    with pytest.raises(ValueError):
        fl.stack_granules([], attrs)


def test_convert_format_checks_the_shape(spark, tmp_path):
    for name, shape in (("csv", "grid"), ("zarr", "table"), ("tiff", "grid")):
        with pytest.raises(ValueError):
            fl.output_media_type(name, shape)
    path = str(tmp_path / "out")
    assert fl.convert_format(spark.range(3), path, " Parquet", "table") == "application/x-parquet"
    assert fl.read_table(spark, path, columns=["id"]).count() == 3


def test_crs_tag_is_metadata(spark):
    out = gr.tag_crs(small_grid(spark), "EPSG:3857", ["lat", "lon"])
    assert out.schema["ndvi"].metadata["crs"] == "EPSG:3857" and out.schema["lat"].metadata == {}
    with pytest.raises(ValueError):
        gr.tag_crs(spark.range(1), "EPSG:3857", [])


def test_coarsen_begins_where_the_grid_begins(spark):
    """Blocks by position, against a walk over the same rows."""
    rows = [(i, float(10 * i), 0, 0.0, float(i * i)) for i in range(12)]
    schema = "lat_idx INT, lat DOUBLE, lon_idx INT, lon DOUBLE, v DOUBLE"
    for first, last in ((0, 11), (1, 5), (4, 11), (7, 7)):
        kept = [r for r in rows if first <= r[0] <= last]
        got = rs.coarsen(spark.createDataFrame(kept, schema).drop("lon", "lon_idx"), 2, ["v"]).collect()
        blocks = [kept[i : i + 2] for i in range(0, len(kept) - len(kept) % 2, 2)]
        assert sorted((r["lat_idx"], r["lat"], r["v"]) for r in got) == [
            (k, sum(b[1] for b in block) / 2, sum(b[4] for b in block) / 2) for k, block in enumerate(blocks)]


def test_raw_times_need_units(spark):
    grid = spark.createDataFrame([(0.0, 1.0), (86_400.0, 2.0), (172_800.0, 3.0)], "time DOUBLE, v DOUBLE")
    got = gr.subset_time(grid, "2021-06-02/2021-06-03", units="seconds since 2021-06-01 00:00:00")
    assert sorted(r["v"] for r in got.collect()) == [2.0, 3.0]
    with pytest.raises(ValueError, match="units"):
        gr.subset_time(grid, "2021-06-02/2021-06-03")


def test_hyperslab_knows_longitudes_by_any_case(spark):
    cells = spark.range(8).select(F.col("id").alias("Longitude_idx"))
    assert ax.hyperslab(cells, {"Longitude": (-157.5, 45.0, 8)}, {"Longitude": (170.0, -170.0)}).count() == 8


def test_align_takes_whole_rows_or_refuses(spark):
    t = datetime(2022, 3, 1, 12)
    scans = [(t + timedelta(seconds=9), 0.0, 3, 9), (t + timedelta(seconds=2), 0.0, 5, 1)]
    a = spark.createDataFrame(scans, "time TIMESTAMP_NTZ, lat DOUBLE, x INT, q INT")
    b = spark.createDataFrame([(t, 0.0, 7)], "time TIMESTAMP_NTZ, lat DOUBLE, z INT")
    row = al.align([a, b], ["time", "lat"], snap_ns=60 * 10**9)[0].head()
    assert (row["x"], row["q"], row["z"]) == (5.0, 1.0, 7.0)
    twice = a.withColumn("time", F.lit(t).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="more than once"):
        al.align([twice, b], ["time", "lat"])[0].collect()


@pytest.mark.parametrize("alias", ["QS-DEC", "QE-DEC", "QE-JAN", "QS-FEB", "YE-JUN", "YS-OCT", "2QS-FEB", "3ME", "2W", "3W-WED", "2YS", "W-FRI"])
def test_calendar_aliases_equal_pandas(spark, alias):
    rng = np.random.default_rng(17)
    start = pd.Timestamp("2018-02-11 05:00")
    times = [start + pd.Timedelta(hours=int(h)) for h in np.unique(rng.integers(0, 24 * 365 * 4, 300))]
    values = rng.integers(0, 99, len(times)).astype(float)
    want = pd.Series(values, index=pd.DatetimeIndex(times)).resample(alias).mean()
    grid = spark.createDataFrame([(t.to_pydatetime(), 1, float(v)) for t, v in zip(times, values, strict=True)], "time TIMESTAMP_NTZ, cell INT, v DOUBLE")
    got = {r["time"]: r["v"] for r in rs.resample_time(grid, alias, ["v"], ["cell"]).collect()}
    assert sorted(got) == [t.to_pydatetime() for t in want.index]
    for t, v in want.items():
        assert (got[t.to_pydatetime()] is None) == bool(np.isnan(v)) and (np.isnan(v) or got[t.to_pydatetime()] == pytest.approx(v))


def test_chunks_of_several_layouts(spark):
    """Two variables share chunks, one is cut another way, one source lacks a variable."""
    from graticule.sources.chunks import flatten_chunks

    rng = np.random.default_rng(3)
    chunks, want = [], {}
    for source, layouts in ((1, {"a": (2, 3), "b": (2, 3), "c": (4, 2)}), (2, {"a": (4, 6), "b": (3, 5)})):
        for name, (h, w) in layouts.items():
            grid = rng.integers(0, 99, (4, 6)).astype(float)
            for i in range(4):
                for j in range(6):
                    want.setdefault((source, i, j), {})[name] = grid[i, j]
            for i in range(0, 4, h):
                for j in range(0, 6, w):
                    block = grid[i : i + h, j : j + w]
                    chunks.append((source, name, [i, j], list(block.shape), block.ravel().tolist()))
    axes = [(s, d, i, 10.0 * i + s) for s in (1, 2) for d, n in (("y", 4), ("x", 6)) for i in range(n)]
    got = flatten_chunks(
        spark.createDataFrame(chunks, "source_id BIGINT, variable STRING, chunk_origin ARRAY<INT>, shape ARRAY<INT>, values ARRAY<DOUBLE>"),
        spark.createDataFrame(axes, "source_id BIGINT, axis STRING, idx INT, value DOUBLE"), ["y", "x"], ["a", "b", "c"]).collect()
    assert len(got) == len(want)
    for r in got:
        cell = want[r["source_id"], r["y_idx"], r["x_idx"]]
        assert [r[v] for v in "abc"] == [cell.get(v) for v in "abc"]
        assert (r["y"], r["x"]) == (10.0 * r["y_idx"] + r["source_id"], 10.0 * r["x_idx"] + r["source_id"])
