from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graticule.functions import location as loc
from graticule.functions import quality, temporal
from graticule.functions import text as tx
from graticule.operators.lineage import retrieval_key


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values).items()))
    return row.select(column.alias("x")).first()["x"]


def _types(values):
    kind = {str: "STRING", float: "DOUBLE", int: "BIGINT", type(None): "STRING"}
    return {k: kind[type(v)] for k, v in values.items()}


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")


def mapped(spark, values, column):
    rows = texts(spark, values).select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


# -- places ------------------------------------------------------------------------------


def test_watershed_prefixes(spark):
    """Each level's code after each way to write the prefix, and the same texts spoilt."""
    codes = ["".join(str((7 * i + n) % 10) for i in range(n)) for n in loc.WATERSHED_CODE_LENGTHS]
    forms = ["{mark} {code}", "{mark}{n} {code}", "{mark}-{n}   {code}"]
    texts = {form.format(mark=mark, n=len(code), code=code): code
             for code in codes for form in forms for mark in ("HUC", "huc", "hUc")}
    assert mapped(spark, list(texts), loc.strip_watershed_prefix(F.col("t"))) == list(texts.values())
    spoilt = [spoil for t in texts for spoil in (t.replace(" ", ""), t + "z", "q" + t, t.split(" ")[0])]
    assert mapped(spark, spoilt, loc.strip_watershed_prefix(F.col("t"))) == [None] * len(spoilt)


def test_watershed_code_needs_a_level_length(spark):
    assert mapped(spark, ["101", "0101", "HUC 010", "1" * 14, " 10"], loc.watershed_code(F.col("t"))) == [
        None, "0101", None, None, None]


def test_bbox_text(spark):
    status = mapped(spark, ["-105, 37,-104,38", "170,0,-170,10", "1,2,3", "a,1,2,3", "1d,1,2,3", "181,0,1,1", "0,-91,1,1",
                            "0,5,1,4", "nan,0,1,1", "1e1,0,2_0,5"], loc.parse_bbox(F.col("t"))["status"])
    assert status == ["ok", "ok", "bad_count", "non_numeric", "non_numeric", "longitude_range", "latitude_range",
                      "south_above_north", "longitude_range", "ok"]


def test_point_text(spark):
    got = mapped(spark, ["-93.6,41.6", "Denver, CO", "200,10", "1,2,3"], loc.parse_point(F.col("t")))
    assert got[0].asDict() == {"w": -93.6, "s": 41.6, "e": -93.6, "n": 41.6} and got[1:] == [None] * 3


def test_geojson_boxes(spark):
    docs = [
        '{"type":"Point","coordinates":[5,6,700]}',
        '{"type":"Feature","properties":{"p":[[9,9]]},"bbox":[0,0,99,99],"geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4]]],[[[-5,6.5],[0,1e1]]]]}}',
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,1]},{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[2,2],[7,-3]]}]}]}',
        '{"type":"FeatureCollection","features":[]}',
        '{"type":"Polygon","coordinates":[]}',
    ]
    got = [r and tuple(r) for r in mapped(spark, docs, loc.bbox_from_geojson(F.col("t")))]
    assert got == [(5, 6, 5, 6), (-5, 2, 3, 10), (1, -3, 7, 2), None, None]


# -- time ------------------------------------------------------------------------------------


def test_each_epoch_decodes_by_itself(spark):
    units = ["minutes since 2020-09-15 00:00:00", "minutes since 2020-09-16", "hours since 2020-01-01T00:00:00Z",
             "days since 2020-01-01 00:00:00 UTC", "seconds since 2020-01-01 02:00:00+02:00", "fortnights since 2020-01-01", None]
    got = mapped(spark, units, temporal.decode_cf_time(F.lit(180.0), F.col("t")))
    assert [str(x) for x in got] == ["2020-09-15 03:00:00", "2020-09-16 03:00:00", "2020-01-08 12:00:00",
                                     "2020-06-29 00:00:00", "2020-01-01 00:03:00", "None", "None"]


def test_odd_calendar_stops_the_job(spark):
    df = texts(spark, ["noleap"]).select(temporal.decode_cf_time(F.lit(1.0), F.lit("days since 2020-01-01"), F.col("t")))
    with pytest.raises(Exception, match="unsupported calendar"):
        df.collect()


def test_snap_rounds_half_to_even(spark):
    stamps = ["2020-01-01 00:00:30", "2020-01-01 00:01:30", "2020-01-01 00:00:30.000001", "1969-12-31 23:59:29.999999", "2020-01-01 00:00:00.5"]
    got = mapped(spark, stamps, temporal.snap_time(F.col("t").cast("timestamp_ntz"), 60 * 10**9))
    assert [str(x)[11:] for x in got] == ["00:00:00", "00:02:00", "00:01:00", "23:59:00", "00:00:00"]


@pytest.mark.parametrize(("text", "low", "high"), [
    ("2020-01-01/2020-01-02", "2020-01-01 00:00:00", "2020-01-03 00:00:00"),
    ("2020-02/2020", "2020-02-01 00:00:00", "2021-01-01 00:00:00"),
    ("/2020-12", None, "2021-01-01 00:00:00"),
    ("2020-01-01T05:30/", "2020-01-01 05:30:00", None),
    ("2020-01-01/2020-01-02T03:04:05Z", "2020-01-01 00:00:00", "2020-01-02 03:04:06"),
])
def test_time_bounds(text, low, high):
    assert tuple(x and str(x) for x in temporal.time_bounds(text)) == (low, high)


def test_range_text_round_trip(spark):
    r = mapped(spark, ["2024-01-01T00:00:00Z/2024-03-31T00:00:00Z", "2024-01-01", "2024-01-01/"], temporal.parse_range(F.col("t")))
    assert str(r[0]["start"]) == "2024-01-01 00:00:00" and str(r[0]["end"]) == "2024-03-31 00:00:00"
    assert r[1]["start"] is None and r[2]["end"] is None


# -- values and text ---------------------------------------------------------------------------


def test_mask_skips_nan_markers_and_prefers_the_range(spark):
    v = spark.createDataFrame([(float(x),) for x in (-1e30, 1, 2, 3, 4, 999)], "v DOUBLE")
    keep = quality.quality_mask(F.col("v"), fill=-1e30, missing=float("nan"), valid_min=3, valid_range=[0, 10])
    assert [r[0] for r in v.select(keep).collect()] == [None, 1, 2, 3, 4, None]


def test_number_text_matches_python(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e-5, 1.5e-4, 0.0005, 0.001, 123456789.25, 1e15, 1e16, -179.875, 1e7] + [
        round(rng.uniform(-180, 180), rng.randint(0, 6)) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    got = {r["i"]: r["x"] for r in df.select("i", tx.plain_number(F.col("v")).alias("x")).collect()}
    assert [got[i] for i in range(len(values))] == [str(v) for v in values]


def test_encodings_match_the_standard_library(spark):
    from urllib.parse import quote, quote_plus

    values = ["/a b;[0:1]-_.~*()", "é+&=", "plain"]
    assert mapped(spark, values, tx.percent_encode(F.col("t"))) == [quote(v, safe="") for v in values]
    assert mapped(spark, values, tx.form_encode(F.col("t"))) == [quote_plus(v) for v in values]


def test_retrieval_key_golden(spark):
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", (-105.0, 37.0, -104.0, 38.0), strict=True)])
    key = retrieval_key(F.lit("S"), F.lit("f"), box, F.lit("t"), F.array(F.lit("b"), F.lit("a")), F.lit(None), F.lit("2"))
    want = hashlib.sha256(b"S:f:-105.0,37.0,-104.0,38.0:t:a,b::2").hexdigest()[:24]
    assert spark.range(1).select(key).first()[0] == want


def test_file_names_and_job_ids(spark):
    urls = ["https://h/a/G.dap.nc4?dap4.ce=%2Fx", "https://h/a/G.nc4.dap.nc4", "https://h/a/", "https://h/x.nc"]
    assert mapped(spark, urls, tx.file_name_from_url(F.col("t"))) == ["G.nc4", "G.nc4", "subset.nc4", "x.nc"]
    jobs = ["https://h/jobs/abc?linktype=https", "https://h/jobs/abc/#f", "https://h/", None, "jobs/xyz"]
    assert mapped(spark, jobs, tx.job_id_from_url(F.col("t"))) == ["abc", "abc", None, None, "xyz"]


def test_formats_and_media_types(spark):
    assert mapped(spark, [" CSV ", "NetCDF4", "tiff"], tx.canonical_format(F.col("t"))) == ["text/csv", "application/x-netcdf", None]
    assert mapped(spark, ["a.NC", "b.hdf5", "c.png", "noext"], tx.media_type_of(F.col("t"))) == [
        "application/netcdf4", "application/netcdf4", "application/octet-stream", "application/octet-stream"]


