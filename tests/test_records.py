from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graticule.operators import area as ar
from graticule.operators import catalog as cat
from graticule.operators import coverage as cov
from graticule.operators import manifest as mf
from graticule.operators import routing as rt
from graticule.operators import sample as sm
from graticule.sources import lookups as lk
from graticule.sources import metadata as md
from graticule.sources.files import pick_result_files


def records(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "raw STRING")


# -- ingest ---------------------------------------------------------------------------------


def test_granule_sizes_follow_the_unit_rule(spark):
    def doc(*entries):
        return {"meta": {"concept-id": "G"}, "umm": {"DataGranule": {"ArchiveAndDistributionInformation": list(entries)}}}

    g = md.parse_granules(records(
        spark, doc({"SizeInBytes": 1048576}, {"Size": 2.5, "SizeUnit": "MB"}), doc({"Size": 3, "SizeUnit": "GB"}),
        doc({"SizeInBytes": 0, "Size": "4", "SizeUnit": "MB"}), {"meta": {}, "umm": {}}))
    assert [(r["size_mb"], r["unsized_entries"]) for r in g.collect()] == [(3.5, 0), (0.0, 1), (4.0, 0), (0.0, 0)]


def test_collection_layer(spark):
    c = md.parse_collections(records(
        spark,
        {"meta": {"concept-id": "C1"}, "umm": {"ProcessingLevel": {"Id": "2"}, "StandardProduct": False, "Purpose": "p", "CollectionProgress": "ACTIVE",
         "SpatialExtent": {"HorizontalSpatialDomain": {"Geometry": {"GPolygons": [{"Boundary": {"Points": [
             {"Longitude": 1, "Latitude": 5}, {"Longitude": -3, "Latitude": 7}]}}]}}}}},
        {"meta": {"concept-id": "C2"}, "umm": {"ProcessingLevel": {"Id": "3"}, "StandardProduct": None}})).collect()
    assert c[0]["output_shape"] == "swath" and tuple(c[0]["spatial_extent"]) == (-3, 5, 1, 7)
    assert c[0]["advisory"] == ["CollectionProgress: ACTIVE", "Not flagged as the standard product (StandardProduct=false).", "p"]
    assert c[1]["output_shape"] == "grid" and c[1]["spatial_extent"] is None and c[1]["advisory"] == []


def test_keyword_dump_forms(spark):
    dumps = [{"concepts": [{"prefLabel": "", "label": "b"}, "plain", {"text": "t"}, 5]}, [{"text": "no"}, {"label": "x"}, "y"], {"other": 1}]
    got = sorted(r["label"] for r in md.parse_keyword_labels(records(spark, *dumps)).collect())
    assert got == ["b", "plain", "t", "x", "y"]


# -- services: no union across services ---------------------------------------------------------


UNION_TRAP = {
    "conceptId": "C1", "shortName": "X", "bboxSubset": True, "variableSubset": True, "outputFormats": ["netcdf", "png"],
    "services": [
        {"name": "subsetter", "href": "https://c/S1/", "capabilities": {"subsetting": {"bbox": True, "variable": True}, "output_formats": ["netcdf"]}},
        {"name": "imagenator", "href": "https://c/S2", "capabilities": {"subsetting": {"variable": True}, "output_formats": ["png"]}},
    ],
}


def test_union_trap(spark):
    caps = md.parse_capabilities(records(spark, UNION_TRAP).withColumn("concept_id", F.lit("C1")))
    merged = md.merge_capabilities(md.parse_collections(records(spark, {"meta": {"concept-id": "C1"}, "umm": {}})), caps)
    rows = [("bp", True, False, "png"), ("bn", True, False, "netcdf"), ("vp", False, True, "png")]
    req = spark.createDataFrame(rows, "request_id STRING, needs_bbox BOOLEAN, needs_variable BOOLEAN, output_format STRING")
    for need in ("temporal", "shape", "dimension", "reproject", "point_sample"):
        req = req.withColumn(f"needs_{need}", F.lit(False))
    req = req.withColumn("collection_id", F.lit("C1")).withColumn("has_urls", F.lit(True))
    matched = rt.match_services(req, merged)
    got = {r["request_id"]: r["service"] and r["service"]["service_name"] for r in matched.collect()}
    assert got == {"bp": None, "bn": "subsetter", "vp": "imagenator"}
    why = {r["request_id"]: r for r in rt.explain_routes(rt.route_requests(matched)).collect()}
    assert why["bp"]["reason"] == "no_single_service_satisfies"
    assert [u["first_unmet_need"] for u in why["bp"]["unmet"]] == ["output_format", "bbox"]
    assert why["bn"]["satisfied_needs"] == ["bbox", "output_format"]
    routes = {r["request_id"]: r["route"] for r in rt.route_requests(matched, service_available=False).collect()}
    assert routes == {"bp": None, "bn": "harmony", "vp": "harmony"}


# -- constraint expressions -------------------------------------------------------------------------


def brackets(axis, low, high):
    """The index range of a degree window, by walking over the cells."""
    origin, step, n = axis
    if low > high:
        return ""
    places = sorted(((low - origin) / step, (high - origin) / step))
    first, last = math.floor(places[0]), math.ceil(places[1])
    cells = [i for i in range(n) if first <= i <= last]
    if not cells:
        cells = [0 if last < 0 else n - 1]
    return f"[{cells[0]}:{cells[-1]}]"


def constraint(spark, *, names=("depth",), box=(12.0, -30.0, 31.5, -8.25), boxed=True, lat="y", lon="x", time=None,
               lat_axis=(-44.5, 1.0, 90), lon_axis=(0.75, 1.5, 240), plans=None, shape="grid", ambiguous=None):
    leaf = lambda n: n.rsplit("/", 1)[-1]
    usual = [(leaf(lat), None), (leaf(lon), None)]
    axis = "STRUCT<origin: DOUBLE, step: DOUBLE, length: BIGINT>"
    df = spark.createDataFrame(
        [(boxed, box, shape, lat, lon, time, lat_axis, lon_axis, [(v, (plans or {}).get(v, usual)) for v in names], ambiguous)],
        f"""needs_bbox BOOLEAN, bbox STRUCT<w: DOUBLE, s: DOUBLE, e: DOUBLE, n: DOUBLE>, output_shape STRING, coord_lat STRING, coord_lon STRING,
        coord_time STRING, lat_axis {axis}, lon_axis {axis}, variables ARRAY<STRUCT<name: STRING, dim_plan: ARRAY<STRUCT<leaf: STRING, size: BIGINT>>>>,
        ambiguous BOOLEAN""")
    return mf.constraint_expressions(df).first()


@pytest.mark.parametrize("seed", range(6))
def test_constraints_cut_what_the_box_meets(spark, seed):
    rng = random.Random(seed)
    lat_axis = (rng.uniform(-80, 80), rng.choice([-1, 1]) * rng.choice([0.5, 1.0, 2.25]), rng.randint(1, 70))
    lon_axis = (rng.uniform(-170, 170), rng.choice([-1, 1]) * rng.choice([0.75, 3.0]), rng.randint(1, 120))
    w, e, s = rng.uniform(-170, 150), rng.uniform(-170, 150), rng.uniform(-80, 60)
    n = s + rng.uniform(0, 25)
    la, lo = brackets(lat_axis, s, n), brackets(lon_axis, w, e)
    got = constraint(spark, box=(w, s, e, n), lat_axis=lat_axis, lon_axis=lon_axis, names=["depth", "set/salt", "depth", "x"],
                     plans={"set/salt": [("tide", 3), ("y", None), ("x", None)]})
    assert got["status"] == "ok"
    assert got["constraint"].split(";") == [f"/y{la}", f"/x{lo}", f"/depth{la}{lo}", f"/set/salt[0:2]{la}{lo}"]


def test_constraints_without_a_cut(spark):
    whole = lambda **k: constraint(spark, **k)["constraint"].split(";")
    assert whole(boxed=False, names=["depth of sea"], time="/t/when") == ["/t/when", "/depth of sea"]
    assert whole(lat_axis=None, lon_axis=None) == ["/y", "/x", "/depth"] == whole(shape="swath")
    assert whole(plans={"depth": None})[2] == "/depth"
    assert whole(names=[]) == [""]


def test_an_ambiguous_request_never_asks_for_the_whole_file(spark):
    got = constraint(spark, ambiguous=True)
    assert got["constraint"] is None and got["status"] == "ambiguous"
    frame = spark.createDataFrame([(1, None, "ambiguous"), (2, "/a", "ok")], "request_id INT, constraint STRING, status STRING")
    granules = spark.createDataFrame([(k, r, f"g{r}", f"https://h.example/g{r}") for k in (1, 2) for r in range(1, 121)],
                                     "request_id INT, rank INT, granule_ur STRING, access_url STRING")
    rows = mf.subset_manifest(frame, granules).collect()
    assert len(rows) == 240 and all((r["url"] is None) == (r["request_id"] == 1) for r in rows)
    assert sorted({r["batch"] for r in rows}) == [0, 1, 2] and all(r["batch"] == (r["rank"] - 1) // 50 for r in rows)


# -- coverage against brute force ---------------------------------------------------------------------


def meets(a, b):
    parts = lambda w, e: [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    lon = any(p[0] <= q[1] and q[0] <= p[1] for p in parts(a[0], a[2]) for q in parts(b[0], b[2]))
    return lon and a[1] <= b[3] and b[1] <= a[3] and a[4] <= b[5] and b[4] <= a[5]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_overlap_join_is_exact(spark, broadcast):
    rng = random.Random(5)
    start = datetime(2000, 1, 1)

    def box(i, granule):
        wide = rng.choice([0, 1, 4, 10, 60, 359])
        w = float(rng.randint(-180, 180))
        e = w + wide
        s = float(rng.randint(-90, 80))
        t = start + timedelta(days=rng.randint(0, 3000))
        span = rng.choice([0, 1, 30, 500, 4000])
        return (f"{'G' if granule else 'R'}{i}", f"C{rng.randint(0, 1)}", w, s, e - 360 if e > 180 else e, min(90.0, s + rng.choice([0, 5, 170])), t, t + timedelta(days=span))

    reqs, grans = [box(i, False) for i in range(150)], [box(i, True) for i in range(400)]
    cols = "collection_id STRING, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE"
    r = spark.createDataFrame(reqs, f"request_id STRING, {cols}, t0 TIMESTAMP_NTZ, t1 TIMESTAMP_NTZ")
    g = spark.createDataFrame(grans, f"granule_ur STRING, {cols}, time_start TIMESTAMP_NTZ, time_end TIMESTAMP_NTZ")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", broadcast)
    got = [(x["request_id"], x["granule_ur"]) for x in cov.overlap_join(r, g).collect()]
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    want = {(a[0], b[0]) for a in reqs for b in grans if a[1] == b[1] and meets(a[2:], b[2:])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_size_estimate_is_over_all_granules(spark):
    rng = random.Random(11)
    sizes = {1: [rng.choice([None, 0.0, rng.uniform(0.1, 90)]) for _ in range(173)], 2: [None] * 7, 3: []}
    start = datetime(2003, 2, 1)
    rows = [(k, f"g{i:04}", start + timedelta(hours=i), x) for k, xs in sizes.items() for i, x in enumerate(xs)]
    requests = spark.createDataFrame([(k, "C") for k in sizes], "request_id INT, collection_id STRING")
    overlaps = spark.createDataFrame(rows, "request_id INT, granule_ur STRING, time_start TIMESTAMP_NTZ, size_mb DOUBLE")

    def check(got, taken):
        for k, xs in sizes.items():
            known = [x for x in xs[:taken] if x]
            mean = sum(known) / len(known) if known else 0.0
            assert got[k]["total_granules"] == len(xs)
            assert got[k]["avg_size_mb"] == pytest.approx(mean, abs=1e-3) and got[k]["total_size_mb"] == pytest.approx(mean * len(xs), abs=1e-3)
            assert (got[k]["warning"] is None) == bool(known)

    check({r["request_id"]: r for r in cov.estimate_sizes(requests, overlaps).collect()}, None)
    check({r["request_id"]: r for r in cov.estimate_sizes(requests, overlaps, sample=9).collect()}, 9)


def test_regions_hold_their_landmarks(spark):
    marks = [("Africa", 36.8, -1.3), ("europe", 2.35, 48.85), (" Mena", 46.7, 24.7), ("se asia", 106.8, -6.2), ("West Indies", -76.8, 18.0),
             ("nordic", -21.9, 64.1), ("antarctic", 0.0, -75.0), ("Far East", 139.7, 35.7), ("oceania", 151.2, -33.9)]
    l = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "id INT, text STRING, x DOUBLE, y DOUBLE")
    hits = ar.lookup_regions(l, lk.region_keys(lk.region_entries(spark)))
    assert hits.count() == len(marks)
    assert hits.where("x BETWEEN w AND e AND y BETWEEN s AND n").count() == len(marks)
    assert lk.region_entries(spark).count() == 17


def test_watershed_name_phases(spark):
    names = [("02", 1, "Mid Atlantic Region"), ("10", 1, "Missouri Region"), ("1408", 2, "Upper San Juan"), ("1409", 2, "Lower San Juan"), ("14080101", 4, "Animas"), ("14080102", 4, "Animas Forks")]
    w = spark.createDataFrame([(c, lv, n, 0.0, 0.0, 1.0, 1.0) for c, lv, n in names], "code STRING, level BIGINT, name STRING, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")
    asks = ["missouri", "San Juan", "Juan River Upper", "animas", "river basin", "Nile", "an", "ANIMAS forks"]
    l = spark.createDataFrame([(a,) for a in asks], "text STRING")
    got = {r["text"]: (r["status"], r["code"], r["suggested_code"]) for r in ar.match_watershed_names(l, w).collect()}
    assert got == {"missouri": ("ok", "10", None), "San Juan": ("ambiguous", None, "1408"), "Juan River Upper": ("ok", "1408", None),
                   "animas": ("ambiguous", None, "14080101"), "river basin": ("none", None, None), "Nile": ("none", None, None),
                   "an": ("ok", "02", None), "ANIMAS forks": ("ok", "14080102", None)}
    found = {(r["text"], r["candidate"]) for r in ar.ambiguous_candidates(l, w).collect()}
    assert ("San Juan", "Lower San Juan (1409)") in found and len(found) == 4


def test_contains_join_is_exact(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    names, asks = [word(12) for _ in range(200)], [[word(rng.randint(1, 5)) for _ in range(rng.randint(1, 2))] for _ in range(40)]
    n = spark.createDataFrame([(x.upper(),) for x in set(names)], "name STRING")
    q = spark.createDataFrame([(i, a) for i, a in enumerate(asks)], "q INT, parts ARRAY<STRING>")
    got = sorted((r["q"], r["match_name"]) for r in ar.contains_join(q, n, "parts", "name").collect())
    assert got == sorted((i, x.upper()) for i, a in enumerate(asks) for x in set(names) if all(p in x for p in a))


def test_keyword_priority(spark):
    terms = spark.createDataFrame([("Rain ",), ("SOIL",), ("oil",), ("zzz",)], "term STRING")
    labels = spark.createDataFrame([("Soil", 3), ("OIL SPILL", 2), ("Boiling", 1)], "label STRING, pos INT")
    got = {}
    for r in cat.normalize_keywords(terms, lk.synonym_keys(spark), labels).collect():
        got.setdefault((r["term"], r["rule"]), set()).add(r["keyword"])
    assert got == {("Rain ", "synonym"): {"PRECIPITATION AMOUNT", "PRECIPITATION RATE"}, ("SOIL", "exact"): {"Soil"},
                   ("oil", "substring"): {"Soil", "OIL SPILL", "Boiling"}, ("zzz", "passthrough"): {"zzz"}}
    first = {r["term"]: r["keyword"] for r in cat.search_keywords(cat.normalize_keywords(terms, lk.synonym_keys(spark), labels)).collect()}
    assert first == {"Rain ": "PRECIPITATION AMOUNT", "SOIL": "Soil", "oil": "Boiling", "zzz": "zzz"}


def test_notes_never_change_facts(spark):
    c = spark.createDataFrame([("A", "v1"), ("B", "v2")], "short_name STRING, version STRING")
    curated = spark.createDataFrame([("A", ["n1"], "o", "d")], "short_name STRING, notes ARRAY<STRING>, owner STRING, last_reviewed STRING")
    noted = cat.collection_notes(curated).withColumn("version", F.lit("hacked"))
    rows = {r["short_name"]: r for r in cat.attach_notes(c, noted, ["short_name"]).collect()}
    assert rows["A"]["version"] == "v1" and rows["B"]["advisory_notes"] == []
    assert rows["A"]["advisory_notes"][0].asDict() == {"note": "n1", "owner": "o", "last_reviewed": "d", "authoritative": False, "advisory": "advisory/non-authoritative"}


def test_imagery_layer_preference(spark):
    rows = [("a", 0, "P", True, None), ("a", 1, "X_Night", None, None), ("a", 2, "X_Day", None, False), ("a", 3, "Y", None, None),
            ("b", 0, "P_Night", True, None), ("b", 1, "Q", None, True), ("c", 0, None, None, None)]
    l = spark.createDataFrame(rows, "collection_id STRING, pos INT, layer STRING, arctic BOOLEAN, antarctic BOOLEAN")
    assert {r[0]: r[1] for r in cat.select_imagery_layers(l).collect()} == {"a": "X_Day", "b": "Q", "c": None}


def test_nearest_on_irregular_axis(spark):
    rng = random.Random(9)
    axis = sorted({round(rng.uniform(-80, -20), 3) for _ in range(30)} | {60.5, 61.5})
    pts = [-90.0, 90.0, 61.0, 10.0] + [round(rng.uniform(-90, 90), 3) for _ in range(200)]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(pts)], "i INT, p DOUBLE")
    a = spark.createDataFrame([(x,) for x in axis], "lat DOUBLE")
    got = {r["i"]: r["lat"] for r in sm.nearest_on_axis(p, a, "p", "lat", (-90, 90)).collect()}
    assert [got[i] for i in range(len(pts))] == [min(axis, key=lambda v: (abs(v - x), v)) for x in pts]


def test_result_file_listing(spark):
    rows = [("a", i, i, f"f{i}.csv", "csv") for i in range(8)] + [("b", 0, 1, "granule-list.csv", "csv"), ("b", 1, 2, "x-Results.csv", "CSV"), ("b", 2, 3, "y-results.csv", "csv")]
    m = spark.createDataFrame(rows, "task_id STRING, pos INT, file_id INT, file_name STRING, file_type STRING")
    got = {r["task_id"]: r for r in pick_result_files(m).collect()}
    assert got["a"]["status"] == "no_results" and got["a"]["seen_files"] == "f0.csv, f1.csv, f2.csv, f3.csv, f4.csv, f5.csv…"
    assert (got["b"]["file_id"], got["b"]["status"]) == (2, "ok")
