from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graticule.operators import jobs as jb
from graticule.operators import lineage as ln
from graticule.streaming import ingest, job_state, means

EDGE = "ws STRING, target STRING, source STRING"


def brute(edges):
    out = {}
    for ws in {e[0] for e in edges}:
        up = {}
        for w, t, s in edges:
            if w == ws:
                up.setdefault(t, set()).add(s)
        for start in up:
            frontier, depth = {start}, 0
            seen = {}
            while frontier:
                depth += 1
                frontier = {s for f in frontier for s in up.get(f, ())} - set(seen)
                for s in frontier:
                    seen[s] = depth
            out.update({(ws, start, a): d for a, d in seen.items()})
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["ws"], r["handle"], r["ancestor"]): r["depth"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_chain_diamond_cycle_and_workspaces(spark):
    chain = [("a", f"h{i}", f"h{i + 1}") for i in range(20)]
    diamond = [("a", "d", "l"), ("a", "d", "r"), ("a", "l", "top"), ("a", "r", "m"), ("a", "m", "top")]
    cycle = [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x")]
    other = [("b", "h0", "secret"), ("b", "d", "top")]
    edges = chain + diamond + cycle + other
    e = spark.createDataFrame(edges, EDGE)
    want = brute(edges)
    assert want[("a", "h0", "h20")] == 20 and want[("a", "d", "top")] == 2 and want[("a", "x", "x")] == 3
    assert as_dict(ln.ancestry_closure(e)) == want
    starts = spark.createDataFrame([("a", "h0"), ("a", "d"), ("a", "x"), ("b", "h0"), ("b", "gone")], "ws STRING, handle STRING")
    keys = {tuple(r) for r in starts.collect()}
    assert as_dict(ln.ancestry(e, starts)) == {k: d for k, d in want.items() if k[:2] in keys}
    assert max(as_dict(ln.ancestry_closure(e, 5)).values()) == 5 and max(as_dict(ln.ancestry(e, starts, 3)).values()) == 3
    none = spark.createDataFrame([("a", "nobody")], "ws STRING, handle STRING")
    assert ln.ancestry(e, none).count() == 0


def test_closure_on_random_graphs(spark, monkeypatch):
    rng = random.Random(4)
    edges = list({("w", f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(70)})
    e = spark.createDataFrame(edges, EDGE)
    assert as_dict(ln.ancestry_closure(e)) == brute(edges)
    monkeypatch.setattr(ln, "is_small", lambda df, n=0: False)
    assert as_dict(ln.ancestry_closure(e)) == brute(edges)


def test_url_specs(spark):
    specs = {
        '{"u":"HTTP://x"}': True, '{"l":["a","gs://b"]}': True, '{"opendap_url":"https://x","opendap_urls":["https://y"]}': False,
        '{"n":{"u":"s3://x"}}': False, '{"t":"see https://x"}': False, '{"t":"[\\"http://x\\"]"}': False, '{"l":[["http://x"]]}': False, "{}": False,
    }
    df = spark.createDataFrame([(s,) for s in specs] + [(None,)], "spec STRING")
    got = {r["spec"]: r["bad"] for r in df.select("spec", ln.spec_has_url(F.col("spec")).alias("bad")).collect()}
    assert got == {**specs, None: False}


def test_spec_round_trip_and_legacy_forms(spark):
    full = {"concept_id": "C", "output_format": "image/png", "needs_bbox": True, "aoi_bbox": [-1.0, 2.0, 3.0, 4.0], "variables": ["a"], "provider": "opendap",
            "opendap_urls": ["u1", "u2"], "lat_axis": {"name": "lat", "origin": -59.875, "step": 0.25, "length": 600}, "var_dims": {"a": [["lat", None]]}}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, '{"opendap_url":"only"}')], "id INT, spec STRING")
    table = ln.read_specs(df)
    rows = {r["id"]: r for r in table.collect()}
    assert rows[2]["provider"] == "harmony" and rows[2]["output_format"] == "application/netcdf4" and rows[2]["opendap_urls"] == ["only"]
    assert rows[2]["needs_bbox"] is False and rows[2]["variables"] == [] and rows[2]["aoi_bbox"] is None
    back = {r["id"]: json.loads(r["spec"]) for r in ln.write_specs(table).collect()}
    assert len(back[1]) == 25 and back[1]["opendap_url"] == "u1" and back[1]["var_dims"] == {"a": [["lat", None]]} and back[1]["lat_axis"] == full["lat_axis"]
    assert back[2]["opendap_urls"] == ["only"] and back[1]["coord_time"] is None


def test_payload_merge_keeps_a_later_null(spark):
    rows = [("h", 1, {"a": "1", "b": "x"}), ("h", 3, {"b": None}), ("h", 2, {"b": "y", "c": "z"})]
    u = spark.createDataFrame(rows, "handle STRING, seq INT, payload MAP<STRING, STRING>")
    assert ln.merge_payloads(u).first()["payload"] == {"a": "1", "b": None, "c": "z"}


def test_transform_key_depends_on_order_of_sources_only(spark):
    def key(sources, params):
        m = F.create_map(*[F.lit(x) for kv in params for x in kv])
        return spark.range(1).select(ln.transform_key(F.lit("op"), F.array(*[F.lit(s) for s in sources]), m)).first()[0]

    assert key(["a", "b"], [("x", "1"), ("y", "2")]) == key(["a", "b"], [("y", "2"), ("x", "1")])
    assert key(["a", "b"], [("x", "1")]) != key(["b", "a"], [("x", "1")])


# -- jobs and streams ------------------------------------------------------------------------------


LOG = [(1, 1, "pending"), (1, 2, "submitted"), (1, 3, "running"), (1, 4, "materializing"), (1, 5, "ready"), (1, 6, "expired"),
       (2, 1, "pending"), (2, 2, "running"), (2, 3, "failed"), (2, 4, "running"), (3, 1, "ready"), (3, 2, "ready")]


def test_illegal_transitions(spark):
    log = spark.createDataFrame([(*r, None) for r in LOG], "job_id BIGINT, seq BIGINT, state STRING, created_at TIMESTAMP_NTZ")
    got = {(r["job_id"], r["previous"], r["state"]) for r in jb.illegal_transitions(log).collect()}
    assert got == {(2, "pending", "running"), (2, "failed", "running"), (3, "ready", "ready")}
    assert [(r["job_id"], r["resume_step"]) for r in jb.unfinished_jobs(log).collect()] == [(2, "poll_job")]


def test_long_jobs_are_sorted_in_stretches(spark):
    rng = random.Random(8)
    states = list(jb.LEGAL)
    rows = [(j, s, rng.choice(states)) for j in range(3) for s in rng.sample(range(1000), 300)]
    log = spark.createDataFrame(rows, "job_id BIGINT, seq BIGINT, state STRING")
    got = {(r["job_id"], r["seq"]): r["before_state"] for r in jb.with_previous(log, ["state"], 7).collect()}
    want = {}
    for j in range(3):
        before = None
        for _, s, state in sorted(r for r in rows if r[0] == j):
            want[(j, s)] = before
            before = state
    assert got == want


def test_job_state_stream_carries_state_between_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 2), (2, 4), (4, 9)):
        batch = [r for r in LOG if low < r[1] <= high]
        spark.createDataFrame(batch, "job_id BIGINT, seq BIGINT, state STRING").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job_id BIGINT, seq BIGINT, state STRING").parquet(source)
        job_state.track_jobs(stream, path, str(tmp_path / "progress")).awaitTermination()
    got = {r["job_id"]: (r["seq"], r["state"], r["illegal"]) for r in job_state.current_state(spark, path).collect()}
    assert got == {1: (6, "expired", 0), 2: (4, "running", 2), 3: (2, "ready", 1)}


def test_granule_stream_drops_repeats(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, ids in enumerate((["G1", "G2", "G1"], ["G2", "G3"])):
        lines = [json.dumps({"meta": {"concept-id": g}, "umm": {"GranuleUR": g}}) for g in ids]
        (source / f"{i}.json").write_text("\n".join(lines))
        records = ingest.read_record_files(spark, str(source))
        ingest.append_batches(ingest.ingest_granules(records), path, str(tmp_path / "progress")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(path).select("concept_id").collect()) == ["G1", "G2", "G3"]


def test_stream_means_drop_late_rows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0)], [("2024-01-01 05:00:00", 9.0)], [("2024-01-01 00:20:00", 100.0), ("2024-01-01 09:00:00", 0.0)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "t STRING, v DOUBLE").select(F.col("t").cast("timestamp").alias("time"), F.lit(1).alias("cell"), "v")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("time TIMESTAMP, cell INT, v DOUBLE").parquet(source)
        means.stream_means(stream, "h", ["v"], ["cell"]).writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r["time"]), r["v"]) for r in spark.read.parquet(path).collect()) == [
        ("2024-01-01 00:00:00", 2.0), ("2024-01-01 05:00:00", 9.0)]


def test_different_parameters_have_different_keys(spark):
    maps = [{"a=b": "c"}, {"a": "b=c"}, {"a": None}, {"a": ""}, {"a": "null"}, {}, {"a": '"},{"'}]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i INT, p MAP<STRING, STRING>")
    keys = rows.select(ln.transform_key(F.lit("subset"), F.array(F.lit("obs_1")), F.col("p")).alias("k")).distinct()
    assert keys.count() == len(maps)


def test_late_job_events_are_counted(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id BIGINT, seq BIGINT, state STRING"
    for batch in ([(1, 1, "pending"), (1, 5, "submitted")], [(1, 3, "failed"), (1, None, "ready"), (1, 6, "running")], [(2, 2, "pending"), (1, 6, "running")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        job_state.track_jobs(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "progress")).awaitTermination()
    got = {r["job_id"]: (r["seq"], r["state"], r["illegal"], r["late"]) for r in job_state.current_state(spark, path).collect()}
    assert got == {1: (6, "running", 0, 3), 2: (2, "pending", 0, 0)}


def _plain_closure(edges, limit=None):
    onward, found = {}, {}
    for ws, target, source in edges:
        onward.setdefault((ws, target), set()).add(source)
    for ws, start in onward:
        near, depth, seen = {start}, 0, {}
        while near and (limit is None or depth < limit):
            depth += 1
            near = {y for x in near for y in onward.get((ws, x), ())} - seen.keys()
            seen |= dict.fromkeys(near, depth)
        found |= {(ws, start, y): d for y, d in seen.items()}
    return found


@pytest.mark.parametrize("limit", [None, 21])
def test_closure_of_long_ways_and_tops_equals_brute_force(spark, limit):
    """Ways of many stretches, shortcuts across them, a long cycle, tops over tops, two workspaces."""
    rng = random.Random(8)
    edges = [("a", f"p{i}", f"p{i - 1}") for i in range(1, 71)] + [("a", f"p{i}", f"p{i - rng.randint(2, 9)}") for i in (20, 33, 52)]
    edges += [("a", f"y{i}", f"y{(i + 1) % 41}") for i in range(41)] + [("a", "p0", "y3"), ("b", "y2", "p70")]
    edges += [("a", f"t{i}", rng.choice([f"p{rng.randrange(71)}", f"y{rng.randrange(41)}"])) for i in range(400) for _ in range(2)]
    edges += [("a", f"u{i}", f"t{rng.randrange(400)}") for i in range(1500)]
    got = ln.ancestry_closure(spark.createDataFrame(edges, "ws string, target string, source string"), limit)
    rows = got.collect()
    assert len(rows) == len(_plain_closure(edges, limit))
    assert {(r.ws, r.handle, r.ancestor): r.depth for r in rows} == _plain_closure(edges, limit)


def test_handles_that_reach_no_other_edges_leave_them_out_of_the_jumps(spark, monkeypatch):
    """Edges that no given handle can reach are not doubled, however many they are."""
    edges = [("a", f"p{i}", f"p{i - 1}") for i in range(1, 30)] + [("a", f"o{i}", f"c{i % 50}") for i in range(3000)]
    edges += [("a", f"c{i}", f"p{i % 3 + 20}") for i in range(50)]
    sizes, twice = [], ln._twice
    monkeypatch.setattr(ln, "_twice", lambda jumps: sizes.append(jumps.count()) or twice(jumps))
    handles = [("a", f"c{i}") for i in range(0, 50, 2)]
    got = ln.ancestry(spark.createDataFrame(edges, "ws string, target string, source string"), spark.createDataFrame(handles, "ws string, handle string"))
    plain = {k: d for k, d in _plain_closure(edges).items() if k[:2] in set(handles)}
    assert {(r.ws, r.handle, r.ancestor): r.depth for r in got.collect()} == plain
    assert max(sizes) <= 30


def test_tops_take_no_part_in_the_rounds(spark, monkeypatch):
    edges = [("a", f"p{i}", f"p{i - 1}") for i in range(1, 41)] + [("a", f"t{i}", f"p{i % 41}") for i in range(500)]
    sizes, small = [], ln.is_small
    monkeypatch.setattr(ln, "is_small", lambda df, limit: sizes.append(df.count()) or small(df, limit))
    got = ln.ancestry_closure(spark.createDataFrame(edges, "ws string, target string, source string"))
    assert {(r.ws, r.handle, r.ancestor): r.depth for r in got.collect()} == _plain_closure(edges)
    assert max(sizes) <= 40 and len(sizes) <= 8


def test_extended_closure_puts_tops_together_from_lists(spark, monkeypatch):
    """Appended edges meet tops as lists: no table of the tops' pairs is written or compared, and lists stay bounded."""
    rng = random.Random(9)
    edges = [("a", f"p{i}", f"p{i - 1}") for i in range(1, 71)] + [("a", f"y{i}", f"y{(i + 1) % 41}") for i in range(41)] + [("a", "p0", "y3"), ("b", "y2", "p70")]
    edges += [("a", f"t{i}", rng.choice([f"p{rng.randrange(71)}", f"y{rng.randrange(41)}"])) for i in range(900) for _ in range(2)]
    edges = sorted(set(edges))
    late = [e for e in edges if rng.random() < 0.2]
    early = [e for e in edges if e not in set(late)]
    inner = [e for e in edges if e[1][0] != "t"]
    stored = spark.createDataFrame([(*k, d) for k, d in _plain_closure(early).items()], "ws string, handle string, ancestor string, depth int")
    written, cut = {}, ln.cut_lineage

    def keep(df, label):
        out = cut(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(ln, "cut_lineage", keep)
    monkeypatch.setattr(ln, "_LIST", 7)
    want = _plain_closure(edges)
    got = ln.extended_closure(stored, spark.createDataFrame(late + early[:3], "ws string, target string, source string"))
    assert as_dict(got) == want
    assert got.schema["depth"].dataType.simpleString() == "int"
    assert max(n for label, n in written.items() if label != "edges") <= len(_plain_closure(inner)) < len(want) / 5
    assert ln._listed(stored).agg(F.max(F.size("items"))).first()[0] == 7
    none = stored.limit(0)
    assert as_dict(ln.extended_closure(none, spark.createDataFrame(edges, "ws string, target string, source string"))) == want
    assert as_dict(ln.extended_closure(stored, none.select("ws", F.col("handle").alias("target"), F.col("ancestor").alias("source")))) == _plain_closure(early)
