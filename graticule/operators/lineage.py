"""Lineage tables: edges, events, handles, keys, request specs, ancestry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.text import handle_kind, plain_number
from graticule.session import among, bits_of, by_shuffle, cut_lineage, is_small

# Prefixes of short-lived URLs, keys that may hold lasting ones, event types.
URL_PREFIXES = ("http://", "https://", "s3://", "gs://")
LASTING_URL_KEYS = ("opendap_url", "opendap_urls")
EVENT_TYPES = (
    "created", "routed", "submitted", "provider-fallback", "opendap-not-applicable",
    "job-failed", "materialized", "expired", "re-materialized",
)

#: Pairs of handles below which a closure round broadcasts its growing pairs.
_EDGE_BROADCAST = 200_000


# -- ancestry --------------------------------------------------------------------------


#: Depth up to which distances double from single edges; what lies deeper is put together from stretches.
_NEAR = 16


def _doubled(edges: DataFrame, max_depth: int | None) -> list[DataFrame]:
    """Pairs of ``ws, handle, ancestor`` with their shortest depth, as one table for each round.

    Distances double: every pair at depth k+1 … 2k is a pair at exactly k followed by one of at
    most k, so a chain of depth d takes log2(d) joins and no pair is derived from every split of its
    path. Each round writes only the pairs it found, to the scratch folder, which cuts lineage.
    """
    pair = ["ws", "handle", "ancestor"]
    parts = [cut_lineage(edges.select(*pair).distinct().withColumn("depth", F.lit(1)), "closure")]
    k = 1
    while max_depth is None or k < max_depth:
        known = reduce(DataFrame.unionByName, parts)
        # Pairs at exactly k were all found in the last round.
        edge = parts[-1].where(F.col("depth") == k).select("ws", "handle", F.col("ancestor").alias("mid"))
        seen = known
        if is_small(edge, _EDGE_BROADCAST):
            # Few pairs are still growing: broadcast them and leave the known pairs unshuffled.
            edge = F.broadcast(edge)
            growing = F.broadcast(edge.select("ws", "handle").distinct())
            seen = known.join(growing, ["ws", "handle"], "left_semi")
        onward = known.select("ws", F.col("handle").alias("mid"), "ancestor", F.col("depth").alias("more"))
        longer = onward.join(edge, ["ws", "mid"]).groupBy(*pair).agg(
            (F.min("more") + F.lit(k)).alias("depth")
        )
        fresh = cut_lineage(longer.join(seen.select(*pair), pair, "left_anti"), "closure")
        if fresh.isEmpty():
            break
        parts.append(fresh)
        k *= 2
    return parts


#: Most ancestors in one list.
_LIST = 1_000

#: Ways that one task takes beyond their ends, so that what it unpacks does not grow with the tables.
_WAYS_A_TASK = 200_000


def _shortest(ways: DataFrame) -> DataFrame:
    return ways.groupBy("ws", "handle", "ancestor").agg(F.min("depth").alias("depth"))


def _listed(pairs: DataFrame) -> DataFrame:
    """Pairs ``ws, handle, ancestor, depth`` as ``ws, handle, items``, in lists of at most ``_LIST``."""
    place = F.row_number().over(Window.partitionBy("handle", "ws").orderBy("ancestor"))
    shared = pairs.withColumn("_list", F.floor((place - 1) / _LIST))
    return shared.groupBy("ws", "handle", "_list").agg(F.collect_list(F.struct("ancestor", "depth")).alias("items")).drop("_list")


def _beyond(ways: DataFrame, lists: DataFrame) -> DataFrame:
    """Ways ``ws, handle, ancestor, depth`` and what is listed for their ends, still as lists."""
    onward = by_shuffle(lists.withColumnRenamed("handle", "ancestor"))
    end = F.array(F.struct("ancestor", F.lit(0).alias("depth")))
    held = F.when(F.col("items").isNull(), end).otherwise(F.concat(end, "items"))
    return ways.join(onward, ["ws", "ancestor"], "left").select("ws", "handle", F.col("depth").alias("lead"), held.alias("items"))


def _unpacked(lists: DataFrame, ways: int) -> DataFrame:
    """The shortest of listed pairs: lists of a handle are dealt to one task and unpacked only there."""
    least = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.repartition(max(least, ways // _WAYS_A_TASK), "ws", "handle")
    return _shortest(dealt.select("ws", "handle", "lead", F.inline("items")).select("ws", "handle", "ancestor", (F.col("lead") + F.col("depth")).alias("depth")))


def _closure_by_stretches(edges: DataFrame, max_depth: int | None) -> DataFrame:
    """The closure of ``ws, handle, ancestor``: near pairs by doubling, far ones by one join.

    A shortest way of more than ``_NEAR`` steps is some whole stretches of ``_NEAR`` and a near
    rest. Stretches are edges of a graph with few pairs, whose closure is taken by doubling; so a
    far pair is made once, at the end, in place of being read again in every later round. Near
    pairs meet the stretches as lists.
    """
    near_parts = _doubled(edges, _NEAR if max_depth is None else min(_NEAR, max_depth))
    near = reduce(DataFrame.unionByName, near_parts)
    stretch = near_parts[-1].where(F.col("depth") == _NEAR)
    if (max_depth is not None and max_depth <= _NEAR) or stretch.isEmpty():
        return near if max_depth is None else near.where(F.col("depth") <= max_depth)
    stretches = reduce(DataFrame.unionByName, _doubled(stretch, None if max_depth is None else -(-max_depth // _NEAR)))
    lead = stretches.withColumn("depth", F.col("depth") * _NEAR)
    lists = cut_lineage(_listed(near), "lists")
    found = _unpacked(_beyond(lead, lists).unionByName(lists.withColumn("lead", F.lit(0))), stretches.count())
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def _split_tops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of handles that are nobody's source, and the other edges; written."""
    sources = edges.select("ws", F.col("ancestor").alias("handle")).distinct().withColumn("_is_source", F.lit(True))
    marked = cut_lineage(edges.join(sources, ["ws", "handle"], "left"), "edges")
    return marked.where("_is_source is null").drop("_is_source"), marked.where("_is_source").drop("_is_source")


def _layers(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of edges of handles that are nobody's source below, while they halve the edges, and the rest."""
    layers: list[DataFrame] = []
    while True:
        tops, inner = _split_tops(edges)
        if tops.isEmpty() or tops.count() < inner.count():
            return layers, edges
        layers.append(tops)
        edges = inner


def _with_layers(found: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """The closure of all edges from that of the innermost: a layer meets its sources' ancestors once, as lists."""
    for tops in reversed(layers):
        found = cut_lineage(found, "closure")
        bits = bits_of(tops.select(F.struct("ws", "ancestor").alias("_at")).distinct(), "_at")
        lists = _listed(found.where(among(F.struct("ws", "handle"), bits)))
        ways = tops.select("ws", "handle", "ancestor", F.lit(1).alias("depth"))
        found = found.unionByName(_unpacked(_beyond(ways, lists), tops.count()))
    return found


def ancestry_closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of all handles with their shortest depth, inside each workspace.

    ``edges``: ``ws, target, source``. Handles that are nobody's source (most, where many results
    come from few inputs) are left out of the rounds: their ancestors are their sources and those
    of their sources, by one join at the end. This is repeated while it halves the edges; the
    closure of the others is taken by doubling. On a cycle a handle is its own ancestor.
    """
    layers, left = _layers(cut_lineage(edges.select("ws", F.col("target").alias("handle"), F.col("source").alias("ancestor")).distinct(), "edges"))
    found = _with_layers(_closure_by_stretches(left, max_depth), layers)
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


#: Single steps that handle lists take before distances double.
_STEPS = 4


def _twice(jumps: DataFrame) -> DataFrame:
    """Pairs at twice the number of steps, from pairs ``ws, at, ancestor`` at exactly so many."""
    onward = jumps.select("ws", F.col("at").alias("ancestor"), F.col("ancestor").alias("far"))
    return jumps.join(onward, ["ws", "ancestor"]).select("ws", "at", F.col("far").alias("ancestor")).distinct()


def ancestry(edges: DataFrame, handles: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Ancestors of the given handles (``ws, handle``) with their shortest depth.

    The first rounds step the frontier along the edges and drop pairs seen before, so short
    histories cost what they hold, diamonds do not multiply and cycles end. What is still open
    then is a long chain: from there pairs found within k steps are joined with pairs at exactly
    k steps, which are doubled each round, so a chain of depth d takes log2(d) more rounds. Only
    edges of the workspaces that are still open are doubled.
    """
    e = cut_lineage(edges.select("ws", F.col("target").alias("at"), F.col("source").alias("ancestor")).distinct(), "edges")
    pair = ["ws", "handle", "ancestor"]
    frontier = handles.select("ws", "handle", F.col("handle").alias("at")).distinct()
    levels: list[DataFrame] = []
    depth = 0
    while depth < _STEPS and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.join(e, ["ws", "at"]).select(*pair).distinct()
        for seen in levels:
            step = step.join(seen.select(*pair), pair, "left_anti")
        level = cut_lineage(step.withColumn("depth", F.lit(depth)), "frontier")
        levels.append(level)
        if level.isEmpty():
            break
        frontier = level.select("ws", "handle", F.col("ancestor").alias("at"))
    if not levels:
        return frontier.select("ws", "handle", F.col("at").alias("ancestor"), F.lit(0).alias("depth")).limit(0)
    if depth < _STEPS or depth == max_depth or levels[-1].isEmpty():
        return reduce(DataFrame.unionByName, levels)
    # Only what a given handle can reach goes on: first handles that nobody has asked for and that are
    # nobody's source leave, then those that are no source of what is left, for jumps begin at ancestors.
    sources = lambda of: of.select("ws", F.col("ancestor").alias("at"))
    asked = handles.select("ws", F.col("handle").alias("at"))
    held = e.join(frontier.select("ws").distinct(), "ws", "left_semi").join(sources(e).unionByName(asked).distinct(), ["ws", "at"], "left_semi")
    jumps = cut_lineage(held.join(sources(held).distinct(), ["ws", "at"], "left_semi"), "jumps")
    for _ in range(_STEPS.bit_length() - 1):
        jumps = cut_lineage(_twice(jumps), "jumps")
    parts, k = levels, depth
    while max_depth is None or k < max_depth:
        known = reduce(DataFrame.unionByName, parts)
        onward = known.select("ws", "handle", F.col("ancestor").alias("at"), "depth").join(jumps, ["ws", "at"])
        longer = onward.groupBy(*pair).agg((F.min("depth") + F.lit(k)).cast("int").alias("depth"))
        fresh = cut_lineage(longer.join(known.select(*pair), pair, "left_anti"), "ancestors")
        if fresh.isEmpty():
            break
        parts = [*parts, fresh]
        jumps = cut_lineage(_twice(jumps), "jumps")
        k *= 2
    found = reduce(DataFrame.unionByName, parts)
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def _new_ways(closure: DataFrame, step: DataFrame) -> DataFrame:
    """Pairs from a new edge's target to a new edge's source along new edges and stored stretches between them.

    ``step``: the new edges as pairs of depth 1, written.
    """
    pair = ["ws", "handle", "ancestor"]
    ends = step.select("ws", F.col("handle").alias("ancestor")).distinct()
    # Stored stretches from one new edge's source to another's target, none at all among them.
    between = closure.join(step.select("ws", F.col("ancestor").alias("handle")).distinct(), ["ws", "handle"], "left_semi").join(ends, ["ws", "ancestor"], "left_semi")
    bridges = cut_lineage(between.select("ws", F.col("handle").alias("out"), F.col("ancestor").alias("into"), F.col("depth").alias("gap")), "bridges")

    def joined(front: DataFrame, back: DataFrame) -> DataFrame:
        """Ways of two parts: the second begins where the first ends, or beyond a bridge."""
        first = front.select("ws", "handle", F.col("ancestor").alias("out"), F.col("depth").alias("done"))
        direct = first.select("ws", "handle", F.col("out").alias("into"), "done")
        over = first.join(bridges, ["ws", "out"]).select("ws", "handle", "into", (F.col("done") + F.col("gap")).alias("done"))
        onward = back.select("ws", F.col("handle").alias("into"), "ancestor", F.col("depth").alias("more"))
        met = direct.unionByName(over).join(onward, ["ws", "into"])
        return met.select(*pair, (F.col("done") + F.col("more")).alias("depth"))

    ways = step
    while True:
        longer = cut_lineage(_shortest(ways.unionByName(joined(ways, ways))), "new_ways")
        better = longer.join(ways.withColumnRenamed("depth", "old"), pair, "left").where("old is null or depth < old")
        done = better.isEmpty()
        ways = longer
        if done:
            return ways


def _led(closure: DataFrame, ways: DataFrame) -> DataFrame:
    """Ways from a new edge's target, and from all that the closure has before it."""
    before = closure.select("ws", F.col("handle").alias("start"), F.col("ancestor").alias("handle"), F.col("depth").alias("lead"))
    led = ways.join(before, ["ws", "handle"]).select("ws", F.col("start").alias("handle"), "ancestor", (F.col("depth") + F.col("lead")).alias("depth"))
    return _shortest(ways.unionByName(led))


def _steps(new_edges: DataFrame) -> DataFrame:
    return new_edges.select("ws", F.col("target").alias("handle"), F.col("source").alias("ancestor")).distinct().withColumn("depth", F.lit(1))


def extend_closure(closure: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The rows of a stored closure that appended edges add or shorten.

    ``closure``: ``ws, handle, ancestor, depth`` as ``ancestry_closure`` gives without a depth
    limit; ``new_edges``: ``ws, target, source``. A new pair goes along one or more new edges, with
    stored stretches before, between and after them. So the new edges are brought together first
    (as many rounds as the logarithm of the most new edges on one way), and the stored closure is
    read only at their ends. Put the rows in the place of those of the same pair.
    """
    pair = ["ws", "handle", "ancestor"]
    led = _led(closure, _new_ways(closure, cut_lineage(_steps(new_edges), "new_edges")))
    after = closure.select("ws", F.col("handle").alias("ancestor"), F.col("ancestor").alias("end"), F.col("depth").alias("tail"))
    whole = led.unionByName(led.join(after, ["ws", "ancestor"]).select("ws", "handle", F.col("end").alias("ancestor"), (F.col("depth") + F.col("tail")).alias("depth")))
    known = closure.select(*pair, F.col("depth").alias("old"))
    return _shortest(whole).join(known, pair, "left").where("old is null or depth < old").select(*pair, F.col("depth").cast("int").alias("depth"))


def extended_closure(closure: DataFrame, new_edges: DataFrame) -> DataFrame:
    """A stored closure with appended edges, whole: what ``merge_closure`` makes of ``extend_closure``.

    For appends that change much of the closure; ``extend_closure`` is for few. A new pair is again
    put together from stored stretches and new edges, but only among handles that are somebody's
    source. The others take their ancestors from their sources' lists, by one join along their
    edges, which the closure holds at depth 1. No pair is compared with its stored one by a join.
    """
    held = closure.where("depth = 1").select("ws", "handle", "ancestor", F.lit(False).alias("new"))
    step = _steps(new_edges).select("ws", "handle", "ancestor", F.lit(True).alias("new"))
    layers, left = _layers(cut_lineage(held.unionByName(step), "edges"))
    inner = closure
    if layers:
        handles = left.select("ws", "handle").distinct()
        bits = bits_of(handles.select(F.struct("ws", "handle").alias("_at")), "_at")
        inner = cut_lineage(closure.where(among(F.struct("ws", "handle"), bits)).join(by_shuffle(handles), ["ws", "handle"], "left_semi"), "inner_closure")
    step = cut_lineage(left.where("new").select("ws", "handle", "ancestor", F.lit(1).alias("depth")), "new_edges")
    led = cut_lineage(_led(inner, _new_ways(inner, step)), "led")
    lists = cut_lineage(_listed(inner), "lists")
    found = _unpacked(_beyond(led, lists).unionByName(lists.withColumn("lead", F.lit(0))), led.count())
    return _with_layers(found, layers)


def merge_closure(closure: DataFrame, changed: DataFrame) -> DataFrame:
    """A stored closure with the rows of ``extend_closure`` in place."""
    pair = ["ws", "handle", "ancestor"]
    kept = closure.select(*pair, "depth").join(changed.select(*pair), pair, "left_anti")
    return kept.unionByName(changed.select(*pair, "depth"))


def provenance_view(edges: DataFrame, events: DataFrame, handles: DataFrame) -> DataFrame:
    """Ancestors and events of handles as rows ``ws, handle, part, ancestor, depth,
    event_type, created_at, id``; part is ``ancestor`` or ``event``."""
    up = ancestry(edges, handles).select(
        "ws", "handle", F.lit("ancestor").alias("part"), "ancestor", "depth",
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("long").alias("id"),
    )
    log = events.join(handles, ["ws", "handle"], "left_semi").select(
        "ws", "handle", F.lit("event").alias("part"), F.lit(None).cast("string").alias("ancestor"),
        F.lit(None).cast("int").alias("depth"), "event_type", "created_at", "id",
    )
    return up.unionByName(log)


# -- edges and events ------------------------------------------------------------------


def spec_has_url(spec: Column) -> Column:
    """True when a top-level value, or a text in a top-level list, is a short-lived URL.

    Keys for lasting URLs are exempt; nested objects are not searched.
    """
    entries = F.map_entries(F.from_json(spec, "map<string,variant>"))

    def is_url(text: Column) -> Column:
        low = F.lower(text)
        hit = F.lit(False)
        for p in URL_PREFIXES:
            hit = hit | F.startswith(low, F.lit(p))
        return F.coalesce(hit, F.lit(False))

    def text_of(v: Column) -> Column:
        # Only JSON texts count: numbers and objects would be turned into text by the cast.
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def bad(entry: Column) -> Column:
        value = entry["value"]
        items = F.coalesce(
            F.try_variant_get(value, "$", "array<variant>"), F.array(value)
        )
        return ~entry["key"].isin(*LASTING_URL_KEYS) & F.exists(items, lambda v: is_url(text_of(v)))

    return F.coalesce(F.exists(entries, bad), F.lit(False))


def split_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges → ``(good, rejected)`` by :func:`spec_has_url` on ``spec``."""
    flagged = edges.withColumn("_bad", spec_has_url(F.col("spec")))
    return flagged.where(~F.col("_bad")).drop("_bad"), flagged.where("_bad").drop("_bad")


def derived_edges(results: DataFrame) -> DataFrame:
    """One edge per source of every derived result, with ``accepted`` by :func:`spec_has_url`.

    ``results``: ``ws, target, sources ARRAY<STRING>, operation, parameters MAP<STRING, STRING>,
    output_format, created_at``. The spec is flat: operation and parameters, then workspace,
    result, format and content key, which no parameter can replace; never a path.
    """
    fixed = ("operation", "workspace_id", "cube_handle", "output_format", "cache_key")
    own = F.map_filter(
        F.coalesce("parameters", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*fixed)
    )
    entry = lambda name, value: F.create_map(F.lit(name), value)
    key = transform_key(F.col("operation"), F.col("sources"), F.col("parameters"))
    spec = F.to_json(
        F.map_concat(
            entry("operation", F.col("operation")), F.map_from_entries(F.array_sort(F.map_entries(own))),
            entry("workspace_id", F.col("ws")), entry("cube_handle", F.col("target")),
            entry("output_format", F.col("output_format")), entry("cache_key", key),
        ),
        {"ignoreNullFields": "false"},
    )
    edges = results.withColumn("spec", spec)
    return edges.select(
        "ws", "target", F.explode("sources").alias("source"), "spec", "created_at",
        (~spec_has_url(F.col("spec"))).alias("accepted"),
    )


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events → ``(good, rejected)`` by their type; missing details become ``{}``."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    filled = events.withColumn("detail", F.coalesce("detail", F.lit("{}")))
    return filled.where(known), filled.where(~known)


def latest_specs(edges: DataFrame, handles: DataFrame) -> DataFrame:
    """Newest known spec per handle; status ``none`` when no edge of it has one."""
    has = F.col("spec").isNotNull()
    newest = edges.groupBy("ws", F.col("target").alias("handle")).agg(
        F.max_by(F.when(has, F.col("spec")), F.when(has, F.struct("created_at", "id"))).alias("spec")
    )
    return handles.join(newest, ["ws", "handle"], "left").select(
        "ws", "handle", "spec",
        F.when(F.col("spec").isNull(), "none").otherwise("ok").alias("status"),
    )


def event_timeline(events: DataFrame, ws: str, handle: str | None = None) -> DataFrame:
    """Events of a workspace, newest first per handle (``created_at``, then ``id``)."""
    out = events.where(F.col("ws") == ws)
    if handle is not None:
        out = out.where(F.col("handle") == handle)
    return out.orderBy("handle", F.col("created_at").desc(), F.col("id").desc())


# -- keys and specs ----------------------------------------------------------------------


def retrieval_key(
    short_name: Column, output_format: Column, bbox: Column, time_range: Column,
    variables: Column, service_name: Column, service_version: Column,
) -> Column:
    """Content key of a retrieval: 24 hex digits of a SHA-256 over its parts, order-free in
    the variables. ``bbox`` is a ``w,s,e,n`` struct or null; missing parts are empty."""
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    box = F.when(
        bbox.isNotNull(),
        F.concat_ws(",", *[plain_number(bbox[x]) for x in ("w", "s", "e", "n")]),
    )
    joined = F.concat_ws(
        ":", text(short_name), text(output_format), text(box), text(time_range),
        text(F.array_join(F.array_sort(variables), ",")), text(service_name), text(service_version),
    )
    return F.substring(F.sha2(joined, 256), 1, 24)


def transform_key(operation: Column, sources: Column, parameters: Column) -> Column:
    """Content key of a transform: operation, ordered sources, and parameters as sorted pairs.

    Keys and values stand apart and a null value is written as one, so no two different
    requests share a text.
    """
    canonical = F.to_json(
        F.struct(
            operation.alias("operation"),
            F.array_sort(F.map_entries(parameters)).alias("parameters"),
            sources.alias("sources"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.substring(F.sha2(canonical, 256), 1, 24)


AXIS_DDL = "STRUCT<name: STRING, origin: DOUBLE, step: DOUBLE, length: BIGINT>"

#: Columns of a request spec and their JSON types, in the order they are written.
SPEC_FIELDS = {
    "concept_id": "STRING", "short_name": "STRING", "output_format": "STRING",
    "output_shape": "STRING", "needs_bbox": "BOOLEAN", "needs_variable": "BOOLEAN",
    "needs_temporal": "BOOLEAN", "needs_point_sample": "BOOLEAN", "aoi_bbox": "ARRAY<DOUBLE>",
    "time_range": "STRING", "variables": "ARRAY<STRING>", "provider": "STRING",
    "service_name": "STRING", "opendap_urls": "ARRAY<STRING>", "opendap_url": "STRING",
    "coord_lat": "STRING", "coord_lon": "STRING", "coord_time": "STRING",
    "lat_axis": AXIS_DDL, "lon_axis": AXIS_DDL, "var_dims": "STRING",
    "workspace_id": "STRING", "job_handle": "STRING", "obs_handle": "STRING",
    "cache_key": "STRING",
}
# Fixed value: output format of specs written before the field existed.
DEFAULT_SPEC_FORMAT = "application/netcdf4"


def read_specs(specs: DataFrame, raw: str = "spec") -> DataFrame:
    """Spec JSON → columns, bringing old forms up to date.

    Missing flags are false, a lone URL becomes a list, the default format and provider fill
    in, missing lists are empty.
    """
    ddl = ", ".join(f"{k} {v}" for k, v in SPEC_FIELDS.items())
    d = specs.select(*[c for c in specs.columns if c != raw], F.from_json(F.col(raw), ddl).alias("d"))
    col = lambda n: F.col(f"d.{n}")
    empty = F.array().cast("array<string>")
    urls = F.when(F.size(col("opendap_urls")) > 0, col("opendap_urls")).when(
        F.coalesce(col("opendap_url"), F.lit("")) != "", F.array(col("opendap_url"))
    )
    special = {
        "output_format": F.coalesce(F.nullif(col("output_format"), F.lit("")), F.lit(DEFAULT_SPEC_FORMAT)),
        "provider": F.coalesce(F.nullif(col("provider"), F.lit("")), F.lit("harmony")),
        "aoi_bbox": F.when(F.size(col("aoi_bbox")) > 0, col("aoi_bbox")),
        "variables": F.coalesce(col("variables"), empty),
        "opendap_urls": F.coalesce(urls, empty),
        "var_dims": F.coalesce(col("var_dims"), F.lit("{}")),
        "cache_key": F.coalesce(col("cache_key"), F.lit("")),
        **{n: F.coalesce(col(n), F.lit(False)) for n in SPEC_FIELDS if n.startswith("needs_")},
    }
    return d.select(
        *[c for c in specs.columns if c != raw],
        *[special.get(n, col(n)).alias(n) for n in SPEC_FIELDS if n != "opendap_url"],
    )


def write_specs(table: DataFrame, name: str = "spec") -> DataFrame:
    """Columns → spec JSON with all its keys, nulls kept; the first URL is repeated alone."""
    urls = F.when(F.size("opendap_urls") > 0, F.col("opendap_urls"))
    special = {
        "opendap_urls": urls,
        "opendap_url": F.try_element_at(urls, F.lit(1)),
        "var_dims": F.parse_json("var_dims"),
    }
    fields = [special.get(n, F.col(n) if n not in special else None).alias(n) for n in SPEC_FIELDS]
    kept = [c for c in table.columns if c not in SPEC_FIELDS]
    return table.select(
        *kept, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name)
    )


# -- handles -----------------------------------------------------------------------------


def resolve_handles(lookups: DataFrame, handles: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Bulk handle lookup inside a workspace.

    ``lookups``: ``ws, handle``; ``handles``: ``handle, owner, payload`` (JSON). Status in
    order: ``not_a_handle``, ``wrong_kind``, ``not_found``, ``other_workspace``,
    ``not_ready`` (a result without status ready, key and media type), ``ok``.
    """
    found = lookups.withColumn("kind", handle_kind(F.col("handle"))).join(handles, "handle", "left")
    part = lambda name: F.get_json_object("payload", f"$.{name}")
    ready = (
        (F.coalesce(part("status"), F.lit("")) == "ready")
        & (F.coalesce(part("storage_key"), F.lit("")) != "")
        & (F.coalesce(part("media_type"), F.lit("")) != "")
    )
    status = F.when(F.col("kind").isNull(), "not_a_handle")
    if kinds is not None:
        status = status.when(~F.col("kind").isin(*kinds), "wrong_kind")
    status = (
        status.when(F.col("owner").isNull(), "not_found")
        .when(F.col("owner") != F.col("ws"), "other_workspace")
        .when(F.col("kind").isin("obs", "cube") & ~ready, "not_ready")
        .otherwise("ok")
    )
    visible = F.col("status").isin("ok", "not_ready")
    return found.withColumn("status", status).select(
        "ws", "handle", "kind", "status", F.when(visible, F.col("payload")).alias("payload")
    )


def list_handles(handles: DataFrame, ws: str, kind: str | None = None) -> DataFrame:
    """Handles of a workspace, oldest first, optionally of one kind."""
    out = handles.where(F.col("owner") == ws)
    if kind is not None:
        out = out.where(handle_kind(F.col("handle")) == kind)
    return out.orderBy("created_at", "handle")


def merge_payloads(updates: DataFrame) -> DataFrame:
    """Payload updates folded per handle, later keys overwriting earlier ones.

    ``updates``: ``handle, seq, payload MAP<STRING, STRING>``. Keys are merged as rows, so
    the running best per key is all a task holds, however often a handle was updated.
    """
    per_key = (
        updates.select("handle", "seq", F.explode("payload").alias("key", "value"))
        .groupBy("handle", "key")
        # The struct keeps a null value: max_by alone would skip to an older one.
        .agg(F.max(F.struct("seq", "value"))["value"].alias("value"))
    )
    return per_key.groupBy("handle").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("payload")
    )
