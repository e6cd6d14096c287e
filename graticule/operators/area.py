"""Locations in bulk: region and watershed lookups, name matching, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions import location as loc
from graticule.session import among, bits_of, cut_lineage, spread_out

#: Lengths of the pieces that names are found by; a part is cut into the longest that fits.
_GRAMS = (3, 5, 8)


def union_boxes(boxes: DataFrame, group: str) -> DataFrame:
    """Smallest box around all boxes of a group."""
    return boxes.groupBy(group).agg(
        F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n")
    )


def lookup_regions(locations: DataFrame, region_keys: DataFrame) -> DataFrame:
    """Rows whose trimmed lower-case ``text`` names a region, with its box.

    The key table is this library's fixed list, so broadcasting it is safe.
    """
    keyed = locations.withColumn("region_key", F.lower(F.trim("text")))
    return keyed.join(F.broadcast(region_keys), "region_key").drop("region_key")


def lookup_watershed_codes(locations: DataFrame, watersheds: DataFrame) -> DataFrame:
    """Code texts joined to the boundary table; status ``ok``, ``not_found`` or ``not_a_code``."""
    coded = locations.withColumn("code", loc.watershed_code(F.col("text")))
    found = coded.join(watersheds.select("code", "level", "name", "w", "s", "e", "n"), "code", "left")
    return found.select(
        "id", "text", "code",
        (F.length("code") / 2).cast("long").alias("level"),
        "name", "w", "s", "e", "n",
        F.when(F.col("code").isNull(), "not_a_code")
        .when(F.col("name").isNull(), "not_found")
        .otherwise("ok").alias("status"),
    )


# -- substring joins -------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one length."""
    count = F.length(text) - size + 1
    return F.array_distinct(
        F.transform(
            F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(text, i, F.lit(size)),
        )
    )


def contains_join(queries: DataFrame, names: DataFrame, parts: str, text: str) -> DataFrame:
    """Pairs where the lower-case ``text`` of a name contains every string in ``parts``.

    A plain ``contains`` join compares every query with every name. Here each query is
    routed by one piece of its parts (three, five or eight letters as they fit, or a whole shorter
    part), the one found in the fewest names, so a query meets only names that hold its rarest
    piece; the exact test follows. Nothing is lost, because a name that contains the parts contains
    every piece of them. Queries with nothing to look for match nothing.

    Pieces of names are tested against the bits of the asked ones before anything else, so those
    that nobody asks for are neither counted nor shuffled.
    """
    q = queries.withColumn("_parts", F.filter(F.col(parts), lambda p: F.length(p) > 0)).where(
        F.size("_parts") > 0
    )
    keyed = q.withColumn("_key", F.sha2(F.array_join("_parts", "\u0001"), 256))

    def cut(p: Column) -> Column:
        pieces = F.array(p)
        for size in _GRAMS:
            pieces = F.when(F.length(p) >= size, _grams(p, size)).otherwise(pieces)
        return pieces

    pieces = F.array_distinct(F.flatten(F.transform(F.col("_parts"), cut)))
    wanted = keyed.select("_key", "_parts").dropDuplicates(["_key"])
    asked = cut_lineage(wanted.select("_key", "_parts", F.explode(pieces).alias("_gram")), "asked")
    sizes = asked.agg(F.collect_set(F.length("_gram"))).scalar()  # at most one to eight
    # Files of names are small and their pieces many, so the names are dealt out first.
    spread = spread_out(names.withColumn("_text", F.lower(F.col(text))))

    def indexed(wanted_pieces: DataFrame) -> DataFrame:
        """Names under each of their pieces whose bit is set, once for each distinct piece."""
        sized = spread.withColumn("_size", F.explode(sizes)).where("_size <= length(_text)")
        cut = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_size") + 1)))
        grams = cut.withColumn("_gram", F.substring("_text", F.col("_at"), F.col("_size")))
        held = grams.where(among(F.col("_gram"), bits_of(wanted_pieces, "_gram")))
        return held.where(F.position(F.col("_gram"), F.col("_text")) == F.col("_at")).drop("_size", "_at")

    frequency = indexed(asked).groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = cut_lineage(
        asked.join(frequency, "_gram", "left")
        .groupBy("_key")
        .agg(
            F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"),
            F.any_value("_parts").alias("_parts"),
            F.min(F.coalesce("_n", F.lit(0))).alias("_n"),
        )
        .where("_n > 0").drop("_n"),  # a piece that no name has
        "rarest",
    )
    hits = (
        indexed(rarest).join(rarest, "_gram")
        .where(F.forall("_parts", lambda p: F.contains(F.col("_text"), p)))
        .select("_key", *[F.col(c).alias(f"match_{c}") for c in names.columns])
    )
    return keyed.join(hits, "_key").drop("_key", "_parts")


def _coarsest(matches: DataFrame) -> DataFrame:
    """Per query the coarsest level with a match, its match count and lowest-code match."""
    per_level = matches.groupBy("text", "match_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(
            F.struct(
                F.col("match_code").alias("code"), F.col("match_name").alias("name"),
                *[F.col(f"match_{x}").alias(x) for x in ("w", "s", "e", "n")],
            ),
            "match_code",
        ).alias("hit"),
    )
    return per_level.groupBy("text").agg(
        F.min("match_level").alias("level"),
        F.min_by("n", "match_level").alias("n"),
        F.min_by("hit", "match_level").alias("hit"),
    )


def name_tokens(text: Column) -> Column:
    """Words of a name without the words every watershed name has."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: F.length(t) > 0)
    return F.filter(words, lambda t: ~t.isin(*loc.WATERSHED_STOPWORDS))


def _phase_matches(names: DataFrame, watersheds: DataFrame, parts: Column) -> DataFrame:
    return contains_join(
        names.select("text", parts.alias("_parts_in")), watersheds, "_parts_in", "name"
    ).drop("_parts_in")


def match_watershed_names(locations: DataFrame, watersheds: DataFrame) -> DataFrame:
    """Free names → watershed, coarsest level first. Output one row per distinct ``text``.

    First the whole text as a substring: at the first level with any match it must be the
    only one. Otherwise all words that are not stopwords: one match at the first level with
    any is accepted, more make the name ``ambiguous`` (see :func:`ambiguous_candidates`),
    none makes it ``none``.
    """
    names = locations.select("text").distinct()
    # One row per name is written, not the pairs behind it; the second phase needs it again.
    whole = cut_lineage(_coarsest(_phase_matches(names, watersheds, F.array(F.lower("text")))), "whole")
    single = whole.where(F.col("n") == 1).select(
        "text", F.col("level").alias("wl"), F.col("hit").alias("wh")
    )
    rest = names.join(single, "text", "left_anti")
    words = _coarsest(_phase_matches(rest, watersheds, name_tokens(F.col("text")))).select(
        "text", F.col("level").alias("tl"), F.col("n").alias("tn"), F.col("hit").alias("th")
    )
    joined = names.join(single, "text", "left").join(words, "text", "left")
    hit = F.coalesce("wh", F.when(F.col("tn") == 1, F.col("th")))
    return joined.select(
        "text",
        F.when(F.col("wh").isNotNull() | (F.col("tn") == 1), "ok")
        .when(F.col("tn") > 1, "ambiguous").otherwise("none").alias("status"),
        F.coalesce("wl", "tl").cast("long").alias("level"),
        F.coalesce("tn", F.when(F.col("wh").isNotNull(), 1)).cast("long").alias("n_matches"),
        hit["code"].alias("code"), hit["name"].alias("name"),
        hit["w"].alias("w"), hit["s"].alias("s"), hit["e"].alias("e"), hit["n"].alias("n"),
        F.when(F.col("tn") > 1, F.col("th")["code"]).alias("suggested_code"),
    )


def ambiguous_candidates(locations: DataFrame, watersheds: DataFrame) -> DataFrame:
    """The candidates of every ambiguous name, one row each: ``text, level, candidate``."""
    found = match_watershed_names(locations, watersheds).where(F.col("status") == "ambiguous")
    verdict = cut_lineage(found.select("text", "level"), "ambiguous")
    hits = _phase_matches(verdict.select("text"), watersheds, name_tokens(F.col("text")))
    return hits.join(
        verdict.select("text", F.col("level").alias("match_level")), ["text", "match_level"]
    ).select(
        "text", F.col("match_level").cast("long").alias("level"),
        F.concat("match_name", F.lit(" ("), "match_code", F.lit(")")).alias("candidate"),
    )


def free_names(locations: DataFrame, region_keys: DataFrame) -> DataFrame:
    """The rows whose ``text`` is a name: no shape, box, point, code or region."""
    keys = F.broadcast(region_keys.select(F.col("region_key").alias("_key"), F.lit(True).alias("_is_region")))
    keyed = locations.join(keys, F.lower(F.trim("text")) == F.col("_key"), "left")
    kind = loc.classify_location(F.col("text"), F.coalesce("_is_region", F.lit(False)))
    return keyed.where(kind == "name").drop("_key", "_is_region")


# -- the whole location job --------------------------------------------------------


def resolve_locations(locations: DataFrame, region_keys: DataFrame, watersheds: DataFrame) -> DataFrame:
    """``id, text`` → ``id, text, source, status, w, s, e, n, geojson``.

    Sources in order of trial: ``geojson``, ``bbox``, ``point``, ``watershed`` (by code or
    name), ``region``. Status is ``ok``, a parse error of the box, ``no_coordinates``,
    ``not_found`` (a code), ``ambiguous``, or ``unresolved`` for a name nothing knows. The
    geometry is the text itself for ``geojson``, a point for ``point``, that of the watershed
    if ``watersheds`` has a ``geojson`` column, and null where only a box is known.

    One pass over the locations with equi-joins; only distinct free names go through the
    substring match.
    """
    keyed = locations.withColumn("region_key", F.lower(F.trim("text"))).join(
        F.broadcast(
            region_keys.select("region_key", F.struct("w", "s", "e", "n").alias("_region"))
        ),
        "region_key", "left",
    )
    text = F.col("text")
    kind = loc.classify_location(text, F.col("_region").isNotNull())
    typed = keyed.withColumn("_kind", kind).withColumn(
        "_code", F.when(F.col("_kind") == "watershed_code", loc.watershed_code(text))
    )
    shape = F.col("geojson") if "geojson" in watersheds.columns else F.lit(None).cast("string")
    by_code = watersheds.select(
        F.col("code").alias("_code"), shape.alias("_shape"),
        F.struct(*[F.col(x).cast("double").alias(x) for x in ("w", "s", "e", "n")]).alias("_by_code"),
    )
    free = typed.where(F.col("_kind") == "name").select("text")
    by_name = match_watershed_names(free, watersheds).select(
        "text", F.col("status").alias("_name_status"), F.col("code").alias("_name_code"),
        F.when(
            F.col("status") == "ok",
            F.struct(*[F.col(x).cast("double").alias(x) for x in ("w", "s", "e", "n")]),
        ).alias("_by_name"),
    )
    # A name found by its words is a code as well, so both kinds meet the watersheds once.
    named = typed.join(by_name, "text", "left").withColumn("_code", F.coalesce("_code", "_name_code"))
    joined = named.join(by_code, "_code", "left")
    parsed = joined.withColumn("_bbox", F.when(F.col("_kind") == "bbox", loc.parse_bbox(text)))
    found = (
        F.when(F.col("_kind") == "geojson", loc.bbox_from_geojson(text))
        .when(F.col("_kind") == "bbox", F.col("_bbox.bbox"))
        .when(F.col("_kind") == "point", loc.parse_point(text))
        .when(F.col("_kind") == "watershed_code", F.col("_by_code"))
        .when(F.col("_kind") == "region", F.col("_region"))
        .when(F.col("_kind") == "name", F.col("_by_name"))
    )
    done = parsed.withColumn("_box", found)
    status = (
        F.when(F.col("_box").isNotNull(), "ok")
        .when(F.col("_kind") == "geojson", "no_coordinates")
        .when(F.col("_kind") == "bbox", F.col("_bbox.status"))
        .when(F.col("_kind") == "watershed_code", "not_found")
        .when(F.col("_name_status") == "ambiguous", "ambiguous")
        .otherwise("unresolved")
    )
    return done.select(
        "id", "text",
        F.when(F.col("_kind").isin("watershed_code", "name"), "watershed")
        .otherwise(F.col("_kind")).alias("source"),
        status.alias("status"), "_box.w", "_box.s", "_box.e", "_box.n",
        F.when(F.col("_box").isNull(), F.lit(None).cast("string"))
        .when(F.col("_kind") == "geojson", text)
        .when(F.col("_kind") == "point", loc.point_geojson(F.col("_box.w"), F.col("_box.s")))
        .otherwise(F.col("_shape")).alias("geojson"),
    )
