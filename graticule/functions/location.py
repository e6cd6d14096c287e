"""Location text → boxes. Boxes are ``struct<w, s, e, n: double>``, W > E allowed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Watershed code lengths, words ignored in watershed names.
WATERSHED_CODE_LENGTHS = (2, 4, 6, 8, 10, 12)
WATERSHED_STOPWORDS = ("river", "basin", "watershed", "region")

_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"
_PAIR = (
    r"\[\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*,\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"\s*(?:,[^\[\]]*)?\]"
)

# The coordinates member of any geometry in a JSON text, however deep. In a quoted string its
# quotes would be escaped, so it never matches there.
_COORDINATES = r'"coordinates"\s*:\s*(\[[\[\]\s\d.,eE+-]*\])'


def to_number(text: Column) -> Column:
    """Text → double, or null. Suffixed forms such as ``1d`` are not numbers."""
    tidy = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.rlike(tidy, F.lit(_NUMBER)), F.replace(tidy, F.lit("_"), F.lit("")).try_cast("double")) \
        .when(F.rlike(tidy, F.lit(_SPECIAL)), F.lit(float("nan")))


def box(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))


def comma_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _inside(value: Column, limit: float) -> Column:
    # NaN compares as larger than any number, so it is outside.
    return (value >= -limit) & (value <= limit)


def parse_bbox(text: Column) -> Column:
    """``W,S,E,N`` text → ``struct<status, bbox>``.

    Status is ``ok``, ``bad_count``, ``non_numeric``, ``longitude_range``,
    ``latitude_range`` or ``south_above_north``; the box is null unless ``ok``.
    """
    parts = F.transform(F.split(text, ","), to_number)
    w, s, e, n = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3, 4))
    status = (
        F.when(comma_count(text) != 3, "bad_count")
        .when(w.isNull() | s.isNull() | e.isNull() | n.isNull(), "non_numeric")
        .when(~(_inside(w, 180.0) & _inside(e, 180.0)), "longitude_range")
        .when(~(_inside(s, 90.0) & _inside(n, 90.0)), "latitude_range")
        .when(s > n, "south_above_north")
        .otherwise("ok")
    )
    return F.struct(status.alias("status"), F.when(status == "ok", box(w, s, e, n)).alias("bbox"))


def parse_point(text: Column) -> Column:
    """``lon,lat`` text → zero-area box, or null when it is not two in-range numbers."""
    parts = F.transform(F.split(text, ","), to_number)
    lon, lat = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    good = (comma_count(text) == 1) & _inside(lon, 180.0) & _inside(lat, 90.0)
    return F.when(good, box(lon, lat, lon, lat))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.to_json(
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    )


def watershed_code(text: Column) -> Column:
    """Digits of a watershed code, bare or behind a ``HUC`` prefix; zeros kept.

    Null when the text is no code or its length is not a watershed level.
    """
    prefixed = F.regexp_extract(F.trim(text), r"(?i)^huc[-]?\d*\s+(\d+)$", 1)
    digits = F.when(prefixed != "", prefixed).when(F.rlike(text, F.lit(r"^\d+$")), text)
    return F.when(F.length(digits).isin(*WATERSHED_CODE_LENGTHS), digits)


def strip_watershed_prefix(text: Column) -> Column:
    """Digits behind a ``HUC`` prefix, or null when there is no such prefix."""
    return F.nullif(
        F.regexp_extract(F.trim(text), r"(?i)^huc[-]?\d*\s+(\d+)$", 1), F.lit("")
    )


# -- GeoJSON -----------------------------------------------------------------


_GEOJSON_DDL = (
    "type STRING, coordinates STRING, geometry STRING, geometries STRING, "
    "features ARRAY<STRUCT<type: STRING, geometry: STRING, coordinates: STRING>>"
)


def _coordinate_texts(geometry: Column) -> Column:
    """Coordinate texts of a geometry's JSON, nested collections included."""
    return F.regexp_extract_all(F.coalesce(geometry, F.lit("")), F.lit(_COORDINATES), F.lit(1))


def bbox_from_geojson(text: Column) -> Column:
    """GeoJSON text → box around all its coordinate pairs, or null when it has none.

    Reads only geometry members, so a ``bbox`` member or number pairs in ``properties``
    never count. Collections may nest to any depth. Altitudes are dropped.
    """
    doc = F.from_json(text, _GEOJSON_DDL)
    texts = (
        F.when(doc["type"] == "Feature", _coordinate_texts(doc["geometry"]))
        .when(
            doc["type"] == "FeatureCollection",
            F.flatten(
                F.transform(
                    F.coalesce(doc["features"], F.array()),
                    lambda f: F.when(f["type"] == "Feature", _coordinate_texts(f["geometry"]))
                    .otherwise(F.array(f["coordinates"])),
                )
            ),
        )
        .when(doc["type"] == "GeometryCollection", _coordinate_texts(doc["geometries"]))
        .otherwise(F.array(doc["coordinates"]))
    )
    # A Point's coordinates are one bare pair, which the pattern matches as well.
    joined = F.array_join(F.array_compact(texts), " ")
    lons = F.transform(F.regexp_extract_all(joined, F.lit(_PAIR), F.lit(1)), lambda x: x.cast("double"))
    lats = F.transform(F.regexp_extract_all(joined, F.lit(_PAIR), F.lit(2)), lambda x: x.cast("double"))
    return F.when(
        F.size(lons) > 0,
        box(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)),
    )


def is_json_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()


def classify_location(text: Column, region_hit: Column) -> Column:
    """Which reading a location text gets, in strict order.

    ``geojson``, ``bbox`` (three commas, never a name), ``point``, ``watershed_code``,
    ``region`` (when ``region_hit``), else ``name``.
    """
    rules = [
        (is_json_object(text), "geojson"),
        (comma_count(text) == 3, "bbox"),
        (parse_point(text).isNotNull(), "point"),
        (watershed_code(text).isNotNull(), "watershed_code"),
        (region_hit, "region"),
    ]
    first = F.when(rules[0][0], rules[0][1])
    return reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rules[1:], first).otherwise("name")
