"""Small fixed tables: regions, keyword synonyms, curated notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Named regions, boxes as west, south, east, north, with their aliases.
REGIONS = [
    ("africa", -17.7, -34.9, 51.3, 37.4, ["african continent"]),
    ("europe", -24.5, 27.6, 69.1, 81.9, ["european continent"]),
    ("asia", 26.0, -11.2, 169.7, 77.7, ["asian continent"]),
    ("north america", -168.1, 7.2, -52.6, 83.6, ["northern america"]),
    ("south america", -81.3, -55.9, -34.8, 13.4, ["southern america"]),
    ("oceania", 112.9, -47.7, 180.0, 28.5, ["australia and oceania", "australasia"]),
    ("antarctica", -180.0, -90.0, 180.0, -60.0, ["antarctic"]),
    ("middle east", 26.0, 12.5, 63.3, 42.4, ["mena", "near east", "middle-east"]),
    ("southeast asia", 92.2, -11.2, 141.1, 28.5, ["se asia", "southeastern asia", "south-east asia"]),
    ("south asia", 60.9, 4.0, 97.4, 37.1, ["indian subcontinent", "southern asia", "south-asia"]),
    ("east asia", 73.5, 18.2, 145.5, 53.6, ["eastern asia", "east-asia", "far east"]),
    ("central asia", 46.5, 35.1, 87.3, 55.4, ["central-asia"]),
    ("scandinavia", 4.5, 54.6, 31.1, 71.2, ["scandinavian countries", "scandinavian peninsula"]),
    ("nordic countries", -24.5, 54.6, 31.1, 71.5, ["nordic", "nordic nations"]),
    ("sub-saharan africa", -17.7, -34.9, 51.3, 15.0,
     ["subsaharan africa", "sub saharan africa", "africa south of sahara"]),
    ("central america", -92.3, 7.2, -77.1, 18.5, ["mesoamerica", "central-america"]),
    ("caribbean", -84.9, 10.0, -59.5, 26.9, ["caribbean islands", "west indies"]),
]

# Everyday words → catalog keywords.
SYNONYMS = [
    ("rain", ["PRECIPITATION AMOUNT", "PRECIPITATION RATE"]),
    ("vegetation", ["VEGETATION INDEX", "VEGETATION COVER"]),
    ("temperature", ["SURFACE TEMPERATURE", "AIR TEMPERATURE"]),
]


def region_entries(spark: SparkSession) -> DataFrame:
    """The region table as written: ``key, w, s, e, n, aliases``."""
    return spark.createDataFrame(
        REGIONS, "key STRING, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, aliases ARRAY<STRING>"
    )


def region_keys(entries: DataFrame) -> DataFrame:
    """One row per lower-case key or alias. Keys starting with ``_`` are comments."""
    return entries.where(~F.startswith("key", F.lit("_"))).select(
        F.explode(
            F.array_distinct(
                F.array_union(F.array("key"), F.transform("aliases", lambda a: F.lower(a)))
            )
        ).alias("region_key"),
        "w", "s", "e", "n",
    )


def synonym_keys(spark: SparkSession) -> DataFrame:
    """``synonym_key`` (lower-case) → ``keywords``, in preference order."""
    rows = spark.createDataFrame(SYNONYMS, "term STRING, keywords ARRAY<STRING>")
    return rows.select(F.lower("term").alias("synonym_key"), "keywords")
