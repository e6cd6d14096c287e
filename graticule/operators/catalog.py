"""Catalog search, associations, curated notes, keywords, imagery layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.area import contains_join
from graticule.operators.coverage import DEFAULT_LIMIT

#: Search filters that are honoured; others are dropped.
ALLOWED_FILTERS = (
    "concept_id", "short_name", "provider", "temporal", "bounding_box",
    "processing_level_id", "has_granules", "limit",
)

# The mark every curated note carries.
ADVISORY_FLAG = "advisory/non-authoritative"

NOTE_DDL = (
    "ARRAY<STRUCT<note: STRING, owner: STRING, last_reviewed: STRING, "
    "authoritative: BOOLEAN, advisory: STRING>>"
)


def search_collections(collections: DataFrame, keyword: str | None = None, filters: dict | None = None) -> DataFrame:
    """Collections that match every word of ``keyword`` and all filters.

    ``collections``: ``concept_id, short_name, provider_id, entry_title, abstract,
    processing_level, time_start, time_end, w, s, e, n, has_granules``. Default 10 rows by
    ``concept_id``; a ``limit`` of None gives all.
    """
    f = {k: v for k, v in (filters or {}).items() if k in ALLOWED_FILTERS and v is not None}
    out = collections
    if keyword and keyword.split():
        text = F.lower(F.concat_ws(" ", "short_name", "entry_title", "abstract"))
        words = F.array(*[F.lit(w) for w in keyword.lower().split()])
        out = out.where(F.forall(words, lambda w: F.contains(text, w)))
    for name, column in (("concept_id", "concept_id"), ("short_name", "short_name"), ("provider", "provider_id")):
        if name in f:
            out = out.where(F.col(column) == f[name])
    if "processing_level_id" in f:
        out = out.where(F.col("processing_level").isin(*f["processing_level_id"]))
    if "has_granules" in f:
        out = out.where(F.col("has_granules") == bool(f["has_granules"]))
    if "temporal" in f:
        start, end = (F.lit(str(t)).cast("timestamp_ntz") for t in f["temporal"])
        out = out.where((F.col("time_start") <= end) & (F.col("time_end") >= start))
    if "bounding_box" in f:
        w, s, e, n = f["bounding_box"]
        lon = F.lit(False)
        for a, b in ([(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]):
            straight = (F.col("w") <= b) & (F.col("e") >= a)
            lon = lon | F.when(F.col("w") <= F.col("e"), straight).otherwise(
                (F.col("w") <= b) | (F.col("e") >= a)
            )
        out = out.where(lon & (F.col("s") <= n) & (F.col("n") >= s))
    out = out.orderBy("concept_id")
    limit = (filters or {}).get("limit", DEFAULT_LIMIT)
    return out if limit is None else out.limit(int(limit))


def search_summary(collections: DataFrame) -> DataFrame:
    """The compact view of a found collection."""
    return collections.select(
        "concept_id", "short_name", "version", "entry_title", "processing_level", "advisory_notes"
    )


def associated_records(collections: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """Records associated with each collection: ``collection_id``, list position, record.

    ``kind`` is ``variables`` or ``services``. A collection without ids gives no rows; ids
    without a record give none either.

    The outer explode keeps Spark from testing the id list in a pushed-down filter, which
    would parse each record's JSON a second time; the join drops the empty rows.
    """
    ids = collections.select(
        F.col("concept_id").alias("collection_id"),
        F.posexplode_outer(F.col(f"associations.{kind}")).alias("pos", "concept_id"),
    )
    return ids.join(records, "concept_id")


# -- curated notes -----------------------------------------------------------------


def collection_notes(curated: DataFrame) -> DataFrame:
    """Curated products → ``short_name, advisory_notes``.

    Input ``short_name, notes ARRAY<STRING>, owner, last_reviewed``.
    """
    return curated.select(
        "short_name",
        F.transform(
            "notes",
            lambda n: F.struct(
                n.alias("note"), F.col("owner").alias("owner"),
                F.col("last_reviewed").alias("last_reviewed"),
                F.lit(False).alias("authoritative"), F.lit(ADVISORY_FLAG).alias("advisory"),
            ),
        ).cast(NOTE_DDL).alias("advisory_notes"),
    )


def variable_notes(curated: DataFrame) -> DataFrame:
    """Curated variables → ``short_name, name, advisory_notes``; an empty note is no note."""
    note = F.struct(
        F.col("note").alias("note"), F.col("owner").alias("owner"),
        F.col("last_reviewed").alias("last_reviewed"),
        F.lit(False).alias("authoritative"), F.lit(ADVISORY_FLAG).alias("advisory"),
    )
    return curated.where(F.coalesce("note", F.lit("")) != "").select(
        "short_name", "name", F.array(note).cast(NOTE_DDL).alias("advisory_notes")
    )


def attach_notes(records: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of notes; records without one get an empty list.

    Notes only ever add the ``advisory_notes`` column, so no fact can change.
    """
    facts = [c for c in records.columns if c != "advisory_notes"]
    return records.select(*facts).join(notes.select(*keys, "advisory_notes"), keys, "left").select(
        *facts, F.coalesce("advisory_notes", F.array().cast(NOTE_DDL)).alias("advisory_notes")
    )


def describe_datasets(collections: DataFrame, variables: DataFrame, notes: DataFrame, curated_vars: DataFrame) -> DataFrame:
    """Collections with their variables and notes, one row per variable.

    A collection without variables keeps one row. Rows instead of one array per collection,
    so a collection with very many variables stays spread out.
    """
    listed = associated_records(collections, variables, "variables").select(
        "collection_id", "pos",
        F.col("concept_id").alias("variable_id"), F.col("name").alias("variable"), "units", "scale",
        "offset", "standard_name",
    )
    base = attach_notes(collections, notes, ["short_name"]).select(
        F.col("concept_id").alias("collection_id"), "short_name", "advisory_notes"
    )
    noted = variable_notes(curated_vars).select(
        "short_name", F.col("name").alias("variable"), F.col("advisory_notes").alias("variable_notes")
    )
    return base.join(listed, "collection_id", "left").join(noted, ["short_name", "variable"], "left").select(
        "collection_id", "short_name", "advisory_notes", "pos", "variable_id", "variable", "units",
        "scale", "offset", "standard_name",
        F.coalesce("variable_notes", F.array().cast(NOTE_DDL)).alias("variable_notes"),
    )


# -- keywords ------------------------------------------------------------------------


def normalize_keywords(terms: DataFrame, synonyms: DataFrame, labels: DataFrame) -> DataFrame:
    """``term`` → rows ``term, rule, pos, keyword`` by strict priority.

    A synonym; else labels equal to the term ignoring case; else labels that contain it;
    else the term itself. ``labels``: ``label, pos`` in dump order. ``pos`` orders the
    keywords of a term. Only terms without a synonym or exact label reach the substring
    match.
    """
    keyed = terms.select("term").distinct().withColumn("_key", F.lower(F.trim("term")))
    by_synonym = keyed.join(
        synonyms.withColumnRenamed("synonym_key", "_key"), "_key"
    ).select(
        "term", F.lit("synonym").alias("rule"), F.posexplode("keywords").alias("pos", "keyword")
    ).withColumn("pos", F.col("pos").cast("long"))
    rest = keyed.join(by_synonym.select("term").distinct(), "term", "left_anti")
    known = labels.groupBy("label").agg(F.min("pos").cast("long").alias("pos"))
    exact = rest.join(known.withColumn("_key", F.lower("label")), "_key").select(
        "term", F.lit("exact").alias("rule"), "pos", F.col("label").alias("keyword")
    )
    unmatched = rest.join(exact.select("term").distinct(), "term", "left_anti")
    partial = contains_join(
        unmatched.select("term", F.array("_key").alias("_in")), known, "_in", "label"
    ).select(
        "term", F.lit("substring").alias("rule"),
        F.col("match_pos").alias("pos"), F.col("match_label").alias("keyword"),
    )
    passed = unmatched.join(partial.select("term").distinct(), "term", "left_anti").select(
        "term", F.lit("passthrough").alias("rule"), F.lit(0).cast("long").alias("pos"),
        F.col("term").alias("keyword"),
    )
    return by_synonym.unionByName(exact).unionByName(partial).unionByName(passed)


def search_keywords(normalized: DataFrame) -> DataFrame:
    """The one keyword per term that a search uses: its first."""
    return normalized.groupBy("term").agg(
        F.min_by("rule", "pos").alias("rule"), F.min_by("keyword", "pos").alias("keyword")
    )


# -- imagery -------------------------------------------------------------------------


def select_imagery_layers(layers: DataFrame) -> DataFrame:
    """Best layer per collection: non-polar before polar, then day before night, then first.

    ``layers``: ``collection_id, pos, layer, arctic, antarctic``. Rows without a layer name
    never win; a collection with none gets null. One aggregation, no sort.
    """
    usable = F.coalesce("layer", F.lit("")) != ""
    polar = F.coalesce("arctic", F.lit(False)) | F.coalesce("antarctic", F.lit(False))
    rank = F.struct(polar, F.contains("layer", F.lit("_Night")), F.col("pos"))
    return layers.groupBy("collection_id").agg(
        F.min_by(F.when(usable, F.col("layer")), F.when(usable, rank)).alias("layer")
    )
