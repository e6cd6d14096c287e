"""Tables and result files: formats, bundles, point-result listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.temporal import decode_cf_time, synthesize_time
from graticule.functions.text import FORMAT_ALIASES
from graticule.session import cut_lineage

#: Media types written here; grid containers are left to their own libraries.
_WRITERS = {"application/x-parquet": "parquet", "text/csv": "csv"}


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None,
    schema=None,
) -> DataFrame:
    """Parquet or CSV → DataFrame; the column list reaches the Parquet scan.

    CSV without a schema is read twice, the first time to infer types.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"cannot read {fmt!r}; use parquet or csv")
    return df.select(*columns) if columns else df


def output_media_type(name: str, shape: str) -> str:
    """Canonical media type for a requested format, checked against the data's shape."""
    media = FORMAT_ALIASES.get(name.strip().lower())
    if media is None:
        raise ValueError(f"unknown output format {name!r}; known: {sorted(FORMAT_ALIASES)}")
    if media == "text/csv" and shape != "table":
        raise ValueError("csv output needs a table; write a grid as netcdf or parquet")
    if media in ("application/x-netcdf", "application/zarr") and shape != "grid":
        raise ValueError(f"{name} output needs a grid; write a table as csv or parquet")
    return media


def convert_format(
    df: DataFrame, path: str, name: str, shape: str = "table",
    partition_by: tuple[str, ...] = (),
) -> str:
    """Write ``df`` in the requested format and return its media type."""
    media = output_media_type(name, shape)
    if media not in _WRITERS:
        raise ValueError(f"{media} is a grid container; long-form grids are written as parquet")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if _WRITERS[media] == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return media


def format_decisions(requests: DataFrame) -> DataFrame:
    """Request rows ``(output_format, shape)`` → ``media_type`` and ``status`` in bulk.

    Status is ``ok``, ``unknown_format``, ``needs_table`` or ``needs_grid``.
    """
    from graticule.functions.text import canonical_format

    media = canonical_format(F.col("output_format"))
    status = (
        F.when(media.isNull(), "unknown_format")
        .when((media == "text/csv") & (F.col("shape") != "table"), "needs_table")
        .when(
            media.isin("application/x-netcdf", "application/zarr") & (F.col("shape") != "grid"),
            "needs_grid",
        )
        .otherwise("ok")
    )
    return requests.withColumn("media_type", media).withColumn("status", status)


def pick_result_files(manifest: DataFrame) -> DataFrame:
    """Per task, the first ``csv`` file whose name contains ``results``.

    Input ``task_id, pos, file_id, file_name, file_type``. Tasks without one get status
    ``no_results`` and the first six file names for the message. Only the running best and
    a six-row window cross the shuffle, so a task with very many files is no burden.
    """
    from pyspark.sql import Window

    hit = (F.lower(F.coalesce("file_type", F.lit(""))) == "csv") & F.contains(
        F.lower(F.coalesce("file_name", F.lit(""))), F.lit("results")
    )
    order = Window.partitionBy("task_id").orderBy("pos")
    head = (
        manifest.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= 6)
        .groupBy("task_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_rank", F.coalesce("file_name", F.lit("?")).alias("f")))),
                    lambda x: x["f"],
                ),
                ", ",
            ).alias("_head")
        )
    )
    best = manifest.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min_by(F.when(hit, F.struct("file_id", "file_name")), F.when(hit, F.col("pos"))).alias("_best"),
    )
    return best.join(head, "task_id").select(
        "task_id",
        "n_files",
        F.col("_best.file_id").alias("file_id"),
        F.col("_best.file_name").alias("file_name"),
        F.when(F.col("_best").isNotNull(), "ok").otherwise("no_results").alias("status"),
        F.when(
            F.col("_best").isNull(),
            F.concat(F.col("_head"), F.when(F.col("n_files") > 6, "…").otherwise("")),
        ).alias("seen_files"),
    )


def csv_results_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Header CSV with inferred types → Parquet, returned as a DataFrame."""
    read_table(spark, csv_path, "csv").write.parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def stack_granules(members: list[DataFrame], attrs: DataFrame) -> DataFrame:
    """Granule tables → one table along ``time``.

    Members hold ``granule``, the number ``time_raw`` (may be null) and their variables;
    ``attrs`` has one row per granule: ``granule, units, calendar, begin_date,
    begin_clock``. Each row is decoded with its own granule's epoch before the union means
    anything, and a granule with no time takes its begin date. Equal times in different
    granules all stay. Variables missing in a member are null.
    """
    if not members:
        raise ValueError("a bundle needs at least one granule")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), members)
    time = synthesize_time(
        decode_cf_time(F.col("time_raw"), F.col("units"), F.col("calendar")),
        F.col("begin_date"), F.col("begin_clock"),
    )
    kept = [c for c in stacked.columns if c not in ("granule", "time_raw")]
    return stacked.join(attrs, "granule", "left").select("granule", time.alias("time"), *kept)


# -- result files in bulk ------------------------------------------------------------------

#: Types that a column of a result file may have, narrowest first; anything else is text.
_INFERRED = ("bigint", "double", "boolean", "date", "timestamp_ntz")


def _inferred_types(rows: DataFrame, names: list[str]) -> dict[str, str]:
    """The narrowest type that takes all values of each column, found in one pass."""
    if not names:
        return {}
    fits = rows.agg(*[
        F.bool_and(F.col(f"_{i}").isNull() | F.col(f"_{i}").try_cast(kind).isNotNull()).alias(f"{i}_{kind}")
        for i in range(len(names)) for kind in _INFERRED
    ]).head()
    filled = rows.agg(*[F.count(f"_{i}").alias(str(i)) for i in range(len(names))]).head()
    kind = lambda i: next((k for k in _INFERRED if fits[f"{i}_{k}"]), "string") if filled[str(i)] else "string"
    return {name: kind(i) for i, name in enumerate(names)}


def lines_of_files(spark: SparkSession, root: str) -> DataFrame:
    """The text files under a folder as an archive: ``path, at, front, value``.

    Every file is opened and listed by itself, which suits thousands of files; millions of small
    ones belong in an archive, a table of this shape that is written once.
    """
    scan = spark.read.option("recursiveFileLookup", True).text(root)
    return scan.select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"),
        (F.col("_metadata.file_block_start") == 0).alias("front"), "value")


def result_files_to_parquet(spark: SparkSession, manifest: DataFrame, files: str | DataFrame, parquet_path: str) -> DataFrame:
    """The result file of every task of a manifest → one Parquet table: ``task_id`` and all columns.

    ``manifest``: ``task_id, pos, file_id, file_name, file_type`` as in ``pick_result_files``, and
    ``path`` as Spark names it in ``_metadata.file_path``. ``files`` is a folder under which the files
    lie, or an archive of them: a row per line, ``path, at`` (the line's place in its file), ``value``,
    and optionally ``front`` (false for parts of a file that cannot hold its header). All are read in one
    scan and meet their task by path; of an archive no list of files is ever on the driver.
    Headers may differ: columns are united by name, in alphabetical order, a column
    that a file lacks is null there, and of equal names in one header the first counts. Types are
    inferred over all tasks; empty fields are null, empty lines are left out, and quoted fields do
    not reach over lines. Rows of a task stand together, in their order. Tasks without a result
    file have no row; ``pick_result_files`` tells them.
    """
    chosen = pick_result_files(manifest).where("status = 'ok'").select("task_id", "file_id")
    paths = manifest.join(chosen, ["task_id", "file_id"]).select("task_id", F.col("path").alias("_path"))
    archive = lines_of_files(spark, files) if isinstance(files, str) else files
    front = F.col("front") if "front" in archive.columns else F.lit(True)
    lines = archive.where(F.trim("value") != "").select(
        F.regexp_replace("value", "^﻿", "").alias("line"), F.col("path").alias("_path"), front.alias("_front"), F.col("at").alias("_at"))
    held = cut_lineage(lines.join(paths, "_path").drop("_path"), "result_lines")
    first = held.where("_front").groupBy("task_id").agg(F.min("_at").alias("_first"), F.min_by("line", "_at").alias("_header"))
    width = first.agg(F.max(F.length("_header") - F.length(F.replace("_header", F.lit(","), F.lit(""))))).head()[0]
    fields = ", ".join(f"c{i} string" for i in range((width or 0) + 1))

    def cut(line: str) -> Column:
        parsed = F.from_csv(line, fields)
        return F.array(*[F.trim(parsed[f"c{i}"]) for i in range((width or 0) + 1)])

    headers = cut_lineage(first.select("task_id", "_first", F.filter(cut("_header"), lambda c: F.length(c) > 0).alias("_names")), "result_headers")
    names = sorted(r[0] for r in headers.select(F.explode("_names")).distinct().collect())  # these are the table's columns
    rows = held.join(headers, "task_id").where("_at > _first").withColumn("_fields", cut("line"))

    def value(name: str) -> Column:
        at = F.array_position("_names", F.lit(name)).cast("int")
        return F.nullif(F.when(at > 0, F.try_element_at("_fields", at)), F.lit(""))

    wide = cut_lineage(rows.select("task_id", "_at", *[value(n).alias(f"_{i}") for i, n in enumerate(names)]), "result_rows")
    types = _inferred_types(wide, names)
    typed = wide.select("task_id", "_at", *[F.col(f"_{i}").try_cast(types[n]).alias(n) for i, n in enumerate(names)])
    ordered = typed.repartitionByRange("task_id", "_at").sortWithinPartitions("task_id", "_at").drop("_at")
    ordered.write.parquet(parquet_path)
    return spark.read.schema(ordered.schema).parquet(parquet_path)
