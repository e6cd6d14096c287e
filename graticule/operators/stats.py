"""Descriptive statistics and structural summaries. No analysis beyond that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.quality import nan_to_null, quality_mask

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOAT = (T.FloatType, T.DoubleType)


def _to_rows(aggregated: DataFrame, variables: list[str], types: dict) -> DataFrame:
    """One wide aggregate row → one row per variable."""
    def entry(v: str) -> Column:
        numeric = isinstance(types[v], _NUMERIC)
        value = lambda stat: (
            F.col(f"{v}.{stat}").cast("double") if numeric else F.lit(None).cast("double")
        )
        return F.struct(
            F.lit(v).alias("variable"), F.lit(types[v].simpleString()).alias("dtype"),
            value("min").alias("min"), value("max").alias("max"),
            value("mean").alias("mean"), value("std").alias("std"),
            F.col(f"{v}.count").alias("count"),
        )

    return aggregated.select(F.inline(F.array(*[entry(v) for v in variables])))


def grid_statistics(
    grid: DataFrame, variables: list[str], rules: dict[str, dict] | None = None
) -> DataFrame:
    """``variable, dtype, min, max, mean, std, count`` for a grid, in one pass.

    Values are masked by ``rules`` first (see :func:`quality_mask`); missing cells are
    skipped; ``std`` is the population one; a variable with no value gives nulls and 0.
    Non-numeric variables get their count only.
    """
    types = {f.name: f.dataType for f in grid.schema}
    aggs = []
    for v in variables:
        if isinstance(types[v], _NUMERIC):
            x = nan_to_null(quality_mask(F.col(v), **(rules or {}).get(v, {})), types[v])
            aggs.append(F.struct(
                F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("std"), F.count(x).alias("count"),
            ).alias(v))
        else:
            aggs.append(F.struct(F.count(v).alias("count")).alias(v))
    return _to_rows(grid.agg(*aggs), variables, types)


def table_statistics(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same five numbers per column of a table, in one pass.

    NaN is a value here, not a gap: it is counted and makes mean and std NaN, while min and
    max pass over it. Text, boolean, date and time columns get their non-null count only.
    """
    types = {f.name: f.dataType for f in table.schema}
    names = columns or table.columns
    aggs = []
    for c in names:
        if isinstance(types[c], _NUMERIC):
            real = nan_to_null(F.col(c), types[c])
            low, high = F.min(real), F.max(real)
            if isinstance(types[c], _FLOAT):
                # Only NaN values: min and max are NaN, not missing.
                only_nan = F.count(c) > F.count(real)
                nan = F.lit(float("nan"))
                low, high = (F.coalesce(x, F.when(only_nan, nan)) for x in (low, high))
            aggs.append(F.struct(
                low.alias("min"), high.alias("max"), F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"), F.count(c).alias("count"),
            ).alias(c))
        else:
            aggs.append(F.struct(F.count(c).alias("count")).alias(c))
    return _to_rows(table.agg(*aggs), names, types)


def grid_summary(grid: DataFrame, dims: list[str]) -> DataFrame:
    """Structure of a grid: ``section, name, value``; one row per axis and variable."""
    fixed = set(dims) | {f"{d}_idx" for d in dims}
    sizes = grid.agg(*[F.count_distinct(d).alias(d) for d in dims])
    entries = [F.struct(F.lit("dim").alias("section"), F.lit(d).alias("name"),
                        F.col(d).cast("string").alias("value")) for d in dims]
    entries += [F.struct(F.lit("variable").alias("section"), F.lit(f.name).alias("name"),
                         F.lit(f.dataType.simpleString()).alias("value"))
                for f in grid.schema if f.name not in fixed]
    return sizes.select(F.inline(F.array(*entries)))


def table_summary(table: DataFrame) -> DataFrame:
    """Structure of a table: its row count and one row per column with its type."""
    entries = [F.struct(F.lit("rows").alias("section"), F.lit("num_rows").alias("name"),
                        F.col("n").cast("string").alias("value"))]
    entries += [F.struct(F.lit("column").alias("section"), F.lit(f.name).alias("name"),
                         F.lit(f.dataType.simpleString()).alias("value")) for f in table.schema]
    return table.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*entries)))


def dataset_summary(collections: DataFrame) -> DataFrame:
    """The six metadata fields shown for a catalog entry."""
    return collections.select(
        "short_name", "concept_id", "processing_level",
        F.col("spatial_extent").alias("bbox"), F.col("temporal_extents").alias("temporal"),
        "native_formats",
    )


def materialization_summary(handles: DataFrame) -> DataFrame:
    """Result handles with status: a handle that is not ready has status and no summary.

    Input ``handle, status, storage_key, media_type``.
    """
    ready = (F.col("status") == "ready") & (F.coalesce("storage_key", F.lit("")) != "") & (
        F.coalesce("media_type", F.lit("")) != ""
    )
    return handles.select(
        "handle", "status",
        F.when(ready, F.col("media_type")).alias("media_type"),
        ready.alias("summarizable"),
    )
