"""Incremental temporal resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graticule.operators.resample import parse_frequency


def stream_means(
    cells: DataFrame, time_freq: str, variables: list[str], cell: list[str], delay: str = "1 hour"
) -> DataFrame:
    """Tumbling means per cell over a stream with a ``time`` column, for append mode.

    A bin is emitted once the watermark has passed its end; rows later than ``delay`` are
    dropped. Only fixed-width bins that divide or span whole days from the epoch; empty bins
    are left to ``means_view``, which late rows also reach.
    """
    freq = parse_frequency(time_freq)
    if freq.kind != "fixed":
        raise ValueError("streams resample to fixed widths (D, h, min, s), not calendar periods")
    return (
        cells.withWatermark("time", delay)
        .groupBy(F.window("time", f"{freq.micros} microseconds").alias("_w"), *cell)
        .agg(*[F.avg(v).alias(v) for v in variables])
        .select(F.col("_w.start").alias("time"), *cell, *variables)
    )


# -- partial sums and the batch view over them ---------------------------------------------------


def stream_sums(cells: DataFrame, time_freq: str, variables: list[str], cell: list[str]) -> DataFrame:
    """The rows of each micro-batch with the bin they belong to, for ``append_sums``."""
    freq = parse_frequency(time_freq)
    if freq.kind != "fixed":
        raise ValueError("streams resample to fixed widths (D, h, min, s), not calendar periods")
    return cells.select(F.window("time", f"{freq.micros} microseconds")["start"].alias("time"), *cell, *variables)


def append_sums(binned: DataFrame, variables: list[str], cell: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's sums and counts by bin and cell to a table under ``path``.

    Sums of a bin may come in any number of batches and at any time: they are added when they are
    read, so a late row corrects its bin and nothing has to wait for a watermark. A batch that is
    run again after a failure replaces its own rows.
    """
    parts = [f(v).alias(f"{v}_{name}") for v in variables for name, f in (("sum", F.sum), ("n", F.count))]

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("time", *cell).agg(*parts)
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return binned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_sums(spark: SparkSession, path: str, variables: list[str], cell: list[str], to: str) -> None:
    """Write the sums under ``path`` as one row per bin and cell to another table of the same kind."""
    rows = spark.read.option("basePath", path).parquet(path).groupBy("time", *cell)
    rows.agg(*[F.sum(f"{v}_{x}").alias(f"{v}_{x}") for v in variables for x in ("sum", "n")]).write.parquet(f"{to}/batch=-1")


def means_view(spark: SparkSession, path: str, time_freq: str, variables: list[str], cell: list[str], fill_gaps: bool = True) -> DataFrame:
    """Means per bin and cell of all sums written so far: what a batch resampling of the same rows gives.

    With ``fill_gaps`` each cell has a row for every bin from the first to the last of all, null
    where it has no value.
    """
    freq = parse_frequency(time_freq)
    rows = spark.read.option("basePath", path).parquet(path).withColumn("time", F.col("time").cast("timestamp_ntz"))
    sums = rows.groupBy("time", *cell).agg(*[F.sum(f"{v}_{x}").alias(f"{v}_{x}") for v in variables for x in ("sum", "n")])
    means = sums.select("time", *cell, *[F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_sum") / F.col(f"{v}_n")).alias(v) for v in variables])
    if not fill_gaps:
        return means
    # The span is read from the stored sums, and each cell makes its own bins.
    span = rows.agg(F.struct(F.min("time").alias("low"), F.max("time").alias("high"))).scalar()
    width = F.expr(f"make_dt_interval(0, 0, 0, {freq.micros / 1_000_000:.6f})")
    bins = rows.select(*cell).distinct().withColumn("time", F.explode(F.sequence(span["low"], span["high"], width)))
    return bins.join(means, ["time", *cell], "left").select("time", *cell, *variables)
