"""Chunked arrays → long-form cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell_index(dim: int, ndim: int) -> Column:
    """Index along ``dim`` of the value at row-major position ``pos`` in its chunk."""
    stride = reduce(
        lambda acc, d: acc * F.col("shape")[d], range(dim + 1, ndim), F.lit(1).cast("long")
    )
    within = F.pmod(F.floor(F.col("pos") / stride), F.col("shape")[dim].cast("long"))
    return (F.col("chunk_origin")[dim] + within).cast("long")


def flatten_chunks(
    chunks: DataFrame, axes: DataFrame, dims: list[str], variables: list[str]
) -> DataFrame:
    """Every cell one row: ``source_id``, ``<dim>_idx`` and ``<dim>`` per dim, one column
    per variable.

    ``chunks``: ``source_id, variable, chunk_origin, shape, values``; ``axes``:
    ``source_id, axis, idx, value``. Variables are brought together as whole arrays, by the
    place of their chunks, and exploded side by side. Only where a place lacks one of the
    variables are single cells shuffled, because the others may be chunked another way there.
    """
    place = ["source_id", "chunk_origin", "shape"]
    arrays = chunks.where(F.col("variable").isin(variables)).groupBy(*place).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("values"))).alias(f"_v{i}") for i, v in enumerate(variables)]
    )
    columns = [F.col(f"_v{i}") for i in range(len(variables))]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])

    def cells(of: DataFrame) -> DataFrame:
        return of.select(*place, F.posexplode(F.arrays_zip(*columns)).alias("pos", "x")).select(
            "source_id", *[_cell_index(i, len(dims)).alias(f"{d}_idx") for i, d in enumerate(dims)],
            *[F.col(f"x._v{i}").alias(v) for i, v in enumerate(variables)],
        )

    keys = ["source_id"] + [f"{d}_idx" for d in dims]
    partly = arrays.where(~whole).select(
        *place, *[F.coalesce(c, F.array().cast(arrays.schema[f"_v{i}"].dataType)).alias(f"_v{i}") for i, c in enumerate(columns)])
    merged = cells(partly).groupBy(*keys).agg(*[F.max(v).alias(v) for v in variables])
    wide = cells(arrays.where(whole)).unionByName(merged)
    for d in dims:
        side = axes.where(F.col("axis") == d).select(
            "source_id", F.col("idx").cast("long").alias(f"{d}_idx"), F.col("value").alias(d)
        )
        wide = wide.join(side, ["source_id", f"{d}_idx"], "left")
    return wide


def _cut(values: Column, shape: Column, dim: int, ndim: int, low: Column, count: Column) -> Column:
    """The part of a row-major array that lies at ``low`` and ``count`` along one dimension."""
    product = lambda dims: reduce(lambda acc, d: acc * shape[d], dims, F.lit(1))
    inner = product(range(dim + 1, ndim))
    if dim == 0:
        return F.slice(values, (low * inner + 1).cast("int"), (count * inner).cast("int"))
    stretch = lambda i: F.slice(values, ((i * shape[dim] + low) * inner + 1).cast("int"), (count * inner).cast("int"))
    return F.flatten(F.transform(F.sequence(F.lit(0), (product(range(dim)) - 1).cast("int")), stretch))


def cut_chunks(chunks: DataFrame, axes: DataFrame, dims: list[str], limits: dict[str, tuple]) -> DataFrame:
    """The chunks that ``limits`` touch, each cut to the part that lies within.

    ``limits``: dimension → (low, high), inclusive; None leaves an end open. Each source's own
    axis gives the range of indices, so chunks outside it are dropped by their origin and shape
    before any value is looked at. On an axis that does not rise or fall throughout the range
    reaches from the first to the last index inside the limits; ``flatten_chunks`` of the result
    then has cells between them too.
    """
    out = chunks
    for d, (low, high) in limits.items():
        dim = dims.index(d)
        inside = F.lit(True)
        inside = inside if low is None else inside & (F.col("value") >= low)
        inside = inside if high is None else inside & (F.col("value") <= high)
        ranges = axes.where((F.col("axis") == d) & inside).groupBy("source_id").agg(
            F.min("idx").cast("int").alias("_first"), F.max("idx").cast("int").alias("_last"))
        origin, size = F.col("chunk_origin")[dim], F.col("shape")[dim]
        touched = out.join(ranges, "source_id").where((origin <= F.col("_last")) & (origin + size > F.col("_first")))
        start = F.greatest(F.lit(0), F.col("_first") - origin)
        count = F.least(size, F.col("_last") - origin + 1) - start
        whole = count == size
        replaced = lambda c, value: F.transform(c, lambda x, i: F.when(i == dim, value).otherwise(x))  # noqa: B023, E731
        cut = touched.withColumns({"_start": start, "_count": count, "_whole": whole}).withColumnsRenamed({"values": "_values", "chunk_origin": "_origin", "shape": "_shape"})
        part = _cut(F.col("_values"), F.col("_shape"), dim, len(dims), F.col("_start"), F.col("_count"))
        out = cut.withColumns({
            "values": F.when(F.col("_whole"), F.col("_values")).otherwise(part),
            "chunk_origin": replaced(F.col("_origin"), F.col("_origin")[dim] + F.col("_start")),
            "shape": replaced(F.col("_shape"), F.col("_count")),
        }).select(chunks.columns)
    return out


def flatten_chunks_within(chunks: DataFrame, axes: DataFrame, dims: list[str], variables: list[str], limits: dict[str, tuple]) -> DataFrame:
    """``flatten_chunks`` of the cells within ``limits`` only; no other cell is made."""
    wanted = chunks.where(F.col("variable").isin(variables))
    cells = flatten_chunks(cut_chunks(wanted, axes, dims, limits), axes, dims, variables)
    for d, (low, high) in limits.items():
        cells = cells if low is None else cells.where(F.col(d) >= low)
        cells = cells if high is None else cells.where(F.col(d) <= high)
    return cells
