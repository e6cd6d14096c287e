"""Alignment of grids on shared axes, and merging of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.temporal import snap_time
from graticule.operators.axes import dense_grid, index_axis
from graticule.operators.grid import decoded_time, flatten_group, widen_integers
from graticule.session import BROADCAST_ROWS, cut_lineage

METHODS = ("outer", "inner", "left", "right", "exact", "override")


def _collect_axes(grids: list[DataFrame], dims: list[str]) -> DataFrame:
    """Distinct axis values of all grids: ``_grid, _dim`` and the value in its dim's column.

    One pass per grid for all its axes; written out, because the axes are used many times
    and are small next to the cells.
    """
    def tagged(grid: DataFrame, i: int) -> DataFrame:
        types = {f.name: f.dataType for f in grid.schema}
        entry = lambda d: F.struct(
            F.lit(d).alias("_dim"),
            *[(F.col(x) if x == d else F.lit(None).cast(types[x])).alias(x) for x in dims],
        )
        rows = grid.select(F.inline(F.array(*[entry(d) for d in dims])))
        return rows.distinct().select(F.lit(i).alias("_grid"), "_dim", *dims)

    found = reduce(DataFrame.unionByName, [tagged(g, i) for i, g in enumerate(grids)])
    present = reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in dims])
    return cut_lineage(found.where(present), "axes")


def _sizes(table: DataFrame, *keys: str) -> dict:
    """Row counts per key of a small table."""
    return {tuple(r[:-1]): r[-1] for r in table.groupBy(*keys).count().collect()}


def _check_grids(grids: list[DataFrame], dims: list[str]) -> None:
    if len(grids) < 2:
        raise ValueError("align needs at least two grids")
    for g in grids:
        lacking = [d for d in dims if d not in g.columns]
        if lacking:
            raise ValueError(f"align needs gridded sources; one has no axis {lacking}")


def _joined_axes(per_grid: list[DataFrame], method: str, dim: str, sizes: list[int]) -> DataFrame:
    """The result axis for one dim."""
    if method == "outer":
        return reduce(DataFrame.union, per_grid).distinct()
    if method == "inner":
        return reduce(lambda a, b: a.join(b, dim, "left_semi"), per_grid)
    if method == "right":
        return per_grid[-1]
    if method == "exact":
        same = per_grid[0].join(reduce(lambda a, b: a.join(b, dim, "left_semi"), per_grid[1:]), dim, "left_semi")
        if len(set(sizes)) != 1 or same.count() != sizes[0]:
            raise ValueError(f"cannot align with method 'exact': axis {dim!r} differs")
    if method == "override" and len(set(sizes)) != 1:
        raise ValueError(f"cannot align with method 'override': axis {dim!r} has sizes {sizes}")
    return per_grid[0]


def align(
    grids: list[DataFrame],
    dims: list[str],
    method: str = "outer",
    snap_ns: int | None = None,
    units: str | None = None,
) -> tuple[DataFrame, dict]:
    """Align grids per axis and merge their variables → ``(grid, report)``.

    Axes are joined one by one (``outer`` unions them, ``inner`` intersects, ``left`` and
    ``right`` take the first or last grid's, ``exact`` demands equality, ``override`` takes
    the first grid's labels by position) and the result has every cell of the joined axes,
    with nulls where no source has data. A variable name seen in an earlier grid keeps that
    grid's column entirely, nulls included. ``snap_ns`` rounds times first; of a source's rows
    that fall on one cell by that, the one of the earliest time is taken whole. A source that
    has a cell twice in itself stops the job.

    The axes are collected in one pass, written to the scratch folder and counted; the cells
    themselves go through one shuffle: the dense grid and all sources are unioned and grouped
    by cell. Integer variables become floats so they can hold gaps.
    """
    _check_grids(grids, dims)
    if method not in METHODS:
        raise ValueError(f"unknown join method {method!r}; one of {METHODS}")
    ready = [widen_integers(decoded_time(g, units), dims) for g in grids]
    snapped = snap_ns is not None and "time" in dims
    if snapped:
        ready = [g.withColumn("_scan", F.col("time")).withColumn("time", snap_time(F.col("time"), snap_ns)) for g in ready]

    found = _collect_axes(ready, dims)
    per_grid = {
        d: [found.where((F.col("_dim") == d) & (F.col("_grid") == i)).select(d) for i in range(len(ready))]
        for d in dims
    }
    sizes = _sizes(found, "_dim", "_grid")
    before = {d: [sizes.get((d, i), 0) for i in range(len(ready))] for d in dims}
    joined = {
        d: index_axis(
            _joined_axes(per_grid[d], method, d, before[d]), d, small=sum(before[d]) <= BROADCAST_ROWS
        )
        for d in dims
    }
    lengths = _sizes(
        reduce(DataFrame.union, [joined[d].select(F.lit(d).alias("_dim")) for d in dims]), "_dim"
    )
    after = {d: lengths.get((d,), 0) for d in dims}

    if method == "override":
        ready = [ready[0]] + [_relabel(g, per_grid, joined, dims, i + 1) for i, g in enumerate(ready[1:])]

    seen: set[str] = set()
    parts: list[DataFrame] = []
    values: list[Column] = []
    for i, g in enumerate(ready):
        fresh = [c for c in g.columns if c not in dims and c not in seen and c != "_scan" and not _is_index(c, dims)]
        seen |= set(fresh)
        source = f"_source{i}"
        if snapped:
            # Ordered by the scan's own time first; the rest breaks ties between equal times.
            part = g.select(*dims, F.struct("_scan", *fresh).alias(source))
            values += [F.min(source)[v].alias(v) for v in fresh]
        else:
            part = g.select(*dims, *fresh, F.lit(1).alias(source))
            twice = F.raise_error(F.lit(f"source {i} has a cell more than once"))
            values += [F.when(F.count(source) > 1, twice).otherwise(F.max(v)).alias(v) for v in fresh]
        if method in ("inner", "left", "right"):
            for d in dims:
                side = joined[d].select(d)
                part = part.join(F.broadcast(side) if after[d] <= BROADCAST_ROWS else side, d, "left_semi")
        parts.append(part)

    cells = dense_grid(joined, after)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cells, *parts])
    out = merged.groupBy(*dims).agg(*values)
    report = {
        "n_inputs": len(grids),
        "method": method,
        "common_dims": after,
        "shapes_before": [{d: before[d][i] for d in dims} for i in range(len(grids))],
        "shape_after": after,
    }
    return out, report


def _is_index(column: str, dims: list[str]) -> bool:
    return column in {f"{d}_idx" for d in dims}


def _relabel(grid, per_grid, joined, dims, i) -> DataFrame:
    """Give a grid the first grid's axis values, position by position."""
    for d in dims:
        own = index_axis(per_grid[d][i], d).withColumnRenamed("idx", "_i")
        target = joined[d].select(F.col(d).alias("_label"), F.col("idx").alias("_i"))
        table = own.join(target, "_i").select(d, "_label")
        grid = grid.join(table, d).drop(d).withColumnRenamed("_label", d)
    return grid


def report_rows(spark, report: dict) -> DataFrame:
    """The alignment report as rows ``stage, input, axis, size``."""
    rows = [
        ("before", i, axis, size)
        for i, shape in enumerate(report["shapes_before"])
        for axis, size in shape.items()
    ] + [("after", None, axis, size) for axis, size in report["shape_after"].items()]
    return spark.createDataFrame(rows, "stage STRING, input INT, axis STRING, size BIGINT")


def merge_groups(groups: dict[str, DataFrame], dims: list[str]) -> DataFrame:
    """Groups of one file → one grid: names prefixed by group, axes outer-joined."""
    flat = [flatten_group(g, path, dims) for path, g in groups.items()]
    return flat[0] if len(flat) == 1 else align(flat, dims, "outer")[0]
