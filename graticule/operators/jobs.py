"""Job logs: current state, unfinished work, illegal transitions, failure texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.text import literal_map

# Legal state changes, final states, and the step that resumes a state.
LEGAL = {
    "pending": ("submitted", "failed", "cancelled"),
    "submitted": ("running", "failed", "cancelled"),
    "running": ("materializing", "failed", "cancelled"),
    "materializing": ("ready", "failed"),
    "ready": ("expired",),
    "failed": (),
    "expired": (),
    "cancelled": (),
}
FINAL = ("ready", "failed", "expired", "cancelled")
RESUME = {
    "pending": "submit_job", "submitted": "poll_job",
    "running": "poll_job", "materializing": "materialize_job",
}


#: Sequence numbers of one job sorted together.
SEQ_SPAN = 1_000_000


def is_legal(previous: Column, state: Column) -> Column:
    """Whether ``previous → state`` is a legal change."""
    pairs = [f"{a}>{b}" for a, targets in LEGAL.items() for b in targets]
    return F.concat(previous, F.lit(">"), state).isin(*pairs)


def with_previous(log: DataFrame, columns: list[str], span: int = SEQ_SPAN) -> DataFrame:
    """Adds ``before_<column>``: each column's value in the job's preceding event.

    A job's log is cut into stretches of ``span`` sequence numbers, so one job with a large
    share of all events is still sorted by many tasks. The last event of each stretch is
    carried to the first of the next: one row per stretch.
    """
    cut = log.withColumn("_stretch", F.floor(F.col("seq") / span))
    inside = Window.partitionBy("job_id", "_stretch").orderBy("seq")
    values = F.struct(*columns)
    local = cut.withColumn("_before", F.lag(values).over(inside))
    carried = (
        cut.groupBy("job_id", "_stretch").agg(F.max_by(values, "seq").alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy("job_id").orderBy("_stretch")))
        .drop("_last")
    )
    before = F.coalesce("_before", "_carried")
    return local.join(carried, ["job_id", "_stretch"]).select(
        *log.columns, *[before[c].alias(f"before_{c}") for c in columns]
    )


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Consecutive states of a job that are not a legal change.

    ``log``: ``job_id, seq, state, created_at``. The pair test is a constant list, so the
    legal changes need no join.
    """
    pairs = with_previous(log, ["state"]).withColumnRenamed("before_state", "previous")
    return pairs.where(
        F.col("previous").isNotNull() & ~is_legal(F.col("previous"), F.col("state"))
    ).select("job_id", "seq", "previous", "state", "created_at")


def job_status(log: DataFrame) -> DataFrame:
    """Latest state per job with its progress and error, by partial aggregation."""
    cols = [c for c in ("state", "progress", "error", "created_at") if c in log.columns]
    return log.groupBy("job_id").agg(
        *[F.max_by(F.struct(*cols), "seq").alias("_last")], F.min("created_at").alias("first_seen")
    ).select("job_id", "first_seen", "_last.*")


def unfinished_jobs(log: DataFrame) -> DataFrame:
    """Jobs not in a final state, oldest first, with the step that resumes each."""
    return (
        job_status(log)
        .where(~F.col("state").isin(*FINAL))
        .select("job_id", "first_seen", "state",
                F.element_at(literal_map(RESUME), F.col("state")).alias("resume_step"))
        .orderBy("first_seen", "job_id")
    )


def failure_reports(failures: DataFrame) -> DataFrame:
    """Failure rows → one readable ``error`` text.

    ``failures``: ``job_id, stage, provider, error_prefix, error_type, messages
    ARRAY<STRING>``. Several message parts are joined; an empty message falls back to the
    error's type; a given prefix is kept word for word.
    """
    prefix = F.coalesce(
        "error_prefix", F.concat("stage", F.lit("/"), "provider", F.lit(" failed"))
    )
    joined = F.array_join("messages", ": ", "None")
    message = F.when(F.size("messages") > 1, joined).otherwise(
        F.coalesce(F.nullif(joined, F.lit("")), F.col("error_type"))
    )
    return failures.select(
        "job_id", "stage", "provider", "error_type", message.alias("message"),
        F.concat(prefix, F.lit(": "), message).alias("error"),
    )
