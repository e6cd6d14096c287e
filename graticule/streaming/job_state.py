"""Current job state and illegal changes from a stream of status events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graticule.operators.jobs import LEGAL

STATE_DDL = "job_id BIGINT, seq BIGINT, state STRING, illegal BIGINT, late BIGINT, events BIGINT"
_KEPT_DDL = "seq BIGINT, state STRING, illegal BIGINT, late BIGINT, events BIGINT"
_OVER_DDL = "seq BIGINT, illegal BIGINT, late BIGINT, events BIGINT"

#: Where the state store keeps these states: one that takes several named ones and their expiry.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def is_terminal(state: str | None) -> bool:
    """True for a state that no legal change leaves."""
    return state is not None and not LEGAL.get(state)


class JobFold(StatefulProcessor):
    """Folds one job's events of a micro-batch into its state, and reports the state.

    A job in progress has its whole state in the store. When it reaches a terminal state that is
    forgotten, and a short record of its last event stays for ``keep_ms`` after the last event of
    it; then the store drops that as well.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", _KEPT_DDL)
        self.over = handle.getValueState("over", _OVER_DDL, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        seq, state, illegal, late, events = None, None, 0, 0, 0
        if self.running.exists():
            seq, state, illegal, late, events = self.running.get()
        over = self.over.get() if self.over.exists() else None
        if over is not None:
            seq, illegal, late, events = over
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="last")
        for new_seq, new_state in zip(batch["seq"], batch["state"], strict=True):
            events += 1
            if pd.isna(new_seq) or (seq is not None and new_seq <= seq):
                late += 1
                continue
            # A job that is over has no legal change any more, whatever state it was over in.
            if over is not None or (state is not None and new_state not in LEGAL.get(state, ())):
                illegal += 1
            seq, state, over = int(new_seq), new_state, None
        if over is not None or is_terminal(state):
            self.running.clear()
            self.over.update((seq, illegal, late, events))
        else:
            self.over.clear()
            self.running.update((seq, state, illegal, late, events))
        yield pd.DataFrame({"job_id": [key[0]], "seq": pd.array([seq], "Int64"), "state": [state], "illegal": [illegal], "late": [late], "events": [events]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """Stream of ``job_id, seq, state`` → a row per job and micro-batch that has events of it.

    Spark's state store keeps each job's last state between batches; it must be one that has named
    states (``use_named_states``). Each event is compared with the one before it in ``seq``; an
    event at or before the stored ``seq``, or without one, comes too late to be judged and is counted
    in ``late``. ``events`` counts all events so far. A job in a terminal state leaves the store
    ``keep`` after its last event. Events that come within that time are counted as before, and
    a row without a ``state`` then says that the state did not change; a job
    whose events come later still begins anew, with counts from one.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return events.groupBy("job_id").transformWithStateInPandas(JobFold(keep_ms), STATE_DDL, "append", "ProcessingTime")


def use_named_states(spark) -> None:
    """Choose the state store that ``job_states`` needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def track_jobs(events: DataFrame, path: str, checkpoint: str, keep: str = "7 days", every: str | None = None) -> StreamingQuery:
    """Append the states to a table under ``path``; only jobs with new events are written.

    Takes what is there as one batch and ends, or runs on with a batch ``every`` so often. (States
    that expire by the clock keep a run over all available batches from ending, so that trigger is
    not used.) Read the newest states with :func:`current_state`.
    """
    use_named_states(events.sparkSession)
    writer = job_states(events, keep).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()


def current_state(spark, path: str) -> DataFrame:
    """Newest state of each job: the row of the highest ``seq``, and of those the one with the most events."""
    rows = spark.read.schema(STATE_DDL).parquet(path)
    newest = F.max_by(F.struct("seq", "illegal", "late"), F.struct("seq", "events")).alias("s")
    state = F.max_by("state", F.when(F.col("state").isNotNull(), F.struct("seq", "events"))).alias("state")
    return rows.groupBy("job_id").agg(newest, state).select("job_id", "s.seq", "state", "s.illegal", "s.late")
