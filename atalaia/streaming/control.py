"""Control messages as keyed state: a task asked for twice runs once, one that is stuck is timed out, and a restart remembers both.

A message names a task by its id and says run, completed or failed. The state of an id goes from run to running, then to completed, failed or
timed_out; the last two may be asked to run again. Spark keeps the states by id in its state store, so their number is bounded by no
driver, and brings them back from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "id string, task string, state string, params map<string,string>"
#: Changes of state: of which task, which run of it, and what is asked for.
CHANGE = "id string, state string, attempt long, task string, params string"
_HELD = "phase string, attempt long, task string, params string, began long"
#: What takes part first among an id's messages of one batch, and the phases from which a task may be started.
ORDER = {"run": 0, "completed": 1, "failed": 1}
STARTS = ("", "failed", "timed_out")


def step(phase: str, said: str) -> str | None:
    """The phase after a message, None if it changes nothing."""
    if said == "run":
        return "running" if phase in STARTS else None
    return said if said in ORDER and phase == "running" else None


def changes(messages: DataFrame, timeout: str = "PT1H", forget: str | None = None) -> DataFrame:
    """CHANGE rows of a stream of MESSAGE rows, one for each change of an id's state.

    Of one batch an id's requests to run come before what ended, so a task that is asked for twice and ends in the same batch runs once.
    A run that has not ended ``timeout`` after it began (an ISO duration) becomes timed_out with the next batch. With ``forget`` an id that
    has ended is forgotten after so long, and may run anew. Null ids and unknown states are left out.
    """
    wait, keep = (None if x is None else int(pd.Timedelta(x).total_seconds() * 1000) for x in (timeout, forget))

    def work(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, attempt, task, params, began = state.get if state.exists else ("", 0, None, None, 0)
        out: list[tuple[Any, ...]] = []
        if state.hasTimedOut:
            if phase != "running":
                state.remove()
                return
            phase = "timed_out"
            out.append((key[0], phase, attempt, task, params))
        else:
            said = pd.concat(list(frames)).sort_values(["rank", "task", "params", "state"])
            for name, of, what in zip(said["state"], said["task"], said["params"], strict=True):
                new = step(phase, name)
                if new is None:
                    continue
                if new == "running":
                    attempt, task, params, began = attempt + 1, of, what, state.getCurrentProcessingTimeMs()
                phase = new
                out.append((key[0], phase, attempt, task, params))
        if phase:
            state.update((phase, attempt, task, params, began))
            if phase == "running":  # Spark forgets the timer with every update; messages that change nothing don't put it off
                state.setTimeoutDuration(max(1, began + wait - state.getCurrentProcessingTimeMs()))
            elif keep is not None:
                state.setTimeoutDuration(keep)
        yield pd.DataFrame(out, columns=["id", "state", "attempt", "task", "params"])

    rank = F.when(F.col("state") == "run", 0).otherwise(1)
    known = messages.filter(F.col("id").isNotNull() & F.col("state").isin(*ORDER)).select("id", "state", "task", F.to_json("params").alias("params"), rank.alias("rank"))
    return known.groupBy("id").applyInPandasWithState(work, CHANGE, _HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)


def serve(messages: DataFrame, start: Callable[[DataFrame], None], out: str, checkpoint: str, timeout: str = "PT1H", forget: str | None = None, once: bool = True) -> StreamingQuery:
    """Write the changes below ``out`` and give the tasks that begin to ``start``, as a DataFrame of CHANGE rows, batch by batch.

    A batch that Spark repeats after a failure starts nothing anew if its changes had been written; ``start`` is called before that, so it
    must bear the same tasks twice if it fails half-way (id and attempt tell them). With ``once`` what has arrived is taken, else the query goes on.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, f"{out.rstrip('/')}/batch={number}"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return
        batch.persist()
        try:
            begun = batch.filter("state = 'running'")
            if not begun.isEmpty():
                start(begun)
            batch.write.mode("overwrite").parquet(place)
        finally:
            batch.unpersist()

    writer = changes(messages, timeout, forget).writeStream.outputMode("append").foreachBatch(work).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    conf, key = messages.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(key)
    conf.set(key, "false")  # batches for timers alone would go on for ever
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, was)
    return query


def say(spark: SparkSession, folder: str, rows: DataFrame, state: str) -> None:
    """Put messages about the tasks of ``rows`` (id, and task if there is one) into a folder that ``ingest.commands`` reads."""
    task = F.col("task") if "task" in rows.columns else F.lit(None).cast("string")
    rows.select("id", task.alias("task"), F.lit(state).alias("state")).write.mode("append").json(folder)


def states(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every id, from the changes that serve() has written."""
    rows = spark.read.parquet(out)
    rank = F.when(F.col("state") == "running", 0).otherwise(1)
    last = F.max_by(F.struct("state", "attempt", "task"), F.struct("attempt", rank))
    return rows.groupBy("id").agg(last.alias("x"), F.count_if(F.col("state") == "running").alias("runs")).select("id", "x.*", "runs")
