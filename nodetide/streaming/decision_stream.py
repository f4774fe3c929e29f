"""Scaling decisions on a stream of predictions, with the state machine's state kept per node by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nodetide.operators import decide as D
from nodetide.sources.writers import replace_partitions

PREDICTION_FEED = (
    "cloud_provider string, node_id string, timestamp bigint, observed_timestamp bigint, pred_cpu_util double, "
    "pred_mem_util double, cur_cpu_util double, cur_mem_util double, spike boolean")
#: Place in the policy's table of states, the last action and the last window of a node.
STATE = "at int, last_kind int, last_ts bigint, prev_timestamp bigint, prev_cpu double, prev_mem double"
MACHINE = "act int, streak int, cooling boolean, last_kind int, last_ts bigint, prev_timestamp bigint, prev_cpu double, prev_mem double"


def stepper(policy: D.Policy, columns: list[str]):
    """Per node: the new windows in time order through the state machine; its output stands beside their columns."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, action, streak, cooling = D.tables(policy)
        at, kind, when, *before = state.get if state.exists else (0, None, None, None, None, None)
        # A group is one node's windows of one trigger, which the trigger's file limit bounds.
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        order = np.argsort(rows["timestamp"].to_numpy(np.int64))
        stamps, codes, cpu, mem = (rows[c].to_numpy(kind_of)[order] for c, kind_of in (
            ("timestamp", np.int64), ("code", np.int64), ("cpu", float), ("mem", float)))
        moves, walked, n = nxt.tolist(), [at], len(rows)
        for code in codes.tolist():  # each state depends on the one before
            walked.append(moves[walked[-1]][code])
        path = np.array(walked[:-1])
        acts = action[path, codes]
        spot = np.maximum.accumulate(np.where(acts > 0, np.arange(n), -1))
        nothing = (spot < 0) & (kind is None)
        first = np.zeros(n, bool)
        first[0] = before[0] is None
        # Whole arrays make one frame: a node has few windows, and setting columns one by one costs more than its steps.
        out = {c: rows[c].array.take(order) for c in columns}
        out |= {
            "act": acts, "streak": streak[path, codes], "cooling": cooling[path],
            "last_kind": pd.arrays.IntegerArray(np.where(spot < 0, kind or 0, acts[spot]), nothing),
            "last_ts": pd.arrays.IntegerArray(np.where(spot < 0, when or 0, stamps[spot]), nothing),
            "prev_timestamp": pd.arrays.IntegerArray(np.append(before[0] or 0, stamps[:-1]), first),
            "prev_cpu": np.append(np.nan if before[1] is None else before[1], cpu[:-1]),
            "prev_mem": np.append(np.nan if before[2] is None else before[2], mem[:-1]),
        }
        known = (int(acts[spot[-1]]), int(stamps[spot[-1]])) if spot[-1] >= 0 else (kind, when)
        state.update((walked[-1], *known, int(stamps[-1]), float(cpu[-1]), float(mem[-1])))
        yield pd.DataFrame(out)

    return run


def read_predictions(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(PREDICTION_FEED).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true").parquet(path)
    )


def decisions(predictions: DataFrame, policy: D.Policy = D.Policy()) -> DataFrame:
    """Streaming records with the columns of the batch; all but the machine itself are plain columns. Thresholds and flags
    are made again from the predictions after the machine, so that it passes on those alone."""
    given = predictions.columns
    coded = D.alert_levels(predictions, policy).select(*given, "cpu", "mem", F.expr(
        f"CASE WHEN is_crit THEN {D.CRITICAL} WHEN is_low THEN {D.LOW} ELSE {D.CALM} END").alias("code"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in predictions.schema.fields)
    machine = coded.groupBy("node_id").applyInPandasWithState(
        stepper(policy, given), f"{schema}, {MACHINE}", STATE, "append", GroupStateTimeout.NoTimeout)
    stepped = D.alert_levels(machine, policy)
    prev = F.struct(F.col("prev_timestamp").alias("timestamp"), F.col("prev_cpu").alias("cpu"), F.col("prev_mem").alias("mem"))
    return D.records_of(stepped.withColumn("prev", prev), policy)


def start(decided: DataFrame, out: str, checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Write each micro-batch under its own id: a repeated batch replaces itself."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}

    def write(df: DataFrame, batch_id: int) -> None:
        replace_partitions(df.withColumn("batch", F.lit(batch_id)), out, "batch")

    return decided.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(
        **trigger
    ).foreachBatch(write).start()
