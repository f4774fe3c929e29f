"""Scaling decisions: thresholds, streaks, the per-node state machine, records and summaries.

The machine depends on its own past (an action resets the streak and starts a cooldown), but it has only a few dozen
states. A node's history is therefore cut into chunks: every chunk is first reduced to "which state does each
possible start state end in", these small tables are chained per node, and then all chunks are replayed at once from
their known start state. No task walks a whole node's history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodetide import config as C
from nodetide.config import TraceConfig
from nodetide.functions.expressions import clamp01, settled
from nodetide.session import written
from nodetide.operators.grid import chunk_id

ACTIONS = ("MAINTAIN", "SCALE_UP", "SCALE_DOWN")
CALM, CRITICAL, LOW, PAD = 0, 1, 2, 3


@dataclass(frozen=True)
class Policy:
    up_streak: int = C.UP_STREAK
    down_streak: int = C.DOWN_STREAK
    cooldown: int = C.COOLDOWN
    low: float = C.LOW_UTIL


# ------------------------------------------------------------------ state machine
def advance(state: tuple[int, int, int], code: int, policy: Policy) -> tuple[tuple[int, int, int], int, int]:
    """One window: (high streak, low streak, cooldown) and a code to the next state, the action and its streak."""
    hi, lo, wait = state
    hi = hi + 1 if code == CRITICAL else 0
    lo = lo + 1 if code == LOW else 0
    if wait > 0:
        return (hi, lo, wait - 1), 0, 0
    if hi >= policy.up_streak:
        return (0, lo, policy.cooldown), 1, hi
    if lo >= policy.down_streak:
        return (hi, 0, policy.cooldown), 2, lo
    return (hi, lo, 0), 0, 0


@lru_cache(maxsize=8)
def tables(policy: Policy):
    """All reachable states as arrays: next state, action and streak by (state, code), cooldown by state."""
    states, index, moves = [(0, 0, 0)], {(0, 0, 0): 0}, {}
    for state in states:  # grows while it is walked
        for code in (CALM, CRITICAL, LOW):
            nxt, action, streak = advance(state, code, policy)
            if nxt not in index:
                index[nxt] = len(states)
                states.append(nxt)
            moves[index[state], code] = (index[nxt], action, streak)
    n = len(states)
    nxt = np.tile(np.arange(n)[:, None], (1, 4))
    action, streak = np.zeros((n, 4), dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
    for (s, code), (to, a, k) in moves.items():
        nxt[s, code], action[s, code], streak[s, code] = to, a, k
    return nxt, action, streak, np.array([s[2] > 0 for s in states])


def _codes(texts: pd.Series) -> np.ndarray:
    """Code strings to one matrix, short ones padded with a code that changes nothing."""
    rows = [np.frombuffer(t.encode("ascii"), dtype=np.uint8) - 48 for t in texts]
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), PAD, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _chunk_map(policy: Policy):
    """Per chunk: end state and the position and kind of the last action, for every start state."""

    @F.pandas_udf("struct<ends:array<int>,kinds:array<int>,spots:array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        nxt, action, _, _ = tables(policy)
        codes = _codes(texts)
        state = np.tile(np.arange(nxt.shape[0]), (len(texts), 1))
        kind, spot = np.zeros_like(state), np.full_like(state, -1)
        for t in range(codes.shape[1]):
            c = codes[:, t][:, None]
            a = action[state, c]
            kind, spot = np.where(a > 0, a, kind), np.where(a > 0, t, spot)
            state = nxt[state, c]
        return pd.DataFrame({"ends": list(state), "kinds": list(kind), "spots": list(spot)})

    return run


def _replay(policy: Policy):
    """Per chunk and known start state: action, its streak, cooldown flag and position of the last action, per row."""

    @F.pandas_udf("struct<acts:array<int>,streaks:array<int>,cools:array<boolean>,spots:array<int>>")
    def run(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        nxt, action, streak, cooling = tables(policy)
        codes = _codes(texts)
        state = starts.to_numpy(dtype=np.int64)
        spot = np.full(len(texts), -1, dtype=np.int64)
        steps = []
        for t in range(codes.shape[1]):
            c = codes[:, t]
            a = action[state, c]
            spot = np.where(a > 0, t, spot)
            steps.append((a, streak[state, c], cooling[state], spot))
            state = nxt[state, c]
        sizes = texts.str.len()
        columns = [np.array(x).T for x in zip(*steps)]
        return pd.DataFrame({
            name: [row[:n] for row, n in zip(values, sizes)]
            for name, values in zip(("acts", "streaks", "cools", "spots"), columns)
        })

    return run


CHAIN_SCHEMA = ("node_id string, chunk bigint, start int, past_kind int, past_ts bigint, "
                "prev_timestamp bigint, prev_cpu double, prev_mem double")


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the chunk tables in (node, chunk) order, handing each chunk the state its node has reached."""
    node, state, kind, when, prev = None, 0, 0, None, (None, None, None)
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.node_id != node:
                node, state, kind, when, prev = r.node_id, 0, 0, None, (None, None, None)
            out.append((node, r.chunk, state, kind, when, *prev))
            if r.kinds[state]:
                kind, when = int(r.kinds[state]), int(r.stamps[r.spots[state]])
            state = int(r.ends[state])
            prev = (int(r.last_timestamp), r.last_cpu, r.last_mem)
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in CHAIN_SCHEMA.split(", ")])
        for c in ("past_ts", "prev_timestamp"):
            frame[c] = frame[c].astype("Int64")
        yield frame


# --------------------------------------------------------------------- thresholds
def threshold(metric: str, multiple: int, provider: Column) -> Column:
    """1 - multiple x RMSE of the provider's model, 4 digits; unknown providers use the default RMSE."""
    i = {"cpu": 0, "mem": 1}[metric]
    value = F.lit(round(1.0 - multiple * C.DEFAULT_RMSE[i], 4))
    for name, rmse in C.MODEL_RMSE.items():
        value = F.when(F.lower(provider) == name, round(1.0 - multiple * rmse[i], 4)).otherwise(value)
    return value


def alert_levels(predictions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Clamped predictions with their thresholds, flags and alert level."""
    p = F.col("cloud_provider")
    rows = predictions.withColumns({
        "cpu": clamp01(F.col("pred_cpu_util")), "mem": clamp01(F.col("pred_mem_util")),
        **{f"{word}_{m}": threshold(m, k, p) for word, k in (("crit", 2), ("warn", 3)) for m in ("cpu", "mem")},
    })
    rows = rows.withColumns({
        "cpu_is_crit": F.expr("cpu >= crit_cpu"), "mem_is_crit": F.expr("mem >= crit_mem"),
        "is_warn": F.expr("cpu >= warn_cpu OR mem >= warn_mem"),
        "is_low": F.expr(f"cpu <= {policy.low}D AND mem <= {policy.low}D"),
    })
    return rows.withColumns({
        "is_crit": F.expr("cpu_is_crit OR mem_is_crit"),
        "alert_level": F.expr(
            "CASE WHEN cpu_is_crit OR mem_is_crit THEN 'CRITICAL' WHEN is_warn THEN 'WARNING' ELSE 'NORMAL' END"
        ),
    })


def arrival_spike(rates: DataFrame) -> DataFrame:
    """Whether a window's arrivals exceed 1.5 times the mean of up to 12 earlier ones (at least 3).

    The input is one row per provider and window, so a partition holds one trace's windows.
    """
    before = Window.partitionBy("cloud_provider").orderBy("window_ts").rowsBetween(-C.SPIKE_WINDOW, -1)
    enough = F.count("arrival_rate").over(before) >= C.SPIKE_MIN
    high = F.col("arrival_rate") > C.SPIKE_FACTOR * F.avg("arrival_rate").over(before)
    return rates.withColumn("arrival_spike", F.coalesce(enough & high, F.lit(False)))


def run_lengths(rows: DataFrame, flags: dict[str, str], cfg: TraceConfig, ts: str = "timestamp") -> DataFrame:
    """Length of the run of rows up to this one where a flag holds, per node; `flags` maps a flag to the column made.

    Runs are counted inside each chunk; a run that crosses a chunk border gets the open run of the chunks before it,
    taken from one row per chunk. All flags share the pass over the chunks and the table of carried runs.
    """
    series = Window.partitionBy("node_id", "chunk").orderBy(ts)
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("chunk", chunk_id(F.col(ts), cfg)).withColumn("_at", F.row_number().over(series))
    for f in flags:  # the last row without the flag, by its number in the chunk: 0 where there is none yet
        local = local.withColumn(f"_stop_{f}", F.coalesce(F.max(F.when(~F.col(f), F.col("_at"))).over(so_far), F.lit(0)))
    order = Window.partitionBy("node_id").orderBy("chunk")
    carried = local.groupBy("node_id", "chunk").agg(
        F.max("_at").alias("_n"), *[F.max(f"_stop_{f}").alias(f"_end_{f}") for f in flags])
    done = F.sum("_n").over(order)
    for f in flags:  # rows before the chunk, less those up to the last stop
        stop = F.max(F.when(F.col(f"_end_{f}") > 0, done - F.col("_n") + F.col(f"_end_{f}"))).over(order)
        carried = carried.withColumn(f"_open_{f}", done - F.coalesce(stop, F.lit(0)))
    carried = carried.select("node_id", "chunk", *[F.coalesce(F.lag(f"_open_{f}").over(order), F.lit(0)).alias(f"_carry_{f}") for f in flags])
    whole = {
        name: (F.col("_at") - F.col(f"_stop_{f}") + F.when(F.col(f"_stop_{f}") > 0, 0).otherwise(F.col(f"_carry_{f}"))).cast("long")
        for f, name in flags.items()
    }
    return local.join(carried, ["node_id", "chunk"]).withColumns(whole).drop(
        "chunk", "_at", *[f"_{k}_{f}" for f in flags for k in ("stop", "carry")])


# ------------------------------------------------------------------------ records
def percent_text(x: str, pattern: str = "0.0") -> str:
    return f"concat(format_number(round({x}, 6) * 100, '{pattern}'), '%')"


def reason_sql(policy: Policy) -> str:
    both = "concat('Predicted CPU ', {cpu}, ' ({word} >= ', {t_cpu}, '), memory ', {mem}, ' ({word} >= ', {t_mem}, '){end}')"

    def say(word: str, end: str) -> str:
        return both.format(word=word, end=end, cpu=percent_text("cpu"), mem=percent_text("mem"),
                           t_cpu=percent_text(f"{word}_cpu"), t_mem=percent_text(f"{word}_mem"))

    base = (f"CASE WHEN is_crit THEN {say('crit', '.')} WHEN is_warn THEN {say('warn', ' approaching limit.')} "
            "ELSE 'Utilization within bounds.' END")
    low = percent_text(f"{policy.low}D", "0")
    return f"""CASE
        WHEN act = 2 THEN concat('CPU and memory <= ', {low}, ' for ', streak, ' windows.')
        WHEN act = 1 THEN concat({base}, ' Sustained for ', streak, ' windows.',
                                 CASE WHEN spike THEN ' Task arrivals spiking.' ELSE '' END)
        WHEN cooling AND is_crit THEN concat({base}, ' Cooling down after a recent scaling action.')
        ELSE {base} END"""


def decide(predictions: DataFrame, cfg: TraceConfig, policy: Policy = Policy()) -> DataFrame:
    """Records per node and window.

    predictions: cloud_provider, node_id, timestamp, observed_timestamp, pred_cpu_util, pred_mem_util, cur_cpu_util,
    cur_mem_util, spike; at most one row per node and timestamp. The payload is shuffled once, by (node, chunk), and
    written: the chunk tables and the replay read it from there, so the input is computed once.
    """
    lowest = min(1.0 - 2.0 * r for pair in (*C.MODEL_RMSE.values(), C.DEFAULT_RMSE) for r in pair)
    if policy.low >= lowest:
        raise ValueError("a window must not be low and critical at once")
    flagged = alert_levels(predictions, policy).withColumn(
        "code", F.expr(f"CASE WHEN is_crit THEN '{CRITICAL}' WHEN is_low THEN '{LOW}' ELSE '{CALM}' END")
    )
    payload = ["timestamp", *[c for c in flagged.columns if c not in ("node_id", "timestamp")]]
    packed = written(
        flagged.withColumn("chunk", chunk_id(F.col("timestamp"), cfg))
        .groupBy("node_id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("rows"))
        .withColumn("codes", F.expr("array_join(transform(rows, r -> r.code), '')")),
        "decision-chunks",
    )
    chunk_tables = packed.select(
        "node_id", "chunk", F.expr("transform(rows, r -> r.timestamp)").alias("stamps"),
        F.expr("element_at(rows, -1)").alias("tail"), _chunk_map(policy)("codes").alias("m"),
    ).selectExpr(
        "node_id", "chunk", "stamps", "m.ends", "m.kinds", "m.spots",
        "tail.timestamp AS last_timestamp", "tail.cpu AS last_cpu", "tail.mem AS last_mem",
    )
    starts = (
        chunk_tables.repartition("node_id").sortWithinPartitions("node_id", "chunk").mapInPandas(_chain, CHAIN_SCHEMA)
    )
    replayed = (
        packed.join(starts, ["node_id", "chunk"])
        .withColumn("out", _replay(policy)("codes", "start"))
        .selectExpr("node_id", "rows", "past_kind", "past_ts", "prev_timestamp", "prev_cpu", "prev_mem", "out.*")
    )
    rows = replayed.selectExpr(
        "node_id", "rows", "acts", "streaks", "cools",
        "transform(spots, s -> CASE WHEN s >= 0 THEN rows[s].timestamp ELSE past_ts END) AS last_ts",
        "transform(spots, s -> CASE WHEN s >= 0 THEN acts[s] ELSE past_kind END) AS last_kind",
        """concat(
            array(named_struct('timestamp', prev_timestamp, 'cpu', prev_cpu, 'mem', prev_mem)),
            transform(slice(rows, 1, size(rows) - 1),
                      r -> named_struct('timestamp', r.timestamp, 'cpu', r.cpu, 'mem', r.mem))) AS prev""",
    ).selectExpr("node_id", "inline(arrays_zip(rows, acts, streaks, cools, last_ts, last_kind, prev))")
    flat = rows.selectExpr(
        "node_id", "rows.*", "acts AS act", "streaks AS streak", "cools AS cooling", "last_ts", "last_kind", "prev"
    )
    return records_of(flat, policy)


def records_of(rows: DataFrame, policy: Policy) -> DataFrame:
    """Final columns of a record from the machine's output."""
    def pct(metric: str) -> Column:
        return F.expr(f"""CASE WHEN act = 1 AND {metric}_is_crit THEN {C.UP_PCT} * (CASE WHEN spike THEN 2 ELSE 1 END)
                               WHEN act = 2 THEN -{C.DOWN_PCT} ELSE 0 END""")

    def word(kind: str) -> Column:
        return F.expr(f"CASE {kind} WHEN 1 THEN 'SCALE_UP' WHEN 2 THEN 'SCALE_DOWN' END")

    pred = {m: settled(F.col(m), 4) for m in ("cpu", "mem")}
    was = {m: settled(F.col(f"prev.{m}"), 4) for m in ("cpu", "mem")}
    closes = F.expr("prev.timestamp = observed_timestamp AND cur_cpu_util IS NOT NULL AND cur_mem_util IS NOT NULL")
    previous = F.struct(
        F.col("prev.timestamp").alias("timestamp"),
        *[
            c
            for m in ("cpu", "mem")
            for c in (
                was[m].alias(f"pred_{m}_util"),
                F.when(closes, settled(F.col(f"cur_{m}_util"), 4)).alias(f"actual_{m}_util"),
                F.when(closes, settled(was[m] - F.col(f"cur_{m}_util"), 4)).alias(f"error_{m}"),
            )
        ],
    )
    return rows.select(
        "cloud_provider", "node_id", "timestamp",
        F.coalesce(word("act"), F.lit("MAINTAIN")).alias("action"),
        pct("cpu").alias("cpu_change_pct"), pct("mem").alias("mem_change_pct"),
        "alert_level",
        F.expr(reason_sql(policy)).alias("reason"),
        pred["cpu"].alias("pred_cpu_util"), pred["mem"].alias("pred_mem_util"),
        settled(F.col("cur_cpu_util"), 4).alias("cur_cpu_util"),
        settled(F.col("cur_mem_util"), 4).alias("cur_mem_util"),
        word("last_kind").alias("last_action"),
        F.col("last_ts").alias("last_action_timestamp"),
        F.when(F.col("prev.timestamp").isNotNull(), previous).alias("previous"),
        "spike",
    )


# ------------------------------------------------------------- views over records
def summary(records: DataFrame) -> DataFrame:
    """One row per provider and batch."""
    return records.groupBy("cloud_provider", "timestamp").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("alert_level") == "CRITICAL").alias("critical"),
        F.count_if(F.col("alert_level") == "WARNING").alias("warning"),
        F.count_if(F.col("action") == "SCALE_UP").alias("scale_up"),
        F.count_if(F.col("action") == "SCALE_DOWN").alias("scale_down"),
        F.max("spike").alias("arrival_spike"),
    )


def latest_per_node(records: DataFrame) -> DataFrame:
    """Newest record of each node; partial maxima run before the shuffle."""
    fields = [c for c in records.columns if c != "node_id"]
    return records.groupBy("node_id").agg(
        F.max_by(F.struct(*fields), "timestamp").alias("r")
    ).select("node_id", "r.*")


def history(records: DataFrame, n: int = C.HISTORY_PER_NODE) -> DataFrame:
    """The newest n records of each node; Spark cuts to n per node before the shuffle as well."""
    newest = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("timestamp")))
    return records.withColumn("age", newest).filter(F.col("age") <= n)


def alert_feed(records: DataFrame, n: int = C.ALERT_FEED_LIMIT) -> DataFrame:
    """Newest alerts and actions first."""
    return records.filter("alert_level <> 'NORMAL' OR action <> 'MAINTAIN'").orderBy(
        F.desc("timestamp"), "node_id"
    ).limit(n)


def filter_records(records: DataFrame, cloud: str | None = None, action: str | None = None,
                   alert: str | None = None) -> DataFrame:
    wanted = {"cloud_provider": cloud, "action": action, "alert_level": alert}
    for column, value in wanted.items():
        if value is not None:
            records = records.filter(F.col(column) == value)
    return records


def shown_of_total(records: DataFrame, **wanted: str) -> DataFrame:
    """How many of the newest records a filter shows, and how many there are."""
    keep = F.lit(True)
    for column, value in wanted.items():
        keep = keep & (F.col(column) == value)
    return records.agg(F.count_if(keep).alias("shown"), F.count(F.lit(1)).alias("total"))
