"""Registered queries: streaks, spikes, the scaling state machine and the views over its records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from nodetide.operators import decide as D
from nodetide.operators import features as X
from nodetide.operators import grid as G
from nodetide.plans import telemetry as T
from nodetide.plans.oracle import STEP, r6, with_blocks
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.registry import query

CFG = T.CHECK


def r4(expr: str, alias: str) -> str:
    return f"round({expr} + 1.3e-9, 4) + 0.0 AS {alias}"


def _pct(x: str) -> str:
    return f"printf('%.1f%%', round({x}, 6) * 100)"


_SAY = "'Predicted CPU ' || {cpu} || ' ({w} >= ' || {tc} || '), memory ' || {mem} || ' ({w} >= ' || {tm} || '){end}'"


def _say(w: str, end: str) -> str:
    return _SAY.format(w=w, end=end, cpu=_pct("cpu"), mem=_pct("mem"), tc=_pct(f"{w}_cpu"), tm=_pct(f"{w}_mem"))


_BASE = (f"CASE WHEN is_crit THEN {_say('crit', '.')} WHEN is_warn THEN {_say('warn', ' approaching limit.')} "
         "ELSE 'Utilization within bounds.' END")

BLOCKS = {
    "rates": f"""
        SELECT CASE WHEN machine % 2 = 0 THEN 'alibaba' ELSE 'google' END AS cloud_provider,
               CAST(floor(s / {STEP}) * {STEP} AS BIGINT) AS window_ts, CAST(count(*) AS DOUBLE) AS arrival_rate
        FROM tele GROUP BY 1, 2""",
    "spikes": """
        SELECT *, coalesce(count(arrival_rate) OVER w >= 3 AND arrival_rate > 1.5 * avg(arrival_rate) OVER w, false)
               AS arrival_spike
        FROM rates WINDOW w AS (PARTITION BY cloud_provider ORDER BY window_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "preds": f"""
        SELECT cloud_provider, node_id, f.window_ts + {STEP} AS timestamp, f.window_ts AS observed_timestamp,
               greatest(0.0, least(1.0, cpu)) AS cpu, greatest(0.0, least(1.0, mem)) AS mem,
               cpu_usage_norm AS cur_cpu, mem_usage_norm AS cur_mem, coalesce(arrival_spike, false) AS spike,
               row_number() OVER (PARTITION BY node_id ORDER BY f.window_ts) AS k
        FROM filled f LEFT JOIN spikes s USING (cloud_provider, window_ts)""",
    "levels": """
        SELECT *, cpu >= crit_cpu AS cpu_is_crit, mem >= crit_mem AS mem_is_crit,
               cpu >= crit_cpu OR mem >= crit_mem AS is_crit, cpu >= warn_cpu OR mem >= warn_mem AS is_warn,
               cpu <= 0.30 AND mem <= 0.30 AS is_low,
               CASE WHEN cpu >= crit_cpu OR mem >= crit_mem THEN 'CRITICAL'
                    WHEN cpu >= warn_cpu OR mem >= warn_mem THEN 'WARNING' ELSE 'NORMAL' END AS alert_level
        FROM (SELECT *, CASE cloud_provider WHEN 'google' THEN 0.834 ELSE 0.888 END AS crit_cpu,
                     CASE cloud_provider WHEN 'google' THEN 0.904 ELSE 0.966 END AS crit_mem,
                     CASE cloud_provider WHEN 'google' THEN 0.751 ELSE 0.832 END AS warn_cpu,
                     CASE cloud_provider WHEN 'google' THEN 0.856 ELSE 0.949 END AS warn_mem FROM preds)""",
    "machine": """
        SELECT node_id, CAST(0 AS BIGINT) AS k, 0 AS hi, 0 AS lo, 0 AS cd, 0 AS act, 0 AS streak, false AS cooling
        FROM (SELECT DISTINCT node_id FROM levels)
        UNION ALL
        SELECT node_id, k, CASE WHEN act = 1 THEN 0 ELSE h END, CASE WHEN act = 2 THEN 0 ELSE l END,
               CASE WHEN cd > 0 THEN cd - 1 WHEN act > 0 THEN 3 ELSE 0 END, act,
               CASE act WHEN 1 THEN h WHEN 2 THEN l ELSE 0 END, cd > 0
        FROM (SELECT node_id, k, h, l, cd,
                     CASE WHEN cd > 0 THEN 0 WHEN h >= 2 THEN 1 WHEN l >= 6 THEN 2 ELSE 0 END AS act
              FROM (SELECT v.node_id, v.k, m.cd, CASE WHEN v.is_crit THEN m.hi + 1 ELSE 0 END AS h,
                           CASE WHEN v.is_low THEN m.lo + 1 ELSE 0 END AS l
                    FROM machine m JOIN levels v ON v.node_id = m.node_id AND v.k = m.k + 1))""",
    "records": f"""
        SELECT *, last_value(CASE WHEN act > 0 THEN action END IGNORE NULLS) OVER up AS last_action,
               last_value(CASE WHEN act > 0 THEN timestamp END IGNORE NULLS) OVER up AS last_action_timestamp,
               lag(timestamp) OVER w AS p_ts, lag(pred_cpu_util) OVER w AS p_cpu, lag(pred_mem_util) OVER w AS p_mem,
               lag(timestamp) OVER w = observed_timestamp AND cur_cpu IS NOT NULL AND cur_mem IS NOT NULL AS closes
        FROM (SELECT v.*, act, streak, cooling,
                     CASE act WHEN 1 THEN 'SCALE_UP' WHEN 2 THEN 'SCALE_DOWN' ELSE 'MAINTAIN' END AS action,
                     CASE WHEN act = 1 AND cpu_is_crit THEN 25 * (CASE WHEN spike THEN 2 ELSE 1 END)
                          WHEN act = 2 THEN -10 ELSE 0 END AS cpu_change_pct,
                     CASE WHEN act = 1 AND mem_is_crit THEN 25 * (CASE WHEN spike THEN 2 ELSE 1 END)
                          WHEN act = 2 THEN -10 ELSE 0 END AS mem_change_pct,
                     CASE WHEN act = 2 THEN 'CPU and memory <= 30% for ' || streak || ' windows.'
                          WHEN act = 1 THEN {_BASE} || ' Sustained for ' || streak || ' windows.' ||
                               CASE WHEN spike THEN ' Task arrivals spiking.' ELSE '' END
                          WHEN cooling AND is_crit THEN {_BASE} || ' Cooling down after a recent scaling action.'
                          ELSE {_BASE} END AS reason,
                     {r4('cpu', 'pred_cpu_util')}, {r4('mem', 'pred_mem_util')},
                     {r4('cur_cpu', 'cur_cpu_util')}, {r4('cur_mem', 'cur_mem_util')}
              FROM levels v JOIN machine m ON m.node_id = v.node_id AND m.k = v.k)
        WINDOW w AS (PARTITION BY node_id ORDER BY timestamp),
               up AS (PARTITION BY node_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


def sql(body: str) -> str:
    return with_blocks(body, **BLOCKS)


def spikes(spark, sf):
    return D.arrival_spike(T.arrival_rates(spark, sf))


def predictions(spark, sf):
    """The filled grid's current values as the forecast of the next window."""
    metrics = T.metrics(spark, sf)
    small = X.context_fits(X.provider_spans(metrics, CFG), CFG)
    spike = spikes(spark, sf).select("cloud_provider", "window_ts", F.col("arrival_spike").alias("spike"))
    rows = G.filled_grid(metrics, None, CFG).join(
        F.broadcast(spike) if small else spike, ["cloud_provider", "window_ts"], "left"
    )
    return rows.selectExpr(
        "cloud_provider", "node_id", f"window_ts + {CFG.step} AS timestamp", "window_ts AS observed_timestamp",
        "cpu AS pred_cpu_util", "mem AS pred_mem_util", "cpu_usage_norm AS cur_cpu_util",
        "mem_usage_norm AS cur_mem_util", "coalesce(spike, false) AS spike",
    )


def records(spark, sf):
    return T.staged(spark, ("records", sf, CFG), lambda: D.decide(predictions(spark, sf), CFG), "cloud_provider")


RECORD = ["cloud_provider", "node_id", "timestamp", "action", "cpu_change_pct", "mem_change_pct", "alert_level", "reason",
          "pred_cpu_util", "pred_mem_util", "cur_cpu_util", "cur_mem_util", "last_action", "last_action_timestamp"]


@query("arrival_spike", sql("SELECT * FROM spikes"))
def arrival_spike(spark, sf):
    return spikes(spark, sf)


@query("alert_level", sql(f"""
    SELECT node_id, timestamp, {r6('cpu', 'cpu')}, {r6('mem', 'mem')}, crit_cpu::DOUBLE AS crit_cpu, crit_mem::DOUBLE AS crit_mem,
           warn_cpu::DOUBLE AS warn_cpu, warn_mem::DOUBLE AS warn_mem, alert_level FROM levels"""))
def alert_level(spark, sf):
    rows = D.alert_levels(predictions(spark, sf))
    return settle_all(rows.select("node_id", "timestamp", "cpu", "mem", "crit_cpu", "crit_mem", "warn_cpu", "warn_mem", "alert_level"))


def _run_sql(flag: str) -> str:
    return (f"CASE WHEN {flag} THEN row_number() OVER (PARTITION BY node_id, {flag}_g, {flag} ORDER BY k) ELSE 0 END")


@query("streaks", sql(f"""
    SELECT node_id, timestamp, CAST({_run_sql('is_crit')} AS BIGINT) AS hi, CAST({_run_sql('is_low')} AS BIGINT) AS lo
    FROM (SELECT *, sum(CASE WHEN is_crit THEN 0 ELSE 1 END) OVER w AS is_crit_g,
                 sum(CASE WHEN is_low THEN 0 ELSE 1 END) OVER w AS is_low_g
          FROM levels WINDOW w AS (PARTITION BY node_id ORDER BY k))"""))
def streaks(spark, sf):
    rows = D.alert_levels(predictions(spark, sf)).select("node_id", "timestamp", "is_crit", "is_low")
    return D.run_lengths(rows, {"is_crit": "hi", "is_low": "lo"}, CFG).select("node_id", "timestamp", "hi", "lo")


@query("scaling_decision", sql(f"SELECT {', '.join(RECORD)} FROM records"))
def scaling_decision(spark, sf):
    return D.decide(predictions(spark, sf), CFG).select(*RECORD)


@query("last_action", sql("SELECT node_id, timestamp, last_action, last_action_timestamp FROM records"))
def last_action(spark, sf):
    return records(spark, sf).select("node_id", "timestamp", "last_action", "last_action_timestamp")


@query("previous_window", sql(f"""
    SELECT node_id, timestamp, p_ts AS previous_timestamp, p_cpu AS previous_pred_cpu, p_mem AS previous_pred_mem,
           CASE WHEN closes THEN cur_cpu_util END AS actual_cpu, CASE WHEN closes THEN cur_mem_util END AS actual_mem,
           CASE WHEN closes THEN round(p_cpu - cur_cpu + 1.3e-9, 4) + 0.0 END AS error_cpu,
           CASE WHEN closes THEN round(p_mem - cur_mem + 1.3e-9, 4) + 0.0 END AS error_mem
    FROM records"""))
def previous_window(spark, sf):
    return records(spark, sf).selectExpr(
        "node_id", "timestamp", "previous.timestamp AS previous_timestamp", "previous.pred_cpu_util AS previous_pred_cpu",
        "previous.pred_mem_util AS previous_pred_mem", "previous.actual_cpu_util AS actual_cpu",
        "previous.actual_mem_util AS actual_mem", "previous.error_cpu", "previous.error_mem",
    )


@query("latest_per_node", sql(f"""
    SELECT {', '.join(RECORD)} FROM records QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) = 1"""))
def latest_per_node(spark, sf):
    return D.latest_per_node(records(spark, sf)).select(*RECORD)


@query("node_history", sql("""
    SELECT node_id, timestamp, action, CAST(row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) AS BIGINT) AS age
    FROM records QUALIFY age <= 288"""))
def node_history(spark, sf):
    return D.history(records(spark, sf)).select("node_id", "timestamp", "action", F.col("age").cast("long"))


SUMMARY_SQL = """
    SELECT cloud_provider, timestamp, count(*) AS total, count(*) FILTER (WHERE alert_level = 'CRITICAL') AS critical,
           count(*) FILTER (WHERE alert_level = 'WARNING') AS warning, count(*) FILTER (WHERE action = 'SCALE_UP') AS scale_up,
           count(*) FILTER (WHERE action = 'SCALE_DOWN') AS scale_down, bool_or(spike) AS arrival_spike
    FROM records GROUP BY 1, 2"""


@query("recommendation_summary", sql(SUMMARY_SQL))
def recommendation_summary(spark, sf):
    return D.summary(records(spark, sf))


@query("recommend_batch", sql(f"SELECT {', '.join(RECORD)} FROM records"))
def recommend_batch(spark, sf):
    """Nested batches (rows of a provider and window, some thousand nodes each) through explode and decision."""
    flat = predictions(spark, sf)
    item = F.struct("node_id", "pred_cpu_util", "pred_mem_util", "cur_cpu_util", "cur_mem_util", "spike")
    nodes = T.metrics(spark, sf).agg(F.approx_count_distinct("node_id")).first()[0]
    batches = flat.withColumn("part", F.pmod(F.xxhash64("node_id"), F.lit(nodes // 1000 + 1))).groupBy(
        "cloud_provider", "timestamp", "observed_timestamp", "part"
    ).agg(F.collect_list(item).alias("predictions"))
    exploded = batches.select("cloud_provider", "timestamp", "observed_timestamp", F.inline("predictions"))
    return D.decide(exploded, CFG).select(*RECORD)


@query("alert_feed", sql("""
    SELECT cloud_provider, node_id, timestamp, action, alert_level FROM records
    WHERE alert_level <> 'NORMAL' OR action <> 'MAINTAIN' ORDER BY timestamp DESC, node_id LIMIT 200"""))
def alert_feed(spark, sf):
    return D.alert_feed(records(spark, sf).select("cloud_provider", "node_id", "timestamp", "action", "alert_level"))


@query("rec_filter", sql("""
    SELECT count(*) FILTER (WHERE cloud_provider = 'google' AND alert_level = 'NORMAL') AS shown, count(*) AS total
    FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) = 1)"""))
def rec_filter(spark, sf):
    newest = D.latest_per_node(records(spark, sf))
    return D.shown_of_total(newest, cloud_provider="google", alert_level="NORMAL")


@query("filtered_records", sql(f"""
    SELECT asked, {', '.join(RECORD)} FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) = 1),
           (VALUES ('all', NULL, NULL), ('google', 'google', NULL), ('alibaba', 'alibaba', NULL), ('alibaba up', 'alibaba', 'SCALE_UP')) AS f(asked, cloud, wanted)
    WHERE (cloud IS NULL OR cloud_provider = cloud) AND (wanted IS NULL OR action = wanted)"""))
def filtered_records(spark, sf):
    """The newest record of every node, whole, as each of four filters shows them."""
    newest = D.latest_per_node(records(spark, sf)).select(*RECORD)
    asked = {"all": {}, "google": {"cloud": "google"}, "alibaba": {"cloud": "alibaba"}, "alibaba up": {"cloud": "alibaba", "action": "SCALE_UP"}}
    shown = [D.filter_records(newest, **wanted).withColumn("asked", F.lit(name)) for name, wanted in asked.items()]
    return reduce(lambda x, y: x.unionByName(y), shown)
