"""Shared blocks of the checking SQL (DuckDB dialect), combined by name."""

from __future__ import annotations

import re

STEP = 3600
METRICS = ("cpu", "mem")


def r6(expr: str, alias: str) -> str:
    """Rounding that mirrors `settled`."""
    return f"round({expr} + 1.3e-9, 6) + 0.0 AS {alias}"


BLOCKS: dict[str, str] = {
    "tele": """
        SELECT user_id // 10 AS machine, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s, event_type, value,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
        FROM events""",
    "usage_a": f"""
        SELECT CAST(machine AS VARCHAR) AS machine_id,
               CAST(floor(s / {STEP}) * {STEP} AS BIGINT) AS window_ts,
               avg(value) / 100.0 AS cpu_usage_norm, avg(k) / 100.0 AS mem_usage_norm, count(*) AS n_records
        FROM tele WHERE machine % 2 = 0 AND value BETWEEN 0 AND 100 AND k BETWEEN 0 AND 100
        GROUP BY 1, 2""",
    "usage_b": f"""
        SELECT CAST(machine AS VARCHAR) AS machine_id,
               CAST(floor(s / {STEP}) * {STEP} AS BIGINT) AS window_ts,
               sum(value / 100) AS cpu_sum, sum(k / 100) AS mem_sum, count(*) AS n_records
        FROM tele WHERE machine % 2 = 1 AND value >= 0 AND k >= 0
        GROUP BY 1, 2""",
    "capacity": """
        SELECT machine_id, cap_cpu, cap_mem FROM (
            SELECT CAST(c_custkey // 10 AS VARCHAR) AS machine_id,
                   max(c_acctbal / 5000) AS cap_cpu, max(c_acctbal / 5000) AS cap_mem
            FROM customer WHERE c_custkey % 10 < 2 GROUP BY 1)
        WHERE cap_cpu > 0 AND cap_mem > 0""",
    "unified": """
        SELECT cloud_provider, cloud_provider || '_' || machine_id AS node_id, machine_id, window_ts,
               cpu_usage_norm, mem_usage_norm, n_records
        FROM (
            SELECT 'alibaba' AS cloud_provider, * FROM usage_a
            UNION ALL BY NAME
            SELECT 'google' AS cloud_provider, machine_id, window_ts,
                   least(1.0, cpu_sum / cap_cpu) AS cpu_usage_norm,
                   least(1.0, mem_sum / cap_mem) AS mem_usage_norm, n_records
            FROM usage_b JOIN capacity USING (machine_id))""",
    "thresholds": """
        SELECT cloud_provider,
               quantile_disc(cpu_usage_norm, 0.95) AS cpu95, quantile_disc(cpu_usage_norm, 0.99) AS cpu99,
               quantile_disc(mem_usage_norm, 0.95) AS mem95, quantile_disc(mem_usage_norm, 0.99) AS mem99
        FROM unified GROUP BY 1""",
    "classified": """
        SELECT * FROM (
            SELECT u.*, CASE WHEN mem_usage_norm >= mem99 THEN 'MEM_CRIT'
                             WHEN cpu_usage_norm >= cpu99 THEN 'CPU_CRIT'
                             WHEN cpu_usage_norm >= cpu95 THEN 'CPU_HIGH'
                             WHEN mem_usage_norm >= mem95 THEN 'MEM_HIGH'
                             WHEN CAST('0x' || substr(md5(node_id || '|' || window_ts), 1, 8) AS UBIGINT)
                                  / 4294967296.0 < 0.002 THEN 'HEARTBEAT' END AS reason
            FROM unified u JOIN thresholds USING (cloud_provider))
        WHERE reason IS NOT NULL""",
    "lines": """
        SELECT cloud_provider, node_id, window_ts, reason,
               strftime(make_timestamp((CAST(1767225600 AS BIGINT) + window_ts) * 1000000), '%Y-%m-%d %H:%M:%S') ||
               CASE WHEN cloud_provider = 'alibaba' THEN ' | ' ||
                   CASE WHEN reason LIKE '%CRIT' THEN 'ERROR' WHEN reason LIKE '%HIGH' THEN 'WARNING' ELSE 'INFO' END
                   || ' | alibaba-node-' || machine_id || ' | ' ||
                   CASE reason WHEN 'MEM_CRIT' THEN 'Out of Memory risk. Container eviction imminent!'
                               WHEN 'CPU_CRIT' THEN 'CPU throttling triggered! Usage at saturation'
                               WHEN 'CPU_HIGH' THEN 'High CPU load on node'
                               WHEN 'MEM_HIGH' THEN 'High memory pressure on node'
                               ELSE 'System heartbeat normal.' END
               ELSE ' [' ||
                   CASE WHEN reason LIKE '%CRIT' THEN 'CRITICAL' WHEN reason LIKE '%HIGH' THEN 'WARN' ELSE 'INFO' END
                   || '] gcp-host-' || machine_id || ' : ' ||
                   CASE reason WHEN 'MEM_CRIT' THEN 'OOM Killer invoked.'
                               WHEN 'CPU_CRIT' THEN 'CPU saturation detected.'
                               WHEN 'CPU_HIGH' THEN 'CPU load above normal.'
                               WHEN 'MEM_HIGH' THEN 'Memory usage above normal.'
                               ELSE 'active_tasks=' || n_records END
               END AS log_line
        FROM classified""",
    "sev": """
        SELECT node_id, window_ts, max(CASE WHEN reason LIKE '%CRIT' THEN 2 ELSE 1 END) AS sev
        FROM classified WHERE reason <> 'HEARTBEAT' GROUP BY 1, 2""",
    "bounds": """
        SELECT cloud_provider, min(window_ts) AS lo, max(window_ts) AS hi FROM unified GROUP BY 1""",
    "grid": f"""
        SELECT cloud_provider, node_id, CAST(unnest(range(lo, hi + 1, {STEP})) AS BIGINT) AS window_ts
        FROM (SELECT cloud_provider, node_id, min(window_ts) AS lo, max(window_ts) AS hi FROM unified GROUP BY 1, 2)""",
    "filled": """
        SELECT g.cloud_provider, g.node_id, g.window_ts, u.cpu_usage_norm, u.mem_usage_norm, u.n_records,
               u.cpu_usage_norm IS NOT NULL AS observed, CAST(coalesce(sev, 0) AS INTEGER) AS sev,
               last_value(cpu_usage_norm IGNORE NULLS) OVER w AS cpu,
               last_value(mem_usage_norm IGNORE NULLS) OVER w AS mem,
               last_value(n_records IGNORE NULLS) OVER w AS n_rec,
               row_number() OVER (PARTITION BY g.node_id ORDER BY g.window_ts) AS rn
        FROM grid g LEFT JOIN unified u ON u.node_id = g.node_id AND u.window_ts = g.window_ts
             LEFT JOIN sev l ON l.node_id = g.node_id AND l.window_ts = g.window_ts
        WINDOW w AS (PARTITION BY g.node_id ORDER BY g.window_ts
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "context": f"""
        SELECT *, CASE WHEN window_ts - lag(window_ts) OVER w = {STEP}
                       THEN cl_cpu_mean - lag(cl_cpu_mean) OVER w ELSE 0.0 END AS cl_cpu_d1,
               CASE WHEN window_ts - lag(window_ts) OVER w = {STEP}
                       THEN cl_mem_mean - lag(cl_mem_mean) OVER w ELSE 0.0 END AS cl_mem_d1
        FROM (SELECT cloud_provider, window_ts, avg(cpu_usage_norm) AS cl_cpu_mean,
                     coalesce(stddev_samp(cpu_usage_norm), 0.0) AS cl_cpu_std, avg(mem_usage_norm) AS cl_mem_mean,
                     coalesce(stddev_samp(mem_usage_norm), 0.0) AS cl_mem_std
              FROM unified GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY cloud_provider ORDER BY window_ts)""",
}

LAGS, MEANS, SPREADS, HORIZONS = (1, 2, 3, 6, 12), (6, 12, 72), (6, 12, 72), (1, 6, 12)


def _frame(n: int) -> str:
    return f"(PARTITION BY node_id ORDER BY window_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ROW = "(PARTITION BY node_id ORDER BY window_ts)"
LAG_SQL = [f"lag({m}, {k}) OVER {_ROW} AS {m}_lag{k}" for m in METRICS for k in LAGS]
LAG_SQL.append(f"lag(n_rec, 1) OVER {_ROW} AS n_rec_lag1")
MEAN_SQL = [f"avg({m}) OVER {_frame(n)} AS {m}_mean{n}" for m in METRICS for n in MEANS]
MEAN_SQL.append(f"avg(n_rec) OVER {_frame(12)} AS n_rec_mean12")
STD_SQL = [f"stddev_pop({m}) OVER {_frame(n)} AS {m}_std{n}" for m in METRICS for n in SPREADS]
EXTREMA_SQL = [f"max({m}) OVER {_frame(n)} AS {m}_max{n}" for m in METRICS for n in SPREADS]
EXTREMA_SQL += [f"min({m}) OVER {_frame(12)} AS {m}_min12" for m in METRICS]
COUNT_SQL = [
    f"CAST(sum(CASE WHEN sev = {s} THEN 1 ELSE 0 END) OVER {_frame(n)} AS BIGINT) AS {name}_cnt{n}"
    for n in (6, 12) for s, name in ((1, "warn"), (2, "err"))
]
LABEL_SQL = [f"lead({m}_usage_norm, {h}) OVER {_ROW} AS y_{m}_h{h}" for m in METRICS for h in HORIZONS]
TIME_SQL = [f"{f}((window_ts % 86400) / 86400.0 * 2 * pi()) AS tod_{f}" for f in ("sin", "cos")]

BLOCKS["base"] = f"""
        SELECT cloud_provider, node_id, window_ts, observed, cpu, mem, n_rec, rn, {', '.join(TIME_SQL)},
               {', '.join(LAG_SQL + MEAN_SQL + STD_SQL + EXTREMA_SQL + COUNT_SQL + LABEL_SQL)}
        FROM filled"""


def _derived(m: str) -> list[str]:
    out = [f"{m} - {m}_lag{k} AS {m}_d{k}" for k in (1, 3, 12)]
    out.append(f"({m} - {m}_lag1) - ({m}_lag1 - {m}_lag2) AS {m}_accel")
    out += [f"{m} - {m}_mean{n} AS {m}_dev{n}" for n in MEANS]
    out += [
        f"{m}_mean6 - {m}_mean12 AS {m}_slope_short", f"{m}_mean12 - {m}_mean72 AS {m}_slope_long",
        f"{m}_max12 - {m}_min12 AS {m}_range12",
        f"greatest(-5.0, least(5.0, ({m} - {m}_mean72) / ({m}_std72 + 1e-6))) AS {m}_z72",
    ]
    return out


DERIVED_SQL = _derived("cpu") + _derived("mem") + ["n_rec - n_rec_lag1 AS n_rec_d1"]
DERIVED_NAMES = [d.rsplit(" AS ", 1)[1] for d in DERIVED_SQL]
BASE_NAMES = [
    e.rsplit(" AS ", 1)[1] for e in TIME_SQL + LAG_SQL + MEAN_SQL + STD_SQL + EXTREMA_SQL + COUNT_SQL
]
LABEL_NAMES = [e.rsplit(" AS ", 1)[1] for e in LABEL_SQL]
CONTEXT_NAMES = [f"cl_{m}_{s}" for m in METRICS for s in ("mean", "std", "d1")] + ["cpu_vs_cl", "mem_vs_cl"]
FEATURE_NAMES = ["cpu", "mem", "n_rec"] + CONTEXT_NAMES + BASE_NAMES + DERIVED_NAMES
COUNT_NAMES = ("n_rec", "n_rec_lag1", "n_rec_d1", "warn_cnt6", "err_cnt6", "warn_cnt12", "err_cnt12")

BLOCKS["observed_rows"] = f"""
        SELECT b.*, cl_cpu_mean, cl_cpu_std, cl_cpu_d1, cl_mem_mean, cl_mem_std, cl_mem_d1,
               cpu - cl_cpu_mean AS cpu_vs_cl, mem - cl_mem_mean AS mem_vs_cl, {', '.join(DERIVED_SQL)}
        FROM base b JOIN context USING (cloud_provider, window_ts)
        WHERE observed AND rn > 72"""
SPLIT_CASE = f"""CASE WHEN window_ts < lo + 0.70 * (hi - lo) - {12 * STEP} THEN 'train'
                    WHEN window_ts >= lo + 0.70 * (hi - lo) AND window_ts < lo + 0.85 * (hi - lo) - {12 * STEP} THEN 'val'
                    WHEN window_ts >= lo + 0.85 * (hi - lo) THEN 'test' END"""
BLOCKS["features"] = f"""
        SELECT * FROM (SELECT o.*, {SPLIT_CASE} AS split FROM observed_rows o JOIN bounds USING (cloud_provider))
        WHERE split IS NOT NULL"""

# The features of a whole day: 288 steps back, so rows need that many before them.
DAY_SQL = [f"lag({m}, 288) OVER {_ROW} AS {m}_lag288" for m in METRICS] + [f"avg({m}) OVER {_frame(288)} AS {m}_mean288" for m in METRICS]
DAY_NAMES = [e.rsplit(" AS ", 1)[1] for e in DAY_SQL] + [f"{m}_{s}" for m in METRICS for s in ("dev288", "dday")]
BLOCKS["day_windows"] = f"SELECT node_id, window_ts, {', '.join(DAY_SQL)} FROM filled"
BLOCKS["day_features"] = """
        SELECT f.*, d.* EXCLUDE (node_id, window_ts), cpu - cpu_mean288 AS cpu_dev288, cpu - cpu_lag288 AS cpu_dday,
               mem - mem_mean288 AS mem_dev288, mem - mem_lag288 AS mem_dday
        FROM features f JOIN day_windows d ON d.node_id = f.node_id AND d.window_ts = f.window_ts WHERE rn > 288"""


def with_blocks(body: str, **extra: str) -> str:
    """Prefix `body` with the blocks it uses, in the order they depend on each other."""
    blocks = {**BLOCKS, **extra}
    order: list[str] = []
    open_blocks: set[str] = set()

    def visit(text: str) -> None:
        for name in blocks:
            if name not in open_blocks and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                open_blocks.add(name)
                visit(blocks[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return ("WITH RECURSIVE " if "machine" in order else "WITH ") + ",\n".join(f"{n} AS ({blocks[n]})" for n in order) + "\n" + body
