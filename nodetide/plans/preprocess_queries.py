"""Registered queries: sources, sinks, preprocessing and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodetide.config import INSTANCE_PROVIDER, PERCENT_PROVIDER
from nodetide.functions.expressions import bucket, clamp01, node_key, settled_sql
from nodetide.operators import logs as L
from nodetide.operators import preprocess as P
from nodetide.plans import telemetry as T
from nodetide.plans.oracle import STEP, r6, with_blocks
from nodetide.plans.registry import query
from nodetide.session import scratch_path
from nodetide.sources import readers as R
from nodetide.sources import writers as W

CFG = T.CHECK
TYPED_SQL = with_blocks("""
    SELECT CAST(machine AS VARCHAR) AS machine_id, s AS ts, value AS cpu, k AS mem
    FROM tele WHERE machine % 2 = 0""")
UNIFIED_SQL = with_blocks(f"""
    SELECT cloud_provider, node_id, machine_id, window_ts, {r6('cpu_usage_norm', 'cpu_usage_norm')},
           {r6('mem_usage_norm', 'mem_usage_norm')}, n_records FROM unified""")


def settle(df, *columns):
    """Round the given double columns for the comparison, keep the rest."""
    return df.selectExpr(*[settled_sql(c) if c in columns else c for c in df.columns])


def settle_all(df):
    return settle(df, *[f.name for f in df.schema.fields if f.dataType.typeName() == "double"])


# --------------------------------------------------------------------- sources
@query("scan_percent_usage", TYPED_SQL)
def scan_percent_usage(spark, sf):
    path = scratch_path(spark, "usage-csv")
    T.percent_raw(spark, sf).write.csv(path)
    return P.PERCENT.typed(R.read_percent_usage(spark, path))


@query("scan_percent_usage_header", TYPED_SQL)
def scan_percent_usage_header(spark, sf):
    path = scratch_path(spark, "usage-csv-header")
    T.percent_raw(spark, sf).select(
        "mem_util_percent", "time_stamp", "machine_id", "cpu_util_percent"
    ).write.option("header", "true").csv(path)
    return P.PERCENT.typed(R.read_percent_usage(spark, path))


@query("scan_preagg_usage", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('cpu_sum', 'cpu_sum')}, {r6('mem_sum', 'mem_sum')}, n_records FROM usage_b"""))
def scan_preagg_usage(spark, sf):
    path = scratch_path(spark, "preagg-csv")
    rolled = P.rollup_sum(P.INSTANCES.typed(T.instance_raw(spark, sf)), CFG.step)
    rolled.write.option("header", "true").option("compression", "gzip").csv(path)
    return settle_all(P.PREAGGREGATED.typed(R.read_headed_csv(spark, f"{path}/*.csv*", R.PREAGG_SCHEMA)))


@query("preagg_unified", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('cpu_usage_norm', 'cpu_usage_norm')},
           {r6('mem_usage_norm', 'mem_usage_norm')}, n_records FROM unified WHERE cloud_provider = 'google'"""))
def preagg_unified(spark, sf):
    usage, capacity = scratch_path(spark, "preagg-usage"), scratch_path(spark, "preagg-capacity")
    P.rollup_sum(P.INSTANCES.typed(T.instance_raw(spark, sf)), CFG.step).write.option("header", "true").csv(usage)
    T.machine_events(spark, sf).select(
        "machine_id", F.col("capacity.cpus").alias("cap_cpu"), F.col("capacity.memory").alias("cap_mem")
    ).write.option("header", "true").option("compression", "gzip").csv(capacity)
    return settle_all(P.preaggregated_usage(
        R.read_headed_csv(spark, usage, R.PREAGG_SCHEMA),
        P.capacity_from_table(R.read_headed_csv(spark, capacity, R.CAPACITY_SCHEMA)),
    ))


@query("scan_nested_json", with_blocks(f"""
    SELECT CAST(machine AS VARCHAR) AS machine_id, CAST(s AS DOUBLE) AS ts, {r6('value / 100', 'cpu')}, {r6('k / 100', 'mem')}
    FROM tele WHERE machine % 2 = 1"""))
def scan_nested_json(spark, sf):
    path = scratch_path(spark, "usage-json")
    T.instance_raw(spark, sf).write.option("compression", "gzip").json(path)
    return settle_all(P.INSTANCES.typed(R.read_json_lines(spark, f"{path}/*.json*", R.INSTANCE_SCHEMA)))


@query("scan_log_text", with_blocks("SELECT log_line AS value FROM lines"))
def scan_log_text(spark, sf):
    path = scratch_path(spark, "syslog")
    T.log_lines(spark, sf).select("log_line").write.text(path)
    return R.read_log_text(spark, path)


@query("scan_partitioned", with_blocks(f"""
    SELECT cloud_provider, node_id, window_ts, {r6('cpu_usage_norm', 'cpu_usage_norm')}
    FROM unified WHERE cloud_provider = 'google'"""))
def scan_partitioned(spark, sf):
    path = scratch_path(spark, "unified")
    W.write_partitioned(T.unified(spark, sf), path)
    return settle_all(R.read_table(spark, path, INSTANCE_PROVIDER).select(
        "cloud_provider", "node_id", "window_ts", "cpu_usage_norm"
    ))


# ----------------------------------------------------------------------- sinks
@query("write_partitioned", UNIFIED_SQL)
def write_partitioned(spark, sf):
    path = scratch_path(spark, "unified")
    W.write_partitioned(T.unified(spark, sf), path)
    return settle_all(R.read_table(spark, path))


@query("write_log_text", with_blocks("""
    SELECT node_id, window_ts, sev FROM sev"""))
def write_log_text(spark, sf):
    """Both formats, each to its own folder, read back and parsed."""
    lines, found = T.log_lines(spark, sf), {}
    for provider in CFG.providers:
        path = scratch_path(spark, "syslog")
        W.write_log_text(lines.filter(F.col("cloud_provider") == provider).select("log_line"), path)
        found[provider] = R.read_log_text(spark, path)
    return L.severity_max(L.parse_all(found))


# ------------------------------------------------- projections, filters, rollups
@query("typed_projection", TYPED_SQL)
def typed_projection(spark, sf):
    return P.PERCENT.typed(T.percent_raw(spark, sf))


@query("drop_incomplete", with_blocks("""
    SELECT CAST(machine AS VARCHAR) AS machine_id, s AS ts, value AS cpu, k AS mem
    FROM tele WHERE machine % 2 = 0 AND event_type <> 'error'"""))
def drop_incomplete(spark, sf):
    """Readings of error events are blanked to text that is no number, then dropped."""
    blank = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    raw = T.events(spark, sf).filter("machine % 2 = 0").select(
        F.col("machine").cast("string").alias("machine_id"),
        F.col("s").cast("string").alias("time_stamp"),
        blank.alias("cpu_util_percent"),
        F.col("k").cast("string").alias("mem_util_percent"),
    )
    return P.drop_incomplete(P.PERCENT.typed(raw))


@query("sentinel_filter", with_blocks("""
    SELECT CAST(machine AS VARCHAR) AS machine_id, s AS ts, value AS cpu, k AS mem
    FROM tele WHERE machine % 2 = 0 AND value BETWEEN 0 AND 100 AND k BETWEEN 0 AND 100"""))
def sentinel_filter(spark, sf):
    return P.PERCENT.in_range(P.PERCENT.typed(T.percent_raw(spark, sf)))


@query("unit_normalise", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('least(1.0, cpu_sum / cap_cpu)', 'cpu_usage_norm')},
           {r6('least(1.0, mem_sum / cap_mem)', 'mem_usage_norm')}, n_records
    FROM usage_b JOIN capacity USING (machine_id)"""))
def unit_normalise(spark, sf):
    rolled = P.rollup_sum(P.INSTANCES.typed(T.instance_raw(spark, sf)), CFG.step)
    capacity = P.capacity_from_events(T.machine_events(spark, sf))
    return settle_all(P.normalised(P.with_capacity(rolled, capacity)))


@query("node_key", with_blocks("""
    SELECT CASE WHEN machine % 2 = 0 THEN 'alibaba_' ELSE 'google_' END || CAST(machine AS VARCHAR) AS node_id, count(*) AS n
    FROM tele GROUP BY 1"""))
def node_key_query(spark, sf):
    provider = F.when(F.expr("machine % 2 = 0"), PERCENT_PROVIDER).otherwise(INSTANCE_PROVIDER)
    key = node_key(provider, F.col("machine").cast("string"))
    return T.events(spark, sf).groupBy(key.alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


@query("tumbling_bucket", with_blocks(f"""
    SELECT CAST(floor(s / {STEP}) * {STEP} AS BIGINT) AS hour_ts, CAST(floor(s / 300) * 300 AS BIGINT) AS five_min_ts,
           count(*) AS n FROM tele GROUP BY 1, 2"""))
def tumbling_bucket(spark, sf):
    s = F.col("s")
    return T.events(spark, sf).groupBy(
        bucket(s, STEP).alias("hour_ts"), bucket(s, 300).alias("five_min_ts")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("clamp01", with_blocks("""
    SELECT s, machine, greatest(0.0, least(1.0, (value - 50) / 100)) AS x FROM tele"""))
def clamp01_query(spark, sf):
    return T.events(spark, sf).select("s", "machine", clamp01((F.col("value") - 50) / 100).alias("x"))


@query("window_rollup_avg", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('cpu_usage_norm', 'cpu_usage_norm')},
           {r6('mem_usage_norm', 'mem_usage_norm')}, n_records FROM usage_a"""))
def window_rollup_avg(spark, sf):
    return settle_all(P.percent_usage(T.percent_raw(spark, sf), CFG))


@query("window_rollup_sum", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('cpu_sum', 'cpu_sum')}, {r6('mem_sum', 'mem_sum')}, n_records FROM usage_b"""))
def window_rollup_sum(spark, sf):
    return settle_all(P.rollup_sum(P.INSTANCES.typed(T.instance_raw(spark, sf)), CFG.step))


@query("capacity_max", with_blocks("SELECT * FROM capacity"))
def capacity_max(spark, sf):
    return P.capacity_from_events(T.machine_events(spark, sf))


@query("capacity_join", with_blocks(f"""
    SELECT machine_id, window_ts, {r6('cpu_sum', 'cpu_sum')}, {r6('mem_sum', 'mem_sum')}, n_records, cap_cpu, cap_mem
    FROM usage_b JOIN capacity USING (machine_id)"""))
def capacity_join(spark, sf):
    rolled = P.rollup_sum(P.INSTANCES.typed(T.instance_raw(spark, sf)), CFG.step)
    joined = P.with_capacity(rolled, P.capacity_from_events(T.machine_events(spark, sf)))
    return settle(joined, "cpu_sum", "mem_sum")


@query("union_by_name", with_blocks("""
    SELECT cloud_provider, machine_id, window_ts, n_records FROM unified"""))
def union_by_name(spark, sf):
    return T.unified(spark, sf).select("cloud_provider", "machine_id", "window_ts", "n_records")


@query("unified_usage", UNIFIED_SQL)
def unified_usage(spark, sf):
    return settle_all(T.unified(spark, sf))


@query("trace_summary", with_blocks("""
    SELECT cloud_provider, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT node_id) AS machines,
           round(count(*) / count(DISTINCT node_id), 0) AS windows_per_machine, min(window_ts) AS min_ts,
           max(window_ts) AS max_ts, round(avg(cpu_usage_norm), 3) AS avg_cpu, round(avg(mem_usage_norm), 3) AS avg_mem
    FROM unified GROUP BY 1"""))
def trace_summary(spark, sf):
    return P.trace_summary(T.unified(spark, sf))


# ------------------------------------------------------------------------ logs
@query("approx_quantiles", with_blocks("SELECT * FROM thresholds"))
def approx_quantiles(spark, sf):
    return L.log_thresholds(T.metrics(spark, sf))


@query("log_classify", with_blocks("SELECT node_id, window_ts, reason FROM classified"))
def log_classify(spark, sf):
    return T.classified(spark, sf).select("node_id", "window_ts", "reason")


@query("log_render", with_blocks("SELECT node_id, window_ts, reason, log_line FROM lines"))
def log_render(spark, sf):
    return T.log_lines(spark, sf).select("node_id", "window_ts", "reason", "log_line")


@query("log_reason_counts", with_blocks("""
    SELECT cloud_provider, reason, count(*) AS lines FROM classified GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2"""))
def log_reason_counts(spark, sf):
    return L.reason_counts(T.classified(spark, sf))


PARSED = {
    "parsed": """
        SELECT 'alibaba_' || regexp_extract(log_line, '\\| alibaba-node-(\\S+) \\|', 1) AS node_id,
               regexp_extract(log_line, '^([0-9: -]{19}) ', 1) AS t,
               regexp_extract(log_line, '^[0-9: -]{19} \\| (\\w+) \\|', 1) AS level
        FROM lines WHERE cloud_provider = 'alibaba'
        UNION ALL
        SELECT 'google_' || regexp_extract(log_line, '\\] gcp-host-(\\S+) :', 1),
               regexp_extract(log_line, '^([0-9: -]{19}) ', 1),
               regexp_extract(log_line, '^[0-9: -]{19} \\[(\\w+)\\]', 1)
        FROM lines WHERE cloud_provider = 'google'""",
}


@query("log_parse", with_blocks("""
    SELECT node_id, CAST(epoch(strptime(t, '%Y-%m-%d %H:%M:%S')) AS BIGINT) - 1767225600 AS window_ts,
           CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 2 ELSE 1 END AS sev
    FROM parsed WHERE level <> 'INFO'""", **PARSED))
def log_parse(spark, sf):
    return T.parsed_logs(spark, sf)


@query("log_severity_max", with_blocks("SELECT * FROM sev"))
def log_severity_max(spark, sf):
    return L.severity_max(T.parsed_logs(spark, sf))
