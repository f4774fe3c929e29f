"""Settings of the pipeline, and every value that is fixed by the data formats."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------- fixed values
# Provider names, as they appear in `cloud_provider`, node keys and log lines.
PERCENT_PROVIDER = "alibaba"
INSTANCE_PROVIDER = "google"
PROVIDERS = (PERCENT_PROVIDER, INSTANCE_PROVIDER)

# Log clock: trace second 0 is this wall-clock time (UTC).
LOG_EPOCH = "2026-01-01 00:00:00"
LOG_EPOCH_SECONDS = 1767225600
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
HEARTBEAT_SHARE = 0.002

# Log line patterns: timestamp, level, machine.
LOG_TIME_PATTERN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
LOG_PATTERNS = {
    "alibaba": "^" + LOG_TIME_PATTERN + r" \| (\w+) \| alibaba-node-(\S+) \| .*$",
    "google": "^" + LOG_TIME_PATTERN + r" \[(\w+)\] gcp-host-(\S+) : .*$",
}

# Level vocabulary and message per provider and reason.
LOG_LEVELS = {
    "alibaba": {"CRIT": "ERROR", "HIGH": "WARNING", "OTHER": "INFO"},
    "google": {"CRIT": "CRITICAL", "HIGH": "WARN", "OTHER": "INFO"},
}
LOG_MESSAGES = {
    "alibaba": {
        "MEM_CRIT": "Out of Memory risk. Container eviction imminent!",
        "CPU_CRIT": "CPU throttling triggered! Usage at saturation",
        "CPU_HIGH": "High CPU load on node",
        "MEM_HIGH": "High memory pressure on node",
        "HEARTBEAT": "System heartbeat normal.",
    },
    "google": {
        "MEM_CRIT": "OOM Killer invoked.",
        "CPU_CRIT": "CPU saturation detected.",
        "CPU_HIGH": "CPU load above normal.",
        "MEM_HIGH": "Memory usage above normal.",
    },
}
SEVERITY_ERROR = ("ERROR", "CRITICAL")
SEVERITY_WARN = ("WARN", "WARNING")

# Column names of the percent-scale usage file when it has no header.
PERCENT_COLUMNS = (
    "machine_id", "time_stamp", "cpu_util_percent", "mem_util_percent",
    "mem_gps", "mkpi", "net_in", "net_out", "disk_io_percent",
)

# Decision policy.
MODEL_RMSE = {"google": (0.083, 0.048), "alibaba": (0.056, 0.017)}
DEFAULT_RMSE = (0.075, 0.075)
LOW_UTIL = 0.30
UP_STREAK, DOWN_STREAK, COOLDOWN = 2, 6, 3
SPIKE_FACTOR, SPIKE_WINDOW, SPIKE_MIN = 1.5, 12, 3
UP_PCT, DOWN_PCT = 25, 10
HISTORY_PER_NODE = 288
ALERT_FEED_LIMIT = 200

# Columns of the older per-row modelling table.
MODELING_COLUMNS = (
    "cpu_usage_norm", "mem_usage_norm", "time_delta_sec", "error_count",
    "task_arrival_count", "instance_arrival_count", "cpu_lag_1", "cpu_lag_2",
    "cpu_avg_5m", "cpu_avg_15m", "mem_lag_1", "mem_lag_2", "mem_avg_5m", "mem_avg_15m",
    "task_lag_1", "instance_lag_1", "task_avg_5m", "instance_avg_5m", "task_avg_15m",
)
MODELING_DERIVED = (
    "cpu_d1", "cpu_d2", "cpu_accel", "cpu_dev5", "cpu_trend", "mem_d1", "mem_d2",
    "mem_dev5", "mem_trend", "task_d1", "task_trend", "inst_d1", "cpu_mem_gap", "err_per_task",
)
# ----------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class TraceConfig:
    """Time grid and feature settings.

    ``chunk_steps`` is the number of grid steps one task works on at a time: per-node series are cut into
    chunks of that length, each with enough rows of its neighbours to compute every window exactly.
    ``context_broadcast_rows`` is the largest cluster-context table that may be broadcast.
    """

    step: int = 300
    horizons: tuple[int, ...] = (1, 6, 12)
    use_day: bool = True
    chunk_steps: int = 2016
    context_broadcast_rows: int = 500_000
    providers: tuple[str, ...] = PROVIDERS

    @property
    def lags(self) -> tuple[int, ...]:
        return (1, 2, 3, 6, 12) + ((288,) if self.use_day else ())

    @property
    def means(self) -> tuple[int, ...]:
        return (6, 12, 72) + ((288,) if self.use_day else ())

    @property
    def spreads(self) -> tuple[int, ...]:
        return (6, 12, 72)

    @property
    def lookback(self) -> int:
        """Steps before a row that its features reach back to."""
        return max(self.lags + self.means)

    @property
    def warmup(self) -> int:
        return 288 if self.use_day else 72

    @property
    def lookahead(self) -> int:
        return max(self.horizons)

    @property
    def gap(self) -> int:
        """Seconds kept free before a split boundary so that labels never cross it."""
        return self.lookahead * self.step

    @property
    def history_windows(self) -> int:
        """Windows a stream must keep to compute the newest window's features."""
        return self.warmup + 2

    def with_(self, **changes) -> "TraceConfig":
        return replace(self, **changes)
