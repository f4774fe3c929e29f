"""Window features of a stream from state alone: a ring buffer for each node in Spark's state store.

A node's state is the last grid steps it has seen (gaps filled forward), and for every frame exact running sums and monotone
queues of candidates for the extrema. A new window moves each of them by one step; no history is read. Values enter the sums
as whole numbers of 2^-60, so a sum is exact however long the stream runs: the value that leaves takes away just what it
brought, and a frame of equal values has spread zero. Rows older than a node's last window come out as late ones.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nodetide.config import TraceConfig
from nodetide.operators import features as X
from nodetide.session import ship_package
from nodetide.sources.writers import replace_partitions
from nodetide.streaming import feature_stream as FS

METRICS = X.METRICS
UNIT_BITS = 60
COUNT_FRAMES = (6, 12)
COUNT_MEAN = 12


def _units(x: float) -> int:
    return round(math.ldexp(x, UNIT_BITS))


@dataclass
class Frame:
    """The last `size` values of one metric."""

    size: int
    total: int = 0
    squares: int = 0
    high: deque = field(default_factory=deque)  # (step, value), values falling
    low: deque = field(default_factory=deque)

    def move(self, step: int, value: float, entering: int, leaving: int | None) -> None:
        self.total += entering
        self.squares += entering * entering
        if leaving is not None:
            self.total -= leaving
            self.squares -= leaving * leaving
        for queue, beaten in ((self.high, lambda old: old <= value), (self.low, lambda old: old >= value)):
            while queue and beaten(queue[-1][1]):
                queue.pop()
            queue.append((step, value))
            if queue[0][0] <= step - self.size:
                queue.popleft()

    @property
    def mean(self) -> float:
        return math.ldexp(self.total / self.size, -UNIT_BITS)

    @property
    def spread(self) -> float:
        over = self.size * self.squares - self.total * self.total
        return math.sqrt(over / (self.size * self.size << 2 * UNIT_BITS))


class Series:
    """State of one node."""

    def __init__(self, cfg: TraceConfig):
        self.step, self.reach = cfg.step, cfg.history_windows
        self.sizes = cfg.means
        self.clear()

    def clear(self) -> None:
        self.last: int | None = None  # grid step of the newest window
        self.held = 0  # steps in the ring
        self.ring: deque = deque(maxlen=self.reach)  # (cpu, mem, n_rec, sev, observed), filled
        self.units: dict[str, deque] = {m: deque(maxlen=max(self.sizes) + 1) for m in METRICS}
        self.frames = {m: {n: Frame(n) for n in self.sizes} for m in METRICS}

    def _push(self, cpu, mem, n_rec, sev: int, observed: bool) -> None:
        before = self.ring[-1] if self.ring else (None, None, None)
        cpu, mem, n_rec = (new if new is not None else old for new, old in zip((cpu, mem, n_rec), before))
        self.ring.append((cpu, mem, n_rec, sev, observed))
        self.held += 1
        for m, value in zip(METRICS, (cpu, mem)):
            if value is None:
                continue
            past = self.units[m]
            entering = _units(value)
            for n, frame in self.frames[m].items():
                frame.move(self.held, value, entering, past[-n] if len(past) >= n else None)
            past.append(entering)

    def add(self, window_ts: int, cpu, mem, n_rec, sev: int) -> bool:
        """Take the node's row of a window; False if the node is already past it."""
        at = window_ts // self.step
        if self.last is not None and at <= self.last:
            return False
        if self.last is None and cpu is None and mem is None:
            return True  # log lines of a node without metrics yet: no frame will reach them
        if self.last is not None and at - self.last > self.reach:
            filled = self.ring[-1][:3]
            self.clear()
            for _ in range(self.reach - 1):
                self._push(*filled, 0, False)
        elif self.last is not None:
            for _ in range(at - self.last - 1):
                self._push(None, None, None, 0, False)
        self._push(cpu, mem, n_rec, sev, cpu is not None)
        self.last = at
        return True

    def ready(self, warmup: int) -> bool:
        """Whether one of the two oldest windows that a frame can begin with was observed."""
        ring = self.ring
        return ring[-1][4] and any(len(ring) > back and ring[-1 - back][4] for back in range(warmup, self.reach))

    def features(self, cfg: TraceConfig) -> dict:
        """All features of the newest window that do not depend on other nodes."""
        ring = self.ring
        out = {"cpu": ring[-1][0], "mem": ring[-1][1], "n_rec": ring[-1][2]}
        for i, m in enumerate(METRICS):
            frames = self.frames[m]
            out |= {f"{m}_lag{k}": ring[-1 - k][i] for k in cfg.lags}
            out |= {f"{m}_mean{n}": frames[n].mean for n in cfg.means}
            out |= {f"{m}_std{n}": frames[n].spread for n in cfg.spreads}
            out |= {f"{m}_max{n}": frames[n].high[0][1] for n in cfg.spreads}
            out[f"{m}_min12"] = frames[12].low[0][1]
        recent = [ring[-1 - k] for k in range(max(*COUNT_FRAMES, COUNT_MEAN))]
        out["n_rec_lag1"], out["n_rec_mean12"] = ring[-2][2], sum(r[2] for r in recent[:COUNT_MEAN]) / COUNT_MEAN
        for n in COUNT_FRAMES:
            for code, name in ((1, "warn"), (2, "err")):
                out[f"{name}_cnt{n}"] = sum(r[3] == code for r in recent[:n])
        return out


def _types(cfg: TraceConfig) -> dict[str, str]:
    """The features' columns in the order of the batch table's base columns."""
    types = {"cpu": "double", "mem": "double", "n_rec": "long"}
    for m in METRICS:
        types |= {f"{m}_{s}": "double" for s in [*[f"lag{k}" for k in cfg.lags], *[f"mean{n}" for n in cfg.means], *[f"std{n}" for n in cfg.spreads],
                                                 *[f"max{n}" for n in cfg.spreads], "min12"]}
    types |= {"n_rec_lag1": "long", "n_rec_mean12": "double"}
    return types | {f"{name}_cnt{n}": "long" for n in COUNT_FRAMES for name in ("warn", "err")}


def output_schema(cfg: TraceConfig) -> str:
    fields = {"node_id": "string", "window_ts": "long", "cpu_usage_norm": "double", "mem_usage_norm": "double", "late": "boolean", "ready": "boolean"}
    return ", ".join(f"{n} {t}" for n, t in (fields | _types(cfg)).items())


class NodeFeatures(StatefulProcessor):
    """Keeps one `Series` a node and gives a row for each row that comes in: with features where the node is ready."""

    def __init__(self, cfg: TraceConfig):
        self.cfg, self.names = cfg, list(_types(cfg))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802 (Spark's name)
        known = self.state.get() if self.state.exists() else None
        series = pickle.loads(bytes(known[0])) if known else Series(self.cfg)
        for r in sorted(rows, key=lambda r: r["window_ts"]):
            taken = series.add(r["window_ts"], r["cpu_usage_norm"], r["mem_usage_norm"], r["n_records"], r["sev"] or 0)
            ready = taken and r["cpu_usage_norm"] is not None and series.ready(self.cfg.warmup)
            found = series.features(self.cfg) if ready else {}
            yield Row(node_id=key[0], window_ts=r["window_ts"], cpu_usage_norm=r["cpu_usage_norm"], mem_usage_norm=r["mem_usage_norm"],
                      late=not taken, ready=ready, **{n: found.get(n) for n in self.names})
        self.state.update((pickle.dumps(series, pickle.HIGHEST_PROTOCOL),))

    def close(self) -> None:
        pass


CONTEXT_SCHEMA = "window_ts bigint, " + ", ".join(f"cl_{m}_{s} double" for m in METRICS for s in ("mean", "std")) + ", " + FS.PLACE
LATE_SCHEMA = "node_id string, window_ts bigint, cpu_usage_norm double, mem_usage_norm double, batch bigint"


def _context(job: FS.StreamJob, rows: DataFrame, lo: int) -> DataFrame:
    """Cluster context of the batch's windows; the change since the window before the first is taken from the kept table."""
    spark, cloud = rows.sparkSession, F.lit(job.cloud).alias("cloud_provider")
    own = X.cluster_context(rows.where("NOT late AND cpu_usage_norm IS NOT NULL").select(cloud, "window_ts", "cpu_usage_norm", "mem_usage_norm"))
    own = spark.createDataFrame(own.collect(), own.schema)  # a row a window of the batch
    kept = job.between(spark, "context", CONTEXT_SCHEMA, lo - job.cfg.step, lo - job.cfg.step).select(cloud, *[c for c in own.columns if c != "cloud_provider"])
    replace_partitions(job.placed(own.drop("cloud_provider")), job.path("context"), "block", "w")
    return X.context_delta(own.unionByName(kept), job.cfg)


def process_batch(job: FS.StreamJob, batch: DataFrame, batch_id: int) -> None:
    """Context, derived features, predictions and live error of the windows of one micro-batch, which holds them whole.

    Windows before the job's first one only feed state and context.
    """
    spark, cfg = batch.sparkSession, job.cfg
    batch = batch.persist()
    try:
        windows = sorted(r[0] for r in batch.where("NOT late").select("window_ts").distinct().collect())
        late = batch.where("late").select("node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm").withColumn("batch", F.lit(batch_id).cast("bigint"))
        replace_partitions(late, job.path("late"), "batch")
        if not windows:
            return
        context = _context(job, batch, windows[0])
        scored = [w for w in windows if w >= job.first_window]
        if scored:
            ready = batch.where("ready").where(F.col("window_ts") >= job.first_window).withColumn("cloud_provider", F.lit(job.cloud))
            features = X.with_derived(X.join_context(X.with_clock(ready), context, True), cfg).drop("cpu_usage_norm", "mem_usage_norm", "late", "ready")
            FS.write_scores(job, features, batch.where("NOT late"), scored, batch_id)
    finally:
        batch.unpersist()


def start(job: FS.StreamJob, feed: DataFrame, seconds: int | None = 5, name: str = "incremental-predictions") -> StreamingQuery:
    """Run the stream: every `seconds`, or once over all that is there when None."""
    spark = feed.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed.select(*FS.FEED_COLUMNS).groupBy("node_id").transformWithState(
        statefulProcessor=NodeFeatures(job.cfg), outputStructType=output_schema(job.cfg), outputMode="Append", timeMode="None")
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return (
        rows.writeStream.queryName(name).option("checkpointLocation", job.path("checkpoint")).outputMode("append").trigger(**trigger)
        .foreachBatch(lambda df, batch_id: process_batch(job, df, batch_id)).start()
    )


def late_rows(spark, job: FS.StreamJob) -> DataFrame:
    path = job.path("late")
    return spark.read.schema(LATE_SCHEMA).parquet(path) if FS.exists(spark, path) else spark.createDataFrame([], LATE_SCHEMA)
