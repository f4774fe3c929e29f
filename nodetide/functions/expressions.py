"""Column expressions shared by batch and stream."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind of a feature by the statistic in its name: `level` is measured like the metric itself, `plain` has no unit, all
# others are changes. Names are (context_)metric(_statistic), the statistic with its number of steps.
KINDS = {"": "level", "lag": "level", "mean": "level", "max": "level", "min": "level", "z": "plain"}
UNITLESS = ("tod", "warn", "err")
COUNTS = "n_rec"
CONTEXT_PREFIX, CONTEXT_LEVELS = "cl_", ("mean",)
NAME = re.compile(r"(?P<context>cl_)?(?P<metric>n_rec|[a-z]+)(?:_(?P<statistic>[a-z_]*?)\d*)?$")


def bucket(ts: Column, step: int) -> Column:
    """Start of the tumbling window that holds second `ts`."""
    return (F.floor(ts / step) * step).cast("long")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clamp01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def node_key(provider: Column, machine: Column) -> Column:
    return F.concat_ws("_", provider, machine)


def stable_uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the values only, so a recomputed task draws the same one."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def kind_of(feature: str) -> tuple[str, str]:
    """(kind, metric) of a feature."""
    parts = NAME.match(feature)
    statistic, metric = parts["statistic"] or "", parts["metric"]
    if metric in UNITLESS:
        return "plain", metric
    if parts["context"] and statistic not in CONTEXT_LEVELS:
        return "change", metric
    return KINDS.get(statistic, "change"), metric


def metric_of(feature: str) -> str:
    """Metric a feature is measured in."""
    return kind_of(feature)[1]


def scaled(feature: str, mode: str) -> str:
    """SQL text that puts one feature on the scale shared by all providers.

    The provider's statistics are columns of the same row (`mu_*`, `sd_*`, `dsd_*`). `mode` picks the unit of
    changes: `spread` = deviation of the level, `delta` = deviation of the one-step change. Counts have one unit.
    """
    kind, metric = kind_of(feature)
    column = "n" if metric == COUNTS else metric
    unit = f"sd_{column}" if kind == "level" or metric == COUNTS else change_unit(metric, mode) if kind == "change" else ""
    return {"plain": feature, "level": f"({feature} - mu_{column}) / {unit}", "change": f"{feature} / {unit}"}[kind]


def change_unit(metric: str, mode: str) -> str:
    return {"delta": f"dsd_{metric}", "spread": f"sd_{metric}"}[mode]


def settled(x: Column, digits: int = 6) -> Column:
    """Rounded for reports: the tiny shift keeps decimal ties and minus zero the same on every engine."""
    return F.round(x + F.lit(1.3e-9), digits) + F.lit(0.0)


def settled_sql(name: str, digits: int = 6) -> str:
    return f"round({name} + 1.3e-9D, {digits}) + 0D AS {name}"
