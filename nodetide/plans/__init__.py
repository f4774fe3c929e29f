"""Registered queries over the given tables."""

import functools
import importlib

from nodetide.session import ship_package

MODULES = ("preprocess_queries", "feature_queries", "model_queries", "decision_queries", "report_queries",
           "training_queries", "stream_queries")


def _with_package(fn):
    """The query, after its workers were given this package."""

    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def registered():
    """All queries and their checking SQL, by name."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from nodetide.plans.registry import ORACLE, QUERIES

    return {name: _with_package(fn) for name, fn in QUERIES.items()}, dict(ORACLE)
