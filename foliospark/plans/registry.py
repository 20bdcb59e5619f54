"""Registered queries: a Spark function and, where SQL can say it, its check."""

from __future__ import annotations

import importlib

from ..session import configure

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

MODULES = (
    "selectors",
    "reshaping",
    "storing",
    "joining",
    "counting",
    "rendering",
    "validating",
    "generating",
    "streaming",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark, sf_dir):
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql.strip()
        return fn

    return register


def load_all():
    for module in MODULES:
        importlib.import_module(f"foliospark.plans.{module}")
    return QUERIES, CHECKS
