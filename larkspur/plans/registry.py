"""Where queries are registered, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.tables import VIEWS, frame, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str | None, function: Callable[..., DataFrame], *ctes: str) -> None:
    """Register function of the frames named in views; sql reads them, and ctes, by the same names. A stored table is a frame too."""
    names = views.split()
    QUERIES[name] = lambda spark, sf_dir: function(*[frame(spark, sf_dir, VIEWS.get(v, f"SELECT * FROM {{{v}}}")) for v in names])
    if sql:
        heads = [f"{v} AS ({plain(VIEWS[v])})" for v in names if v in VIEWS] + list(ctes)
        ORACLES[name] = (f"WITH {', '.join(heads)} " if heads else "") + sql
