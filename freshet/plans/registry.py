"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


from freshet.plans import bulletins, derived, gauges, hierarchy, hydrology, matching, outlines, payloads, places, rainfall, reports, stateful, streams  # noqa: E402, F401
