"""Every query by name, over the mapped test tables, with its check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelake.sources.samples import SampleWarehouse, cte_chain

QUERIES: dict[str, Callable[[SampleWarehouse], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed clocks of the test tables: trips end in 2001, events in January 2024.
TRIP_CLOCK = "2001-07-31 12:00:00"
EVENT_CLOCK = "2024-01-31 12:00:00"


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(wh)`` under ``name``; ``sql`` may use the mappings in ``tables``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            chain = cte_chain(*tables) if tables else ""
            if text.startswith("with recursive "):
                text = "with recursive " + chain.removeprefix("with ") + ",\n" + text.removeprefix("with recursive ")
            elif text.startswith("with "):
                text = chain + ",\n" + text.removeprefix("with ") if chain else text
            else:
                text = f"{chain}\n{text}"
            ORACLES[name] = text
        return fn

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](SampleWarehouse(spark, sf_dir))

    run.__name__ = name
    return run


def load() -> None:
    """Import the modules that register queries."""
    from farelake.catalog import access, kpis, loads, streams, trips  # noqa: F401
