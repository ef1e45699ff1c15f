"""The fact load as a stream: each micro-batch of staging files is one increment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from farelake.plans.increment import IncrementalLoad
from farelake.plans.views import Tables

# Sources of an increment that may have no new rows in a batch.
LOGS = ("driver_attributes", "rider_attributes", "raw_payments")


def stream_facts(job: IncrementalLoad, staging: DataFrame, others: Callable[[int], Tables], checkpoint: str, first: int = 1) -> None:
    """Load a stream of staging rows until its source is used up.

    ``others`` gives the other sources of a batch: new rows of ``LOGS`` (empty ones for none),
    places and holidays. Micro-batch n is batch ``first`` + n of the load. The stream's checkpoint delivers an unfinished
    micro-batch again with its number, and a batch run again replaces what it wrote, so no row is
    lost or added twice. ``first`` belongs to the checkpoint and must not change with it.
    """
    def add(rows: DataFrame, number: int) -> None:
        batch = first + number
        job.add({**others(batch), "staging_raw_trips": rows}, batch)

    run = (staging.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    run.awaitTermination()
