"""Daily revenue as a stream that loses nothing: emitted days, open days, and a side table of late rows.

Every micro-batch sums its completed trips by day and pickup place and adds
the sums to the open days. A day is emitted, by city, when the watermark (the newest
pickup time of the batches before, less a delay) passes its end. Rows whose day
has been emitted by then, and rows without a pickup time, go to a side table
as they are, for the late-arrival load. Emitted days, open days and the side table
together are the daily revenue of all rows.

Every output is a folder per batch, and a batch reads only folders of
batches before it; a batch that is run again after a failure replaces its own folders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.functions.aggregates import ratio
from farelake.plans.views import Tables, completed_status, pickup_city

SUMS = ("total_trips", "total_revenue", "fares", "driver_earnings", "company_revenue")


def day_sums(trips: DataFrame) -> DataFrame:
    """Mergeable sums by pickup day and place; a day's rows of a place meet as one row per task."""
    return trips.groupBy(F.to_date("pickup_timestamp").alias("trip_date"), "pickup_location_sk").agg(
        F.count(F.lit(1)).alias("total_trips"), F.sum("total_fare").cast("decimal(38,2)").alias("total_revenue"),
        F.count("total_fare").alias("fares"), F.sum("driver_earnings").cast("decimal(38,2)").alias("driver_earnings"),
        F.sum("company_commission").cast("decimal(38,2)").alias("company_revenue"))


def by_city(sums: DataFrame, wh: Tables) -> DataFrame:
    """Daily revenue per city from sums per place."""
    merged = sums.groupBy("trip_date", "pickup_location_sk").agg(*[F.sum(c).alias(c) for c in SUMS])
    return (merged.join(pickup_city(wh), "pickup_location_sk").groupBy("trip_date", "city")
            .agg(*[F.sum(c).alias(c) for c in SUMS])
            .select("trip_date", "city", "total_trips", F.col("total_revenue").cast("decimal(20,2)").alias("total_revenue"),
                    ratio(F.col("total_revenue"), F.col("fares")).alias("avg_fare"),
                    F.col("driver_earnings").cast("decimal(20,2)").alias("driver_earnings"),
                    F.col("company_revenue").cast("decimal(20,2)").alias("company_revenue")))


class RevenueStream:
    """Daily revenue below ``root`` from a stream of fact rows."""

    def __init__(self, spark: SparkSession, root: str, wh: Tables, delay: dt.timedelta = dt.timedelta(days=3)):
        self.spark, self.root, self.wh, self.delay = spark, root.rstrip("/"), wh, delay

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _before(self, name: str, batch: int) -> DataFrame:
        """Rows of the batches before one."""
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch") < batch)

    def _mark(self, before: int) -> dt.datetime | None:
        """The watermark a batch works under: of the batches before it."""
        if before == 0:
            return None
        newest = self._before("marks", before).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def add(self, rows: DataFrame, batch: int) -> None:
        """Work off one micro-batch (``foreachBatch``)."""
        mark = self._mark(batch)
        done = rows.where(F.col("trip_status_sk") == completed_status(self.wh))
        # A day is closed when it ended at or before the mark.
        closed = F.lit(False) if mark is None else F.coalesce(
            F.date_add(F.to_date("pickup_timestamp"), 1).cast("timestamp_ntz") <= F.lit(mark), F.lit(False))
        late = closed | F.col("pickup_timestamp").isNull()
        self._write(done.where(late), "late", batch)
        self._write(day_sums(done.where(~late)), "open", batch)
        self._write(rows.agg(F.max("pickup_timestamp").alias("newest")), "marks", batch)
        after = self._mark(batch + 1)
        ends = F.date_add("trip_date", 1).cast("timestamp_ntz")
        sums = self._before("open", batch + 1)
        emitted = sums.where(F.lit(False) if after is None else ends <= F.lit(after))
        if mark is not None:
            emitted = emitted.where(ends > F.lit(mark))
        self._write(by_city(emitted, self.wh), "days", batch)

    def run(self, trips: DataFrame, checkpoint: str) -> None:
        """Work off a stream of fact rows until its source is used up."""
        job = (trips.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        job.awaitTermination()

    def days(self) -> DataFrame:
        """Emitted days."""
        return self.spark.read.parquet(f"{self.root}/days").drop("batch")

    def late(self) -> DataFrame:
        """Rows behind the watermark and rows without a pickup time."""
        return self.spark.read.parquet(f"{self.root}/late").drop("batch")

    def revenue(self) -> DataFrame:
        """Daily revenue of all rows so far: emitted and open days' sums and the side table."""
        return by_city(self.spark.read.parquet(f"{self.root}/open").drop("batch").unionByName(day_sums(self.late())), self.wh)
