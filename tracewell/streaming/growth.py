"""Streams (T-a to T-f): growth of a bank from a stream of routes, resumable sinks, running scores.

State is tables in the shared folder. A micro-batch replaces a table by a new version and then moves the pointer to it, so a batch
that dies half-way leaves the old version, and a batch that runs twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators.bank import KEY, merge_routes, new_signatures, normalized_route, summary_scoped
from tracewell.session import exists
from tracewell.sources.sinks import append_history

ROUTES = "category string, intent string, reasoning_path array<string>, _at long"


class Versions:
    """A table with versions below a path; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def newest(self) -> tuple[int, str] | None:
        """(version, name) of the newest version; null only if none was ever written. A folder that can't be read is an error, not an empty table."""
        if not exists(self.spark, self.path + "/pointer"):
            return None
        got = self.spark.read.text(self.path + "/pointer").agg(F.max_by("value", F.split("value", "\\|")[0].cast("long")).alias("v")).first()["v"]
        return (int(got.split("|")[0]), got.split("|")[1]) if got else None

    def read(self) -> DataFrame:
        newest = self.newest()
        if newest is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{newest[1]}")

    def replace(self, df: DataFrame, version: int) -> None:
        name = f"{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{name}")
        self.spark.createDataFrame([(f"{version}|{name}",)], "value string").coalesce(1).write.mode("append").text(self.path + "/pointer")


BANK = "category string, intent string, path_pos int, reasoning_path array<string>"


class BankGrowth:
    """T-b, T-c, T-d: new routes wait until there are `threshold` of them, are then merged into the bank, and the bank may be rebuilt.

    The bank is read anew by each micro-batch, so rows of one batch all see the bank as it was before the batch.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int, rebuild: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.bank = Versions(spark, path + "/bank", BANK)
        self.pending = Versions(spark, path + "/pending", ROUTES)
        self.history = path.rstrip("/") + "/history"
        self.threshold, self.rebuild = threshold, rebuild

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """df: route (struct), gold_matches_answer, and _at for the order. A batch that comes again after it was finished changes nothing."""
        done = self.pending.newest()
        if done is not None and done[0] >= 2 * batch_id + 2:
            return
        r = df.where(F.col("gold_matches_answer").eqNullSafe(F.lit(True))).select(normalized_route(F.col("route")).alias("r"), "_at").where("r is not null").select("r.*", "_at")
        bank, waiting = self.bank.read(), self.pending.read()
        if done is None or done[0] < 2 * batch_id + 1:
            fresh = new_signatures(r, bank, waiting)
            self.pending.replace(waiting.unionByName(fresh.select(*waiting.columns)), 2 * batch_id + 1)
        pending = self.pending.read()
        if pending.count() >= self.threshold:
            last = self.bank.newest()
            if last is None or last[0] < batch_id + 1:
                grown = merge_routes(bank, pending, "_at")
                self.bank.replace(self.rebuild(grown) if self.rebuild else grown, batch_id + 1)
            # the history is told apart by batch, so that a second try doesn't write a second row
            append_history(summary_scoped(self.bank.read()), self.history, batch_id)
            pending = pending.limit(0)
        self.pending.replace(pending, 2 * batch_id + 2)

    def start(self, stream: DataFrame, checkpoint: str):
        """Run over what is there, then stop; a restart goes on at the checkpoint (T-e)."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """T-a: each key once within the watermark, later deliveries dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """Correct and total so far; write it in complete or update mode."""
    return scored.groupBy(*by).agg(F.sum(F.col("_ok").cast("long")).alias("correct"), F.count("*").alias("total"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window, closed once the watermark has passed."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *by, "n")


def stale(cells: DataFrame, listing: DataFrame, keys: list[str], quiet: str = "20 minutes") -> DataFrame:
    """T-f: cells whose newest file (modificationTime) is older than `quiet`, or that have none: they may be submitted again."""
    last = listing.groupBy(*keys).agg(F.max("modificationTime").alias("_t"))
    return cells.join(last, keys, "left").where(F.col("_t").isNull() | (F.col("_t") < F.current_timestamp() - F.expr(f"interval {quiet}"))).drop("_t")


__all__ = ["BankGrowth", "KEY", "Versions", "once_each", "running_accuracy", "stale", "windowed_counts"]
