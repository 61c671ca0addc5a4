"""Attribute history over a stream of updates: each micro-batch joins the events kept so far, and only the claims it touches are made anew.

The events are kept as a table of parts, one per batch and named by its number, so a batch that is run again replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataform.operators import history


class HistoryStream:
    def __init__(self, root: str, keys: list[str], attributes: list[str], rank: list[str]) -> None:
        self.root, self.keys, self.attributes, self.rank = root.rstrip("/"), keys, attributes, rank

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch with the columns keys, eff, purge, attributes and rank."""
        columns = [*self.keys, "eff", "purge", *self.attributes, *self.rank]
        batch.select(*columns).write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")
        touched = batch.select(*self.keys).dropna().distinct()
        events = batch.sparkSession.read.parquet(f"{self.root}/events").select(*columns).join(touched, self.keys, "left_semi")
        made = history.effective_events(events, self.keys, "eff", "purge", self.attributes, self.rank)
        found = history.versions(history.attribute_log(made, self.keys, self.attributes), self.keys, self.attributes)
        # A touched claim may have no version any more; its mark says that older ones don't hold.
        found = touched.join(found, self.keys, "left")
        found.write.mode("overwrite").parquet(f"{self.root}/versions/batch={number}")

    def start(self, updates: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return updates.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def versions(self, spark) -> DataFrame:
        """The versions as of the last batch: of every entity the rows of the last batch that touched it."""
        rows = spark.read.parquet(f"{self.root}/versions")
        last = rows.groupBy(*self.keys).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*self.keys, "batch"]).where("since is not null").drop("batch")
