"""Controls as they arrive: judged on arrival, and folded into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phantomlake.functions import rules
from phantomlake.operators import store


def judged(runs: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """A stream (or table) of controls with their statuses and verdict; with devices, also whether each is known."""
    rows = runs.withColumns(rules.statuses())
    if devices is None:
        return rows
    known = devices.select("device_id", F.lit(True).alias("known"))
    return rows.join(known, "device_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def follow(runs: DataFrame, path: str, checkpoint: str, buckets: int | None = None, consumer: str | None = None, tidy_every: int = 100) -> StreamingQuery:
    """Folds every new batch of controls into the store, removals (`deleted`) among them; only the buckets of devices that
    it touches are read and written. A batch that is repeated after a failure, or read again under a new checkpoint, finds
    its own rows and changes nothing. A named consumer merges three ways: against what it last saw of the store, so that
    what others changed or removed meanwhile stays unless the batch changes it. Every `tidy_every` batches the versions
    that nobody needs any more are removed."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.persist()  # read by several steps of the fold
        store.write_runs(batch, path, buckets, consumer)
        batch.unpersist()
        if number % tidy_every == tidy_every - 1:
            store.tidy(batch.sparkSession, path)

    return runs.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
