"""Writing what several steps read, safe against lost executors; joining what grows with the fleet."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def meet(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with others by a key of which there are more in a larger fleet (slice, series, control). The hint keeps
    `others` out of a broadcast, which an estimate by the size of files would choose: each task holds its part of them."""
    return rows.join(others.hint("shuffle_hash"), on, how)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder that spark.checkpoint.dir names. Only where all runs on one machine (tests) a
    temporary folder is set for a session that has none."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
