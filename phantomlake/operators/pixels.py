"""How pixels and files are kept and found: a table of image rows bucketed by slice, and the scan of an archive's folders.

Every operator on pixels joins and groups by slice. A table that is bucketed by slice and sorted by (slice_id, row_idx)
gives it its rows as they lie: no exchange stands above the scan of the pixels, however many analyses read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phantomlake.operators.catalogue import is_candidate
from phantomlake.operators.lineage import meet

#: Image rows as a table, or as a source that gives those of the slices it is asked for (slice_id) and makes or decodes no others.
Images = DataFrame | Callable[[DataFrame], DataFrame]


def write_slice_rows(image_rows: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Writes slice_id, row_idx and hu as a table, bucketed by slice with one file a bucket, sorted by slice and row; `path`
    is where its files go (else the warehouse). Choose buckets of a few hundred MB."""
    rows = image_rows.select("slice_id", "row_idx", "hu").repartition(buckets, "slice_id")
    out = rows.write.bucketBy(buckets, "slice_id").sortBy("slice_id", "row_idx").format("parquet").mode(mode)
    (out.option("path", path) if path else out).saveAsTable(table)


def with_slices(image_rows: DataFrame, slices: DataFrame, how: str = "inner") -> DataFrame:
    """Image rows joined with rows of a few columns by slice. The hint keeps pixels out of a broadcast, which an estimate of
    their size that is too low would choose; each task holds its part of `slices`, and pixels dealt by slice stay where they are."""
    return meet(image_rows, slices, "slice_id", how)


def of_slices(images: Images, slices: DataFrame) -> DataFrame:
    """The image rows of some slices."""
    ids = slices.select("slice_id")
    return images(ids) if callable(images) else with_slices(images, ids, "left_semi")


def plain_path(path: Column) -> Column:
    """A local path without its scheme, however many slashes stand behind it; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, folder and candidate of every file below a folder; what is in them is never read. Hidden
    files are left out by the scan itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = plain_path(F.col("path"))
    return files.select(at.alias("path"), "length", F.col("modificationTime").alias("modified"), folder_of(at).alias("folder"), is_candidate(at).alias("candidate"))


def scan_report(files: DataFrame, headers: DataFrame, reason: Column) -> DataFrame:
    """path, folder, kind, reason of every candidate file of a scan: `headers` (path and header values) are those that could
    be decoded, `reason` (a STRUCT<kind, reason> over them, as catalogue.slice_class gives it) says why one is no slice.
    Candidates without a header could not be read, and are an error of their own."""
    judged = headers.select(F.col("path").alias("_path"), reason.alias("_c"))
    rows = files.filter("candidate").join(judged, F.col("path") == F.col("_path"), "left")
    unread = F.col("_path").isNull()
    return rows.select("path", "folder", F.when(unread, "error").otherwise(F.col("_c.kind")).alias("kind"), F.when(unread, UNREADABLE).otherwise(F.col("_c.reason")).alias("reason"))


#: Fixed value: why a file without a readable header is rejected.
UNREADABLE = "fichier illisible ou non DICOM"
