"""Paths of archived series: relative paths, relocation, finding the folder that holds a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.operators.lineage import meet


def relative_path(path: Column, base: Column) -> Column:
    """`path` from the folder `base`, with "/" and ".." as needed."""
    p, b = F.split(F.translate(path, "\\", "/"), "/"), F.split(F.translate(base, "\\", "/"), "/")
    most = F.least(F.size(p), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), most), lambda k: F.element_at(p, k) != F.element_at(b, k))
    common = F.coalesce(F.array_min(differ) - 1, most)
    up = F.array_repeat(F.lit(".."), (F.size(b) - common).cast("int"))
    down = F.slice(p, common + 1, F.greatest(F.size(p) - common, F.lit(0)))
    return F.coalesce(F.nullif(F.array_join(F.concat(up, down), "/"), F.lit("")), F.lit("."))


def apply_relocation(path: Column, old: Column, new: Column) -> Column:
    """The path with a whole-component prefix swapped; null where the prefix does not apply."""
    return F.when((path == old) | path.startswith(F.concat(old, F.lit("/"))), F.concat(new, F.substr(path, F.length(old) + 1)))


def relocation_between(old: Column, new: Column) -> Column:
    """STRUCT<old, new>: the two paths without their common trailing components, never all of one; null where
    they are equal or blank."""
    o, n = F.reverse(F.split(old, "/")), F.reverse(F.split(new, "/"))
    # the root is a component: one part of each path always stays
    most = F.least(F.size(o), F.size(n)) - 1
    differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (F.element_at(o, k) != F.element_at(n, k)) | (k > most))
    common = F.coalesce(F.array_min(differ) - 1, most)
    kept = lambda parts: F.coalesce(F.nullif(F.array_join(F.reverse(F.slice(parts, (common + 1).cast("int"), F.size(parts))), "/"), F.lit("")), F.lit("/"))
    usable = (F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "") & (old != new)
    return F.when(usable, F.struct(kept(o).alias("old"), kept(n).alias("new")))


def prefixes(path: Column) -> Column:
    """The path and all its parent folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def normalised(path: Column) -> Column:
    """The path with "/" only, without ".", empty and ".." components; a ".." at the root goes nowhere."""
    path = F.translate(path, "\\", "/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda done, x: F.when(x != "..", F.concat(done, F.array(x))).when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(path.startswith("/"), done).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def candidate_folders(runs: DataFrame, relocations: DataFrame, base: str = "") -> DataFrame:
    """run_id, series_uid, folder, via, rank (smallest first) of every folder that may hold a run's images: the stored path
    (via 0), the path relative to the folder `base` of the store (folder_rel, via -1), then each relocation that applies,
    most recent (largest seq) first. A run meets a relocation by equality of one of its path's prefixes."""
    rank = lambda k, x=F.lit(0): F.struct(F.lit(k).alias("kind"), x.cast("long").alias("place")).alias("rank")
    moved_to = lambda x: normalised(apply_relocation(x, F.col("old"), F.col("new"))).alias("folder")
    stored = runs.filter("folder <> ''").select("run_id", "series_uid", normalised(F.col("folder")).alias("folder"), F.lit(0).cast("long").alias("via"), rank(0))
    each = runs.filter("folder <> ''").select("run_id", "series_uid", "folder", F.explode(prefixes(F.col("folder"))).alias("old"))
    moved = each.join(relocations.select("old", "new", F.col("seq").cast("long").alias("via")), "old")
    moved = moved.select("run_id", "series_uid", moved_to(F.col("folder")), "via", rank(2, -F.col("via")))
    found = stored.unionByName(moved)
    if "folder_rel" in runs.columns:
        path = normalised(F.concat(F.lit(base.rstrip("/") + "/"), F.col("folder_rel")))
        found = found.unionByName(runs.filter("folder_rel <> ''").select("run_id", "series_uid", path.alias("folder"), F.lit(-1).cast("long").alias("via"), rank(1)))
    return found


def resolve_folder(runs: DataFrame, relocations: DataFrame, catalogue: DataFrame, base: str = "") -> DataFrame:
    """run_id, folder, via: the first candidate folder that really holds the run's series, written as in the catalogue."""
    held = catalogue.select("series_uid", F.col("folder").alias("held"), normalised(F.col("folder")).alias("folder")).distinct()
    found = meet(candidate_folders(runs, relocations, base), held, ["series_uid", "folder"])
    return found.groupBy("run_id").agg(F.min_by(F.struct(F.col("held").alias("folder"), "via"), F.struct("rank", "held")).alias("f")).select("run_id", "f.folder", "f.via")


def find_series(catalogue: DataFrame) -> DataFrame:
    """The first folder that holds each series."""
    return catalogue.groupBy("series_uid").agg(F.min("folder_id").alias("folder_id"))
