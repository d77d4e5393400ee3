"""Inputs of the queries as views over the given tables.

One SQL text serves Spark and DuckDB, so both sides start from equal rows. `{name}` stands for a table or for
another view of this module.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phantomlake.operators.lineage import meet

#: Decoded controls of every scanner, as recorded (several rows share a device_id and run_id).
QC_RUNS = """
select concat('dev-', cast(user_id as string)) as device_id,
       concat(cast(user_id as string), '.', cast(event_id % 40 as string)) as run_id,
       event_id, cast(ts as date) as run_date, ts as recorded_at,
       (value - 35.0) / 3.0 as water_ct, value / 10.0 as uniformity,
       case when event_type = 'error' then null else 5.0 + (value - 40.0) / 100.0 end as noise,
       case when event_type = 'error' then null else 0.25 + (value - 40.0) / 2000.0 end as nps_freq,
       case when event_type = 'view' then null when event_type = 'signup' and value > 100 then true else false end as artifacts_present,
       case when user_id % 5 = 0 then null else cast(5.1 as double) end as ref_noise,
       case when user_id % 7 = 0 then cast(0.0 as double) when user_id % 11 = 0 then null else cast(0.255 as double) end as ref_nps_freq,
       case when event_id % 3 = 0 then '' else event_type end as control_type,
       case when event_id % 4 = 0 then concat('fix ', cast(event_id as string)) else '' end as corrective_action,
       case when event_id % 4 = 0 or event_id % 6 = 0 then cast(cast(ts as date) as string) else '' end as corrective_action_date,
       case when event_id % 9 = 0 then cast(0.0 as double) else 100.0 + event_id % 3 * 20 end as kvp,
       cast(event_id % 250 as double) as mas,
       case when event_id % 8 = 0 then concat('a;b "', cast(event_id as string), '"') else '' end as notes,
       case when event_id % 5 = 0 then null when event_id % 10 = 3 then concat('/reports/a;', cast(event_id as string), '.pdf') else concat('/reports/', cast(event_id as string), '.pdf') end as pdf_path,
       cast(event_id % 30 as int) as hu_slice, cast(event_id % 50 as int) as n_slices,
       event_id % 13 <> 0 as hu_detected, event_id % 17 <> 0 as nps_detected
from {events}"""

#: One row per slice of every series.
HEADERS = """
select o_custkey as folder_id, l_orderkey as series_uid,
       concat(cast(l_orderkey as string), '/', cast(l_linenumber as string), '/', cast(l_partkey as string)) as file_path,
       cast(l_linenumber as int) as instance_number, cast(l_extendedprice as double) / 1000.0 as slice_location,
       case when l_tax >= 0.08 then 1024 else 512 end as n_rows,
       case when l_discount >= 0.10 then cast(0.25 as double) else cast(0.5 as double) end as px,
       case when l_returnflag = 'R' and l_linenumber = 1 then 'LOCALIZER' else 'AXIAL' end as image_type,
       case when l_linenumber % 3 = 0 and l_orderkey % 2 = 0 then cast(0.0 as double) else 80.0 + floor(l_orderkey % 3) * 20 + case when l_orderkey % 5 = 0 then l_linenumber else 0 end end as kvp,
       case when l_orderkey % 9 = 0 then cast(0.0 as double) else cast(l_quantity as double) end as tube_current,
       l_suppkey as suppkey, o_orderpriority as description, cast(l_orderkey % 4 as int) as series_number
from {lineitem} join {orders} on l_orderkey = o_orderkey"""

#: Header values as a scanner writes them: absent, malformed and vendor-specific ones among them.
RAW_HEADERS = """
select l_orderkey, cast(l_linenumber as int) as l_linenumber, l_partkey,
       case when l_orderkey % 5 = 0 then '' when l_orderkey % 7 = 0 then ' 2020' else replace(cast(cast(o_orderdate as date) as string), '-', '') end as study_date,
       case when l_orderkey % 10 = 0 then 'ABCDEFGH' else concat(' ', replace(cast(cast(l_shipdate as date) as string), '-', ''), 'T1') end as series_date,
       case when l_linenumber = 4 then null else replace(cast(cast(l_shipdate as date) as string), '-', '') end as acquisition_date,
       case when l_linenumber = 1 then '' when l_linenumber = 2 then '0915' when l_linenumber = 5 then '09' else concat('1030', cast(10 + l_linenumber as string), '.5') end as study_time,
       case when l_linenumber = 6 then '2026-3-1' when l_linenumber = 5 then '' else cast(cast(o_orderdate as date) as string) end as iso_date,
       case when l_linenumber = 3 then null else concat('original', chr(92), ' Primary ', chr(92), case when l_returnflag = 'R' and l_linenumber = 1 then 'localizer' else 'Axial' end) end as image_type,
       concat('B', cast(l_linenumber as string), 'f ', chr(92), l_linestatus) as kernel,
       case l_linenumber % 4 when 0 then 'IEC Head Dosimetry Phantom' when 1 then 'IEC Body Dosimetry Phantom' when 2 then '' else o_orderpriority end as ctdi_meaning,
       case when l_linenumber = 2 then null when l_linenumber = 3 then 'x' else cast(cast(l_quantity as int) as string) end as slice_location_text,
       case when l_orderkey % 3 = 0 then null else cast(l_linenumber as double) * 2.5 end as position_z,
       case when l_linenumber = 2 then null when l_linenumber = 3 and l_orderkey % 2 = 0 then cast(0.0 as double) else 0.25 + l_linenumber / 8.0 end as spacing_row,
       case when l_linenumber = 2 then null when l_linenumber = 4 and l_orderkey % 2 = 0 then cast(0.5 as double) else 0.25 + l_linenumber / 8.0 end as spacing_col,
       case when l_linenumber = 1 then cast(0.0 as double) when l_orderkey % 2 = 0 then cast(0.625 as double) else cast(1.0 as double) end as single_width,
       case when l_linenumber = 2 then cast(0.0 as double) when l_linenumber = 1 and l_orderkey % 3 = 0 then cast(0.0 as double) else 20.0 * (l_orderkey % 3 + 1) end as total_width,
       case l_linenumber % 4 when 0 then 'SPIRAL' when 1 then 'SEQUENCED' when 2 then '' else 'Constant_Angle' end as acquisition_type,
       case when l_linenumber % 3 = 0 then cast(0.0 as double) else 0.5 + cast(l_orderkey % 8 as double) / 8.0 end as pitch,
       case when l_orderkey % 4 = 0 then cast(0.0 as double) else 0.25 + cast(l_linenumber as double) / 4.0 end as revolution_time,
       case when l_orderkey % 6 = 0 then cast(0.0 as double) else 250.0 + cast(l_linenumber as double) * 250.0 + l_orderkey % 2 * 1000.0 end as exposure_time,
       case when l_orderkey % 3 = 0 then cast(0.0 as double) else cast(l_quantity as double) end as exposure,
       case when l_orderkey % 8 = 0 then cast(0.0 as double) else 100.0 + l_linenumber end as tube_current,
       case when l_orderkey % 11 = 0 then cast(0.0 as double) else cast(l_quantity as double) / 4.0 end as ctdi_vol,
       case when l_orderkey % 13 = 0 then 'MR' when l_orderkey % 7 = 0 then '' else ' ct ' end as modality,
       case when l_orderkey % 17 = 0 then '1.2.840.10008.5.1.4.1.1.2.1' when l_orderkey % 19 = 0 then '1.2.840.10008.5.1.4.1.1.7' when l_orderkey % 5 = 0 then '' else '1.2.840.10008.5.1.4.1.1.2' end as sop_class,
       case when l_orderkey % 23 = 0 then cast(0.0 as double) else cast(1.0 as double) end as orient_rx,
       case when l_orderkey % 23 = 0 then cast(0.5 as double) else cast(1.0 as double) end as orient_cy,
       case when l_orderkey % 29 = 0 then '01' else '' end as lossy,
       l_linenumber <> 6 or l_orderkey % 2 = 0 as single_plane,
       case when l_linenumber % 2 = 0 then concat(cast(l_linenumber as string), '.200', chr(47), '0.60') when l_linenumber = 3 then 'n/a' when l_linenumber = 5 then '' else '1.200000' end as focal_spots,
       cast(l_quantity as int) % 9 as small_int
from {lineitem} join {orders} on l_orderkey = o_orderkey"""

#: Scanners with the four parts of their identity; some have none.
DEVICES = """
select s_suppkey, case when s_suppkey % 10 = 0 then ' ' else n_name end as manufacturer,
       case when s_suppkey % 10 = 0 then '' else concat(s_name, ' ') end as model_name,
       case when s_suppkey % 10 = 0 or s_suppkey % 3 = 0 then null else concat('ST ', cast(s_suppkey % 7 as string)) end as station_name,
       case when s_suppkey % 10 = 0 or s_suppkey % 4 = 0 then '' else concat('SN', cast(s_suppkey as string)) end as serial_number,
       case when s_suppkey % 4 = 1 then '' else concat('CHU ', n_name) end as hospital_name,
       case when s_suppkey % 3 = 1 then '' else concat('Scanner ', cast(s_suppkey as string)) end as device_name,
       case when s_suppkey % 2 = 1 then '' else cast(2630000 + s_suppkey as string) end as inventory_number,
       s_acctbal
from {supplier} join {nation} on s_nationkey = n_nationkey"""

#: Every ROI tile: 8 x 8 values of one row, in HU; 8 tiles a slice.
TILES = """
select vec_id, label as series_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as k, embedding
from {embeddings}"""

PATHS = """
select page_id, regexp_replace(url, '^https?:/', '') as path from {pages}"""

BASE = "select c_custkey as k, c_name as f1, c_mktsegment as f2 from {customer} where c_custkey % 13 <> 0"
MINE = """
select c_custkey as k, case when c_custkey % 7 = 0 then concat(c_name, '-M') else c_name end as f1,
       case when c_custkey % 10 = 1 then 'MINE' else c_mktsegment end as f2
from {customer} where (c_custkey % 13 <> 0 and c_custkey % 11 <> 0) or c_custkey % 26 = 0"""
THEIRS = """
select c_custkey as k, case when c_custkey % 5 = 0 then concat(c_name, '-T') else c_name end as f1,
       case when c_custkey % 15 = 1 then 'THEIRS' else c_mktsegment end as f2
from {customer} where (c_custkey % 13 <> 0 and c_custkey % 17 <> 0) or c_custkey % 39 = 0"""

#: Synthetic phantoms, one pixel a row: water with integer noise, a wall, air.
PIXELS_DUCK = """
select s_suppkey as slice_id, cast(r as int) as row_idx, cast(k as int) as col_idx, cast(case
  when (r-(48+s_suppkey%5-2))*(r-(48+s_suppkey%5-2)) + (k-(48+s_suppkey%7-3))*(k-(48+s_suppkey%7-3)) <= (34+s_suppkey%3)*(34+s_suppkey%3)
    then (r*7919 + k*104729 + s_suppkey*31) % 41 - 20
  when (r-(48+s_suppkey%5-2))*(r-(48+s_suppkey%5-2)) + (k-(48+s_suppkey%7-3))*(k-(48+s_suppkey%7-3)) <= (38+s_suppkey%3)*(38+s_suppkey%3)
    then 120 else -1000 end as double) as hu
from {supplier}, range(96) a(r), range(96) b(k)"""
#: The same images as one array an image row; what holds for a whole row is worked out once.
IMAGE_ROWS = """
select slice_id, row_idx, transform(sequence(0L, 95L), k -> case when (k - c) * (k - c) <= water then cast((base + k * 104729) % 41 - 20 as double) when (k - c) * (k - c) <= wall then 120D else -1000D end) as hu
from (select s_suppkey as slice_id, cast(r as int) as row_idx, 48 + s_suppkey % 7 - 3 as c, r * 7919 + s_suppkey * 31 as base,
             pow(34 + s_suppkey % 3, 2) - pow(r - (46 + s_suppkey % 5), 2) as water, pow(38 + s_suppkey % 3, 2) - pow(r - (46 + s_suppkey % 5), 2) as wall
      from (select s_suppkey, explode(sequence(0L, 95L)) as r from {slice_ids}))"""

#: What a reviewer of images looked up for each slice: centre and inner radius, known by construction.
PHANTOMS = """
select s_suppkey as slice_id, cast(48 + s_suppkey % 5 - 2 as int) as center_row, cast(48 + s_suppkey % 7 - 3 as int) as center_col,
       cast(2 * (34 + s_suppkey % 3) as double) as diameter_px, cast(1.0 as double) as px
from {supplier}"""

#: Phantom diameters and pixel sizes of many formats.
FORMATS = """
select p_partkey as fmt_id, 60.0 + cast(p_partkey % 1700 as double) / 2.0 as diameter_px, cast(1 + p_partkey % 9 as double) / 8.0 as px,
       cast(256 * (1 + p_partkey % 4) as int) as n_rows, cast(200 + p_partkey % 40 as int) as center_row, cast(250 - p_partkey % 30 as int) as center_col
from {part}"""

#: How many images or rows of a table a task gets at most, about.
SLICES_A_TASK, ROWS_A_TASK = 1000, 500_000

VIEWS = {
    "qc_runs": QC_RUNS, "headers": HEADERS, "raw_headers": RAW_HEADERS, "devices": DEVICES, "tiles": TILES, "paths": PATHS,
    "base": BASE, "mine": MINE, "theirs": THEIRS, "phantoms": PHANTOMS, "formats": FORMATS,
}


def names_in(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {x: view(spark, sf_dir, x) for x in names_in(VIEWS[name])}
    if "lineitem" in tables:  # slices are joined with their series, then ordered and grouped within it
        tables["lineitem"] = dealt(tables["lineitem"], "l_orderkey", tables["lineitem"].count())
        tables["orders"] = tables["orders"].hint("merge")  # series, else broadcast while their compressed file is small; a merge can spill
    return spark.sql(VIEWS[name], **tables)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows dealt by key to as many tasks as a shuffle has, or more, of at most about ROWS_A_TASK: what a task sorts or joins
    does not grow with the table. The number is set even where a shuffle has as many, since adaptive execution merges the tasks
    of a shuffle to one a core. Joins, windows and groups by the key then follow this dealing; what fits one task is left alone."""
    tasks = -(-n_rows // ROWS_A_TASK)
    return rows.repartition(max(tasks, shuffle_tasks(rows.sparkSession)), key) if tasks > 1 else rows


def duck(text: str) -> str:
    """SQL for DuckDB with every {view} written out and {table} as its own name."""
    texts = VIEWS | {"pixels": PIXELS_DUCK}
    return text.format(**{x: f"({duck(texts[x])})" if x in texts else x for x in names_in(text)})


def image_rows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """slice_id, row_idx, hu ARRAY<DOUBLE>: the images row by row, made by all cores from the few rows of their table. Those
    are dealt by slice, to as many tasks as a shuffle has or more, so that nothing that joins or groups by slice deals pixels.
    `of` (slice_id) names the slices that are wanted; no others are made."""
    ids = view(spark, sf_dir, "supplier").select("s_suppkey")
    tasks = max(spark.sparkContext.defaultParallelism, shuffle_tasks(spark), -(-ids.count() // SLICES_A_TASK))
    ids = ids.repartition(tasks, "s_suppkey")
    if of is not None:  # both sides are dealt alike; a semi-join would be put before the dealing, which is then left out
        ids = meet(ids, of.select(F.col("slice_id").alias("s_suppkey")).distinct().repartition(tasks, "s_suppkey"), "s_suppkey")
    return spark.sql(IMAGE_ROWS, slice_ids=ids)
