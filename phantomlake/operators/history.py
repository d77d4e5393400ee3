"""The history of recorded controls: upserts, latest rows, trends, summaries, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.functions import scalars as S

DEFAULT_CONTROL_TYPE = "trimestriel"
METRICS = ("water_ct", "uniformity", "noise", "nps_freq")
#: Fixed value: the CT number beyond which a deviation is serious.
CT_LINE = 25.0
NOT_GIVEN = "Non renseigné"
NO_SPECTRUM = "SPB non calculé"


def upsert(runs: DataFrame, order: str = "event_id") -> DataFrame:
    """One row per device and run: the last wins. Where it has neither a corrective action nor its date, both come
    from the last row that had one of them. `replaced`: whether there was an earlier row."""
    key = Window.partitionBy("device_id", "run_id").orderBy(order)
    blank = (F.coalesce("corrective_action", F.lit("")) == "") & (F.coalesce("corrective_action_date", F.lit("")) == "")
    both = F.when(~blank, F.struct("corrective_action", "corrective_action_date"))
    kept = F.last(both, ignorenulls=True).over(key)
    rows = runs.withColumn("_action", kept).withColumn("_n", F.count("*").over(Window.partitionBy("device_id", "run_id"))).withColumn("_k", F.row_number().over(key))
    rows = rows.filter("_k = _n").withColumn("replaced", F.col("_n") > 1)
    for x in ("corrective_action", "corrective_action_date"):
        rows = rows.withColumn(x, F.coalesce(f"_action.{x}", F.lit("")))
    return rows.drop("_action", "_n", "_k")


def action_event() -> Column:
    """The event that a row's corrective action comes from: its own if it has one."""
    blank = (F.coalesce("corrective_action", F.lit("")) == "") & (F.coalesce("corrective_action_date", F.lit("")) == "")
    return F.when(~blank, F.col("event_id"))


def latest(runs: DataFrame) -> DataFrame:
    """The upsert of rows that have `action_event`, as one aggregate: it does not depend on the order in which rows
    come, and folding a part of them first changes nothing."""
    action = ["corrective_action", "corrective_action_date", "action_event"]
    others = [c for c in runs.columns if c not in (*action, "device_id", "run_id")]
    found = runs.groupBy("device_id", "run_id").agg(F.max_by(F.struct(*others), "event_id").alias("r"), F.max_by(F.struct(*action), "action_event").alias("a"))
    blank = {"corrective_action": F.lit(""), "corrective_action_date": F.lit("")}
    return found.select("device_id", "run_id", "r.*", *(F.coalesce(f"a.{x}", y).alias(x) for x, y in blank.items()), "a.action_event").select(runs.columns)


def recent(runs: DataFrame, n: int = 10) -> DataFrame:
    """The n latest controls of each device, newest first."""
    w = Window.partitionBy("device_id").orderBy(F.desc("run_date"), F.desc("recorded_at"), F.desc("event_id"))
    return runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def last_control_type(runs: DataFrame) -> DataFrame:
    """Per device the last control type that was given, else the usual one."""
    given = F.when(F.col("control_type") != "", F.col("control_type"))
    found = F.max_by(given, F.when(given.isNotNull(), F.struct("run_date", "recorded_at", "event_id")))
    return runs.groupBy("device_id").agg(F.coalesce(found, F.lit(DEFAULT_CONTROL_TYPE)).alias("control_type"))


def summary(judged: DataFrame) -> DataFrame:
    """Per device: controls, non-conforming ones, first month, last date."""
    bad = F.col("overall").isin(R.NC, R.NCG, R.NC_OR_NCG)
    return judged.groupBy("device_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.date_format(F.min("run_date"), "MM/yyyy").alias("since"), F.max("run_date").alias("last_date"))


def trend_points(runs: DataFrame) -> DataFrame:
    """One row per control and measured metric with a date, judged with the references frozen in the control."""
    status = R.statuses()
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), status[f"{m}_status"].alias("status")) for m in METRICS))).alias("p")
    return runs.select("device_id", "event_id", "run_date", pairs).select("device_id", "event_id", "run_date", "p.*").filter("run_date is not null and value is not null")


def trend_bands(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Per device and metric the band from the references in force today, the lines of a serious deviation of the CT
    number, and the padded range of dates of the metric's own points: a window of 180 days, 45 more on both sides at least,
    or 5 % in whole days. A metric without points has no range."""
    measured = {m: F.when(F.col("run_date").isNotNull() & F.col(m).isNotNull(), F.col("run_date")) for m in METRICS}
    spans = runs.groupBy("device_id").agg(*(F.struct(F.lit(m).alias("metric"), F.min(x).alias("a"), F.max(x).alias("b")).alias(m) for m, x in measured.items()))
    days = F.datediff("b", "a")
    pad = F.when(days < 180, F.greatest(F.lit(45), F.floor((180 - days) / 2))).otherwise(F.floor(days / 20)).cast("int")
    rows = spans.select("device_id", F.inline(F.array(*METRICS))).withColumn("pad", pad).join(references, "device_id", "left")
    rows = rows.withColumn("band", R.tolerance_band(F.col("metric"), F.col("ref_noise"), F.col("ref_nps_freq")))
    line = F.when(F.col("metric") == "water_ct", CT_LINE)
    return rows.select("device_id", "metric", "band.low", "band.high", "band.reference", (-line).alias("line_low"), line.alias("line_high"), F.date_sub("a", "pad").alias("from_date"), F.date_add("b", "pad").alias("to_date"))


CSV_HEADER = ("date", "kV", "mAs", "ct_eau_UH", "uniformite_UH", "bruit_UH", "bruit_ref_UH", "f_spb_cmm", "f_spb_ref_cmm", "artefacts", "statut", "action_corrective_date", "action_corrective", "notes", "pdf")


def csv_lines(judged: DataFrame, english: bool = False) -> DataFrame:
    """device_id, order columns and one CSV line per control; numbers as shown on screen, unmeasured ones blank."""
    sep = "," if english else ";"

    def number(x: str, decimals: int) -> Column:
        text = S.format_number(F.col(x), decimals)
        return F.coalesce(text if english else S.comma(text), F.lit(""))

    def quoted(x: Column) -> Column:
        return F.when(x.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    cells = [
        F.coalesce(F.col("run_date").cast("string"), F.lit("")), number("kvp", 0), number("mas", 0), number("water_ct", 1), number("uniformity", 1),
        number("noise", 2), number("ref_noise", 2), number("nps_freq", 3), number("ref_nps_freq", 3),
        F.coalesce(F.col("artifacts_present").cast("int").cast("string"), F.lit("")), R.worded(F.col("overall"), R.SHORT), F.col("corrective_action_date"), F.col("corrective_action"), F.col("notes"), F.coalesce("pdf_path", F.lit("")),
    ]
    return judged.select("device_id", "run_date", "recorded_at", "event_id", F.concat_ws(sep, *(quoted(x) for x in cells)).alias("line"))


def write_csv(judged: DataFrame, path: str, english: bool = False) -> None:
    """One folder of text files per device: UTF-8 with byte order mark, CRLF, oldest control first."""
    sep = "," if english else ";"
    lines = csv_lines(judged, english)
    head = judged.select("device_id").distinct().select("device_id", F.lit(None).cast("date").alias("run_date"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(-1).cast("long").alias("event_id"), F.lit("﻿" + sep.join(CSV_HEADER)).alias("line"))
    rows = head.unionByName(lines).repartition("device_id").sortWithinPartitions("device_id", (F.col("event_id") >= 0).asc(), "run_date", "recorded_at", "event_id")
    rows.select("device_id", "line").write.partitionBy("device_id").option("lineSep", "\r\n").text(path)


def reference_eligible(runs: DataFrame) -> DataFrame:
    """Controls that may become a reference: noise and frequency measured, phantom found, dated."""
    return runs.filter("noise is not null and nps_freq is not null and hu_detected and nps_detected and run_date is not null")


def corrective_actions(runs: DataFrame) -> DataFrame:
    return runs.filter("corrective_action <> '' or corrective_action_date <> ''").select("device_id", "event_id", "run_date", "corrective_action_date", "corrective_action")


def register_extract(judged: DataFrame, equipment: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """One row of the register of operations per control, as texts: every line of the installation and acquisition
    sections, and the verdict. Controls of unknown installations or without images keep their row.

    `equipment` has device_id, the installation's names, numbers and dates, its phantom, the origin of the protocol and
    the reconstruction algorithm. `acquisitions` has event_id, header values, z (of the HU slice), the slices of the
    spectrum (nps_start, nps_end, null without one) with their locations z_first and z_last, series_uid and folder.
    """
    filled = lambda x, default: F.coalesce(S.blank_to_null(x), F.lit(default))
    given = lambda x: filled(F.trim(x), NOT_GIVEN).alias(x)
    dash = lambda x: F.coalesce(x, F.lit(S.DASH))
    shown = lambda x: dash(S.blank_to_null(F.trim(x)))
    positive = lambda x, text: dash(F.when(F.col(x) > 0, text))
    rows = judged.drop("kvp", "mas").join(equipment, "device_id", "left").join(acquisitions, "event_id", "left")
    maker = F.concat_ws(" ", S.blank_to_null(F.col("phantom_brand")), S.blank_to_null(F.col("phantom_model")))
    number = F.concat(F.lit("n° série "), S.blank_to_null(F.col("phantom_serial")))
    phantom = F.when(number.isNull(), maker).when(maker == "", number).otherwise(F.concat(maker, F.lit(" ("), number, F.lit(")")))
    ctdi = F.concat(S.format_fr(F.col("ctdi_vol"), 2), F.lit(" mGy"), F.coalesce(F.concat(F.lit(" (fantôme "), S.blank_to_null(F.col("ctdi_phantom")), F.lit(")")), F.lit("")))
    n_nps = F.col("nps_end") - F.col("nps_start") + 1
    return rows.select(
        "event_id", "device_id", F.coalesce(F.date_format("run_date", "dd/MM/yyyy"), F.lit(S.UNKNOWN_DATE)).alias("day"), filled(F.col("control_type"), DEFAULT_CONTROL_TYPE).alias("control_type"),
        given("hospital_name"), given("hospital_location"), shown("manufacturer").alias("manufacturer"), shown("model_name").alias("model_name"), given("serial_number"), given("inventory_number"), given("commissioning_date"),
        filled(phantom, NOT_GIVEN).alias("phantom"), given("clinical_protocol_origin"), given("reconstruction_algorithm"),
        shown("description").alias("protocol"), positive("kvp", F.format_string("%.0f", "kvp")).alias("kvp_text"), positive("tube_current", F.format_string("%.0f", "tube_current")).alias("ma_text"),
        positive("mas", S.format_fr(F.col("mas"), 0)).alias("mas_text"), positive("rotation_time", F.concat(S.format_fr(F.col("rotation_time"), 2), F.lit(" s"))).alias("rotation_text"),
        shown("mode").alias("mode"), shown("collimation").alias("collimation"), S.focal_text(F.col("focal_spots")).alias("focal_text"), shown("kernel").alias("kernel"),
        positive("slice_thickness", F.concat(S.format_fr(F.col("slice_thickness"), 1), F.lit(" mm"))).alias("thickness_text"),
        positive("px", F.concat(S.format_fr(F.col("px"), 3), F.lit(" mm"))).alias("pixel_text"), positive("n_rows", F.concat_ws(" × ", "n_rows", "n_rows")).alias("matrix_text"),
        positive("n_rows", F.concat(F.format_string("%.0f", F.col("n_rows") * F.col("px")), F.lit(" mm"))).alias("fov_text"), positive("ctdi_vol", ctdi).alias("ctdi_text"),
        dash(F.concat(S.hu_slice_text(F.col("hu_slice"), F.col("n_slices"), F.col("z")), F.lit(" — nombre CT, uniformité"))).alias("hu_slice_text"),
        F.coalesce(F.when(n_nps > 0, F.concat(S.nps_slice_text(F.col("nps_start"), F.col("nps_end"), n_nps, F.col("z_first"), F.col("z_last")), F.lit(" — bruit, SPB"))), F.lit(NO_SPECTRUM)).alias("nps_slice_text"),
        dash(F.col("series_uid").cast("string")).alias("series_uid"), given("folder"), "overall",
    )
