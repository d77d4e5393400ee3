"""Header values and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DATE = "date inconnue"
NO_NAME = "Installation sans nom"
DASH = "—"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def hu_rescale(pixels: Column, slope: Column, intercept: Column) -> Column:
    """Stored pixels to HU; slope 1 and intercept 0 where absent."""
    return F.transform(pixels, lambda v: v.cast("double") * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0)))


def scan_date(*dates: Column) -> Column:
    """The first date that begins with 8 digits, cut to them; "" without one."""
    found = [F.when(F.trim(x).rlike("^[0-9]{8}"), F.substring(F.trim(x), 1, 8)) for x in dates]
    return F.coalesce(*found, F.lit(""))


def dicom_date_to_iso(x: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD; "" where it is no date."""
    text = F.substring(F.trim(x), 1, 8)
    return F.coalesce(F.when(text.rlike("^[0-9]{8}$"), F.date_format(F.try_to_timestamp(text, F.lit("yyyyMMdd")), "yyyy-MM-dd")), F.lit(""))


def iso_date(x: Column) -> Column:
    """A strict YYYY-MM-DD as DATE, else null."""
    return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))))


def iso_to_fr(x: Column) -> Column:
    """dd/mm/yyyy of text that begins with a date; what does not stays as it is, null becomes blank."""
    return F.coalesce(F.date_format(iso_date(F.substring(x, 1, 10)), "dd/MM/yyyy"), x, F.lit(""))


def run_date_fr(x: Column) -> Column:
    return F.coalesce(F.date_format(iso_date(x), "dd/MM/yyyy"), F.lit(UNKNOWN_DATE))


def datetime_fr(date: Column, time: Column) -> Column:
    """DICOM date and time as dd/mm/yyyy HH:MM:SS; seconds 00 and the time itself only as far as given."""
    sub = F.substring
    day = F.when(F.length(date) >= 8, F.concat(sub(date, 7, 2), F.lit("/"), sub(date, 5, 2), F.lit("/"), sub(date, 1, 4))).otherwise(UNKNOWN_DATE)
    seconds = F.when(F.length(time) >= 6, sub(time, 5, 2)).otherwise("00")
    clock = F.when(F.length(time) >= 4, F.concat(F.lit(" "), sub(time, 1, 2), F.lit(":"), sub(time, 3, 2), F.lit(":"), seconds)).otherwise("")
    return F.concat(day, clock)


def multivalue(x: Column, upper: bool = False) -> Column:
    """Backslash-separated values joined by "/", each trimmed and, if wanted, in upper case."""
    clean = (lambda v: F.upper(F.trim(v))) if upper else F.trim
    return F.coalesce(F.array_join(F.transform(F.split(x, r"\\"), lambda v: clean(v)), "/"), F.lit(""))


def ctdi_phantom(meaning: Column) -> Column:
    low = F.lower(meaning)
    return F.when(low.contains("head"), "tête 16 cm").when(low.contains("body"), "corps 32 cm").otherwise(F.coalesce(meaning, F.lit("")))


def slice_location(text: Column, position_z: Column) -> Column:
    """The stated location, else z of the position, else 0."""
    return F.coalesce(text.try_cast("double"), position_z, F.lit(0.0))


def plain_number(x: Column) -> Column:
    """A double as short as possible, without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def comma(x: Column) -> Column:
    return F.replace(x, F.lit("."), F.lit(","))


def format_number(x: Column, decimals: int, sign: bool = False) -> Column:
    """Fixed decimals, half to even, with a point; null for null."""
    flag = "+" if sign else ""
    return F.when(x.isNotNull(), F.format_string(f"%{flag}.{decimals}f", F.bround(x, decimals)))


def format_fr(x: Column, decimals: int, sign: bool = False) -> Column:
    """Fixed decimals, half to even, with a comma."""
    return comma(format_number(x, decimals, sign))


def parse_fr(x: Column) -> Column:
    """A number with point or comma; null where it is none."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def pixel_spacing(row: Column, col: Column) -> Column:
    """STRUCT<ok, reason>: present, finite, positive and square within 0.1 % of the larger."""
    shown = F.concat(plain_number(row), F.lit(" × "), plain_number(col), F.lit(" mm"))
    sound = lambda v: (v > 0) & (v < float("inf")) & ~F.isnan(v)
    reason = (
        F.when(row.isNull() | col.isNull(), F.lit("taille de pixel absente (champ DICOM PixelSpacing)"))
        .when(~(sound(row) & sound(col)), F.concat(F.lit("taille de pixel invalide (PixelSpacing = "), shown, F.lit(")")))
        .when(F.abs(row - col) > 0.001 * F.greatest(row, col), F.concat(F.lit("pixels non carrés ("), shown, F.lit(") non pris en charge")))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def collimation(single: Column, total: Column) -> Column:
    """N × w mm, the row width or the total alone; "" without both."""
    width = lambda x: comma(plain_number(x))
    mm = F.lit(" mm")
    return (
        F.when((single > 0) & (total > 0), F.concat(F.bround(total / single, 0).cast("int").cast("string"), F.lit(" × "), width(single), mm))
        .when(single > 0, F.concat(width(single), mm))
        .when(total > 0, F.concat(width(total), mm))
        .otherwise("")
    )


def acquisition_mode(kind: Column, pitch: Column) -> Column:
    up = F.upper(F.coalesce(kind, F.lit("")))
    helical = F.concat(F.lit("hélicoïdal"), F.when(pitch > 0, F.concat(F.lit(" (pitch "), format_fr(pitch, 3), F.lit(")"))).otherwise(""))
    return F.when(up.startswith("SPIRAL") | ((up == "") & (pitch > 0)), helical).when(up.startswith("SEQUENCE"), "axial (séquentiel)").otherwise(F.coalesce(kind, F.lit("")))


def rotation_time(revolution: Column, exposure_ms: Column) -> Column:
    """Seconds; the exposure time stands in only where the revolution time is unknown."""
    return F.when(revolution > 0, revolution).when(exposure_ms > 0, exposure_ms / 1000.0).otherwise(0.0)


def tube_load(exposure: Column, current: Column, rotation: Column) -> Column:
    """mAs: as stated, else current times rotation, else 0."""
    return F.when(exposure > 0, exposure).when((current > 0) & (rotation > 0), current * rotation).otherwise(0.0)


def exposure_time_text(exposure_ms: Column, rotation: Column) -> Column:
    """Shown only where it differs from the rotation time."""
    seconds = exposure_ms / 1000.0
    same = (rotation > 0) & (F.abs(seconds - rotation) < 0.005)
    return F.when((exposure_ms <= 0) | same, "").otherwise(F.concat(format_fr(seconds, 2), F.lit(" s")))


def pitch_text(pitch: Column, kind: Column) -> Column:
    return F.when(pitch > 0, format_fr(pitch, 3)).when(F.upper(kind).startswith("SEQUENCE"), "acquisition séquentielle").otherwise(DASH)


def ctdi_text(ctdi: Column, phantom: Column) -> Column:
    tail = F.when(phantom != "", F.concat(F.lit(" ("), phantom, F.lit(")"))).otherwise("")
    return F.when(ctdi > 0, F.concat(format_fr(ctdi, 2), F.lit(" mGy"), tail)).otherwise(DASH)


def device_id(*parts: Column) -> Column:
    """Identity parts stripped, lower-cased, spaces as "-", joined by "_"; "" identifies no scanner."""
    clean = [blank_to_null(F.replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit(" "), F.lit("-"))) for x in parts]
    return F.concat_ws("_", *clean)


def display_name(hospital: Column, name: Column, manufacturer: Column, model: Column, inventory: Column) -> Column:
    """Hospital - device (or maker and model) - inventory number."""
    maker = F.concat_ws(" ", blank_to_null(manufacturer), blank_to_null(model))
    number = F.concat(F.lit("N°inv. "), blank_to_null(inventory))
    return F.coalesce(blank_to_null(F.concat_ws(" - ", blank_to_null(hospital), blank_to_null(F.coalesce(blank_to_null(name), maker)), number)), F.lit(NO_NAME))


def manual_id(*row: Column) -> Column:
    """The id of an installation without any identity: "manual-" and 8 hexadecimal digits of the row's content."""
    return F.concat(F.lit("manual-"), F.substring(F.sha2(F.to_json(F.struct(*row)), 256), 1, 8))


def run_key(series_uid: Column, run_date: Column, *row: Column) -> Column:
    """The series, else the date with 8 hexadecimal digits of the row's content."""
    digest = F.substring(F.sha2(F.to_json(F.struct(*row)), 256), 1, 8)
    return F.coalesce(blank_to_null(series_uid), F.concat(F.coalesce(run_date.cast("string"), F.lit("date")), F.lit("-"), digest))


def focal_text(raw: Column) -> Column:
    """Focal spot sizes as "0,6 / 1,2 mm"; unparsable text stays, blank becomes a dash."""
    parts = F.split(F.coalesce(raw, F.lit("")), "/")
    numbers = F.transform(parts, lambda v: v.try_cast("double"))
    text = F.array_join(F.transform(numbers, lambda v: comma(plain_number(v))), " / ")
    return F.when(F.exists(numbers, lambda v: v.isNull()), F.coalesce(blank_to_null(raw), F.lit(DASH))).otherwise(F.concat(text, F.lit(" mm")))


def file_part(x: Column) -> Column:
    """Text that can stand in a file name."""
    x = F.regexp_replace(x, r'[<>:"/\\|?*\[\]]', "")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-+|-+$", "")


def report_filename(device: Column, inventory: Column, date: Column, control_type: Column) -> Column:
    """CQI-type_device_inventory_date.pdf with defaults for what is missing."""
    kind = file_part(F.regexp_replace(F.coalesce(control_type, F.lit("")), "[()]", ""))
    prefix = F.when(kind == "", "CQI").otherwise(F.concat(F.lit("CQI-"), kind))
    known = lambda x, default: F.coalesce(blank_to_null(file_part(x)), F.lit(default))
    day = F.coalesce(F.date_format(iso_date(date), "yyyy-MM-dd"), F.lit("date-inconnue"))
    return F.concat(prefix, F.lit("_"), known(device, "Unknown"), F.lit("_"), known(inventory, "NoInv"), F.lit("_"), day, F.lit(".pdf"))


def hu_slice_text(index: Column, total: Column, z: Column) -> Column:
    """12 / 24 (z = +5,0 mm)."""
    place = F.concat(F.lit("z = "), format_fr(z, 1, sign=True), F.lit(" mm"))
    of = F.when(total > 0, F.concat(F.lit(" / "), total.cast("string"))).otherwise("")
    return F.when(index.isNull(), place).otherwise(F.concat((index + 1).cast("string"), of, F.lit(" ("), place, F.lit(")")))


def nps_slice_text(first: Column, last: Column, count: Column, z0: Column, z1: Column) -> Column:
    """8 à 17 (10 coupes, z = -22,5 à +22,5 mm)."""
    slices = F.concat(count.cast("string"), F.lit(" coupe"), F.when(count > 1, "s").otherwise(""))
    detail = F.concat(slices, F.lit(", z = "), format_fr(z0, 1, sign=True), F.lit(" à "), format_fr(z1, 1, sign=True), F.lit(" mm"))
    return F.when(first.isNull(), detail).otherwise(F.concat((first + 1).cast("string"), F.lit(" à "), (last + 1).cast("string"), F.lit(" ("), detail, F.lit(")")))


def window_level(hu: Column, width: float, level: float) -> Column:
    """HU to grey levels 0 to 255 of a window, truncated."""
    low, high = level - width / 2, level + width / 2
    return F.transform(hu, lambda v: ((F.least(F.greatest(v, F.lit(low)), F.lit(high)) - low) / (high - low) * 255).cast("int"))


def ring_count_of(side: Column) -> Column:
    """Rings of a square spectrum, up to 1.375 times the Nyquist frequency."""
    return (F.floor(side / 2) * F.lit(1.375)).cast("int") + 1


def frequency_axis(side: Column, px: Column) -> Column:
    """The frequencies of the cells along one axis of a spectrum, zero at side // 2."""
    return F.transform(F.sequence(F.lit(0), side - 1), lambda k: (k - F.floor(side / 2)) / (side * px))
