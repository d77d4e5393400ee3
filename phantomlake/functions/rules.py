"""The regulatory criteria as column expressions: statuses, verdicts, tolerance bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance at the edge of a criterion.
EPS = 1e-9
#: Statuses and their wording.
OK, NC, NCG, PENDING, INCOMPLETE, NC_OR_NCG = "ok", "nc", "ncg", "pending", "incomplete", "nc_or_ncg"
LABELS = {OK: "Conforme", NC: "Non conforme", NCG: "NC grave", PENDING: "—", INCOMPLETE: "Incomplet", NC_OR_NCG: "NC ou NCG"}
SHORT = {OK: "Conforme", NC: "NC", NCG: "NCG", PENDING: "—", INCOMPLETE: "Incomplet", NC_OR_NCG: "NC ou NCG"}
ACTIONS = {
    NCG: "Arrêt de l'exploitation et signalement à l'ANSM et à l'ARS dont dépend l'exploitant dans un délai de 2 jours ouvrés dans le cadre du système national de matériovigilance",
    NC_OR_NCG: "Nombre CT de l'eau égal à 25 UH en valeur absolue : la décision ANSM (point 9.1.7.3) classe cette valeur à la fois en non-conformité et en non-conformité grave. Merci de vous référer au texte de la décision.",
    NC: "Remise en conformité dès que possible",
}
VERDICTS = {OK: "✔ Conforme", NC: "✘ Non conforme", NCG: "✘ Non-conformité grave", NC_OR_NCG: "✘ NC ou NCG : merci de vous référer au texte ANSM"}
REASONS = {
    "water_ct": "nombre CT de l'eau non mesuré",
    "uniformity": "uniformité non mesurée",
    "noise": "stabilité du bruit non évaluée (valeur de référence absente)",
    "nps_freq": "stabilité du SPB non évaluée (valeur de référence absente)",
    "artifacts": "inspection visuelle des artéfacts non réalisée",
}
NOISE_NOT_MEASURED, NPS_NOT_MEASURED = "bruit non mesuré", "SPB non mesuré"
TESTS = ("water_ct", "uniformity", "noise", "nps_freq", "artifacts")
MEASURES = ("water_ct", "uniformity", "noise", "nps_freq", "artifacts_present", "ref_noise", "ref_nps_freq")


def water_ct_status(v: Column) -> Column:
    """Up to 7 HU ok, 25 HU itself undecided by the text, below it nc, above ncg; null pending."""
    a = F.abs(v)
    return F.when(v.isNull(), PENDING).when(a <= 7, OK).when(F.abs(a - 25) <= EPS, NC_OR_NCG).when(a < 25, NC).otherwise(NCG)


def uniformity_status(v: Column) -> Column:
    return F.when(v.isNull(), PENDING).when(F.abs(v) <= 7, OK).otherwise(NC)


def noise_bounds(ref: Column) -> tuple[Column, Column]:
    """Deviations from the reference that are allowed; null without reference."""
    tenth = ref * F.lit(0.1)
    low, high = F.least(F.lit(-0.2), -tenth), F.greatest(F.lit(0.2), tenth)
    return F.when(ref.isNotNull(), low), F.when(ref.isNotNull(), high)


def noise_status(v: Column, ref: Column) -> Column:
    """A reference of 0 is judged; only a missing one leaves the test pending."""
    low, high = noise_bounds(ref)
    return F.when(v.isNull() | ref.isNull(), PENDING).when((v - ref).between(low - EPS, high + EPS), OK).otherwise(NC)


def nps_bounds(ref: Column) -> tuple[Column, Column]:
    return ref * F.lit(0.9), ref * F.lit(1.1)


def nps_status(v: Column, ref: Column) -> Column:
    """A missing reference and a reference of 0 both leave the test pending."""
    low, high = nps_bounds(ref)
    return F.when(v.isNull() | ref.isNull() | (ref == 0), PENDING).when(v.between(low - EPS, high + EPS), OK).otherwise(NC)


def artifacts_status(present: Column) -> Column:
    return F.when(present.isNull(), PENDING).when(present, NC).otherwise(OK)


def overall_status(*statuses: Column) -> Column:
    """The worst judged status; without a bad one, ok only if every test was judged."""
    some = lambda value: F.array_contains(F.array(*statuses), value)
    judged = F.size(F.filter(F.array(*statuses), lambda s: s != PENDING))
    return F.when(some(NCG), NCG).when(some(NC_OR_NCG), NC_OR_NCG).when(some(NC), NC).when(judged == 0, PENDING).when(judged == len(statuses), OK).otherwise(INCOMPLETE)


def statuses(**columns: Column) -> dict[str, Column]:
    """Status columns of the five tests and `overall`; columns default to those named in MEASURES."""
    c = {x: columns.get(x, F.col(x)) for x in MEASURES}
    each = {
        "water_ct_status": water_ct_status(c["water_ct"]),
        "uniformity_status": uniformity_status(c["uniformity"]),
        "noise_status": noise_status(c["noise"], c["ref_noise"]),
        "nps_freq_status": nps_status(c["nps_freq"], c["ref_nps_freq"]),
        "artifacts_status": artifacts_status(c["artifacts_present"]),
    }
    return each | {"overall": overall_status(*each.values())}


def pending_reasons(status: dict[str, Column], noise: Column, nps_freq: Column) -> Column:
    """One phrase per pending test, in the order of TESTS."""
    texts = {x: F.lit(REASONS[x]) for x in TESTS}
    texts["noise"] = F.when(noise.isNull(), NOISE_NOT_MEASURED).otherwise(texts["noise"])
    texts["nps_freq"] = F.when(nps_freq.isNull(), NPS_NOT_MEASURED).otherwise(texts["nps_freq"])
    return F.filter(F.array(*(F.when(status[x] == PENDING, texts[x]) for x in TESTS)), lambda x: x.isNotNull())


def tolerance_band(metric: Column, ref_noise: Column, ref_nps: Column) -> Column:
    """STRUCT<low, high, reference>; null where no band applies."""
    n_low, n_high = noise_bounds(ref_noise)
    f_low, f_high = nps_bounds(ref_nps)
    none = F.lit(None).cast("double")
    band = lambda low, high, ref: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), ref.alias("reference"))
    return (
        F.when(metric == "water_ct", band(F.lit(-7.0), F.lit(7.0), none))
        .when(metric == "uniformity", band(F.lit(0.0), F.lit(7.0), none))
        .when((metric == "noise") & ref_noise.isNotNull(), band(ref_noise + n_low, ref_noise + n_high, ref_noise))
        .when((metric == "nps_freq") & ref_nps.isNotNull() & (ref_nps != 0), band(f_low, f_high, ref_nps))
    )


def worded(status: Column, words: dict[str, str], default: str | None = "") -> Column:
    """A status as text of a fixed dictionary."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[status], F.lit(default))
