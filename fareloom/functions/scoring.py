"""Scores and predicates of single quotes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom import constants as C


def payable(flight_status: Column) -> Column:
    return ~F.coalesce(flight_status, F.lit("")).isin(*C.NOT_PAYABLE)


def eligible(flight_status: Column, exclusion: Column | None = None) -> Column:
    """Payable, and without a reason for exclusion (the empty text is none)."""
    ok = payable(flight_status)
    return ok if exclusion is None else ok & (F.coalesce(exclusion, F.lit("")) == "")


def _known(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def rounded(value: Column, places: int) -> Column:
    """Half away from zero on the scaled double, which other engines do alike."""
    return F.round(value * 10**places) / float(10**places)


def base_ratio(carrier: Column, route: Column | None = None) -> Column:
    """Share of the base fare: of the route plus the carrier's offset, else of the carrier; null if neither is known."""
    return clamped(known_ratio(F.upper(F.trim(carrier)), route))


def known_ratio(carrier: Column, route: Column | None = None) -> Column:
    """The share as tables and offset give it for a carrier's code."""
    of_route = F.lit(None).cast("double") if route is None else _known(C.ROUTE_BASE_RATIO, route) + F.coalesce(_known(C.CARRIER_BASE_OFFSET, carrier), F.lit(0.0))
    return rounded(F.coalesce(of_route, _known(C.CARRIER_BASE_RATIO, carrier)), 4)


def clamped(ratio: Column) -> Column:
    """The share within its bounds; null stays."""
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(C.BASE_RATIO_CLAMP[0])), F.lit(C.BASE_RATIO_CLAMP[1])))


def fare_split(total: Column, base: Column, taxes: Column, carrier: Column, route: Column | None = None) -> Column:
    """Struct of base, taxes and basis: measured (both given), residual (one given), calibrated (by the ratio of the
    route or carrier) or estimated (by the default ratio). Computed parts have two places."""
    ratio = base_ratio(carrier, route)
    whole = base_part(total, base, taxes, base_by(ratio, total))
    return F.struct(whole.alias("base"), tax_part(total, whole, taxes).alias("taxes"), split_basis(base, taxes, ratio).alias("basis"))


def base_by(ratio: Column, total: Column) -> Column:
    """The base fare that a ratio makes of a total; the default ratio where it is null."""
    return rounded(total * F.coalesce(ratio, F.lit(C.DEFAULT_BASE_RATIO)), 2)


def base_part(total: Column, base: Column, taxes: Column, computed: Column) -> Column:
    """The given base fare, else what the given taxes leave, else the computed one."""
    return F.coalesce(base, rounded(total - taxes, 2), computed)


def tax_part(total: Column, base: Column, taxes: Column) -> Column:
    """The given taxes, else what ``base_part`` leaves."""
    return F.coalesce(taxes, rounded(total - base, 2))


def split_basis(base: Column, taxes: Column, ratio: Column) -> Column:
    """The basis of a split by its given parts and the ratio for what is computed."""
    given = F.when(base.isNotNull() & taxes.isNotNull(), "measured").when(base.isNotNull() | taxes.isNotNull(), "residual")
    return given.when(ratio.isNull(), "estimated").otherwise("calibrated")


def recomposes(total: Column, base: Column, taxes: Column, absolute: float = 1.0, relative: float = 0.005) -> Column:
    """Whether the given parts add up to the total within tolerance; true when neither is given."""
    gap = F.abs(total - F.coalesce(base, F.lit(0.0)) - F.coalesce(taxes, F.lit(0.0)))
    return (base.isNull() & taxes.isNull()) | (gap <= F.greatest(F.lit(absolute), total * relative))


def exclusion(flight_status: Column, recomposed: Column, outlier: Column) -> Column:
    """The first reason that applies: cancelled, sold out, parts that don't add up, outlier."""
    return (
        F.when(flight_status == "cancelled", "cancelled")
        .when(flight_status == "sold_out", "sold_out")
        .when(~recomposed, "split_recomposition_mismatch")
        .when(F.coalesce(outlier, F.lit(False)), "outlier")
    )


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """With no deviation 0 at the mean and 999 with its sign elsewhere."""
    flat = F.when(F.abs(value - mean) <= C.EPSILON, 0.0).when(value > mean, 999.0).otherwise(-999.0)
    return F.when(deviation <= C.EPSILON, flat).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))


def change(current: Column, previous: Column) -> Column:
    """Relative change; from nothing or less it is 1 if there is something now."""
    return F.when(previous <= 0, F.when(current > 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(current - previous, previous))


def severity(z: Column, dod: Column) -> Column:
    return F.when((z >= C.Z_CRITICAL) | (F.coalesce(dod, F.lit(0.0)) >= C.DOD_CRITICAL), "CRITICAL").when(z >= C.Z_WARNING, "WARNING")


def dynamic_z(value: Column, mean: Column, deviation: Column, lead_days: Column) -> Column:
    """Z-score with a deviation that is wider close to departure."""
    lead = F.greatest(lead_days.cast("double"), F.lit(1.0))
    return z_score(value, mean, deviation * (1 + 0.35 * F.exp(-lead / 10)))


def fence_outlier(value: Column, mean: Column, deviation: Column, n: Column, q1: Column, q3: Column, k: float = 1.5) -> Column:
    """Outside the fences of at least four peers, else of mean and deviation; a lower fence of zero excludes nothing."""
    spread = F.greatest(q3 - q1, F.lit(0.0))
    enough = n >= 4
    lower = F.when(enough, rounded(F.greatest(q1 - k * spread, F.lit(0.0)), 2)).otherwise(rounded(F.greatest(mean - 2.5 * deviation, F.lit(0.0)), 2))
    upper = F.when(enough, rounded(q3 + k * spread, 2)).otherwise(rounded(mean + 2.5 * deviation, 2))
    return (value > upper) | ((lower > 0) & (value < lower))


def surge_score(z: Column, multiple: Column, dod: Column, outlier: Column, hhi: Column) -> Column:
    """Weighted sum of five features, each scaled to the unit interval; an outlier counts in full."""
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    w, n = C.SURGE_WEIGHTS, C.SURGE_NORMS
    total = (
        w["z"] * unit(z / n["z"])
        + w["multiple"] * unit((multiple - 1) / n["multiple"])
        + w["dod"] * unit(dod / n["dod"])
        + w["outlier"] * F.when(outlier, 1.0).otherwise(0.0)
        + w["concentration"] * unit((hhi - 0.25) / n["concentration"])
    )
    return rounded(unit(total), 4)


def violation(multiple: Column, z: Column, dod: Column, hhi: Column) -> Column:
    """Code of the rule that is broken: the multiple of the median outranks the others, of which the first counts."""
    return (
        F.when(multiple >= C.MULTIPLE_LIMIT, C.VIOLATION_CODES["multiple"])
        .when(z >= C.Z_CRITICAL, C.VIOLATION_CODES["sigma"])
        .when(dod >= C.DOD_CRITICAL, C.VIOLATION_CODES["dod"])
        .when((hhi >= C.HHI_LIMIT) & (z >= C.HHI_Z), C.VIOLATION_CODES["concentration"])
    )


def surge_level(score: Column, broken: Column, z: Column, dod: Column) -> Column:
    """CRITICAL for any violation or a high score, WARNING, or NORMAL."""
    return (
        F.when(broken.isNotNull() | (score >= C.SURGE_LEVELS["critical"]), "CRITICAL")
        .when((z >= C.Z_WARNING) | (dod >= C.DOD_WARNING) | (score >= C.SURGE_LEVELS["warning"]), "WARNING")
        .otherwise("NORMAL")
    )


def surge(fare: Column, mean: Column, deviation: Column, lead_days: Column, previous: Column, median: Column, n: Column, q1: Column, q3: Column, hhi: Column) -> Column:
    """Struct of dz, dod, multiple, outlier, score, violation and level of a fare against its baseline.

    Figures are rounded before the rules look at them: dz and dod to four places, the multiple to three. Without
    a positive previous fare dod is null; without a positive median the mean takes its place.
    """
    dz = rounded(dynamic_z(fare, mean, deviation, lead_days), 4)
    dod = F.when(previous > 0, rounded((fare - previous) / previous, 4))
    middle = F.when(median > 0, median).when(mean > 0, mean).otherwise(C.DEFAULT_BASELINE[2])
    multiple = rounded(fare / middle, 3)
    outlier = fence_outlier(fare, mean, deviation, n, q1, q3)
    score = surge_score(dz, multiple, dod, outlier, hhi)
    broken = violation(multiple, dz, dod, hhi)
    return F.struct(dz.alias("dz"), dod.alias("dod"), multiple.alias("multiple"), outlier.alias("outlier"), score.alias("score"), broken.alias("violation"), surge_level(score, broken, dz, dod).alias("level"))


def alert(z: Column, dod: Column, surged: Column) -> tuple[Column, Column]:
    """Severity and kind of an alert, both null without one: raised by Z, by the daily change, or by ``surge``."""
    broken, spike = surged["violation"].isNotNull(), F.coalesce(dod >= C.DOD_CRITICAL, F.lit(False))
    raised = (z >= C.Z_WARNING) | spike | (surged["level"] != "NORMAL")
    critical = broken | (z >= C.Z_CRITICAL) | spike
    return F.when(raised, F.when(critical, "CRITICAL").otherwise("HIGH")), F.when(raised, F.when(broken, "DGCA_STATUTORY_VIOLATION").when(spike, "SURGE_PRICING").otherwise("SPIKE"))


def rubric(z: Column, multiple: Column, dod: Column) -> Column:
    """Four tiers of a violation."""
    return (
        F.when((z >= 4) | (multiple > 3.5) | (dod >= 0.75), "SEVERE")
        .when((z >= C.Z_CRITICAL) | (multiple >= C.MULTIPLE_LIMIT) | (dod >= C.DOD_CRITICAL), "CRITICAL")
        .when(z >= C.Z_WARNING, "WARNING")
        .otherwise("NONE")
    )


def horizon_elasticity(lead_days: Column, near: float = -0.25, far: float = -1.65, middle: float = 14.5, slope: float = 0.18) -> Column:
    """Logistic path of elasticity from ``near`` departure to ``far`` from it."""
    return near + (far - near) / (1 + F.exp(-slope * (lead_days - middle)))


def fisher(laspeyres: Column, paasche: Column) -> Column:
    """Geometric mean, null for a negative product."""
    product = laspeyres * paasche
    return F.when(product >= 0, F.sqrt(product))


def succeeded(status: Column) -> Column:
    """Whether a run's status is no failure; partial and unknown ones count as successes."""
    return ~F.upper(F.trim(F.coalesce(status, F.lit("")))).isin(*C.FAILED_STATUSES)
