"""Release gates over a table of evidence: what is not there, or is no number, is NOT MEASURED and never a pass.

Evidence is long: measure, source, item (a class or crop), value (text or number) and n. All gates are read from one
aggregate of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators.graph import written

PASS, FAIL, NONE = "PASS", "FAIL", "NOT MEASURED"
REQUIRED = ["Cotton", "Soyabean"]
NON_CROP = ["Fallow", "Abstained", "Other/Abstained", "Non-crop", "Unclear", "Monitoring-flagged"]
HELD_OUT, SURVEY = "heldout", "d1"
NOT_RELEASED = "Not released"
# Gate, component, and what holds while it is not met.
GATES = [
    ("classification_precision_recall", "Classification", NOT_RELEASED),
    ("classification_calibration", "Classification", NOT_RELEASED),
    ("classification_abstain_rate", "Classification", "Released; abstentions shown"),
    ("reference_kappa", "Reference quality", "D1 not used for gating"),
    ("area_vs_d1", "Area", NOT_RELEASED),
    ("area_vs_official", "Area", NOT_RELEASED),
    ("delineation_iou", "Delineation", "Shown with boundary_confidence"),
    ("sowing_upper_bound", "Sowing", "Shown as window, not date"),
    ("sowing_optical_radar", "Sowing", "Shown as window, not date"),
    ("sowing_abs_error", "Sowing", 'Labelled "not yet validated against farm records"'),
    ("stage_d1_agreement", "Stage", "Labelled provisional"),
    ("yield_error", "Yield", "Published only as a district-anchored band with label (5.6)"),
    ("stress_plausibility", "Stress", "Shown as anomaly only, type withheld"),
    ("raster_integrity", "Raster", NOT_RELEASED),
    ("insufficient_evidence", "All", NOT_RELEASED),
]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _said(fails: Column, passes: Column) -> Column:
    """FAIL before PASS before NOT MEASURED; a null test is no test."""
    return F.when(F.coalesce(fails, F.lit(False)), FAIL).when(F.coalesce(passes, F.lit(False)), PASS).otherwise(NONE)


def _judged(value: Column, passes: Column) -> Column:
    return _said(value.isNotNull() & ~passes, value.isNotNull() & passes)


def evaluated(evidence: DataFrame) -> DataFrame:
    """A row a gate: gate, component, value (the one that decides), result, consequence, and releasable (of its component:
    no gate that withholds it is short of a pass)."""
    x = F.expr("try_cast(value AS DOUBLE)")
    # a few rows, read several times
    rows = written(evidence.select("measure", "source", "item", F.coalesce("n", F.lit(0)).alias("n"), F.when(~F.isnan(x), x).alias("x")))
    is_ = lambda m: F.col("measure") == m
    one = lambda m, *tests: F.max(F.when(_all([is_(m), *tests]), F.col("x")))
    four = ["precision", "recall", "precision_low", "recall_low"]
    single = ["ece", "abstain_rate", "official_diff", "delineation_iou", "cadastral_ok", "area_total", "stage_agreement", "stress_plausible", "stress_compliance", "raster_checks", "evidence_used"]
    # areas and yields are judged by item first, sowing errors by source
    items = rows.groupBy("measure", "source", "item").agg(F.max("x").alias("x"), F.max("n").alias("n"))
    areas = items.groupBy("item").agg(one("area_map").alias("map"), one("area_estimate").alias("estimate")).where(F.col("map").isNotNull() & ~F.col("item").isin(NON_CROP))
    yields = items.groupBy("item").agg(one("yield_field").alias("field"), one("yield_total").alias("total"), F.max(F.when(is_("yield_field"), F.col("n"))).alias("n")).where("n >= 30")
    errors = items.groupBy("source").agg(one("sowing_median").alias("median"), one("sowing_p90").alias("p90"), F.max(F.when(is_("sowing_median"), F.col("n"))).alias("n")).where("n > 0 AND median IS NOT NULL AND p90 IS NOT NULL")
    facts = rows.agg(
        *[one(m).alias(m) for m in single],
        one("kappa", F.col("n") > 0).alias("kappa"),
        F.max(F.when(is_("stage_agreement"), F.lower("source").contains("client"))).alias("stage_client"),
        *[one(m, F.col("source") == s, F.col("item") == c).alias(f"{m}_{s}_{k}") for m in four for s in (HELD_OUT, SURVEY) for k, c in enumerate(REQUIRED)],
        one("sowing_late", F.col("n") > 0).alias("late"), F.min(F.when(is_("sowing_agreement") & (F.col("n") > 0), F.col("x"))).alias("agreement"),
    )
    total = rows.agg(one("area_total").alias("area_total"))
    off = F.abs(F.col("map") - F.col("estimate")) / F.nullif(F.col("estimate"), F.lit(0.0)) * 100
    area_rows = areas.crossJoin(total).where(F.greatest("map", "estimate") / F.nullif(F.col("area_total"), F.lit(0.0)) >= 0.05).select(off.alias("off"))  # total: one row
    area = area_rows.agg(F.max("off").alias("area_off"), F.count(F.lit(1)).alias("area_n"), F.count("off").alias("area_measured"))
    bad = (F.col("field") > 25) | F.col("total").isNull() | (F.abs("total") > 10)
    yields = yields.agg(F.max("field").alias("yield_field"), F.count(F.lit(1)).alias("yield_n"), F.coalesce(F.bool_or(F.coalesce(bad, F.lit(True))), F.lit(False)).alias("yield_bad"))
    errors = errors.agg(F.max("median").alias("sowing_median"), F.max("p90").alias("sowing_p90"))
    f = facts.crossJoin(area).crossJoin(yields).crossJoin(errors)  # one row each

    c = F.col
    usable = F.coalesce(c("kappa") >= 0.70, F.lit(False))
    of = lambda s, k: [c(f"{m}_{s}_{k}") for m in four]
    known = lambda s, k: _all([v.isNotNull() for v in of(s, k)])
    good = lambda s, k: (of(s, k)[0] >= 0.85) & (of(s, k)[1] >= 0.85) & (of(s, k)[2] >= 0.80) & (of(s, k)[3] >= 0.80)
    pairs = [(s, k) for s in (HELD_OUT, SURVEY) for k in range(len(REQUIRED))]
    used = lambda s: usable if s == SURVEY else F.lit(True)
    fails = _any([used(s) & known(s, k) & ~good(s, k) for s, k in pairs])
    measured = _all([used(s) & known(s, k) for s, k in pairs])
    weakest = F.least(*[F.when(used(s) & known(s, k), F.least(*of(s, k)[:2])) for s, k in pairs])
    stage = F.when(usable | F.coalesce(c("stage_client"), F.lit(False)), c("stage_agreement"))
    stress = F.when(c("stress_compliance").isNotNull(), c("stress_plausible"))
    area_off = F.when(usable & (c("area_n") > 0), c("area_off"))
    results = {
        "classification_precision_recall": (weakest, _said(fails, measured)),
        "classification_calibration": (c("ece"), _judged(c("ece"), c("ece") <= 0.05)),
        "classification_abstain_rate": (c("abstain_rate"), _judged(c("abstain_rate"), c("abstain_rate") <= 0.20)),
        "reference_kappa": (c("kappa"), _judged(c("kappa"), c("kappa") >= 0.70)),
        "area_vs_d1": (area_off, _said(area_off > 10, area_off.isNotNull() & (c("area_measured") == c("area_n")))),
        "area_vs_official": (c("official_diff"), _judged(c("official_diff"), c("official_diff") <= 15)),
        "delineation_iou": (F.coalesce("delineation_iou", "cadastral_ok"), _judged(F.coalesce("delineation_iou", "cadastral_ok"), F.coalesce(c("delineation_iou") >= 0.60, F.lit(False)) | F.coalesce(c("cadastral_ok") == 1, F.lit(False)))),
        "sowing_upper_bound": (c("late"), _judged(c("late"), c("late") <= 0.05)),
        "sowing_optical_radar": (c("agreement"), _judged(c("agreement"), c("agreement") >= 0.80)),
        "sowing_abs_error": (c("sowing_median"), _judged(c("sowing_median"), (c("sowing_median") <= 7) & (c("sowing_p90") <= 15))),
        "stage_d1_agreement": (stage, _judged(stage, stage >= 0.80)),
        "yield_error": (F.when(c("yield_n") > 0, c("yield_field")), _said((c("yield_n") > 0) & c("yield_bad"), (c("yield_n") > 0) & ~c("yield_bad"))),
        "stress_plausibility": (stress, _judged(stress, (stress >= 0.80) & (c("stress_compliance") >= 1))),
        "raster_integrity": (c("raster_checks"), _judged(c("raster_checks"), c("raster_checks") >= 1)),
        "insufficient_evidence": (c("evidence_used"), _judged(c("evidence_used"), c("evidence_used") >= 1)),
    }
    told = [F.struct(F.lit(k).alias("place"), F.lit(g).alias("gate"), F.lit(part).alias("component"), results[g][0].cast("double").alias("value"), results[g][1].alias("result"), F.lit(unmet).alias("unmet")) for k, (g, part, unmet) in enumerate(GATES)]
    rows = f.select(F.explode(F.array(*told)).alias("g")).select("g.*")
    held = rows.groupBy("component").agg((~F.bool_or((F.col("result") != PASS) & (F.col("unmet") == NOT_RELEASED))).alias("releasable"))
    return rows.join(held, "component").select("gate", "component", "value", "result", F.when(F.col("result") == PASS, "Meets gate").otherwise(F.col("unmet")).alias("consequence"), "releasable")
