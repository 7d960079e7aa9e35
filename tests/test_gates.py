"""Release gates: nothing measured is never a pass, low agreement withholds survey gates, and each gate's branches."""

import pytest

from tilth.operators import gates
from tilth.operators.gates import FAIL, NONE, PASS

SCHEMA = "measure string, source string, item string, value string, n long"


def judged(spark, *rows):
    made = [(m, s, i, None if v is None else str(v), n) for m, s, i, v, n in rows]
    return {r.gate: r for r in gates.evaluated(spark.createDataFrame(made, SCHEMA)).collect()}


def scores(source, level=0.95, crops=("Cotton", "Soyabean")):
    return [(m, source, c, level - (0.05 if m.endswith("low") else 0), 200) for c in crops for m in ("precision", "recall", "precision_low", "recall_low")]


KAPPA = ("kappa", "d1", None, 0.8, 250)


def test_nothing_measured_is_never_a_pass(spark):
    got = judged(spark)
    assert len(got) == 15 and {r.result for r in got.values()} == {NONE}
    assert all(r.consequence != "Meets gate" for r in got.values()) and not got["classification_calibration"].releasable and got["sowing_abs_error"].releasable


def test_classification_needs_both_sources_and_agreement(spark):
    name = "classification_precision_recall"
    assert judged(spark, *scores("heldout"))[name].result == NONE
    both = judged(spark, *scores("heldout"), *scores("d1"), KAPPA, ("ece", "heldout", None, 0.0, 600), ("abstain_rate", "x", None, 0.1, 9))
    assert both[name].result == PASS and both["reference_kappa"].result == PASS and both["classification_calibration"].releasable
    low = judged(spark, *scores("heldout"), *scores("d1"), ("kappa", "d1", None, 0.6, 250), ("area_map", "d1", "Cotton", 500, 0), ("area_estimate", "d1", "Cotton", 475, 0), ("area_total", "d1", None, 1000, 0))
    assert low[name].result == NONE and low["reference_kappa"].result == FAIL and low["area_vs_d1"].result == NONE
    assert judged(spark, *scores("heldout", 0.84), *scores("d1"), KAPPA)[name].result == FAIL
    assert judged(spark, *scores("heldout", 0.84))[name].result == FAIL  # one required class that fails is enough
    assert judged(spark, *scores("heldout"), *scores("d1", crops=["Cotton"]), KAPPA)[name].result == NONE


@pytest.mark.parametrize(("estimate", "result"), [(475, PASS), (400, FAIL), (None, NONE)])
def test_areas(spark, estimate, result):
    rows = [("area_map", "d1", "Cotton", 500, 0), ("area_estimate", "d1", "Cotton", estimate, 0), ("area_map", "d1", "Fallow", 200, 0), ("area_estimate", "d1", "Fallow", 20, 0), ("area_map", "d1", "Tur", 10, 0), ("area_estimate", "d1", "Tur", 1, 0), ("area_total", "d1", None, 1000, 0)]
    got = judged(spark, KAPPA, *rows)["area_vs_d1"]
    assert got.result == result


def test_the_other_gates(spark):
    got = judged(
        spark, ("official_diff", "user", None, 40.0, 0), ("sowing_late", "a", None, 0.02, 100), ("sowing_late", "b", None, 0.5, 0), ("sowing_agreement", "a", None, 0.7, 100), ("sowing_agreement", "b", None, 0.9, 100),
        ("sowing_median", "client", None, 5.0, 12), ("sowing_p90", "client", None, 14.0, 12), ("yield_field", "client", "Cotton", 10.0, 12), ("delineation_iou", "bench", None, 0.65, 0), ("raster_checks", "tests", None, 0.98, 0), ("stress_plausible", "d1", None, 0.9, 5),
    )
    results = {g: r.result for g, r in got.items()}
    assert results["area_vs_official"] == FAIL and results["sowing_upper_bound"] == PASS and results["sowing_optical_radar"] == FAIL and results["sowing_abs_error"] == PASS
    assert results["yield_error"] == NONE and results["delineation_iou"] == PASS and results["raster_integrity"] == FAIL and results["stress_plausibility"] == NONE and results["insufficient_evidence"] == NONE
    assert got["sowing_upper_bound"].consequence == "Meets gate" and got["raster_integrity"].consequence == "Not released"


def test_yields_with_enough_records(spark):
    fine = [("yield_field", "client", "Cotton", 20.0, 35), ("yield_total", "client", "Cotton", 5.0, 35)]
    assert judged(spark, *fine)["yield_error"].result == PASS
    assert judged(spark, *fine, ("yield_field", "client", "Soyabean", 30.0, 31), ("yield_total", "client", "Soyabean", 5.0, 31))["yield_error"].result == FAIL
    assert judged(spark, ("yield_field", "client", "Cotton", 20.0, 35))["yield_error"].result == FAIL


def test_stage_stress_and_cadastre(spark):
    assert judged(spark, ("stage_agreement", "survey", None, 0.9, 1))["stage_d1_agreement"].result == NONE
    assert judged(spark, ("stage_agreement", "Client records", None, 0.9, 1))["stage_d1_agreement"].result == PASS
    assert judged(spark, KAPPA, ("stage_agreement", "survey", None, 0.7, 1))["stage_d1_agreement"].result == FAIL
    assert judged(spark, ("stress_plausible", "d1", None, 0.9, 5), ("stress_compliance", "audit", None, 1.0, 5))["stress_plausibility"].result == PASS
    assert judged(spark, ("stress_plausible", "d1", None, 0.9, 5), ("stress_compliance", "audit", None, 0.99, 5))["stress_plausibility"].result == FAIL
    assert judged(spark, ("delineation_iou", "b", None, 0.3, 0), ("cadastral_ok", "c", None, 1, 0))["delineation_iou"].result == PASS


@pytest.mark.parametrize("bad", ["oops", "NaN", None, ""])
def test_what_is_no_number_is_not_measured(spark, bad):
    assert judged(spark, ("ece", "heldout", None, bad, 5))["classification_calibration"].result == NONE
