"""Queries of map accuracy: users' and producers' accuracy, scores that count abstention, overall scores, sowing checks,
client matches, coarse groups, and the release gates that stand on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import wilson
from tilth.operators import evaluation, gates
from tilth.plans.base import CYCLES, cycles, query, table

#: A map class a line, its reference class, and the stratum the line was drawn from.
_SAMPLE = """sample AS (SELECT l_returnflag AS mapped, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.05 THEN 'R' ELSE l_returnflag END AS reference,
  l_returnflag AS stratum FROM lineitem),
area AS (SELECT l_returnflag AS stratum, sum(l_extendedprice) AS area, count(*) * 40.0 AS units FROM lineitem GROUP BY 1)"""


def _sample(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    reference = F.when(F.col("l_quantity") < 10, "A").when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") > 0.05, "R").otherwise(F.col("l_returnflag"))
    sample = line.select(F.col("l_returnflag").alias("mapped"), reference.alias("reference"), F.col("l_returnflag").alias("stratum"))
    area = line.groupBy(F.col("l_returnflag").alias("stratum")).agg(F.sum("l_extendedprice").alias("area"), (F.count(F.lit(1)) * 40.0).alias("units"))
    return sample, area


@query(f"""WITH {_SAMPLE}, w AS (SELECT stratum, area / sum(area) OVER () AS w, units FROM area),
k AS (SELECT DISTINCT mapped AS label FROM sample UNION SELECT DISTINCT reference FROM sample),
c AS (SELECT stratum, mapped, reference, count(*) AS n FROM sample GROUP BY 1, 2, 3),
b AS (
  SELECT label, stratum, sum(n) AS n, sum(CASE WHEN mapped = label AND reference = label THEN n ELSE 0 END) AS hits, sum(CASE WHEN mapped = label THEN n ELSE 0 END) AS m,
         sum(CASE WHEN reference = label THEN n ELSE 0 END) AS r FROM c CROSS JOIN k GROUP BY 1, 2),
e AS (
  SELECT label, sum(w * hits / n) AS hits, sum(w * m / n) AS m, sum(w * r / n) AS r FROM b JOIN w USING (stratum) GROUP BY 1),
v AS (
  SELECT label, e.hits / nullif(e.m, 0) AS ua, e.hits / nullif(e.r, 0) AS pa, e.m AS em, e.r AS er,
    b.hits, b.m, b.r, b.n, w, units FROM e JOIN b USING (label) JOIN w USING (stratum)),
s AS (
  SELECT label, any_value(ua) AS ua, any_value(pa) AS pa, any_value(em) AS em, any_value(er) AS er, count(*) FILTER (n < 2) AS thin,
    sum(w * w * (1 - n / units) / n * (hits * (1 - hits / n) + ua * ua * m * (1 - m / n) - 2 * ua * (hits - hits * m / n)) / (n - 1)) AS vu,
    sum(w * w * (1 - n / units) / n * (hits * (1 - hits / n) + pa * pa * r * (1 - r / n) - 2 * pa * (hits - hits * r / n)) / (n - 1)) AS vp
  FROM v GROUP BY 1)
SELECT label, round(ua, 9) AS users_accuracy, CASE WHEN thin = 0 THEN round(sqrt(greatest(vu / (em * em), 0)), 9) END AS ua_se,
  round(pa, 9) AS producers_accuracy, CASE WHEN thin = 0 THEN round(sqrt(greatest(vp / (er * er), 0)), 9) END AS pa_se FROM s""")
def users_producers_accuracy(spark, sf_dir):
    """Combined ratio estimators over strata with a finite population correction, and their standard errors."""
    sample, area = _sample(spark, sf_dir)
    found = evaluation.accuracy_by_class(sample, area, "mapped", "reference", "stratum", "area", "units")
    return found.select("label", *[F.round(c, 9).alias(c) for c in ("users_accuracy", "ua_se", "producers_accuracy", "pa_se")])


_PAIRS = """pairs AS (SELECT l_returnflag AS reference, CASE WHEN l_tax > 0.06 THEN NULL WHEN l_quantity < 12 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.04 THEN 'R' ELSE l_returnflag END AS predicted FROM lineitem)"""


def _pairs(spark, sf_dir) -> DataFrame:
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    predicted = F.when(F.col("l_tax") > 0.06, F.lit(None).cast("string")).when(q < 12, "A").when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") > 0.04, "R").otherwise(flag)
    return table(spark, sf_dir, "lineitem").select(flag.alias("reference"), predicted.alias("predicted"))


def _low(k: str, n: str) -> str:
    return f"greatest(0.0, ({k} / {n} + 3.8416 / (2 * {n}) - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}))"


_SCORES = f"""{_PAIRS}, c AS (SELECT reference, predicted, count(*) AS k FROM pairs GROUP BY 1, 2),
l AS (SELECT DISTINCT reference AS label FROM c UNION SELECT DISTINCT predicted FROM c WHERE predicted IS NOT NULL),
t AS (SELECT label, CAST(sum(CASE WHEN reference = label AND predicted = label THEN k ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN reference = label AND predicted IS DISTINCT FROM label THEN k ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN reference <> label AND predicted = label THEN k ELSE 0 END) AS BIGINT) AS fp FROM c CROSS JOIN l GROUP BY 1)"""


def _scores(spark, sf_dir) -> DataFrame:
    """Counts of each label; an abstention (null) is a miss of its reference and never a false positive."""
    counts = _pairs(spark, sf_dir).groupBy("reference", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.per_class(counts).where("label IS NOT NULL")


@query(f"""WITH {_SCORES} SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(CASE WHEN tp + fp > 0 THEN {_low('tp', '(tp + fp)')} END, 9) AS precision_low,
  round(tp / nullif(tp + fn, 0), 9) AS recall, round(CASE WHEN tp + fn > 0 THEN {_low('tp', '(tp + fn)')} END, 9) AS recall_low, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM t""")
def scores_with_abstention(spark, sf_dir):
    s = _scores(spark, sf_dir)
    low = lambda n: F.round(wilson(F.col("tp").cast("double"), n.cast("double"))[0], 9)
    predicted, held = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return s.select("label", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), low(predicted).alias("precision_low"), F.round("recall", 9).alias("recall"), low(held).alias("recall_low"), F.round("f1", 9).alias("f1"))


@query(f"""WITH {_SCORES}, o AS (SELECT count(*) AS n, count(predicted) AS named, count(*) FILTER (reference = predicted) AS right FROM pairs)
SELECT n, round(any_value("right") / CAST(n AS DOUBLE), 9) AS accuracy, round(any_value("right") / CAST(any_value(named) AS DOUBLE), 9) AS accuracy_named, round(1 - any_value(named) / CAST(n AS DOUBLE), 9) AS abstained,
  round(avg(tp / nullif(tp + fn, 0)), 9) AS balanced, round(avg(2.0 * tp / nullif(2 * tp + fp + fn, 0)), 9) AS macro_f1, round(min(tp / nullif(tp + fn, 0)), 9) AS least_recall FROM t, o GROUP BY n""")
def overall_scores(spark, sf_dir):
    """Accuracy of all and of the named, share of abstentions, balanced accuracy over supported classes and mean F1."""
    pairs = _pairs(spark, sf_dir)
    one = pairs.agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("named"), F.count_if(F.col("reference") == F.col("predicted")).alias("good"))
    means = _scores(spark, sf_dir).agg(F.round(F.avg("recall"), 9).alias("balanced"), F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.min("recall"), 9).alias("least_recall"))
    both = one.crossJoin(means)  # one row each
    n = F.col("n")
    return both.select("n", F.round(F.col("good") / n, 9).alias("accuracy"), F.round(F.col("good") / F.col("named"), 9).alias("accuracy_named"), F.round(1 - F.col("named") / n, 9).alias("abstained"), "balanced", "macro_f1", "least_recall")


@query(f"""WITH {_PAIRS}, g AS (SELECT CASE WHEN reference IN ('A', 'R') THEN 'returned' ELSE 'kept' END AS reference, CASE WHEN predicted IN ('A', 'R') THEN 'returned' WHEN predicted IS NOT NULL THEN 'kept' END AS predicted FROM pairs)
SELECT reference, count(*) AS n, count(*) FILTER (reference = predicted) AS good, round(count(*) FILTER (reference = predicted) / CAST(count(*) AS DOUBLE), 9) AS recall FROM g GROUP BY 1""")
def coarse_scores(spark, sf_dir):
    """Classes collapsed to groups before they are scored."""
    group = lambda c: F.when(F.col(c).isin("A", "R"), "returned").when(F.col(c).isNotNull(), "kept")
    g = _pairs(spark, sf_dir).select(group("reference").alias("reference"), group("predicted").alias("predicted"))
    good = F.count_if(F.col("reference") == F.col("predicted"))
    return g.groupBy("reference").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), F.round(good / F.count(F.lit(1)), 9).alias("recall"))


@query(f"WITH {CYCLES} SELECT crop_id, count(DISTINCT parcel_id % 10) AS regions, count(DISTINCT parcel_id % 10) >= 3 AS replicated FROM cycles GROUP BY 1")
def class_replication(spark, sf_dir):
    """In how many regions a class was seen."""
    regions = F.countDistinct(F.col("parcel_id") % 10)
    return cycles(spark, sf_dir).groupBy("crop_id").agg(regions.alias("regions")).withColumn("replicated", F.col("regions") >= 3)


_SOWING = """fields AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS field_id, l_returnflag AS crop, CAST(l_shipdate AS DATE) AS sown,
  CASE WHEN l_tax < 0.07 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 2 END AS survey, make_date(year(l_shipdate), 6, 20) AS onset, l_linestatus = 'F' AS irrigated,
  CASE WHEN l_discount > 0.02 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 23 - 8 END AS radar, CASE WHEN l_discount > 0.06 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 17 - 6 END AS client FROM lineitem)"""


@query(f"""WITH {_SOWING} SELECT crop, count(*) AS fields, count(*) FILTER (sown > survey) AS after_survey, count(survey) AS surveyed, round(count(*) FILTER (sown > survey) / CAST(count(survey) AS DOUBLE), 9) AS upper_rate,
  count(*) FILTER (NOT irrigated AND sown < onset - 5) AS before_onset, count(*) FILTER (NOT irrigated) AS rainfed, count(*) FILTER (abs(sown - radar) <= 10) AS agreed, count(radar) AS both_seen, median(abs(sown - radar)) AS median_difference,
  count(client) AS client_dates, median(abs(sown - client)) AS median_error, quantile_cont(abs(sown - client), 0.9) AS p90_error, round(avg(sown - client), 9) AS mean_error FROM fields GROUP BY 1""")
def sowing_checks(spark, sf_dir):
    """Sown after it was seen sown; rainfed and sown long before the onset; optical and radar dates agreeing within ten
    days; errors against client dates. Each over the rows that have what it needs."""
    q, day = F.col("l_quantity").cast("int"), F.col("l_shipdate").cast("date")
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("crop"),
        day.alias("sown"),
        F.when(F.col("l_tax") < 0.07, F.date_add(day, q - 2)).alias("survey"),
        F.make_date(F.year("l_shipdate"), F.lit(6), F.lit(20)).alias("onset"),
        (F.col("l_linestatus") == "F").alias("irrigated"),
        F.when(F.col("l_discount") > 0.02, F.date_add(day, q % 23 - 8)).alias("radar"),
        F.when(F.col("l_discount") > 0.06, F.date_add(day, q % 17 - 6)).alias("client"),
    )
    late, apart, wrong = F.col("sown") > F.col("survey"), F.abs(F.datediff("sown", "radar")), F.datediff("sown", "client")
    return f.groupBy("crop").agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(late).alias("after_survey"),
        F.count("survey").alias("surveyed"),
        F.round(F.count_if(late) / F.count("survey"), 9).alias("upper_rate"),
        F.count_if(~F.col("irrigated") & (F.col("sown") < F.date_sub("onset", 5))).alias("before_onset"),
        F.count_if(~F.col("irrigated")).alias("rainfed"),
        F.count_if(apart <= 10).alias("agreed"),
        F.count("radar").alias("both_seen"),
        F.median(apart).alias("median_difference"),
        F.count("client").alias("client_dates"),
        F.median(F.abs(wrong)).alias("median_error"),
        F.percentile(F.abs(wrong), F.lit(0.9)).alias("p90_error"),
        F.round(F.avg(wrong), 9).alias("mean_error"),
    )


_CLIENT = f"""{CYCLES}, rec AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 100 + 1 END AS field_id, CAST(o_orderdate AS DATE) AS sown, o_custkey % 12 AS crop, o_totalprice / 10000 AS area, o_custkey % 100 + 1 AS place FROM orders),
near AS (SELECT record_id, cycle_id, crop_id % 12 AS found, c.sown AS ours, row_number() OVER (PARTITION BY record_id ORDER BY abs(c.sown - r.sown), cycle_id) AS k
  FROM rec r JOIN cycles c ON c.parcel_id = coalesce(r.field_id, r.place) AND c.sown BETWEEN r.sown - 20 AND r.sown + 20)"""


@query(f"""WITH {_CLIENT} SELECT r.record_id, cycle_id, CASE WHEN cycle_id IS NULL THEN 'unmatched' WHEN field_id IS NOT NULL THEN 'by_id' ELSE 'by_place' END AS matched, CAST(ours - sown AS INTEGER) AS sowing_error, found = crop AS same_crop
FROM rec r LEFT JOIN near n ON n.record_id = r.record_id AND k = 1""")
def client_match(spark, sf_dir):
    """Each record's nearest cycle in time, on its field by id, or at its place where it names none. The join is on the
    field and on bands of 20 days, so a record meets only cycles near it in time."""
    m = _matches(spark, sf_dir)
    matched = F.when(F.col("b").isNull(), "unmatched").when(F.col("field_id").isNotNull(), "by_id").otherwise("by_place")
    return m.select("record_id", F.col("b.cycle_id").alias("cycle_id"), matched.alias("matched"), F.datediff("b.ours", "sown").alias("sowing_error"), (F.col("b.found") == F.col("crop")).alias("same_crop"))


def _matches(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey") % 100 + 1).alias("field_id"),
        F.col("o_orderdate").cast("date").alias("sown"),
        (F.col("o_custkey") % 12).alias("crop"),
        (F.col("o_custkey") % 100 + 1).alias("place"),
    )
    band = lambda c: F.floor(F.unix_date(c) / 20)
    near = F.explode(F.array(*[band("sown") + k for k in (-1, 0, 1)])).alias("band")
    asked = r.select("record_id", "sown", F.coalesce("field_id", "place").alias("parcel_id"), near)
    c = cycles(spark, sf_dir).select("parcel_id", "cycle_id", (F.col("crop_id") % 12).alias("found"), F.col("sown").alias("ours"), band("sown").alias("band"))
    met = asked.join(c, ["parcel_id", "band"]).where(F.abs(F.datediff("ours", "sown")) <= 20)
    best = met.groupBy("record_id").agg(F.min_by(F.struct("cycle_id", "found", "ours"), F.struct(F.abs(F.datediff("ours", "sown")), F.col("cycle_id"))).alias("b"))
    return r.join(best, "record_id", "left")


@query(f"""WITH {_CLIENT}, j AS (SELECT r.record_id, r.sown, crop, ours, found FROM rec r JOIN near n ON n.record_id = r.record_id AND k = 1), d AS (
  SELECT record_id, unnest(list_filter([CASE WHEN abs(ours - sown) > 7 THEN {{'field': 'sowing_date', 'theirs': CAST(sown AS VARCHAR), 'ours': CAST(ours AS VARCHAR)}} END,
    CASE WHEN found <> crop THEN {{'field': 'crop', 'theirs': CAST(crop AS VARCHAR), 'ours': CAST(found AS VARCHAR)}} END], lambda x: x IS NOT NULL)) AS x FROM j)
SELECT record_id, x.field AS field, x.theirs AS theirs, x.ours AS ours FROM d""")
def disagreement_log(spark, sf_dir):
    """A row a field of a matched record on which client and map differ."""
    j = _matches(spark, sf_dir).where("b IS NOT NULL").select("record_id", "sown", "crop", "b.found", "b.ours", F.datediff("b.ours", "sown").alias("sowing_error"))
    entry = lambda name, a, b: F.struct(F.lit(name).alias("field"), F.col(a).cast("string").alias("theirs"), F.col(b).cast("string").alias("ours"))
    found = F.array_compact(F.array(F.when(F.abs("sowing_error") > 7, entry("sowing_date", "sown", "ours")), F.when(F.col("found") != F.col("crop"), entry("crop", "crop", "found"))))
    return j.select("record_id", F.explode(found).alias("x")).select("record_id", "x.*")


@query("""WITH f AS (SELECT c_mktsegment AS village, c_acctbal < 500 AS abstained, abs(c_acctbal) AS area FROM customer)
SELECT village, count(*) AS fields, count(*) FILTER (abstained) AS abstained, round(avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END), 9) AS rate, round(sum(CASE WHEN abstained THEN area ELSE 0 END) / nullif(sum(area), 0), 9) AS area_rate FROM f GROUP BY 1""")
def abstain_rates(spark, sf_dir):
    """Share of fields, and of their area, without a named class."""
    out, area = F.col("c_acctbal") < 500, F.abs("c_acctbal")
    rate = F.try_divide(F.sum(F.when(out, area).otherwise(0.0)), F.sum(area))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("village")).agg(F.count(F.lit(1)).alias("fields"), F.count_if(out).alias("abstained"), F.round(F.avg(F.when(out, 1.0).otherwise(0.0)), 9).alias("rate"), F.round(rate, 9).alias("area_rate"))


@query("""WITH m AS (SELECT l_returnflag AS kind, l_discount * 10 AS iou, l_linenumber AS pieces FROM lineitem)
SELECT kind, count(*) AS n, round(median(iou), 9) AS median_iou, round(avg(iou), 9) AS mean_iou, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS over_half, round(avg(CASE WHEN iou >= 0.3 THEN 1.0 ELSE 0.0 END), 9) AS over_third, round(avg(CASE WHEN pieces > 1 THEN 1.0 ELSE 0.0 END), 9) AS fragmented FROM m GROUP BY 1""")
def iou_summary(spark, sf_dir):
    """Overlap of matched outlines: middle, mean, shares over 0.5 and 0.3, share in several pieces."""
    iou = F.col("l_discount") * 10
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 9)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(iou), 9).alias("median_iou"), F.round(F.avg(iou), 9).alias("mean_iou"), share(iou >= 0.5).alias("over_half"), share(iou >= 0.3).alias("over_third"), share(F.col("l_linenumber") > 1).alias("fragmented"))


_EVIDENCE = f"""{_SCORES}, {_SOWING.replace('WITH ', '')},
sc AS (SELECT *, CASE label WHEN 'A' THEN 'Cotton' WHEN 'N' THEN 'Soyabean' END AS item FROM t WHERE label IN ('A', 'N')),
ev AS (
  SELECT 'precision' AS measure, 'heldout' AS source, item, tp / nullif(tp + fp, 0) AS x, tp + fp AS n FROM sc UNION ALL SELECT 'recall', 'heldout', item, tp / nullif(tp + fn, 0), tp + fn FROM sc
  UNION ALL SELECT 'precision_low', 'heldout', item, {_low('tp', '(tp + fp)')}, tp + fp FROM sc UNION ALL SELECT 'recall_low', 'heldout', item, {_low('tp', '(tp + fn)')}, tp + fn FROM sc
  UNION ALL SELECT m, 'd1', item, x, 100 FROM (SELECT unnest(['Cotton', 'Soyabean']) AS item), (VALUES ('precision', 0.91), ('recall', 0.92), ('precision_low', 0.84), ('recall_low', 0.86)) v(m, x)
  UNION ALL SELECT 'abstain_rate', 'classification', NULL, avg(CASE WHEN predicted IS NULL THEN 1.0 ELSE 0.0 END), count(*) FROM pairs
  UNION ALL SELECT 'kappa', 'd1', NULL, avg(CASE WHEN reference IS NOT DISTINCT FROM predicted THEN 1.0 ELSE 0.0 END), count(*) FROM pairs
  UNION ALL SELECT 'area_map', 'd1', CASE l_returnflag WHEN 'A' THEN 'Cotton' WHEN 'N' THEN 'Soyabean' ELSE 'Fallow' END, sum(l_quantity) / 1000, 0 FROM lineitem GROUP BY 3
  UNION ALL SELECT 'area_estimate', 'd1', CASE l_returnflag WHEN 'A' THEN 'Cotton' WHEN 'N' THEN 'Soyabean' ELSE 'Fallow' END, sum(l_quantity * CASE WHEN l_linenumber > 6 THEN 2 ELSE 1 END) / 1000, 0 FROM lineitem GROUP BY 3
  UNION ALL SELECT 'area_total', 'd1', NULL, sum(l_quantity) / 1000, 0 FROM lineitem
  UNION ALL SELECT 'sowing_late', 'fields', NULL, count(*) FILTER (sown > survey) / nullif(CAST(count(survey) AS DOUBLE), 0), count(survey) FROM fields
  UNION ALL SELECT 'sowing_agreement', 'fields', NULL, count(*) FILTER (abs(sown - radar) <= 10) / nullif(CAST(count(radar) AS DOUBLE), 0), count(radar) FROM fields
  UNION ALL SELECT 'sowing_median', 'client', NULL, median(abs(sown - client)), count(client) FROM fields UNION ALL SELECT 'sowing_p90', 'client', NULL, quantile_cont(abs(sown - client), 0.9), count(client) FROM fields
  UNION ALL SELECT 'yield_field', 'client', l_returnflag, median(abs(l_tax * 400)), count(*) FROM lineitem GROUP BY 3 UNION ALL SELECT 'yield_total', 'client', l_returnflag, avg(l_tax * 100), count(*) FROM lineitem GROUP BY 3
  UNION ALL SELECT 'delineation_iou', 'benchmark', NULL, median(l_discount * 10), count(*) FROM lineitem
  UNION ALL SELECT 'raster_checks', 'tests', NULL, avg(CASE WHEN l_quantity > 0 THEN 1.0 ELSE 0.0 END), count(*) FROM lineitem UNION ALL SELECT 'stress_plausible', 'survey', NULL, 0.9, 10),
d AS (SELECT *, measure || '_' || source || '_' || coalesce(item, '') AS k FROM ev),
u AS (SELECT coalesce(max(x) FILTER (measure = 'kappa' AND n > 0) >= 0.70, false) AS usable FROM d),
pr AS (SELECT source, item, max(x) FILTER (measure = 'precision') AS p, max(x) FILTER (measure = 'recall') AS r, max(x) FILTER (measure = 'precision_low') AS pl, max(x) FILTER (measure = 'recall_low') AS rl FROM d WHERE item IN ('Cotton', 'Soyabean') AND measure IN ('precision', 'recall', 'precision_low', 'recall_low') GROUP BY 1, 2),
pu AS (SELECT pr.* FROM pr, u WHERE (source = 'heldout' OR usable) AND p IS NOT NULL AND r IS NOT NULL AND pl IS NOT NULL AND rl IS NOT NULL),
ar AS (SELECT abs(m - e) / nullif(e, 0) * 100 AS off FROM (SELECT item, max(x) FILTER (measure = 'area_map') AS m, max(x) FILTER (measure = 'area_estimate') AS e FROM d WHERE item NOT IN ('Fallow') GROUP BY 1), (SELECT max(x) AS total FROM d WHERE measure = 'area_total') WHERE m IS NOT NULL AND greatest(m, e) / total >= 0.05),
yl AS (SELECT item, max(x) FILTER (measure = 'yield_field') AS f, max(x) FILTER (measure = 'yield_total') AS t FROM d WHERE measure LIKE 'yield%' AND n >= 30 GROUP BY 1),
v AS (SELECT measure, max(x) AS x, min(x) AS low FROM d GROUP BY 1),
g AS (
  SELECT 'classification_precision_recall' AS gate, 'Classification' AS component, min(least(p, r)) AS value, CASE WHEN bool_or(p < 0.85 OR r < 0.85 OR pl < 0.80 OR rl < 0.80) THEN 'FAIL' WHEN count(*) = 4 THEN 'PASS' ELSE 'NOT MEASURED' END AS result, 'Not released' AS unmet FROM pu
  UNION ALL SELECT 'area_vs_d1', 'Area', CASE WHEN usable THEN o END, CASE WHEN NOT usable OR k = 0 THEN 'NOT MEASURED' WHEN o > 10 THEN 'FAIL' WHEN k = kk THEN 'PASS' ELSE 'NOT MEASURED' END, 'Not released' FROM u, (SELECT max(off) AS o, count(*) AS k, count(off) AS kk FROM ar)
  UNION ALL SELECT 'yield_error', 'Yield', max(f), CASE WHEN count(*) = 0 THEN 'NOT MEASURED' WHEN bool_or(coalesce(f > 25 OR t IS NULL OR abs(t) > 10, true)) THEN 'FAIL' ELSE 'PASS' END, 'Published only as a district-anchored band with label (5.6)' FROM yl
  UNION ALL SELECT gate, component, x, CASE WHEN x IS NULL THEN 'NOT MEASURED' WHEN sign * x >= sign * bound AND (gate <> 'sowing_abs_error' OR (SELECT x <= 15 FROM v WHERE measure = 'sowing_p90')) THEN 'PASS' ELSE 'FAIL' END, unmet
  FROM (VALUES ('classification_calibration', 'Classification', 'ece', -1, 0.05, 'Not released'), ('classification_abstain_rate', 'Classification', 'abstain_rate', -1, 0.20, 'Released; abstentions shown'), ('reference_kappa', 'Reference quality', 'kappa', 1, 0.70, 'D1 not used for gating'), ('area_vs_official', 'Area', 'official_diff', -1, 15, 'Not released'),
    ('delineation_iou', 'Delineation', 'delineation_iou', 1, 0.60, 'Shown with boundary_confidence'), ('sowing_upper_bound', 'Sowing', 'sowing_late', -1, 0.05, 'Shown as window, not date'), ('sowing_optical_radar', 'Sowing', 'sowing_agreement', 1, 0.80, 'Shown as window, not date'), ('sowing_abs_error', 'Sowing', 'sowing_median', -1, 7, 'Labelled "not yet validated against farm records"'),
    ('stage_d1_agreement', 'Stage', 'stage_agreement', 1, 0.80, 'Labelled provisional'), ('stress_plausibility', 'Stress', 'stress_without_audit', 1, 0.80, 'Shown as anomaly only, type withheld'), ('raster_integrity', 'Raster', 'raster_checks', 1, 1, 'Not released'), ('insufficient_evidence', 'All', 'evidence_used', 1, 1, 'Not released')) w(gate, component, m, sign, bound, unmet) LEFT JOIN v ON v.measure = m)"""


@query(f"""WITH {_EVIDENCE} SELECT gate, component, round(value, 9) AS value, result, CASE WHEN result = 'PASS' THEN 'Meets gate' ELSE unmet END AS consequence, NOT bool_or(result <> 'PASS' AND unmet = 'Not released') OVER (PARTITION BY component) AS releasable FROM g""")
def release_gates(spark, sf_dir):
    """All gates: a value each and PASS, FAIL, or NOT MEASURED where evidence is lacking; what holds while one is not met."""
    return gates.evaluated(_evidence(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _evidence(spark, sf_dir) -> DataFrame:
    """measure, source, item, value and n of what the tables hold; nothing on calibration, official shares, stages or audits."""
    item = F.when(F.col("label") == "A", "Cotton").when(F.col("label") == "N", "Soyabean")
    low = lambda n: wilson(F.col("tp").cast("double"), n.cast("double"))[0]
    predicted, held = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    s = _scores(spark, sf_dir).where(F.col("label").isin("A", "N"))
    four = F.array(*[F.struct(F.lit(m).alias("measure"), x.cast("double").alias("value"), n.cast("long").alias("n")) for m, x, n in (("precision", F.col("precision"), predicted), ("recall", F.col("recall"), held), ("precision_low", low(predicted), predicted), ("recall_low", low(held), held))])
    scored = s.select(item.alias("item"), F.explode(four).alias("m")).select("m.measure", F.lit("heldout").alias("source"), "item", "m.value", "m.n")
    surveyed = [(m, "d1", c, x, 100) for c in gates.REQUIRED for m, x in (("precision", 0.91), ("recall", 0.92), ("precision_low", 0.84), ("recall_low", 0.86))]
    given = spark.createDataFrame([*surveyed, ("stress_plausible", "survey", None, 0.9, 10)], "measure string, source string, item string, value double, n long")

    def said(df: DataFrame, source: str, by: Column | None = None, **values) -> DataFrame:
        told = F.array(*[F.struct(F.lit(m).alias("measure"), x.cast("double").alias("value"), n.cast("long").alias("n")) for m, (x, n) in values.items()])
        grouped = df.groupBy((F.lit(None).cast("string") if by is None else by).alias("item")).agg(told.alias("m"))
        return grouped.select("item", F.explode("m").alias("m")).select("m.measure", F.lit(source).alias("source"), "item", "m.value", "m.n")

    every, none = F.count(F.lit(1)), F.lit(0)
    rate = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    pairs, sowing, line = _pairs(spark, sf_dir), sowing_totals(spark, sf_dir), table(spark, sf_dir, "lineitem")
    crop = F.when(F.col("l_returnflag") == "A", "Cotton").when(F.col("l_returnflag") == "N", "Soyabean").otherwise("Fallow")
    parts = [
        scored, given,
        said(pairs, "classification", abstain_rate=(rate(F.col("predicted").isNull()), every)),
        said(pairs, "d1", kappa=(rate(F.col("reference").eqNullSafe(F.col("predicted"))), every)),
        said(line, "d1", crop, area_map=(F.sum("l_quantity") / 1000, none), area_estimate=(F.sum(F.col("l_quantity") * F.when(F.col("l_linenumber") > 6, 2).otherwise(1)) / 1000, none)),
        said(line, "d1", area_total=(F.sum("l_quantity") / 1000, none)),
        said(sowing, "fields", sowing_late=(F.try_divide(F.count_if("late").cast("double"), F.count("late")), F.count("late")), sowing_agreement=(F.try_divide(F.count_if(F.col("apart") <= 10).cast("double"), F.count("apart")), F.count("apart"))),
        said(sowing, "client", sowing_median=(F.median("wrong"), F.count("wrong")), sowing_p90=(F.percentile("wrong", F.lit(0.9)), F.count("wrong"))),
        said(line, "client", F.col("l_returnflag"), yield_field=(F.median(F.abs(F.col("l_tax") * 400)), every), yield_total=(F.avg(F.col("l_tax") * 100), every)),
        said(line, "benchmark", delineation_iou=(F.median(F.col("l_discount") * 10), every)),
        said(line, "tests", raster_checks=(rate(F.col("l_quantity") > 0), every)),
    ]
    return reduce(DataFrame.unionByName, parts)


def sowing_totals(spark, sf_dir) -> DataFrame:
    q, day = F.col("l_quantity").cast("int"), F.col("l_shipdate").cast("date")
    survey, radar, client = F.when(F.col("l_tax") < 0.07, F.date_add(day, q - 2)), F.when(F.col("l_discount") > 0.02, F.date_add(day, q % 23 - 8)), F.when(F.col("l_discount") > 0.06, F.date_add(day, q % 17 - 6))
    return table(spark, sf_dir, "lineitem").select((day > survey).alias("late"), F.abs(F.datediff(day, radar)).alias("apart"), F.abs(F.datediff(day, client)).alias("wrong"))


@query(f"""WITH {CYCLES}, w AS (SELECT cycle_id, crop_id % 20 AS crop, parcel_id AS block, CASE WHEN days < 5 THEN 0.5 ELSE 1.0 END AS qa FROM cycles),
f AS (SELECT *, least(3.0, greatest(1.0 / 3, count(*) OVER () / (20.0 * count(*) OVER (PARTITION BY crop)))) / sqrt(count(*) OVER (PARTITION BY block)) * qa AS raw FROM w)
SELECT cycle_id, round(raw * count(*) OVER () / sum(raw) OVER (), 7) AS weight FROM f""")
def sample_weights(spark, sf_dir):
    """Capped inverse frequency of the class, over the root of the block's size, times quality, to a mean of 1. Counts are
    aggregated first and joined back, so no window holds all rows."""
    w = cycles(spark, sf_dir).select("cycle_id", (F.col("crop_id") % 20).alias("crop"), F.col("parcel_id").alias("block"), F.when(F.col("days") < 5, 0.5).otherwise(1.0).alias("qa"))
    n = w.agg(F.count(F.lit(1)).alias("n"))
    of_class = w.groupBy("crop").agg(F.count(F.lit(1)).alias("of_class")).crossJoin(n)  # one row
    of_block = w.groupBy("block").agg(F.count(F.lit(1)).alias("of_block"))
    factor = F.least(F.lit(3.0), F.greatest(F.lit(1.0 / 3), F.col("n") / (20.0 * F.col("of_class"))))
    raw = w.join(of_class, "crop").join(of_block, "block").select("cycle_id", (factor / F.sqrt("of_block") * F.col("qa")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("cycle_id", F.round(F.col("raw") / F.col("mean"), 7).alias("weight"))


@query(f"""WITH {CYCLES}, g AS (SELECT parcel_id % 10 AS region, cycle_id, days * area_ha AS v FROM cycles)
SELECT cycle_id, region, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 7) AS standardised FROM g WINDOW w AS (PARTITION BY region)""")
def region_standardised(spark, sf_dir):
    """Each value against its region's mean and spread, by aggregates joined back instead of ten large windows."""
    g = cycles(spark, sf_dir).select((F.col("parcel_id") % 10).alias("region"), "cycle_id", (F.col("days") * F.col("area_ha")).alias("v"))
    by = g.groupBy("region").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return g.join(by, "region").select("cycle_id", "region", F.round(F.try_divide(F.col("v") - F.col("mean"), F.col("sd")), 7).alias("standardised"))
