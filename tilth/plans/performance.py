"""Queries over a parcel's scenes: stage baselines, anomalies, health, yield potential, land cover and crop presence.

A scene is an observation with a signal; scenes of a parcel are numbered from 0 by day and id. The signal stands for the
composite index, the cloud share for the canopy's water.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.plans.base import OBS, observations, query

#: Fixed values of the anomaly rules, the scores and the land-cover votes.
IQR_FACTOR, SUSTAINED, CV_MEDIUM, CV_HIGH, HIGH_MULT = 2.0, 4, 0.48, 0.62, 1.25
Z_MEDIUM, Z_HIGH, Z_WATER, Z_WATER_HIGH = 1.5, 2.5, 1.8, 2.5
BARE, VEGETATED, EVERGREEN, AMPLITUDE, BARE_BSI, DOMINANT = 0.20, 0.45, 0.55, 0.18, 0.35, 0.60

SCENE = f"""{OBS},
scene AS (
  SELECT parcel_id, obs_id, day, signal AS cvi, cloud / 100.0 - 0.5 AS lswi,
         row_number() OVER (PARTITION BY parcel_id ORDER BY day, obs_id) - 1 AS i, count(*) OVER (PARTITION BY parcel_id) AS n
  FROM obs WHERE signal IS NOT NULL),
staged AS (
  SELECT *, CASE WHEN i / greatest(n - 1, 1) < 0.25 THEN 'VEGETATIVE' WHEN i / greatest(n - 1, 1) < 0.5 THEN 'FLOWERING'
                 WHEN i / greatest(n - 1, 1) < 0.75 THEN 'GRAIN_FILL' ELSE 'RIPENING' END AS stage
  FROM scene)"""


def stage_of(i: Column, n: Column) -> Column:
    at = i / F.greatest(n - 1, F.lit(1))
    return F.when(at < 0.25, "VEGETATIVE").when(at < 0.5, "FLOWERING").when(at < 0.75, "GRAIN_FILL").otherwise("RIPENING")


def scenes(spark, sf_dir) -> DataFrame:
    own = Window.partitionBy("parcel_id")
    rows = observations(spark, sf_dir).where("signal IS NOT NULL")
    numbered = rows.select(
        "parcel_id",
        "obs_id",
        "day",
        F.col("signal").alias("cvi"),
        (F.col("cloud") / 100.0 - 0.5).alias("lswi"),
        (F.row_number().over(own.orderBy("day", "obs_id")) - 1).alias("i"),
        F.count(F.lit(1)).over(own).alias("n"),
    )
    return numbered.withColumn("stage", stage_of(F.col("i"), F.col("n")))


BASELINE = """base AS (
  SELECT parcel_id, stage, count(*) AS looks, avg(cvi) AS cvi_mean, stddev_pop(cvi) AS cvi_std, avg(lswi) AS lswi_mean, stddev_pop(lswi) AS lswi_std
  FROM staged GROUP BY 1, 2)"""


def baseline(scene: DataFrame) -> DataFrame:
    stats = [f(c).alias(f"{c}_{name}") for c in ("cvi", "lswi") for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return scene.groupBy("parcel_id", "stage").agg(F.count(F.lit(1)).alias("looks"), *stats)


@query(f"""WITH {SCENE}, {BASELINE}
SELECT parcel_id, stage, looks, round(cvi_mean, 9) AS cvi_mean, round(cvi_std, 9) AS cvi_std, round(lswi_mean, 9) AS lswi_mean, round(lswi_std, 9) AS lswi_std
FROM base""")
def stage_baseline(spark, sf_dir):
    """Mean and spread of the indices in each growth stage of the parcel."""
    names = ("cvi_mean", "cvi_std", "lswi_mean", "lswi_std")
    return baseline(scenes(spark, sf_dir)).select("parcel_id", "stage", "looks", *[F.round(c, 9).alias(c) for c in names])


MOMENTUM = """step AS (
  SELECT parcel_id, n, i, cvi - lag(cvi) OVER (PARTITION BY parcel_id ORDER BY i) AS d FROM scene WHERE i < greatest(n // 2, 2)),
momentum AS (
  SELECT parcel_id, CASE WHEN max(n) < 3 THEN 7.5 ELSE least(15.0, least(8.0, max(d) / 0.08 * 8.0)
         + least(7.0, avg(CASE WHEN d > 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) * 7.0)) END AS momentum
  FROM step GROUP BY 1)"""


def momentum(scene: DataFrame) -> DataFrame:
    """Steepest rise and share of rises in the first half of the scenes; under three scenes the middle score."""
    half = scene.where(F.col("i") < F.greatest(F.floor(F.col("n") / 2), F.lit(2)))
    step = half.withColumn("d", F.col("cvi") - F.lag("cvi").over(Window.partitionBy("parcel_id").orderBy("i")))
    slope = F.least(F.lit(8.0), F.max("d") / 0.08 * 8.0)
    smooth = F.least(F.lit(7.0), F.avg(F.when(F.col("d") > 0, 1.0).when(F.col("d").isNotNull(), 0.0)) * 7.0)
    score = F.when(F.max("n") < 3, 7.5).otherwise(F.least(F.lit(15.0), slope + smooth))
    return step.groupBy("parcel_id").agg(score.alias("momentum"))


@query(f"WITH {SCENE}, {MOMENTUM} SELECT parcel_id, round(momentum, 9) AS momentum FROM momentum")
def growth_momentum(spark, sf_dir):
    return momentum(scenes(spark, sf_dir)).select("parcel_id", F.round("momentum", 9).alias("momentum"))


ANOMALY = f"""fence AS (
  SELECT parcel_id, quantile_cont(cvi, 0.25) AS q1, greatest(quantile_cont(cvi, 0.75) - quantile_cont(cvi, 0.25), 0.05) AS iqr,
         arg_min(i, (-cvi, i)) AS peak
  FROM scene WHERE n >= 5 GROUP BY 1),
fenced AS (SELECT s.*, q1, iqr, peak FROM staged s JOIN fence USING (parcel_id)),
low AS (SELECT *, i - row_number() OVER (PARTITION BY parcel_id ORDER BY i) AS run FROM fenced WHERE cvi < q1),
run AS (
  SELECT parcel_id, min(i) AS first_i, max(i) AS last_i, (min(i) + max(i) + 1) // 2 AS i, any_value(n) AS n, any_value(q1) - avg(cvi) AS magnitude, any_value(iqr) AS iqr
  FROM low GROUP BY parcel_id, run HAVING count(*) >= {SUSTAINED}),
near AS (
  SELECT parcel_id, any_value(peak) AS i, any_value(n) AS n, count(*) AS k, stddev_pop(cvi) / greatest(avg(cvi), 0.01) AS cv
  FROM fenced WHERE abs(i - peak) <= greatest(1, n // 4) GROUP BY 1),
z AS (
  SELECT f.*, (cvi - cvi_mean) / greatest(cvi_std, 0.001) AS zc, (lswi - lswi_mean) / greatest(lswi_std, 0.001) AS zl, cvi_mean, lswi_mean
  FROM fenced f JOIN base USING (parcel_id, stage)),
found AS (
  SELECT parcel_id, 'sudden_drop' AS kind, f.i, f.n, f.i AS first_i, f.i AS last_i, q1 - cvi AS magnitude, iqr, NULL AS score FROM fenced f
  WHERE cvi < q1 - {IQR_FACTOR} * iqr AND NOT EXISTS (SELECT 1 FROM run r WHERE r.parcel_id = f.parcel_id AND f.i BETWEEN r.first_i AND r.last_i)
  UNION ALL SELECT parcel_id, 'sustained_depression', i, n, first_i, last_i, magnitude, iqr, NULL FROM run
  UNION ALL SELECT parcel_id, 'high_volatility', i, n, i, i, cv, NULL, cv FROM near WHERE k >= 3 AND cv > {CV_MEDIUM}
  UNION ALL SELECT parcel_id, 'baseline_departure', i, n, i, i, cvi_mean - cvi, NULL, zc FROM z WHERE zc <= -{Z_MEDIUM}
  UNION ALL SELECT parcel_id, 'water_stress', i, n, i, i, lswi_mean - lswi, NULL, zl FROM z WHERE zl <= -{Z_WATER}),
anomaly AS (
  SELECT parcel_id, kind, CAST(i AS INTEGER) AS i, n, first_i, last_i, magnitude, CASE WHEN i / greatest(n - 1, 1) < 0.25 THEN 'VEGETATIVE'
         WHEN i / greatest(n - 1, 1) < 0.5 THEN 'FLOWERING' WHEN i / greatest(n - 1, 1) < 0.75 THEN 'GRAIN_FILL' ELSE 'RIPENING' END AS stage,
    CASE kind
      WHEN 'high_volatility' THEN CASE WHEN score > {CV_HIGH} THEN 'HIGH' ELSE 'MEDIUM' END
      WHEN 'baseline_departure' THEN CASE WHEN score <= -{Z_HIGH} AND stage IN ('FLOWERING', 'GRAIN_FILL') THEN 'HIGH'
           WHEN score <= -{Z_HIGH} OR stage IN ('FLOWERING', 'GRAIN_FILL') THEN 'MEDIUM' ELSE 'LOW' END
      WHEN 'water_stress' THEN CASE WHEN score <= -{Z_WATER_HIGH} AND stage IN ('FLOWERING', 'GRAIN_FILL') THEN 'HIGH' ELSE 'MEDIUM' END
      ELSE CASE WHEN stage IN ('FLOWERING', 'GRAIN_FILL') AND magnitude > {HIGH_MULT} * iqr THEN 'HIGH' WHEN magnitude > 0.35 * iqr THEN 'MEDIUM' ELSE 'LOW' END
    END AS impact
  FROM found)"""


def anomalies(scene: DataFrame) -> DataFrame:
    """parcel_id, kind, i, n, first_i, last_i, magnitude, stage, impact of every anomaly: drops under the fence outside
    of longer depressions, depressions of at least SUSTAINED scenes, a restless peak, and departures of either index
    from the parcel's own stage."""
    fence = scene.where("n >= 5").groupBy("parcel_id").agg(
        F.percentile("cvi", F.lit(0.25)).alias("q1"),
        F.greatest(F.percentile("cvi", F.lit(0.75)) - F.percentile("cvi", F.lit(0.25)), F.lit(0.05)).alias("iqr"),
        F.min_by("i", F.struct(-F.col("cvi"), F.col("i"))).alias("peak"),
    )
    fenced = scene.join(fence, "parcel_id")
    by = Window.partitionBy("parcel_id").orderBy("i")
    low = fenced.where("cvi < q1").withColumn("run", F.col("i") - F.row_number().over(by))
    long = low.groupBy("parcel_id", "run").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.first("n").alias("n"), (F.first("q1") - F.avg("cvi")).alias("magnitude"), F.first("iqr").alias("iqr"), F.count(F.lit(1)).alias("k")
    )
    long = long.where(F.col("k") >= SUSTAINED).withColumn("i", F.floor((F.col("first_i") + F.col("last_i") + 1) / 2).cast("int"))
    inside = Window.partitionBy("parcel_id", "run")
    # a drop that belongs to a run of low scenes long enough is covered by it
    lone = low.withColumn("k", F.count(F.lit(1)).over(inside)).where((F.col("k") < SUSTAINED) & (F.col("cvi") < F.col("q1") - IQR_FACTOR * F.col("iqr")))
    around = fenced.where(F.abs(F.col("i") - F.col("peak")) <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    near = around.groupBy("parcel_id").agg(F.first("peak").alias("i"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.stddev_pop("cvi") / F.greatest(F.avg("cvi"), F.lit(0.01))).alias("cv"))
    near = near.where((F.col("k") >= 3) & (F.col("cv") > CV_MEDIUM))
    own = fenced.join(baseline(scene), ["parcel_id", "stage"])
    z = lambda c: (F.col(c) - F.col(f"{c}_mean")) / F.greatest(F.col(f"{c}_std"), F.lit(0.001))

    def part(df: DataFrame, kind: str, magnitude: Column, score: Column | None = None, iqr: bool = False) -> DataFrame:
        ends = [F.col(c) for c in ("first_i", "last_i")] if kind == "sustained_depression" else [F.col("i").alias("first_i"), F.col("i").alias("last_i")]
        none = F.lit(None).cast("double")
        return df.select("parcel_id", F.lit(kind).alias("kind"), "i", "n", *ends, magnitude.alias("magnitude"), (F.col("iqr") if iqr else none).alias("iqr"), (none if score is None else score).alias("score"))

    found = part(lone, "sudden_drop", F.col("q1") - F.col("cvi"), iqr=True)
    found = found.unionByName(part(long, "sustained_depression", F.col("magnitude"), iqr=True))
    found = found.unionByName(part(near, "high_volatility", F.col("cv"), F.col("cv")))
    found = found.unionByName(part(own.where(z("cvi") <= -Z_MEDIUM), "baseline_departure", F.col("cvi_mean") - F.col("cvi"), z("cvi")))
    found = found.unionByName(part(own.where(z("lswi") <= -Z_WATER), "water_stress", F.col("lswi_mean") - F.col("lswi"), z("lswi")))
    found = found.withColumn("stage", stage_of(F.col("i"), F.col("n")))
    critical, score, size = F.col("stage").isin("FLOWERING", "GRAIN_FILL"), F.col("score"), F.col("magnitude")
    impact = (
        F.when(F.col("kind") == "high_volatility", F.when(score > CV_HIGH, "HIGH").otherwise("MEDIUM"))
        .when(F.col("kind") == "baseline_departure", F.when((score <= -Z_HIGH) & critical, "HIGH").when((score <= -Z_HIGH) | critical, "MEDIUM").otherwise("LOW"))
        .when(F.col("kind") == "water_stress", F.when((score <= -Z_WATER_HIGH) & critical, "HIGH").otherwise("MEDIUM"))
        .when(critical & (size > HIGH_MULT * F.col("iqr")), "HIGH")
        .when(size > 0.35 * F.col("iqr"), "MEDIUM")
        .otherwise("LOW")
    )
    return found.select("parcel_id", "kind", "i", "n", "first_i", "last_i", "magnitude", "stage", impact.alias("impact"))


@query(f"""WITH {SCENE}, {BASELINE}, {ANOMALY} SELECT parcel_id, kind, i, stage, round(magnitude, 9) AS magnitude, impact FROM anomaly""")
def scene_anomalies(spark, sf_dir):
    return anomalies(scenes(spark, sf_dir)).select("parcel_id", "kind", "i", "stage", F.round("magnitude", 9).alias("magnitude"), "impact")


HEALTH = """shape AS (
  SELECT parcel_id, any_value(n) AS n, avg(CASE WHEN i < greatest(1, n // 3) THEN cvi END) AS early,
         coalesce(max(CASE WHEN i >= greatest(1, n // 3) AND i < 2 * greatest(1, n // 3) THEN cvi END), max(cvi)) AS mid,
         avg(CASE WHEN i >= 2 * greatest(1, n // 3) THEN cvi END) AS late, max(cvi) AS top, avg(cvi) AS mean, sum(cvi) AS auc,
         avg(CASE WHEN cvi > 0.30 THEN 1.0 ELSE 0.0 END) AS canopy
  FROM scene GROUP BY 1),
hit AS (SELECT parcel_id, count(*) AS events, sum(CASE impact WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.0 ELSE 0.35 END) AS lost FROM anomaly GROUP BY 1),
health AS (
  SELECT parcel_id, n, CASE WHEN n < 3 THEN 50.0 ELSE least(100.0,
      least(30.0, least(10.0, greatest(0.0, (mid - early) / greatest(top, 0.01) * 15.0)) + least(10.0, top / 0.70 * 10.0)
        + CASE WHEN mid <= late THEN 0.0 WHEN mid - late > 0.20 THEN 10.0 WHEN mid - late > 0.10 THEN 7.0 WHEN mid - late > 0.05 THEN 4.0 ELSE 2.0 END)
      + least(15.0, top / 0.75 * 15.0) + least(10.0, mean / 0.55 * 10.0) + greatest(0.0, 20.0 - coalesce(lost, 0)) + momentum + least(10.0, canopy * 10.0)) END AS health,
    coalesce(events, 0) AS events
  FROM shape LEFT JOIN hit USING (parcel_id) JOIN momentum USING (parcel_id))"""


def shape(scene: DataFrame) -> DataFrame:
    third, i, cvi = F.greatest(F.lit(1), F.floor(F.col("n") / 3)), F.col("i"), F.col("cvi")
    return scene.groupBy("parcel_id").agg(
        F.first("n").alias("n"),
        F.avg(F.when(i < third, cvi)).alias("early"),
        F.coalesce(F.max(F.when((i >= third) & (i < 2 * third), cvi)), F.max(cvi)).alias("mid"),
        F.avg(F.when(i >= 2 * third, cvi)).alias("late"),
        F.max(cvi).alias("top"),
        F.avg(cvi).alias("mean"),
        F.sum(cvi).alias("auc"),
        F.avg(F.when(cvi > 0.30, 1.0).otherwise(0.0)).alias("canopy"),
    )


def health(scene: DataFrame) -> DataFrame:
    """parcel_id, n, health and events: arc 30, biomass 25, stability 20, momentum 15 and canopy 10 points."""
    most = lambda points, x: F.least(F.lit(points), x)
    weight = F.when(F.col("impact") == "HIGH", 2.0).when(F.col("impact") == "MEDIUM", 1.0).otherwise(0.35)
    hit = anomalies(scene).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("events"), F.sum(weight).alias("lost"))
    fall = F.col("mid") - F.col("late")
    decline = F.when(F.coalesce(fall, F.lit(-1.0)) <= 0, 0.0).when(fall > 0.20, 10.0).when(fall > 0.10, 7.0).when(fall > 0.05, 4.0).otherwise(2.0)
    rise = most(10.0, F.greatest(F.lit(0.0), (F.col("mid") - F.col("early")) / F.greatest(F.col("top"), F.lit(0.01)) * 15.0))
    arc = most(30.0, rise + most(10.0, F.col("top") / 0.70 * 10.0) + decline)
    biomass = most(15.0, F.col("top") / 0.75 * 15.0) + most(10.0, F.col("mean") / 0.55 * 10.0)
    stability = F.greatest(F.lit(0.0), 20.0 - F.coalesce("lost", F.lit(0.0)))
    rows = shape(scene).join(hit, "parcel_id", "left").join(momentum(scene), "parcel_id")
    score = most(100.0, arc + biomass + stability + F.col("momentum") + most(10.0, F.col("canopy") * 10.0))
    return rows.select("parcel_id", "n", F.when(F.col("n") < 3, 50.0).otherwise(score).alias("health"), F.coalesce("events", F.lit(0).cast("long")).alias("events"))


@query(f"""WITH {SCENE}, {BASELINE}, {ANOMALY}, {MOMENTUM}, {HEALTH} SELECT parcel_id, n, round(health, 8) AS health, events FROM health""")
def health_score(spark, sf_dir):
    return health(scenes(spark, sf_dir)).select("parcel_id", "n", F.round("health", 8).alias("health"), "events")


YIELD = """touched AS (
  SELECT DISTINCT parcel_id, unnest(CASE WHEN kind = 'sustained_depression' THEN range(first_i, last_i + 1)
         WHEN impact = 'HIGH' THEN [greatest(0, i - 1), i, least(n - 1, i + 1)] ELSE [i] END) AS i FROM anomaly),
dirty AS (SELECT parcel_id, count(*) AS k FROM touched GROUP BY 1),
top AS (SELECT parcel_id, arg_min(i, (-cvi, i)) AS peak FROM scene GROUP BY 1),
steady AS (
  SELECT parcel_id, CASE WHEN count(*) >= 2 THEN least(15.0, greatest(0.0, (1.0 - stddev_pop(cvi) / greatest(avg(cvi), 0.01) / 0.60) * 15.0)) ELSE 7.5 END AS steady
  FROM scene JOIN top USING (parcel_id) WHERE abs(i - peak) <= greatest(1, n // 4) GROUP BY 1),
ratio AS (SELECT *, auc / greatest(CASE WHEN top >= 0.65 THEN 0.45 WHEN top >= 0.40 THEN 0.30 ELSE 0.20 END * n, 0.1) AS r FROM shape),
yielded AS (
  SELECT parcel_id, n, r, CASE WHEN n < 3 THEN 50.0 ELSE least(100.0,
      CASE WHEN r >= 1.0 THEN 35.0 WHEN r >= 0.85 THEN 26.0 + (r - 0.85) / 0.15 * 9.0 WHEN r >= 0.70 THEN 17.0 + (r - 0.70) / 0.15 * 9.0
           WHEN r >= 0.50 THEN 6.0 + (r - 0.50) / 0.20 * 11.0 ELSE r / 0.50 * 6.0 END
      + greatest(0.0, (1.0 - coalesce(k, 0) / n) * 30.0) + least(20.0, top / 0.75 * 20.0) + steady) END AS potential
  FROM ratio LEFT JOIN dirty USING (parcel_id) JOIN steady USING (parcel_id))"""


def potential(scene: DataFrame) -> DataFrame:
    """parcel_id, n, r and potential: accumulation 35, scenes free of anomalies 30, peak 20 and steadiness 15 points."""
    events = anomalies(scene)
    spread = F.when(F.col("kind") == "sustained_depression", F.sequence("first_i", "last_i"))
    spread = spread.when(F.col("impact") == "HIGH", F.array(F.greatest(F.lit(0), F.col("i") - 1), F.col("i"), F.least(F.col("n").cast("int") - 1, F.col("i") + 1)))
    dirty = events.select("parcel_id", F.explode(spread.otherwise(F.array("i"))).alias("i")).distinct().groupBy("parcel_id").agg(F.count(F.lit(1)).alias("k"))
    top = scene.groupBy("parcel_id").agg(F.min_by("i", F.struct(-F.col("cvi"), F.col("i"))).alias("peak"))
    around = scene.join(top, "parcel_id").where(F.abs(F.col("i") - F.col("peak")) <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    cv = F.stddev_pop("cvi") / F.greatest(F.avg("cvi"), F.lit(0.01))
    calm = F.least(F.lit(15.0), F.greatest(F.lit(0.0), (1.0 - cv / 0.60) * 15.0))
    steady = around.groupBy("parcel_id").agg(F.when(F.count(F.lit(1)) >= 2, calm).otherwise(7.5).alias("steady"))
    usual = F.when(F.col("top") >= 0.65, 0.45).when(F.col("top") >= 0.40, 0.30).otherwise(0.20)
    rows = shape(scene).withColumn("r", F.col("auc") / F.greatest(usual * F.col("n"), F.lit(0.1)))
    rows = rows.join(dirty, "parcel_id", "left").join(steady, "parcel_id")
    r = F.col("r")
    grown = (
        F.when(r >= 1.0, 35.0)
        .when(r >= 0.85, 26.0 + (r - 0.85) / 0.15 * 9.0)
        .when(r >= 0.70, 17.0 + (r - 0.70) / 0.15 * 9.0)
        .when(r >= 0.50, 6.0 + (r - 0.50) / 0.20 * 11.0)
        .otherwise(r / 0.50 * 6.0)
    )
    clean = F.greatest(F.lit(0.0), (1.0 - F.coalesce("k", F.lit(0)) / F.col("n")) * 30.0)
    score = F.least(F.lit(100.0), grown + clean + F.least(F.lit(20.0), F.col("top") / 0.75 * 20.0) + F.col("steady"))
    return rows.select("parcel_id", "n", "r", F.when(F.col("n") < 3, 50.0).otherwise(score).alias("potential"))


@query(f"""WITH {SCENE}, {BASELINE}, {ANOMALY}, {HEALTH.split("hit AS")[0].rstrip().rstrip(",")}, {YIELD}
SELECT parcel_id, n, round(r, 9) AS auc_ratio, round(potential, 8) AS potential FROM yielded""")
def yield_potential(spark, sf_dir):
    return potential(scenes(spark, sf_dir)).select("parcel_id", "n", F.round("r", 9).alias("auc_ratio"), F.round("potential", 8).alias("potential"))


@query(f"""WITH {SCENE}, q AS (
  SELECT parcel_id, any_value(n) AS n, max(cvi) AS top, avg(cvi) AS mean, stddev_pop(cvi) / greatest(avg(cvi), 0.01) AS cv, arg_min(i, (-cvi, i)) AS peak,
         max(cvi) - avg(CASE WHEN i < greatest(1, n // 4) THEN cvi END) AS rise, avg(CASE WHEN cvi > 0.35 THEN 1.0 ELSE 0.0 END) AS above,
         (max(CASE WHEN i >= n // 3 AND i < n - n // 3 THEN cvi END) - avg(CASE WHEN i >= n - n // 3 THEN cvi END)) AS arc
  FROM scene GROUP BY 1),
r AS (SELECT parcel_id, n, list_filter([
    CASE WHEN top <= 0.35 THEN 'peak under threshold' END, CASE WHEN above < 0.25 THEN 'too few scenes above threshold' END,
    CASE WHEN peak < greatest(1, n // 4) AND coalesce(arc, 0) < 0.3 AND cv < 0.08 THEN 'early scenes missing' END,
    CASE WHEN peak >= greatest(1, n // 4) AND rise < 0.10 THEN 'rise too small' END,
    CASE WHEN cv < 0.08 THEN 'too flat' END, CASE WHEN cv > 0.80 THEN 'too erratic' END], lambda x: x IS NOT NULL) AS reasons FROM q)
SELECT parcel_id, len(reasons) = 0 AS crop_present, array_to_string(reasons, '; ') AS reason FROM r""")
def crop_present_gate(spark, sf_dir):
    """Peak, share above the threshold, rise (or arc and variation where the early scenes are missing), variation."""
    i, n, cvi = F.col("i"), F.col("n"), F.col("cvi")
    quarter, third = F.greatest(F.lit(1), F.floor(n / 4)), F.floor(n / 3)
    q = scenes(spark, sf_dir).groupBy("parcel_id").agg(
        F.first("n").alias("n"),
        F.max("cvi").alias("top"),
        (F.stddev_pop("cvi") / F.greatest(F.avg("cvi"), F.lit(0.01))).alias("cv"),
        F.min_by("i", F.struct(-cvi, i)).alias("peak"),
        (F.max("cvi") - F.avg(F.when(i < quarter, cvi))).alias("rise"),
        F.avg(F.when(cvi > 0.35, 1.0).otherwise(0.0)).alias("above"),
        (F.max(F.when((i >= third) & (i < n - third), cvi)) - F.avg(F.when(i >= n - third, cvi))).alias("arc"),
    )
    early = F.col("peak") < quarter
    reasons = [
        (F.col("top") <= 0.35, "peak under threshold"),
        (F.col("above") < 0.25, "too few scenes above threshold"),
        (early & (F.coalesce("arc", F.lit(0.0)) < 0.3) & (F.col("cv") < 0.08), "early scenes missing"),
        (~early & (F.col("rise") < 0.10), "rise too small"),
        (F.col("cv") < 0.08, "too flat"),
        (F.col("cv") > 0.80, "too erratic"),
    ]
    reason = F.concat_ws("; ", *[F.when(bad, text) for bad, text in reasons])
    return q.select("parcel_id", (reason == "").alias("crop_present"), reason.alias("reason"))


@query(f"""WITH {OBS}, c AS (SELECT parcel_id, signal AS v, CASE WHEN sensor = 'view' THEN (cloud - 30) / 100.0 END AS water, CASE WHEN sensor = 'click' THEN (cloud - 40) / 100.0 END AS built,
    CASE WHEN sensor = 'signup' THEN cloud / 100.0 END AS soil FROM obs),
e AS (SELECT parcel_id, count(v) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS amp,
    avg(CASE WHEN water > 0 THEN 1.0 WHEN water IS NOT NULL THEN 0.0 END) AS water, avg(CASE WHEN built > 0 THEN 1.0 WHEN built IS NOT NULL THEN 0.0 END) AS built,
    quantile_cont(soil, 0.5) AS soil, avg(CASE WHEN v <= {BARE} THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END) AS bare, avg(CASE WHEN v >= {VEGETATED} THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END) AS veg,
    count(*) FILTER (v >= 0.66) // 3 AS cycles FROM c GROUP BY 1),
s AS (SELECT *, CASE WHEN water >= {DOMINANT} AND p90 < {BARE} THEN 'WATER' WHEN built >= {DOMINANT} AND p90 < 0.30 THEN 'BUILTUP' WHEN soil >= {BARE_BSI} AND p90 < 0.30 THEN 'BARREN'
      WHEN p90 < {BARE} THEN 'BARREN' WHEN p10 >= {EVERGREEN} AND amp < {AMPLITUDE} THEN 'FOREST' WHEN p50 >= {BARE} THEN 'CROPLAND' END AS spectral,
    CASE WHEN cycles > 0 THEN 'CROPLAND' WHEN amp >= {AMPLITUDE} AND veg > 0.05 THEN 'CROPLAND' WHEN amp < {AMPLITUDE} AND bare <= 0.05 AND veg > 0.5 THEN 'PLANTATION'
      WHEN amp < {AMPLITUDE} AND veg < 0.05 THEN 'BARREN' END AS temporal FROM e WHERE n >= 8),
w AS (SELECT *, CASE WHEN spectral IS NULL THEN 0.0 WHEN spectral = 'WATER' THEN least(0.95, 0.55 + water * 0.4) WHEN spectral = 'BUILTUP' THEN least(0.90, 0.50 + built * 0.4)
      WHEN spectral = 'BARREN' THEN 0.85 WHEN spectral = 'FOREST' THEN 0.70 ELSE 0.60 END AS cs,
    CASE WHEN temporal IS NULL THEN 0.0 WHEN cycles > 0 THEN 0.85 WHEN temporal = 'CROPLAND' THEN 0.65 WHEN temporal = 'PLANTATION' THEN 0.55 ELSE 0.80 END AS ct FROM s),
v AS (SELECT *, spectral IS NOT NULL AND spectral = temporal AS agree, coalesce(CASE WHEN cs >= ct THEN spectral ELSE temporal END, 'UNKNOWN') AS class, greatest(cs, ct) AS strongest FROM w),
d AS (SELECT *, CASE WHEN class = 'UNKNOWN' THEN 0.0 WHEN agree THEN least(0.98, strongest + 0.10) ELSE strongest * (0.75 + 0.25 * strongest / (cs + ct)) END AS conf FROM v),
f AS (SELECT parcel_id, n, CASE WHEN class = 'FOREST' AND temporal = 'PLANTATION' THEN 'PLANTATION' ELSE class END AS class, CASE WHEN class = 'FOREST' AND temporal = 'PLANTATION' THEN greatest(conf, ct) ELSE conf END AS conf FROM d
  UNION ALL SELECT parcel_id, n, 'UNKNOWN', 0.0 FROM e WHERE n < 8)
SELECT parcel_id, n, class, round(conf, 9) AS confidence, CASE WHEN class IN ('WATER', 'BUILTUP', 'BARREN', 'FOREST') AND conf >= 0.75 THEN 'reject' WHEN class = 'CROPLAND' AND conf >= 0.45 THEN 'pass' ELSE 'flag' END AS outcome FROM f""")
def landcover_gate(spark, sf_dir):
    """Percentile evidence, a spectral and a temporal vote, and their vote by confidence: pass, flag or reject."""
    share = lambda c, test: F.avg(F.when(test, 1.0).when(F.col(c).isNotNull(), 0.0))
    pct = lambda c, q: F.percentile(c, F.lit(q))
    of = lambda sensor, x: F.when(F.col("sensor") == sensor, x)
    cloud = F.col("cloud")
    c = observations(spark, sf_dir).select("parcel_id", F.col("signal").alias("v"), of("view", (cloud - 30) / 100.0).alias("water"), of("click", (cloud - 40) / 100.0).alias("built"), of("signup", cloud / 100.0).alias("soil"))
    e = c.groupBy("parcel_id").agg(
        F.count("v").alias("n"),
        pct("v", 0.1).alias("p10"),
        pct("v", 0.5).alias("p50"),
        pct("v", 0.9).alias("p90"),
        (pct("v", 0.9) - pct("v", 0.1)).alias("amp"),
        share("water", F.col("water") > 0).alias("water"),
        share("built", F.col("built") > 0).alias("built"),
        pct("soil", 0.5).alias("soil"),
        share("v", F.col("v") <= BARE).alias("bare"),
        share("v", F.col("v") >= VEGETATED).alias("veg"),
        F.floor(F.count_if(F.col("v") >= 0.66) / 3).alias("cycles"),
    )
    p10, p90, amp = F.col("p10"), F.col("p90"), F.col("amp")
    spectral = (
        F.when((F.col("water") >= DOMINANT) & (p90 < BARE), "WATER")
        .when((F.col("built") >= DOMINANT) & (p90 < 0.30), "BUILTUP")
        .when((F.col("soil") >= BARE_BSI) & (p90 < 0.30), "BARREN")
        .when(p90 < BARE, "BARREN")
        .when((p10 >= EVERGREEN) & (amp < AMPLITUDE), "FOREST")
        .when(F.col("p50") >= BARE, "CROPLAND")
    )
    temporal = (
        F.when(F.col("cycles") > 0, "CROPLAND")
        .when((amp >= AMPLITUDE) & (F.col("veg") > 0.05), "CROPLAND")
        .when((amp < AMPLITUDE) & (F.col("bare") <= 0.05) & (F.col("veg") > 0.5), "PLANTATION")
        .when((amp < AMPLITUDE) & (F.col("veg") < 0.05), "BARREN")
    )
    s, t = F.col("spectral"), F.col("temporal")
    sure = F.when(s == "WATER", F.least(F.lit(0.95), 0.55 + F.col("water") * 0.4)).when(s == "BUILTUP", F.least(F.lit(0.90), 0.50 + F.col("built") * 0.4)).when(s == "BARREN", 0.85).when(s == "FOREST", 0.70)
    sure = F.when(s.isNull(), 0.0).otherwise(sure.otherwise(0.60))
    lived = F.when(t.isNull(), 0.0).when(F.col("cycles") > 0, 0.85).when(t == "CROPLAND", 0.65).when(t == "PLANTATION", 0.55).otherwise(0.80)
    w = e.where("n >= 8").withColumns({"spectral": spectral, "temporal": temporal}).withColumns({"cs": sure, "ct": lived})
    cs, ct = F.col("cs"), F.col("ct")
    voted = F.coalesce(F.when(cs >= ct, s).otherwise(t), F.lit("UNKNOWN"))
    strongest = F.greatest(cs, ct)
    agree = s.isNotNull() & t.isNotNull() & (s == t)
    d = w.withColumn("class", voted).withColumn("conf", F.when(F.col("class") == "UNKNOWN", 0.0).when(agree, F.least(F.lit(0.98), strongest + 0.10)).otherwise(strongest * (0.75 + 0.25 * strongest / (cs + ct))))
    woody = F.coalesce((F.col("class") == "FOREST") & (t == "PLANTATION"), F.lit(False))
    f = d.select("parcel_id", "n", F.when(woody, "PLANTATION").otherwise(F.col("class")).alias("class"), F.when(woody, F.greatest("conf", "ct")).otherwise(F.col("conf")).alias("conf"))
    f = f.unionByName(e.where("n < 8").select("parcel_id", "n", F.lit("UNKNOWN").alias("class"), F.lit(0.0).alias("conf")))
    outcome = F.when(F.col("class").isin("WATER", "BUILTUP", "BARREN", "FOREST") & (F.col("conf") >= 0.75), "reject").when((F.col("class") == "CROPLAND") & (F.col("conf") >= 0.45), "pass").otherwise("flag")
    return f.select("parcel_id", "n", "class", F.round("conf", 9).alias("confidence"), outcome.alias("outcome"))
