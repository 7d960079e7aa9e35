"""The composite risk index with its sub-indices, and the decision on a field's crop."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import risk_band
from tilth.plans.base import ANCHOR, CYCLES, OBS, cycles, observations, query

#: Weights of the sub-indices, penalties of anomalies by impact, their cap, the gate's floor.
WEIGHTS = {"landuse": 30.0, "vigor": 25.0, "stability": 20.0, "weather": 25.0}
HIGH, MEDIUM, LOW, MOST = 1.8, 0.55, 0.15, 16.0
GATE_MIN, SUBSTITUTED, NO_EVIDENCE, YEARS, SEASONS = 0.60, 0.85, 25.0, 1.5, 4

_INDEX = f"""{OBS},
season AS (
  SELECT parcel_id, (day - DATE '{ANCHOR}') // 10 AS season, count(*) AS n, 100 * avg(signal) AS yield, max(signal) AS peak,
         count(*) FILTER (signal < 0.1) AS high, count(*) FILTER (signal >= 0.1 AND signal < 0.2) AS medium,
         CASE WHEN count(*) >= 6 THEN count(*) FILTER (signal >= 0.2 AND signal < 0.25) ELSE 0 END AS low
  FROM obs WHERE signal IS NOT NULL GROUP BY 1, 2),
by_season AS (
  SELECT parcel_id, count(*) AS sp, count(*) FILTER (n >= 3) AS complete, avg(yield) AS yield, stddev_pop(yield) AS yield_sd, avg(peak) AS peak,
         sum(high) AS high, sum(medium) AS medium, sum(low) AS low FROM season GROUP BY 1),
seen AS (
  SELECT parcel_id, avg(CASE WHEN signal IS NULL THEN 1.0 ELSE 0.0 END) AS masked, coalesce(avg(cloud), 50) AS risk,
         CASE WHEN count(*) >= 3 THEN 100 * avg(CASE WHEN cloud >= 80 THEN 1.0 ELSE 0.0 END) END AS exposure,
         100 * max(CASE WHEN cloud >= 50 THEN signal END) AS resilience, coalesce(avg(1 - cloud / 100.0), 0.8) AS quality,
         avg(CASE WHEN sensor = 'purchase' THEN 1.0 ELSE 0.0 END) AS radar, count(cloud) > 0 AS weather_known
  FROM obs GROUP BY 1),
base AS (
  SELECT s.*, coalesce(sp, 0) AS sp, coalesce(complete, 0) / {YEARS} AS cpi, coalesce(complete, 0) AS complete, yield, yield_sd, peak, high, medium, low
  FROM seen s LEFT JOIN by_season b USING (parcel_id)),
cv AS (SELECT *, CASE WHEN sp >= 2 AND yield > 0 THEN least(100.0, greatest(0.0, 100 - yield_sd / yield * 200)) END AS steady FROM base),
sub AS (
  SELECT *,
    CASE WHEN parcel_id % 11 = 0 THEN 0.40 * CASE WHEN peak IS NULL THEN 50.0 ELSE least(100.0, peak / 0.75 * 100) END + 0.35 * least(100.0, sp / 2.0 * 100) + 0.25 * coalesce(steady, 55.0)
    ELSE 0.55 * CASE WHEN cpi >= 2.0 THEN 100.0 WHEN cpi >= 1.5 THEN 80 + (cpi - 1.5) / 0.5 * 20 WHEN cpi >= 1.0 THEN 60 + (cpi - 1.0) / 0.5 * 20
                     WHEN cpi >= 0.5 THEN 35 + (cpi - 0.5) / 0.5 * 25 ELSE cpi / 0.5 * 35 END
       + 0.30 * least(100.0, sp / {SEASONS}.0 * 100) + 0.15 * (100 - least(40.0, 100 * CASE WHEN complete = 0 THEN 1.0 ELSE masked END)) END AS landuse,
    0.70 * coalesce(yield, {NO_EVIDENCE}) + 0.30 * coalesce(least(100.0, peak / 0.75 * 100), {NO_EVIDENCE}) AS vigor,
    CASE WHEN sp = 0 THEN {NO_EVIDENCE} ELSE 0.6 * (100 - least({MOST}, ({HIGH} * high + {MEDIUM} * medium + {LOW} * low) / sqrt(sp))) + 0.4 * coalesce(steady, 60.0) END AS stability,
    CASE WHEN resilience IS NOT NULL AND exposure IS NOT NULL THEN 0.40 * resilience + 0.30 * (100 - exposure) + 0.30 * (100 - risk)
         WHEN exposure IS NOT NULL THEN 0.5 * (100 - exposure) + 0.5 * (100 - risk) ELSE 100 - risk END AS weather,
    0.55 * least(100.0, greatest(0.0, 100 * (0.6 * (1 - masked) + 0.4 * quality) - least(30.0, greatest(0.0, radar - 0.5) * 60)))
      + 0.30 * least(1.0, sp / 4.0) * 100 + 0.15 * CASE WHEN weather_known THEN 100 ELSE 60 END AS confidence
  FROM cv),
gated AS (
  SELECT *, ({GATE_MIN} + (1 - {GATE_MIN}) * confidence / 100) * CASE WHEN parcel_id % 13 = 0 THEN {SUBSTITUTED} ELSE 1 END AS gate,
    CAST(least(4, CASE WHEN parcel_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN parcel_id % 5 = 0 THEN 2 ELSE 0 END) AS DOUBLE) AS bonus
  FROM sub),
risk AS (
  SELECT *, least(100.0, greatest(0.0, least(100.0, (30 * landuse + 25 * vigor + 20 * stability + 25 * weather) / 100 + bonus) * gate)) AS index FROM gated)"""


def _held(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def risk_parts(spark, sf_dir):
    """A row a parcel: the four sub-indices, the confidence, its gate and the index. A parcel of a perennial is judged by
    its canopy, years and steadiness, not by cycles a year; one without a season has no evidence, which is not a good
    sign; a substituted footprint and thin data lower the gate; benefits only ever add."""
    o = observations(spark, sf_dir)
    signal, cloud = F.col("signal"), F.col("cloud")
    per_season = o.where("signal IS NOT NULL").groupBy("parcel_id", F.floor(F.datediff("day", F.lit(ANCHOR).cast("date")) / 10).alias("season")).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(signal)).alias("yield"),
        F.max(signal).alias("peak"),
        F.count_if(signal < 0.1).alias("high"),
        F.count_if((signal >= 0.1) & (signal < 0.2)).alias("medium"),
        F.when(F.count(F.lit(1)) >= 6, F.count_if((signal >= 0.2) & (signal < 0.25))).otherwise(0).alias("low"),
    )
    by_season = per_season.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("sp"),
        F.count_if(F.col("n") >= 3).alias("complete"),
        F.avg("yield").alias("yield"),
        F.stddev_pop("yield").alias("yield_sd"),
        F.avg("peak").alias("peak"),
        *[F.sum(c).alias(c) for c in ("high", "medium", "low")],
    )
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    seen = o.groupBy("parcel_id").agg(
        share(signal.isNull()).alias("masked"),
        F.coalesce(F.avg("cloud"), F.lit(50.0)).alias("risk"),
        F.when(F.count(F.lit(1)) >= 3, 100 * share(cloud >= 80)).alias("exposure"),
        (100 * F.max(F.when(cloud >= 50, signal))).alias("resilience"),
        F.coalesce(F.avg(1 - cloud / 100.0), F.lit(0.8)).alias("quality"),
        share(F.col("sensor") == "purchase").alias("radar"),
        (F.count("cloud") > 0).alias("weather_known"),
    )
    base = seen.join(by_season, "parcel_id", "left").na.fill(0, ["sp", "complete"]).withColumn("cpi", F.col("complete") / YEARS)
    c = F.col
    steady = F.when((c("sp") >= 2) & (c("yield") > 0), _held(100 - F.try_divide(c("yield_sd"), c("yield")) * 200))
    base = base.withColumn("steady", steady)
    cpi = c("cpi")
    intensity = (
        F.when(cpi >= 2.0, 100.0)
        .when(cpi >= 1.5, 80 + (cpi - 1.5) / 0.5 * 20)
        .when(cpi >= 1.0, 60 + (cpi - 1.0) / 0.5 * 20)
        .when(cpi >= 0.5, 35 + (cpi - 0.5) / 0.5 * 25)
        .otherwise(cpi / 0.5 * 35)
    )
    canopy = F.least(F.lit(100.0), c("peak") / 0.75 * 100)
    perennial = 0.40 * F.coalesce(canopy, F.lit(50.0)) + 0.35 * _held(c("sp") / 2.0 * 100) + 0.25 * F.coalesce("steady", F.lit(55.0))
    fallow = F.least(F.lit(40.0), 100 * F.when(c("complete") == 0, 1.0).otherwise(c("masked")))
    annual = 0.55 * intensity + 0.30 * _held(c("sp") / float(SEASONS) * 100) + 0.15 * (100 - fallow)
    lost = F.least(F.lit(MOST), (HIGH * c("high") + MEDIUM * c("medium") + LOW * c("low")) / F.sqrt("sp"))
    safe, calm = 100 - c("exposure"), 100 - c("risk")
    weather = F.when(c("resilience").isNotNull() & c("exposure").isNotNull(), 0.40 * c("resilience") + 0.30 * safe + 0.30 * calm)
    weather = weather.when(c("exposure").isNotNull(), 0.5 * safe + 0.5 * calm).otherwise(calm)
    observed = _held(100 * (0.6 * (1 - c("masked")) + 0.4 * c("quality")) - F.least(F.lit(30.0), F.greatest(F.lit(0.0), c("radar") - 0.5) * 60))
    history = F.least(F.lit(1.0), c("sp") / 4.0) * 100
    sub = base.withColumns(
        {
            "landuse": F.when(c("parcel_id") % 11 == 0, perennial).otherwise(annual),
            "vigor": 0.70 * F.coalesce("yield", F.lit(NO_EVIDENCE)) + 0.30 * F.coalesce(canopy, F.lit(NO_EVIDENCE)),
            "stability": F.when(c("sp") == 0, NO_EVIDENCE).otherwise(0.6 * (100 - lost) + 0.4 * F.coalesce("steady", F.lit(60.0))),
            "weather": weather,
            "confidence": 0.55 * observed + 0.30 * history + 0.15 * F.when(c("weather_known"), 100).otherwise(60),
        }
    )
    bonus = F.least(F.lit(4.0), F.when(c("parcel_id") % 3 == 0, 2).otherwise(0) + F.when(c("parcel_id") % 5 == 0, 2).otherwise(0))
    gated = sub.withColumn("gate", (GATE_MIN + (1 - GATE_MIN) * c("confidence") / 100) * F.when(c("parcel_id") % 13 == 0, SUBSTITUTED).otherwise(1))
    added = sum(w * c(k) for k, w in WEIGHTS.items()) / 100 + bonus
    return gated.withColumns({"bonus": bonus, "index": _held(F.least(F.lit(100.0), added) * c("gate"))})


_PARTS = ("landuse", "vigor", "stability", "weather", "confidence", "gate", "bonus", "index")


@query(f"""WITH {_INDEX} SELECT parcel_id, {', '.join(f'round({c}, 8) AS {c}' for c in _PARTS)},
  CASE WHEN index >= 70 THEN 'LOW' WHEN index >= 50 THEN 'MEDIUM' WHEN index >= 30 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk FROM risk""")
def risk_index(spark, sf_dir):
    parts = risk_parts(spark, sf_dir)
    return parts.select("parcel_id", *[F.round(c, 8).alias(c) for c in _PARTS], risk_band(F.col("index")).alias("risk"))


_CODES = (
    ("LANDUSE_HIGH_INTENSITY", "landuse >= 70"),
    ("LANDUSE_LOW_ACTIVITY", "landuse < 50"),
    ("VIGOR_STRONG", "vigor >= 70"),
    ("VIGOR_WEAK", "vigor < 50"),
    ("STABILITY_STRESS", "stability < 50"),
    ("STABILITY_STRONG", "stability >= 75"),
    ("WEATHER_RESILIENT", "resilience >= 70"),
    ("WEATHER_EXPOSED", "weather < 50"),
    ("FOOTPRINT_SUBSTITUTED", "parcel_id % 13 = 0"),
)


@query(f"""WITH {_INDEX} SELECT parcel_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {test} THEN '{code}' END" for code, test in _CODES)}], lambda x: x IS NOT NULL), ',') AS codes,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {k} < 50 THEN '{k}' END" for k in WEIGHTS)}], lambda x: x IS NOT NULL), ',') AS weak FROM risk""")
def risk_reason_codes(spark, sf_dir):
    """Reason codes in their fixed order, and the sub-indices under 50."""
    codes = F.concat_ws(",", *[F.when(F.expr(test), code) for code, test in _CODES])
    weak = F.concat_ws(",", *[F.when(F.col(k) < 50, k) for k in WEIGHTS])
    return risk_parts(spark, sf_dir).select("parcel_id", codes.alias("codes"), weak.alias("weak"))


@query(f"""WITH {_INDEX}, g AS (SELECT parcel_id, unnest([{', '.join(f"{{'part': '{k}', 'gain': {w} / 100 * greatest(0.0, 75 - {k}) * gate}}" for k, w in WEIGHTS.items())}]) AS s FROM risk),
r AS (SELECT parcel_id, s.part AS part, s.gain AS gain, row_number() OVER (PARTITION BY parcel_id ORDER BY round(s.gain, 9) DESC, s.part) AS place FROM g WHERE s.gain > 0)
SELECT parcel_id, CAST(place AS INTEGER) AS place, part, round(gain, 8) AS gain FROM r WHERE place <= 3""")
def top_scenarios(spark, sf_dir):
    """What raising each sub-index to 75 would gain, the three largest of each parcel."""
    parts = risk_parts(spark, sf_dir)
    gains = F.array(*[F.struct(F.lit(k).alias("part"), (w / 100 * F.greatest(F.lit(0.0), 75 - F.col(k)) * F.col("gate")).alias("gain")) for k, w in WEIGHTS.items()])
    by = F.transform(F.filter(gains, lambda g: g["gain"] > 0), lambda g: F.struct((-F.round(g["gain"], 9)).alias("order"), g["part"].alias("part"), g["gain"].alias("gain")))
    top = parts.select("parcel_id", F.posexplode(F.slice(F.array_sort(by), 1, 3)).alias("place", "s"))
    return top.select("parcel_id", (F.col("place") + 1).alias("place"), "s.part", F.round("s.gain", 8).alias("gain"))


#: Pairs that are grown together, classes that are held on one region's first season, and the local ones they must beat.
_INTERCROP, _HELD, _LOCAL = ((0, 4), (2, 6)), (1, 3), (0, 2, 4)
_PROBS = f"""{CYCLES},
p AS (SELECT c.parcel_id, year(sown) AS y, crop_id % 8 AS crop, sum(days * area_ha) AS w FROM cycles c GROUP BY 1, 2, 3),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY parcel_id, y) AS p, row_number() OVER (PARTITION BY parcel_id, y ORDER BY w DESC, crop) AS r, count(*) OVER (PARTITION BY parcel_id, y) AS n FROM p),
t AS (
  SELECT parcel_id, y, max(CASE WHEN r = 1 THEN crop END) AS top1, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN crop END) AS top2, coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS p2,
         coalesce(max(CASE WHEN crop IN (0, 2, 4) THEN p END), 0) AS local, max(n) AS n FROM s GROUP BY 1, 2),
support AS (SELECT crop_id % 8 AS crop, parcel_id % 40 AS region, count(*) AS held FROM cycles WHERE sown < DATE '1992-09-01' GROUP BY 1, 2)"""


@query(f"""WITH {_PROBS},
u AS (SELECT t.*, coalesce(held, 0) AS held, CASE WHEN coalesce(held, 0) >= 30 THEN 1.0 WHEN coalesce(held, 0) > 0 THEN 0.5 ELSE 0.15 END AS scale, (top1 + y) % 5 <> 0 AS in_season,
      p1 - p2 AS margin, n < 3 AS few FROM t LEFT JOIN support ON crop = top1 AND region = parcel_id % 40),
v AS (SELECT *, p1 * scale * CASE WHEN in_season THEN 1.0 ELSE 0.15 END AS trust, scale < 1 OR NOT in_season AS doubted,
      (least(top1, top2), greatest(top1, top2)) IN ((0, 4), (2, 6)) AND margin < 0.10 AND p1 + p2 >= 0.30 AS pair FROM u),
d AS (SELECT *, CASE WHEN pair AND NOT doubted AND NOT few THEN 'intercrop' WHEN doubted OR trust < 0.15 THEN 'abstained' WHEN few OR y = 1998 THEN 'provisional' ELSE 'confirmed' END AS first FROM v)
SELECT parcel_id, CAST(y AS INTEGER) AS year, top1, top2, round(p1, 9) AS p1, round(margin, 9) AS margin, round(CASE WHEN first = 'intercrop' THEN p1 + p2 ELSE trust END, 9) AS confidence,
  CASE WHEN first IN ('confirmed', 'provisional') AND parcel_id % 4 = 0 AND top1 IN (1, 3) AND p1 - local < 0.25 THEN 'not_requested'
       WHEN first IN ('confirmed', 'provisional') AND top1 = 7 THEN 'not_requested' ELSE first END AS status FROM d""")
def crop_decision(spark, sf_dir):
    """The class with the most probability, trusted less where its region or season does not support it: confirmed,
    provisional, abstained, intercrop of a pair too close to call, or held back as not requested."""
    c = cycles(spark, sf_dir)
    p = c.groupBy("parcel_id", F.year("sown").alias("year"), (F.col("crop_id") % 8).alias("crop")).agg(F.sum(F.col("days") * F.col("area_ha")).alias("w"))
    own = Window.partitionBy("parcel_id", "year")
    s = p.withColumns({"p": F.col("w") / F.sum("w").over(own), "r": F.row_number().over(own.orderBy(F.desc("w"), "crop"))})
    at = lambda r, x: F.max(F.when(F.col("r") == r, F.col(x)))
    t = s.groupBy("parcel_id", "year").agg(
        at(1, "crop").alias("top1"),
        at(1, "p").alias("p1"),
        at(2, "crop").alias("top2"),
        F.coalesce(at(2, "p"), F.lit(0.0)).alias("p2"),
        F.coalesce(F.max(F.when(F.col("crop").isin(*_LOCAL), F.col("p"))), F.lit(0.0)).alias("local"),
        F.count(F.lit(1)).alias("n"),
    )
    support = c.where(F.col("sown") < F.lit("1992-09-01").cast("date")).groupBy((F.col("crop_id") % 8).alias("top1"), (F.col("parcel_id") % 40).alias("region")).agg(F.count(F.lit(1)).alias("held"))
    u = t.withColumn("region", F.col("parcel_id") % 40).join(support, ["top1", "region"], "left")
    held = F.coalesce("held", F.lit(0))
    scale = F.when(held >= 30, 1.0).when(held > 0, 0.5).otherwise(0.15)
    in_season = (F.col("top1") + F.col("year")) % 5 != 0
    few, margin = F.col("n") < 3, F.col("p1") - F.col("p2")
    trust, doubted = F.col("p1") * scale * F.when(in_season, 1.0).otherwise(0.15), (scale < 1) | ~in_season
    together = [(F.least("top1", "top2") == a) & (F.greatest("top1", "top2") == b) & F.col("top2").isNotNull() for a, b in _INTERCROP]
    pair = (together[0] | together[1]) & (margin < 0.10) & (F.col("p1") + F.col("p2") >= 0.30)
    first = F.when(F.coalesce(pair, F.lit(False)) & ~doubted & ~few, "intercrop").when(doubted | (trust < 0.15), "abstained").when(few | (F.col("year") == 1998), "provisional").otherwise("confirmed")
    named = F.col("first").isin("confirmed", "provisional")
    hold = (F.col("parcel_id") % 4 == 0) & F.col("top1").isin(*_HELD) & (F.col("p1") - F.col("local") < 0.25)
    status = F.when(named & (hold | (F.col("top1") == 7)), "not_requested").otherwise(F.col("first"))
    confidence = F.when(F.col("first") == "intercrop", F.col("p1") + F.col("p2")).otherwise(trust)
    d = u.withColumn("first", first)
    return d.select("parcel_id", "year", "top1", "top2", F.round("p1", 9).alias("p1"), F.round(margin, 9).alias("margin"), F.round(confidence, 9).alias("confidence"), status.alias("status"))


@query(f"""WITH {CYCLES}, p AS (SELECT parcel_id, crop_id % 6 AS crop, sum(days) AS d FROM cycles GROUP BY 1, 2),
q AS (SELECT parcel_id, crop, d / sum(d) OVER (PARTITION BY parcel_id) * CASE WHEN (crop + parcel_id) % 4 = 0 THEN 0.15 ELSE 1 END AS w FROM p)
SELECT parcel_id, crop, round(w / sum(w) OVER (PARTITION BY parcel_id), 9) AS posterior FROM q""")
def season_mask(spark, sf_dir):
    """Probabilities of classes out of season count 0.15, and the rest is scaled to 1 again."""
    own = Window.partitionBy("parcel_id")
    p = cycles(spark, sf_dir).groupBy("parcel_id", (F.col("crop_id") % 6).alias("crop")).agg(F.sum("days").alias("d"))
    w = p.withColumn("w", F.col("d") / F.sum("d").over(own) * F.when((F.col("crop") + F.col("parcel_id")) % 4 == 0, 0.15).otherwise(1))
    return w.select("parcel_id", "crop", F.round(F.col("w") / F.sum("w").over(own), 9).alias("posterior"))


@query(f"""WITH {CYCLES}, p AS (SELECT parcel_id, crop_id % 6 AS crop, sum(days) AS d FROM cycles GROUP BY 1, 2),
s AS (SELECT parcel_id, d / sum(d) OVER (PARTITION BY parcel_id) AS p, row_number() OVER (PARTITION BY parcel_id ORDER BY d DESC, crop) AS r FROM p),
t AS (SELECT parcel_id, max(CASE WHEN r = 1 THEN p END) AS p1, coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS p2 FROM s GROUP BY 1)
SELECT parcel_id, round(p1, 9) AS p1, round(least(p1, p1 * least(1.0, (p1 - p2) / 0.1 + 0.5)), 9) AS confidence,
  round(exp(ln(p1) / 1.4) / (exp(ln(p1) / 1.4) + exp(ln(greatest(1 - p1, 1e-9)) / 1.4)), 9) AS tempered FROM t""")
def gap_confidence(spark, sf_dir):
    """Confidence lowered where the second class is near, and the first class's share at a temperature of 1.4."""
    own = Window.partitionBy("parcel_id")
    p = cycles(spark, sf_dir).groupBy("parcel_id", (F.col("crop_id") % 6).alias("crop")).agg(F.sum("days").alias("d"))
    s = p.select("parcel_id", (F.col("d") / F.sum("d").over(own)).alias("p"), F.row_number().over(own.orderBy(F.desc("d"), "crop")).alias("r"))
    t = s.groupBy("parcel_id").agg(F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))), F.lit(0.0)).alias("p2"))
    p1 = F.col("p1")
    warm = lambda x: F.exp(F.ln(x) / 1.4)
    confidence = F.least(p1, p1 * F.least(F.lit(1.0), (p1 - F.col("p2")) / 0.1 + 0.5))
    tempered = warm(p1) / (warm(p1) + warm(F.greatest(1 - p1, F.lit(1e-9))))
    return t.select("parcel_id", F.round("p1", 9).alias("p1"), F.round(confidence, 9).alias("confidence"), F.round(tempered, 9).alias("tempered"))
