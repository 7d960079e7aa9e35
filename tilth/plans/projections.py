"""Queries of column expressions: spectral and agronomic indices, geography, units, scores, labels, hashes, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.functions import agronomy as agro
from tilth.functions import spectral as sp
from tilth.plans.base import OBS, observations, query, table

BANDS = """b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, 0.2 + l_quantity / 100 AS nir, 0.02 + l_discount AS red, 0.03 + l_tax AS green, 0.02 + l_tax / 2 AS blue, 0.1 + l_discount * 2 AS swir, 0.1 + l_quantity / 200 AS edge FROM lineitem)"""


def bands(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), (0.2 + q / 100).alias("nir"), (0.02 + d).alias("red"), (0.03 + t).alias("green"), (0.02 + t / 2).alias("blue"), (0.1 + d * 2).alias("swir"), (0.1 + q / 200).alias("edge"))


def _c(*names):
    return [F.col(n) for n in names]


_ND = "greatest(-1, least(1, ({a} - {b}) / nullif({a} + {b}, 0)))"
INDICES = {
    "ndvi": (lambda: sp.ndvi(*_c("nir", "red")), _ND.format(a="nir", b="red")),
    "evi": (lambda: sp.evi(*_c("nir", "red", "blue")), "greatest(-1, least(1.5, 2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)))"),
    "ndmi": (lambda: sp.ndmi(*_c("nir", "swir")), _ND.format(a="nir", b="swir")),
    "savi": (lambda: sp.savi(*_c("nir", "red")), "greatest(-1, least(1.5, 1.5 * (nir - red) / nullif(nir + red + 0.5, 0)))"),
    "msavi2": (lambda: sp.msavi2(*_c("nir", "red")), "greatest(-1, least(1, (2 * nir + 1 - sqrt(CASE WHEN (2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red) >= 0 THEN (2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red) END)) / 2))"),
    "nirv": (lambda: sp.nirv(*_c("nir", "red")), f"greatest(-1, least(1, nir * {_ND.format(a='nir', b='red')}))"),
    "gcvi": (lambda: sp.gcvi(*_c("nir", "green")), "greatest(-1, least(12, nir / nullif(green, 0) - 1))"),
    "ndbi": (lambda: sp.ndbi(*_c("swir", "nir")), _ND.format(a="swir", b="nir")),
    "bsi": (lambda: sp.bsi(*_c("swir", "red", "nir", "blue")), _ND.format(a="(swir + red)", b="(nir + blue)")),
    "mndwi": (lambda: sp.mndwi(*_c("green", "swir")), _ND.format(a="green", b="swir")),
    "ndwi": (lambda: sp.ndwi(*_c("green", "nir")), _ND.format(a="green", b="nir")),
    "kndvi": (lambda: sp.kndvi(*_c("nir", "red")), f"greatest(0, least(1, tanh(power({_ND.format(a='nir', b='red')}, 2))))"),
    "ndre": (lambda: sp.ndre(*_c("nir", "edge")), _ND.format(a="nir", b="edge")),
    "cire": (lambda: sp.cire(*_c("nir", "edge")), "nir / nullif(edge, 0) - 1"),
    "psri": (lambda: sp.psri(*_c("red", "blue", "edge")), "(red - blue) / nullif(edge, 0)"),
}


@query(f"WITH {BANDS} SELECT k, n, p, " + ", ".join(f"round({s}, 6) + 0.0 AS {i}" for i, (_, s) in INDICES.items()) + " FROM b")
def spectral_indices(spark, sf_dir):
    return bands(spark, sf_dir).select("k", "n", "p", *[(F.round(c(), 6) + 0.0).alias(i) for i, (c, _) in INDICES.items()])


@query("""WITH r AS (SELECT o_orderkey, power(10.0, -(5 + o_totalprice / 50000) / 10) AS vv, power(10.0, -(10 + o_totalprice / 40000) / 10) AS vh FROM orders)
SELECT o_orderkey, round(greatest(0, least(1, 4 * vh / nullif(vv + vh, 0))), 9) AS rvi, round(greatest(0, least(5, vh / nullif(vv, 0))), 9) AS ratio FROM r""")
def radar_indices(spark, sf_dir):
    price = F.col("o_totalprice")
    r = table(spark, sf_dir, "orders").select("o_orderkey", sp.db_to_linear(-(5 + price / 50000)).alias("vv"), sp.db_to_linear(-(10 + price / 40000)).alias("vh"))
    return r.select("o_orderkey", F.round(sp.rvi(F.col("vv"), F.col("vh")), 9).alias("rvi"), F.round(sp.cross_ratio(F.col("vv"), F.col("vh")), 9).alias("ratio"))


@query(f"""WITH {BANDS}, i AS (SELECT k, n, p, CASE WHEN k % 3 <> 0 THEN {_ND.format(a='nir', b='red')} END AS nd, CASE WHEN k % 5 <> 0 THEN {_ND.format(a='nir', b='swir')} END AS mo FROM b)
SELECT k, n, p, round((CASE WHEN nd IS NULL THEN 0 ELSE 0.5 * greatest(0, least(1, (nd + 0.1) / 1.0)) END + CASE WHEN mo IS NULL THEN 0 ELSE 0.2 * greatest(0, least(1, (mo + 0.4) / 1.0)) END) / nullif((CASE WHEN nd IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN mo IS NULL THEN 0 ELSE 0.2 END), 0), 9) AS composite,
       round(0.5 * nd + 0.3 * nd + 0.2 * coalesce(mo, 0.7 * nd), 9) AS vigour FROM i""")
def composite_signal(spark, sf_dir):
    b = bands(spark, sf_dir)
    i = b.select("k", "n", "p", F.when(F.col("k") % 3 != 0, sp.ndvi(F.col("nir"), F.col("red"))).alias("nd"), F.when(F.col("k") % 5 != 0, sp.ndmi(F.col("nir"), F.col("swir"))).alias("mo"))
    terms = [(sp.scaled(F.col("nd"), -0.1, 0.9), 0.5), (sp.scaled(F.col("mo"), -0.4, 0.6), 0.2)]
    return i.select("k", "n", "p", F.round(sp.weighted_available(terms), 9).alias("composite"), F.round(sp.vigour(F.col("nd"), F.lit(None).cast("double"), F.col("mo")), 9).alias("vigour"))


@query(f"""WITH {OBS} SELECT obs_id, CASE WHEN signal IS NOT NULL THEN round(greatest(0, least(1, signal)) * (1 - greatest(0, least(1, cloud / 100))) * greatest(0.4, least(1, 0.5 + 0.5 * sqrt((1 + cloud / 50) / 0.15) / sqrt(10.0))), 9) END AS quality FROM obs""")
def bin_quality(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select("obs_id", F.round(sp.bin_quality(F.col("signal"), F.col("cloud") / 100, 1 + F.col("cloud") / 50), 9).alias("quality"))


_PHI = "radians(10 + c_nationkey)"
_RA = f"(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() * doy / 365)) * (ws * sin({_PHI}) * sin(tilt) + cos({_PHI}) * cos(tilt) * sin(ws)))"


@query(f"""WITH d AS (SELECT o_orderkey, c_nationkey, dayofyear(o_orderdate) AS doy, 20 + o_totalprice / 25000 AS tmax, 5 + o_totalprice / 30000 AS tmin, c_acctbal / 120 AS rh FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, 0.409 * sin(2 * pi() * doy / 365 - 1.39) AS tilt FROM d), s AS (SELECT *, acos(greatest(-1, least(1, -tan({_PHI}) * tan(tilt)))) AS ws FROM t)
SELECT o_orderkey, round(greatest((greatest(10, least(35, tmax)) + greatest(10, least(35, tmin))) / 2 - 10, 0), 9) AS gdd, round(greatest(least((tmax + tmin) / 2, 35) - 10, 0), 9) AS gdd_mean,
       round({_RA}, 6) AS radiation, round(greatest(0.0023 * 0.408 * {_RA} * ((tmax + tmin) / 2 + 17.8) * sqrt(greatest(tmax - tmin, 0)), 0), 6) AS et0,
       round(greatest(0.6108 * exp(17.27 * ((tmax + tmin) / 2) / ((tmax + tmin) / 2 + 237.3)) * (1 - rh / 100), 0), 6) AS vpd FROM s""")
def agro_weather(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"), (20 + F.col("o_totalprice") / 25000).alias("tmax"), (5 + F.col("o_totalprice") / 30000).alias("tmin"), (F.col("c_acctbal") / 120).alias("rh"), (10.0 + F.col("c_nationkey")).alias("lat"))
    hi, lo, lat, doy = F.col("tmax"), F.col("tmin"), F.col("lat"), F.col("doy")
    return d.select("o_orderkey", F.round(agro.gdd(hi, lo), 9).alias("gdd"), F.round(agro.gdd_mean_capped(hi, lo), 9).alias("gdd_mean"), F.round(agro.radiation(lat, doy), 6).alias("radiation"), F.round(agro.hargreaves(hi, lo, lat, doy), 6).alias("et0"), F.round(agro.vapour_deficit((hi + lo) / 2, F.col("rh")), 6).alias("vpd"))


@query("""WITH p AS (SELECT c_custkey, 8 + (c_custkey * 37 % 1000) / 40.0 AS lat, 70 + (c_custkey * 91 % 1000) / 40.0 AS lon FROM customer)
SELECT c_custkey, floor(lat / 0.25)::BIGINT || '_' || floor(lon / 0.25)::BIGINT AS cell,
       round(2 * 6371 * asin(sqrt(least(power(sin(radians(20 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * power(sin(radians(78 - lon) / 2), 2), 1))), 6) AS km,
       round(lat - sqrt(1 + c_custkey % 7) / 2 / 111.32, 9) AS south, round(lon + sqrt(1 + c_custkey % 7) / 2 / (111.32 * cos(radians(lat))), 9) AS east FROM p""")
def geography(spark, sf_dir):
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (8 + (key * 37 % 1000) / 40.0).alias("lat"), (70 + (key * 91 % 1000) / 40.0).alias("lon"))
    lat, lon, half = F.col("lat"), F.col("lon"), F.sqrt(1 + key % 7) / 2
    return p.select("c_custkey", agro.cell(lat, lon).alias("cell"), F.round(agro.haversine(lat, lon, F.lit(20.0), F.lit(78.0)), 6).alias("km"), F.round(lat - half / 111.32, 9).alias("south"), F.round(lon + half / (111.32 * F.cos(F.radians(lat))), 9).alias("east"))


@query("""SELECT s_suppkey, round(abs(w * h) * power(pi() / 180 * 6371000, 2) * cos(radians((5 * lat + 2 * h) / 5)) / 10000, 4) AS hectares
FROM (SELECT s_suppkey, 10 + s_nationkey AS lat, 0.001 + s_suppkey / 100000.0 AS w, 0.002 + abs(s_acctbal) / 10000000 AS h FROM supplier)""")
def ring_area(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (10.0 + F.col("s_nationkey")).alias("lat"), (0.001 + F.col("s_suppkey") / 100000.0).alias("w"), (0.002 + F.abs("s_acctbal") / 10000000).alias("h"))
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    lat, w, h, x = F.col("lat"), F.col("w"), F.col("h"), F.lit(77.0)
    ring = F.array(point(x, lat), point(x + w, lat), point(x + w, lat + h), point(x, lat + h), point(x, lat))
    return s.select("s_suppkey", F.round(agro.ring_area_ha(ring), 4).alias("hectares"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_partkey % 5 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / 10 WHEN 2 THEN l_quantity / 10 / 0.40468564224 WHEN 3 THEN l_quantity / 1000 / 0.40468564224 END, 9) AS yield_t_ha FROM lineitem""")
def unit_conversion(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("t/ha", "q/ha", "q/acre", "kg/acre", "bags")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(agro.tonnes_per_hectare(F.col("l_quantity"), unit), 9).alias("yield_t_ha"))


@query("""SELECT o_orderkey, round(i, 6) AS index, CAST(round_even(300 + 600 * i / 100, 0) AS INTEGER) AS score, CASE WHEN i >= 70 THEN 'LOW' WHEN i >= 50 THEN 'MEDIUM' WHEN i >= 30 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk,
       CASE WHEN i < 25 THEN 'poor' WHEN i < 50 THEN 'fair' WHEN i < 75 THEN 'good' ELSE 'very good' END AS band FROM (SELECT o_orderkey, o_totalprice / 5000.5 AS i FROM orders)""")
def score_bands(spark, sf_dir):
    i = F.col("i")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000.5).alias("i")).select("o_orderkey", F.round(i, 6).alias("index"), agro.score_of(i).alias("score"), agro.risk_band(i).alias("risk"), F.when(i < 25, "poor").when(i < 50, "fair").when(i < 75, "good").otherwise("very good").alias("band"))


@query("""SELECT l, CASE WHEN trim(l) = '' OR l IS NULL THEN NULL ELSE upper(left(trim(l), 1)) || lower(substr(trim(l), 2)) END AS label, count(*) AS n FROM (SELECT replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '_' END) AS l FROM part) GROUP BY 1, 2""")
def label_normalisation(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    clean = F.concat(F.upper(F.substring(F.trim("l"), 1, 1)), F.lower(F.substring(F.trim("l"), F.lit(2), F.length("l"))))
    return table(spark, sf_dir, "part").select(raw.alias("l")).withColumn("label", F.when(F.trim("l") != "", clean)).groupBy("l", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, sha256(user_id || '|' || strftime(date_trunc('week', ts), '%Y-%m-%d')) AS cache_key, count(*) AS n, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY 1, 2, 3""")
def cache_keys(spark, sf_dir):
    week = F.date_trunc("week", F.col("ts")).cast("date")
    e = table(spark, sf_dir, "events").withColumn("week", week)
    return e.groupBy("user_id", "week", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("week", "yyyy-MM-dd")), 256).alias("cache_key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.from_json("props", "k int")["k"]).alias("most"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'kharif' WHEN month(o_orderdate) IN (10, 11, 12, 1) THEN 'rabi' ELSE 'zaid' END AS season,
  CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 THEN 1 ELSE 0 END AS INTEGER) AS season_year FROM orders""")
def season_of_day(spark, sf_dir):
    month = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.when(month.between(6, 9), "kharif").when(month.isin(10, 11, 12, 1), "rabi").otherwise("zaid").alias("season"), (F.year("o_orderdate") - F.when(month == 1, 1).otherwise(0)).alias("season_year"))


@query("""WITH s AS (SELECT vec_id, label, list_sum(e) / len(e) AS mean, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e) - power(list_sum(e) / len(e), 2)) AS sd, e FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))
SELECT vec_id, label, round(mean, 5) AS mean, round(sd, 5) AS sd, round((list_max(e) - mean) / nullif(sd, 0), 4) AS highest, round((list_min(e) - mean) / nullif(sd, 0), 4) AS lowest FROM s""")
def shape_norm(spark, sf_dir):
    """Each trajectory on its own mean and population deviation."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    n = F.size("e")
    e = e.withColumn("mean", F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / n)
    e = e.withColumn("sd", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x) / n - F.col("mean") * F.col("mean")))
    return e.select("vec_id", "label", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round(F.try_divide(F.array_max("e") - F.col("mean"), F.col("sd")), 4).alias("highest"), F.round(F.try_divide(F.array_min("e") - F.col("mean"), F.col("sd")), 4).alias("lowest"))


@query("""SELECT c_custkey, CASE WHEN px < 15 THEN 'not_viable' WHEN px < 50 OR ratio NOT BETWEEN 0.8 AND 1.25 THEN 'marginal' ELSE 'viable' END AS outcome,
  CASE WHEN px < 15 THEN 'too few pixels' WHEN px < 50 THEN 'few pixels' WHEN ratio NOT BETWEEN 0.8 AND 1.25 THEN 'area mismatch' ELSE 'ok' END AS reason, px AS pixels
FROM (SELECT c_custkey, abs(c_acctbal) / 4000 / 0.01 AS px, 0.7 + (c_custkey % 100) / 125.0 AS ratio FROM customer)""")
def viability_gate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 4000 / 0.01).alias("px"), (0.7 + (F.col("c_custkey") % 100) / 125.0).alias("ratio"))
    few, some, off = F.col("px") < 15, F.col("px") < 50, ~F.col("ratio").between(0.8, 1.25)
    return c.select("c_custkey", F.when(few, "not_viable").when(some | off, "marginal").otherwise("viable").alias("outcome"), F.when(few, "too few pixels").when(some, "few pixels").when(off, "area mismatch").otherwise("ok").alias("reason"), F.col("px").alias("pixels"))


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 50000 THEN 'LOW_VALUE' END, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'URGENT' END], lambda x: x IS NOT NULL)::VARCHAR AS codes FROM orders""")
def reason_codes(spark, sf_dir):
    codes = F.filter(F.array(F.when(F.col("o_totalprice") < 50000, "LOW_VALUE"), F.when(F.col("o_orderstatus") == "P", "PENDING"), F.when(F.col("o_orderpriority").startswith("1"), "URGENT")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(codes, ", "), F.lit("]")).alias("codes"))
