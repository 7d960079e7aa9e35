"""Queries of the evaluation layer: agreement, calibration, area estimates, thresholds, weights and allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import wilson
from tilth.operators import evaluation
from tilth.plans.base import query, table

_PAIR = "pair AS (SELECT l_orderkey, l_partkey, l_suppkey % 4 AS stratum, CASE l_returnflag WHEN 'A' THEN 'cotton' WHEN 'N' THEN 'soy' ELSE 'other' END AS map, CASE WHEN (l_partkey * 7 + l_suppkey) % 10 < 7 THEN CASE l_returnflag WHEN 'A' THEN 'cotton' WHEN 'N' THEN 'soy' ELSE 'other' END WHEN l_linestatus = 'O' THEN 'cotton' ELSE 'fallow' END AS ref, 0.3 + (l_partkey % 70) / 100.0 AS conf FROM lineitem)"


def pairs(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", "cotton").when(F.col("l_returnflag") == "N", "soy").otherwise("other")
    ref = F.when((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 10 < 7, flag).when(F.col("l_linestatus") == "O", "cotton").otherwise("fallow")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 4).alias("stratum"), flag.alias("map"), ref.alias("ref"), (0.3 + (F.col("l_partkey") % 70) / 100.0).alias("conf"))


@query(f"WITH {_PAIR} SELECT ref AS reference, map AS predicted, count(*) AS n FROM pair GROUP BY 1, 2")
def confusion_counts(spark, sf_dir):
    return evaluation.confusion(pairs(spark, sf_dir), "ref", "map")


@query(f"""WITH {_PAIR}, l AS (SELECT DISTINCT ref AS label FROM pair UNION SELECT DISTINCT map FROM pair),
s AS (SELECT label, count(*) FILTER (ref = label AND map = label) AS tp, count(*) FILTER (map = label AND ref <> label) AS fp, count(*) FILTER (ref = label AND map <> label) AS fn FROM pair CROSS JOIN l GROUP BY 1)
SELECT label, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall, round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 9) AS f1 FROM s""")
def class_scores(spark, sf_dir):
    s = evaluation.per_class(evaluation.confusion(pairs(spark, sf_dir), "ref", "map"))
    return s.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PAIR}, t AS (SELECT count(*) AS n, count(*) FILTER (ref = map) / CAST(count(*) AS DOUBLE) AS po FROM pair),
e AS (SELECT sum(CAST(a.c AS DOUBLE) * b.c) / power((SELECT n FROM t), 2) AS pe FROM (SELECT ref AS k, count(*) AS c FROM pair GROUP BY 1) a JOIN (SELECT map AS k, count(*) AS c FROM pair GROUP BY 1) b USING (k))
SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa, round(sqrt(po * (1 - po) / (n * power(1 - pe, 2))), 9) AS kappa_se FROM t, e""")
def cohen_kappa(spark, sf_dir):
    k = evaluation.kappa(evaluation.confusion(pairs(spark, sf_dir), "ref", "map"))
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa", "kappa_se")])


@query(f"""WITH {_PAIR}, b AS (SELECT CASE WHEN conf >= 0.9 THEN 9 WHEN conf >= 0.8 THEN 8 WHEN conf >= 0.7 THEN 7 WHEN conf >= 0.6 THEN 6 WHEN conf >= 0.5 THEN 5 WHEN conf >= 0.4 THEN 4 WHEN conf >= 0.3 THEN 3 WHEN conf >= 0.2 THEN 2 WHEN conf >= 0.1 THEN 1 ELSE 0 END AS bin, conf, CASE WHEN ref = map THEN 1.0 ELSE 0.0 END AS ok FROM pair),
g AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM b GROUP BY 1) SELECT bin, n, round(c, 7) AS mean_confidence, round(a, 7) AS accuracy, round(n / CAST(sum(n) OVER () AS DOUBLE) * abs(a - c), 7) AS error_share FROM g""")
def calibration_bins(spark, sf_dir):
    c = evaluation.calibration(pairs(spark, sf_dir), "conf", F.col("ref") == F.col("map"))
    return c.select("bin", "n", *[F.round(x, 7).alias(x) for x in ("mean_confidence", "accuracy", "error_share")])


@query(f"""WITH {_PAIR}, h AS (SELECT stratum, count(*) AS n_h FROM pair GROUP BY 1), s AS (SELECT stratum, n_h, (stratum + 1) * 1000.0 AS area, (stratum + 1) * 1000.0 / 10000 AS w FROM h),
k AS (SELECT s.*, l.label, (SELECT count(*) FROM pair p WHERE p.stratum = s.stratum AND p.ref = l.label) / CAST(n_h AS DOUBLE) AS p FROM s CROSS JOIN (SELECT DISTINCT ref AS label FROM pair) l)
SELECT label, round(sum(w * p), 9) AS share, round(sqrt(sum(w * w * p * (1 - p) / (n_h - 1))), 9) AS share_se, round(sum(w * p) * 10000, 5) AS area, round(1.96 * sqrt(sum(w * w * p * (1 - p) / (n_h - 1))) * 10000, 5) AS half_width FROM k GROUP BY 1""")
def stratified_areas(spark, sf_dir):
    sample = pairs(spark, sf_dir)
    areas = sample.select("stratum").distinct().withColumn("area", (F.col("stratum") + 1) * 1000.0)
    out = evaluation.stratified_area(sample, areas, "ref")
    return out.select("label", F.round("share", 9).alias("share"), F.round("share_se", 9).alias("share_se"), F.round("area", 5).alias("area"), F.round("half_width", 5).alias("half_width"))


@query(f"""WITH {_PAIR}, s AS (SELECT stratum, count(*) AS n, count(*) FILTER (ref = map) AS k FROM pair GROUP BY 1), w AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS z2 FROM s)
SELECT stratum, n, k, round((p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 9) AS low, round((p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 9) AS high FROM w""")
def wilson_intervals(spark, sf_dir):
    s = pairs(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref") == F.col("map")).alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return s.select("stratum", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH {_PAIR}, t AS (SELECT unnest([30, 40, 50, 60, 70, 80, 90]) AS pct)
SELECT CAST(pct AS INTEGER) AS pct, count(*) FILTER (conf >= pct / 100.0) AS covered, round(count(*) FILTER (conf >= pct / 100.0) / CAST(count(*) AS DOUBLE), 9) AS coverage, round(count(*) FILTER (conf >= pct / 100.0 AND ref = map) / nullif(CAST(count(*) FILTER (conf >= pct / 100.0) AS DOUBLE), 0), 9) AS precision FROM pair CROSS JOIN t GROUP BY 1""")
def abstain_sweep(spark, sf_dir):
    """Seven thresholds in one pass: each row is counted under all those it reaches."""
    steps = [30, 40, 50, 60, 70, 80, 90]
    p = pairs(spark, sf_dir).withColumn("ok", F.col("ref") == F.col("map"))
    reached = F.array(*[F.struct(F.lit(s).alias("pct"), (F.col("conf") >= s / 100.0).alias("in")) for s in steps])
    by = p.select("ok", F.explode(reached).alias("t")).groupBy(F.col("t.pct").alias("pct")).agg(F.count_if("t.in").alias("covered"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("t.in") & F.col("ok")).alias("right"))
    return by.select("pct", "covered", F.round(F.col("covered") / F.col("n"), 9).alias("coverage"), F.round(F.try_divide(F.col("right").cast("double"), F.col("covered")), 9).alias("precision"))


@query(f"""WITH {_PAIR}, w AS (SELECT l_orderkey, l_partkey, map, least(3.0, count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY map))) / sqrt(count(*) OVER (PARTITION BY map, stratum)) AS w FROM pair)
SELECT map, count(*) AS n, round(sum(w), 6) AS weight FROM w GROUP BY 1""")
def class_weights(spark, sf_dir):
    p = pairs(spark, sf_dir)
    n = p.groupBy("map", "stratum").agg(F.count(F.lit(1)).alias("n_block"))
    n = n.withColumns({"n_class": F.sum("n_block").over(Window.partitionBy("map")), "n_all": F.sum("n_block").over(Window.partitionBy(F.lit(0)))})
    weight = F.least(F.lit(3.0), F.col("n_all") / (3.0 * F.col("n_class"))) / F.sqrt("n_block")
    return n.groupBy("map").agg(F.sum("n_block").alias("n"), F.round(F.sum(weight * F.col("n_block")), 6).alias("weight"))


@query("""WITH k AS (SELECT d.doc_id, l.quality, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS other, l.toxic FROM documents d JOIN labels l USING (doc_id))
SELECT quality, CAST(other AS INTEGER) AS other, CASE WHEN quality = other THEN 'agreed' WHEN toxic = 1 THEN 'third' ELSE 'open' END AS resolution, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def adjudication(spark, sf_dir):
    k = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("other", F.when(F.col("n_chars") >= 500, 1).otherwise(0))
    res = F.when(F.col("quality") == F.col("other"), "agreed").when(F.col("toxic") == 1, "third").otherwise("open")
    return k.groupBy("quality", "other", res.alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT c_mktsegment AS stratum, sum(abs(c_acctbal)) AS area FROM customer GROUP BY 1), q AS (SELECT stratum, area, greatest(20.0, 400 * area / sum(area) OVER ()) AS want FROM s),
f AS (SELECT *, floor(want) AS base, row_number() OVER (ORDER BY want - floor(want) DESC, stratum) AS r, sum(floor(want)) OVER () AS given, round(sum(want) OVER ()) AS total FROM q)
SELECT stratum, CAST(base + CASE WHEN r <= total - given THEN 1 ELSE 0 END AS BIGINT) AS samples FROM f""")
def sample_allocation(spark, sf_dir):
    """Samples in proportion to area with a floor, rounded by largest remainders; windows over one row a stratum."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.sum(F.abs("c_acctbal")).alias("area"))
    every = Window.partitionBy(F.lit(0))
    q = s.withColumn("want", F.greatest(F.lit(20.0), 400 * F.col("area") / F.sum("area").over(every))).withColumn("base", F.floor("want"))
    q = q.withColumns({"r": F.row_number().over(every.orderBy(F.desc(F.col("want") - F.col("base")), "stratum")), "left": F.round(F.sum("want").over(every)) - F.sum("base").over(every)})
    return q.select("stratum", (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("samples"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT a.label AS one, b.label AS two, round(sqrt(sum(power(a.m - b.m, 2))), 4) AS distance FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2""")
def centroid_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    c = e.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    two = c.select(F.col("label").alias("two"), "d", F.col("m").alias("m2"))
    return c.withColumnRenamed("label", "one").join(two, "d").where("one < two").groupBy("one", "two").agg(F.round(F.sqrt(F.sum(F.pow(F.col("m") - F.col("m2"), F.lit(2.0)))), 4).alias("distance"))


@query("""SELECT vec_id, label, CAST(vec_id // 10 % 5 AS INTEGER) AS fold, count(*) OVER (PARTITION BY vec_id // 10 % 5) AS fold_size FROM embeddings""")
def group_folds(spark, sf_dir):
    fold = (F.floor(F.col("vec_id") / 10) % 5).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", fold.alias("fold"))
    return rows.join(rows.groupBy("fold").agg(F.count(F.lit(1)).alias("fold_size")), "fold")
