"""Queries of fitted models and samples: moments, unlikeness, temperature, allocation and blocks held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import models, sampling
from tilth.plans.base import query, table

SIZE = 64


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, {SIZE + 1})) AS d FROM embeddings), e0 AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, d FROM e UNION ALL SELECT vec_id, 1.0, 0 FROM embeddings)
SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS total FROM e0 a JOIN e0 b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY 1, 2""")
def embedding_moments(spark, sf_dir):
    """Counts, sums and sums of products of the embeddings' features, by partial matrices."""
    return models.moments(table(spark, sf_dir, "embeddings"), "embedding", SIZE).select("i", "j", F.round("total", 6).alias("total"))


@query()
def unlike_embeddings(spark, sf_dir):
    """How unlike the embeddings of even labels each embedding is, and whether it is past 99 % of those."""
    rows = table(spark, sf_dir, "embeddings")
    model = models.fit_unlikeness(rows.where("label % 2 = 0"), "embedding", SIZE)
    return models.unlikeness(rows.select("vec_id", "label", "embedding"), "embedding", SIZE, model).drop("embedding")


def _class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overconfident probabilities of three classes, the return flags, and the flag."""
    line = table(spark, sf_dir, "lineitem")
    part = lambda k: 1 + (F.col("l_partkey") * (k + 3) + F.col("l_linenumber") * 7) % 10
    own = F.get(F.array(*[F.lit(x) for x in "ANR"]), (F.col("l_orderkey") % 3).cast("int"))
    level = [F.pow(part(k).cast("double"), F.lit(2.0)) * F.when((own == x) & (F.col("l_returnflag") == x), 6.0).otherwise(1.0) for k, x in enumerate("ANR")]
    total = level[0] + level[1] + level[2]
    return line.select(F.array(*[x / total for x in level]).alias("p"), F.array_position(F.array(*[F.lit(x) for x in "ANR"]), F.col("l_returnflag")).cast("int").alias("k")).withColumn("label", F.col("k") - 1)


_PART = "power(CAST(1 + (l_partkey * {k} + l_linenumber * 7) % 10 AS DOUBLE), 2) * CASE WHEN l_orderkey % 3 = {n} AND l_returnflag = '{x}' THEN 6.0 ELSE 1.0 END"


@query(f"""WITH l AS (SELECT {', '.join(_PART.format(k=k + 3, n=k, x=x) + f' AS a{k}' for k, x in enumerate('ANR'))}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem),
g AS (SELECT ln(a0 / (a0 + a1 + a2)) AS x0, ln(a1 / (a0 + a1 + a2)) AS x1, ln(a2 / (a0 + a1 + a2)) AS x2, y FROM l),
p AS (SELECT x0, x1, x2, CASE y WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS own, count(*) AS n FROM g GROUP BY ALL),
t1 AS (SELECT t, sum(n * (ln(exp(x0 / t) + exp(x1 / t) + exp(x2 / t)) - own / t)) / sum(n) AS loss FROM p, (SELECT unnest(range(4, 121)) / 20.0 AS t) GROUP BY 1),
b1 AS (SELECT arg_min(t, loss) AS t FROM t1),
t2 AS (SELECT s.t, sum(n * (ln(exp(x0 / s.t) + exp(x1 / s.t) + exp(x2 / s.t)) - own / s.t)) / sum(n) AS loss FROM p, (SELECT t + unnest(range(-100, 101)) / 2000.0 AS t FROM b1) s GROUP BY 1),
b2 AS (SELECT arg_min(t, loss) AS t FROM t2),
t3 AS (SELECT s.t, sum(n * (ln(exp(x0 / s.t) + exp(x1 / s.t) + exp(x2 / s.t)) - own / s.t)) / sum(n) AS loss FROM p, (SELECT t + unnest(range(-100, 101)) / 200000.0 AS t FROM b2) s GROUP BY 1)
SELECT round(arg_min(t, loss), 3) AS temperature, round(min(loss), 8) AS loss, (SELECT round(loss, 8) FROM t1 WHERE t = 1) AS loss_before FROM t3""")
def fitted_temperature(spark, sf_dir):
    """The temperature of the least log loss, by Newton steps on sums."""
    found = models.fit_temperature(_class_rows(spark, sf_dir), "p", "label")
    return spark.createDataFrame([(round(found["temperature"], 3), round(found["loss"], 8), round(found["loss_before"], 8))], "temperature double, loss double, loss_before double")


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS h, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 4000 THEN CAST(c_acctbal AS DECIMAL(15, 2)) ELSE 0 END) AS DOUBLE) AS a FROM customer GROUP BY 1),
start AS (SELECT least(400, sum(n)) AS total, sum(least(12, n)) AS floors, list({'h': h, 'n': n, 'a': a, 'f': least(12, n), 'x': CAST(NULL AS BIGINT)} ORDER BY h) AS items FROM s),
r AS (
  SELECT CAST(0 AS BIGINT) AS k, total, list_transform(items, lambda i: {'h': i.h, 'n': i.n, 'a': i.a, 'f': i.f, 'x': CASE WHEN floors >= total OR i.n = 0 THEN i.f END, 's': CAST(NULL AS DOUBLE)}) AS items, true AS changed FROM start
  UNION ALL SELECT k + 1, total, list_transform(shared, lambda i: {'h': i.h, 'n': i.n, 'a': i.a, 'f': i.f, 'x': CASE WHEN i.x IS NOT NULL THEN i.x WHEN i.s < i.f THEN i.f WHEN i.s > i.n THEN i.n END, 's': i.s}), len(list_filter(shared, lambda i: i.x IS NULL AND (i.s < i.f OR i.s > i.n))) > 0
  FROM (SELECT k, total, list_transform(items, lambda i: {'h': i.h, 'n': i.n, 'a': i.a, 'f': i.f, 'x': i.x, 's': CASE WHEN i.x IS NULL THEN CASE WHEN area > 0 THEN rest * i.a / area ELSE rest / free END END}) AS shared
    FROM (SELECT k, total, items, total - coalesce(list_sum(list_transform(items, lambda i: i.x)), 0) AS rest, coalesce(list_sum(list_transform(list_filter(items, lambda i: i.x IS NULL), lambda i: i.a)), 0) AS area, len(list_filter(items, lambda i: i.x IS NULL)) AS free FROM r WHERE changed))),
e AS (SELECT total, unnest(arg_max(items, k)) AS i FROM r GROUP BY 1),
o AS (SELECT i.h AS h, i.x AS x, i.n AS n, i.s AS s, floor(i.s) AS b, total FROM e),
q AS (SELECT *, sum(CASE WHEN x IS NULL AND b < n THEN 1 ELSE 0 END) OVER (ORDER BY s - b DESC NULLS LAST, h) AS place, total - coalesce(sum(x) OVER (), 0) - coalesce(sum(CASE WHEN x IS NULL THEN b END) OVER (), 0) AS spare FROM (SELECT h, x, n, CASE WHEN x IS NULL THEN s END AS s, CASE WHEN x IS NULL THEN b END AS b, total FROM o))
SELECT h AS stratum, CAST(coalesce(x, b + CASE WHEN b < n AND place <= spare THEN 1 ELSE 0 END) AS BIGINT) AS samples FROM q""")
def allocation_to_fixed_point(spark, sf_dir):
    """Samples by area with a least and a most a stratum, shared anew until nothing changes."""
    c = table(spark, sf_dir, "customer")
    strata = c.groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("c_acctbal") > 4000, F.col("c_acctbal").cast("decimal(15,2)")).otherwise(F.lit(0).cast("decimal(15,2)"))).cast("double").alias("area"))
    return sampling.allocated(strata, 400, 12)


_Q = {"AUTOMOBILE": 60, "BUILDING": 60, "MACHINERY": 25}
_N = list(_Q)
_FILL = " + ".join(f"least(g{k}, greatest({q} - got_{k}, 0)) / {q}.0" for k, q in enumerate(_Q.values()))


@query(f"""WITH RECURSIVE b AS (
  SELECT c_custkey % 80 AS block, {', '.join(f"count(*) FILTER (c_mktsegment = '{c}' AND c_acctbal > 0) AS g{k}, count(*) FILTER (c_mktsegment = '{c}') AS l{k}" for k, c in enumerate(_N))}, min(2.5 * (c_custkey % 80)) AS far FROM customer WHERE c_mktsegment IN {tuple(_N)} GROUP BY 1),
pool AS (SELECT {', '.join(f'greatest(sum(l{k}), 1) AS p{k}' for k in range(3))} FROM b),
r AS (
  SELECT 0 AS place, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS block, CAST(0 AS BIGINT) AS got_0, CAST(0 AS BIGINT) AS got_1, CAST(0 AS BIGINT) AS got_2
  UNION ALL SELECT place + 1, chosen || [best.block], best.block, got_0 + best.g0, got_1 + best.g1, got_2 + best.g2 FROM (
    SELECT place, chosen, got_0, got_1, got_2, arg_min({{'block': block, 'g0': g0, 'g1': g1, 'g2': g2}}, (-score, block)) AS best FROM (
      SELECT r.place, r.chosen, r.got_0, r.got_1, r.got_2, b.*, round(({_FILL}) / ({' + '.join(f'l{k} / p{k}' for k in range(3))} + 0.001) / (1 + far / 150), 12) AS score FROM r, b, pool
      WHERE NOT list_contains(r.chosen, b.block) AND ({' OR '.join(f'got_{k} < {q}' for k, q in enumerate(_Q.values()))})) WHERE score > 0 GROUP BY ALL))
SELECT block, place, got_0, got_1, got_2 FROM r WHERE place > 0""")
def held_out_blocks(spark, sf_dir):
    """Whole blocks for testing, the one that fills most of the quotas for the least cost first."""
    c = table(spark, sf_dir, "customer")
    rows = c.select((F.col("c_custkey") % 80).alias("block"), F.col("c_mktsegment").alias("class"), (F.col("c_acctbal") > 0).alias("eligible"), (2.5 * (F.col("c_custkey") % 80)).cast("double").alias("distance"))
    return sampling.greedy_blocks(rows, _Q)
