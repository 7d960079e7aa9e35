"""Queries of crop cycles, a pass each and all together, over the looks at suppliers' parcels.

A look is a line item: its parcel the supplier's, its day the day of shipping. What grows follows from the parcel's number:
one crop a year, two, a weak one, plants that stay, or nothing; the discount is the noise, and in the clouded weeks of
every second parcel nothing is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import cropcycles as cc
from tilth.operators.graph import written
from tilth.plans.base import query, table

RULES = cc.Rules()
BASE, ADAPTIVE, DENSITY, NDVI = cc.passes(RULES)


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parcel_id, day, ndvi, evi, ndmi."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("parcel_id"), F.col("l_shipdate").cast("date").alias("day"), ((F.col("l_discount").cast("double") - 0.05) / 5).alias("noise")
    )
    d, kind = F.datediff("day", F.lit("1992-01-01").cast("date")) + 37 * F.col("parcel_id"), F.col("parcel_id") % 5
    tent = lambda days: 1 - F.abs(2 * (d % days) / float(days) - 1)
    year, half = tent(365), tent(182)
    level = (
        F.when(kind == 0, 0.14 + 0.64 * F.greatest(F.lit(0.0), 2 * year - 1)).when(kind == 1, 0.14 + 0.66 * half).when(kind == 2, 0.14 + 0.36 * F.greatest(F.lit(0.0), 2 * year - 1))
    ).when(kind == 3, 0.69 + 0.1 * year).otherwise(0.13)
    clouded = (F.col("parcel_id") % 2 == 0) & (F.datediff("day", F.lit("1992-01-01").cast("date")) % 365).between(200, 260)
    seen = line.select("parcel_id", "day", F.when(~clouded, level + F.col("noise")).alias("ndvi"))
    return seen.select("*", F.when(F.col("parcel_id") % 5 != 2, 0.8 * F.col("ndvi")).alias("evi"), (0.45 * F.col("ndvi") - 0.05).alias("ndmi"))


_D = "CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS INTEGER)"
_TENT = "(1 - abs(2 * ((d + 37 * parcel_id) % {0}) / {0}.0 - 1))"
_YEAR, _HALF = _TENT.format(365), _TENT.format(182)
LOOKS = f"""lk0 AS (SELECT l_suppkey AS parcel_id, CAST(l_shipdate AS DATE) AS day, {_D} AS d, (CAST(l_discount AS DOUBLE) - 0.05) / 5 AS noise FROM lineitem),
lk1 AS (
  SELECT parcel_id, day, CASE WHEN NOT (parcel_id % 2 = 0 AND d % 365 BETWEEN 200 AND 260) THEN noise + CASE parcel_id % 5
    WHEN 0 THEN 0.14 + 0.64 * greatest(0, 2 * {_YEAR} - 1) WHEN 1 THEN 0.14 + 0.66 * {_HALF}
    WHEN 2 THEN 0.14 + 0.36 * greatest(0, 2 * {_YEAR} - 1) WHEN 3 THEN 0.69 + 0.1 * {_YEAR} ELSE 0.13 END END AS ndvi FROM lk0),
lk AS (SELECT parcel_id, day, CAST(ndvi AS DOUBLE) AS ndvi, CAST(CASE WHEN parcel_id % 5 <> 2 THEN 0.8 * ndvi END AS DOUBLE) AS evi, CAST(0.45 * ndvi - 0.05 AS DOUBLE) AS ndmi FROM lk1)"""


def _edges(src: str, dst: str, v: str, empty: float) -> str:
    return f"""{dst}_a AS (SELECT *, lead({v}) OVER b - {v} AS up_, {v} - lag({v}) OVER b AS down_ FROM {src} WINDOW b AS (PARTITION BY parcel_id ORDER BY bin)),
{dst}_e AS (
  SELECT parcel_id, arg_min({{'bin': bin, 'y': {v}, 's': coalesce(up_, 0)}}, bin) FILTER ({v} IS NOT NULL) AS f_, arg_max({{'bin': bin, 'y': {v}, 's': coalesce(down_, 0)}}, bin) FILTER ({v} IS NOT NULL) AS l_
  FROM {dst}_a GROUP BY 1),
{dst} AS (
  SELECT a.* EXCLUDE (up_, down_) REPLACE (CASE WHEN f_ IS NULL THEN {empty} WHEN bin < f_.bin THEN f_.y - f_.s * (f_.bin - bin) WHEN bin > l_.bin THEN l_.y + l_.s * (bin - l_.bin) ELSE {v} END AS {v})
  FROM {dst}_a a JOIN {dst}_e USING (parcel_id))"""


def _runs(src: str, dst: str, v: str, more: str = "") -> str:
    """The values and bins on either side of each row."""
    return f"""{dst} AS (
  SELECT *, last_value({v} IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN {v} IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS b0,
    first_value({v} IGNORE NULLS) OVER q AS y1, first_value(CASE WHEN {v} IS NOT NULL THEN bin END IGNORE NULLS) OVER q AS b1{more} FROM {src}
  WINDOW p AS (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    n AS (PARTITION BY parcel_id ORDER BY bin))"""


def _short(src: str, dst: str, v: str) -> str:
    return f"""{_runs(src, dst + '_r', v)},
{dst} AS (
  SELECT * EXCLUDE (y0, b0, y1, b1) REPLACE (CASE WHEN {v} IS NULL AND (b1 - b0 - 1) * 10 <= 48 THEN y0 + (y1 - y0) * (bin - b0) / (b1 - b0) ELSE {v} END AS {v}) FROM {dst}_r)"""


def _long(src: str, dst: str, v: str, ref: str) -> str:
    ahead = ", ".join(f"lead({ref}, {j}) OVER b" for j in range(6))
    return f"""{dst}_n AS (SELECT *, list_filter([{ahead}], lambda x: x IS NOT NULL) AS near FROM {src} WINDOW b AS (PARTITION BY parcel_id ORDER BY bin)),
{dst}_f AS (SELECT *, CASE WHEN {v} IS NOT NULL THEN len(near) >= 3 AND (near[-1] + near[-2]) / 2 < (near[1] + near[2]) / 2 - 0.028 END AS falls FROM {dst}_n),
{_runs(dst + '_f', dst + '_r', v, ", first_value(falls IGNORE NULLS) OVER q AS hat")},
{dst}_t AS (
  SELECT *, (bin - b0) / CAST(b1 - b0 AS DOUBLE) AS x, greatest(y0, y1, 0.18) + least(0.22, 0.35 * greatest(0, 0.55 - least(y0, y1))) AS top0, CASE WHEN y1 < y0 + 0.08 THEN 0.5 ELSE 0.58 END AS turn FROM {dst}_r),
{dst} AS (
  SELECT * EXCLUDE (near, falls, y0, b0, y1, b1, hat, x, top0, turn) REPLACE (CASE WHEN {v} IS NULL AND (b1 - b0 - 1) * 10 >= 36 THEN least(1.0, greatest(-0.1, CASE
    WHEN hat AND x <= turn THEN y0 + (least(0.82, top0) - y0) * (x / turn) WHEN hat THEN least(0.82, top0) + (y1 - least(0.82, top0)) * ((x - turn) / (1 - turn))
    WHEN b1 - b0 = 2 THEN y0 ELSE y0 + (y1 - y0) * (bin - b0 - 1) / (b1 - b0 - 2) END)) ELSE {v} END AS {v}) FROM {dst}_t)"""


_SMOOTH = "(3 * {0} + 2 * coalesce(lag({0}) OVER b, 0) + 2 * coalesce(lead({0}) OVER b, 0) + coalesce(lag({0}, 2) OVER b, 0) + coalesce(lead({0}, 2) OVER b, 0)) / (3 + 2 * (bin > 0)::INT + 2 * (bin < last)::INT + (bin > 1)::INT + (bin < last - 1)::INT)"
REGULAR = f"""{LOOKS},
own AS (SELECT *, CAST(ceil(span / 10.0) AS INTEGER) AS last FROM (SELECT parcel_id, min(day) AS start, CAST(max(day) - min(day) AS INTEGER) AS span, count(*) AS n_looks, count(evi) AS n_evi FROM lk GROUP BY 1) WHERE n_looks >= 10),
every AS (SELECT *, least(bin * 10, span) AS off FROM (SELECT *, CAST(unnest(range(0, last + 1)) AS INTEGER) AS bin FROM own)),
binned AS (SELECT parcel_id, CAST(least(round_even((day - start) / 10.0, 0), last) AS INTEGER) AS bin, avg(ndvi) AS ndvi, avg(evi) AS evi, avg(ndmi) AS ndmi FROM lk JOIN own USING (parcel_id) GROUP BY 1, 2),
g0 AS (SELECT e.*, b.ndvi, b.evi, b.ndmi, b.ndvi IS NOT NULL AS seen FROM every e LEFT JOIN binned b ON b.parcel_id = e.parcel_id AND b.bin = e.bin),
{_edges('g0', 'g1', 'ndvi', 0.22)},{_edges('g1', 'g2', 'ndmi', 0.0)},{_edges('g2', 'g3', 'evi', 0.22)},
{_short('g3', 'g4', 'ndvi')},{_short('g4', 'g5', 'ndmi')},{_short('g5', 'g6', 'evi')},
{_long('g6', 'g7', 'ndvi', 'ndvi')},{_long('g7', 'g8', 'ndmi', 'ndvi')},{_long('g8', 'g9', 'evi', 'ndvi')},
c0 AS (SELECT * REPLACE (least(1.0, greatest(-0.1, ndvi)) AS ndvi, least(0.8, greatest(-0.6, ndmi)) AS ndmi) FROM g9),
c1 AS (SELECT * REPLACE (least(1.0, greatest(0.0, CASE WHEN n_evi < 0.3 * n_looks THEN 0.85 * ndvi + 0.02 ELSE evi END)) AS evi) FROM c0),
c2 AS (SELECT *, least(1.0, greatest(0.0, 0.5 * ndvi + 0.3 * evi + 0.2 * ndmi)) AS cvi FROM c1),
s AS (SELECT *, {_SMOOTH.format('cvi')} AS v, {_SMOOTH.format('ndvi')} AS w FROM c2 WINDOW b AS (PARTITION BY parcel_id ORDER BY bin))"""

ARRAYS = """arr AS (SELECT parcel_id, any_value(start) AS start, any_value(span) AS span, CAST(count(*) AS INTEGER) AS n, list(off ORDER BY bin) AS off, list(v ORDER BY bin) AS v, list(w ORDER BY bin) AS w FROM s GROUP BY 1)"""


def _least(a: str, lo: str, hi: str) -> str:
    return f"list_min({a}[{lo} + 1:{hi} + 1])"


def _first(lo: str, hi: str, test: str, f: str = "list_min") -> str:
    return f"CASE WHEN {hi} >= {lo} THEN {f}(list_filter(range({lo}, {hi} + 1), lambda j: {test})) END"


def _foot(a: str) -> str:
    return f"list_avg({a}[greatest(0, sow - 2) + 1:least(n - 1, sow + 1) + 1])"


def _pass(p: cc.Pass) -> str:
    """CTEs of a pass; its cycles are in `cyc_<name>`: parcel_id, sow, peak, harvest."""
    x, v, fl, back = p.name, p.value, p.prominence, f"ROWS BETWEEN {p.reach} PRECEDING AND CURRENT ROW"
    lasts = f"off[harvest + 1] - off[sow + 1] BETWEEN 40 AND {p.max_days}"
    keep = "kept[:-2] || [cur]"
    fold = lambda name, src, close: f"""{name} AS (
  SELECT parcel_id, 1 AS k, [ps[1]] AS kept FROM {src} WHERE len(ps) > 0
  UNION ALL SELECT parcel_id, k + 1, CASE WHEN {close} AND {v}[cur + 1] > {v}[kept[-1] + 1] THEN {keep} WHEN {close} THEN kept ELSE kept || [cur] END
    FROM (SELECT f.*, q.ps[f.k + 1] AS cur, a.v, a.w FROM {name} f JOIN {src} q USING (parcel_id) JOIN arr a USING (parcel_id) WHERE f.k < len(q.ps)))"""  # noqa: E731
    trough = f"""SELECT * EXCLUDE (sow0, harvest0), CASE WHEN sow0 >= peak THEN greatest(0, peak - 4) ELSE sow0 END AS sow2, CASE WHEN harvest0 <= peak THEN least(n - 1, peak + 4) ELSE harvest0 END AS harvest2 FROM (
      SELECT *, coalesce({_first('left0', 'left1', 'w[j + 1] <= ' + _least('w', 'left0', 'left1') + ' + 0.04', 'list_max')}, left0) AS sow0, coalesce({_first('right0', 'right1', 'w[j + 1] <= ' + _least('w', 'right0', 'right1') + ' + 0.04')}, right1) AS harvest0 FROM (
      SELECT *, greatest(left0, peak - 4) AS left1 FROM (
      SELECT *, greatest(used + 1, peak - 12, 0) AS left0, least(n - 1, peak + 4) AS right0, least(before_next, peak + 12, n - 1) AS right1 FROM walk_in)))"""
    plain = f"""SELECT *, greatest(CASE WHEN used >= 0 THEN used + 1 ELSE 0 END, coalesce({_first('lo', 'hi', 'v[j + 1] < 0.35', 'list_max')}, CASE WHEN hi >= lo THEN lo + list_position(v[lo + 1:hi + 1], {_least('v', 'lo', 'hi')}) - 1 END, lo)) AS sow1,
      coalesce({_first('peak + 4', 'h', 'v[j + 1] < 0.35')}, {_first('peak + 4', 'h', 'w[j + 1] < 0.36')}, CASE WHEN h >= peak + 4 THEN peak + 4 + list_position(v[peak + 5:h + 1], {_least('v', 'peak + 4', 'h')}) - 1 END, h) AS harvest1
      FROM (SELECT *, greatest(0, peak - 19) AS lo, peak - 4 AS hi, least(n - 1, peak + 14, before_next) AS h FROM ({trough}))"""
    both = f"""SELECT *, CASE WHEN fits THEN sow1 ELSE sow2 END AS sow, CASE WHEN fits THEN harvest1 ELSE harvest2 END AS harvest FROM (SELECT *, off[harvest1 + 1] - off[sow1 + 1] BETWEEN 40 AND {p.max_days} AS fits FROM ({plain}))"""
    chosen = f"SELECT *, sow2 AS sow, harvest2 AS harvest FROM ({trough})" if p.anchored else both
    rises = f"w[peak + 1] - {_foot('w')} >= {p.rise}" + ("" if p.anchored else f" OR v[peak + 1] - {_foot('v')} >= {p.rise}")
    walk_in = f"SELECT f.*, q.ps[f.k + 1] AS peak, coalesce(q.ps[f.k + 2] - 1, a.n - 1) AS before_next, a.n, a.off, a.v, a.w FROM walk_{x} f JOIN flat_{x}_end q USING (parcel_id) JOIN arr a USING (parcel_id) WHERE f.k < len(q.ps)"
    return f"""raw_{x} AS (
  SELECT parcel_id, list(bin ORDER BY bin) AS ps FROM (
    SELECT *, max({v}) OVER (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN {p.window} PRECEDING AND {p.window} FOLLOWING) AS top, {v} - least(min({v}) OVER (PARTITION BY parcel_id ORDER BY bin {back}), min({v}) OVER (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND {p.reach} FOLLOWING)) AS falls FROM s)
  WHERE bin BETWEEN {p.window} AND last - {p.window} AND {v} >= {p.peak} AND {v} >= top - 0.005 AND falls >= {fl} GROUP BY 1),
{fold('apart_' + x, 'raw_' + x, f'cur - kept[-1] < {p.separation}')},
apart_{x}_end AS (SELECT parcel_id, arg_max(kept, k) AS ps FROM apart_{x} GROUP BY 1),
{fold('flat_' + x, f'apart_{x}_end', f"least({v}[cur + 1], {v}[kept[-1] + 1]) - {_least(v, 'kept[-1]', 'cur')} < {fl}")},
flat_{x}_end AS (SELECT parcel_id, arg_max(kept, k) AS ps FROM flat_{x} GROUP BY 1),
walk_{x} AS (
  SELECT parcel_id, 0 AS k, -1 AS used, CAST([] AS STRUCT(sow INTEGER, peak INTEGER, harvest INTEGER)[]) AS found FROM flat_{x}_end JOIN arr USING (parcel_id){' WHERE n >= 12' if p.anchored else ''}
  UNION ALL SELECT parcel_id, k + 1, CAST(CASE WHEN taken THEN harvest ELSE used END AS INTEGER), CASE WHEN taken THEN found || [CAST({{'sow': sow, 'peak': peak, 'harvest': harvest}} AS STRUCT(sow INTEGER, peak INTEGER, harvest INTEGER))] ELSE found END FROM (
    SELECT *, peak > used AND {lasts} AND ({rises}) AS taken FROM ({chosen.replace('walk_in', f'({walk_in})')}))),
cyc_{x} AS (SELECT parcel_id, arg_max(found, k) AS found FROM walk_{x} GROUP BY 1)"""


PERENNIAL = """stays AS (SELECT parcel_id, quantile_cont(v, 0.1) AS low, quantile_cont(v, 0.9) AS high, avg(CASE WHEN v < 0.35 THEN 1.0 ELSE 0.0 END) AS bare, count(*) AS n FROM s GROUP BY 1),
yearly AS (
  SELECT parcel_id, bin // 36 AS k, CAST(min(bin) AS INTEGER) AS sow, CAST(arg_min(bin, (-v, bin)) AS INTEGER) AS peak, CAST(max(bin) AS INTEGER) AS harvest FROM s GROUP BY 1, 2),
cyc_perennial AS (
  SELECT parcel_id, list(CAST({'sow': sow, 'peak': peak, 'harvest': harvest} AS STRUCT(sow INTEGER, peak INTEGER, harvest INTEGER)) ORDER BY k) AS found FROM yearly JOIN stays USING (parcel_id)
  WHERE n >= 18 AND low >= 0.5 AND bare <= 0.05 AND high - low <= 0.3 AND (k = 0 OR (harvest - sow + 1) * 2 >= 36) AND sow < n - 1 GROUP BY 1)"""


def _rows(name: str) -> str:
    return f"""SELECT parcel_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY c.sow) AS INTEGER) AS number, start + off[c.sow + 1] AS sown, start + off[c.peak + 1] AS peaked, start + off[c.harvest + 1] AS harvested, CAST(off[c.harvest + 1] - off[c.sow + 1] AS INTEGER) AS days
FROM (SELECT parcel_id, unnest(found) AS c FROM {name}) JOIN arr USING (parcel_id)"""


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(cc.as_arrays(cc.regular(looks(spark, sf_dir), RULES), RULES))


def _dated(arrays: DataFrame, found) -> DataFrame:
    each = written(arrays.select("parcel_id", "start", "off", found.alias("found"))).select("*", F.posexplode("found").alias("number", "c"))
    day = lambda j: F.date_add("start", F.get("off", F.col(j)))
    days = F.get("off", F.col("c.harvest")) - F.get("off", F.col("c.sow"))
    return each.select("parcel_id", (F.col("number") + 1).alias("number"), day("c.sow").alias("sown"), day("c.peak").alias("peaked"), day("c.harvest").alias("harvested"), days.alias("days"))


@query(f"""WITH {REGULAR} SELECT parcel_id, bin, start + off AS day, seen, round(ndvi, 9) AS ndvi, round(evi, 9) AS evi, round(ndmi, 9) AS ndmi, round(v, 9) AS composite, round(w, 9) AS smooth_ndvi FROM s""")
def cycle_series(spark, sf_dir):
    """The regular series: edges led on, short gaps bridged, long ones shaped by what comes after."""
    rounded = [F.round(c, 9).alias(name) for c, name in (("ndvi", "ndvi"), ("evi", "evi"), ("ndmi", "ndmi"), ("v", "composite"), ("w", "smooth_ndvi"))]
    return cc.regular(looks(spark, sf_dir), RULES).select("parcel_id", "bin", F.date_add("start", F.col("off")).alias("day"), "seen", *rounded)


@query(f"WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(BASE)} {_rows('cyc_base')}")
def cycles_base_pass(spark, sf_dir):
    return _dated(_arrays(spark, sf_dir), cc.found(BASE, RULES))


@query(f"WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(ADAPTIVE)} {_rows('cyc_adaptive')}")
def cycles_adaptive_pass(spark, sf_dir):
    return _dated(_arrays(spark, sf_dir), cc.found(ADAPTIVE, RULES))


@query(f"WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(DENSITY)} {_rows('cyc_density')}")
def cycles_density_pass(spark, sf_dir):
    return _dated(_arrays(spark, sf_dir), cc.found(DENSITY, RULES))


@query(f"WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(NDVI)} {_rows('cyc_ndvi')}")
def cycles_ndvi_pass(spark, sf_dir):
    return _dated(_arrays(spark, sf_dir), cc.found(NDVI, RULES))


@query(f"WITH {REGULAR},{ARRAYS},{PERENNIAL} {_rows('cyc_perennial')}")
def cycles_perennial_pass(spark, sf_dir):
    return _dated(_arrays(spark, sf_dir), cc.perennial(RULES))


_WINDOWS = [("kharif", "-06-01", 0, "-10-15", 0), ("rabi", "-10-15", 0, "-03-15", 1), ("zaid", "-03-15", 0, "-06-01", 0)]


def _season_days(season: tuple) -> str:
    name, a, x, b, y = season
    date = lambda md, k: f"CAST((year(sown) + {k}) || '{md}' AS DATE)"
    return " + ".join(f"greatest(0, least(harvested, {date(b, k + y)}) - greatest(sown, {date(a, k + x)}))" for k in (-1, 0, 1)) + f" AS {name}"


CHOSEN = f"""chosen AS (
  SELECT parcel_id, CASE WHEN last_pass = 'ndvi' AND len(f4) > len(best) THEN 'ndvi' WHEN len(best) = 0 AND len(f4) = 0 AND len(f5) > 0 THEN 'perennial' ELSE pass3 END AS pass,
    CASE WHEN len(f4) > len(best) THEN f4 WHEN len(best) = 0 AND len(f5) > 0 THEN f5 ELSE best END AS found
  FROM (SELECT *, 'ndvi' AS last_pass, CASE WHEN len(two) < expected AND len(f3) > len(two) THEN f3 ELSE two END AS best, CASE WHEN len(two) < expected AND len(f3) > len(two) THEN 'density' ELSE pass2 END AS pass3
  FROM (SELECT *, CASE WHEN len(f1) < wanted AND len(f2) > len(f1) THEN f2 ELSE f1 END AS two, CASE WHEN len(f1) < wanted AND len(f2) > len(f1) THEN 'adaptive' ELSE 'base' END AS pass2
  FROM (SELECT a.parcel_id, greatest(1, ceil(greatest(0.25, span / 365.25) * 0.65)) AS wanted, greatest(1, ceil(greatest(0.25, span / 365.25) * 1.5)) AS expected,
    coalesce(b.found, []) AS f1, coalesce(c.found, []) AS f2, coalesce(d.found, []) AS f3, coalesce(e.found, []) AS f4, coalesce(p.found, []) AS f5
  FROM arr a LEFT JOIN cyc_base b USING (parcel_id) LEFT JOIN cyc_adaptive c USING (parcel_id) LEFT JOIN cyc_density d USING (parcel_id) LEFT JOIN cyc_ndvi e USING (parcel_id) LEFT JOIN cyc_perennial p USING (parcel_id)))))"""

DESCRIBED = f"""row0 AS (
  SELECT parcel_id, pass, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY c.sow) AS INTEGER) AS number, c.sow AS sow, c.peak AS peak, c.harvest AS harvest, start + off[c.sow + 1] AS sown, start + off[c.peak + 1] AS peaked, start + off[c.harvest + 1] AS harvested, CAST(off[c.harvest + 1] - off[c.sow + 1] AS INTEGER) AS days
  FROM (SELECT parcel_id, pass, unnest(found) AS c FROM chosen) JOIN arr USING (parcel_id)),
lookdays AS (SELECT parcel_id, day, count(ndvi) AS n FROM lk GROUP BY 1, 2),
gap AS (
  SELECT * FROM (SELECT parcel_id, lag(day) OVER (PARTITION BY parcel_id ORDER BY day) AS a, day AS b FROM lookdays) WHERE b - a >= 25
  UNION ALL SELECT * FROM (SELECT parcel_id, lag(day) OVER (PARTITION BY parcel_id ORDER BY day) AS a, day AS b FROM lookdays WHERE n > 0) WHERE b - a >= 25),
gapped AS (SELECT r.parcel_id, r.number, CAST(sum(b - a) AS INTEGER) AS gap_days FROM row0 r JOIN gap g ON g.parcel_id = r.parcel_id AND a <= harvested AND b >= sown WHERE pass <> 'perennial' GROUP BY 1, 2),
inside AS (
  SELECT r.parcel_id, r.number, max(s.ndvi) AS top, quantile_cont(s.ndvi, 0.1) AS low, stddev_pop(s.ndvi) AS spread, avg(s.v) AS mean_v, stddev_pop(s.v) AS spread_v, avg(s.seen::INT) AS seen_share, avg(s.evi) AS evi, avg(s.ndmi) AS ndmi,
    max(CASE WHEN s.bin = peak THEN s.v END) AS peak_cvi, max(CASE WHEN s.bin = peak THEN s.w END) AS peak_w, bool_or(s.bin = peak AND s.seen) AS peak_seen
  FROM row0 r JOIN s ON s.parcel_id = r.parcel_id AND s.bin BETWEEN sow AND harvest GROUP BY 1, 2),
trap AS (
  SELECT r.parcel_id, r.number, sum((s.ndvi + s.after) / 2 * (s.off2 - s.off)) AS ndvi_days FROM row0 r
  JOIN (SELECT *, lead(ndvi) OVER (PARTITION BY parcel_id ORDER BY bin) AS after, lead(off) OVER (PARTITION BY parcel_id ORDER BY bin) AS off2 FROM s) s ON s.parcel_id = r.parcel_id AND s.bin BETWEEN sow AND harvest - 1 GROUP BY 1, 2),
foot AS (SELECT r.parcel_id, r.number, avg(s.w) AS foot FROM row0 r JOIN s ON s.parcel_id = r.parcel_id AND s.bin BETWEEN sow - 2 AND sow + 1 GROUP BY 1, 2),
near AS (SELECT r.parcel_id, r.number, avg(s.evi) AS evi3, avg(s.ndmi) AS ndmi3 FROM row0 r JOIN s ON s.parcel_id = r.parcel_id AND s.bin BETWEEN peak - 1 AND peak + 1 GROUP BY 1, 2),
row1 AS (
  SELECT r.*, pass = 'perennial' AS stays, CASE WHEN pass = 'perennial' THEN top ELSE peak_w END AS peak_ndvi, CASE WHEN pass = 'perennial' THEN top - low ELSE peak_w - foot END AS ndvi_rise, ndvi_days,
    CASE WHEN pass = 'perennial' THEN evi ELSE evi3 END AS peak_evi, CASE WHEN pass = 'perennial' THEN ndmi ELSE ndmi3 END AS peak_ndmi, peak_cvi, coalesce(gap_days, 0) AS gap_days, peak_seen, seen_share, spread, mean_v, spread_v, {', '.join(map(_season_days, _WINDOWS))}
  FROM row0 r JOIN inside USING (parcel_id, number) LEFT JOIN trap USING (parcel_id, number) JOIN foot USING (parcel_id, number) JOIN near USING (parcel_id, number) LEFT JOIN gapped USING (parcel_id, number)),
row2 AS (
  SELECT *, CASE WHEN greatest(kharif, rabi, zaid) <= 0 OR kharif = greatest(kharif, rabi, zaid) THEN 'kharif' WHEN rabi = greatest(kharif, rabi, zaid) THEN 'rabi' ELSE 'zaid' END AS best,
    greatest(kharif, rabi, zaid) <= 0 OR greatest(kharif, rabi, zaid) / CAST(greatest(1, days) AS DOUBLE) >= 0.55 AS clear,
    CASE WHEN stays THEN least(1, greatest(0, mean_v / 0.75)) * 55 + CASE WHEN mean_v > 0 THEN least(1, greatest(0, 1 - 3 * spread_v / mean_v)) ELSE 0 END * 30 + seen_share * 15
      ELSE least(25, spread * 150) + CASE WHEN days BETWEEN 60 AND 195 THEN 25.0 WHEN days < 60 THEN greatest(0, 25.0 * (days - 40) / 20) ELSE greatest(10, 25.0 * (1 - (days - 195) / 120.0)) END + least(25, peak_cvi * 40) + least(25, peak_cvi * 25 + spread * 50) - 4.0 * gap_days / 7 END AS points
  FROM row1)"""


@query(f"""WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(BASE)},{_pass(ADAPTIVE)},{_pass(DENSITY)},{_pass(NDVI)},{PERENNIAL},{CHOSEN},{DESCRIBED}
SELECT parcel_id, number, pass, CASE WHEN stays THEN 'perennial' ELSE 'annual' END AS kind, sown, peaked, harvested, days, round(peak_ndvi, 9) AS peak_ndvi, round(ndvi_rise, 9) AS ndvi_rise, round(ndvi_days, 7) AS ndvi_days, round(peak_evi, 9) AS peak_evi, round(peak_ndmi, 9) AS peak_ndmi, round(peak_cvi, 9) AS peak_cvi,
  gap_days, peak_seen, round(seen_share, 9) AS seen_share, round(least(100, greatest(10, points)), 7) AS confidence,
  CASE WHEN stays THEN 'PERENNIAL' WHEN days < 90 AND peak_ndvi > 0.55 THEN 'SHORT_HIGH_VIGOR' WHEN days < 90 THEN 'SHORT_MODERATE' WHEN days >= 180 THEN 'LONG_DURATION' WHEN peak_cvi > 0.6 THEN 'MEDIUM_HIGH_VIGOR' WHEN peak_cvi > 0.45 THEN 'MEDIUM_MODERATE' ELSE 'MEDIUM_LOW_VIGOR' END AS crop_type,
  CASE WHEN stays THEN 'perennial' WHEN clear THEN best ELSE 'cross_season' END AS season,
  CASE WHEN stays THEN 'Production year ' || year(sown) WHEN best = 'rabi' THEN 'Rabi ' || (year(sown) - (month(sown) < 10)::INT) || '/' || (year(sown) + 1 - (month(sown) < 10)::INT)
    WHEN NOT clear THEN 'Cross-season ' || year(sown) WHEN best = 'zaid' THEN 'Zaid ' || year(sown) ELSE 'Kharif ' || year(sown) END AS season_label
FROM row2""")
def crop_cycles(spark, sf_dir):
    """All passes in their order, each only where the ones before found too little, and what each cycle is."""
    rows = cc.cycles(looks(spark, sf_dir), RULES)
    places = {"peak_ndvi": 9, "ndvi_rise": 9, "ndvi_days": 7, "peak_evi": 9, "peak_ndmi": 9, "peak_cvi": 9, "seen_share": 9, "confidence": 7}
    kept = rows.drop("c", "v", "off", "start", "base_ndvi")
    return kept.withColumns({c: F.round(c, n) for c, n in places.items()})
