"""Crop cycles of irregular looks: a regular grid with shaped gap filling, then passes of peak, sowing and harvest.

The grid, filling and smoothing are windows over (parcel, bin). Candidate peaks are read off the parcel's bins as arrays.
What is sequential, a peak's claim on the bins before it, folds over a parcel's few peaks in SQL functions; a parcel's bins
are as many as its years, however many looks fall in them, for looks are averaged before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.graph import written


@dataclass(frozen=True)
class Rules:
    """Thresholds. Days are turned into bins of `step` days."""

    step: int = 10
    least_looks: int = 10
    gap_days: int = 25
    # filling
    short_days: int = 48
    long_days: int = 36
    look_after: int = 6
    decline: float = 0.028
    # a peak, and the ground's level
    low: float = 0.35
    peak: float = 0.55
    rise: float = 0.15
    prominence: float = 0.10
    peak_window: int = 21
    tolerance: float = 0.005
    min_days: int = 40
    max_days: int = 195
    after_peak: int = 135
    separation: int = 3
    harvest_ndvi: float = 0.36
    hint_days: int = 21
    slack: float = 0.04
    half_days: int = 120
    # later passes
    adaptive_share: float = 0.65
    expected_a_year: float = 1.5
    relaxed_peak: float = 0.46
    relaxed_rise: float = 0.10
    density_scale: float = 0.58
    density_peak: float = 0.38
    ndvi_peak: float = 0.38
    ndvi_prominence: float = 0.08
    ndvi_rise: float = 0.08
    ndvi_separation: int = 55
    ndvi_max_days: int = 240
    # plants that stay
    perennial_bins: int = 18
    perennial_level: float = 0.50
    perennial_bare: float = 0.05
    perennial_swing: float = 0.30
    gap_penalty: float = 4.0

    @property
    def least_bins(self) -> int:
        return max(3, self.min_days // self.step)

    @property
    def most_bins(self) -> int:
        return self.max_days // self.step

    @property
    def half_bins(self) -> int:
        return max(self.least_bins, self.half_days // self.step)

    @property
    def year_bins(self) -> int:
        return max(1, round(365 / self.step))


CYCLE = "struct<sow:int,peak:int,harvest:int>"


# ---------------------------------------------------------------- the grid


VALUES = ("ndvi", "evi", "ndmi")


def parcels(looks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a parcel of enough looks, written: start, span (days), last (bin), n_looks, and how many looks have each value."""
    own = looks.groupBy("parcel_id").agg(
        F.min("day").alias("start"), F.datediff(F.max("day"), F.min("day")).alias("span"), F.count(F.lit(1)).alias("n_looks"), *[F.count(v).alias(f"n_{v}") for v in VALUES]
    )
    return written(own.where(F.col("n_looks") >= rules.least_looks).withColumn("last", F.ceil(F.col("span") / rules.step).cast("int")))


#: About as many bins as a task sorts at once.
BINS_A_TASK = 125_000


def tasks(own: DataFrame, bins_a_task: int = BINS_A_TASK) -> int:
    """How many tasks share the parcels: so many that none holds more than its bins, however many parcels there are."""
    bins = own.agg(F.sum(F.col("last") + 1).alias("n")).first().n or 0
    return max(own.sparkSession.sparkContext.defaultParallelism, -(-bins // bins_a_task))


def snapped(looks: DataFrame, own: DataFrame, rules: Rules, n_tasks: int) -> DataFrame:
    """parcel_id, bin, off (days from the first look), n_looks, span, start and the mean of each value's looks nearest to
    each bin. looks: parcel_id, day, values; own: as parcels() has them.

    Looks go to their parcel's task once and are averaged there; the bins between two that have looks are made beside them,
    so all that follows stays in the same tasks. Looks are met by the hash of a task's few parcels and not sorted."""
    nearest = F.least(F.rint(F.datediff("day", "start") / rules.step), F.col("last")).cast("int")  # halves go to the even bin
    facts = ["parcel_id", "start", "span", "last", "n_looks", "n_evi"]
    met = looks.select("parcel_id", "day", *VALUES).repartition(n_tasks, "parcel_id").join(own.select(*facts).repartition(n_tasks, "parcel_id").hint("shuffle_hash"), "parcel_id")
    binned = met.groupBy(*facts, nearest.alias("from")).agg(*[F.avg(v).alias(v) for v in VALUES]).where("from IS NOT NULL")
    until = F.coalesce(F.lead("from").over(Window.partitionBy("parcel_id").orderBy("from")) - 1, F.col("last"))
    every = binned.withColumn("until", until).withColumn("bin", F.explode(F.sequence("from", "until")))
    return every.withColumns({v: F.when(F.col("bin") == F.col("from"), F.col(v)) for v in VALUES}).withColumn("off", F.least(F.col("bin") * rules.step, F.col("span"))).drop("from", "until")


def _rising() -> Window:
    return Window.partitionBy("parcel_id").orderBy("bin")


def _falling() -> Window:
    """Bins from the last to the first: what comes after a bin is read in this order, since a frame that only ends with the
    partition is read anew for each row."""
    return Window.partitionBy("parcel_id").orderBy(F.desc("bin"))


def with_sides(grid: DataFrame, values: tuple[str, ...] = VALUES) -> DataFrame:
    """Of each value the first and last bin that have it (__first_ and __last_), with the slope there, and of each bin the
    nearest before and after it (__a_ and __b_): struct(bin, y). All values share two orders of a parcel's bins, rising and
    then falling, so rows are sorted twice however many values there are; they come out falling."""
    slopes = {f"__{name}_{v}": x for v in values for name, x in (("up", F.lead(v).over(_rising()) - F.col(v)), ("down", F.col(v) - F.lag(v).over(_rising())))}
    side = lambda v, *more: F.when(F.col(v).isNotNull(), F.struct("bin", F.col(v).alias("y"), *more))
    whole, back = _rising().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, -1)
    rising = {}
    for v in values:
        rising[f"__first_{v}"] = F.first(side(v, F.col(f"__up_{v}").alias("slope")), ignorenulls=True).over(whole)
        rising[f"__last_{v}"] = F.last(side(v, F.col(f"__down_{v}").alias("slope")), ignorenulls=True).over(whole)
        rising[f"__a_{v}"] = F.last(side(v), ignorenulls=True).over(_rising().rowsBetween(*back))
    falling = {f"__b_{v}": F.last(side(v), ignorenulls=True).over(_falling().rowsBetween(*back)) for v in values}
    return grid.withColumns(slopes).withColumns(rising).drop(*slopes).withColumns(falling)


def with_edges(value: str, empty: float) -> Column:
    """The value led on past its first and last bin by the slope of the two bins there; `empty` where there is none."""
    first, last, zero = F.col(f"__first_{value}"), F.col(f"__last_{value}"), F.lit(0.0)
    return (
        F.when(first.isNull(), F.lit(empty))
        .when(F.col("bin") < first["bin"], first["y"] - F.coalesce(first["slope"], zero) * (first["bin"] - F.col("bin")))
        .when(F.col("bin") > last["bin"], last["y"] + F.coalesce(last["slope"], zero) * (F.col("bin") - last["bin"]))
        .otherwise(F.col(value))
    )


def _run(value: str) -> tuple[Column, Column, Column, Column]:
    """Of an empty bin: the values on either side of its run, the run's length, and the bin's place in it from 1."""
    a, b = F.col(f"__a_{value}"), F.col(f"__b_{value}")
    return a["y"], b["y"], b["bin"] - a["bin"] - 1, F.col("bin") - a["bin"]


def fill_short(value: str, rules: Rules) -> Column:
    """Runs of empty bins of short_days at most, by a straight line."""
    y0, y1, n, k = _run(value)
    short = F.col(value).isNull() & (n * rules.step <= rules.short_days)
    return F.when(short, y0 + (y1 - y0) * k / (n + 1)).otherwise(F.col(value))


def fill_long(grid: DataFrame, values: tuple[str, ...], rules: Rules, reference: str) -> DataFrame:
    """The other runs of the values: a hat where the reference falls after the run, as it does past a peak that nobody saw; a
    line from one side to the other elsewhere. Runs that are left after fill_short() have the sides they had before it."""
    ahead = F.array_compact(F.array(F.col(reference), *[F.lag(reference, j).over(_falling()) for j in range(1, rules.look_after)]))
    near = F.col("__near")
    falls = (F.size(near) >= 3) & ((F.element_at(near, -1) + F.element_at(near, -2)) / 2 < (F.get(near, 0) + F.get(near, 1)) / 2 - rules.decline)
    marked = grid.withColumn("__near", ahead).withColumn("__falls", falls).drop("__near")
    after = _falling().rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({f"__hat_{v}": F.last(F.when(F.col(v).isNotNull(), F.col("__falls")), ignorenulls=True).over(after) for v in values})

    def filled(value: str) -> Column:
        y0, y1, n, k = _run(value)
        x = k / (n + 1)
        base = F.greatest(y0, y1, F.lit(0.18))
        top = F.least(F.lit(0.82), base + F.least(F.lit(0.22), 0.35 * F.greatest(F.lit(0.0), 0.55 - F.least(y0, y1))))
        slow = y1 < y0 + 0.08
        turn, rest = F.when(slow, 0.50).otherwise(0.58), F.when(slow, 0.50).otherwise(0.42)  # 1 - 0.58 is not 0.42 to the last bit
        hat = F.when(x <= turn, y0 + (top - y0) * (x / turn)).otherwise(top + (y1 - top) * ((x - turn) / rest))
        line = F.when(n == 1, y0).otherwise(y0 + (y1 - y0) * (k - 1) / (n - 1))
        shaped = F.least(F.lit(1.0), F.greatest(F.lit(-0.1), F.when(F.col(f"__hat_{value}"), hat).otherwise(line)))
        return F.when(F.col(value).isNull() & (n * rules.step >= rules.long_days), shaped).otherwise(F.col(value))

    return marked.withColumns({v: filled(v) for v in values}).drop("__falls", *[f"__hat_{v}" for v in values])


def smoothed(value: str) -> Column:
    """The triangular mean of five bins, fewer at the ends. The middle comes first in the sum, then its neighbours, before
    and after in turn: thresholds meet exact ties, where another order's last bit would decide otherwise."""
    v, zero = F.col(value), F.lit(0.0)
    before, after = (lambda j: F.coalesce(F.lead(value, j).over(_falling()), zero)), (lambda j: F.coalesce(F.lag(value, j).over(_falling()), zero))
    beside = lambda test: test.cast("int")
    first, last = F.col("bin"), F.col("last") - F.col("bin")
    weights = 3 + 2 * beside(first > 0) + 2 * beside(last > 0) + beside(first > 1) + beside(last > 1)
    return (3 * v + 2 * before(1) + 2 * after(1) + before(2) + after(2)) / weights


def regular(looks: DataFrame, rules: Rules = Rules(), own: DataFrame | None = None, n_tasks: int | None = None) -> DataFrame:
    """A row a parcel and bin: ndvi, evi, ndmi without a gap, seen (a look with NDVI fell in the bin), the composite v and
    the smoothed w of ndvi. Where under 30 % of looks have an EVI it is taken from NDVI. own and n_tasks are worked out
    unless given."""
    own = parcels(looks, rules) if own is None else own
    grid = snapped(looks, own, rules, n_tasks or tasks(own)).withColumn("seen", F.col("ndvi").isNotNull())
    grid = with_sides(grid).withColumns({v: with_edges(v, empty) for v, empty in (("ndvi", 0.22), ("ndmi", 0.0), ("evi", 0.22))})
    grid = grid.withColumns({v: fill_short(v, rules) for v in VALUES})
    grid = fill_long(fill_long(grid, ("ndvi",), rules, "ndvi"), ("ndmi", "evi"), rules, "ndvi")
    clipped = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    grid = grid.withColumns({"ndvi": clipped(F.col("ndvi"), -0.1, 1.0), "ndmi": clipped(F.col("ndmi"), -0.6, 0.8)})
    evi = F.when(F.col("n_evi") < 0.30 * F.col("n_looks"), 0.85 * F.col("ndvi") + 0.02).otherwise(F.col("evi"))
    grid = grid.withColumn("evi", clipped(evi, 0.0, 1.0))
    grid = grid.withColumn("cvi", clipped(0.5 * F.col("ndvi") + 0.3 * F.col("evi") + 0.2 * F.col("ndmi"), 0.0, 1.0))
    kept = grid.withColumns({"v": smoothed("cvi"), "w": smoothed("ndvi")})
    return kept.select("parcel_id", "bin", "off", "start", "span", "last", "seen", "ndvi", "evi", "ndmi", "v", "w")


# ---------------------------------------------------------------- passes


@dataclass(frozen=True)
class Pass:
    """One way to read a series: `value` names the signal, and cycles end in troughs where `anchored`."""

    name: str
    value: str
    peak: float
    rise: float
    prominence: float
    window: int
    reach: int
    separation: int
    max_days: int
    anchored: bool = False


def passes(rules: Rules = Rules()) -> list[Pass]:
    """The base pass, the two with lower thresholds, and the one on NDVI."""
    window = max(3, rules.peak_window // rules.step)
    reach = max(window, rules.most_bins // 2)
    apart = max(rules.least_bins, 2, rules.separation)
    annual = lambda name, peak, rise: Pass(name, "v", peak, rise, rules.prominence, window, reach, apart, rules.max_days)
    return [
        annual("base", rules.peak, rules.rise),
        annual("adaptive", max(rules.relaxed_peak, rules.peak - 0.05), max(rules.relaxed_rise, rules.rise - 0.02)),
        annual("density", max(rules.density_peak, rules.peak * rules.density_scale), max(rules.relaxed_rise, rules.rise - 0.035)),
        Pass(
            "ndvi", "w", rules.ndvi_peak, rules.ndvi_rise, rules.ndvi_prominence, max(2, rules.peak_window // rules.step), rules.half_bins,
            max(rules.least_bins, rules.ndvi_separation // rules.step), max(rules.max_days, rules.ndvi_max_days), anchored=True,
        ),
    ]


def as_arrays(grid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a parcel: its bins' values as arrays, and the candidate peaks of each pass."""
    held = F.struct("bin", "off", "seen", "ndvi", "evi", "ndmi", "v", "w")
    own = grid.groupBy("parcel_id").agg(F.sort_array(F.collect_list(held)).alias("bins"), F.first("start").alias("start"), F.first("span").alias("span"))
    columns = {c: F.col(f"bins.{c}") for c in ("off", "seen", "ndvi", "evi", "ndmi", "v", "w")}
    peaks = {f"peaks_{p.name}": _peaks(columns[p.value], p, rules) for p in passes(rules)}
    return own.select("parcel_id", "start", "span", *[c.alias(n) for n, c in (columns | peaks).items()])


# ---------------------------------------------------------------- folds over a parcel's peaks


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _part(a: Column, lo: Column, hi: Column) -> Column:
    return F.slice(a, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def _mean(a: Column, lo: Column, hi: Column) -> Column:
    part = _part(a, lo, hi)
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)


def _first(lo: Column, hi: Column, test: Callable[[Column], Column], last: bool = False) -> Column:
    """The first (or last) place from lo to hi that passes; null for none."""
    return F.when(hi >= lo, (F.array_max if last else F.array_min)(F.filter(F.sequence(lo, hi), test)))


def _lowest(a: Column, lo: Column, hi: Column) -> Column:
    """The first place of the least value from lo to hi; null for an empty stretch."""
    return F.when(hi >= lo, lo + F.array_position(_part(a, lo, hi), F.array_min(_part(a, lo, hi))).cast("int") - 1)


def _peaks(series: Column, p: Pass, rules: Rules) -> Column:
    """The bins that are a local maximum over the floor and stand clear of the ground on one side at least. The floor is asked
    first, so only what lies over it is held against the bins beside it; a sliding frame would read them for every bin."""

    def over(a: Column) -> Column:
        lo, hi = F.lit(p.window), F.size(a) - 1 - p.window

        def is_peak(j: Column) -> Column:
            v, top = F.get(a, j), F.array_max(_part(a, j - p.window, j + p.window))
            ground = F.least(F.array_min(_part(a, F.greatest(F.lit(0), j - p.reach), j)), F.array_min(_part(a, j, j + p.reach)))
            return (v >= p.peak) & (v >= top - rules.tolerance) & (v - ground >= p.prominence)

        return F.when(hi >= lo, F.filter(F.sequence(lo, hi), is_peak)).otherwise(F.array().cast("array<int>"))

    return let(series, over)


def apart(peaks: Column, signal: Column, separation: int) -> Column:
    """Of peaks closer than the separation the higher, from left to right."""

    def step(kept: Column, p: Column) -> Column:
        close = p - F.element_at(kept, -1) < separation
        higher = F.get(signal, p) > F.get(signal, F.element_at(kept, -1))
        changed = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))
        return F.when(F.size(kept) == 0, F.array(p)).when(close & higher, changed).when(close, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(peaks, F.array().cast("array<int>"), step)


def split_by_valleys(peaks: Column, signal: Column, drop: float) -> Column:
    """One peak a plateau: neighbours with no valley of that depth between them are one, the higher."""

    def step(kept: Column, p: Column) -> Column:
        before = F.element_at(kept, -1)
        valley = F.array_min(_part(signal, before, p))
        flat = F.least(F.get(signal, before), F.get(signal, p)) - valley < drop
        changed = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))
        return F.when(F.size(kept) == 0, F.array(p)).when(flat & (F.get(signal, p) > F.get(signal, before)), changed).when(flat, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(peaks, F.array().cast("array<int>"), step)


def walked_back(signal: Column, peak: Column, off: Column, start: Column, hint: Column | None, rules: Rules) -> Column:
    """Where sowing lies before a peak: the last bin under the ground's level, or the lowest bin of the stretch if it never
    comes down. A hint draws it to the low bin nearest to the hinted day, if one is near enough."""
    lo, hi = F.greatest(F.lit(0), peak - rules.most_bins), peak - rules.least_bins
    low = lambda j: F.get(signal, j) < rules.low
    plain = F.coalesce(_first(lo, hi, low, last=True), _lowest(signal, lo, hi), lo)
    if hint is None:
        return plain
    since = F.datediff(hint, start)  # the hinted day in days from the first look
    nearby = (F.get(off, peak) - since).between(0, rules.max_days + rules.hint_days)
    away = lambda j: F.abs(F.get(off, j) - since)
    able = F.filter(F.sequence(lo, hi), lambda j: low(j) & (away(j) <= rules.hint_days))
    best = F.array_min(F.transform(able, lambda j: F.struct(away(j).alias("away"), (-j).alias("back"))))
    return F.when(nearby & (hi >= lo), F.coalesce(-best["back"], plain)).otherwise(plain)


def troughs(signal: Column, peak: Column, lo: Column, hi: Column, rules: Rules) -> Column:
    """struct(sow, harvest): the valleys nearest to the peak that are within the slack of the lowest on their side."""
    n, least = F.size(signal), rules.least_bins
    left0 = F.greatest(lo, peak - rules.half_bins, F.lit(0))
    left1 = F.greatest(left0, peak - least)
    right0, right1 = F.least(n - 1, peak + least), F.least(hi, peak + rules.half_bins, n - 1)
    near = lambda a, b: lambda j: F.get(signal, j) <= F.array_min(_part(signal, a, b)) + rules.slack
    sow = F.coalesce(_first(left0, left1, near(left0, left1), last=True), left0)
    harvest = F.coalesce(_first(right0, right1, near(right0, right1)), right1)
    return let(
        F.struct(sow.alias("sow"), harvest.alias("harvest")),
        lambda s: F.struct(
            F.when(s["sow"] >= peak, F.greatest(F.lit(0), peak - least)).otherwise(s["sow"]).cast("int").alias("sow"),
            F.when(s["harvest"] <= peak, F.least(n - 1, peak + least)).otherwise(s["harvest"]).cast("int").alias("harvest"),
        ),
    )


def found(p: Pass, rules: Rules = Rules(), hint: Column | None = None) -> Column:
    """The cycles of a pass, of as_arrays() rows: array of struct(sow, peak, harvest), bins. A peak claims the bins up to
    its harvest; later peaks in there are passed over."""
    v, w, off = F.col("v"), F.col("w"), F.col("off")
    signal = F.col(p.value)
    n = F.size("v")
    peaks = split_by_valleys(apart(F.col(f"peaks_{p.name}"), signal, p.separation), signal, p.prominence)
    days = lambda s: F.get(off, s["harvest"]) - F.get(off, s["sow"])
    lasts = lambda s: days(s).between(rules.min_days, p.max_days)
    above = lambda a, s, peak: F.get(a, peak) - _mean(a, F.greatest(F.lit(0), s["sow"] - 2), F.least(n - 1, s["sow"] + 1))

    def annual(peak: Column, before_next: Column, used: Column) -> Column:
        sow = walked_back(v, peak, off, F.col("start"), hint, rules)
        sow = F.when(used >= 0, F.greatest(sow, used + 1)).otherwise(sow)
        lo = peak + rules.least_bins
        hi = F.least(n - 1, peak + max(rules.least_bins + 1, rules.after_peak // rules.step + 1), before_next)
        harvest = F.coalesce(
            _first(lo, hi, lambda j: F.get(v, j) < rules.low), _first(lo, hi, lambda j: F.get(w, j) < rules.harvest_ndvi), _lowest(v, lo, hi), hi
        )
        return let(
            F.struct(sow.cast("int").alias("sow"), harvest.cast("int").alias("harvest")),
            lambda s: F.when(lasts(s), s).otherwise(troughs(w, peak, used + 1, before_next, rules)),
        )

    def step(state: Column, q: Column) -> Column:
        peak, used = q["peak"], state["used"]
        before_next = F.coalesce(q["next"] - 1, n - 1)
        window = troughs(w, peak, used + 1, before_next, rules) if p.anchored else annual(peak, before_next, used)

        def judged(s: Column) -> Column:
            rises = above(w, s, peak) >= p.rise
            if not p.anchored:
                rises = rises | (above(v, s, peak) >= p.rise)
            cycle = F.struct(s["sow"].alias("sow"), peak.alias("peak"), s["harvest"].alias("harvest"))
            taken = F.struct(s["harvest"].alias("used"), F.concat(state["found"], F.array(cycle.cast(CYCLE))).alias("found"))
            return F.when(lasts(s) & rises, taken).otherwise(state)

        return F.when(peak <= used, state).otherwise(let(window, judged))

    nothing = F.struct(F.lit(-1).alias("used"), F.array().cast(f"array<{CYCLE}>").alias("found"))
    with_next = lambda ps: F.transform(ps, lambda x, k: F.struct(x.alias("peak"), F.get(ps, k + 1).alias("next")))
    return F.when(n >= 12 if p.anchored else F.lit(True), let(peaks, lambda ps: F.aggregate(with_next(ps), nothing, step)["found"]))


def _quantile(a: Column, share: float) -> Column:
    """By a straight line between neighbours in order."""
    at = F.lit(share) * (F.size(a) - 1)
    low = F.floor(at).cast("int")
    return let(F.sort_array(a), lambda s: F.get(s, low) + (at - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low)))


def perennial(rules: Rules = Rules()) -> Column:
    """A cycle a year of a parcel that is green throughout, hardly ever bare and swings little; else none. A last piece
    under half a year is left out."""
    v, n, year = F.col("v"), F.size("v"), rules.year_bins
    bare = F.size(F.filter(v, lambda x: x < rules.low)) / n
    low, high = _quantile(v, 0.1), _quantile(v, 0.9)
    stays = (n >= rules.perennial_bins) & (low >= rules.perennial_level) & (bare <= rules.perennial_bare) & (high - low <= rules.perennial_swing)
    end = lambda k: F.least(n - 1, k * year + year - 1)
    starts = F.filter(F.sequence(F.lit(0), F.floor((n - 2) / year).cast("int")), lambda k: (k == 0) | ((end(k) - k * year + 1) * 2 >= year))
    top = lambda a, b: a + F.array_position(_part(v, a, b), F.array_max(_part(v, a, b))).cast("int") - 1
    years = F.transform(starts, lambda k: F.struct((k * year).alias("sow"), top(k * year, end(k)).alias("peak"), end(k).alias("harvest")).cast(CYCLE))
    return F.when(stays, years).otherwise(F.array().cast(f"array<{CYCLE}>"))


def detected(arrays: DataFrame, rules: Rules = Rules(), hint: Column | None = None) -> DataFrame:
    """arrays with `pass` and `cycles`: the base pass; with too few a year the adaptive, then the density pass, each only
    if it finds more; then the NDVI pass if it finds more; and, where there is still none, a perennial's years."""
    years = F.greatest(F.lit(0.25), F.col("span") / 365.25)
    base, adaptive, density, ndvi = passes(rules)
    none = F.array().cast(f"array<{CYCLE}>")
    own = arrays.withColumns({"cycles": found(base, rules, hint), "pass": F.lit("base")})
    wanted = F.greatest(F.lit(1), F.ceil(years * rules.adaptive_share))
    expected = F.greatest(F.lit(1), F.ceil(years * rules.expected_a_year))
    for p, short in ((adaptive, F.size("cycles") < wanted), (density, F.size("cycles") < expected), (ndvi, F.lit(True))):
        own = own.withColumn("__more", F.when(short, F.coalesce(found(p, rules, hint), none)).otherwise(none))
        more = F.size("__more") > F.size("cycles")
        own = own.withColumns({"pass": F.when(more, p.name).otherwise(F.col("pass")), "cycles": F.when(more, F.col("__more")).otherwise(F.col("cycles"))}).drop("__more")
    lasting = own.withColumn("__years", F.when(F.size("cycles") == 0, perennial(rules)).otherwise(none))
    stays = F.size("__years") > 0
    return lasting.withColumns({"pass": F.when(stays, "perennial").otherwise(F.col("pass")), "cycles": F.when(stays, F.col("__years")).otherwise(F.col("cycles"))}).drop("__years")


# ---------------------------------------------------------------- what a cycle is


def gaps(looks: DataFrame, rules: Rules = Rules(), n_tasks: int | None = None) -> DataFrame:
    """parcel_id and gaps: the stretches of gap_days or more between neighbouring looks, and those between neighbouring
    looks that have an NDVI; array of struct(from, to, days). With n_tasks parcels are shared by so many tasks."""
    days = looks.select("parcel_id", "day", "ndvi")
    days = (days.repartition(n_tasks, "parcel_id") if n_tasks else days).groupBy("parcel_id", "day").agg(F.count("ndvi").alias("n"))
    by = Window.partitionBy("parcel_id").orderBy("day")
    every = lambda df: df.withColumn("before", F.lag("day").over(by)).where(F.datediff("day", "before") >= rules.gap_days)
    both = every(days).unionByName(every(days.where("n > 0")))
    return both.groupBy("parcel_id").agg(F.collect_list(F.struct(F.col("before").alias("from"), F.col("day").alias("to"), F.datediff("day", "before").alias("days"))).alias("gaps"))


def _spread(a: Column) -> Column:
    """Standard deviation over all."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return let(mean, lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def described(detected_: DataFrame, parcel_gaps: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a cycle: number, pass, kind, dates, levels, what of it was seen, confidence and a provisional type."""
    each = detected_.join(parcel_gaps, "parcel_id", "left").select("*", F.posexplode("cycles").alias("number", "c"))
    sow, peak, harvest = F.col("c.sow"), F.col("c.peak"), F.col("c.harvest")
    stays = F.col("pass") == "perennial"
    day = lambda j: F.date_add("start", F.get("off", j))
    each = each.withColumns({"sown": day(sow), "peaked": day(peak), "harvested": day(harvest), "days": F.get("off", harvest) - F.get("off", sow), "own_ndvi": _part(F.col("ndvi"), sow, harvest), "own_v": _part(F.col("v"), sow, harvest)})
    reach = F.filter(F.coalesce("gaps", F.array().cast("array<struct<from:date,to:date,days:int>>")), lambda g: (g["from"] <= F.col("harvested")) & (g["to"] >= F.col("sown")))
    gap_days = F.when(stays, F.lit(0)).otherwise(F.aggregate(reach, F.lit(0), lambda s, g: s + g["days"]))
    trapezia = F.transform(F.sequence(sow, harvest - 1), lambda j: (F.get("ndvi", j) + F.get("ndvi", j + 1)) / 2 * (F.get("off", j + 1) - F.get("off", j)))
    near = lambda c: F.when(stays, _mean(F.col(c), sow, harvest)).otherwise(_mean(F.col(c), F.greatest(F.lit(0), peak - 1), F.least(F.size(c) - 1, peak + 1)))
    each = each.withColumns(
        {
            "peak_ndvi": F.when(stays, F.array_max("own_ndvi")).otherwise(F.get("w", peak)),
            "peak_cvi": F.get("v", peak),
            "base_ndvi": F.when(stays, _quantile(F.col("own_ndvi"), 0.1)).otherwise(_mean(F.col("w"), F.greatest(F.lit(0), sow - 3), sow)),
            "foot_ndvi": F.when(stays, _quantile(F.col("own_ndvi"), 0.1)).otherwise(_mean(F.col("w"), F.greatest(F.lit(0), sow - 2), F.least(F.size("w") - 1, sow + 1))),
            "ndvi_days": F.aggregate(trapezia, F.lit(0.0), lambda s, x: s + x),
            "peak_evi": near("evi"),
            "peak_ndmi": near("ndmi"),
            "gap_days": gap_days,
            "seen_share": F.size(F.filter(_part(F.col("seen"), sow, harvest), lambda x: x)) / (harvest - sow + 1),
            "peak_seen": F.get("seen", peak),
            "spread": _spread(F.col("own_ndvi")),
        }
    )
    d, v = F.col("days"), F.col("peak_cvi")
    points = F.least(F.lit(25.0), F.col("spread") * 150)
    points += F.when(d.between(60, rules.max_days), 25.0).when(d < 60, F.greatest(F.lit(0.0), 25.0 * (d - 40) / 20)).otherwise(F.greatest(F.lit(10.0), 25.0 * (1 - (d - rules.max_days) / 120)))
    points += F.least(F.lit(25.0), v * 40) + F.least(F.lit(25.0), v * 25 + F.col("spread") * 50)
    annual = points - rules.gap_penalty * (F.col("gap_days") / 7)
    mean_v = F.aggregate("own_v", F.lit(0.0), lambda s, x: s + x) / F.size("own_v")
    held = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    steady = F.when(mean_v > 0, held(1 - 3 * _spread(F.col("own_v")) / mean_v)).otherwise(0.0)
    lasting = held(mean_v / 0.75) * 55 + steady * 30 + F.col("seen_share") * 15
    vigour = F.when(d < 90, F.when(F.col("peak_ndvi") > 0.55, "SHORT_HIGH_VIGOR").otherwise("SHORT_MODERATE")).when(
        d < 180, F.when(v > 0.60, "MEDIUM_HIGH_VIGOR").when(v > 0.45, "MEDIUM_MODERATE").otherwise("MEDIUM_LOW_VIGOR")
    )
    return each.select(
        "parcel_id", (F.col("number") + 1).alias("number"), "pass", F.when(stays, "perennial").otherwise("annual").alias("kind"), "sown", "peaked", "harvested", "days",
        "peak_ndvi", "base_ndvi", (F.col("peak_ndvi") - F.col("foot_ndvi")).alias("ndvi_rise"), "ndvi_days", "peak_evi", "peak_ndmi", "peak_cvi", "gap_days", "peak_seen", "seen_share",
        F.least(F.lit(100.0), F.greatest(F.lit(10.0), F.when(stays, lasting).otherwise(annual))).alias("confidence"),
        F.when(stays, "PERENNIAL").otherwise(F.coalesce(vigour, F.lit("LONG_DURATION"))).alias("crop_type"), "c", "v", "off", "start",
    )


# ---------------------------------------------------------------- seasons


#: Windows of a year as (season, from, to): month, day, and years past the first.
SEASONS = [("kharif", (6, 1, 0), (10, 15, 0)), ("rabi", (10, 15, 0), (3, 15, 1)), ("zaid", (3, 15, 0), (6, 1, 0))]
SOUTH, SOUTH_SHIFT, CLEAR_SHARE = 16.0, 30, 0.55


def season(sown: Column, harvested: Column, latitude: Column | None = None) -> tuple[Column, Column]:
    """(season, label) by where the cycle spent most of its days; cross_season if in none clearly. South of 16 degrees the
    windows come 30 days later."""
    harvested = F.greatest(sown, harvested)
    shift = F.lit(0) if latitude is None else F.when(latitude < SOUTH, SOUTH_SHIFT).otherwise(0)
    day = lambda md, back: F.date_add(F.make_date(F.year(sown) + back + md[2], F.lit(md[0]), F.lit(md[1])), shift)
    shared = lambda a, b: F.greatest(F.lit(0), F.datediff(F.least(harvested, b), F.greatest(sown, a)))
    days = [sum((shared(day(a, k), day(b, k)) for k in (0, 1)), shared(day(a, -1), day(b, -1))) for _, a, b in SEASONS]
    total = F.greatest(F.datediff(harvested, sown), F.lit(1))
    most = F.greatest(*days)
    best = F.when(most <= 0, "kharif").when(days[0] == most, "kharif").when(days[1] == most, "rabi").otherwise("zaid")
    clear = F.when(most <= 0, F.lit(True)).otherwise(most / total >= CLEAR_SHARE)
    kind = F.when(clear, best).otherwise("cross_season")
    first = F.when(F.month(sown) >= 10, F.year(sown)).otherwise(F.year(sown) - 1)
    label = (
        F.when(best == "rabi", F.concat(F.lit("Rabi "), first, F.lit("/"), first + 1))
        .when(kind == "zaid", F.concat(F.lit("Zaid "), F.year(sown)))
        .when(kind == "cross_season", F.concat(F.lit("Cross-season "), F.year(sown)))
        .otherwise(F.concat(F.lit("Kharif "), F.year(sown)))
    )
    return kind, label


def cycles(looks: DataFrame, rules: Rules = Rules(), hint: Column | None = None) -> DataFrame:
    """All cycles of all parcels, described and with their seasons. looks: parcel_id, day, ndvi, evi, ndmi.

    The arrays and the cycles found are written between, a row a parcel each: both are read several times.
    """
    own = parcels(looks, rules)
    n_tasks = tasks(own)
    arrays = written(as_arrays(regular(looks, rules, own, n_tasks), rules))
    rows = described(written(detected(arrays, rules, hint)), gaps(looks, rules, n_tasks).hint("shuffle_hash"), rules)
    kind, label = season(F.col("sown"), F.col("harvested"))
    stays = F.col("kind") == "perennial"
    named = {"season": F.when(stays, "perennial").otherwise(kind), "season_label": F.when(stays, F.concat(F.lit("Production year "), F.year("sown"))).otherwise(label)}
    return rows.withColumns(named)
