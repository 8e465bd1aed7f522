"""Metric series: (series, iteration, values) with count-based frames along the iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ranking import bucketed_row_number, falling


def along():
    return Window.partitionBy("series").orderBy("iteration")


def last_rows(n: int):
    return along().rowsBetween(-(n - 1), 0)


def deltas(rows: DataFrame, *names: str) -> DataFrame:
    """TS-1. ``d_<name>``: the change since the row before, 0 for the first."""
    return rows.select("*", *[F.coalesce(F.col(c) - F.lag(c).over(along()), F.lit(0.0)).alias(f"d_{c}") for c in names])


def with_cdp(rows: DataFrame) -> DataFrame:
    """TS-2. Structural less semantic entropy."""
    return rows.withColumn("cdp", F.col("vne") - F.col("ee"))


def pearson(x: Column, y: Column, frame) -> Column:
    """0 where a side does not vary; never an error."""
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return F.when(spread < 1e-12, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y).over(frame), spread), F.lit(0.0)))


def rolling_correlation(rows: DataFrame, n: int = 10) -> DataFrame:
    """TS-3. ``correlation`` of the last n changes of vne and ee; 0 until there are n rows."""
    frame = last_rows(n)
    changed = deltas(rows, "vne", "ee")
    full = F.count(F.lit(1)).over(frame) >= n
    return changed.withColumn("correlation", F.when(full, pearson(F.col("d_vne"), F.col("d_ee"), frame)).otherwise(0.0))


def phase_transition(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """TS-4. True where the sign differs from the last correlation that is not 0, both beyond ``least``."""
    before = F.last(F.when(F.col("correlation") != 0, F.col("correlation")), True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    flip = (F.signum(before) * F.signum("correlation") < 0) & (F.abs(before) > least) & (F.abs("correlation") > least)
    return rows.withColumn("is_transition", F.coalesce(flip, F.lit(False)))


def slope(value: str, frame) -> Column:
    """TS-5. Least-squares slope along the rows of a frame (column ``_n`` numbers them); 0 below two."""
    x, y, n = F.col("_n"), F.col(value), F.count(F.lit(1)).over(frame)
    sx, sy, sxy, sxx = (F.sum(c).over(frame) for c in (x, y, x * y, x * x))
    return F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_n", (F.row_number().over(along()) - 1).cast("double"))


def linear_slope(rows: DataFrame, value: str) -> DataFrame:
    """TS-5. One slope a series."""
    x, y, n = F.col("_n"), F.col(value), F.count(F.lit(1))
    fit = F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x))
    return numbered(rows).groupBy("series").agg(F.coalesce(fit, F.lit(0.0)).alias("slope"))


def metrics_trend(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """TS-6. Mean and slope over the last n rows."""
    return numbered(rows).select("*", F.avg(value).over(last_rows(n)).alias("mean"), slope(value, last_rows(n)).alias("slope")).drop("_n")


def early_convergence(rows: DataFrame, n: int = 5, most_variance: float = 0.01, least_slope: float = 0.05) -> DataFrame:
    """TS-7. The last n rows have a settled ee and a rising vne."""
    frame = last_rows(n)
    flag = (F.count(F.lit(1)).over(frame) >= n) & (F.var_samp("ee").over(frame) < most_variance) & (slope("vne", frame) > least_slope)
    return numbered(rows).withColumn("converging", F.coalesce(flag, F.lit(False))).drop("_n")


def confirmed_transition(rows: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """TS-8. (series, iteration, ``confirmed``): true once for each sign flip that holds: on the
    first row at least ``least`` rows later where ``share`` of the last three signs are as after the
    flip and h is 2 or more, before the next flip.

    In closed form: the flips number the stretches of a series, and the first row of a stretch that
    meets the rule is the one.
    """
    sign = F.signum("correlation").cast("int")
    before = F.last(F.when(sign != 0, sign), True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(along())
    marked = rows.select("series", "iteration", "h", sign.alias("sign"), n.alias("n"), F.coalesce((sign != 0) & (sign != before), F.lit(False)).alias("flip"))
    held = marked.select(
        "series", "iteration", "h", "n", F.count_if("flip").over(back).alias("stretch"), F.collect_list("sign").over(last_rows(3)).alias("recent"),
        F.last(F.when(F.col("flip"), F.col("n")), True).over(back).alias("start"), F.last(F.when(F.col("flip"), F.col("sign")), True).over(back).alias("want"),
    )
    alike = F.size(F.filter("recent", lambda s: s == F.col("want"))) >= F.lit(share) * F.size("recent")
    meets = F.coalesce((F.col("n") - F.col("start") >= least) & (F.col("h") >= 2) & alike, F.lit(False))
    first = F.min(F.when(F.col("meets"), F.col("n"))).over(Window.partitionBy("series", "stretch"))
    return held.withColumn("meets", meets).select("series", "iteration", F.coalesce(F.col("n") == first, F.lit(False)).alias("confirmed"))


def regime_features(rows: DataFrame, n: int = 10) -> DataFrame:
    """TS-10. Variance of cdp and deviation of the correlation over n rows, growth, and status."""
    frame = last_rows(n)
    full = F.count(F.lit(1)).over(frame) >= n
    return rows.select(
        "*", F.when(full, F.var_samp("cdp").over(frame)).alias("cdp_variance"), F.when(full, F.stddev_samp("correlation").over(frame)).alias("correlation_std"),
        F.sum("growth").over(frame).alias("recent_growth"), F.when(full, "measured").otherwise("insufficient-history").alias("status"),
    )


def regime(rows: DataFrame, persistence: int = 5) -> DataFrame:
    """TS-9. (series, iteration, ``regime``): nascent, stable, critical or transitioning from the
    features of TS-10: critical above 0.5 / 0.8, stable below 0.2 / 0.3 with growth, else
    transitioning, after ``persistence`` rows of the same class; until then the regime before.

    In closed form: runs of equal classes are numbered, and the regime is the last class that has
    stood ``persistence`` rows in its run.
    """
    v, s, g = F.col("cdp_variance"), F.col("correlation_std"), F.col("recent_growth")
    kind = F.when((v > 0.5) & (s > 0.8), "critical").when((v < 0.2) & (s < 0.3) & (g > 0), "stable").otherwise("transitioning")
    measured = F.col("status") == "measured"
    marked = regime_features(rows).select("series", "iteration", F.when(measured, kind).alias("kind"))
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(along())), 0).otherwise(1)
    runs = marked.withColumn("change", change).withColumn("run", F.sum("change").over(back))
    stood = F.row_number().over(Window.partitionBy("series", "run").orderBy("iteration"))
    settled = runs.withColumn("settled", F.when(stood >= persistence, F.col("kind")))
    return settled.select("series", "iteration", F.coalesce(F.last("settled", True).over(back), F.lit("nascent")).alias("regime"))


def hysteresis_state(rows: DataFrame, value: str, low: float = 2, high: float = 5) -> DataFrame:
    """TS-12. NORMAL, OBSTRUCTED from ``low``, CRITICAL from ``high``; CRITICAL ends only below ``low``.

    In closed form: critical where a value of ``high`` or more has come since the last below ``low``.
    """
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    last_low = F.last(F.when(F.col(value) < low, F.col("iteration")), True).over(back)
    last_high = F.last(F.when(F.col(value) >= high, F.col("iteration")), True).over(back)
    critical = last_high.isNotNull() & (last_low.isNull() | (last_high > last_low))
    return rows.withColumn("state", F.when(F.col(value) < low, "NORMAL").when(critical, "CRITICAL").otherwise("OBSTRUCTED"))


def centrality_trend(rows: DataFrame, eps: float = 0.05) -> DataFrame:
    """TS-13. oscillating, stable, rising or falling from the last three scores."""
    one, two = F.lag("score", 1).over(along()), F.lag("score", 2).over(along())
    d1, d2, m = one - two, F.col("score") - one, (F.col("score") - two) / 2
    trend = F.when(two.isNull(), "stable").when((F.abs(d1) > eps) & (F.abs(d2) > eps) & (d1 * d2 < 0), "oscillating").when(F.abs(m) < eps, "stable").when(m > 0, "rising").otherwise("falling")
    return rows.withColumn("trend", trend)


def rapid_change(rows: DataFrame, times: float = 3) -> DataFrame:
    """TS-14. Scores of ``times`` a positive score before."""
    return rows.withColumn("before", F.lag("score").over(along())).where((F.col("before") > 0) & (F.col("score") >= times * F.col("before")))


def topology_reorganized(rows: DataFrame, most: int = 3) -> DataFrame:
    """TS-15. Iterations in which more than ``most`` nodes moved by over half the ranks. The ranks of
    an iteration are dealt out by ranges of the score."""
    placed = bucketed_row_number(rows, ["iteration"], falling(rows, "score"), [F.desc("score"), "series"], "rank")
    ranked = placed.join(rows.groupBy("iteration").agg(F.count(F.lit(1)).alias("n")), "iteration")
    moved = ranked.withColumn("was", F.lag("rank").over(along())).where(F.abs(F.col("rank") - F.col("was")) > F.col("n") * 0.5)
    return moved.groupBy("iteration").agg(F.count(F.lit(1)).alias("moved")).where(F.col("moved") > most)


def peak_valley(rows: DataFrame, n: int = 50) -> DataFrame:
    """TS-16. The earliest peak and valley among the last n scores of a series."""
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("iteration")))
    return rows.withColumn("_b", back).where(F.col("_b") <= n).groupBy("series").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "iteration")).alias("p"), F.min(F.struct("score", "iteration")).alias("v")
    ).select("series", F.col("p.iteration").alias("peak_at"), (-F.col("p.s")).alias("peak"), F.col("v.iteration").alias("valley_at"), F.col("v.score").alias("valley"))


def rising_nodes(rows: DataFrame, least: float) -> DataFrame:
    """TS-17. Series whose last trend is rising and whose mean step is at least ``least``."""
    ends = centrality_trend(rows).groupBy("series").agg(F.min_by("score", "iteration").alias("first"), F.max_by("score", "iteration").alias("last"), F.max_by("trend", "iteration").alias("trend"), F.count(F.lit(1)).alias("n"))
    step = F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1)
    return ends.withColumn("step", step).where((F.col("trend") == "rising") & (F.col("step") >= least))


def surprising_edges(edges: DataFrame, nodes: DataFrame, proposal: list[str], least: float = 0.3) -> DataFrame:
    """TS-11. Per iteration: edges of proposal origin, those that cross communities between unlike
    vectors, and their share; null where an end has no community or vector. ``edges``: src, dst,
    iteration, origin; ``nodes``: node, community, vector."""
    from skein.operators.vectors import cosine

    a, b = nodes.toDF("src", "ca", "va"), nodes.toDF("dst", "cb", "vb")
    both = edges.where(F.col("origin").isin(proposal)).join(a, "src", "left").join(b, "dst", "left")
    odd = (F.col("ca") != F.col("cb")) & (cosine(F.col("va"), F.col("vb")) < least)
    total = both.groupBy("iteration").agg(F.count(F.lit(1)).alias("proposed"), F.count_if(odd).alias("surprising"), F.count_if(odd.isNull()).alias("unknown"))
    return total.withColumn("ratio", F.when(F.col("unknown") == 0, F.col("surprising") / F.col("proposed")))


def phase_timings(events: DataFrame, phase: str, value: str) -> DataFrame:
    """TS-18. Total of each phase, its rank, and the total of all in the row without a phase (rank 0)."""
    total = events.rollup(phase).agg(F.sum(value).alias("total"), F.grouping(phase).alias("g"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("total"), phase))
    return total.select(phase, "total", F.when(F.col("g") == 0, rank).otherwise(0).alias("rank"))
