"""Monthly series, gap filling and forecasts (ML3-ML6, U2).

A series is (keys..., month, value).  All forecasts are grouped DataFrame
plans - one row per series and month - so thousands of stores forecast in
parallel; nothing is collected to the driver.

* ``fill_months``       - calendar from each series' first to last month,
                          0 where a month has no data (union + aggregate,
                          no join);
* ``seasonal_naive``    - mean of the same calendar month, else the overall
                          mean; each series continues after its own last
                          month;
* ``holt_winters``      - additive trend and season (period 12).  The
                          recursion runs as ``aggregate`` over the series
                          array; smoothing weights come from a fixed grid,
                          expanded as rows (series x grid), the lowest
                          one-step squared error wins (ties: smaller
                          alpha, beta, gamma), and then from ever smaller
                          grids around the best so far, inside the row;
* ``forecast``          - Holt-Winters for series of at least 18 months,
                          seasonal-naive otherwise.

Each series is gap-filled and gathered once into an ordered array
(``series_arrays``: one value per month, so bounded by the calendar, not by
the transactions); both methods and the length gate read those arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiller.functions.labels import (
    FORECAST_HORIZON,
    HOLT_WINTERS_MIN_MONTHS,
    METHOD_HOLT_WINTERS,
    METHOD_SEASONAL_NAIVE,
    SEASON_LENGTH,
)

# Smoothing-weight grid of the Holt-Winters fit (our own choice; the fit is
# a coarse-to-fine search, not a numeric optimiser).
ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.01, 0.05, 0.1, 0.2)
GAMMAS = (0.05, 0.1, 0.2, 0.4)
# Rounds of refinement: alpha moves by the first number, beta and gamma by the
# second as a part of themselves, each down, not at all or up.
REFINEMENTS = ((0.1, 0.5), (0.05, 0.25), (0.025, 0.125), (0.0125, 0.0625))


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def fill_months(series: DataFrame, keys: Sequence[str] = (), month: str = "month",
                value: str = "transactions") -> DataFrame:
    """ML3: (keys..., month, value) with every month between each series'
    first and last month; missing months get 0."""
    bounds = series.groupBy(*_keys(keys)).agg(F.min(month).alias("_lo"), F.max(month).alias("_hi"))
    cal = bounds.select(*_keys(keys), F.explode(F.sequence(
        F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 MONTH"))).alias(month),
        F.lit(0).cast("bigint").alias(value))
    obs = series.select(*_keys(keys), F.col(month), F.col(value).cast("bigint").alias(value))
    return (obs.unionByName(cal)
            .groupBy(*_keys(keys), F.col(month))
            .agg(F.sum(value).cast("bigint").alias(value)))


def _future_months(last: Column, horizon: int) -> Column:
    return F.sequence(F.add_months(last, 1), F.add_months(last, horizon),
                      F.expr("INTERVAL 1 MONTH"))


def series_arrays(series: DataFrame, keys: Sequence[str] = (), month: str = "month",
                  value: str = "transactions") -> DataFrame:
    """(keys..., _first, _last, _y): each gap-filled series as one ordered
    array of doubles.

    A series holds one value per month, so the array is bounded by the
    number of months, not by the number of transactions.
    """
    monthly = series.groupBy(*_keys(keys), F.col(month).alias("_m")).agg(
        F.sum(value).cast("double").alias("_v"))
    held = monthly.groupBy(*_keys(keys)).agg(
        F.min("_m").alias("_first"), F.max("_m").alias("_last"),
        F.map_from_entries(F.collect_list(F.struct("_m", "_v"))).alias("_known"))
    months = F.sequence(F.col("_first"), F.col("_last"), F.expr("INTERVAL 1 MONTH"))
    return held.select(*_keys(keys), "_first", "_last", F.transform(
        months, lambda m: F.coalesce(F.col("_known")[m], F.lit(0.0))).alias("_y"))


def _naive_from_arrays(arr: DataFrame, keys: Sequence[str], horizon: int,
                       month: str) -> DataFrame:
    pts = arr.select(*_keys(keys), "_first", "_last",
                     F.posexplode("_y").alias("_i", "_v"))
    by_moy = pts.groupBy(*_keys(keys), F.month(F.add_months("_first", "_i")).alias("_moy")).agg(
        F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"), F.max("_last").alias("_last"))
    per = by_moy.groupBy(*_keys(keys)).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "_moy", (F.col("_s") / F.col("_c").cast("double"))))).alias("_means"),
        (F.sum("_s") / F.sum("_c").cast("double")).alias("_mean"),
        F.max("_last").alias("_last"))
    fut = per.select(*_keys(keys), "_means", "_mean",
                     F.explode(_future_months(F.col("_last"), horizon)).alias(month))
    yhat = F.coalesce(F.col("_means")[F.month(month)], F.col("_mean"))
    return fut.select(*_keys(keys), month, yhat.alias("yhat"),
                      F.lit(METHOD_SEASONAL_NAIVE).alias("method"))


def seasonal_naive(series: DataFrame, keys: Sequence[str] = (), horizon: int = FORECAST_HORIZON,
                   month: str = "month", value: str = "transactions") -> DataFrame:
    """ML4: (keys..., month, yhat, method) - mean of the same calendar month
    over the gap-filled series, else the overall mean; each series continues
    after its own last month.  The per-month means of a series are a map of
    at most 12 entries."""
    return _naive_from_arrays(series_arrays(series, keys, month, value), keys, horizon, month)


def _mean_of(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x),
                        F.size(arr).cast("double"))


def _hw_state(y: Column, a: Column, b: Column, g: Column, m: int) -> Column:
    """Run the additive Holt-Winters recursion over ``y``.

    Initial state: level = mean of the first season, trend = (mean of the
    second season - mean of the first) / m, season[i] = y[i] - level.  Of an
    incomplete second season the months that are there are compared with the
    same months of the first; a series of at most one season has no trend.
    Step t (0-based): s = season[t mod m]; prediction = level + trend + s;
    level' = a (y - s) + (1 - a)(level + trend); trend' = b (level' -
    level) + (1 - b) trend; season[t mod m] = g (y - level') + (1 - g) s;
    sse += (y - prediction)^2.

    The seasonal state is kept as a rotating queue: its head is the
    seasonal of the current step; each step drops the head and appends the
    updated value (``slice`` + ``concat``), so after the last step the head
    belongs to the first forecast month.
    """
    first = F.slice(y, 1, m)
    second = F.slice(y, m + 1, m)
    l0 = _mean_of(first)
    same = F.slice(y, 1, F.least(F.lit(m), F.size(second)))
    t0 = F.coalesce((_mean_of(second) - _mean_of(same)) / F.lit(float(m)), F.lit(0.0))
    s0 = F.transform(first, lambda v: v - l0)
    init = F.struct(l0.alias("l"), t0.alias("t"), s0.alias("s"),
                    F.lit(0.0).alias("sse"), F.lit(0).alias("i"))
    one = F.lit(1.0)

    def step(st, v):
        s = F.element_at(st["s"], 1)
        pred = st["l"] + st["t"] + s
        err = v - pred
        lvl = a * (v - s) + (one - a) * (st["l"] + st["t"])
        trd = b * (lvl - st["l"]) + (one - b) * st["t"]
        sea = g * (v - lvl) + (one - g) * s
        return F.struct(lvl.alias("l"), trd.alias("t"),
                        F.concat(F.slice(st["s"], 2, m - 1), F.array(sea)).alias("s"),
                        (st["sse"] + err * err).alias("sse"), (st["i"] + 1).alias("i"))

    return F.aggregate(y, init, step)


def _refined(y: Column, coarse: Column, m: int) -> Column:
    """The best weights around ``coarse`` (sse, a, b, g), in grids that shrink.

    Each round tries the 27 neighbours of the best so far, itself included, so
    the error never rises; ties go to the smaller weights.  All rounds run inside
    the row: no shuffle, whatever their number.
    """
    moves = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j"),
                               F.lit(float(k)).alias("k"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    steps = F.array(*[F.struct(F.lit(by).alias("by"), F.lit(part).alias("part"))
                      for by, part in REFINEMENTS])
    one, none = F.lit(1.0), F.lit(0.0)

    def around(best, step):
        near = F.transform(moves, lambda move: F.struct(
            F.least(one, F.greatest(none, best["a"] + move["i"] * step["by"])).alias("a"),
            F.least(one, best["b"] * (one + move["j"] * step["part"])).alias("b"),
            F.least(one, best["g"] * (one + move["k"] * step["part"])).alias("g")))
        return F.array_min(F.transform(near, lambda w: F.struct(
            _hw_state(y, w["a"], w["b"], w["g"], m)["sse"].alias("sse"), w["a"].alias("a"),
            w["b"].alias("b"), w["g"].alias("g"))))

    return F.aggregate(steps, coarse, around)


def _coarse_best(cand: DataFrame, keys: Sequence[str], season: int) -> DataFrame:
    """(keys..., _best, _last, _y): each series' best row of the coarse grid, by error."""
    state = F.when(F.col("_w").isNotNull(), _hw_state(
        F.col("_y"), F.col("_w.a"), F.col("_w.b"), F.col("_w.g"), season)["sse"])
    # The series arrays are a few bytes per store, so adaptive execution packs
    # them into very few partitions; the recursion that follows is CPU work per
    # (series, weights) row, so the candidates are spread over the session's
    # shuffle partitions first (an explicit count is not coalesced).
    parts = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = cand.repartition(parts, *_keys(keys), F.col("_w"))
    best = cand.groupBy(*_keys(keys)).agg(F.min(F.struct(
        state.alias("sse"), F.col("_w.a").alias("a"), F.col("_w.b").alias("b"),
        F.col("_w.g").alias("g"), F.col("_last").alias("last"), F.col("_y").alias("y"))).alias("_b"))
    return best.where(F.col("_b.last").isNotNull()).select(
        *_keys(keys), F.struct("_b.sse", "_b.a", "_b.b", "_b.g").alias("_best"),
        F.col("_b.last").alias("_last"), F.col("_b.y").alias("_y"))


def _grid(alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"))
                     for a in alphas for b in betas for g in gammas])


def _fitted(best: DataFrame, keys: Sequence[str], season: int) -> DataFrame:
    """``_best`` refined, and ``_st``: the state after the series with these weights.

    Rows without weights (short series) keep none.
    """
    if keys:  # few bytes, much work: as many tasks as for the coarse grid
        best = best.repartition(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                                *_keys(keys))
    fit = F.when(F.col("_best.a").isNotNull(), _refined(F.col("_y"), F.col("_best"), season))
    best = best.select(*_keys(keys), "_last", "_y", fit.alias("_best"))
    state = F.when(F.col("_best").isNotNull(), _hw_state(
        F.col("_y"), F.col("_best.a"), F.col("_best.b"), F.col("_best.g"), season))
    return best.withColumn("_st", state)


def _continued(season: int) -> Column:
    """The forecast ``_h`` months after the last one: the queue's head is the first of them."""
    st = F.col("_st")
    return st["l"] + F.col("_h").cast("double") * st["t"] + F.element_at(
        st["s"], (F.col("_h") - 1) % F.lit(season) + 1)


def holt_winters(series: DataFrame, keys: Sequence[str] = (), horizon: int = FORECAST_HORIZON,
                 month: str = "month", value: str = "transactions",
                 season: int = SEASON_LENGTH, alphas: Sequence[float] = ALPHAS,
                 betas: Sequence[float] = BETAS, gammas: Sequence[float] = GAMMAS,
                 min_months: int = HOLT_WINTERS_MIN_MONTHS) -> DataFrame:
    """ML5: (keys..., month, yhat, method, alpha, beta, gamma, sse).

    Only series of at least ``min_months`` (after gap filling), and longer than
    a season, are fitted; each (series, weight triple) of the coarse grid is
    one row, the refinement of the best works inside it.
    """
    arr = series_arrays(series, keys, month, value).where(
        F.size("_y") >= max(min_months, season + 1))
    cand = arr.select(*_keys(keys), "_last", "_y", F.explode(_grid(alphas, betas, gammas)).alias("_w"))
    fut = _fitted(_coarse_best(cand, keys, season), keys, season).select(
        *_keys(keys), "_best", "_last", "_st", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    return fut.select(*_keys(keys), F.add_months(F.col("_last"), F.col("_h")).alias(month),
                      _continued(season).alias("yhat"), F.lit(METHOD_HOLT_WINTERS).alias("method"),
                      F.col("_best.a").alias("alpha"), F.col("_best.b").alias("beta"),
                      F.col("_best.g").alias("gamma"), F.col("_best.sse").alias("sse"))


def forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = FORECAST_HORIZON,
             month: str = "month", value: str = "transactions",
             season: int = SEASON_LENGTH,
             min_months: int = HOLT_WINTERS_MIN_MONTHS) -> DataFrame:
    """ML6: Holt-Winters where a series has ``min_months`` months after gap
    filling (and more than a season), the seasonal-naive mean elsewhere.

    (keys..., month, yhat, method).  One array per series feeds both methods:
    a long series is expanded to the grid of weights, a short one to a single
    row without weights, and one aggregate picks the best row of either.  An empty
    series has no last month and gives no rows.
    """
    arr = series_arrays(series, keys, month, value)
    long_enough = F.size("_y") >= max(min_months, season + 1)
    none = F.array(F.lit(None).cast("struct<a:double,b:double,g:double>"))
    cand = arr.select(*_keys(keys), "_last", "_y", F.explode(
        F.when(long_enough, _grid(ALPHAS, BETAS, GAMMAS)).otherwise(none)).alias("_w"))
    fut = _fitted(_coarse_best(cand, keys, season), keys, season).select(
        *_keys(keys), "_st", "_y", "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    # months are contiguous: the same calendar month lies whole years before
    at = F.size("_y") + F.col("_h") - 1
    same = F.filter("_y", lambda v, i: (at - i) % 12 == 0)
    naive = F.when(F.size(same) > 0, _mean_of(same)).otherwise(_mean_of(F.col("_y")))
    st = F.col("_st")
    return fut.select(*_keys(keys), F.add_months(F.col("_last"), F.col("_h")).alias(month),
                      F.when(st.isNotNull(), _continued(season)).otherwise(naive).alias("yhat"),
                      F.when(st.isNotNull(), F.lit(METHOD_HOLT_WINTERS))
                      .otherwise(F.lit(METHOD_SEASONAL_NAIVE)).alias("method"))
