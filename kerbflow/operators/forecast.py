"""Daily forecasts per series.

Preparation (zero filling, training range, horizon, features) is DataFrame work.
Fitting runs once per series in a grouped-map task; a series holds one row per
calendar day, so a group stays small while the number of series is free to grow.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.operators import fitting
from kerbflow.operators.context import calendar_features, federal_holidays, impute_climatology
from kerbflow.operators.fitting import SEASON
from kerbflow.operators.series import DATE, daily_total

# Executors need not have this package installed: the fitting code travels with the job.
cloudpickle.register_pickle_by_value(fitting)

# Training start and least number of training days.
TRAIN_START = "2021-01-01"
MIN_DAYS = 365
FLAGS = (
    "is_weekend", "is_month_start", "is_month_end", "is_federal_holiday",
    "has_nyc_event", "has_precipitation",
)
WEATHER = ("temperature_avg_f", "precipitation_sum")
CYCLES = {"weekly": 7.0, "annual": 365.25}
FEATURES = (
    "trend", "trend_sq", *FLAGS, *WEATHER,
    *(f"{wave}_{name}" for name in CYCLES for wave in ("sin", "cos")),
    *(f"dow_{d}" for d in range(7)), *(f"month_{m}" for m in range(1, 13)),
)


def forecast_rows(
    df: DataFrame, by: Sequence[str], months: int = 1, start: str = TRAIN_START,
    least: int = MIN_DAYS,
) -> DataFrame:
    """Training days (zero-filled) and the days to forecast (``trips`` null).

    One ordered pass per series: each observed day yields the gap behind it, and
    the last one the 1-12 calendar months ahead. Series with fewer than ``least``
    training days drop out. ``first_day`` and ``last_day`` bound the training days.
    """
    ahead = max(1, min(int(months), 12))
    following = F.lead(DATE).over(Window.partitionBy(*by).orderBy(DATE))
    end = F.date_sub(F.add_months(F.date_add(DATE, 1), ahead), 1)
    runs = daily_total(df, by).select(*by, DATE, "trips", following.alias("next_")).select(
        *by, "trips", "next_",
        F.posexplode(F.sequence(DATE, F.coalesce(F.date_sub("next_", 1), end))).alias("gap", DATE),
    )
    value = F.when(F.col("gap") == 0, F.col("trips")).when(F.col("next_").isNotNull(), 0)
    days = runs.select(*by, DATE, value.alias("trips")).filter(
        F.col(DATE) >= F.lit(start).cast("date")
    )
    series = Window.partitionBy(*by)
    known = F.when(F.col("trips").isNotNull(), F.col(DATE))
    return (
        days.withColumns(
            {
                "first_day": F.min(known).over(series),
                "last_day": F.max(known).over(series),
                "days_": F.count("trips").over(series),
            }
        )
        .filter(F.col("days_") >= least)
        .drop("days_")
    )


def seasonal_naive(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeat the last week (or the whole series if it is shorter)."""
    ahead, train = rows.filter("trips IS NULL"), rows.filter("trips IS NOT NULL")
    length = F.date_diff("last_day", "first_day") + 1
    season = F.least(F.lit(SEASON), length)
    step = F.date_diff(DATE, "last_day") - 1
    source = F.date_add("last_day", 1 - season + step % season)
    return (
        ahead.select(*by, DATE, source.alias("from_"))
        .join(train.select(*by, F.col(DATE).alias("from_"), "trips"), [*by, "from_"])
        .select(*by, DATE, F.col("trips").cast("double").alias("trips_forecast"))
    )


def context_for_days(days: DataFrame, context: DataFrame, flat_rain: bool = False) -> DataFrame:
    """Context of every distinct day, gaps filled from climatology.

    ``flat_rain=True`` keeps the rain feature at 0, as when it is absent.
    """
    wanted = [c for c in (*FLAGS, *WEATHER) if c in context.columns]
    base = days.select(DATE).distinct().join(
        context.select(F.col("date").alias(DATE), *wanted), DATE, "left"
    )
    absent = {c: F.lit(None).cast("boolean") for c in FLAGS if c not in wanted}
    absent |= {c: F.lit(None).cast("double") for c in WEATHER if c not in wanted}
    if flat_rain:
        absent["precipitation_sum"] = F.lit(None).cast("double")
    base = base.withColumns(absent) if absent else base
    return impute_climatology(base, WEATHER, FLAGS)


def feature_columns(day: Column, start: Column) -> dict[str, Column]:
    """Trend, cycle and dummy columns of a day."""
    t = F.date_diff(day, start).cast("double")
    out = {"trend": t, "trend_sq": t * t}
    for name, period in CYCLES.items():
        angle = t * F.lit(2 * math.pi / period)
        out[f"sin_{name}"] = F.sin(angle)
        out[f"cos_{name}"] = F.cos(angle)
    out |= {f"dow_{d}": (F.weekday(day) == d).cast("double") for d in range(7)}
    out |= {f"month_{m}": (F.month(day) == m).cast("double") for m in range(1, 13)}
    return out


def regression_frame(
    rows: DataFrame, by: Sequence[str], context: DataFrame | None, flat_rain: bool = False
) -> DataFrame:
    """Feature columns for training and forecast days.

    Without a context the calendar columns come from the days themselves; weather and
    events are 0.
    """
    if context is None:
        days = rows.select(F.col(DATE).alias("date")).distinct()
        ends = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        context = calendar_features(days, federal_holidays(ends))
    joined = rows.join(context_for_days(rows, context, flat_rain), DATE)
    numeric = {c: F.col(c).cast("double") for c in (*FLAGS, *WEATHER)}
    made = numeric | feature_columns(F.col(DATE), F.col("first_day"))
    return joined.select(*by, DATE, "trips", *[made[f].alias(f) for f in FEATURES])


def smooth(y: Column, level_weight: Column) -> Column:
    """The best Holt-Winters state of a series for one level weight: (error, pair, level,
    trend, cycle), the least one-step squared error over pairs of trend and season weights.

    The recursion is a fold over the days in its error form: the miss of a day, by the
    weights, corrects level, trend and season. ``c0`` is the season of the coming day.
    """
    first, second = (
        F.aggregate(F.slice(y, k, SEASON), F.lit(0.0), lambda a, v: a + v) / SEASON
        for k in (1, SEASON + 1))
    cycle = [f"c{k}" for k in range(SEASON)]
    begin = F.struct(
        F.lit(0.0).alias("error"), first.alias("level"), ((second - first) / SEASON).alias("trend"),
        *[(y[k] - first).alias(c) for k, c in enumerate(cycle)])
    pairs = [F.struct(F.lit(k).alias("pair"), (level_weight * b).alias("trend"), F.lit(g).alias("season"))
             for k, (b, g) in enumerate(itertools.product(fitting.TREND_GRID, fitting.SEASON_GRID))]

    def fold(pair: Column) -> Column:
        def day(s: Column, v: Column) -> Column:
            miss = v - s["level"] - s["trend"] - s["c0"]
            return F.struct(
                (s["error"] + miss * miss).alias("error"),
                (s["level"] + s["trend"] + level_weight * miss).alias("level"),
                (s["trend"] + pair["trend"] * miss).alias("trend"),
                *[s[later].alias(c) for c, later in zip(cycle, cycle[1:])],
                (s["c0"] + pair["season"] * miss).alias(cycle[-1]))

        return F.aggregate(y, begin, day, lambda s: F.struct(
            s["error"].alias("error"), pair["pair"].alias("pair"), s["level"].alias("level"),
            s["trend"].alias("trend"), F.array(*[s[c] for c in cycle]).alias("cycle")))

    return F.array_min(F.transform(F.array(*pairs), fold))


def smoothed_forecast(rows: DataFrame, by: Sequence[str], seasonal: bool = True) -> DataFrame:
    """Holt-Winters, or the last week again where a series is shorter than two seasons,
    its state is not finite or ``seasonal`` is False; built-in expressions only.

    A series is one row with an array of its days; the weights of the level are rows beside
    it, dealt over the tasks, and the best of them is a partial aggregate.
    """
    days = F.array_sort(F.collect_list(F.struct(DATE, "trips")))
    series = rows.groupBy(*by).agg(days.alias("days_")).select(
        *by,
        F.transform(F.filter("days_", lambda d: d["trips"].isNotNull()),
                    lambda d: d["trips"].cast("double")).alias("y_"),
        F.transform(F.filter("days_", lambda d: d["trips"].isNull()), lambda d: d[DATE]).alias("ahead_"),
    )
    size = F.size("y_")
    last = F.expr(f"slice(y_, greatest(size(y_) - {SEASON - 1}, 1), {SEASON})")
    weights = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(a).alias("weight"))
                        for k, a in enumerate(fitting.LEVEL_GRID[: None if seasonal else 1])])
    fits = series.select(*by, "y_", "ahead_", F.explode(weights).alias("w_"))
    if seasonal:  # by number: few rows of much work must not be merged into one task
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fits = fits.repartition(tasks, *by, "w_")
    state = F.when(F.lit(seasonal) & (size >= 2 * SEASON), smooth(F.col("y_"), F.col("w_.weight")))
    found = fits.select(*by, "ahead_", last.alias("last_"), F.col("w_.at").alias("at_"), state.alias("state_"))
    order = F.struct("state_.error", "at_", "state_")
    best = found.groupBy(*by).agg(
        F.min(F.when(F.col("state_").isNotNull(), order)).alias("best_"),
        F.first("ahead_").alias("ahead_"), F.first("last_").alias("last_"))
    s = F.col("best_.state_")
    fine = F.coalesce(F.abs(s["error"]) + F.abs(s["level"]) + F.abs(s["trend"]) < float("inf"), F.lit(False))
    out = best.select(*by, "last_", s.alias("state_"), fine.alias("fine_"), F.posexplode("ahead_").alias("h_", DATE))
    h, s = F.col("h_"), F.col("state_")
    smoothed = s["level"] + (h + 1) * s["trend"] + s["cycle"][h % SEASON]
    value = F.when(F.col("fine_"), smoothed).otherwise(F.col("last_")[h % F.size("last_")])
    return out.select(
        *by, DATE, F.greatest(value, F.lit(0.0)).alias("trips_forecast"),
        F.when(F.col("fine_"), "Holt-Winters").otherwise("Seasonal naive").alias("model"))


def forecast(
    df: DataFrame,
    by: Sequence[str],
    model: str = "Holt-Winters",
    months: int = 1,
    context: DataFrame | None = None,
    start: str = TRAIN_START,
    least: int = MIN_DAYS,
    flat_rain: bool = False,
) -> DataFrame:
    """Forecast per series: (series, pickup_date, trips_forecast, model); floor 0.

    An unknown model, or one that cannot be fitted, falls back to Holt-Winters and
    then to the seasonal naive forecast, series by series. Only the regression runs in
    Python, one group a series.
    """
    rows = forecast_rows(df, by, months, start, least)
    if model != "Regression + seasonality":
        return smoothed_forecast(rows, by, seasonal=model != "Seasonal naive")
    rows = regression_frame(rows, by, context, flat_rain)
    keys = list(by)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(DATE)
        values, used = fitting.predict(model, ordered, FEATURES)
        out = ordered.loc[ordered["trips"].isna(), [*keys, DATE]].copy()
        out["trips_forecast"] = np.clip(values, 0, None)
        out["model"] = used
        return out

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [f"{k} {types[k]}" for k in keys]
        + [f"{DATE} date", "trips_forecast double", "model string"]
    )
    return rows.groupBy(*keys).applyInPandas(fit, schema)


def ridge_optimality(rows: DataFrame, by: Sequence[str], context: DataFrame | None) -> DataFrame:
    """Per series: does the fitted ridge solve its normal equations, and does no other
    penalty have a smaller leave-one-out error?

    The gradient is one aggregation over the training rows beside the coefficients.
    """
    train = regression_frame(rows, by, context).filter("trips IS NOT NULL")
    keys, names = list(by), list(FEATURES)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[names].to_numpy(float), group["trips"].to_numpy(float)
        coef, intercept, penalty, mean, std = fitting.standard_ridge(x, y)
        errors = [fitting.left_out_error((x - mean) / std, y, a) for a in fitting.PENALTIES]
        out = group[keys].head(1).copy()
        out["coef"], out["mean"], out["std"] = [coef.tolist()], [mean.tolist()], [std.tolist()]
        out["intercept"], out["penalty"] = intercept, penalty
        chosen = errors[fitting.PENALTIES.index(penalty)]
        out["least_error"] = chosen <= min(errors) * (1 + 1e-9)
        return out

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", coef array<double>, mean array<double>, std array<double>, intercept double, "
        "penalty double, least_error boolean")
    fits = train.groupBy(*keys).applyInPandas(fit, schema)
    z = F.zip_with(
        F.zip_with(F.array(*names), F.col("mean"), lambda v, m: v - m), F.col("std"),
        lambda v, s: v / s)
    joined = train.join(fits, keys).withColumn("z", z)
    guess = F.aggregate(F.zip_with("z", "coef", lambda v, c: v * c), F.lit(0.0), lambda a, v: a + v)
    joined = joined.withColumn("rest", F.col("trips") - guess - F.col("intercept"))
    pulls = [F.sum(F.col("z")[j] * F.col("rest")) - F.first("penalty") * F.first(F.col("coef")[j])
             for j in range(len(names))]
    scale = F.sum(F.abs("trips")) + 1
    return joined.groupBy(*keys).agg(
        (F.greatest(*[F.abs(p) for p in pulls], F.abs(F.sum("rest"))) <= 1e-7 * scale).alias("optimal"),
        F.first("least_error").alias("least_error"),
    )
