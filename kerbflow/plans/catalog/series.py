"""Daily series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbflow.functions.categories import AREA_ORDER, direction, rank_in
from kerbflow.operators import filters, series
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DAILY,
    DEMAND,
    SPINE,
    named_demand,
    order_days,
    table,
)

REGION_ORDER = ("EUROPE", "ASIA")


@query("daily_total", f"WITH {DAILY} SELECT pickup_date, trips FROM daily")
def daily_total(spark, folder):
    trips = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("pickup_date"), F.lit(1).cast("bigint").alias("trips")
    )
    return series.daily_total(trips)


@query("kpis", f"""WITH {DAILY}
SELECT CAST(SUM(trips) AS BIGINT) AS total_trips, round(AVG(trips), 6) AS avg_daily,
       (SELECT pickup_date FROM daily ORDER BY trips DESC, pickup_date LIMIT 1) AS peak_day,
       MAX(trips) AS peak_trips FROM daily""")
def kpis(spark, folder):
    out = series.kpis(order_days(spark, folder))
    return out.withColumn("avg_daily", F.round("avg_daily", 6))


_PRESETS = """p AS (
  SELECT lo, least(hi, DATE '2001-06-15') AS e FROM
    (SELECT MIN(pickup_date) AS lo, MAX(pickup_date) AS hi FROM daily))"""


@query("preset_ranges", f"""WITH {DAILY}, {_PRESETS}, s AS (
  SELECT '1D' AS preset, e AS s FROM p UNION ALL SELECT '7D', e - 6 FROM p
  UNION ALL SELECT '30D', e - 29 FROM p UNION ALL SELECT '90D', e - 89 FROM p
  UNION ALL SELECT 'MTD', date_trunc('month', e) FROM p
  UNION ALL SELECT 'YTD', date_trunc('year', e) FROM p
  UNION ALL SELECT '1Y', e - 364 FROM p UNION ALL SELECT '5Y', e - 1824 FROM p
  UNION ALL SELECT 'All', lo FROM p UNION ALL SELECT 'Post-2019', DATE '1999-02-01' FROM p)
SELECT preset, greatest(lo, CAST(s AS DATE)) AS start_date, e AS end_date FROM s, p""")
def preset_ranges(spark, folder):
    return filters.preset_ranges(order_days(spark, folder), "2001-06-15", "1999-02-01")


@query("period_filter", f"""WITH {DAILY}, {_PRESETS}
SELECT pickup_date, trips FROM daily, p WHERE pickup_date BETWEEN date_trunc('year', e) AND e""")
def period_filter(spark, folder):
    """Year to date, both ends included."""
    daily = order_days(spark, folder)
    start, end = filters.preset_start(daily, "YTD", "2001-06-15")
    return filters.in_period(daily, start, end)


@query("top_groups", f"""WITH {DEMAND}
SELECT zone, CAST(SUM(trips) AS BIGINT) AS trips FROM demand WHERE zone IS NOT NULL
GROUP BY 1 ORDER BY trips DESC, zone LIMIT 12""")
def top_groups(spark, folder):
    return filters.top_groups(named_demand(spark, folder), "zone", 12)


@query("area_share", f"""WITH {DEMAND}, t AS (
  SELECT borough, CAST(SUM(trips) AS BIGINT) AS trips FROM demand WHERE borough IS NOT NULL
  GROUP BY 1)
SELECT borough, trips, round(trips / SUM(trips) OVER (), 6) AS share FROM t""")
def area_share(spark, folder):
    out = filters.area_share(named_demand(spark, folder))
    return out.withColumn("share", F.round("share", 6))


@query("group_presets", f"""WITH {DEMAND}, b AS (
  SELECT pickup_date, borough, trips FROM demand WHERE borough IS NOT NULL),
best AS (SELECT borough FROM b GROUP BY 1 ORDER BY SUM(trips) DESC, borough LIMIT 3)
SELECT 'all' AS preset, borough, CAST(SUM(trips) AS BIGINT) AS trips FROM b GROUP BY 2
UNION ALL SELECT 'outer', borough, CAST(SUM(trips) AS BIGINT) FROM b
  WHERE borough IN ('AMERICA', 'ASIA') GROUP BY 2
UNION ALL SELECT 'top3', borough, CAST(SUM(trips) AS BIGINT) FROM b
  WHERE borough IN (SELECT borough FROM best) GROUP BY 2
UNION ALL SELECT 'custom', borough, CAST(SUM(trips) AS BIGINT) FROM b
  WHERE borough = 'EUROPE' GROUP BY 2""")
def group_presets(spark, folder):
    df = named_demand(spark, folder).groupBy("borough").agg(F.sum("trips").alias("trips"))
    core, out = ("AFRICA", "AMERICA", "ASIA"), None
    for preset in ("all", "outer", "top3", "custom"):
        chosen = filters.select_groups(df, "borough", preset, ("EUROPE",), core, "AFRICA")
        part = filters.group_volumes(chosen, "borough").withColumn("preset", F.lit(preset))
        out = part if out is None else out.unionByName(part)
    return out


@query("direction_labels", f"""WITH {DAILY}, l AS (
  SELECT pickup_date, trips - lag(trips) OVER (ORDER BY pickup_date) AS delta FROM daily)
SELECT pickup_date, delta, CASE WHEN delta > 0 THEN 'Positive' WHEN delta < 0 THEN 'Negative'
       ELSE 'Flat' END AS direction FROM l""")
def direction_labels(spark, folder):
    before = F.lag("trips").over(Window.orderBy("pickup_date"))
    deltas = order_days(spark, folder).select(
        "pickup_date", (F.col("trips") - before).alias("delta")
    )
    return deltas.withColumn("direction", direction(F.col("delta")))


@query("area_order", f"""WITH {DEMAND}
SELECT borough, CAST(SUM(trips) AS BIGINT) AS trips,
       CAST(CASE borough WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 END AS BIGINT) AS place
FROM demand GROUP BY 1""")
def area_order(spark, folder):
    """Display place of each area; areas that are not listed have none."""
    areas = named_demand(spark, folder).groupBy("borough").agg(F.sum("trips").alias("trips"))
    order = REGION_ORDER + AREA_ORDER
    return areas.withColumn("place", rank_in(F.col("borough"), order).cast("bigint"))


@query("rolling_7_rows", f"""WITH {DAILY}
SELECT pickup_date, trips, round(AVG(trips) OVER (ORDER BY pickup_date
       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_7d FROM daily""")
def rolling_7_rows(spark, folder):
    out = series.rolling_mean(order_days(spark, folder))
    return out.withColumn("rolling_7d", F.round("rolling_7d", 6))


@query("weekly_delta", f"""WITH {DAILY}, r AS (
  SELECT trips, ROW_NUMBER() OVER (ORDER BY pickup_date DESC) AS n FROM daily)
SELECT round(SUM(trips) FILTER (WHERE n <= 7) / SUM(trips) FILTER (WHERE n > 7) - 1, 6)
       AS weekly_delta FROM r WHERE n <= 14""")
def weekly_delta(spark, folder):
    out = series.weekly_delta(order_days(spark, folder))
    return out.withColumn("weekly_delta", F.round("weekly_delta", 6))


@query("month_growth", f"""WITH {DEMAND}, m AS (
  SELECT borough, strftime(pickup_date, '%Y-%m') AS pickup_month,
         CAST(SUM(trips) AS BIGINT) AS trips FROM demand WHERE borough IS NOT NULL GROUP BY 1, 2)
SELECT borough, pickup_month, trips, round(trips / lag(trips) OVER (PARTITION BY borough
       ORDER BY pickup_month) - 1, 6) AS mom_growth FROM m""")
def month_growth(spark, folder):
    out = series.month_growth(named_demand(spark, folder), ["borough"])
    return out.withColumn("mom_growth", F.round("mom_growth", 6))


_SPAN_SQL = ", ".join(
    f"""round((SUM(trips) FILTER (WHERE age BETWEEN 0 AND {n - 1})
        - SUM(trips) FILTER (WHERE age BETWEEN {n} AND {2 * n - 1}))
        / SUM(trips) FILTER (WHERE age BETWEEN {n} AND {2 * n - 1}), 6) AS {name}"""
    for name, n in series.GROWTH_SPANS.items()
)


@query("growth_stats", f"""WITH {DAILY}, a AS (
  SELECT trips, (SELECT MAX(pickup_date) FROM daily) - pickup_date AS age FROM daily)
SELECT {_SPAN_SQL} FROM a""")
def growth_stats(spark, folder):
    out = series.growth_stats(order_days(spark, folder))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _resample_sql(unit, label):
    return f"""WITH {DAILY}
SELECT CAST(date_trunc('{unit}', pickup_date) AS DATE) AS pickup_date,
       CAST(SUM(trips) AS BIGINT) AS trips,
       strftime(date_trunc('{unit}', pickup_date), '{label}') AS period_label
FROM daily GROUP BY ALL"""


@query("resample_week", _resample_sql("week", "Week of %b %d, %Y"))
def resample_week(spark, folder):
    return series.resample(order_days(spark, folder), "week")


@query("resample_month", _resample_sql("month", "%b %Y"))
def resample_month(spark, folder):
    return series.resample(order_days(spark, folder), "month")


@query("resample_year", _resample_sql("year", "%Y"))
def resample_year(spark, folder):
    return series.resample(order_days(spark, folder), "year")


_BUSY = "busy AS (SELECT * FROM daily WHERE trips > (SELECT AVG(trips) FROM daily))"


def _busy_days(spark, folder):
    """Days above the mean, which leaves holes."""
    daily = order_days(spark, folder)
    return daily.filter(F.col("trips") > daily.agg(F.avg("trips")).scalar())


@query("daily_spine", f"""WITH {DAILY}, {_BUSY}, s AS (
  SELECT CAST(unnest(generate_series((SELECT MIN(pickup_date) FROM busy),
         (SELECT MAX(pickup_date) FROM busy), INTERVAL 1 DAY)) AS DATE) AS pickup_date)
SELECT pickup_date, coalesce(trips, 0) AS trips FROM s LEFT JOIN busy USING (pickup_date)""")
def daily_spine(spark, folder):
    return series.fill_days(_busy_days(spark, folder))


@query("series_spine", f"""WITH {DEMAND}, d AS (
  SELECT zone, pickup_date, CAST(SUM(trips) AS BIGINT) AS trips FROM demand
  WHERE zone IS NOT NULL GROUP BY 1, 2),
s AS (SELECT zone, CAST(unnest(generate_series(MIN(pickup_date), MAX(pickup_date),
      INTERVAL 1 DAY)) AS DATE) AS pickup_date FROM d GROUP BY 1)
SELECT zone, pickup_date, coalesce(trips, 0) AS trips
FROM s LEFT JOIN d USING (zone, pickup_date)""")
def series_spine(spark, folder):
    """Zero-filled series per zone, each over its own range."""
    daily = series.daily_total(named_demand(spark, folder), ["zone"])
    return series.fill_days(daily, ["zone"])


@query("missing_dates", f"""WITH {SPINE}, {_BUSY}
SELECT date AS pickup_date FROM spine WHERE date NOT IN (SELECT pickup_date FROM busy)
  AND date BETWEEN (SELECT MIN(pickup_date) FROM busy) AND (SELECT MAX(pickup_date) FROM busy)""")
def missing_dates(spark, folder):
    return series.missing_dates(_busy_days(spark, folder))


@query("date_union_difference", """WITH a AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
u AS (SELECT d FROM a UNION SELECT d FROM b)
SELECT d AS pickup_date, d IN (SELECT d FROM a) AS in_first FROM u""")
def date_union_difference(spark, folder):
    """Distinct days of two tables, and whether the first one has them."""
    first = order_days(spark, folder).select("pickup_date")
    second = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("pickup_date"))
    every = series.union_dates(first, second)
    only_second = every.join(first, "pickup_date", "left_anti")
    common = every.join(first, "pickup_date", "left_semi")
    return common.withColumn("in_first", F.lit(True)).union(
        only_second.withColumn("in_first", F.lit(False))
    )


def _compare_sql(unit, mode, other_start, other_end):
    return f"""WITH {DAILY}, w AS (
  SELECT hi, CAST(date_trunc('{unit}', hi) AS DATE) AS s FROM
    (SELECT MAX(pickup_date) AS hi FROM daily)),
o AS (SELECT hi, s, CAST({other_start} AS DATE) AS os FROM w),
e AS (SELECT *, CAST({other_end} AS DATE) AS oe FROM o),
axis AS (
  SELECT 'current' AS period, s AS lo, CAST(unnest(generate_series(s, hi, INTERVAL 1 DAY)) AS DATE)
    AS pickup_date, s, hi FROM e
  UNION ALL
  SELECT '{mode}', os, CAST(unnest(generate_series(os, oe, INTERVAL 1 DAY)) AS DATE), s, hi FROM e)
SELECT period, CAST(pickup_date - lo + 1 AS INTEGER) AS day, pickup_date,
       CASE WHEN s + CAST(pickup_date - lo AS INTEGER) <= hi
            THEN s + CAST(pickup_date - lo AS INTEGER) END AS plot_date,
       coalesce(trips, 0) AS trips
FROM axis LEFT JOIN daily USING (pickup_date)"""


@query("compare_week_prev", _compare_sql("week", "previous", "s - 7", "os + CAST(hi - s AS INTEGER)"))
def compare_week_prev(spark, folder):
    return series.compare_periods(order_days(spark, folder), "week", "previous")


@query("compare_month_prev", _compare_sql(
    "month", "previous", "s - INTERVAL 1 MONTH", "os + CAST(hi - s AS INTEGER)"))
def compare_month_prev(spark, folder):
    return series.compare_periods(order_days(spark, folder), "month", "previous")


@query("compare_year_last", _compare_sql(
    "year", "last_year", "s - INTERVAL 1 YEAR", "hi - INTERVAL 1 YEAR"))
def compare_year_last(spark, folder):
    return series.compare_periods(order_days(spark, folder), "year", "last_year")


@query("comparison_totals", f"""WITH {DAILY}, w AS (
  SELECT hi, CAST(date_trunc('year', hi) AS DATE) AS s FROM
    (SELECT MAX(pickup_date) AS hi FROM daily)),
e AS (SELECT *, CAST(s - INTERVAL 1 YEAR AS DATE) AS os FROM w),
t AS (SELECT s, hi, os, CAST(os + CAST(hi - s AS INTEGER) AS DATE) AS oe FROM e)
SELECT SUM(trips) FILTER (WHERE pickup_date BETWEEN s AND hi)::BIGINT AS current_total,
       SUM(trips) FILTER (WHERE pickup_date BETWEEN os AND oe)::BIGINT AS comparison_total,
       round(SUM(trips) FILTER (WHERE pickup_date BETWEEN s AND hi)
             / SUM(trips) FILTER (WHERE pickup_date BETWEEN os AND oe) - 1, 6) AS delta,
       s AS current_start, hi AS current_end, os AS comparison_start, oe AS comparison_end
FROM daily, t GROUP BY s, hi, os, oe""")
def comparison_totals(spark, folder):
    out = series.comparison_totals(order_days(spark, folder), "year", "previous")
    return out.withColumn("delta", F.round("delta", 6))
