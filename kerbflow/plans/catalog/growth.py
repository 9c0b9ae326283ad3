"""Growth ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.operators import growth, series
from kerbflow.operators.selection import exact_quantile
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import DEMAND, named_demand, table
from kerbflow.session import shared_folder
from kerbflow.sources.sinks import write_parquet

_COLUMNS = ("current_trips", "prior_trips", "trip_delta", "growth", "direction")


def _sql(months, keys, tail):
    """Ranking written with two grouped windows and a null-safe join."""
    names = ", ".join(keys)
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    picked = ", ".join(f"c.{k}" for k in keys)
    return f"""WITH {DEMAND}, t AS (SELECT pickup_date, {names}, trips FROM demand),
w AS (SELECT hi, CAST(CAST(hi - INTERVAL {months} MONTH AS DATE) + 1 AS DATE) AS cs FROM
        (SELECT MAX(pickup_date) AS hi FROM t)),
v AS (SELECT hi, cs, CAST(cs - INTERVAL {months} MONTH AS DATE) AS ps FROM w),
c AS (SELECT {names}, CAST(SUM(trips) AS BIGINT) AS current_trips FROM t, v
      WHERE pickup_date BETWEEN cs AND hi GROUP BY {names}),
p AS (SELECT {names}, CAST(SUM(trips) AS BIGINT) AS prior_trips FROM t, v
      WHERE pickup_date BETWEEN ps AND cs - 1 GROUP BY {names}),
j AS (SELECT {picked}, current_trips, coalesce(prior_trips, 0) AS prior_trips,
             current_trips - coalesce(prior_trips, 0) AS trip_delta,
             CASE WHEN prior_trips > 0 THEN current_trips / prior_trips - 1 END AS growth
      FROM c LEFT JOIN p ON {on})
SELECT {names}, current_trips, prior_trips, trip_delta, round(growth, 6) AS growth,
       CASE WHEN trip_delta > 0 THEN 'Positive' WHEN trip_delta < 0 THEN 'Negative'
            ELSE 'Flat' END AS direction
FROM j {tail}"""


_FLOOR = "current_trips >= (SELECT quantile_cont(current_trips, {q}) FROM j)"


def _ranked(spark, folder, group, months, **options):
    out = growth.growth_opportunities(named_demand(spark, folder), group, months, **options)
    return out.select(*group, *_COLUMNS).withColumn("growth", F.round("growth", 6))


@query("growth_gains", _sql(12, ["zone", "borough"], f"""
WHERE {_FLOOR.format(q=0.5)}
ORDER BY trip_delta DESC, growth DESC NULLS LAST, zone NULLS LAST, borough NULLS LAST LIMIT 10"""))
def growth_gains(spark, folder):
    return _ranked(spark, folder, ["zone", "borough"], "Last 1 year", top=10)


@query("growth_losses", _sql(6, ["zone", "borough"], """
ORDER BY trip_delta, growth NULLS LAST, zone NULLS LAST, borough NULLS LAST LIMIT 10"""))
def growth_losses(spark, folder):
    return _ranked(spark, folder, ["zone", "borough"], 6, top=10, volume_quantile=None,
                   rank_by="largest_losses")


@query("growth_rate_floor", _sql(36, ["company"], f"""
WHERE {_FLOOR.format(q=0.25)} AND prior_trips > 0
ORDER BY growth DESC NULLS LAST, trip_delta DESC, company NULLS LAST LIMIT 4"""))
def growth_rate_floor(spark, folder):
    return _ranked(spark, folder, ["company"], 36, top=4, volume_quantile=0.25, rank_by="growth")


@query("growth_all_areas", _sql(1, ["borough"], ""))
def growth_all_areas(spark, folder):
    """Every area, unranked."""
    return _ranked(spark, folder, ["borough"], 1, top=None, volume_quantile=None)


_GUARDED = """
WHERE (SELECT COUNT(*) FROM v, unnest(generate_series(v.ps, v.hi, INTERVAL 1 DAY)) g(d)
       WHERE CAST(g.d AS DATE) NOT IN (SELECT pickup_date FROM t)) = 0"""


@query("growth_coverage_guard", _sql(60, ["borough"], _GUARDED))
def growth_coverage_guard(spark, folder):
    """The prior five years reach back before the first day, so nothing is shown."""
    return _ranked(spark, folder, ["borough"], 60, top=None, volume_quantile=None,
                   complete_days=True)


@query("growth_coverage_full", _sql(1, ["borough"], _GUARDED))
def growth_coverage_full(spark, folder):
    """All areas if no day of the two windows is missing."""
    return _ranked(spark, folder, ["borough"], 1, top=None, volume_quantile=None,
                   complete_days=True)


@query("growth_coverage_hole", f"""WITH {DEMAND}, h AS (SELECT MAX(pickup_date) AS hi FROM demand),
gone AS (SELECT DISTINCT pickup_date FROM demand, h WHERE pickup_date BETWEEN hi - 12 AND hi - 10),
t AS (SELECT * FROM demand WHERE pickup_date NOT IN (SELECT pickup_date FROM gone)),
w AS (SELECT hi, CAST(CAST(hi - INTERVAL 1 MONTH AS DATE) + 1 AS DATE) AS cs FROM h),
v AS (SELECT hi, cs, CAST(cs - INTERVAL 1 MONTH AS DATE) AS ps FROM w)
SELECT CAST((SELECT COUNT(*) FROM v, unnest(generate_series(v.ps, v.hi, INTERVAL 1 DAY)) g(d)
             WHERE CAST(g.d AS DATE) NOT IN (SELECT pickup_date FROM t)) AS BIGINT) AS missing_days,
       (SELECT COUNT(DISTINCT coalesce(borough, '-')) FROM t, v WHERE pickup_date BETWEEN cs AND hi)
         AS shown, CAST(0 AS BIGINT) AS shown_if_complete""")
def growth_coverage_hole(spark, folder):
    """Three days are taken out of windows that the data covers: the guard shows nothing."""
    demand = named_demand(spark, folder)
    hi = demand.agg(F.max("pickup_date")).scalar()
    holed = demand.filter(~F.col("pickup_date").between(F.date_sub(hi, 12), F.date_sub(hi, 10)))
    ranked = [
        growth.growth_opportunities(holed, ["borough"], 1, None, None, complete_days=guard).agg(
            F.count(F.lit(1)).alias(name))
        for guard, name in ((False, "shown"), (True, "shown_if_complete"))
    ]
    missing = growth.growth_meta(holed, ["borough"], 1).select("missing_days")
    return missing.select("missing_days", *[r.scalar().alias(r.columns[0]) for r in ranked])


@query("growth_meta", f"""WITH {DEMAND},
w AS (SELECT lo, hi, CAST(CAST(hi - INTERVAL 60 MONTH AS DATE) + 1 AS DATE) AS cs FROM
        (SELECT MIN(pickup_date) AS lo, MAX(pickup_date) AS hi FROM demand)),
v AS (SELECT lo, hi, cs, CAST(cs - INTERVAL 60 MONTH AS DATE) AS ps FROM w)
SELECT strftime(cs, '%b %d, %Y') || ' - ' || strftime(hi, '%b %d, %Y') AS current_window,
       strftime(ps, '%b %d, %Y') || ' - ' || strftime(cs - 1, '%b %d, %Y') AS prior_window,
       CAST((SELECT COUNT(*) FROM unnest(generate_series(ps, hi, INTERVAL 1 DAY)) g(d)
        WHERE CAST(g.d AS DATE) NOT IN (SELECT pickup_date FROM demand)) AS BIGINT)
         AS missing_days,
       lo > ps AS starts_late
FROM v""")
def growth_meta(spark, folder):
    """Five years against the five before: the data starts too late for that."""
    return growth.growth_meta(
        series.daily_total(named_demand(spark, folder), ["borough"]), ["borough"], 60
    )


_SHARES = (0.1, 0.5, 0.9, 0.999)


@query("volume_floor_exact", f"""WITH v AS (
  SELECT l_orderkey, SUM(l_quantity * l_extendedprice) AS volume FROM lineitem GROUP BY 1),
f AS (SELECT unnest({list(_SHARES)!r}::DOUBLE[]) AS share,
             unnest((SELECT quantile_cont(volume, {list(_SHARES)!r}) FROM v)) AS floor)
SELECT share, round(floor, 4) AS floor, COUNT(*) AS groups
FROM f JOIN v ON volume >= floor GROUP BY ALL""")
def volume_floor_exact(spark, folder):
    """Floors over a group of many values, and the groups that reach them."""
    path = f"{shared_folder(spark, 'volumes')}/by_order"
    write_parquet(table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("volume")), path)
    volumes = spark.read.parquet(path)
    floors = [(q, exact_quantile(volumes, q, "volume")) for q in _SHARES]
    counted = volumes.agg(*[F.count_if(F.col("volume") >= floor).alias(f"n{k}")
                            for k, (_, floor) in enumerate(floors)])
    rows = F.array(*[F.struct(F.lit(q).alias("share"), F.round(F.lit(floor), 4).alias("floor"),
                              F.col(f"n{k}").alias("groups")) for k, (q, floor) in enumerate(floors)])
    return counted.select(F.inline(rows))
