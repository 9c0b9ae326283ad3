"""Published snapshots, corrections by delta, late trips and mergeable sets."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbflow.operators import deltas, sets, unify
from kerbflow.operators.unify import Source
from kerbflow.plans import corrections, monthly
from kerbflow.plans.catalog import QUERIES
from kerbflow.sources.snapshots import SnapshotStore
from kerbflow.streaming import eventtime, hourly

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def table(spark, *found):
    return spark.createDataFrame(list(found), "source string, pickup_month string, v bigint")


def test_a_commit_publishes_all_tables_at_once(spark, folder):
    store = SnapshotStore(spark, folder)
    assert store.latest() is None and store.commit([]) == []
    a = store.write("a", table(spark, ("s", "2024-01", 1), ("s", "2024-02", 2)))
    b = store.write("b", table(spark, ("s", "2024-01", 10)))
    with pytest.raises(ValueError, match="no partition"):
        store.read("a")
    assert sorted((p.table_name, p.pickup_month, p.rows) for p in store.commit([a, b])) == [
        ("a", "2024-01", 1), ("a", "2024-02", 1), ("b", "2024-01", 1)]
    a = store.write("a", table(spark, ("s", "2024-02", 5), ("s", "2024-02", 6), ("t", "2024-02", 7)))
    assert rows(store.read("a"), "v") == [(1,), (2,)]  # written, not published
    store.commit([a], replacing=[("b", "s", "2024-01")])
    assert rows(store.read("a"), "source", "pickup_month", "v") == [
        ("s", "2024-01", 1), ("s", "2024-02", 5), ("s", "2024-02", 6), ("t", "2024-02", 7)]
    assert rows(store.read("a", 1), "v") == [(1,), (2,)] and rows(store.read("b", 1), "v") == [(10,)]
    with pytest.raises(ValueError, match="no partition"):
        store.read("b")


def test_versions_with_other_columns_are_united(spark, folder):
    store = SnapshotStore(spark, folder)
    store.commit([store.write("a", table(spark, ("s", "2024-01", 1)))])
    store.commit([store.write("a", table(spark, ("s", "2024-02", 2)).withColumn("w", F.lit("x")))])
    assert rows(store.read("a"), "v", "w") == [(1, None), (2, "x")]


def test_clean_keeps_what_snapshots_read(spark, folder):
    store = SnapshotStore(spark, folder)
    store.commit([store.write("a", table(spark, ("s", "2024-01", 1)))])
    store.commit([store.write("a", table(spark, ("s", "2024-01", 2)))])
    store.write("a", table(spark, ("s", "2024-01", 3)))  # never published
    assert len(store.unused_versions(2)) == 1 and len(store.unused_versions()) == 2
    assert store.clean(2) == 1
    assert rows(store.read("a", 1), "v") == [(1,)]
    assert store.clean() == 1 and rows(store.read("a"), "v") == [(2,)]


def test_two_commits_of_one_number_are_an_error(spark, folder):
    store = SnapshotStore(spark, folder)
    store.commit([store.write("a", table(spark, ("s", "2024-01", 1)))])
    store.spark.read.parquet(f"{folder}/log").write.mode("append").parquet(f"{folder}/copy")
    store.spark.read.parquet(f"{folder}/copy").write.mode("append").parquet(f"{folder}/log")
    with pytest.raises(ValueError, match="share a snapshot"):
        store.latest()


def trips_on(spark, month, n, company="x"):
    day = dt.datetime.fromisoformat(f"{month}-03T04:00:00")
    return spark.createDataFrame(
        [(day, company, 1)] * n, "pickup_datetime timestamp_ntz, company string, location_id bigint")


def test_a_failure_between_two_grains_publishes_nothing(spark, folder, monkeypatch):
    zones = spark.createDataFrame([(1, "Queens", "A")], "location_id bigint, borough string, zone string")
    months = spark.createDataFrame([("2024-01",)], "month string")
    refresh = lambda n, **o: monthly.refresh_months(
        spark, months, lambda m: trips_on(spark, m, n), zones, folder, "s", **o)
    grains = ("daily_by_company", "daily_by_zone", "hourly_by_company", "weekday_hour_by_company")
    state = lambda: [rows(monthly.stored_grain(spark, folder, g), "trips") for g in grains]
    refresh(1)
    write, written = SnapshotStore.write, []

    def failing(store, name, df):
        if name == "hourly_by_company":
            raise OSError("disk")
        written.append(name)
        return write(store, name, df)

    monkeypatch.setattr(SnapshotStore, "write", failing)
    refresh(5, overwrite=True)
    assert written == ["base", "daily_by_company", "daily_by_borough", "daily_by_zone"]
    assert state() == [[(1,)]] * 4 and SnapshotStore(spark, folder).latest() == 1
    last = monthly.run_log(spark, folder).orderBy(F.desc("finished")).first()
    assert last["status"] == "failed" and "disk" in last["message"]
    monkeypatch.undo()
    refresh(5, overwrite=True)
    assert state() == [[(5,)]] * 4
    assert rows(monthly.stored_grain(spark, folder, "daily_by_zone", snapshot=1), "trips") == [(1,)]
    assert len(SnapshotStore(spark, folder).unused_versions()) == 4 + 6


# corrections

def shard(spark, days, fare=None):
    """{day of 2024: trips} as a daily rollup."""
    frame = spark.createDataFrame(
        [(DAY + dt.timedelta(k), "all", n) for k, n in days.items()],
        "pickup_date date, company string, trips bigint")
    return frame if fare is None else frame.withColumn("fare", F.lit(fare).cast("double"))


def plain(state):
    """Merged days and annual rows of {source: (priority, {day: trips})} by plain loops."""
    merged = {}
    for name, (priority, days) in state.items():
        for k, n in days.items():
            if k not in merged or merged[k][0] < priority:
                merged[k] = (priority, name, n)
    days = sorted(merged)
    whole = {}
    for k in days:
        whole.setdefault((DAY + dt.timedelta(k)).year, []).append(k)
    date = lambda k: DAY + dt.timedelta(k)
    return (sorted(((date(k), merged[k][1], merged[k][2]) for k in days), key=repr),
            sorted((y, sum(merged[k][2] for k in v), date(v[0]), date(v[-1]), len(v)) for y, v in whole.items()))


def test_random_corrections_equal_a_rebuild(spark, folder):
    rng = random.Random(4)
    some = lambda lo, hi: {k: rng.randint(1, 9) for k in range(lo, hi) if rng.random() < 0.6}
    state = {"a": (1, some(0, 60)), "b": (2, some(20, 60))}
    store = SnapshotStore(spark, folder)
    corrections.build(store, [Source(n, p, shard(spark, d)) for n, (p, d) in state.items()])
    for step in range(4):
        name, month = ("b", "a", "b", "a")[step], (0, 31, 31, 0)[step]
        priority, days = state[name]
        new = some(month, month + 29) if step != 2 else {}
        days = {k: n for k, n in days.items() if not month <= k < month + (31 if month == 0 else 29)} | new
        state[name] = (priority, days)
        corrections.correct_month(store, Source(name, priority, shard(spark, new)), ("2024-01", "2024-02")[month > 0])
        merged, annual = plain(state)
        assert rows(corrections.unified_daily(store), "pickup_date", "source", "trips") == merged
        assert rows(corrections.annual_summary(store), "year", "trips", "first_date", "last_date", "days") == annual
    expected = unify.daily_by_company([Source(n, p, shard(spark, d)) for n, (p, d) in state.items()])
    assert rows(corrections.unified_daily(store), "pickup_date", "trips") == rows(expected, "pickup_date", "trips")


def test_retracted_measures_become_null_again(spark):
    keys = ["pickup_date", "company"]
    sums = deltas.with_support(shard(spark, {0: 3, 1: 4}), keys)
    once = deltas.signed_delta(shard(spark, {}), shard(spark, {1: 2, 2: 5}, 0.1), keys)
    after = deltas.apply_delta(sums, once, keys)
    assert rows(after, "trips", "fare") == [(3, None), (5, 0.1), (6, 0.1)]
    back = deltas.signed_delta(shard(spark, {1: 2, 2: 5}, 0.1), shard(spark, {}), keys)
    assert rows(deltas.apply_delta(after, back, keys), "trips", "fare") == [(3, None), (4, None)]
    assert deltas.added([once, back], keys).count() == 0
    none = spark.createDataFrame([(None, None, 4)], "pickup_date date, company string, trips bigint")
    gone = deltas.signed_delta(none, none.withColumn("trips", F.lit(1).cast("bigint")), keys)
    assert rows(deltas.apply_delta(deltas.with_support(none, keys), gone, keys), "trips") == [(1,)]


# event time

def test_late_trips_come_as_corrections(spark, folder):
    schema = "pickup_datetime timestamp_ntz, company string"

    def land(*found):
        frame = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), c) for h, m, c in found], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        trips = hourly.landed_trips(spark, f"{folder}/landing", StructType.fromDDL(schema))
        eventtime.run_corrected_hours(trips, f"{folder}/out", f"{folder}/home", "1 hour")
        return rows(eventtime.corrected_hours(spark, f"{folder}/out"), "hour", "company", "published", "late", "trips")

    assert land((1, 0, "x"), (5, 30, "x")) == [(1, "x", 1, 0, 1), (5, "x", 1, 0, 1)]
    # Watermark 4:30: hours 4 and 5 are open, hour 1 is closed.
    assert land((1, 10, "x"), (4, 20, "y"), (5, 40, "x"), (1, 20, "z")) == [
        (1, "x", 1, 1, 2), (1, "z", 0, 1, 1), (4, "y", 1, 0, 1), (5, "x", 2, 0, 2)]
    assert land((9, 0, "x"))[0] == (1, "x", 1, 1, 2)
    none = spark.createDataFrame([(None, "x")], schema)
    none.write.mode("append").parquet(f"{folder}/landing")
    assert (None, "x", 0, 1, 1) in land((5, 50, "x"))


# sets

def test_sets_merge_to_exact_counts(spark):
    rng = random.Random(2)
    found = [(rng.randint(0, 5), rng.choice("ab"), rng.choice([1, 32768, 32769, 70000, -5, 0, 2**40])
              if rng.random() < 0.3 else rng.randint(1, 40)) for _ in range(3000)]
    found += [(6, "c", None), (6, "c", None), (5, None, 7)]
    trips = spark.createDataFrame(found, "day int, company string, vehicle bigint")
    daily = sets.set_rollup(trips, ["day", "company"], "vehicle")
    for keys in (["day", "company"], ["company"], ["day"]):
        want = trips.groupBy(*keys).agg(F.count("*").alias("trips"), F.count_distinct("vehicle").alias("vehicles"))
        assert rows(sets.set_sizes(daily, keys), *keys, "trips", "vehicles") == rows(want, *keys, "trips", "vehicles")
    again = sets.merge_sets(sets.merge_sets(daily, ["company"]), [])
    assert rows(sets.set_sizes(again, []), "vehicles") == [(trips.select("vehicle").dropna().distinct().count(),)]
    assert rows(sets.trips_per_active(daily, ["company"]).filter("company = 'c'"), "trips_per_vehicle") == [(None,)]


def test_sets_at_the_edges_of_words_and_buckets(spark):
    edges = [0, 1, 63, 64, 127, 128, 191, 192, 255, 256, 511, 512, 2**40, 2**62, 2**63 - 1]
    numbers = edges + [-n - 1 for n in edges]
    found = [(day, n) for day in (1, 2) for n in numbers[day:]] + [(1, n) for n in numbers] + [(3, None)]
    daily = sets.set_rollup(spark.createDataFrame(found, "day int, vehicle bigint"), ["day"], "vehicle")
    assert rows(sets.set_sizes(daily, ["day"]), "day", "trips", "vehicles") == [(1, 59, 30), (2, 28, 28), (3, 1, 0)]
    assert rows(sets.set_sizes(daily, []), "trips", "vehicles") == [(88, 30)]


def test_sets_are_narrow_rows_of_hash_aggregates(spark):
    """A set of few members in a bucket must not take KBs of a task, which sorts them all."""
    trips = spark.range(3000).selectExpr("id % 30 AS day", "string(id % 2) AS company", "id * 1000 AS vehicle")
    daily = sets.set_rollup(trips, ["day", "company"], "vehicle")
    sizes = sets.trips_per_active(daily, ["company"])
    assert {f.dataType.simpleString() for f in daily.drop("day", "company").schema} == {"bigint"}
    assert daily.count() == 3000
    for df in (daily, sets.merge_sets(daily, ["company"]), sizes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert rows(sizes, "trips", "vehicles") == [(1500, 1500)] * 2


def test_all_grains_of_vehicles_sort_no_sets(spark, folder):
    days = [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 3, 31), dt.date(2024, 4, 1)]
    lines = [(n * 700, days[i], "AN"[n % 2]) for i in range(4) for n in range(i, 40, i + 1)] + [(None, days[3], "A")]
    spark.createDataFrame(lines, "l_partkey bigint, l_shipdate date, l_returnflag string").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{folder}/lineitem.parquet")
    grains = QUERIES["vehicles_all_grains"](spark, folder)
    plan = grains._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan

    def distinct(*which):
        return len({n for n, day, _ in lines if n is not None and day in {days[i] for i in which}})

    assert rows(grains, "grain", "period", "vehicles") == sorted([
        ("all", "all", distinct(0, 1, 2, 3)), ("year", "2023", distinct(0)), ("year", "2024", distinct(1, 2, 3)),
        ("quarter", "2023Q4", distinct(0)), ("quarter", "2024Q1", distinct(1, 2)), ("quarter", "2024Q2", distinct(3))],
        key=repr)


def test_sets_made_in_passes_are_those_of_one(spark):
    """Each task of a pass holds the sets of that pass; one shuffle unites them all."""
    rng = random.Random(5)
    found = [(rng.randint(0, 3), rng.choice([rng.randint(0, 5000), rng.randint(-3000, -1), 2**40, None])) for _ in range(3000)]
    trips = spark.createDataFrame(found, "day int, vehicle bigint")
    want = rows(sets.set_rollup(trips, ["day"], "vehicle"), "day", sets.BUCKET, "trips", *sets.MEMBERS)
    for passes in (2, 4, 7):
        daily = sets.set_rollup(trips, ["day"], "vehicle", passes)
        assert rows(daily, "day", sets.BUCKET, "trips", *sets.MEMBERS) == want
        plan = daily._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
        assert plan.count("Scan ExistingRDD") == passes
        held = trips.select("day", F.shiftright("vehicle", 8).alias(sets.BUCKET)).distinct()
        most = held.groupBy(F.pmod(F.xxhash64(sets.BUCKET), F.lit(passes))).count().agg(F.max("count")).first()[0]
        assert most < 2 * len(want) / passes + 4
    assert rows(sets.set_sizes(daily, []), "trips", "vehicles") == [(3000, len({n for _, n in found} - {None}))]


@pytest.mark.parametrize(("name", "others"), [("vehicles_all_grains", []), ("vehicles_by_month", ["company"])])
def test_stored_sets_have_only_the_keys_that_are_read(spark, folder, name, others):
    lines = [(n, dt.date(2024, 1, 1 + n % 3), "ANR"[n % 3 - n % 2]) for n in range(600)] * 2
    spark.createDataFrame(lines, "l_partkey bigint, l_shipdate date, l_returnflag string").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{folder}/lineitem.parquet")
    stored = spark.read.parquet(*{f.rpartition("/")[0] for f in QUERIES[name](spark, folder).inputFiles()})
    assert stored.columns == ["pickup_date", *others, sets.BUCKET, "trips", *sets.MEMBERS]
    assert stored.count() == len({(day, n // 256, *([flag] if others else [])) for n, day, flag in lines})
    assert stored.agg(F.sum("trips")).first()[0] == 1200


def test_sketches_estimate_sparse_members(spark):
    trips = spark.range(60000).selectExpr("id % 30 AS day", "id % 2 AS company", "xxhash64(id % 20000) AS vehicle")
    daily = sets.sketch_rollup(trips, ["day", "company"], "vehicle")
    got = sets.sketch_sizes(daily, []).first()
    assert got["trips"] == 60000 and abs(got["vehicles"] - 20000) < 20000 * 0.06
