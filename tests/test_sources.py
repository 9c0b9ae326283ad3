"""Scans, sinks, month bookkeeping, links and streaming on files in a fresh folder."""

from __future__ import annotations

import datetime as dt
import gzip
import html
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbflow.operators.rollup import base_rollup, zone_backfill
from kerbflow.plans import monthly
from kerbflow.plans.unified import build_unified
from kerbflow.operators.unify import Source
from kerbflow.sources import conform, incremental, layouts, links, readers, sinks
from kerbflow.session import shared_folder
from kerbflow.streaming import hourly

D = dt.date(2024, 1, 1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


def write(path, text):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def rows(df, *columns):
    """Rows in a fixed order, nulls first."""
    names = columns or df.columns
    found = [tuple(r[c] for c in names) for r in df.collect()]
    return sorted(found, key=lambda row: [(v is not None, v) for v in row])


def test_gps_csv(spark, folder):
    Path(folder, "a.csv").write_text(
        '"Date/Time","Lat","Lon","Base"\n"4/1/2014 0:11:00",40.7,-73.9,"b02512"\n'
        '"bad",40.7,-73.9,"B02512"\n"4/1/2014 0:17:00",,-73.9,"B02512"\n'
        '"4/2/2014 23:59:59",40.7,-73.9,"X1"\n'
    )
    raw = readers.read_csv(spark, folder, "`Date/Time` string, Lat double, Lon double, Base string")
    got = rows(conform.gps_trips(raw), "pickup_datetime", "base", "base_name")
    assert got == [
        (dt.datetime(2014, 4, 1, 0, 11), "B02512", "Unter"),
        (dt.datetime(2014, 4, 2, 23, 59, 59), "X1", "Unknown"),
    ]


def test_dispatch_csv(spark, folder):
    Path(folder, "a.csv").write_text(
        "Dispatching_base_num,Pickup_date,Affiliated_base_num,locationID\n"
        "b02617,2015-05-17 09:47:00,b02617,141\nB02617,2015-05-17 09:47:00,,65\n"
        "B02617,2015-05-17 09:47:00,B02617,\n"
    )
    raw = readers.read_csv(
        spark, folder,
        "Dispatching_base_num string, Pickup_date string, Affiliated_base_num string, locationID long",
    )
    got = rows(conform.dispatch_trips(raw), "dispatching_base", "affiliated_base", "location_id")
    assert got == [("B02617", None, 65), ("B02617", "B02617", 141)]


def test_csv_after_preamble(spark, folder):
    schema = ("`Base Number` string, `Base Name` string, `Pick Up Date` string, "
              "`Number of Trips` string, `Number of Vehicles` string")
    names = {"Base Number": "base", "Base Name": "base_name", "Pick Up Date": "pickup_date",
             "Number of Trips": "trips", "Number of Vehicles": "vehicles"}
    top = "Title,{0}\n\nline 3\nline,4,x,1,2\n,,,,\n"
    Path(folder, "a.csv").write_text(
        top.format("a") + "Base Number,Base Name,Pick Up Date,Number of Trips,Number of Vehicles\n"
        ' b1 , Some Base ,1/2/2015,"1,234",5\nB9,No Date,,1,1\n'
    )
    Path(folder, "b.csv").write_text(  # other order, a column more, blanks and CRLF
        (top.format("b") + " number of vehicles,Note,Base Name,Base Number,Number of Trips,Pick Up Date\n"
         '5,x, Some Base ,B2,"1,234",1/2/2015\n1,,No Date,B9,1,\n').replace("\n", "\r\n")
    )
    Path(folder, "c.csv").write_text("")
    raw = readers.read_csv_after_preamble(spark, folder, schema, 5, names)
    got = rows(conform.operator_supply(raw))
    assert got == [
        (dt.date(2015, 1, 2), "2015-01", "B1", "Some Base", 1234, 5),
        (dt.date(2015, 1, 2), "2015-01", "B2", "Some Base", 1234, 5),
    ]


def test_a_preamble_file_without_a_column_is_an_error(spark, folder):
    Path(folder, "a.csv").write_text("t\nx,y\n1,2\n")
    Path(folder, "b.csv").write_text("t\nx,z\n1,2\n")
    with pytest.raises(readers.MissingColumns, match=r"b\.csv is missing required columns: \['y'\]"):
        readers.read_csv_after_preamble(spark, folder, "x int, y int", 1)


def test_optional_csv_is_bound_by_header(spark, folder):
    Path(folder, "one.csv").write_text("b,a\n1,2\n")
    Path(folder, "two.csv").write_text('A ,c,"b"\n5,x,4\n')
    Path(folder, "three.csv").write_text("b\n7\n")
    Path(folder, "empty.csv").write_text("")
    got = readers.read_optional(spark, folder, "a int, b string", "csv")
    assert rows(got, "a", "b") == [(None, "7"), (2, "1"), (5, "4")]
    assert readers.read_optional(spark, f"{folder}/none", "a int", "csv").collect() == []


def test_layouts_are_found_from_the_first_lines(spark, folder):
    Path(folder, "long.csv").write_text(",".join(f"c{i}" for i in range(9000)) + "\n" + "x\n" * 5)
    Path(folder, "a b%.csv").write_text('\ufeff"p,q",r\n1,2\n', encoding="utf-8")
    with gzip.open(f"{folder}/z.csv.gz", "wt") as file:
        file.write("r,s\n1,2\n")
    found = {r["path"].rsplit("/", 1)[1]: r["columns"] for r in layouts.file_layouts(spark, folder).collect()}
    assert found["a b%.csv"] == ["p,q", "r"] and found["z.csv.gz"] == ["r", "s"] and len(found["long.csv"]) == 9000
    text = readers.read_csv_by_name(spark, f"{folder}/a b%.csv", "r int, `p,q` int")
    assert rows(text, "r", "p,q") == [(2, 1)]


def test_every_parquet_file_needs_the_columns(spark, folder):
    for k in range(3):
        frame = spark.range(2).withColumn("good" if k != 1 else "other", F.lit(k))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/t")
    with pytest.raises(readers.MissingColumns, match="GOOD"):
        readers.read_parquet_columns(spark, f"{folder}/t", ["id"], required=["ID", "GOOD"])
    assert readers.read_parquet_columns(spark, f"{folder}/t", ["id"], required=["ID"]).count() == 6


def test_base_supply(spark):
    raw = spark.createDataFrame(
        [("b02512", "1/1/2015", "1,234", " 5 "), ("B9", "x", "abc", None)],
        "dispatching_base_number string, date string, active_vehicles string, trips string",
    )
    assert rows(conform.base_supply(raw)) == [
        (None, None, "B9", "Unknown", 0, 0),
        (dt.date(2015, 1, 1), "2015-01", "B02512", "Unter", 1234, 5),
    ]


def high_volume(spark, path, with_cbd):
    t = dt.datetime
    data = [("HV1", t(2024, 1, 1, 3), 7, 1.5, 100, "Y", "N", 2.0),
            ("HV1", t(2024, 1, 1, 3), None, 1.0, 10, "Y", None, 1.0),
            ("HV2", t(2024, 1, 1, 3), 7, 9.0, 10, None, None, 1.0)]
    df = spark.createDataFrame(
        data, "hvfhs_license_num string, pickup_datetime timestamp_ntz, PULocationID bigint, "
        "trip_miles double, trip_time bigint, shared_request_flag string, "
        "shared_match_flag string, cbd_congestion_fee double",
    ).coalesce(1)
    (df if with_cbd else df.drop("cbd_congestion_fee", "shared_match_flag")).write.parquet(path)


def test_high_volume_parquet_with_drifting_columns(spark, folder):
    high_volume(spark, f"{folder}/old", False)
    high_volume(spark, f"{folder}/new", True)
    wanted = ["hvfhs_license_num", "pickup_datetime", "PULocationID", "trip_miles", "trip_time",
              "tips", "cbd_congestion_fee", "shared_request_flag", "shared_match_flag"]
    raw = readers.read_parquet_columns(
        spark, [f"{folder}/old", f"{folder}/new"], wanted, ["PULocationID"]
    )
    assert "tips" not in raw.columns
    trips = conform.high_volume_trips(raw, ["HV1"], {"HV1": "One"}, month="2024-01")
    base = base_rollup(trips, ["hvfhs_license_num", "company"])
    assert rows(base, "company", "location_id", "trips", "trip_time_seconds",
                "cbd_congestion_fees", "shared_requests", "shared_matches") == [
        ("One", 7, 2, 200, 2.0, 2, 0)
    ]
    declared = readers.read_parquet_columns(
        spark, [f"{folder}/old", f"{folder}/new"], schema="trip_miles double, tips double"
    )
    assert declared.columns == ["trip_miles", "tips"]
    assert declared.filter("tips IS NOT NULL").isEmpty() and declared.count() == 6
    with pytest.raises(readers.MissingColumns, match="pickup_zone"):
        readers.read_parquet_columns(spark, f"{folder}/old", wanted, ["pickup_zone"])


def test_month_label_from_the_file_name(spark, folder):
    high_volume(spark, f"{folder}/part", True)
    source = next(Path(folder, "part").glob("*.parquet"))
    target = Path(folder, "landed")
    target.mkdir()
    (target / "fhvhv_tripdata_2023-12.parquet").write_bytes(source.read_bytes())
    raw = spark.read.parquet(str(target))
    trips = conform.high_volume_trips(raw, ["HV2"], {}, month_from_file=True)
    assert rows(trips, "pickup_month", "company") == [("2023-12", "Unknown")]


@pytest.mark.parametrize("spelling", ["PUlocationID", "PULocationID", None])
def test_base_trips(spark, spelling):
    t = dt.datetime(2016, 1, 31, 23, 59)
    data = [("B02512", t, 5.0), ("B02512", t, None), ("b02512", t, 5.0), (None, t, 5.0),
            ("B02512", None, 5.0)]
    name = spelling or "other"
    raw = spark.createDataFrame(
        data, f"dispatching_base_num string, pickup_datetime timestamp_ntz, {name} double"
    )
    trips = conform.base_trips(raw, "x")
    assert rows(trips, "location_id") == ([(None,), (5,)] if spelling else [(None,), (None,)])
    assert {r.base_name for r in trips.collect()} == {"Unter"}
    zones = spark.createDataFrame([(5, "Queens", "A")], "location_id bigint, borough string, zone string")
    filled = zone_backfill(trips, zones, ["company"], fill="Unknown")
    assert rows(filled, "zone", "trips") == ([("A", 1)] if spelling else [])


def test_service_rows(spark, folder):
    Path(folder, "zone.json").write_text(json.dumps([
        {"pickup_day": "2017-01-01T00:00:00.000", "location_id": "3", "trips": "12"},
        {"pickup_day": "2017-01-01T00:00:00.000", "trips": "x"}]))
    Path(folder, "hour.json").write_text(json.dumps([
        {"pickup_day": "2017-01-01T00:00:00.000", "hour": "7", "trips": "2"},
        {"pickup_day": "2017-01-01T00:00:00.000", "hour": None, "trips": "3"}]))
    text = "pickup_day string, location_id string, hour string, trips string"
    zones = spark.createDataFrame([(3, "Bronx", "Z")], "location_id bigint, borough string, zone string")
    by_place = conform.day_place_counts(
        readers.read_json_rows(spark, f"{folder}/zone.json", text), zones, "x", "2017-01"
    )
    assert rows(by_place, "location_id", "borough", "trips") == [(None, "Unknown", 0), (3, "Bronx", 12)]
    by_hour = conform.day_hour_counts(
        readers.read_json_rows(spark, f"{folder}/hour.json", text), "x", "2017-01"
    )
    assert rows(by_hour, "pickup_date", "hour", "trips") == [
        (dt.date(2017, 1, 1), 0, 3), (dt.date(2017, 1, 1), 7, 2)
    ]


def test_columnar_json(spark, folder):
    Path(folder, "w.json").write_text(json.dumps(
        {"latitude": 1, "daily": {"time": ["2024-01-01", "2024-01-02"], "rain_sum": [0.0, None]}}))
    got = readers.read_parallel_arrays(
        spark, f"{folder}/w.json", {"time": "date", "rain_sum": "double"}
    )
    assert rows(got) == [(D, 0.0), (D + dt.timedelta(1), None)]


def test_zone_dimension_nulls(spark):
    raw = spark.createDataFrame(
        [("264", "Unknown", "N/A"), ("1", "EWR", "Newark")], "LocationID string, Borough string, Zone string"
    )
    assert rows(conform.zone_dimension(raw)) == [(1, "EWR", "Newark"), (264, "Unknown", None)]


def test_shards_with_different_layouts(spark, folder):
    for name, text in (("a", "pickup_date,borough,trips\n2018-01-01,Bronx,2\n"),
                       ("b", "pickup_date,trips,borough,fee\n2018-01-02,3,Queens,1.5\n"),
                       ("c", "pickup_date,borough,trips\n")):
        Path(folder, f"{name}.csv").write_text(text)
    shards = readers.read_month_shards(spark, [f"{folder}/{n}.csv" for n in "abc"])
    schema = StructType.fromDDL("pickup_date date, borough string, trips bigint, fee double, tips double")
    assert rows(readers.typed(shards, schema)) == [
        (dt.date(2018, 1, 1), "Bronx", 2, None, None), (dt.date(2018, 1, 2), "Queens", 3, 1.5, None)
    ]


def test_absent_tables_are_empty(spark, folder):
    empty = readers.read_optional(spark, f"{folder}/none", "pickup_date date, trips bigint")
    assert empty.columns == ["pickup_date", "trips"] and empty.isEmpty()
    assert readers.read_custom_events(spark, f"{folder}/none.csv").isEmpty()


def test_custom_events(spark, folder):
    Path(folder, "e.csv").write_text(
        "date,event_name,event_category,borough\n2024-07-04,Fair,Concert,Queens\n"
        "bad,Fair,Concert,Queens\n2024-07-05,,Concert,Queens\n2024-07-06,Run,,Multiple boroughs\n"
    )
    assert rows(readers.read_custom_events(spark, f"{folder}/e.csv")) == [
        (dt.date(2024, 7, 4), "Fair", "Concerts & music festivals", None, "Queens"),
        (dt.date(2024, 7, 6), "Run", "Other event", None, "Multiple boroughs"),
    ]
    Path(folder, "f.csv").write_text("day,event_name\n2024-07-04,Fair\n")
    assert readers.read_custom_events(spark, f"{folder}/f.csv").isEmpty()


def test_stored_table_round_trip(spark, folder):
    df = spark.createDataFrame([(D, D, 3)], "pickup_date date, week_start date, trips bigint")
    sinks.write_csv(df, f"{folder}/t", ["pickup_date"])
    assert rows(readers.read_table(spark, f"{folder}/t", df.schema)) == [(D, D, 3)]


def test_month_partitions_are_replaced_one_by_one(spark, folder):
    def months(data):
        return spark.createDataFrame(data, "source string, pickup_month string, trips bigint")

    sinks.write_months(months([("a", "2024-01", 1), ("a", "2024-02", 2)]), f"{folder}/t")
    sinks.write_months(months([("a", "2024-02", 5)]), f"{folder}/t")
    assert rows(spark.read.parquet(f"{folder}/t"), "pickup_month", "trips") == [
        ("2024-01", 1), ("2024-02", 5)
    ]


def test_empty_result_keeps_the_old_table(spark, folder):
    df = spark.createDataFrame([(1,)], "trips bigint")
    empty = df.filter("trips > 5")
    assert sinks.write_unless_empty(empty, f"{folder}/t")
    assert sinks.write_unless_empty(df, f"{folder}/t")
    assert not sinks.write_unless_empty(empty, f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").count() == 1


def test_manifest_file(spark, folder):
    df = spark.createDataFrame([(D, 1), (D, 2)], "pickup_date date, trips bigint")
    sinks.write_manifest(sinks.manifest({"t": df, "u": df.drop("pickup_date")}), f"{folder}/m",
                         {"start": "2024-01"})
    got = rows(spark.read.json(f"{folder}/m"), "table_name", "rows", "first_date", "start")
    assert got == [("t", 2, "2024-01-01", "2024-01"), ("u", 2, None, "2024-01")]


def zone_table(spark):
    return spark.createDataFrame([(1, "Queens", "A")], "location_id bigint, borough string, zone string")


def test_monthly_refresh_resumes_and_records_failures(spark, folder):
    loaded = []

    def load(month):
        loaded.append(month)
        if month == "2024-02":
            return spark.read.parquet(f"{folder}/absent")
        day = dt.datetime.fromisoformat(f"{month}-03T04:00:00")
        return spark.createDataFrame(
            [(day, "x", 1), (day, "x", 2)],
            "pickup_datetime timestamp_ntz, company string, location_id bigint",
        )

    months = incremental.month_range(incremental.month_bounds(spark, "2024-01", "2024-03"))
    out = f"{folder}/out"
    log = monthly.refresh_months(spark, months, load, zone_table(spark), out, "s")
    assert rows(log.select("month", "status").distinct(), "month", "status") == [
        ("2024-01", "done"), ("2024-02", "failed"), ("2024-03", "done")
    ]
    monthly.refresh_months(spark, months, load, zone_table(spark), out, "s")
    assert loaded == ["2024-01", "2024-02", "2024-03", "2024-02"]
    monthly.refresh_months(spark, months, load, zone_table(spark), out, "s", overwrite=True)
    assert len(loaded) == 7
    borough = monthly.stored_grain(spark, out, "daily_by_borough")
    assert rows(borough, "pickup_month", "borough", "trips") == [
        ("2024-01", None, 1), ("2024-01", "Queens", 1), ("2024-03", None, 1), ("2024-03", "Queens", 1)
    ]
    weekday = monthly.stored_grain(spark, out, "weekday_hour_by_company")
    assert sum(r.trips for r in weekday.collect()) == 4
    stats = monthly.stored_manifest(spark, out)
    assert rows(stats, "table_name", "rows")[0] == ("daily_by_borough", 4)


def trips_on(spark, month, n=1, **columns):
    day = dt.datetime.fromisoformat(f"{month}-03T04:00:00")
    df = spark.createDataFrame(
        [(day, "x", 1)] * n, "pickup_datetime timestamp_ntz, company string, location_id bigint"
    )
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def month_frame(spark, *labels):
    return spark.createDataFrame([(m,) for m in labels], "month string")


def state(spark, out, source="s"):
    log = monthly.run_log(spark, out).filter(F.col("source") == source)
    latest = log.groupBy("month", "table_name").agg(F.max_by("status", "finished").alias("status"))
    return {(r.month, r.table_name): r.status for r in latest.collect()}


def test_each_source_has_its_own_months(spark, folder):
    out = f"{folder}/out"
    for source, n in (("a", 1), ("b", 3)):
        monthly.refresh_months(spark, month_frame(spark, "2024-01"), lambda m, n=n: trips_on(spark, m, n),
                               zone_table(spark), out, source)
    daily = monthly.stored_grain(spark, out, "daily_by_company")
    assert rows(daily, "source", "trips") == [("a", 1), ("b", 3)]


def test_a_skipped_table_stays_due(spark, folder):
    out, months = f"{folder}/out", month_frame(spark, "2024-01")
    load = lambda m: trips_on(spark, m)
    monthly.refresh_months(spark, months, load, zone_table(spark), out, "s", skip_zone=True)
    assert "daily_by_zone" not in {t for _, t in state(spark, out)}
    monthly.refresh_months(spark, months, load, zone_table(spark), out, "s")
    assert state(spark, out)["2024-01", "daily_by_zone"] == "done"
    assert rows(monthly.stored_grain(spark, out, "daily_by_zone"), "trips") == [(1,)]


@pytest.mark.parametrize("batch", [1, 12])
def test_columns_may_appear_and_vanish(spark, folder, batch):
    out = f"{folder}/out"
    extra = {"2024-01": {}, "2024-02": {"tips": 2.0}, "2024-03": {}}
    monthly.refresh_months(spark, month_frame(spark, *extra), lambda m: trips_on(spark, m, 2, **extra[m]),
                           zone_table(spark), out, "s", batch=batch)
    daily = monthly.stored_grain(spark, out, "daily_by_company")
    assert rows(daily, "pickup_month", "tips") == [("2024-01", None), ("2024-02", 4.0), ("2024-03", None)]
    weekday = monthly.stored_grain(spark, out, "weekday_hour_by_company")
    assert sum(r.tips or 0 for r in weekday.collect()) == 4.0


def test_an_empty_month_stays_due(spark, folder):
    out, months = f"{folder}/out", month_frame(spark, "2024-01")
    monthly.refresh_months(spark, months, lambda m: trips_on(spark, m, 0), zone_table(spark), out, "s")
    assert set(state(spark, out).values()) == {"empty"}
    monthly.refresh_months(spark, months, lambda m: trips_on(spark, m, 1), zone_table(spark), out, "s")
    assert set(state(spark, out).values()) == {"done"}
    monthly.refresh_months(spark, months, lambda m: trips_on(spark, m, 0), zone_table(spark), out, "s",
                           overwrite=True)
    assert rows(monthly.stored_grain(spark, out, "daily_by_company"), "trips") == [(1,)]


@pytest.mark.parametrize("error", [OSError("no disk"), ValueError(""), KeyError("x")])
def test_any_error_of_a_loader_is_logged(spark, folder, error):
    out = f"{folder}/out"

    def load(month):
        if month == "2024-01":
            raise error
        return trips_on(spark, month)

    monthly.refresh_months(spark, month_frame(spark, "2024-01", "2024-02"), load, zone_table(spark), out, "s")
    assert {m: s for (m, _), s in state(spark, out).items()} == {"2024-01": "failed", "2024-02": "done"}


def test_headers_decide_not_positions(spark, folder):
    write(f"{folder}/swapped/a.csv", "Base,Lat\nB1,40.5\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, f"{folder}/swapped", "Lat double, Base string").collect()
    write(f"{folder}/shards/a.csv", "a,b\n1,2\n")
    write(f"{folder}/shards/b.csv", "b,a\n3,4\n")
    both = readers.read_month_shards(spark, [[f"{folder}/shards/a.csv", f"{folder}/shards/b.csv"]])
    assert rows(both, "a", "b") == [("1", "2"), ("4", "3")]
    assert rows(readers.read_month_shards(spark, [f"{folder}/shards"]), "a", "b") == [("1", "2"), ("4", "3")]


def test_a_declared_schema_still_checks_required_columns(spark, folder):
    spark.range(2).write.parquet(f"{folder}/p")
    with pytest.raises(readers.MissingColumns):
        readers.read_parquet_columns(spark, f"{folder}/p", ["when"], ["when"], "id long, when timestamp")


def test_the_last_link_is_the_one_furthest_down(spark):
    found = spark.createDataFrame(
        [(1, 5, "2024-01", "z"), (2, 0, "2024-01", "a"), (1, 9, "2024-02", "b")],
        "page_id long, position int, month string, url string").withColumn("record_type", F.lit("fhv"))
    months = month_frame(spark, "2024-01", "2024-02", "2024-03")
    assert rows(links.month_urls(months, found, "fhv", "t-%s"), "month", "url") == [
        ("2024-01", "a"), ("2024-02", "b"), ("2024-03", "t-2024-03")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return self.master if key == "spark.master" else default

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(ValueError):
        shared_folder(Session("spark://host:7077"), "x")
    with pytest.raises(ValueError):
        shared_folder(Session("local-cluster[2,1,1024]"), "x")
    assert shared_folder(Session("local[4]"), "x") != shared_folder(Session("local[4]"), "x")


def test_unified_build_writes_tables(spark, folder):
    df = spark.createDataFrame([(D, 4)], "pickup_date date, trips bigint")
    hours = df.withColumn("hour", F.lit(3))
    stats = build_unified(spark, {
        "unified_daily_by_company": [Source("a", 10, df)],
        "unified_hourly_by_company": [Source("a", 10, hours)],
    }, folder)
    assert rows(stats, "table_name", "rows") == [
        ("unified_annual_summary", 1), ("unified_daily_by_company", 1), ("unified_hourly_by_company", 1)
    ]


def test_month_bookkeeping(spark):
    months = incremental.month_range(incremental.month_bounds(spark, "2023-11", "2024-08"))
    assert months.count() == 10

    def labels(*names):
        return spark.createDataFrame([(n,) for n in names], "month string")

    seen = labels("2023-12", "2024-01", "2024-04", "2024-08")
    assert rows(incremental.until_gap(months, seen)) == [("2023-12",), ("2024-01",), ("2024-04",)]
    assert rows(incremental.until_gap(months, seen, 2)) == [("2023-12",), ("2024-01",)]
    assert rows(incremental.gap_runs(months, seen)) == [
        ("2023-11", "2023-11", 1), ("2024-02", "2024-03", 2), ("2024-05", "2024-07", 3)
    ]
    assert incremental.month_span("2023-12") == ("2023-12-01", "2024-01-01")
    assert incremental.month_span("2024-01") == ("2024-01-01", "2024-02-01")
    assert rows(incremental.latest_months(months, 2)) == [("2024-07",), ("2024-08",)]
    stored = spark.createDataFrame(
        [("a", "2024-01"), ("b", "2024-01"), ("a", "2024-02"), ("a", "2024-02")],
        "table_name string, month string",
    )
    pending = {r.month for r in incremental.pending_months(months, stored, 2).collect()}
    assert "2024-01" not in pending and len(pending) == 9


PAGE = """<html><!-- <a href="/trip-data/fhv_tripdata_2000-01.parquet">no</a> -->
<script>var s = '<a href="/trip-data/fhv_tripdata_2000-02.parquet">no</a>';</script>
<A class=x HREF='https://d/trip-data/fhvhv_tripdata_2024-01.parquet'> High <b>volume</b>
</A><a name="here">skip</a>
<a href=https://d/trip-data/yellow_tripdata_2024-02.PARQUET>Yellow &amp; more</a>
<a data-href="x" title="t">none</a>
<a href="https://d/trip-data/green_tripdata_2024-03.parquet">lost <a href="/x">kept</a>
<a href="https://d/trip-data/fhv_tripdata.parquet">no month</a>
<a href="https://d/other/fhv_tripdata_2024-04.parquet">elsewhere</a>
<a href="https://d/trip-data/fhv_tripdata_2024-04.pdf">pdf</a></html>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    found = links.page_links(pages)
    assert ("/x", "kept") in rows(found, "href", "label")
    typed = links.trip_record_links(found)
    assert rows(typed, "month", "year", "record_type", "label") == [
        ("2024-01", "2024", "hvfhv", "High  volume"), ("2024-02", "2024", "yellow", "Yellow & more"),
    ]
    months = spark.createDataFrame([("2024-01",), ("2024-05",)], "month string")
    assert rows(links.month_urls(months, typed, "hvfhv", "https://m/%s.parquet")) == [
        ("2024-01", "https://d/trip-data/fhvhv_tripdata_2024-01.parquet"),
        ("2024-05", "https://m/2024-05.parquet"),
    ]


def landed(spark, path, hours):
    spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, h), "x") for h in hours], "pickup_datetime timestamp_ntz, company string"
    ).coalesce(1).write.mode("append").parquet(path)


def test_stream_adds_up_late_files_and_replays(spark, folder):
    source, out, point = f"{folder}/in", f"{folder}/out", f"{folder}/cp"
    landed(spark, source, [5, 5, 6])
    schema = spark.read.parquet(source).schema

    def run():
        hourly.run_hourly_counts(hourly.landed_trips(spark, source, schema), out, point)
        return rows(hourly.stored_hourly(spark, out), "hour", "trips")

    assert run() == [(5, 2), (6, 1)]
    assert run() == [(5, 2), (6, 1)]
    landed(spark, source, [1, 5])
    assert run() == [(1, 1), (5, 3), (6, 1)]
    for more, want in (([7], [(1, 1), (5, 3), (6, 1), (7, 1)]), ([7, 1], [(1, 2), (5, 3), (6, 1), (7, 2)])):
        hourly.fold_batches(spark, out)
        landed(spark, source, more)
        assert run() == want
    hourly.fold_batches(spark, out)
    assert run() == [(1, 2), (5, 3), (6, 1), (7, 2)]
    assert Path(f"{out}_folded/version=3").exists()


def test_character_references_are_decoded_once(spark):
    texts = ["a &amp;lt; b", "&#65;&#x42;&#X43;;", "&eacute;&Eacute;&apos;&nbsp;x", "&nobody; &amp &; &#; &#x;",
             "&#128512;&#x1F600;&#0;&#xD800;&#x110000;&#999999999;", "", "plain", "&", "&&lt;&"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(links.resolved(F.col("t"))).collect()]
    assert got == [html.unescape(t.replace("&amp &", "&amp; &")).replace("&nobody; & &", "&nobody; &amp &")
                   for t in texts] + [None]
