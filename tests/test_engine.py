import uuid
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tempora.functions import aggregates as A
from tempora.functions import uuid7
from tempora.functions.buckets import align_to_bucket, bucket_int, bucket_range, bucket_value, next_bucket, time_bucket
from tempora.functions.timeutil import interval
from tempora.operators.gapfill import Fill, Gapfill, gapfill
from tempora.plans import catalogue, views
from tempora.plans.cagg import ContinuousAggregate, Definition, Join, cut_ranges, merge_ranges
from tempora.plans.jobs import Scheduler, backoff
from tempora.sources import hypertable as H
from tempora.sources.copy import copy_from, copy_to

SF = "/root/testdata/sf0.001"


def test_interval():
    assert interval("1 day 02:30").width() == 95_400_000_000
    assert interval("5 months").months == 5
    with pytest.raises(ValueError):
        interval("1 month 1 day").width()


def test_integer_buckets(spark):
    df = spark.createDataFrame([(-11,), (-10,), (-1,), (0,), (9,), (10,)], "t long")
    assert [r[0] for r in df.select(bucket_int(10, F.col("t"))).collect()] == [-20, -10, -10, 0, 0, 10]
    assert bucket_value(10, -11) == -20
    with pytest.raises(ValueError):
        bucket_int(0, F.col("t"))


@pytest.mark.parametrize("width", ["7 days", "15 minutes", "5 months", "1 year"])
def test_twin(spark, width):
    times = [datetime(1960, 2, 3, 4, 5), datetime(1999, 12, 31), datetime(2000, 1, 3), datetime(2024, 2, 29, 23, 59)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select(time_bucket(width, F.col("t"), "timestamp_ntz")).collect()]
    assert got == [bucket_value(width, t) for t in times]


def test_bucket_range():
    for v in range(-20, 20):
        for op in (">=", ">", "<", "<=", "="):
            low, high = bucket_range(op, 7, v)
            for c in range(-40, 40):
                b = bucket_value(7, c)
                want = {">=": b >= v, ">": b > v, "<": b < v, "<=": b <= v, "=": b == v}[op]
                assert want == ((low is None or c >= low) and (high is None or c < high))
    assert align_to_bucket(10, 3, 11) == (0, 20)
    assert next_bucket("1 month", datetime(2024, 12, 1)) == datetime(2025, 1, 1)


def test_gapfill_rules(spark):
    df = spark.createDataFrame([(0, 1), (5, 6), (7, None), (9, 2)], "t int, v int")
    out = gapfill(df, Gapfill(1, "t", 0, 11), {"v": F.max("v")}, {"v": Fill("interpolate")})
    assert [r.v for r in out.orderBy("bucket").collect()] == [1, 2, 3, 4, 5, 6, None, None, None, 2, None]
    out = gapfill(df, Gapfill(1, "t", 0, 10), {"v": F.max("v")}, {"v": Fill("locf")})
    assert [r.v for r in out.orderBy("bucket").collect()] == [1, 1, 1, 1, 1, 6, 6, None, None, 2]
    out = gapfill(df, Gapfill(1, "t", 0, 10), {"v": F.max("v")}, {"v": Fill("locf", null_is_missing=True)})
    assert [r.v for r in out.orderBy("bucket").collect()] == [1, 1, 1, 1, 1, 6, 6, 6, 6, 2]


def test_histogram(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,), (None,)], "v double")
    assert df.select(A.histogram(F.col("v"), 0.0, 10.0, 2)).first()[0] == [1, 1, 1, 1]
    assert df.where("false").select(A.histogram(F.col("v"), 0.0, 10.0, 2)).first()[0] is None


def test_chunks(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, d), d) for d in range(1, 11)], "ts timestamp_ntz, v long")
    t = H.Hypertable.create(spark, str(tmp_path / "t"), df.schema, H.by_range("ts", "2 days"), stats=("v",), data=df)
    assert t.approximate_row_count() == 10
    assert t.scan(datetime(2024, 1, 3), datetime(2024, 1, 5)).count() == 2
    assert len(t.chunks(ranges={"v": (9, 10)})) < len(t.chunks())
    assert [r.v for r in t.latest(3).collect()] == [10, 9, 8]
    t.compress()
    assert t.scan().count() == 10
    ids = [c["id"] for c in t.chunks()]
    t.merge_chunks(ids[:2])
    t.split_chunk(t.chunks()[0]["id"], datetime(2024, 1, 2))
    assert t.scan().count() == 10
    t.drop_chunks(older_than=datetime(2024, 1, 6))
    assert t.scan().agg(F.min("v")).first()[0] >= 5
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(None, 1)], df.schema))


def test_ranges():
    assert merge_ranges([[5, 6], [1, 2], [3, 3]]) == [[1, 3], [5, 6]]
    assert cut_ranges([[1, 9]], 3, 6) == ([[3, 5]], [[1, 2], [6, 9]])


def test_jobs():
    assert backoff(50, timedelta(minutes=5), timedelta(minutes=10)) == timedelta(minutes=50)
    s, seen = Scheduler(), []
    a = s.add_job(lambda c, now: seen.append(now), timedelta(hours=1))
    b = s.add_job(lambda c, now: 1 / 0, timedelta(hours=1))
    now = datetime(2024, 1, 1)
    assert s.run_pending(now) == [a, b]
    assert seen == [now] and s.jobs[b].failures == 1


@pytest.mark.parametrize("name", ["ohlc", "gapfill_interpolate", "cagg_late_data", "upsert_latest", "asof_join"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["gapfill_basic", "gapfill_locf", "gapfill_locf_prev", "gapfill_interpolate", "gapfill_window"])
def test_gapfill_over_all_events(spark, name):
    """Every event of sf0.01 by SQL; five minutes by type, so most buckets are gaps."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF.replace('0.001', '0.01')}/events.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    assert len(want) == 31 * 288 * 5
    got = catalogue.QUERIES[name](spark, SF.replace("0.001", "0.01")).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_gapfill_lookup(spark):
    """Ten days of sf0.01 with records looked up on either side equal those days of a filling of the whole month."""
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(catalogue.ORACLES["gapfill_lookup"])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES["gapfill_lookup"](spark, sf).select(*columns).collect()
    assert len(got) == 10 * 288 * 5 and all(r.v is not None for r in got)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["query_predicate", "merge_then_compress", "split_then_scan", "upsert_time_key", "update_moves_rows", "delete_whole_chunk", "merge_delete", "cagg_on_cagg", "cagg_join", "attach_detach", "copy_in_out", "distinct_on_latest"])
def test_tables_against_duckdb(spark, name):
    test_against_duckdb(spark, name)


# ---------------------------------------------------------------- tables


def day(d, h=0):
    return datetime(2024, 1, d, h)


@pytest.fixture
def days(spark, tmp_path):
    """Ten daily rows in chunks of two days, by time and user."""
    df = spark.createDataFrame([(day(d), d, f"k{d % 3}", d) for d in range(1, 11)], "ts timestamp_ntz, v long, k string, u long")
    return H.Hypertable.create(spark, str(tmp_path / "days"), df.schema, H.by_range("ts", "2 days"), H.by_hash("u", 2), stats=("v",), data=df)


def folders(df):
    return {f.rpartition("/")[0].partition("/data/")[2] for f in df.inputFiles()}


def held(chunks):
    return {p.partition("/data/")[2] for c in chunks for p in c["paths"]}


@pytest.mark.parametrize(
    "where",
    ["ts >= '2024-01-07'", "ts = TIMESTAMP_NTZ '2024-01-03'", "ts IN (TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-09')", "NOT (ts < TIMESTAMP_NTZ '2024-01-09')", "u = 4", "u IN (4, 5) AND ts < '2024-01-05'", "v > 9 OR v <= 1",
     "v BETWEEN 3 AND 4", "ts > now()", "ts < now() AND v = 5", "ts = NULL", "k = 'k1' OR ts < '2024-01-02'", "3 >= v", "u <=> 4", "v + 1 = 3", "true", "false", "u IN (1,2,3,4,5,6,7,8,9,10,11,12) AND ts < '2024-01-03'"],
)
def test_exclusion_is_right_and_reads_less(days, where):
    got = days.query(where)
    read = folders(got)
    rows = sorted(r.v for r in got.collect())
    days.optimize = False
    assert sorted(r.v for r in days.query(where).collect()) == rows
    every = held(days.chunks())
    days.optimize = True
    assert read <= every
    if where not in ("k = 'k1' OR ts < '2024-01-02'", "v + 1 = 3", "true"):
        assert len(read) < len(every)
    needed = {p for c in days.chunks() for p in c["paths"] if any(r.v in rows for r in days.read([c]).collect())}
    assert {p.partition("/data/")[2] for p in needed} <= read


def test_bucket_and_join_exclusion(spark, days):
    got = days.query(buckets=(("=", "2 days", datetime(2024, 1, 3) if bucket_value("2 days", day(3)) == day(3) else day(4)),))
    assert len(folders(got)) <= 2 and got.count() == 2
    few = spark.createDataFrame([(day(9),)], "ts timestamp_ntz")
    assert len(folders(days.joined_scan(few))) < len(held(days.chunks()))
    assert days.joined_scan(few).join(few, "ts").count() == 1
    assert days.extremes("v") == (1, 10) and days.only().count() == 0
    assert [r.v for r in days.scan(ranges={"v": (9, 9)}).collect()] == [9]


def test_merge_and_split_keep_ranges(spark, tmp_path):
    df = spark.createDataFrame([(day(d), None if d < 5 else d) for d in range(1, 9)], "ts timestamp_ntz, v long")
    t = H.Hypertable.create(spark, str(tmp_path / "t"), df.schema, H.by_range("ts", "2 days"), stats=("v",), data=df)
    spans = lambda: sorted((c["start"], c["end"]) for c in t.chunks())
    first = t.chunks()
    with pytest.raises(ValueError):
        t.merge_chunks([first[0]["id"], first[2]["id"]])
    t.merge_chunks([c["id"] for c in first[1:3]])  # the first has only nulls in v
    merged = spans()
    t.compress()
    assert spans() == merged and t.scan().count() == 8
    t.split_chunk(t.chunks()[1]["id"], day(4, 6))
    t.append(spark.createDataFrame([(day(4, 5), 50), (day(4, 7), 51), (day(20), 52)], df.schema))
    a = spans()
    assert all(x[1] <= y[0] for x, y in zip(a, a[1:], strict=False))
    assert all(c["start"] <= c["lo"] and c["hi"] < c["end"] for c in t.chunks())
    t.set_chunk_interval("3 days")
    t.append(spark.createDataFrame([(day(d, 1), d) for d in range(1, 25)], df.schema))
    a = spans()
    assert all(x[1] <= y[0] for x, y in zip(a, a[1:], strict=False)) and t.scan().count() == 35
    assert H.Hypertable.open(spark, t.root).scan().count() == 35


def test_upsert_rules(spark, days):
    row = lambda d, v, u: spark.createDataFrame([(day(d), v, "n", u)], days.schema)
    with pytest.raises(ValueError, match="partitioning"):
        H.upsert(days, row(5, 1, 1), ["u"])
    with pytest.raises(ValueError, match="second time"):
        H.upsert(days, row(5, 1, 5).union(row(5, 2, 5)), ["ts", "u"])
    before = held(days.chunks())
    got = H.upsert(days, row(5, 50, 5).union(row(6, 60, 99)), ["ts", "u"], returning=True)
    assert sorted((r.v, r.action) for r in got.collect()) == [(50, "update"), (60, "insert")]
    assert len(before - held(days.chunks())) == 1  # one chunk rewritten
    H.upsert(days, row(5, 70, 5).union(row(5, 71, 5)).union(row(7, 72, 98)).union(row(7, 73, 98)), ["ts", "u"], do="nothing")
    assert sorted(r.v for r in days.scan().collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 50, 60, 72]


def test_changes_touch_matched_chunks_only(days):
    days.compress()
    before = held(days.chunks())
    assert H.update(days, {"k": F.lit("z")}, "v = 4") == 1
    assert len(before - held(days.chunks())) == 1
    assert all(c["status"] & H.COMPRESSED for c in days.chunks())
    before, n = held(days.chunks()), len(days.chunks())
    gone = H.delete(days, "ts < '2024-01-03'", returning=True)
    assert sorted(r.v for r in gone.collect()) == [1, 2] and days.scan().count() == 8
    assert held(days.chunks()) < before and len(days.chunks()) < n
    frozen = days.chunks()[0]
    days.freeze(frozen["id"])
    for change in (lambda: H.delete(days, F.col("v") > 0), lambda: days.truncate(), lambda: days.compress(older_than=day(9)) or days.rewrite([frozen["id"]]), lambda: days.detach_chunk(frozen["id"])):
        with pytest.raises(ValueError, match="frozen"):
            change()
    days.freeze(frozen["id"], False)
    days.truncate()
    assert days.scan().count() == 0


def test_two_writers(spark, days):
    other = H.Hypertable.open(spark, days.root)
    days.append(days.scan().where("v = 1"))
    with pytest.raises(H.ConcurrentWrite):
        other.append(other.scan().where("v = 2"))
    assert H.Hypertable.open(spark, days.root).scan().count() == 11


def test_copy(spark, days, tmp_path):
    copy_to(days.scan(), str(tmp_path / "csv"), null="-")
    t = H.Hypertable.create(spark, str(tmp_path / "c"), days.schema, H.by_range("ts", "1 day"))
    assert copy_from(t, str(tmp_path / "csv"), where="v % 2 = 0", null="-") == 5
    assert sorted(map(tuple, t.scan().collect())) == sorted(tuple(r) for r in days.scan().collect() if r.v % 2 == 0)


# ---------------------------------------------------------------- continuous aggregates and jobs


def test_cagg_rules(spark, days, tmp_path):
    root = lambda: str(tmp_path / uuid.uuid4().hex)
    n = {"n": F.count("*")}
    for wrong in (Definition("1 day", [], {}), Definition(5, [], n), Definition("1 month 1 day", [], n), Definition("1 day", ["n"], n), Definition("0 days", [], n), Definition("1 day", [], n, joins=(Join(days.scan(), "u", "full"),)), Definition("1 day", [], n, joins=(Join(days, "u"),))):
        with pytest.raises(ValueError):
            ContinuousAggregate(days, root(), wrong)
    c = ContinuousAggregate(days, root(), Definition("1 day", [], n, materialized_only=True))
    for wrong in (Definition("36 hours", [], {"n": F.sum("n")}), Definition("1 day", [], {"n": F.sum("n")}, timezone="Asia/Tokyo")):
        with pytest.raises(ValueError):
            ContinuousAggregate(c, root(), wrong)
    month = ContinuousAggregate(days, root(), Definition("1 month", [], n))
    with pytest.raises(ValueError):
        ContinuousAggregate(month, root(), Definition("60 days", [], {"n": F.sum("n")}))
    with pytest.raises(ValueError, match="too small"):
        c.refresh(day(3, 1), day(3, 20))
    assert c.refresh(day(3), day(6)) == 1 and c.view().count() == 3
    assert days.state["threshold"] == days.to_internal(day(6)) and days.state["changes"] == []
    days.append(days.scan().where("v IN (4, 8)"))  # from below the threshold to above it
    assert len(days.state["changes"]) == 1
    days.append(days.scan().where("v = 9"))
    assert len(days.state["changes"]) == 1  # nothing there was ever materialised
    assert c.refresh(day(3), day(6)) == 1 and {r.bucket: r.n for r in c.view().collect()} == {day(3): 1, day(4): 2, day(5): 1}
    assert c.refresh(day(3), day(6)) == 0
    held_by_other = c._register(days.to_internal(day(1)), days.to_internal(day(4)))
    with pytest.raises(ValueError, match="overlapping"):
        c.refresh()
    c.files.delete(held_by_other)
    assert c.refresh() == 2 and sum(r.n for r in c.view().collect()) == 13
    c.add_column("total", F.sum("v"))
    assert {r.total for r in c.view().collect()} == {None}
    c.refresh(force=True)
    assert sum(r.total for r in c.view().collect()) == 55 + 4 + 8 + 9


def test_job_state_outlives_the_process(spark, days, tmp_path):
    s = Scheduler(days.files, str(tmp_path))
    job = s.add_retention_policy(days, timedelta(days=5), name="retention")
    s.add_job(lambda c, now: 1 / 0, timedelta(hours=1), name="fails")
    assert len(s.run_pending(day(11))) == 2
    assert days.scan().agg(F.min("v")).first()[0] >= 5
    again = Scheduler(days.files, str(tmp_path))
    assert again.add_retention_policy(days, timedelta(days=5), name="retention") == job
    assert again.run_pending(day(11, 1)) == []
    stats = {r.job_id: r for r in views.job_stats(spark, again).collect()}
    assert stats[job].total_successes == 1
    assert [r.error for r in views.job_errors(spark, again).collect()] == ["division by zero"]
    assert again.add_job(lambda c, now: None, timedelta(hours=1)) > job + 1


def test_policies(days, tmp_path):
    s = Scheduler()
    s.add_compression_policy(days, timedelta(days=5))
    c = ContinuousAggregate(days, str(tmp_path / "c"), Definition("1 day", [], {"n": F.count("*")}))
    s.add_refresh_policy(c, None, timedelta(days=1), timedelta(hours=1))
    s.add_compaction_policy(days)
    s.run_pending(day(11))
    assert all(h[2] for h in s.history)
    assert 0 < sum(bool(x["status"] & H.COMPRESSED) for x in days.chunks()) < len(days.chunks())
    assert c.state["watermark"] == days.to_internal(day(10))


# ---------------------------------------------------------------- edges


@pytest.mark.parametrize(
    "zone, at, want",
    [("Asia/Amman", datetime(2021, 3, 26, 12), datetime(2021, 3, 25, 22)), ("Europe/Berlin", datetime(2025, 10, 26, 12), datetime(2025, 10, 25, 22)), ("Europe/Berlin", datetime(2025, 10, 27, 0), datetime(2025, 10, 26, 23)), ("America/New_York", datetime(2024, 11, 3, 12), datetime(2024, 11, 3, 4)), ("America/New_York", datetime(2024, 11, 4, 6), datetime(2024, 11, 4, 5))],
)
def test_zoned_days(spark, tmp_path, zone, at, want):
    df = spark.createDataFrame([(at, 1)], "ts timestamp_ntz, v long")
    assert df.select(time_bucket("1 day", F.col("ts"), "timestamp_ntz", timezone=zone).alias("b")).first().b == want
    t = H.Hypertable.create(spark, str(tmp_path / "t"), df.schema, H.by_range("ts"))
    c = ContinuousAggregate(t, str(tmp_path / "c"), Definition("1 day", [], {"n": F.count("*")}, timezone=zone))
    assert c._floor(t.to_internal(at)) == t.to_internal(want)


def test_bookend_nulls(spark):
    rows = [(None, 9.0), (1, None), (2, 5.0), (7, None)]
    got = spark.createDataFrame(rows, "t int, v double").agg(A.first(F.col("v"), F.col("t")).alias("f"), A.last(F.col("v"), F.col("t")).alias("l")).first()
    assert (got.f, got.l) == (None, None)
    got = spark.createDataFrame([(None, 9.0), (3, 5.0)], "t int, v double").agg(A.first(F.col("v"), F.col("t")).alias("f")).first()
    assert got.f == 5.0


def test_gapfill_ends(spark):
    df = spark.createDataFrame([(3, 30), (5, 50)], "t int, v long")
    point = lambda x, y: F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"))
    out = gapfill(df, Gapfill(1, "t", 0, 8), {"v": F.max("v")}, {"v": Fill("interpolate", prev=point(-2, -20), next=point(10, 100))})
    assert [r.v for r in out.orderBy("bucket").collect()] == [0, 10, 20, 30, 40, 50, 60, 70]
    out = gapfill(df, Gapfill(1, "t", 0, 7), {"v": F.max("v")}, {"v": Fill("locf", prev=F.lit(-1).cast("long"))})
    assert [r.v for r in out.orderBy("bucket").collect()] == [-1, -1, -1, 30, 30, 50, 50]


def test_uuid_bucket_refuses_other_versions(spark):
    df = spark.createDataFrame([("5f8b1c1e-0000-4000-8000-000000000000",)], "u string")
    with pytest.raises(Exception, match="not a version 7"):
        df.select(uuid7.bucket("1 hour", F.col("u"))).collect()


def test_interpolation_frames_are_linear(spark):
    """No frame runs from a row to the end of its group: such a frame is read anew for every row."""
    plan = catalogue.QUERIES["gapfill_interpolate"](spark, SF)._jdf.queryExecution().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("name", ["lateral_latest", "left_lateral"])
def test_newest_order_when_tasks_spill(spark, tmp_path, name):
    """Rows of a sort that spills come in any order of equal keys; orders without a date come last, and customers come twice or without a key."""
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT * FROM '{SF}/customer.parquet' UNION ALL (SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey < 5) UNION ALL (SELECT * REPLACE (NULL AS c_custkey) FROM '{SF}/customer.parquet' LIMIT 1)) TO '{tmp_path}/customer.parquet'")
        db.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_custkey % 4 > 0 OR o_orderkey % 2 = 0 AND o_custkey % 8 > 0 THEN o_orderdate END AS o_orderdate) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
        for t in ("customer", "orders"):
            db.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
        want = sorted(db.execute(catalogue.ORACLES[name]).fetchall(), key=str)
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "50")
    try:
        got = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    finally:
        conf.remove(key)
    assert got == want
