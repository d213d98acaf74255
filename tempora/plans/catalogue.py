"""Registered queries of the engine and their DuckDB counterparts.

A query that standard SQL expresses is one text for both engines; what is ours
(buckets, gap filling, bookends, histograms, hypertables, continuous
aggregates) is built from the library and compared with DuckDB's own SQL.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import uuid7
from ..functions.buckets import bucket_int, bucket_range, time_bucket
from ..operators.gapfill import Fill, Gapfill, gapfill
from ..operators.skipscan import latest_by
from ..sources import hypertable as H
from ..sources.copy import copy_from, copy_to
from . import views
from .cagg import ContinuousAggregate, Definition, Join, answer, roll_up, usable

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = "region nation customer supplier part orders lineitem events".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """One SQL text for both engines, duck where DuckDB spells it otherwise."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql
        for t in used:
            text = re.sub(rf"\b{t}\b(?!\.)", "{" + t + "}", text)
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name], ORACLES[name] = run, duck or sql


def scratch(spark: SparkSession) -> str:
    """A folder for a query's tables, in the shared one of spark.checkpoint.dir; only local mode may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tempora-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- buckets


def bucket_count(name: str, source: str, column: str, width: str, duck: str, **options) -> None:
    @register(name, f"SELECT {duck} AS bucket, count(*) AS n FROM {source} GROUP BY 1")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return df.groupBy(time_bucket(width, F.col(column), "timestamp_ntz", **options).alias("bucket")).agg(F.count("*").alias("n"))


for _name, _source, _column, _width in (("bucket_15min", "events", "ts", "15 minutes"), ("bucket_hour", "events", "ts", "1 hour"), ("bucket_day", "events", "ts", "1 day"), ("bucket_week", "events", "ts", "7 days"), ("bucket_13d", "orders", "o_orderdate", "13 days"), ("bucket_month", "orders", "o_orderdate", "1 month"), ("bucket_5mon", "orders", "o_orderdate", "5 months")):
    bucket_count(_name, _source, _column, _width, f"time_bucket(INTERVAL '{_width}', {_column})::TIMESTAMP")
bucket_count("bucket_offset", "events", "ts", "1 hour", "time_bucket(INTERVAL '1 hour', ts - INTERVAL '15 minutes') + INTERVAL '15 minutes'", offset="15 minutes")
bucket_count("bucket_origin", "orders", "o_orderdate", "7 days", "time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '2000-01-01')", origin=datetime(2000, 1, 1))


@register("bucket_timezone", "SELECT timezone('America/New_York', time_bucket(INTERVAL '1 day', timezone('America/New_York', timezone('UTC', ts)))) AT TIME ZONE 'UTC' AS bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_timezone(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(time_bucket("1 day", F.col("ts"), "timestamp_ntz", timezone="America/New_York").alias("bucket")).agg(F.count("*").alias("n"))


@register("bucket_int", "SELECT (floor(o_orderkey / 1000.0) * 1000)::BIGINT AS bucket, count(*) AS n FROM orders GROUP BY 1")
def bucket_int_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(bucket_int(1000, F.col("o_orderkey")).alias("bucket")).agg(F.count("*").alias("n"))


@register("bucket_int_offset", "SELECT (floor((o_orderkey - 7) / 100.0) * 100 + 7)::BIGINT AS bucket, count(*) AS n FROM orders GROUP BY 1")
def bucket_int_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(bucket_int(100, F.col("o_orderkey"), 7).alias("bucket")).agg(F.count("*").alias("n"))


@register("bucket_date", "SELECT time_bucket(INTERVAL '10 days', l_shipdate::DATE)::DATE AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_date(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(time_bucket("10 days", F.col("l_shipdate").cast("date"), "date").alias("bucket")).agg(F.count("*").alias("n"))


@register("uuid7_round_trip", "SELECT event_id, time_bucket(INTERVAL '1 millisecond', ts) AS t, 7 AS version FROM events")
def uuid7_round_trip(spark, sf_dir):
    u = table(spark, sf_dir, "events").withColumn("u", uuid7.to_uuidv7(F.col("ts")))
    return u.select("event_id", uuid7.timestamp(F.col("u")).cast("timestamp_ntz").alias("t"), uuid7.version(F.col("u")).alias("version"))


# ---------------------------------------------------------------- bookends, histogram


@register(
    "ohlc",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, arg_min_null(value, (ts, event_id)) AS open, "
    "max(value) AS high, min(value) AS low, arg_max_null(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2",
)
def ohlc(spark, sf_dir):
    key, v = F.struct("ts", "event_id"), F.col("value")
    return table(spark, sf_dir, "events").groupBy(time_bucket("1 hour", F.col("ts"), "timestamp_ntz").alias("bucket"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), A.first(v, key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), A.last(v, key).alias("close")
    )


@register("first_last", "SELECT user_id, arg_min_null(event_type, (ts, event_id)) AS first_type, arg_max_null(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def first_last(spark, sf_dir):
    key, v = F.struct("ts", "event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(A.first(v, key).alias("first_type"), A.last(v, key).alias("last_type"))


@register("histogram_value", "SELECT event_type, [" + ", ".join(["count(*) FILTER (value < 0)::INT", *[f"count(*) FILTER (value >= {20 * i} AND value < {20 * i + 20})::INT" for i in range(5)], "count(*) FILTER (value >= 100)::INT"]) + "] AS h FROM events GROUP BY 1")
def histogram_value(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(A.histogram(F.col("value"), 0.0, 100.0, 5).alias("h"))


# ---------------------------------------------------------------- gap filling

START, FINISH = datetime(2024, 1, 1), datetime(2024, 2, 1)
_GRID = """
WITH e AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, event_type, count(*) AS n, sum(event_id) AS v, true AS re FROM events GROUP BY 1, 2),
k AS (SELECT DISTINCT event_type FROM e),
s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:59:59', INTERVAL '5 minutes')) AS bucket),
g AS (SELECT bucket, event_type FROM s CROSS JOIN k UNION SELECT bucket, event_type FROM e),
f AS (SELECT g.bucket, g.event_type, n, v::BIGINT AS v, coalesce(re, false) AS re FROM g LEFT JOIN e ON e.bucket = g.bucket AND e.event_type = g.event_type)
"""


def filled(spark, sf_dir, fill: Fill | None) -> DataFrame:
    """All events by five minutes and type; most buckets have none."""
    spec = Gapfill("5 minutes", "ts", START, FINISH, ["event_type"])
    return gapfill(table(spark, sf_dir, "events"), spec, {"n": F.count("*"), "v": F.sum("event_id")}, {"v": fill} if fill else {})


@register("gapfill_basic", _GRID + "SELECT bucket, event_type, n, v FROM f")
def gapfill_basic(spark, sf_dir):
    return filled(spark, sf_dir, None)


@register("gapfill_locf", _GRID + "SELECT bucket, event_type, n, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket) AS v FROM f")
def gapfill_locf(spark, sf_dir):
    return filled(spark, sf_dir, Fill("locf"))


@register("gapfill_locf_prev", _GRID + "SELECT bucket, event_type, n, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket), -1) AS v FROM f")
def gapfill_locf_prev(spark, sf_dir):
    return filled(spark, sf_dir, Fill("locf", prev=F.lit(-1).cast("long")))


_LINE = """, p AS (SELECT *, last_value(CASE WHEN re THEN epoch_us(bucket) END IGNORE NULLS) OVER b AS x0, last_value(v IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN re THEN epoch_us(bucket) END IGNORE NULLS) OVER a AS x1, first_value(v IGNORE NULLS) OVER a AS y1, epoch_us(bucket) AS x FROM f
  WINDOW b AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT bucket, event_type, n, CASE WHEN re THEN v ELSE round((y0::DOUBLE * (x1 - x) + y1::DOUBLE * (x - x0)) / (x1 - x0))::BIGINT END AS v FROM p"""


@register("gapfill_interpolate", _GRID + _LINE)
def gapfill_interpolate(spark, sf_dir):
    return filled(spark, sf_dir, Fill("interpolate"))


@register("gapfill_lookup", _GRID + "SELECT * FROM (" + _LINE.replace(", p AS", "WITH p AS", 1) + ") WHERE bucket >= TIMESTAMP '2024-01-10' AND bucket < TIMESTAMP '2024-01-20'")
def gapfill_lookup(spark, sf_dir):
    """Ten days, whose open ends meet the last bucket before them and the first one after them, looked up by type."""
    events, low, high = table(spark, sf_dir, "events"), datetime(2024, 1, 10), datetime(2024, 1, 20)
    ts, aggregates = F.col("ts"), {"n": F.count("*"), "v": F.sum("event_id")}
    start, finish = (F.lit(t).cast("timestamp_ntz") for t in (low, high))
    outside = events.where((ts < start) | (ts >= finish)).select(F.col("event_type").alias("kind"), "ts", "event_id")
    buckets = outside.groupBy("kind", time_bucket("5 minutes", ts, "timestamp_ntz").alias("b")).agg(aggregates["v"].alias("y"))
    point = F.struct(F.unix_micros(F.col("b").cast("timestamp")).alias("x"), "y")

    def record(side, pick):
        ends = buckets.where(side).groupBy("kind").agg(pick(point, F.col("b")).alias("r"))
        return ends.where(F.col("kind") == F.col("event_type").outer()).select("r").scalar()

    fill = Fill("interpolate", prev=record(F.col("b") < start, F.max_by), next=record(F.col("b") >= finish, F.min_by))
    return gapfill(events.where((ts >= start) & (ts < finish)), Gapfill("5 minutes", "ts", low, high, ["event_type"]), aggregates, {"v": fill})


@register("gapfill_window", _GRID + ", l AS (SELECT bucket, event_type, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket) AS v FROM f) SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY bucket) AS before FROM l")
def gapfill_window(spark, sf_dir):
    out = filled(spark, sf_dir, Fill("locf")).drop("n")
    return out.withColumn("before", F.lag("v").over(Window.partitionBy("event_type").orderBy("bucket")))


# ---------------------------------------------------------------- hypertables, continuous aggregates


def event_table(spark, sf_dir, rows: DataFrame | None = None, **options) -> H.Hypertable:
    df = table(spark, sf_dir, "events")
    return H.Hypertable.create(spark, scratch(spark), df.schema, H.by_range("ts", "1 day"), H.by_hash("user_id", 2), data=df if rows is None else rows, **options)


@register("time_pruned_scan", "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def time_pruned_scan(spark, sf_dir):
    return event_table(spark, sf_dir).scan(datetime(2024, 1, 10), datetime(2024, 1, 12, 6)).select("event_id", "ts", "event_type")


@register("bucket_pruned_scan", "SELECT event_id FROM events WHERE time_bucket(INTERVAL '7 days', ts) = TIMESTAMP '2024-01-08'")
def bucket_pruned_scan(spark, sf_dir):
    low, high = bucket_range("=", "7 days", datetime(2024, 1, 8))
    df = event_table(spark, sf_dir).scan(low, high)
    return df.where(time_bucket("7 days", F.col("ts"), "timestamp_ntz") == F.lit(datetime(2024, 1, 8)).cast("timestamp_ntz")).select("event_id")


@register("space_pruned_scan", "SELECT event_id FROM events WHERE user_id = 7")
def space_pruned_scan(spark, sf_dir):
    return event_table(spark, sf_dir).scan(space_value=7).select("event_id")


@register("chunk_counts", "SELECT (floor(epoch_us(ts) / 86400000000.0) * 86400000000)::BIGINT AS range_start, count(*)::BIGINT AS row_count FROM events GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return event_table(spark, sf_dir).chunk_table().groupBy("range_start").agg(F.sum("rows").alias("row_count"))


@register("compressed_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def compressed_scan(spark, sf_dir):
    t = H.Hypertable.create(spark, scratch(spark), table(spark, sf_dir, "events").schema, H.by_range("ts", "7 days"), segmentby=("event_type",), bloom=("event_type",), data=table(spark, sf_dir, "events"))
    t.compress()
    return t.scan().groupBy("event_type").agg(F.count("*").alias("n"))


@register("retention", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def retention(spark, sf_dir):
    t = event_table(spark, sf_dir)
    t.drop_chunks(older_than=datetime(2024, 1, 15))
    return t.scan().agg(F.count("*").alias("n"))


@register("delete_range", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-10')")
def delete_range(spark, sf_dir):
    t = event_table(spark, sf_dir)
    H.delete(t, (F.col("event_type") == "view") & (F.col("ts") < F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")), high=datetime(2024, 1, 10))
    return t.scan().select("event_id")


@register("update_range", "SELECT event_id, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value FROM events")
def update_range(spark, sf_dir):
    t = event_table(spark, sf_dir)
    H.update(t, {"value": F.col("value") * 2}, F.col("event_type") == "click")
    return t.scan().select("event_id", "value")


@register("upsert_latest", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'new' ELSE event_type END AS event_type FROM events")
def upsert_latest(spark, sf_dir):
    t = event_table(spark, sf_dir)
    H.upsert(t, table(spark, sf_dir, "events").where("event_id % 10 = 0").withColumn("event_type", F.lit("new")), ["event_id", "ts", "user_id"])
    return t.scan().select("event_id", "event_type")


@register("upsert_nothing", "SELECT event_id, event_type FROM events")
def upsert_nothing(spark, sf_dir):
    t = event_table(spark, sf_dir, table(spark, sf_dir, "events").where("event_id % 2 = 0"))
    H.upsert(t, table(spark, sf_dir, "events"), ["event_id", "ts", "user_id"], do="nothing")
    return t.scan().select("event_id", "event_type")


@register("merge_rows", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'merged' ELSE event_type END AS event_type FROM events")
def merge_rows(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    t = event_table(spark, sf_dir, df.where("event_id % 2 = 0"))
    H.merge(t, df.where("event_id % 2 = 1 OR event_id % 3 = 0").withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "merged").otherwise(F.col("event_type"))), ["event_id", "ts", "user_id"])
    return t.scan().select("event_id", "event_type")


_HOURLY = "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 2"


def hourly() -> Definition:
    return Definition("1 hour", ["event_type"], {"n": F.count("*"), "high": F.max("value")})


@register("cagg_refresh_realtime", _HOURLY)
def cagg_refresh_realtime(spark, sf_dir):
    t = event_table(spark, sf_dir)
    c = ContinuousAggregate(t, scratch(spark), hourly())
    c.refresh(end=datetime(2024, 1, 20))
    return c.view()


@register("cagg_late_data", _HOURLY)
def cagg_late_data(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    t = event_table(spark, sf_dir, df.where("event_id % 7 <> 0"))
    c = ContinuousAggregate(t, scratch(spark), hourly())
    c.refresh()
    t.append(df.where("event_id % 7 = 0"))
    c.refresh()
    return c.view()


@register("cagg_hierarchical", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1")
def cagg_hierarchical(spark, sf_dir):
    c = ContinuousAggregate(event_table(spark, sf_dir), scratch(spark), hourly())
    c.refresh()
    return roll_up(c, "1 day", {"n": F.sum("n")})


@register("cagg_rewrite", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def cagg_rewrite(spark, sf_dir):
    t = event_table(spark, sf_dir)
    c = ContinuousAggregate(t, scratch(spark), hourly())
    c.refresh()
    query = Definition("1 hour", ["event_type"], {"events": F.count("*")})
    assert usable(c, t, query)  # else the rows would answer, and the result would not show it
    return answer([c], t, query)


@register("asof_join", "SELECT a.event_id, b.event_id AS click_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("click_id", F.last(click, True).over(w)).where("event_type = 'purchase'").select("event_id", "click_id")


# ---------------------------------------------------------------- general relational layer

shared("moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
shared("lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
shared("rank_users", "SELECT user_id, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY n DESC) AS BIGINT) AS d, round(percent_rank() OVER (ORDER BY n DESC), 6) AS p FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) q")
shared("ntile_buckets", "SELECT event_id, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS BIGINT) AS q FROM events")
shared("first_nth_value", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
@register("distinct_on_latest", "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on_latest(spark, sf_dir):
    return latest_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


shared("top_k_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
shared("limit_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 15")
shared("nulls_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN value END DESC NULLS FIRST, event_id) AS BIGINT) AS r FROM events")
shared("distinct_types", "SELECT DISTINCT event_type, user_id % 10 AS slot FROM events")
shared("inner_join", "SELECT o.o_orderkey, c.c_custkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
shared("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")
shared("right_join", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")
shared("full_join", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 3")
shared("cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
shared("using_join", "SELECT a.event_id, b.event_type FROM events a JOIN (SELECT event_id, event_type FROM events WHERE value > 50) b USING (event_id)")
shared("theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
shared("semi_join", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
shared("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
shared("anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
shared("not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9700)")


def newest_orders(customers: DataFrame, orders: DataFrame, how: str) -> DataFrame:
    """Each customer with the key of their newest order, as LATERAL (... ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1).

    Spark's own LATERAL drops the order where the inner query doesn't return the
    date, and so takes whichever order comes first. Orders without a date count as the oldest.
    """
    dated = orders.select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderdate").isNotNull().alias("dated"))
    newest = latest_by(dated, ["o_custkey"], ["dated", "o_orderdate", "o_orderkey"])
    return customers.join(newest, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")


@register("lateral_latest", "SELECT c.c_custkey, l.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) l")
def lateral_latest(spark, sf_dir):
    return newest_orders(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "inner")


shared("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c")
shared("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, round(total, 2) AS total FROM big WHERE total > 1000000")
shared("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
shared("union_all", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
shared("union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
shared("except_rows", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
shared("intersect_rows", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
shared("agg_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS lo, max(l_shipdate) AS hi, min(l_linestatus) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
shared("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
shared("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
shared("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
shared("filter_agg", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS many FROM events GROUP BY event_type")
shared("having_agg", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12")
shared("distinct_agg", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
shared("stddev_var", "SELECT event_type, round(stddev_samp(value), 5) AS s, round(var_pop(value), 5) AS v, round(stddev_pop(value), 5) AS sp, round(var_samp(value), 5) AS vs FROM events GROUP BY event_type")
shared("corr_regr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS v, round(regr_slope(l_extendedprice, l_quantity), 4) AS s FROM lineitem")
shared("bool_bit_agg", "SELECT event_type, bool_and(value > 0) AS a, bool_or(value > 90) AS o, bit_or(user_id) AS b FROM events GROUP BY event_type")
shared("sum_bigint", "SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38, 0))) AS DECIMAL(38, 0)) AS total FROM orders")
shared("percentile", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median FROM events GROUP BY event_type")
shared("funnel_case", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, coalesce(nullif(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 0), -1) AS bought FROM events GROUP BY user_id", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views, coalesce(nullif(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 0), -1)::BIGINT AS bought FROM events GROUP BY user_id")
shared("json_extract", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
shared("like_in_between", "SELECT event_id FROM events WHERE (event_type LIKE 'p%' OR event_type NOT LIKE '%i%') AND user_id IN (1, 2, 3, 5, 8, 13) AND value BETWEEN 10 AND 90")
shared("null_tests", "SELECT event_id FROM events WHERE nullif(user_id, 3) IS NULL OR event_type IS DISTINCT FROM 'view'")
shared("greatest_least", "SELECT event_id, greatest(value, 50.0) AS g, least(value, 50.0) AS l FROM events")
shared("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) AS t FROM orders", None)
shared("string_functions", "SELECT event_id, upper(left(event_type, 3)) || '-' || substring(event_type, 2, 2) AS s FROM events")
shared("math_functions", "SELECT event_id, ceil(value) AS c, round(sqrt(value + 1), 6) AS s, round(pow(value, 2), 4) AS p FROM events")


@register("array_string_agg", "SELECT user_id, list(event_id ORDER BY event_id) AS ids, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def array_string_agg(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@register("unnest", "SELECT event_id, unnest(range(1, 4)) AS i FROM events")
def unnest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("i"))


@register("generate_series", "SELECT unnest(generate_series(TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-03', INTERVAL '6 hours')) AS t")
def generate_series(spark, sf_dir):
    return spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-31', TIMESTAMP_NTZ '2024-02-03', INTERVAL 6 HOURS)) AS t")


# ---------------------------------------------------------------- predicates, layout and changes of hypertables


@register("query_predicate", "SELECT event_id FROM events WHERE (user_id IN (3, 7) OR value > 95) AND ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-20'")
def query_predicate(spark, sf_dir):
    t = event_table(spark, sf_dir, stats=("event_id",))
    return t.query("(user_id IN (3, 7) OR value > 95) AND ts BETWEEN TIMESTAMP_NTZ '2024-01-09' AND TIMESTAMP_NTZ '2024-01-20'").select("event_id")


@register("query_now", "SELECT event_id FROM events WHERE ts < now()::TIMESTAMP - INTERVAL '1 day' AND ts >= TIMESTAMP '2024-01-28'")
def query_now(spark, sf_dir):
    return event_table(spark, sf_dir).query("ts < now() - INTERVAL 1 DAY AND ts >= TIMESTAMP_NTZ '2024-01-28'").select("event_id")


@register("query_bucket", "SELECT event_id FROM events WHERE time_bucket(INTERVAL '1 day', ts) >= TIMESTAMP '2024-01-25' AND event_type <> 'view'")
def query_bucket(spark, sf_dir):
    return event_table(spark, sf_dir).query("event_type <> 'view'", buckets=((">=", "1 day", datetime(2024, 1, 25)),)).select("event_id")


@register("chunk_skipping", "SELECT event_id FROM events WHERE event_id BETWEEN 2000 AND 2500")
def chunk_skipping(spark, sf_dir):
    return event_table(spark, sf_dir, stats=("event_id",)).query("event_id BETWEEN 2000 AND 2500").select("event_id")


@register("joined_scan", "SELECT e.event_id FROM events e JOIN (SELECT ts FROM events WHERE event_id BETWEEN 500 AND 520) d ON e.ts = d.ts")
def joined_scan(spark, sf_dir):
    few = table(spark, sf_dir, "events").where("event_id BETWEEN 500 AND 520").select("ts")
    return event_table(spark, sf_dir).joined_scan(few).join(few, "ts").select("event_id")


@register("table_extremes", "SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi, min(event_id) AS first_id, max(event_id) AS last_id FROM events")
def table_extremes(spark, sf_dir):
    t = event_table(spark, sf_dir, stats=("event_id",))
    return spark.createDataFrame([(*t.extremes("ts"), *t.extremes("event_id"))], "lo long, hi long, first_id long, last_id long")


@register("ordered_latest", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 25")
def ordered_latest(spark, sf_dir):
    return event_table(spark, sf_dir).latest(25, "event_type = 'click'").select("event_id", "ts")


def daily(spark, sf_dir, **options) -> H.Hypertable:
    df = table(spark, sf_dir, "events")
    return H.Hypertable.create(spark, scratch(spark), df.schema, H.by_range("ts", "1 day"), data=df, **options)


@register("merge_then_compress", "SELECT (floor(epoch_us(ts) / 172800000000.0) * 172800000000)::BIGINT AS range_start, (floor(epoch_us(ts) / 172800000000.0) * 172800000000 + 172800000000)::BIGINT AS range_end, count(*)::BIGINT AS row_count FROM events GROUP BY 1, 2")
def merge_then_compress(spark, sf_dir):
    """Pairs of daily chunks become one, are compressed and hold what they held."""
    t = daily(spark, sf_dir)
    by: dict = {}
    for c in t.chunks():
        by.setdefault(c["start"] // (2 * 86_400_000_000), []).append(c)
    for pair in by.values():
        if len(pair) == 2:
            t.merge_chunks([c["id"] for c in pair])
    t.compress()
    t.append(t.scan().where("false"))
    own, day = t.chunk_table(), 86_400_000_000
    whole = own.select((F.floor(F.col("range_start") / (2 * day)) * 2 * day).alias("range_start"), "rows")
    return whole.groupBy("range_start").agg(F.sum("rows").alias("row_count")).select("range_start", (F.col("range_start") + 2 * day).alias("range_end"), "row_count")


@register("split_then_scan", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-04 18:00:00'")
def split_then_scan(spark, sf_dir):
    t = daily(spark, sf_dir)
    for c in t.chunks(datetime(2024, 1, 3), datetime(2024, 1, 5)):
        t.split_chunk(c["id"])
    t.compress()
    return t.scan(datetime(2024, 1, 3, 6), datetime(2024, 1, 4, 18)).select("event_id", "ts")


@register("upsert_time_key", "SELECT event_id, ts, CASE WHEN event_id % 4 = 0 AND value < 50 THEN -value ELSE value END AS value FROM events")
def upsert_time_key(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    t = daily(spark, sf_dir)
    H.upsert(t, df.where("event_id % 4 = 0").withColumn("value", -F.col("value")), ["event_id", "ts"], where=F.col("old_value") < 50)
    return t.scan().select("event_id", "ts", "value")


@register("update_compressed", "SELECT event_id, CASE WHEN user_id = 7 THEN 'seven' ELSE event_type END AS event_type FROM events")
def update_compressed(spark, sf_dir):
    t = event_table(spark, sf_dir, segmentby=("event_type",), bloom=("event_type",))
    t.compress()
    H.update(t, {"event_type": F.lit("seven")}, "user_id = 7")
    return t.scan().select("event_id", "event_type")


@register("update_moves_rows", "SELECT event_id, CASE WHEN event_type = 'error' THEN ts + INTERVAL '40 days' ELSE ts END AS ts FROM events WHERE event_type = 'error' OR ts < TIMESTAMP '2024-01-05'")
def update_moves_rows(spark, sf_dir):
    t = daily(spark, sf_dir)
    H.update(t, {"ts": F.expr("ts + INTERVAL 40 DAYS")}, "event_type = 'error'")
    early, late = t.scan(high=datetime(2024, 1, 5)), t.scan(low=datetime(2024, 2, 9))
    return early.unionByName(late).where("event_type = 'error' OR ts < TIMESTAMP_NTZ '2024-01-05'").select("event_id", "ts")


@register("delete_whole_chunk", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-12'")
def delete_whole_chunk(spark, sf_dir):
    t = daily(spark, sf_dir)
    t.compress()
    H.delete(t, "ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    return t.scan().select("event_id")


@register("returning_rows", "SELECT event_id, value AS old_value, value + 1 AS new_value FROM events WHERE user_id = 7")
def returning_rows(spark, sf_dir):
    got = H.update(event_table(spark, sf_dir), {"value": F.col("value") + 1}, "user_id = 7", returning=True)
    return got.select("new.event_id", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@register("merge_delete", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 3 = 0 OR event_id % 5 <> 0")
def merge_delete(spark, sf_dir):
    t = daily(spark, sf_dir)
    df = table(spark, sf_dir, "events")
    H.merge(t, df.where("event_id % 3 = 0"), ["event_id", "ts"], matched={"value": F.col("t_value") * 2}, not_matched=False)
    H.merge(t, df.where("event_id % 3 <> 0 AND event_id % 5 = 0"), ["event_id", "ts"], matched="delete", not_matched=False)
    return t.scan().select("event_id", "value")


# ---------------------------------------------------------------- further continuous aggregates


@register("cagg_join", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, kind, count(*) AS n FROM events LEFT JOIN (SELECT DISTINCT event_type, upper(event_type) AS kind FROM events WHERE event_type <> 'view') d USING (event_type) GROUP BY 1, 2")
def cagg_join(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_type", F.upper("event_type").alias("kind")).distinct()
    c = ContinuousAggregate(event_table(spark, sf_dir), scratch(spark), Definition("1 day", ["kind"], {"n": F.count("*")}, joins=(Join(kinds, "event_type", "left"),)))
    c.refresh(end=datetime(2024, 1, 15))
    return c.view()


@register("cagg_on_cagg", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*)::BIGINT AS n, max(value) AS high FROM events GROUP BY 1, 2")
def cagg_on_cagg(spark, sf_dir):
    """Late rows reach the upper aggregate by the ranges that the lower one recomputed."""
    df = table(spark, sf_dir, "events")
    t = event_table(spark, sf_dir, df.where("event_id % 7 <> 0"))
    lower = ContinuousAggregate(t, scratch(spark), hourly())
    upper = ContinuousAggregate(lower, scratch(spark), Definition("1 day", ["event_type"], {"n": F.sum("n"), "high": F.max("high")}))
    lower.refresh(end=datetime(2024, 1, 20))
    upper.refresh()
    t.append(df.where("event_id % 7 = 0"))
    lower.refresh(end=datetime(2024, 1, 21))
    upper.refresh()
    return upper.view()


@register("cagg_month_tz", "SELECT timezone('America/New_York', date_trunc('month', timezone('America/New_York', timezone('UTC', ts)))) AT TIME ZONE 'UTC' AS bucket, count(*) AS n FROM events GROUP BY 1")
def cagg_month_tz(spark, sf_dir):
    c = ContinuousAggregate(event_table(spark, sf_dir), scratch(spark), Definition("1 month", [], {"n": F.count("*")}, timezone="America/New_York"))
    c.refresh()
    return c.view()


@register("cagg_batched", _HOURLY)
def cagg_batched(spark, sf_dir):
    c = ContinuousAggregate(event_table(spark, sf_dir), scratch(spark), hourly())
    c.refresh(buckets_per_batch=200, max_batches=2)
    c.refresh(buckets_per_batch=400)
    return c.view()


@register("cagg_after_retention", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, max(value) AS high FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def cagg_after_retention(spark, sf_dir):
    """Buckets of dropped chunks go when their range is refreshed."""
    t = event_table(spark, sf_dir)
    c = ContinuousAggregate(t, scratch(spark), hourly())
    c.refresh()
    t.drop_chunks(older_than=datetime(2024, 1, 15))
    c.refresh(end=datetime(2024, 1, 15), force=True)
    return c.view()


# ---------------------------------------------------------------- information, COPY, further functions


@register("view_chunks", "SELECT (floor(epoch_us(ts) / 86400000000.0) * 86400000000)::BIGINT AS range_start, count(*)::BIGINT AS row_count, true AS is_compressed FROM events GROUP BY 1")
def view_chunks(spark, sf_dir):
    t = daily(spark, sf_dir)
    t.compress()
    return views.chunks(spark, [t]).select("range_start", F.col("rows").alias("row_count"), "is_compressed")


@register("view_dimensions", "SELECT * FROM (VALUES (1, 'ts', 'timestamp_ntz', 'Time', 86400000000, NULL), (2, 'user_id', 'bigint', 'Space', NULL, 2)) v(dimension_number, column_name, column_type, dimension_type, time_interval_us, num_partitions)")
def view_dimensions(spark, sf_dir):
    return views.dimensions(spark, [event_table(spark, sf_dir)]).drop("hypertable", "integer_interval")


@register("view_hypertables", "SELECT 2 AS num_dimensions, false AS compression_enabled, 'ts' AS primary_dimension, count(*)::BIGINT AS approximate_rows FROM events")
def view_hypertables(spark, sf_dir):
    return views.hypertables(spark, [event_table(spark, sf_dir)]).select("num_dimensions", "compression_enabled", "primary_dimension", "approximate_rows")


@register("view_compression_settings", "SELECT * FROM (VALUES ('event_type', 1, NULL), ('user_id', NULL, 1), ('ts', NULL, 2)) v(column_name, segmentby_index, orderby_index)")
def view_compression_settings(spark, sf_dir):
    return views.compression_settings(spark, [event_table(spark, sf_dir, segmentby=("event_type",), orderby=("user_id",))]).drop("hypertable")


@register("view_continuous_aggregates", "SELECT '1 hour' AS bucket_width, false AS materialized_only, epoch_us(max(time_bucket(INTERVAL '1 hour', ts))) + 3600000000 AS watermark FROM events")
def view_continuous_aggregates(spark, sf_dir):
    c = ContinuousAggregate(event_table(spark, sf_dir), scratch(spark), hourly())
    c.refresh()
    return views.continuous_aggregates(spark, [c]).select("bucket_width", "materialized_only", "watermark")


@register("copy_in_out", "SELECT event_id, ts, user_id, event_type FROM events WHERE user_id > 50")
def copy_in_out(spark, sf_dir):
    path = f"{scratch(spark)}/csv"
    copy_to(table(spark, sf_dir, "events"), path, header=True, delimiter=";")
    t = H.Hypertable.create(spark, scratch(spark), table(spark, sf_dir, "events").schema, H.by_range("ts", "7 days"))
    copy_from(t, path, where="user_id > 50", header=True, delimiter=";")
    return t.scan().select("event_id", "ts", "user_id", "event_type")


@register("chunk_append_order", "SELECT event_id, ts FROM events")
def chunk_append_order(spark, sf_dir):
    return daily(spark, sf_dir).ordered(descending=True).select("event_id", "ts")


@register("attach_detach", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-08' OR ts >= TIMESTAMP '2024-01-09'")
def attach_detach(spark, sf_dir):
    """Two chunks leave the table; one comes back where it was."""
    t = daily(spark, sf_dir)
    for c in t.chunks(datetime(2024, 1, 8), datetime(2024, 1, 10)):
        paths = t.detach_chunk(c["id"])
        if c["start"] >= t.to_internal(datetime(2024, 1, 9)):
            t.attach_chunk(paths[0], c["start"], c["end"])
    return t.scan().select("event_id")


@register("prepared_statement", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def prepared_statement(spark, sf_dir):
    return spark.sql("SELECT event_id FROM {events} WHERE event_type = :kind AND value > :least", args={"kind": "click", "least": 50}, events=table(spark, sf_dir, "events"))


def tablesample(spark, sf_dir):
    """A sample is the feature: one row in ten, by a fixed seed."""
    return table(spark, sf_dir, "events").sample(0.1, seed=7).select("event_id")


QUERIES["tablesample"] = tablesample


@register("user_aggregate", "SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS mean FROM events GROUP BY 1")
def user_aggregate(spark, sf_dir):
    """A caller's own aggregate in two steps, so that it is combined before the shuffle: a geometric mean."""
    parts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.ln(F.col("value") + 1)).alias("s"), F.count("value").alias("n"))
    return parts.select("event_type", F.round(F.exp(F.col("s") / F.col("n")), 6).alias("mean"))


@register("bucket_uuid", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_uuid(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(uuid7.to_uuidv7(F.col("ts")).alias("u"))
    return u.groupBy(uuid7.bucket("1 hour", F.col("u")).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@register("uuid7_boundary", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def uuid7_boundary(spark, sf_dir):
    u = table(spark, sf_dir, "events").withColumn("u", uuid7.to_uuidv7(F.col("ts")))
    return u.where(F.col("u") >= uuid7.to_uuidv7_boundary(F.lit(datetime(2024, 1, 15)))).select("event_id")


shared("avg_int", "SELECT event_type, round(avg(user_id), 6) AS a, round(stddev_samp(user_id), 5) AS s, round(var_pop(event_id), 2) AS v FROM events GROUP BY event_type")
shared("mode_agg", "SELECT l_returnflag, mode(l_linestatus) AS m FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'O' GROUP BY l_returnflag HAVING count(DISTINCT l_linestatus) = 1")
shared("range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM events")
shared("natural_join", "SELECT user_id, n, views FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a NATURAL JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY user_id) b")


@register("left_lateral", "SELECT c.c_custkey, l.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) l ON true")
def left_lateral(spark, sf_dir):
    return newest_orders(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000"), "left")


shared("boolean_equality", "SELECT event_id FROM (SELECT event_id, value > 50 AS high, user_id % 2 = 0 AS even FROM events) q WHERE high = even AND high IS TRUE")
shared("any_all", "SELECT event_id FROM events WHERE array_contains(array('click', 'view'), event_type) AND NOT array_contains(array(1, 2, 3), CAST(user_id AS INT))", "SELECT event_id FROM events WHERE event_type = ANY (['click', 'view']) AND user_id <> ALL (SELECT unnest([1, 2, 3]))")
shared("regex_functions", "SELECT event_id, regexp_replace(event_type, '[aeiou]', '*') AS r, event_type RLIKE '^(p|v)' AS m FROM events", "SELECT event_id, regexp_replace(event_type, '[aeiou]', '*', 'g') AS r, regexp_matches(event_type, '^(p|v)') AS m FROM events")
shared("date_format", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH24') AS d FROM events".replace("HH24", "HH"), "SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS d FROM events")
shared("date_difference", "SELECT o_orderkey, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days FROM orders")
shared("truncate_numbers", "SELECT event_id, CAST(value AS BIGINT) AS t, floor(value) AS f, abs(value - 50) AS a, mod(user_id, 7) AS m FROM events", "SELECT event_id, trunc(value)::BIGINT AS t, floor(value)::BIGINT AS f, abs(value - 50) AS a, user_id % 7 AS m FROM events")
shared("json_contains", "SELECT event_id FROM events WHERE CAST(get_json_object(props, '$.k') AS INT) = 3", "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 3}')")
shared("epoch_conversion", "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us, timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP))) = CAST(ts AS TIMESTAMP) AS same FROM events", "SELECT event_id, epoch_us(ts) AS us, true AS same FROM events")
