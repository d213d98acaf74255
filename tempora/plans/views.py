"""Informational views as DataFrames over manifests, aggregates and the job registry; a row an object, none a data row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.hypertable import COMPRESSED, FROZEN, PARTIAL, Hypertable
from .cagg import LOWEST, ContinuousAggregate
from .jobs import Scheduler


def hypertables(spark: SparkSession, tables: list[Hypertable]) -> DataFrame:
    rows = [(t.root, 1 + bool(t.state["space"]), len(t.state["chunks"]), any(c["status"] & COMPRESSED for c in t.state["chunks"]), t.state["time"], t.approximate_row_count(), t.size()) for t in tables]
    return spark.createDataFrame(rows, "hypertable string, num_dimensions int, num_chunks int, compression_enabled boolean, primary_dimension string, approximate_rows long, bytes long")


def dimensions(spark: SparkSession, tables: list[Hypertable]) -> DataFrame:
    rows = []
    for t in tables:
        whole = t.state["kind"] == "int"
        rows.append((t.root, 1, t.state["time"], t.schema[t.state["time"]].dataType.simpleString(), "Time", None if whole else t.state["interval"], t.state["interval"] if whole else None, None))
        if t.state["space"]:
            column, n = t.state["space"]
            rows.append((t.root, 2, column, t.schema[column].dataType.simpleString(), "Space", None, None, n))
    return spark.createDataFrame(rows, "hypertable string, dimension_number int, column_name string, column_type string, dimension_type string, time_interval_us long, integer_interval long, num_partitions int")


def chunks(spark: SparkSession, tables: list[Hypertable]) -> DataFrame:
    rows = [(t.root, c["id"], t.state["time"], c["start"], c["end"], c["space"], bool(c["status"] & COMPRESSED), bool(c["status"] & PARTIAL), bool(c["status"] & FROZEN), c["rows"], c["bytes"]) for t in tables for c in t.chunks()]
    return spark.createDataFrame(rows, "hypertable string, chunk_id long, primary_dimension string, range_start long, range_end long, space int, is_compressed boolean, is_partial boolean, is_frozen boolean, rows long, bytes long")


def compression_settings(spark: SparkSession, tables: list[Hypertable]) -> DataFrame:
    rows = []
    for t in tables:
        order = [*t.state["orderby"], *([] if t.state["time"] in t.state["orderby"] else [t.state["time"]])]
        rows += [(t.root, c, i, None) for i, c in enumerate(t.state["segmentby"], 1)] + [(t.root, c, None, i) for i, c in enumerate(order, 1)]
    return spark.createDataFrame(rows, "hypertable string, column_name string, segmentby_index int, orderby_index int")


def continuous_aggregates(spark: SparkSession, caggs: list[ContinuousAggregate]) -> DataFrame:
    rows = [(c.root, c.source.root, str(c.d.width), c.d.timezone, c.d.materialized_only, None if c.state["watermark"] == LOWEST else c.state["watermark"], len(c.state["parts"]), len(c.invalid())) for c in caggs]
    return spark.createDataFrame(rows, "view string, source string, bucket_width string, timezone string, materialized_only boolean, watermark long, parts int, invalid_ranges int")


def jobs(spark: SparkSession, scheduler: Scheduler) -> DataFrame:
    rows = [(j.id, getattr(j.action, "__name__", "action"), j.every.total_seconds(), j.retry_period.total_seconds(), j.max_retries, j.scheduled, j.next_start) for j in scheduler.jobs.values()]
    return spark.createDataFrame(rows, "job_id long, proc_name string, schedule_interval_s double, retry_period_s double, max_retries int, scheduled boolean, next_start timestamp_ntz")


def job_stats(spark: SparkSession, scheduler: Scheduler) -> DataFrame:
    rows = []
    for j in scheduler.jobs.values():
        own = [h for h in scheduler.history if h[0] == j.id]
        good = [h[1] for h in own if h[2]]
        rows.append((j.id, len(own), len(good), len(own) - len(good), max((h[1] for h in own), default=None), max(good, default=None), None if not own else "Success" if own[-1][2] else "Failed"))
    return spark.createDataFrame(rows, "job_id long, total_runs int, total_successes int, total_failures int, last_run timestamp_ntz, last_successful_finish timestamp_ntz, last_run_status string")


def job_history(spark: SparkSession, scheduler: Scheduler) -> DataFrame:
    return spark.createDataFrame([(h[0], h[1], h[2], h[3] or None) for h in scheduler.history], "job_id long, start_time timestamp_ntz, succeeded boolean, error string")


def job_errors(spark: SparkSession, scheduler: Scheduler) -> DataFrame:
    return job_history(spark, scheduler).where("NOT succeeded").drop("succeeded")
