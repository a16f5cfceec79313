"""A run ledger derived from the relational tables, row for row.

customer -> projects, orders -> runs, lineitem -> run pages, events -> project
events.  States and timestamps are functions of the stored keys and dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.sources.tables import load

PROJECT_STATES = (
    "QUEUED", "ANALYZING", "AWAITING_SETUP", "ANALYSIS_READY", "PREVIEWING", "PREVIEW_READY",
    "DISCOVERING", "EXTRACTING", "EXPORTING", "COMPLETED", "PAUSED", "FAILED", "CANCELED",
)
RUN_STATES = ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELED")
PAGE_STATES = ("PENDING", "FETCHING", "EXTRACTED", "BLOCKED", "FAILED")


def now():
    return F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))


def _pick(names, index):
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def _ntz(column):
    return F.col(column).cast("timestamp_ntz")


def projects(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    base = load(spark, folder, "customer").select(
        key.alias("project_id"),
        F.col("c_nationkey").alias("user_id"),
        _pick(PROJECT_STATES, key % 13).alias("state"),
        ((key % 100) / 100).alias("confidence"),
        (key % 4).alias("warning_count"),
        F.col("c_mktsegment").alias("page_type"),
    )
    from pagesieve.operators.ledger import promoted_runs

    return base.join(promoted_runs(runs(spark, folder)), "project_id", "left")


def runs(spark, folder) -> DataFrame:
    key, created = F.col("o_orderkey"), _ntz("o_orderdate")
    state = _pick(RUN_STATES, key % 5)
    return load(spark, folder, "orders").select(
        key.alias("run_id"),
        F.col("o_custkey").alias("project_id"),
        F.when(key % 11 != 0, key % 97).alias("spec_id"),
        state.alias("state"),
        (key % 4).alias("resume_count"),
        created.alias("created_at"),
        F.when(key % 5 != 0, created + F.make_dt_interval(hours=F.lit(1))).alias("started_at"),
        F.when(key % 5 >= 2, created + F.make_dt_interval(hours=F.lit(1), secs=(key % 2500))).alias("finished_at"),
        (key % 2500).alias("seconds"),
    )


def run_pages(spark, folder) -> DataFrame:
    part = F.col("l_partkey")
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_suppkey") * 1000000000 + part * 10 + F.col("l_linenumber")).alias("page_key"),
        _pick(PAGE_STATES, part % 5).alias("state"),
        F.col("l_linenumber").alias("depth"),
        F.when(part % 5 == 3, F.when(F.col("l_suppkey") % 3 == 0, "RATE_LIMITED").otherwise("ANTI_BOT_CHALLENGE"))
        .when((part % 5 == 4) & (F.col("l_suppkey") % 2 == 0), "SELECTOR_ZERO_MATCH")
        .alias("block_reason"),
        _ntz("l_shipdate").alias("updated_at"),
        _ntz("l_shipdate").alias("created_at"),
        _ntz("l_shipdate").alias("lease_expires_at"),
    )


def events(spark, folder) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("project_id"),
        (F.col("user_id") % 50).alias("user_id"),
        "event_type",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("debug").alias("level"),
        _ntz("ts").alias("created_at"),
        "value",
    )
