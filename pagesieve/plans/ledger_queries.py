"""Ledger, health, event and dashboard queries over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions import classify
from pagesieve.operators import ledger, ranked
from pagesieve.plans.registry import query
from pagesieve.sources import ledger as source
from pagesieve.sources.tables import load

_PS = "['" + "','".join(source.PROJECT_STATES) + "']"
LEDGER = f"""
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS project_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 97 END AS spec_id,
         ['QUEUED','RUNNING','COMPLETED','FAILED','CANCELED'][o_orderkey % 5 + 1] AS state, o_orderkey % 4 AS resume_count,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS started_at,
         CASE WHEN o_orderkey % 5 >= 2 THEN o_orderdate + INTERVAL 1 HOUR + to_seconds(o_orderkey % 2500) END AS finished_at,
         o_orderkey % 2500 AS seconds FROM orders),
current AS (SELECT project_id, max_by(run_id, (finished_at, run_id)) AS current_run_id FROM runs WHERE state = 'COMPLETED' GROUP BY 1),
projects AS (
  SELECT c_custkey AS project_id, c_nationkey AS user_id, {_PS}[c_custkey % 13 + 1] AS state, (c_custkey % 100) / 100 AS confidence,
         c_custkey % 4 AS warning_count, c_mktsegment AS page_type, current_run_id
  FROM customer LEFT JOIN current ON c_custkey = project_id),
run_pages AS (
  SELECT l_orderkey AS run_id, l_suppkey * 1000000000 + l_partkey * 10 + l_linenumber AS page_key,
         ['PENDING','FETCHING','EXTRACTED','BLOCKED','FAILED'][l_partkey % 5 + 1] AS state, l_linenumber AS depth,
         CASE WHEN l_partkey % 5 = 3 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'RATE_LIMITED' ELSE 'ANTI_BOT_CHALLENGE' END
              WHEN l_partkey % 5 = 4 AND l_suppkey % 2 = 0 THEN 'SELECTOR_ZERO_MATCH' END AS block_reason,
         l_shipdate AS updated_at FROM lineitem)"""
NOW = "TIMESTAMP '2000-01-01'"
EVENTS = """
ev AS (SELECT event_id, user_id AS project_id, user_id % 50 AS user_id, event_type,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'debug' END AS level, ts AS created_at, value FROM events)"""


def L(sql):
    return f"WITH {LEDGER} {sql}"


@query("ledger_display_run", L("""SELECT p.project_id, coalesce(max(r.run_id) FILTER (r.state IN ('QUEUED','RUNNING')), p.current_run_id) AS run_id
       FROM projects p LEFT JOIN runs r USING (project_id) GROUP BY p.project_id, p.current_run_id"""))
def ledger_display_run(spark, folder):
    return ledger.display_runs(source.projects(spark, folder), source.runs(spark, folder))


@query("ledger_progress", L("""SELECT run_id, count(*) AS pages_total, count(*) FILTER (state='PENDING') AS pages_pending, count(*) FILTER (state='FETCHING') AS pages_fetching,
       count(*) FILTER (state='EXTRACTED') AS pages_extracted, count(*) FILTER (state='BLOCKED') AS pages_blocked, count(*) FILTER (state='FAILED') AS pages_failed,
       count(*) FILTER (state IN ('EXTRACTED','BLOCKED','FAILED')) AS pages_done,
       round(count(*) FILTER (state IN ('EXTRACTED','BLOCKED','FAILED')) / count(*) * 100)::INT AS percent FROM run_pages GROUP BY run_id"""))
def ledger_progress(spark, folder):
    return ledger.progress(source.run_pages(spark, folder))


@query("ledger_blocked_pages", L("""SELECT run_id, page_key, block_reason, row_number() OVER (PARTITION BY run_id ORDER BY page_key) AS rank
       FROM run_pages WHERE state = 'BLOCKED' QUALIFY rank <= 100"""))
def ledger_blocked_pages(spark, folder):
    return ledger.page_details(source.run_pages(spark, folder), "BLOCKED", 100, "UNKNOWN")


@query("ledger_failed_pages", L("""SELECT run_id, page_key, coalesce(block_reason, 'FAILED') AS block_reason, row_number() OVER (PARTITION BY run_id ORDER BY page_key) AS rank
       FROM run_pages WHERE state = 'FAILED' QUALIFY rank <= 2"""))
def ledger_failed_pages(spark, folder):
    return ledger.page_details(source.run_pages(spark, folder), "FAILED", 2, "FAILED")


@query("ledger_claim_order", L("""SELECT run_id, depth, page_key, row_number() OVER (PARTITION BY run_id ORDER BY depth, page_key) AS rank
       FROM run_pages WHERE state = 'PENDING' QUALIFY rank <= 2"""))
def ledger_claim_order(spark, folder):
    return ledger.claim_order(source.run_pages(spark, folder), 2)


@query("ledger_run_outcome", L("""SELECT run_id, CASE WHEN ok = 0 AND n = 0 AND bots > 0 AND bots = blocked AND failed = 0 THEN 'BOT_PROTECTION_BLOCKED'
         WHEN ok = 0 AND n = 0 THEN 'ALL_PAGES_FAILED' WHEN run_id % 2 = 0 AND n = 0 THEN 'NO_RECORDS_EXTRACTED' ELSE 'COMPLETED' END AS outcome
       FROM (SELECT run_id, count(*) FILTER (state = 'EXTRACTED' OR (state = 'FAILED' AND block_reason = 'SELECTOR_ZERO_MATCH')) AS ok,
               count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (block_reason = 'ANTI_BOT_CHALLENGE') AS bots,
               count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'EXTRACTED' AND page_key % 3 = 0) AS n FROM run_pages GROUP BY run_id)"""))
def ledger_run_outcome(spark, folder):
    pages = source.run_pages(spark, folder)
    records = pages.filter((F.col("state") == "EXTRACTED") & (F.col("page_key") % 3 == 0)).groupBy("run_id").agg(F.count("*").alias("n_records"))
    return ledger.run_outcome(pages, records, F.col("run_id") % 2 == 0)


@query("ledger_page_outcome", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'FAILED' WHEN page_id % 5 = 0 THEN 'BLOCKED' WHEN page_id % 3 = 0 THEN 'FAILED' WHEN page_id % 4 = 0 THEN 'FAILED' ELSE 'EXTRACTED' END AS state,
       CASE WHEN page_id % 7 = 0 THEN 'TIMEOUT' WHEN page_id % 5 = 0 THEN 'ANTI_BOT_CHALLENGE' WHEN page_id % 3 = 0 THEN 'PAGE_DECODE_FAILED' WHEN page_id % 4 = 0 THEN 'SELECTOR_ZERO_MATCH' END AS reason FROM pages""")
def ledger_page_outcome(spark, folder):
    k = F.col("page_id")
    html = (
        F.when(k % 5 == 0, F.concat(F.lit('<div class="cf-turnstile"></div>'), F.col("html")))
        .when(k % 3 == 0, F.regexp_replace("html", r"[^\s<>]", "�"))
        .otherwise(F.col("html"))
    )
    done = classify.page_outcome(
        classify.challenge_reason(html, F.col("url")), classify.html_quality(html)["label"],
        F.when(k % 4 == 0, 0).otherwise(3), F.when(k % 7 == 0, F.lit("TIMEOUT")),
    )
    return load(spark, folder, "pages").select("page_id", done.alias("o")).select("page_id", "o.state", "o.reason")


@query("ledger_current_run", L("SELECT project_id, current_run_id FROM current"))
def ledger_current_run(spark, folder):
    return ledger.promoted_runs(source.runs(spark, folder))


@query("ledger_duplicate_active", L("SELECT project_id, count(*) AS n FROM runs WHERE state IN ('QUEUED','RUNNING') GROUP BY 1 HAVING count(*) > 1"))
def ledger_duplicate_active(spark, folder):
    return ledger.duplicate_active_runs(source.runs(spark, folder))


_ACTIVE = "('QUEUED','ANALYZING','PREVIEWING','DISCOVERING','EXTRACTING','EXPORTING')"


@query("ledger_admission", L(f"SELECT user_id, count(*) FILTER (state IN {_ACTIVE}) AS active, count(*) FILTER (state IN {_ACTIVE}) < 28 AS admitted FROM projects GROUP BY 1"))
def ledger_admission(spark, folder):
    return ledger.active_per_user(source.projects(spark, folder), 28)


@query("ledger_dashboard_tiles", L(f"""SELECT user_id, count(*) FILTER (state IN {_ACTIVE}) AS active,
       count(*) FILTER (state IN ('AWAITING_SETUP','ANALYSIS_READY','PREVIEW_READY','COMPLETED')) AS ready, count(*) AS total FROM projects GROUP BY 1"""))
def ledger_dashboard_tiles(spark, folder):
    return ledger.dashboard_tiles(source.projects(spark, folder))


@query("ledger_state_counters", L("""SELECT 'run' AS kind, state AS label, count(*) AS n FROM runs GROUP BY 2 UNION ALL SELECT 'page', coalesce(block_reason, state), count(*) FROM run_pages GROUP BY 2"""))
def ledger_state_counters(spark, folder):
    runs = source.runs(spark, folder).groupBy(F.col("state").alias("label")).agg(F.count("*").alias("n"))
    pages = source.run_pages(spark, folder).groupBy(F.coalesce("block_reason", "state").alias("label")).agg(F.count("*").alias("n"))
    return runs.withColumn("kind", F.lit("run")).unionByName(pages.withColumn("kind", F.lit("page")))


@query("ledger_progress_results", L("""SELECT run_id, count(*) AS pages_total, count(*) FILTER (state = 'EXTRACTED' AND page_key % 3 = 0) AS n_records,
       max(CASE WHEN run_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_exports FROM run_pages GROUP BY run_id"""))
def ledger_progress_results(spark, folder):
    pages = source.run_pages(spark, folder)
    records = pages.filter((F.col("state") == "EXTRACTED") & (F.col("page_key") % 3 == 0)).select("run_id")
    exports = source.runs(spark, folder).filter(F.col("run_id") % 4 == 0).select("run_id")
    return ledger.progress(pages, records, exports).select("run_id", "pages_total", "n_records", "n_exports")


@query("ledger_records_after", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (DATE '1995-01-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def ledger_records_after(spark, folder):
    """A page of fifty past a key."""
    import datetime

    rows = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return ledger.records_after(rows, ["o_orderdate", "o_orderkey"], (datetime.date(1995, 1, 1), 0), 50)


@query("ledger_page_columns", """WITH p AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)
       SELECT DISTINCT unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['status', 'even'] ELSE ['status', lower(o_orderstatus)] END) AS "column" FROM p""")
def ledger_page_columns(spark, folder):
    key = F.col("o_orderkey")
    data = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.when(key % 2 == 0, "even").otherwise(F.lower("o_orderstatus")), F.lit("x"), F.lit("source_url"), F.lit("u"))
    rows = load(spark, folder, "orders").select("o_orderkey", data.alias("data"))
    return ledger.page_columns(ledger.records_after(rows, ["o_orderkey"], None, 50), "data")


@query("event_completed_by_project", """SELECT user_id AS project_id, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1""")
def event_completed_by_project(spark, folder):
    rows = load(spark, folder, "events").select(F.col("user_id").alias("project_id"), "event_type")
    return ledger.event_group(rows, "completed").groupBy("project_id").agg(F.count("*").alias("n"))


@query("ledger_duration_histogram", L("""SELECT state, b::VARCHAR AS le, count(*) FILTER (s <= b) AS n FROM (SELECT state, seconds AS s FROM runs WHERE finished_at IS NOT NULL),
       (SELECT unnest([1,5,15,30,60,120,300,600,1800]) AS b) GROUP BY state, b UNION ALL SELECT state, '+Inf', count(*) FROM runs WHERE finished_at IS NOT NULL GROUP BY state"""))
def ledger_duration_histogram(spark, folder):
    done = source.runs(spark, folder).filter(F.col("finished_at").isNotNull())
    seconds = F.timestamp_diff("SECOND", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"))
    return ledger.duration_histogram(done, seconds)


# Fixed values, written out apart from the operator's own tables.
_STATUS_SQL = """CASE WHEN state IN ('QUEUED', 'ANALYZING') THEN 'analyzing|Analyzing site|warning' WHEN state IN ('AWAITING_SETUP', 'ANALYSIS_READY') THEN 'ready_to_review|Ready to choose fields|success'
       WHEN state = 'PREVIEWING' THEN 'previewing|Preparing preview|warning' WHEN state = 'PREVIEW_READY' THEN 'preview_ready|Preview ready|success' WHEN state = 'DISCOVERING' THEN 'extracting|Finding pages|warning'
       WHEN state = 'EXTRACTING' THEN 'extracting|Extracting data|warning' WHEN state = 'EXPORTING' THEN 'exporting|Preparing results|warning' WHEN state = 'COMPLETED' THEN 'completed|Results ready|success'
       WHEN state = 'PAUSED' THEN 'paused|Paused|neutral' WHEN state = 'FAILED' THEN 'failed|Failed|danger' WHEN state = 'CANCELED' THEN 'canceled|Canceled|neutral' END"""


@query("ledger_product_status", L(f"""SELECT project_id, {_STATUS_SQL} AS status, CASE WHEN confidence >= 0.85 AND warning_count = 0 THEN 'High' WHEN confidence >= 0.65 THEN 'Needs review' ELSE 'Low' END AS confidence_label,
       upper(left(page_type, 1)) || lower(substr(page_type, 2)) AS detected FROM projects"""))
def ledger_product_status(spark, folder):
    rows = ledger.with_status(source.projects(spark, folder))
    return rows.select(
        "project_id", F.concat_ws("|", "status.code", "status.label", "status.tone").alias("status"),
        classify.confidence_label(F.col("confidence"), F.col("warning_count")).alias("confidence_label"),
        F.initcap(F.replace("page_type", F.lit("_"), F.lit(" "))).alias("detected"),
    )


@query("ledger_illegal_transitions", """SELECT o_orderkey, a AS old_state, b AS new_state FROM (
       SELECT o_orderkey, """ + _PS + """[o_custkey % 13 + 1] AS a, """ + _PS + """[o_orderkey % 13 + 1] AS b FROM orders) WHERE NOT (
         (b IN ('FAILED', 'CANCELED') AND a NOT IN ('COMPLETED', 'FAILED', 'CANCELED')) OR (a, b) IN (
           ('QUEUED', 'ANALYZING'), ('ANALYZING', 'AWAITING_SETUP'), ('ANALYZING', 'ANALYSIS_READY'), ('AWAITING_SETUP', 'PREVIEWING'), ('AWAITING_SETUP', 'DISCOVERING'),
           ('ANALYSIS_READY', 'PREVIEWING'), ('ANALYSIS_READY', 'DISCOVERING'), ('PREVIEWING', 'PREVIEW_READY'), ('PREVIEWING', 'AWAITING_SETUP'), ('PREVIEWING', 'ANALYSIS_READY'),
           ('PREVIEW_READY', 'PREVIEWING'), ('PREVIEW_READY', 'DISCOVERING'), ('DISCOVERING', 'EXTRACTING'), ('DISCOVERING', 'PAUSED'), ('EXTRACTING', 'EXPORTING'), ('EXTRACTING', 'PAUSED'),
           ('EXPORTING', 'COMPLETED'), ('PAUSED', 'DISCOVERING'), ('PAUSED', 'EXTRACTING'), ('COMPLETED', 'DISCOVERING'), ('FAILED', 'QUEUED'), ('FAILED', 'ANALYSIS_READY'), ('FAILED', 'PREVIEW_READY')))""")
def ledger_illegal_transitions(spark, folder):
    states = F.array(*[F.lit(s) for s in source.PROJECT_STATES])
    pick = lambda c: F.get(states, (F.col(c) % 13).cast("int"))
    changes = load(spark, folder, "orders").select("o_orderkey", pick("o_custkey").alias("old_state"), pick("o_orderkey").alias("new_state"))
    return ledger.illegal_transitions(changes)


@query("ledger_illegal_task_steps", """SELECT user_id, event_id, a AS old_state, b AS new_state FROM (
       SELECT user_id, event_id, b, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a
       FROM (SELECT user_id, event_id, ts, ['PERMISSION_GRANTED', 'SCRAPING', 'SCRAPED', 'LLM_PROCESSING', 'COMPLETED', 'FAILED'][event_id % 6 + 1] AS b FROM events))
     WHERE a <> b AND NOT (a || '>' || b IN ('PERMISSION_GRANTED>SCRAPING', 'SCRAPING>SCRAPED', 'SCRAPING>FAILED', 'SCRAPED>LLM_PROCESSING', 'SCRAPED>FAILED', 'LLM_PROCESSING>COMPLETED', 'LLM_PROCESSING>FAILED'))""")
def ledger_illegal_task_steps(spark, folder):
    """Old and new states come from the event table itself."""
    states = F.array(*[F.lit(s) for s in ("PERMISSION_GRANTED", "SCRAPING", "SCRAPED", "LLM_PROCESSING", "COMPLETED", "FAILED")])
    history = load(spark, folder, "events").select("user_id", "event_id", "ts", F.get(states, (F.col("event_id") % 6).cast("int")).alias("state"))
    changes = ledger.state_changes(history, "user_id", ["ts", "event_id"])
    return ledger.illegal_transitions(changes, ledger.TASK_TRANSITIONS).drop("ts")


@query("health_stuck_rows", f"""SELECT event_id FROM events WHERE (event_type = 'view' AND ts < TIMESTAMP '2024-01-01 01:00:00' - INTERVAL 3 MINUTE)
       OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-01 01:00:00' - INTERVAL 5 MINUTE) OR (event_type = 'error' AND ts < TIMESTAMP '2024-01-01 01:00:00' - INTERVAL 10 MINUTE)""")
def health_stuck_rows(spark, folder):
    state = F.when(F.col("event_type") == "view", "PERMISSION_GRANTED").when(F.col("event_type") == "click", "SCRAPING").when(F.col("event_type") == "error", "LLM_PROCESSING").otherwise("DONE")
    ts = F.col("created_at")
    tasks = source.events(spark, folder).select("event_id", state.alias("state"), F.when(F.col("event_id") % 2 == 0, ts).alias("updated_at"), ts.alias("created_at"))
    return ledger.stuck_rows(tasks, F.to_timestamp_ntz(F.lit("2024-01-01 01:00:00"))).select("event_id")


@query("health_expired_leases", L(f"""SELECT run_id, page_key FROM run_pages WHERE state = 'FETCHING' AND updated_at < {NOW} AND run_id IN (
       SELECT run_id FROM runs JOIN projects USING (project_id) WHERE projects.state IN ('DISCOVERING','EXTRACTING'))"""))
def health_expired_leases(spark, folder):
    return ledger.expired_leases(
        source.run_pages(spark, folder), source.runs(spark, folder), source.projects(spark, folder), source.now()
    ).select("run_id", "page_key")


@query("health_stalled_runs", L(f"""SELECT r.run_id, r.project_id, CASE WHEN resume_count >= 3 THEN 'exhausted' WHEN spec_id IS NULL THEN 'no_spec' ELSE 'resume' END AS action
       FROM runs r JOIN projects p USING (project_id) LEFT JOIN (SELECT run_id, max(updated_at) AS last FROM run_pages GROUP BY 1) a USING (run_id)
       WHERE p.state IN ('DISCOVERING','EXTRACTING') AND r.state IN ('QUEUED','RUNNING') AND coalesce(a.last, r.started_at, r.created_at) < {NOW} - INTERVAL 10 MINUTE"""))
def health_stalled_runs(spark, folder):
    return ledger.stalled_runs(source.projects(spark, folder), source.runs(spark, folder), source.run_pages(spark, folder), source.now())


@query("health_orphaned_runs", L("SELECT run_id FROM runs WHERE state IN ('QUEUED','RUNNING') AND project_id IN (SELECT project_id FROM projects WHERE state = 'FAILED')"))
def health_orphaned_runs(spark, folder):
    return ledger.orphaned_active_runs(source.projects(spark, folder), source.runs(spark, folder)).select("run_id")


@query("health_reclaimable_runs", L(f"""SELECT run_id FROM runs WHERE state IN ('COMPLETED','FAILED','CANCELED') AND run_id NOT IN (SELECT current_run_id FROM projects WHERE current_run_id IS NOT NULL)
       AND coalesce(finished_at, created_at) < {NOW} - INTERVAL 14 DAY ORDER BY run_id LIMIT 50"""))
def health_reclaimable_runs(spark, folder):
    return ledger.reclaimable_runs(source.projects(spark, folder), source.runs(spark, folder), source.now(), 50)


_CACHE_SQL = """cache AS (SELECT c_custkey AS entry_id, sha256((c_custkey % 40)::VARCHAR) AS content_hash, c_mktsegment AS mode, 'r' || c_custkey AS result,
       CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1999-01-01' + to_days((c_custkey % 700)::INT) END AS expires_at FROM customer)"""


def _cache(spark, folder):
    key = F.col("c_custkey")
    return load(spark, folder, "customer").select(
        key.alias("entry_id"), F.sha2((key % 40).cast("string"), 256).alias("content_hash"), F.col("c_mktsegment").alias("mode"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(1).alias("version"), F.concat(F.lit("r"), key.cast("string")).alias("result"),
        F.when(key % 3 != 0, F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")) + F.make_dt_interval(days=(key % 700).cast("int"))).alias("expires_at"),
    )


@query("health_expired_cache", f"WITH {_CACHE_SQL} SELECT entry_id FROM cache WHERE expires_at < {NOW}")
def health_expired_cache(spark, folder):
    return ledger.expired_cache(_cache(spark, folder), source.now()).select("entry_id")


@query("analysis_cache_lookup", f"""WITH {_CACHE_SQL}, live AS (SELECT content_hash, mode, max_by(result, entry_id) AS result FROM cache WHERE expires_at IS NULL OR expires_at > {NOW} GROUP BY 1, 2),
       req AS (SELECT o_orderkey, sha256((o_orderkey % 60)::VARCHAR) AS content_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS mode FROM orders)
       SELECT o_orderkey, result AS cached_result, result IS NULL AS miss FROM req LEFT JOIN live USING (content_hash, mode)""")
def analysis_cache_lookup(spark, folder):
    key = F.col("o_orderkey")
    requests = load(spark, folder, "orders").select(
        "o_orderkey", F.sha2((key % 60).cast("string"), 256).alias("content_hash"), F.when(key % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("mode"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(1).alias("version"),
    )
    found = ledger.cache_lookup(requests, _cache(spark, folder), source.now())
    return found.select("o_orderkey", "cached_result", F.col("cached_result").isNull().alias("miss"))


@query("ledger_extraction_gate", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'NO_PREVIEW' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN 'STALE_PREVIEW'
       WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 6 = 1 THEN 'ZERO_PREVIEW_RECORDS' WHEN o_custkey % 13 NOT IN (2, 3, 5, 9) THEN 'NOT_READY'
       WHEN o_custkey % 2 = 0 THEN 'SCOPE_NOT_CONFIRMED' WHEN o_custkey % 3 = 0 THEN 'EXTRACTION_ALREADY_RUNNING' END AS gate FROM orders""")
def ledger_extraction_gate(spark, folder):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    states = F.array(*[F.lit(s) for s in source.PROJECT_STATES])
    rows = load(spark, folder, "orders").select(
        "o_orderkey", (o % 3 != 0).alias("has_preview"), (o % 4 == 0).alias("preview_stale"), F.when(o % 6 == 1, 0).otherwise(2).alias("preview_records"),
        (F.col("o_orderstatus") == "F").alias("structured"), (o % 5 == 0).alias("extract_anyway"), F.get(states, (c % 13).cast("int")).alias("state"),
        (c % 2 == 0).alias("unconfirmed_scope"), (c % 3 == 0).alias("has_active_run"),
    )
    return ledger.extraction_gate(rows).select("o_orderkey", "gate")


@query("ledger_retry_target", """SELECT c_custkey, CASE WHEN c_custkey % 13 <> 11 THEN 'NOT_FAILED' WHEN c_acctbal > 0 AND c_nationkey % 2 = 0 THEN 'PREVIEW_READY' WHEN c_acctbal > 0 THEN 'ANALYSIS_READY'
       WHEN c_nationkey % 3 = 0 THEN 'QUEUED' ELSE 'NO_PROVIDER_CONFIGURED' END AS target FROM customer""")
def ledger_retry_target(spark, folder):
    states = F.array(*[F.lit(s) for s in source.PROJECT_STATES])
    target = ledger.retry_target(
        F.get(states, (F.col("c_custkey") % 13).cast("int")), F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 3 == 0
    )
    return load(spark, folder, "customer").select("c_custkey", target.alias("target"))


@query("ledger_delete_plan", L("""SELECT 'runs' AS child, count(*) AS n FROM runs JOIN projects USING (project_id) WHERE projects.state = 'CANCELED'
       UNION ALL SELECT 'run_pages', count(*) FROM run_pages WHERE run_id IN (SELECT run_id FROM runs JOIN projects USING (project_id) WHERE projects.state = 'CANCELED')"""))
def ledger_delete_plan(spark, folder):
    doomed = source.projects(spark, folder).filter(F.col("state") == "CANCELED")
    runs = source.runs(spark, folder)
    pages = source.run_pages(spark, folder).join(runs.select("run_id", "project_id"), "run_id")
    return ledger.delete_plan(doomed, {"runs": runs, "run_pages": pages})


@query("ledger_latest_run", L("SELECT project_id, run_id, state FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) = 1"))
def ledger_latest_run(spark, folder):
    """Latest row per project, the pattern of specs, previews and frontier previews."""
    rows = source.runs(spark, folder).select("project_id", "run_id", "state", "created_at")
    return ranked.latest_per_key(rows, ["project_id"], ["created_at", "run_id"]).select("project_id", "run_id", "state")


@query("ledger_projects_with_latest", L("""SELECT p.project_id, r.run_id FROM projects p LEFT JOIN (SELECT project_id, max_by(run_id, (created_at, run_id)) AS run_id FROM runs GROUP BY 1) r USING (project_id)
       WHERE p.user_id = 7 ORDER BY p.project_id DESC LIMIT 20 OFFSET 2"""))
def ledger_projects_with_latest(spark, folder):
    """One user's newest-first list page, each project with its latest run."""
    rows = source.runs(spark, folder).select("project_id", "run_id", "created_at")
    latest = ranked.latest_per_key(rows, ["project_id"], ["created_at", "run_id"]).select("project_id", "run_id")
    mine = source.projects(spark, folder).filter(F.col("user_id") == 7).select("project_id")
    page = mine.orderBy(F.desc("project_id")).offset(2).limit(20)
    return page.join(latest, "project_id", "left")


@query("ledger_newest_active", L(f"SELECT user_id, project_id FROM projects WHERE state IN {_ACTIVE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY project_id DESC) = 1"))
def ledger_newest_active(spark, folder):
    rows = source.projects(spark, folder).filter(F.col("state").isin(*ledger.ACTIVE_PROJECTS)).select("user_id", "project_id")
    return ranked.latest_per_key(rows, ["user_id"], ["project_id"])


@query("ledger_current_records", L("""SELECT p.page_key, p.run_id, projects.project_id FROM run_pages p JOIN projects ON projects.current_run_id = p.run_id WHERE p.state = 'EXTRACTED'"""))
def ledger_current_records(spark, folder):
    current = source.projects(spark, folder).filter(F.col("current_run_id").isNotNull()).select("project_id", F.col("current_run_id").alias("run_id"))
    return source.run_pages(spark, folder).filter(F.col("state") == "EXTRACTED").join(current, "run_id").select("page_key", "run_id", "project_id")


@query("ledger_current_record_counts", L("""SELECT projects.project_id, count(*) AS n FROM run_pages p JOIN projects ON projects.current_run_id = p.run_id WHERE p.state = 'EXTRACTED' GROUP BY 1"""))
def ledger_current_record_counts(spark, folder):
    return ledger_current_records(spark, folder).groupBy("project_id").agg(F.count("*").alias("n"))


@query("ledger_records_page", """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, 150 < (SELECT count(*) FROM orders) AS has_more, 150 AS next_skip FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def ledger_records_page(spark, folder):
    return ledger.records_page(load(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 100, 50)


@query("event_newest_per_project", f"WITH {EVENTS} SELECT project_id, event_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, event_id DESC) AS rank FROM ev QUALIFY rank <= 5")
def event_newest_per_project(spark, folder):
    return ledger.newest_events(source.events(spark, folder), "project_id", 5).select("project_id", "event_id", "rank")


@query("event_newest_per_user", f"WITH {EVENTS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rank FROM ev QUALIFY rank <= 100")
def event_newest_per_user(spark, folder):
    return ledger.newest_events(source.events(spark, folder), "user_id", 100).select("user_id", "event_id", "rank")


@query("event_level_clamp", f"WITH {EVENTS} SELECT event_id, CASE WHEN level = 'debug' THEN 'info' ELSE level END AS level FROM ev")
def event_level_clamp(spark, folder):
    return source.events(spark, folder).select("event_id", ledger.clamp_level(F.col("level")).alias("level"))


@query("event_scalar_metadata", """SELECT event_id, 'flat,k,list' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '' END AS kept FROM events""")
def event_scalar_metadata(spark, folder):
    k = F.get_json_object("props", "$.k")
    meta = F.create_map(
        F.lit("flat"), F.lit('"text"'), F.lit("k"), k, F.lit("list"), F.concat(F.lit("["), k, F.lit(",1]")),
        F.lit("nested"), F.col("props"), F.lit("deep"), F.concat(F.lit("[{\"a\":"), k, F.lit("}]")),
    )
    kept = F.map_keys(ledger.scalar_metadata(meta))
    return load(spark, folder, "events").select("event_id", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query("event_groups_by_project", f"""WITH {EVENTS} SELECT project_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
       max_by(event_id, (created_at, event_id)) AS newest FROM ev WHERE level IN ('error','warning') GROUP BY project_id""")
def event_groups_by_project(spark, folder):
    rows = source.events(spark, folder).filter(F.col("level").isin("error", "warning"))
    return rows.groupBy("project_id").agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
        F.max(F.struct("created_at", "event_id"))["event_id"].alias("newest"),
    )
