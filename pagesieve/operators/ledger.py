"""Run ledger: progress, health, outcomes and lifecycle as table queries.

Tables: projects(project_id, user_id, state, current_run_id, created_at,
updated_at, ...), runs(run_id, project_id, spec_id, state, resume_count,
created_at, started_at, finished_at), run_pages(run_id, url, state, depth,
block_reason, lease_expires_at, created_at, updated_at).

Aggregates combine before their shuffle and top-k lists are salted, so a run or
user that owns a third of the rows does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.operators.ranked import top_per_group

PAGE_STATES = ("PENDING", "FETCHING", "EXTRACTED", "BLOCKED", "FAILED")
ACTIVE_RUNS = ("QUEUED", "RUNNING")
FINISHED_RUNS = ("COMPLETED", "FAILED", "CANCELED")
ACTIVE_PROJECTS = ("QUEUED", "ANALYZING", "PREVIEWING", "DISCOVERING", "EXTRACTING", "EXPORTING")
READY_PROJECTS = ("AWAITING_SETUP", "ANALYSIS_READY", "PREVIEW_READY", "COMPLETED")
DURATION_BUCKETS = (1, 5, 15, 30, 60, 120, 300, 600, 1800)
MAX_RESUMES = 3
RETENTION_DAYS = 14

# Minutes a row may sit in a state before it counts as stuck.
STUCK_MINUTES = {"PERMISSION_GRANTED": 3, "SCRAPING": 5, "LLM_PROCESSING": 10}

# Presentation of project states (code, label, tone).
STATUS = {
    "QUEUED": ("analyzing", "Analyzing site", "warning"),
    "ANALYZING": ("analyzing", "Analyzing site", "warning"),
    "AWAITING_SETUP": ("ready_to_review", "Ready to choose fields", "success"),
    "ANALYSIS_READY": ("ready_to_review", "Ready to choose fields", "success"),
    "PREVIEWING": ("previewing", "Preparing preview", "warning"),
    "PREVIEW_READY": ("preview_ready", "Preview ready", "success"),
    "DISCOVERING": ("extracting", "Finding pages", "warning"),
    "EXTRACTING": ("extracting", "Extracting data", "warning"),
    "EXPORTING": ("exporting", "Preparing results", "warning"),
    "COMPLETED": ("completed", "Results ready", "success"),
    "PAUSED": ("paused", "Paused", "neutral"),
    "FAILED": ("failed", "Failed", "danger"),
    "CANCELED": ("canceled", "Canceled", "neutral"),
}

# Legal project state changes.
TRANSITIONS = {
    "QUEUED": ("ANALYZING", "FAILED", "CANCELED"),
    "ANALYZING": ("AWAITING_SETUP", "ANALYSIS_READY", "FAILED", "CANCELED"),
    "AWAITING_SETUP": ("PREVIEWING", "DISCOVERING", "FAILED", "CANCELED"),
    "ANALYSIS_READY": ("PREVIEWING", "DISCOVERING", "FAILED", "CANCELED"),
    "PREVIEWING": ("PREVIEW_READY", "AWAITING_SETUP", "ANALYSIS_READY", "FAILED", "CANCELED"),
    "PREVIEW_READY": ("PREVIEWING", "DISCOVERING", "FAILED", "CANCELED"),
    "DISCOVERING": ("EXTRACTING", "PAUSED", "FAILED", "CANCELED"),
    "EXTRACTING": ("EXPORTING", "PAUSED", "FAILED", "CANCELED"),
    "EXPORTING": ("COMPLETED", "FAILED", "CANCELED"),
    "PAUSED": ("DISCOVERING", "EXTRACTING", "FAILED", "CANCELED"),
    "COMPLETED": ("DISCOVERING",),
    "FAILED": ("QUEUED", "ANALYSIS_READY", "PREVIEW_READY"),
    "CANCELED": (),
}


def display_runs(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """project_id, run_id to show: the active run, else the current one."""
    active = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).groupBy("project_id").agg(F.max("run_id").alias("active_run"))
    return (
        projects.select("project_id", "current_run_id")
        .join(active, "project_id", "left")
        .select("project_id", F.coalesce("active_run", "current_run_id").alias("run_id"))
    )


def progress(run_pages: DataFrame, records: DataFrame | None = None, exports: DataFrame | None = None) -> DataFrame:
    """Page counts by state per run, with finished pages and their share.

    ``records`` and ``exports`` (with run_id) add how many of them a run has.
    """
    counts = {s: F.count_if(F.col("state") == s).alias(f"pages_{s.lower()}") for s in PAGE_STATES}
    out = run_pages.groupBy("run_id").agg(F.count("*").alias("pages_total"), *counts.values())
    done = F.col("pages_extracted") + F.col("pages_blocked") + F.col("pages_failed")
    share = F.least(F.greatest(F.round(done / F.col("pages_total") * 100, 0), F.lit(0)), F.lit(100))
    out = out.withColumns({"pages_done": done, "percent": share.cast("int")})
    for name, rows in (("records", records), ("exports", exports)):
        if rows is not None:
            counted = rows.groupBy("run_id").agg(F.count("*").alias(f"n_{name}"))
            out = out.join(counted, "run_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def page_details(run_pages: DataFrame, state: str, limit: int, default: str) -> DataFrame:
    """First pages of a run in a state, with a reason; salted top-k per run."""
    rows = run_pages.filter(F.col("state") == state).select(
        "run_id", "page_key", F.coalesce("block_reason", F.lit(default)).alias("block_reason")
    )
    return top_per_group(rows, ["run_id"], [F.col("page_key")], limit, "rank", ["page_key"])


def claim_order(run_pages: DataFrame, limit: int = 1) -> DataFrame:
    """Next pending pages per run, shallow first."""
    rows = run_pages.filter(F.col("state") == "PENDING").select("run_id", "depth", "page_key")
    return top_per_group(rows, ["run_id"], [F.col("depth"), F.col("page_key")], limit, "rank", ["page_key"])


def run_outcome(run_pages: DataFrame, records: DataFrame, structured: Column) -> DataFrame:
    """run_id, outcome of finished runs.

    ``records`` is (run_id, n_records); ``structured`` reads columns of the
    joined row.
    """
    is_in = lambda s: F.col("state") == s
    per_run = run_pages.groupBy("run_id").agg(
        F.count_if(is_in("EXTRACTED") | (is_in("FAILED") & F.col("block_reason").eqNullSafe("SELECTOR_ZERO_MATCH"))).alias("fetched"),
        F.count_if(is_in("BLOCKED")).alias("blocked"),
        F.count_if(is_in("BLOCKED") & F.col("block_reason").eqNullSafe("ANTI_BOT_CHALLENGE")).alias("challenged"),
        F.count_if(is_in("FAILED")).alias("failed"),
    )
    joined = per_run.join(records, "run_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    nothing = (F.col("fetched") == 0) & (F.col("n_records") == 0)
    all_bots = (F.col("challenged") > 0) & (F.col("challenged") == F.col("blocked")) & (F.col("failed") == 0)
    return joined.select(
        "run_id",
        F.when(nothing & all_bots, "BOT_PROTECTION_BLOCKED")
        .when(nothing, "ALL_PAGES_FAILED")
        .when(structured & (F.col("n_records") == 0), "NO_RECORDS_EXTRACTED")
        .otherwise("COMPLETED")
        .alias("outcome"),
    )


def promoted_runs(runs: DataFrame) -> DataFrame:
    """project_id, current_run_id: the completed run that finished last."""
    done = runs.filter((F.col("state") == "COMPLETED") & F.col("finished_at").isNotNull())
    best = done.groupBy("project_id").agg(F.max(F.struct("finished_at", "run_id")).alias("b"))
    return best.select("project_id", F.col("b.run_id").alias("current_run_id"))


def duplicate_active_runs(runs: DataFrame) -> DataFrame:
    """Projects with more than one active run: project_id, n."""
    active = runs.filter(F.col("state").isin(*ACTIVE_RUNS))
    return active.groupBy("project_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def active_per_user(projects: DataFrame, limit: int = 3) -> DataFrame:
    """user_id, active, admitted: whether one more job may start."""
    return projects.groupBy("user_id").agg(
        F.count_if(F.col("state").isin(*ACTIVE_PROJECTS)).alias("active")
    ).withColumn("admitted", F.col("active") < limit)


def dashboard_tiles(projects: DataFrame) -> DataFrame:
    return projects.groupBy("user_id").agg(
        F.count_if(F.col("state").isin(*ACTIVE_PROJECTS)).alias("active"),
        F.count_if(F.col("state").isin(*READY_PROJECTS)).alias("ready"),
        F.count("*").alias("total"),
    )


def duration_histogram(runs: DataFrame, seconds: Column) -> DataFrame:
    """Cumulative bucket counts of run durations: state, le, n."""
    counts = runs.withColumn("__s", seconds).groupBy("state").agg(
        *[F.count_if(F.col("__s") <= b).alias(f"b{b}") for b in DURATION_BUCKETS], F.count("__s").alias("all")
    )
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in DURATION_BUCKETS],
        F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")),
    )
    return counts.select("state", F.inline(rows))


def with_status(projects: DataFrame) -> DataFrame:
    """Add status code, label and tone; unknown states need attention."""
    rows = F.create_map(
        *[x for s, (c, label, tone) in STATUS.items()
          for x in (F.lit(s), F.struct(F.lit(c).alias("code"), F.lit(label).alias("label"), F.lit(tone).alias("tone")))]
    )
    other = F.struct(F.lit("unknown").alias("code"), F.lit("Needs attention").alias("label"), F.lit("neutral").alias("tone"))
    return projects.withColumn("status", F.coalesce(F.try_element_at(rows, F.col("state")), other))


# The states a task may go to.
TASK_TRANSITIONS = {
    "PERMISSION_GRANTED": ("SCRAPING",),
    "SCRAPING": ("SCRAPED", "FAILED"),
    "SCRAPED": ("LLM_PROCESSING", "FAILED"),
    "LLM_PROCESSING": ("COMPLETED", "FAILED"),
    "COMPLETED": (),
    "FAILED": (),
}


def state_changes(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Successive states of each project or task: key, order, old_state, new_state; the first state has no change."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    changes = history.select(key, *order, before.alias("old_state"), F.col("state").alias("new_state"))
    return changes.filter(F.col("old_state").isNotNull() & (F.col("old_state") != F.col("new_state")))


def illegal_transitions(changes: DataFrame, transitions: dict = TRANSITIONS) -> DataFrame:
    """Rows of (old_state, new_state, ...) that the state machine does not allow."""
    legal = F.lit(False)
    for old, nexts in transitions.items():
        if nexts:
            legal = legal | ((F.col("old_state") == old) & F.col("new_state").isin(*nexts))
    return changes.filter(~F.coalesce(legal, F.lit(False)))


# --- health -----------------------------------------------------------------------------


def minutes_before(now: Column, minutes) -> Column:
    return now - F.make_dt_interval(mins=minutes if isinstance(minutes, Column) else F.lit(minutes))


def stuck_rows(tasks: DataFrame, now: Column, limits: dict[str, int] = STUCK_MINUTES) -> DataFrame:
    """Rows in a timed state, untouched for longer than its limit."""
    touched = F.coalesce("updated_at", "created_at")
    stuck = F.lit(False)
    for state, minutes in limits.items():
        stuck = stuck | ((F.col("state") == state) & (touched < minutes_before(now, minutes)))
    return tasks.filter(stuck)


def expired_leases(run_pages: DataFrame, runs: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """Fetching pages whose lease ran out while their project is active."""
    live = projects.filter(F.col("state").isin("DISCOVERING", "EXTRACTING")).select("project_id")
    owned = runs.select("run_id", "project_id").join(live, "project_id", "left_semi")
    late = run_pages.filter((F.col("state") == "FETCHING") & (F.col("lease_expires_at") < now))
    return late.join(owned.select("run_id"), "run_id", "left_semi")


def stalled_runs(projects: DataFrame, runs: DataFrame, run_pages: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Active runs without page activity: run_id, action (resume / exhausted / no_spec)."""
    activity = run_pages.groupBy("run_id").agg(F.max(F.coalesce("updated_at", "created_at")).alias("last_activity"))
    live = projects.filter(F.col("state").isin("DISCOVERING", "EXTRACTING")).select("project_id")
    active = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(live, "project_id")
    joined = active.join(activity, "run_id", "left")
    last = F.coalesce("last_activity", "started_at", "created_at")
    action = (
        F.when(F.col("resume_count") >= MAX_RESUMES, "exhausted").when(F.col("spec_id").isNull(), "no_spec").otherwise("resume")
    )
    return joined.filter(last < minutes_before(now, minutes)).select("run_id", "project_id", action.alias("action"))


def orphaned_active_runs(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Active runs whose project already failed."""
    failed = projects.filter(F.col("state") == "FAILED").select("project_id")
    return runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(failed, "project_id", "left_semi")


def reclaimable_runs(projects: DataFrame, runs: DataFrame, now: Column, batch: int | None = None) -> DataFrame:
    """Finished runs past retention that no project shows; the first ``batch`` if given."""
    shown = projects.filter(F.col("current_run_id").isNotNull()).select(F.col("current_run_id").alias("run_id"))
    old = F.coalesce("finished_at", "created_at") < minutes_before(now, RETENTION_DAYS * 24 * 60)
    gone = runs.filter(F.col("state").isin(*FINISHED_RUNS) & old).join(shown, "run_id", "left_anti").select("run_id")
    return gone if batch is None else gone.orderBy("run_id").limit(batch)


def expired_cache(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at").isNotNull() & (F.col("expires_at") < now))


CACHE_KEY = ("content_hash", "mode", "provider", "model", "version")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with ``cached_result``; NULL is a miss.

    The newest live entry per key answers, so duplicates in the cache do not
    multiply requests.
    """
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    newest = live.groupBy(*CACHE_KEY).agg(F.max_by("result", "entry_id").alias("cached_result"))
    return requests.join(newest, list(CACHE_KEY), "left")


def extraction_gate(rows: DataFrame) -> DataFrame:
    """Add ``gate``: why a project may not start extracting; NULL when it may.

    Expects has_preview, preview_stale, preview_records, structured,
    extract_anyway, state, unconfirmed_scope, has_active_run.
    """
    c = F.col
    return rows.withColumn(
        "gate",
        F.when(~c("has_preview") & ~c("extract_anyway"), "NO_PREVIEW")
        .when(c("has_preview") & c("preview_stale") & ~c("extract_anyway"), "STALE_PREVIEW")
        .when(c("has_preview") & ~c("preview_stale") & c("structured") & (c("preview_records") == 0), "ZERO_PREVIEW_RECORDS")
        .when(~c("state").isin(*READY_PROJECTS), "NOT_READY")
        .when(c("unconfirmed_scope"), "SCOPE_NOT_CONFIRMED")
        .when(c("has_active_run"), "EXTRACTION_ALREADY_RUNNING"),
    )


def retry_target(state: Column, has_analysis: Column, preview_matches: Column, has_provider: Column) -> Column:
    """State a failed project returns to, or the reason it cannot."""
    return (
        F.when(state != "FAILED", "NOT_FAILED")
        .when(has_analysis & preview_matches, "PREVIEW_READY")
        .when(has_analysis, "ANALYSIS_READY")
        .when(has_provider, "QUEUED")
        .otherwise("NO_PROVIDER_CONFIGURED")
    )


def delete_plan(doomed: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Rows each child table loses with a set of projects: child, n."""
    parts = [
        table.join(doomed.select("project_id"), "project_id", "left_semi").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("child"), "n"
        )
        for name, table in children.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- events -----------------------------------------------------------------------------

LEVELS = ("info", "warning", "error")


def clamp_level(level: Column) -> Column:
    return F.when(level.isin(*LEVELS), level).otherwise("info")


def scalar_metadata(metadata: Column) -> Column:
    """Keep JSON scalars and lists of scalars of a map<string,string> of JSON texts."""
    scalar = r"^\s*(?:\"(?:[^\"\\]|\\.)*+\"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*$"
    flat = r"^\s*\[[^\[\]{}]*\]\s*$"
    return F.map_filter(metadata, lambda k, v: F.rlike(v, F.lit(scalar)) | F.rlike(v, F.lit(flat)))


def newest_events(events: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Newest events per project or user; salted so a noisy owner is split."""
    return top_per_group(
        events, [key], [F.desc("created_at"), F.desc("event_id")], limit, "rank", ["event_id"]
    )


def records_after(records: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows past the key ``after`` (None: from the start): no task sees the rows skipped."""
    if after is not None:
        kinds = dict(records.dtypes)
        key = F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after, strict=True)])
        records = records.filter(F.struct(*order) > key)
    return records.orderBy(*order).limit(limit)


def page_columns(page: DataFrame, data: str, skip: tuple[str, ...] = ("source_url",)) -> DataFrame:
    """Names of the values on one page of records, one row each, in order."""
    return page.select(F.explode(F.map_keys(data)).alias("column")).distinct().filter(~F.col("column").isin(*skip)).orderBy("column")


# Groups of the activity list.
EVENT_GROUPS = {"problems": ("error", "warning"), "errors": ("error",)}


def event_group(events: DataFrame, group: str) -> DataFrame:
    """Events of one group of the activity list: problems, errors, or completed (steps that ended well)."""
    if group == "completed":
        return events.filter(F.endswith("event_type", F.lit("_completed")) | F.col("event_type").isin("purchase", "signup"))
    return events.filter(F.col("level").isin(*EVENT_GROUPS[group]))


def records_page(records: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    """One page of rows with total, next_skip and has_more on every row."""
    limit = max(1, limit)
    total = records.agg(F.count("*")).scalar()
    page = records.orderBy(*order).offset(skip).limit(limit).withColumn("total", total)
    more = F.lit(skip + limit) < F.col("total")
    return page.withColumns(
        {"has_more": more, "next_skip": F.when(more, F.lit(skip + limit))}
    )

