"""Breadth-first frontier over a link table, and the one-page frontier preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.urls import path_of
from pagesieve.operators.patterns import MIN_DETAIL_LINKS, parent_prefix, prefix_glob
from pagesieve.operators.ranked import top_per_group
from pagesieve.session import cut_lineage

MANY_EXCLUSIONS = 10
NO_CAP = 2**62
HIGH_EXCLUSION_RATE = 0.8


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Pages each run reaches: run_id, url, depth, ordinal.

    ``seeds`` is (run_id, url, page_cap) with one seed per run; ``edges`` is
    (src, dst, pos).  Levels are ordered by (parent ordinal, pos), URLs are
    unique per run and a run stops at its page cap (NULL: none).  Already known URLs do not
    use up slots.

    Only the loop counter lives on the driver.  Each level is checkpointed, so
    plans stay flat and a lost executor replays one level.  A small frontier is
    broadcast by size and ``edges`` is then scanned in place; a large one joins
    by shuffle, where hub pages are split by the adaptive skew join.
    """
    caps = seeds.groupBy("run_id").agg(F.coalesce(F.max("page_cap"), F.lit(NO_CAP)).alias("page_cap"))
    most = caps.agg(F.max("page_cap")).first()[0] or 0
    level = cut_lineage(
        seeds.select("run_id", "url", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("ordinal"))
    )
    seen = level
    for depth in range(1, max_depth + 1):
        found = (
            level.select("run_id", "url", "ordinal")
            .join(edges, F.col("url") == F.col("src"))
            .groupBy("run_id", F.col("dst").alias("url"))
            .agg(F.min(F.struct("ordinal", "pos")).alias("first"))
            .join(seen.select("run_id", "url"), ["run_id", "url"], "left_anti")
        )
        room = (
            seen.groupBy("run_id")
            .agg(F.count("*").alias("used"))
            .join(caps, "run_id")
            .select("run_id", "used", (F.col("page_cap") - F.col("used")).alias("room"))
        )
        ranked = top_per_group(
            found, ["run_id"], [F.col("first"), F.col("url")], most, "rank", ["url"]
        )
        level = cut_lineage(
            ranked.join(room, "run_id")
            .filter(F.col("rank") <= F.col("room"))
            .select("run_id", "url", F.lit(depth).alias("depth"), (F.col("used") + F.col("rank")).alias("ordinal"))
        )
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def insert_new_pages(existing: DataFrame, found: DataFrame, room: int) -> DataFrame:
    """Rows to append for (run_id, normalized_url): known keys dropped, then first ``room`` per run.

    ``found`` carries run_id, normalized_url and pos (discovery order).
    """
    first = found.groupBy("run_id", "normalized_url").agg(F.min("pos").alias("pos"))
    fresh = first.join(existing.select("run_id", "normalized_url"), ["run_id", "normalized_url"], "left_anti")
    return top_per_group(
        fresh, ["run_id"], [F.col("pos"), F.col("normalized_url")], room, "rank", ["normalized_url"]
    )


def links_to_enqueue(decisions: DataFrame, same_site: DataFrame, mode: Column, room: Column) -> DataFrame:
    """Per page: scope-chosen links, or plain same-site links where no scope is stored.

    ``mode`` and ``room`` read columns present on both inputs; CURRENT_PAGE and
    full runs enqueue nothing.
    """
    scoped = decisions.filter(mode.isNotNull() & (mode != "CURRENT_PAGE") & (F.col("decision") == "included"))
    legacy = same_site.filter(mode.isNull())
    both = scoped.select("page_id", "pos", "normalized_url", room.alias("room")).unionByName(
        legacy.select("page_id", "pos", "normalized_url", room.alias("room"))
    )
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= F.col("room"))


def preview_rows(decisions: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Decisions per seed page, the first ``limit`` a side if given; the seed leads the included list.

    ``pages`` has page_id, page_norm.  Rank 0 is the seed row.
    """
    side = Window.partitionBy("page_id", "decision").orderBy("pos")
    ranked = decisions.withColumn("rank", F.row_number().over(side))
    ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    ranked = ranked.select("page_id", "rank", "decision", "normalized_url", "reason_code", "role", "depth")
    lead = ranked.filter((F.col("decision") == "included") & (F.col("rank") == 1)).select(
        "page_id", F.col("normalized_url").alias("lead_url")
    )
    seeds = (
        pages.join(lead, "page_id", "left")
        .filter(F.col("lead_url").isNull() | (F.col("lead_url") != F.col("page_norm")))
        .select(
            "page_id",
            F.lit(0).alias("rank"),
            F.lit("included").alias("decision"),
            F.col("page_norm").alias("normalized_url"),
            F.lit("SEED_URL").alias("reason_code"),
            F.lit("seed").alias("role"),
            F.lit(0).alias("depth"),
        )
    )
    return seeds.unionByName(ranked)


def preview_summary(decisions: DataFrame, pages: DataFrame, detail_hits: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per seed: counts, estimated pages and warning columns.

    Counts and rates are of all decisions; with ``limit``, of the rows a preview
    cut at that many a side would show.

    ``pages`` has page_id, page_norm, max_pages; ``detail_hits`` has page_id,
    detail_hits (elements matched by the analysed detail selector).
    """
    dropped = F.col("reason_code").isin("EXCLUDED_SCOPE_MODE", "CURRENT_PAGE_SCOPE")
    by_page = decisions.groupBy("page_id").agg(
        F.count_if(F.col("decision") == "included").alias("n_in"),
        F.count_if(F.col("decision") == "excluded").alias("n_out"),
        F.count_if(dropped).alias("unrelated"),
        F.min(F.when(F.col("decision") == "included", F.struct("pos", "normalized_url"))).alias("lead"),
        F.count_if(
            dropped
            & F.startswith(
                path_of(F.col("normalized_url")), F.concat(parent_prefix(F.col("page_url")), F.lit("/"))
            )
        ).alias("sib_n"),
        F.min(parent_prefix(F.col("page_url"))).alias("prefix"),
    )
    clusters = prefix_glob(decisions.filter(dropped)).select(
        "page_id", F.col("glob").alias("pre_glob"), F.col("n").alias("pre_n")
    )
    facts = (
        pages.join(by_page, "page_id", "left")
        .join(clusters, "page_id", "left")
        .join(detail_hits, "page_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_in", "n_out", "unrelated", "sib_n", "detail_hits")})
    )
    seeded = F.col("lead").isNull() | (F.col("lead.normalized_url") != F.col("page_norm"))
    shown = lambda n: F.col(n) if limit is None else F.least(F.col(n), F.lit(limit))
    shown_in = shown("n_in") + F.when(seeded, 1).otherwise(0)
    shown_out = shown("n_out")
    siblings = (F.col("sib_n") > 0) & F.col("prefix").isNotNull()
    glob = F.when(siblings, F.concat(F.col("prefix"), F.lit("/*"))).otherwise(F.col("pre_glob"))
    narrow = (F.col("n_in") == 0) & (F.col("unrelated") >= MANY_EXCLUSIONS) & glob.isNotNull()
    return facts.select(
        "page_id",
        shown_in.alias("included_count"),
        shown_out.alias("excluded_count"),
        F.col("unrelated").alias("unrelated_same_origin_count"),
        F.col("max_pages").alias("estimated_page_count"),
        (F.col("unrelated") >= MANY_EXCLUSIONS).alias("has_many_exclusions"),
        narrow.alias("scope_too_narrow"),
        F.when(
            narrow, F.when(~siblings & (F.col("detail_hits") >= MIN_DETAIL_LINKS), "DATASET").otherwise("COLLECTION")
        ).alias("suggested_mode"),
        F.when(narrow, glob).alias("suggested_pattern"),
        F.when(narrow, F.when(siblings, F.col("sib_n")).otherwise(F.col("pre_n"))).alias("suggested_count"),
        (shown_out / (shown_in + shown_out) >= HIGH_EXCLUSION_RATE).alias("high_exclusion_rate"),
    )
