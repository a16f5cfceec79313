"""URL-template mining and scope recommendation, one row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.urls import looks_like_pagination, path_of, segments_of

MIN_SIBLINGS = 3
MIN_DETAIL_LINKS = 3


def parent_prefix(seed: Column) -> Column:
    """'/a/b' for a seed '/a/b/c'; NULL for a top-level seed."""
    segs = segments_of(seed)
    parents = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.when(F.size(parents) > 0, F.concat(F.lit("/"), F.array_join(parents, "/")))


def sibling_glob(links: DataFrame, seed: str = "page_url") -> DataFrame:
    """page_id, glob, n: links under the seed's parent path; absent when none."""
    marked = links.withColumn("__prefix", parent_prefix(F.col(seed)))
    under = F.startswith(path_of(F.col("normalized_url")), F.concat(F.col("__prefix"), F.lit("/")))
    return (
        marked.groupBy("page_id")
        .agg(F.concat(F.min("__prefix"), F.lit("/*")).alias("glob"), F.count_if(under).alias("n"))
        .filter((F.col("n") > 0) & F.col("glob").isNotNull())
    )


def prefix_glob(links: DataFrame) -> DataFrame:
    """page_id, glob, n: commonest first segment; ties go to the greatest prefix."""
    first = F.get(segments_of(F.col("normalized_url")), F.lit(0))
    counts = (
        links.withColumn("__seg", first)
        .filter(F.col("__seg").isNotNull())
        .groupBy("page_id", F.concat(F.lit("/"), F.col("__seg")).alias("prefix"))
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("page_id").agg(F.max(F.struct("n", "prefix")).alias("b"))
    return best.select("page_id", F.concat(F.col("b.prefix"), F.lit("/*")).alias("glob"), F.col("b.n").alias("n"))


def path_template(links: DataFrame) -> DataFrame:
    """page_id, glob, n: template of the largest same-length group of paths.

    A segment is constant when its minimum equals its maximum, so no distinct
    set is ever collected; each stage combines before its shuffle.
    """
    segs = links.select("page_id", segments_of(F.col("normalized_url")).alias("segs")).withColumn(
        "n_segs", F.size("segs")
    )
    per_position = (
        segs.filter(F.col("n_segs") > 0)
        .select("page_id", "n_segs", F.posexplode("segs").alias("i", "seg"))
        .groupBy("page_id", "n_segs", "i")
        .agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.count("*").alias("n"))
    )
    piece = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("*"))
    per_length = per_position.groupBy("page_id", "n_segs").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda s: s["p"]).alias("parts"),
    )
    best = per_length.groupBy("page_id").agg(F.max(F.struct("n", "n_segs", "parts")).alias("b"))
    parts = F.col("b.parts")
    leafed = F.when(F.array_contains(parts, "*"), parts).otherwise(
        F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit("*")))
    )
    return best.select(
        "page_id", F.concat(F.lit("/"), F.array_join(leafed, "/")).alias("glob"), F.col("b.n").alias("n")
    )


def derived_patterns(
    pages: DataFrame, same_origin: DataFrame, detail_links: DataFrame, scopes: DataFrame
) -> DataFrame:
    """page_id, include_pattern for unconfigured COLLECTION and DATASET scopes.

    ``scopes`` has page_id, mode, configured; ``detail_links`` holds the
    same-origin links matched by each page's detail selector.  They are read
    once: their number is counted beside them, so no second tree is built for it.
    """
    siblings = sibling_glob(same_origin).select("page_id", F.col("glob").alias("sib"), F.col("n").alias("sib_n"))
    counted = detail_links.withColumn("det_n", F.count("*").over(Window.partitionBy("page_id")))
    enough = counted.filter(F.col("det_n") >= MIN_DETAIL_LINKS)
    detail = path_template(enough).select("page_id", F.col("glob").alias("det"))
    pattern = F.when(
        (F.col("mode") == "COLLECTION") & (F.col("sib_n") >= MIN_SIBLINGS), F.col("sib")
    ).when(F.col("mode") == "DATASET", F.col("det"))
    return (
        scopes.filter(~F.col("configured"))
        .join(siblings, "page_id", "left")
        .join(detail, "page_id", "left")
        .select("page_id", "mode", pattern.alias("include_pattern"))
        .filter(F.col("include_pattern").isNotNull())
    )


def recommend_scope(pages: DataFrame, same_origin: DataFrame, hits: DataFrame) -> DataFrame:
    """Evidence-based mode per page: pagination, then siblings, then detail links.

    ``hits`` has page_id, selector_hits (anchors of the pagination selector)
    and detail_hits (elements of the detail selector).
    """
    under = F.startswith(path_of(F.col("normalized_url")), F.concat(parent_prefix(F.col("page_url")), F.lit("/")))
    evidence = same_origin.groupBy("page_id").agg(
        F.count_if(looks_like_pagination(F.col("normalized_url"))).alias("paged"),
        F.count_if(under).alias("siblings"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    facts = (
        pages.select("page_id", parent_prefix(F.col("url")).alias("prefix"))
        .join(evidence, "page_id", "left")
        .join(hits, "page_id", "left")
        .withColumns({n: zero(n) for n in ("paged", "siblings", "selector_hits", "detail_hits")})
    )
    glob = F.concat(F.col("prefix"), F.lit("/*"))
    mode = (
        F.when((F.col("selector_hits") > 0) | (F.col("paged") > 0), "PAGINATION")
        .when((F.col("siblings") >= MIN_SIBLINGS) & F.col("prefix").isNotNull(), "COLLECTION")
        .when(F.col("detail_hits") >= MIN_DETAIL_LINKS, "DATASET")
        .otherwise("CURRENT_PAGE")
    )
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = F.col("recommended_mode")
    proof = F.filter(
        F.array(
            F.when(
                (said == "PAGINATION") & (F.col("selector_hits") > 0),
                line("Pagination selector matched ", F.col("selector_hits"), " link(s) on the page."),
            ),
            F.when(
                (said == "PAGINATION") & (F.col("paged") > 0),
                line(F.col("paged"), " link(s) look like page-number links."),
            ),
            F.when(said == "COLLECTION", line(F.col("siblings"), " sibling list link(s) under '", glob, "'.")),
            F.when(
                said == "DATASET", line("Detail-link selector matched ", F.col("detail_hits"), " link(s) on the page.")
            ),
        ),
        lambda e: e.isNotNull(),
    )
    confidence = F.when(said == "PAGINATION", 0.8).when(said == "COLLECTION", 0.7).otherwise(0.6)
    return facts.withColumn("recommended_mode", mode).select(
        "page_id",
        "recommended_mode",
        confidence.alias("confidence"),
        proof.alias("evidence"),
        F.when(said == "COLLECTION", F.array(glob)).otherwise(F.array().cast("array<string>")).alias("suggested_include_patterns"),
    )


def recommend_from_analysis(repeated_selector: Column) -> Column:
    """Fallback without markup: struct(recommended_mode, confidence)."""
    has_rows = F.coalesce(repeated_selector, F.lit("")) != ""
    return F.struct(
        F.when(has_rows, "DATASET").otherwise("CURRENT_PAGE").alias("recommended_mode"),
        F.when(has_rows, 0.55).otherwise(0.6).alias("confidence"),
    )
