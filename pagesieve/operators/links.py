"""Anchors of a page corpus as rows: extraction, resolution, per-page dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.globs import PLAIN, first_match, literal_rule
from pagesieve.functions.text import decode_entities, inner_text, strip_ends, without_code
from pagesieve.functions.urls import (
    drop_parts,
    is_navigation,
    origin_of,
    with_normalized,
    with_normalized_reference,
    with_parts,
)
from pagesieve.operators.nodes import partitions_for

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_ANCHOR = r"(?i)<a\s" + _ATTRS + r">[\s\S]*?(?=</a\s*>|<a\s|$)"
_OPEN = r"(?i)^<a\s(" + _ATTRS + r")>"
_HREF = r"(?i)(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def extract_anchors(pages: DataFrame) -> DataFrame:
    """One row per ``<a href>`` in page order: page_id, page_url, pos, href, link_text.

    The explode prunes ``html``, so only slim rows leave the scan stage.
    """
    anchors = F.regexp_extract_all(without_code(F.col("html")), F.lit(_ANCHOR), F.lit(0))
    opened = F.regexp_extract(F.col("anchor"), _OPEN, 1)
    href = F.concat(*[F.regexp_extract(F.col("attrs"), _HREF, g) for g in (1, 2, 3)])
    return (
        pages.withColumnRenamed("url", "page_url")
        .select("*", F.posexplode(anchors).alias("anchor_pos", "anchor"))
        .drop("html")
        .withColumn("attrs", opened)
        .filter(F.rlike(F.col("attrs"), F.lit(_HREF)))
        .withColumn("href", strip_ends(decode_entities(href)))
        .withColumn("link_text", F.nullif(inner_text(F.regexp_replace(F.col("anchor"), _OPEN, "")), F.lit("")))
        .drop("anchor", "attrs")
        .withColumnRenamed("anchor_pos", "pos")
    )


def resolve_links(pages: DataFrame) -> DataFrame:
    """Anchors with normalized_url, page_norm and kind (navigation/invalid/link)."""
    keyed = with_normalized(with_parts(pages, "url", "b_"), "url", "page_norm")
    links = with_normalized_reference(extract_anchors(keyed), "href", "b_", "normalized_url")
    return drop_parts(links, "b_").withColumn(
        "kind",
        F.when(is_navigation(F.col("href")), "navigation")
        .when(F.col("normalized_url").isNull(), "invalid")
        .otherwise("link"),
    )


def first_seen(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """Keep the first link per (page, URL); navigation and invalid rows all stay.

    Rows are placed by page once; the per-page operators downstream group on
    the same key and need no further exchange.  Without ``partitions`` adaptive
    execution merges them by the cores at hand.
    """
    key = F.when(F.col("kind") == "link", F.col("normalized_url")).otherwise(
        F.concat(F.lit("\u0000"), F.col("pos").cast("string"))
    )
    order = Window.partitionBy("page_id", "__key").orderBy("pos")
    return (
        links.withColumn("__key", key)
        .transform(lambda rows: rows.repartition("page_id") if partitions is None else rows.repartition(partitions, "page_id"))
        .withColumn("__seen", F.row_number().over(order))
        .filter(F.col("__seen") == 1)
        .drop("__key", "__seen")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Deduplicated resolved links of every page, in as many partitions as the bytes of html ask for."""
    return first_seen(resolve_links(pages), partitions_for(pages))


def same_origin_links(links: DataFrame) -> DataFrame:
    """Followable links that stay on the page's own origin."""
    return links.filter(
        (F.col("kind") == "link") & (origin_of(F.col("normalized_url")) == origin_of(F.col("page_url")))
    )


def discover_same_site(links: DataFrame, include=(), exclude=(), limit: int | None = None) -> DataFrame:
    """Same-origin links passing whole-URL globs, ranked per page; the first ``limit`` if given."""
    url = F.col("normalized_url")
    whole = lambda patterns: [literal_rule(p, PLAIN)._replace(on_path=False) for p in patterns]
    kept = same_origin_links(links)
    if exclude:
        kept = kept.filter(first_match(url, whole(exclude)).isNull())
    if include:
        kept = kept.filter(first_match(url, whole(include)).isNotNull())
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    ranked = kept.withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)
