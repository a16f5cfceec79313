"""Links, scope decisions, pattern mining and frontier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions.urls import with_normalized
from pagesieve.operators import frontier, patterns
from pagesieve.operators.links import discover_same_site, page_links, resolve_links, same_origin_links
from pagesieve.operators.nodes import elements, place_pages
from pagesieve.operators.records import selector_links
from pagesieve.operators.scope import (
    CrawlScope,
    classify,
    compile_scopes,
    fingerprint,
    included_per_page,
    needs_confirmation,
    normalize_scopes,
    page_cap,
)
from pagesieve.operators.select import select_elements
from pagesieve.plans.oracle_parts import LINKS, LISTED, URLS
from pagesieve.plans.registry import query
from pagesieve.sources.catalog import catalog_pages
from pagesieve.sources.tables import load


def stored(spark, folder):
    return load(spark, folder, "pages")


def rendered(spark, folder):
    return catalog_pages(load(spark, folder, "part"), load(spark, folder, "supplier"))


# Links of the rendered catalog, straight from the tables.
_H = "'https://shop.example.com"
CATALOG_LINKS = f"""{LISTED},
cat AS (
  SELECT page_id, url AS page_url, 0 AS pos, '/' AS href, 'Home' AS link_text, {_H}/' AS norm, 'link' AS kind FROM shop
  UNION ALL SELECT page_id, url, 1, '#top', 'Top', '#top', 'navigation' FROM shop
  UNION ALL SELECT page_id, url, 2, 'mailto:desk@example.com', 'Mail', 'mailto:desk@example.com', 'navigation' FROM shop
  UNION ALL SELECT page_id, url, 3, 'https://partner.example.org/x?utm_source=shop&b=1', 'Partner',
                   'https://partner.example.org/x?b=1', 'link' FROM shop
  UNION ALL SELECT page_id, url, 4, '/suppliers/' || (page_id + 1) || '/', 'Next supplier', {_H}/suppliers/' || (page_id + 1), 'link' FROM shop
  UNION ALL SELECT page_id, url, 5, '?page=2', '2', {_H}/suppliers/' || page_id || '?page=2', 'link' FROM shop
  UNION ALL SELECT page_id, url, 6, '/suppliers/' || page_id || '/', 'Self', {_H}/suppliers/' || page_id, 'link' FROM shop
  UNION ALL SELECT l.page_id, s.url, CAST(6 + row_number() OVER (PARTITION BY l.page_id ORDER BY p_partkey) AS INTEGER),
                   '../parts/' || p_partkey, p_name, {_H}/suppliers/parts/' || p_partkey, 'link'
            FROM listed l JOIN shop s USING (page_id)
)"""


@query("link_anchors", f"WITH {LINKS} SELECT page_id, pos, href, link_text FROM links")
def link_anchors(spark, folder):
    return resolve_links(stored(spark, folder)).select("page_id", "pos", "href", "link_text")


@query("link_catalog_anchors", f"WITH {CATALOG_LINKS} SELECT page_id, pos, href, link_text, norm, kind FROM cat")
def link_catalog_anchors(spark, folder):
    links = resolve_links(rendered(spark, folder))
    norm = F.when(F.col("kind") == "link", F.col("normalized_url")).otherwise(F.col("href"))
    return links.select("page_id", "pos", "href", "link_text", norm.alias("norm"), "kind")


@query("link_first_seen", f"WITH {LINKS} SELECT page_id, pos, normalized_url FROM seen")
def link_first_seen(spark, folder):
    return page_links(stored(spark, folder)).select("page_id", "pos", "normalized_url")


@query(
    "link_first_seen_repeats",
    f"""WITH {LINKS} SELECT page_id, min(pos) AS pos, normalized_url FROM links GROUP BY page_id, normalized_url""",
)
def link_first_seen_repeats(spark, folder):
    """Every page body twice over: the second copy adds no link."""
    pages = stored(spark, folder).withColumn("html", F.concat("html", "html"))
    return page_links(pages).select("page_id", "pos", "normalized_url")


@query(
    "link_same_site_limited",
    f"""WITH {LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, normalized_url
        FROM seen QUALIFY rank <= 3""",
)
def link_same_site_limited(spark, folder):
    return discover_same_site(page_links(stored(spark, folder)), limit=3).select("page_id", "rank", "normalized_url")


@query(
    "link_same_origin_set",
    f"""WITH {CATALOG_LINKS} SELECT page_id, norm AS normalized_url FROM cat
        WHERE kind = 'link' AND starts_with(norm, 'https://shop.example.com/')""",
)
def link_same_origin_set(spark, folder):
    return same_origin_links(page_links(rendered(spark, folder))).select("page_id", "normalized_url")


def _decision_sql(ladder: str, role: str) -> str:
    """Oracle for a literal scope: ``ladder`` follows the common first rules."""
    return f"""WITH {CATALOG_LINKS}, coded AS (
        SELECT *, CASE WHEN kind = 'navigation' THEN 'EXCLUDED_NAVIGATION'
            WHEN NOT starts_with(norm, 'https://shop.example.com/') THEN 'EXCLUDED_DIFFERENT_ORIGIN'
            {ladder} END AS reason_code FROM cat)
        SELECT page_id, pos, norm AS normalized_url, reason_code,
               CASE WHEN reason_code LIKE '%_MATCH' OR reason_code = 'FULL_SITE_SAME_ORIGIN' THEN 'included' ELSE 'excluded' END AS decision,
               CASE WHEN reason_code LIKE '%_MATCH' OR reason_code = 'FULL_SITE_SAME_ORIGIN' THEN {role} END AS role,
               CASE WHEN kind = 'link' THEN 1 ELSE 0 END AS depth FROM coded"""


_SELF = "WHEN norm = 'https://shop.example.com/suppliers/' || page_id THEN 'CURRENT_PAGE_SCOPE'"
_DECISION_COLUMNS = ("page_id", "pos", "normalized_url", "reason_code", "decision", "role", "depth")

_LITERAL_SCOPES = {
    "current_page": (CrawlScope("CURRENT_PAGE", exclude_patterns=("*9",)),
                     "WHEN norm LIKE '%9' THEN 'EXCLUDED_PATTERN' ELSE 'CURRENT_PAGE_SCOPE'", "NULL"),
    "pagination": (CrawlScope("PAGINATION", pagination_pattern="*parts/?5"),
                   _SELF + " WHEN regexp_matches(norm, 'parts/.5$') OR norm LIKE '%?page=2' THEN 'PAGINATION_PATTERN_MATCH'"
                   " ELSE 'EXCLUDED_SCOPE_MODE'", "'pagination'"),
    "pagination_selector": (CrawlScope("PAGINATION", pagination_selector="parts"),
                            _SELF + " WHEN norm LIKE '%?page=2' THEN 'PAGINATION_PATTERN_MATCH'"
                            " WHEN norm LIKE '%parts%' THEN 'PAGINATION_SELECTOR_MATCH' ELSE 'EXCLUDED_SCOPE_MODE'", "'pagination'"),
    "collection": (CrawlScope("COLLECTION", max_depth=1, include_patterns=("/suppliers/*",), link_rules=(("list", "/"),)),
                   _SELF + " WHEN regexp_matches(norm, '/suppliers/[^/?]+([?].*)?$') OR norm = 'https://shop.example.com/'"
                   " THEN 'COLLECTION_PATTERN_MATCH' ELSE 'EXCLUDED_SCOPE_MODE'", "'collection'"),
    "dataset": (CrawlScope("DATASET", include_patterns=("/suppliers/parts/*1",),
                           exclude_patterns=("*7",), link_rules=(("detail", "/*/*/*2"), ("dataset", "/suppliers/parts/*3"), ("nav", "/"))),
                "WHEN norm LIKE '%7' THEN 'EXCLUDED_PATTERN' " + _SELF +
                " WHEN norm LIKE '%?page=2' THEN 'PAGINATION_PATTERN_MATCH'"
                " WHEN norm LIKE '%/parts/%1' THEN 'DATASET_PATTERN_MATCH'"
                " WHEN norm LIKE '%/parts/%2' THEN 'DETAIL_LINK_SELECTOR_MATCH'"
                " WHEN norm LIKE '%/parts/%3' THEN 'DATASET_PATTERN_MATCH' ELSE 'EXCLUDED_SCOPE_MODE'",
                "CASE WHEN reason_code = 'DETAIL_LINK_SELECTOR_MATCH' THEN 'detail' ELSE 'dataset' END"),
    "full_site": (CrawlScope("FULL_SITE"), _SELF + " ELSE 'FULL_SITE_SAME_ORIGIN'", "'site'"),
    "full_site_patterns": (CrawlScope("FULL_SITE", include_patterns=("/suppliers/p*",)),
                           _SELF + " WHEN norm LIKE '%/suppliers/p%' THEN 'DATASET_PATTERN_MATCH' ELSE 'EXCLUDED_PATTERN'", "'site'"),
    "unknown_mode": (CrawlScope("SIDEWAYS"), _SELF + " ELSE 'EXCLUDED_SCOPE_MODE'", "NULL"),
}


def _register_literal(name, scope, ladder, role):
    @query(f"scope_{name}", _decision_sql(ladder, role))
    def run(spark, folder):
        return classify(page_links(rendered(spark, folder)), scope).select(*_DECISION_COLUMNS)


for _name, (_scope, _ladder, _role) in _LITERAL_SCOPES.items():
    _register_literal(_name, _scope, _ladder, _role)


@query(
    "scope_depth_limit",
    f"""WITH {CATALOG_LINKS} SELECT page_id, pos,
          CASE WHEN kind = 'navigation' THEN 'EXCLUDED_NAVIGATION'
               WHEN NOT starts_with(norm, 'https://shop.example.com/') THEN 'EXCLUDED_DIFFERENT_ORIGIN' {_SELF}
               WHEN page_id % 4 + 1 > 2 THEN 'EXCLUDED_DEPTH_LIMIT' ELSE 'FULL_SITE_SAME_ORIGIN' END AS reason_code,
          CASE WHEN kind = 'link' THEN page_id % 4 + 1 ELSE 0 END AS depth FROM cat""",
)
def scope_depth_limit(spark, folder):
    depth = (F.col("page_id") % 4).cast("int")
    done = classify(page_links(rendered(spark, folder)), CrawlScope("FULL_SITE", max_depth=2), depth)
    return done.select("page_id", "pos", "reason_code", F.col("depth").cast("bigint").alias("depth"))


def saved_scopes(pages):
    """One saved scope per page (a page is its own project here), modes in rotation."""
    k, texts = F.col("page_id") % 6, F.array().cast("array<string>")
    modes = F.array(*[F.lit(m) for m in ("CURRENT_PAGE", "PAGINATION", "COLLECTION", "DATASET", "FULL_SITE", "WEIRD")])
    rule = F.array(
        F.struct(F.lit("detail").alias("role"), F.lit("/suppliers/parts/*2").alias("pattern")),
        F.struct(F.lit("list").alias("role"), F.lit("/").alias("pattern")),
    )
    return pages.select(
        "page_id",
        F.get(modes, k.cast("int")).alias("mode"),
        F.when(k == 2, F.lit(1)).cast("int").alias("max_depth"),
        F.when(k == 2, F.array(F.lit("/suppliers/*")))
        .when(k == 3, F.array(F.lit("/suppliers/parts/*1")))
        .when(F.col("page_id") % 12 == 4, F.array(F.lit("/suppliers/p*")))
        .otherwise(texts)
        .alias("include_patterns"),
        F.array(F.lit("*3")).alias("exclude_patterns"),
        F.when(k == 1, F.lit("*parts/?")).alias("pagination_pattern"),
        F.lit(None).cast("string").alias("pagination_selector"),
        rule.alias("link_rules"),
    )


_SAVED_LADDER = r"""CASE WHEN kind = 'navigation' THEN 'EXCLUDED_NAVIGATION'
    WHEN NOT starts_with(norm, 'https://shop.example.com/') THEN 'EXCLUDED_DIFFERENT_ORIGIN'
    WHEN norm LIKE '%3' THEN 'EXCLUDED_PATTERN'
    WHEN page_id % 6 = 0 OR norm = 'https://shop.example.com/suppliers/' || page_id THEN 'CURRENT_PAGE_SCOPE'
    WHEN page_id % 6 = 1 AND (regexp_matches(norm, 'parts/.$') OR norm LIKE '%?page=2') THEN 'PAGINATION_PATTERN_MATCH'
    WHEN page_id % 6 = 2 AND (regexp_matches(norm, '/suppliers/[^/?]+([?].*)?$') OR norm = 'https://shop.example.com/') THEN 'COLLECTION_PATTERN_MATCH'
    WHEN page_id % 6 = 3 AND norm LIKE '%?page=2' THEN 'PAGINATION_PATTERN_MATCH'
    WHEN page_id % 6 = 3 AND norm LIKE '%/parts/%1' THEN 'DATASET_PATTERN_MATCH'
    WHEN page_id % 6 = 3 AND norm LIKE '%/parts/%2' THEN 'DETAIL_LINK_SELECTOR_MATCH'
    WHEN page_id % 12 = 4 THEN CASE WHEN norm LIKE '%/suppliers/p%' THEN 'DATASET_PATTERN_MATCH' ELSE 'EXCLUDED_PATTERN' END
    WHEN page_id % 6 = 4 THEN 'FULL_SITE_SAME_ORIGIN' ELSE 'EXCLUDED_SCOPE_MODE' END"""

_SAVED_REASON = r"""CASE reason_code
    WHEN 'EXCLUDED_NAVIGATION' THEN 'Skipped: looks like a navigation anchor (#, mailto, tel, javascript).'
    WHEN 'EXCLUDED_DIFFERENT_ORIGIN' THEN 'Different origin than the seed.'
    WHEN 'EXCLUDED_PATTERN' THEN CASE WHEN norm LIKE '%3' THEN 'Matched exclude pattern ''*3''.'
        ELSE 'FULL_SITE scope has include patterns and this URL matched none.' END
    WHEN 'CURRENT_PAGE_SCOPE' THEN CASE WHEN page_id % 6 = 0 THEN 'Mode is CURRENT_PAGE: only the seed URL is crawled.'
        ELSE 'Same URL as the current page.' END
    WHEN 'PAGINATION_PATTERN_MATCH' THEN CASE WHEN page_id % 6 = 1 AND regexp_matches(norm, 'parts/.$')
        THEN 'Matched pagination URL pattern ''*parts/?''.' ELSE 'URL looks like a page-number link.' END
    WHEN 'COLLECTION_PATTERN_MATCH' THEN CASE WHEN norm = 'https://shop.example.com/' THEN 'Matched related-list rule pattern ''/''.'
        ELSE 'Matched related-list include pattern ''/suppliers/*''.' END
    WHEN 'DETAIL_LINK_SELECTOR_MATCH' THEN 'Matched detail rule pattern ''/suppliers/parts/*2''.'
    WHEN 'DATASET_PATTERN_MATCH' THEN CASE WHEN page_id % 6 = 3 THEN 'Matched dataset include pattern ''/suppliers/parts/*1''.'
        ELSE 'Matched include pattern ''/suppliers/p*''.' END
    WHEN 'FULL_SITE_SAME_ORIGIN' THEN 'Same-origin link in FULL_SITE scope.'
    ELSE CASE page_id % 6 WHEN 1 THEN 'PAGINATION scope: only pagination selector/pattern matches are included.'
        WHEN 2 THEN 'COLLECTION scope: only related-list include patterns are included.'
        WHEN 3 THEN 'DATASET scope: only dataset include patterns / rules are included.'
        ELSE 'Unknown crawl scope mode ''WEIRD''.' END END"""


def _saved_decisions(pages):
    return classify(page_links(pages).join(compile_scopes(saved_scopes(pages), ["page_id"]), "page_id"))


@query(
    "scope_saved_per_project",
    f"""WITH {CATALOG_LINKS}, coded AS (SELECT *, {_SAVED_LADDER} AS reason_code FROM cat)
        SELECT page_id, pos, reason_code, {_SAVED_REASON} AS reason FROM coded""",
)
def scope_saved_per_project(spark, folder):
    return _saved_decisions(rendered(spark, folder)).select("page_id", "pos", "reason_code", "reason")


@query(
    "link_decision_counts",
    f"""WITH {LINKS}, coded AS (
          SELECT CASE WHEN normalized_url = page_norm THEN 'CURRENT_PAGE_SCOPE' ELSE 'FULL_SITE_SAME_ORIGIN' END AS reason_code FROM seen)
        SELECT 'FULL_SITE' AS mode, reason_code, count(*) AS links FROM coded GROUP BY reason_code
        UNION ALL SELECT 'CURRENT_PAGE', 'CURRENT_PAGE_SCOPE', count(*) FROM seen""",
)
def link_decision_counts(spark, folder):
    """Stored corpus under two scopes, links counted by reason."""
    links = page_links(stored(spark, folder))
    columns, modes = links.columns, ("FULL_SITE", "CURRENT_PAGE")
    for i, mode in enumerate(modes):  # both reasons on one row: the pages are read once
        links = classify(links, CrawlScope(mode)).withColumn(f"reason_{i}", F.col("reason_code"))
        links = links.select(*columns, *[f"reason_{n}" for n in range(i + 1)])
    both = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"reason_{i}").alias("reason_code")) for i, m in enumerate(modes)])
    return links.select(F.inline(both)).groupBy("mode", "reason_code").agg(F.count("*").alias("links"))


@query(
    "link_decision_counts_by_page",
    f"""WITH {LINKS}, tail AS (SELECT *, regexp_matches(href, '^/[a-m].*$') AS wanted FROM seen)
        SELECT page_id, count(*) FILTER (wanted AND NOT ends_with(href, 'e')) AS included,
               count(*) FILTER (NOT wanted OR ends_with(href, 'e')) AS excluded FROM tail GROUP BY page_id""",
)
def link_decision_counts_by_page(spark, folder):
    scope = CrawlScope("FULL_SITE", include_patterns=("/[a-m]*",), exclude_patterns=("*e",))
    done = classify(page_links(stored(spark, folder)), scope)
    return done.groupBy("page_id").agg(
        F.count_if(F.col("decision") == "included").alias("included"),
        F.count_if(F.col("decision") == "excluded").alias("excluded"),
    )


@query(
    "link_included_first_n",
    f"""WITH {CATALOG_LINKS} SELECT page_id, norm AS normalized_url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank
        FROM cat WHERE kind = 'link' AND starts_with(norm, {_H}/') AND norm <> {_H}/suppliers/' || page_id QUALIFY rank <= 5""",
)
def link_included_first_n(spark, folder):
    done = classify(page_links(rendered(spark, folder)), CrawlScope("FULL_SITE"))
    return included_per_page(done, 5).select("page_id", "normalized_url", "rank")


@query(
    "link_enqueue_choice",
    f"""WITH {CATALOG_LINKS}, ok AS (
          SELECT page_id, pos, norm, page_id % 3 AS k FROM cat WHERE kind = 'link' AND starts_with(norm, {_H}/')
            AND (page_id % 3 = 1 OR norm <> {_H}/suppliers/' || page_id))
        SELECT page_id, norm AS normalized_url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM ok
        WHERE k <> 0 QUALIFY rank <= page_id % 5""",
)
def link_enqueue_choice(spark, folder):
    pages = rendered(spark, folder)
    k = F.col("page_id") % 3
    stored_mode = F.when(k == 0, "CURRENT_PAGE").when(k == 2, "FULL_SITE")
    scopes = saved_scopes(pages).withColumns(
        {
            "mode": F.coalesce(stored_mode, F.lit("FULL_SITE")),
            "include_patterns": F.array().cast("array<string>"),
            "exclude_patterns": F.array().cast("array<string>"),
        }
    )
    links = page_links(pages)
    decided = classify(links.join(compile_scopes(scopes, ["page_id"]), "page_id"))
    picked = frontier.links_to_enqueue(decided, discover_same_site(links), stored_mode, F.col("page_id") % 5)
    return picked.select("page_id", "normalized_url", "rank")


# --- frontier -----------------------------------------------------------------------------

_GRAPH = """
edges AS (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2
  UNION ALL
  SELECT 'p' || l_partkey, 's' || l_suppkey, min(l_orderkey * 10 + l_linenumber) FROM lineitem GROUP BY 1, 2
),
seeds AS (
  SELECT s_nationkey AS run_id, 's' || min(s_suppkey) AS url, 40 + 60 * s_nationkey AS page_cap FROM supplier GROUP BY s_nationkey
),
l0 AS (SELECT run_id, url, 0 AS depth, CAST(1 AS BIGINT) AS ordinal FROM seeds)"""


def _level_sql(depth: int) -> str:
    known = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth))
    return f"""
k{depth} AS ({known}),
f{depth} AS (
  SELECT l.run_id, e.dst AS url, min((l.ordinal, e.pos)) AS first FROM l{depth - 1} l JOIN edges e ON l.url = e.src
  WHERE (l.run_id, e.dst) NOT IN (SELECT (run_id, url) FROM k{depth}) GROUP BY 1, 2),
l{depth} AS (
  SELECT f.run_id, f.url, {depth} AS depth, u.used + row_number() OVER (PARTITION BY f.run_id ORDER BY first, f.url) AS ordinal
  FROM f{depth} f JOIN (SELECT run_id, count(*) AS used FROM k{depth} GROUP BY 1) u USING (run_id)
  JOIN seeds s USING (run_id) QUALIFY u.used + row_number() OVER (PARTITION BY f.run_id ORDER BY first, f.url) <= s.page_cap)"""


@query(
    "frontier_breadth_first",
    f"WITH {_GRAPH}, {_level_sql(1)}, {_level_sql(2)}, {_level_sql(3)} "
    "SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3",
)
def frontier_breadth_first(spark, folder):
    """Supplier and part pages linked by lineitem; one capped run per nation."""
    line = load(spark, folder, "lineitem")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    pairs = line.groupBy(s.alias("s"), p.alias("p")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    edges = pairs.select(
        "pos", F.inline(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("s").alias("dst"))))
    )
    seeds = load(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("run_id")).agg(
        F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("url"), (F.max("s_nationkey") * 60 + 40).alias("page_cap")
    )
    return frontier.expand(seeds, edges, 3)


@query(
    "frontier_page_insert",
    """WITH found AS (SELECT o_custkey % 7 AS run_id, 'u' || (o_custkey % 400) AS normalized_url, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2)
       SELECT run_id, normalized_url, row_number() OVER (PARTITION BY run_id ORDER BY pos, normalized_url) AS rank FROM found
       WHERE (run_id, normalized_url) NOT IN (SELECT (c_custkey % 7, 'u' || (c_custkey % 400)) FROM customer WHERE c_acctbal < 0)
       QUALIFY rank <= 50""",
)
def frontier_page_insert(spark, folder):
    def key(column):
        url = F.concat(F.lit("u"), (F.col(column) % 400).cast("string"))
        return [(F.col(column) % 7).alias("run_id"), url.alias("normalized_url")]

    found = load(spark, folder, "orders").select(*key("o_custkey"), F.col("o_orderkey").alias("pos"))
    existing = load(spark, folder, "customer").filter("c_acctbal < 0").select(*key("c_custkey"))
    return frontier.insert_new_pages(existing, found, 50).select("run_id", "normalized_url", "rank")


def _preview_inputs(spark, folder):
    pages = rendered(spark, folder)
    named = with_normalized(pages, "url", "page_norm").select("page_id", "page_norm", (F.col("page_id") + 1).alias("max_pages"))
    return pages, named, _saved_decisions(pages)


_INCLUDED = "(reason_code LIKE '%_MATCH' OR reason_code = 'FULL_SITE_SAME_ORIGIN')"


@query(
    "frontier_preview_rows",
    f"""WITH {CATALOG_LINKS}, coded AS (SELECT *, {_SAVED_LADDER} AS reason_code FROM cat),
        sided AS (SELECT *, CASE WHEN {_INCLUDED} THEN 'included' ELSE 'excluded' END AS decision FROM coded)
        SELECT page_id, decision, norm AS normalized_url, reason_code, row_number() OVER (PARTITION BY page_id, decision ORDER BY pos) AS rank
        FROM sided
        UNION ALL SELECT page_id, 'included', {_H}/suppliers/' || page_id, 'SEED_URL', 0 FROM shop""",
)
def frontier_preview_rows(spark, folder):
    _, named, decided = _preview_inputs(spark, folder)
    return frontier.preview_rows(decided, named).select("page_id", "decision", "normalized_url", "reason_code", "rank")


@query(
    "frontier_preview_summary",
    f"""WITH {CATALOG_LINKS}, coded AS (SELECT *, {_SAVED_LADDER} AS reason_code FROM cat),
        agg AS (SELECT page_id, count(*) FILTER ({_INCLUDED}) AS n_in, count(*) FILTER (NOT {_INCLUDED}) AS n_out,
                  count(*) FILTER (reason_code IN ('EXCLUDED_SCOPE_MODE', 'CURRENT_PAGE_SCOPE')) AS unrelated,
                  count(*) FILTER (reason_code IN ('EXCLUDED_SCOPE_MODE', 'CURRENT_PAGE_SCOPE') AND norm LIKE '%/suppliers/%') AS sib FROM coded GROUP BY page_id)
        SELECT page_id, n_in + 1 AS included_count, n_out AS excluded_count, unrelated AS unrelated_same_origin_count,
               page_id + 1 AS estimated_page_count, unrelated >= 10 AS has_many_exclusions, n_in = 0 AND unrelated >= 10 AS scope_too_narrow,
               CASE WHEN n_in = 0 AND unrelated >= 10 THEN 'COLLECTION' END AS suggested_mode,
               CASE WHEN n_in = 0 AND unrelated >= 10 THEN '/suppliers/*' END AS suggested_pattern,
               CASE WHEN n_in = 0 AND unrelated >= 10 THEN sib END AS suggested_count,
               n_out / (n_in + 1 + n_out) >= 0.8 AS high_exclusion_rate FROM agg""",
)
def frontier_preview_summary(spark, folder):
    pages, named, decided = _preview_inputs(spark, folder)
    nodes = elements(place_pages(pages))
    hits = select_elements(nodes, "ul.parts a.name").groupBy("page_id").agg(F.count("*").alias("detail_hits"))
    return frontier.preview_summary(decided, named, hits)


@query(
    "scope_invalid_links",
    """SELECT s_suppkey AS page_id, href, CASE i WHEN 0 THEN 'EXCLUDED_INVALID_URL' WHEN 1 THEN 'FULL_SITE_SAME_ORIGIN' ELSE 'EXCLUDED_NAVIGATION' END AS reason_code,
              CASE i WHEN 1 THEN 'https://h.example/ok' || s_suppkey ELSE href END AS normalized_url, CASE i WHEN 1 THEN 1 ELSE 0 END AS depth
       FROM supplier, (VALUES (0, 'https://[x'), (1, '/ok'), (2, '#top')) v(i, shape), LATERAL (SELECT CASE i WHEN 1 THEN shape || s_suppkey WHEN 0 THEN shape || s_suppkey ELSE shape END AS href) h""",
)
def scope_invalid_links(spark, folder):
    """Links that are no address at all, beside good ones."""
    key = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit('<a href="https://[x'), key, F.lit('">a</a><a href="/ok'), key, F.lit('">b</a><a href="#top">c</a>'))
    pages = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("https://h.example/start").alias("url"), html.alias("html"))
    decided = classify(page_links(pages), CrawlScope(mode="FULL_SITE"))
    return decided.select("page_id", "href", "reason_code", "normalized_url", "depth")


@query(
    "frontier_preview_dataset",
    """SELECT s_suppkey AS page_id, 'DATASET' AS suggested_mode, '/item/*' AS suggested_pattern, 12 AS suggested_count, true AS scope_too_narrow FROM supplier""",
)
def frontier_preview_dataset(spark, folder):
    """Twelve links of one prefix elsewhere on the site, all left out, that a detail selector finds as well."""
    key = F.col("s_suppkey").cast("string")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit('<a class="d" href="/item/'), key, F.lit("-"), i.cast("string"), F.lit('">x</a>'))), "")
    pages = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("https://h.example/lists/all/").alias("url"), links.alias("html"))
    named = with_normalized(pages, "url", "page_norm").select("page_id", "page_norm", F.lit(50).alias("max_pages"))
    decided = classify(page_links(pages), CrawlScope(mode="COLLECTION", include_patterns=("/nothing/*",)))
    hits = select_elements(elements(place_pages(pages)), "a.d").groupBy("page_id").agg(F.count("*").alias("detail_hits"))
    out = frontier.preview_summary(decided, named, hits)
    return out.select("page_id", "suggested_mode", "suggested_pattern", "suggested_count", "scope_too_narrow")


# --- pattern mining -----------------------------------------------------------------------


@query(
    "pattern_sibling_glob",
    f"""WITH {CATALOG_LINKS} SELECT page_id, '/suppliers/*' AS glob, count(*) AS n FROM cat
        WHERE norm LIKE 'https://shop.example.com/suppliers/%' GROUP BY page_id""",
)
def pattern_sibling_glob(spark, folder):
    return patterns.sibling_glob(same_origin_links(page_links(rendered(spark, folder))))


@query(
    "pattern_prefix_glob",
    f"""WITH {LINKS}, firsts AS (SELECT page_id, '/' || left(regexp_extract(href, '^/+([^/?#;]+)', 1), 1) AS prefix, count(*) AS n
          FROM seen WHERE regexp_extract(href, '^/+([^/?#;]+)', 1) <> '' GROUP BY 1, 2)
        SELECT page_id, prefix || '/*' AS glob, n FROM firsts
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, encode(prefix) DESC) = 1""",
)
def pattern_prefix_glob(spark, folder):
    """Links regrouped under the first letter of their path, so prefixes repeat."""
    letter = F.substring(F.regexp_extract("normalized_url", "^https?://[^/]+/+([^/?#;]+)", 1), 1, 1)
    links = page_links(stored(spark, folder)).filter(letter != "")
    deeper = F.concat(F.regexp_extract("normalized_url", "^(https?://[^/]+)", 1), F.lit("/"), letter, F.lit("/x"))
    return patterns.prefix_glob(links.withColumn("normalized_url", deeper))


@query(
    "pattern_path_template",
    f"""WITH {LISTED}, n AS (SELECT page_id, count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM listed GROUP BY 1)
        SELECT page_id, '/suppliers/parts/' || CASE WHEN lo = hi AND false THEN lo::VARCHAR ELSE '*' END AS glob, n FROM n JOIN shop USING (page_id)""",
)
def pattern_path_template(spark, folder):
    links = same_origin_links(page_links(rendered(spark, folder)))
    return patterns.path_template(links.filter(F.contains("normalized_url", F.lit("/parts/"))))


@query(
    "pattern_path_template_mixed",
    """WITH paths AS (SELECT o_custkey AS page_id, o_orderstatus AS a, o_orderpriority AS b, o_orderkey AS c,
          CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS n_segs FROM orders),
        g AS (SELECT page_id, n_segs, count(*) AS n, count(DISTINCT a) AS da, min(a) AS a, count(DISTINCT b) AS db, min(b) AS b,
                     count(DISTINCT c) AS dc FROM paths GROUP BY 1, 2
              QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, n_segs DESC) = 1)
        SELECT page_id, n, '/' || CASE WHEN da = 1 THEN a ELSE '*' END || '/' ||
            CASE WHEN n_segs = 2 THEN CASE WHEN db = 1 AND da > 1 THEN b ELSE '*' END
                 ELSE CASE WHEN db = 1 THEN b ELSE '*' END || '/*' END AS glob FROM g""",
)
def pattern_path_template_mixed(spark, folder):
    """Two- and three-segment paths per customer, built from its orders."""
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.col("o_orderkey").cast("string")))
    url = F.concat(F.lit("https://h/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderpriority"), tail)
    rows = load(spark, folder, "orders").select(F.col("o_custkey").alias("page_id"), url.alias("normalized_url"))
    return patterns.path_template(rows)


@query(
    "pattern_selector_links",
    f"WITH {CATALOG_LINKS} SELECT page_id, norm AS normalized_url FROM cat WHERE pos >= 7",
)
def pattern_selector_links(spark, folder):
    pages = place_pages(rendered(spark, folder))
    return selector_links(pages, elements(pages), "li.part-card").select("page_id", "normalized_url")


@query(
    "pattern_derived_includes",
    f"""WITH {LISTED}, n AS (SELECT page_id, count(*) AS n FROM listed GROUP BY 1)
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'COLLECTION' ELSE 'DATASET' END AS mode,
               CASE WHEN page_id % 2 = 0 THEN '/suppliers/*' ELSE '/suppliers/parts/*' END AS include_pattern
        FROM shop JOIN n USING (page_id) WHERE page_id % 5 <> 0 AND (page_id % 2 = 0 OR n >= 3)""",
)
def pattern_derived_includes(spark, folder):
    unplaced = rendered(spark, folder)
    pages = place_pages(unplaced)
    links = page_links(unplaced)  # slim rows: they are placed by themselves, the html is not
    details = selector_links(pages, elements(pages), "li.part-card a.name")
    scopes = pages.select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, "COLLECTION").otherwise("DATASET").alias("mode"),
        (F.col("page_id") % 5 == 0).alias("configured"),
    )
    return patterns.derived_patterns(pages, same_origin_links(links), details, scopes)


@query(
    "pattern_recommend_scope",
    f"""WITH {LINKS}, s AS (SELECT page_id, max(regexp_matches(normalized_url, '[?&]page=') OR regexp_matches(lower(href), '^/page[/_-]?[0-9]')) AS paged FROM seen GROUP BY 1)
        SELECT p.page_id, CASE WHEN s.paged THEN 'PAGINATION' WHEN regexp_matches(p.html, '(<p>.*){{3}}') AND p.page_id % 2 = 0 THEN 'DATASET' ELSE 'CURRENT_PAGE' END AS recommended_mode,
               CASE WHEN s.paged THEN 0.8 ELSE 0.6 END AS confidence
        FROM pages p LEFT JOIN s USING (page_id)""",
)
def pattern_recommend_scope(spark, folder):
    """Detail hits stand in as paragraph counts on every other page."""
    pages = stored(spark, folder)
    hits = pages.select(
        "page_id",
        F.lit(0).alias("selector_hits"),
        F.when(F.col("page_id") % 2 == 0, F.regexp_count("html", F.lit("<p>"))).otherwise(0).alias("detail_hits"),
    )
    found = patterns.recommend_scope(pages, same_origin_links(page_links(pages)), hits)
    return found.select("page_id", "recommended_mode", "confidence")


@query(
    "pattern_recommend_selector",
    f"""WITH {LISTED} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'PAGINATION' ELSE 'COLLECTION' END AS recommended_mode FROM shop JOIN (SELECT DISTINCT page_id FROM listed) USING (page_id)""",
)
def pattern_recommend_selector(spark, folder):
    """Pages whose spec names a paging selector that finds links; the others hold none that look like paging."""
    pages = rendered(spark, folder)
    placed = place_pages(pages)
    found = selector_links(placed, elements(placed), "nav > a[href^='?']").groupBy("page_id").agg(F.count("*").alias("n"))
    hits = pages.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.coalesce("n", F.lit(0))).otherwise(0).alias("selector_hits"), F.lit(0).alias("detail_hits")
    )
    links = same_origin_links(page_links(pages)).filter(~F.contains("normalized_url", F.lit("?page=")))
    return patterns.recommend_scope(pages, links, hits).select("page_id", "recommended_mode")


@query(
    "pattern_recommend_catalog",
    f"""WITH {LISTED} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'PAGINATION' ELSE 'COLLECTION' END AS recommended_mode,
          CASE WHEN page_id % 2 = 0 THEN '1 link(s) look like page-number links.'
               ELSE (n + 2) || ' sibling list link(s) under ''/suppliers/*''.' END AS evidence,
          CASE WHEN page_id % 2 = 0 THEN '' ELSE '/suppliers/*' END AS suggested
        FROM shop JOIN (SELECT page_id, count(*) AS n FROM listed GROUP BY 1) USING (page_id)""",
)
def pattern_recommend_catalog(spark, folder):
    pages = rendered(spark, folder)
    links = same_origin_links(page_links(pages)).filter((F.col("page_id") % 2 == 0) | ~F.contains("normalized_url", F.lit("?page=")))
    hits = pages.select("page_id", F.lit(0).alias("selector_hits"), F.lit(0).alias("detail_hits"))
    found = patterns.recommend_scope(pages, links, hits)
    return found.select(
        "page_id", "recommended_mode", F.array_join("evidence", "; ").alias("evidence"),
        F.array_join("suggested_include_patterns", ",").alias("suggested"),
    )


@query(
    "pattern_recommend_from_analysis",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'DATASET' ELSE 'CURRENT_PAGE' END AS recommended_mode,
              CASE WHEN c_acctbal > 0 THEN 0.55 ELSE 0.6 END AS confidence FROM customer""",
)
def pattern_recommend_from_analysis(spark, folder):
    selector = F.when(F.col("c_acctbal") > 0, F.lit(".row"))
    found = patterns.recommend_from_analysis(selector)
    return load(spark, folder, "customer").select("c_custkey", found["recommended_mode"].alias("recommended_mode"), found["confidence"].alias("confidence"))


# --- saved scopes -------------------------------------------------------------------------


def _raw_scopes(spark, folder):
    k = F.col("c_custkey") % 5
    mode = F.when(k == 0, None).when(k == 1, "COLLECTION").when(k == 2, "DATASET").when(k == 3, "CURRENT_PAGE").otherwise("FULL_SITE")
    none = F.lit(None).cast("array<string>")
    return load(spark, folder, "customer").select(
        "c_custkey",
        mode.alias("mode"),
        F.when(k == 0, None).when(F.col("c_nationkey") % 2 == 0, "USER_CONFIRMED").otherwise("AI_SUGGESTED").alias("status"),
        (F.col("c_nationkey") % 3 - 1).alias("max_depth"),
        F.when(F.col("c_nationkey") > 5, (F.col("c_acctbal") * 3).cast("int")).alias("page_limit"),
        F.lit(None).cast("int").alias("max_pages"),
        F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("/own/*"))).otherwise(none).alias("include_patterns"),
        none.alias("link_rules"),
        F.array(F.lit(" /food/* "), F.lit("")).alias("suggested_include_patterns"),
    )


@query(
    "scope_table_normalized",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'FULL_SITE' WHEN 1 THEN 'COLLECTION' WHEN 2 THEN 'DATASET' WHEN 3 THEN 'CURRENT_PAGE' ELSE 'FULL_SITE' END AS mode,
         CASE WHEN c_custkey % 5 = 0 THEN 'SYSTEM_DEFAULTED' WHEN c_nationkey % 2 = 0 THEN 'USER_CONFIRMED' ELSE 'AI_SUGGESTED' END AS status,
         CASE WHEN c_nationkey > 5 THEN greatest(1, trunc(c_acctbal * 3)::INT) ELSE 500 END AS max_pages,
         CASE WHEN c_nationkey % 4 = 0 THEN '/own/*' WHEN c_custkey % 5 IN (1, 2) THEN '/food/*' ELSE '' END AS include_patterns,
         CASE WHEN c_custkey % 5 = 1 THEN greatest(1, c_nationkey % 3 - 1) ELSE c_nationkey % 3 - 1 END AS max_depth FROM customer""",
)
def scope_table_normalized(spark, folder):
    done = normalize_scopes(_raw_scopes(spark, folder))
    return done.select("c_custkey", "mode", "status", "max_pages", F.array_join("include_patterns", ",").alias("include_patterns"), "max_depth")


@query(
    "scope_needs_confirmation",
    """SELECT c_custkey, c_custkey % 5 NOT IN (0, 3) AND c_nationkey % 2 <> 0 AS blocked,
              least(500, CASE WHEN c_nationkey > 5 THEN greatest(1, trunc(c_acctbal * 3)::INT) ELSE 500 END, 400) AS cap FROM customer""",
)
def scope_needs_confirmation(spark, folder):
    raw = _raw_scopes(spark, folder).withColumn("blocked", needs_confirmation(F.col("mode"), F.col("status")))
    done = normalize_scopes(raw)
    return done.select("c_custkey", "blocked", page_cap(F.lit(400), F.lit(500), F.col("max_pages")).alias("cap"))


@query(
    "scope_fingerprint",
    """SELECT c_custkey, sha256('{"max_pages":' || (c_nationkey + 1) || ',"mode":"' || c_mktsegment || '"}') AS scope_hash FROM customer""",
)
def scope_fingerprint(spark, folder):
    rows = load(spark, folder, "customer").select(
        "c_custkey", F.struct((F.col("c_nationkey") + 1).alias("max_pages"), F.col("c_mktsegment").alias("mode")).alias("scope")
    )
    return rows.select("c_custkey", fingerprint(F.col("scope")).alias("scope_hash"))
