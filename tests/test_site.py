"""A nine-page fixture site: scope outcomes and breadth-first expansion."""

from pyspark.sql import functions as F

from pagesieve.operators import frontier, nodes
from pagesieve.operators.links import page_links
from pagesieve.operators.patterns import derived_patterns
from pagesieve.operators.records import selector_links
from pagesieve.operators.scope import CrawlScope, classify

H = "https://site.example"


def anchors(*hrefs):
    return "<html><body>" + "".join(f'<a href="{h}">{h}</a>' for h in hrefs) + "</body></html>"


def potato(spark):
    nav = ("/food/pizza", "/food/meat", "/about", "/contact", "/blog")
    html = anchors(*nav, "?page=2", "?page=2", "?page=3")
    return spark.createDataFrame([(1, H + "/food/potato-products", html)], "page_id long, url string, html string")


def outcome(spark, scope):
    rows = classify(page_links(potato(spark)), scope).select("normalized_url", "decision", "reason_code").collect()
    return {r.normalized_url.removeprefix(H): (r.decision, r.reason_code) for r in rows}


def test_pagination_follows_page_links_only(spark):
    got = outcome(spark, CrawlScope("PAGINATION"))
    assert sorted(u for u, d in got.items() if d[0] == "included") == ["/food/potato-products?page=2", "/food/potato-products?page=3"]
    assert sum(d == ("excluded", "EXCLUDED_SCOPE_MODE") for d in got.values()) == 5


def test_current_page_excludes_everything(spark):
    assert {d for d in outcome(spark, CrawlScope("CURRENT_PAGE")).values()} == {("excluded", "CURRENT_PAGE_SCOPE")}


def test_dataset_rule_pattern_is_a_literal_path(spark):
    html = anchors("/products/1", "/products/2", "/products/3", "/products", "/about")
    pages = spark.createDataFrame([(1, H + "/", html)], "page_id long, url string, html string")
    rows = classify(page_links(pages), CrawlScope("DATASET", link_rules=(("detail", "/products/"),))).collect()
    hit = {r.normalized_url.removeprefix(H): r.decision for r in rows}
    assert hit == {"/products/1": "excluded", "/products/2": "excluded", "/products/3": "excluded", "/products": "included", "/about": "excluded"}


def test_collection_derives_and_follows_siblings(spark):
    html = anchors("/food/a", "/food/b", "/food/c", "/food/d", "/food/beef", "https://else.example/food/x", "/about")
    pages = spark.createDataFrame([(1, H + "/food/beef", html)], "page_id long, url string, html string")
    links = page_links(pages)
    scopes = pages.select("page_id", F.lit("COLLECTION").alias("mode"), F.lit(False).alias("configured"))
    derived = derived_patterns(pages, links.filter(~F.contains("normalized_url", F.lit("else"))), links.limit(0), scopes).collect()
    assert [r.include_pattern for r in derived] == ["/food/*"]
    rows = classify(links, CrawlScope("COLLECTION", max_depth=1, include_patterns=("/food/*",))).collect()
    assert sorted(r.normalized_url for r in rows if r.decision == "included") == [f"{H}/food/{x}" for x in "abcd"]


def test_frontier_levels_cap_and_uniqueness(spark):
    edges = spark.createDataFrame(
        [("/", "/a", 1), ("/", "/b", 2), ("/a", "/b", 1), ("/a", "/c", 2), ("/b", "/d", 1), ("/c", "/", 1), ("/d", "/e", 1)],
        "src string, dst string, pos int",
    )
    seeds = spark.createDataFrame([(1, "/", 100), (2, "/", 4)], "run_id int, url string, page_cap int")
    rows = frontier.expand(seeds, edges, 10).collect()
    full = {r.url: (r.depth, r.ordinal) for r in rows if r.run_id == 1}
    assert full == {"/": (0, 1), "/a": (1, 2), "/b": (1, 3), "/c": (2, 4), "/d": (2, 5), "/e": (3, 6)}
    assert sorted(r.url for r in rows if r.run_id == 2) == ["/", "/a", "/b", "/c"]


def test_links_are_placed_by_bytes(spark, monkeypatch):
    """Beyond the bytes a task may get, more html gives more tasks, not larger ones; the links stay the same."""
    pages = spark.range(400).selectExpr("id AS page_id", "concat('https://h.example/', id) AS url", "concat('<a href=\"/x\">X</a>', repeat('<p>text</p>', 20)) AS html")
    few = page_links(pages)
    size = pages.selectExpr("sum(octet_length(html))").first()[0]
    monkeypatch.setattr(nodes, "TASK_BYTES", size // 40)
    many = page_links(pages)
    assert many.rdd.getNumPartitions() >= 40 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.select("page_id", "normalized_url").collect())) == sorted(map(tuple, few.select("page_id", "normalized_url").collect()))


def test_derived_patterns_read_details_once(spark):
    """Too few detail links give no pattern, and the details' tree stands once in the plan."""
    body = lambda n: "<ul>" + "".join(f"<li><a href='/p/{i}'>x</a></li>" for i in range(n)) + "</ul>"
    pages = nodes.place_pages(spark.createDataFrame([(i, H + "/", body(n)) for i, n in enumerate((2, 3, 4))], "page_id long, url string, html string"))
    details = selector_links(pages, nodes.elements(pages), "li a")
    scopes = pages.select("page_id", F.lit("DATASET").alias("mode"), F.lit(False).alias("configured"))
    derived = derived_patterns(pages, page_links(pages), details, scopes)
    assert {r.page_id: r.include_pattern for r in derived.collect()} == {1: "/p/*", 2: "/p/*"}
    trees = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("AS covered")
    assert trees(derived) == trees(details) > 0
