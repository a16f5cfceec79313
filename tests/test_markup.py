from pyspark.sql import functions as F

from pagesieve.functions.text import decode_entities
from pagesieve.operators import records
from pagesieve.operators.nodes import elements, place_pages, with_texts
from pagesieve.operators.records import FieldSpec, header_score
from pagesieve.operators.select import is_valid, relaxed, select_elements

BROKEN = (
    '<!DOCTYPE html><html><body><ul id=u><li class="a b">One<li class=a>Two <b>x</b><ul><li>n1<li>n2</ul><li data-k=\'3\' title="a > b">Three &amp; four</ul>'
    '<p><b>bold<br><p>para <a href="/x">link</a> tail</p><div class="c"><span>s1</span><i>mis<b>nest</i>ed</b></div></body></html>'
)


def site(spark, *bodies):
    rows = [(i, f"https://h.example/{i}", body) for i, body in enumerate(bodies)]
    return place_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def texts(spark, body, selector):
    pages = site(spark, body)
    return [r.text for r in with_texts(select_elements(elements(pages), selector), pages).orderBy("open_pos").collect()]


def test_unclosed_items_and_paragraphs(spark):
    assert texts(spark, BROKEN, "#u > li") == ["One", "Two x n1 n2", "Three & four"]
    assert texts(spark, BROKEN, "li li") == ["n1", "n2"]
    assert texts(spark, BROKEN, "body > p") == ["bold", "para link tail"]


def test_selectors(spark):
    assert texts(spark, BROKEN, "[data-k]") == ["Three & four"]
    assert texts(spark, BROKEN, "[class^=a]") == ["One", "Two x n1 n2"]
    assert texts(spark, BROKEN, "ul > li > ul > li:nth-child(2), div.c span") == ["n2", "s1"]
    assert texts(spark, BROKEN, "#u > li:nth-of-type(2) b") == ["x"]
    assert [is_valid(s) for s in ("td:nth-child(3) p", "a >", "..x", "", "p::before")] == [True, False, False, False, False]
    assert relaxed("td:nth-child(3) p span") == ["td:nth-child(3) p span", "td:nth-child(3) p", "td:nth-child(3)"]
    assert relaxed("td p.title") == ["td p.title"]


def test_entities(spark):
    given = ["a &amp; b", "&eacute;&#233;&#xE9;", "&unknown; &", "&#128512;", "x&nbsp;y", "&lt;p&gt; &quot;"]
    want = ["a & b", "ééé", "&unknown; &", "😀", "x y", '<p> "']
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string")
    assert [r.o for r in df.orderBy("i").select(decode_entities(F.col("t")).alias("o")).collect()] == want


FOOD = (
    '<table class="odd"><thead><tr><th>Food</th><th>Serving</th><th>kcal</th><th>kJ</th></tr></thead><tbody>'
    "<tr><td>Beef Filet</td><td>100 g</td><td>143</td><td>598</td></tr><tr><td>Veal</td><td>100 g</td><td>215</td><td>900</td></tr></tbody></table>"
)


def test_table_fallback_maps_headers_and_numbers(spark):
    pages = site(spark, FOOD)
    fields = [FieldSpec("Food", ".none"), FieldSpec("Calories", ".none2", "number"), FieldSpec("Kilojoules", ".none3", "number")]
    found = records.typed(records.extract_structured(pages, elements(pages), fields, ".row"), fields).orderBy("record_ordinal").collect()
    assert [(r.strategy, r.Food, r.Calories, r.Kilojoules) for r in found] == [("table", "Beef Filet", 143.0, 598.0), ("table", "Veal", 215.0, 900.0)]


def test_header_scores(spark):
    pairs = [("ID", "Video ID", 52), ("ID", "ID", 100), ("Title", "Subtitle", 10), ("Calories", "kcal", 58), ("cal", "Physical Activity", 0)]
    row = spark.range(1).select(*[header_score(F.lit(a), F.lit(b)).alias(str(i)) for i, (a, b, _) in enumerate(pairs)]).first()
    assert [row[str(i)] for i in range(len(pairs))] == [s for _, _, s in pairs]


def test_nested_containers_each_get_their_fields(spark):
    body = '<div class="i"><b>1</b><div class="i"><b>2</b></div></div><div class="i"><b>3</b></div>'
    pages = site(spark, body)
    found = records.from_containers(pages, elements(pages), [FieldSpec("n", "b")], ".i").orderBy("record_ordinal").collect()
    assert [r.n for r in found] == ["1", "2", "3"]


def test_empty_first_hit_of_the_working_variant_stays_empty(spark):
    body = '<div class="i"><td><p></p>text</td></div>'
    pages = site(spark, body)
    found = records.from_containers(pages, elements(pages), [FieldSpec("n", "td p"), FieldSpec("t", "td")], ".i").collect()
    assert [(r.n, r.t) for r in found] == [(None, "text")]


def test_images_and_links_resolve(spark):
    body = '<div class="i"><a href="../x?y=1#z">go</a><img srcset="a.png 1x, b.png 2x"></div>'
    pages = site(spark, body)
    fields = [FieldSpec("link", "a", "url"), FieldSpec("image", "img", "image")]
    found = records.from_containers(pages, elements(pages), fields, ".i").first()
    assert (found.link, found.image) == ("https://h.example/x?y=1#z", "https://h.example/a.png")


def test_markdown_keeps_language_nesting_and_cells(spark):
    from pagesieve.operators.content import markdown

    html = (
        "<main><pre><code class='language-python'>x = 1</code></pre><div class='highlight-sql'><pre>select 1</pre></div>"
        "<ul><li>a<ul><li>b<ol><li>c</li></ol></li></ul></li><li>d</li></ul>"
        "<table><tr><th>H</th><th>K</th></tr><tr><td>1</td><td>2</td></tr></table></main>"
    )
    pages = place_pages(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string"))
    text = markdown(pages, elements(pages), primary="main").first().text
    assert "```python\n" in text and "```sql\nselect 1\n```" in text
    assert "- a\n  - b\n    1. c\n- d" in text
    assert "| H | K |\n| --- | --- |\n| 1 | 2 |" in text


def test_nothing_is_cut(spark):
    """More containers than any former cap, and a page over two megabytes."""
    from pagesieve.operators.records import FieldSpec, from_containers
    from pagesieve.sources.tables import scan_pages

    html = "<ul>" + "".join(f"<li class='card'><b>{i}</b></li>" for i in range(1500)) + "</ul>"
    pages = place_pages(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string"))
    assert from_containers(pages, elements(pages), [FieldSpec("n", "b")], "li.card").count() == 1500
    big = spark.createDataFrame([(2, "u", "x" * (3 << 20))], "page_id long, url string, html string")
    row = scan_pages(big).first()
    assert row.analyzed_bytes == 3 << 20 and not row.truncated and len(row.html) == 3 << 20


def test_frontier_goes_beyond_five_thousand_pages(spark):
    from pagesieve.operators.frontier import expand

    seeds = spark.createDataFrame([(1, "s", None), (2, "s", 50)], "run_id long, url string, page_cap long")
    edges = spark.range(6000).selectExpr("'s' AS src", "concat('p', id) AS dst", "id AS pos")
    n = {r.run_id: r["count"] for r in expand(seeds, edges, 2).groupBy("run_id").count().collect()}
    assert n == {1: 6001, 2: 50}


def test_partitions_grow_with_the_pages(spark, monkeypatch):
    """Tasks hold a bounded number of bytes, and elements stay where the pages were placed."""
    from pagesieve.operators import nodes

    monkeypatch.setattr(nodes, "TASK_BYTES", 4_000)
    html = "<ul>" + "<li class='c'><b>x</b></li>" * 20 + "</ul>"
    frame = lambda n: spark.createDataFrame([(i, "http://a/", html) for i in range(n)], "page_id long, url string, html string")
    sizes = {n: place_pages(frame(n)).rdd.getNumPartitions() for n in (300, 900)}
    assert sizes == {n: -(-n * len(html) // 4_000) for n in sizes}
    pages = place_pages(frame(300))
    found = records.from_containers(pages, elements(pages), [FieldSpec("n", "b")], "li.c")
    assert found.count() == 6_000
    assert nodes.place_pages(frame(300).limit(0)).count() == 0


def test_alternate_mode_reads_the_tree_once(spark):
    """Rows of nested tables count for each table around them; one tokenisation gives all facts."""
    from pagesieve.operators.profile import alternate_mode

    nested = "<table><tr><td><table><tr><td>a</td></tr><tr><td>b</td></tr></table></td></tr></table><table><tr></tr></table>"
    bodies = (
        nested, "<table><tr></tr><tr></tr></table><tr></tr>", "<ul>" + "<li class='x y'>1" * 12 + "</ul>", "<p>" + "w" * 700 + "<p><b>" + "w" * 500 + "</b>",
        "<article>a</article>", "<p>" + "w" * 1199 + "<ul>" + "<li class=x>1" * 11 + "</ul>", "",
    )
    pages = site(spark, *bodies)
    for mode, hit, out in (("content", {0, 2}, "STRUCTURED"), ("STRUCTURED", {3, 4}, "CONTENT")):
        found = alternate_mode(pages, elements(pages), F.lit(mode))
        assert {r.page_id: r.suggestion for r in found.collect()} == {i: out if i in hit else None for i in range(len(bodies))}
    plan = alternate_mode(pages, elements(pages), F.col("url"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_pages_read_once_stay_in_place(spark, monkeypatch):
    """What is read from written pages and elements keeps the partitions their bytes gave."""
    from pagesieve.operators import nodes
    from pagesieve.operators.profile import repeated_classes

    monkeypatch.setattr(nodes, "TASK_BYTES", 4_000)
    html = "<ul>" + "<li class='c'><b>x</b></li>" * 20 + "</ul>"
    pages = spark.createDataFrame([(i, "http://a/", html) for i in range(100)], "page_id long, url string, html string")
    held, found = nodes.read_once(pages, ("li",))
    count = -(-100 * len(html) // 4_000)
    assert [df.rdd.getNumPartitions() for df in (held, found, elements(held), repeated_classes(found))] == [count] * 4
    assert found.filter("text = 'x' AND tag = 'li'").count() == 2_000


def test_table_samples_read_the_tree_once(spark):
    """Cells of nested rows and tables count for each of them; tables without rows have a number."""
    from pagesieve.operators.profile import Limits, table_samples

    inner = "<table><tr><td>c</td></tr><tr><td>d</td></tr></table>"
    pages = site(spark, f"<table></table><table><tr><td>a</td><th>b</th></tr><tr><td>x{inner}</td></tr></table>", "<p>none</p>")
    found = lambda *limits: {
        (r.table_idx, r.row_idx): r.line for r in table_samples(pages, elements(pages), *limits).collect()
    }
    every = {(2, 1): "a | b", (2, 2): "x c d | c | d", (2, 3): "c", (2, 4): "d", (3, 1): "c", (3, 2): "d"}
    assert found() == every
    assert found(Limits(tables=2, table_rows=2)) == {k: v for k, v in every.items() if k[0] <= 2 and k[1] <= 2}
    plan = table_samples(pages, elements(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
