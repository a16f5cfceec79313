import pytest
from pyspark.sql import functions as F

from pagesieve.operators import specs
from pagesieve.operators.nodes import elements, place_pages
from pagesieve.operators.select import SelectorError, compile_selector, relaxed, relative, select_many

SELECTORS = [
    "li", "ul > li", "ul li.a", "li.a.b", "#x", "*", "div *", "[data-k]", "[data-k='1']", "a[href^=\"/p\"]", "a[href$=html]", "a[href*=x]", "[class~=b]", "[lang|=en]",
    "li:nth-child(2)", "li:nth-child(odd)", "li:nth-child(2n+1)", "li:nth-child(-n+2)", "li:nth-last-child(1)", "p:nth-of-type(2)", "p:nth-last-of-type(even)", "li:first-child", "li:last-child",
    "p:only-child", "p:only-of-type", "span:empty", "li:not(.a)", "li:not(:first-child)", ":not(li)", "h1 + p", "h1 ~ p", "ul>li+li", "ul > li ~ li a", "div > ul > li > a", "li a, h1", "p ,span", "div li:not([data-k]) > a",
    "a[title='x, y > z']", "body div.box p ~ span", "ul li + li > a[href]",
]
BAD = ["", ",", "li,", "li::before", "a >", "> a", "a > > b", "a:hover", "li:nth-child(x)", ".", "a[", "b(c)", "li:not(a b)", "a.b c:not()", "1a"]
HTML = """<html><body><div class="box"><h1 id=x>T</h1><p lang="en-GB">one <b>b</b></p><p>two</p><span></span>
<ul><li class="a b" data-k="1"><a href="/p/1.html" title="x, y > z">A</a></li><li class="a"><a href="/x">B</a><p>only</p></li><li><a>C</a></li></ul></div>
<div><p>three</p><ul><li data-k=2><span>s</span><a href='/p/2'>D</a></li></ul></div></body></html>"""


def stored(spark, rows):
    return spark.createDataFrame(rows, specs.SPEC_SCHEMA)


def test_selectors_of_a_table_select_like_literal_ones(spark):
    pages = place_pages(spark.createDataFrame([(i, f"https://h.com/{i}", HTML if i else "<p>x</p>") for i in range(2)], "page_id long, url string, html string"))
    texts = spark.createDataFrame([(i, t) for i in range(2) for t in SELECTORS + BAD], "page_id long, text string")
    compiled = specs.compile_selectors(texts)
    assert {r.text for r in compiled.filter("tests IS NULL").select("text").distinct().collect()} == set(BAD)
    longest = compiled.agg(F.max("step")).first()[0]
    steps = compiled.filter("tests IS NOT NULL").groupBy("page_id").agg(F.collect_list(F.struct(F.col("text").alias("sel"), "alt", "step", "last", "link", "next_link", "tests", F.lit(0).alias("uses"))).alias("steps"))
    nodes = elements(pages)
    got = {(r.page_id, r.sel, r.open_pos) for r in specs.select_by_steps(specs.satisfied_steps(nodes, steps), longest).collect()}
    want = {(r.page_id, r.key, r.open_pos) for r in select_many(nodes, {s: s for s in SELECTORS}).collect()}
    assert got == want and {s for _, s, _ in want} >= set(SELECTORS) - {"p:only-child"}


@pytest.mark.parametrize("text", BAD)
def test_bad_selectors_are_bad_for_both(text):
    with pytest.raises((SelectorError, IndexError)):
        if not compile_selector(text) or not text:
            raise SelectorError(text)


def test_relaxed_and_relative_columns(spark):
    texts = ["td p span", "p", "a > span", "li.x em b i", "", " a  b ", "h1 + b i", "ul.l li > a", "ul.l", "ul.l > li", None]
    rows = spark.createDataFrame([(t, "ul.l") for t in texts], "t string, c string")
    got = rows.select("t", specs.relaxed_column(F.col("t")).alias("r"), specs.relative_column(F.col("t"), F.col("c")).alias("s")).collect()
    for r in got:
        if r.t is not None:
            assert (r.r, r.s) == (relaxed(r.t), relative(r.t, "ul.l")), r.t


FIELD = {"type": "string", "label": None, "user_label": None, "selected": True, "required": False}


def field(name, selector, **more):
    f = {**FIELD, **more}
    return (name, selector, f["type"], f["label"], f["user_label"], f["selected"], f["required"])


def test_odd_specs(spark):
    pages = spark.createDataFrame([(i, f"https://h.com/{i}/", HTML, i) for i in range(7)] + [(9, "https://h.com/9", None, 1), (10, "https://h.com/10", HTML, None)], "page_id long, url string, html string, spec_id long")
    rows = [
        (0, "li", [field("t", "a"), field("k", "li[data-k]", required=False)]), (1, None, None), (2, "li", []), (3, None, [field("t", "h1", user_label="Title"), field("b", "b")]),
        (4, "li", [field("t", "p", required=True)]), (5, "x:y", [field("", ""), field("u", "a", type="URL")]), (77, "li", [field("t", "a")]),
    ]
    out = specs.extract_stored(pages, stored(spark, rows)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.page_id, r.record_ordinal)):
        by.setdefault(r.page_id, []).append((r.strategy, {v.field: v.value for v in r["values"]}, r.warnings))
    assert set(by) == {0, 3, 4, 5}
    assert [v[1]["t"] for v in by[0]] == ["x, y > z", "B", "C", "D"] and {v[0] for v in by[0]} == {"containers"}
    assert by[3] == [("field_index", {"Title": "T", "b": "b"}, [])]
    assert by[4] == [("containers", {"t": "only"}, [])]
    assert [v[1]["u"] for v in by[5]][:2] == ["https://h.com/p/1.html", "https://h.com/x"]
    assert by[5][0][2] == ["field has no selector.", "Repeated item selector is invalid: x:y"]
    assert specs.extract_stored(pages.limit(0), stored(spark, rows)).count() == 0


def test_the_plan_does_not_grow_with_the_specs(spark):
    pages = spark.createDataFrame([(i, "https://h.com/", HTML, i) for i in range(40)], "page_id long, url string, html string, spec_id long")
    size = []
    for n in (2, 40):
        rows = [(i, "ul > li", [field(f"f{j}", f"a.c{i}, li:nth-child({j + 1}) > a") for j in range(1 + i % 4)]) for i in range(n)]
        compiled = specs.compile_specs(stored(spark, rows))
        plan = specs.selected_uses(place_pages(pages), compiled)._jdf.queryExecution().optimizedPlan().toString()
        size.append(plan.count("\n"))
    assert size[0] == size[1]
