from pyspark.sql import functions as F

from pagesieve.llm.common import table
from pagesieve.llm.pii import CELLS, FEATURES, Trees, digest, find, fit, redact, remainder_97
from pagesieve.llm.queries import QUERIES
from tests.llm import brute


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:6] for r in QUERIES["op9_boosted_pii"](spark, folder).collect()}
    want = {r.doc_id: brute.base_pii(r.text) for r in table(spark, folder, "documents").collect()}
    assert got == want
    assert all(any(v[i] for v in got.values()) for i in range(4))


def test_trees_learn_an_interaction():
    zero = {f: 0 for f in FEATURES}
    cells = [(zero | {"digits": d, "hint": h, "joint": j}, *((40, 1) if (d == 3) != (h == 1) else (1, 40))) for d in range(5) for h in range(3) for j in range(3)]
    model = fit(cells, cells)
    when = lambda t, y, n: y if t else n
    assert all((model.score(x.get, when) >= model.threshold) == (p > n) for x, p, n in cells)
    assert fit([], []) == Trees() and CELLS < 200_000


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "né a.b@c.de, x@y y@z@q.r.s. +1 (234) 555-7777 and 4111 1111-1111 1111; 10.0.0.256 010.1.2.3.4.5.6.7"), (3, "4111111111111112 +1 2 3"),
        (None, "1" * 4000), (4, "q" * 4000 + " me@home.example.org"), (5, "1.2.3.4"), (5, "1.2.3.4"), (6, "+12-34-56-78-90-+1 222 333 4444-"), (7, "+ " * 5000 + "7 " * 5000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("id", F.lit("x"))
    got = digest(find(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((d, *brute.base_pii(t)) for d, t in rows), key=repr)
    assert find(docs.limit(0)).count() == 0
    # too long for the backtracking of the brute version
    long = spark.createDataFrame([(1, "1" * 300_000), (2, "q" * 300_000 + " me@home.example.org " + "x" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.base] for r in find(long).collect()} == {1: [], 2: [("email", 300_001, 300_020)]}


def test_added_spans_look_like_the_base_ones(spark):
    line = lambda i, number: f"please call {number} today, item {i}"
    rows = [(i, line(i, f"+1 ({200 + i}) 555-{1000 + i}")) for i in range(80)] + [(500 + i, f"price: 1{i:03d} 00{i:02d}") for i in range(80)]
    rows += [(900, line(1, "1 (202) 555-1234"))]
    found = find(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r.doc_id: r for r in found.collect()}
    assert [s.kind for s in by[900].more] == ["number_like"] and not any(by[500 + i].more for i in range(80))
    text = spark.createDataFrame([("a b@c.de f", [("email", 2, 8)], [("at_like", 1, 8), ("x", 9, 10)])], "t string, b array<struct<kind:string,start:int,end:int>>, m array<struct<kind:string,start:int,end:int>>")
    assert text.select(redact(F.col("t"), F.col("b"), F.col("m"))).first()[0] == "a[at_like] [x]"


def test_nothing_is_added_below_the_precision():
    plain = dict.fromkeys(FEATURES, 0)
    cells = [(plain, 5, 995), (plain | {"kind": 1}, 930, 70)]
    model = fit(cells, cells)
    when = lambda test, yes, no: yes if test else no
    assert model.trees and model.score(cells[1][0].get, when) > 2.0  # the default threshold
    assert not any(model.score(x.get, when) >= model.threshold for x, _, _ in cells)
    assert any(model.score(x.get, when) >= fit(cells, cells, precision=0.9).threshold for x, _, _ in cells)


def test_spans_are_confirmed_and_added(spark):
    """Account numbers, spelled-out addresses and national numbers among the documents of the table; look-alikes stay."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    good = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "me (at) example", "jane.doe[at]mail.example.org", "jane (at) mail (dot) example (dot) org"]
    bad = ["DE88 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 33", "AB12 CDEF 3456 7890 1234", "we met (at a time) there", "look [at] this!x"]
    places = "the thing was then {} and so on, whenever it came to that"
    extra = [(10**6 + i, places.format(x)) for i, x in enumerate(good)] + [(2 * 10**6 + i, places.format(x)) for i, x in enumerate(bad)] + [(3 * 10**6, "phone: 030 1234567 or fax 030-1234568, order 030 1234569")]
    found = {r.doc_id: r for r in find(docs.union(spark.createDataFrame(extra, "doc_id long, text string"))).where("size(more) > 0").collect()}
    cut = lambda d, text: [text[s.start : s.end] for s in found[d].more] if d in found else []
    for i, x in enumerate(good):
        assert any(x in y for y in cut(10**6 + i, places.format(x))), x
    assert not any(2 * 10**6 <= d < 3 * 10**6 for d in found)
    assert cut(*extra[-1]) == ["030 1234567", "030-1234568"]
    assert not [d for d in found if d < 10**6]  # the table's own documents hold none


def test_remainders(spark):
    codes = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "X"]
    by_hand = lambda c: int("".join(str(int(x, 36)) for x in (c[4:] + c[:4]))) % 97
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", remainder_97(F.col("c")).alias("r")).collect()
    assert {r.c: r.r for r in rows} == {c: by_hand(c.replace(" ", "")) for c in codes}
