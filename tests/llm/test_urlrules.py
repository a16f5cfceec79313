import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pyarrow as pa

from pagesieve.llm.queries import ORACLES, QUERIES
from pagesieve.llm.urlrules import DOMAIN_RULES, HOUSE_RULES, Automaton, judge
from tests.compare import check, duck
from tests.llm import brute

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab/*", max_size=90), min_size=1, max_size=6), st.lists(st.text("ab/é", max_size=40), min_size=1, max_size=6))
def test_automaton_equals_regex(globs, strings):
    automaton = Automaton(globs)
    state = automaton.run(pa.array(strings))
    for i, glob in enumerate(globs):
        pattern = "".join("[^/]*" if x == "*" else ".*" if x[0] == "*" else re.escape(x) for x in re.findall(r"\*\*|.", glob))
        assert automaton.matches(state, i).tolist() == [bool(re.fullmatch(pattern, s)) for s in strings]


def test_query(spark, folder):
    assert check(spark, "op3_glob_automaton", QUERIES, ORACLES, folder, duck(folder)) is None


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "x://org", "x://org?/", "x://org/", "x://evil.com/a.org/es/", "a://b://c.com/fr/?q", "x://com/de/", "x://notcom/de/", "x://a.ÉXAMPLE.org/en/12", "x://a.example.org/en/12", "x://com/fr/" + "z" * 100_000, "x://com/de/", "x://example.org/en/1#a", "x://spam-farm.net/a"]
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit("x"))
    got = judge(pages, DOMAIN_RULES + HOUSE_RULES).collect()
    want = []
    for i, url in rows:
        host, path = brute.url_parts(url)
        fit = max(((len(h + p), h + p, v) for v, h, p in RULES if brute.fits(h, p, host, path)), default=None)
        want.append((i, host, path, *(fit[1:] if fit else (None, None))))
    assert sorted(((r.page_id, r.host, r.path, *((r.rule, r.verdict) if r.tier == 1 else (None, None))) for r in got), key=repr) == sorted(want, key=repr)
    assert [r.verdict for r in got if "spam" in r.host] == ["block"]
    assert judge(pages.limit(0), DOMAIN_RULES).count() == 0
