import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.llm import triejoin
from pagesieve.llm.components import components
from pagesieve.llm.queries import QUERIES
from pagesieve.llm.triejoin import near_duplicates, needed, walk
from tests.llm import brute


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), min_size=1), st.lists(st.sets(st.integers(1, 60), min_size=1), max_size=8), st.integers(20, 95))
def test_walk_finds_just_the_similar_sets(probe, members, percent):
    as_keys = lambda s: np.array(sorted(s), np.uint64)
    want = {i for i, m in enumerate(members) if 100 * len(m & probe) >= percent * len(m | probe)}
    assert set(walk(as_keys(probe), [as_keys(m) for m in members], percent)) == want
    assert all(len(members[i] & probe) >= needed(len(members[i]), len(probe), percent) for i in want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_size_estimate_of_components_does_not_multiply(spark):
    """Twelve rounds over a path; the estimate had twice as many digits after every round."""
    found = components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
    assert found.count() == 301 and found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query(spark, folder, texts):
    want = brute.similar_components(texts)
    assert rows(QUERIES["op2_trie_jaccard"](spark, folder)) == sorted(want, key=repr)
    assert any(d != c for d, _, c in want)


def test_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(30))
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (4, "ONE\ttwo"), (None, "one two"), (None, "lonely text here it is"), (None, None), (5, "x " * 50_000), (6, "x " * 70)]
    base = [word() for _ in range(120)]
    for i in range(60):  # near copies with up to six edits
        own = list(base)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(120)] = word()
        docs.append((100 + i, " ".join(own)))
    docs += [(200 + i, passage + " " + " ".join(word() for _ in range(rng.choice((2, 4, 60))))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cls", F.lit(1)).withColumn("key", F.lit("x"))
    for width, percent in ((4, 85), (5, 80)):
        assert rows(near_duplicates(df, width=width, percent=percent)) == sorted(brute.similar_components(docs, width, percent), key=repr)
    assert rows(near_duplicates(df, bits=64)) == sorted(brute.similar_components(docs), key=repr)  # bit sets that say yes to all
    assert near_duplicates(df.limit(0)).count() == 0


def test_bit_sets_grow_with_their_keys(spark):
    """A fixed size would let all keys through once there are many, and all full sets to the shuffles."""
    keys = spark.range(20_000).select(F.xxhash64("id").alias("token"))
    marked = triejoin._thin(keys, 64)
    others = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert marked.bits >= 8 * 20_000 and marked.has(others).mean() < 0.1
    assert marked.has(np.array([r.token for r in keys.collect()], np.int64).view(np.uint64)).all()
    assert triejoin._thin(keys.limit(0), 128).bits == 128


def test_the_tests_are_dealt_in_steps(spark, monkeypatch):
    """What all blocks take is dealt some at a time once it is more than a step holds; no pair is lost."""
    sets = spark.createDataFrame([(c, [k * 8 for k in range(20)] + [1000 + c]) for c in range(9)], "cls long, keys array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(a + 1, 9)], "a long, b long")
    steps, test_some = [], triejoin._test_some
    monkeypatch.setattr(triejoin, "_test_some", lambda *a: steps.append(1) or test_some(*a))
    monkeypatch.setattr(triejoin, "STEP_BYTES", 1)
    found = triejoin._test(pairs, sets, 85)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(9) for b in range(a + 1, 9)] and len(steps) == 4
    assert triejoin._test(pairs.limit(0), sets, 85).count() == 0


def test_keys_are_thinned_out_without_a_queue(spark):
    """A filter on a Python column keeps the rows in a queue that goes to disk."""
    index = spark.createDataFrame([(c, 10, 4, k, 0, c) for c in range(6) for k in (1, 2 + c)], "cls long, n int, shared int, key long, pos int, root long")
    left = triejoin._open_keys(index, 80, 64)
    assert sorted((r.cls, r.key, r.among) for r in left.collect()) == [(c, 1, 6) for c in range(6)]
    assert "ArrowEvalPython" not in left._jdf.queryExecution().executedPlan().toString()
