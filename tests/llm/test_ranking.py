import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import ranking
from pagesieve.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck
from tests.llm.brute import low


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def brute(docs, items, k=20):
    """(item, rank, doc, score): all scores, sorted."""
    counted = [(d, Counter(w), len(w)) for d, w in ((d, terms_of(t)) for d, t in docs) if w]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms_of(text)), []
        for d, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_its_sql(spark, folder):
    assert check(spark, "op13_hybrid_search", QUERIES, ORACLES, folder, duck(folder)) is None


@pytest.fixture
def small_blocks(monkeypatch):
    """Sizes at which lists are long, blocks are skipped and slices are many."""
    for name, value in {"SHORT": 3, "SKIP": 4, "EAGER": 2, "HELD": 50}.items():
        monkeypatch.setattr(ranking, name, value)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_equals_exhaustive_search(small_blocks, k):
    rng = np.random.default_rng(k)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 30), p=np.arange(16, 0, -1) / 136)) for _ in range(300)]
    import pyarrow as pa

    from pagesieve.llm.tokens import LETTERS_DIGITS, words

    hashes = np.unique(next(words(pa.array(list("abcdefghijklmnop")), LETTERS_DIGITS)).hashes)
    index = ranking.Index.of(pa.array(texts), hashes, 300, sum(len(t.split()) for t in texts))
    bounds = index.bounds()
    assert bounds
    skipped = 0
    for _ in range(40):
        asked = np.sort(rng.choice(16, rng.integers(1, 8), replace=False))
        worth = rng.integers(1, 5000, len(asked))
        want = np.zeros(300, np.int64)
        for t, w in zip(asked, worth, strict=True):
            p = slice(index.at[t], index.at[t + 1])
            want[index.doc[p]] += w * index.impact[p]
        doc, score = ranking.search(index, bounds, asked, worth, 1, k)
        least = np.sort(want)[::-1][k - 1]
        assert list(doc) == list(np.flatnonzero(want >= max(least, 1))) and list(score) == list(want[doc])
        high = int(want.max()) + 1
        assert not len(ranking.search(index, bounds, asked, worth, high, k)[0])
        skipped += 1
    assert skipped == 40


def test_small_blocks_change_nothing(spark, folder, texts, small_blocks):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    queries = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items, 7)
    assert got(ranking.rank(docs, queries, k=7, block_terms=100)) == want and len(want) > 100


def test_odd_rows(spark):
    docs = [(i, "common words are here " * (i % 4 + 1) + f"rare{i % 50}") for i in range(400)]
    docs += [(None, "rare7 common"), (None, "rare7 common"), (3, "rare3"), (3, "rare3"), (500, None), (501, ""), (502, "... !"), (503, "Été RARE7, été " + "x" * 200_000), (504, "filler " * 30_000 + "rare9")]
    items = [(1, "rare7 common"), (1, "rare7 common"), (2, None), (3, ""), (4, "nowhere"), (5, "RARE3 rare3 été"), (None, "x" * 200_000), (6, " ".join(f"rare{i}" for i in range(50)) + " common filler")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("Query", F.lit(1))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(None).cast("int")).withColumn("doc_id", F.lit(1))
    assert got(ranking.rank(left, right)) == brute(docs, items)
    assert got(ranking.rank(left, right, k=2, block_terms=4)) == brute(docs, items, 2)
    assert ranking.rank(left.limit(0), right).count() == 0 and ranking.rank(left, right.limit(0)).count() == 0
