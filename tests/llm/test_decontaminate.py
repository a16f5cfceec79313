from pyspark.sql import functions as F

from pagesieve.llm.common import table
from pagesieve.llm.decontaminate import decontaminate, digest
from pagesieve.llm.queries import QUERIES
from tests.llm import brute


def rows(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}


def test_query_equals_brute_force(spark, folder, texts):
    items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
    want = {d: v for (d, _), v in brute.contamination(texts, items).items()}
    assert rows(QUERIES["op5_winnowing"](spark, folder)) == want
    assert any(v[-1] for v in want.values())


def test_odd_rows(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:12])), (2, "short one"), (3, None), (4, ""), (5, " ".join(w[2:12])), (6, "and " * 30), (7, "x"), (8, " ".join(w[20:29])), (8, " ".join(w[20:29]))]
    docs = [
        (0, "a b " + " ".join(w[1:11]) + " z"), (1, " ".join(w[1:10])), (2, None), (3, ""), (4, "A Short ONE, x! x short-one"), (5, "and " * 500),
        (6, "ünï " + " ".join(w) + " Été"), (None, "short one"), (9, "q" * 300_000 + " short one"), (6, "ünï " + " ".join(w) + " Été"), (10, " ".join(w[5:29])), (10, "another text"),
    ]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("runs", F.lit("x"))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit(0))
    want = brute.contamination(docs, items)
    got = sorted(map(tuple, digest(decontaminate(left, right)).collect()), key=repr)
    assert got == sorted(((d, *want[d, t]) for d, t in docs), key=repr)
    none = digest(decontaminate(left, right.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert digest(decontaminate(left.limit(0), right)).count() == 0
