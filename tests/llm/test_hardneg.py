import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import hardneg
from pagesieve.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """The rule in plain Python integers."""
    last = lambda x: (x is None, x or 0)
    own = set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(float(np.float32(x)) * 256) for x in v)
        if sum(x * x for x in q) < hardneg.MOST_LENGTH:
            own.add((i, label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905  the shorter one is filled up with zeros
    out = []
    for a in own:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((dot(a[2], b[2]), b) for b in own if b is not a), key=lambda s: (-s[0], last(s[1][0])))
        for score, p in [s for s in scored if s[1][1] == a[1]][:positives]:
            inside = [s for s in scored if s[1][1] != a[1] and low * score <= 100 * s[0] <= high * score]
            out += [(a[0], p[0], r + 1, n[0], score, s) for r, (s, n) in enumerate(inside[:negatives])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_its_sql(spark, folder):
    assert check(spark, "op11_residue_negatives", QUERIES, ORACLES, folder, duck(folder)) is None


@pytest.mark.parametrize(("size", "width"), [(200, 3), (70_000, 64), (500_000, 200), (2**20, 7)])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (17, width)), rng.integers(-size, size + 1, (31, width))
    a[0], b[0], b[1] = size, size, -size
    primes = hardneg.primes_for(int(max((a * a).sum(1).max(), (b * b).sum(1).max())))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    assert (hardneg.scores(a, b, primes) == want).all()


def test_sums_at_the_edge_of_float32():
    """Residues of the largest size and one sign, and lengths that need one more prime."""
    for p in hardneg.PRIMES:
        assert hardneg.DEPTH * (p // 2) ** 2 < 2**24
        a = np.full((1, 64), p // 2)
        assert hardneg._product(a, a, p)[0, 0] == 64 * (p // 2) ** 2 % p
    assert len(hardneg.primes_for(510)) == 1 and len(hardneg.primes_for(511)) == 2
    assert np.prod([float(p) for p in hardneg.primes_for(hardneg.MOST_LENGTH)]) < 2**62


def test_blocks_change_nothing(spark, folder, monkeypatch):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = got(hardneg.mine(table, every=10))
    assert len(want) > 50 and want == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()], every=10)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hardneg, "ROW_BLOCK", 17)
    assert got(hardneg.mine(table, every=10)) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.4, 6)
    rows = [(i, (base + rng.normal(0, 0.3, 6)).astype("float32").tolist(), int(rng.integers(0, 3))) for i in range(1, 260)]
    hot = (base * 0.9).astype("float32").tolist()
    rows += [(1000 + i, hot, i % 3) for i in range(120)]  # ties
    rows += [(50, hot, 1)] * 40 + [(None, hot, 2)] * 3  # repeated rows, null ids
    rows += [(100, None, 1), (150, [None, 1.0], 1), (200, [float("nan")] * 6, 2), (200, [float("inf")] * 6, 1), (300, [1e30] * 6, 0), (350, hot, None)]
    rows += [(400, [], 0), (450, [0.5, 0.5], 1), (500, [90.0] * 9, 2), (550, [-x for x in hot], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row_no", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("Anchor", F.lit(None).cast("int"))
    assert got(hardneg.mine(df)) == brute(rows)
    assert hardneg.mine(df.limit(0)).count() == 0
    assert hardneg.mine(df.where("vec_id % 50 <> 0")).count() == 0
