import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import linededup
from pagesieve.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck
from tests.llm.brute import low


def brute(docs, min_points=40, min_docs=5):
    """(id, lines, lines dropped, kept text) of each row."""
    key = lambda line: low(line.strip(" \t\n\x0b\f\r"))
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_points:
                holders[key(line)].add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        gone = [len(holders[k]) >= min_docs and d != max(holders[k], key=order) if (k := key(x)) in holders else False for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted(map(tuple, linededup.kept_texts(df, linededup.keep_bitmaps(df, **more)).collect()), key=repr)


def test_query_equals_its_sql(spark, folder):
    assert check(spark, "op12_line_bitmaps", QUERIES, ORACLES, folder, duck(folder)) is None


def test_query_equals_brute_force(spark, folder, texts):
    rows = QUERIES["op12_line_bitmaps"](spark, folder).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(texts)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr) and sum(r.n_dropped for r in rows) > 0


HOT = "This passage is under a license and stands in very many documents."


@pytest.mark.parametrize(("partitions", "batch"), [(4, 10_000), (37, 3)])
def test_hot_lines_straddle_partitions_and_batches(spark, partitions, batch):
    rows = [(i, f"own line number {i} that is of no interest to any other document\n  {HOT.upper() if i % 2 else HOT}\t\n{HOT}\nshort") for i in range(900)]
    rows += [(5000 + i, "a line in exactly four documents of all of these\nx") for i in range(4)] + [(6000 + i, "a line in exactly five documents of all of these\nx") for i in range(5)]
    rows += [(None, HOT)] * 300 + [(7, HOT)] * 200  # a hot row
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (partitions, batch), strict=True):
            spark.conf.set(k, v)
        assert got(df) == brute(rows)
        ranges = linededup.in_ranges(linededup.line_hashes(df, "doc_id", "text", 40))
        sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 3 * sum(sizes) / partitions  # one line has most of the rows
        assert len(linededup.verdicts(ranges)) <= 2 * partitions
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_odd_rows(spark):
    line = "Ünïcode Zeile, die in genug Dokumenten vorkommt, ähnlich wie hier"
    long_text = "\n".join([line] * 70 + [f"{i} {line}" for i in range(9000)] + [line])
    rows = [(i, f"{line}\n\n  \n{line.upper() if i == 3 else line}\nend {i}") for i in range(1, 6)]
    rows += [(None, line), (6, None), (7, ""), (8, "\n"), (9, long_text), (9, long_text), (9, "another text of the largest id\n" + line), (2, line + " "), (4, line[:39]), (4, "x" * 40), (5, "x" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("KEEP", F.lit("x")).withColumn("row_hash", F.lit(None).cast("int"))
    assert got(df) == brute(rows)
    assert got(df, min_points=1, min_docs=2) == brute(rows, 1, 2)
    assert got(df.limit(0)) == []
