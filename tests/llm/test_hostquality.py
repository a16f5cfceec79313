from pyspark.sql import functions as F

from pagesieve.llm.hostquality import judge
from pagesieve.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck
from tests.llm import brute

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query(spark, folder, texts):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op4_host_rules"](spark, folder).collect()}
    assert got == {d: brute.quality(t) for d, t in texts}
    assert check(spark, "op4_host_rules", QUERIES, ORACLES, folder, duck(folder)) is None


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (3, " \n\t", "a"), (4, "x y z x y z\nx y z\n\nx y z", None), (5, "née & co | x\u00a0y  " * 40000, "b"), (None, "a b c a b c", "b"), (6, "w " * 60, "a"), (7, " ".join(f"w{i}" for i in range(60)), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(3)).withColumn("words", F.lit("?"))
    out = judge(docs).collect()
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in out), key=repr) == sorted(((d, *brute.quality(t)) for d, t, _ in rows), key=repr)
    assert all(not r.kept for r in out if r.base_failed)
    assert judge(docs.limit(0)).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i % 50 else good, "bad") for i in range(200)] + [(1000 + i, good, f"host{i % 9}") for i in range(900)]
    out = judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.host: r.n for r in out.groupBy("host").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()}
    assert kept["bad"] == 0 and all(kept[f"host{i}"] == 100 for i in range(9))


def test_suspect_hosts_must_pass_the_soft_rules(spark):
    """A document that breaks only the symbol rule goes where its host does worse than the mean, and stays elsewhere."""
    good = " ".join(f"w{i}" for i in range(60))
    marks = " ".join(f"w{i}#" for i in range(60))
    rows = [(f"host{h}", "short" if i < 10 + 3 * (h == 0) else marks if i == 99 else good) for h in range(9) for i in range(100)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = judge(docs).collect()
    assert {r.host for r in out if r.host_verdict == "suspect"} == {"host0"} and not any(r.host_verdict == "bad" for r in out)
    assert [r.host for r in out if not r.kept and not r.base_failed] == ["host0"]
    one = judge(docs.where("source = 'host1'"))
    assert {r.host_verdict for r in one.collect()} == {"trusted"}


def test_the_verdicts_fire_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = judge(docs).where("NOT base_failed AND NOT kept").collect()
    assert 0 < len(out) < 100 and all(r.failed for r in out)
