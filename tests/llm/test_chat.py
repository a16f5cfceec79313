from pyspark.sql import functions as F

from pagesieve.llm.chat import format_chats
from pagesieve.llm.common import table
from pagesieve.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck
from tests.llm import brute


def test_query(spark, folder):
    assert check(spark, "op1_snapshot_collapse", QUERIES, ORACLES, folder, duck(folder)) is None
    log = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r.n_turns for r in QUERIES["op1_snapshot_collapse"](spark, folder).collect()}
    assert got == {c: len(v) for c, v in brute.maximal_chats(log).items()}


def test_odd_rows(spark):
    log = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"),
        (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 5, "user", "a"), (5, 9, "assistant", "x"), (6, 0, None, None), (7, 0, "", ""), (7, 1, "", ""),
        (None, 0, "user", "z"), (8, None, "user", "q"), (8, 0, "human", "<|end|>" + "y" * 300_000), (9, 0, "user", "z"), (10, 1, "user", "r"), (10, 1, "user", "r"), (11, 1, "user", "r"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("n", F.lit("x")).withColumn("part", F.lit(2))
    got = {r.conv_id: r for r in format_chats(df).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {c: len(v) for c, v in brute.maximal_chats(log).items()}
    assert set(got) == {2, 4, 7, 8, 9, 10}
    assert got[2].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>"
    assert got[2].n_replies == 1 and "< |end|>yyy" in got[8].rendered
    assert format_chats(df.limit(0)).count() == 0


def test_rows_without_an_id_are_no_conversation(spark):
    log = [(None, i, "user", "z") for i in range(50)] + [(1, 0, "user", "z"), (2, 0, "user", "z"), (2, 1, "bot", "y")]
    got = format_chats(spark.createDataFrame(log, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_replies) for r in got] == [(2, 2, 1)]
