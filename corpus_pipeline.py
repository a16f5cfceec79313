"""From raw documents to shuffled training shards: stages over the operators of ``pagesieve.llm``.

Each stage reads what its predecessor wrote and returns all its columns; the told
language is added by the first, as the last column, and used up by mixing.  Rows
leave by one decision a stage: no language, a near copy that is not its group's
first, benchmark passages, not drawn for the mix.

Defined results, in every stage: an empty table gives no rows; texts are judged
whole, however long; other columns travel along as they are, whatever their
names (dots, and names that differ from a helper's by case alone, too); columns
that a stage adds get a number behind their name where it is taken.  What a stage
makes of nulls, ties and repeated rows is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import decontaminate, langid, mixing, shard, triejoin
from pagesieve.llm.common import durable, free_name, quoted, remove, shared_folder, table, without

MIN_CERTAINTY = 0.3
#: Last column from the language stage to the mixing stage; the ``lang`` of the input stays as it is.
TOLD = "pipeline_told_lang"
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SHARDS = 24


def _row_hash():
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose spans are labelled with some certainty, and the language with most letters in one more column, ``TOLD``.

    Null and empty texts, and those without a letter, have no language and leave;
    a null ``lang`` is not learned from.  Where no row has a ``lang`` there is
    nothing to judge by: all rows stay, with a null ``TOLD``.  Repeated rows are
    judged alike.
    """
    model, name = langid.learn(docs), free_name(docs.columns, TOLD)
    if not model.langs:
        return docs.withColumn(name, F.lit(None).cast("string"))
    rows = docs.select(F.struct("*").alias("row"), langid.told(docs, model).alias("told"))
    kept = rows.where((F.col("told.lang") != langid.UNDETERMINED) & (F.col("told.certainty") >= MIN_CERTAINTY))
    return kept.select("row.*", F.col("told.lang").alias(name))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of similar ones: the one with the smallest id.

    Texts without words are similar to none and stay; null ids come after all
    others; of rows equal in id and text one stays, whatever their other columns.
    """
    found = durable(triejoin.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT))
    first = without(docs, found.where("NOT keeper").select("doc_id", "row_hash"), "doc_id", _row_hash())
    repeated = found.where("keeper").groupBy("doc_id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row_hash")
    if repeated.isEmpty():
        return first
    others = without(first, repeated, "doc_id", _row_hash())
    rows = first.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), _row_hash().alias("own_hash"))
    repeated = repeated.select(F.col("doc_id").alias("their_id"), F.col("row_hash").alias("their_hash"))
    again = rows.join(repeated, F.col("own_id").eqNullSafe(F.col("their_id")) & (F.col("own_hash") == F.col("their_hash")), "left_semi")
    return others.union(again.dropDuplicates(["own_id", "own_hash"]).select("row.*"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null texts hold none and stay; rows equal in id and text leave together.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(F.size("runs") > 0).select("doc_id", "row_hash"), "doc_id", _row_hash())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the targets by source, told language and topic; ``TOLD``, the last column, ends here.

    Null sources and languages belong to the rest; rows equal in id and text are
    drawn together.  By itself, without the told language, the stage tells it.
    """
    if not docs.columns[-1].startswith(TOLD):
        model, name = langid.learn(docs), free_name(docs.columns, TOLD)
        docs = durable(docs.select("*", langid.told(docs, model)["lang"].alias(name)))
    *own, told = docs.columns
    measured = mixing.measured(docs, mixing.PRODUCTION, lang_col=told, keep=own)
    mixed = mixing.mix(measured, mixing.calibrate(measured, mixing.PRODUCTION, mixing.BUDGET))
    return mixed.where("sampled").select("row.*")


def write_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard_no`` and ``slot``; rows equal in all columns take places of their own."""
    dealt = shard.named_apart(shard.shard(docs, SHARDS), "shard_no")
    return dealt.select(*map(quoted, docs.columns), *map(quoted, dealt.columns[:2]))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", write_order),
]
#: The model, the n-gram groups and the seeded draws are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
