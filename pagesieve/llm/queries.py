"""The registered queries of this subpackage: thin wrappers that derive the agreed columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import chat, decontaminate, hardneg, hostquality, langid, linededup, mixing, pii, ranking, secrets, shard, triejoin, urlrules
from pagesieve.llm.common import durable, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query(chat.ORACLE)
def op1_snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


# All pairs with a common shingle; fit for small tables only.
_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS s, doc_id AS t FROM documents
  UNION SELECT s, y FROM reach JOIN edges ON t = x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT s AS doc_id, min(t) AS c FROM reach GROUP BY s) USING (doc_id)
"""


@query(_OP2_SQL)
def op2_trie_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return triejoin.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query(urlrules.ORACLE)
def op3_glob_automaton(spark: SparkSession, folder: str) -> DataFrame:
    judged = urlrules.judge(table(spark, folder, "pages"), urlrules.DOMAIN_RULES + urlrules.HOUSE_RULES)
    # house rules decide the verdict only; the rule column names domain rules
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("rule")).alias("rule"), "verdict")


@query(hostquality.ORACLE)
def op4_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = hostquality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(decontaminate.ORACLE)
def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.digest(found)


@query()
def op6_two_pass_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    written = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    own, slot = shard.write_shards(shard.shard(docs, 24), written)
    rows = spark.read.parquet(written)
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col(own).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op7_confirmed_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query()
def op8_viterbi_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    aside = langid.held_out()
    model = langid.learn(docs.where(~aside))
    return langid.predict(docs, model).select("doc_id", aside.alias("held_out"), "lang_pred", "score")


@query()
def op9_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query()
def op10_raked_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = durable(mixing.measured(table(spark, folder, "documents"), mixing.PRODUCTION, keep=["doc_id"]))
    mixed = mixing.mix(docs, mixing.calibrate(docs, mixing.PRODUCTION, mixing.BUDGET))
    return mixed.select("row.doc_id", F.col("tokens").alias("n_tokens"), "source", "lang", "topic", "weight", "probability", "sampled")


@query(hardneg.ORACLE)
def op11_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, folder, "embeddings"), label=label)


@query(linededup.ORACLE)
def op12_line_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kept = linededup.kept_texts(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(ranking.ORACLE)
def op13_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
