"""Top-k per group that stays bounded when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.session import cut_lineage

SALTS = 64
#: A larger limit is no bound for a task: ranks are then counted up over partitions.
MOST_IN_A_TASK = 100_000


def ranked_rows(df: DataFrame, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """Rank of every row in its group (from 1), also where one group holds most of the table.

    Rows are range-partitioned by group and order and written; each partition
    numbers its own rows, and the rows of the partitions before are added (one
    count for a group and partition).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)).withColumn("__part", F.spark_partition_id())
    counts = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    theirs = starts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__their_part"), "__start")
    same = F.col("__part") == F.col("__their_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    numbered = placed.withColumn("__own", own).join(theirs, same)
    return numbered.select(*df.columns, (F.col("__own") + F.col("__start")).cast("long").alias(rank))


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str, salt_by: list[str]
) -> DataFrame:
    """First ``limit`` rows of each group, ranked from 1 in column ``rank``.

    Rows are ranked inside (group, salt) first, so no task sorts a whole hot
    group; at most ``SALTS * limit`` rows of a group reach the second ranking.
    ``salt_by`` names columns that vary inside a group.  Beyond ``MOST_IN_A_TASK``
    see :func:`ranked_rows`.
    """
    if limit > MOST_IN_A_TASK:
        return ranked_rows(df, keys, order, rank).filter(F.col(rank) <= limit)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    kept = salted.withColumn("__r", first).filter(F.col("__r") <= limit).drop("__r", "__salt")
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return kept.withColumn(rank, final).filter(F.col(rank) <= limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key, as a mergeable aggregate.

    Unlike a window this combines on the map side, so a key that owns a third
    of the table sends one row per task through the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("__row")
    out = df.groupBy(*keys).agg(newest)
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in df.columns if c not in keys])
