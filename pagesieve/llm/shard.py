"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash of their key into buckets that fit
in memory (their number follows from the total size).  Pass two orders a bucket
by hash, so that the outcome does not depend on arrival, and runs a
Fisher-Yates shuffle seeded by the bucket.  Shuffled buckets laid end to end
are one random order of all rows; row ``g`` of it goes to shard ``g % shards``,
slot ``g // shards``: shard sizes differ by one row at most.

The order follows from the rows (all columns), the seed and ``bucket_bytes``
alone: neither the partitioning nor a setting of the session changes it.

Defined results: every row lands exactly once, repeated rows too; rows equal in
all columns share a bucket, or as many buckets as they fill; null keys are
scattered by the other columns; an empty table gives no rows.  Other columns
travel along, whatever their names; in written shards a column of the operator
gets a number behind its name where theirs has the name (``shard_2``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField

from pagesieve.llm.common import durable, free_name, quoted, small_batches, sums

SEED = 20240607


def _fisher_yates(seed: int, slice_bytes: int = 4 << 20):
    """Shuffle one bucket; numpy's ``permutation`` is a Fisher-Yates shuffle.

    A task holds its bucket once: the order is found from the hashes alone, and
    the rows leave in slices, so no second copy of the bucket is made here or
    taken as one batch by the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        first = pc.sort_indices(group.select(["hash", "tie"]), [("hash", "ascending"), ("tie", "ascending")])
        bucket, base = group.column("bucket")[0].as_py(), group.column("base")[0].as_py()
        order = first.take(pa.array(np.random.default_rng([seed, bucket]).permutation(group.num_rows)))
        rows = group.column("row").combine_chunks()
        del group, first
        step = max(1, len(rows) * slice_bytes // max(1, rows.nbytes))
        for at in range(0, len(rows), step):
            part = order.slice(at, step)
            yield pa.record_batch({"row": rows.take(part), "place": pa.array(base + at + np.arange(len(part)))})

    return run


def _dealt_repeats(rows: DataFrame, large: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``bucket``; rows of a key in ``large`` (hash, tie, parts) go to that many buckets in turn.

    The turn is a counter within the key: the rows before it in its partition and
    in the partitions before.  How many rows a bucket gets follows from their
    number alone, so the order of all others does not depend on the partitioning.
    """
    both = rows.join(large, ["hash", "tie"], "left")
    rest = both.where("parts IS NULL").drop("parts").withColumn("bucket", F.pmod(F.col("hash"), F.lit(buckets)))
    # a checkpoint, so that a partition holds the same rows at each read
    repeats = durable(both.where("parts IS NOT NULL")).withColumn("part_no", F.spark_partition_id())
    own = Window.partitionBy("hash", "tie", "part_no")
    before = Window.partitionBy("hash", "tie").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = repeats.groupBy("hash", "tie", "part_no").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    turned = repeats.withColumn("turn", F.row_number().over(own.orderBy(F.lit(0))) - 1).join(starts, ["hash", "tie", "part_no"])
    bucket = F.pmod(F.pmod(F.col("hash"), F.lit(buckets)) + (F.col("start") + F.col("turn")) % F.col("parts"), F.lit(buckets))
    return rest.unionByName(turned.withColumn("bucket", bucket).select(*rest.columns))


def _hashable(field: StructField) -> Column:
    """A column as something to hash: maps have no order, so they go as sorted entries; what cannot be compared goes as text."""
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, MapType):
        return F.to_json(F.array_sort(F.transform(F.map_entries(column), lambda e: F.to_json(e))))
    return F.to_json(column) if "map<" in field.dataType.simpleString() else column.cast("string") if field.dataType.typeName() in ("variant", "interval") else column


def scattered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Pass one: ``row`` (struct), ``hash``, ``tie``, ``size`` and the ``bucket`` of each row."""
    # whole rows: those equal in id and text alone have an order of their own
    key = [F.col(id_col), F.col(text_col), *(_hashable(f) for f in docs.schema if f.name not in (id_col, text_col))]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), *key).alias("hash"), F.xxhash64(F.lit(seed + 1), *key).alias("tie"), (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 64).alias("size"))
    total = sums(rows, F.sum("size"))[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    if total > bucket_bytes:
        large = rows.groupBy("hash", "tie").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes)
        large = durable(large.select("hash", "tie", F.ceil(F.col("bytes") / bucket_bytes).alias("parts")))
        if not large.isEmpty():
            return _dealt_repeats(rows, large, buckets)
    return rows.withColumn("bucket", F.pmod(F.col("hash"), F.lit(buckets)))


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = 32 << 20) -> DataFrame:
    """All rows with ``place``, their position in one random order: columns ``row`` (struct) and ``place``.

    ``bucket_bytes`` is the memory a bucket may take in a task.
    """
    small_batches(docs.sparkSession)
    rows = scattered(docs, id_col, text_col, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 1024))
    # prefix sums in two levels: no task sees more than a thousand buckets or block totals
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select("bucket", (F.col("start") + F.col("own")).alias("base"))
    placed = rows.drop("size").join(bases, "bucket")
    schema = placed.select("row", F.lit(0).cast("long").alias("place")).schema
    return placed.groupBy("bucket").applyInArrow(_fisher_yates(seed), schema)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``row`` (all input columns), ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    dealt = shuffled(docs, id_col, text_col, seed, bucket_bytes)
    return dealt.select("row", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def named_apart(dealt: DataFrame, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """The shard and slot of every row beside its own columns, numbered names where theirs are taken."""
    theirs = dealt.schema["row"].dataType.names
    shard_name = free_name(theirs, shard_name)
    slot_name = free_name([*theirs, shard_name], slot_name)
    return dealt.select(F.col("shard").alias(shard_name), F.col("slot").alias(slot_name), "row.*")


def write_shards(dealt: DataFrame, folder: str) -> tuple[str, str]:
    """One Parquet folder a shard, rows in slot order inside each file.

    A task writes the rows of its own buckets to all shards, so the texts are not
    shuffled a third time; ``slot`` gives the order across the files of a shard.
    Returns the names of both columns (see ``named_apart``).
    """
    out = named_apart(dealt)
    shard_name, slot_name = out.columns[:2]
    out.sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(folder)
    return shard_name, slot_name
