"""Reading tables, durable intermediate results and compact bit sets."""

from __future__ import annotations

import gc
import itertools
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of its own only for a session on one machine that names none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"/tmp/checkpoints/{os.getpid()}")
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, wherever Spark's file systems keep it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Rows with texts reach Python in batches bounded by bytes, not by a number of rows of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def quoted(name: str) -> str:
    """A column name as it is, dots included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(taken: list[str], name: str) -> str:
    """``name``, with a number behind it if a column has that name in whatever case."""
    low = {t.lower() for t in taken}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(2))) if n.lower() not in low)


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as files in a fresh folder of the shared one, and that folder, for the caller to remove.

    Spark estimates it by the size of the files, not by the plan that made it.
    """
    folder = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's JVM collects what referred to them, which a large
    driver heap may put off until long after the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def sums(df: DataFrame, *columns) -> tuple:
    """One row of totals; what reaches the driver does not grow with the data."""
    return tuple(df.agg(*columns).first())


class BitSet:
    """A Bloom filter of given size.  A false hit only costs time and disk, never changes a result.

    Every task marks its keys in one bitmap and hands over the non-zero words;
    the words are merged with ``bit_or``.  The driver receives ``bits / 64``
    words at most, however many keys there are.
    """

    PROBES = 3

    def __init__(self, bits: int, words: np.ndarray | None = None):
        if bits & (bits - 1) or bits < 64:
            raise ValueError("bits must be a power of two, 64 at least")
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    @staticmethod
    def room(keys: int, each: int, least: int, most: int) -> int:
        """Bits for so many keys at ``each`` bits a key, between ``least`` and ``most``."""
        return min(max(1 << max(keys * each - 1, 0).bit_length(), least), max(least, most))

    def _places(self, keys: np.ndarray):
        low, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(self.PROBES):
                yield (low + np.uint64(i) * step) & np.uint64(self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for place in self._places(keys):
            np.bitwise_or.at(self.words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self._places(keys):
            found &= ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found

    @classmethod
    def of(cls, keys: DataFrame, bits: int) -> "BitSet":
        """Bits of all keys in the single long column of ``keys``."""

        def mark(batches):
            own = cls(bits)
            for batch in batches:
                if batch.num_rows:
                    own.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            at = np.flatnonzero(own.words)
            yield pa.record_batch({"at": at.astype(np.int64), "word": own.words[at].view(np.int64)})

        marked = keys.mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
        out = cls(bits)
        rows = marked.toArrow()
        out.words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
        return out


def without(docs: DataFrame, dropped: DataFrame, id_col: str, row_hash, bits: int = 1 << 24) -> DataFrame:
    """``docs`` without the rows whose id and hash are in ``dropped`` (id, row_hash), all columns as they were.

    A fixed-size bit set of the dropped hashes lets the other rows pass unshuffled;
    the rest is decided by an exact anti-join.
    """
    dropped = durable(dropped.select(F.col(dropped.columns[0]).alias("gone_id"), F.col(dropped.columns[1]).alias("gone_hash")).distinct())
    marked = BitSet.of(dropped.select("gone_hash"), bits)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(marked.has(keys.to_numpy().view(np.uint64)))

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), row_hash.alias("own_hash")).withColumn("maybe", maybe("own_hash"))
    rest = rows.where("maybe").join(dropped, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    return rows.where("NOT maybe").select("row").union(rest.select("row")).select("row.*")
