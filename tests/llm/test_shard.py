import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagesieve.llm.queries import QUERIES
from pagesieve.llm.shard import SEED, _fisher_yates, scattered, shard, write_shards


def gapless(pairs):
    slots = defaultdict(list)
    for s, slot in pairs:
        slots[s].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return {s: len(v) for s, v in slots.items()}


def test_query(spark, folder, texts):
    rows = QUERIES["op6_two_pass_shuffle"](spark, folder).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    sizes = gapless((r.shard, r.slot) for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_query_deals_whole_documents(spark, folder):
    """The query's shards and slots are those of the operator over all columns, text included."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r.row.doc_id: (r.shard, r.slot) for r in shard(docs, 24).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in QUERIES["op6_two_pass_shuffle"](spark, folder).collect()} == want


def test_written_shards_are_whole(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    write_shards(shard(docs, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    for file in {r[0] for r in back.select(F.input_file_name()).distinct().collect()}:
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == sorted(slots)


def test_same_order_for_any_partitioning(spark, folder, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.row.doc_id: (r.shard, r.slot) for r in shard(docs.repartition(1), 5).collect()}
    many = {r.row.doc_id: (r.shard, r.slot) for r in shard(docs.repartition(7), 5).collect()}
    assert one == many
    assert one != {r.row.doc_id: (r.shard, r.slot) for r in shard(docs, 5, seed=1).collect()}


def test_odd_rows(spark, tmp_path):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (1, "a"), (2, "b" * 300_000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("theirs")).withColumn("hash", F.lit(1.5)).withColumn("bucket", F.lit(None).cast("int"))
    dealt = shard(docs, 3)
    got = dealt.collect()
    assert sorted(((r.row.doc_id, r.row.text) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(r.row["shard"] == "theirs" for r in got)
    assert sorted(gapless((r.shard, r.slot) for r in got).values()) == [2, 2, 3]
    assert shard(docs.limit(0), 3).count() == 0
    clashing = docs.withColumnRenamed("shard", "Shard").withColumn("slot", F.lit("own")).withColumn("a.b", F.lit(2))
    names = write_shards(shard(clashing, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert names == ("shard_2", "slot_2") and {(r["Shard"], r["slot"], r["a.b"]) for r in back.collect()} == {("theirs", "own", 2)}
    assert sorted(gapless((r.shard_2, r.slot_2) for r in back.collect()).values()) == [2, 2, 3]


def test_repeated_rows_fill_several_buckets(spark):
    """A third of the rows equal in id and text: no bucket takes them all, none is lost, the others keep their order."""
    rows = [(None, None)] * 3000 + [(7, "same")] * 20 + [(i, f"text {i}") for i in range(100, 6100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = 20_000  # bytes: about 270 rows
    sizes = [r["count"] for r in scattered(docs, bucket_bytes=small).groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 1000
    dealt = lambda d: shard(d, 5, bucket_bytes=small).collect()
    one, many = dealt(docs.repartition(1)), dealt(docs.repartition(7))
    assert sorted(((r.row.doc_id, r.shard, r.slot) for r in one), key=repr) == sorted(((r.row.doc_id, r.shard, r.slot) for r in many), key=repr)
    assert sorted((tuple(r.row) for r in one), key=repr) == sorted(rows, key=repr)
    counts = gapless((r.shard, r.slot) for r in one)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_order_does_not_follow_the_session(spark, folder):
    """One order under any number of shuffle partitions and any partitioning, rows equal in id and text included."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.range(3000).selectExpr("CAST(NULL AS BIGINT)", "'same'", "concat('s', id)")).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = shard(docs.repartition(partitions), 5, bucket_bytes=20_000).collect()
            seen.append(sorted(((r.row.doc_id, r.row.text, r.row.source, r.shard, r.slot) for r in rows), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_the_shuffle_equals_a_plain_one(spark):
    """Fisher-Yates over the bucket's rows in the order of their hashes, by a second implementation in plain Python."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    rows = scattered(docs, bucket_bytes=8000).select("bucket", "hash", "tie", "row.doc_id").collect()
    at, want = 0, {}
    for bucket in sorted({r.bucket for r in rows}):
        own = [r.doc_id for r in sorted((r for r in rows if r.bucket == bucket), key=lambda r: (r["hash"], r.tie))]
        order = np.random.default_rng([SEED, bucket]).permutation(len(own))
        want.update({own[j]: at + i for i, j in enumerate(order)})
        at += len(own)
    assert len({r.bucket for r in rows}) > 3
    assert {r.row.doc_id: r.slot * 7 + r.shard for r in shard(docs, 7, bucket_bytes=8000).collect()} == want


def test_a_bucket_is_held_once():
    """Rows come in batches and leave in slices; what Arrow holds beside the bucket and one joined copy is a slice."""
    n, slice_bytes, pool = 400, 1 << 20, pa.default_memory_pool()
    start = pool.bytes_allocated()

    def batches():
        for at in range(0, n, 50):
            rows = pa.StructArray.from_arrays([pa.array(range(at, at + 50)), pa.array(["x" * 50_000] * 50)], ["doc_id", "text"])
            yield pa.record_batch({"row": rows, "hash": pa.array([-i for i in range(at, at + 50)]), "tie": pa.array([0] * 50), "bucket": pa.array([3] * 50), "base": pa.array([1000] * 50)})

    got, places, held = [], [], 0
    for batch in _fisher_yates(SEED, slice_bytes)(batches()):
        assert batch.nbytes < 2 * slice_bytes
        got += batch.column("row").field("doc_id").to_pylist()
        places += batch.column("place").to_pylist()
        held = max(held, pool.bytes_allocated() - start)
    assert got == [n - 1 - j for j in np.random.default_rng([SEED, 3]).permutation(n)] and places == list(range(1000, 1000 + n))
    assert held < n * 50_000 + 3 * slice_bytes
