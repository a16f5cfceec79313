import os
from datetime import datetime, timedelta

from pagesieve.operators import ranked
from pagesieve.streaming import flows

T0 = datetime(2024, 1, 1)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"] or p["stateOperators"]]


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """Input rows of a batch stay the same however many keys are stored; replays and late rows add nothing."""
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id long, url string"
    stream = lambda: flows.first_only(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["run_id", "url"])
    for i in range(6):
        land(spark, path, [(1, f"u{j}") for j in range(100 * i, 100 * i + 100)] + [(1, "u0"), (2, f"v{i // 2}")], schema)
    progress = drain(flows.store(stream(), out, state))
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [102] * 6
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress][:6] == [101, 201, 302, 402, 503, 603]
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 603
    # long after, the same keys again, and one new one
    land(spark, path, [(1, "u0"), (1, "u599"), (2, "v0"), (3, "w")], schema)
    progress = drain(flows.store(stream(), out, state))
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [4] and spark.read.parquet(out).count() == 604
    # a batch whose end was not recorded runs again and writes nothing twice
    commits = os.path.join(state, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(os.path.join(commits, name))
    drain(flows.store(stream(), out, state))
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 604


def test_keys_are_forgotten_after_the_delay(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id long, url string, ts timestamp"
    for minutes in (0, 1, 300, 600):
        land(spark, path, [(1, "same", T0 + timedelta(minutes=minutes)), (1, f"u{minutes}", T0 + timedelta(minutes=minutes))], schema)
        source = spark.readStream.schema(schema).parquet(path)
        progress = drain(flows.store(flows.first_only(source, ["run_id", "url"], "ts", "10 minutes"), out, state))
    # the clock of a batch is that of the rows before it: the row of minute 300 still finds its key, then the key is forgotten
    rows = spark.read.parquet(out)
    assert rows.filter("url = 'same'").count() == 2 and rows.count() == 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_timeout_is_raised_while_the_stream_goes_on(spark, tmp_path):
    """Run 1 falls quiet; its row appears with the batches of run 2, before the stream ends, and a late row of it is dropped."""
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id long, ts timestamp"
    at = lambda run, *minutes: [(run, T0 + timedelta(minutes=m)) for m in minutes]
    batches = [at(1, 0, 2, 4), at(2, 6, 8), at(2, 30), at(2, 32) + at(1, 5), at(2, 34)]
    seen = []
    for rows in batches:
        land(spark, path, rows, schema)
        source = spark.readStream.schema(schema).parquet(path)
        drain(flows.store(flows.run_timeouts(source, "ts", "5 minutes", "1 minute"), out, state))
        seen.append(sorted((r.run_id, (r.started - T0) // timedelta(minutes=1), (r.quiet_since - T0) // timedelta(minutes=1), r.pages) for r in spark.read.parquet(out).collect()) if os.path.isdir(out) else [])
    assert seen[0] == seen[1] == []
    assert seen[2] == seen[3] == seen[4] == [(1, 0, 9, 3), (2, 6, 13, 2)]


def test_ranks_of_a_hot_group(spark, monkeypatch):
    """Ranks counted up over partitions equal those of a window, and no partition sorts the whole group."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, 1).when(F.col("id") % 10 == 8, F.col("id") % 7).alias("run_id"), F.hash("id").alias("x"), F.col("id").alias("url"))
    order = [F.col("x") % 50, F.col("url")]
    want = {(r.run_id, r.url): r["rank"] for r in rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).collect()}
    assert {(r.run_id, r.url): r["rank"] for r in ranked.ranked_rows(rows, ["run_id"], order, "rank").collect()} == want
    monkeypatch.setattr(ranked, "MOST_IN_A_TASK", 10)
    top = ranked.top_per_group(rows, ["run_id"], order, 500, "rank", ["url"]).collect()
    assert {(r.run_id, r.url): r["rank"] for r in top} == {k: v for k, v in want.items() if v <= 500}
    placed = rows.repartitionByRange(8, F.col("run_id"), *order)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 5000
