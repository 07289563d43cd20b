"""Stateful streams against their batch forms, over micro-batch edges and restarts."""

import time
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from molweave.functions.hashing import key_hash
from molweave.operators import runs
from molweave.sources.corpus import stream_corpus
from molweave.streaming import stateful as S
from molweave.streaming.jobs import drain


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def files(spark, path, rows, schema, parts):
    """One file after the other, so that a stream reads them in this order."""
    for part in range(parts):
        spark.createDataFrame(rows[part * len(rows) // parts : (part + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_sliding_shuffle(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, None if i % 7 == 0 else f"t{i}") for i in range(400)]
    schema = files(spark, source, rows, "id long, text string", 4)
    stream = stream_corpus(spark, source, schema, 1)
    got = S.drain_shuffled(stream, "id", 5, str(tmp_path / "o"), str(tmp_path / "s"), buffer=60, shards=2).collect()
    assert Counter((r.id, r.text) for r in got) == Counter(rows)
    for shard in (0, 1):
        order = [r.id for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.turn)]
        assert [r.turn for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.turn)] == list(range(len(order)))
        # Rows of the first file come out after rows of later ones, and no row comes out a buffer before its turn.
        first, later = [k for k, i in enumerate(order) if i < 100], [k for k, i in enumerate(order) if i >= 100]
        assert max(first) > min(later)
    again = S.drain_shuffled(stream, "id", 5, str(tmp_path / "o2"), str(tmp_path / "s2"), buffer=60, shards=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sliding_shuffle_goes_on_after_a_restart(spark, tmp_path):
    source, where = str(tmp_path / "in"), (str(tmp_path / "o"), str(tmp_path / "s"))
    schema = files(spark, source, [(i,) for i in range(100)], "id long", 2)
    stream = stream_corpus(spark, source, schema, 1)
    once = S.drain_shuffled(stream, "id", 1, *where, buffer=16, shards=2).collect()
    assert sorted(r.id for r in once) == list(range(100))
    files(spark, source, [(i,) for i in range(100, 150)], "id long", 1)
    more = S.drain_shuffled(stream_corpus(spark, source, schema, 1), "id", 1, *where, buffer=16, shards=2).collect()
    assert sorted(r.id for r in more) == list(range(150))
    known = {(r.shard, r.turn): r.id for r in more}
    # What was emitted stays; only rows that the buffers held have a new place.
    assert sum(known.get((r.shard, r.turn)) == r.id for r in once) >= 100 - 16


@pytest.mark.parametrize("parts", [1, 5])
def test_batches_equal_batch_collation(spark, tmp_path, parts):
    source = str(tmp_path / "in")
    rows = [(i, [i, i + 1]) for i in range(230)]
    schema = files(spark, source, rows, "id long, ids array<long>", parts)
    stream = stream_corpus(spark, source, schema, 1)
    got = S.drain_batches(stream, "id", "id", ["id", "ids"], 16, str(tmp_path / "o"), str(tmp_path / "s"), shards=3)
    table = spark.read.parquet(source).withColumn("shard", (key_hash("shard", "id") % 3).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1
    cells = F.array_sort(F.collect_list(F.struct("id", "ids")))
    want = table.withColumn("batch_id", F.floor(place / 16)).groupBy("shard", "batch_id").agg(cells.alias("c"))
    want = want.select("shard", "batch_id", F.size("c").alias("n_rows"), F.col("c.id").alias("id"), F.col("c.ids").alias("ids"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("patience", [None, 1, 3])
def test_early_stop_equals_the_finished_log(spark, tmp_path, patience):
    source = str(tmp_path / "in")
    nan = float("nan")
    values = {"a": [3.0, 2.0, 2.0, 2.5, 2.2, 1.0], "b": [nan, 1.0, None, nan, 2.0, 0.5], "c": [nan] * 6, "d": [5.0, 4.0, 3.0, 2.0, 1.0, 0.0]}
    rows = [(run, epoch, name, v[epoch]) for epoch in range(6) for run, v in values.items() for name in ("val_loss", "val_roc")]
    schema = files(spark, source, rows, "run string, epoch long, name string, value double", 3)
    goals = {"loss": "minimize", "roc": "maximize"}
    followed = S.stream_early_stop(stream_corpus(spark, source, schema, 1), patience, goals)
    got = drain(followed, str(tmp_path / "o"), str(tmp_path / "s"))
    log = spark.read.parquet(source)
    columns = ["run", "epoch", "name", "step", "improved", "best"]
    want = runs.running_best(log, goals)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    stopped = runs.early_stop_epoch(log, patience, goals)
    assert sorted(map(str, S.stops(got).collect())) == sorted(map(str, stopped.select("run", "name", "stop_epoch", "last_epoch").collect()))


def test_silent_runs_are_told(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "o")
    schema = files(spark, source, [("a", 0, "loss", 1.0)], "run string, epoch long, name string, value double", 1)
    followed = S.stream_early_stop(stream_corpus(spark, source, schema, 1), 2, {"loss": "minimize"}, silent_ms=1)
    query = followed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="1 second").start()
    told, deadline = set(), time.time() + 60
    while ("a", "silent") not in told and query.isActive and time.time() < deadline:
        time.sleep(2)
        if (query.lastProgress or {"batchId": 0})["batchId"] > 0:
            told = {(r.run, r.event) for r in spark.read.schema(followed.schema).parquet(out).collect()}
    query.stop()
    assert told == {("a", "epoch"), ("a", "silent")}
