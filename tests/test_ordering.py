import hashlib

import pytest
from pyspark.sql import functions as F

from molweave.functions.hashing import key_hash, position_state, position_state_np, position_uniform, uniform
from molweave.operators import ordering as O


def u(seed, *keys):
    text = "|".join(str(x) for x in (seed, *keys))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_uniform_matches_its_definition(spark):
    got = {r.id: r.u for r in spark.range(50).withColumn("u", uniform(7, "id")).collect()}
    assert got == {i: u(7, i) for i in range(50)}


def test_position_state_has_one_meaning(spark):
    import numpy as np

    df = spark.range(200).select("id", key_hash(1, "id").alias("h")).withColumn("p", (F.col("id") * 7919).cast("int"))
    rows = df.withColumn("s", position_state(F.col("h"), F.col("p"))).collect()
    again = position_state_np(np.array([r.h for r in rows]), np.array([r.p for r in rows]))
    assert [r.s for r in rows] == again.tolist()


def test_position_draws_look_uniform_and_independent(spark):
    long = spark.range(400).select("id", key_hash(3, "id").alias("h")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(511))))
    draws = long.withColumn("u", position_uniform(F.col("h"), F.col("p"))).withColumn(
        "v", position_uniform(F.col("h"), F.col("p") + 1)
    )
    r = draws.agg(F.avg("u").alias("m"), F.stddev_pop("u").alias("s"), F.corr("u", "v").alias("c"), F.avg((F.col("u") < 0.15).cast("int")).alias("q")).first()
    assert abs(r.m - 0.5) < 0.003 and abs(r.s - 12**-0.5) < 0.003 and abs(r.c) < 0.01 and abs(r.q - 0.15) < 0.003


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_global_shuffle_is_dense_and_independent_of_partitions(spark, parts):
    df = spark.range(0, 500, 1, parts)
    got = {r.id: r.idx for r in O.global_shuffle(df, "id", 42).collect()}
    order = sorted(range(500), key=lambda i: (u(42, i), i))
    assert got == {k: n for n, k in enumerate(order)}


def test_take_drops_buckets_and_keeps_the_order(spark):
    full = {r.id: r.idx for r in O.global_shuffle(spark.range(500), "id", 5).collect()}
    head = {r.id: r.idx for r in O.global_shuffle(spark.range(500), "id", 5, take=70).collect()}
    assert head == {k: i for k, i in full.items() if i < 70}


def test_dense_index_of_a_skewed_key(spark):
    # A third of the rows share one value of the first order column.
    df = spark.range(0, 900, 1, 7).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    got = O.dense_index(df, "k", "id").collect()
    order = sorted(((r.k, r.id) for r in got))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.idx)] == order
    assert sorted(r.idx for r in got) == list(range(900))


def test_buffer_shuffle_stays_in_its_buffer(spark):
    df = spark.range(0, 250, 1, 1).withColumn("text", F.col("id").cast("string"))
    shuffled = O.buffer_shuffle(df, "id", 1, buffer=100)
    assert "Exchange" not in shuffled._jdf.queryExecution().executedPlan().toString()
    got = shuffled.collect()
    assert all(r.id // 100 == r.block and r.text == str(r.id) for r in got)
    assert [r.place for r in got] == [*range(100), *range(100), *range(50)]
    for block in range(3):
        assert [r.id for r in got if r.block == block] == sorted(range(block * 100, min(250, block * 100 + 100)), key=lambda i: (u(1, i), i))


def test_keys_for_rows_without_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, None), (None, None)], "s string, t int")
    keyed = O.with_row_key(df).collect()
    assert len({r.row_key for r in keyed}) == 5
    assert {r.row_key for r in O.with_row_key(df.repartition(3)).collect()} == {r.row_key for r in keyed}


def test_batches_keep_the_short_last_one(spark):
    rows = spark.range(65).withColumnRenamed("id", "idx").withColumn("x", F.col("idx") * 2)
    batches = O.collate_batches(O.assign_batches(rows, 32), "x").orderBy("batch_id").collect()
    assert [r.n_rows for r in batches] == [32, 32, 1]
    assert batches[1].x == [2 * i for i in range(32, 64)]
    assert O.take_steps(O.assign_batches(rows, 32), 2).count() == 64


@pytest.mark.parametrize("n,buckets", [(65, 3), (640, 4), (31, 2), (500, 40)])
def test_collating_in_buckets_equals_collating(spark, n, buckets):
    rows = O.global_shuffle(spark.range(n), "id", 3, buckets=buckets, bucket_out="bucket")
    batches = O.assign_batches(rows, 32)
    once = O.collate_batches(batches, "id", batch_size=32, bucket="bucket")
    assert {str(r) for r in once.collect()} == {str(r) for r in O.collate_batches(batches, "id").collect()}


def test_collating_in_buckets_shuffles_rows_once(spark):
    rows = O.assign_batches(O.global_shuffle(spark.range(500), "id", 3, buckets=4, bucket_out="bucket"), 32)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = O.collate_batches(rows, "id", batch_size=32, bucket="bucket")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(bucket") + plan.count("Exchange hashpartitioning(_bucket") - plan.count("ReusedExchange") <= 2
    assert plan.count("Exchange hashpartitioning(batch_id") == 1


def test_first_batches(spark):
    rows = O.first_batches(spark.range(300), "id", 9, 32, 5).collect()
    assert len(rows) == 160 and {r.batch_id for r in rows} == set(range(5))


def test_take_filters_before_the_shuffle(spark):
    plan = O.global_shuffle(spark.range(500), "id", 5, take=70)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Exchange hashpartitioning(_bucket") < plan.index("BroadcastHashJoin")
    assert "< 70" in plan
