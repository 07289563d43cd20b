from pyspark.sql import functions as F

from molweave.functions.ids import SPECIAL_TOKENS
from molweave.operators import ordering, review


def vocab(spark):
    rows = [(t, i, 0) for i, t in enumerate([*SPECIAL_TOKENS, "a", "b", "c"])]
    return spark.createDataFrame(rows, "token string, id int, n long")


def test_token_diff_stops_at_padding(spark):
    rows = [(1, [1, 5, 6, 3, 7], [1, 5, 7, 3, 3]), (2, [5, 6], [5, 5]), (3, [3, 5], [3, 5])]
    df = spark.createDataFrame(rows, "k int, disc_input array<int>, input_ids array<int>")
    got = {(r.k, r.pos): (r.token, r.changed) for r in review.token_diff(df, vocab(spark), "k").collect()}
    assert got == {
        (1, 0): ("[CLS]", False),
        (1, 1): ("a", False),
        (1, 2): ("b", True),
        (2, 0): ("a", False),
        (2, 1): ("b", True),
    }


def test_replacement_report(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 7, 5, 3], [1, 1, 0, 0, 1], [1, 0, 1, 0, 1])],
        "k int, disc_input array<int>, disc_predictions array<int>, disc_labels array<int>",
    )
    report = review.replacement_report(df, "k")
    assert {r.pos: r.verdict for r in report.collect()} == {0: "right", 1: "wrong", 2: "wrong", 3: None}
    assert {r.verdict: r.n for r in review.confusion(report).collect()} == {"right": 1, "wrong": 2, None: 1}


def test_sample_for_review_takes_one_row_per_batch(spark):
    rows = ordering.assign_batches(spark.range(400).withColumn("idx", F.col("id")), 32)
    got = review.sample_for_review(rows, "id", 8).collect()
    assert sorted(r.batch_id for r in got) == [0, 1, 2, 3, 4]
    assert all(r.id // 32 == r.batch_id for r in got)
    again = review.sample_for_review(rows.repartition(7), "id", 8).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
