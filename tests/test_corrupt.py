import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.functions.hashing import position_state_np, position_state, state_uniform
from molweave.functions.ids import MASK, PAD
from molweave.functions.vectors import gumbel
from molweave.operators import corrupt as K
from molweave.sources.scratch import stored


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1, *rng.integers(5, 25, 40).tolist(), 2] + [PAD] * 10) for i in range(60)]
    return spark.createDataFrame(rows, "k int, input_ids array<int>").cache()


@pytest.fixture(scope="module")
def candidates(sequences):
    return K.ngram_candidates(sequences.select(F.array_remove("input_ids", PAD).alias("ids")))


def test_extremes_and_ignored_ids(sequences):
    none = K.mask_sequences(sequences, "k", 1, p=0.0).collect()
    assert all(r.masked_input == r.input_ids and set(r.mlm_labels) == {-100} for r in none)
    for r in K.mask_sequences(sequences, "k", 1, p=1.0).collect():
        assert all((m == PAD) if x == PAD else (m == MASK) for x, m in zip(r.input_ids, r.masked_input))
        assert all((y == -100) if x == PAD else (y == x) for x, y in zip(r.input_ids, r.mlm_labels))
    for r in K.mask_sequences(sequences, "k", 1, p=1.0, ignore=(1, 2)).collect():
        assert r.masked_input[0] == 1 and 2 in r.masked_input and PAD in r.masked_input


def test_edge_sequences(spark):
    df = spark.createDataFrame([(1, [PAD] * 4), (2, [7]), (3, []), (4, None)], "k int, input_ids array<int>")
    got = {r.k: r.masked_input for r in K.mask_sequences(df, "k", 1, p=1.0).collect()}
    assert got == {1: [PAD] * 4, 2: [MASK], 3: [], 4: None}


def test_long_and_array_forms_agree(sequences):
    long = K.mask_positions(sequences, "k", 5).collect()
    arrays = {r.k: r for r in K.mask_sequences(sequences, "k", 5).collect()}
    assert len(long) == 60 * 52
    for r in long:
        a = arrays[r.k]
        assert (r.masked, r.mlm_label, r.masked_id) == (a.masked[r.pos], a.mlm_labels[r.pos], a.masked_input[r.pos])
    share = sum(r.masked for r in long) / sum(r.token_id != PAD for r in long)
    assert abs(share - 0.15) < 0.03


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_corruption_is_independent_of_partitions(sequences, candidates, parts):
    once = {r.k: r for r in K.corrupt_sequences(sequences, candidates, "k", 3).collect()}
    again = {r.k: r for r in K.corrupt_sequences(sequences.repartition(parts), candidates, "k", 3).collect()}
    assert once == again


def test_replaced_only_where_masked(sequences, candidates):
    seen = {(0, 0): 0, (0, 1): 0}
    for r in K.corrupt_sequences(sequences, candidates, "k", 3, p=0.5).collect():
        for x, m, d, y, pos in zip(r.input_ids, r.masked, r.disc_input, r.disc_labels, range(99)):
            assert y == int(d != x)
            if not m:
                assert d == x
            else:
                seen[(0, y)] += 1
    # A masked position may draw its own token again, and then counts as original.
    assert seen[(0, 0)] > 0 and seen[(0, 1)] > 0


def test_candidates_rank_and_back_off(spark):
    df = spark.createDataFrame([([1, 5, 6, 5, 6, 5, 7, 2],)], "ids array<int>")
    got = {(r.prev, r["rank"]): (r.token, r.log_p) for r in K.ngram_candidates(df).collect()}
    assert got[(5, 1)][0] == 6 and got[(5, 1)][1] == pytest.approx(np.log(2 / 3))
    assert got[(5, 2)][0] == 7
    assert (5, 3) not in got
    # All tokens are proposed, none is cut off.
    assert [got[(K.ANY_LEFT, i)][0] for i in (1, 2, 3, 4)] == [5, 6, 2, 7]


def test_short_sequences_have_no_pairs(spark):
    df = spark.createDataFrame([([4],), ([],), (None,)], "ids array<int>")
    assert K.ngram_candidates(df).count() == 0
    with pytest.raises(ValueError):
        K.proposal_table(K.ngram_candidates(df))


def test_gumbel_sample_equals_the_expression(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([1, 5, 9, 3] * 20)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "k int, logits array<double>").withColumn("s", K.sample_state(2, "k"))
    noisy = F.transform("logits", lambda x, i: x / 0.7 + gumbel(state_uniform(position_state(F.col("s"), i))))
    both = df.select(
        "k", K.gumbel_sample(0.7)(F.col("logits"), F.col("s")).alias("a"), (F.array_position(noisy, F.array_max(noisy)) - 1).alias("b")
    ).collect()
    assert [r.a for r in both if r.k < 900] == [r.b for r in both if r.k < 900]
    assert all(r.a is None for r in both if r.k >= 900)


def test_gumbel_sample_follows_the_probabilities(spark):
    df = spark.range(20000).select(F.array(F.lit(0.0), F.log(F.lit(3.0))).alias("l"), K.sample_state(4, "id").alias("s"))
    share = df.agg(F.avg(K.gumbel_sample()(F.col("l"), F.col("s")))).first()[0]
    assert abs(share - 0.75) < 0.015


def test_corruption_needs_no_shuffle(sequences, candidates):
    plan = K.corrupt_sequences(sequences, candidates, "k", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_positions(sequences, candidates):
    rows = K.corrupt_sequences(sequences, candidates, "k", 3)
    long = K.positions_of(rows, ["k"], {"input_ids": "token_id", "disc_input": "disc_id"})
    assert long.columns == ["k", "pos", "token_id", "disc_id"] and long.count() == 60 * 52
    assert K.non_pad_positions(long).count() == 60 * 42


def test_a_table_too_large_to_broadcast_is_joined(sequences, candidates, monkeypatch):
    fields = ["masked", "mlm_labels", "masked_input", "disc_input", "disc_labels"]
    arrays = {r.k: [r[c] for c in fields] for r in K.corrupt_sequences(sequences, candidates, "k", 3, p=0.4).collect()}
    monkeypatch.setattr(K, "CANDIDATE_LIMIT", 4)
    joined = {r.k: [r[c] for c in fields] for r in K.corrupt_sequences(sequences, candidates, "k", 3, p=0.4).collect()}
    assert joined == arrays


def test_draws_follow_the_counts(spark):
    df = spark.createDataFrame([(5, 1, 6, 70, 70), (5, 2, 7, 29, 99), (5, 3, 8, 1, 100), (K.ANY_LEFT, 1, 9, 3, 3)], "prev int, rank int, token int, n long, cum long")
    table = K.proposal_table(df)
    u = (np.arange(10_000) + 0.5) / 10_000
    drawn = table.draw(np.full(len(u), 5), u)
    assert [(drawn == t).sum() for t in (6, 7, 8)] == [7000, 2900, 100]
    assert set(table.draw(np.full(5, 1234), u[:5]).tolist()) == {9}


def test_rows_with_equal_low_bits_draw_apart():
    states = np.array([5, 5 + (1 << 32), 5 + (7 << 32)])
    draws = [position_state_np(np.full(200, s), np.arange(200)) for s in states]
    assert not (draws[0] == draws[1]).any() and not (draws[1] == draws[2]).any()


# ---- temperature and judged generators --------------------------------------------------------------------------------


def test_ranking_has_no_task_with_a_whole_neighbour(spark):
    """One neighbour with ten million followers: its rows are ranked in parts of the range order."""
    n = 10_000_000
    counts = spark.range(n).select(F.lit(7).alias("prev"), F.col("id").cast("int").alias("token"), (F.col("id") % 1000 + 1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = stored(K.rank_followers(counts).withColumn("task", F.spark_partition_id()), "ranked")
        plan = K.rank_followers(counts.limit(10))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = n // 1000 * 500_500
    got = ranked.agg(
        F.count("*"), F.max("rank"), F.countDistinct("rank"), F.max("cum"), F.sum(F.when(F.col("rank") == 1, F.col("token"))), F.min("most")
    ).first()
    assert tuple(got) == (n, n, n, total, 999, 1000)
    assert max(r["count"] for r in ranked.groupBy("task").count().collect()) < n / 2
    # Windows over a whole neighbour see sums of parts only; those over rows stay inside a part.
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_size" in line or "_rows" in line or ", _part" in line for line in windows)


@pytest.mark.parametrize("temperature", [0.5, 2.0])
def test_tempered_weights(spark, temperature):
    counts = spark.createDataFrame([(1, 10, 100), (1, 11, 50), (1, 12, 1), (2, 10, 3)], "prev int, token int, n long")
    table = K.rank_followers(counts)
    got = {(r.prev, r.token): r for r in K.tempered(table, temperature).collect()}
    for (prev, token), n, most in (((1, 10), 100, 100), ((1, 11), 50, 100), ((1, 12), 1, 100), ((2, 10), 3, 3)):
        assert got[prev, token].n == pytest.approx((n / most) ** (1 / temperature) * K.WEIGHT_ONE, rel=1e-5)
        assert got[prev, token].log_p == pytest.approx(np.log(n / {1: 151, 2: 3}[prev]))
    assert got[1, 12].cum == sum(got[1, t].n for t in (10, 11, 12)) and got[1, 10].cum == got[1, 10].n
    with pytest.raises(ValueError):
        K.tempered(table, 0.0)


@pytest.mark.parametrize("temperature", [0.5, 1.0, 2.0])
def test_draws_follow_the_gumbel_rule(spark, temperature):
    """Shares of inverted draws and of Gumbel draws over log p / T are those of the tempered distribution."""
    counts = spark.createDataFrame([(K.ANY_LEFT, t, n) for t, n in ((5, 60), (6, 25), (7, 10), (8, 5))], "prev int, token int, n long")
    table = stored(K.rank_followers(counts), "proposals")
    n = 6000
    rows = spark.range(n).select("id", F.array(F.lit(5)).alias("input_ids"))
    drawn = K.corrupt_sequences(rows, table, "id", 1, p=1.0, temperature=temperature)
    ours = {r[0]: r["count"] / n for r in drawn.groupBy(F.col("disc_input")[0]).count().collect()}
    logits = F.array(*[F.lit(float(np.log(x))) for x in (60, 25, 10, 5)])
    rule = spark.range(n).select(K.gumbel_sample(temperature)(logits, K.sample_state(9, "id")).alias("i"))
    gumbel = {5 + r.i: r["count"] / n for r in rule.groupBy("i").count().collect()}
    weights = np.array([60, 25, 10, 5.0]) ** (1 / temperature)
    for token, share in zip((5, 6, 7, 8), weights / weights.sum()):
        spread = 4 * np.sqrt(share * (1 - share) / n)
        assert abs(ours.get(token, 0) - share) < spread and abs(gumbel.get(token, 0) - share) < spread


@pytest.mark.parametrize("temperature", [0.5, 1.0])
def test_judged_forms_agree(spark, sequences, candidates, temperature, monkeypatch):
    table = stored(candidates, "proposals")
    arrays = {r.k: r for r in K.corrupt_sequences(sequences, table, "k", 3, p=0.4, temperature=temperature, judged=True).collect()}
    monkeypatch.setattr(K, "HOT_PARTS", 50)
    joined = {r.k: r for r in K.corrupt_by_join(sequences, table, "k", 3, p=0.4, temperature=temperature, judged=True).collect()}
    plain = {r.k: r for r in K.corrupt_sequences(sequences, table, "k", 3, p=0.4, temperature=temperature).collect()}
    rows = table.collect()
    count = {(r.prev, r.token): r.n for r in rows}
    total, best = {}, {}
    for r in rows:
        total[r.prev] = total.get(r.prev, 0) + r.n
        if r["rank"] == 1:
            best[r.prev] = r.token
    k0 = sum(r.prev == K.ANY_LEFT for r in rows)
    judged = 0
    for k, a in arrays.items():
        b = joined[k]
        assert a.disc_input == b.disc_input == plain[k].disc_input and a.gen_hit == b.gen_hit
        assert [x is None for x in a.nll] == [not m for m in a.masked]
        for pos, (x, y) in enumerate(zip(a.nll, b.nll)):
            if x is None:
                assert y is None
                continue
            judged += 1
            prev = a.masked_input[pos - 1] if pos else K.ANY_LEFT
            prev = prev if prev in total else K.ANY_LEFT
            alone = (count.get((K.ANY_LEFT, a.input_ids[pos]), 0) + 1) / (total[K.ANY_LEFT] + k0 + 1)
            p = alone if prev == K.ANY_LEFT else (count.get((prev, a.input_ids[pos]), 0) + alone) / (total[prev] + 1)
            assert x == pytest.approx(-np.log(p)) == pytest.approx(y)
            assert a.gen_hit[pos] == (best[prev] == a.input_ids[pos])
    assert judged > 300


def test_nothing_masked_is_judged_as_nothing(spark, candidates):
    table = stored(candidates, "proposals")
    df = spark.createDataFrame([(1, [PAD] * 4), (2, []), (3, None)], "k int, input_ids array<int>")
    for form in (K.corrupt_sequences, K.corrupt_by_join):
        got = {r.k: r.nll for r in form(df, table, "k", 1, p=1.0, judged=True).collect()}
        assert got == {1: [None] * 4, 2: [], 3: None}


def test_neighbours_across_parts_carry_their_totals(spark):
    """Ranks, sums, totals and numbers of followers, where a neighbour fills parts, ends one or lies inside of one."""
    rng = np.random.default_rng(5)
    sizes = {K.ANY_LEFT: 900, 3: 1, 4: 700, 5: 2, 6: 3, 9: 400}
    rows = [(p, t, int(n)) for p, k in sizes.items() for t, n in enumerate(rng.integers(1, 50, k))]
    counts = spark.createDataFrame(rows, "prev int, token int, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.prev, r.token): (r["rank"], r.cum, r.most, r.total, r.followers) for r in K.rank_followers(counts).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for prev, k in sizes.items():
        own = sorted(((t, n) for p, t, n in rows if p == prev), key=lambda x: (-x[1], x[0]))
        ends = np.cumsum([n for _, n in own])
        want |= {(prev, t): (i + 1, ends[i], own[0][1], ends[-1], k) for i, (t, _) in enumerate(own)}
    assert got == want
