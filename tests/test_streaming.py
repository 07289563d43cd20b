import pytest
from pyspark.sql import functions as F

from molweave.functions.ids import add_template
from molweave.operators.corrupt import corrupt_sequences, mask_sequences, ngram_candidates
from molweave.operators.encoding import encode_text, tokenize
from molweave.operators.metrics import auroc, pearson_of, rmse_of
from molweave.operators.vocab import encode, train_vocab
from molweave.sources.corpus import stream_corpus
from molweave.sources.scratch import stored
from molweave.streaming import jobs as J


@pytest.fixture(scope="module")
def molecules(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mols"))
    rows = [(i, "".join(f"[C{j % 7}]" for j in range(i % 20)) or None) for i in range(200)]
    spark.createDataFrame(rows, "mol_id long, selfies string").repartition(5).write.mode("overwrite").parquet(path)
    return path


@pytest.fixture
def paths(tmp_path):
    """New places for a stream's rows and state at each call."""
    made = []

    def pair():
        made.append(1)
        return str(tmp_path / f"out{len(made)}"), str(tmp_path / f"state{len(made)}")

    return pair


def as_set(df):
    return {str(r) for r in df.collect()}


def test_stream_encode_and_mask_equal_batch(spark, molecules, paths):
    batch = spark.read.parquet(molecules)
    vocab = train_vocab(tokenize(batch))
    stream = stream_corpus(spark, molecules, batch.schema, max_files_per_trigger=1)
    encoded = J.stream_encode(stream, vocab, max_length=16)
    assert as_set(J.drain(encoded, *paths())) == as_set(encode_text(batch, vocab, max_length=16))
    masked = J.drain(J.stream_mask(encoded, "mol_id", 3), *paths())
    assert as_set(masked) == as_set(mask_sequences(encode_text(batch, vocab, max_length=16), "mol_id", 3))


def test_stream_metrics_equal_batch(spark, tmp_path, paths):
    path = str(tmp_path / "preds")
    rows = spark.range(300).select((F.col("id") % 3).alias("epoch"), F.lit("train").alias("split"), (F.col("id") * 1.5).alias("pred"), F.sqrt("id").alias("target"))
    rows.repartition(4).write.parquet(path)
    got = {r.epoch: r for r in J.stream_metrics(stream_corpus(spark, path, rows.schema, 1), *paths()).collect()}
    want = rows.groupBy("epoch").agg(F.count("*").alias("n"), rmse_of(F.col("pred"), F.col("target")).alias("rmse"), pearson_of(F.col("pred"), F.col("target")).alias("r"))
    for r in want.collect():
        g = got[r.epoch]
        assert g.n == r.n and g.rmse == pytest.approx(r.rmse) and g.pearsonr == pytest.approx(r.r)


@pytest.mark.parametrize("steps", [0, 2, 50])
def test_stream_limit(spark, molecules, steps, paths):
    schema = spark.read.parquet(molecules).schema
    files = spark.read.parquet(molecules).select(F.input_file_name().alias("f"), "mol_id").groupBy("f").count().collect()
    got = J.stream_limit(stream_corpus(spark, molecules, schema, max_files_per_trigger=1), steps, *paths())
    n = got.count()
    assert got.select("mol_id").distinct().count() == n
    assert n == 200 if steps > len(files) else n == {0: 0, 2: 80}[steps]


def test_streams_go_on_from_their_state(spark, tmp_path, paths):
    source = str(tmp_path / "in")
    stream = stream_corpus(spark, source + "/*", spark.range(1).schema)
    rows, table = paths(), paths()
    counts = stream.groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n"))
    for name, low, high in (("a", 0, 10), ("b", 10, 15)):
        spark.range(low, high).write.parquet(f"{source}/{name}")
        # The second call of each round finds nothing new.
        for _ in range(2):
            assert sorted(r.id for r in J.drain(stream, *rows).collect()) == list(range(high))
            assert {r.odd: r.n for r in J.drain_table(counts, *table).collect()} == {0: (high + 1) // 2, 1: high // 2}


def test_a_limited_stream_skips_nothing(spark, molecules, paths):
    schema = spark.read.parquet(molecules).schema
    where = paths()
    seen = []
    for steps in (1, 1, 3, 99):
        stream = stream_corpus(spark, molecules, schema, max_files_per_trigger=1)
        seen.append(sorted(r.mol_id for r in J.stream_limit(stream, steps, *where).collect()))
    assert [len(x) for x in seen] == [40, 40, 120, 200]
    assert seen[-1] == list(range(200))


def test_stream_shuffle_and_corrupt_equal_batch(spark, molecules, paths):
    batch = spark.read.parquet(molecules)
    stream = stream_corpus(spark, molecules, batch.schema, max_files_per_trigger=1)
    shuffled = J.drain(J.stream_shuffle(stream, "mol_id", 1, buffer=16), *paths())
    assert as_set(shuffled.select(batch.columns)) == as_set(batch)
    assert shuffled.agg(F.max("place")).first()[0] == 15
    vocab = stored(train_vocab(tokenize(batch)), "vocab")
    encoded = encode_text(batch, vocab, max_length=16)
    ids = encode(tokenize(batch), vocab).select(add_template(F.col("ids")).alias("ids"))
    table = stored(ngram_candidates(ids), "proposals")
    made = J.stream_corrupt(J.stream_encode(stream, vocab, max_length=16).select("mol_id", "input_ids"), table, "mol_id", 3)
    assert as_set(J.drain(made, *paths())) == as_set(corrupt_sequences(encoded.select("mol_id", "input_ids"), table, "mol_id", 3))


@pytest.mark.parametrize("bins", [100, 1000, None])
def test_stream_auroc_is_exact_on_binned_scores(spark, tmp_path, paths, bins):
    path = str(tmp_path / "scores")
    rows = spark.range(2000).select(
        F.lit(0).alias("epoch"),
        F.lit("val").alias("split"),
        (F.pmod(F.hash("id"), F.lit(101)) / 100.0).alias("pred"),
        (F.pmod(F.hash(F.col("id") + 7), F.lit(3)) == 0).cast("int").alias("target"),
    )
    rows.repartition(4).write.parquet(path)
    got = J.stream_auroc(stream_corpus(spark, path, rows.schema, 1), *paths(), bins).first().roc
    assert got == pytest.approx(auroc(spark.read.parquet(path)).first().roc, abs=1e-12)


def test_a_binned_score_outside_the_range_is_an_error(spark, tmp_path, paths):
    rows = spark.range(5).select(F.lit(0).alias("epoch"), F.lit("val").alias("split"), (F.col("id") * 1.0).alias("pred"), F.lit(1).alias("target"))
    rows.write.parquet(str(tmp_path / "wide"))
    with pytest.raises(Exception, match="outside"):
        J.stream_auroc(stream_corpus(spark, str(tmp_path / "wide"), rows.schema), *paths(), 10)


def test_drain_corrupted_takes_proposals_of_any_size(spark, molecules, paths, monkeypatch):
    batch = spark.read.parquet(molecules)
    vocab = stored(train_vocab(tokenize(batch)), "vocab")
    table = stored(ngram_candidates(encode(tokenize(batch), vocab).select(add_template(F.col("ids")).alias("ids"))), "proposals")
    stream = stream_corpus(spark, molecules, batch.schema, max_files_per_trigger=1)
    encoded = J.stream_encode(stream, vocab, max_length=16).select("mol_id", "input_ids")
    want = as_set(corrupt_sequences(encode_text(batch, vocab, max_length=16).select("mol_id", "input_ids"), table, "mol_id", 3, temperature=0.5))
    tempered = J.stream_corrupt(encoded, table, "mol_id", 3, temperature=0.5)
    assert as_set(J.drain(tempered, *paths())) == want
    monkeypatch.setattr("molweave.operators.corrupt.CANDIDATE_LIMIT", 3)
    with pytest.raises(ValueError):
        J.stream_corrupt(encoded, table, "mol_id", 3)
    assert as_set(J.drain_corrupted(encoded, table, "mol_id", 3, *paths(), temperature=0.5)) == want


def scores(spark, path, n, distinct):
    score = F.pmod(F.hash("id"), F.lit(distinct)) / F.lit(float(distinct))
    positive = F.pmod(F.hash(F.col("id") + 7), F.lit(1000)) < 200 + 500 * score
    rows = spark.range(n).select(F.lit(0).alias("epoch"), F.lit("val").alias("split"), (score * 40 - 7).alias("pred"), positive.cast("int").alias("target"))
    rows.repartition(3).write.parquet(path)
    return rows.schema


@pytest.mark.parametrize("distinct", [3, 1_000_003])
def test_sketched_area_is_within_its_bound(spark, tmp_path, paths, distinct):
    for k, points in ((256, 512), (J.SKETCH_K, J.SKETCH_POINTS)):
        path = str(tmp_path / f"s{k}")
        schema = scores(spark, path, 60_000, distinct)
        got = J.stream_auroc_sketch(stream_corpus(spark, path, schema, 1), *paths(), k=k, points=points).first()
        assert abs(got.roc - auroc(spark.read.parquet(path)).first().roc) <= J.sketch_bound(k, points)
        assert got.n_positive + got.n_negative == 60_000
    assert J.sketch_bound() < 0.003


def test_sketches_do_not_grow_with_the_stream(spark, tmp_path, paths):
    sizes = []
    for n in (20_000, 200_000):
        path, (out, state) = str(tmp_path / f"n{n}"), paths()
        schema = scores(spark, path, n, 1_000_003)
        J.stream_auroc_sketch(stream_corpus(spark, path, schema, 1), out, state, k=256)
        sizes.append(spark.read.parquet(out).agg(F.max(F.length("_p") + F.length("_n"))).first()[0])
    assert sizes[1] < 1.3 * sizes[0]


def test_sketched_area_of_one_class_is_null(spark, tmp_path, paths):
    path = str(tmp_path / "one")
    rows = spark.range(9).select(F.lit(None).cast("int").alias("epoch"), F.lit("val").alias("split"), F.col("id").cast("double").alias("pred"), F.lit(1).alias("target"))
    rows.write.parquet(path)
    got = J.stream_auroc_sketch(stream_corpus(spark, path, rows.schema), *paths()).first()
    assert (got.epoch, got.n_positive, got.n_negative, got.roc) == (None, 9, 0, None)


def test_streams_take_a_vocabulary_of_any_size(spark, molecules, paths, monkeypatch):
    batch = spark.read.parquet(molecules)
    vocab = stored(train_vocab(tokenize(batch)), "vocab")
    table = stored(ngram_candidates(encode(tokenize(batch), vocab).select(add_template(F.col("ids")).alias("ids"))), "proposals")
    stream = stream_corpus(spark, molecules, batch.schema, max_files_per_trigger=1)
    encoded = encode_text(batch, vocab, max_length=16).select("mol_id", "input_ids")
    steps = {
        "encode": lambda rows: rows,
        "mask": lambda rows: J.stream_mask(rows, "mol_id", 3),
        "corrupt": lambda rows: J.stream_corrupt(rows, table, "mol_id", 3),
    }
    want = {name: as_set(step(encoded)) for name, step in steps.items()}
    monkeypatch.setattr("molweave.operators.vocab.BROADCAST_LIMIT", 7)
    monkeypatch.setattr("molweave.operators.corrupt.CANDIDATE_LIMIT", 3)
    with pytest.raises(ValueError, match="drain_through"):
        J.stream_encode(stream, vocab, max_length=16)
    for name, step in steps.items():
        through = lambda rows: step(J.stream_encode(rows, vocab, max_length=16, key="mol_id").select("mol_id", "input_ids"))  # noqa: B023
        assert as_set(J.drain_through(stream, through, *paths())) == want[name]
