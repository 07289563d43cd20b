import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.operators.vocab import train_vocab
from molweave.sources import corpus as C
from molweave.sources import scratch
from molweave.sources.scratch import fresh_path, remove_stored, shared_dir, stored


def test_load_split_prunes_a_partition_column(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(100).withColumn("split", C.split_of("id")).write.partitionBy("split").parquet(path)
    parts = {s: C.load_corpus(spark, path, s) for s in C.SPLITS}
    assert sum(p.count() for p in parts.values()) == 100
    assert "PartitionFilters: [isnotnull(split" in parts["test"]._jdf.queryExecution().executedPlan().toString()


def test_load_split_by_key(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(2000).write.parquet(path)
    sizes = [C.load_corpus(spark, path, s, key="id").count() for s in C.SPLITS]
    assert sum(sizes) == 2000 and abs(sizes[0] / 2000 - 0.8) < 0.03
    assert C.load_corpus(spark, path, key="id").count() == 2000
    with pytest.raises(ValueError):
        C.load_corpus(spark, path, "train")
    with pytest.raises(ValueError):
        C.load_corpus(spark, path, "dev", key="id")


def test_project_and_drop(spark):
    df = spark.createDataFrame([(1, "[C]", "C", "x")], "PUBCHEM_COMPOUND_CID long, CAN_SELFIES string, PUBCHEM_OPENEYE_CAN_SMILES string, ids string")
    assert C.project(df, "pubchem").columns == ["mol_id", "text"]
    assert C.drop_source_columns(df, "pubchem").columns == ["ids"]
    fine = spark.createDataFrame([("C", "[C]", 1)], "smiles string, selfies string, target int")
    assert C.project(fine, "finetune_smiles").first().asDict() == {"text": "C", "target": 1}
    assert C.project(fine, "finetune_selfies").first().text == "[C]"
    zinc = spark.createDataFrame([("Z1", "[C]", "C")], "id string, selfies string, smiles string")
    assert C.project(zinc, "zinc20").first().asDict() == {"mol_id": "Z1", "text": "[C]"}


@pytest.mark.parametrize("batch_size", [None, 1, 7])
def test_map_batches_does_not_depend_on_batches(spark, batch_size):
    df = spark.range(0, 50, 1, 3).withColumn("s", F.col("id").cast("string"))
    out = C.map_batches(df, lambda b: {"n": b["s"].str.len(), "id": b["id"] + 1}, "n long, id long", ["s"], batch_size)
    assert sorted((r.id, r.n) for r in out.collect()) == [(i + 1, len(str(i))) for i in range(50)]


def test_stored_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path / "mine"))
    assert stored(spark.range(5), "numbers").count() == 5 and remove_stored(spark)
    assert not (tmp_path / "mine" / "molweave").exists()


def test_an_empty_vocabulary_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "v")
    empty = spark.createDataFrame([("[PAD]", 3, 0)], "token string, id int, n long")
    with pytest.raises(ValueError):
        C.save_vocab(empty, path)
    assert C.save_vocab(empty.union(spark.createDataFrame([("a", 5, 1)], empty.schema)), path).count() == 2


def test_save_vocab(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    assert C.save_vocab(train_vocab(df), str(tmp_path / "v")).count() == 7
    empty = spark.createDataFrame([], "tokens array<string>")
    with pytest.raises(ValueError):
        C.save_vocab(train_vocab(empty), str(tmp_path / "e"))


def test_log_metrics_is_wide_and_appends(spark, tmp_path):
    rows = [(1, 0, "train", "loss", 1.0), (1, 0, "validation", "loss", 2.0), (1, 1, "train", "roc", 0.5)]
    log = spark.createDataFrame(rows, "run int, epoch int, split string, name string, value double")
    wide = C.log_metrics(log, ["loss", "roc"], {"train": "train", "validation": "val"})
    path = str(tmp_path / "log")
    C.append_metrics(wide.filter("epoch = 0"), path, "r-0")
    C.append_metrics(wide.filter("epoch = 1"), path, "r-1")
    got = [tuple(r) for r in C.read_metrics(wide, path).orderBy("epoch").collect()]
    assert got == [(1, 0, 1.0, None, 2.0, None), (1, 1, None, 0.5, None, None)]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured and fresh_path(spark, "x").startswith(configured)
    assert stored(spark.range(5), "t").count() == 5


def test_stream_has_the_given_schema(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "s"))
    stream = C.stream_corpus(spark, str(tmp_path / "s"), T.StructType([T.StructField("id", T.LongType())]), 1)
    assert stream.isStreaming and stream.columns == ["id"]


def test_a_repeated_record_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "run string, epoch int, loss double")
    broken = F.when(F.col("loss") == 2, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("loss"))
    for run, epoch in (("a", 0), ("b", 0)):
        C.append_metrics(rows.filter((F.col("run") == run) & (F.col("epoch") == epoch)), path, f"{run}-{epoch}")
    with pytest.raises(Exception, match="killed"):
        C.append_metrics(rows.filter("run = 'a' AND epoch = 1").withColumn("loss", broken), path, "a-1")
    for _ in range(2):
        C.append_metrics(rows.filter("run = 'a' AND epoch = 1"), path, "a-1")
    assert sorted(map(tuple, C.read_metrics(rows, path).collect())) == sorted(map(tuple, rows.collect()))
    assert C.read_metrics(rows, path).columns == rows.columns
    with pytest.raises(ValueError):
        C.append_metrics(rows, path, "a/b")


def test_a_step_has_its_files_and_no_task_a_whole_step(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 3)
    files = C.files_of_steps(rows, 2, 500)
    assert files == 5 and C.files_of_steps(rows, 2) == 1 and C.files_of_steps(rows.limit(0), 2) == 1
    for name, part in (("0", rows.filter("id < 2500")), ("1", rows.filter("id < 2"))):
        C.append_step(part, str(tmp_path), name, files)
        written = spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}")
        assert len(written.inputFiles()) == files and written.count() == part.count()
        sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) <= 510
