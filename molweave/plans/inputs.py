"""Inputs in the engine's shapes, derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.hashing import position_uniform, uniform
from molweave.functions.ids import PAD, add_template
from molweave.functions.vectors import softmax
from molweave.operators.corrupt import corrupt_sequences, mask_state, ngram_candidates, sample_state
from molweave.operators.encoding import encode_text, model_inputs, tokenize
from molweave.operators.vocab import encode, train_vocab
from molweave.sources.corpus import split_of
from molweave.sources.scratch import stored

SEED = 42
BATCH_SIZE = 32
# Elements of a vector of the embeddings table.
VECTOR_WIDTH = 64

# Event types read as metric names.
METRIC_OF_EVENT = {"click": "loss", "error": "rmse", "purchase": "pearsonr", "signup": "roc", "view": "precision"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_selfies(text: Column) -> Column:
    """Prose as a molecule string: every run of letters a symbol, every full stop a fragment dot."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\."), F.lit(0))
    bracketed = F.concat(F.lit("["), F.array_join(parts, "]["), F.lit("]"))
    return F.replace(F.replace(bracketed, F.lit("[.]"), F.lit(".")), F.lit("[]"), F.lit(""))


def molecules(documents: DataFrame) -> DataFrame:
    """(mol_id, split, selfies); works on batches and streams."""
    return documents.select(
        F.col("doc_id").alias("mol_id"), split_of("doc_id").alias("split"), as_selfies(F.col("text")).alias("selfies")
    )


def spread(df: DataFrame) -> DataFrame:
    """A table of few files may be one row group, which one task reads: deal its rows to all cores. One with a file for each core is
    read by all of them as it is."""
    if not df.isStreaming and len(df.inputFiles()) >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, split, tokens)"""
    return tokenize(corpus(spark, sf_dir)).drop("selfies")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the train split, written once so that later uses do not count again."""
    return stored(train_vocab(tokenized(spark, sf_dir).filter("split = 'train'")), "vocab")


def encoded(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    """(mol_id, split, ids)"""
    vocab = vocabulary(spark, sf_dir) if vocab is None else vocab
    return encode(tokenized(spark, sf_dir), vocab, key="mol_id", keep=False)


def inputs(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    """(mol_id, split, input_ids, attention_mask, token_type_ids)"""
    vocab = vocabulary(spark, sf_dir) if vocab is None else vocab
    return encode_text(corpus(spark, sf_dir), vocab, key="mol_id")


def proposals(spark: SparkSession, sf_dir: str, vocab: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The written proposals of the train split."""
    train = (encoded(spark, sf_dir, vocab) if ids is None else ids).filter("split = 'train'")
    return ngram_candidates(train.select(add_template(F.col("ids")).alias("ids")))


def written_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, (mol_id, split, ids)), both written; texts are split into tokens once for the two."""
    tokens = stored(tokenized(spark, sf_dir), "tokens")
    vocab = stored(train_vocab(tokens.filter("split = 'train'")), "vocab")
    return vocab, stored(encode(tokens, vocab, key="mol_id", keep=False), "ids")


def corrupted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """(mol_id, split, input_ids) with masked and replaced sequences."""
    return corrupted_with_vocabulary(spark, sf_dir, **options)[0]


def corrupted_with_vocabulary(
    spark: SparkSession, sf_dir: str, chosen: Callable[[DataFrame], DataFrame] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The corrupted sequences and the vocabulary; ``chosen`` picks sequences whose corruption is looked at. Draws are a row's own."""
    vocab, ids = written_ids(spark, sf_dir)
    rows = model_inputs(ids).select("mol_id", "split", "input_ids")
    rows = rows if chosen is None else chosen(rows)
    return corrupt_sequences(rows, proposals(spark, sf_dir, vocab, ids), "mol_id", SEED, **options), vocab


def stand_in_logit(token: Column, pos: Column) -> Column:
    """A discriminator stand-in: a logit between -2.5 and 2.5 that depends on the token shown and its place."""
    return ((token * 7 + pos * 3) % 11 - 5) / F.lit(2.0)


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, target) with an unbalanced two-class target."""
    return table(spark, sf_dir, "labels").select("doc_id", split_of("doc_id").alias("split"), F.col("quality").alias("target"))


def length_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, target) with a numeric target."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", split_of("doc_id").alias("split"), F.col("n_chars").cast("double").alias("target")
    )


def strided_sums(vector: Column, outputs: int) -> Column:
    """Logits of a small fixed head over a whole vector: output k sums the elements k, k + outputs, ..."""

    def sum_from(k: Column) -> Column:
        places = F.sequence(k, F.lit(VECTOR_WIDTH - 1), F.lit(outputs))
        return F.aggregate(places, F.lit(0.0), lambda total, i: total + F.get(vector, i).cast("double"))

    return F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), sum_from)


def head_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of several heads for each vector."""
    e = F.col("embedding")
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        label.alias("label"),
        F.floor(F.col("vec_id") / BATCH_SIZE).alias("batch_id"),
        strided_sums(e, 10).alias("logits"),
        strided_sums(e, 2).alias("binary_logits"),
        (label < 5).cast("int").alias("binary_target"),
        F.when(uniform("keep", "vec_id") < 0.85, label).otherwise(-100).alias("mlm_label"),
        strided_sums(e, 3).alias("multi_logits"),
        F.array((label % 2).cast("int"), (label % 3 == 0).cast("int"), (label < 5).cast("int")).alias("multi_targets"),
        softmax(F.reverse(strided_sums(e, 10)), 10).alias("soft_targets"),
    )


def head_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discriminator outputs position by position, padded after a length that depends on the label."""
    long = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.floor(F.col("vec_id") / BATCH_SIZE).alias("batch_id"),
        mask_state(SEED, "vec_id").alias("m"),
        sample_state(SEED, "vec_id").alias("s"),
        F.posexplode("embedding").alias("pos", "x"),
    )
    pos = F.col("pos")
    token = F.when(pos >= 6 * (F.col("label") + 1), F.lit(PAD)).otherwise(pos + 5)
    masked = (token != PAD) & (position_uniform(F.col("m"), pos) < 0.15)
    replaced = (masked & (position_uniform(F.col("s"), pos) < 0.8)).cast("int")
    x = F.col("x").cast("double")
    return long.select(
        "vec_id",
        "batch_id",
        "pos",
        token.alias("token_id"),
        masked.alias("masked"),
        x.alias("disc_logit"),
        replaced.alias("disc_label"),
        F.when(masked, F.abs(x) * 10).alias("nll"),
    )


def line_split() -> Column:
    return F.when(F.col("l_linestatus") == "O", "train").otherwise("validation")


def line_scores() -> list[Column]:
    """A score with many ties and a two-class label, per order line."""
    return [(F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression and binary predictions per order line; an order is a batch."""
    price, guess = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"),
        F.col("l_linenumber").alias("epoch"),
        line_split().alias("split"),
        F.col("l_orderkey").alias("batch_id"),
        guess.alias("pred"),
        price.alias("target"),
        ((guess - price) * (guess - price)).alias("loss"),
        *line_scores(),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, split, name, value): a user's largest value of a day is the run's metric of an epoch."""
    names = F.create_map(*[F.lit(x) for pair in METRIC_OF_EVENT.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("run"),
            F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
            F.when(F.hour("ts") < 12, "train").otherwise("validation").alias("split"),
            names[F.col("event_type")].alias("name"),
            "value",
        )
        .groupBy("run", "epoch", "split", "name")
        .agg(F.max("value").alias("value"))
    )


def event_predictions(events: DataFrame) -> DataFrame:
    """(epoch, split, pred, target) from an event table or stream."""
    return events.select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        split_of("event_id").alias("split"),
        F.get_json_object("props", "$.k").cast("double").alias("pred"),
        F.col("value").alias("target"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changed = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return before.drop("c_mktsegment"), before.select("c_custkey", changed.alias("c_acctbal"))
