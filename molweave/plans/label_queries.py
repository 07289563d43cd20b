"""Label statistics, losses and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from molweave.functions import vectors as X
from molweave.operators import labels as L
from molweave.operators import losses as O
from molweave.operators import metrics as M
from molweave.operators import scoring, training
from molweave.plans import inputs as T
from molweave.plans import sql as S
from molweave.plans.registry import query
from molweave.sources.corpus import split_of
from molweave.sources.scratch import stored


def rounded(df, *columns, digits: int = 6):
    """Floating sums depend on their order; results are compared to a fixed number of digits."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _train(df):
    return df.filter("split = 'train'")


_CLS = f"cls AS (SELECT doc_id, {S.split_case('doc_id')} AS split, quality AS target FROM labels)"
_REG = f"reg AS (SELECT doc_id, {S.split_case('doc_id')} AS split, CAST(n_chars AS DOUBLE) AS target FROM documents)"
_WEIGHTS = """w AS (SELECT target, count(*) AS n_c, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
  FROM cls WHERE split = 'train' AND target IS NOT NULL GROUP BY target)"""

# ---- label statistics -----------------------------------------------------------------------------------------------


@query(
    "target_mean_std",
    f"WITH {_REG} SELECT round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std FROM reg WHERE split = 'train'",
)
def target_mean_std(spark, sf):
    return rounded(L.target_mean_std(_train(T.length_rows(spark, sf))), "mean", "std")


@query("class_weights", f"WITH {_CLS}, {_WEIGHTS} SELECT target, n_c, round(weight, 6) AS weight FROM w")
def class_weights(spark, sf):
    return rounded(L.class_weights(_train(T.class_rows(spark, sf))), "weight")


@query(
    "infer_problem",
    """SELECT 'quality' AS target, 'classification' AS problem_type, count(DISTINCT quality) AS num_labels FROM labels
    UNION ALL SELECT 'toxic', 'classification', count(DISTINCT toxic) FROM labels
    UNION ALL SELECT 'n_chars', 'regression', 1""",
)
def infer_problem(spark, sf):
    labels = T.table(spark, sf, "labels")
    sets = [(labels, "quality"), (labels, "toxic"), (T.length_rows(spark, sf).withColumnRenamed("target", "n_chars"), "n_chars")]
    rows = [L.infer_problem(df, t).select(F.lit(t).alias("target"), "problem_type", "num_labels") for df, t in sets]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    "train_stats_to_splits",
    f"""WITH {_CLS}, {_REG}, {_WEIGHTS}, s AS (SELECT avg(target) AS mean, stddev_pop(target) AS std FROM reg WHERE split = 'train')
    SELECT 'classification' AS problem, doc_id, cls.split, CAST(cls.target AS DOUBLE) AS target, round(weight, 6) AS class_weight,
           NULL AS mean, NULL AS std FROM cls LEFT JOIN w USING (target)
    UNION ALL SELECT 'regression', doc_id, split, target, NULL, round(mean, 6), round(std, 6) FROM reg, s""",
)
def train_stats_to_splits(spark, sf):
    c, r = T.class_rows(spark, sf), T.length_rows(spark, sf)
    none = F.lit(None).cast("double")
    first = L.apply_train_stats(c, _train(c)).select(
        F.lit("classification").alias("problem"),
        "doc_id",
        "split",
        F.col("target").cast("double").alias("target"),
        "class_weight",
        none.alias("mean"),
        none.alias("std"),
    )
    second = L.apply_train_stats(r, _train(r)).select(
        F.lit("regression").alias("problem"), "doc_id", "split", "target", none.alias("class_weight"), "mean", "std"
    )
    return rounded(first.union(second), "class_weight", "mean", "std")


@query(
    "standardize",
    f"""WITH {_REG}, s AS (SELECT avg(target) AS mean, stddev_pop(target) AS std FROM reg WHERE split = 'train')
    SELECT doc_id, split, round((target - mean) / nullif(std, 0), 6) AS target FROM reg, s""",
)
def standardize(spark, sf):
    rows = T.length_rows(spark, sf)
    return rounded(L.standardize(rows, _train(rows)), "target")


_MULTI = ["l_quantity", "l_extendedprice", "l_discount", "0"]


@query(
    "standardize_multi",
    f"""WITH t AS (SELECT *, {S.split_case('l_orderkey')} AS split FROM lineitem),
    s AS (SELECT {', '.join(f'avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}' for i, c in enumerate(_MULTI))}
          FROM t WHERE split = 'train')
    SELECT l_orderkey, l_linenumber, split,
           {', '.join(f'round(({c} - m{i}) / s{i}, 5) AS z{i}' for i, c in enumerate(_MULTI))} FROM t, s""",
)
def standardize_multi(spark, sf):
    targets = F.array(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.lit(0.0))
    rows = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", split_of("l_orderkey").alias("split"), targets.alias("targets")
    )
    z = L.standardize_multi(rows, _train(rows), num_tasks=4)
    return z.select("l_orderkey", "l_linenumber", "split", *[F.round(F.col("targets")[i], 5).alias(f"z{i}") for i in range(4)])


# ---- losses ---------------------------------------------------------------------------------------------------------


def _nll(logits: str, label: str) -> str:
    return f"({S.lse(logits)} - {logits}[{label} + 1])"


@query("softmax_prob", f"WITH {S.HEADS} SELECT vec_id, round(exp(binary_logits[2] - {S.lse('binary_logits')}), 6) AS p FROM heads")
def softmax_prob(spark, sf):
    return rounded(T.head_outputs(spark, sf).select("vec_id", X.positive_probability(F.col("binary_logits")).alias("p")), "p")


@query(
    "argmax_pred",
    f"WITH {S.HEADS} SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM heads",
)
def argmax_pred(spark, sf):
    return T.head_outputs(spark, sf).select("vec_id", X.argmax(F.col("logits")).alias("pred"))


@query(
    "token_cross_entropy",
    f"""WITH {S.HEADS} SELECT batch_id, round(avg({_nll('logits', 'mlm_label')}) FILTER (mlm_label >= 0), 6) AS loss,
    count(*) FILTER (mlm_label >= 0) AS n FROM heads GROUP BY batch_id""",
)
def token_cross_entropy(spark, sf):
    return rounded(O.token_cross_entropy(T.head_outputs(spark, sf), "logits", "mlm_label", 10, ["batch_id"]), "loss")


@query(
    "weighted_cross_entropy",
    f"""WITH {S.HEADS}, w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM heads GROUP BY label)
    SELECT round(sum(weight * {_nll('logits', 'label')}) / sum(weight), 6) AS loss FROM heads JOIN w USING (label)""",
)
def weighted_cross_entropy(spark, sf):
    rows = T.head_outputs(spark, sf)
    return rounded(O.weighted_cross_entropy(rows, L.class_weights(rows, "label"), "logits", "label", 10), "loss")


@query(
    "bce_with_logits",
    f"""WITH {S.HEAD_POSITIONS} SELECT batch_id, round(avg({S.bce('disc_logit', 'disc_label')}), 6) AS loss, count(*) AS n,
    'non_pad' AS mask FROM hp WHERE token_id <> 3 GROUP BY batch_id
    UNION ALL SELECT batch_id, round(avg({S.bce('disc_logit', 'disc_label')}), 6), count(*), 'none' FROM hp GROUP BY batch_id""",
)
def bce_with_logits(spark, sf):
    rows = T.head_positions(spark, sf)
    kept = O.bce_loss(rows, "disc_logit", "disc_label", F.col("token_id") != 3, ["batch_id"])
    every = O.bce_loss(rows, "disc_logit", "disc_label", None, ["batch_id"])
    return rounded(kept.withColumn("mask", F.lit("non_pad")).union(every.withColumn("mask", F.lit("none"))), "loss")


@query(
    "multilabel_bce",
    f"""WITH {S.HEADS}, long AS (SELECT unnest(multi_logits) AS x, unnest(multi_targets) AS y FROM heads)
    SELECT round(avg({S.bce('x', 'y')}), 6) AS loss FROM long""",
)
def multilabel_bce(spark, sf):
    return rounded(O.multilabel_bce(T.head_outputs(spark, sf), 3, "multi_logits", "multi_targets"), "loss")


@query(
    "mse_loss",
    """SELECT l_returnflag AS run, round(avg((l_quantity / 50 - l_tax) * (l_quantity / 50 - l_tax)
      + (l_extendedprice / 1e5 - l_discount) * (l_extendedprice / 1e5 - l_discount)) / 2, 6) AS loss FROM lineitem GROUP BY l_returnflag""",
)
def mse_loss(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run"),
        (F.col("l_quantity") / 50).alias("p1"),
        F.col("l_tax").alias("t1"),
        (F.col("l_extendedprice") / 1e5).alias("p2"),
        F.col("l_discount").alias("t2"),
    )
    return rounded(O.mse_loss(rows, [("p1", "t1"), ("p2", "t2")], ["run"]), "loss")


@query(
    "labelled_cross_entropy",
    f"WITH {S.HEADS} SELECT round(coalesce(avg({_nll('logits', 'mlm_label')}) FILTER (mlm_label >= 0), 0), 6) AS loss FROM heads",
)
def labelled_cross_entropy(spark, sf):
    return rounded(O.labelled_cross_entropy(T.head_outputs(spark, sf), "logits", "mlm_label", 10), "loss")


@query(
    "soft_label_loss",
    f"""WITH {S.HEADS}, long AS (SELECT vec_id, unnest(logits) - {S.lse('logits')} AS lp,
      exp(unnest(soft_logits) - {S.lse('soft_logits')}) AS t FROM heads),
    rows AS (SELECT vec_id, -sum(lp * t) AS l FROM long GROUP BY vec_id) SELECT round(avg(l), 6) AS loss FROM rows""",
)
def soft_label_loss(spark, sf):
    return rounded(O.soft_label_loss(T.head_outputs(spark, sf), "logits", "soft_targets", 10), "loss")


_DISC_HIT = "avg(CAST((CASE WHEN disc_logit > 0 THEN 1 ELSE 0 END) = disc_label AS INTEGER))"
_DISC_ACC = f"0.5 * {_DISC_HIT} FILTER (masked) + 0.5 * {_DISC_HIT} FILTER (NOT masked)"


@query(
    "rtd_total_loss",
    f"""WITH {S.HEAD_POSITIONS}, b AS (SELECT batch_id, avg(nll) AS mlm_loss,
      avg({S.bce('disc_logit', 'disc_label')}) FILTER (token_id <> 3) AS disc_loss, {_DISC_ACC} AS disc_acc FROM hp GROUP BY batch_id)
    SELECT batch_id, round(mlm_loss, 6) AS mlm_loss, round(disc_loss, 6) AS disc_loss, round(disc_acc, 6) AS disc_acc,
      round(mlm_loss + 50 * disc_loss, 6) AS loss FROM b""",
)
def rtd_total_loss(spark, sf):
    return rounded(O.rtd_losses(T.head_positions(spark, sf)), "mlm_loss", "disc_loss", "disc_acc", "loss")


@query(
    "generator_accuracy",
    f"""WITH {S.HEADS} SELECT batch_id, round(avg(CAST(list_position(logits, list_max(logits)) - 1 = label AS INTEGER))
      FILTER (mlm_label >= 0), 6) AS gen_acc FROM heads GROUP BY batch_id""",
)
def generator_accuracy(spark, sf):
    rows = T.head_outputs(spark, sf).withColumn("masked", F.col("mlm_label") >= 0)
    return rounded(O.generator_accuracy(rows, by=["batch_id"]), "gen_acc")


@query(
    "discriminator_pred",
    f"WITH {S.HEAD_POSITIONS} SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(disc_logit > 0 AS INTEGER) AS pred FROM hp",
)
def discriminator_pred(spark, sf):
    return T.head_positions(spark, sf).select("vec_id", "pos", X.sign_prediction(F.col("disc_logit")).alias("pred"))


@query("discriminator_accuracy", f"WITH {S.HEAD_POSITIONS} SELECT round({_DISC_ACC}, 6) AS disc_acc FROM hp")
def discriminator_accuracy(spark, sf):
    return rounded(O.discriminator_accuracy(T.head_positions(spark, sf)), "disc_acc")


# ---- heads ----------------------------------------------------------------------------------------------------------


def _features(spark, sf):
    return T.table(spark, sf, "embeddings").select(
        "vec_id",
        split_of("vec_id").alias("split"),
        F.col("embedding").alias("features"),
        (F.col("label") < 5).cast("int").alias("target"),
        F.col("embedding")[0].cast("double").alias("number"),
    )


def demo_head(width: int = 64) -> dict[str, np.ndarray]:
    """A head with simple weights in place of trained ones: each unit doubles its input, two outputs weigh the units."""
    ramp = np.arange(1, width + 1) / width
    return {
        "dense_w": 2.0 * np.eye(width),
        "dense_b": np.full(width, 0.1),
        "out_w": np.stack([ramp, 1.0 - ramp]),
        "out_b": np.array([0.0, 0.5]),
    }


_UNIT = "tanh(2 * CAST(x AS DOUBLE) + 0.1)"


@query(
    "score_batch",
    f"""WITH l AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: {_UNIT} * i / 64)) AS a,
      list_sum(list_transform(embedding, lambda x, i: {_UNIT} * (1 - CAST(i AS DOUBLE) / 64))) + 0.5 AS b FROM embeddings)
    SELECT vec_id, round(a, 6) AS logit_0, round(b, 6) AS logit_1, round(1 / (1 + exp(a - b)), 6) AS p FROM l""",
)
def score_batch(spark, sf):
    rows = _features(spark, sf).withColumn("features", F.col("features").cast("array<double>"))
    logits = F.col("logits")
    scored = scoring.score_batch(rows, demo_head(), scoring.HEAD_ACTIVATION["roberta"]).select(
        "vec_id", logits[0].alias("logit_0"), logits[1].alias("logit_1"), X.positive_probability(logits).alias("p")
    )
    return rounded(scored, "logit_0", "logit_1", "p")


def _optimum(df, error, weight, features):
    """(part, i, value): mean of weighted error times each feature, and the error alone; all are 0 where a fit has its optimum."""
    terms = [error, *[error * F.col(features)[i].cast("double") for i in range(T.VECTOR_WIDTH)]]
    sums = df.agg(*[(F.sum(weight * x) / F.sum(weight)).alias(f"g{i}") for i, x in enumerate(terms)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (F.round(f"g{i}", 4) + 0.0).alias("value")) for i in range(len(terms))])
    return sums.select(F.lit("optimum").alias("part"), F.explode(cells).alias("c")).select("part", "c.i", "c.value")


def _two(spark, first, second):
    """(part, i, value) of a model with one feature."""
    return spark.createDataFrame([("one", 0, round(float(first), 4)), ("one", 1, round(float(second), 4))], "part string, i int, value double")


_ZEROS = "SELECT 'optimum', CAST(i AS INTEGER), 0.0 FROM range(65) t(i)"


@query(
    "finetune_classifier",
    f"""WITH f AS (SELECT CAST(embedding[1] > 0 AS INTEGER) AS x, CAST(label < 5 AS INTEGER) AS y,
      {S.split_case('vec_id')} AS split FROM embeddings),
    t AS (SELECT * FROM f WHERE split = 'train'),
    w AS (SELECT y, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS w FROM t GROUP BY y),
    o AS (SELECT x, ln(sum(w) FILTER (y = 1) / sum(w) FILTER (y = 0)) AS odds FROM t JOIN w USING (y) GROUP BY x)
    SELECT 'one' AS part, 0 AS i, round((SELECT odds FROM o WHERE x = 0), 4) AS value
    UNION ALL SELECT 'one', 1, round((SELECT odds FROM o WHERE x = 1) - (SELECT odds FROM o WHERE x = 0), 4)
    UNION ALL {_ZEROS}""",
)
def finetune_classifier(spark, sf):
    """A head on one two-valued feature is the log odds; a head on all features leaves errors that no feature explains."""
    train = _train(_features(spark, sf))
    sign = train.withColumn("features", F.array((F.col("features")[0] > 0).cast("double")))
    one = scoring.fit_classifier(sign)
    model = scoring.fit_classifier(train)
    weighted = L.apply_train_stats(scoring.classifier_predictions(model, train), train)
    error = X.positive_probability(F.col("logits")) - F.col("target")
    return _two(spark, one.intercept, one.coefficients[0]).unionByName(_optimum(weighted, error, F.col("class_weight"), "features"))


@query(
    "finetune_regressor",
    f"""WITH f AS (SELECT CAST(embedding[2] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, {S.split_case('vec_id')} AS split
      FROM embeddings),
    t AS (SELECT x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS z FROM f WHERE split = 'train'),
    s AS (SELECT covar_pop(x, z) / var_pop(x) AS slope, avg(x) AS mx, avg(z) AS mz FROM t)
    SELECT 'one' AS part, 0 AS i, round(mz - slope * mx, 4) AS value FROM s UNION ALL SELECT 'one', 1, round(slope, 4) FROM s
    UNION ALL {_ZEROS}""",
)
def finetune_regressor(spark, sf):
    """A head on one feature is the least-squares line of the standardised target; on all features, errors none explains."""
    rows = _train(_features(spark, sf)).withColumn("target", F.col("number"))
    one = scoring.fit_regressor(rows.withColumn("features", F.slice("features", 2, 1)))
    rest = rows.withColumn("features", F.concat(F.array(F.lit(0.0)), F.slice("features", 2, T.VECTOR_WIDTH - 1).cast("array<double>")))
    model = scoring.fit_regressor(rest)
    scaled = L.standardize(scoring.regressor_predictions(model, rest), rest)
    return _two(spark, one.intercept, one.coefficients[0]).unionByName(
        _optimum(scaled, F.col("pred") - F.col("target"), F.lit(1.0), "features")
    )


EPOCHS, EPOCH_STEPS = 6, 3


@query(
    "finetune_epochs",
    f"""WITH f AS (SELECT {S.split_case('vec_id')} AS split FROM embeddings)
    SELECT split, count(*) AS n, true AS as_good, {EPOCHS} AS n_epochs FROM f WHERE split IN ('train', 'validation') GROUP BY split""",
)
def finetune_epochs(spark, sf):
    """A head trained by epochs beside the MLlib fit of the same rows: the mean loss of its best epoch is as good within 0.02."""
    rows = stored(_features(spark, sf), "features")
    train, held = (rows.filter(F.col("split") == s).select("vec_id", "split", "features", "target") for s in ("train", "validation"))
    head, _, log = training.fit_epochs(train, held, "classification", "vec_id", T.SEED, EPOCHS, EPOCH_STEPS)
    model = scoring.fit_classifier(train)
    both = train.unionByName(held)
    ours = training.head_predictions(head, both).withColumn("a", X.negative_log_likelihood(F.col("logits"), F.col("target"), 2)).drop("logits")
    theirs = scoring.classifier_predictions(model, ours).withColumn("b", X.negative_log_likelihood(F.col("logits"), F.col("target"), 2))
    n_epochs = log.select(F.countDistinct("epoch").cast("int").alias("n_epochs")).scalar()
    per = theirs.groupBy("split").agg(F.count(F.lit(1)).alias("n"), (F.avg("a") <= F.avg("b") + 0.02).alias("as_good"))
    return per.withColumn("n_epochs", n_epochs)


# ---- metrics --------------------------------------------------------------------------------------------------------

_RMSE = "sqrt(avg((pred - target) * (pred - target)))"
_PEARSON = "covar_pop(pred, target) / nullif(stddev_pop(pred) * stddev_pop(target), 0)"
_PRECISION = "coalesce(count(*) FILTER (score > 0.5 AND label = 1) / nullif(CAST(count(*) FILTER (score > 0.5) AS DOUBLE), 0), 0)"


@query(
    "batch_mean_loss",
    f"""WITH {S.PREDS}, b AS (SELECT run, epoch, split, batch_id, avg(loss / 1e6) AS l FROM preds GROUP BY ALL)
    SELECT run, epoch, split, round(avg(l), 6) AS loss, count(*) AS n_batches FROM b GROUP BY run, epoch, split""",
)
def batch_mean_loss(spark, sf):
    return rounded(M.batch_mean_loss(T.predictions(spark, sf).withColumn("loss", F.col("loss") / 1e6)), "loss")


@query("rmse", f"WITH {S.PREDS} SELECT split, round({_RMSE}, 6) AS rmse FROM preds GROUP BY split")
def rmse(spark, sf):
    return rounded(M.rmse(T.predictions(spark, sf), by=["split"]), "rmse")


@query("pearsonr", f"WITH {S.PREDS} SELECT split, round({_PEARSON}, 6) AS pearsonr FROM preds GROUP BY split")
def pearsonr(spark, sf):
    return rounded(M.pearsonr(T.predictions(spark, sf), by=["split"]), "pearsonr")


@query("precision", f"WITH {S.PREDS} SELECT split, round({_PRECISION}, 6) AS precision FROM preds GROUP BY split")
def precision(spark, sf):
    return rounded(M.precision(T.predictions(spark, sf), "score", "label", ["split"]), "precision")


@query(
    "auroc",
    f"""WITH {S.PREDS}, s AS (SELECT 'tied' AS scores, score AS s, label FROM preds
      UNION ALL SELECT 'continuous', target, label FROM preds)
    SELECT scores, round(roc, 6) AS roc FROM ({S.roc_rows('s', 'scores', 's', 'label')})""",
)
def auroc(spark, sf):
    p = T.predictions(spark, sf)
    tied = p.select(F.lit("tied").alias("scores"), F.col("score").alias("s"), "label")
    both = tied.union(p.select(F.lit("continuous").alias("scores"), F.col("target").alias("s"), "label"))
    return rounded(M.auroc(both, "s", "label", ["scores"]), "roc")


@query(
    "mae",
    f"""WITH {S.PREDS}, r AS (SELECT run, split, avg(abs(pred - target)) AS m FROM preds GROUP BY run, split)
    SELECT split, round(avg(m), 6) AS mae_mean FROM r GROUP BY split""",
)
def mae(spark, sf):
    return rounded(M.mae(T.predictions(spark, sf), by=["split"]), "mae_mean")


@query(
    "evaluate_predictions",
    f"""WITH {S.PREDS}, c AS (SELECT split, {_PRECISION} AS p FROM preds GROUP BY split),
    r AS (SELECT split, {_RMSE} AS e, {_PEARSON} AS c FROM preds GROUP BY split), a AS ({S.roc_rows('preds', 'split', 'score', 'label')}),
    long AS (SELECT 'classification' AS problem, split, 'precision' AS name, p AS value FROM c
      UNION ALL SELECT 'classification', split, 'roc', roc FROM a
      UNION ALL SELECT 'regression', split, 'rmse', e FROM r UNION ALL SELECT 'regression', split, 'pearsonr', c FROM r)
    SELECT problem, split, name, round(value, 6) AS value FROM long""",
)
def evaluate_predictions(spark, sf):
    p = T.predictions(spark, sf)
    kinds = {"classification": ("score", "label"), "regression": ("pred", "target")}
    made = [M.evaluate_predictions(p, k, *c).withColumn("problem", F.lit(k)) for k, c in kinds.items()]
    return rounded(made[0].unionByName(made[1]), "value").select("problem", "split", "name", "value")


_EPOCHS = f"""{S.PREDS}, b AS (SELECT run, epoch, split, batch_id, avg(loss / 1e6) AS l FROM preds GROUP BY ALL),
    m AS (SELECT run, epoch, split, {_RMSE} AS rmse, {_PEARSON} AS pearsonr FROM preds GROUP BY run, epoch, split),
    long AS (SELECT run, epoch, split, 'loss' AS name, avg(l) AS value FROM b GROUP BY run, epoch, split
      UNION ALL SELECT run, epoch, split, 'rmse', rmse FROM m UNION ALL SELECT run, epoch, split, 'pearsonr', pearsonr FROM m),
    named AS (SELECT run, epoch, split, CASE split WHEN 'train' THEN 'train_' ELSE 'val_' END || name AS name, value FROM long)"""


def _epochs(spark, sf):
    p = T.predictions(spark, sf).withColumn("loss", F.col("loss") / 1e6)
    return M.epoch_metrics(p, "regression", {"train": "train", "validation": "val"})


@query("epoch_metrics", f"WITH {_EPOCHS} SELECT run, epoch, name, round(value, 6) AS value FROM named")
def epoch_metrics(spark, sf):
    return rounded(_epochs(spark, sf), "value")


@query(
    "format_metrics",
    f"""WITH {_EPOCHS} SELECT run, epoch, split_part(name, '_', 1) AS split,
      '[' || split_part(name, '_', 1) || '] epoch ' || epoch || ' ' ||
      string_agg(name || ': ' || printf('%.4f', value), ' ' ORDER BY name) AS line
    FROM named GROUP BY run, epoch, split_part(name, '_', 1)""",
)
def format_metrics(spark, sf):
    rows = _epochs(spark, sf).withColumn("split", F.split_part("name", F.lit("_"), F.lit(1)))
    return M.format_metrics(rows, ["run", "epoch", "split"])


_PRETRAINING = ", ".join(f"avg({n}) AS {n}" for n in M.PRETRAINING_METRICS)


@query(
    "pretraining_metrics",
    f"""WITH {S.HEAD_POSITIONS}, b AS (SELECT batch_id, batch_id % 3 AS epoch, {S.split_case('batch_id')} AS split, avg(nll) AS mlm_loss,
      avg({S.bce('disc_logit', 'disc_label')}) FILTER (token_id <> 3) AS disc_loss, {_DISC_ACC} AS disc_acc,
      avg(CAST(disc_logit > 0 AS INTEGER)) FILTER (masked) AS gen_acc FROM hp GROUP BY batch_id),
    c AS (SELECT *, mlm_loss + 50 * disc_loss AS loss FROM b),
    e AS (SELECT epoch, split, {_PRETRAINING} FROM c GROUP BY epoch, split),
    long AS (UNPIVOT e ON {', '.join(M.PRETRAINING_METRICS)} INTO NAME name VALUE value)
    SELECT epoch, CASE split WHEN 'train' THEN 'train_' WHEN 'validation' THEN 'val_' ELSE 'test_' END || name AS name,
           round(value, 6) AS value FROM long""",
)
def pretraining_metrics(spark, sf):
    """The epoch record of pretraining; a positive logit stands in for the generator's hit."""
    rows = T.head_positions(spark, sf).select(
        "*", (F.col("batch_id") % 3).alias("epoch"), split_of("batch_id").alias("split"), (F.col("disc_logit") > 0).alias("hit")
    )
    batches = O.rtd_losses(rows, ["epoch", "split", "batch_id"], hit="hit")
    return rounded(M.pretraining_metrics(batches, {"train": "train", "validation": "val", "test": "test"}, ["epoch"]), "value")
