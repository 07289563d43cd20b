"""Corruption, run analysis and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from molweave.functions.ids import CLS, PAD, SEP
from molweave.operators import corrupt as K
from molweave.operators import losses, ordering, review, runs
from molweave.plans import inputs as T
from molweave.plans import sql as S
from molweave.plans.corpus_queries import shown
from molweave.plans.registry import query
from molweave.sources.corpus import append_step, files_of_steps, stream_corpus
from molweave.sources.scratch import fresh_path, stored
from molweave.streaming import stateful
from molweave.streaming.jobs import drain

PATIENCE = 3
# Rows of a file of the metric log, which are short.
LOG_FILE_ROWS = 200_000
# Below 1, likely tokens are sampled more often than they are counted.
TEMPERATURE = 0.5


def _per_sequence(column: str, out: str, source: str = "masked") -> str:
    return f"SELECT mol_id, string_agg({column}, ' ' ORDER BY pos) AS {out} FROM {source} GROUP BY mol_id"


# ---- corruption -----------------------------------------------------------------------------------------------------


@query(
    "ignore_mask",
    f"""WITH {S.POSITIONS} SELECT mol_id, count(*) FILTER (token_id = {PAD}) AS n_ignored,
    count(*) FILTER (token_id IN ({PAD}, {CLS}, {SEP})) AS n_special, count(*) AS n FROM masked GROUP BY mol_id""",
)
def ignore_mask(spark, sf):
    long = T.inputs(spark, sf).select("mol_id", F.explode("input_ids").alias("t"))
    default, wide = K.ignore_mask(F.col("t")), K.ignore_mask(F.col("t"), (PAD, CLS, SEP))
    return long.groupBy("mol_id").agg(
        F.count_if(default).alias("n_ignored"), F.count_if(wide).alias("n_special"), F.count(F.lit(1)).alias("n")
    )


@query(
    "bernoulli_mask",
    f"""WITH {S.POSITIONS} SELECT CAST(pos AS INTEGER) AS pos, count(*) FILTER (masked) AS n_masked, CAST(sum(CASE WHEN masked THEN mol_id ELSE 0 END) AS BIGINT)
    AS mol_sum, count(*) AS n FROM masked GROUP BY pos""",
)
def bernoulli_mask(spark, sf):
    """How often each position is masked, from the long form."""
    long = K.mask_positions(T.inputs(spark, sf), "mol_id", T.SEED)
    return long.groupBy("pos").agg(
        F.count_if("masked").alias("n_masked"),
        F.sum(F.when(F.col("masked"), F.col("mol_id")).otherwise(0)).alias("mol_sum"),
        F.count(F.lit(1)).alias("n"),
    )


def _masked(spark, sf):
    return K.mask_sequences(T.inputs(spark, sf).select("mol_id", "input_ids"), "mol_id", T.SEED)


@query("mlm_labels", f"WITH {S.POSITIONS} {_per_sequence('mlm_label', 'mlm_labels')}")
def mlm_labels(spark, sf):
    return _masked(spark, sf).select("mol_id", shown(F.col("mlm_labels")).alias("mlm_labels"))


@query("masked_input", f"WITH {S.POSITIONS} {_per_sequence('masked_id', 'masked_input')}")
def masked_input(spark, sf):
    return _masked(spark, sf).select("mol_id", shown(F.col("masked_input")).alias("masked_input"))


@query(
    "gumbel_sample",
    f"""WITH {S.HEADS},
    g0 AS (SELECT vec_id, {S.hash_of(f'{T.SEED}:sample', 'vec_id')} AS s, unnest(logits) AS logit,
                  generate_subscripts(logits, 1) - 1 AS i FROM heads),
    {S.mixed('g1', 'g0', 's', 'i', 'gx')},
    g2 AS (SELECT vec_id, i, logit / 0.5 - ln(-ln(gx / CAST({1 << 32} AS DOUBLE) + 1e-9) + 1e-9) AS score FROM g1)
    SELECT vec_id, CAST(i AS INTEGER) AS sampled FROM g2
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) = 1""",
)
def gumbel_sample(spark, sf):
    rows = T.head_outputs(spark, sf)
    return rows.select("vec_id", K.gumbel_sample(0.5)(F.col("logits"), K.sample_state(T.SEED, "vec_id")).alias("sampled"))


@query("ngram_generator", f"WITH {S.IDS}, {S.NGRAMS} SELECT prev, rank, token, round(log_p, 6) AS log_p FROM cands")
def ngram_generator(spark, sf):
    rows = T.proposals(spark, sf, *T.written_ids(spark, sf))
    return rows.select("prev", "rank", "token", F.round("log_p", 6).alias("log_p"))


@query(
    "replace_tokens",
    f"""WITH {S.REPLACED} SELECT mol_id, string_agg(disc_id, ' ' ORDER BY pos) AS disc_input,
    string_agg(disc_label, ' ' ORDER BY pos) AS disc_labels FROM replaced GROUP BY mol_id""",
)
def replace_tokens(spark, sf):
    return T.corrupted(spark, sf).select("mol_id", *[shown(F.col(c)).alias(c) for c in ("disc_input", "disc_labels")])


@query(
    "replace_tokens_tempered",
    f"""WITH {S.replaced(TEMPERATURE)} SELECT mol_id, string_agg(disc_id, ' ' ORDER BY pos) AS disc_input,
    string_agg(disc_label, ' ' ORDER BY pos) AS disc_labels FROM replaced GROUP BY mol_id""",
)
def replace_tokens_tempered(spark, sf):
    """Replacements drawn at half the temperature, where likely tokens are likelier still."""
    rows = T.corrupted(spark, sf, temperature=TEMPERATURE)
    return rows.select("mol_id", *[shown(F.col(c)).alias(c) for c in ("disc_input", "disc_labels")])


_JUDGED = f"""{S.REPLACED}, {S.GENERATOR}, batched AS (SELECT j.*, mol_id // {T.BATCH_SIZE} AS batch_id,
  split FROM judged j JOIN inputs USING (mol_id))"""


@query(
    "generator_losses",
    f"""WITH {_JUDGED} SELECT batch_id, split, round(avg(nll), 6) AS mlm_loss, avg(CAST(hit AS DOUBLE)) AS gen_acc,
    round(exp(avg(nll)), 4) AS perplexity, count(nll) AS n FROM batched GROUP BY batch_id, split""",
)
def generator_losses(spark, sf):
    """Loss and accuracy of the generator that made the replacements, per batch and split."""
    rows = T.corrupted(spark, sf, judged=True).withColumn("batch_id", F.floor(F.col("mol_id") / T.BATCH_SIZE))
    long = K.positions_of(rows, ["batch_id", "split"], {"nll": "nll", "gen_hit": "hit"})
    return losses.generator_losses(long, by=("batch_id", "split")).select(
        "batch_id", "split", F.round("mlm_loss", 6).alias("mlm_loss"), "gen_acc", F.round("perplexity", 4).alias("perplexity"), "n"
    )


@query(
    "pretraining_step",
    f"""WITH {_JUDGED}, f AS (SELECT r.*, r.mol_id // {T.BATCH_SIZE} AS bid, nll, hit, {S.DISC_LOGIT} AS x FROM replaced r LEFT JOIN judged j ON j.mol_id = r.mol_id AND j.pos = r.pos),
    l AS (SELECT f.*, {S.bce('x', 'disc_label')} AS bce, CAST((x > 0) = (disc_label = 1) AS DOUBLE) AS correct FROM f)
    SELECT bid AS batch_id, round(avg(nll), 6) AS mlm_loss, round(avg(bce) FILTER (token_id <> {PAD}), 6) AS disc_loss,
      round(0.5 * avg(correct) FILTER (masked) + 0.5 * avg(correct) FILTER (NOT masked), 6) AS disc_acc, avg(CAST(hit AS DOUBLE)) AS gen_acc,
      round(avg(nll) + 50 * avg(bce) FILTER (token_id <> {PAD}), 4) AS loss FROM l GROUP BY bid""",
)
def pretraining_step(spark, sf):
    """All losses and accuracies of a replaced-token step per batch, with the generator that made the replacements."""
    rows = T.corrupted(spark, sf, judged=True).withColumn("batch_id", F.floor(F.col("mol_id") / T.BATCH_SIZE))
    long = K.positions_of(rows, ["batch_id"], _RTD | {"nll": "nll", "gen_hit": "hit"})
    scored = long.withColumn("disc_logit", T.stand_in_logit(F.col("disc_id"), F.col("pos")))
    out = losses.rtd_losses(scored, hit="hit", y="disc_label")
    return out.select("batch_id", *[F.round(c, 6).alias(c) for c in ("mlm_loss", "disc_loss", "disc_acc")], "gen_acc", F.round("loss", 4).alias("loss"))


_RTD = {
    "input_ids": "token_id",
    "masked": "masked",
    "mlm_labels": "mlm_label",
    "masked_input": "masked_id",
    "disc_input": "disc_id",
    "disc_labels": "disc_label",
}


@query(
    "non_pad_positions",
    f"""WITH {S.REPLACED} SELECT mol_id, CAST(pos AS INTEGER) AS pos, token_id, masked, mlm_label, masked_id, disc_id, disc_label
    FROM replaced WHERE token_id <> {PAD}""",
)
def non_pad_positions(spark, sf):
    """The long form of the training examples, without padding."""
    return K.non_pad_positions(K.positions_of(T.corrupted(spark, sf), ["mol_id"], _RTD))


# ---- runs -----------------------------------------------------------------------------------------------------------

# Names as epoch_metrics logs them; the SQL states each goal by itself.
_LOGGED = f"""{S.LOG}, logged AS (SELECT run, epoch, CASE split WHEN 'train' THEN 'train_' ELSE 'val_' END || name AS name, value FROM mlog)"""
_SCORED = f"""{_LOGGED}, signed AS (SELECT *, CASE WHEN name IN ('train_pearsonr', 'val_pearsonr', 'train_roc', 'val_roc',
    'train_precision', 'val_precision') THEN value ELSE -value END AS s,
  row_number() OVER (PARTITION BY run, name ORDER BY epoch) AS step FROM logged),
prior AS (SELECT *, max(s) OVER (PARTITION BY run, name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM signed),
best AS (SELECT run, epoch, name, value, step, s > coalesce(b, '-infinity'::DOUBLE) AS improved,
  abs(greatest(b, s)) AS best FROM prior)"""


def _log(spark, sf):
    prefix = F.when(F.col("split") == "train", "train").otherwise("val")
    return T.metric_log(spark, sf).select("run", "epoch", F.concat_ws("_", prefix, "name").alias("name"), "value")


@query("running_best", f"WITH {_SCORED} SELECT run, epoch, name, value, step, improved, best FROM best")
def running_best(spark, sf):
    return runs.running_best(_log(spark, sf), runs.METRIC_GOALS)


@query(
    "early_stop_epoch",
    f"""WITH {_SCORED}, waits AS (SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER (
      PARTITION BY run, name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS waited FROM best)
    SELECT run, name, min(epoch) FILTER (waited = {PATIENCE}) AS stop_epoch, max(epoch) AS last_epoch
    FROM waits GROUP BY run, name""",
)
def early_stop_epoch(spark, sf):
    return runs.early_stop_epoch(_log(spark, sf), PATIENCE, runs.METRIC_GOALS)


@query(
    "stream_early_stop",
    f"""WITH {_SCORED}, waits AS (SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER (
      PARTITION BY run, name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS waited FROM best)
    SELECT CAST(run AS VARCHAR) AS run, CAST(epoch AS BIGINT) AS epoch, name, value, step, improved, best, waited,
      CASE WHEN waited = {PATIENCE} THEN 'stop' ELSE 'epoch' END AS event FROM waits""",
)
def stream_early_stop(spark, sf):
    """The metric log as a stream of epochs, followed with state per run: best value, patience and the row at which a run stops."""
    log = stored(_log(spark, sf), "log")
    source, files = fresh_path(spark, "log-stream"), files_of_steps(log, 2, LOG_FILE_ROWS)
    middle = log.agg(F.percentile_approx("epoch", 0.5)).first()[0]
    for number, half in enumerate((F.col("epoch") <= middle, F.col("epoch") > middle)):
        append_step(log.filter(half), source, f"half-{number}", files)
    stream = stream_corpus(spark, f"{source}/*", log.schema, max_files_per_trigger=files)
    stateful.use_rocksdb(spark)
    followed = stateful.stream_early_stop(stream, PATIENCE, runs.METRIC_GOALS)
    return drain(followed, fresh_path(spark, "followed"), fresh_path(spark, "followed-state"))


@query(
    "best_trial",
    f"""WITH {_LOGGED}, t AS (SELECT 'all' AS dataset, run, name, arg_max(value, epoch) AS value FROM logged GROUP BY run, name),
    low AS (SELECT * FROM t WHERE name IN ('train_loss', 'val_loss', 'train_rmse', 'val_rmse')
            QUALIFY row_number() OVER (PARTITION BY name ORDER BY value, run) = 1),
    high AS (SELECT * FROM t WHERE name NOT IN (SELECT name FROM low)
             QUALIFY row_number() OVER (PARTITION BY name ORDER BY value DESC, run) = 1),
    sweep AS (SELECT 'sweep' AS dataset, run, name, value FROM t WHERE name = 'val_roc' ORDER BY value DESC, run LIMIT 1)
    SELECT dataset, name, run, value FROM low UNION ALL SELECT dataset, name, run, value FROM high
    UNION ALL SELECT dataset, name, run, value FROM sweep""",
)
def best_trial(spark, sf):
    """The best run of each metric, and of the one metric that a sweep declares with its goal."""
    last = _log(spark, sf).groupBy("run", "name").agg(F.max_by("value", "epoch").alias("value")).withColumn("dataset", F.lit("all"))
    sweep = runs.best_trial(last.withColumn("dataset", F.lit("sweep")), {"val_roc": "maximize"}, "val_roc")
    return runs.best_trial(last, runs.METRIC_GOALS).unionByName(sweep)


@query("unchanged_keys", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def unchanged_keys(spark, sf):
    before, after = T.snapshots(spark, sf)
    return runs.unchanged_keys(before, after, "c_custkey", "c_acctbal")


# ---- review ---------------------------------------------------------------------------------------------------------

_CUT = f"""{S.REPLACED}, cuts AS (SELECT mol_id, min(pos) FILTER (disc_id = {PAD}) AS cut FROM replaced GROUP BY mol_id),
kept AS (SELECT r.* FROM replaced r JOIN cuts USING (mol_id) WHERE pos < coalesce(cut, 1000000))"""


@query(
    "token_diff",
    f"WITH {_CUT} SELECT mol_id, CAST(pos AS INTEGER) AS pos, v.token, disc_id <> token_id AS changed FROM kept JOIN vocab v ON v.id = disc_id",
)
def token_diff(spark, sf):
    return review.token_diff(*T.corrupted_with_vocabulary(spark, sf), "mol_id")


# The discriminator is stood in for by its own input: a position counts as predicted when the mask hid it.
@query(
    "replacement_report",
    f"""WITH {_CUT} SELECT CASE WHEN masked AND disc_label = 1 THEN 'right' WHEN masked OR disc_label = 1 THEN 'wrong' END AS verdict,
    disc_id AS id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM kept GROUP BY ALL""",
)
def replacement_report(spark, sf):
    rows = T.corrupted(spark, sf).withColumn("disc_predictions", F.col("masked").cast("array<int>"))
    report = review.replacement_report(rows, "mol_id")
    return report.groupBy("verdict", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


def _first_batches(rows):
    """The batches that are looked at, taken before they are corrupted; written, since drawing and filling in both read them."""
    return stored(ordering.first_batches(rows, "mol_id", T.SEED, T.BATCH_SIZE, review.REVIEW_BATCHES), "first-batches")


@query(
    "sample_for_review",
    f"""WITH {S.REPLACED}, per AS (SELECT mol_id, string_agg(masked_id, ' ' ORDER BY pos) AS masked_input,
      string_agg(disc_id, ' ' ORDER BY pos) AS disc_input, string_agg(disc_label, ' ' ORDER BY pos) AS disc_labels
      FROM replaced GROUP BY mol_id),
    s AS (SELECT mol_id, row_number() OVER (ORDER BY {S.u(T.SEED, 'mol_id')}, mol_id) - 1 AS idx FROM mols),
    b AS (SELECT mol_id, idx // {T.BATCH_SIZE} AS batch_id FROM s),
    p AS (SELECT * FROM b WHERE batch_id < {review.REVIEW_BATCHES}
          QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY {S.u(T.SEED, 'batch_id', 'mol_id')}, mol_id) = 1)
    SELECT batch_id, mol_id, masked_input, disc_input, disc_labels FROM p JOIN per USING (mol_id)""",
)
def sample_for_review(spark, sf):
    """One training example of each of the first batches, whole."""
    rows = T.corrupted(spark, sf, chosen=_first_batches)
    columns = ["masked_input", "disc_input", "disc_labels"]
    return review.sample_for_review(rows, "mol_id", T.SEED).select("batch_id", "mol_id", *[shown(F.col(c)).alias(c) for c in columns])


@query(
    "review_diff",
    f"""WITH {_CUT}, s AS (SELECT mol_id, row_number() OVER (ORDER BY {S.u(T.SEED, 'mol_id')}, mol_id) - 1 AS idx FROM mols),
    b AS (SELECT mol_id, idx // {T.BATCH_SIZE} AS batch_id FROM s),
    p AS (SELECT * FROM b WHERE batch_id < {review.REVIEW_BATCHES}
          QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY {S.u(T.SEED, 'batch_id', 'mol_id')}, mol_id) = 1)
    SELECT mol_id, CAST(pos AS INTEGER) AS pos, v.token, disc_id <> token_id AS changed,
           CASE WHEN masked AND disc_label = 1 THEN 'right' WHEN masked OR disc_label = 1 THEN 'wrong' END AS verdict
    FROM kept JOIN p USING (mol_id) JOIN vocab v ON v.id = disc_id""",
)
def review_diff(spark, sf):
    """The sampled examples position by position: the token shown, whether it differs, and the verdict on it."""
    rows, vocab = T.corrupted_with_vocabulary(spark, sf, chosen=_first_batches)
    # A few rows, which both the verdicts and the tokens are made from.
    picked = stored(review.sample_for_review(rows, "mol_id", T.SEED), "picked").withColumn("disc_predictions", F.col("masked").cast("array<int>"))
    verdicts = review.replacement_report(picked, "mol_id").drop("id")
    return review.token_diff(picked, vocab, "mol_id").join(verdicts, ["mol_id", "pos"])
