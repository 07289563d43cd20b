"""Sources, tokens, vocabulary, order and batches."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from molweave.functions import ids as I
from molweave.functions.symbols import join_symbols, split_symbols, whitespace_tokens
from molweave.operators import metrics as M
from molweave.operators import ordering, vocab as V
from molweave.plans import inputs as T
from molweave.plans import sql as S
from molweave.plans.registry import query
from molweave.sources import corpus as C
from molweave.sources.scratch import fresh_path, stored
from molweave.streaming import jobs, stateful

SEED = T.SEED
BATCH = T.BATCH_SIZE
STEPS = 5


def shown(items: Column) -> Column:
    """An array as one string, so that results compare as plain values."""
    return F.array_join(items.cast("array<string>"), " ")


def _paths(spark, kind: str) -> tuple[str, str]:
    """Where a stream of a query keeps its rows and its state."""
    return fresh_path(spark, kind), fresh_path(spark, f"{kind}-state")


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query(
    "load_split",
    f"SELECT doc_id, lang, n_chars, split FROM (SELECT *, {S.split_case('doc_id')} AS split FROM documents) WHERE split = 'train'",
)
def load_split(spark, sf):
    return C.load_corpus(spark, f"{sf}/documents.parquet", "train", key="doc_id").select("doc_id", "lang", "n_chars", "split")


@query("stream_corpus", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def stream_corpus(spark, sf):
    schema = T.table(spark, sf, "documents").schema
    rows = C.stream_corpus(spark, f"{sf}/documents*.parquet", schema)
    return jobs.drain(rows, *_paths(spark, "corpus")).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("project_columns", f"WITH {S.MOLS} SELECT mol_id, selfies AS text, split FROM mols")
def project_columns(spark, sf):
    """The pretraining layout, projected to what encoding reads."""
    documents = T.table(spark, sf, "documents")
    raw = documents.select(
        F.col("doc_id").alias("PUBCHEM_COMPOUND_CID"),
        T.as_selfies(F.col("text")).alias("CAN_SELFIES"),
        F.col("text").alias("PUBCHEM_OPENEYE_CAN_SMILES"),
        C.split_of("doc_id").alias("split"),
    )
    return C.project(raw, "pubchem")


@query("map_batches", "SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n_symbols, upper(source) AS tag FROM documents")
def map_batches(spark, sf):
    rows = T.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return C.map_batches(
        rows,
        lambda b: {"n_symbols": b["text"].str.len(), "tag": b["source"].str.upper()},
        "n_symbols bigint, tag string",
        remove_columns=["text", "source"],
        batch_size=1000,
    )


@query("save_vocab", f"WITH {S.VOCAB} SELECT token, id, n FROM vocab")
def save_vocab(spark, sf):
    train = T.tokenized(spark, sf).filter("split = 'train'")
    return C.save_vocab(V.train_vocab(train), fresh_path(spark, "saved-vocab"))


_LOG_NAMES = list(T.METRIC_OF_EVENT.values())
_LOG_SPLITS = {"train": "train", "validation": "val"}
_LOG_CELLS = ", ".join(
    f"max(value) FILTER (split = '{s}' AND name = '{n}') AS {p}_{n}" for s, p in _LOG_SPLITS.items() for n in _LOG_NAMES
)


@query("log_metrics", f"WITH {S.LOG} SELECT run, epoch, {_LOG_CELLS} FROM mlog GROUP BY run, epoch")
def log_metrics(spark, sf):
    wide = C.log_metrics(T.metric_log(spark, sf), _LOG_NAMES, _LOG_SPLITS)
    path = fresh_path(spark, "metric-log")
    # The second write stands for a retried one, which leaves one record.
    for _ in range(2):
        C.append_metrics(wide, path, "all-runs")
    return C.read_metrics(wide, path)


# ---- tokens and vocabulary ------------------------------------------------------------------------------------------


@query("split_symbols", f"WITH {S.TOKS} SELECT mol_id, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, '') AS symbols FROM toks")
def split_symbols_query(spark, sf):
    rows = T.corpus(spark, sf).select("mol_id", split_symbols(F.col("selfies")).alias("t"))
    return rows.select("mol_id", F.size("t").alias("n"), F.array_join("t", "").alias("symbols"))


@query("join_symbols", f"WITH {S.TOKS} SELECT mol_id, array_to_string(tokens, ' ') AS tokenized FROM toks")
def join_symbols_query(spark, sf):
    return T.corpus(spark, sf).select("mol_id", join_symbols(split_symbols(F.col("selfies"))).alias("tokenized"))


_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(
    "whitespace_tokens",
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda t: t <> '') AS t FROM documents)
    SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS tokens FROM w""",
)
def whitespace_tokens_query(spark, sf):
    rows = T.table(spark, sf, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("train_vocab", f"WITH {S.VOCAB} SELECT token, id, n FROM vocab")
def train_vocab(spark, sf):
    return V.train_vocab(T.tokenized(spark, sf).filter("split = 'train'"))


@query("encode_ids", f"WITH {S.IDS} SELECT mol_id, {S.text_of('ids')} AS ids FROM ids")
def encode_ids(spark, sf):
    return T.encoded(spark, sf).select("mol_id", shown(F.col("ids")).alias("ids"))


@query("encode_ids_by_join", f"WITH {S.IDS} SELECT mol_id, {S.text_of('ids')} AS ids FROM ids")
def encode_ids_by_join(spark, sf):
    rows = V.encode_by_join(T.tokenized(spark, sf), T.vocabulary(spark, sf), "mol_id")
    return rows.select("mol_id", shown(F.col("ids")).alias("ids"))


@query("add_template", f"WITH {S.IDS} SELECT mol_id, {S.text_of('([1] || ids || [2])')} AS ids FROM ids")
def add_template(spark, sf):
    return T.encoded(spark, sf).select("mol_id", shown(I.add_template(F.col("ids"))).alias("ids"))


@query("truncate_ids", f"WITH {S.INPUTS} SELECT mol_id, CAST(len(f) AS INTEGER) AS n, {S.text_of('f')} AS ids FROM framed")
def truncate_ids(spark, sf):
    rows = T.encoded(spark, sf).select("mol_id", I.add_template(I.truncate(F.col("ids"))).alias("f"))
    return rows.select("mol_id", F.size("f").alias("n"), shown(F.col("f")).alias("ids"))


_ONES = S.padded("list_transform(f, lambda v: CAST(1 AS INTEGER))", 0)
_MASK_SQL = f"""SELECT mol_id, {S.text_of('input_ids')} AS input_ids, {S.text_of(_ONES)} AS attention_mask,
  {S.text_of('list_transform(input_ids, lambda v: 0)')} AS token_type_ids FROM inputs"""
_INPUT_COLUMNS = ["input_ids", "attention_mask", "token_type_ids"]


@query("pad_and_mask", f"WITH {S.INPUTS} {_MASK_SQL}")
def pad_and_mask(spark, sf):
    return T.inputs(spark, sf).select("mol_id", *[shown(F.col(c)).alias(c) for c in _INPUT_COLUMNS])


@query(
    "lm_labels",
    f"""WITH {S.INPUTS} SELECT mol_id,
    {S.text_of('list_transform(input_ids, lambda v: CASE WHEN v = 3 THEN -100 ELSE v END)')} AS labels FROM inputs""",
)
def lm_labels(spark, sf):
    return T.inputs(spark, sf).select("mol_id", shown(I.lm_labels(F.col("input_ids"))).alias("labels"))


_DECODED = f"""{S.INPUTS},
dec_long AS (SELECT mol_id, unnest(input_ids) AS id, generate_subscripts(input_ids, 1) - 1 AS pos FROM inputs),
dec_cut AS (SELECT mol_id, min(pos) FILTER (id = 3) AS cut FROM dec_long GROUP BY mol_id),
dec AS (SELECT d.mol_id, d.pos, v.token FROM dec_long d JOIN dec_cut c USING (mol_id) JOIN vocab v USING (id)
        WHERE d.pos < coalesce(c.cut, 1000000))"""


@query("decode_ids", f"WITH {_DECODED} SELECT mol_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM dec GROUP BY mol_id")
def decode_ids(spark, sf):
    vocab = T.vocabulary(spark, sf)
    return V.decode(T.inputs(spark, sf, vocab), vocab, "mol_id").select("mol_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "decode_positions",
    f"WITH {_DECODED} SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM dec GROUP BY token",
)
def decode_positions(spark, sf):
    """Where decoded tokens stand, from the long form of decoding."""
    vocab = T.vocabulary(spark, sf)
    long = V.decode_long(T.inputs(spark, sf, vocab), vocab, "mol_id")
    return long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@query(
    "length_profile",
    f"""WITH {S.TOKS} SELECT CAST(max(len(tokens)) AS INTEGER) AS longest, count(*) FILTER (len(tokens) > 512) AS n_over,
    round(avg(CAST(len(tokens) > 512 AS INTEGER)), 6) AS share_over, count(*) AS n_sequences FROM toks""",
)
def length_profile(spark, sf):
    return V.length_profile(T.tokenized(spark, sf)).withColumn("share_over", F.round("share_over", 6))


# ---- order and batches ----------------------------------------------------------------------------------------------

_SHUFFLED = f"""shuffled AS (SELECT doc_id, lang, md5(text) AS text_md5,
  row_number() OVER (ORDER BY {S.u(SEED, 'doc_id')}, doc_id) - 1 AS idx FROM documents)"""
_BATCHED = f"{_SHUFFLED}, batched AS (SELECT *, idx // {BATCH} AS batch_id FROM shuffled)"


def _documents(spark, sf):
    """Whole rows: the text is moved with its key, and only shown as a hash."""
    return T.table(spark, sf, "documents").select("doc_id", "lang", "text")


def _shuffled(spark, sf):
    return ordering.global_shuffle(_documents(spark, sf), "doc_id", SEED)


def _with_hash(rows, *columns):
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"), *columns)


@query("global_shuffle", f"WITH {_SHUFFLED} SELECT doc_id, lang, text_md5, idx FROM shuffled")
def global_shuffle(spark, sf):
    return _with_hash(_shuffled(spark, sf), "idx")


# The table comes as one row group, so one task reads all of it in file order; buffers smaller than it show several blocks.
SMALL_BUFFER = 150


def _buffered(order: str) -> str:
    return f"""WITH f AS (SELECT doc_id, lang, md5(text) AS text_md5, row_number() OVER () - 1 AS n FROM documents),
    b AS (SELECT *, n // {SMALL_BUFFER} AS block FROM f)
    SELECT doc_id, lang, text_md5, block, row_number() OVER (PARTITION BY block ORDER BY {order}, doc_id) - 1 AS place FROM b"""


@query("buffer_shuffle", _buffered(S.u(SEED, "doc_id")))
def buffer_shuffle(spark, sf):
    return _with_hash(ordering.buffer_shuffle(_documents(spark, sf), "doc_id", SEED, SMALL_BUFFER), "block", "place")


@query("assign_batches", f"WITH {_BATCHED} SELECT doc_id, lang, text_md5, idx, batch_id FROM batched")
def assign_batches(spark, sf):
    return _with_hash(ordering.assign_batches(_shuffled(spark, sf), BATCH), "idx", "batch_id")


@query("take_steps", f"WITH {_BATCHED} SELECT doc_id, lang, text_md5, idx, batch_id FROM batched WHERE batch_id < {STEPS}")
def take_steps(spark, sf):
    """The first steps of an epoch; the limit is the operator."""
    return _with_hash(ordering.first_batches(_documents(spark, sf), "doc_id", SEED, BATCH, STEPS), "idx", "batch_id")


@query(
    "row_keys",
    """WITH r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)
    SELECT lang, source, n AS n_rows, n AS n_keys FROM r""",
)
def row_keys(spark, sf):
    """Keys for rows without an id: as many as there are rows, equal rows included."""
    rows = ordering.with_row_key(T.table(spark, sf, "documents").select("lang", "source", "text"))
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_key").alias("n_keys"))


@query(
    "collate_batches",
    f"""WITH {S.INPUTS}, {_BATCHED}
    SELECT batch_id, CAST(count(*) AS INTEGER) AS n_rows, string_agg(doc_id, ' ' ORDER BY idx) AS mol_ids,
           md5(string_agg({S.text_of('input_ids')}, ' ' ORDER BY idx)) AS ids_md5
    FROM batched JOIN inputs ON doc_id = mol_id GROUP BY batch_id""",
)
def collate_batches(spark, sf):
    rows = ordering.global_shuffle(T.inputs(spark, sf).select("mol_id", "input_ids"), "mol_id", SEED, buckets=8, bucket_out="bucket")
    batches = ordering.collate_batches(ordering.assign_batches(rows, BATCH), "mol_id", "input_ids", batch_size=BATCH, bucket="bucket")
    return batches.select(
        "batch_id", "n_rows", shown(F.col("mol_id")).alias("mol_ids"), F.md5(shown(F.flatten("input_ids"))).alias("ids_md5")
    )


# ---- streams --------------------------------------------------------------------------------------------------------


def _document_stream(spark, sf):
    rows = C.stream_corpus(spark, f"{sf}/documents*.parquet", T.table(spark, sf, "documents").schema)
    return T.spread(rows.select("doc_id", "text"))


@query("stream_encode", f"WITH {S.INPUTS} {_MASK_SQL}")
def stream_encode(spark, sf):
    vocab = T.vocabulary(spark, sf)
    made = jobs.drain_through(
        T.molecules(_document_stream(spark, sf)), lambda rows: jobs.stream_encode(rows, vocab, key="mol_id"), *_paths(spark, "encoded")
    )
    return made.select("mol_id", *[shown(F.col(c)).alias(c) for c in _INPUT_COLUMNS])


@query(
    "stream_metrics",
    f"""WITH e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
      {S.split_case('event_id')} AS split, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pred, value AS target FROM events)
    SELECT epoch, split, count(*) AS n, round(sqrt(avg((pred - target) * (pred - target))), 6) AS rmse,
      round(avg(abs(pred - target)), 6) AS mae,
      round(covar_pop(pred, target) / nullif(stddev_pop(pred) * stddev_pop(target), 0), 6) AS pearsonr
    FROM e GROUP BY epoch, split""",
)
def stream_metrics(spark, sf):
    events = C.stream_corpus(spark, f"{sf}/events*.parquet", T.table(spark, sf, "events").schema)
    made = jobs.stream_metrics(T.event_predictions(events), *_paths(spark, "metrics"))
    return made.select("epoch", "split", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "pearsonr")])


@query(
    "stream_auroc",
    f"""WITH {S.PREDS}, b AS (SELECT split, floor(score * 1000 + 0.5) AS s, label FROM preds)
    SELECT split, round(roc, 6) AS roc FROM ({S.roc_rows('b', 'split', 's', 'label')})""",
)
def stream_auroc(spark, sf):
    lines = C.stream_corpus(spark, f"{sf}/lineitem*.parquet", T.table(spark, sf, "lineitem").schema)
    scored = lines.select(T.line_split().alias("split"), *T.line_scores())
    paths = _paths(spark, "scores")
    return jobs.stream_auroc(scored, *paths, 1000, "score", "label", ["split"]).select("split", F.round("roc", 6).alias("roc"))


@query("stream_limit", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id % 4 < 2")
def stream_limit(spark, sf):
    """Two micro-batches of a stream of four steps; a step is one file, or as many equal ones as its rows need."""
    documents = T.table(spark, sf, "documents").select("doc_id", "lang", "text")
    quarters = [documents.filter(F.col("doc_id") % 4 == part) for part in range(4)]
    return _with_hash(jobs.stream_limit(_in_steps(spark, documents, quarters), 2, *_paths(spark, "limited")))


def _in_steps(spark, rows, parts):
    """A stream of the parts of a table, one a micro-batch."""
    source, files = fresh_path(spark, "steps"), C.files_of_steps(rows, len(parts))
    for number, part in enumerate(parts):
        C.append_step(part, source, f"part-{number}", files)
    return C.stream_corpus(spark, f"{source}/*", rows.schema, max_files_per_trigger=files)


STREAM_SHARDS = 4


def _in_four_files(spark, sf):
    """The documents as a stream of four steps in the order of their ids, each about a quarter."""
    documents = _documents(spark, sf)
    edges = documents.agg(F.percentile_approx("doc_id", [0.25, 0.5, 0.75])).first()[0] or [0] * 3
    doc_id = F.col("doc_id")
    quarters = [doc_id <= edges[0], *[(doc_id > a) & (doc_id <= b) for a, b in zip(edges, edges[1:])], doc_id > edges[-1]]
    return _in_steps(spark, documents, [documents.filter(quarter) for quarter in quarters])


@query("stream_sliding_shuffle", "SELECT doc_id, lang, md5(text) AS text_md5, true AS moved FROM documents")
def stream_sliding_shuffle(spark, sf):
    """Every row once through buffers that live as long as the stream; moved: some row left its buffer in another micro-batch."""
    rows = stateful.drain_shuffled(_in_four_files(spark, sf), "doc_id", SEED, *_paths(spark, "sliding"), buffer=SMALL_BUFFER, shards=STREAM_SHARDS)
    rows = stored(rows, "slid")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1
    order = rows.select("shard", "turn", place.alias("place"))
    moved = order.agg((F.max(F.abs(F.col("turn") - F.col("place"))) > 2 * SMALL_BUFFER // STREAM_SHARDS).alias("moved")).scalar()
    return _with_hash(rows.withColumn("moved", moved), "moved")


@query(
    "stream_collate",
    f"""WITH s AS (SELECT doc_id, lang, {S.hash_of("shard", "doc_id")} % {STREAM_SHARDS} AS shard FROM documents),
    b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM s)
    SELECT CAST(shard AS INTEGER) AS shard, batch_id, CAST(count(*) AS INTEGER) AS n_rows, string_agg(doc_id, ' ' ORDER BY doc_id) AS doc_ids,
           string_agg(lang, ' ' ORDER BY doc_id) AS langs FROM b GROUP BY shard, batch_id""",
)
def stream_collate(spark, sf):
    """Batches assembled from a stream across micro-batches, the last of each shard short."""
    stream = _in_four_files(spark, sf).drop("text")
    made = stateful.drain_batches(stream, "doc_id", "doc_id", ["doc_id", "lang"], BATCH, *_paths(spark, "batches"), shards=STREAM_SHARDS)
    return made.select("shard", "batch_id", "n_rows", shown(F.col("doc_id")).alias("doc_ids"), shown(F.col("lang")).alias("langs"))


@query(
    "stream_auroc_sketch",
    f"""WITH {S.PREDS} SELECT split, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label <> 1) AS n_negative, true AS within
    FROM preds GROUP BY split""",
)
def stream_auroc_sketch(spark, sf):
    """Areas of a stream by sketches, each held against the exact one and the stated bound."""
    lines = C.stream_corpus(spark, f"{sf}/lineitem*.parquet", T.table(spark, sf, "lineitem").schema)
    columns = [T.line_split().alias("split"), *T.line_scores()]
    made = jobs.stream_auroc_sketch(lines.select(*columns), *_paths(spark, "sketches"), pred="score", target="label", by=["split"])
    exact = M.auroc(T.table(spark, sf, "lineitem").select(*columns), "score", "label", ["split"]).withColumnRenamed("roc", "exact")
    within = F.abs(F.col("roc") - F.col("exact")) <= jobs.sketch_bound()
    return made.join(exact, "split").select("split", "n_positive", "n_negative", within.alias("within"))


@query("stream_shuffle", _buffered(S.u(SEED, "doc_id")))
def stream_shuffle(spark, sf):
    rows = C.stream_corpus(spark, f"{sf}/documents*.parquet", T.table(spark, sf, "documents").schema).select("doc_id", "lang", "text")
    shuffled = jobs.stream_shuffle(rows, "doc_id", SEED, SMALL_BUFFER)
    return _with_hash(jobs.drain(shuffled, *_paths(spark, "shuffled")), "block", "place")


@query(
    "stream_corrupt",
    f"""WITH {S.REPLACED} SELECT mol_id, string_agg(disc_id, ' ' ORDER BY pos) AS disc_input,
    string_agg(disc_label, ' ' ORDER BY pos) AS disc_labels FROM replaced GROUP BY mol_id""",
)
def stream_corrupt(spark, sf):
    vocab = T.vocabulary(spark, sf)
    proposals = T.proposals(spark, sf, vocab)

    def corrupted(rows):
        encoded = jobs.stream_encode(rows, vocab, key="mol_id").select("mol_id", "input_ids")
        return jobs.stream_corrupt(encoded, proposals, "mol_id", SEED)

    made = jobs.drain_through(T.molecules(_document_stream(spark, sf)), corrupted, *_paths(spark, "corrupted"))
    return made.select("mol_id", *[shown(F.col(c)).alias(c) for c in ("disc_input", "disc_labels")])


@query(
    "stream_mask",
    f"""WITH {S.POSITIONS} SELECT mol_id, string_agg(mlm_label, ' ' ORDER BY pos) AS mlm_labels,
    string_agg(masked_id, ' ' ORDER BY pos) AS masked_input FROM masked GROUP BY mol_id""",
)
def stream_mask(spark, sf):
    vocab = T.vocabulary(spark, sf)

    def masked(rows):
        encoded = jobs.stream_encode(rows, vocab, key="mol_id").select("mol_id", "input_ids")
        return jobs.stream_mask(encoded, "mol_id", SEED)

    made = jobs.drain_through(T.molecules(_document_stream(spark, sf)), masked, *_paths(spark, "masked"))
    return made.select("mol_id", *[shown(F.col(c)).alias(c) for c in ("mlm_labels", "masked_input")])
