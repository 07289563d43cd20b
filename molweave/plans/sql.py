"""SQL fragments shared by the oracle texts: the same inputs as ``inputs``, as common table expressions."""

from __future__ import annotations

from molweave.functions.hashing import MASK32, MIX_MULTIPLIER, STEP_MULTIPLIER
from molweave.functions.ids import IGNORE_LABEL, MASK, MAX_LENGTH, PAD, SPECIAL_TOKENS
from molweave.functions.symbols import SYMBOL_PATTERN
from molweave.operators.corrupt import MASK_PROB, WEIGHT_ONE
from molweave.plans.inputs import BATCH_SIZE, METRIC_OF_EVENT, SEED, VECTOR_WIDTH
from molweave.sources.corpus import SPLIT_SEED


def hash_of(seed, *columns: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 13) AS BIGINT)"


def u(seed, *columns: str) -> str:
    return f"({hash_of(seed, *columns)} / CAST({1 << 52} AS DOUBLE))"


def split_case(key: str) -> str:
    draw = u(SPLIT_SEED, key)
    return f"CASE WHEN {draw} < 0.8 THEN 'train' WHEN {draw} < 0.9 THEN 'validation' ELSE 'test' END"


def mixed(name: str, source: str, state: str, position: str, out: str) -> str:
    """CTEs adding the 32-bit state of a position, one arithmetic step each."""
    step = f"SELECT * REPLACE ((xor(x, x >> 16) * {MIX_MULTIPLIER}) & {MASK32} AS x) FROM"
    start = f"xor(({state}) & {MASK32}, (CAST({position} AS BIGINT) * {STEP_MULTIPLIER}) & {MASK32})"
    late = f"(SELECT * REPLACE (xor(x, ({state}) >> 32) AS x) FROM {name}_1)"
    return (
        f"{name}_0 AS (SELECT *, {start} AS x FROM {source}), "
        f"{name}_1 AS ({step} {name}_0), {name}_2 AS ({step} {late}), "
        f"{name} AS (SELECT * EXCLUDE (x), xor(x, x >> 16) AS {out} FROM {name}_2)"
    )


def lse(logits: str) -> str:
    return f"(list_max({logits}) + ln(list_sum(list_transform({logits}, lambda v: exp(v - list_max({logits}))))))"


def bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0.0) - {x} * {y} + ln(1 + exp(-abs({x}))))"


def text_of(items: str) -> str:
    return f"array_to_string({items}, ' ')"


def padded(items: str, fill: int, length: int = MAX_LENGTH) -> str:
    return f"({items} || list_transform(range({length} - len({items})), lambda v: CAST({fill} AS INTEGER)))"


MOLS = rf"""mols AS (
  SELECT doc_id AS mol_id, {split_case('doc_id')} AS split,
         regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}.]+', ' ', 'g'),
                                       '(\p{{L}}+)', '[\1]', 'g'), ' ', '', 'g') AS selfies
  FROM documents)"""

TOKS = rf"""{MOLS},
toks AS (SELECT mol_id, split, regexp_extract_all(selfies, '{SYMBOL_PATTERN}') AS tokens FROM mols),
tok_long AS (SELECT mol_id, split, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM toks)"""

_SPECIALS = ", ".join(f"('{t}', {i}, 0)" for i, t in enumerate(SPECIAL_TOKENS))
_SPECIAL_NAMES = ", ".join(f"'{t}'" for t in SPECIAL_TOKENS)
VOCAB = f"""{TOKS},
counted AS (SELECT token, count(*) AS n FROM tok_long
            WHERE split = 'train' AND token NOT IN ({_SPECIAL_NAMES}) GROUP BY token),
vocab AS (SELECT token, CAST(id AS INTEGER) AS id, CAST(n AS BIGINT) AS n FROM (VALUES {_SPECIALS}) s(token, id, n)
          UNION ALL
          SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + {len(SPECIAL_TOKENS) - 1} AS INTEGER), n
          FROM counted)"""

IDS = f"""{VOCAB},
ids_long AS (SELECT l.mol_id, l.pos, coalesce(v.id, 0) AS id FROM tok_long l LEFT JOIN vocab v USING (token)),
ids_grouped AS (SELECT mol_id, list(id ORDER BY pos) AS ids FROM ids_long GROUP BY mol_id),
ids AS (SELECT t.mol_id, t.split, coalesce(g.ids, CAST([] AS INTEGER[])) AS ids
        FROM toks t LEFT JOIN ids_grouped g USING (mol_id))"""

INPUTS = f"""{IDS},
framed AS (SELECT mol_id, split, [1] || ids[1:{MAX_LENGTH - 2}] || [2] AS f FROM ids),
inputs AS (SELECT mol_id, split, f, {padded('f', PAD)} AS input_ids FROM framed)"""

POSITIONS = f"""{INPUTS},
pos_0 AS (SELECT mol_id, {hash_of(f'{SEED}:mask', 'mol_id')} AS ms, {hash_of(f'{SEED}:sample', 'mol_id')} AS ss,
                 unnest(input_ids) AS token_id, generate_subscripts(input_ids, 1) - 1 AS pos FROM inputs),
{mixed('pos_1', 'pos_0', 'ms', 'pos', 'mx')},
positions AS (SELECT mol_id, pos, token_id, ss,
                     token_id <> {PAD} AND mx / CAST({1 << 32} AS DOUBLE) < {MASK_PROB} AS masked FROM pos_1),
masked AS (SELECT mol_id, pos, token_id, ss, masked,
                  CASE WHEN masked THEN token_id ELSE {IGNORE_LABEL} END AS mlm_label,
                  CASE WHEN masked THEN {MASK} ELSE token_id END AS masked_id FROM positions)"""

GRAM_COUNTS = """gram_long AS (SELECT mol_id, unnest([1] || ids || [2]) AS token,
                     generate_subscripts([1] || ids || [2], 1) AS pos FROM ids WHERE split = 'train'),
gram_pairs AS (SELECT lag(token) OVER (PARTITION BY mol_id ORDER BY pos) AS prev, token FROM gram_long),
gram_counts AS (SELECT prev, token, count(*) AS n FROM gram_pairs WHERE prev IS NOT NULL GROUP BY prev, token),
gram_all AS MATERIALIZED (SELECT prev, token, n FROM gram_counts
             UNION ALL SELECT -1, token, CAST(sum(n) AS BIGINT) FROM gram_counts GROUP BY token)"""

NGRAMS = f"""{GRAM_COUNTS},
cands AS (SELECT prev, CAST(row_number() OVER w AS INTEGER) AS rank, token, n,
                 ln(n) - ln(sum(n) OVER (PARTITION BY prev)) AS log_p
          FROM gram_all WINDOW w AS (PARTITION BY prev ORDER BY n DESC, token))"""


def replaced(temperature: float = 1.0) -> str:
    """CTEs of the replaced sequences: each draw meets the last follower whose weights before it the draw reaches."""
    share = f"pow(n / CAST(max(n) OVER (PARTITION BY prev) AS DOUBLE), CAST({1 / temperature} AS DOUBLE))"
    weight = "n" if temperature == 1 else f"greatest(CAST(floor({share} * {WEIGHT_ONE}) AS BIGINT), 1)"
    return f"""{POSITIONS},
{GRAM_COUNTS},
weighed AS (SELECT prev, token, {weight} AS w FROM gram_all),
spans AS MATERIALIZED (SELECT prev, token, CAST(sum(w) OVER (PARTITION BY prev ORDER BY w DESC, token) - w AS BIGINT) AS low,
                 CAST(sum(w) OVER (PARTITION BY prev) AS BIGINT) AS total FROM weighed),
totals AS MATERIALIZED (SELECT DISTINCT prev, total FROM spans),
seen AS (SELECT mol_id, pos, ss, masked, lag(masked_id) OVER (PARTITION BY mol_id ORDER BY pos) AS prev FROM masked),
asked AS MATERIALIZED (SELECT mol_id, pos, ss, CASE WHEN prev IN (SELECT c.prev FROM totals c) THEN prev ELSE -1 END AS prev
          FROM seen WHERE masked),
{mixed('asked_mix', 'asked', 'ss', 'pos', 'ps')},
{mixed('high_mix', 'asked_mix', 'ps', '0', 'hi')},
{mixed('low_mix', 'high_mix', 'ps', '1', 'lo')},
drawn AS (SELECT mol_id, pos, prev, ((hi << 20) + (lo >> 12)) / CAST({1 << 52} AS DOUBLE) AS u FROM low_mix),
aimed AS MATERIALIZED (SELECT mol_id, pos, prev, CAST(floor(u * total) AS BIGINT) AS target FROM drawn JOIN totals USING (prev)),
picked AS (SELECT a.mol_id, a.pos, s.token FROM aimed a ASOF JOIN spans s ON a.prev = s.prev AND a.target >= s.low),
replaced AS MATERIALIZED (SELECT m.mol_id, m.pos, m.token_id, m.masked, m.mlm_label, m.masked_id,
                    coalesce(p.token, m.token_id) AS disc_id,
                    CAST(coalesce(p.token, m.token_id) <> m.token_id AS INTEGER) AS disc_label
             FROM masked m LEFT JOIN picked p USING (mol_id, pos))"""


REPLACED = replaced()

# Loss and hit of each masked position under the smoothed counts; to go after REPLACED.
GENERATOR = """sized AS (SELECT prev, CAST(sum(n) AS BIGINT) AS total, arg_min(token, (-n, token)) AS best FROM gram_all GROUP BY prev),
whole AS (SELECT sum(n) AS n, count(*) AS k FROM gram_all WHERE prev = -1),
judged AS (SELECT a.mol_id, a.pos, m.token_id = z.best AS hit,
    -ln(CASE WHEN a.prev = -1 THEN (coalesce(o.n, 0) + 1) / CAST(w.n + w.k + 1 AS DOUBLE)
        ELSE (coalesce(g.n, 0) + (coalesce(o.n, 0) + 1) / CAST(w.n + w.k + 1 AS DOUBLE)) / CAST(z.total + 1 AS DOUBLE) END) AS nll
  FROM asked a JOIN masked m USING (mol_id, pos) JOIN sized z ON z.prev = a.prev CROSS JOIN whole w
  LEFT JOIN gram_all g ON g.prev = a.prev AND g.token = m.token_id LEFT JOIN gram_all o ON o.prev = -1 AND o.token = m.token_id)"""

# The discriminator stand-in of inputs.stand_in_logit.
DISC_LOGIT = "((r.disc_id * 7 + r.pos * 3) % 11 - 5) / 2.0"


def strided(outputs: int, order: int = 1) -> str:
    """Sums of every ``outputs``-th element, as an array."""
    cells = [" + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(k, VECTOR_WIDTH, outputs)) for k in range(outputs)]
    return f"[{', '.join(cells[::order])}]"


HEADS = f"""heads AS (SELECT vec_id, label, vec_id // {BATCH_SIZE} AS batch_id,
  {strided(10)} AS logits, {strided(2)} AS binary_logits,
  CAST(label < 5 AS INTEGER) AS binary_target,
  CASE WHEN {u('keep', 'vec_id')} < 0.85 THEN label ELSE -100 END AS mlm_label,
  {strided(3)} AS multi_logits,
  [label % 2, CAST(label % 3 = 0 AS INTEGER), CAST(label < 5 AS INTEGER)] AS multi_targets,
  {strided(10, -1)} AS soft_logits FROM embeddings)"""

HEAD_POSITIONS = f"""hp_0 AS (SELECT vec_id, label, vec_id // {BATCH_SIZE} AS batch_id,
  {hash_of(f'{SEED}:mask', 'vec_id')} AS m, {hash_of(f'{SEED}:sample', 'vec_id')} AS s,
  unnest(CAST(embedding AS DOUBLE[])) AS disc_logit, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
{mixed('hp_1', 'hp_0', 'm', 'pos', 'mx')}, {mixed('hp_2', 'hp_1', 's', 'pos', 'sx')},
hp_3 AS (SELECT *, CASE WHEN pos >= 6 * (label + 1) THEN {PAD} ELSE pos + 5 END AS token_id FROM hp_2),
hp_4 AS (SELECT *, token_id <> {PAD} AND mx / CAST({1 << 32} AS DOUBLE) < 0.15 AS masked FROM hp_3),
hp AS (SELECT vec_id, batch_id, pos, token_id, masked, disc_logit,
  CAST(masked AND sx / CAST({1 << 32} AS DOUBLE) < 0.8 AS INTEGER) AS disc_label,
  CASE WHEN masked THEN abs(disc_logit) * 10 END AS nll FROM hp_4)"""

PREDS = """preds AS (SELECT l_returnflag AS run, l_linenumber AS epoch,
  CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'validation' END AS split, l_orderkey AS batch_id,
  l_quantity * 1500 AS pred, l_extendedprice AS target,
  (l_quantity * 1500 - l_extendedprice) * (l_quantity * 1500 - l_extendedprice) AS loss,
  l_discount * 10 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""

_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF_EVENT.items())
LOG = f"""mlog AS (SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
  CASE WHEN hour(ts) < 12 THEN 'train' ELSE 'validation' END AS split, CASE event_type {_NAMES} END AS name,
  max(value) AS value FROM events GROUP BY ALL)"""


def roc_rows(source: str, by: str, score: str, target: str) -> str:
    """Rank-sum form of the area per group."""
    return f"""SELECT {by}, (sum(r) FILTER (y = 1) - max(p) * (max(p) + 1) / 2) / nullif(max(p) * (count(*) - max(p)), 0) AS roc
  FROM (SELECT {by}, {target} AS y, sum({target}) OVER (PARTITION BY {by}) AS p,
               rank() OVER (PARTITION BY {by} ORDER BY {score})
               + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {source}) GROUP BY {by}"""
