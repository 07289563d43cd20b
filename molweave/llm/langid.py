"""Language identification with averaged hashed subword embeddings.

Every run of 2, 3 and 4 bytes of the folded text (A-Z lower-cased, bytes outside words as one blank each) is hashed to a row
of an embedding table; a text is the mean of its rows, and a linear softmax reads the language off it. Table and softmax are
trained by stochastic gradient descent in numpy on a bounded sample: windows of labelled documents, of many lengths, placed
by a hash. Since both maps are linear, the trained model is one table of class scores per bucket, and scoring a text is a
mean over all its subwords.

Calibration uses labelled windows that training did not see: a temperature that minimises their log loss, and for each
language the confidence below which only REJECT_SHARE of them fall (at most MAX_FLOOR). Whole texts below it are rejected.

Null texts and texts without a letter are ``und`` and rejected, with score 0. With no labelled row at all everything is ``und``.
Long texts are scored in parts of SEGMENT bytes, each subword in the part it begins in, which gives the mean of the whole text. An
empty table gives an empty one. Equal texts get equal answers, so ties and repeated rows do; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import key_hash, uniform
from molweave.llm.folds import bounded_sample, held_out
from molweave.llm.words import FOLD, pieces, text_bytes

UNKNOWN = "und"
BUCKET_BITS = 15
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
# Odd multipliers, one per length.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)

# Bounds of the sample: documents per language, characters per window.
SAMPLE_PER_LANGUAGE = 2000
WINDOW = 1000
EPOCHS = 6
MIN_STEPS = 1000
BATCH = 64
RATE = 0.5
CALIBRATION_SHARE = 0.2
REJECT_SHARE = 0.001
MAX_FLOOR = 0.4

_SPACED = np.where(FOLD == 0, 0x20, FOLD).astype(np.uint32)
# Bytes scored together.
SEGMENT = 1 << 20


def subwords(data: np.ndarray, offsets: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every subword that lies within one text and has a word byte; ordered by length, then place.

    Of a part of a long text only subwords that begin in its ``own`` first bytes count; the others begin in the next part.
    """
    b = _SPACED[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, buckets = [], []
    blank = b == 0x20
    for length, multiplier in zip(LENGTHS, MULTIPLIERS, strict=True):
        n = len(b) - length + 1
        if n <= 0:
            break
        gram = np.zeros(n, np.uint32)
        empty = np.ones(n, bool)
        for k in range(length):
            gram |= b[k : k + n] << np.uint32(8 * k)
            empty &= blank[k : k + n]
        kept = ~empty & (row[:n] == row[length - 1 :])
        if own is not None:
            kept[own:] = False
        rows.append(row[:n][kept])
        buckets.append((gram[kept] * np.uint32(multiplier)) >> np.uint32(32 - BUCKET_BITS))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def segments(offsets: np.ndarray):
    """(first row, last row + 1, first byte, last byte + 1) of bounded parts; parts of a long text overlap by 3 bytes."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[stop])
        if high - low <= SEGMENT:
            yield at, stop, low, high
        else:
            for part in range(low, high, SEGMENT):
                yield at, stop, part, min(high, part + SEGMENT + LENGTHS[-1] - 1)
        at = stop


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    floors: np.ndarray

    def means(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean class scores and number of subwords of each text."""
        data, offsets = text_bytes(column)
        total = np.zeros((len(column), len(self.languages)))
        n = np.zeros(len(column))
        for first, stop, low, high in segments(offsets):
            cuts = np.clip(offsets[first : stop + 1], low, high) - low
            row, bucket = subwords(data[low:high], cuts, SEGMENT)
            n[first:stop] += np.bincount(row, minlength=stop - first)
            for k in range(len(self.languages)):
                total[first:stop, k] += np.bincount(row, self.scores[:, k][bucket], stop - first)
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, confidence, rejected)"""
        means, _ = self.means(column)
        logits = (means + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        confidence = p[np.arange(len(best)), best]
        return best, confidence, confidence < self.floors[best]


def train(texts: list[str], labels: np.ndarray, classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(class scores per bucket, bias) by stochastic gradient descent on the embedding table and the softmax."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    encoded = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        encoded.append(np.unique(subwords(raw, np.array([0, len(raw)]))[1], return_counts=True))
    used = np.array([i for i, (bucket, _) in enumerate(encoded) if len(bucket)], np.int64)
    per_epoch = len(used) // BATCH + 1
    epochs = max(EPOCHS, -(-MIN_STEPS // per_epoch)) if len(used) else 0
    steps = max(1, epochs * per_epoch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(used)
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            bucket = np.concatenate([encoded[i][0] for i in chosen])
            share = np.concatenate([encoded[i][1] / encoded[i][1].sum() for i in chosen]).astype(np.float32)
            first = np.cumsum([0] + [len(encoded[i][0]) for i in chosen[:-1]])
            hidden = np.add.reduceat(table[bucket] * share[:, None], first, axis=0)
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            rate = RATE * (1 - step / steps)
            back = p @ softmax.T
            softmax -= rate * hidden.T @ p / len(chosen) * 8
            bias -= rate * p.mean(axis=0)
            sizes = [len(encoded[i][0]) for i in chosen]
            moved = np.repeat(back, sizes, axis=0) * share[:, None]
            np.subtract.at(table, bucket, rate * 8 * moved)
            step += 1
    return table @ softmax, bias


def windows(documents: DataFrame, seed: str) -> DataFrame:
    """(lang, window, calibration) of a bounded sample of labelled documents outside the held-out fold."""
    known = documents.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    chosen, _ = bounded_sample(known, "lang", "doc_id", SAMPLE_PER_LANGUAGE, seed)
    length = (F.pow(F.lit(2.0), uniform(seed + "-length", "doc_id") * 6) * WINDOW / 64).cast("int")
    room = F.greatest(F.char_length("text") - length, F.lit(0)) + 1
    start = F.pmod(key_hash(seed + "-start", "doc_id"), room.cast("bigint")).cast("int") + 1
    calibration = uniform(seed + "-calibration", "doc_id") < CALIBRATION_SHARE
    return chosen.select("lang", F.substring("text", start, length).alias("window"), calibration.alias("calibration"))


def fit(documents: DataFrame, seed: str = "langid") -> Model:
    rows = windows(documents, seed).toPandas().sort_values(["window", "lang"])
    languages = sorted(rows.lang.unique())
    if not languages:
        return Model([UNKNOWN], np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1), 1.0, np.zeros(1))
    label = rows.lang.map({x: i for i, x in enumerate(languages)}).to_numpy()
    apart = rows.calibration.to_numpy().astype(bool)
    if apart.all() or not apart.any():
        apart[:] = False
    texts = rows.window.tolist()
    scores, bias = train([t for t, c in zip(texts, apart, strict=True) if not c], label[~apart], len(languages))
    model = Model(languages, scores.astype(np.float32), bias, 1.0, np.zeros(len(languages)))
    held = np.flatnonzero(apart) if apart.any() else np.arange(len(texts))
    column, truth = pa.array([texts[i] for i in held]), label[held]
    means, _ = model.means(column)
    losses = []
    grid = np.geomspace(0.05, 2.0, 40)
    for temperature in grid:
        logits = (means + bias) / temperature
        logits -= logits.max(axis=1, keepdims=True)
        log_p = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        losses.append(-log_p[np.arange(len(truth)), truth].mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    best, confidence, _ = model.predict(column)
    for k in range(len(languages)):
        right = confidence[(best == k) & (truth == k)]
        if len(right):
            model.floors[k] = min(MAX_FLOOR, float(np.quantile(right, REJECT_SHARE, method="lower")))
    return model


def predict_languages(documents: DataFrame, model: Model) -> DataFrame:
    """(every column of documents..., held_out, lang_pred, score, rejected)"""
    names = documents.columns
    taken = {c.lower() for c in names}
    out = {k: k if k not in taken else f"_{k}" for k in ("held_out", "lang_pred", "score", "rejected")}

    def run(batches):
        for piece in pieces(batches, "text"):
            text = piece.column("text")
            best, confidence, rejected = model.predict(text)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            spoken = letters & (model.languages != [UNKNOWN])
            picked = np.where(spoken, np.array(model.languages, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns,
                    pa.array(picked, pa.string()),
                    pa.array(np.where(spoken, np.clip(confidence, 0, 1), 0.0)),
                    pa.array(rejected | ~spoken),
                ],
                names=[*piece.schema.names, out["lang_pred"], out["score"], out["rejected"]],
            )

    marked = documents.withColumn(out["held_out"], held_out())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    return marked.mapInArrow(run, f"{schema}, {out['lang_pred']} string, {out['score']} double, {out['rejected']} boolean")


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict_languages(rows, fit(documents)).drop("text")


def keep_known(documents: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    marked = predict_languages(documents, fit(documents))
    rejected = marked.columns[-1]
    return marked.filter(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in documents.columns])
