"""Toxicity by weak supervision.

1. Lexicons. On a bounded sample of labelled documents, words and word beginnings that occur almost only in toxic ones are
   mined. A feature counts by the different contexts (word before, word after) it stands in, so that copies of one text
   don't make its words look toxic. A short list of common insults is always among the lexicons.
2. Voters. Words and beginnings of like support form a voter each: it votes toxic where one of its features stands, and
   abstains elsewhere. Pattern voters look at how many features stand in the text and how densely; some vote clean.
3. Label model. Expectation maximisation estimates, for each voter and class, how often it votes either way; what remains
   correlated between voters within a class lowers their weights, and the estimation is run again. No labels enter, but for
   the share of toxic documents.
4. Classifier. Logistic regression on the logarithms of the voters' counts is fitted to the posteriors.

Scoring reads each whole text once, in numpy over Arrow batches. Nothing is shuffled but the sample.
Empty and null texts have no words and get the score of a document without any hit. Repeated rows are scored alike.
Long texts are read whole, in one piece of their own. With no labelled toxic document only the list of insults is used; an empty
table gives an empty one. Labels that are null or neither 0 nor 1 are not learned from; of several labels of a document the larger
counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.llm.folds import bounded_sample, held_out
from molweave.llm.words import Words, mix, pieces
from molweave.sources.scratch import stored

# Common insults.
INSULTS = [
    "bastard", "clown", "creep", "disgusting", "dumb", "filthy", "fool", "freak", "garbage", "hateful", "idiot", "imbecile",
    "jerk", "loser", "moron", "pathetic", "pig", "repulsive", "scum", "stupid", "trash", "ugly", "vermin", "vile", "worthless",
]
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

# Bounds of the labelled sample, per class. All mined features come from it, so their number is bounded with it.
SAMPLE_TOXIC = 4000
SAMPLE_CLEAN = 8000
MIN_DOCS = 2
MIN_CONTEXTS = 4
# Contexts that a feature of fewer than FEW_DOCS documents needs.
FEW_DOCS = 3
MANY_CONTEXTS = 8
MIN_PRECISION = 0.9
TIERS = 6


@dataclass
class Lexicon:
    """Sorted feature hashes, the voter of each, and a bit table that skips most other words."""

    keys: np.ndarray
    voter: np.ndarray
    voters: int

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.keys & np.uint64(0xFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, indices of the features found there)"""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFF)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]


def features_of(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; 0 where a word is no longer than the beginning."""
    return [words.hash, *(words.prefix[k] for k in PREFIXES)]


def insult_hashes() -> np.ndarray:
    return Words(pa.array(INSULTS)).hash


def counted_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, n): documents of a piece that hold a feature."""
    for piece in pieces(batches, "text"):
        words = Words(piece.column("text"), PREFIXES)
        toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        every = np.concatenate(features_of(words))
        row = np.tile(words.row, 1 + len(PREFIXES))
        used = every != 0
        pair = np.unique(np.rec.fromarrays([every[used], row[used]], names="f,r"))
        tagged = np.rec.fromarrays([pair["f"], toxic[pair["r"]]], names="f,y")
        found, n = np.unique(tagged, return_counts=True)
        yield pa.record_batch(
            [pa.array(found["f"].view(np.int64)), pa.array(found["y"]), pa.array(n.astype(np.int64))], names=["feature", "toxic", "n"]
        )


def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, context): the different neighbourhoods of each feature of a piece, by a hash of the words on both sides."""
    for piece in pieces(batches, "text"):
        words = Words(piece.column("text"), PREFIXES)
        around = np.zeros(len(words.hash), np.uint64)
        around[1:] += mix(words.hash[:-1])
        around[:-1] += words.hash[1:] >> np.uint64(1)
        for hashes in features_of(words):
            used = hashes != 0
            pair = np.unique(np.rec.fromarrays([hashes[used], around[used]], names="f,c"))
            yield pa.record_batch([pa.array(pair["f"].view(np.int64)), pa.array(pair["c"].view(np.int64))], names=["feature", "context"])


def mine(sample: DataFrame, shares: dict) -> list[tuple[int, int]]:
    """(feature, contexts) of all features of the sample that mark toxic documents and stand in enough different contexts."""
    weight = {y: 1.0 / shares.get(y, 1.0) for y in (0, 1)}
    counts = (
        sample.select("text", "toxic")
        .mapInArrow(counted_features, "feature long, toxic long, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("good"))
        .fillna(0)
    )
    weighted = F.col("bad") * weight[1]
    precise = weighted >= MIN_PRECISION * (weighted + F.col("good") * weight[0])
    marked = counts.filter((F.col("bad") >= MIN_DOCS) & precise).select("feature", "bad")
    around = sample.filter("toxic = 1").select("text").mapInArrow(contexts, "feature long, context long")
    support = around.join(marked, "feature").distinct().groupBy("feature", "bad").count()
    needed = F.when(F.col("bad") >= FEW_DOCS, MIN_CONTEXTS).otherwise(MANY_CONTEXTS)
    return [(r["feature"], r["count"]) for r in support.filter(F.col("count") >= needed).collect()]


def make_lexicon(mined: list[tuple[int, int]]) -> Lexicon:
    """Voter 0 holds the insults; the mined features go by support, four times as much for each tier, two voters a tier."""
    insults = insult_hashes()
    voter = dict.fromkeys(map(int, insults), 0)
    for feature, support in mined:
        tier = min(TIERS - 1, int(np.log2(support / MIN_CONTEXTS) / 2))
        voter.setdefault(feature % (1 << 64), 1 + 2 * tier + (feature & 1))
    keys = np.array(sorted(voter), np.uint64)
    return Lexicon(keys, np.array([voter[int(k)] for k in keys], np.int64), 1 + 2 * TIERS)


def hit_counts(words: Words, lexicon: Lexicon) -> np.ndarray:
    """Per row: hits of each lexicon voter, words that are hit, words."""
    hits = np.zeros((words.rows, lexicon.voters + 2))
    any_hit = np.zeros(len(words.hash), bool)
    for hashes in features_of(words):
        at, feature = lexicon.find(hashes)
        any_hit[at] = True
        np.add.at(hits, (words.row[at], lexicon.voter[feature]), 1)
    hits[:, -2] = np.bincount(words.row[any_hit], minlength=words.rows)
    hits[:, -1] = words.counts()
    return hits


def votes_of(hits: np.ndarray) -> np.ndarray:
    """Votes of every voter: 1 toxic, 0 clean, -1 abstains."""
    total, words = hits[:, -2], hits[:, -1]
    lexicons = np.where(hits[:, :-2] > 0, 1, -1)
    density = total / np.maximum(words, 1)
    patterns = np.stack(
        [
            np.where(total >= 2, 1, -1),
            np.where(total >= 4, 1, -1),
            np.where((total >= 2) & (density >= 0.005), 1, -1),
            np.where((hits[:, :-2] > 0).sum(axis=1) >= 3, 1, -1),
            np.where(total == 0, 0, -1),
            np.where((total <= 1) & (words >= 100), 0, -1),
            np.where(density < 0.001, 0, -1),
        ],
        axis=1,
    )
    return np.concatenate([lexicons, patterns], axis=1)


def inputs_of(hits: np.ndarray) -> np.ndarray:
    """Inputs of the classifier."""
    total, words = hits[:, -2:-1], hits[:, -1:]
    return np.concatenate([np.log1p(hits[:, :-1]), total > 0, 100 * total / np.maximum(words, 20), np.ones_like(total)], axis=1)


def independence(votes: np.ndarray, expected: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of each voter: 1 for one that errs by itself, 1 / n for each of n that always err together."""
    left = ((votes == 1) - expected) * np.sqrt(weight)[:, None]
    scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
    correlation = (left.T @ left) / scale[:, None] / scale[None, :]
    np.fill_diagonal(correlation, 0)
    return 1 / (1 + np.clip(correlation - 0.05, 0, None).sum(axis=1))


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, steps: int = 40, rounds: int = 3) -> np.ndarray:
    """Posterior of the toxic class for each row of votes.

    The first round weighs voters by how they go together at all, the later ones by what goes together within a class.
    """
    kinds = np.stack([votes == -1, votes == 0, votes == 1], axis=2).astype(float)
    strength = independence(votes, np.average(votes == 1, axis=0, weights=weight)[None, :], weight)
    for_it, against = (kinds[:, :, 2] * strength).sum(axis=1), (kinds[:, :, 1] * strength).sum(axis=1)
    posterior = (for_it + 2 * prior) / (for_it + against + 2)
    for _ in range(rounds):
        for _ in range(steps):
            rates = []
            for share in (1 - posterior, posterior):
                mass = (weight * share)[:, None, None]
                rates.append(((kinds * mass).sum(axis=0) + 0.1) / (mass.sum() + 0.3))
            logs = np.log(rates[1]) - np.log(rates[0])
            odds = np.log(prior) - np.log1p(-prior) + ((kinds * logs).sum(axis=2) * strength).sum(axis=1)
            posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        expected = (1 - posterior)[:, None] * rates[0][:, 2] + posterior[:, None] * rates[1][:, 2]
        strength = independence(votes, expected, weight)
    return posterior


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        hits = hit_counts(words, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(inputs_of(hits) @ self.beta, -30, 30))), hits[:, -2]


def fit(documents: DataFrame, labels: DataFrame, seed: str = "toxicity") -> Model:
    """Learn from the labelled documents outside the held-out fold, SAMPLE_CLEAN and SAMPLE_TOXIC of them at most."""
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    clean, clean_share = bounded_sample(known.filter("toxic = 0"), "toxic", "doc_id", SAMPLE_CLEAN, seed)
    toxic, toxic_share = bounded_sample(known.filter("toxic = 1"), "toxic", "doc_id", SAMPLE_TOXIC, seed)
    shares = clean_share | toxic_share
    # At most a few thousand small rows, by the two bounds.
    chosen = F.broadcast(clean.unionByName(toxic))
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").dropDuplicates()
    sample = stored(sample, "toxicity-sample")
    lexicon = make_lexicon(mine(sample, shares) if 1 in shares else [])

    def gather(batches):
        for piece in pieces(batches, "text"):
            hits = hit_counts(Words(piece.column("text"), PREFIXES), lexicon)
            flat = pa.array(hits.ravel())
            lists = pa.FixedSizeListArray.from_arrays(flat, hits.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([piece.column("toxic"), lists], names=["toxic", "hits"])

    rows = sample.mapInArrow(gather, "toxic long, hits array<double>").collect()
    if not rows:
        # Without a sample, texts without hits stand in for it.
        hits, known_toxic = np.zeros((200, lexicon.voters + 2)), np.zeros(200, int)
    else:
        hits, known_toxic = np.array([r.hits for r in rows]), np.array([r.toxic for r in rows])
    # One made-up row with one insult keeps the fit sound where no sampled document has any.
    hits = np.concatenate([hits, np.zeros((2, hits.shape[1]))])
    hits[-1, [0, -2, -1]] = 3, 3, 100
    weight = np.append(np.array([1 / shares.get(int(y), 1.0) for y in known_toxic]), [0.5, 0.5])
    prior = float(np.clip((weight[:-2] * known_toxic).sum() / weight.sum(), 0.005, 0.5))
    posterior = label_model(votes_of(hits), weight, prior)
    weight = weight * len(weight) / weight.sum()
    return Model(lexicon, fit_logistic(inputs_of(hits), posterior, weight))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of every document."""

    def run(batches):
        for piece in pieces(batches, "text"):
            score, hits = model.score(Words(piece.column("text"), PREFIXES))
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    piece.column("held_out"),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                    pa.array(hits.astype(np.int64)),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(documents, fit(documents, labels))
