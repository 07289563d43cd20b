"""Scores of the backoff automaton against a dictionary model, whole texts against cut ones, and held-out texts."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molweave.llm import backoff
from molweave.llm.queries import table
from molweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def by_hand(documents):
    """(n_tokens, n_known, N, base, score) of each (doc_id, text) by plain counting."""
    grams = Counter()
    learned = [words_of(t) for i, t in documents if not is_held(i)]
    for words in learned:
        line = [0, *words, 1]
        grams.update((w,) for w in line)
        grams.update(zip(line, line[1:]))
        grams.update(zip(line, line[1:], line[2:]))
    tokens = sum(len(w) + 1 for w in learned)
    types = len({w for line in learned for w in line}) + (1 if learned else 0)
    m_two, m_three = backoff.WEIGHTS

    def p(*gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (tokens + types + 1)
        m = m_two if len(gram) == 2 else m_three
        return (grams[gram] + m * p(*gram[1:])) / (grams[gram[:-1]] + m)

    out = []
    for doc_id, text in documents:
        line = [0, *words_of(text), 1]
        base = sum(math.log10(p(w)) for w in line[1:])
        score = sum(math.log10(p(*line[max(0, k - 2) : k + 1])) for k in range(1, len(line)))
        known = sum(grams[(w,)] > 0 for w in line[1:])
        out.append((doc_id, is_held(doc_id), len(line) - 1, known, tokens, base, score))
    return out


def as_rows(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def same(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)


def test_packed_numbers():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (backoff.unpack_sorted(backoff.pack_sorted(keys), len(keys)) == keys).all()
    assert (backoff.unpack(backoff.pack(keys % np.uint64(5)), len(keys)) == keys % np.uint64(5)).all()


def test_tokens():
    texts = ["A b\tB", "", None, " \x00x Y ", "a", "\n"]
    tokens = backoff.Tokens(pa.array(texts))
    assert tokens.counts().tolist() == [3, 0, 0, 1, 1, 0]
    assert tokens.hash[1] == tokens.hash[2] and tokens.hash[0] == tokens.hash[4]


def test_edges(spark, edge_documents, no_documents):
    documents = [(r.doc_id, r.text) for r in edge_documents.collect()]
    same(as_rows(backoff.score_texts(edge_documents)), by_hand(documents))
    assert backoff.score_texts(no_documents).isEmpty()
    only_held = edge_documents.filter(backoff.held_out()).filter("doc_id <> 8")
    rows = as_rows(backoff.score_texts(only_held))
    assert rows and all(r[4:] == (0, 0.0, 0.0) and r[3] == 0 for r in rows)


def test_cut_texts_score_as_whole_ones(spark):
    draw = random.Random(5)
    documents = [(i, " ".join(draw.choice("a b c dd eee F") for _ in range(draw.choice([0, 1, 2, 3, 40, 1500])))) for i in range(60)]
    documents += [(60, " " * 500 + "x"), (61, "one" + " " * 300), (62, "w" * 400 + " v"), (63, "a " + "b" * 200 + " c d " + "e" * 150)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    wanted = by_hand(documents)
    same(as_rows(backoff.score_texts(df, limit=100)), wanted)
    same(as_rows(backoff.score_texts(df)), wanted)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(backoff, "layout", lambda sizes: (7, 4))
    draw = random.Random(6)
    documents = [(i % 50, " ".join(draw.choice("abcdefgh") for _ in range(30))) for i in range(90)]
    same(as_rows(backoff.score_texts(spark.createDataFrame(documents, "doc_id long, text string"))), by_hand(documents))


def test_layout_grows_by_the_root():
    small, large = backoff.layout({"n_bytes": 10**9}), backoff.layout({"n_bytes": 10**14})
    assert small == (239, 8) and 10**6 < large[0] < 2 * 10**6 and 19 <= large[1] <= 22
    assert backoff.layout({"n_bytes": 0}) == (1, 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_whole_table(spark):
    documents = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = as_rows(QUERIES["op12_lm_scoring"](spark, SF))
    same(got, by_hand(documents))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(9)]
    texts = [" ".join(draw.choice(vocabulary[:6], 40)) for _ in range(20)]
    for context in ("w1 w2", "w1", "w8 w1", "w8 w8"):
        ends = [f"{context} {w}" for w in vocabulary]
        rows = pa.table(
            {
                "text": texts + ends,
                "begins": [True] * 29,
                "ends": [True] * 20 + [False] * 9,
                "lead": pa.array([0] * 29, pa.int32()),
                "held_out": [False] * 20 + [True] * 9,
            }
        )
        lines = backoff.Lines(rows)
        sizes = {"train_tokens": 41 * 20, "train_types": 7}
        weights = backoff.Automaton(lines, lines.train, sizes).read(lines)
        last = 10 ** weights[lines.end[20:] - 1]
        unknown = last[6]
        assert np.allclose(last[6:], unknown)
        closing = pa.table({k: v[20:21] for k, v in zip(rows.column_names, rows.columns)})
        closing = closing.set_column(0, "text", [[context]]).set_column(2, "ends", [[True]])
        both = pa.concat_tables([rows.slice(0, 20), closing])
        lines = backoff.Lines(both)
        end = 10 ** backoff.Automaton(lines, lines.train, sizes).read(lines)[-1]
        assert abs(last[:6].sum() + end + unknown - 1) < 1e-12


def test_texts_are_shuffled_once(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.col("id") % 7).alias("text"))
    scored = backoff.score_texts(df)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Reused" in plan
