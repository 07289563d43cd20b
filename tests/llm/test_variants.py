"""Spelling variants against brute force on words, blocks and the whole table."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from molweave.llm import variants
from molweave.llm.queries import table
from molweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def counted(documents):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, alphabet):
    for k in range(len(word) + 1):
        for c in alphabet:
            yield word[:k] + c + word[k:]
            if k < len(word):
                yield word[:k] + c + word[k + 1 :]
        if k < len(word):
            yield word[:k] + word[k + 1 :]


def by_hand(counts):
    alphabet = sorted(set("".join(counts)))
    rows = {}
    for word, n in counts.items():
        near = {w for w in edits(word, alphabet) if w in counts and w != word}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        rows[word] = [n, len(near), form, counts.get(form)]
    for word, row in rows.items():
        root = word
        while rows[root][2] is not None:
            root = rows[root][2]
        row.append(root)
    return {w: tuple(r[:5]) for w, r in rows.items()}


def as_rows(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def some_words(seed, n, alphabet="abécd", least=6, most=11):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(alphabet) for _ in range(draw.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_block_finds_all_words_at_one_error(seed):
    words = some_words(seed, 700, "abc" if seed % 2 else "abécdÿ")
    asked = words[::2] + ["zzzzzz", "abzcba"]
    halves = np.array([len(w) // 2 for w in asked])
    which, met = variants.Block(words).near(asked, halves)
    got = {(asked[a], words[b]) for a, b in zip(which, met)}
    alphabet = sorted(set("".join(words)))
    known = set(words)
    wanted = {(w, v) for w in asked for v in edits(w, alphabet) if v in known and v != w and v[: len(w) // 2] == w[: len(w) // 2]}
    assert got == wanted and len(which) == len(got)


def test_block_of_one_word():
    block = variants.Block(["abcdef"])
    assert [list(x) for x in block.near(["abcdef", "abcdeg", "abcdefg", "abcde", "xbcdef"], np.array([3, 3, 3, 2, 3]))] == [[1, 2, 3], [0, 0, 0]]


def test_edges(spark, edge_documents, no_documents):
    extra = [(n, "Straße " * 5 + "strasse straÿe" * n, None, "x") for n in range(20, 26)]
    more = edge_documents.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    documents = [(r.doc_id, r.text) for r in more.collect()]
    assert as_rows(variants.spelling_forms(more)) == by_hand(counted(documents))
    assert as_rows(variants.spelling_forms(edge_documents)) == by_hand(counted([(r.doc_id, r.text) for r in edge_documents.collect()]))
    assert variants.spelling_forms(no_documents).isEmpty()


def test_chains_ties_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_WORDS", 16)
    words = some_words(9, 400, "abc", 6, 9)
    draw = random.Random(2)
    counts = {w: draw.choice([5, 5, 5, 26, 131, 700]) for w in words}
    documents = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    wanted = by_hand(counted(documents))
    assert as_rows(variants.spelling_forms(df)) == wanted
    assert any(r[2] is not None and r[4] != r[2] for r in wanted.values())


def test_number_of_blocks_is_bounded():
    for n in (0, 1, 10**5, 10**7, 10**9):
        assert -(-n // variants.block_words(n)) <= variants.BLOCKS


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_whole_table(spark):
    documents = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert as_rows(QUERIES["op11_spelling_variants"](spark, SF)) == by_hand(counted(documents))
