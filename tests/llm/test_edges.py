"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molweave.llm import chosen_path, collision, exact, langid, lengths, licenses, mixing, packing, pages, toxicity
from tests.llm.conftest import LONG

OWN = "doc_id text lang source score held_out size key node root part run words rate copies".split()


def by_row(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=str)


def test_toxicity(edge_documents, edge_labels, no_documents):
    rows = toxicity.toxicity(edge_documents, edge_labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.toxicity(edge_documents, edge_labels.limit(0)).filter("predicted = 1").isEmpty()
    assert toxicity.toxicity(no_documents, edge_labels).isEmpty()


def test_licenses(edge_documents, no_documents):
    rows = licenses.scan(edge_documents).collect()
    assert len(rows) == 14
    assert [r.n_words for r in rows if r.doc_id in (4, 5, 6)] == [0, 0, 0]
    assert [r.n_words for r in rows if r.doc_id == 8] == [160_000]
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in rows)
    assert licenses.scan(no_documents).isEmpty()


def test_exact_groups_whose_hash_collides_at_an_edge(spark, monkeypatch):
    """All texts share one hash, so parts are cut by preference alone and each text alternates between all of them."""
    rows = [(i, 0, ["one", "two", "three", "four", " o ne"][i % 5] + " " * (i % 3)) for i in range(400)]

    def colliding(documents):
        norm = exact.normalised(F.col("text"))
        placed = documents.select("doc_id", "row_no", norm.alias("norm"), (-F.char_length("text")).alias("s"), F.lit(7).cast("long").alias("hash"))
        placed = placed.repartitionByRange(4, "hash", "s", "doc_id").sortWithinPartitions("hash", "norm", "s", "doc_id")
        return placed.select("doc_id", "row_no", "norm", "hash")

    monkeypatch.setattr(exact, "content_sorted", colliding)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, x int, text string")).collect()}
    groups = {}
    for i, _, text in rows:
        groups.setdefault("".join(text.split()), []).append((-len(text), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    assert got == want


def test_exact(edge_documents, no_documents):
    rows = exact.exact_dedup(edge_documents).collect()
    assert len(rows) == 14 and sum(r.kept for r in rows) == 8
    same = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {(r.keep_id, r.group_size) for r in same} == {(2, 4)} and sum(r.kept for r in same) == 1
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 4 and {(r.keep_id, r.group_size) for r in blank} == {(6, 4)}
    assert exact.exact_dedup(no_documents).isEmpty()
    kept = exact.keep_first(edge_documents)
    assert kept.columns == OWN and kept.count() == 8


def test_langid(edge_documents, no_documents):
    rows = langid.detect(edge_documents).collect()
    assert len(rows) == 14
    for r in rows:
        if r.doc_id in (4, 5, 6, 7):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1
    assert langid.detect(no_documents).isEmpty()
    assert {r.lang_pred for r in langid.detect(edge_documents.withColumn("lang", edge_documents.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}
    kept = langid.keep_known(edge_documents)
    assert kept.columns == OWN and kept.filter("doc_id IN (4, 5, 6, 7)").isEmpty() and not kept.filter("doc_id = 8").isEmpty()


def test_mixing(edge_documents, no_documents):
    rows = mixing.mix(edge_documents).collect()
    assert len(rows) == 14
    assert all(r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size for r in rows)
    assert {r.source_size for r in rows if r.doc_id in (7, 8)} == {160_003}
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mix(no_documents).isEmpty()
    copies = mixing.emit(edge_documents)
    assert copies.columns == OWN
    assert copies.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0] == sum(r.taken for r in rows)
    no_words = edge_documents.filter("doc_id IN (4, 5, 6)")
    assert {(r.target, r.taken) for r in mixing.mix(no_words).collect()} == {(0.0, 0)}


def test_packing(edge_documents, no_documents):
    rows = packing.pack(edge_documents).collect()
    assert len([r for r in rows if r.doc_id in (4, 5)]) == 2
    assert {(r.length, r.start) for r in rows if r.doc_id in (4, 5)} == {(1, 0)}
    long = sorted((r for r in rows if r.doc_id == 8), key=lambda r: r.piece)
    assert all(r.length == 2048 for r in long[1:]) and long[-1].start + 2048 == sum(r.length for r in long)
    assert packing.pack(no_documents).isEmpty()


def test_lengths(edge_documents, no_documents):
    rows = lengths.token_counts(edge_documents).collect()
    assert sum(r.n_docs for r in rows) == 14 and [r.n_docs for r in rows if r.n_tokens == 0] == [3]
    assert lengths.token_counts(no_documents).isEmpty()


def test_jaccard(edge_documents, no_documents):
    rows = chosen_path.jaccard_join(edge_documents).collect()
    assert len(rows) == 14
    assert {(r.class_id, r.n_copies) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 4)}
    assert {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows if r.doc_id in (4, 5, 6)} == {(i, i, 0, 1) for i in (4, 5, 6)}
    assert chosen_path.jaccard_join(no_documents).isEmpty()
    kept = chosen_path.keep_representatives(edge_documents)
    assert kept.columns == OWN and by_row(kept.filter("doc_id < 4"), "doc_id") == [[1]] and kept.count() == 11


def test_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://h/x", "<p>a"), (3, "http://h/y", LONG), (3, "http://h/y", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'h' AS host", "1 AS removed")
    got = pages.main_text(df).collect()
    assert sorted(map(str, ((r.page_id, r.n_chars) for r in got))) == sorted(map(str, ((1, 0), (2, 0), (None, 1), (3, len(LONG) - 1), (3, len(LONG) - 1))))
    assert pages.main_text(df.limit(0)).isEmpty()


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0])]
    rows += [(7, [0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "2 AS v", "3 AS rank")
    got = collision.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    near = {q: [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert near == {0: [(1, 1), (2, 9), (3, 9), (4, 50), (5, 2)], 50: [(1, 0), (2, 1), (3, 2), (4, 9), (5, 9)]}
    assert collision.nearest(df.limit(0), df.limit(0)).isEmpty()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, edge_documents, no_documents, name, stage):
    out = stage(spark, edge_documents, "/nowhere")
    assert out.count() > 0 and stage(spark, no_documents, "/nowhere").isEmpty()
    if name != "pack":
        assert out.columns == OWN


def test_no_operator_swallows_import_errors():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"ImportError", source)


def test_components_of_odd_links(spark):
    from molweave.llm import components

    links = spark.createDataFrame([(5, 3), (5, 3), (3, 3), (9, 5), (None, 1), (2, None), (8, 7)], "a long, b long").selectExpr("*", "1 AS root")
    got = {(r.node, r.root) for r in components.components(links).collect()}
    assert got == {(5, 3), (9, 3), (8, 7)}
    assert components.components(links.limit(0)).isEmpty()
