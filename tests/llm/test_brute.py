"""Operators against brute force, exact round trips and bounds."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from molweave.llm import chosen_path, collision, components, lengths, licenses, packing, pages
from molweave.llm.queries import table
from molweave.plans.registry import QUERIES
from molweave.llm.tokens import public_vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_vocabulary().model_path)


# tokens, lengths, packing


def test_ids_equal_tokenizers(spark, tokenizer):
    vocabulary = public_vocabulary()
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    texts += ["", "a<|endoftext|>b", " " * 500 + "x", "   \u0085x", "don't I'LL", "\U0001f600‍" * 9]
    texts += ["x" + chr(c) + " 1" + chr(c) for c in range(0x80, 0x30000, 97) if not 0xD800 <= c < 0xE000]
    for text, encoding in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert vocabulary.encode(text).tolist() == encoding.ids


def test_length_table(spark, tokenizer):
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    n = np.array([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)])
    result = QUERIES["op10_token_counts"](spark, SF)
    rows = {r.n_tokens: r for r in result.collect()}
    assert sorted(rows) == sorted(set(n.tolist()))
    for length, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.docs_below) == ((n == length).sum(), (n >= length).sum(), (n < length).sum())
        assert (r.tokens_at_least, r.truncated_total) == (n[n >= length].sum(), np.minimum(n, length).sum())
    limits = [0, 1, 100, 512, 2048, 10**6]
    answered = lengths.at_limits(result, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()
    for r in answered:
        assert (r.docs_cut, r.truncated_total) == ((n > r.limit).sum(), np.minimum(n, r.limit).sum())
    assert len(answered) == len(limits)
    assert lengths.quantile(result, 0.5).first()[0] == np.quantile(n, 0.5, method="inverted_cdf")


def test_packing_is_a_round_trip(spark, tokenizer):
    documents = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 2048 for r in parts[1:]) and len(parts) == -(-len(ids) // 2048)
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


@pytest.mark.parametrize("capacity,seed", [(16, 1), (64, 2), (100, 3)])
def test_plans_use_every_piece_once(capacity, seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 300, capacity) * (rng.random(capacity) < 0.5)
    plan = packing.solve(counts, capacity)
    used = np.zeros_like(counts)
    for config, copies in plan:
        assert sum(x * n for x, n in config) <= capacity and copies > 0
        for x, n in config:
            used[x] += n * copies
    assert (used == counts).all()
    places = packing.Places(plan)
    seen = set()
    for length in np.flatnonzero(counts):
        sequence, offset = places.find(np.full(counts[length], length), np.arange(counts[length]))
        seen |= {(s, o + k) for s, o in zip(sequence.tolist(), offset.tolist(), strict=True) for k in range(length)}
    assert len(seen) == (counts * np.arange(capacity + 1)).sum()


def test_pricing_reaches_the_linear_program():
    # Lengths 6, 5, 4 of capacity 10: pairs (6, 4) and (5, 5) fill 30 sequences and no fewer are possible.
    counts = np.zeros(11, np.int64)
    counts[[4, 5, 6]] = 20, 20, 20
    uses = packing.price_configurations(counts, 10)
    covered = np.zeros(11)
    for config, times in uses.items():
        for x, n in config:
            covered[x] += n * times
    assert (covered <= counts + 1e-6).all()
    assert sum(n for _, n in packing.solve(counts, 10)) == 30


# near copies


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute_links(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words_of(t)) for i, t in texts.items())}
    links = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def made_up_texts(seed=3):
    """A large group of near copies, chains of edits, a passage that all share, and texts of their own."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choices("abcdefghij", k=6))

    passage = [word() for _ in range(60)]
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(150):
        near = base.copy()
        for _ in range(rng.randrange(1, 4)):
            near[rng.randrange(len(near))] = word()
        texts.append(near)
    chain = [word() for _ in range(120)]
    for _ in range(12):
        chain = chain.copy()
        chain[rng.randrange(len(chain))] = word()
        texts.append(chain)
    texts += [[word() for _ in range(rng.randrange(30, 200))] + passage for _ in range(300)]
    texts += [[word() for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 16, "TILE": 24}, {"TILE": 24, "WIDE_TILE": 40, "STRIPE": 7}])
def test_join_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(chosen_path, name, value)
    texts = made_up_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = brute_links(texts)
    root = {}
    for i in sorted(texts):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += links[k]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in chosen_path.jaccard_join(df).collect()}
    assert got == {i: (root[i], len(links[i]), 1) for i in texts}
    kept = {r.doc_id for r in chosen_path.keep_representatives(df).collect()}
    assert kept == set(root.values())


@pytest.mark.parametrize("least", [components.HUB_LEAST, 1])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, least):
    monkeypatch.setattr(components, "HUB_LEAST", least)
    links = [(i + 1, i) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 4999), (5000, 1005)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 300)} | {5000: 1000, 4999: 1000}
    assert got == want


# nearest neighbours


@pytest.mark.parametrize("block", [8192, 60])
def test_recall_of_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(collision, "BLOCK", block)
    vectors = table(spark, SF, "embeddings")
    rows = vectors.collect()
    ids = np.array([r.vec_id for r in rows])
    matrix = np.array([r.embedding for r in rows], float)
    got = {}
    for r in collision.nearest(vectors, vectors.filter("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 10 == 0):
        score = collision.cosines(matrix[q], matrix)
        order = [k for k in np.lexsort((ids, -score)) if k != q][:5]
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(s == score[np.flatnonzero(ids == v)[0]] for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
        total += 5
    assert hits >= 0.9 * total


def test_equal_vectors_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(i, [float(i), 1.0, 0.5]) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collision.nearest(df, df.filter("vec_id = 50")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and len({r.score for r in got}) == 1


def test_blocks_of_a_repeated_id(spark):
    rows = spark.range(3000).selectExpr("id % 3 * id AS vec_id", "array(double(id), 1.0D) AS v")
    equal = spark.range(3000).selectExpr("7L AS vec_id", "array(1.0D, 2.0D) AS v")
    sizes = [r["count"] for r in collision.in_blocks(rows.union(equal), 60, 5).groupBy("block").count().collect()]
    assert sum(sizes) == 3005 and max(sizes) < 120


def test_ranks_beyond_16_bits():
    vectors = np.random.default_rng(1).standard_normal((70_000, 3))
    directions = collision.directions_of(3, 4, seed=5)
    block = collision.Block(np.arange(70_000), vectors, directions)
    query = vectors[:2] / np.linalg.norm(vectors[:2], axis=1, keepdims=True)
    projected, width = (query @ directions).astype(np.float32), 0.9
    values = ((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ directions).astype(np.float32)
    for q, count in enumerate(block.collisions(projected, width)):
        inside = (values >= projected[q] - width) & (values <= projected[q] + width)
        assert np.abs(count.astype(int) - inside.sum(axis=1)).sum() <= 4


# licenses


def test_blocks_meet_templates(spark):
    filler = " ".join(f"w{i}" for i in range(100))
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [
        (1, f"x\n{apache}\ny"),
        (2, f"{filler} {apache} {filler}"),
        (3, "Licensed under the Apache"),
        (4, "CC BY, cc by! General Public\nLicense"),
        (5, "2.0 version license apache the under licensed"),
        (6, f"licensed {filler} under {filler} the apache license version 2 0"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["apache-2.0", "apache-2.0", "", "cc-by,gpl", "apache-2.0", ""]
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels, got[4].n_words) == (3, 0, 4, "cc-by,gpl", 7)


def test_wrapped_notices_meet_templates(spark):
    filler = "\n".join(f"w{i} v{i} u{i}" for i in range(40))
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    mit = " * Permission is hereby granted,\r\n * free of charge, to any person\r\n * obtaining a copy of this software"
    rows = [(1, bsd), (2, f"{filler}\n{bsd}\n{filler}"), (3, f"{filler}\n{mit}"), (4, f"{bsd}\n{filler}\n{mit}")]
    rows += [(5, "Redistribution and use in source and binary\n" + filler + "\nforms, with or without modification, are permitted provided that")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "bsd", "mit", "bsd,mit", ""]
    assert [got[i].score for i in range(1, 6)] == [1.0, 1.0, 1.0, 1.0, 0.0]


# pages


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<p>b", "a b"),
        ("a<b>b</b>c<br>d", "abc d"),
        ('<div class="ad">x</div>y', "y"),
        ('<article><div class=comment-list>q</div><p title="a>b">z&nbsp;&amp;w</article>tail', "z &w"),
        ("<ul><li>a<li>b</ul>", "a b"),
        ("x < y &lt; z", "x < y < z"),
        ("<script>if(a<b)</p></script>ok<style>p{}</style>", "ok"),
        ("<header>h</header><main>m</main><footer>f</footer>", "m"),
        ("<article><header><h1>T</h1></header>b</article>", "T b"),
        ("<!-- x -->k<![CDATA[raw&amp;]]>", "kraw&amp;"),
        ("<title>t</title>v<textarea><p>u</textarea>w", "v w"),
        ("<b>x<p>y</b>z</p>w", "x yz w"),
        ("<nav><article>n</article></nav>o", "o"),
        ("<div id=sidebar>s</div><div class='post side'>p</div></div></div>q", "p q"),
        ("<p>unclosed <div class=", "unclosed"),
        ("<article>one<article>in</article></article><article>two</article>", "one in two"),
        ('<div aria-hidden="false">a</div><p data-title="The hidden cost">b<p data-id="share-12">c<p data-role=menu>d', "a b c d"),
        ("<p title='x' hidden>a</p><p title=\"class='ad'\">b</p><p CLASS = 'ad' class=x>c</p><p class=x class=ad>d", "b d"),
        ('<div id=content class="no-sidebar">a</div><div class="has_nav x">b</div><div class=sidebar-left>c</div>', "a b"),
        ('<article class="post comments-open">a</article>b', "a"),
        ('<article class="post sponsored">a<div class=share>s</div></article>b', "a"),
        ('<div class="widget"><p>x</p><main>a</main></div>b', "a"),
        ('<div class="popup page"><p>x</p><article>a</article></div>b', "a"),
        ('<article>a</article><div id=related><article class=card>t</article></div>', "a"),
        ('<div hidden><article>a</article></div>b', "b"),
    ],
)
def test_main_text_of_markup(page, text):
    assert pages.Reader().read(page) == text


@pytest.mark.parametrize("limit", [500_000, 0])
def test_site_templates_are_removed(spark, monkeypatch, limit):
    monkeypatch.setattr(pages, "BROADCAST_TEMPLATES", limit)
    promo = "<div><p>Read our <i>other</i> stories</p></div>"
    rows = [(i, f"https://site/{i}", f"<article><h1>t{i}</h1><p>story {i}</p>{promo}</article>") for i in range(20)]
    rows += [(100 + i, f"https://copies/{i}", "<article><p>the same article</p></article>") for i in range(20)]
    rows += [(200 + i, f"https://small/{i}", f"<article><p>story {i}</p>{promo}</article>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(got[i] == f"t{i} story {i}" for i in range(20))
    assert all(got[100 + i] == "the same article" for i in range(20))
    assert all(got[200 + i] == f"story {i} Read our other stories" for i in range(4))


@pytest.mark.parametrize("url,limit", [("https://hot/{}", 500_000), ("https://hot/{}", 0), (None, 500_000)])
def test_recurring_blocks_are_removed_below_half(spark, monkeypatch, url, limit):
    monkeypatch.setattr(pages, "BROADCAST_TEMPLATES", limit)
    notice = "<div>Visitors of the harbour section see this notice</div>"
    shared = "".join(f"<p>paragraph {k} that all near copies of one article have</p>" for k in range(6))
    line = "<p>This passage may be used under the license of its author</p>"

    def page(i, extra=""):
        own = " ".join(f"w{i}x{k}" for k in range(12))
        return (i, url and url.format(i), f"<article><h1>story {i}</h1><p>{own}</p>{extra}</article>")

    rows = [page(i) for i in range(100)] + [page(i, notice) for i in range(100, 130)]
    rows += [page(i, "<table><tr><td>yes</td></tr></table>") for i in range(130, 160)]
    rows += [page(i, line) for i in range(160, 190)]
    rows += [(i, url and url.format(i), f"<div><h1>copy {i}</h1>{shared}</div>") for i in range(200, 240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert not any("notice" in got[i] for i in range(100, 130)) and all(got[i].endswith("x11") for i in range(130))
    assert all(got[i].endswith(" yes") for i in range(130, 160)) and all(got[i].endswith(" author") for i in range(160, 190))
    assert all(got[i].count("paragraph") == 6 for i in range(200, 240))


def test_articles_of_the_table(spark):
    import html

    rows = table(spark, SF, "pages").collect()
    got = {r.page_id: r.text for r in QUERIES["op8_html_extraction"](spark, SF).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
