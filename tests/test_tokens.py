import pytest
from pyspark.sql import functions as F

from molweave.functions import ids as I
from molweave.functions.symbols import join_symbols, molecule_tokens, split_symbols, whitespace_tokens
from molweave.operators import vocab as V
from molweave.operators.encoding import encode_text, model_inputs


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("", []),
        (None, None),
        ("[C]", ["[C]"]),
        ("[C].[O]", ["[C]", ".", "[O]"]),
        ("[=C][Branch1][C]", ["[=C]", "[Branch1]", "[C]"]),
        ("ab[C]cd[N]", ["[C]", "[N]"]),
        ("[C][N", ["[C]"]),
    ],
)
def test_split_symbols(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert values(df.select(split_symbols(F.col("s")).alias("t")), "t") == [expected]


def test_join_and_whitespace(spark):
    df = spark.createDataFrame([("  a\tb c d\n",), ("",), (None,)], "s string")
    assert values(df.select(whitespace_tokens(F.col("s")).alias("t")), "t") == [["a", "b", "c", "d"], [], None]
    df = spark.createDataFrame([(["[C]", "[O]"],), ([],)], "t array<string>")
    assert values(df.select(join_symbols(F.col("t")).alias("s")), "s") == ["[C] [O]", ""]


def test_symbol_with_whitespace_splits_like_text(spark):
    df = spark.createDataFrame([("[C][a b].[O]",), ("[C][O]",), (None,)], "s string")
    assert values(df.select(molecule_tokens(F.col("s")).alias("t")), "t") == [
        ["[C]", "[a", "b]", ".", "[O]"],
        ["[C]", "[O]"],
        None,
    ]


def corpus(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, tokens array<string>")


def test_vocab_order_ties_and_specials(spark):
    df = corpus(spark, [["b", "a", "c", "c"], ["[PAD]", "[PAD]", "[PAD]"], None, []])
    got = [(r.token, r.id, r.n) for r in V.train_vocab(df).orderBy("id").collect()]
    assert got[:5] == [(t, i, 0) for i, t in enumerate(I.SPECIAL_TOKENS)]
    assert got[5:] == [("c", 5, 2), ("a", 6, 1), ("b", 7, 1)]


def test_vocab_size_and_frequency_limits(spark):
    df = corpus(spark, [["a"] * 3 + ["b"] * 2 + ["c"]])
    assert values(V.train_vocab(df, max_size=7).orderBy("id"), "token")[5:] == ["a", "b"]
    assert values(V.train_vocab(df, min_frequency=3).orderBy("id"), "token")[5:] == ["a"]
    assert V.train_vocab(df, max_size=5).count() == 5
    with pytest.raises(ValueError):
        V.train_vocab(df, max_size=4)


@pytest.fixture(scope="module")
def trained(spark):
    df = corpus(spark, [["a", "a", "b"], ["c"]])
    return V.train_vocab(df)


def test_encode_forms_agree(spark, trained):
    rows = corpus(spark, [["a", "zzz", "c"], [], None, ["[PAD]", "b"], ["zzz"]])
    by_lookup = {r.k: r.ids for r in V.encode(rows, trained).collect()}
    by_join = {r.k: r.ids for r in V.encode_by_join(rows, trained, "k").collect()}
    assert by_lookup == {0: [5, 0, 7], 1: [], 2: None, 3: [3, 6], 4: [0]}
    # The join form cannot tell a null sequence from an empty one; both encode to the bare template.
    assert by_join == {**by_lookup, 2: []}


def test_large_vocabulary_takes_the_shuffled_tail(spark, trained):
    rows = corpus(spark, [["a", "zzz", "c", "b"], ["a"] * 50])
    small = V.encode_by_join(rows, trained, "k", limit=6)
    assert {r.k: r.ids for r in small.collect()} == {0: [5, 0, 7, 6], 1: [5] * 50}


def test_encode_and_decode_route_by_size(spark, trained, monkeypatch):
    rows = corpus(spark, [["a", "zzz", "c"], [], None, ["[PAD]", "b"], ["zzz"] * 40])
    ids = V.encode(rows, trained, key="k").select("k", "ids")
    want = {r.k: r.ids for r in ids.collect()}
    shown = {r.k: r.tokens for r in V.decode(ids, trained, "k", "ids").collect()}
    monkeypatch.setattr(V, "BROADCAST_LIMIT", 6)
    assert {r.k: r.ids for r in V.encode(rows, trained, key="k").collect()} == want
    assert {r.k: r.tokens for r in V.decode(ids, trained, "k", "ids").collect()} == shown
    with pytest.raises(ValueError, match="key"):
        V.encode(rows, trained)


def test_every_token_is_kept_by_default(spark):
    df = corpus(spark, [[f"t{i}" for i in range(2000)]])
    assert V.train_vocab(df).count() == 2005


@pytest.mark.parametrize("n", [0, 1, 509, 510, 511, 1771])
def test_model_inputs_have_fixed_length(spark, n):
    df = spark.createDataFrame([(list(range(5, 5 + n)),)], "ids array<int>")
    r = model_inputs(df).first()
    kept = min(n, 510)
    assert r.input_ids == [1, *range(5, 5 + kept), 2] + [3] * (510 - kept)
    assert r.attention_mask == [1] * (kept + 2) + [0] * (510 - kept)
    assert r.token_type_ids == [0] * 512


def test_null_text_keeps_its_row(spark, trained):
    df = spark.createDataFrame([(1, None), (2, "[q]")], "k int, selfies string")
    got = {r.k: r for r in encode_text(df, trained, max_length=4).collect()}
    assert got[1].input_ids == [1, 2, 3, 3] and got[1].attention_mask == [1, 1, 0, 0]
    assert got[2].input_ids == [1, 0, 2, 3]
    assert set(got[1].asDict()) == {"k", "input_ids", "attention_mask", "token_type_ids"}


def test_lm_labels_ignore_padding(spark):
    df = spark.createDataFrame([([1, 5, 2, 3, 3],)], "ids array<int>")
    assert df.select(I.lm_labels(F.col("ids")).alias("y")).first().y == [1, 5, 2, -100, -100]


def test_decode_is_the_inverse(spark, trained):
    rows = corpus(spark, [["a", "c", "b"], []])
    coded = model_inputs(V.encode(rows, trained), 8)
    back = {r.k: r.tokens for r in V.decode(coded, trained, "k").collect()}
    assert back == {0: ["[CLS]", "a", "c", "b", "[SEP]"], 1: ["[CLS]", "[SEP]"]}
    long = sorted((r.k, r.pos, r.token) for r in V.decode_long(coded, trained, "k").collect())
    assert long == [(k, i, t) for k in back for i, t in enumerate(back[k])]


def test_decode_without_padding_keeps_the_last_token(spark, trained):
    df = spark.createDataFrame([(1, [1, 5, 2]), (2, [3, 5])], "k int, input_ids array<int>")
    got = {r.k: r.tokens for r in V.decode(df, trained, "k").collect()}
    assert got == {1: ["[CLS]", "a", "[SEP]"], 2: []}


def test_length_profile(spark):
    r = V.length_profile(corpus(spark, [["a"] * 513, ["a"] * 512, None, []])).first()
    assert (r.longest, r.n_over, r.share_over, r.n_sequences) == (513, 1, 0.25, 4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_needs_no_shuffle_and_one_pass(spark, trained):
    df = spark.createDataFrame([(1, "[C]")], "k int, selfies string")
    text = plan(encode_text(df, trained))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_counting_combines_before_the_shuffle_and_tokenises_once(spark, tmp_path):
    spark.createDataFrame([(1, "[C][N]")], "k int, selfies string").write.parquet(str(tmp_path / "m"))
    from molweave.operators.encoding import tokenize

    text = plan(V.count_tokens(tokenize(spark.read.parquet(str(tmp_path / "m")))))
    assert "partial_count" in text
    assert text.count("RLIKE") == 1
    assert "ReadSchema: struct<selfies:string>" in text


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_vocabulary_is_independent_of_partitions(spark, parts):
    rows = corpus(spark, [[f"t{(i * j) % 11}" for j in range(i % 9)] for i in range(80)])
    want = [tuple(r) for r in V.train_vocab(rows.coalesce(1)).orderBy("id").collect()]
    assert [tuple(r) for r in V.train_vocab(rows.repartition(parts)).orderBy("id").collect()] == want


def test_a_tail_is_joined_once_per_row_and_token(spark, monkeypatch):
    """Beyond the broadcast head a sequence asks for each of its tokens once, and what it asks is all that is exploded."""
    rows = corpus(spark, [["a"] * 9 + ["b"] * 5 + ["c", "zzz", None, "zzz"], ["d", "c", "d", "c"], ["a"], [], None])
    trained = V.train_vocab(corpus(spark, [["a"] * 4 + ["b"] * 3 + ["c"] * 2 + ["d"]]))
    ids = V.encode(rows, trained, key="k", keep=False)
    want, long = {r.k: r.ids for r in ids.collect()}, sorted(tuple(r) for r in V.decode_long(ids, trained, "k", "ids").collect())
    assert want[0][-4:] == [7, 0, 0, 0] and ids.columns == ["k", "ids"]
    monkeypatch.setattr(V, "BROADCAST_LIMIT", 7)
    large = V.encode(rows, trained, key="k", keep=False)
    assert {r.k: r.ids for r in large.collect()} == want and large.columns == ["k", "ids"]
    assert {r.k: r.ids for r in V.encode_by_join(rows, trained, "k").collect()} == {**want, 4: []}
    assert sorted(tuple(r) for r in V.decode_long(ids, trained, "k", "ids").collect()) == long
    looked = rows.select("k", V.head_lookup(trained.filter("id < 7"))(F.col("tokens")).alias("h")).select("k", "h.*").collect()
    assert {r.k: (r.rest and sorted(r.rest)) for r in looked} == {0: ["c", "zzz"], 1: ["c", "d"], 2: [], 3: [], 4: None}
