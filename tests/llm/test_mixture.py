import numpy as np
import pytest

from weftline.llm import mixture as M

TOK = "/opt/tokenizers/byte_bpe_50k.json"
SIZED = "doc_id long, source string, lang string, topic string, n_tokens long, copies int, w double"


def sized(spark, n=6000):
    r = np.random.default_rng(1)
    src, lang = ["big", "mid", "small", "none", None], ["en", "de", None]
    rows = [(i, src[min(4, int(r.choice(5, p=[0.6, 0.25, 0.05, 0.08, 0.02])))], lang[int(r.integers(3))], f"t{int(r.integers(4))}", int(r.integers(0, 400)), 9, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, SIZED)


TARGETS = "source string, target_share double, max_repeats long"


def by_source(m):
    return {r["level"]: r for r in m.report().where("margin = 'source'").collect()}


def test_languages_and_topics_keep_their_shares(spark):
    t = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.3, 4), ("small", 0.3, 16)], TARGETS)
    rep = M.Mixture(sized(spark), t, total=400_000).report().collect()
    assert {(r["margin"], r["level"]) for r in rep} >= {("lang", None), ("lang", "en"), ("topic", "t0"), ("source", "small")}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in rep if r["margin"] != "source")
    for m in ("source", "lang", "topic"):
        assert abs(sum(r["actual_share"] for r in rep if r["margin"] == m) - 1) < 1e-9


def test_shares_and_caps(spark):
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.3, 8), ("absent", 0.1, 3)], TARGETS)
    rep = by_source(M.Mixture(sized(spark), t))
    for s, want in (("big", 1 / 3), ("mid", 1 / 3), ("small", 1 / 3), ("absent", 0.0)):
        assert abs(rep[s]["actual_share"] - want) < 0.005, rep[s]
        assert rep[s]["most_repeats"] <= rep[s]["max_repeats"]
    assert rep["absent"]["target_share"] == 0.1
    m = M.Mixture(sized(spark), t).sample()
    assert m.columns == ["doc_id", "source", "n_tokens", "copies"] and {r[0] for r in m.select("source").distinct().collect()} == {"big", "mid", "small"}
    assert m.exceptAll(M.Mixture(sized(spark), t).sample()).count() == 0  # the same each time


def test_a_given_size_and_too_much(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 1)], TARGETS)
    rep = by_source(M.Mixture(sized(spark), t, total=20_000))
    assert all(abs(r["tokens"] - 10_000) < 400 for r in rep.values())
    rep = by_source(M.Mixture(sized(spark), t, total=1e9))
    assert all(r["most_repeats"] <= 1 and r["tokens"] == r["tokens_available"] for r in rep.values())


def test_rake_meets_margins():
    tok = np.array([10.0, 20, 30, 40])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    ta, tb = np.array([60.0, 40]), np.array([50.0, 50])
    w = M.rake(tok, [a, b], [ta, tb], np.full(4, 100.0))
    assert np.allclose(np.bincount(a, w * tok), ta) and np.allclose(np.bincount(b, w * tok), tb)
    w = M.rake(tok, [a, b], [ta, tb], np.array([1.0, 9, 9, 9]))
    assert w[0] <= 1 and np.allclose(np.bincount(a, w * tok), ta)


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], SIZED)
    t = spark.createDataFrame([("a", 1.0, 1), (None, 1.0, 1), ("z", None, None)], TARGETS)
    m = M.Mixture(none, t)
    assert m.sample().collect() == []
    assert sorted((r["level"], r["tokens"], r["actual_share"]) for r in m.report().collect()) == [("a", 0, 0.0), ("z", 0, 0.0)]
    assert M.Mixture(none, t.limit(0)).report().collect() == []


def test_token_counts(spark):
    pytest.importorskip("tokenizers")
    long = "word " * 50_000
    d = spark.createDataFrame([(1, "Hello <|endoftext|> world", 5), (2, None, 5), (3, "", 5), (4, long, 5)], "doc_id long, text string, n_tokens int")
    got = {r[0]: r[1] for r in M.token_counts(d, TOK).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOK)
    t.encode_special_tokens = True
    assert got == {1: len(t.encode("Hello <|endoftext|> world").ids), 2: 0, 3: 0, 4: len(t.encode(long).ids)}
    assert M.token_counts(d.limit(0), TOK).collect() == []


def test_ranks_count_as_the_tokenizer(spark):
    pytest.importorskip("tiktoken")
    texts = ["it's  a\n\n test_x 12345 ü— \t x ", "<|endoftext|>", "a" * 3000, " ", "\n\n\nx"]
    assert M._counter(TOK)(texts) == M._counter(TOK.replace(".json", ".tiktoken"))(texts)
