import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repoloom.llm import bpe, mixing

VOCABULARY = bpe.default_vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the public vocabulary is not installed")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_public_library(reference, text):
    assert bpe.encoder(VOCABULARY).encode(text) == reference(text)


def test_very_long_pretokens_and_round_trip(reference):
    e = bpe.encoder(VOCABULARY)
    names = {v: k for k, v in e.ranks.items()}
    for text in ("ab" * 20_000, "a" * 9_999, " " * 5_000, "é😀" * 3_000, "<|endoftext|>"):
        ids = e.encode(text)
        assert ids == reference(text) and b"".join(names[i] for i in ids).decode() == text


def test_rank_queue_order_and_stale_bits():
    q = bpe.RankQueue(70_000)
    for rank, at in ((69_999, 1), (5, 9), (5, 2), (64, 0), (4096, 3)):
        q.push(rank, at)
    assert [q.pop() for _ in range(6)] == [(5, 2), (5, 9), (64, 0), (4096, 3), (69_999, 1), None]


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (3, None), (None, "x")], "doc_id bigint, text string").selectExpr("*", "'clash' as ids")
    rows = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, bpe.encoder(VOCABULARY).encode("Hello world")), (2, []), (3, []), (3, []), (None, bpe.encoder(VOCABULARY).encode("x"))], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def brute(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        best = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, given, caps, strict=True)) if g < c and w > 0]
        if not best:
            break
        given[min(best)[1]] += 1
    return given


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(sources, seats):
    weights, caps = np.array([w for w, _ in sources]), np.array([c for _, c in sources])
    assert mixing.sainte_lague(weights, seats, caps).tolist() == brute(weights, seats, caps)


def test_mix(spark):
    words = ["alpha beta gamma delta", "one two three"]
    docs = [(i, "big", words[i % 2]) for i in range(3000)] + [(5000 + i, "small", words[i % 2]) for i in range(40)] + [(9000, None, "x"), (9001, "big", None), (9002, "other", "x"), (9003, "small", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 as n_tokens")
    goals = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.3, 3), ("m", "none", 0.1, 9), ("n", "none", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, goals, shard_docs=500).cache()
    rows = {(r.mix_id, r.source): r for r in mixing.shares(mixed, goals).collect()}
    assert rows["m", "big"].actual_share == pytest.approx(0.6 / 0.9, abs=0.02) and rows["m", "small"].actual_share == pytest.approx(0.3 / 0.9, abs=0.02)
    assert rows["m", "small"].most_repeats <= 3 and rows["m", "none"].n_tokens == 0 and rows["n", "none"].actual_share is None
    assert mixed.where("doc_id in (9000, 9001, 9002, 9003)").count() == 0
    assert {tuple(r) for r in mixing.mix(df, goals, shard_docs=500).collect()} == {tuple(r) for r in mixed.collect()}
    assert mixing.mix(df.limit(0), goals).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=20), st.integers(0, 400))
def test_take_stays_within_the_quota_and_leaves_nothing_that_fits(sizes, quota):
    sizes = np.array(sizes, np.int64)
    taken = mixing.take(sizes, quota)
    left = quota - int(sizes[taken].sum())
    assert left >= 0 and all(s > left for s in sizes[~taken])


def test_one_large_document_does_not_break_the_share(spark):
    docs = [(0, "a", "word " * 3000)] + [(i, "a", "one two three") for i in range(1, 300)] + [(1000 + i, "b", "one two three four") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("m", "a", 0.1, 1), ("m", "b", 0.9, 1)], "mix_id string, source string, target_share double, max_repeats int")
    for shard_docs in (20_000, 400):
        got = {r.source: r for r in mixing.shares(mixing.mix(df, goals, shard_docs=shard_docs), goals).collect()}
        assert got["a"].actual_share == pytest.approx(0.1, abs=0.02) and got["b"].actual_share == pytest.approx(0.9, abs=0.02)
