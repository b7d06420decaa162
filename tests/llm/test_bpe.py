"""The transducer against the definition of the merges and a reference encoder; round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def coder():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        return bpe.Transducer(bpe.parse_ranks(f.read()))


@pytest.fixture(scope="module")
def reference(coder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=coder.ranks, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_random_texts(coder, reference, text):
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert "".join(coder.decode(ids)) == text


def test_pieces_equal_merging(coder):
    rnd = random.Random(2)
    for _ in range(500):
        piece = bytes(rnd.choice(b" abcdeinorst\xc3\xa9\xe4\xb8\xad") for _ in range(rnd.randrange(1, 24)))
        assert coder.encode_piece(piece) == coder.merged(piece)


def test_edges(coder, reference):
    assert coder.encode(None) == [] and coder.encode("") == []
    for text in (" ", "\n\n", "a" * 50_000, "中" * 3000, "<|endoftext|>", "it's  I'LL\r\n\t x", "😀👍🏽" * 50, "ab12" * 9000):
        assert coder.encode(text) == reference.encode_ordinary(text)


def test_flush_keeps_results(coder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 10)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    t = bpe.Transducer(coder.ranks)
    text = "The quick brown fox jumps over thirteen lazy dogs, again and again."
    assert t.encode(text) == coder.encode(text)


def test_lookahead_settles_tokens(coder, reference, monkeypatch):
    """Tokens emitted on the way are those of the whole piece, however short the lookahead."""
    rnd = random.Random(8)
    text = "".join(rnd.choice(["the", "ing", "tion", "qu", "x", "é", "ß", "ab", "zz"]) for _ in range(3000))
    want = reference.encode_ordinary(text)
    for n in (1, 7, 64, 512):
        monkeypatch.setattr(bpe, "LOOKAHEAD", n)
        t = bpe.Transducer(coder.ranks)
        assert t.encode(text) == want
    settled, open_ = [], []
    own = bpe.Transducer._settled

    def watch(self, state, lasts):
        end = own(self, state, lasts)
        settled.append(end)
        open_.append(len(lasts) - end)
        return end

    monkeypatch.setattr(bpe.Transducer, "_settled", watch)
    coder.encode_piece(text.encode())
    assert any(settled) and max(open_) < 200  # what stays open is bounded by the vocabulary's tokens, not by the piece


def test_table(spark, coder):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "s"), (1, "hello world", "s")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encoded(df).collect())
    assert got == [(1, coder.encode("hello world"))] * 2 + [(2, []), (3, [])]
    assert sorted(r["n_tokens"] for r in bpe.encoded(df, counts_only=True, keep=["ids"]).collect()) == [0, 0, 2, 2]
    assert bpe.encoded(df.limit(0)).count() == 0
