"""Encoding: equal to the public libraries, an exact round trip, and the defined cases."""

import base64
import os
import random

import pytest

from millrace.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def voc():
    return bpe.Vocabulary()


def reference(text):
    import tiktoken

    if not hasattr(reference, "e"):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.DEFAULT_VOCABULARY, "rb") if x.strip())}
        reference.e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return reference.e.encode_ordinary(text)


def texts():
    rng = random.Random(3)
    out = ["", " ", "\n\n  x", "Hello world's don't", "<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 900, "ß∂ƒ 日本語 🚀" * 20, "\r\n\t x\u00a0y\u200b", "0123456789" * 40]
    alphabet = "abcdef ghij\n\t.,!?'é日🚀0189ABC"
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(150)]


def test_equals_library_and_round_trip(voc):
    t = texts()
    offsets, ids = voc.encode_batch(t)
    back = {v: k for k, v in voc.ranks.items()}
    for i, x in enumerate(t):
        mine = ids[offsets[i] : offsets[i + 1]].tolist()
        assert mine == reference(x)
        assert b"".join(back[k] for k in mine).decode() == x


def test_heap_and_matrix_agree(voc):
    for w in (b"abababab" * 30, b"internationalisation" * 12, bytes(range(65, 91)) * 9):
        assert voc._long(w).tolist() == voc._matrix([w])[0].tolist()


def test_cache_reset(voc, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 5)
    for x in texts()[:20]:
        offsets, ids = voc.encode_batch([x])
        assert ids.tolist() == reference(x)


def test_operator(spark):
    rows = [(1, "Hello world", 7), (2, None, 7), (3, "", 7), (4, "Hello world", 7), (4, "Hello world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df).collect())
    hello = reference("Hello world")
    assert got == [(1, hello), (2, []), (3, []), (4, hello), (4, hello)]
    assert bpe.encode(df.limit(0)).count() == 0
