import os
import random

import pytest

from photoloom.llm.encoding import BYTE_BPE_50K, Encoder, encode, ranks_of, replay, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary here")


def public(texts):
    import tiktoken

    from photoloom.llm.encoding import PATTERN

    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(BYTE_BPE_50K), special_tokens={})
    return [t.encode_ordinary(x or "") for x in texts]


TEXTS = [None, "", " ", "\n\n \t x", "The sitting is opened.", "don't  DON'T we'll", "Überhang ﬁ é 강물은 둑을 🙂🙂", "a" * 3000, "=" * 501 + " " * 77, "<|endoftext|> 1234567 b7871d3b", "x y z\x1c‍", "Ab" * 40_000]


def test_ids_are_those_of_the_public_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, extra string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in encode(df).collect())
    assert [x for _, x in got[::2]] == public(TEXTS) == [x for _, x in got[1::2]]
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(x) for i, x in enumerate(public(TEXTS))}
    assert encode(df.limit(0)).count() == 0


def test_random_text_and_forgetting():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab cde'\n12.,éß中") for _ in range(rnd.randrange(200))) for _ in range(300)]
    import numpy as np

    encoder = Encoder(words=50)
    got = [np.frombuffer(x, "<i4").tolist() for k in range(0, 300, 30) for x in encoder.encode(texts[k : k + 30])]
    assert got == public(texts)


def test_round_trip():
    back = {v: k for k, v in ranks_of(BYTE_BPE_50K).items()}
    words = [w.encode() for w in ("", " the", "aaaaaaaaab", "héllo", "\n\n\n")]
    assert [b"".join(back[i] for i in ids) for ids in replay(words, ranks_of(BYTE_BPE_50K))] == words
