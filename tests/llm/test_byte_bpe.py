import random
import time

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm.byte_bpe import byte_bpe, coder

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
own = coder(PATH, public_tokenizers.PATTERN)
other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab tha'se\n\t\x1c\x1f\x85\u2003 é漢🙂12,.<|endoftext|>"), max_size=60))
def test_same_ids(text):
    ids = own.encode(text)
    assert ids == ",".join(map(str, other.encode_ordinary(text)))
    assert own.decode(ids) == text.encode()


def test_long_pieces_stay_near_linear():
    rng = random.Random(3)
    for text in ("a" * 60_000, "".join(rng.choices("thaneriou", k=60_000)), "=" * 5001, " " * 4000 + "x"):
        began = time.time()
        assert own.encode(text) == ",".join(map(str, other.encode_ordinary(text)))
        assert time.time() - began < 10


def test_table(spark):
    docs = spark.createDataFrame([(1, "The thing.", 5), (1, "The thing.", 6), (2, None, 7), (3, "", 8), (None, "é\n\n x", 9)], "doc_id int, text string, ids int")
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids, bytes(r.decoded)) for r in byte_bpe(docs, PATH, public_tokenizers.PATTERN).collect())
    want = sorted((i or 0, len(e := other.encode_ordinary(t or "")), ",".join(map(str, e)), (t or "").encode()) for i, t, _ in docs.collect())
    assert got == want
    assert byte_bpe(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
