import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quilate.llm import packing as K


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=200, deadline=None)
def test_bins_never_overflow(sizes):
    s = np.array(sizes, dtype="int64")
    bins = K.pack_shard(s, 64, 16)
    used = np.bincount(bins, weights=s, minlength=1) if len(s) else np.zeros(1)
    assert (bins >= 0).all() and (used <= 64).all() and (not len(s) or len(set(bins)) == bins.max() + 1)


def test_fill_of_many():
    rng = np.random.default_rng(0)
    s = np.minimum(rng.lognormal(5.5, 1.0, 20_000).astype("int64") + 1, 2048)
    bins = K.pack_shard(s)
    assert s.sum() / ((bins.max() + 1) * 2048) > 0.93


def test_pack(spark):
    words = "uno dos tres cuatro "
    rows = [(i, words * (i + 1), "c") for i in range(40)] + [(100, None, "c"), (101, "", "c"), (102, words * 3000, "c"), (7, words * 8, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = K.pack(df, "doc_id", "text", shard_documents=20).collect()
    encoding = K.load_tokenizer(K.DEFAULT_TOKENIZER)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        want = len(encoding.encode_ordinary(t)) if t else 0
        assert sum(r["n_tokens"] for r in by[i]) == want * (2 if i == 7 else 1)
        if want > 2048:
            assert sorted(r["piece"] for r in by[i]) == list(range(-(-want // 2048)))
        elif i != 7:
            assert len(by[i]) == 1
    assert by[100][0]["container"] is None and by[101][0]["container"] is None
    f = K.fill(spark.createDataFrame([(r["container"], r["n_tokens"]) for r in out], "container string, n_tokens int")).first()
    assert f["fullest"] <= 2048
    assert K.pack(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> hola", "a" * 20_000, "ñandú 🙂 \x00"])
def test_tokenizer_round_trip(text):
    e = K.load_tokenizer(K.DEFAULT_TOKENIZER)
    assert e.decode(e.encode_ordinary(text)) == text
