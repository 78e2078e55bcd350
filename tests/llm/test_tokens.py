import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bpe, queries, tokens

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\n  x", "aaaaaaaa" * 9, "a" * 30_000, " " * 30_000 + "b", "it's 'll  's", "<|endoftext|>x<|endoftext|>",
    "日本語" * 50, "é" * 20 + "🙂🙂", "\x85\xa0\u2028x\x1c y",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def noise(seed, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab '\n1.é🙂<|endoftext|>") for _ in range(200)) for _ in range(n)]


def test_counts_equal_the_library(library):
    texts = ODD + noise(1)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_texts(texts, tokens.merge_table(), {}) == want


def test_count_query_on_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op5_token_counts"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_encoding_query_on_the_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = bpe.encoding()
    for r in queries.QUERIES["op9_byte_level_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_cutting_long_texts_changes_nothing():
    enc = bpe.encoding()
    for text in ODD + noise(2):
        assert bpe.encode_text(enc, text, cut_chars=17) == enc.encode_ordinary(text)
        assert "".join(bpe.pieces(text, 17)) == text


def test_awkward_rows(awkward, nothing):
    counted = tokens.count(awkward)
    assert set(awkward.columns) | {"n_bytes", "n_tokens", "over_limit"} == set(counted.columns)
    by_id = {r.doc_id: r for r in counted.collect()}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0 and by_id[4].over_limit
    coded = bpe.with_tokens(awkward)
    assert coded.count() == 8 and coded.where("round_trip").count() == 8
    assert tokens.count(nothing).count() == bpe.digests(nothing).count() == 0
