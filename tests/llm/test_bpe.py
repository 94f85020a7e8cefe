import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.bpe import bpe_decode, bpe_encode, codec, from_piece, op4_byte_bpe, production, read_ranks, to_piece

PATH, PATTERN = production()
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def check(texts):
    own = codec(PATH, PATTERN)
    for text, packed in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == ORACLE.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    check(texts)


def test_words_runs_and_scripts(spark):
    rng = random.Random(1)
    letters = "aeéßñ  \n\t'sS ▁Ġ日本語🙂0123,.!$"
    check(["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)])
    check([" " * 3000, "a" * 3000, "é" * 2000, "<|endoftext|>", "", "don't  we'LL"])
    assert from_piece(to_piece(bytes(range(256)))) == bytes(range(256))


def test_query_over_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "Hello  wörld"), (3, "Hello  wörld"), (None, "x"), (5, "mot clé\n" * 20000)]
    docs = spark.createDataFrame([(a, b, 7, "z") for a, b in rows], "doc_id long, text string, n_tokens long, ids string").repartition(3)
    encoded = bpe_encode(docs, PATH, PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in bpe_decode(encoded, PATH, PATTERN).collect()) == sorted((a or 0, b or "") for a, b in rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_byte_bpe(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        ids = ORACLE.encode_ordinary(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_encode(docs.limit(0), PATH, PATTERN).collect() == []
    assert public_tokenizers.PATTERN == PATTERN
