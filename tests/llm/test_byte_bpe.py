import base64
import hashlib

import numpy as np
import pytest

from codelattice.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", "hello  world\n\n  x", "naïve 𝔘nicode '’s don't", "a" * 3000, "hello  world\n\n  x", "    tail "]


def test_matches_tiktoken(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = known.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
