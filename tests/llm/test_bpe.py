import hashlib
import random

import public_tokenizers as P
import pytest

from corpusmill.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(FILE, P.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 5, 17])
def test_any_tree_gives_the_same_ids(encoder, leaf):
    rng = random.Random(leaf)
    for n in range(400):
        text = "".join(rng.choice("abc  \n'sdlvrem 12é!?\t　漢字") for _ in range(rng.randrange(120)))
        ids = encoder.encode_ordinary(text)
        assert bpe.encode_tree(text, encoder.encode_ordinary, leaf, 1 + n % 5) == ids
        assert bpe.decode_tree(ids, encoder.decode_bytes, leaf) == text.encode()


def test_documents(spark, encoder, awkward):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(awkward)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in bpe.encode_documents(df, FILE, P.PATTERN, keep_ids=True, leaf=64).collect()}
    for i, t in enumerate(awkward):
        ids = encoder.encode_ordinary(t or "")
        assert list(rows[i]["ids"]) == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert rows[None]["n_tokens"] > 0 and bpe.encode_documents(df.limit(0), FILE, P.PATTERN).count() == 0
