"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakemill.llm import bpe, queries


@pytest.fixture(scope="module")
def model():
    with open(bpe.default_tokenizer(), "rb") as f:
        return bpe.codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_joins_are_exact(model, library):
    """Random texts of awkward pieces, cut anywhere, with a window that starts at two tokens."""
    pieces = ["a", "b", "e", "th", "ing", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "22", "!", "..", "é", "日本", "🙂", "<|endoftext|>", "<|", "|>", "　", "́", "aaaa", "zq", "THE", " the", "..."]
    rng = random.Random(5)
    for _ in range(600):
        some = rng.sample(pieces, rng.choice([1, 2, 3, len(pieces)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(2, 500)))
        at = rng.randint(1, len(text) - 1) if len(text) > 1 else 1
        a, b = text[:at], text[at:]
        got = model.join(a.encode(), np.array(model.encode(a), np.uint32), b.encode(), np.array(model.encode(b), np.uint32), window=2)
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tree_over_one_unsplit_run(model, library):
    text = "ab" * 3000 + "abc" * 2000
    leaves = [text[i : i + 700] for i in range(0, len(text), 700)]
    assert model.tree([(x.encode(), np.array(model.encode(x), np.uint32)) for x in leaves]).tolist() == library.encode(text, add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(awkward, library):
    got = bpe.round_trip(awkward).collect()
    want = [(r["doc_id"], *expected(library, r["text"])) for r in awkward.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_round_trip_is_encode_then_decode(awkward):
    from pyspark.sql import functions as F

    both = bpe.decode(bpe.encode(awkward, leaf_chars=1000)).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256))
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, bpe.round_trip(awkward, leaf_chars=1000).collect()), key=repr)


def test_leaves_in_parallel(documents, library):
    got = {r["doc_id"]: bpe.unpack(r["ids"]).tolist() for r in bpe.encode(documents, leaf_chars=500).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]] == library.encode(r["text"], add_special_tokens=False).ids


def test_query(spark, data, documents, library):
    rows = {r["doc_id"]: tuple(r)[1:4] for r in queries.op1_bpe(spark, data).collect()}
    assert rows == {r["doc_id"]: expected(library, r["text"]) for r in documents.collect()}


def test_empty(empty):
    assert bpe.round_trip(empty).count() == 0


def test_decode_of_broken_bytes(model, library):
    ids = [model.encode("é")[0], 220, 50256]
    parts = [i for i, x in enumerate(model.parts) if x == b"\xc3"] + ids
    assert model.decode(parts) == library.decode(parts, skip_special_tokens=False)
