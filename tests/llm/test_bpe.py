import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from linework.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def encoded(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.ids for r in bpe.bpe_encode(docs, PATH, P.PATTERN).orderBy("doc_id").collect()]


def test_random_words_equal_the_library(spark, library):
    rng = random.Random(1)
    alphabet = ["a", "th", "e", "  ", "\n", "é", "ß", "ing", "漢", "1", "22", "'s", "!", "\t", "🙂", "aaaa", "Ω"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "<|endoftext|>", ""]
    assert encoded(spark, texts) == [library.encode_ordinary(t) for t in texts]


def test_small_blocks_and_batches(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20)
    monkeypatch.setattr(bpe, "BATCH_BYTES", 10)
    texts = ["one two three four five", "six zwölfzig seven", "", "one zzzqqq", None, "zzzqqq zzzqqq"]
    assert encoded(spark, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_words_of_a_million_bytes_take_seconds(spark, library):
    rng = random.Random(3)
    long = ["a" * 1_000_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(333_000)), " " * 1_000_000]
    vocabulary = bpe.Vocabulary(bpe.load_ranks(PATH))
    for text in long:
        began = time.perf_counter()
        ids, sizes = bpe.replay([text.encode()], vocabulary)
        assert time.perf_counter() - began < 15
        assert ids.tolist() == bpe.by_heap(text.encode(), vocabulary) == library._core_bpe.encode_single_piece(text.encode())
    piece = library._core_bpe.encode_single_piece  # the library's own pattern can't take such texts
    assert encoded(spark, long) == [[i for w in regex.findall(P.PATTERN, t) for i in piece(w.encode())] for t in long]


def test_a_vocabulary_whose_merges_are_out_of_order():
    ranks = {bytes([i]): 100 + i for i in range(256)} | {b"ab": 50, b"abc": 10, b"bc": 60, b"cab": 5, b"aa": 7, b"aaa": 6}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(2, 14))) for _ in range(2000)] + ["".join(rng.choices("abc", k=5000)) for _ in range(3)]
    words = [w for w in words if w.encode() not in ranks]
    ids, sizes = bpe.replay([w.encode() for w in words], bpe.Vocabulary(ranks))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(w) for w in words]


def test_query_on_documents(spark, library):
    rows = bpe.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_blocks_and_other_columns(spark, library, monkeypatch):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "hello  world", "y"), (3, "hello  world", "y")], "doc_id long, text string, bytes_ string")
    both = bpe.bpe_decode(bpe.bpe_encode(docs, PATH, P.PATTERN), PATH)
    assert [(r.doc_id, r.bytes_, r.ids, bytes(r.bytes)) for r in both.orderBy("doc_id").collect()] == [
        (1, "x", [], b""), (2, None, [], b""), *[(3, "y", library.encode_ordinary("hello  world"), b"hello  world")] * 2]
    assert bpe.bpe_decode(bpe.bpe_encode(docs.limit(0), PATH, P.PATTERN), PATH).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, ids string, bytes int")
    row = bpe.bpe_decode(bpe.bpe_encode(docs, PATH, P.PATTERN), PATH).first()
    assert (row.doc_id, bytes(row.bytes)) == (1, b"a b") and len(row.ids) == 2
