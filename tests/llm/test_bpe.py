import hashlib
import random

import pytest

pytest.importorskip("kindred.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from kindred.llm import bpe, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n\n x", "aaaaaaaaaaaaa", "a<|endoftext|> b<|endoftext|>", "<|endoftext|>", "don't we'll  go \x1c\x1f\x85 　x",
    "naïve café 東京 🙂🙂 ‍", "x" * 5000, "ab" * 3000 + " " * 300, "1234567890½²", "\t\r\n  ends  ", "'S 'll's", "﻿é́",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def unpack(b):
    return [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)]


def test_same_ids_as_the_library(vocabulary):
    rnd = random.Random(3)
    alphabet = "aeiouthnrs  .,'\n\té中🙂0159-_\x1d "
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(300)]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [unpack(b) for b in bpe.encode_texts(texts, vocabulary)] == want
    assert [bpe.decode_ids(b, vocabulary) for b in bpe.encode_texts(texts, vocabulary)] == texts


def test_every_code_point(vocabulary):
    library = Tokenizer.from_file(PATH)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    wrong = []
    for k, (t, b) in enumerate(zip(texts, bpe.encode_texts(texts, vocabulary), strict=True)):
        if unpack(b) != library.encode(t, add_special_tokens=False).ids:
            wrong += [c for c in points[k * 2000 : k * 2000 + 2000] if unpack(bpe.encode_texts([f"a{chr(c)}b {chr(c)} 1{chr(c)}"], vocabulary)[0]) != library.encode(f"a{chr(c)}b {chr(c)} 1{chr(c)}", add_special_tokens=False).ids]
    assert [hex(c) for c in wrong] == []


def test_columns_nulls_and_empty_tables(spark, vocabulary):
    shared = bpe.share(spark, vocabulary)
    rows = [(1, None, "old"), (2, "a b", "x"), (2, "a b", "x"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, shared), shared)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got.collect()) == [("1", 0, ""), ("2", 2, "a b"), ("2", 2, "a b"), ("None", 0, "")]
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    assert bpe.encode(df.filter(F.lit(False)), shared).collect() == []


def test_latin_texts_split_like_all_others():
    texts = ["".join(f"a{chr(c)}b {chr(c)}  {chr(d)}1{chr(c)}" for c in range(256)) for d in range(0, 256, 5)] + [f" {chr(c)}{chr(d)} " for c in range(256) for d in range(256)]
    assert all(bpe.split(t) == bpe.PIECES.findall(t) for t in texts)


def test_pieces_of_earlier_chunks_are_kept_or_forgotten(vocabulary, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma" * 3, "δέλτα", "<|endoftext|>"]) for _ in range(rnd.randrange(30))) for _ in range(200)]
    want = bpe.encode_texts(texts, vocabulary)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 90)
    assert bpe.encode_texts(texts, vocabulary) == want
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    assert bpe.encode_texts(texts, vocabulary) == want


def test_query_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        packed = b"".join(k.to_bytes(4, "little") for k in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
