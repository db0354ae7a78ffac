import random

import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stratafin.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def brute():
    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_random_texts_match_and_round_trip(enc, brute):
    rnd = random.Random(5)
    for _ in range(3000):
        s = "".join(rnd.choice("abcеёщ  \n\t'sтll re09½²\xa0日本😀éaaaaa,.—\x1c​") for _ in range(rnd.randint(0, 30)))
        assert enc.encode(s) == brute(s)
        assert enc.decode(enc.encode(s)) == s


def test_long_and_special(enc, brute):
    for s in ("<|endoftext|> a", " " * 5000, "щ" * 5000, "1" * 3000 + " x"):
        assert enc.encode(s) == brute(s)
    assert enc.count("a b") == 2 and enc.count(None) == 0


def test_utf8_machine_replaces_malformed():
    m = bpe.Utf8Machine()
    assert m.feed(b"\xd0") == "" and m.feed(b"\x90a\xff") == "Аa�"
    assert m.feed(b"\xe2\x82") == "" and m.finish() == "�"


def test_frame(spark, enc):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "Выручка 10", "x"), (4, "Выручка 10", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect())
    assert got == [(1, []), (2, []), (3, enc.encode("  ")), (4, enc.encode("Выручка 10")), (4, enc.encode("Выручка 10"))]
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {1: "", 2: "", 3: "  ", 4: "Выручка 10"}
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert n[1] == 0 and n[4] == len(enc.encode("Выручка 10"))
    assert bpe.encode_documents(spark.createDataFrame([], df.schema)).count() == 0
    assert isinstance(bpe.encode_documents(df).schema["ids"].dataType, T.ArrayType)
