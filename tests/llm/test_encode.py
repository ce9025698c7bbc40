import random

import numpy as np
from tokenizers import Tokenizer

from lectern.llm.encode import TOKENIZERS, Bpe, encode_texts

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
TEXTS = ["", None, " ", "   ", "hello  world", "it's we'll\n\n x", "\r\n a \t b", "<|endoftext|>", "naïve 日本語 ไทย مرحبا", "a" * 3000, "x" * 50 + " " * 40, " end ", "1234567 3.14", "a b  c", "\x00 nul \x00", "👍🏽 ok"]


def test_like_the_library(spark):
    r = random.Random(1)
    alphabet = "abcde  \n\t'-.é日กا12" + chr(0xA0)
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "ids_of")
    got = {x["ids_of"]: x.ids for x in encode_texts(df, "ids_of").collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_failing_words_are_merged():
    b = Bpe(PATH)
    ids, ends = b.encode(["согласно протоколу хранитель фонда опечатала сводную записку", None])
    assert ends.tolist() == [0, len(ids), len(ids)]
    assert b.failed > 0


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0


def test_dense_counts_in_several_levels(spark, monkeypatch):
    from lectern.llm import text

    df = spark.range(1000).repartition(9)
    count = lambda b: [b.column(0).to_numpy() % 40_000 * 31 % 40_000]
    want = np.bincount(np.arange(1000) * 31 % 40_000, minlength=40_000)
    assert (text.dense_counts(df, 40_000, count) == want).all()
    monkeypatch.setattr(text, "FAN_IN", 2)
    assert (text.dense_counts(df, 40_000, count) == want).all()
    assert not text.dense_counts(df.limit(0), 40_000, count).any()
