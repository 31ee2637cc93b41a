import os
import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")

TEXTS = [
    None, "", " ", "   \t\n  ", "a", "Hello  world!!  ", "it's we'll I'VE 'tis", "<|endoftext|> x <|endoftext|>", "日本語のテキスト、そして１２３", "👩‍🔧👨‍👩‍👧 é é ẹ́̂", "  　x\u0085y\x1cz\x0bq",
    "مرحبا بالعالم नमस्ते ท่า", "x" * 3000, "ab" * 700 + " " * 300, "0123456789" * 120, "\x00\x07�", "a\r\n\r\n   b", "ſ K ﬂ ½ ² Ⅳ ٣", "don''t''s 's's", "…—–!?" * 90,
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"ids": F.lit(1), "word": F.lit("w"), "salt": F.lit(3), "pos": F.lit(0)})


def test_texts_of_all_kinds(spark, reference):
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs(spark, TEXTS)).collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == []


def test_random_bytes_of_words(spark, reference):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab eé-日1'\n.T ") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(60)]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs(spark, texts)).collect()}
    wrong = [i for i, t in enumerate(texts) if got[i] != reference(t) and not _newer_than_the_jvm(t)]
    assert wrong == []


def _newer_than_the_jvm(text):
    """Characters whose category this JVM does not know yet."""
    import unicodedata

    return any(unicodedata.category(c) == "Cn" for c in text)


def test_the_heap_and_the_fold_agree(spark):
    ranks = bpe.load_ranks()
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 60))).encode() for _ in range(200)] + [b"a" * 37, bytes(range(256)), b"ab" * 400, "日本語".encode() * 50, b"=" * 2000, b"x" * 61, b"y" * 60]
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "i int, w binary")
    folded = {r.i: list(r.ids) for r in df.select("i", bpe.fold_ids(F.col("w"), bpe.rank_literal(bpe.VOCABULARY)).alias("ids")).collect()}
    assert folded == {i: bpe.heap_ids(w, ranks) for i, w in enumerate(words)}


def test_round_trip_counts_and_hot_words(spark):
    texts = TEXTS + [" the" * 2000] * 5 + ["the " * 10] * 400
    df = docs(spark, texts)
    back = bpe.decode(bpe.encode(df, frequent=3))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    full = {r.doc_id: len(r.ids) for r in bpe.encode(df).collect()}
    assert sizes == {i: n for i, n in full.items() if n}


def test_empty_table_and_null_ids(spark):
    assert bpe.encode(docs(spark, []).limit(0)).collect() == []
    rows = [(None, None), (5, "x"), (5, "x"), (6, "zqx zqx"), (6, "zqx zqx"), (7, "x"), (7, "qzy")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, bytes(b for i in r.ids for b in {v: k for k, v in bpe.load_ranks().items()}[i]).decode()) for r in bpe.encode(df).collect())
    assert got == [(0, ""), (5, "x"), (6, "zqx zqx"), (7, "qzy"), (7, "x")]


def test_every_piece_merges_to_itself():
    ranks = bpe.load_ranks()
    assert all(bpe.heap_ids(piece, ranks) == [rank] for piece, rank in ranks.items())
