"""Token ids against the tokenizers library."""

import random

import pytest

from acequia.llm.encode import Encoder, encode_corpus, load_vocabulary

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_vocabulary(PATH))


def test_texts_of_all_sorts(encoder, reference):
    texts = [" ", "\n\n ", "don't we'll", "naïve café — ½ día", "日本語テスト", "👩‍💻 + ☕", "<|endoftext|>", "a\x85b\xa0c​d　e", "x" * 300, "y" * 100_001, "ab" * 300, "é" * 10]
    assert encoder.encode(texts) == reference(texts)
    assert encoder.encode(texts) == reference(texts)  # from the words met


def test_long_words_without_spaces(encoder, reference):
    random.seed(7)
    texts = ["".join(random.choice("abcdeinorstu") for _ in range(n)) for n in (255, 256, 257, 5000)]
    assert encoder.encode(texts) == reference(texts)


def test_random_code_points(encoder, reference):
    random.seed(6)
    texts = ["".join(chr(random.choice([random.randint(1, 0x2FF), random.randint(0x2000, 0x30FF)])) for _ in range(40)) for _ in range(300)]
    assert encoder.encode(texts) == reference(texts)


def test_corpus_with_empty_null_and_repeated_rows(spark, reference):
    rows = [(1, "Hola mundo"), (2, ""), (3, None), (4, "  "), (1, "Hola mundo"), (5, "largo " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df, PATH).collect())
    assert got == sorted((k, reference([t])[0] if t else []) for k, t in rows)
    assert encode_corpus(df.limit(0), PATH).collect() == []
