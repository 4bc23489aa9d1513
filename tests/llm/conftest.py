import random

import pytest

random.seed(7)
WORDS = ["the", "of", "Law", "and", "naïve", "mit", "license", "under", "tea", "x1", "***", "Ärger", "|", "co-op"]


def odd_texts():
    """Nulls, empty and blank texts, odd characters, a very long text, ties and repeats."""
    base = " ".join(random.choices(WORDS, k=60))
    near = base.split(" ")
    near[30] = "changed"
    return [
        None, "", " ", "\n\t \r\n", "a", "a b", "A  B\n c", base, base, base.upper(), " ".join(near), base + " tail", "日本語 テスト 日本語", "é    x",
        "<|endoftext|> a <|endoftext|>", " leading", "trailing ", "tab\tand\nline", "x" * 3000, "\x00 nul \x1c", " ".join(random.choices(WORDS, k=20000)),
        "Released under the MIT License. Apache License, Version 2.0; CC-BY-NC cc by nc 4.0", "émit under the mit licenses", "the the the the the the the the the the the the",
        "one line\none line\n\none line\nother " * 4,
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3, t, ("en", "fr")[i % 2], "s", i, "n", 1.5) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string, score double")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
