import pytest
import public_tokenizers

#: Rows that every operator must take: nulls in any column, empty and odd texts, repeated rows, and columns whose names clash.
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, " ".join(WORDS[:120]), "en", "src1", 5),
        (1, " ".join(WORDS[:120]), "en", "src1", 5),
        (2, None, None, None, None),
        (3, "", "en", "src1", 0),
        (None, "a text without id " * 20, "de", None, 3),
        (4, "!!! ??? ...", None, "x", 1),
        (5, "word", "de", "x", 1),
        (6, " ".join(WORDS[:119]) + " other", "en", "src2", 5),
        (7, "\x01\x02 \x00 tab\tnul 😀 é ß ' <|endoftext|> 中文", "fr", "s", 9),
        (8, "x" * 5000 + " " + "ab cd. " * 3000, "fr", "s", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that operators use inside
    clash = {c: df.n_chars for c in ("id", "row", "key", "n", "sig", "node", "words", "score", "start", "length", "value", "findings", "h", "x")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
