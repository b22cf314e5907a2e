import pytest

# null text, null ids, empty, no letters, one word, repeated rows, copies, ties, a long text, and columns named like outputs
LONG = "the quick brown fox jumps over the lazy dog near an old stone bridge. " * 3000
PASSAGE = " ".join(f"common{i} passage{i * 7 % 13} words" for i in range(30)) + "."
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line here. And more!", "en", "s0", 20, 5.0),
    (2, None, None, None, None, None),
    (3, "", "en", "s0", 0, 1.0),
    (4, "12345 678 ---", "fr", None, 13, 1.0),
    (5, LONG, "en", "s0", len(LONG), 1.0),
    (6, "mot", "fr", "s1", 3, None),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line here. And more!", None, "s0", 20, 5.0),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line here. And more!", None, "s0", 20, 5.0),
    (None, "ohne nummer und ohne namen", "de", "s1", 26, 1.0),
    (9, "café 漢字 \U0001f600 naïve – “quoted” wide space\t tab\r\n<|endoftext|> end  ", "fr", "s2", 40, 2.0),
    (10, "un deux\n" + PASSAGE + "\ntrois quatre", "fr", "s1", 10, 1.0),
    (11, "ein zwei\n" + PASSAGE + "\ndrei vier", "de", "s1", 10, 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("score", "rate").selectExpr("*", "'x' as spans", "1 as ids", "2 as class_id", "3 as lang_pred", "4 as start").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def rows():
    return ROWS
