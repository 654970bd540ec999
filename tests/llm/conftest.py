import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(60_000))
GIANT = "ab" * 100_000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "one two three four five six seven eight"), (6, "one two three four five six seven eight"), (7, "ONE two\nthree four five six seven  eight"),
    (8, "repeated row of a few words, twice"), (8, "repeated row of a few words, twice"), (None, "a text without an id of its own"), (9, LONG), (10, LONG + " end"), (11, GIANT), (12, "日本語 テキスト 😀 \u00e9 mail me@example.com"), (13, "123 456 !!! ???"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns named like results."""
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in (5, None) else f"s{(i or 0) % 3}", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["kept", "component", "component_id", "score", "size", "taken", "row", "a", "b", "id", "band", "h", "word", "spans", "toxicity", "n_tokens", "ids", "mix_copy", "lang_pred", "hub", "with"]
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in clash))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
