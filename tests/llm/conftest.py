import pytest

LONG = "langer text ohne ende und kein punkt " * 9000

#: doc_id, text, lang, source: nulls, empty, white space, short, copies, near copies, a long one, a repeated row, emoji.
ROWS = [
    (0, None, None, None),
    (1, "", "en", "a"),
    (2, " \t\n ", "en", "a"),
    (3, "one", "en", "b"),
    (4, "one two three", "en", "b"),
    (5, "One  two\nthree", "de", None),
    (6, "the quick brown fox jumps over the lazy dog and then the cat sleeps all day long in the sun", "en", "a"),
    (7, "The quick brown fox jumps over the lazy dog and then the cat sleeps all day long in the sun", "en", "a"),
    (8, "the quick brown fox jumps over the lazy dog and then the cat sleeps all day long in the rain", "en", "b"),
    (9, "der schnelle braune fuchs springt über den faulen hund und die katze schläft", "de", "b"),
    (10, LONG, "de", "c"),
    (11, LONG + "doch", "de", "c"),
    (12, "😀 é à mail bob@example.com ip 10.0.0.1 card 4111 1111 1111 1111 call +1 (310) 555-4510", None, "c"),
    (13, "12345 67890 !!! ???", None, "c"),
    (14, "repeat row here for you now", "en", "a"),
    (14, "repeat row here for you now", "en", "a"),
    (15, " ", None, "b"),
    (None, "no id at all", "en", "a"),
]
#: Names that the operators use inside.
CLASH = ["size", "rank", "_salt", "key", "cls", "n", "label", "_bucket", "recipe", "ids", "n_tokens", "decoded", "_copy", "_copies", "_kept_id", "_lang_pred", "fingerprint", "shard"]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name in CLASH:
        d = d.withColumn(name, F.lit(f"own {name}"))
    return d


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
