import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows and extra columns of clashing names."""
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    near = base.replace("alpha3 ", "gamma ")
    rows = [
        (1, base, "en", "s"), (2, base, "en", None), (3, near, None, "s"), (4, None, "en", "s"), (5, "", "de", "s"), (6, " \t\n", None, None), (7, "one", "en", "s"),
        (8, LONG, "en", "t"), (9, base + " tail words here", "en", "s"), (7, "one", "en", "s"), (None, base, "en", "s"), (10, "Ünïcödé ₤ 日本 \U0001f600 " * 30, "fr", "s"),
    ]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return made.selectExpr("*", "1 _salt", "'x' spans", "2 bucket", "3 n", "'y' rep", "'z' marks", "4 n_words", "5 kept")
