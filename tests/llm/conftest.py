import pytest

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
SHARED = "  Shared LINE of all\t"


def text_rows():
    """Documents with nulls in each column, empty and long texts, repeated rows and repeated ids."""
    rows = [
        (1, "Alpha beta gamma delta. " * 8 + "\n" + SHARED + "\nend one", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", "fr", "b", 0),
        (4, LONG, "de", None, 5),
        (5, "word", None, "b", 4),
        (None, "no id here but text\nshared line of all", "en", "c", 1),
        (6, " \n\t\n ", "en", "a", 3),
        (7, "%%% ### 123", "fr", "a", 3),
        (8, "Elle est le petit chat noir dans la maison.\n" + SHARED, "fr", "a", 3),
        (8, "another text under the same id", "en", "a", 3),
        (9, "repeated row of some words here", "en", "b", 1),
        (9, "repeated row of some words here", "en", "b", 1),
    ]
    rows += [(20 + k, f"number {k} of many copies\nShared line of all\nunique {k}", "en", "hot", 9) for k in range(14)]
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside or return.
CLASHING = "piece size taken h1 key pos part length _rank text_key label kept lang_pred n_lines drop_map target words sequence_id start print root component_id".split()


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(text_rows(), COLUMNS)
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
