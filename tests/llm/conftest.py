import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, rank long, in_0 int, shard int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    prose = " ".join(f"the cat{i} of a hat and in to is that{i % 7}" for i in range(30))
    texts = [
        (1, prose), (2, prose), (2, prose), (3, ""), (4, None), (None, prose + " x"), (None, None),
        (5, "word " * 40_000), (6, "a@b.co and +1 (555) 555-0100, 10.0.0.1 \U0001f600 4111 1111 1111 1111"),
        (7, 'token = "0123456789abcdef0123456789abcdef" \n\n\t x'), (8, "###$$$ &&& ||| " * 60), (9, "x" * 50_000),
        (10, "Éa éb"), (11, " \t\n "), (12, prose.upper()), (12, "another text with the same id"),
    ]
    rows = [
        (d, t, (None, "en", "fr", "xx")[i % 4], (None, "s0", "s1")[i % 3], None if t is None else len(t), "f", None, i, i, 99)
        for i, (d, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
