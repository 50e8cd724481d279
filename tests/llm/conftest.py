from __future__ import annotations

import pytest

from tests.conftest import spark  # noqa: F401

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):  # noqa: F811
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
        (2, "first line\nAlpha  beta gamma delta epsilon zeta eta theta iota kappa lambda\nlast line", "en", "b", 1),
        (3, "", "de", "b", 0), (4, None, None, None, None), (None, "no id here", "fr", "a", 5),
        (None, None, None, None, None), (5, LONG, "en", "a", 9), (6, LONG + " more", None, "c", 9),
        (7, " \t\n ", "de", "", 4), (8, "ÉTÉ ß \x1f x y\n\n\nz  w", "fr", "a", 3), (9, "x", "de", "z", 1),
        (None, "another text without an id, of other words", "fr", "c", 7),
    ]
    extra = spark.createDataFrame([(*r, i, -1, "e") for i, r in enumerate(rows)], DOCS + ", row int, start int, `odd name.x` string")
    return extra.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):  # noqa: F811
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
