import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    parts = "ka lo mi re tu san ver dol ith ang bre cor nim pel qua".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows."""
    rng = random.Random(3)
    base = words(rng, 400)
    lines = [words(rng, 6) for _ in range(5)]
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " end", None, None, None), (4, "", "en", "a", 0), (5, None, "de", "a", None),
        (6, "  \n\t\n ", "de", None, 5), (7, "one", "en", "a", 3), (8, "One", "en", "a", 3), (9, "\n".join(lines), "en", "a", 1),
        (10, "\n".join([lines[0].upper(), "short", "  " + lines[1] + " ", ""]), "en", "a", 1), (11, "\n".join([*lines, *lines]), "en", "a", 1),
        (12, words(rng, 30000), "en", "a", 1), (13, "x" * 70000, "en", "a", 1), (14, "Ünïcödé 漢字 \U0001f600 " * 30, "en", "a", 1),
        (14, "Ünïcödé 漢字 \U0001f600 " * 30, "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None),
        *((100 + k, words(rng, 60), "en", "b", 1) for k in range(40)),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a table, with extra columns named like those the operators make."""
    extra = [(*r, 0.5, "x", 7, "k", True) for r in odd_rows]
    return spark.createDataFrame(extra, DOCS + ", score double, fp string, n_lines long, kept_text string, ids boolean").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
