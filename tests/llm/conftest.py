from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, one word, repeated, very long and non-ASCII texts."""
    return [None, "", "  \n ", "word", "word", words(300, 1), words(300, 1), words(20_000, 2), "héé ünï 漢字 😀 " * 30, "x" * 5000, "\u0000 nul and \r\n lines \x1c end"]


def frame(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    # Extra columns with names that operators use inside.
    return spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], DOCS + ", size long, id string")


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return frame(spark, odd_texts()).cache()


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [])
