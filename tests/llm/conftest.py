import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int, size: int = 3000) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def table(spark, texts, first: int = 1, extra: str = ""):
    """Documents from texts (or (doc_id, text) pairs)."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, "alpha beta gamma delta " * 30), (1, "alpha beta gamma delta " * 30), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, "x" * 200_000), (5, "the same word " * 20_000), (6, "..., !!! ???"), (7, "é" * 3000), (8, "short"), (8, "another text of the same id")]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = table(spark, ODD)
    clash = {c: F.lit("clash") for c in ("k", "h", "pos", "start", "end", "keep", "rule", "shard", "g", "o", "n", "code", "body", "id", "a", "b", "marks", "cuts", "places", "size", "n_words", "node", "component", "_k", "_id")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
