import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) or (id, text, lang) rows, with two columns of clashing names."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "a", len(r[1] or ""), 7, "x") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, hash int, key string"
        )

    return build
