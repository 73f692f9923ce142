import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts; ids may be given."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS).repartition(2)

    return make


@pytest.fixture
def words():
    """Seeded sentences of distinct words."""

    def make(seed, n=60, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make
