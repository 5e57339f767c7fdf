"""Builders of small document tables."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, uid string, n long, _uid string, band long, k long"


def words(seed: int, n: int, pool: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def frame(spark, texts, first: int = 0, langs=None):
    """Documents with columns whose names the operators use inside, and some of them null."""
    rows = [(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, langs[i] if langs else None, None, None, "x", "u", 3, None, 5, None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
