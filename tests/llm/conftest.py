from __future__ import annotations

import random

import pytest

@pytest.fixture
def rng() -> random.Random:
    return random.Random(7)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, source) rows, with a few extra columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows, extra: bool = True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("id", "key", "n", "size", "component", "component_id", "kept", "score", "h", "start", "path", "spans", "digest", "rank", "item_id"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
