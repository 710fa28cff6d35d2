from __future__ import annotations

import pytest

DOCS = "doc_id string, repo string, path string, func_name string, code string, language string"
PAGES = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*rows):
        """Rows as (doc_id, path, func_name, code), with more values for repo and language."""
        full = [(r[0], r[4] if len(r) > 4 else "own/proj", r[1], r[2], r[3], r[5] if len(r) > 5 else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """A table with extra columns, some of which clash with names used inside or differ from others by case alone."""

    def make(df):
        from pyspark.sql import functions as F

        for name in ("id", "place", "n", "kind", "cells", "words", "term", "number"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df.select("*", *(F.lit("y").alias(c) for c in ("CODE", "TEXT", "Node_Key", "doc_ID") if c.lower() in df.columns))

    return make
