"""Every core query against its SQL, over the smallest tables."""

from __future__ import annotations

import math
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from codelattice.plans import catalogue

AT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not AT.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in AT.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(AT))
    expected = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted(str(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(_norm(r[i]) for i in at)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, str(AT)).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_python_rows_are_told_by_label_or_path(spark, tmp_path):
    labels = ["python", "PYTHON", " Python", "python\t", "py", "java", "", None, "text"]
    rows = [(f"{i}{j}", "r", path, "from os import path\n", label) for i, label in enumerate(labels) for j, path in enumerate(["a/b.py", "a/B.PYW", "a/b.js", "a.py/b", "py", None])]
    spark.createDataFrame(rows, "doc_id string, repo string, path string, code string, language string").write.parquet(str(tmp_path / "docs.parquet"))
    named = {"python", "PYTHON", " Python", "python\t", "py"}
    want = {r[0] for r in rows if r[4] in named or r[4] != "java" and r[2] in ("a/b.py", "a/B.PYW")}
    assert {r["doc_id"] for r in catalogue.queries()["syntax_check"](spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"] for r in catalogue.queries()["import_categories"](spark, str(tmp_path)).collect()} == want


def test_tokens_of_every_document_like_brute_force(spark, tmp_path):
    texts = ["", "a b", "naïve, Straße!", "x_1+y\u00a0z", "tab\tand\x0bline\r\n", "... ¿qué? 日本", "w " * 200, "w " * 201, None]
    rows = [(i, text, lang) for i, (text, lang) in enumerate((t, g) for t in texts for g in ("en", "xx", None))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    count = lambda t: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]", t))
    want = {(i, count(t), count(t) <= 200) for i, t, _ in rows if t is not None}
    assert {tuple(r) for r in catalogue.queries()["token_budget_fit"](spark, str(tmp_path)).collect()} == want
