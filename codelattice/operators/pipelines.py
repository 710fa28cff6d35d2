"""Whole jobs: building a repository's graph, describing it, answering questions in stages, evaluating completions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import adaptive_k, exploration
from ..providers import Offline, Provider, answered
from ..session import written
from ..sources import readers, sinks
from . import build, enrich, evaluate, mcts, parse, retrieval, traverse
from .cypher import CypherError, run_cypher

#: What models are asked; the question is put after it.
ASK_QUERY = "Write one graph query (MATCH ... RETURN a node as item) that finds the code the question needs.\n\n"
ASK_SPEC = 'Name the code entities the question needs as JSON {"entities": [{"name": ..., "type": ...}], "relationships": [...]}.\n\n'


# ---------------------------------------------------------------- settings and timing


def settings(text: str) -> dict[str, Any]:
    """Settings of nested ``name: value`` lines, deeper ones indented, lists as ``- value`` lines; ``#`` begins a remark."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any]] = [(-1, root)]
    for line in text.split("\n"):
        plain = line.split(" #")[0].rstrip()
        if not plain.strip() or plain.lstrip().startswith("#"):
            continue
        depth, plain = len(plain) - len(plain.lstrip()), plain.strip()
        while stack[-1][0] >= depth:
            stack.pop()
        holder = stack[-1][1]
        if plain.startswith("- "):
            holder.setdefault("items", []).append(_scalar(plain[2:]))
            continue
        name, _, value = plain.partition(":")
        if value.strip():
            holder[name.strip()] = _scalar(value)
        else:
            holder[name.strip()] = {}
            stack.append((depth, holder[name.strip()]))
    return _with_lists(root)


def _scalar(value: str) -> Any:
    value = value.strip()
    try:
        return json.loads(value)
    except ValueError:
        return {"True": True, "False": False, "~": None}.get(value, value.strip("'"))


def _with_lists(x: Any) -> Any:
    if isinstance(x, dict):
        return x["items"] if set(x) == {"items"} and isinstance(x["items"], list) else {k: _with_lists(v) for k, v in x.items()}
    return x


def timed(run: Callable[[], DataFrame]) -> tuple[list, float]:
    """The rows of what ``run`` gives, and the seconds it took from asking to the last row."""
    began = time.perf_counter()
    rows = run().collect()
    return rows, time.perf_counter() - began


# ---------------------------------------------------------------- offline: building and describing graphs


def build_repository(spark: SparkSession, root: str, repo: str, kind: str = "search") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of a source folder, without the imports its requirements file names."""
    file = readers.requirement_file(root.removeprefix("file://"), kind)
    required = readers.requirements(readers.requirement_lines(spark, file, repo)) if file else None
    nodes, edges, errors = parse.raw_records(parse.parse_files(readers.source_files(spark, root, repo), required))
    return *build.build_graph(nodes, edges), errors


def build_repositories(spark: SparkSession, roots: dict[str, str], out: str, kind: str = "search") -> DataFrame:
    """Builds each repository that has no graph in ``out`` yet, one snapshot folder for each; (repo, nodes, edges, errors, seconds)."""
    report = []
    for repo, root in sorted(roots.items()):
        at = f"{out}/{repo.replace('/', '_')}"
        if Path(at.removeprefix("file://")).exists():
            continue
        began = time.perf_counter()
        nodes, edges, errors = build_repository(spark, root, repo, kind)
        sinks.snapshot(nodes, edges, at)
        nodes, edges = sinks.load_snapshot(spark, at)
        report.append((repo, nodes.count(), edges.count(), errors.count(), time.perf_counter() - began))
    return spark.createDataFrame(report, "repo string, nodes bigint, edges bigint, errors bigint, seconds double")


def _set(nodes: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    return written(build.update_nodes(nodes, updates, *columns, keys=("node_id",), scoped=False), "described")


def described_graph(nodes: DataFrame, edges: DataFrame, most_tokens: int = 3000, provider: Provider | None = None) -> DataFrame:
    """Nodes with descriptions and embeddings where they had none: functions, globals, methods and classes that fit the budget from their
    code, larger classes from their methods' descriptions, then modules from those of what they contain."""
    ready, deferred = enrich.leaves(nodes, most_tokens, provider)
    nodes = _set(nodes, ready, "description", "member_descriptions", "embedding")
    nodes = _set(nodes, enrich.class_summaries(nodes, edges, deferred, most_tokens, provider), "description", "embedding")
    waiting = enrich.waiting(nodes, "Module").select("node_id")
    modules = enrich.module_summaries(nodes, edges, most_tokens, provider).join(waiting, "node_id", "left_semi")
    return _set(nodes, modules, "description", "embedding")


# ---------------------------------------------------------------- online: answering a question


def by_query(nodes: DataFrame, edges: DataFrame, question: str, provider: Provider | None = None, k: int = 5) -> DataFrame | None:
    """A model's graph query, run and expanded to what the found nodes contain, the best k by similarity of their code to the question; None
    where it writes no query that can be run or finds nothing."""
    text = (provider or Offline()).answer([ASK_QUERY + question])[0]
    spark = nodes.sparkSession
    query = spark.createDataFrame([(text,)], "a string").select(T.extract_query(F.col("a"))).first()[0]
    try:
        rows = run_cypher(query, nodes, edges)
    except (CypherError, KeyError, ValueError):
        return None
    if not rows.columns:
        return None
    ids = written(rows.select(F.col(f"`{rows.columns[0]}`").cast("string").alias("node_id")).join(nodes.select("node_id"), "node_id", "left_semi").distinct().withColumn("position", F.lit(0)), "answers")
    if ids.isEmpty():
        return None
    found = traverse.expanded(nodes, edges, ids).drop("at")
    return retrieval.rerank(found, F.lit(question), "node_id", k=k, provider=provider)


def by_specification(nodes: DataFrame, edges: DataFrame, question: str, provider: Provider | None = None, limit: int = 8000) -> DataFrame | None:
    """Entities and relationships a model names, looked up, with their neighbours, the most similar first within ``limit`` characters."""
    provider = provider or Offline()
    spec = T.first_json(provider.answer([ASK_SPEC + question])[0])
    if spec is None:
        return None
    seeds = written(traverse.answer_spec(nodes, edges, json.loads(spec)), "seeds")
    if seeds.isEmpty():
        return None
    q = F.array(*(F.lit(float(x)) for x in provider.embed([question])[0]))
    return traverse.ranked_context(nodes, edges, seeds, q, limit).withColumnRenamed("similarity", "score")


def by_search(nodes: DataFrame, edges: DataFrame, question: str, provider: Provider | None = None, iterations: int = 200, k: int = 10) -> DataFrame:
    """The guided search over the graph; the provider scores nodes for the question as the search reaches them."""
    provider = provider or Offline()
    spark = nodes.sparkSession
    q = F.array(*(F.lit(float(x)) for x in provider.embed([question])[0]))
    vectors = nodes.select(F.lit("q").alias("query_id"), "repo", "node_id", retrieval.cosine("embedding", q).alias("similarity"))
    similarity = vectors.withColumn("reward", F.lit(0.0)).withColumn("repo", F.lit("all")).withColumn("similarity", F.greatest("similarity", F.lit(0.0)))
    sizes = nodes.agg(F.count(F.lit(1)).cast("int").alias("size")).withColumn("repo", F.lit("all"))
    texts = nodes.select("node_id", F.lit(question).alias("question"), F.coalesce("description", "code", "name").alias("text"))
    space = mcts.space_of(nodes, traverse.children(nodes, edges), similarity, sizes).join(texts, "node_id")
    row = spark.createDataFrame([(nodes.where("label = 'Module'").count(),)], "m bigint").select(adaptive_k(F.col("m")).alias("k"))
    at = row.select("k", exploration(F.col("k")).alias("c")).first()
    found = mcts.search(space, mcts.Settings(iterations=iterations, k=at["k"], exploration=at["c"], results=k), provider=provider)
    return nodes.join(found.select("node_id", "score", "rank"), "node_id")


def answer(nodes: DataFrame, edges: DataFrame, question: str, provider: Provider | None = None, k: int = 5) -> tuple[str, DataFrame]:
    """The stage that answered, and its nodes: a graph query first, then entities by name, then the guided search."""
    for stage, rows in (("query", by_query(nodes, edges, question, provider, k)), ("specification", by_specification(nodes, edges, question, provider))):
        if rows is not None:
            rows = written(rows, "answer")
            if not rows.isEmpty():
                return stage, rows
    return "search", by_search(nodes, edges, question, provider, k=k)


# ---------------------------------------------------------------- completions


def completed(tasks: DataFrame, graph: DataFrame, chunks: DataFrame, mode: str = "hybrid", budget: int = 4000, most_tokens: int = 6000, provider: Provider | None = None) -> DataFrame:
    """tasks(query_id, repo, prompt, groundtruth) with ``predicted``, exact_match and edit_similarity.

    graph and chunks (query_id, position, text) are what retrieval found for the tasks; ``mode`` takes either or both.  They are packed within
    the budget and put before the prompt, which is shortened to ``most_tokens``; of the answer the shortest part that parses counts.
    """
    empty = lambda df: df.where("false")
    packed = retrieval.packed_context(graph if mode != "bm25" else empty(graph), chunks if mode != "graph" else empty(chunks), budget=budget)
    order = F.array_sort(F.collect_list(F.struct((F.col("source") != "graph").alias("late"), "position", "text")))
    context = packed.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n").alias("context"))
    asked = tasks.join(context, "query_id", "left").withColumn("asked", T.shorten_prompt(F.concat_ws("\n", "context", "prompt"), most_tokens))
    told = asked.withColumn("predicted", T.complete(F.col("prompt"), answered(F.col("asked"), provider)))
    return evaluate.completions(told.drop("context", "asked"))


def summary_of(results: list[DataFrame], metric: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Consolidated per-repository results of several runs (a repository's last run counts), and the n best by a metric."""
    numbered = reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(results)])
    rest = [c for c in numbered.columns if c not in ("repo", "run")]
    every = numbered.groupBy("repo").agg(F.max_by(F.struct(*rest), "run").alias("x")).select("repo", "x.*")
    return every, sinks.top_repos(every, metric, n)
