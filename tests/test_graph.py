"""Parsing, building, stitching and walking small graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codelattice.model import EDGES, NODES, conform
from codelattice.operators import build, cypher, mcts, parse, pattern, traverse
from codelattice.operators.components import components

BASE = 'LIMIT = 3\n\nclass Base:\n    def run(self):\n        self.size = LIMIT\n        return helper(self.size)\n\n    def stop(self):\n        pass\n\ndef helper(x):\n    return helper(x - 1) if x else LIMIT\n'
EXTENDED = 'import os\nfrom base import Base, helper as h\nfrom base import LIMIT\n\nclass Extended(Base):\n    def run(self):\n        return h(LIMIT)\n\nif __name__ == "__main__":\n    Extended().run()\n'


def _files(spark, **content):
    rows = [("r", k.replace("__", "/") + ".py" if not k.endswith("init") else k[:-5].rstrip("_") + "/__init__.py", v, i) for i, (k, v) in enumerate(content.items())]
    return spark.createDataFrame(rows, "repo string, path string, content string, file_ord int")


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges, errors = parse.raw_records(parse.parse_files(_files(spark, base=BASE, extended=EXTENDED, broken="def f(:\n")))
    assert [r["path"] for r in errors.collect()] == ["broken.py"]
    n, e = build.build_graph(nodes, edges)
    return n.cache(), e.cache()


def _names(nodes, edges, kind):
    n = {r["node_id"]: r["name"] for r in nodes.collect()}
    return {(n[r["src"]], n[r["dst"]]) for r in edges.where(F.col("type") == kind).collect()}


def test_two_files_are_stitched(graph):
    nodes, edges = graph
    assert ("Extended", "Base") in _names(nodes, edges, "INHERITS")
    uses = _names(nodes, edges, "USES")
    assert {("run", "helper"), ("run", "LIMIT"), ("__main__", "Extended")} <= uses
    assert ("Base", "run") in _names(nodes, edges, "HAS_METHOD")
    assert {("base", "Base"), ("base", "helper"), ("base", "LIMIT"), ("extended", "Extended"), ("r", "base")} <= _names(nodes, edges, "CONTAINS")


def test_finished_graph_has_no_leftovers(graph):
    nodes, edges = graph
    assert nodes.where("label IN ('Import', 'Field')").count() == 0
    assert edges.where("src = dst").count() == 0
    assert nodes.count() == nodes.select("node_id").distinct().count()
    assert edges.count() == edges.select("src", "dst", "type").distinct().count()


def test_reexport_resolves_through_the_package(spark):
    files = spark.createDataFrame(
        [("r", "pkg/__init__.py", "from pkg.core import Thing\n", 0), ("r", "pkg/core.py", "class Thing:\n    pass\n", 1), ("r", "use.py", "from pkg import Thing\n\ndef make():\n    return Thing()\n", 2), ("r", "whole.py", "import pkg.core\n\ndef f():\n    return pkg\n", 3)],
        "repo string, path string, content string, file_ord int",
    )
    nodes, edges = build.build_graph(*parse.raw_records(parse.parse_files(files))[:2])
    assert ("make", "Thing") in _names(nodes, edges, "USES")
    assert ("pkg", "Thing") in _names(nodes, edges, "CONTAINS")


def test_relative_imports():
    assert parse.resolve_relative(1, "x", "a.b") == "a.b.x"
    assert parse.resolve_relative(2, None, "a.b") == "a"
    assert parse.resolve_relative(3, "x", "a.b") is None


def test_property_setter_is_one_method(spark):
    code = "class A:\n    @property\n    def p(self):\n        return 1\n    @p.setter\n    def p(self, v):\n        self.q = v\n"
    nodes, _, _ = parse.raw_records(parse.parse_files(_files(spark, m=code)))
    rows = nodes.where("type = 'Method'").collect()
    assert [r["signature"] for r in rows] == ["p(self, v)"]


def test_last_file_wins(spark):
    raw = spark.createDataFrame([("r", "Module", "m", "m", "old", 0), ("r", "Module", "m", "m", "new", 1)], "repo string, type string, name string, module_name string, code string, file_ord int")
    for c in ("signature", "class", "module", "alias", "local_name", "dotted_folder_name"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    assert [r["code"] for r in build.merged_nodes(raw).collect()] == ["new"]


def _random_graph(spark, n=30, m=50, seed=3):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    nodes = conform(spark.createDataFrame([(f"n{i:02}", "Function", f"f{i}") for i in range(n)], "node_id string, label string, name string"), NODES)
    edges = conform(spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "USES") for a, b in pairs], "src string, dst string, type string"), EDGES)
    return nodes, edges, pairs


def test_closure_like_a_plain_search(spark):
    nodes, edges, pairs = _random_graph(spark)
    got = {r["node_id"]: r["depth"] for r in pattern.closure(nodes.where("node_id = 'n00'"), edges, "USES").collect()}
    seen, frontier, depth = {"n00": 0}, {0}, 0
    while frontier:
        depth += 1
        frontier = {b for a, b in pairs if a in frontier and f"n{b:02}" not in seen}
        seen |= {f"n{b:02}": depth for b in frontier}
    assert got == seen


def test_paths_use_no_edge_twice(spark):
    edges = conform(spark.createDataFrame([("a", "b", "T"), ("b", "a", "T")], "src string, dst string, type string"), EDGES)
    start = spark.createDataFrame([("a",)], "node_id string")
    assert sorted((r["end"], r["depth"]) for r in pattern.paths(start, edges, "T", most=5).collect()) == [("a", 2), ("b", 1)]


def test_components_like_union_find(spark):
    _, edges, pairs = _random_graph(spark, 40, 30, 5)
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {f"n{x:02}": f"n{find(x):02}" for x in touched}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    assert components(edges).select("component").distinct().collect()[0][0] == 0


def test_cypher(spark, graph):
    nodes, edges = graph
    run = lambda q, **p: [tuple(r) for r in cypher.run_cypher(q, nodes, edges, **p).collect()]
    assert run("MATCH (c:Class)-[:INHERITS]->(b:Class {name: $b}) RETURN c.name AS name", b="Base") == [("Extended",)]
    assert run("MATCH (c:Class) OPTIONAL MATCH (c)-[:HAS_METHOD]->(m) RETURN c.name AS c, count(m) AS n ORDER BY n DESC") == [("Base", 2), ("Extended", 1)]
    assert run("MATCH (r:Repo)-[:CONTAINS*]->(x:Class) RETURN x.name AS x ORDER BY x LIMIT 1") == [("Base",)]
    assert run("MATCH (f) WHERE f:Function AND NOT (f)-[:USES]->() RETURN count(*) AS n") == [(0,)]
    assert run("MATCH (f:Function) RETURN DISTINCT CASE WHEN f.name = 'helper' THEN 1 ELSE 0 END AS x UNION MATCH (c:Class) RETURN 1 AS x") != []
    for bad in ("CREATE (n:Class)", "MATCH (n) DELETE n", "MATCH (n)", "MATCH (n RETURN n"):
        with pytest.raises(cypher.CypherError):
            run(bad)


def test_names_of_corpus_functions(spark):
    df = spark.createDataFrame([("a",), ("C.a",), ("M.C.a",)], "f string")
    assert [tuple(r[0]) for r in df.select(traverse.parsed_name(F.col("f"))).collect()] == [(None, "a"), ("C", "a"), ("C", "a")]


def test_pruning_keeps_the_way_to_the_root(spark, graph):
    nodes, edges = graph
    targets = spark.createDataFrame([("r", "Base", "run", "elsewhere")], "repo string, class string, name string, module_name string")
    kept, left = traverse.prune_to_corpus(nodes, edges, targets)
    names = {r["name"] for r in kept.collect()}
    assert {"r", "base", "Base", "run", "stop", "Extended", "extended"} <= names and "helper" not in names
    ids = {r["node_id"] for r in kept.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in left.collect())


def test_inflated_size_counts_a_class_for_each_method(graph):
    nodes, edges = graph
    compat = traverse.graph_size(nodes, edges).first()["size"]
    plain = traverse.graph_size(nodes, edges, compat=False).first()["size"]
    assert compat == plain + 1  # Base has two methods


def test_search_visits_add_up():
    near = {"r": ["a", "b"], "a": ["c", "d"], "b": ["e"]}
    sim = {"r": 1.0, "a": 0.9, "b": 0.5, "c": 0.8, "d": 0.7, "e": 0.95}
    labels = {k: "Function" for k in sim} | {"r": "Repo"}
    s = mcts.Search("r", labels, near, sim, {k: 10 * v for k, v in sim.items()}, 100, mcts.Settings(iterations=50, k=2, k_least=1))
    best = s.run()
    assert s.count() == 6 and s.root.visits == 5
    assert [b[0] for b in best][0] == "e"
    again = mcts.Search("r", labels, near, sim, {k: 10 * v for k, v in sim.items()}, 100, mcts.Settings(iterations=50, k=2, k_least=1)).run()
    assert best == again


# ---------------------------------------------------------------- the query language's walks


@pytest.fixture(scope="module")
def chain(spark):
    nodes = conform(spark.createDataFrame([(f"n{i:02}", "Function", f"f{i:02}") for i in range(20)], "node_id string, label string, name string"), NODES)
    pairs = [(f"n{i:02}", f"n{i + 1:02}", "USES") for i in range(14)] + [("n18", "n18", "USES"), ("n18", "n19", "CONTAINS")]
    return nodes, conform(spark.createDataFrame(pairs, "src string, dst string, type string"), EDGES)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (x {name:'f00'})-[:USES*]->(y) RETURN count(y) AS n", [(14,)]),
        ("MATCH (x {name:'f00'})-[:USES]-(y)-[:USES]-(z) RETURN z.name AS z", [("f02",)]),
        ("MATCH (x {name:'f18'})-[:USES]-(y) RETURN y.name AS z", [("f18",)]),
        ("MATCH (x {name:'f18'})-[:USES*]-(y) RETURN y.name AS z", [("f18",)]),
        ("MATCH (a {name:'f01'})-[:USES]->(b), (c)-[:USES]->(b) RETURN c.name AS c", []),
        ("MATCH (a {name:'f01'})-[:USES]->(b) MATCH (c)-[:USES]->(b) RETURN c.name AS c", [("f01",)]),
        ("MATCH (a {name:'f00'})-[:USES*2..3]->(b)-[:USES]->(c) RETURN c.name AS c ORDER BY c", [("f03",), ("f04",)]),
        ("MATCH (a {name:'f13'}) OPTIONAL MATCH (a)-[:USES]->(b)-[:USES]->(c) RETURN a.name AS a, c.name AS c", [("f13", None)]),
    ],
)
def test_no_edge_is_used_twice_and_walks_have_no_end(chain, query, want):
    assert [tuple(r) for r in cypher.run_cypher(query, *chain).collect()] == want


def test_walks_that_do_not_end_in_time_raise(chain):
    nodes, edges = chain
    with pytest.raises(RuntimeError):
        pattern.paths(nodes.where("name = 'f00'"), edges, "USES", most_rounds=5)
    with pytest.raises(RuntimeError):
        pattern.closure(nodes.where("name = 'f00'"), edges, "USES", most_rounds=5)
    assert pattern.closure(nodes.where("name = 'f00'"), edges, "USES").count() == 15


def test_edges_of_nested_and_conditional_definitions(spark):
    code = (
        "class A(Missing):\n    x = 1\n    def m(self):\n        self.y = helper()\n        z = Other\n        def inner():\n            pass\n        @deco\n        def hidden():\n            pass\n"
        "class Other: pass\ndef helper(): pass\ndef deco(f): return f\nif helper:\n    def conditional(): pass\ntry:\n    def tried(): pass\nexcept E:\n    pass\n"
        'if __name__ == "__main__":\n    def main(): pass\n'
    )
    nodes, edges, _ = parse.raw_records(parse.parse_files(_files(spark, m=code)))
    rows = {(r["type"], r["source"], r["target"]) for r in edges.collect()}
    assert {("HAS_METHOD", "A", "m"), ("HAS_METHOD", "A", "inner"), ("CONTAINS", "m", "tried"), ("CONTAINS", "m", "main"), ("CONTAINS", "m", "__main__"), ("USES", "A", "helper"), ("USES", "A", "Other"), ("INHERITS", "A", "Missing")} <= rows
    assert not {("HAS_METHOD", "A", "hidden"), ("CONTAINS", "m", "conditional")} & rows
    assert {r["name"] for r in nodes.where("type = 'Field' AND class = 'A'").collect()} >= {"x", "y", "z"}
    built, kept = build.build_graph(nodes, edges)
    assert build.broken_keys(built).count() == 0 and kept.where("type = 'INHERITS'").count() == 0


def test_last_update_wins_as_a_whole(spark):
    nodes = conform(spark.createDataFrame([("a", "Function", "f", "m", "old", "kept")], "node_id string, label string, name string, module_name string, description string, code string"), NODES)
    updates = spark.createDataFrame([("a", 1, "zzz", "x"), ("a", 2, "new", None)], "node_id string, at int, description string, code string")
    r = build.update_nodes(nodes, updates, "description", "code", keys=("node_id",), scoped=False, order="at").first()
    assert (r["description"], r["code"]) == ("new", "kept")


# ---------------------------------------------------------------- whole jobs


def test_jobs_from_sources_to_answers(spark, tmp_path, graph):
    from codelattice.operators import pipelines

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "base.py").write_text(BASE)
    (tmp_path / "src" / "extended.py").write_text(EXTENDED)
    report = pipelines.build_repositories(spark, {"r": str(tmp_path / "src")}, str(tmp_path / "out")).collect()
    nodes, edges = graph
    assert [(r["repo"], r["nodes"], r["edges"], r["errors"]) for r in report] == [("r", nodes.count(), edges.count(), 0)]
    assert pipelines.build_repositories(spark, {"r": str(tmp_path / "src")}, str(tmp_path / "out")).count() == 0
    described = pipelines.described_graph(nodes, edges, most_tokens=30)
    assert described.where("label IN ('Function', 'Method', 'Class', 'Module') AND (description IS NULL OR embedding IS NULL)").count() == 0
    assert pipelines.described_graph(described, edges).where("description <> ''").count() == described.where("description <> ''").count()

    class Model(pipelines.Offline):
        def __init__(self, text):
            super().__init__()
            self.text = text

        def answer(self, prompts):
            return [self.text] * len(prompts)

    ask = lambda text: pipelines.answer(described, edges, "class Base def run self helper size LIMIT return", Model(text))
    stage, rows = ask("```\nMATCH (c:Class {name: 'Base'}) RETURN c AS item\n```")
    assert stage == "query" and {r["name"] for r in rows.collect()} == {"Base", "run", "stop"}
    stage, rows = ask('{"entities": [{"name": "helper", "type": "Function"}]}')
    assert stage == "specification" and "helper" in {r["name"] for r in rows.collect()}
    stage, rows = ask("nothing to say")
    assert stage == "search" and 0 < rows.count() <= 5
    tasks = spark.createDataFrame([("q", "r", "x = ", "1"), ("p", "r", "y = ", "2")], "query_id string, repo string, prompt string, groundtruth string")
    found = spark.createDataFrame([("q", 0, "def helper(): pass")], "query_id string, position int, text string")
    done = {r["query_id"]: (r["predicted"], r["exact_match"]) for r in pipelines.completed(tasks, found, found, provider=Model("1\n2")).collect()}
    assert done == {"q": ("1", True), "p": ("1", False)}
    assert pipelines.settings("a:\n  b: 1  # remark\n  c:\n    - x\n    - 2\nd: 'text'\n") == {"a": {"b": 1, "c": ["x", 2]}, "d": "text"}
    rows, seconds = pipelines.timed(lambda: found)
    assert len(rows) == 1 and seconds > 0


def test_nodes_are_scored_when_they_are_reached():
    asked = []

    def scorer(ids):
        asked.extend(ids)
        return [1.0] * len(ids)

    near = {"r": ["a", "b"], "a": ["c"], "b": ["d"], "d": ["e"]}
    sim = {k: 0.5 for k in "rabcde"} | {"e": 0.0}
    s = mcts.Search("r", {k: "Function" for k in sim} | {"r": "Repo"}, near, sim, {}, 100, mcts.Settings(iterations=50, k=1, k_least=1), scorer=scorer)
    assert {i for i, *_ in s.run()} == {"a", "b", "c", "d"} and sorted(asked) == ["a", "b", "c", "d"]
