"""Queries that run every operator over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, vectors
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import build, cypher, evaluate, mcts, parse, pattern, retrieval, traverse
from ..sources import readers, sinks
from .graph_view import GRAPH_SQL, graph_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = False) -> Callable[[Callable], Callable]:
    """Registers a query; ``graph``: the function takes the graph view, and the SQL may use its tables nodes and edges."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = (lambda spark, at: function(*graph_view(spark, at))) if graph else function
        if sql is not None:
            SQL[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{GRAPH_SQL}{sql.replace('RECURSIVE', '')}" if graph else sql
        return function

    return register


def _t(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---------------------------------------------------------------- flagship


@query(
    "cross_module_deps_topk",
    """
    , members AS (SELECT e.dst AS a FROM edges e WHERE e.type = 'CONTAINS' AND e.src IN (SELECT node_id FROM nodes WHERE label = 'Module' AND name = 'NATION_3')),
    own AS (SELECT a FROM members UNION SELECT e.dst FROM edges e JOIN members ON e.src = a WHERE e.type = 'HAS_METHOD'),
    used AS (SELECT DISTINCT e.dst AS node_id FROM edges e JOIN own ON e.src = a WHERE e.type = 'USES')
    SELECT node_id, name, module_name, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
    FROM nodes JOIN used USING (node_id) JOIN embeddings ON node_id = 'GlobalVariable:' || vec_id
    WHERE module_name <> 'NATION_3' ORDER BY similarity DESC, node_id LIMIT 5
    """,
)
def flagship(spark: SparkSession, at: str) -> DataFrame:
    nodes, edges = graph_view(spark, at)
    name = nodes.where("label = 'Module'").orderBy("node_id").select("name")
    module = next((r["name"] for r in _t(spark, at, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("name")).collect()), None) or name.first()["name"]
    question = _t(spark, at, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    found = traverse.cross_module_dependencies(nodes, edges, module).where("embedding IS NOT NULL").join(F.broadcast(question), F.lit(True))
    scored = found.select("node_id", "name", "module_name", _r(vectors.cosine("embedding", "q")).alias("similarity"))
    return retrieval.top_k(scored, "similarity", 5, "node_id")


SQL["cross_module_deps_topk"] = (
    "WITH " + GRAPH_SQL + SQL["cross_module_deps_topk"].replace("'NATION_3'", "(SELECT n_name FROM nation WHERE n_nationkey = 3)")
)


# ---------------------------------------------------------------- graph patterns


@query("label_counts", "SELECT label, count(*) AS n FROM nodes GROUP BY label", graph=True)
def _(nodes, edges):
    return A.label_counts(nodes)


@query(
    "repo_stats_pivot",
    """
    , mods AS (SELECT src AS r, dst AS n FROM edges WHERE type = 'CONTAINS' AND src LIKE 'Repo:%'),
    kids AS (SELECT r, e.dst AS n FROM mods JOIN edges e ON e.src = mods.n WHERE e.type = 'CONTAINS'),
    meths AS (SELECT r, e.dst AS n FROM kids JOIN edges e ON e.src = kids.n WHERE e.type = 'HAS_METHOD'),
    below AS (SELECT * FROM mods UNION SELECT * FROM kids UNION SELECT * FROM meths)
    SELECT repo.name AS repo_name, count(*) FILTER (x.label = 'Module') AS "Module", count(*) FILTER (x.label = 'Class') AS "Class",
      count(*) FILTER (x.label = 'Function') AS "Function", count(*) FILTER (x.label = 'Method') AS "Method", 0::BIGINT AS "Field",
      count(*) FILTER (x.label = 'GlobalVariable') AS "GlobalVariable", count(x.node_id) AS total
    FROM nodes repo LEFT JOIN below ON below.r = repo.node_id LEFT JOIN nodes x ON x.node_id = below.n WHERE repo.label = 'Repo' GROUP BY repo.node_id, repo.name
    """,
    graph=True,
)
def _(nodes, edges):
    return A.repo_statistics(nodes, edges)


@query(
    "repo_stats_summary",
    """
    , mods AS (SELECT src AS r, dst AS n FROM edges WHERE type = 'CONTAINS' AND src LIKE 'Repo:%'),
    kids AS (SELECT r, e.dst AS n FROM mods JOIN edges e ON e.src = mods.n WHERE e.type = 'CONTAINS'),
    below AS (SELECT * FROM mods UNION SELECT * FROM kids), per AS (SELECT repo.node_id, count(below.n) AS total FROM nodes repo LEFT JOIN below ON r = repo.node_id WHERE label = 'Repo' GROUP BY 1)
    SELECT count(*) AS repos, count(*) FILTER (total = 0) AS empty_repos, sum(total)::BIGINT AS nodes, max(total) AS largest FROM per
    """,
    graph=True,
)
def _(nodes, edges):
    return A.statistics_summary(A.repo_statistics(nodes, edges, methods=False))


@query("children_directed", "SELECT src AS node_id, dst AS child FROM edges WHERE type = 'CONTAINS'", graph=True)
def _(nodes, edges):
    starts = nodes.where("label IN ('Repo', 'Module')").select("node_id")
    return pattern.hop(starts, edges, "node_id", "child", "CONTAINS")


@query(
    "children_undirected",
    """
    , und AS (SELECT src AS s, dst AS t, type FROM edges UNION ALL SELECT dst, src, type FROM edges)
    SELECT DISTINCT node_id, t AS child FROM nodes JOIN und ON s = node_id
    WHERE label IN ('Class') AND type IN ('HAS_METHOD', 'HAS_FIELD', 'USES') OR label IN ('Function', 'Method', 'GlobalVariable', 'Field') AND type = 'USES'
    UNION SELECT src, dst FROM edges WHERE type = 'CONTAINS'
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.children(nodes, edges)


@query(
    "has_children",
    """
    SELECT node_id, EXISTS (SELECT 1 FROM edges WHERE src = node_id AND (label IN ('Repo', 'Module') AND type = 'CONTAINS'
      OR label = 'Class' AND type IN ('HAS_METHOD', 'HAS_FIELD') OR label NOT IN ('Repo', 'Module', 'Class') AND type = 'USES')) AS has_children FROM nodes
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.has_children(nodes, edges).select("node_id", "has_children")


@query(
    "optional_match_inflated_count",
    """
    , c AS (SELECT e.src AS r, e.dst AS c FROM edges e WHERE type = 'CONTAINS' AND src LIKE 'Repo:%'),
    below AS (SELECT * FROM c UNION ALL SELECT c.r, e.dst FROM c JOIN edges e ON e.src = c.c AND e.type = 'CONTAINS')
    SELECT r AS repo_id, count(c) + count(m.dst) + 1 AS size FROM below LEFT JOIN edges m ON m.src = c AND m.type = 'HAS_METHOD' GROUP BY r
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.graph_size(nodes, edges).where("size > 1")


@query("not_exists_empty_modules", "SELECT node_id FROM nodes WHERE label = 'Class' AND NOT EXISTS (SELECT 1 FROM edges WHERE src = node_id AND type = 'HAS_METHOD' AND dst IN (SELECT 'Method:' || o_orderkey FROM orders WHERE o_orderstatus = 'P'))", graph=False)
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    some = _t(spark, at, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("Method:"), F.col("o_orderkey")).alias("dst"))
    return cypher.run_cypher("MATCH (c:Class) WHERE NOT (c)-[:HAS_METHOD]->() RETURN c AS node_id", nodes, edges.join(some, "dst", "left_semi"))


SQL["not_exists_empty_modules"] = "WITH " + GRAPH_SQL + SQL["not_exists_empty_modules"]


@query("empty_modules", "SELECT 'Module:' || n_nationkey AS node_id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)", graph=False)
def _(spark, at):
    """Of the graph that holds the classes of one kind only."""
    nodes, edges = graph_view(spark, at)
    rich = _t(spark, at, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("Class:"), F.col("c_custkey")).alias("node_id"))
    return build.empty_modules(*build.keep_only(nodes, edges, rich.unionByName(nodes.where("label = 'Module'").select("node_id")))).select("node_id")


@query(
    "varlen_contains",
    """
    , RECURSIVE walk(start, node, depth) AS (SELECT src, dst, 1 FROM edges WHERE type = 'CONTAINS' AND src LIKE 'Repo:%'
      UNION ALL SELECT start, e.dst, depth + 1 FROM walk JOIN edges e ON e.src = node WHERE e.type = 'CONTAINS')
    SELECT start, node AS "end", depth FROM walk
    """,
    graph=True,
)
def _(nodes, edges):
    return pattern.paths(nodes.where("label = 'Repo'"), edges, "CONTAINS")


@query(
    "inherits_closure",
    """
    , RECURSIVE up(node_id, depth) AS (SELECT 'GlobalVariable:1', 0 UNION SELECT e.src, depth + 1 FROM up JOIN edges e ON e.dst = up.node_id WHERE e.type = 'INHERITS' AND e.src <> e.dst)
    SELECT node_id, min(depth) AS depth FROM up GROUP BY node_id
    """,
    graph=True,
)
def _(nodes, edges):
    return pattern.closure(nodes.where("node_id = 'GlobalVariable:1'"), edges, "INHERITS", direction="in")


@query(
    "collect_concat_unwind",
    """
    , kids AS (SELECT m.name AS module, e.dst AS c FROM nodes m JOIN edges e ON e.src = m.node_id AND e.type = 'CONTAINS' WHERE m.label = 'Module'),
    pairs AS (SELECT module, c, h.dst AS x FROM kids LEFT JOIN edges h ON h.src = c AND h.type = 'HAS_METHOD')
    SELECT module, count(*) AS n FROM (SELECT module, c AS item FROM pairs UNION ALL SELECT module, x FROM pairs WHERE x IS NOT NULL) GROUP BY module
    """,
    graph=True,
)
def _(nodes, edges):
    text = """MATCH (m:Module)-[:CONTAINS]->(c) OPTIONAL MATCH (c)-[:HAS_METHOD]->(x) WITH m.name AS module, collect(c) + collect(x) AS items
              UNWIND items AS item RETURN module, count(item) AS n"""
    return cypher.run_cypher(text, nodes, edges)


@query("cypher_group_order", "SELECT m.name AS module, count(e.dst) AS classes FROM nodes m JOIN edges e ON e.src = m.node_id JOIN nodes c ON c.node_id = e.dst WHERE m.label = 'Module' AND c.label = 'Class' AND e.type = 'CONTAINS' GROUP BY m.node_id, m.name", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (m:Module)-[:CONTAINS]->(c:Class) RETURN m.name AS module, count(c) AS classes ORDER BY classes DESC, module", nodes, edges)


@query(
    "cypher_union_where",
    """
    SELECT DISTINCT name, label FROM nodes WHERE label = 'Function' AND lower(name) LIKE '%1%' AND module_name IS NOT NULL
    UNION SELECT name, label FROM nodes WHERE label = 'Module' AND name <> 'x'
    """,
    graph=True,
)
def _(nodes, edges):
    text = """MATCH (f:Function) WHERE toLower(f.name) CONTAINS $part AND f.module_name IS NOT NULL RETURN DISTINCT f.name AS name, labels(f)[0] AS label
              UNION MATCH (m:Module) WHERE m.name <> 'x' RETURN m.name AS name, labels(m)[0] AS label"""
    return cypher.run_cypher(text, nodes, edges, part="1")


@query(
    "cypher_two_hops",
    """
    SELECT c.name AS class, count(DISTINCT g.node_id) AS used, count(*) AS uses FROM nodes c JOIN edges h ON h.src = c.node_id AND h.type = 'HAS_METHOD'
    JOIN edges u ON u.src = h.dst AND u.type IN ('USES', 'INHERITS') JOIN nodes g ON g.node_id = u.dst WHERE c.label = 'Class' AND g.label = 'GlobalVariable' GROUP BY c.name
    """,
    graph=True,
)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (c:Class)-[:HAS_METHOD]->(m)-[:USES|INHERITS]->(g:GlobalVariable) RETURN c.name AS class, count(DISTINCT g) AS used, count(*) AS uses", nodes, edges)


@query("usage_report", "SELECT n.node_id, n.label, n.name, count(*) AS uses FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.type = 'USES' GROUP BY 1, 2, 3", graph=True)
def _(nodes, edges):
    return traverse.usage_report(nodes, edges)


@query(
    "called_by_name",
    """
    SELECT DISTINCT t.node_id FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes t ON t.node_id = e.dst WHERE e.type = 'USES' AND s.name = '1-URGENT'
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.called_by_name(nodes, edges, "1-URGENT").select("node_id")


@query(
    "entity_lookup_ci",
    """
    SELECT node_id, name FROM (SELECT *, row_number() OVER (ORDER BY node_id) AS k FROM nodes WHERE lower(name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 7)) WHERE k <= 5
    UNION ALL SELECT node_id, name FROM (SELECT *, row_number() OVER (ORDER BY node_id) AS k FROM nodes WHERE label = 'Module' AND contains(lower(name), 'a')) WHERE k <= 5
    """,
)
def _(spark, at):
    nodes, _edges = graph_view(spark, at)
    name = _t(spark, at, "part").where("p_partkey = 7").first()
    return traverse.entities(nodes, [{"name": name["p_name"].upper() if name else ""}, {"name": "A", "type": "Module"}]).select("node_id", "name")


SQL["entity_lookup_ci"] = "WITH " + GRAPH_SQL + SQL["entity_lookup_ci"]


@query(
    "relationship_lookup",
    """
    SELECT e.src, e.dst, e.type FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes t ON t.node_id = e.dst
    WHERE e.type IN ('CONTAINS', 'USES') AND contains(lower(s.name), '2') ORDER BY e.src, e.dst, e.type LIMIT 5
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.relationships(nodes, edges, [{"type": "CONTAINS|USES", "source": "2"}]).select("src", "dst", "type")


# ---------------------------------------------------------------- graph changes


@query(
    "merge_last_write_wins",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) FILTER (false) AS none FROM events GROUP BY user_id, event_type",
)
def _(spark, at):
    e = _t(spark, at, "events").select("user_id", "event_type", "value", "ts", "event_id")
    best = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return best.withColumn("none", F.lit(None).cast("bigint"))


@query(
    "first_match_cascade",
    """
    , names AS (SELECT DISTINCT name AS target_name FROM nodes WHERE label IN ('Class', 'Function', 'GlobalVariable')),
    tiers AS (SELECT name, CASE label WHEN 'Class' THEN 0 WHEN 'Function' THEN 1 ELSE 2 END AS tier, node_id FROM nodes WHERE label IN ('Class', 'Function', 'GlobalVariable'))
    SELECT target_name, arg_min(node_id, (tier, node_id)) AS target, min(tier) AS tier FROM names JOIN tiers ON name = target_name GROUP BY target_name
    """,
    graph=True,
)
def _(nodes, edges):
    labels = ("Class", "Function", "GlobalVariable")
    wanted = nodes.where(F.col("label").isin(*labels)).select(F.col("name").alias("target_name")).distinct()
    return build.first_match(wanted, [nodes.where(F.col("label") == x).select(F.col("name").alias("target_name"), "node_id") for x in labels], ["target_name"])


@query(
    "import_resolution_tiers",
    """
    WITH imp AS (SELECT DISTINCT p_name AS name, 'm' || (p_size % 5) AS module FROM part),
    defs AS (SELECT p_name AS name, 'm' || (p_partkey % 7) AS module, 'Class' AS label, 0 AS r, 'Class:' || min(p_partkey) AS id FROM part GROUP BY 1, 2
      UNION ALL SELECT s_name, 'm' || (s_suppkey % 7), 'Function', 1, 'Function:' || min(s_suppkey) FROM supplier GROUP BY 1, 2),
    hits AS (SELECT i.name, i.module, 1 AS tier, r, id, label FROM imp i JOIN defs d ON d.name = i.name AND d.module = i.module
      UNION ALL SELECT i.name, i.module, 3, CASE label WHEN 'Class' THEN 0 ELSE 2 END, id, label FROM imp i JOIN defs d ON d.name = i.name)
    SELECT name || '@' || module AS import_id, arg_min(id, (tier, r, id)) AS target, arg_min(label, (tier, r, id)) AS label, min(tier) AS tier FROM hits GROUP BY 1
    """,
)
def _(spark, at):
    part, supplier = _t(spark, at, "part"), _t(spark, at, "supplier")
    repo = F.lit("r").alias("repo")
    imports = part.select("p_name", F.concat(F.lit("m"), F.col("p_size") % 5).alias("module")).distinct()
    imports = imports.select(F.concat_ws("@", "p_name", "module").alias("node_id"), repo, F.col("p_name").alias("name"), "module", F.lit("").alias("dotted_folder_name"))

    def defs(df, name, key, label):
        g = df.groupBy(F.col(name).alias("name"), F.concat(F.lit("m"), F.col(key) % 7).alias("within")).agg(F.min(key).alias("k"))
        return g.select(F.concat(F.lit(label + ":"), F.col("k")).alias("node_id"), F.lit(label).alias("label"), repo, "name", F.lit(None).cast("string").alias("local_name"), "within")

    members = defs(part, "p_name", "p_partkey", "Class").unionByName(defs(supplier, "s_name", "s_suppkey", "Function"))
    modules = members.select("within").distinct().select(F.concat(F.lit("Module:"), F.col("within")).alias("node_id"), F.lit("Module").alias("label"), repo, F.col("within").alias("name"), F.lit(None).cast("string").alias("local_name"), "within")
    edges = members.select(F.concat(F.lit("Module:"), F.col("within")).alias("src"), F.col("node_id").alias("dst"), F.lit("CONTAINS").alias("type"))
    return build.match_imports(imports, members.unionByName(modules), edges)


@query(
    "left_anti_prune",
    """
    , gone AS (SELECT node_id FROM nodes WHERE label = 'Class' AND module_name IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0))
    SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone) GROUP BY type
    """,
)
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    even = _t(spark, at, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("module_name"))
    gone = nodes.where("label = 'Class'").join(even, "module_name", "left_semi")
    return build.delete_nodes(nodes, edges, gone)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


SQL["left_anti_prune"] = "WITH " + GRAPH_SQL + SQL["left_anti_prune"]


@query("self_loop_drop", "SELECT type, count(*) AS n FROM edges WHERE src <> dst GROUP BY type", graph=True)
def _(nodes, edges):
    return build.without_self_loops(edges).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("self_loop_report", "SELECT type, count(*) AS loops FROM edges WHERE src = dst GROUP BY type", graph=True)
def _(nodes, edges):
    return build.self_loop_report(edges)


@query(
    "class_relatives",
    """
    , ids AS (SELECT 'Method:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'P'),
    owners AS (SELECT DISTINCT e.src AS node_id FROM ids JOIN edges e ON e.dst = ids.node_id AND e.type = 'HAS_METHOD')
    SELECT node_id FROM owners UNION SELECT e.dst FROM owners JOIN edges e ON e.src = owners.node_id AND e.type = 'HAS_METHOD'
    """,
)
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    ids = _t(spark, at, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("Method:"), F.col("o_orderkey")).alias("node_id"))
    return traverse.class_relatives(nodes, edges, ids)


SQL["class_relatives"] = "WITH " + GRAPH_SQL + SQL["class_relatives"]


@query(
    "module_embedding_state",
    """
    SELECT repo, count(*) FILTER (graph_node_data.node_type = 'Module') AS modules, count(*) FILTER (graph_node_data.node_type = 'Module' AND graph_node_data.embedding IS NOT NULL) AS embedded,
      CASE WHEN count(*) FILTER (graph_node_data.node_type = 'Module') = 0 THEN 'process'
        WHEN count(*) FILTER (graph_node_data.node_type = 'Module') = count(*) FILTER (graph_node_data.node_type = 'Module' AND graph_node_data.embedding IS NOT NULL) THEN 'skip' ELSE 'delete' END AS state
    FROM tree_nodes GROUP BY repo
    """,
)
def _(spark, at):
    d = F.col("graph_node_data")
    return build.repo_state(_t(spark, at, "tree_nodes").select("repo", d["node_type"].alias("label"), d["embedding"].alias("embedding")))


@query("resume_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, at):
    done = _t(spark, at, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.pending(_t(spark, at, "orders"), done, "o_custkey").select("o_orderkey")


@query(
    "tracking_upsert",
    """
    WITH new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
    SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new
    """,
)
def _(spark, at):
    new = _t(spark, at, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return sinks.upserted(_t(spark, at, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), new, "k")


# ---------------------------------------------------------------- vectors, text, retrieval


@query(
    "cosine_topk",
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10",
)
def _(spark, at):
    e = _t(spark, at, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    return retrieval.top_k(e.join(F.broadcast(q), F.lit(True)).select("vec_id", _r(vectors.cosine("embedding", "q")).alias("similarity")), "similarity", 10, "vec_id")


@query(
    "cosine_topk_per_query",
    """
    SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM (
      SELECT q.vec_id AS query_id, i.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)) WHERE k <= 5
    """,
)
def _(spark, at):
    e = _t(spark, at, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), vectors.normalised("embedding").alias("q"))
    pairs = e.join(F.broadcast(q), F.lit(True)).select("query_id", "vec_id", _r(vectors.cosine("q", "embedding")).alias("similarity"))
    return retrieval.top_k(pairs, "similarity", 5, "vec_id", per="query_id").select("query_id", "vec_id", "similarity")


@query(
    "chunk_maxpool",
    "SELECT label, max(s) AS similarity FROM (SELECT label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)), 6) AS s FROM embeddings) GROUP BY label",
)
def _(spark, at):
    e = _t(spark, at, "embeddings")
    q = e.where("vec_id = 2").select(F.col("embedding").alias("q"))
    return A.maxpool(e.join(F.broadcast(q), F.lit(True)).select("label", _r(vectors.cosine("embedding", "q")).alias("similarity")), "label", "similarity")


_LINES = """
    parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    numbered AS (SELECT doc_id, l, unnest(generate_series(0, (len(l) - 1) // 10)) AS chunk FROM parts),
    chunks AS (SELECT doc_id, chunk::INT AS chunk, (chunk * 10 + 1)::INT AS start_line, least((chunk + 1) * 10, len(l))::INT AS end_line, len(l)::INT AS total_lines,
      regexp_replace(array_to_string(l[chunk * 10 + 1 : chunk * 10 + 10], chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM numbered)
"""


@query("chunk_lines", f"WITH {_LINES} SELECT * FROM chunks WHERE text <> ''")
def _(spark, at):
    return retrieval.chunked_lines(_t(spark, at, "documents"), "doc_id", "text")


_BM25 = f"""
    WITH {_LINES}, kept AS (SELECT doc_id, chunk, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[[:punct:]]', '', 'g')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM chunks WHERE text <> ''),
    tok AS (SELECT doc_id, chunk, len(w) AS dl, unnest(w) AS term FROM kept), post AS (SELECT doc_id, chunk, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
    corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM kept), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, corpus), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    q AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[[:punct:]]', '', 'g')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS term FROM queries WHERE text IS NOT NULL),
    qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, chunk, floor(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1000000 + 0.5) / 1000000 AS score FROM qt JOIN idf USING (term) JOIN post USING (term), corpus GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk) AS rank FROM scored WHERE score > 0)
"""


def _bm25(spark, at, k: int) -> DataFrame:
    chunks = retrieval.chunked_lines(_t(spark, at, "documents"), "doc_id", "text")
    postings, corpus = retrieval.inverted_index(chunks, ["doc_id", "chunk"])
    return retrieval.bm25(_t(spark, at, "queries"), postings, corpus, ["doc_id", "chunk"], k, digits=6)


@query("bm25_topk", _BM25 + "SELECT query_id, doc_id, chunk, score FROM ranked WHERE rank <= 5")
def _(spark, at):
    return _bm25(spark, at, 5).select("query_id", "doc_id", "chunk", "score")


@query(
    "bm25_excluding_source",
    _BM25 + """, left_over AS (SELECT ranked.* FROM ranked JOIN documents USING (doc_id) WHERE rank <= 15 AND NOT coalesce(ends_with(source, 'crawl'), false))
    SELECT query_id, doc_id, chunk, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM left_over) WHERE k <= 5""",
)
def _(spark, at):
    ranked = _bm25(spark, at, 15).join(_t(spark, at, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    own = _t(spark, at, "queries").select("query_id").distinct().withColumn("file", F.lit("crawl"))
    return retrieval.bm25_excluding(ranked, own, "source", 5).select("query_id", "doc_id", "chunk", "score")


@query(
    "edit_similarity",
    "SELECT p_partkey, round(greatest(0, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))), 6) AS similarity, p_name = p_type AS exact FROM part",
)
def _(spark, at):
    p = _t(spark, at, "part")
    return p.select("p_partkey", _r(T.edit_similarity(F.col("p_name"), F.col("p_type"))).alias("similarity"), T.exact_match(F.col("p_name"), F.col("p_type")).alias("exact"))


@query("purposes")
def _(spark, at):
    return _t(spark, at, "documents").select("doc_id", T.purpose(F.col("text")).alias("purpose"), T.purpose_line(F.col("text")).alias("line"))


@query("token_budget_fit", r"SELECT doc_id, n AS tokens, n <= 200 AS fits FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]')) AS n FROM documents WHERE text IS NOT NULL)")
def _(spark, at):
    d = _t(spark, at, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.token_count(F.col("text")).alias("tokens"), T.fits_context(F.col("text"), [], 200, 0).alias("fits"))


@query(
    "budget_pack_prefix",
    "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 8000",
)
def _(spark, at):
    return retrieval.within_budget(_t(spark, at, "documents"), F.col("n_chars"), 8000, "doc_id", per=["source"]).select("source", "doc_id", "used")


@query("split_documents")
def _(spark, at):
    return _t(spark, at, "documents").select("doc_id", F.posexplode(T.split_text(F.col("text"), 512, 50)).alias("chunk_index", "document"))


@query("document_index")
def _(spark, at):
    return retrieval.chunk_index(_t(spark, at, "documents").select("doc_id", "text"), "doc_id", "text").select("id", "doc_id", "chunk_index", "total_chunks", "embedding")


@query("sequence_ratio_match")
def _(spark, at):
    p = _t(spark, at, "part")
    return p.select("p_partkey", T.sequence_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


def _python(docs: DataFrame) -> DataFrame:
    """Rows of docs in Python: by their label however written, else by the path's extension."""
    label = F.lower(F.regexp_replace(F.coalesce("language", F.lit("")), r"^\s+|\s+$", ""))
    known = label.isin("python", "py", "python3", "javascript", "js", "node", "java", "go", "golang", "php", "ruby", "rb")
    return docs.where(label.isin("python", "py", "python3") | ~known & F.coalesce(F.lower("path").rlike(r"\.pyw?$"), F.lit(False)))


@query("syntax_check")
def _(spark, at):
    return _python(_t(spark, at, "docs")).select("doc_id", T.parses_as_python(F.col("code")).alias("valid")).distinct()


# ---------------------------------------------------------------- keys and names


@query(
    "blob_addresses",
    """
    SELECT DISTINCT doc_id, split_part(doc_id, '/', 4) AS owner, split_part(doc_id, '/', 5) AS repo, split_part(doc_id, '/', 7) AS commit, path AS file FROM docs
    """,
)
def _(spark, at):
    return _t(spark, at, "docs").select("doc_id", F.inline(F.array(readers.blob_address(F.col("doc_id"))))).select("doc_id", "owner", "repo", "commit", "file").distinct()


@query(
    "module_names",
    "SELECT DISTINCT path, replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\', '.') AS module FROM docs",
)
def _(spark, at):
    return _t(spark, at, "docs").select("path", readers.path_to_module(F.col("path")).alias("module")).distinct()


@query(
    "func_name_parts",
    "SELECT DISTINCT func_name, CASE WHEN contains(func_name, '.') THEN split_part(func_name, '.', -2) END AS class, split_part(func_name, '.', -1) AS name FROM docs WHERE func_name IS NOT NULL",
)
def _(spark, at):
    d = _t(spark, at, "docs").where("func_name IS NOT NULL").select("func_name").distinct()
    return d.select("func_name", traverse.parsed_name(F.col("func_name"))["class"].alias("class"), traverse.parsed_name(F.col("func_name"))["name"].alias("name"))


@query("repo_key_splits", "SELECT DISTINCT repo, len(string_split(replace(repo, '/', '-') || '-c0ffee', '-')) - 2 AS ways FROM docs")
def _(spark, at):
    d = _t(spark, at, "docs").select("repo").distinct()
    return d.select("repo", F.size(readers.repo_key_splits(F.concat(F.translate("repo", "/", "-"), F.lit("-c0ffee")))).alias("ways"))


@query("import_categories")
def _(spark, at):
    d = _python(_t(spark, at, "docs")).where("code IS NOT NULL").select("doc_id", "repo", F.explode(T.imported_modules(F.col("code"))).alias("module")).distinct()
    none = spark.createDataFrame([], "repo string, package string")
    return readers.categorised_imports(d, none)


# ---------------------------------------------------------------- evaluation


@query(
    "qrel_mode_dedup",
    """
    SELECT query_id, doc_id, arg_max(relevance, (n, relevance)) AS relevance, sum(n)::BIGINT AS judgements
    FROM (SELECT query_id, doc_id, relevance, count(*) AS n FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL) GROUP BY query_id, doc_id
    """,
)
def _(spark, at):
    return A.judged_once(_t(spark, at, "qrels"))


_JUDGED = "judged AS (SELECT query_id, doc_id, arg_max(relevance, (n, relevance)) AS relevance FROM (SELECT query_id, doc_id, relevance, count(*) AS n FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL) GROUP BY ALL)"


@query("docs_by_query", f"WITH {_JUDGED} SELECT query_id, string_agg(relevance || ' ' || doc_id, ',' ORDER BY relevance DESC, doc_id) AS docs FROM judged GROUP BY query_id")
def _(spark, at):
    grouped = A.docs_by_query(A.judged_once(_t(spark, at, "qrels")))
    return grouped.select("query_id", F.array_join(F.transform("docs", lambda d: F.concat_ws(" ", d["relevance"].cast("string"), d["doc_id"])), ",").alias("docs"))


@query(
    "ndcg_recall_at10",
    f"""
    WITH {_JUDGED}, ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM judged),
    got AS (SELECT r.query_id, sum(CASE WHEN relevance > 0 THEN relevance / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (relevance > 0) AS hits FROM ranked r JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
    best AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS k FROM judged),
    ideal AS (SELECT query_id, sum(CASE WHEN relevance > 0 AND k <= 10 THEN relevance / log2(k + 1) ELSE 0 END) AS idcg, count(*) FILTER (relevance > 0) AS relevant FROM best GROUP BY 1)
    SELECT query_id, round(dcg / idcg, 6) AS ndcg, round(hits / relevant, 6) AS recall FROM ideal JOIN got USING (query_id) WHERE relevant > 0
    """,
)
def _(spark, at):
    judged = A.judged_once(_t(spark, at, "qrels"))
    ranked = judged.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).alias("rank"))
    return evaluate.ndcg_recall(ranked, judged).select("query_id", _r(F.col("ndcg")).alias("ndcg"), _r(F.col("recall")).alias("recall"))


@query(
    "mrr_acc",
    """
    WITH r AS (SELECT query_id, graph_node_data.node_type AS t, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC NULLS LAST, node_key) AS rank FROM tree_nodes),
    f AS (SELECT query_id, min(rank) FILTER (t = 'Method' AND rank <= 5) AS rank FROM r GROUP BY 1)
    SELECT query_id, rank, round(coalesce(1 / log2(rank + 1), 0), 6) AS ndcg, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall FROM f
    """,
)
def _(spark, at):
    t = _t(spark, at, "tree_nodes").select("query_id", "node_key", "retrieval_score", F.col("graph_node_data.node_type").alias("kind"))
    ranked = t.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("retrieval_score"), "node_key")))
    wanted = t.select("query_id").distinct().withColumn("kind", F.lit("Method"))
    return evaluate.first_hit(ranked, wanted, ["kind"], 5).withColumn("ndcg", _r(F.col("ndcg")))


@query(
    "macro_micro_avg",
    "SELECT round(sum(o_totalprice) / count(o_totalprice), 4) AS micro, round((SELECT avg(a) FROM (SELECT avg(o_totalprice) AS a FROM orders GROUP BY o_custkey)), 4) AS macro FROM orders",
)
def _(spark, at):
    r = A.macro_micro(_t(spark, at, "orders"), "o_custkey", "o_totalprice")
    return r.select(_r(F.col("micro_o_totalprice"), 4).alias("micro"), _r(F.col("macro_o_totalprice"), 4).alias("macro"))


@query("weighted_mean", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax FROM lineitem")
def _(spark, at):
    r = A.weighted_mean(_t(spark, at, "lineitem"), "l_quantity", "l_discount", "l_tax")
    return r.select(_r(F.col("l_discount")).alias("l_discount"), _r(F.col("l_tax")).alias("l_tax"))


@query(
    "median_hist",
    "SELECT least(floor((p_retailprice - 0) / 125) + 1, 20)::INT AS bin, count(*) AS n FROM part WHERE p_retailprice BETWEEN 0 AND 2500 GROUP BY 1",
)
def _(spark, at):
    return A.spread(_t(spark, at, "part"), "p_retailprice", 0.0, 2500.0)


@query("value_summary", "SELECT count(c_acctbal) AS n, min(c_acctbal) AS least, max(c_acctbal) AS greatest, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM customer")
def _(spark, at):
    return A.summary(_t(spark, at, "customer"), "c_acctbal").withColumn("mean", _r(F.col("mean"))).withColumn("median", _r(F.col("median")))


@query("frequent_repos", "SELECT repo, count(*) AS n FROM docs GROUP BY repo HAVING count(*) >= 5")
def _(spark, at):
    return A.frequent_repos(_t(spark, at, "docs"), 5)


@query(
    "repo_mapping",
    """
    WITH r AS (SELECT DISTINCT doc_id, repo FROM docs) SELECT d.repo, doc_count, qrels_count FROM (SELECT repo, count(*) AS doc_count FROM docs GROUP BY 1) d
    JOIN (SELECT repo, count(*) AS qrels_count FROM qrels JOIN r USING (doc_id) GROUP BY 1) q ON q.repo = d.repo
    """,
)
def _(spark, at):
    docs = _t(spark, at, "docs")
    return A.both_present(docs, _t(spark, at, "qrels"), docs.select("doc_id", "repo").distinct())


@query("rollup_average", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def _(spark, at):
    return A.rolled_up(_t(spark, at, "orders"), "o_orderpriority", "o_totalprice").withColumn("o_totalprice", _r(F.col("o_totalprice"), 4))


@query(
    "search_constants",
    """
    SELECT p_partkey, CASE WHEN p_partkey < 20 THEN greatest(1, p_partkey // 2) ELSE least(round_even(p_partkey / 10, 0) * 5, 200) + 15 END::INT AS k,
      round(1 / (8 * sqrt(ln(4 * (CASE WHEN p_partkey < 20 THEN greatest(1, p_partkey // 2) ELSE least(round_even(p_partkey / 10, 0) * 5, 200) + 15 END)))), 6) AS c FROM part
    """,
)
def _(spark, at):
    k = ranking.adaptive_k(F.col("p_partkey"))
    return _t(spark, at, "part").select("p_partkey", k.alias("k"), _r(ranking.exploration(k)).alias("c"))


@query(
    "retrieval_scores",
    "SELECT node_key, floor((CASE WHEN visit_count > 0 THEN 0.5::DOUBLE * total_reward / visit_count + 0.5::DOUBLE * 10 * coalesce(retrieval_score, 0) ELSE 0 END) * 1000000 + 0.5) / 1000000 AS score FROM tree_nodes",
)
def _(spark, at):
    t = _t(spark, at, "tree_nodes")
    s = ranking.retrieval_score(F.col("total_reward"), F.col("visit_count"), F.coalesce("retrieval_score", F.lit(0.0)), 0.5)
    return t.select("node_key", ranking.at_sixth(s).alias("score"))


@query("tree_sizes", "SELECT query_id, count(*) AS nodes FROM tree_nodes GROUP BY query_id")
def _(spark, at):
    e = _t(spark, at, "tree_nodes").select("query_id", "node_key", "parent_key")
    return e.groupBy("query_id").agg(F.count("node_key").alias("nodes"))


# ---------------------------------------------------------------- walks and parsing


def _space(spark, at) -> DataFrame:
    t = _t(spark, at, "tree_nodes")
    d = F.col("graph_node_data")
    nodes = t.select("query_id", F.col("node_key").cast("string").alias("node_id"), F.when(F.col("parent_key").isNull(), "Repo").otherwise(d["node_type"]).alias("label"), d["embedding"].alias("embedding"), "parent_key", "total_reward", "visit_count")
    kids = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").cast("bigint").cast("string").alias("node_id")).agg(F.collect_list("node_id").alias("children"))
    roots = nodes.where("label = 'Repo'").select("query_id", F.col("embedding").alias("q"))
    sizes = nodes.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    joined = nodes.join(kids, "node_id", "left").join(roots, "query_id").join(sizes, "query_id")
    similarity = F.greatest(vectors.cosine("embedding", "q"), F.lit(0.01))
    return joined.select("query_id", "node_id", "label", "children", F.lit(None).cast("array<string>").alias("users"), similarity.alias("similarity"), vectors.clamped(similarity).alias("reward"), (F.col("size") + 1).alias("size"))


@query("mcts_rank")
def _(spark, at):
    return mcts.search(_space(spark, at), mcts.Settings(iterations=50, k=5, k_least=2))


@query("mcts_traces")
def _(spark, at):
    return mcts.traces(_space(spark, at), mcts.Settings(iterations=50, k=5, k_least=2)).select("query_id", "nodes", F.size("selected").alias("selections"))


def _python_files(spark, at) -> DataFrame:
    d = _t(spark, at, "docs").where("func_name IS NULL AND path LIKE '%.py' AND code IS NOT NULL").select("repo", "path", "code").dropDuplicates(["repo", "path"])
    return readers.numbered_files(d.select("repo", "path", F.col("code").alias("content")))


@query("parse_graph_counts")
def _(spark, at):
    nodes, _edges, errors = parse.raw_records(parse.parse_files(_python_files(spark, at)))
    counts = nodes.groupBy("repo", F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(errors.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select("repo", F.lit("error").alias("kind"), "n"))


@query("build_graph_counts")
def _(spark, at):
    raw_nodes, raw_edges, _errors = parse.raw_records(parse.parse_files(_python_files(spark, at)))
    nodes, edges = build.build_graph(raw_nodes, raw_edges)
    return A.label_counts(nodes).select("label", "n").unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def queries() -> dict[str, Query]:
    from . import library  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import library  # noqa: F401 - registers its queries

    return dict(SQL)

