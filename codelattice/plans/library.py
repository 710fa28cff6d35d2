"""Queries that take the library's functions one by one over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking, vectors
from ..functions import text as T
from ..model import EDGES, NODES, conform, node_id
from ..operators import aggregates as A
from ..operators import build, cypher, enrich, evaluate, pattern, pipelines, retrieval, traverse
from ..session import own_dir
from ..sources import readers, sinks
from .catalogue import SQL, _r, _t, query
from .graph_view import GRAPH_SQL, graph_view


def graph_query(name: str, sql: str):
    """Registers a query that takes (spark, at) and whose SQL may use the tables nodes and edges of the graph view."""
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    return query(name, f"WITH {recursive}{GRAPH_SQL}{sql.replace('RECURSIVE', '')}")


# ---------------------------------------------------------------- the query language

_BOTH = ", und AS (SELECT src AS s, dst AS t, type FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE src <> dst)"


@query("cypher_undirected_two_hops", f"{_BOTH} SELECT a.name AS a, c.name AS c, count(*) AS n FROM nodes a JOIN und x ON x.s = a.node_id AND x.type = 'CONTAINS' JOIN und y ON y.s = x.t AND y.type = 'CONTAINS' AND y.t <> x.s JOIN nodes c ON c.node_id = y.t WHERE a.label = 'Module' AND c.label = 'Module' GROUP BY 1, 2", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (a:Module)-[:CONTAINS]-(b)-[:CONTAINS]-(c:Module) RETURN a.name AS a, c.name AS c, count(*) AS n", nodes, edges)


@query("cypher_self_loop", f"{_BOTH} SELECT s AS node_id, count(*) AS n FROM und WHERE type = 'INHERITS' GROUP BY s", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (a:GlobalVariable)-[:INHERITS]-(b:GlobalVariable) RETURN elementId(a) AS node_id, count(b) AS n", nodes, edges)


@query(
    "cypher_long_path",
    """
    , RECURSIVE walk(node, depth, looped) AS (SELECT 'GlobalVariable:199', 0, false
      UNION ALL SELECT e.dst, depth + 1, e.src = e.dst FROM walk JOIN edges e ON e.src = node WHERE e.type = 'INHERITS' AND NOT looped)
    SELECT node AS node_id, count(*) AS n FROM walk WHERE depth > 0 GROUP BY node
    """,
    graph=True,
)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (a:GlobalVariable) WHERE elementId(a) = $id MATCH (a)-[:INHERITS*]->(b) RETURN elementId(b) AS node_id, count(*) AS n", nodes, edges, id="GlobalVariable:199")


@query("cypher_path_lengths", "SELECT r.name AS repo, count(*) AS n FROM nodes r JOIN edges a ON a.src = r.node_id JOIN edges b ON b.src = a.dst WHERE r.label = 'Repo' AND a.type = 'CONTAINS' AND b.type = 'CONTAINS' GROUP BY r.name", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (r:Repo)-[:CONTAINS*2..2]->(x) RETURN r.name AS repo, count(x) AS n", nodes, edges)


@query("cypher_relationship_types", "SELECT m.name AS module, e.type AS kind, count(*) AS n FROM nodes m JOIN edges e ON e.src = m.node_id WHERE m.label = 'Module' GROUP BY 1, 2", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (m:Module)-[r]->(x) RETURN m.name AS module, type(r) AS kind, count(*) AS n", nodes, edges)


@query("cypher_unwind_parameters", "SELECT name, node_id FROM nodes WHERE label = 'Repo' AND name IN ('ASIA', 'EUROPE')", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("UNWIND $names AS n MATCH (r:Repo) WHERE r.name = n RETURN r.name AS name, elementId(r) AS node_id", nodes, edges, names=["ASIA", "EUROPE", "NOWHERE"])


@query("cypher_comma_pattern", "SELECT r.name AS repo, count(*) AS n FROM nodes r, nodes m WHERE r.label = 'Repo' AND m.label = 'Module' AND contains(m.name, 'I') GROUP BY 1", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (r:Repo), (m:Module) WHERE m.name CONTAINS 'I' RETURN r.name AS repo, count(m) AS n", nodes, edges)


@query("cypher_case_order_skip", "SELECT name, size FROM (SELECT name, CASE WHEN length(name) > 6 THEN 'long' ELSE 'short' END AS size, row_number() OVER (ORDER BY name DESC) AS k FROM nodes WHERE label = 'Module') WHERE k BETWEEN 3 AND 12", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (m:Module) RETURN m.name AS name, CASE WHEN size(m.name) > 6 THEN 'long' ELSE 'short' END AS size ORDER BY name DESC SKIP 2 LIMIT 10", nodes, edges)


@query("not_exists_rich_classes", "SELECT node_id FROM nodes WHERE label = 'GlobalVariable' AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = node_id AND type = 'INHERITS' AND src <> dst)", graph=True)
def _(nodes, edges):
    return cypher.run_cypher("MATCH (g:GlobalVariable) WHERE NOT (g)<-[:INHERITS]-() RETURN elementId(g) AS node_id", nodes, edges.where("src <> dst"))


# ---------------------------------------------------------------- lookups and walks


@query("repo_root", "SELECT node_id, name FROM nodes WHERE label = 'Repo' AND name = 'ASIA'", graph=True)
def _(nodes, edges):
    return traverse.repo_root(nodes, "ASIA").select("node_id", "name")


@query(
    "node_identities",
    """
    SELECT node_key, coalesce(repo, '') || '/' || t || ':' || CASE t WHEN 'Module' THEN n WHEN 'GlobalVariable' THEN n || ':' || m WHEN 'Method' THEN n || ':' || c || ':' || s || ':' || m ELSE n || ':' || s || ':' || m END AS node_id
    FROM (SELECT node_key, repo, graph_node_data.node_type AS t, coalesce(graph_node_data.name, '') AS n, coalesce(graph_node_data.signature, '') AS s, coalesce(graph_node_data.module_name, '') AS m, coalesce(graph_node_data.class_name, '') AS c FROM tree_nodes)
    WHERE t IN ('Module', 'GlobalVariable', 'Method', 'Class', 'Function')
    """,
)
def _(spark, at):
    return _tree(spark, at).where("label IN ('Module', 'GlobalVariable', 'Method', 'Class', 'Function')").select("node_key", node_id().alias("node_id"))


def _tree(spark, at) -> DataFrame:
    """tree_nodes with the columns of nodes."""
    d = F.col("graph_node_data")
    columns = {"label": "node_type", "name": "name", "signature": "signature", "module_name": "module_name", "class": "class_name", "code": "code", "description": "description", "embedding": "embedding"}
    return _t(spark, at, "tree_nodes").select("query_id", "node_key", "parent_key", "repo", "visit_count", "total_reward", "retrieval_score", *(d[v].alias(k) for k, v in columns.items()), F.lit(None).cast("string").alias("module"))


@query("callers_by_name", "SELECT DISTINCT s.node_id FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes t ON t.node_id = e.dst WHERE e.type = 'USES' AND t.name = (SELECT min(name) FROM nodes WHERE label = 'Function')", graph=True)
def _(nodes, edges):
    name = nodes.where("label = 'Function'").agg(F.min("name")).first()[0]
    return traverse.called_by_name(nodes, edges, name, callers=True).select("node_id")


@query(
    "neighbours_with_embedding",
    """
    , v AS (SELECT 'GlobalVariable:' || vec_id AS id FROM embeddings)
    SELECT DISTINCT e.src AS start, e.dst AS node_id FROM edges e JOIN nodes s ON s.node_id = e.src JOIN v ON v.id = e.dst WHERE s.label = 'Method' AND e.type = 'USES' AND e.dst IN (SELECT node_id FROM nodes)
    """,
    graph=True,
)
def _(nodes, edges):
    return traverse.connected_with_embedding(nodes, edges, nodes.where("label IN ('Method', 'Module')")).select("start", "node_id")


@query(
    "specification_answer",
    """
    , a AS (SELECT node_id FROM nodes WHERE lower(name) = 'asia' ORDER BY node_id LIMIT 5),
    b AS (SELECT e.src, e.dst FROM edges e JOIN nodes s ON s.node_id = e.src WHERE e.type = 'CONTAINS' AND contains(lower(s.name), 'europe') ORDER BY e.src, e.dst LIMIT 5)
    SELECT node_id FROM a UNION SELECT src FROM b UNION SELECT dst FROM b
    """,
    graph=True,
)
def _(nodes, edges):
    spec = {"entities": [{"name": "Asia", "type": "Repo"}], "relationships": [{"type": "CONTAINS", "source": "Europe"}]}
    return traverse.answer_spec(nodes, edges, spec).select("node_id")


@query("distinct_results", "SELECT min(node_id) AS node_id FROM nodes GROUP BY CASE label WHEN 'Method' THEN 'M' || name || '|' || class ELSE node_id END", graph=True)
def _(nodes, edges):
    plain = nodes.where("label = 'Method'").unionByName(nodes.where("label <> 'Method'").withColumn("signature", F.col("node_id")).withColumn("name", F.col("node_id")))
    return traverse.distinct_nodes(plain).select("node_id")


@query(
    "ranked_context",
    """
    , q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3), seeds AS (SELECT node_id FROM nodes WHERE label = 'GlobalVariable' AND contains(name, 'a')),
    v AS (SELECT n.node_id, length(p_type) AS size, coalesce(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 0) AS sim FROM seeds n JOIN part ON n.node_id = 'GlobalVariable:' || p_partkey LEFT JOIN embeddings ON vec_id = p_partkey),
    run AS (SELECT node_id, sum(size) OVER (ORDER BY sim DESC, node_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM v)
    SELECT node_id, used FROM run WHERE used <= 2000
    """,
    graph=True,
)
def _(nodes, edges):
    seeds = nodes.where("label = 'GlobalVariable' AND contains(name, 'a')").withColumn("signature", F.col("node_id")).withColumn("name", F.col("node_id"))
    question = nodes.where("node_id = 'GlobalVariable:3'").select("embedding").first()[0]
    q = F.array(*(F.lit(float(x)) for x in question))
    return traverse.ranked_context(nodes, edges, seeds, q, 2000).select("node_id", "used")


@query(
    "expanded_results",
    """
    , start AS (SELECT * FROM (VALUES ('Module:3', 2), ('Class:5', 1), ('Repo:0', 3), ('Function:1', 0)) t(node_id, position)),
    below AS (SELECT e.dst AS node_id, position FROM start JOIN edges e ON e.src = start.node_id AND e.type = 'CONTAINS' WHERE start.node_id LIKE 'Module:%'),
    part_of AS (SELECT node_id, position, 0 AS step FROM start WHERE node_id NOT LIKE 'Module:%' UNION ALL SELECT node_id, position, 1 FROM below
      UNION ALL SELECT e.dst, position, 1 FROM below b JOIN edges e ON e.src = b.node_id AND e.type = 'HAS_METHOD'
      UNION ALL SELECT e.dst, position, 1 FROM start JOIN edges e ON e.src = start.node_id AND e.type = 'HAS_METHOD' WHERE start.node_id LIKE 'Class:%'),
    best AS (SELECT node_id, arg_min(position, position * 10 + step) AS position, min(position * 10 + step) AS place FROM part_of GROUP BY 1),
    keyed AS (SELECT b.*, row_number() OVER (PARTITION BY n.name, coalesce(n.module_name, ''), coalesce(n.class, '') ORDER BY place, b.node_id) AS k FROM best b JOIN nodes n USING (node_id))
    SELECT node_id, position FROM keyed WHERE k = 1
    """,
    graph=True,
)
def _(nodes, edges):
    start = nodes.sparkSession.createDataFrame([("Module:3", 2), ("Class:5", 1), ("Repo:0", 3), ("Function:1", 0)], "node_id string, position int")
    return traverse.expanded(nodes, edges, start).select("node_id", F.col("at.position").alias("position"))


@query(
    "uses_closure_within",
    """
    , c AS (SELECT node_id FROM nodes WHERE label IN ('Method', 'Function')), reached AS (SELECT e.dst AS node_id FROM edges e JOIN c ON c.node_id = e.src WHERE e.type = 'USES' AND e.src LIKE 'Method:%' AND e.dst IN (SELECT node_id FROM c))
    SELECT node_id, 0 AS depth FROM nodes WHERE label = 'Method' UNION SELECT node_id, 1 FROM reached
    """,
    graph=True,
)
def _(nodes, edges):
    corpus = nodes.where("label IN ('Method', 'Function')")
    return pattern.closure(nodes.where("label = 'Method'"), edges, "USES", within=corpus)


@query(
    "way_to_the_root",
    """
    , seed AS (SELECT 'Method:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT DISTINCT e.src AS node_id FROM seed JOIN edges e ON e.dst = seed.node_id AND e.type = 'HAS_METHOD'),
    m AS (SELECT DISTINCT e.src AS node_id FROM c JOIN edges e ON e.dst = c.node_id AND e.type = 'CONTAINS'), r AS (SELECT DISTINCT e.src AS node_id FROM m JOIN edges e ON e.dst = m.node_id AND e.type = 'CONTAINS')
    SELECT node_id, 0 AS depth FROM seed UNION ALL SELECT node_id, 1 FROM c UNION ALL SELECT node_id, 2 FROM m UNION ALL SELECT node_id, 3 FROM r
    """,
    graph=False,
)
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    seed = _t(spark, at, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("Method:"), F.col("o_orderkey")).alias("node_id"))
    return pattern.closure(seed, edges, "CONTAINS", "HAS_METHOD", direction="in")


SQL["way_to_the_root"] = "WITH " + GRAPH_SQL + SQL["way_to_the_root"]


@query(
    "corpus_matches",
    """
    WITH t AS (SELECT DISTINCT n_nationkey % 3 AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'elsewhere' END AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0)
    SELECT DISTINCT 'Function:' || s_suppkey AS node_id FROM supplier JOIN t ON s_name = t.name
    """,
)
def _(spark, at):
    nodes, _edges = graph_view(spark, at)
    s = _t(spark, at, "supplier").join(_t(spark, at, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 5 = 0")
    targets = s.select(F.lit("r").alias("repo"), F.lit(None).cast("string").alias("class"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("elsewhere").alias("module_name")).distinct()
    return traverse.corpus_nodes(targets, nodes.withColumn("repo", F.lit("r")))


@query(
    "pruned_graph",
    """
    , seed AS (SELECT 'Function:' || s_suppkey AS node_id FROM supplier WHERE s_suppkey % 7 = 0 UNION SELECT DISTINCT 'Method:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 50 = 1),
    own AS (SELECT DISTINCT e.src AS node_id FROM seed JOIN edges e ON e.dst = seed.node_id AND e.type IN ('CONTAINS', 'HAS_METHOD')),
    kin AS (SELECT e.dst AS node_id FROM own JOIN edges e ON e.src = own.node_id AND e.type = 'HAS_METHOD'),
    up AS (SELECT e.src AS node_id FROM own JOIN edges e ON e.dst = own.node_id AND e.type = 'CONTAINS'), top AS (SELECT e.src AS node_id FROM up JOIN edges e ON e.dst = up.node_id AND e.type = 'CONTAINS')
    SELECT node_id FROM seed UNION SELECT node_id FROM own UNION SELECT node_id FROM kin UNION SELECT node_id FROM up UNION SELECT node_id FROM top
    """,
    graph=False,
)
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    nodes = nodes.withColumn("repo", F.lit("r"))
    funcs = _t(spark, at, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("Function:"), F.col("s_suppkey")).alias("node_id"))
    meths = _t(spark, at, "orders").where("o_custkey % 50 = 1").select(F.concat(F.lit("Method:"), F.col("o_orderkey")).alias("node_id"))
    wanted = nodes.join(funcs.unionByName(meths), "node_id", "left_semi").withColumn("name", F.col("node_id"))
    named = nodes.withColumn("name", F.when(F.col("label").isin("Function", "Method"), F.col("node_id")).otherwise(F.col("name")))
    return traverse.prune_to_corpus(named, edges, wanted.select("repo", "class", "name", "module_name"))[0].select("node_id")


SQL["pruned_graph"] = "WITH " + GRAPH_SQL + SQL["pruned_graph"]


@query("classes_with_methods", "SELECT 'q' AS query_id, node_id, rank FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS rank FROM nodes WHERE label = 'Class') UNION ALL SELECT 'q', e.dst, rank FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS rank FROM nodes WHERE label = 'Class') c JOIN edges e ON e.src = c.node_id AND e.type = 'HAS_METHOD'", graph=True)
def _(nodes, edges):
    classes = nodes.where("label = 'Class'").select(F.lit("q").alias("query_id"), "node_id", F.row_number().over(Window.orderBy("node_id")).alias("rank"))
    methods = edges.where("type = 'HAS_METHOD'").select(F.col("src").alias("class_id"), F.col("dst").alias("node_id"))
    return evaluate.expand_classes(classes, methods)


# ---------------------------------------------------------------- changes to the graph


@query(
    "merged_nodes",
    """
    WITH raw AS (SELECT 'r' || (user_id % 5) AS repo, 'v' || (user_id % 97) AS name, event_type AS module_name, CAST(value AS VARCHAR) AS code, row_number() OVER (ORDER BY event_id) AS ord FROM events)
    SELECT repo || '/GlobalVariable:' || name || ':' || module_name AS node_id, arg_max(ord, ord)::INT AS file_ord FROM raw GROUP BY 1
    """,
)
def _(spark, at):
    e = _t(spark, at, "events")
    raw = e.select(
        F.concat(F.lit("r"), F.col("user_id") % 5).alias("repo"), F.lit("GlobalVariable").alias("type"), F.concat(F.lit("v"), F.col("user_id") % 97).alias("name"), F.col("event_type").alias("module_name"),
        F.col("value").cast("string").alias("code"), F.row_number().over(Window.orderBy("event_id")).alias("file_ord"), *(F.lit(None).cast("string").alias(c) for c in ("local_name", "class", "signature", "module", "alias", "dotted_folder_name")),
    )
    return build.merged_nodes(raw).select("node_id", "file_ord")


@query("repo_edges", "SELECT DISTINCT 'Repo:' || repo AS src, repo || '/Module:' || graph_node_data.name AS dst FROM tree_nodes WHERE graph_node_data.node_type = 'Module' AND repo IS NOT NULL AND graph_node_data.name IS NOT NULL")
def _(spark, at):
    nodes = _tree(spark, at).where("label = 'Module' AND name IS NOT NULL").withColumn("node_id", node_id())
    return build.repo_nodes(conform(nodes, NODES).dropDuplicates(["node_id"]))[1].select("src", "dst")


@query(
    "resolved_edges",
    """
    WITH m AS (SELECT DISTINCT p_brand AS m FROM part), v AS (SELECT DISTINCT p_name AS n, p_brand AS m FROM part), i AS (SELECT DISTINCT p_type AS n, p_brand AS o, p_name AS a FROM part)
    SELECT 'r/Module:' || p_brand AS src, 'r/GlobalVariable:' || p_name || ':' || p_brand AS dst, 'CONTAINS' AS type FROM part
    UNION SELECT 'r/GlobalVariable:' || p_name || ':' || p_brand, 'r/Import:' || i.n || ':' || i.o, 'USES' FROM part JOIN i ON i.n = p_type WHERE p_size % 2 = 0
    UNION SELECT 'r/GlobalVariable:' || p_name || ':' || p_brand, 'r/Import:' || i.n || ':' || i.o, 'USES' FROM part JOIN i ON i.a = p_name WHERE p_size % 2 = 1
    """,
)
def _(spark, at):
    part = _t(spark, at, "part")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    made = lambda label, name, **cols: conform(part.select(F.lit("r").alias("repo"), F.lit(label).alias("label"), F.col(name).alias("name"), *(F.col(v).alias(k) for k, v in cols.items())), NODES)
    nodes = made("Module", "p_brand").unionByName(made("GlobalVariable", "p_name", module_name="p_brand")).unionByName(made("Import", "p_type", module="p_brand", alias="p_name"))
    nodes = nodes.withColumn("node_id", node_id()).dropDuplicates(["node_id", "alias"])
    base = part.select(F.lit("r").alias("repo"), "p_name", "p_brand", "p_type", "p_size")

    def raw(df, kind, source, source_kind, target, target_kind):
        return df.select("repo", F.lit(kind).alias("type"), source.alias("source"), F.lit(source_kind).alias("source_association_type"), target.alias("target"), F.lit(target_kind).alias("target_association_type"), F.col("p_brand").alias("source_module_name"), F.col("p_brand").alias("target_module_name"), *none("source_signature", "target_signature", "source_class", "target_class"))

    name = F.col("p_name")
    records = raw(base, "CONTAINS", F.col("p_brand"), "Module", name, "GlobalVariable").unionByName(raw(base.where("p_size % 2 = 0"), "USES", name, "GlobalVariable", F.col("p_type"), "Import"))
    records = records.unionByName(raw(base.where("p_size % 2 = 1"), "USES", name, "GlobalVariable", name, "Import")).unionByName(raw(base, "INHERITS", name, "GlobalVariable", name, "GlobalVariable"))
    return build.edges_of(records, nodes).select("src", "dst", "type")


@query(
    "redirected_edges",
    """
    , m AS (SELECT 'Function:' || s_suppkey AS id, 'Module:' || s_nationkey AS target FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT DISTINCT src, coalesce(target, dst) AS dst, type, CASE WHEN target IS NOT NULL AND type = 'USES' THEN 'Module' END AS kind FROM edges LEFT JOIN m ON m.id = dst WHERE src NOT IN (SELECT id FROM m)
    """,
    graph=False,
)
def _(spark, at):
    _nodes, edges = graph_view(spark, at)
    m = _t(spark, at, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("Function:"), F.col("s_suppkey")).alias("import_id"), F.concat(F.lit("Module:"), F.col("s_nationkey")).alias("target"), F.lit("Module").alias("label"))
    return build.redirected(edges, m).select("src", "dst", "type", F.col("target_association_type").alias("kind"))


SQL["redirected_edges"] = "WITH " + GRAPH_SQL + SQL["redirected_edges"]


@query("labels_deleted", "SELECT type, count(*) AS n FROM edges WHERE src NOT LIKE 'Function:%' AND dst NOT LIKE 'Function:%' GROUP BY type", graph=True)
def _(nodes, edges):
    return build.delete_labels(nodes, edges, "Function", "Import")[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("repo_deleted", "SELECT label, count(*) AS n FROM nodes WHERE coalesce(module_name, '') <> (SELECT min(n_name) FROM nation) GROUP BY label", graph=True)
def _(nodes, edges):
    name = nodes.where("label = 'Module'").agg(F.min("name")).first()[0]
    return A.label_counts(build.delete_repo(nodes.withColumn("repo", F.coalesce("module_name", F.lit(""))), edges, name)[0])


@query("kept_only", "SELECT type, count(*) AS n FROM edges WHERE (src LIKE 'Method:%' OR src LIKE 'Class:%') AND (dst LIKE 'Method:%' OR dst LIKE 'Class:%') GROUP BY type", graph=True)
def _(nodes, edges):
    return build.keep_only(nodes, edges, nodes.where("label IN ('Method', 'Class')"))[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("cleared_graph", "SELECT count(*) AS nodes, 0::BIGINT AS edges FROM region WHERE false")
def _(spark, at):
    nodes, edges = build.cleared(*graph_view(spark, at))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


@query("broken_identities", "SELECT name AS node_id, count(*) AS n FROM nodes WHERE label = 'GlobalVariable' GROUP BY name HAVING count(*) > 1", graph=True)
def _(nodes, edges):
    return build.broken_keys(nodes.where("label = 'GlobalVariable'").withColumn("node_id", F.col("name")))


@query(
    "updated_nodes",
    """
    WITH u AS (SELECT p_name AS name, p_brand AS module_name, arg_max(p_comment, p_partkey) AS new FROM (SELECT *, p_type || ' ' || p_size AS p_comment FROM part WHERE p_size > 20) GROUP BY 1, 2)
    SELECT 'GlobalVariable:' || p_partkey AS node_id, coalesce(new, p_type) AS code FROM part LEFT JOIN u ON u.name = p_name AND u.module_name = p_brand
    """,
)
def _(spark, at):
    nodes, _edges = graph_view(spark, at)
    part = _t(spark, at, "part").where("p_size > 20").select(F.col("p_name").alias("name"), F.col("p_brand").alias("module_name"), F.concat_ws(" ", "p_type", "p_size").alias("code"), "p_partkey")
    return build.update_nodes(nodes.where("label = 'GlobalVariable'"), part, "code", keys=("name", "module_name"), scoped=False, order="p_partkey").select("node_id", "code")


@query(
    "import_resolution_modules",
    """
    WITH mods AS (SELECT p_brand AS name, min(p_partkey) AS k FROM part GROUP BY 1), imp AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part),
    mem AS (SELECT DISTINCT p_brand AS within, p_name AS name FROM part), imp2 AS (SELECT DISTINCT p_name AS name, p_brand AS module FROM part)
    SELECT 'w:' || name AS import_id, 'Module:' || name AS target, 0 AS tier FROM imp JOIN mods USING (name)
    UNION ALL SELECT 'm:' || name || '@' || module, 'GlobalVariable:' || name || '@' || module, 2 FROM imp2
    """,
)
def _(spark, at):
    part, s = _t(spark, at, "part"), lambda x: F.lit(x).cast("string")
    base = lambda df, i, label, name, **cols: conform(df.select(i.alias("node_id"), F.lit(label).alias("label"), F.lit("r").alias("repo"), name.alias("name"), *(v.alias(k) for k, v in cols.items())), NODES)
    brand, name = F.col("p_brand"), F.col("p_name")
    mods = base(part.select("p_brand").distinct(), F.concat(F.lit("Module:"), brand), "Module", brand, local_name=s(None))
    pairs = part.select("p_name", "p_brand").distinct()
    mem = base(pairs, F.concat(F.lit("GlobalVariable:"), name, F.lit("@"), brand), "GlobalVariable", name, module_name=brand)
    whole = part.select(F.explode(F.array("p_brand", "p_type")).alias("n")).distinct()
    imports = base(whole, F.concat(F.lit("w:"), F.col("n")), "Import", F.col("n"), module=F.col("n"), dotted_folder_name=s("pkg"))
    imports = imports.unionByName(base(pairs, F.concat(F.lit("m:"), name, F.lit("@"), brand), "Import", name, module=brand, dotted_folder_name=s("pkg")))
    edges = conform(pairs.select(F.concat(F.lit("Module:"), brand).alias("src"), F.concat(F.lit("GlobalVariable:"), name, F.lit("@"), brand).alias("dst"), F.lit("CONTAINS").alias("type")), EDGES)
    return build.match_imports(imports, mods.unionByName(mem), edges, by_name=False).select("import_id", "target", "tier")


@query(
    "contains_targets",
    """
    WITH r AS (SELECT DISTINCT n_name AS module_name, s_name AS target_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT module_name, target_name, 'Function:' || min(s_suppkey::VARCHAR) AS target, 1 AS tier FROM r JOIN nation ON n_name = module_name JOIN supplier ON s_nationkey = n_nationkey AND s_name = target_name GROUP BY 1, 2
    """,
)
def _(spark, at):
    nodes, _edges = graph_view(spark, at)
    nodes = nodes.withColumn("repo", F.lit("r"))
    records = nodes.where("label = 'Function'").select("repo", "module_name", F.col("name").alias("target_name")).distinct()
    return build.contains_targets(records, nodes).select("module_name", "target_name", "target", "tier")


# ---------------------------------------------------------------- statistics


@query("repositories", "SELECT DISTINCT name FROM nodes WHERE label = 'Repo'", graph=True)
def _(nodes, edges):
    return A.repositories(nodes)


@query("largest_repositories", "SELECT r.name AS repo_name, count(e.dst) + count(DISTINCT n.n_nationkey) AS total FROM nodes r JOIN nation n ON r.node_id = 'Repo:' || n_regionkey JOIN edges e ON e.src = 'Module:' || n_nationkey AND e.type = 'CONTAINS' WHERE r.label = 'Repo' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", graph=True)
def _(nodes, edges):
    return A.largest(A.repo_statistics(nodes, edges, methods=False), 3).select("repo_name", "total")


@query("python_file_counts", "SELECT repo, count(*) AS python_files FROM docs WHERE path LIKE '%.py' GROUP BY repo")
def _(spark, at):
    return A.python_file_counts(_t(spark, at, "docs"))


@query("documents_by_language", "SELECT repo, count(DISTINCT doc_id) AS n, string_agg(DISTINCT doc_id, ' ' ORDER BY doc_id) AS doc_ids FROM docs WHERE lower(trim(language)) = 'go' GROUP BY repo")
def _(spark, at):
    return A.documents_by_language(_t(spark, at, "docs"), "go").withColumn("doc_ids", F.array_join("doc_ids", " "))


_DETAILS = "details AS (SELECT o_custkey % 40 AS repo, o_orderstatus = 'F' AS hit, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 + 1 END AS rank, (o_orderkey % 100) / 100.0::DOUBLE AS sim FROM orders WHERE o_orderstatus <> 'P')"


def _details(spark, at) -> DataFrame:
    o, hit = _t(spark, at, "orders"), F.col("o_orderstatus") == "F"
    return o.select(
        (F.col("o_custkey") % 40).alias("repo"), hit.alias("found_match"), F.when(hit, F.col("o_orderkey") % 5 + 1).alias("match_rank"), (F.col("o_orderkey") % 100 / 100.0).alias("best_similarity"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error")
    )


@query(
    "by_repository",
    f"WITH {_DETAILS} SELECT repo, count(*) AS examples, count(*) FILTER (hit) AS correct, round(avg(hit::INT), 6) AS accuracy, round(avg(CASE WHEN hit THEN 1 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg, round(avg(sim), 6) AS similarity FROM details GROUP BY repo",
)
def _(spark, at):
    r = A.by_repository(_details(spark, at))
    return r.select("repo", "examples", "correct", *(_r(F.col(c)).alias(c) for c in ("accuracy", "mrr", "ndcg", "similarity")))


@query(
    "overall_results",
    f"WITH {_DETAILS}, per AS (SELECT repo, count(*) AS n, count(*) FILTER (hit) AS c, avg(CASE WHEN hit THEN 1 / rank ELSE 0 END) AS mrr, avg(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg FROM details GROUP BY repo) SELECT round(sum(c) / sum(n), 6) AS accuracy, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per WHERE repo NOT IN (0, 7)",
)
def _(spark, at):
    tracking = A.by_repository(_details(spark, at)).withColumnRenamed("examples", "total_examples").withColumnRenamed("correct", "correct_retrievals")
    r = A.overall(tracking, spark.createDataFrame([(0,), (7,)], "repo bigint"))
    return r.select(*(_r(F.col(c)).alias(c) for c in ("accuracy", "mrr", "ndcg")))


@query("averages_without", "SELECT count(*) AS queries, round(avg(o_totalprice), 3) AS price FROM orders WHERE o_custkey % 40 NOT IN (1, 2)")
def _(spark, at):
    o = _t(spark, at, "orders").groupBy((F.col("o_custkey") % 40).alias("repo")).agg(F.collect_list(F.struct(F.col("o_totalprice").alias("price"))).alias("queries"))
    r = A.averages_without(o, spark.createDataFrame([(1,), (2,)], "repo bigint"), "price")
    return r.select("queries", _r(F.col("price"), 3).alias("price"))


@query("only_in_one", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, at):
    return A.only_in(_t(spark, at, "customer").select(F.col("c_custkey").alias("k")), _t(spark, at, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@query("consolidated_summary", "SELECT repo, v FROM (SELECT o_custkey % 40 AS repo, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS v FROM orders GROUP BY 1) ORDER BY v DESC, repo LIMIT 10")
def _(spark, at):
    o = _t(spark, at, "orders").groupBy((F.col("o_custkey") % 40).alias("repo"))
    first, second = o.agg(F.count(F.lit(1)).alias("v")), o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("v"))
    return pipelines.summary_of([first, second], "v")[1].select("repo", "v")


@query("tree_node_counts", "SELECT query_id, count(*) AS nodes FROM tree_nodes GROUP BY query_id")
def _(spark, at):
    """Nodes reached from each root by the parents' links."""
    t = _t(spark, at, "tree_nodes").select(F.col("node_key").cast("string").alias("id"), F.col("parent_key").cast("bigint").cast("string").alias("up"), "query_id")
    edges = conform(t.where("up IS NOT NULL").select(F.col("up").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type")), EDGES)
    reached = pattern.closure(t.where("up IS NULL").select(F.col("id").alias("node_id")), edges, "CONTAINS")
    return reached.join(t.select(F.col("id").alias("node_id"), "query_id"), "node_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"))


# ---------------------------------------------------------------- text and vectors


@query("purpose_parts", r"SELECT doc_id, trim(regexp_extract(text, '(?s)\*\*Purpose\*\*:?\s*(.*)', 1)) <> '' AS marked, CASE WHEN text IS NOT NULL THEN regexp_replace(string_split_regex(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '\n[ \t\n\x0B\f\r]*\n')[1], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END AS purpose FROM documents WHERE NOT contains(text, '**Purpose**')")
def _(spark, at):
    d = _t(spark, at, "documents").where("NOT contains(text, '**Purpose**')")
    return d.select("doc_id", F.lit(False).alias("marked"), T.purpose(F.col("text")).alias("purpose"))


@query("numbered_descriptions", "SELECT n_name AS name, string_agg('**' || k || '. ' || s_name, chr(10) || chr(10) ORDER BY k) AS text FROM (SELECT n_name, s_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name")
def _(spark, at):
    s = _t(spark, at, "supplier").join(_t(spark, at, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    grouped = s.groupBy("n_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("d"))
    return grouped.select(F.col("n_name").alias("name"), T.numbered(F.col("d")).alias("text"))


@query("answer_lines", r"SELECT p_partkey, list_transform(list_filter([p_name, '', '---None---', p_type], lambda x: x <> '' AND x <> '---None---'), lambda x: p_brand || ' - ' || x)::VARCHAR AS lines FROM part")
def _(spark, at):
    p = _t(spark, at, "part")
    response = F.concat_ws("\n", F.concat(F.lit("  "), F.col("p_name")), F.lit(" "), F.lit("---None---"), F.col("p_type"))
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join(T.answer_lines(response, F.col("p_brand")), ", "), F.lit("]")).alias("lines"))


@query("extracted_queries", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'MATCH (n) RETURN ' || p_size WHEN 1 THEN 'MATCH (n {name: ''' || p_name || '''}) RETURN n' ELSE p_name END AS found FROM part")
def _(spark, at):
    p, k = _t(spark, at, "part"), F.col("p_partkey") % 3
    fenced = F.concat(F.lit("Here:\n```cypher\nMATCH (n) RETURN "), F.col("p_size"), F.lit("\n```\nas asked"))
    plain = F.concat(F.lit("I would say MATCH (n {name: '"), F.col("p_name"), F.lit("'}) RETURN n\nand so on"))
    return p.select("p_partkey", T.extract_query(F.when(k == 0, fenced).when(k == 1, plain).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n")))).alias("found"))


@query("safe_names", "SELECT DISTINCT repo, replace(replace(replace(repo, '/', '_'), ' ', '_'), ':', '_') AS name FROM docs")
def _(spark, at):
    return _t(spark, at, "docs").select("repo", T.safe_name(F.col("repo")).alias("name")).distinct()


@query("identifier_counts", "SELECT doc_id, max(len(list_distinct(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')))) AS n FROM docs WHERE code IS NOT NULL GROUP BY doc_id")
def _(spark, at):
    return _t(spark, at, "docs").where("code IS NOT NULL").select("doc_id", F.size(T.identifiers(F.col("code"))).alias("n")).groupBy("doc_id").agg(F.max("n").cast("bigint").alias("n"))


@query("context_fit", r"SELECT doc_id, n AS tokens, n + 7 + 3000 <= 3200 AS fits FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]')) AS n FROM documents WHERE text IS NOT NULL)")
def _(spark, at):
    d = _t(spark, at, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.token_count(F.col("text")).alias("tokens"), T.fits_context(F.col("text"), ["Describe this code:", "Say what the code is for."], 3200, 3000).alias("fits"))


@query("item_texts", "SELECT node_key, 'Name: ' || coalesce(graph_node_data.name, '') || ' | Signature: ' || coalesce(graph_node_data.signature, '') || ' | Code: ' || coalesce(graph_node_data.code, '') AS text FROM tree_nodes")
def _(spark, at):
    return _tree(spark, at).select("node_key", T.item_text(F.col("name"), F.col("signature"), F.col("code")).alias("text"))


@query("embedding_texts", "SELECT node_key, concat_ws(chr(10), graph_node_data.description, graph_node_data.signature) AS text FROM tree_nodes")
def _(spark, at):
    return _tree(spark, at).select("node_key", enrich.embedding_text(F.col("description"), F.col("signature")).alias("text"))


@query("upper_bounds", "SELECT node_key, CASE WHEN n.visit_count > 0 THEN floor((n.total_reward / n.visit_count + 0.1::DOUBLE * sqrt(2 * ln(greatest(p.visit_count, 1)) / n.visit_count)) * 1000000 + 0.5) / 1000000 END AS bound FROM tree_nodes n JOIN (SELECT DISTINCT node_key AS k, visit_count FROM tree_nodes) p ON p.k = n.parent_key")
def _(spark, at):
    t = _t(spark, at, "tree_nodes")
    p = t.select(F.col("node_key").alias("parent_key"), F.col("visit_count").alias("above")).distinct()
    return t.join(p, "parent_key").select("node_key", ranking.at_sixth(ranking.uct(F.col("total_reward"), F.col("visit_count"), F.col("above"), 0.1)).alias("bound"))


@query("clamped_products", "SELECT vec_id, round(least(greatest(10 * list_inner_product(list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::DOUBLE[], (SELECT list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::DOUBLE[] FROM embeddings WHERE vec_id = 4)), 0), 10), 4) AS score FROM embeddings")
def _(spark, at):
    e = _t(spark, at, "embeddings")
    q = e.where("vec_id = 4").select(vectors.normalised("embedding").alias("q"))
    return e.withColumn("u", vectors.normalised("embedding")).join(F.broadcast(q), F.lit(True)).select("vec_id", _r(vectors.clamped(vectors.dot("u", "q")), 4).alias("score"))


@query("similar_nodes", "SELECT node_key, round(s, 6) AS similarity FROM (SELECT node_key, coalesce(list_cosine_similarity(e, (SELECT graph_node_data.embedding::DOUBLE[] FROM tree_nodes WHERE node_key = (SELECT min(node_key) FROM tree_nodes WHERE len(graph_node_data.embedding) = 64 AND len(list_filter(graph_node_data.embedding, lambda x: isfinite(x) AND x <> 0)) > 0))), 0) AS s FROM (SELECT node_key, graph_node_data.embedding::DOUBLE[] AS e FROM tree_nodes WHERE len(graph_node_data.embedding) = 64 AND len(list_filter(graph_node_data.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(graph_node_data.embedding, lambda x: x <> 0)) > 0)) ORDER BY s DESC, node_key LIMIT 10")
def _(spark, at):
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    nodes = _tree(spark, at).where((F.size(e) == 64) & F.forall(e, finite) & F.exists(e, lambda x: x != 0)).withColumn("node_id", F.col("node_key"))
    first = nodes.orderBy("node_key").select("embedding").first()
    found = retrieval.similar_nodes(nodes, F.array(*(F.lit(float(x)) for x in (first[0] if first else []))), 10)
    return found.select("node_key", _r(F.col("similarity")).alias("similarity"))


@query(
    "search_vectors",
    """
    SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id) AS rank
      FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= 7
    """,
)
def _(spark, at):
    e = _t(spark, at, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.search_vectors(queries, e.select(F.col("vec_id").alias("id"), "embedding"), 7).select("query_id", "id", "rank")


# ---------------------------------------------------------------- contexts, evaluation, sinks

_COUNT = r"len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]'))"


@query(
    "packed_context",
    f"""
    WITH d AS (SELECT coalesce(lower(trim(source)), '?') AS query_id, doc_id AS position, text, {_COUNT} AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE position % 2 = 0),
    m AS (SELECT * FROM g WHERE used <= 3000), t AS (SELECT query_id, sum(n) AS main FROM m GROUP BY 1),
    c AS (SELECT d.*, coalesce(main, 0) AS main, sum(n) OVER (PARTITION BY d.query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM d LEFT JOIN t ON t.query_id = d.query_id WHERE position % 2 = 1)
    SELECT query_id, 'graph' AS source, position FROM m UNION ALL SELECT query_id, 'lexical', position FROM c WHERE used <= CASE WHEN main >= 3000 THEN least(1000, 4000 - main) ELSE 4000 - main END
    """,
)
def _(spark, at):
    d = _t(spark, at, "documents").where("text IS NOT NULL").select(F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("query_id"), F.col("doc_id").alias("position"), "text")
    return retrieval.packed_context(d.where("position % 2 = 0"), d.where("position % 2 = 1")).select("query_id", "source", "position")


@query(
    "packed_by_share",
    f"""
    WITH d AS (SELECT coalesce(lower(trim(source)), '?') AS query_id, doc_id AS position, text, {_COUNT} AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE position % 2 = 0),
    m AS (SELECT * FROM g WHERE used <= 3000), t AS (SELECT query_id, sum(n) AS main FROM m GROUP BY 1),
    c AS (SELECT d.*, coalesce(main, 0) AS main, sum(n) OVER (PARTITION BY d.query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM d LEFT JOIN t ON t.query_id = d.query_id WHERE position % 2 = 1)
    SELECT query_id, 'graph' AS source, position FROM m UNION ALL SELECT query_id, 'lexical', position FROM c WHERE used <= 4000 - main
    """,
)
def _(spark, at):
    d = _t(spark, at, "documents").where("text IS NOT NULL").select(F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("query_id"), F.col("doc_id").alias("position"), "text")
    return retrieval.packed_by_share(d.where("position % 2 = 0"), d.where("position % 2 = 1")).select("query_id", "source", "position")


@query(
    "grouped_context",
    """
    WITH d AS (SELECT n_regionkey::VARCHAR AS query_id, n_name AS module_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'C' || (s_suppkey % 2) END AS class, s_suppkey AS position, s_name AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    w AS (SELECT *, min(position) OVER (PARTITION BY query_id, module_name) AS m, min(position) OVER (PARTITION BY query_id, module_name, coalesce(class, '')) AS c FROM d),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, coalesce(class, '') = '', c, position) AS k, lag(module_name) OVER (PARTITION BY query_id ORDER BY m, coalesce(class, '') = '', c, position) AS before FROM w)
    SELECT query_id, string_agg(CASE WHEN before IS DISTINCT FROM module_name THEN '# Module: ' || module_name || chr(10) ELSE '' END || code, chr(10) || chr(10) ORDER BY k) AS context FROM l GROUP BY query_id
    """,
)
def _(spark, at):
    s = _t(spark, at, "supplier").join(_t(spark, at, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("n_regionkey").cast("string").alias("query_id"), F.col("n_name").alias("module_name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("C"), F.col("s_suppkey") % 2)).alias("class"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("code"))
    return retrieval.grouped_context(rows)


@query("routed_results", "WITH a AS (SELECT query_id, doc_id FROM qrels WHERE relevance >= 3), b AS (SELECT query_id, doc_id FROM qrels WHERE relevance = 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a WHERE query_id IS NOT NULL)")
def _(spark, at):
    q = _t(spark, at, "qrels")
    return retrieval.routed(q.where("relevance >= 3").select("query_id", "doc_id"), q.where("relevance = 2").select("query_id", "doc_id"))


@query("hybrid_results", "SELECT query_id, doc_id FROM qrels WHERE relevance >= 3 UNION ALL SELECT query_id, doc_id FROM qrels WHERE relevance = 2")
def _(spark, at):
    q = _t(spark, at, "qrels")
    return retrieval.hybrid(q.where("relevance >= 3").select("query_id", "doc_id"), q.where("relevance = 2").select("query_id", "doc_id"), "hybrid")


@query("named_relevance", "WITH j AS (SELECT query_id, doc_id, arg_max(relevance, (n, relevance)) AS relevance FROM (SELECT query_id, doc_id, relevance, count(*) AS n FROM qrels WHERE relevance IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT query_id, func_name AS name, arg_max(relevance, doc_id) AS relevance FROM j JOIN (SELECT DISTINCT doc_id, func_name FROM docs) USING (doc_id) WHERE func_name IS NOT NULL GROUP BY 1, 2")
def _(spark, at):
    return evaluate.named_relevance(A.judged_once(_t(spark, at, "qrels")), _t(spark, at, "docs").select("doc_id", "func_name").distinct())


@query(
    "completion_summary",
    "SELECT p_brand AS repo, round(avg((trim(p_name) = trim(p_type))::INT), 6) AS exact_match_rate, round(avg(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1 ELSE greatest(0, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))) END), 6) AS average_edit_similarity, count(*) AS total_examples FROM part GROUP BY p_brand",
)
def _(spark, at):
    rows = _t(spark, at, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("predicted"), F.col("p_type").alias("groundtruth"))
    r = evaluate.completion_summary(rows)
    return r.select("repo", _r(F.col("exact_match_rate")).alias("exact_match_rate"), _r(F.col("average_edit_similarity")).alias("average_edit_similarity"), "total_examples")


@query("chosen_snippets", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS snippet, p_size % 3 AS identifier FROM part")
def _(spark, at):
    item = lambda c, i: F.struct(F.col(c).alias("snippet"), F.lit(i).cast("bigint").alias("identifier"))
    p = _t(spark, at, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("gold_snippet_index"), F.array(item("p_name", 0), item("p_type", 1), item("p_brand", 2)).alias("context"))
    return evaluate.choice(p).select("p_partkey", "snippet", "identifier")


@query("missing_repositories", "SELECT DISTINCT repo FROM docs WHERE repo IS NOT NULL AND repo NOT IN (SELECT repo FROM docs WHERE language = 'go' AND repo IS NOT NULL)")
def _(spark, at):
    d = _t(spark, at, "docs").where("repo IS NOT NULL")
    return retrieval.missing_repos(d.select("repo").distinct(), d.where("language = 'go'").select(F.col("repo").alias("repo_name")))


def _place(spark, at: str, name: str) -> str:
    return f"{own_dir(spark)}/results/{name}-{zlib.crc32(at.encode())}"


@query("json_round_trip", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, at):
    s = _t(spark, at, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.write_json(s, _place(spark, at, "json"), by="s_nationkey")
    return readers.json_lines(spark, _place(spark, at, "json"), s.schema)


@query("csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _(spark, at):
    sinks.write_csv(_t(spark, at, "customer").select("c_custkey", "c_name"), _place(spark, at, "csv"))
    return spark.read.option("header", True).csv(_place(spark, at, "csv"))


@query("appended_results", "SELECT o_orderkey, 1 AS run FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'P'")
def _(spark, at):
    place = _place(spark, at, "appended")
    o = _t(spark, at, "orders")
    o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(1).alias("run")).write.mode("overwrite").parquet(place)
    sinks.append(o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit(2).alias("run")), place)
    return spark.read.parquet(place)


@query("partitions_replaced", "SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 'new' ELSE 'old' END AS v, c_nationkey AS part FROM customer")
def _(spark, at):
    place = _place(spark, at, "parts")
    c = _t(spark, at, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"), F.col("c_nationkey").alias("part"))
    c.write.mode("overwrite").partitionBy("part").parquet(place)
    sinks.upsert_partitions(place, c.where("part = 3").withColumn("v", F.lit("new")), "part")
    return spark.read.schema(c.schema).parquet(place)


@graph_query("snapshot_round_trip", " SELECT label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT type, count(*) FROM edges GROUP BY type")
def _(spark, at):
    nodes, edges = graph_view(spark, at)
    place = _place(spark, at, "snapshot")
    sinks.snapshot(nodes.withColumn("repo", F.coalesce("module_name", F.lit("none"))), edges, place)
    n, e = sinks.load_snapshot(spark, place)
    return A.label_counts(n).unionByName(e.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- names and requirements


@query("requirement_packages", "SELECT DISTINCT p_brand AS repo, replace(trim(string_split_regex(p_name, 'e')[1]), '-', '_') AS package FROM part WHERE trim(string_split_regex(p_name, 'e')[1]) <> ''")
def _(spark, at):
    p = _t(spark, at, "part")
    head = F.trim(F.split("p_name", "e").getItem(0))
    lines = p.where(head != "").select(F.col("p_brand").alias("repo"), F.concat(head, F.element_at(F.array(*map(F.lit, ("==", ">=", "<=", "~="))), (F.col("p_size") % 4 + 1).cast("int")), F.col("p_size")).alias("line"))
    remarks = p.select(F.col("p_brand").alias("repo"), F.explode(F.array(F.lit("# remark"), F.lit("  "))).alias("line"))
    return readers.requirements(lines.unionByName(remarks))


@query(
    "chosen_requirements",
    """
    WITH f AS (SELECT p_brand AS repo, CASE p_partkey % 9 WHEN 0 THEN 'requirements/base.txt' WHEN 1 THEN 'test_requirements.txt' WHEN 2 THEN 'requirements-dev.txt' ELSE 'setup.py' END AS path FROM part WHERE p_partkey % 2 = 1 OR p_size > 30)
    SELECT repo, arg_min(path, CASE path WHEN 'test_requirements.txt' THEN 1 WHEN 'requirements-dev.txt' THEN 3 WHEN 'requirements/base.txt' THEN 4 END) AS path FROM f GROUP BY repo
    """,
)
def _(spark, at):
    p, k = _t(spark, at, "part").where("p_partkey % 2 = 1 OR p_size > 30"), F.col("p_partkey") % 9
    path = F.when(k == 0, "requirements/base.txt").when(k == 1, "test_requirements.txt").when(k == 2, "requirements-dev.txt").otherwise("setup.py")
    return readers.choose_requirement_file(p.select(F.col("p_brand").alias("repo"), path.alias("path")))


@query("file_modules", r"SELECT DISTINCT path, CASE WHEN f = '__init__' THEN CASE WHEN d = '' THEN 'main' ELSE d END WHEN d = '' THEN f ELSE d || '.' || f END AS module FROM (SELECT path, replace(regexp_replace(path, '/?[^/]*$', ''), '/', '.') AS d, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.py$', '') AS f FROM docs WHERE path LIKE '%.py')")
def _(spark, at):
    return _t(spark, at, "docs").where("path LIKE '%.py'").select("path", readers.module_name(F.col("path")).alias("module")).distinct()


@query("example_modules", r"SELECT DISTINCT 'tme/tests/' || path AS path, replace(regexp_replace('tests/' || path, '\.py$', ''), '/', '.') AS module FROM docs")
def _(spark, at):
    d = _t(spark, at, "docs").select(F.concat(F.lit("tme/tests/"), F.col("path")).alias("path"))
    return d.select("path", readers.example_path_to_module(F.col("path")).alias("module")).distinct()


@query("blob_lines", r"SELECT DISTINCT doc_id, CASE WHEN doc_id LIKE '%#L%' THEN regexp_extract(doc_id, '#L(\d+)', 1)::INT END AS first_line, CASE WHEN doc_id LIKE '%#L%-L%' THEN regexp_extract(doc_id, '-L(\d+)$', 1)::INT END AS last_line FROM docs")
def _(spark, at):
    return _t(spark, at, "docs").select("doc_id", F.inline(F.array(readers.blob_address(F.col("doc_id"))))).select("doc_id", "first_line", "last_line").distinct()


@query("repo_key_readings", "SELECT repo, list_aggregate(p[1:i], 'string_agg', '-') AS owner, list_aggregate(p[i + 1:len(p) - 1], 'string_agg', '-') AS name FROM (SELECT repo, p, unnest(generate_series(1, len(p) - 2)) AS i FROM (SELECT DISTINCT repo, string_split(replace(repo, '/', '-') || '-c0ffee', '-') AS p FROM docs WHERE repo IS NOT NULL))")
def _(spark, at):
    d = _t(spark, at, "docs").where("repo IS NOT NULL").select("repo").distinct()
    ways = d.select("repo", F.inline(readers.repo_key_splits(F.concat(F.translate("repo", "/", "-"), F.lit("-c0ffee")))).alias("owner", "name", "commit"))
    return ways.select("repo", "owner", "name")


@query("imported_modules", r"SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(code, '(?m)^[ \t\n\x0B\f\r]*from[ \t\n\x0B\f\r]+([.A-Za-z0-9_]+)[ \t\n\x0B\f\r]+import', 1)) AS m FROM docs WHERE code IS NOT NULL AND NOT regexp_matches(code, '(?m)^[ \t\n\x0B\f\r]*import[ \t\n\x0B\f\r]')) GROUP BY doc_id")
def _(spark, at):
    d = _t(spark, at, "docs").where(r"code IS NOT NULL AND NOT (code RLIKE '(?m)^\\s*import\\s')").select("doc_id", F.explode(T.imported_modules(F.col("code"))).alias("m")).distinct()
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
