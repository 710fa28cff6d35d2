"""A star schema seen as a code graph, to run the graph operators on tables of any size.

Repo is region, Module nation, Class customer, Function supplier, Method orders, GlobalVariable part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, NODES, conform


def _id(label: str, key: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


def graph_view(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: spark.read.parquet(f"{at}/{n}.parquet")
    nation = t("nation")
    named = nation.select("n_nationkey", "n_name")
    customer = t("customer").join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customer.select("c_custkey", "c_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    part, uses = t("part"), t("lineitem")
    vectors = t("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    node = lambda df, label, key, **cols: conform(df.select(_id(label, key).alias("node_id"), F.lit(label).alias("label"), *(F.col(v).alias(k) for k, v in cols.items())), NODES)
    nodes = [
        node(t("region"), "Repo", "r_regionkey", name="r_name"),
        node(nation, "Module", "n_nationkey", name="n_name"),
        node(customer, "Class", "c_custkey", name="c_name", module_name="n_name", code="c_mktsegment"),
        node(supplier, "Function", "s_suppkey", name="s_name", module_name="n_name"),
        node(orders.withColumnRenamed("c_name", "owner"), "Method", "o_orderkey", name="o_orderpriority", module_name="n_name", **{"class": "owner"}),
        node(part.join(vectors, "p_partkey", "left"), "GlobalVariable", "p_partkey", name="p_name", module_name="p_brand", code="p_type", embedding="embedding"),
    ]
    edge = lambda df, a, x, b, y, kind: conform(df.select(_id(a, x).alias("src"), _id(b, y).alias("dst"), F.lit(kind).alias("type")), EDGES)
    edges = [
        edge(nation, "Repo", "n_regionkey", "Module", "n_nationkey", "CONTAINS"),
        edge(t("customer"), "Module", "c_nationkey", "Class", "c_custkey", "CONTAINS"),
        edge(t("supplier"), "Module", "s_nationkey", "Function", "s_suppkey", "CONTAINS"),
        edge(t("orders"), "Class", "o_custkey", "Method", "o_orderkey", "HAS_METHOD"),
        edge(uses.select("l_orderkey", "l_partkey").distinct(), "Method", "l_orderkey", "GlobalVariable", "l_partkey", "USES"),
        edge(uses.select("l_orderkey", "l_suppkey").distinct(), "Method", "l_orderkey", "Function", "l_suppkey", "USES"),
        edge(part.withColumn("up", F.floor(F.col("p_partkey") / 2)), "GlobalVariable", "p_partkey", "GlobalVariable", "up", "INHERITS"),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


#: The same view for SQL: common table expressions nodes and edges.
GRAPH_SQL = """
nodes AS (
  SELECT 'Repo:' || r_regionkey AS node_id, 'Repo' AS label, r_name AS name, NULL AS class, NULL AS module_name FROM region
  UNION ALL SELECT 'Module:' || n_nationkey, 'Module', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'Class:' || c_custkey, 'Class', c_name, NULL, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Function:' || s_suppkey, 'Function', s_name, NULL, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Method:' || o_orderkey, 'Method', o_orderpriority, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'GlobalVariable:' || p_partkey, 'GlobalVariable', p_name, NULL, p_brand FROM part),
edges AS (
  SELECT 'Repo:' || n_regionkey AS src, 'Module:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'Module:' || c_nationkey, 'Class:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'Module:' || s_nationkey, 'Function:' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'Class:' || o_custkey, 'Method:' || o_orderkey, 'HAS_METHOD' FROM orders
  UNION ALL SELECT DISTINCT 'Method:' || l_orderkey, 'GlobalVariable:' || l_partkey, 'USES' FROM lineitem
  UNION ALL SELECT DISTINCT 'Method:' || l_orderkey, 'Function:' || l_suppkey, 'USES' FROM lineitem
  UNION ALL SELECT 'GlobalVariable:' || p_partkey, 'GlobalVariable:' || (p_partkey // 2), 'INHERITS' FROM part)
"""
