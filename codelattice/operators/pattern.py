"""Graph patterns as joins: node filters, hops, optional parts, paths and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rounds of a walk whose rows are kept apart before they are merged; rows of a frontier that may be broadcast.
MERGED, FRONTIER_ROWS = 16, 100_000


def matching(nodes: DataFrame, *labels: str, **properties: object) -> DataFrame:
    """Nodes with one of the labels and all the properties; no label means any."""
    out = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    for name, value in properties.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def edge_key() -> Column:
    """What tells edges apart: there is one of a type between two nodes."""
    return F.xxhash64("src", "dst", "type")


def directed(edges: DataFrame, types: tuple[str, ...] = (), direction: str = "out", keyed: bool = False) -> DataFrame:
    """(start, end, type) of the edges of the types: forwards (out), backwards (in) or both ways (any), where a loop still comes once;
    ``keyed`` adds the edge's key."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    more = [edge_key().alias("edge")] if keyed else []
    out = e.select(F.col("src").alias("start"), F.col("dst").alias("end"), "type", *more)
    back = e.select(F.col("dst").alias("start"), F.col("src").alias("end"), "type", *more)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back.where("start <> end"))


def hop(rows: DataFrame, edges: DataFrame, start: str, end: str, *types: str, direction: str = "out", optional: bool = False) -> DataFrame:
    """Rows joined to the nodes one edge away, a row for each edge; ``optional`` keeps rows without one, with a null end."""
    e = directed(edges, types, direction).select(F.col("start").alias(start), F.col("end").alias(end))
    return rows.join(e, start, "left" if optional else "inner")


def with_node(rows: DataFrame, nodes: DataFrame, column: str, *wanted: str, optional: bool = False) -> DataFrame:
    """Rows with columns of the node whose id is in ``column``, as column_name."""
    n = nodes.select(F.col("node_id").alias(column), *(F.col(c).alias(f"{column}_{c}") for c in wanted))
    return rows.join(n, column, "left" if optional else "inner")


def paths(starts: DataFrame, edges: DataFrame, *types: str, direction: str = "out", least: int = 1, most: int | None = None, used: bool = False, most_rounds: int = 1000) -> DataFrame:
    """(start, end, depth) for every path of at least ``least`` and at most ``most`` edges (without it: of any length) from
    starts(node_id) that uses no edge twice: one row for each path, so ends repeat.  ``used`` adds the keys of the path's edges.

    Paths end by themselves, as no edge comes twice; raises should they still go on after ``most_rounds`` edges.
    """
    e = checkpointed(directed(edges, types, direction, keyed=True).select(F.col("start").alias("end"), F.col("end").alias("next"), "edge"))
    level = checkpointed(starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("end"), F.array().cast("array<bigint>").alias("used")))
    empty = level.select("start", "end", F.lit(0).alias("depth"), "used")
    found = [empty if least == 0 else empty.where("false")]
    depth = 0
    while most is None or depth < most:
        depth += 1
        if depth > most_rounds:
            raise RuntimeError(f"paths go on beyond {most_rounds} edges")
        level = checkpointed(level.join(e, "end").where(~F.array_contains("used", F.col("edge"))).select("start", F.col("next").alias("end"), F.array_append("used", F.col("edge")).alias("used")))
        if level.isEmpty():
            break
        if depth >= least:
            found.append(level.select("start", "end", F.lit(depth).alias("depth"), "used"))
            if len(found) > MERGED:
                found = [checkpointed(reduce(DataFrame.unionByName, found))]
    out = reduce(DataFrame.unionByName, found)
    return out if used else out.drop("used")


def closure(starts: DataFrame, edges: DataFrame, *types: str, direction: str = "out", within: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """(node_id, depth): everything reachable from starts(node_id), the starts included at depth 0, each with its least depth.

    Cycles end by the frontier: only nodes not seen before go on.  ``within`` (node_id) limits the nodes that may be reached.  The edges
    that count are written once, and each round writes its own frontier only.
    """
    e = directed(edges, types, direction).select(F.col("start").alias("node_id"), "end").where("node_id <> end").distinct()
    if within is not None:
        e = e.join(within.select(F.col("node_id").alias("end")).distinct(), "end", "left_semi")
    e = checkpointed(e)
    frontier = checkpointed(starts.select("node_id").distinct().withColumn("depth", F.lit(0)))
    seen, size = [frontier], frontier.count()
    for depth in range(1, most_rounds + 1):
        near = F.broadcast(frontier) if size <= FRONTIER_ROWS else frontier
        reached = e.join(near.select("node_id"), "node_id").select(F.col("end").alias("node_id")).distinct()
        frontier = checkpointed(reached.join(reduce(DataFrame.unionByName, seen), "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            return reduce(DataFrame.unionByName, seen)
        seen.append(frontier)
        if len(seen) > MERGED:
            seen = [checkpointed(reduce(DataFrame.unionByName, seen))]
    raise RuntimeError(f"closure did not end in {most_rounds} rounds")


def ascending(c: str | Column) -> Column:
    """Graph queries sort null as the largest value."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def descending(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def holds_text(a: Column, b: Column) -> Column:
    return F.lower(a).contains(F.lower(b))
