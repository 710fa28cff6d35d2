"""Lookups and walks over the code graph: children, callers, dependencies, entity search and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..model import KEYS
from .build import keep_only
from .pattern import closure, descending, directed, holds_text, hop, matching, paths


def repo_root(nodes: DataFrame, name: str) -> DataFrame:
    return matching(nodes, "Repo", name=name)


#: Edge types and direction to a node's children, by label, and those that decide whether it has any.
CHILDREN = {
    "Repo": (("CONTAINS",), "out"), "Module": (("CONTAINS",), "out"), "Class": (("HAS_METHOD", "HAS_FIELD", "USES"), "any"),
    "Function": (("USES",), "any"), "Method": (("USES",), "any"), "GlobalVariable": (("USES",), "any"), "Field": (("USES",), "any"),
}
#: The variant where modules also follow USES and classes INHERITS.
CHILDREN_WIDE = CHILDREN | {"Module": (("CONTAINS", "USES"), "out"), "Class": (("HAS_METHOD", "HAS_FIELD", "USES", "INHERITS"), "any")}
HAS_CHILDREN = {
    "Repo": (("CONTAINS",), "out"), "Module": (("CONTAINS",), "out"), "Class": (("HAS_METHOD", "HAS_FIELD"), "out"), "Function": (("USES",), "out"),
    "Method": (("USES",), "out"), "GlobalVariable": (("USES",), "out"), "Field": (("USES",), "out"),
}


def _by_label(nodes: DataFrame, edges: DataFrame, rules: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """(node_id, child): pairs by the rule of the start's label, in one pass over the edges in the directions that rules ask for."""
    table = [(label, t, way) for label, (types, direction) in rules.items() for t in types for way in (("out", "in") if direction == "any" else (direction,))]
    known = F.broadcast(nodes.sparkSession.createDataFrame(table, "label string, type string, way string"))  # a row for a label, type and direction
    ways = []
    for way in sorted({w for _, _, w in table}):
        types = sorted({t for _, t, w in table if w == way})
        ways.append(directed(edges, tuple(types), way).withColumn("way", F.lit(way)))
    e = reduce(DataFrame.unionByName, ways).select(F.col("start").alias("node_id"), F.col("end").alias("child"), "type", "way")
    return e.join(nodes.select("node_id", "label"), "node_id").join(known, ["label", "type", "way"], "left_semi").select("node_id", "child").distinct()


def children(nodes: DataFrame, edges: DataFrame, wide: bool = False) -> DataFrame:
    return _by_label(nodes, edges, CHILDREN_WIDE if wide else CHILDREN)


def has_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``has_children``.  Its rule differs from that of children: a node that is only used by others has none."""
    some = _by_label(nodes, edges, HAS_CHILDREN).select("node_id").distinct().withColumn("has", F.lit(True))
    return nodes.join(some, "node_id", "left").withColumn("has_children", F.coalesce("has", F.lit(False))).drop("has")


def called_by_name(nodes: DataFrame, edges: DataFrame, name: str, callers: bool = False) -> DataFrame:
    """What any node of the name uses, or who uses one: matched by name alone, so across modules."""
    e = directed(edges, ("USES",), "in" if callers else "out")
    ids = nodes.where(F.col("name") == name).select(F.col("node_id").alias("start"))
    return nodes.join(e.join(ids, "start").select(F.col("end").alias("node_id")).distinct(), "node_id", "left_semi")


def connected_with_embedding(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Neighbours of start(node_id) that have an embedding: what a module contains, what any other node uses."""
    ids = nodes.join(start.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "label")
    out = directed(edges).withColumnRenamed("start", "node_id").join(ids, "node_id")
    out = out.where(F.when(F.col("label") == "Module", F.col("type") == "CONTAINS").otherwise(F.col("type") == "USES"))
    return out.select(F.col("node_id").alias("start"), F.col("end").alias("node_id")).distinct().join(nodes.where("embedding IS NOT NULL"), "node_id")


def cross_module_dependencies(nodes: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """Distinct nodes outside the module that its members, or the methods of its classes, use; those without a module are not outside."""
    m = matching(nodes, "Module", name=module).select(F.col("node_id").alias("m"))
    members = hop(m, edges, "m", "a", "CONTAINS").select("a")
    methods = hop(members, edges, "a", "b", "HAS_METHOD").select(F.col("b").alias("a"))
    used = hop(members.unionByName(methods).distinct(), edges, "a", "node_id", "USES").select("node_id").distinct()
    return nodes.where(F.col("module_name") != module).join(used, "node_id", "left_semi")


# ---------------------------------------------------------------- search by specification


def entities(nodes: DataFrame, specs: list[dict], limit: int = 5) -> DataFrame:
    """For each spec {name, type?} up to ``limit`` nodes: equal names whatever the case; for a Module part of the name is enough."""
    parts = []
    for i, spec in enumerate(specs):
        name, kind = F.lit(spec["name"]), spec.get("type")
        n = matching(nodes, *([kind] if kind else []))
        hit = holds_text(F.col("name"), name) if kind == "Module" else F.lower("name") == F.lower(name)
        parts.append(n.where(hit).orderBy("node_id").limit(limit).withColumn("spec", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def relationships(nodes: DataFrame, edges: DataFrame, specs: list[dict], limit: int = 5) -> DataFrame:
    """For each spec {type?, source?, target?} up to ``limit`` edges whose ends' names hold the given texts."""
    parts = []
    for i, spec in enumerate(specs):
        e = edges.where(F.col("type").isin(*str(spec["type"]).split("|"))) if spec.get("type") else edges
        e = e.select("src", "dst", "type")
        for side, key in (("src", "source"), ("dst", "target")):
            e = e.join(nodes.select(F.col("node_id").alias(side), F.col("name").alias(f"{side}_name")), side)
            if spec.get(key):
                e = e.where(holds_text(F.col(f"{side}_name"), F.lit(spec[key])))
        parts.append(e.orderBy("src", "dst", "type").limit(limit).withColumn("spec", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def answer_spec(nodes: DataFrame, edges: DataFrame, spec: dict | list, limit: int = 5) -> DataFrame:
    """The nodes that a specification {entities: [...], relationships: [...]} (or a list of them) names, each once."""
    specs = spec if isinstance(spec, list) else [spec]
    found = [e for s in specs for e in s.get("entities", [])]
    linked = [r for s in specs for r in s.get("relationships", [])]
    parts = [entities(nodes, found, limit).drop("spec")] if found else []
    if linked:
        ends = relationships(nodes, edges, linked, limit).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        parts.append(nodes.join(ends, "node_id", "left_semi"))
    return distinct_nodes(reduce(DataFrame.unionByName, parts)) if parts else nodes.where("false")


def key_of(label: Column, compat: bool = True) -> Column:
    """What makes two results the same; ``compat`` leaves a method's module out of it."""
    out = F.col("node_id")
    for name, keys in KEYS.items():
        use = [k for k in keys if not (compat and name == "Method" and k == "module_name")]
        out = F.when(label == name, F.concat_ws(":", F.lit(name), *(F.coalesce(F.col(k), F.lit("")) for k in use))).otherwise(out)
    return out


def distinct_nodes(nodes: DataFrame, compat: bool = True) -> DataFrame:
    rest = nodes.columns
    best = nodes.groupBy(key_of(F.col("label"), compat).alias("key")).agg(F.min_by(F.struct(*rest), "node_id").alias("x"))
    return best.select("x.*")


def ranked_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, query: Column, limit: int = 8000) -> DataFrame:
    """Seeds and their neighbours, best cosine first, as long as their code fits in ``limit`` characters: the first that does not
    fit ends the list."""
    around = connected_with_embedding(nodes, edges, seeds).select(*seeds.columns)
    found = distinct_nodes(seeds.unionByName(around)).withColumn("similarity", cosine("embedding", query))
    order = Window.orderBy(F.desc("similarity"), "node_id").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(F.coalesce("code", F.lit("")))).over(order)
    return found.withColumn("used", used).where(F.col("used") <= limit)


def expanded(nodes: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """results(node_id, position) with their contents: for a module all it contains, however deep, and the methods of classes there, but
    not itself; a class with its members; others themselves.  Nodes of one name, signature, module and class come once, at their first
    position; within a position the result itself comes first, then by node."""
    ids = results.join(nodes.select("node_id", "label"), "node_id")
    own = ids.where("label <> 'Module'").select("node_id", "position", F.lit(0).alias("step"))
    modules = ids.where("label = 'Module'").select("node_id", "position")
    inside = paths(modules.select("node_id").distinct(), edges, "CONTAINS").select(F.col("start").alias("node_id"), "end").distinct()
    below = modules.join(inside, "node_id").select(F.col("end").alias("node_id"), "position")
    methods = hop(below, edges, "node_id", "m", "HAS_METHOD").select(F.col("m").alias("node_id"), "position")
    members = hop(ids.where("label = 'Class'").select("node_id", "position"), edges, "node_id", "m", "HAS_METHOD", "HAS_FIELD").select(F.col("m").alias("node_id"), "position")
    parts = [below, methods, members]
    whole = reduce(DataFrame.unionByName, [own, *(p.withColumn("step", F.lit(1)) for p in parts)])
    at = whole.groupBy("node_id").agg(F.min(F.struct("position", "step")).alias("at"))
    keys = ["name", "signature", "module_name", "class"]
    joined = nodes.join(at, "node_id")
    best = joined.groupBy(*(F.coalesce(F.col(k), F.lit("")).alias(f"key_{k}") for k in keys)).agg(F.min_by(F.struct(*joined.columns), F.struct("at", "node_id")).alias("x"))
    return best.select("x.*")


# ---------------------------------------------------------------- pruning to a corpus


def parsed_name(func_name: Column) -> Column:
    """struct(class, name) of ``name``, ``Class.name`` or a longer dotted name, of which the last two parts count."""
    parts = F.split(func_name, r"\.")
    return F.struct(F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("class"), F.element_at(parts, -1).alias("name"))


def corpus_targets(docs: DataFrame, module: Column) -> DataFrame:
    """(repo, class, name, module_name) that corpus rows (repo, func_name) name."""
    p = parsed_name(F.col("func_name"))
    return docs.where("func_name IS NOT NULL").select("repo", p["class"].alias("class"), p["name"].alias("name"), module.alias("module_name")).distinct()


def corpus_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions and methods that targets name; where the module does not agree, by name and class alone."""
    n = nodes.where("label IN ('Function', 'Method')").select("repo", "name", F.coalesce("class", F.lit("")).alias("class"), "module_name", "node_id")
    t = targets.withColumn("class", F.coalesce("class", F.lit("")))
    exact = t.join(n, ["repo", "name", "class", "module_name"])
    rest = t.join(exact.select(*t.columns), t.columns, "left_anti")
    loose = rest.join(n.drop("module_name"), ["repo", "name", "class"])
    return exact.select("node_id").unionByName(loose.select("node_id")).distinct()


def class_relatives(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Owning classes, all their methods and fields, and the classes above and below them."""
    owners = hop(ids.select("node_id"), edges, "node_id", "c", "HAS_METHOD", direction="in").select(F.col("c").alias("node_id"))
    classes = owners.unionByName(nodes.where("label = 'Class'").join(ids.select("node_id"), "node_id", "left_semi").select("node_id")).distinct()
    members = hop(classes, edges, "node_id", "m", "HAS_METHOD", "HAS_FIELD").select(F.col("m").alias("node_id"))
    kin = hop(classes, edges, "node_id", "m", "INHERITS", direction="any").select(F.col("m").alias("node_id"))
    return classes.unionByName(members).unionByName(kin).distinct()


def prune_to_corpus(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph cut down to the corpus: its nodes, what they use inside it, their classes, and everything above them."""
    seed = corpus_nodes(targets, nodes)
    near = closure(seed, edges, "USES", within=seed).select("node_id")
    keep = closure(near, edges, "CONTAINS", "HAS_METHOD", direction="in").select("node_id")
    kin = class_relatives(nodes, edges, keep)
    keep = closure(keep.unionByName(kin).distinct(), edges, "CONTAINS", "HAS_METHOD", direction="in").select("node_id")
    return keep_only(nodes, edges, keep)


# ---------------------------------------------------------------- sizes


def graph_size(nodes: DataFrame, edges: DataFrame, compat: bool = True) -> DataFrame:
    """(repo_id, size) of each repository.  ``compat`` counts a class once for each of its methods, and the methods, and one; else
    the distinct nodes below the root, and one."""
    repo = nodes.where("label = 'Repo'").select(F.col("node_id").alias("repo_id"))
    modules = hop(repo, edges, "repo_id", "c", "CONTAINS")
    inner = hop(modules.withColumnRenamed("c", "m"), edges, "m", "c", "CONTAINS").select("repo_id", "c")
    contained = modules.unionByName(inner)
    rows = hop(contained, edges, "c", "m", "HAS_METHOD", optional=True)
    if compat:
        counted = rows.groupBy("repo_id").agg((F.count("c") + F.count("m") + 1).alias("size"))
    else:
        every = rows.select("repo_id", F.col("c").alias("n")).unionByName(rows.select("repo_id", F.col("m").alias("n")))
        counted = every.groupBy("repo_id").agg((F.countDistinct("n") + 1).alias("size"))
    return repo.join(counted, "repo_id", "left").select("repo_id", F.coalesce("size", F.lit(1)).alias("size"))


def usage_report(nodes: DataFrame, edges: DataFrame, kind: str = "USES") -> DataFrame:
    """How often each node is used, most used first."""
    n = edges.where(F.col("type") == kind).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("uses"))
    return nodes.select("node_id", "label", "name").join(n, "node_id").orderBy(descending("uses"), "node_id")
