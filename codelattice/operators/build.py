"""From raw records to the graph: keyed upsert, edge resolution, import stitching, cleanup and deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EDGES, NODES, conform, node_id
from ..session import checkpointed


def merged_nodes(raw: DataFrame) -> DataFrame:
    """One node per identity; of records with one identity the file that came last wins, column by column of that record."""
    named = raw.withColumnRenamed("type", "label")
    named = named.withColumn("node_id", node_id())
    rest = [c for c in named.columns if c != "node_id"]
    best = named.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("file_ord", F.lit(-1)), F.xxhash64(*[F.col(c).cast("string") for c in rest]))).alias("x"))
    return conform(best.select("node_id", "x.*"), NODES)


def repo_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Repo nodes of the graph and their edges to modules."""
    repos = nodes.select("repo").where("repo IS NOT NULL").distinct().select(F.lit("Repo").alias("label"), "repo", F.col("repo").alias("name"))
    repos = conform(repos, NODES).withColumn("node_id", node_id())
    modules = nodes.where("label = 'Module'").select("repo", F.col("node_id").alias("dst"))
    edges = repos.select("repo", F.col("node_id").alias("src")).join(modules, "repo").select("src", "dst", F.lit("CONTAINS").alias("type"))
    return repos, conform(edges, EDGES)


def _side(side: str) -> dict[str, Column]:
    return {
        "label": F.col(f"{side}_association_type"), "name": F.col(side), "signature": F.col(f"{side}_signature"), "class": F.col(f"{side}_class"),
        "module_name": F.col(f"{side}_module_name"), "module": F.col(f"{side}_module_name"),
    }


def _identified(raw: DataFrame, side: str) -> Column:
    """The identity that an edge record's side names."""
    s = _side(side)
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = {
        "Module": (s["name"],), "Class": (s["name"], s["signature"], s["module_name"]), "Function": (s["name"], s["signature"], s["module_name"]),
        "Method": (s["name"], s["class"], s["signature"], s["module_name"]), "Field": (s["name"], s["class"], s["module_name"]),
        "GlobalVariable": (s["name"], s["module_name"]), "Import": (s["name"], s["module"]),
    }
    out = F.lit(None).cast("string")
    for label, keys in parts.items():
        out = F.when(s["label"] == label, F.concat_ws("/", text(F.col("repo")), F.concat_ws(":", F.lit(label), *map(text, keys)))).otherwise(out)
    return out


def edges_of(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes that exist, each once.

    Sides are found by identity.  INHERITS needs a target signature unless the target is an import, as null matches nothing.
    An edge to an import reaches every import of that name in the repository; only where there is none, those with it as alias.
    """
    ids = nodes.select("node_id")
    r = raw.withColumn("src", _identified(raw, "source")).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    plain = r.where("target_association_type <> 'Import'").withColumn("dst", _identified(raw, "target"))
    plain = plain.where("type <> 'INHERITS' OR target_signature IS NOT NULL").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    imports = nodes.where("label = 'Import'").select("repo", F.col("node_id").alias("dst"), F.col("name").alias("import_name"), F.col("alias").alias("import_alias"))
    wanted = r.where("target_association_type = 'Import'").select("src", "type", "repo", F.col("target").alias("import_name"))
    by_name = wanted.join(imports.drop("import_alias"), ["repo", "import_name"])
    left = wanted.join(imports.select("repo", "import_name").distinct(), ["repo", "import_name"], "left_anti")
    by_alias = left.withColumnRenamed("import_name", "import_alias").join(imports.drop("import_name"), ["repo", "import_alias"])
    parts = [d.select("src", "dst", "type") for d in (plain, by_name, by_alias)]
    return conform(reduce(DataFrame.unionByName, parts).distinct(), EDGES)


def first_match(wanted: DataFrame, candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """wanted with ``target`` and ``tier`` of the first candidate table that has its keys; ties by the smallest target.

    Each candidate has the keys and a column node_id.  Rows without a match are left out."""
    tiers = reduce(DataFrame.unionByName, [c.select(*keys, F.lit(i).alias("tier"), F.col("node_id").alias("target")) for i, c in enumerate(candidates)])
    best = tiers.groupBy(*keys).agg(F.min(F.struct("tier", "target")).alias("x")).select(*keys, "x.target", "x.tier")
    return wanted.join(best, keys)


def contains_targets(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a CONTAINS record's name means in its module: a class, else a function, else a global, else an import, else an alias."""
    at = lambda label, name="name": nodes.where(F.col("label") == label).select("repo", F.col(name).alias("target_name"), "node_id")
    inside = lambda label: nodes.where(F.col("label") == label).select("repo", F.col("name").alias("target_name"), "module_name", "node_id")
    local = first_match(records, [inside(x) for x in ("Class", "Function", "GlobalVariable")], ["repo", "module_name", "target_name"])
    rest = records.join(local.select(*records.columns), records.columns, "left_anti")
    return local.unionByName(first_match(rest, [at("Import"), at("Import", "alias")], ["repo", "target_name"]).withColumn("tier", F.col("tier") + 3))


# ---------------------------------------------------------------- imports


def redirected(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges to a matched import point to its target instead; edges of matched imports themselves are gone."""
    m = matches.select(F.col("import_id").alias("dst"), "target", F.col("label").alias("target_label"))
    moved = edges.join(m, "dst", "left").join(matches.select(F.col("import_id").alias("src")), "src", "left_anti")
    return moved.select(
        "src", F.coalesce("target", "dst").alias("dst"), "type", "source_association_type",
        F.when(F.col("target").isNotNull() & (F.col("type") == "USES"), F.col("target_label")).otherwise(F.col("target_association_type")).alias("target_association_type"),
    ).dropDuplicates(["src", "dst", "type"])


def match_imports(imports: DataFrame, nodes: DataFrame, edges: DataFrame, by_name: bool = True) -> DataFrame:
    """(import_id, target, label, tier): what each import resolves to, by the first rule that finds something.

    0 a module of that name or local name; 1 a member of that name in the module named from the importing folder; 2 the same
    with the module as written; 3 any node of the name.  In 1 and 2 a class goes before a function before a global, in 3 a
    class before a global before a function; then the smallest identity.
    """
    full = F.when(F.col("name") == F.col("module"), F.col("module")).otherwise(F.concat_ws(".", "module", "name"))
    imp = imports.select(F.col("node_id").alias("import_id"), "repo", "name", "module", "dotted_folder_name", full.alias("full"))
    mod = nodes.where("label = 'Module'").select("repo", F.col("node_id").alias("target"), F.col("name").alias("m"), F.col("local_name").alias("l"), "label")
    whole = lambda key, rank: imp.where("name = module").join(mod.select("repo", "target", "label", F.col(key).alias("module")), ["repo", "module"]).select("import_id", "target", "label", F.lit(0).alias("tier"), F.lit(rank).alias("rank"))
    sub = imp.where("name <> module").join(mod.select("repo", "target", "label", F.col("m").alias("full")), ["repo", "full"]).select("import_id", "target", "label", F.lit(0).alias("tier"), F.lit(2).alias("rank"))
    members = (
        edges.where("type = 'CONTAINS'").select("src", "dst").join(nodes.where("label = 'Module'").select(F.col("node_id").alias("src"), "repo", F.col("name").alias("within")), "src")
        .join(nodes.where("label IN ('Class', 'Function', 'GlobalVariable')").select(F.col("node_id").alias("dst"), "name", "label"), "dst")
        .select("repo", "within", "name", F.col("dst").alias("target"), "label")
    )
    order = F.when(F.col("label") == "Class", 0).when(F.col("label") == "Function", 1).otherwise(2)
    prefixed = F.when(F.coalesce("dotted_folder_name", F.lit("")) == "", F.col("module")).otherwise(F.concat_ws(".", "dotted_folder_name", "module"))
    last = F.element_at(F.split("name", r"\."), -1)
    look = lambda module, tier: imp.withColumn("within", module).withColumn("name", last).join(members, ["repo", "within", "name"]).select("import_id", "target", "label", F.lit(tier).alias("tier"), order.alias("rank"))
    tiers = [whole("m", 0), whole("l", 1), sub, look(prefixed, 1), look(F.col("module"), 2)]
    if by_name:
        named = nodes.where("label IN ('Class', 'Function', 'GlobalVariable')").select("repo", "name", F.col("node_id").alias("target"), "label")
        rank = F.when(F.col("label") == "Class", 0).when(F.col("label") == "GlobalVariable", 1).otherwise(2)
        tiers.append(imp.withColumn("name", last).join(named, ["repo", "name"]).select("import_id", "target", "label", F.lit(3).alias("tier"), rank.alias("rank")))
    found = reduce(DataFrame.unionByName, tiers)
    return found.groupBy("import_id").agg(F.min(F.struct("tier", "rank", "target", "label")).alias("x")).select("import_id", "x.target", "x.label", "x.tier")


def stitch_imports(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, matches): imports replaced by what they mean.

    Modules and members are tried in rounds until a round finds nothing, as a resolved re-export gives its package a member
    that other imports resolve through; what is left is tried by name alone.  Each round resolves an import at least, so rounds end;
    raises should they go on beyond ``most_rounds``.
    """
    left, matches = nodes.where("label = 'Import'"), None
    edges = checkpointed(edges)
    for _ in range(most_rounds):
        found = checkpointed(match_imports(left, nodes, edges, by_name=False))
        last = found.isEmpty()
        if last:
            found = checkpointed(match_imports(left, nodes, edges, by_name=True))
        edges = checkpointed(redirected(edges, found))
        matches = found if matches is None else matches.unionByName(found)
        if last:
            break
        left = nodes.where("label = 'Import'").join(matches.select(F.col("import_id").alias("node_id")), "node_id", "left_anti")
    else:
        raise RuntimeError(f"imports still resolve after {most_rounds} rounds")
    return nodes.join(matches.select(F.col("import_id").alias("node_id")), "node_id", "left_anti"), edges, matches


# ---------------------------------------------------------------- cleanup and deletion


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def self_loop_report(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").groupBy("type").agg(F.count(F.lit(1)).alias("loops"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of gone(node_id), and every edge at them, taken out."""
    ids = gone.select("node_id").distinct()
    kept = nodes.join(ids, "node_id", "left_anti")
    for side in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node_id", side), side, "left_anti")
    return kept, edges


def delete_labels(nodes: DataFrame, edges: DataFrame, *labels: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.where(F.col("label").isin(*labels)))


def delete_repo(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.where(F.col("repo") == repo))


def keep_only(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything but keep(node_id) is deleted."""
    return delete_nodes(nodes, edges, nodes.join(keep.select("node_id").distinct(), "node_id", "left_anti"))


def cleared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without anything in it."""
    return nodes.where("false"), edges.where("false")


def broken_keys(nodes: DataFrame) -> DataFrame:
    """(node_id, n): identities that more than one node has; a graph made by ``merged_nodes`` has none."""
    return nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that contain nothing."""
    return nodes.where("label = 'Module'").join(edges.where("type = 'CONTAINS'").select(F.col("src").alias("node_id")), "node_id", "left_anti")


def update_nodes(nodes: DataFrame, updates: DataFrame, *columns: str, keys: tuple[str, ...] = ("name", "module_name", "signature"), scoped: bool = True, order: str | None = None) -> DataFrame:
    """Columns set from updates where the keys agree; null there keeps the old value.

    Of updates with one key the last by ``order`` wins as a whole (without it, the greatest row).  ``scoped`` adds label and class to the keys, so that methods of one name
    in different classes are told apart; without it they are updated together.
    """
    on = [*keys, *(("label", "class") if scoped else ())]
    row = F.struct(*columns)
    best = updates.groupBy(*on).agg(F.max_by(row, F.struct(F.col(order), F.to_json(row))).alias("new") if order else F.max(row).alias("new"))
    best = best.select(*(F.col(k).alias(f"key_{k}") for k in on), "new")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in on])
    joined = nodes.join(best, same, "left").select(*nodes.columns, "new")
    return joined.select(*((F.coalesce(F.col("new")[c], F.col(c)).alias(c) if c in columns else F.col(c)) for c in nodes.columns))


def repo_state(nodes: DataFrame) -> DataFrame:
    """(repo, modules, embedded, state): missing and empty repositories are processed, embedded ones skipped, partly embedded
    ones deleted and processed again."""
    m = F.col("label") == "Module"
    counted = nodes.groupBy("repo").agg(F.count_if(m).alias("modules"), F.count_if(m & F.col("embedding").isNotNull()).alias("embedded"))
    state = F.when(F.col("modules") == 0, "process").when(F.col("embedded") == F.col("modules"), "skip").otherwise("delete")
    return counted.withColumn("state", state)


def build_graph(raw_nodes: DataFrame, raw_edges: DataFrame, keep_fields: bool = False) -> tuple[DataFrame, DataFrame]:
    """The finished graph: merged nodes, resolved edges, stitched imports, no fields (unless kept), no self loops, no imports."""
    nodes = checkpointed(merged_nodes(raw_nodes))
    edges = edges_of(raw_edges, nodes)
    if not keep_fields:
        nodes, edges = delete_labels(nodes, edges, "Field")
    nodes, edges, _ = stitch_imports(nodes, edges)
    nodes, edges = delete_labels(nodes, without_self_loops(edges), "Import")
    repos, roots = repo_nodes(nodes)
    return repos.unionByName(nodes), roots.unionByName(edges)
