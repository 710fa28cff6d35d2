"""Descriptions and embeddings rolled up from functions to classes to modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..providers import Provider, answered, embedded

#: The two questions asked about a piece of code.
PROMPTS = ("Describe the purpose of this code.\n\n", "List each member of this code with what it is for; write ---None--- where there is none.\n\n")
SUMMARY = "Summarise these descriptions in one paragraph.\n\n"
DEPTH = 3


def waiting(nodes: DataFrame, *labels: str) -> DataFrame:
    return nodes.where(F.col("label").isin(*labels) & F.col("embedding").isNull())


def embedding_text(description: Column, members: Column) -> Column:
    return F.concat_ws("\n", description, members)


def described(rows: DataFrame, content: str = "code", provider: Provider | None = None, name: Column | None = None) -> DataFrame:
    """rows with description, member_descriptions and embedding: both questions for every row in one pass of the provider."""
    asked = rows.withColumn("asked", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PROMPTS)))))
    told = asked.withColumn("answer", answered(F.concat(F.col("asked.p"), F.coalesce(F.col(content), F.lit(""))), provider))
    keys = [c for c in rows.columns if c == "node_id"]
    pivoted = told.groupBy(*keys).agg(F.max(F.when(F.col("asked.i") == 0, F.col("answer"))).alias("description"), F.max(F.when(F.col("asked.i") == 1, F.col("answer"))).alias("members"))
    lines = F.array_join(T.answer_lines(F.col("members"), name), "\n")
    out = pivoted.withColumn("member_descriptions", lines).drop("members")
    out = out.withColumn("embedding", embedded(embedding_text(F.col("description"), F.col("member_descriptions")), provider))
    return rows.drop("description", "member_descriptions", "embedding").join(out, "node_id")


def leaves(nodes: DataFrame, most_tokens: int, provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(described, deferred): functions, globals and methods without an embedding, and classes that fit the budget; other code is cut
    to it, larger classes are left for their methods' descriptions."""
    todo = waiting(nodes, "Function", "Class", "GlobalVariable", "Method").withColumn("fits", T.fits_context(F.col("code"), list(PROMPTS), most_tokens, 0))
    deferred = todo.where("label = 'Class' AND NOT coalesce(fits, true)").drop("fits")
    ready = todo.where("label <> 'Class' OR coalesce(fits, true)").withColumn("code", F.when(F.col("fits"), F.col("code")).otherwise(T.truncate_tokens(F.col("code"), most_tokens))).drop("fits")
    return described(ready, provider=provider), deferred


def _level(groups: DataFrame, most_tokens: int, provider: Provider | None) -> DataFrame:
    """One round of summaries: groups(node_id, descriptions) whose descriptions do not fit are packed, each pack is summarised, and
    the summaries are the new descriptions."""
    packs = groups.select("node_id", F.posexplode(T.pack_descriptions(F.col("descriptions"), most_tokens)).alias("at", "pack"))
    told = packs.withColumn("summary", answered(F.concat(F.lit(SUMMARY), T.numbered(F.col("pack"))), provider))
    return told.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "summary"))), lambda x: x["summary"]).alias("descriptions"))


def summarised(groups: DataFrame, most_tokens: int = 3000, provider: Provider | None = None) -> DataFrame:
    """(node_id, description, embedding) of groups(node_id, descriptions): summarised at once where they fit, else level by level, and
    cut to the budget after three levels.  A group without descriptions gives no row."""
    left = groups.where(F.size("descriptions") > 0)
    size = T.token_count(T.numbered(F.col("descriptions")))
    done = None
    for depth in range(DEPTH + 1):
        last = depth == DEPTH
        fits = left if last else left.where(size <= most_tokens)
        content = T.numbered(F.col("descriptions"))
        rows = fits.select("node_id", answered(F.concat(F.lit(SUMMARY), T.truncate_tokens(content, most_tokens) if last else content), provider).alias("description"))
        done = rows if done is None else done.unionByName(rows)
        if not last:
            left = _level(left.where(size > most_tokens), most_tokens, provider)
    return done.withColumn("embedding", embedded(F.col("description"), provider))


def member_groups(nodes: DataFrame, edges: DataFrame, owner: str, *types: str) -> DataFrame:
    """(node_id, descriptions) of the owners' members in order of name."""
    owners = nodes.where(F.col("label") == owner).select("node_id")
    e = edges.where(F.col("type").isin(*types)).select(F.col("src").alias("node_id"), F.col("dst").alias("m"))
    told = nodes.where("description IS NOT NULL").select(F.col("node_id").alias("m"), "name", "description")
    joined = owners.join(e, "node_id").join(told, "m")
    return joined.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "m", "description"))), lambda x: x["description"]).alias("descriptions"))


def module_summaries(nodes: DataFrame, edges: DataFrame, most_tokens: int = 3000, provider: Provider | None = None) -> DataFrame:
    return summarised(member_groups(nodes, edges, "Module", "CONTAINS"), most_tokens, provider)


def class_summaries(nodes: DataFrame, edges: DataFrame, deferred: DataFrame, most_tokens: int = 3000, provider: Provider | None = None) -> DataFrame:
    groups = member_groups(nodes, edges, "Class", "HAS_METHOD").join(deferred.select("node_id"), "node_id", "left_semi")
    return summarised(groups, most_tokens, provider)
