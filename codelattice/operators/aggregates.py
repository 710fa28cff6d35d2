"""Counts, statistics and averages over the graph and over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LABELS
from .pattern import hop


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def repo_statistics(nodes: DataFrame, edges: DataFrame, methods: bool = True) -> DataFrame:
    """One row per Repo node with the number of nodes of each label below it, 0 where there is none, and their total.

    Without ``methods`` only CONTAINS is followed, so methods count 0."""
    repo = nodes.where("label = 'Repo'").select(F.col("node_id").alias("repo_id"), F.col("name").alias("repo_name"))
    m = hop(repo, edges, "repo_id", "n", "CONTAINS")
    c = hop(m.withColumnRenamed("n", "m"), edges, "m", "n", "CONTAINS").select("repo_id", "repo_name", "n")
    below = m.select("repo_id", "repo_name", "n").unionByName(c)
    if methods:
        below = below.unionByName(hop(c.withColumnRenamed("n", "c"), edges, "c", "n", "HAS_METHOD", "HAS_FIELD").select("repo_id", "repo_name", "n"))
    kinds = [x for x in LABELS if x not in ("Repo", "Import")]
    labelled = below.distinct().join(nodes.select(F.col("node_id").alias("n"), "label"), "n")
    counted = labelled.groupBy("repo_id", "repo_name").agg(*(F.count_if(F.col("label") == k).alias(k) for k in kinds))
    out = repo.join(counted.drop("repo_name"), "repo_id", "left").fillna(0, kinds)
    return out.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0))).drop("repo_id")


def statistics_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("total") == 0).alias("empty_repos"), F.sum("total").alias("nodes"), F.max("total").alias("largest"))


def largest(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n repositories with the most nodes; ties by name."""
    return stats.orderBy(F.desc("total"), "repo_name").limit(n)


def documents_by_language(docs: DataFrame, language: str, key: str = "repo") -> DataFrame:
    """(key, n, doc_ids) of one language's documents: how many, and which in order."""
    return docs.where(F.lower(F.trim("language")) == language).groupBy(key).agg(F.countDistinct("doc_id").alias("n"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def averages_without(results: DataFrame, excluded: DataFrame, *metrics: str) -> DataFrame:
    """One row: the mean of each metric over results(repo, queries: array<struct<metrics>>) of the repositories not excluded(repo)."""
    kept = results.join(excluded.select("repo").distinct(), "repo", "left_anti").select(F.inline("queries"))
    return kept.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(m).alias(m) for m in metrics))


def repositories(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'Repo'").select("name").distinct().orderBy("name")


def python_file_counts(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py")).groupBy("repo").agg(F.count(F.lit(1)).alias("python_files"))


def judged_once(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance, judgements): the most frequent relevance of a pair, the highest one where several are."""
    counted = qrels.where("relevance IS NOT NULL").groupBy("query_id", "doc_id", "relevance").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("query_id", "doc_id").agg(F.max(F.struct("n", "relevance")).alias("x"), F.sum("n").alias("judgements")).select(
        "query_id", "doc_id", F.col("x.relevance").alias("relevance"), "judgements"
    )


def docs_by_query(judged: DataFrame) -> DataFrame:
    """(query_id, docs): array<struct(relevance, doc_id)>, most relevant first, then by doc_id."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("order"), "doc_id", "relevance")))
    return judged.groupBy("query_id").agg(ordered.alias("docs")).withColumn("docs", F.transform("docs", lambda d: F.struct(d["relevance"].alias("relevance"), d["doc_id"].alias("doc_id"))))


def frequent_repos(rows: DataFrame, least: int) -> DataFrame:
    """Repositories with at least so many rows, most first."""
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "repo")


def both_present(docs: DataFrame, qrels: DataFrame, repo_of: DataFrame) -> DataFrame:
    """(repo, doc_count, qrels_count) of the repositories that have documents and judgements."""
    judged = qrels.join(repo_of, "doc_id").groupBy("repo").agg(F.count(F.lit(1)).alias("qrels_count"))
    return docs.groupBy("repo").agg(F.count(F.lit(1)).alias("doc_count")).join(judged, "repo")


# ---------------------------------------------------------------- result averages


def macro_micro(results: DataFrame, group: str, *metrics: str) -> DataFrame:
    """One row: for each metric its mean over rows (micro) and the mean of its means per group (macro)."""
    per = results.groupBy(group).agg(*(F.sum(m).alias(f"s_{m}") for m in metrics), *(F.count(m).alias(f"n_{m}") for m in metrics))
    out = []
    for m in metrics:
        out += [(F.sum(f"s_{m}") / F.sum(f"n_{m}")).alias(f"micro_{m}"), F.avg(F.col(f"s_{m}") / F.col(f"n_{m}")).alias(f"macro_{m}")]
    return per.agg(*out)


def weighted_mean(rows: DataFrame, weight: str, *rates: str) -> DataFrame:
    return rows.agg(*((F.sum(F.col(r) * F.col(weight)) / F.sum(weight)).alias(r) for r in rates))


def overall(tracking: DataFrame, excluded: DataFrame) -> DataFrame:
    """Accuracy over all examples, and the mean of the repositories' MRR and NDCG, without the excluded ones."""
    kept = tracking.join(excluded.select("repo").distinct(), "repo", "left_anti")
    return kept.agg((F.sum("correct_retrievals") / F.sum("total_examples")).alias("accuracy"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def by_repository(results: DataFrame) -> DataFrame:
    """Per repository of detail rows (repo, found_match, match_rank, best_similarity, error); rows with an error are left out."""
    hit, rank = F.col("found_match"), F.col("match_rank")
    return results.where("error IS NULL").groupBy("repo").agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(F.when(hit, 1 / rank).otherwise(0.0)).alias("mrr"), F.avg(F.when(hit, 1 / F.log2(rank + 1)).otherwise(0.0)).alias("ndcg"), F.avg("best_similarity").alias("similarity"),
    )


def spread(rows: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(bin, n) of a histogram with equal bins; values at the upper end count in the last one."""
    number = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return rows.where(F.col(value).between(low, high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row of count, least, greatest, mean and median; 0 over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count(value).alias("n"), zero(F.min(value)).alias("least"), zero(F.max(value)).alias("greatest"), zero(F.avg(value)).alias("mean"), zero(F.median(value)).alias("median"))


def maxpool(scores: DataFrame, item: str, score: str) -> DataFrame:
    return scores.groupBy(item).agg(F.max(score).alias(score))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def rolled_up(results: DataFrame, group: str, metric: str) -> DataFrame:
    """The mean per group and, with a null group, over all."""
    return results.rollup(group).agg(F.avg(metric).alias(metric), F.count(F.lit(1)).alias("n"))


def rate(c: Column, of: Column) -> Column:
    return F.when(of > 0, c / of).otherwise(F.lit(0.0))
