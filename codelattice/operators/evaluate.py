"""Evaluation of ranked results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import dcg, gain


def ideal(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, idcg, relevant) of judged(query_id, doc_id, relevance); queries without a relevant document are left out."""
    by = judged.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("relevance"), asc=False), 1, k).alias("r"), F.count_if(F.col("relevance") > 0).alias("relevant"))
    return by.where("relevant > 0").select("query_id", dcg(F.col("r")).alias("idcg"), "relevant")


def ndcg_recall(ranked: DataFrame, judged: DataFrame, k: int = 10, item: str = "doc_id") -> DataFrame:
    """(query_id, ndcg, recall): results(query_id, item, rank) at ranks up to k; an item found more than once counts at its first rank.

    Queries without results score 0, those without a relevant document are left out."""
    first = ranked.where(F.col("rank") <= k).groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    hit = first.join(judged.groupBy("query_id", item).agg(F.max("relevance").alias("relevance")), ["query_id", item])
    got = hit.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"), F.count_if(F.col("relevance") > 0).alias("hits"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ideal(judged, k).join(got, "query_id", "left").select("query_id", (z("dcg") / F.col("idcg")).alias("ndcg"), (z("hits") / F.col("relevant")).alias("recall"))


def named_relevance(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """judged with the documents' function names as items; of documents of one name the last by doc_id decides."""
    named = judged.join(docs.select("doc_id", F.col("func_name").alias("name")).where("func_name IS NOT NULL"), "doc_id")
    return named.groupBy("query_id", "name").agg(F.max_by("relevance", "doc_id").alias("relevance"))


def greedy_scores(ranked: DataFrame, truths: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall) where a ground truth is credited once: a result of its name or Class.name takes it; a class takes
    the most relevant of its methods not taken yet.  Sequential by rank within a query.

    ranked(query_id, rank, label, name, class); truths(query_id, name, relevance), name as ``name`` or ``Class.name``.
    """
    grouped = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "name", "class"))).alias("results"))
    known = truths.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("name", "relevance"))).alias("truths"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import math

        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                left = {t["name"]: t["relevance"] for t in r.truths}
                total, hits = 0.0, 0
                for x in r.results if r.results is not None else []:
                    if x["label"] == "Class":
                        mine = [n for n in left if n.startswith(f"{x['name']}.")]
                        name = max(mine, key=lambda n: (left[n], n), default=None)
                    else:
                        full = f"{x['class']}.{x['name']}" if x["class"] else x["name"]
                        name = full if full in left else x["name"] if x["name"] in left else None
                    if name is not None and (gained := left.pop(name)) > 0:
                        total += gained / math.log2(x["rank"] + 1)
                        hits += 1
                best = sorted((t["relevance"] for t in r.truths), reverse=True)[:k]
                idcg = sum(v / math.log2(i + 2) for i, v in enumerate(best) if v > 0)
                relevant = sum(t["relevance"] > 0 for t in r.truths)
                if relevant:
                    rows.append((r.query_id, total / idcg, hits / relevant))
            yield pd.DataFrame(rows, columns=["query_id", "ndcg", "recall"])

    return known.join(grouped, "query_id", "left").select("query_id", "results", "truths").mapInPandas(run, "query_id string, ndcg double, recall double")


def lenient_scores(ranked: DataFrame, truths: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall) by the older rule: a class result gains the most relevant of its methods without taking it, other results
    count at their first rank, and recall is over all ground truths, relevant or not."""
    t = truths.select("query_id", F.col("name").alias("truth"), "relevance", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("owner"), F.element_at(F.split("name", r"\."), -1).alias("short"))
    full = F.when(F.col("class").isNull() | (F.col("class") == ""), F.col("name")).otherwise(F.concat_ws(".", "class", "name"))
    r = ranked.where(F.col("rank") <= k).select("query_id", "rank", "label", "name", full.alias("full"))
    plain = r.where("label <> 'Class'").join(t, "query_id").where("truth = full OR truth = name").groupBy("query_id", "truth").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    whole = r.where("label = 'Class'").join(t, "query_id").where("owner = name").groupBy("query_id", "rank").agg(F.max("relevance").alias("relevance"), F.max_by("truth", F.struct("relevance", "truth")).alias("truth"))
    hits = plain.select("query_id", "truth", "rank", "relevance").unionByName(whole.select("query_id", "truth", "rank", "relevance"))
    got = hits.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"), F.countDistinct("truth").alias("hits"))
    judged = truths.select("query_id", F.col("name").alias("doc_id"), "relevance")
    every = truths.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ideal(judged, k).join(every, "query_id").join(got, "query_id", "left").select("query_id", (z("dcg") / F.col("idcg")).alias("ndcg"), (z("hits") / F.col("all")).alias("recall"))


def first_hit(ranked: DataFrame, wanted: DataFrame, keys: list[str], k: int = 10, per: str = "query_id") -> DataFrame:
    """(per, rank, ndcg, recall) for one wanted item a query: the first rank it stands at within k; 0 where it does not."""
    hit = ranked.where(F.col("rank") <= k).join(wanted, [per, *keys]).groupBy(per).agg(F.min("rank").alias("rank"))
    return wanted.select(per).distinct().join(hit, per, "left").select(
        per, "rank", F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0)).alias("ndcg"), F.col("rank").isNotNull().cast("double").alias("recall")
    )


def expand_classes(ranked: DataFrame, methods: DataFrame) -> DataFrame:
    """Ranked nodes with the methods(class_id, node_id) of ranked classes at the class's rank."""
    inside = ranked.join(methods, ranked["node_id"] == methods["class_id"]).select(ranked["query_id"], methods["node_id"], ranked["rank"])
    return ranked.select("query_id", "node_id", "rank").unionByName(inside)


def snippet_matches(ranked: DataFrame, gold: DataFrame, k: int = 5, alike: float = 0.25, sure: float = 0.75) -> DataFrame:
    """(example_idx, found_match, match_rank, best_similarity, best_match_idx, num_retrieved): the first of an example's results whose
    code is like its gold snippet, and has its name, or is so like it that the name does not matter.

    ranked(example_idx, rank, name, code); gold(example_idx, name, snippet).  Similarities after the match do not count.
    """
    rows = gold.join(ranked.where(F.col("rank") <= k).withColumnRenamed("name", "found_name"), "example_idx", "left")
    rows = rows.withColumn("ratio", T.sequence_ratio(F.col("snippet"), F.col("code")))
    hit = ((F.col("ratio") >= alike) & (F.col("found_name") == F.col("name"))) | ((F.col("ratio") >= sure) & F.col("name").isNull())
    at = Window.partitionBy("example_idx")
    rows = rows.withColumn("match_rank", F.min(F.when(hit, F.col("rank"))).over(at))
    seen = F.col("match_rank").isNull() | (F.col("rank") <= F.col("match_rank"))
    return rows.groupBy("example_idx").agg(
        F.max("match_rank").isNotNull().alias("found_match"), F.max("match_rank").alias("match_rank"), F.coalesce(F.max(F.when(seen, F.col("ratio"))), F.lit(0.0)).alias("best_similarity"),
        F.max_by(F.when(seen, F.col("rank")), F.when(seen, F.struct("ratio", -F.col("rank")))).alias("best_match_idx"), F.count("rank").alias("num_retrieved"),
    )


def choice(examples: DataFrame) -> DataFrame:
    """Examples with the gold snippet and identifier of their context array, whose index counts from 0."""
    gold = F.try_element_at("context", F.col("gold_snippet_index") + 1)
    return examples.withColumn("snippet", gold["snippet"]).withColumn("identifier", gold["identifier"])


def completions(rows: DataFrame) -> DataFrame:
    """rows(predicted, groundtruth) with exact_match and edit_similarity."""
    p, g = F.col("predicted"), F.col("groundtruth")
    return rows.withColumn("exact_match", T.exact_match(p, g)).withColumn("edit_similarity", T.edit_similarity(p, g))


def completion_summary(rows: DataFrame) -> DataFrame:
    return completions(rows).groupBy("repo").agg(
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"), F.avg("edit_similarity").alias("average_edit_similarity"), F.count(F.lit(1)).alias("total_examples")
    )
