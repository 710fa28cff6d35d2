"""Retrieval: exact vector search, chunk indexes, BM25, reranking and packing of contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..functions.vectors import cosine, dot, normalised
from ..providers import Provider, embedded, scored
from ..session import written
from .scoring import asked_words, scorer

#: Okapi constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries that are sent to the index at once.
QUERY_BLOCK = 4096


def top_k(rows: DataFrame, score: str, k: int, *ties: str, per: str | None = None) -> DataFrame:
    """The k best rows, or the k best of each ``per`` value; ties by the tie columns."""
    order = [F.desc_nulls_last(score), *ties]
    if per is None:
        return rows.orderBy(*order).limit(k)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def similar_nodes(nodes: DataFrame, query: Column, k: int = 1) -> DataFrame:
    """The nodes nearest to a vector by cosine."""
    return top_k(nodes.where("embedding IS NOT NULL").withColumn("similarity", cosine("embedding", query)), "similarity", k, "node_id")


def search_vectors(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", item: str = "id") -> DataFrame:
    """(query_id, item, similarity, rank) for a table of queries (query_id, embedding) against an index (item, embedding).

    Queries are sent whole to the index's tasks, which keep k rows for each query before anything is moved: at once up to QUERY_BLOCK of
    them, more of them in blocks of about that size.  A search by an index of cells is among the operators for training data."""
    q = written(queries.select(F.col(query_id), normalised("embedding").alias("q")), "queries")
    i = index.select(F.col(item), normalised("embedding").alias("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    parts = [q] if blocks == 1 else [q.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) for b in range(blocks)]
    pairs = [i.join(F.broadcast(p), F.lit(True)).select(query_id, item, dot("q", "v").alias("similarity")) for p in parts]
    return reduce(DataFrame.unionByName, [top_k(p, "similarity", k, item, per=query_id) for p in pairs])


# ---------------------------------------------------------------- chunk indexes


def chunk_index(items: DataFrame, key: str, content: str, size: int = 512, overlap: int = 50, python: bool = False, provider: Provider | None = None) -> DataFrame:
    """items with one row per piece of their content: id ``key_number``, document, chunk_index, total_chunks, embedding."""
    cut = items.where(F.length(content) > 0).withColumn("pieces", T.split_text(F.col(content), size, overlap, python)).withColumn("total_chunks", F.size("pieces"))
    rows = cut.select(*items.columns, "total_chunks", F.posexplode("pieces").alias("chunk_index", "document"))
    rows = rows.withColumn("id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))
    return rows.withColumn("embedding", embedded(F.col("document"), provider))


def node_index(nodes: DataFrame, content: str = "description", labels: tuple[str, ...] = ("Function", "GlobalVariable", "Method"), **options) -> DataFrame:
    """A chunk index of nodes' descriptions, or of their code."""
    items = nodes.where(F.col("label").isin(*labels)).select(F.col("node_id").alias("original_node_id"), "name", F.col("label").alias("type"), "module_name", F.col("repo").alias("repo_name"), F.col("class").alias("class_name"), "signature", content)
    return chunk_index(items, "original_node_id", content, **options)


def missing_repos(repos: DataFrame, index: DataFrame) -> DataFrame:
    """Repositories that an index does not have yet."""
    return repos.join(index.select(F.col("repo_name").alias("repo")).distinct(), "repo", "left_anti")


# ---------------------------------------------------------------- BM25


def chunked_lines(docs: DataFrame, key: str, content: str, size: int = 10) -> DataFrame:
    """(key, chunk, start_line, end_line, total_lines, text) of fixed runs of lines."""
    return docs.where(F.col(content).isNotNull()).select(key, F.inline(T.line_chunks(F.col(content), size)))


def inverted_index(chunks: DataFrame, keys: list[str], content: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, corpus): index (keys, tokens, dl) has each chunk's words, written once; corpus is one row (n, avgdl)."""
    tokens = written(chunks.select(*keys, T.bm25_tokens(F.col(content)).alias("tokens")).withColumn("dl", F.size("tokens")), "words")
    return tokens, tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_weights(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, idf): Okapi weights; a term in over half of the chunks gets a share of the mean weight instead of a negative one."""
    df = index.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = written(df.join(F.broadcast(corpus.select("n")), F.lit(True)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "weights")
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


#: Distinct query terms that may be broadcast to the index.
QUERY_TERMS = 100_000
#: Words of queries that are sent at once to the tasks that score.
ASKED_ROWS = 1_000_000
#: Chunks that a task scores at once, at most and at least.
MOST_CHUNKS, LEAST_CHUNKS = 65_536, 2_048


def bm25(queries: DataFrame, index: DataFrame, corpus: DataFrame, keys: list[str], k: int, query_id: str = "query_id", content: str = "text", digits: int | None = None) -> DataFrame:
    """(query_id, keys, score, rank): the k best chunks with a positive score; a term repeated in a query counts as often.  ``digits``
    rounds scores (half up, as of the double) before they are ranked.

    Only the queries' own terms leave the index.  Every hit counts, but none is a row: a task holds the scores of a block of chunks as a
    vector, adds up a query's terms in it and passes on the query's k best, so what is moved grows with the results."""
    spark = index.sparkSession
    terms = queries.select(query_id, F.explode(T.bm25_tokens(F.col(content))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("times"))
    asked = written(terms.join(term_weights(index, corpus), "term").select(query_id, "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    wanted = written(asked.select("term").distinct(), "wanted")
    words = index.select(*keys, "dl", F.explode("tokens").alias("term")).join(F.broadcast(wanted) if wanted.count() <= QUERY_TERMS else wanted, "term", "left_semi")
    cores, chunks = spark.sparkContext.defaultParallelism, index.count()
    blocks = max(1, min(cores * -(-chunks // (cores * MOST_CHUNKS)), chunks // LEAST_CHUNKS))
    postings = words.repartition(blocks, *keys).groupBy(*keys, "term", "dl").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(corpus.select("avgdl")), F.lit(True))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    held = postings.groupBy(*keys).agg(F.collect_list(F.struct("term", part.alias("part"))).alias("words"))
    parts = max(1, -(-asked.count() // ASKED_ROWS))
    if parts > 1:
        held = written(held, "postings").repartition(blocks, *keys)
    held = held.sortWithinPartitions(*keys)
    schema = StructType([StructField(f.name, f.dataType) for f in (asked.schema[query_id], *(index.schema[c] for c in keys))]).add("score", "double")

    def scores(number: int) -> DataFrame:
        of = asked if parts == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == number)
        sent = asked_words(of.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("words")), query_id)
        return held.mapInArrow(scorer(spark.sparkContext.broadcast(sent), query_id, keys, k, digits), schema)

    return top_k(reduce(DataFrame.unionByName, map(scores, range(parts))), "score", k, *keys, per=query_id)


def bm25_excluding(ranked: DataFrame, excluded: DataFrame, path: str, k: int, query_id: str = "query_id") -> DataFrame:
    """Of each query's best 3k chunks those whose path does not end with the query's own file; of them the first k."""
    own = excluded.select(F.col(query_id).alias("own"), F.col("file"))  # a query without a name has its file too
    kept = ranked.where(F.col("rank") <= 3 * k).join(own, F.col(query_id).eqNullSafe(F.col("own")), "left").drop("own").where(F.col("file").isNull() | ~F.endswith(path, F.col("file")))
    order = Window.partitionBy(query_id).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("file")


# ---------------------------------------------------------------- reranking and packing


def rerank(items: DataFrame, query: Column, key: str, most_tokens: int = 512, k: int = 5, provider: Provider | None = None, by_lines: bool = True) -> DataFrame:
    """items(key, name, signature, code) by the best cosine of any of their pieces with a query text; the k best."""
    prefix = T.item_text(F.col("name"), F.col("signature"), F.lit(""))
    cut = items.withColumn("piece", F.explode(T.split_by_tokens(F.coalesce("code", F.lit("")), most_tokens, by_lines, prefix)))
    rows = cut.select(key, embedded(F.col("piece"), provider).alias("v"), embedded(query, provider).alias("q")).withColumn("score", dot(normalised("v"), normalised("q")))
    best = rows.groupBy(key).agg(F.max("score").alias("score"))
    return top_k(items.join(best, key), "score", k, key)


def cross_scores(pairs: DataFrame, key: list[str], query: str, content: str, most_tokens: int = 8192, provider: Provider | None = None) -> DataFrame:
    """(key, score): relevance of texts by a pair scorer, from 0 to 10; a text too long is halved and its best part counts."""
    rows = pairs.withColumn("part", F.explode(T.split_by_tokens(F.col(content), most_tokens)))
    raw = rows.withColumn("score", scored(F.col(query), F.col("part"), provider))
    return raw.groupBy(*key).agg(F.max(F.least(F.greatest(F.col("score") * 10, F.lit(0.0)), F.lit(10.0))).alias("score"))


def within_budget(rows: DataFrame, size: Column, limit: int | Column, *order: str, per: list[str] | None = None) -> DataFrame:
    """Rows in order as long as their sizes sum up to at most ``limit``; the first that does not fit ends the list."""
    w = Window.partitionBy(*(per or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= limit)


def grouped_context(rows: DataFrame, per: str = "query_id") -> DataFrame:
    """(per, context): code by module and class in order of first appearance, items outside any class after the classes."""
    cls = F.coalesce("class", F.lit(""))
    w = Window.partitionBy(per, "module_name")
    placed = rows.withColumn("m", F.min("position").over(w)).withColumn("c", F.min("position").over(Window.partitionBy(per, "module_name", cls)))
    item = F.struct("m", (cls == "").cast("int").alias("alone"), "c", "position", "module_name", cls.alias("class"), "code")
    ordered = placed.groupBy(per).agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = lambda x, i: F.concat(
        F.when((i == 0) | (F.element_at("items", F.greatest(i, F.lit(1)))["module_name"] != x["module_name"]), F.concat(F.lit("# Module: "), F.coalesce(x["module_name"], F.lit("")), F.lit("\n"))).otherwise(F.lit("")),
        F.coalesce(x["code"], F.lit("")),
    )
    return ordered.select(per, F.array_join(F.transform("items", line), "\n\n").alias("context"))


def packed_context(main: DataFrame, chunks: DataFrame, per: str = "query_id", budget: int = 4000, main_budget: int = 3000, most_chunks: int = 1000) -> DataFrame:
    """(per, position, source, text): graph results within ``main_budget`` tokens, then lexical chunks within what is left, at most
    ``most_chunks`` where the graph part is full."""
    m = within_budget(main.withColumn("tokens", T.token_count(F.col("text"))), F.col("tokens"), main_budget, "position", per=[per])
    used = m.groupBy(per).agg(F.sum("tokens").alias("main_tokens"))
    c = chunks.withColumn("tokens", T.token_count(F.col("text"))).join(used, per, "left").fillna(0, ["main_tokens"])
    room = F.when(F.col("main_tokens") >= main_budget, F.least(F.lit(most_chunks), budget - F.col("main_tokens"))).otherwise(budget - F.col("main_tokens"))
    c = within_budget(c.withColumn("room", room), F.col("tokens"), F.col("room"), "position", per=[per])
    return m.select(per, F.lit("graph").alias("source"), "position", "text").unionByName(c.select(per, F.lit("lexical").alias("source"), "position", "text"))


def packed_by_share(main: DataFrame, chunks: DataFrame, per: str = "query_id", budget: int = 4000, share: float = 0.75) -> DataFrame:
    """The same with a fixed share of the budget for the graph part."""
    return packed_context(main, chunks, per, budget, int(budget * share), budget)


def hybrid(graph: DataFrame, lexical: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Results of one path or of both."""
    if mode not in ("graph", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    return graph if mode == "graph" else lexical if mode == "bm25" else graph.unionByName(lexical)


def routed(first: DataFrame, second: DataFrame, per: str = "query_id") -> DataFrame:
    """The first path's rows, and the second path's for the queries the first has none for."""
    return first.unionByName(second.join(first.select(per).distinct(), per, "left_anti"))
