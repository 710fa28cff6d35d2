"""Evaluation texts leaking into training text.

Method: a distributed positional inverted index.  Every training token becomes part of a posting (term, document, positions); the
postings are stored once, each run of documents with its terms in order, and answer any set of evaluation items.  For each run of ``width`` words
of an item the two rarest terms are looked up and their offset-adjusted position lists intersected; only where both agree are the
lists of the item's other terms intersected as well.  What is left are exact phrase matches; proximity matches count an item's
terms near its rarest ones.  Texts are read once, to be indexed; after that only postings move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import BROADCAST_ROWS, WORD, batches, picked, sized

#: Consecutive words in common that make a leak.
WIDTH = 12
#: Documents whose postings are made and sorted at once.
RUN = 2048
#: Further words that are looked up before all of an item's words are.
MORE = 3
#: For each so many distinct words of an item one more of its rarest words must be held by a document to be looked at.
MEETING = 4
_MARKUP = re.compile(r"<[^>]*>")


def words(text: str) -> list[str]:
    """Maximal runs of ASCII letters, digits and underscores after taking out markup tags and lowering case."""
    return WORD.findall(_MARKUP.sub("", text).lower())


_POSTINGS = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("positions", pa.list_(pa.int32()))])


def _posted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(first, RUN) for whole in it for first in range(0, whole.num_rows, RUN)):
        tokens: list[str] = []
        ends = [0]
        for text in batch.column(2).to_pylist():
            tokens += words(text)
            ends.append(len(tokens))
        if not tokens:
            continue
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        terms = np.asarray(coded.dictionary.to_pylist(), dtype=object)
        rank = np.empty(len(terms), np.int64)
        order = np.argsort(terms)
        rank[order] = np.arange(len(terms))
        code = rank[coded.indices.to_numpy()]
        sizes = np.diff(ends)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = (np.arange(len(tokens)) - np.repeat(np.asarray(ends[:-1]), sizes)).astype(np.int32)
        by = np.argsort(code, kind="stable")  # within a term documents and positions stay in order
        code, doc, place = code[by], doc[by], place[by]
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)].astype(np.int32)), pa.array(place))
        held = pa.array(doc[starts])
        yield pa.RecordBatch.from_arrays([pa.array(terms[order][code[starts]].tolist(), pa.string()), batch.column(0).take(held), batch.column(1).take(held), positions], schema=_POSTINGS)


def index(documents: DataFrame) -> DataFrame:
    """(term, doc_id, copy, positions): the positional index of all documents' words, written to the shared folder.

    copy tells texts apart that come under one doc_id.  Rows without doc_id or text, and repeated rows beyond the first, change nothing.
    """
    rows = picked(documents, "doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return written(rows.mapInArrow(_posted, "term string, doc_id bigint, copy bigint, positions array<int>"), "postings")


_ITEMS = pa.schema([("item_id", pa.int64()), ("version", pa.int64()), ("place", pa.int32()), ("term", pa.string())])


def _placed(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _ITEMS.names}
    for item, version, text in zip(rows["item_id"], rows["version"], rows["text"]):
        ws = words(text)
        out["item_id"] += [item] * len(ws)
        out["version"] += [version] * len(ws)
        out["place"] += range(len(ws))
        out["term"] += ws
    return out


def item_words(eval_items: DataFrame, postings: DataFrame) -> DataFrame:
    """(item_id, version, place, term, n): the items' words and how many documents hold each, null for none; written."""
    rows = picked(eval_items, "item_id", "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct().select("item_id", F.xxhash64("text").alias("version"), "text")
    placed = written(rows.mapInArrow(batches(_placed, _ITEMS), "item_id bigint, version bigint, place int, term string"), "item_words")
    vocabulary = sized(placed.select("term").distinct(), "vocabulary")
    holding = postings.select("term").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return written(placed.join(sized(holding, "holding"), "term", "left").select("item_id", "version", "place", "term", "n"), "items")


_DOC, _ITEM = ["doc_id", "copy"], ["item_id", "version"]


def _looked_up(wanted: DataFrame, postings: DataFrame, name: str) -> DataFrame:
    """wanted(doc_id, copy, term, ...) with the positions of the term in the document, without those whose document lacks it."""
    wanted = written(wanted, name)
    if wanted.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(wanted), [*_DOC, "term"])
    docs, terms = sized(wanted.select(*_DOC).distinct(), f"{name}_documents"), sized(wanted.select("term").distinct(), f"{name}_terms")
    return wanted.join(postings.join(terms, "term", "left_semi").join(docs, _DOC, "left_semi"), [*_DOC, "term"])


def _runs(places: Column, width: int) -> Column:
    """struct(before, length, longest, matches) of runs of consecutive places in a sorted array."""
    start = F.struct(F.lit(-2).alias("before"), F.lit(0).alias("length"), F.lit(0).alias("longest"), F.lit(0).alias("matches"))

    def step(s: Column, p: Column) -> Column:
        length = F.when(p == s["before"] + 1, s["length"] + 1).otherwise(1)
        return F.struct(p.alias("before"), length.alias("length"), F.greatest(s["longest"], length).alias("longest"), (s["matches"] + (length >= width).cast("int")).alias("matches"))

    return F.aggregate(places, start, step)


def phrases(postings: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, matches, longest) of the documents in an index and the items of item_words."""
    ahead = Window.partitionBy(*_ITEM).orderBy("place").rowsBetween(0, width - 1)
    run = items.select(*_ITEM, F.col("place").alias("start"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "place", "term"))).over(ahead)).alias("run")).where(F.size("run") == width)
    first, second = F.col("run")[0], F.col("run")[1]
    pairs = run.groupBy(*_ITEM, first["place"].alias("place"), first["term"].alias("term"), second["place"].alias("other_place"), second["term"].alias("other"))
    pairs = pairs.agg(F.first("run").alias("run"), F.max("start").alias("low"), (F.min("start") + width - 1).alias("high"))
    # All runs with these two rarest words have the words from low to high in common, so a match has them as well.
    more = F.slice(F.filter("run", lambda x: x["place"].between(F.col("low"), F.col("high")) & (x["place"] != F.col("place")) & (x["place"] != F.col("other_place"))), 1, MORE)
    anchors = sized(pairs.select(*_ITEM, "place", "term", "other_place", "other", more.alias("more")), "anchors")
    # Where a run's rarest term stands, a match would have the item's word 0 at offset position - place; the next rarest must agree.
    near = postings.join(anchors.drop("more"), "term").withColumn("position", F.explode("positions"))
    near = near.select(*_DOC, *_ITEM, (F.col("position") - F.col("place")).alias("offset"), "place", F.col("other").alias("term"), "other_place").distinct()
    agreed = _looked_up(near, postings, "near").where(F.array_contains("positions", F.col("offset") + F.col("other_place"))).drop("term", "positions")
    more = agreed.join(anchors.select(*_ITEM, "place", "other_place", "more"), [*_ITEM, "place", "other_place"])
    more = written(more.select(*_DOC, *_ITEM, "offset", "place", "other_place", F.size("more").alias("wanted"), F.explode_outer("more").alias("x")).select("*", "x.term", F.col("x.place").alias("at")).drop("x"), "agreed")
    both = _looked_up(more.where("wanted > 0"), postings, "more").where(F.array_contains("positions", F.col("offset") + F.col("at")))
    both = both.groupBy(*_DOC, *_ITEM, "offset", "place", "other_place", "wanted").agg(F.countDistinct("at").alias("k")).where("k = wanted")
    agreed = both.select(*_DOC, *_ITEM, "offset").unionByName(more.where("wanted = 0").select(*_DOC, *_ITEM, "offset")).distinct()
    every = agreed.join(sized(items.where("n IS NOT NULL").select(*_ITEM, "place", "term"), "item_terms"), _ITEM)
    placed = _looked_up(every, postings, "matching").where(F.array_contains("positions", F.col("offset") + F.col("place")))
    aligned = placed.groupBy(*_DOC, *_ITEM, "offset").agg(F.array_sort(F.collect_set("place")).alias("places")).select(*_DOC, *_ITEM, _runs(F.col("places"), width).alias("runs"))
    found = aligned.where(F.col("runs.longest") >= width).groupBy(*_DOC, *_ITEM).agg(F.sum("runs.matches").cast("int").alias("matches"), F.max("runs.longest").alias("longest"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matches").alias("matches"), F.max("longest").alias("longest"))


def leaks(documents: DataFrame, eval_items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, matches, longest): documents and items with ``width`` consecutive words in common.

    matches counts the runs of ``width`` words found, longest is the length of the longest common run.  Null texts and texts
    of fewer words match nothing; repeated rows count once.  Where texts differ under one doc_id or item_id, the best counts.
    """
    postings = index(documents)
    return phrases(postings, item_words(eval_items, postings), width)


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(item_id, benchmark, documents, longest, leaked): one row per item, with how many documents hold a part of it."""
    hits = leaks(documents, eval_items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest").alias("longest"))
    items = picked(eval_items, "item_id", "benchmark").distinct()
    return items.join(hits, "item_id", "left").select(
        "item_id", "benchmark", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("documents").isNotNull().alias("leaked")
    )


def proximity(documents: DataFrame, eval_items: DataFrame, window: int = 24, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, near_share): the largest share of an item's distinct words that a document holds within the item's length,
    but at least ``window`` words, on either side of one of its rarest words, where that share is at least ``share``: edited or
    reordered copies.

    As many of the item's rarest words are taken as it may lack and one more, so that no document with the share is passed over.
    Items of fewer than WIDTH words, null and short texts match nothing; repeated rows count once.
    """
    postings = index(documents)
    items = item_words(eval_items, postings)
    size = items.groupBy(*_ITEM).agg(F.count(F.lit(1)).alias("length"), F.countDistinct("term").alias("distinct"), F.countDistinct(F.when(F.col("n").isNotNull(), F.col("term"))).alias("held")).where(F.col("length") >= WIDTH)
    # It may lack all but this many; words no document holds are lacking already.
    need = F.ceil(F.col("distinct") * share - 1e-9)
    size = size.withColumn("anchors", F.col("held") - need + 1).where("anchors >= 1").withColumn("meet", F.least(F.floor(F.col("distinct") / MEETING) + 1, need))
    by_rarity = Window.partitionBy(*_ITEM).orderBy("n", "term")
    terms = items.where("n IS NOT NULL").select(*_ITEM, "term", "n").distinct().join(size, _ITEM).withColumn("rank", F.row_number().over(by_rarity))
    terms = written(terms.select(*_ITEM, "term", "rank", "length", "distinct", "anchors", "meet"), "ranked")
    # A document with the share holds at least ``meet`` of the ``meet`` - 1 more rarest words.
    asked = sized(terms.where(F.col("rank") <= F.col("anchors") + F.col("meet") - 1).select(*_ITEM, "term", "meet"), "asked")
    met = postings.select("term", *_DOC).distinct().join(asked, "term").groupBy(*_DOC, *_ITEM).agg(F.count(F.lit(1)).alias("k"), F.first("meet").alias("meet")).where("k >= meet").select(*_DOC, *_ITEM)
    wanted = met.join(sized(terms.select(*_ITEM, "term", (F.col("rank") <= F.col("anchors")).alias("anchor"), "length", "distinct"), "ranked_terms"), _ITEM)
    held = _looked_up(wanted, postings, "met").groupBy(*_DOC, *_ITEM, "term", "anchor", "length", "distinct").agg(F.first("positions").alias("positions"))
    pairs = held.groupBy(*_DOC, *_ITEM, "length", "distinct").agg(F.collect_list(F.struct("anchor", "positions")).alias("terms"))
    near = pairs.select("doc_id", "item_id", F.greatest("length", F.lit(window)).alias("reach"), "distinct", "terms").mapInArrow(_close(share), "doc_id bigint, item_id bigint, near_share double")
    return near.groupBy("doc_id", "item_id").agg(F.max("near_share").alias("near_share"))


_NEAR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("near_share", pa.float64())])


def _close(share: float):
    def rows(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in _NEAR.names}
        for doc, item, reach, distinct, terms in zip(*(columns[n] for n in ("doc_id", "item_id", "reach", "distinct", "terms"))):
            centres = np.unique(np.concatenate([np.asarray(t["positions"]) for t in terms if t["anchor"]] or [np.empty(0, np.int64)]))
            count = np.zeros(len(centres), np.int64)
            for t in terms:  # a term counts where one of its positions is within reach
                at = np.asarray(t["positions"])
                count += np.searchsorted(at, centres - reach) < np.searchsorted(at, centres + reach, side="right")
            best = count.max(initial=0) / distinct
            if best >= share:
                for column, value in zip(_NEAR.names, (doc, item, round(float(best), 6))):
                    out[column].append(value)
        return out

    return batches(rows, _NEAR)


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, eval_items).select("doc_id", "item_id").distinct()
