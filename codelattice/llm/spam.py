"""Keyword-stuffed and link-list pages.

Method: the compression ratio of a page's blocks, normalised by length and language, flags extreme redundancy, and a low density of
sentence punctuation confirms it.  Running text and list-like lines are cut into blocks of their own, of bounded size, so that stuffed
sentences next to real prose, or lists next to either, are judged by themselves.  Before list-like lines are compressed, their links,
tags and short list items are replaced by a mark each, so that a list whose entries are all different is as redundant as its form.
Where sentences are punctuated, as in keywords dressed as sentences, the redundancy must be greater to count.  A page is spam if most of
its words lie in such blocks.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import batches, picked

#: A block is redundant if its ratio is below this share of the usual ratio of its length and language and it has few sentences ...
REDUNDANT = 0.6
#: ... fewer than so many sentence ends for 100 words; a block with more of them is redundant below this smaller share.
FEW_SENTENCES, DRESSED = 4.0, 0.55
#: A block is closed at the end of a sentence or line from this many characters; a rest of under half of it joins the block before.
BLOCK = 700
#: Where a whole part is redundant but less than this share of its words lies in redundant blocks, it repeats itself over distances longer
#: than a block, and all its words count.
EXPLAINED = 0.25
#: A page is spam from this share of its words in redundant blocks.
SPAM_SHARE = 0.5
#: The level of a language is the one that so many pages of it show together with as many pages of the usual level as the second figure
#: says; it is taken at this share of the pages, ranked by ratio, so that it stays right where a smaller share of them is spam.
LEVEL_AT, USUAL_PAGES = 0.7, 20
#: Words of a list item at most, and items of a line at least, for the items to be replaced by marks.
ITEM_WORDS, ITEMS = 3, 3

_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"<a\s[^>]*>(?s:.*?)</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|\b(?:[\w-]+\.)+[a-z]{2,}/\S*", re.I)
_TAG = re.compile(r"(?<!\S)[#@]\w[\w-]*")
_END = re.compile(r"[.!?…](?=[\s\"'»”’)\]]|$)")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+")
_SEPARATOR = re.compile(r"\s[|•·»>/;]\s|\t|,\s")
_ROW = re.compile(r"\s[|•·»>/;]\s|\t")
_CODE = re.compile(r"^(?:\s{4}|\t).*[(){}=;\[\]]|[{};]\s*$|\w\([^)]*\)\s*[:{;]?\s*$|^\s*(?:def|class|return|import|from|func|end|if|for|while)\b.*[:)({]\s*$")
_LINES = re.compile("[\r\n\u2028\u2029]+")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def _ratio(text: str, length: int) -> float:
    return len(zlib.compress(text.encode("utf-8", "replace"), 6)) / length if length else 1.0


def _blocks(pieces: list[str]) -> list[list[str]]:
    """Consecutive pieces in blocks of about BLOCK characters; a longer piece is cut at blanks, or where there are none anywhere."""
    out: list[list[str]] = []
    size = BLOCK
    for piece in (p for whole in pieces for p in _cut(whole)):
        if size >= BLOCK:
            out.append([])
            size = 0
        out[-1].append(piece)
        size += len(piece) + 1
    if len(out) > 1 and 2 * size < BLOCK:
        rest = out.pop()
        out[-1] += rest
    return out


def _cut(piece: str) -> list[str]:
    out = []
    while len(piece) > 2 * BLOCK:
        at = piece.rfind(" ", BLOCK // 2, BLOCK) + 1 or BLOCK
        out.append(piece[:at])
        piece = piece[at:]
    return [*out, piece]


def form(line: str) -> str:
    """What is left of a list-like line when its links, tags and short list items are marks."""
    line = _TAG.sub("#", _LINK.sub("\x02", line))
    items = _SEPARATOR.split(line)
    if len(items) < ITEMS:
        return line
    return ",".join("" if len(_WORD.findall(x)) <= ITEM_WORDS else x for x in items)


def _block(part: str, whole: bool, pieces: list[str]) -> dict:
    """The measures of _BLOCK.  The links of running text do not count in its length; those of lists do, as they are what it is made of."""
    text = "\n".join(pieces)
    words = len(_WORD.findall(text))
    shown = _LINK.sub("\x02", text) if part == "told" else "\n".join(map(form, pieces))
    length = len((shown if part == "told" else text).encode("utf-8", "replace"))
    return {"part": part, "whole": whole, "words": words, "length": length, "ratio": _ratio(shown, length), "ends": 100.0 * len(_END.findall(shown)) / words if words else 0.0}


def measured(text: str) -> tuple[int, list[dict]]:
    """Words in all, and the measures of _BLOCK for the sentences ("told") and the list-like lines ("listed"), each as a whole and,
    where it has several, by block.  Code is only counted."""
    told, listed, code, fenced = [], [], 0, False
    for line in _LINES.split(text):
        if not line.strip():
            continue
        fence = _FENCE.match(line)
        fenced = fenced != bool(fence)
        if fenced or fence or _CODE.search(line):
            code += len(_WORD.findall(line))
            continue
        for part in _SPLIT.split(line):
            (told if _END.search(part) and len(_WORD.findall(_LINK.sub(" ", part))) >= 4 and not _ROW.search(part) else listed).append(part)
    blocks = []
    for part, pieces in (("told", told), ("listed", listed)):
        if pieces:
            cut = _blocks(pieces)
            blocks.append(_block(part, True, [p for block in cut for p in block]))
            blocks += [_block(part, False, block) for block in cut] if len(cut) > 1 else []
    return sum(b["words"] for b in blocks if b["whole"]) + code, blocks


_BLOCK = pa.struct([("part", pa.string()), ("whole", pa.bool_()), ("words", pa.int64()), ("length", pa.int64()), ("ratio", pa.float64()), ("ends", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("blocks", pa.list_(_BLOCK))])
_KINDS = "doc_id bigint, lang string, words bigint, blocks array<struct<part: string, whole: boolean, words: bigint, length: bigint, ratio: double, ends: double>>"
_LANG = re.compile(r"[a-z]+")
# Names and three-letter codes of languages.
_LANGS = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es"}


def language(value: str | None) -> str:
    """A label's two-letter code; empty where it names no language."""
    m = _LANG.match((value or "").strip().lower())
    name = _LANGS.get(m[0], m[0]) if m else ""
    return name if len(name) == 2 else ""


def _measures(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _OUT.names}
    for doc, text, lang in zip(rows["doc_id"], rows["text"], rows["lang"]):
        for name, value in zip(_OUT.names, (doc, language(lang), *measured(text))):
            out[name].append(value)
    return out


def _bin(length: Column) -> Column:
    return F.floor(F.log2(F.greatest(length, F.lit(16))) * 2).cast("int")


def page_measures(documents: DataFrame) -> DataFrame:
    """Per page the measures of its blocks, each with its score: its ratio against the usual one, taken from all pages, for its length
    and language.

    The tables of usual ratios have a row for each half power of two of length and for each two-letter language, however many pages."""
    rows = picked(documents, "doc_id", "text", "lang").where(F.length("text") > 0)
    # Numbers only, written once: the usual ratios and the pages' own are taken from the same measures.
    pages = written(rows.mapInArrow(batches(_measures, _OUT), _KINDS), "pages")
    told = pages.select("lang", F.explode("blocks").alias("x")).where("x.part = 'told' AND x.words > 0").select("lang", "x.whole", "x.ratio", _bin(F.col("x.length")).alias("bin"))
    usual = told.groupBy("bin").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"))
    # Longer text compresses better, so no length's usual ratio is below that of a greater length: a length at which most blocks are
    # spam takes the ratio of longer ones.
    usual = F.broadcast(usual.withColumn("usual", F.max("usual").over(Window.orderBy(F.desc("bin")))))
    # A language's texts as a whole lie above or below those ratios by some factor; the fewer its pages, the nearer it is taken to 1.
    level = F.percentile_approx(F.col("ratio") / F.col("usual"), LEVEL_AT, 1000)
    whole = told.where("whole").join(usual, "bin")
    every = F.broadcast(whole.agg(level.alias("every")))
    factor = whole.groupBy("lang").agg(level.alias("level"), F.count(F.lit(1)).alias("n")).where("lang <> ''").join(every, F.lit(True))
    factor = F.broadcast(factor.select("lang", F.pow(F.col("level") / F.col("every"), F.col("n") / (F.col("n") + USUAL_PAGES)).alias("factor")))
    ratios = F.broadcast(usual.agg(F.map_from_entries(F.collect_list(F.struct("bin", "usual"))).alias("usual")))
    pages = pages.join(ratios, F.lit(True)).join(factor, "lang", "left")
    expected = lambda x: F.coalesce(F.col("usual")[_bin(x["length"])], F.get(F.map_values("usual"), F.lit(0)), F.lit(0.6)) * F.coalesce("factor", F.lit(1.0))
    return pages.withColumn("blocks", F.transform("blocks", lambda x: x.withField("score", F.when(x["words"] > 0, x["ratio"] / expected(x)))))


def score_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share, told_score, listed_score, is_spam), one row per row of documents with text.

    A score is the compression ratio of a part as a whole against the usual one, null where there is no such part.  Null or empty
    text gives no row; text without any word has share 0.  Repeated rows are judged alike.
    """
    pages = page_measures(documents)
    words = lambda blocks: F.aggregate(blocks, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])
    redundant = lambda x: F.coalesce(x["score"] < F.when(x["ends"] < FEW_SENTENCES, REDUNDANT).otherwise(DRESSED), F.lit(False))
    bad = F.lit(0)
    for part in ("told", "listed"):
        own = F.filter("blocks", lambda x: x["part"] == F.lit(part))  # noqa: B023
        pages = pages.withColumn(f"{part}_whole", F.get(F.filter(own, lambda x: x["whole"]), F.lit(0))).withColumn(f"{part}_score", F.col(f"{part}_whole")["score"])
        pages = pages.withColumn(f"{part}_inside", words(F.filter(own, lambda x: ~x["whole"] & redundant(x))))
        whole, inside = F.col(f"{part}_whole"), F.col(f"{part}_inside")
        bad = bad + F.when(redundant(whole) & (inside < EXPLAINED * whole["words"]), whole["words"]).otherwise(inside)
    return pages.withColumn("spam_share", F.when(F.col("words") > 0, bad / F.col("words")).otherwise(0.0)).select(
        "doc_id", "spam_share", "told_score", "listed_score", (F.col("spam_share") > SPAM_SHARE).alias("is_spam")
    )


def found(documents: DataFrame) -> DataFrame:
    return score_pages(documents).where("is_spam").select("doc_id").distinct()
