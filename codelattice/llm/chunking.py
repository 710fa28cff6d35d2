"""Splitting oversized items at natural boundaries.

Method: content-defined chunking.  A rolling hash over the characters sets landmarks; each cut is the first landmark past the
minimum size, snapped to the nearest natural boundary between minimum and maximum.  As landmarks depend on nearby characters
only, an edit changes the pieces around it and the cuts fall into step again after it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, picked, sized

#: Smallest piece as a share of the largest; expected distance of landmarks as a share of it; how far a cut may be moved to a boundary.
LEAST, LANDMARKS, REACH = 0.4, 0.15, 0.12
_WINDOW_STEPS = 5  # the hash spans 2**5 characters
#: Natural boundaries, the best first: a cut comes right after the match.
_LEVELS = tuple(re.compile(p) for p in (r"\n[ \t\r]*\n+(?=\S)", r"\n[ \t\r]*\n+", r"\n(?=[^\s)\]}])", r"\r\n?|\n", r"(?<=[.!?;:。！？])\s+", r"\s+"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def landmarks(text: str, every: int) -> np.ndarray:
    """Places whose rolling hash over the 32 characters before them is one of about 1 in ``every``."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    h = h * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for step in range(_WINDOW_STEPS):
        width = 1 << step
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint64(width)
        h = h + shifted
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.flatnonzero((h >> np.uint64(20)) % np.uint64(max(1, every)) == 0) + 1


class _Boundaries:
    def __init__(self, text: str):
        self.levels = [np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64) for p in _LEVELS]

    def nearest(self, at: int, low: int, high: int, reach: int) -> int | None:
        """The nearest boundary of the best level that has one within ``reach`` of ``at`` and in [low, high]."""
        a, b = max(low, at - reach), min(high, at + reach)
        for places in self.levels:
            i, j = np.searchsorted(places, a), np.searchsorted(places, b, side="right")
            if i < j:
                near = places[i:j]
                return int(near[np.argmin(np.abs(near - at))])
        return None


def pieces(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece: it is text[start:end], of which text[own start:end] is not in the piece before.

    No piece is longer than max_chars; without their repeated starts the pieces are the text, whole and in order.  Each piece but the
    first repeats about overlap_chars of what stands before it, a quarter more or less, to start at a natural boundary; an overlap of
    max_chars or more is taken as one less, as a piece must have something new.
    """
    n = len(text)
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    if n <= max_chars:
        return [(0, 0, n)]
    overlap = max(0, min(overlap_chars, max_chars - 1))
    slack = min(overlap, max_chars - overlap) // 4
    room = max_chars - overlap - slack
    least, reach = max(1, int(room * LEAST)), max(1, int(room * REACH))
    marks = landmarks(text, max(2, int(room * LANDMARKS)))
    natural = _Boundaries(text)
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < n:
        most = room if at else max_chars - slack
        if n - at <= most:
            end = n
        else:
            low, high = at + least, at + most
            i = np.searchsorted(marks, low)
            mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
            end = natural.nearest(mark, low, high, reach) or natural.nearest(high, low, high, most) or high
        start = at
        if at and overlap:
            back = natural.nearest(at - overlap, max(0, at - overlap - slack), at - 1, slack)
            start = back if back is not None else at - overlap
        out.append((start, at, end))
        at = end
    return out


_OUT = pa.schema(
    [("field_name", pa.string()), ("item_key", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("own_start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]
)
_DDL = "field_name string, item_key string, piece int, pieces int, start int, own_start int, end int, text string"


def _cut(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _OUT.names}
    for field, key, text, most, overlap in zip(*(rows[n] for n in ("field_name", "item_key", "text", "max_chars", "overlap_chars"))):
        cuts = pieces(text, most, overlap or 0)
        for i, (start, own, end) in enumerate(cuts):
            for column, value in zip(_OUT.names, (field, key, i, len(cuts), start, own, end, text[start:end])):
                out[column].append(value)
    return out


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The items (field_name, item_key, text) that are longer than their field's limit, with max_chars and overlap_chars."""
    limits = picked(limits, "field_name", "max_chars", "overlap_chars").where("max_chars > 0").dropDuplicates(["field_name"])
    return picked(items, "field_name", "item_key", "text").join(sized(limits, "limits"), "field_name").where(F.length("text") > F.col("max_chars"))


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the items (field_name, item_key, text) that are longer than their field's limit, in characters.

    limits is a table of a few fields (field_name, max_chars, overlap_chars); a field without a row there, or with a null
    limit, is not split, nor is null text.  Columns: field_name, item_key, piece (from 0), pieces, start, own_start, end, text;
    the piece is the item's [start, end), of which [own_start, end) is new.  An item that comes twice gives its pieces twice.
    """
    return oversized(items, limits).mapInArrow(batches(_cut, _OUT), _DDL)


def items_of(docs: DataFrame, tree_nodes: DataFrame) -> DataFrame:
    """The code of docs, and code and description of tree_nodes, as (field_name, item_key, text)."""
    docs, tree_nodes = picked(docs, "doc_id", "code"), picked(tree_nodes, "node_key", "graph_node_data")
    code = docs.select(F.lit("docs.code").alias("field_name"), F.col("doc_id").alias("item_key"), F.col("code").alias("text"))
    data = F.col("graph_node_data")
    nodes = tree_nodes.select(
        F.col("node_key").cast("string").alias("item_key"),
        F.explode(F.array(*[F.struct(F.lit(f"tree_nodes.{x}").alias("field_name"), data[x].alias("text")) for x in ("code", "description")])).alias("x"),
    ).select("x.field_name", "item_key", "x.text")
    return code.unionByName(nodes)


def split_all(docs: DataFrame, tree_nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every oversized item of docs and tree_nodes; redelivered docs rows are cut once, as the delivery with the smallest
    text should they differ.  Only the texts of items that come more than once are moved."""
    long = oversized(items_of(docs, tree_nodes), limits)
    key = ["field_name", "item_key"]
    again = sized(long.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "redelivered")
    once = long.join(again, key, "left_anti")
    chosen = long.join(again, key, "left_semi").groupBy(*key, "max_chars", "overlap_chars").agg(F.min("text").alias("text")).select(*once.columns)
    return once.unionByName(chosen).mapInArrow(batches(_cut, _OUT), _DDL)


def found(docs: DataFrame, tree_nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, item_key) of the items that came out in pieces."""
    return split_items(items_of(docs, tree_nodes), limits).where("piece = 1").select("field_name", "item_key").distinct()
