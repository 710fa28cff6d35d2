"""Near-duplicate records with small edits.

Method: exact set-similarity join with set-relation skipping.  Equal sets are answered once.  Index lists hold the rarest part of
each set, sorted by set size and by the place of the entry in its set: for a block of entries of one size and place, the entries of another
size that may match are one stretch of places, and all others are skipped without being looked at.  That part is long enough that similar
sets must meet in several lists, in more the larger they are.  Sets that are highly similar to one are its family: what each lacks of it
and has besides is kept, the overlaps within the family are derived from that, and lists are only searched for pairs across families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import written
from .common import WORD, picked, sized, with_code

SIMILARITY, SHINGLE = 0.7, 3
#: Counters of the shingle frequencies: a power of two near the number of records, between these.  They only decide the order of a set's
#: members and which lists may be long.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 17, 1 << 20
#: For each so many members of a set one more meeting is asked for.
MEETING = 12
#: Longer index lists are worked on in blocks of this many entries.
LIST_BLOCK = 20_000
#: Rows of a table of two or three numbers that may be broadcast.
NARROW_ROWS = 1_000_000
#: Places of the filter that tells which records' texts verification may need, a table of fixed size.
PLACES = 1 << 18
#: Least hashes, two at a time, by which sets are first brought to one that is probably similar; sets of a family paired in a block.
HASHES, FAMILY_BLOCK = 8, 1000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SALTS = (np.arange(1, HASHES + 1, dtype=np.uint64) * _M1 | np.uint64(1))[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(code: str, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``length`` consecutive tokens."""
    tokens = WORD.findall(code)
    n = len(tokens) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = _mixed(total * _M1 + h[i : i + n])
    return np.unique(total)


def _least_overlap(a, b, t: float):
    """Members two sets of sizes a and b must share at similarity t (with a guard against rounding up past it)."""
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9)


def rare_length(size: int, t: float) -> int:
    """Members in the rare part: as many more than one meeting needs as further meetings are asked for, so that two sets with enough in
    common share at least 1 + size // MEETING members of their rare parts, by the smaller set's size."""
    return min(size, size - int(np.ceil(t * size - 1e-9)) + 1 + size // MEETING)


def _counter(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in it:
            every = np.concatenate([np.empty(0, np.uint64), *(shingles(code) for code in batch.column(0).to_pylist())])
            counts += np.bincount((every & np.uint64(width - 1)).astype(np.int64), minlength=width)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["place", "n"])

    return run


def frequencies(rows: DataFrame, records: int) -> np.ndarray:
    """How often members fall on each counter, over all rows (code)."""
    width = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, records - 1).bit_length()))
    table = rows.select("code").mapInArrow(_counter(width), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most a row for a counter
    counts = np.zeros(width, np.int64)
    counts[table.column("place").to_numpy()] = table.column("n").to_numpy()
    return counts


_SETS = pa.schema(
    [("doc_id", pa.string()), ("text", pa.int64()), ("number", pa.int64()), ("size", pa.int32()), ("rare", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))]
)


def _setter(frequency, t: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        mask = np.uint64(len(counts) - 1)
        for batch in it:
            out: list[list] = [[] for _ in _SETS]
            for doc, text, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = shingles(code)
                n = len(s)
                if not n:
                    continue
                order = np.argsort(counts[(s & mask).astype(np.int64)], kind="stable")
                least = (s * _SALTS).min(axis=1)  # members are mixed already, so products order them anew
                for column, value in zip(out, (doc, text, _number(s), n, s[order[: rare_length(n, t)]].view(np.int64), least.view(np.int64))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SETS)], schema=_SETS)

    return run


_POSTINGS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("class", pa.int64())])


def _poster(frequency=None, hot: int = 0):
    """Postings of the rare members of rows (id, size, rare, class); with ``hot`` the keys only, of lists that may be longer."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value if frequency is not None else None
        for batch in it:
            lists = batch.column(2)
            lengths = np.diff(np.asarray(lists.offsets))
            member = np.asarray(lists.flatten())
            if counts is not None:
                member = member[counts[(member.view(np.uint64) & np.uint64(len(counts) - 1)).astype(np.int64)] > hot]
                yield pa.RecordBatch.from_arrays([pa.array(member)], names=["key"])
                continue
            repeated = [np.repeat(np.asarray(batch.column(i)), lengths) for i in (0, 1, 3)]
            places = (np.arange(len(member)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            columns = [member, repeated[0], repeated[1].astype(np.int32), places, repeated[2]]
            for first in range(0, len(member), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[first : first + 50_000]) for c in columns], schema=_POSTINGS)

    return run


_MET = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("size_a", pa.int32()), ("size_b", pa.int32()), ("place_a", pa.int32()), ("place_b", pa.int32()), ("met", pa.int32())])
_MET_DDL = "id_a bigint, id_b bigint, size_a int, size_b int, place_a int, place_b int, met int"


def list_pairs(key, ids, size, place, side, classes, t: float, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """Pairs of sets that meet in a list and may be similar: columns id, id, size, size, place, place, ids in order.

    Entries of a list are sorted by size and place.  For a block of entries of size a at place i and another size b, what may still match
    stands from i - (a - need) to i + (b - need), where need is the overlap they must have; only that stretch is looked at.  Pairs of one
    class (0 is none) are not wanted: of each list the entries of its largest class are only looked at beside others, so that a list of
    one class is skipped as a whole.
    """
    order = np.lexsort((place, size, key))
    key, ids, size, place, side, classes = (x[order] for x in (key, ids, size, place, side, classes))
    n = len(key)
    if not n:
        return
    new_list = np.r_[True, key[1:] != key[:-1]]
    new_size = new_list | np.r_[True, size[1:] != size[:-1]]
    new_block = new_size | np.r_[True, place[1:] != place[:-1]]
    group = np.cumsum(new_size) - 1  # a size within a list
    starts = np.flatnonzero(new_size)
    list_of = np.cumsum(new_list)[starts]
    sizes = size[starts].astype(np.int64)
    span = np.int64(place.max()) + 1
    code = group * span + place  # ascending
    block_of = np.cumsum(new_block)
    major = _largest_class(np.cumsum(new_list) - 1, classes) if classes.any() else np.zeros(n, bool)
    entries = np.flatnonzero(~major)
    for step in (1, -1) if major.any() else (1,):
        x, distance = entries, 0 if step > 0 else -1
        while len(x):
            own = group[x]
            other = own + distance
            ok = (other >= 0) & (other < len(starts))
            x, own, other = x[ok], own[ok], other[ok]
            small, large = (own, other) if step > 0 else (other, own)
            ok = (list_of[own] == list_of[other]) & (sizes[small] >= t * sizes[large] - 1e-9)
            x, own, other = x[ok], own[ok], other[ok]
            if not len(x):
                break
            # the stretch is the same for all of a block
            block = np.flatnonzero(np.r_[True, block_of[x[1:]] != block_of[x[:-1]]])
            a, b, i = sizes[own[block]], sizes[other[block]], place[x[block]].astype(np.int64)
            need = _least_overlap(a.astype(np.float64), b, t).astype(np.int64)
            low = np.searchsorted(code, other[block] * span + np.clip(i - (a - need), 0, span - 1))
            high = np.searchsorted(code, other[block] * span + np.clip(i + (b - need), 0, span - 1), side="right")
            count = np.diff(np.r_[block, len(x)])
            low, high = np.repeat(low, count), np.repeat(high, count)
            if not distance and not major.any():
                low = np.maximum(low, x + 1)
            length = np.maximum(high - low, 0)
            for f in range(0, len(x), max(1, most // 64)):
                part = slice(f, f + max(1, most // 64))
                yield from _fits(x[part], low[part], length[part], (ids, size, place, side, classes, major), distance, most)
            distance += step


def _largest_class(lists: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether each entry is of the class that most entries of its list are of."""
    order = np.lexsort((classes, lists))
    a, c = lists[order], classes[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    length = np.diff(np.r_[starts, len(a)])
    by = np.lexsort((length, a[starts]))  # the last of a list is its longest run
    last = by[np.r_[a[starts][by][1:] != a[starts][by][:-1], True]]
    best = np.zeros(int(a[-1]) + 1, classes.dtype)
    best[a[starts][last]] = c[starts][last]
    return classes == best[lists]


def _fits(entry, low, length, columns: tuple, distance: int, most: int) -> Iterator[np.ndarray]:
    ids, size, place, side, classes, major = columns
    total = np.cumsum(length)
    at = 0
    while at < len(entry):
        begun = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, begun + most, side="right")))
        n = length[at:to]
        x = np.repeat(entry[at:to], n)
        y = np.repeat(low[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to
        fit = ((side[x] == 0) | (side[x] != side[y])) & (ids[x] != ids[y]) & ((classes[x] != classes[y]) | (classes[x] == 0))
        if distance <= 0:  # each pair once: entries beside the largest class, and others that come later
            fit &= major[y] | (y > x)
        x, y = x[fit], y[fit]
        if len(x):
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield np.stack([ids[x], ids[y], size[x], size[y], place[x], place[y]], axis=1)


def _summed(found: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    met = np.diff(np.r_[starts, len(rows)])
    last = [np.maximum.reduceat(rows[:, i], starts) for i in (4, 5)]
    columns = [*(rows[starts, i] for i in range(4)), *last, met]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _MET)], schema=_MET)


def _matcher(t: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for pairs in list_pairs(*(np.concatenate(x) for x in zip(*parts)), t):
                found.append(pairs)
                n += len(pairs)
                if n > 1_000_000:
                    yield _summed(found)
                    found, n = [], 0
            if found:
                yield _summed(found)

        # Rows come sorted by key, so that a list is never cut; lists are worked on a few hundred thousand entries at a time.
        for batch in it:
            columns = [np.asarray(batch.column(i)) for i in range(6)]
            key = columns[0]
            if rows > 400_000 and len(key):
                last = held[-1][0][-1]
                cut = int(np.searchsorted(key, last, side="right"))
                held.append(tuple(c[:cut] for c in columns))
                if cut < len(key):
                    yield from flush(held)
                    held, rows = [tuple(c[cut:] for c in columns)], len(key) - cut
                else:
                    rows += cut
            else:
                held.append(tuple(columns))
                rows += len(key)
        if held:
            yield from flush(held)

    return run


def _number(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Records:
    """The sets of a table of records, written once: (id, doc_id, text, number, size, rare, least), id being the row's own number.

    Records without code, without doc_id or with fewer than three tokens have none.  ``first`` gives of each number of a set that several rows
    have the smallest id, ``each`` one row for a set.  least has the least of several hashes of the members.
    """

    def __init__(self, docs: DataFrame, similarity: float):
        spark = docs.sparkSession
        self.similarity = similarity
        self.rows = with_code(picked(docs, "doc_id", "code")).where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("code").alias("text"), "code")
        counts = frequencies(self.rows, docs.count())
        self.frequency, self.long = spark.sparkContext.broadcast(counts), bool(counts.max(initial=0) > LIST_BLOCK)
        made = self.rows.mapInArrow(_setter(self.frequency, similarity), "doc_id string, text bigint, number bigint, size int, rare array<bigint>, least array<bigint>")
        self.sets = written(made.withColumn("id", F.monotonically_increasing_id()), "sets")
        again = self.sets.groupBy("number").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("number", "first")
        self.again = sized(again, "again", NARROW_ROWS)
        self.each = self.sets.join(self.again, "number", "left").where("first IS NULL OR first = id").drop("first")

    def members(self) -> DataFrame:
        """(doc_id, text, id): each record with the id of its set; a doc_id delivered more than once counts once, with its smallest set and
        text should the deliveries differ."""
        placed = self.sets.select("doc_id", "text", "id", "number").join(self.again, "number", "left").select("doc_id", "text", F.coalesce("first", "id").alias("id"))
        return placed.groupBy("doc_id").agg(F.min(F.struct("id", "text")).alias("x")).select("doc_id", "x.text", "x.id")

    def candidates(self, classes: DataFrame | None = None) -> DataFrame:
        """(id_a, id_b, size_a, size_b), id_a < id_b: all pairs of different sets that may be similar, and some that are not; with
        classes(id, class) only such of different classes."""
        rows = self.each.select("id", "size", "rare")
        rows = rows.withColumn("class", F.lit(0).cast("bigint")) if classes is None else rows.join(classes, "id", "left").withColumn("class", F.coalesce("class", -F.col("id") - 1))
        posted = rows.mapInArrow(_poster(), "key bigint, id bigint, size int, place int, class bigint").withColumn("side", F.lit(0))
        if self.long:
            keys = rows.mapInArrow(_poster(self.frequency, LIST_BLOCK), "key bigint")
            hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST_BLOCK).select("key", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))
            posted = self._cut(posted, sized(hot, "hot", NARROW_ROWS))
        met = posted.select("key", "id", "size", "place", "side", "class").repartition("key").sortWithinPartitions("key").mapInArrow(_matcher(self.similarity), _MET_DDL)
        met = met.groupBy("id_a", "id_b", "size_a", "size_b").agg(F.sum("met").alias("met"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"))
        least = 1 + F.floor(F.least("size_a", "size_b") / MEETING)
        need = F.ceil((F.col("size_a") + F.col("size_b")) * (self.similarity / (1 + self.similarity)) - 1e-9)
        # After the last member they met in, no more can be common than either has left.
        most = F.col("met") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
        return met.where((F.col("met") >= least) & (most >= need)).select("id_a", "id_b", "size_a", "size_b")

    @staticmethod
    def _cut(posted: DataFrame, hot: DataFrame) -> DataFrame:
        """Long lists in blocks by a hash of the set: each pair of blocks is a list of its own, where only entries of different sides
        (side 0: any) are compared."""
        rows = posted.drop("side").join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("other") > F.col("own"), 1).otherwise(2)
        return rows.select(key.alias("key"), "id", "size", "place", "class", side.alias("side"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, code) of the sets of ids(id), each once."""
        # A filter of fixed size keeps most other texts from being moved.
        wanted = sized(self.each.select("id", "doc_id", "text").join(ids, "id", "left_semi"), "wanted")
        place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int")
        places = F.broadcast(wanted.select(place.alias("place")).distinct())
        some = self.rows.withColumn("place", place).join(places, "place", "left_semi").select("doc_id", "text", "code")
        return some.join(wanted, ["doc_id", "text"]).select("id", "code").dropDuplicates(["id"])

    def _similar(self, pairs: DataFrame) -> DataFrame:
        """(id_a, id_b, shared, either) of the pairs (id_a, id_b, size_a, size_b, shared) that are similar enough."""
        either = F.col("size_a") + F.col("size_b") - F.col("shared")
        return pairs.withColumn("either", either).where(F.col("shared") >= self.similarity * F.col("either") - 1e-9).select("id_a", "id_b", "shared", "either")

    def families(self) -> DataFrame:
        """(id, size, head, head_size, shared, plus, minus), written: sets that are similar to their head, a set that has none itself, with
        what they have besides its members and lack of them.  Each set is compared with one other at most, so this is linear."""
        band = lambda i: F.xxhash64(F.col("least")[i], F.col("least")[i + 1])
        hashed = self.each.select("id", "size", F.posexplode(F.array(*(band(i) for i in range(0, HASHES, 2)))).alias("at", "hash"))
        first = hashed.groupBy("at", "hash").agg(F.min(F.struct("id", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        placed = hashed.join(first, ["at", "hash"]).groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.id").alias("head"), F.col("first.size").alias("head_size"))
        placed = written(placed, "placed")
        roots = placed.where("id = head").select("head")
        wanted = written(placed.where("id > head").join(roots, "head", "left_semi"), "wanted")
        texts = written(self.texts(wanted.select("id").unionByName(wanted.select(F.col("head").alias("id"))).distinct()), "texts")
        heads = texts.select(F.col("id").alias("head"), F.col("code").alias("head_code"))
        told = texts.join(wanted, "id").join(heads, "head").select("id", "code", "head", "head_code", "head_size")
        told = told.mapInArrow(_differ, "id bigint, size int, head bigint, shared int, plus array<bigint>, minus array<bigint>, head_size int")
        return written(told.where(F.col("plus").isNotNull() & (F.col("shared") >= self.similarity * (F.col("size") + F.col("head_size") - F.col("shared")) - 1e-9)), "families")

    @staticmethod
    def family_classes(families: DataFrame) -> DataFrame:
        """(id, class) of all sets that are in a family."""
        both = families.select("id", (F.col("head") + 1).alias("class")).unionByName(families.select(F.col("head").alias("id"), (F.col("head") + 1).alias("class")).distinct())
        return sized(both, "classes", NARROW_ROWS)

    def within(self, families: DataFrame) -> DataFrame:
        """(id_a, id_b, shared, either) of the similar pairs within families, the heads included.  A large family is paired block by block."""
        direct = families.select(F.col("head").alias("id_a"), F.col("id").alias("id_b"), F.col("head_size").alias("size_a"), F.col("size").alias("size_b"), "shared")
        many = families.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head", F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("blocks"))
        rows = families.join(sized(many, "many", NARROW_ROWS), "head").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "plus", "minus")]
        left = rows.where("own = low").select("head", "head_size", "low", "high", *side("a"))
        right = rows.where("own = high").select("head", "low", "high", *side("b"))
        pairs = left.join(right, ["head", "low", "high"]).where("low < high OR id_a < id_b")
        lacking = F.size("minus_a") + F.size("minus_b") - F.size(F.array_intersect("minus_a", "minus_b"))
        pairs = pairs.withColumn("shared", F.col("head_size") - lacking + F.size(F.array_intersect("plus_a", "plus_b")))
        swap = F.col("id_a") > F.col("id_b")
        ordered = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c)).alias(c)
        pairs = pairs.select(ordered("id_a", "id_b"), ordered("id_b", "id_a"), ordered("size_a", "size_b"), ordered("size_b", "size_a"), "shared")
        return self._similar(direct.unionByName(pairs))

    def links(self, candidates: DataFrame) -> DataFrame:
        """(id_a, id_b, shared, either) of the candidates that are similar."""
        candidates = written(candidates.select("id_a", "id_b", "size_a", "size_b"), "candidates")
        met = candidates.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("other")))).alias("x")).select("x.*")
        nearest = written(met.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("head")), "heads")
        texts = written(self.texts(nearest.select("id")), "texts")
        heads = texts.join(nearest.where("head < id").select(F.col("head").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("head"), F.col("code").alias("head_code"))
        told = texts.join(nearest.where("id <> head"), "id").join(heads, "head").select("id", "code", "head", "head_code", F.lit(0).alias("head_size"))
        told = written(told.mapInArrow(_differ, "id bigint, size int, head bigint, shared int, plus array<bigint>, minus array<bigint>, head_size int"), "differences")
        pairs = candidates.join(told.select(F.col("id").alias("id_b"), F.col("head").alias("id_a"), "shared"), ["id_a", "id_b"], "left")
        direct = pairs.where("shared IS NOT NULL").select("id_a", "id_b", "size_a", "size_b", "shared")
        rest = written(pairs.where("shared IS NULL").select("id_a", "id_b", "size_a", "size_b"), "rest")
        # Of the other pairs those whose sets were compared with the same one, from the differences alone.
        side = lambda s: told.where("plus IS NOT NULL").select(F.col("id").alias(f"id_{s}"), F.col("head").alias(f"head_{s}"), F.col("plus").alias(f"plus_{s}"), F.col("minus").alias(f"minus_{s}"))
        both = rest.join(side("a"), "id_a").join(side("b"), "id_b").where("head_a = head_b")
        size = F.col("size_a") - F.size("plus_a") + F.size("minus_a")  # of the set both were compared with
        lacking = F.size("minus_a") + F.size("minus_b") - F.size(F.array_intersect("minus_a", "minus_b"))
        derived = both.select("id_a", "id_b", "size_a", "size_b", (size - lacking + F.size(F.array_intersect("plus_a", "plus_b"))).alias("shared"))
        derived = written(derived, "derived")
        # What is left is compared by its texts.
        left = rest.join(derived.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
        code = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("code").alias(f"code_{s}"))
        compared = left.join(code("a"), "id_a").join(code("b"), "id_b").select("id_a", "id_b", "size_a", "size_b", "code_a", "code_b")
        compared = compared.mapInArrow(_comparer, "id_a bigint, id_b bigint, size_a int, size_b int, shared int")
        return self._similar(direct.unionByName(derived).unionByName(compared))


_DIFFERENCES = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("head", pa.int64()), ("shared", pa.int32()), ("plus", pa.list_(pa.int64())), ("minus", pa.list_(pa.int64())), ("head_size", pa.int32())])


def _differ(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the sets share with the one they are compared with, and, where that is most of it, what they have besides and lack."""
    head, base = None, np.empty(0, np.uint64)
    for batch in it:
        out: list[list] = [[] for _ in _DIFFERENCES]
        for i, code, h, head_code, size in zip(*(batch.column(x).to_pylist() for x in range(5))):
            if h != head:
                head, base = h, shingles(head_code)
            s = shingles(code)
            shared = len(np.intersect1d(s, base, assume_unique=True))
            alike = 2 * shared >= len(base)
            plus, minus = (np.setdiff1d(x, y, assume_unique=True).view(np.int64) if alike else None for x, y in ((s, base), (base, s)))
            for column, value in zip(out, (i, len(s), h, shared, plus, minus, size)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _DIFFERENCES)], schema=_DIFFERENCES)


#: Sets a task keeps, as a set has often several pairs.
KEPT = 2000


def _comparer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}

    def members(i: int, code: str) -> np.ndarray:
        if i not in kept:
            if len(kept) >= KEPT:
                kept.pop(next(iter(kept)))
            kept[i] = shingles(code)
        return kept[i]

    for batch in it:
        shared = [len(np.intersect1d(members(a, x), members(b, y), assume_unique=True)) for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(shared, pa.int32())], names=["id_a", "id_b", "size_a", "size_b", "shared"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity), doc_id_a < doc_id_b: records at least so similar, exactly.

    Each record is paired with the first record of every text that is similar to its own, its own included.  So different texts come out as
    all their pairs, also where their triples are equal, and exact copies of a text are not paired out among each other or with the copies
    of another one, however few or many they are; ``copies`` tells for whom a first record stands.
    Records without code, without doc_id or with fewer than three tokens are not paired; a doc_id delivered twice counts once.
    """
    records = Records(docs, similarity)
    members = written(records.members(), "members")
    families = records.families()
    across = records.links(records.candidates(records.family_classes(families)))
    links = written(records.within(families).unionByName(across), "links")
    texts = members.groupBy("id", "text").agg(F.min("doc_id").alias("head"))
    own = members.join(texts, "id").select(F.col("doc_id").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("similarity"))
    linked = links.select("id_a", "id_b", (F.col("shared") / F.col("either")).alias("similarity"))
    linked = linked.unionByName(linked.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "similarity"))
    heads = linked.join(texts.select(F.col("id").alias("id_b"), F.col("head").alias("b")), "id_b").select(F.col("id_a").alias("id"), "b", "similarity")
    out = members.select("id", F.col("doc_id").alias("a")).join(heads, "id").select("a", "b", "similarity").unionByName(own)
    return out.where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), "similarity").distinct()


def _copies(members: DataFrame) -> DataFrame:
    """The members with the number n of records with the same code, and the first of them (head)."""
    return members.join(members.groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("head")), ["id", "text"])


def _has_set() -> Column:
    return F.size(F.regexp_extract_all("code", F.lit(r"([A-Za-z0-9_]+)"), 1)) >= SHINGLE


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, copies): for each record with token triples the first record with the same code, and how many have it."""
    rows = with_code(picked(docs, "doc_id", "code")).where(F.col("doc_id").isNotNull()).where(_has_set())
    members = rows.select("doc_id", F.xxhash64("code").alias("text")).groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("id", F.lit(0))
    return _copies(written(members, "members")).select("doc_id", F.col("head").alias("first_doc_id"), F.col("n").alias("copies"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, members): one row per record; class_id is the first doc_id of the records it is connected to by similarity,
    members how many they are.

    Families are found first, which is linear; only sets that this leaves in different classes are then searched for as pairs, so that a
    large family is never paired out.
    """
    records = Records(docs, similarity)
    families = records.families()
    more = written(records.links(records.candidates(records.family_classes(families))), "more")
    number = components(families.select(F.col("head").alias("id_a"), F.col("id").alias("id_b")).unionByName(more.select("id_a", "id_b")), "id_a", "id_b")
    joined = written(records.members().join(number.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")), "joined")
    names = joined.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return joined.join(names, "component").select("doc_id", "class_id", "members")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id_a", "doc_id_b")
