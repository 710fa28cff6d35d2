"""Most similar vectors for every vector.

Method: additive quantisation.  Full-dimensional codebooks are fitted to residuals one after another; a beam search encodes each
vector as a sum of one codeword of each, and the norm of that sum is stored.  The first codes name cells of a few hundred vectors;
a vector is searched for in the cells of the beam's best sums.  There, lookup tables of query-codeword products score the stored codes
of all the cell's vectors, and the best of them are reranked with the exact vectors.  How many cells are searched is chosen by how many
neighbours that reaches for some vectors; where no number of them reaches enough, and for vectors that see too few others, the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import threads, written
from .common import picked, sized

NEIGHBOURS, DIMENSION = 5, 64
#: Codebooks behind those that name cells, codewords of each, beam width; vectors the codebooks are fitted on (chosen by a hash of the
#: key), rounds of fitting.
BOOKS, WORDS, BEAM, SAMPLE, ROUNDS = 8, 256, 8, 16384, 6
#: Vectors for a cell to aim at; codewords a single codebook may have to name cells; candidates of a cell reranked.
CELL, CELL_WORDS, RERANK = 512, 1024, 96
#: A cell with more base vectors, or more vectors searched for, is worked on in pairs of blocks of these sizes.
CELL_BLOCK, QUERY_BLOCK = 4096, 16384
#: Numbers of cells a vector may be searched in; share of the neighbours of ASKED vectors that must lie in them; vectors in a block of the
#: exact search.
PROBES, REACH, ASKED, EXACT_BLOCK = (4, 6, 8, 12, 16, 24, 32, 48, 64), 0.985, 256, 16384


def fit(sample: np.ndarray, sizes: list[int], rounds: int = ROUNDS, seed: int = 0) -> list[np.ndarray]:
    """Codebooks (words, dimension) of the given sizes, each by k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    out = []
    for words in sizes:
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            nearest = np.argmax(rest @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres), axis=1)
            counts = np.bincount(nearest, minlength=words)
            order = np.argsort(nearest, kind="stable")
            starts = np.searchsorted(nearest[order], np.arange(words))
            used = counts > 0
            sums = np.add.reduceat(rest[order], np.minimum(starts, len(rest) - 1), axis=0)
            centres[used] = sums[used] / counts[used, None]
            if (~used).any():
                centres[~used] = rest[rng.choice(len(rest), int((~used).sum()))]
        out.append(centres)
        nearest = np.argmax(rest @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres), axis=1)
        rest -= centres[nearest]
    return out


class Coder:
    """Codebooks, of which the first ``depth`` name cells, with the products of their codewords."""

    def __init__(self, books: list[np.ndarray], depth: int):
        self.books, self.depth = books, depth
        self.flat = np.concatenate(books)
        self.starts = np.cumsum([0, *(len(b) for b in books)])
        self.squares = np.einsum("ij,ij->i", self.flat, self.flat)
        # twice the products of all earlier codewords with those of each codebook
        self.products = [2 * (self.flat[: self.starts[b]] @ book.T) for b, book in enumerate(books)]

    def encode(self, vectors: np.ndarray, probes: int = 1, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, norms of the sums, cells): beam search over the codebooks; cells are the numbers of the ``probes`` best sums of the first
        codebooks, best first, -1 where there are fewer."""
        n = len(vectors)
        products = 2 * (vectors @ self.flat.T)
        # error of a sum s for a vector x, without |x|²: |s|² - 2 x·s
        codes = np.zeros((n, 1, 0), np.int64)
        errors = np.zeros((n, 1), np.float32)
        cells = np.full((n, probes), -1, np.int64)
        rows = np.arange(n)[:, None]
        for b, book in enumerate(self.books):
            span, words = slice(self.starts[b], self.starts[b + 1]), len(book)
            grown = errors[:, :, None] + (self.squares[span] - products[:, span])[:, None, :]
            for j in range(codes.shape[2]):
                grown += self.products[b][self.starts[j] + codes[:, :, j]]
            grown = grown.reshape(n, -1)
            width = min(max(beam, probes) if b < self.depth else beam, grown.shape[1])
            best = np.argpartition(grown, width - 1, axis=1)[:, :width] if width < grown.shape[1] else np.broadcast_to(np.arange(width), grown.shape)
            value = grown[rows, best]
            order = np.argsort(value, axis=1, kind="stable")
            best, errors = best[rows, order], value[rows, order]
            codes = np.concatenate([codes[rows, best // words], (best % words)[:, :, None]], axis=2)
            if b + 1 == self.depth:
                number = np.zeros(codes.shape[:2], np.int64)
                for j in range(self.depth):
                    number = number * len(self.books[j]) + codes[:, :, j]
                some = min(probes, number.shape[1])
                cells[:, :some] = number[:, :some]
                codes, errors = codes[:, :beam], errors[:, :beam]
        top = codes[:, 0, :]
        total = self.flat[self.starts[:-1] + top].sum(axis=1)
        return top.astype(np.uint16), np.linalg.norm(total, axis=1).astype(np.float32), cells


def _vectors(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(rows, -1)


_UNITS = pa.schema([("node_key", pa.int64()), ("same", pa.string()), ("vector", pa.binary())])


def _units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
        unit = [x.tobytes() for x in (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_hexdigest(x) for x in unit]), pa.array(unit, pa.binary())], schema=_UNITS)


def _sifter(asked, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads()
        keys, points = asked.value
        best = np.full((len(keys), k), -np.inf)
        found = np.full((len(keys), k, points.shape[1]), 0, np.float32)
        for batch in it:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                unit = _vectors(part.column(1), part.num_rows)
                cosine = (points @ unit.T).astype(np.float64)
                cosine[keys[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                for i in np.flatnonzero(cosine.max(axis=1) > best[:, -1]):
                    value = np.concatenate([best[i], cosine[i]])
                    top = np.argsort(-value, kind="stable")[:k]
                    found[i] = [found[i, j] if j < k else unit[j - k] for j in top]
                    best[i] = value[top]
        row, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(best[row, place]), pa.array([found[i, j].tobytes() for i, j in zip(row, place)], pa.binary())], schema=_SIFTED)

    return run


_SIFTED = pa.schema([("a", pa.int64()), ("cosine", pa.float64()), ("vector", pa.binary())])


def reach(units: DataFrame, keys: np.ndarray, points: np.ndarray, coder: Coder, k: int) -> int | None:
    """The first of the numbers PROBES of cells that hold at least the share REACH of the k nearest of all vectors, for ASKED of
    the points; None if none does.  The nearest are found by one pass over all vectors."""
    some = np.arange(len(points))[:: -(-len(points) // ASKED)]
    keys, points = keys[some], points[some]
    best = Window.partitionBy("a").orderBy(F.desc("cosine"))
    sifted = units.select("node_key", "vector").mapInArrow(_sifter(units.sparkSession.sparkContext.broadcast((keys, points)), k), "a bigint, cosine double, vector binary")
    near = sifted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("a", "vector").collect()  # at most ASKED * k rows
    if not near:
        return PROBES[0]
    home = coder.encode(np.array([np.frombuffer(r["vector"], np.float32) for r in near]))[2][:, 0]
    cells = dict(zip(keys.tolist(), coder.encode(points, PROBES[-1])[2]))
    place = np.array([int(np.flatnonzero(cells[r["a"]] == h)[0]) if (cells[r["a"]] == h).any() else PROBES[-1] for r, h in zip(near, home)])
    return next((p for p in PROBES if np.mean(place < p) >= REACH), None)


_ENCODED = pa.schema([("node_key", pa.int64()), ("codes", pa.binary()), ("norm", pa.float32()), ("vector", pa.binary()), ("cells", pa.list_(pa.int64()))])


def _encoder(shared, probes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads()
        coder = Coder(*shared.value)
        for batch in it:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                codes, norms, cells = coder.encode(_vectors(part.column(1), part.num_rows), probes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), part.column(1), pa.array([row[row >= 0] for row in cells], pa.list_(pa.int64()))], schema=_ENCODED
                )

    return run


_HITS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


def nearest_in_cell(asked: tuple, base: tuple, books: list[np.ndarray], k: int, rerank: int = RERANK) -> tuple | None:
    """For each asked (keys, vectors) its k nearest of the base (keys, vectors, codes, norms), itself left out: lookup-table scores of all
    of the base, then exact ones of the best; all that tie with the last of the k come as well, up to so many again."""
    (keys, vectors), (bk, bv, codes, norms) = asked, base
    if not len(bk) or not len(keys):
        return None
    starts = np.cumsum([0, *(len(b) for b in books)])
    flat = np.concatenate(books).T
    at = starts[:-1] + codes.astype(np.int64)
    out = []
    for first in range(0, len(keys), 512):
        q, qk = vectors[first : first + 512], keys[first : first + 512]
        if len(bk) > rerank:
            tables = q @ flat
            score = tables[:, at[:, 0]]
            for b in range(1, len(books)):
                score += tables[:, at[:, b]]
            score /= np.maximum(norms, 1e-6)
            score[qk[:, None] == bk[None, :]] = -np.inf
            pick = np.argpartition(score, len(bk) - rerank, axis=1)[:, -rerank:]
            exact = np.matmul(bv[pick], q[:, :, None])[:, :, 0].astype(np.float64)
        else:
            pick = np.broadcast_to(np.arange(len(bk)), (len(q), len(bk)))
            exact = (q @ bv.T).astype(np.float64)
        exact[bk[pick] == qk[:, None]] = -np.inf
        width = min(k, exact.shape[1])
        top = np.argsort(-exact, axis=1, kind="stable")[:, : 2 * width]
        rows = np.arange(len(q))[:, None]
        value = exact[rows, top]
        ok = np.isfinite(value) & (value >= value[:, width - 1 : width] - 1e-6)
        # the exact cosines of what is kept, in double precision
        row, column = np.nonzero(ok)
        other = pick[row, top[row, column]]
        cosine = np.einsum("ij,ij->i", q[row].astype(np.float64), bv[other].astype(np.float64))
        out.append((qk[row], bk[other], cosine))
    return tuple(np.concatenate(x) for x in zip(*out))


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (cell, block) after the other; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        cell, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and (cell[a], block[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = (cell[a], block[a])
    if held:
        yield pa.Table.from_batches(held)


def _searcher(shared, k: int):
    """``shared`` is None for the exact search, where all of the base counts as best."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads()
        books = shared.value[0] if shared else [np.zeros((1, 1), np.float32)]
        ready: list[tuple] = []
        for t in _groups(it):
            keys, vectors = t.column("node_key").to_numpy(), _vectors(t.column("vector"), t.num_rows)
            base, asks = (t.column(x).to_numpy(zero_copy_only=False) for x in ("is_base", "asks"))
            if shared:
                codes = np.frombuffer(b"".join(t.column("codes").filter(pa.array(base)).to_pylist()), np.uint16).reshape(int(base.sum()), -1)
                hit = nearest_in_cell((keys[asks], vectors[asks]), (keys[base], vectors[base], codes, t.column("norm").to_numpy()[base]), books, k)
            else:
                hit = nearest_in_cell((keys[asks], vectors[asks]), (keys[base], vectors[base], np.zeros((int(base.sum()), 1)), np.ones(int(base.sum()))), books, k, rerank=1 << 62)
            if hit is not None and len(hit[0]):
                ready.append(hit)
            if sum(len(r[0]) for r in ready) > 20_000:
                yield _hits(ready)
                ready = []
        if ready:
            yield _hits(ready)

    return run


def _hits(ready: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*ready), _HITS)], schema=_HITS)


def _spread(n: int | F.Column, salt: int) -> F.Column:
    return F.pmod(F.xxhash64("node_key", F.lit(salt)), n if isinstance(n, F.Column) else F.lit(n)).cast("int")


def _each(n: int | F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0), (n if isinstance(n, F.Column) else F.lit(n)) - 1))


def exactly(asking: DataFrame, units: DataFrame, total: int, k: int) -> DataFrame:
    """(a, b, cosine): for each of ``asking`` its k nearest of ``units`` (both node_key, vector), and possibly more, by comparing blocks."""
    left, right = (max(1, -(-n // EXACT_BLOCK)) for n in (asking.count(), total))
    columns = lambda base: ["cell", "block", "node_key", "vector", F.lit(base).alias("is_base"), F.lit(not base).alias("asks")]
    asked = asking.select(_spread(left, 1).alias("cell"), "node_key", "vector").select("cell", _each(right).alias("block"), "node_key", "vector").select(*columns(False))
    base = units.select(_spread(right, 2).alias("block"), "node_key", "vector").select(_each(left).alias("cell"), "block", "node_key", "vector").select(*columns(True))
    return asked.unionByName(base).repartition(left * right, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_searcher(None, k), "a bigint, b bigint, cosine double")


def in_cells(encoded: DataFrame, shared, k: int) -> DataFrame:
    """(a, b, cosine): for each vector its k nearest, and possibly more, of each cell it is searched in.

    A vector is base of its first cell and asks in all of its cells.  Cells that are too full are worked on as a grid: blocks of base
    vectors against blocks of asking ones, each pair a group of its own, so that no group outgrows a block of each.
    """
    placed = encoded.select("node_key", "codes", "norm", "vector", F.posexplode("cells").alias("rank", "cell"))
    full = encoded.select(F.posexplode("cells").alias("rank", "cell")).groupBy("cell").agg(F.count_if(F.col("rank") == 0).alias("base"), F.count(F.lit(1)).alias("asking"))
    full = full.where((F.col("base") > CELL_BLOCK) | (F.col("asking") > QUERY_BLOCK))
    full = sized(full.select("cell", F.greatest(F.ceil(F.col("base") / CELL_BLOCK), F.lit(1)).cast("int").alias("bases"), F.ceil(F.col("asking") / QUERY_BLOCK).cast("int").alias("askers")), "full")
    placed = placed.join(full, "cell", "left")
    is_base = F.col("rank") == 0
    none = lambda c: F.when(is_base, F.col(c)).alias(c)
    plain = placed.where("bases IS NULL").select("cell", F.lit(0).alias("block"), "node_key", none("codes"), none("norm"), "vector", is_base.alias("is_base"), F.lit(True).alias("asks"))
    grid = placed.where("bases IS NOT NULL").withColumn("b", _spread(F.col("bases"), 3)).withColumn("q", _spread(F.col("askers"), 4))
    base = grid.where(is_base).withColumn("q", _each(F.col("askers"))).select("cell", (F.col("b") * F.col("askers") + F.col("q")).alias("block"), "node_key", "codes", "norm", "vector", F.lit(True).alias("is_base"), F.lit(False).alias("asks"))
    asking = grid.withColumn("b", _each(F.col("bases"))).select(
        "cell", (F.col("b") * F.col("askers") + F.col("q")).alias("block"), "node_key", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"), "vector", F.lit(False).alias("is_base"), F.lit(True).alias("asks")
    )
    rows = plain.unionByName(base).unionByName(asking)
    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_searcher(shared, k), "a bigint, b bigint, cosine double")


def usable(nodes: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(node_key, vector) of the nodes with a key whose embedding has ``dimension`` values, all finite and not all zero."""
    nodes = picked(nodes, "node_key", "graph_node_data")
    e = F.col("graph_node_data")["embedding"]
    fine = (F.size(e) == dimension) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return nodes.where(F.col("node_key").isNotNull() & e.isNotNull()).where(fine).select("node_key", e.alias("vector"))


def _books(total: int, points: int) -> tuple[int, list[int]]:
    """How many codebooks name cells, and the sizes of all."""
    cells = max(1, round(total / CELL))
    depth = next(d for d in range(1, 9) if cells <= CELL_WORDS**d)
    first = min(max(1, int(np.ceil(cells ** (1 / depth) - 1e-9))), points)
    return depth, [first] * depth + [min(WORDS, max(2, points // 16))] * BOOKS


def nearest(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, cosine): for each of the vectors (node_key, vector) its k nearest others by cosine.

    Every vector is indexed and searched for; the codebooks alone are fitted on a bounded sample.  Keys that come twice count
    once, with the first of their vectors in order.  Among equal cosines the smaller key is nearer.  Of more than k + 1 equal vectors all
    have the smallest keys among them as neighbours, which needs no search.  The search is approximate, exact where no cells would reach
    enough neighbours and for vectors that see fewer than k others: see the README for its measured recall.
    """
    threads()
    spark = vectors.sparkSession
    units = written(vectors.select("node_key", "vector").mapInArrow(_units, "node_key bigint, same string, vector binary"), "units")
    again = sized(units.groupBy("node_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_key"), "again")
    if not again.isEmpty():
        one = units.join(again, "node_key", "left_semi").groupBy("node_key").agg(F.min(F.struct("same", "vector")).alias("x")).select("node_key", "x.same", "x.vector")
        units = written(units.join(again, "node_key", "left_anti").unionByName(one), "units")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("a", "b", "cosine")
    # Large groups of equal vectors: the k + 1 smallest keys stand for all.
    many = sized(units.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("same"), "many")
    copies = None
    if not many.isEmpty():
        members = units.select("node_key", "same").join(many, "same")
        first = members.withColumn("place", F.row_number().over(Window.partitionBy("same").orderBy("node_key"))).where(F.col("place") <= k + 1)
        first = sized(first.select("same", F.col("node_key").alias("b"), "place"), "first")
        rest = written(members.join(first.select("same", F.col("b").alias("node_key")), ["same", "node_key"], "left_anti"), "rest")
        copies = rest.join(first.where(F.col("place") <= k), "same").select(F.col("node_key").alias("a"), "b", F.lit(1.0).alias("cosine"))
        units = written(units.join(rest.select("node_key"), "node_key", "left_anti"), "units")
    total = units.count()
    # About SAMPLE vectors, those whose key's hash is small: the driver gets no more whatever the number of vectors.
    share = min(1.0, SAMPLE / max(1, total))
    chosen = units.where(F.pmod(F.xxhash64("node_key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else units
    sample = chosen.select("node_key", "vector").limit(SAMPLE + SAMPLE // 8).collect()
    sample.sort(key=lambda r: r["node_key"])
    if len(sample) < 2:
        return copies if copies is not None else spark.createDataFrame([], "a bigint, b bigint, cosine double")
    points = np.array([np.frombuffer(r["vector"], np.float32) for r in sample])
    depth, sizes = _books(total, len(points))
    books = fit(points, sizes)
    probes = reach(units, np.array([r["node_key"] for r in sample], np.int64), points, Coder(books, depth), k)
    if probes is None:
        out = ranked(exactly(units, units, total, k))
    else:
        shared = spark.sparkContext.broadcast((books, depth))
        rows = units.select("node_key", "vector").mapInArrow(_encoder(shared, probes), "node_key bigint, codes binary, norm float, vector binary, cells array<bigint>")
        near = written(ranked(in_cells(written(rows, "encoded"), shared, k)), "near")
        enough = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, total - 1)).select(F.col("a").alias("node_key"))
        short = written(units.select("node_key", "vector").join(enough, "node_key", "left_anti"), "short")
        out = near if short.isEmpty() else near.join(short.select(F.col("node_key").alias("a")), "a", "left_anti").unionByName(ranked(exactly(short, units, total, k)))
    return out if copies is None else out.unionByName(copies)


def neighbours(nodes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``nearest`` of the nodes' usable embeddings."""
    return nearest(usable(nodes), k)


def found(nodes: DataFrame) -> DataFrame:
    """(node_key_a, node_key_b), a < b: pairs of which one is among the 5 nearest of the other."""
    near = neighbours(nodes)
    return near.select(F.least("a", "b").alias("node_key_a"), F.greatest("a", "b").alias("node_key_b")).distinct()
