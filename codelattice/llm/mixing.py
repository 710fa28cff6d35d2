"""Mixing sources to target weights.

Method: each source's tokens are packed into blocks of a fixed length; every output shard draws how many blocks it takes of
each source from a multinomial, conditioned on the sources' exact totals; a source's slots are mapped through pseudorandom
permutations of its block numbers, one per pass over the source; blocks are joined to slots by number.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import picked

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block; blocks of a shard at least; shards of a bundle at least, and bundles at most, whose counts the driver draws (a task
#: draws those of its shards).
BLOCK, SHARD_BLOCKS, BUNDLE_SHARDS, MOST_BUNDLES = 512, 256, 16, 1024
#: Characters of a group of rows that is packed by itself; groups whose rests are packed together; numbering rows that are broadcast at most.
GROUP_CHARS, RESTS, NUMBERING = 4_000_000, 256, 100_000
#: Tasks that pack at most; with more groups than that a task packs several, one after the other.
MOST_TASKS = 50_000


@lru_cache(4)
def tokenizer(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to token numbers by a public vocabulary: ranks of tiktoken's form, or a file of the tokenizers library."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [np.asarray(encode(t), dtype=np.int32) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda texts: [np.asarray(e.ids, dtype=np.int32) for e in found.encode_batch(texts, add_special_tokens=False)]


def source_name(column: F.Column) -> F.Column:
    """Sources are the same when they differ by case or surrounding blanks only."""
    return F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", ""))


_BLOCKS = pa.schema(
    [("source", pa.string()), ("group", pa.int64()), ("number", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))]
)
_BLOCKS_DDL = "source string, group bigint, number bigint, n_tokens int, tokens array<int>, doc_ids array<bigint>, starts array<int>"


def _blocks_of(source: str, group: int, docs: list, tokens: list[np.ndarray], length: int, first: int, last: bool) -> tuple[list[tuple], list, list[np.ndarray]]:
    """The full blocks (and with ``last`` the shorter last one) of documents' tokens in order, and the documents and tokens left over."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(sizes)
    every = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
    count = -(-len(every) // length) if last else len(every) // length
    rows = []
    for i in range(count):
        a, b = i * length, min((i + 1) * length, len(every))
        x, y = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
        rows.append((source, group, first + i, b - a, every[a:b], docs[x : y + 1], np.maximum(ends[x : y + 1] - sizes[x : y + 1] - a, 0).astype(np.int32)))
    at = count * length
    if at >= len(every):
        return rows, [], []
    x = int(np.searchsorted(ends, at, side="right"))
    rest = [every[at : ends[x]], *tokens[x + 1 :]]
    return rows, docs[x:], rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)


def _packer(path: str, length: int, whole: bool):
    """Rows (group, source, doc_id, text or tokens), sorted by group and source, to blocks; what is left over of a source in a group
    comes out with number -1, a row for each document, unless ``whole``: then as a shorter last block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        at, docs, tokens, number = None, [], [], 0

        def close() -> list[tuple]:
            if at is None:
                return []
            rows, ids, rest = _blocks_of(at[1], at[0], docs, tokens, length, number, whole)
            return rows + [(at[1], at[0], -1, len(t), t, [d], [0]) for d, t in zip(ids, rest) if len(t)]

        for batch in it:
            groups, sources, ids, contents = (batch.column(i).to_pylist() for i in range(4))
            cuts = encode(contents) if batch.schema.field(3).type == pa.string() else [np.asarray(c, dtype=np.int32) for c in contents]
            out: list[tuple] = []
            for group, source, doc, cut in zip(groups, sources, ids, cuts):
                if (group, source) != at:
                    out += close()
                    at, docs, tokens, number = (group, source), [], [], 0
                if len(cut):
                    docs.append(doc)
                    tokens.append(cut)
            if at is not None and sum(map(len, tokens)) >= length:
                rows, docs, tokens = _blocks_of(at[1], at[0], docs, tokens, length, number, False)
                number += len(rows)
                out += rows
            if out:
                yield _batch(out)
        if last := close():
            yield _batch(last)

    return run


def pack(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, length: int = BLOCK) -> DataFrame:
    """(source, number, n_tokens, tokens, doc_ids, starts): the tokens of every source in blocks numbered from 0, written to the shared
    folder; starts has where in the block each document's tokens begin.

    Rows are spread over groups by their key, as many as their characters need and whatever the session's settings, so that a source of
    any size is packed by many tasks.  What is left over in a group is packed with what other groups leave, so that of a source one
    block alone is shorter than ``length``.  Rows without text or of a source without target are left out; each repeated row counts.
    """
    wanted = F.broadcast(picked(targets, "source").select(source_name(F.col("source")).alias("source")).distinct())
    rows = picked(documents, "doc_id", "source", "text").where(F.length("text") > 0).withColumn("source", source_name(F.col("source"))).join(wanted, "source", "left_semi")
    groups = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP_CHARS))
    mark = F.xxhash64("doc_id", "text")
    spread = rows.select(F.pmod(mark, F.lit(groups)).alias("group"), "source", "doc_id", "text", mark.alias("mark"))
    spread = spread.repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group", "source", "mark", "doc_id").select("group", "source", "doc_id", "text")
    done, level = None, 0
    while True:
        packed = written(spread.mapInArrow(_packer(path, length, groups == 1), _BLOCKS_DDL), "blocks")
        full = packed.where("number >= 0").withColumn("level", F.lit(level))
        done = full if done is None else done.unionByName(full)
        if groups == 1:
            break
        groups, level = -(-groups // RESTS), level + 1
        rests = packed.where("number < 0").select(F.floor(F.col("group") / RESTS).alias("group"), "source", F.col("doc_ids")[0].alias("doc_id"), "tokens", F.col("group").alias("from"), F.xxhash64("tokens").alias("mark"))
        spread = rests.repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group", "source", "from", "mark", "doc_id").select("group", "source", "doc_id", "tokens")
    # Blocks before each group's, by source: one row for a source and group.
    counts = done.groupBy("source", "level", "group").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("source", "level", "group", "sum(n) over (partition by source order by level, group rows between unbounded preceding and 1 preceding) as before")
    before = written(before, "numbering")
    small = before.count() <= NUMBERING
    numbered = done.join(F.broadcast(before) if small else before, ["source", "level", "group"])
    return numbered.select("source", (F.col("number") + F.coalesce("before", F.lit(0))).alias("number"), "n_tokens", "tokens", "doc_ids", "starts")


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 at ``index``: a four-round Feistel network, walked until it stays inside."""
    bits = max(2, int(size - 1).bit_length() + 1) // 2
    low = np.uint64((1 << bits) - 1)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & low
        for turn in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF)
            f = (right + key) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & low)
        return (left << np.uint64(bits)) | right

    x = network(index.astype(np.uint64))
    while (out := x >= np.uint64(size)).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def plan(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Blocks to take of each source, as many in all as the scarcest source allows.

    available: (blocks, tokens) by source; targets: (share, max_repeats).  A source that has no tokens is left out and the
    other shares are scaled up.
    """
    use = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and available.get(s, (0, 0))[1] > 0}
    weight = sum(share for share, _ in use.values())
    if not use:
        return {}
    total = min(available[s][1] * repeats * weight / share for s, (share, repeats) in use.items())
    blocks = {}
    for s, (share, repeats) in use.items():
        n, tokens = available[s]
        blocks[s] = min(n * repeats, max(1, round(share / weight * total * n / tokens)))
    return blocks


def drawn(left: np.ndarray, sizes: list[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """For parts of the given sizes how many of each kind they take: multinomial counts conditioned on the totals ``left``.  Totals
    beyond what can be drawn exactly are divided in proportion."""
    for i, size in enumerate(sizes):
        if i == len(sizes) - 1:
            take = left
        elif left.sum() < 1_000_000_000:
            take = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:
            exact = left * (size / left.sum())
            take = np.minimum(np.floor(exact).astype(np.int64), left)
            take[np.argsort(take - exact, kind="stable")[: size - int(take.sum())]] += 1
        yield take
        left = left - take


def mixture(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, length: int = BLOCK, seed: int = 0) -> DataFrame:
    """(shard, slot, source, number, use, n_tokens, tokens, doc_ids, starts): the mixture's blocks; slot is the block's place in its shard.

    Each source has its target share of all tokens to within a block, and no block, so no row, is used more than its source's
    max_repeats times; use counts a block's uses from 1.  The result is the same whatever the session's settings.  targets has a few
    rows; repeated sources there count with their largest share.  Documents of other sources, and null or empty texts, take no part.
    """
    spark = documents.sparkSession
    blocks = pack(documents, targets, path, length)
    wanted: dict[str, tuple[float, int]] = {}
    for r in picked(targets, "source", "target_share", "max_repeats").withColumn("source", source_name(F.col("source"))).dropna().orderBy("source", "target_share").collect():
        wanted[r["source"]] = (float(r["target_share"]), int(r["max_repeats"]))
    sizes = {r["source"]: (r["n"], r["t"]) for r in blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    quota = plan(sizes, wanted)
    names = sorted(quota)
    total = sum(quota.values())
    shards = max(1, total // SHARD_BLOCKS)
    bundles = min(MOST_BUNDLES, -(-shards // BUNDLE_SHARDS))
    place = lambda shard: total * shard // shards
    edges = [shards * b // bundles for b in range(bundles + 1)]
    rows, taken = [], np.zeros(len(names), dtype=np.int64)
    for b, counts in enumerate(drawn(np.array([quota[s] for s in names], dtype=np.int64), [place(y) - place(x) for x, y in zip(edges, edges[1:])], np.random.default_rng(seed))):
        rows.append((b, edges[b], [place(s + 1) - place(s) for s in range(edges[b], edges[b + 1])], taken.tolist(), counts.tolist()))
        taken = taken + counts
    kinds = [(s, sizes[s][0]) for s in names]
    table = spark.createDataFrame(rows if total else [], "bundle int, first bigint, sizes array<bigint>, taken array<bigint>, counts array<bigint>")
    slots = table.repartition(bundles, "bundle").mapInArrow(_slots(kinds, seed), "shard bigint, slot int, source string, number bigint, use int")
    return slots.join(blocks, ["source", "number"]).select("shard", "slot", "source", "number", "use", "n_tokens", "tokens", "doc_ids", "starts")


_SLOTS = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("number", pa.int64()), ("use", pa.int32())])


def _slots(kinds: list[tuple[str, int]], seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                taken = np.array(r["taken"], np.int64)
                rng = np.random.default_rng([seed, r["bundle"]])
                for shard, counts in enumerate(drawn(np.array(r["counts"], np.int64), r["sizes"], rng), r["first"]):
                    source, number, use = [], [], []
                    for i in np.flatnonzero(counts):
                        name, size = kinds[i]
                        k = np.arange(taken[i], taken[i] + counts[i])
                        turn, index = k // size, k % size
                        own = np.empty(len(k), np.int64)
                        for t in np.unique(turn):
                            own[turn == t] = permuted(index[turn == t], size, (seed * 1000 + int(i)) * 64 + int(t))
                        source += [name] * len(k)
                        number.append(own)
                        use.append(turn + 1)
                    taken += counts
                    n = len(source)
                    columns = [np.full(n, shard), rng.permutation(n).astype(np.int32), source, np.concatenate(number), np.concatenate(use).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SLOTS)], schema=_SLOTS)

    return run


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, length: int = BLOCK, seed: int = 0) -> DataFrame:
    """(source, target_share, max_repeats, blocks, tokens, actual_share, most_uses), one row per target."""
    mixed = mixture(documents, targets, path, length, seed)
    by = mixed.groupBy("source", "number").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").cast("bigint").alias("tokens")).groupBy("source")
    by = by.agg(F.sum("uses").alias("blocks"), F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"))
    by = by.withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # a row for a target
    wanted = picked(targets, "source", "target_share", "max_repeats").withColumn("source", source_name(F.col("source")))
    return wanted.join(F.broadcast(by), "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.round(F.col("tokens") / F.col("all"), 6), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
