"""Scores of a block of chunks for many queries at once: whole score vectors, from which only each query's best leave the task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: A term of over this share of a block's chunks is held as a column of all of them.
DENSE = 0.125
#: Chunks of which only the best score is looked at first.
GROUP = 256


def asked_words(queries: DataFrame, query_id: str) -> tuple:
    """(ids, terms, starts, numbers, weights) of a table (query_id, words: array of (term, weight)): the words of the i-th query are those
    from starts[i] to starts[i + 1], each with its number in terms."""
    t = queries.select(query_id, "words").toArrow().combine_chunks()
    if not t.num_rows:
        return (), pa.array([], pa.string()), [0], [], []
    words = t.column("words").chunk(0)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    term, weight = (words.flatten().field(x) for x in ("term", "weight"))
    terms = pc.unique(term)
    return t.column(query_id).chunk(0), terms, starts.tolist(), pc.index_in(term, value_set=terms).to_pylist(), weight.to_pylist()


def best(score: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best positive scores after rounding, the first places among equals.  ``score`` is of a multiple of GROUP,
    with zeros at its end.  Of k groups each has its best at or above the k-th best of all groups, so nothing far below it is among the k."""
    groups = score.reshape(-1, GROUP)
    peaks = groups.max(axis=1)
    least = np.partition(peaks, len(peaks) - k)[len(peaks) - k] if len(peaks) > k else 0.0
    least -= 0.0 if digits is None else 1.5 * 10.0**-digits
    near = np.flatnonzero(peaks >= least if least > 0 else peaks > 0)
    some = groups[near].ravel()
    within = np.flatnonzero(some >= least if least > 0 else some > 0)
    at = near[within // GROUP] * GROUP + within % GROUP
    found = score[at]
    if digits is not None:
        found = np.floor(found * 10**digits + 0.5) / 10**digits
        at, found = at[found > 0], found[found > 0]
    if len(at) > k:
        last = np.partition(found, len(found) - k)[len(found) - k]
        above = found > last
        equal = np.flatnonzero(found == last)[: k - np.count_nonzero(above)]
        above[equal] = True
        at, found = at[above], found[above]
    return at, found


def scorer(shared: Broadcast, query_id: str, keys: list[str], k: int, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (keys, words: array of (term, part)), in order of the keys, a row for a chunk: (query_id, keys, score), the k best
    chunks of a partition for each query of ``asked_words``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, starts, numbers, weights = shared.value
        held = [b for b in it if b.num_rows]
        if not held or not len(ids):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        n, words = t.num_rows, t.column("words").chunk(0)
        number = pc.fill_null(pc.index_in(words.flatten().field("term"), value_set=terms), -1).to_numpy().astype(np.int64)
        place = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())
        part = words.flatten().field("part").to_numpy()
        mine = number >= 0
        code, part = number[mine] * n + place[mine], part[mine]
        order = np.argsort(code)
        code, part = code[order], part[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))  # a term of texts with the same keys counts once, by its sum
        if not len(first):
            return
        number, place = np.divmod(code[first], n)
        part = np.add.reduceat(part, first)
        size = -(-n // GROUP) * GROUP
        lists: dict[int, tuple] = {}
        columns: dict[int, np.ndarray] = {}
        cuts = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > DENSE * n:
                column = columns[int(number[a])] = np.zeros(size)
                column[place[a:b]] = part[a:b]
            else:
                lists[int(number[a])] = place[a:b], part[a:b]

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            asked, at, value = (pa.array(np.concatenate(x)) for x in zip(*out))
            return pa.RecordBatch.from_arrays([ids.take(asked), *(t.column(c).chunk(0).take(at) for c in keys), value], names=[query_id, *keys, "score"])

        # Queries of the same frequent words come one after the other: the sum over those is made once.
        frequent = [tuple((numbers[j], weights[j]) for j in range(starts[q], starts[q + 1]) if numbers[j] in columns) for q in range(len(ids))]
        score, base, last = np.zeros(size), np.zeros(size), ()
        out: list[tuple] = []
        rows = 0
        for q in sorted(range(len(ids)), key=frequent.__getitem__):
            if frequent[q] != last:
                last = frequent[q]
                base.fill(0)
                for word, weight in last:
                    base += columns[word] * weight
            rare = [(lists[numbers[j]], weights[j]) for j in range(starts[q], starts[q + 1]) if numbers[j] in lists]
            if last or rare:
                np.copyto(score, base)
                for (places, parts), weight in rare:
                    score[places] += parts * weight
                at, value = best(score, k, digits)
                out.append((np.full(len(at), q), at, value))
                rows += len(at)
            if rows > 50_000:
                yield rows_of(out)
                out, rows = [], 0
        if rows:
            yield rows_of(out)

    return run
