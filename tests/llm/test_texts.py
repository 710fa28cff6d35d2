"""Problems 2, 4, 5, 7, 8 and 9, against plain versions on small tables."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from codelattice.llm import ann, chunking, common, leakage, mixing, neardup, spam

WORDS = [f"w{i}" for i in range(400)]


def _code(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _brute(rows, t):
    sets = {}
    for doc, code in rows:
        w = re.findall(r"[A-Za-z0-9_]+", code or "")
        sets[doc] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.fixture(scope="module")
def family():
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = _code(rng).split()
        for j in range(6):
            x = list(base)
            for _ in range(j):
                at = rng.randrange(len(x))
                x[at : at + 1] = [[], [rng.choice(WORDS)], [rng.choice(WORDS), x[at]]][rng.randrange(3)]
            rows.append((f"d{i}-{j}", " ".join(x)))
    rows += [("same1", rows[0][1] + "!"), ("same2", rows[0][1].replace(" ", "\r\n")), ("short", "a b"), ("null", None), ("empty", ""), ("three", "a b c"), ("three2", "a, b; c")]
    return rows


def test_near_duplicates_like_brute_force(spark, docs_of, odd, family):
    docs = docs_of(*((d, "x.py", None, c) for d, c in family), (family[3][0], "x.py", None, family[3][1]))
    got = {tuple(r) for r in neardup.found(odd(docs)).collect()}
    assert got == _brute(family, 0.7)  # no two texts of the family are equal
    assert len(got) > 40
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert all(classes[a] == classes[b] for a, b in got) and classes["three"] == classes["three2"] == "three" and "short" not in classes


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_skipping_by_size_and_place_loses_nothing(most):
    rng = np.random.default_rng(0)
    key = rng.integers(0, 5, 300).astype(np.int64)
    ids, size = rng.permutation(300).astype(np.int64), rng.integers(50, 100, 300).astype(np.int32)
    place, side, classes = rng.integers(0, 40, 300).astype(np.int32), rng.integers(0, 3, 300).astype(np.int32), rng.integers(1, 4, 300).astype(np.int64)
    classes[key == 0] = 7
    for sides, kinds in ((np.zeros(300, np.int32), np.zeros(300, np.int64)), (side, classes)):
        found = [tuple(r) for part in neardup.list_pairs(key, ids, size, place, sides, kinds, 0.7, most) for r in part.tolist()]
        want = set()
        for a, b in itertools.permutations(range(300), 2):
            most_common = min(place[a], place[b]) + min(size[a] - place[a], size[b] - place[b])
            same = key[a] == key[b] and (sides[a] == 0 or sides[a] != sides[b] or sides[b] == 0) and (kinds[a] == 0 or kinds[a] != kinds[b])
            alike = min(size[a], size[b]) >= 0.7 * max(size[a], size[b]) and most_common >= np.ceil((int(size[a]) + int(size[b])) * 0.7 / 1.7 - 1e-9)
            if ids[a] < ids[b] and same and alike:
                want.add(tuple(int(x) for x in (ids[a], ids[b], size[a], size[b], place[a], place[b])))
        assert len(found) == len(set(found)) and set(found) == want


def test_long_lists_are_cut_and_lose_nothing(docs_of, family, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_BLOCK", 2)
    monkeypatch.setattr(neardup, "LEAST_COUNTERS", 1 << 6)
    monkeypatch.setattr(neardup, "MOST_COUNTERS", 1 << 6)
    docs = docs_of(*((d, "x.py", None, c) for d, c in family))
    assert {tuple(r) for r in neardup.found(docs).collect()} == _brute(family, 0.7)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_records_are_paired_with_the_first_of_each_similar_text(docs_of, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(neardup, "NARROW_ROWS", rows)
    code = "a b c d e f g h i j k l"
    table = [(f"c{i}", "x.py", None, code) for i in range(5)] + [(f"d{i}", "x.py", None, code.replace(" ", " " * (i + 2))) for i in range(3)] + [(f"e{i}", "x.py", None, "a b c d e f g h i j k m") for i in range(2)]
    got = {tuple(r) for r in neardup.found(docs_of(*table, table[0])).collect()}
    heads = ["c0", "d0", "d1", "d2", "e0"]
    assert got == {tuple(sorted((d, h))) for d, *_ in table for h in heads if d != h}
    told = {tuple(r) for r in neardup.copies(docs_of(*table, table[0])).collect()}
    assert told == {(f"c{i}", "c0", 5) for i in range(5)} | {(f"d{i}", f"d{i}", 1) for i in range(3)} | {(f"e{i}", "e0", 2) for i in range(2)}
    assert {(r["class_id"], r["members"]) for r in neardup.classes(docs_of(*table)).collect()} == {("c0", 10)}


def test_a_family_has_its_class_and_all_its_pairs(docs_of):
    rng = random.Random(12)
    base = _code(rng, 200).split()
    rows = []
    for i in range(90):
        x = list(base)
        x[rng.randrange(200)] = f"n{i}"
        rows.append((f"f{i:02}", " ".join(x)))
    rows += [(f"g{i}", " ".join(base[:100] + _code(rng, 100).split())) for i in range(3)]
    docs = docs_of(*((d, "x.py", None, c) for d, c in rows))
    assert {tuple(r) for r in neardup.found(docs).collect()} == _brute(rows, 0.7)
    assert sorted((r["class_id"], r["members"]) for r in neardup.classes(docs).collect()) == [("f00", 90)] * 90 + [("g0", 1), ("g1", 1), ("g2", 1)]


def test_no_duplicates_in_nothing(docs_of):
    none = docs_of(("a", "x", None, "a b c")).where("false")
    assert neardup.found(none).count() == 0 and neardup.classes(none).count() == 0


# ---------------------------------------------------------------- 4


def _nodes(spark, vectors):
    rows = [(k, (None, None if v is None else [None if x is None else float(x) for x in v])) for k, v in vectors]
    return spark.createDataFrame(rows, "node_key bigint, graph_node_data struct<code: string, embedding: array<float>>")


def test_neighbours_recall(spark, odd):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    points = np.concatenate([c + 0.15 * rng.normal(size=(15, 64)) for c in centres]).astype(np.float32) * rng.uniform(0.5, 3, (600, 1)).astype(np.float32)
    bad = [(900, None), (901, [1.0] * 32), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] + [1.0] * 63), (905, [None] + [1.0] * 63), (7, points[7])]
    nodes = _nodes(spark, [*enumerate(points), *bad])
    got = {(r["a"], r["b"]) for r in ann.neighbours(odd(nodes)).collect()}
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-cos, axis=1)[:, :5]) for j in row}
    assert len(got) == 3000 and len(got & true) >= 0.98 * len(true)
    assert all(a < 600 and b < 600 for a, b in got)


def test_vectors_without_clusters_have_their_neighbours(spark):
    points = np.random.default_rng(5).normal(size=(9000, 64)).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(points)]
    got = {(r["a"], r["b"]) for r in ann.nearest(spark.createDataFrame(rows, "node_key bigint, vector array<float>")).collect()}
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1)[:, None]
    true = set()
    for first in range(0, 9000, 1000):
        cos = unit[first : first + 1000] @ unit.T
        cos[np.arange(1000), np.arange(first, first + 1000)] = -2
        true |= {(first + i, int(j)) for i, row in enumerate(np.argpartition(-cos, 5, axis=1)[:, :5]) for j in row}
    assert len(got) == 45000 and len(got & true) >= 0.9 * len(true)


def _true_neighbours(points):
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    return {(i, int(j)) for i, row in enumerate(np.argsort(-cos, axis=1)[:, :5]) for j in row}


def test_vectors_are_searched_exactly_where_cells_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 3)
    monkeypatch.setattr(ann, "EXACT_BLOCK", 50)
    points = np.random.default_rng(6).normal(size=(300, 64)).astype(np.float32)
    for probes, reach in (((1,), 0.0), ((1,), 1.1)):  # too few seen in one cell, and no number of cells that reaches enough
        monkeypatch.setattr(ann, "PROBES", probes)
        monkeypatch.setattr(ann, "REACH", reach)
        got = {(r["a"], r["b"]) for r in ann.nearest(ann.usable(_nodes(spark, enumerate(points)))).collect()}
        assert len(got) == 1500 and (got == _true_neighbours(points) or reach == 0.0)


def test_many_equal_vectors_have_the_smallest_keys(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(60, 64)).astype(np.float32)
    points[10:40] = points[10]  # thirty equal ones
    got = {}
    for r in ann.nearest(ann.usable(_nodes(spark, enumerate(points)))).collect():
        got.setdefault(r["a"], []).append((-round(r["cosine"], 5), r["b"]))
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1)[:, None]
    for a in range(60):
        want = sorted((-round(float(unit[a] @ unit[b]), 5), b) for b in range(60) if b != a)[:5]
        assert sorted(got[a]) == want


def test_codes_stand_for_vectors():
    points = np.random.default_rng(8).normal(size=(500, 16)).astype(np.float32)
    books = ann.fit(points, [20, 20, 64, 64, 64, 64])
    codes, norms, cells = ann.Coder(books, 2).encode(points, 12)
    sums = sum(b[codes[:, i]] for i, b in enumerate(books))
    assert np.allclose(np.linalg.norm(sums, axis=1), norms, atol=1e-4)
    assert ((points - sums) ** 2).sum() < 0.35 * (points**2).sum()
    assert all(len(set(row.tolist())) == 12 and row.min() >= 0 and row.max() < 400 for row in cells)


def test_few_equal_and_no_vectors(spark):
    one = [1.0] * 64
    assert ann.found(_nodes(spark, [(1, one)])).count() == 0
    assert ann.found(_nodes(spark, [(1, None)]).where("false")).count() == 0
    assert {tuple(r) for r in ann.found(_nodes(spark, [(i, one) for i in range(4)])).collect()} == set(itertools.combinations(range(4), 2))


def test_full_cells_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_BLOCK", 7)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 11)
    monkeypatch.setattr(ann, "CELL", 30)
    rng = np.random.default_rng(2)
    points = (np.ones(64) + 0.1 * rng.normal(size=(60, 64))).astype(np.float32)
    got = {(r["a"], r["b"]) for r in ann.neighbours(_nodes(spark, enumerate(points))).collect()}
    assert got == _true_neighbours(points)


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("seed", range(6))
def test_pieces_are_bounded_and_lose_nothing(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "é", "\n", "\n\n", ". ", "x" * 30, "𝄞", "def f():\n    "]) for _ in range(rng.randrange(1, 3000)))
    for most, overlap in ((100, 20), (100, 80), (500, 0), (999, 600), (7, 3), (20, 19), (20, 50)):
        cuts = chunking.pieces(text, most, overlap)
        real = min(overlap, most - 1)
        assert all(own - start >= min(own, real - real // 4) for start, own, _ in cuts[1:])
        assert all(end - start <= most for start, _, end in cuts)
        assert "".join(text[own:end] for _, own, end in cuts) == text
        assert all(a[2] == b[1] and b[0] <= b[1] for a, b in zip(cuts, cuts[1:]))


def test_an_edit_changes_the_pieces_around_it():
    rng = random.Random(9)
    text = "\n".join(_code(rng, 12) + "." for _ in range(400))
    edited = text[:9000] + "one more sentence here. " + text[9000:]
    own = lambda t: [t[o:e] for _, o, e in chunking.pieces(t, 1200, 120)]
    a, b = own(text), own(edited)
    assert len(set(a) - set(b)) <= 6 < len(a) / 2


def test_pieces_of_tables(spark, docs_of, odd):
    docs = docs_of(("long", "x", None, "line\n" * 100), ("long", "x", None, "line\n" * 100), ("short", "x", None, "y"), ("null", "x", None, None))
    nodes = spark.createDataFrame([(5, ("z " * 200, "ü" * 51))], "node_key bigint, graph_node_data struct<code: string, description: string>")
    limits = spark.createDataFrame([("docs.code", 100, 10), ("tree_nodes.description", 50, 5), ("tree_nodes.code", None, None)], "field_name string, max_chars int, overlap_chars int")
    assert {tuple(r) for r in chunking.found(odd(docs), nodes, limits).collect()} == {("docs.code", "long"), ("tree_nodes.description", "5")}
    rows = chunking.split_all(docs, nodes, limits).where("item_key = 'long'").orderBy("piece").collect()
    assert "".join(r["text"][r["own_start"] - r["start"] :] for r in rows) == "line\n" * 100
    assert all(r["text"].endswith("\n") for r in rows)
    assert chunking.found(docs.where("false"), nodes.where("false"), limits).count() == 0


# ---------------------------------------------------------------- 7


def test_leaks_like_brute_force(spark, odd):
    rng = random.Random(5)
    items = [(i, "b", _code(rng, rng.randrange(8, 40))) for i in range(12)] + [(99, "b", None)]
    docs = []
    for d in range(60):
        text = _code(rng, 80)
        if d % 3 == 0:
            w = items[d % 12][2].split()
            n = rng.choice([10, 11, 12, 13, 20])
            at = rng.randrange(max(1, len(w) - n))
            text += " <b>" + ", ".join(w[at : at + n]).upper() + "</b> " + _code(rng, 20)
        docs.append((d, text))
    docs += [(70, None), (71, ""), (72, items[0][2]), (72, items[0][2])]
    grams = lambda t: {tuple(x) for w in [leakage.words(t or "")] for x in (w[i : i + 12] for i in range(len(w) - 11))}
    want = {(d, i) for d, t in docs for i, _, x in items if grams(t) & grams(x)}
    pages = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, benchmark string, text string")
    assert {tuple(r) for r in leakage.found(odd(pages), table).collect()} == want and want
    assert leakage.leaked_items(pages, table).where("leaked").count() == len({i for _, i in want})
    assert {(r["doc_id"], r["item_id"]) for r in leakage.proximity(pages, table).collect()} >= {(72, 0)}
    assert leakage.found(pages.where("false"), table).count() == leakage.found(pages, table.where("false")).count() == 0


def _near_brute(docs, items, window, share):
    df = {}
    for text in {(d, t) for d, t in docs if t}:
        for w in set(leakage.words(text[1])):
            df[w] = df.get(w, 0) + 1
    out = {}
    for item, text in items:
        own = leakage.words(text)
        distinct = set(own)
        held = sorted((w for w in distinct if w in df), key=lambda w: (df[w], w))
        anchors = held[: len(held) - int(np.ceil(share * len(distinct) - 1e-9)) + 1] if len(own) >= 12 else []
        reach = max(window, len(own))
        for d, t in docs:
            ws = leakage.words(t or "")
            best = max((len(distinct & set(ws[max(0, i - reach) : i + reach + 1])) / len(distinct) for i, w in enumerate(ws) if w in anchors), default=0)
            if best >= share:
                out[d, item] = max(out.get((d, item), 0), round(best, 6))
    return out


@pytest.mark.parametrize("rows", [0, 100_000])
def test_phrases_and_near_copies_with_and_without_broadcasts(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", rows)
    rng = random.Random(21)
    items = [(i, _code(rng, rng.randrange(10, 50))) for i in range(15)]
    docs = []
    for d in range(60):
        ws = items[d % 15][1].split()
        for _ in range(rng.randrange(0, len(ws) // 3)):  # the rarest words as likely as any other
            ws[rng.randrange(len(ws))] = rng.choice(WORDS)
        if d % 4 == 0:
            rng.shuffle(ws)
        docs.append((d, _code(rng, 60) + " " + " ".join(ws) + " " + _code(rng, 60)))
    docs += [(5, "another text under the same id " + items[0][1]), (90, None), (91, "")]
    pages = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda t: {tuple(x) for w in [leakage.words(t or "")] for x in (w[i : i + 12] for i in range(len(w) - 11))}
    assert {tuple(r) for r in leakage.found(pages, table).collect()} == {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}
    near = {(r["doc_id"], r["item_id"]): r["near_share"] for r in leakage.proximity(pages, table).collect()}
    assert near == _near_brute(docs, items, 24, 0.8) and len(near) > 10
    assert leakage.proximity(pages.where("false"), table).count() == leakage.proximity(pages, table.where("false")).count() == 0


# ---------------------------------------------------------------- 8


def test_mixture_shares_and_repeats(spark, odd):
    rng = random.Random(6)
    rows = [(i, _code(rng, 200), " BIG" if i % 2 else "big") for i in range(120)] + [(500 + i, _code(rng, 200), "small") for i in range(12)] + [(900, None, "big"), (901, "", "big"), (902, "x", None), (903, "y", "other")]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mixing.shares(odd(pages), targets, length=64).collect()}
    assert abs(r["big"]["actual_share"] - 5 / 9) < 0.02 and abs(r["small"]["actual_share"] - 4 / 9) < 0.02
    assert r["big"]["most_uses"] <= 1 and r["small"]["most_uses"] <= 3 and r["none"]["blocks"] == 0
    mixed = mixing.mixture(pages, targets, length=64)
    assert mixed.groupBy("source", "number").count().join(targets.selectExpr("lower(trim(source)) AS source", "max_repeats"), "source").where("count > max_repeats").count() == 0
    assert mixing.shares(pages.where("false"), targets).where("blocks > 0").count() == 0


def test_packing_is_a_round_trip(spark):
    rows = [(i, f"text number {i} " * 40, "s") for i in range(20)]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    blocks = mixing.pack(pages, targets, length=50).collect()
    encode = mixing.tokenizer(mixing.TOKENIZER)
    want = {i: encode([x])[0].tolist() for i, x, _ in rows}
    assert sorted(t for b in blocks for t in b["tokens"]) == sorted(t for x in want.values() for t in x)
    got: dict[int, list[int]] = {}
    for b in sorted(blocks, key=lambda b: b["number"]):
        for doc, a, z in zip(b["doc_ids"], b["starts"], [*b["starts"][1:], b["n_tokens"]]):
            got.setdefault(doc, []).extend(b["tokens"][a:z])
    assert got == want and sum(b["n_tokens"] < 50 for b in blocks) <= 1
    assert np.array_equal(mixing.tokenizer("/opt/tokenizers/byte_bpe_50k.json")([rows[3][1]])[0], want[3])
    assert sorted(b["number"] for b in blocks) == list(range(len(blocks))) and all(b["n_tokens"] <= 50 for b in blocks)


def test_mixture_is_the_same_for_all_settings_and_meets_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_CHARS", 3000)
    monkeypatch.setattr(mixing, "RESTS", 3)
    monkeypatch.setattr(mixing, "MOST_TASKS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 5)
    monkeypatch.setattr(mixing, "BUNDLE_SHARDS", 2)
    monkeypatch.setattr(mixing, "MOST_BUNDLES", 4)
    rng = random.Random(16)
    rows = [(i, _code(rng, rng.randrange(5, 300)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(150)] + [(1000, "w", "a"), (1000, "w", "a"), (None, _code(rng, 90), "b")]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r["shard"], r["slot"], r["source"], r["number"], r["use"], tuple(r["tokens"]), tuple(r["starts"])) for r in mixing.mixture(pages.repartition(int(n)), targets, length=32).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    total = sum(len(r[5]) for r in results[0])
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(len(r[5]) for r in results[0] if r[2] == source) - share * total) <= 32
    shards = {}
    for r in results[0]:
        shards.setdefault(r[0], []).append(r[1])
    assert len(shards) > 4 and all(sorted(s) == list(range(len(s))) and len(s) >= 5 for s in shards.values())


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_permutations(size):
    assert sorted(mixing.permuted(np.arange(size), size, 3).tolist()) == list(range(size))


# ---------------------------------------------------------------- 9

PROSE = "The walk visits every folder at most {a} times before it gives up. Nobody has tried this with more than {b} modules, so expect surprises. Later releases will track the label in the background, and {w} keeps one session for each worker. "


def test_spam_pages(spark, odd):
    rng = random.Random(8)
    prose = lambda: "".join(PROSE.format(a=rng.randrange(999), b=rng.randrange(999), w=rng.choice(WORDS) + rng.choice(WORDS)) + _code(rng, 30) + ". " for _ in range(3))
    rows = [(i, prose(), "en") for i in range(60)]
    keys = ["cheap", "best", "tool", "free", "download"]
    spammy = {
        100: " ".join(rng.choice(keys) for _ in range(150)), 101: "\n".join(f"name{i} https://www.a{i}.example/x/y" for i in range(40)), 102: " ".join(f"#{rng.choice(keys)}{i % 7}" for i in range(90)),
        103: "\n".join(f"item{i} | SKU {i} | in stock | tool, best" for i in range(30)), 104: "Buy cheap tool, try cheap tool, love cheap tool. " * 15, 105: " ".join(f'<a href="https://x{i}.test/a/b">cheap tool</a>' for i in range(30)),
        106: "One sentence of prose stands here.\n" + " ".join(rng.choice(keys) for _ in range(150)),
    }
    fine = {200: prose() + "\n\nSee also:\n" + "\n".join(f"- https://a{i}.example/x" for i in range(4)), 201: prose() + "\nKeywords: a, b, c, d", 202: "short", 203: "?!", 204: prose() + "\n```\n" + "x = f(x)\n" * 30 + "```\n"}
    rows += [(k, t, None) for k, t in spammy.items()] + [(k, t, "EN ") for k, t in fine.items()] + [(300, None, "en"), (301, "", "en"), (100, spammy[100], None)]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in spam.found(odd(pages)).collect()} == set(spammy)
    assert spam.score_pages(pages).where("doc_id IN (300, 301)").count() == 0
    assert spam.found(pages.where("false")).count() == 0


def test_stuffed_sentences_beside_prose_are_told(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    keys = ["cheap", "hotel", "flight", "best", "deal", "online"]
    stuffed = lambda n: " ".join(" ".join(rng.choice(keys) for _ in range(12)).capitalize() + "." for _ in range(n))
    rows = [(i, prose(rng.randint(10, 90 if i < 60 else 500)), "en") for i in range(100)]
    rows += [(100 + i, prose(44) + "\n\n" + stuffed(58), "en") for i in range(5)]  # 57 % stuffed
    rows += [(200 + i, prose(64) + "\n\n" + stuffed(40), "en") for i in range(5)]  # 38 % stuffed
    rows += [(300, "\n".join([prose(30)] * 12), "en")]  # repeats over more than a block
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in spam.found(pages).collect()} == {*range(100, 105), 300}
