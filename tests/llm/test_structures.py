"""Decontamination, prefix trie and centroid clustering against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wattaudit.llm import clustering, decontaminate, rollup, trie

# --- op11


def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_hits(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for n, starts in ((window, range(len(w) - window + 1)),) if len(w) >= window else ((len(w), range(min(1, len(w)))),):
            for s in starts:
                windows[tuple(w[s : s + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found_hits(docs, items, *args):
    return sorted((tuple(r) for r in decontaminate.contaminated(docs, items, *args).collect()), key=str)


@pytest.mark.parametrize("block_words", [30, 100_000])
def test_contaminated_brute_force(spark, block_words):
    rng = random.Random(5)

    def text(n, letters="abc"):
        return rng.choice(["", "... "]) + " ".join(rng.choice(letters) * rng.choice([1, 1, 2]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 5, 9, 14]), "abé")) for i in range(40)]
    items += [(i + 100, t) for i, t in items[:10]] + [(7, "A-b b, A"), (None, "cc c cc c cc"), (7, "A-b b, A")]
    docs = [(i, text(rng.choice([0, 3, 10, 40]), "abcé")) for i in range(60)] + [(None, items[8][1]), (61, None), (61, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 4):
        assert found_hits(table, tests, window, block_words) == brute_hits(docs, items, window)


def test_contaminated_odd(spark):
    same = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None, "x"), (2, "", "x"), (3, same.upper(), "x"), (4, "long " * 200_000 + same, "x"), (5, same[:-7], "x"), (5, same[:-7], "x"), (6, "ten eleven", "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(1, same, "y"), (2, same, "y"), (3, None, "y"), (4, " ", "y"), (5, same + " " + "w " * 3_000, "y")], "item_id long, text string, text2 string")
    got = {r[0]: tuple(r[1:4]) for r in decontaminate.contaminated(table, items).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (11, 11, 3), 4: (200_011, 11, 3), 5: (10, 10, 3), 6: (2, 0, 0)}
    assert decontaminate.contaminated(table.limit(0), items).count() == 0
    assert decontaminate.contaminated(table, items.limit(0)).where("contaminated").count() == 0


def test_chunks_and_pieces_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    text = b"Aa, bb!cc\xc3\xa9 dd  ee-ff gg"
    assert [w for part in decontaminate.stream(text) for w in part] == [b"aa", b"bb", b"cc\xc3\xa9", b"dd", b"ee", b"ff", b"gg"]
    words = [f"w{i}" for i in range(2_500)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = [(s, " ".join(words[s : s + 10])) for s in (0, 985, 991, 995, 1000, 1981, 1990, 2490)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert got.where("n_hit = 10").count() == len(docs)


def test_decontaminate(spark):
    rows = [(1, "Keep this. ONE two, three four! and this", "z"), (2, "one two three four", "z"), (3, "nothing", "z"), (4, None, "z"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in decontaminate.decontaminate(docs, items, 4).collect()}
    assert got == {1: ("Keep this. ! and this", "z"), 3: ("nothing", "z"), 4: (None, "z"), 5: ("", "z")}
    assert decontaminate.decontaminate(docs, items, 4).columns == docs.columns


# --- op12


def brute_trie(rows, group=20, shared=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(t)] for c, t in turns.items()}
    nodes = defaultdict(lambda: [set(), set(), set()])  # members, ends, children
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        base = int(np.fix(c / group)) * group
        way = [*own.get(base, [])[:h], *own[c][h:]]
        for d in range(len(way) + 1):
            nodes[tuple(way[:d])][0].add(c)
            if d:
                nodes[tuple(way[: d - 1])][2].add(tuple(way[:d]))
        nodes[tuple(way)][1].add(c)
    saved = {k: (len(v[0]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0) for k, v in nodes.items()}
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [sums[c] for c in nodes[k][2]]
        sums[k] = (sum(b[0] for b in below) if below else 1, saved[k] + sum(b[1] for b in below))
    return sorted(
        (
            (min(v[0]), len(k), min(nodes[k[:-1]][0]) if k else None, len(v[0]), len(v[2]), *sums[k],
             hashlib.sha256(",".join(map(str, sorted(v[1]))).encode()).hexdigest())
            for k, v in nodes.items()
        ), key=str,
    )


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local,stretch", [(1, 2), (3, 3), (40, 2), (65_536, 32)])
def test_trie_brute_force(spark, local, stretch):
    rng = random.Random(local)
    rows = []
    for c in [*range(45), 100, 101, -3, 2**40 + 7]:
        shape = rng.choice(["a", "ab", "abc"])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(shape) + " x") for t in range(rng.choice([1, 2, 3, 5, 9, 30]))]
    rows += [(60, t, "user", "long chain") for t in range(70)] + [(None, 1, "user", "nobody")]
    got = sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), local=local, stretch=stretch).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_odd(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_SPAN", 3)
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "", ""), (7, 0, "user", "word " * 100_000), (9, 1, "a", "b"), (9, 1, "a", "b"), (41, 0, "q", "r")]
    rows += [(c, t, "user", "same") for c in range(60, 80) for t in range(3)]
    wide = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", depth string")
    got = sorted((tuple(r) for r in trie.prefix_trie(wide).collect()), key=str)
    assert got == brute_trie(rows)
    assert trie.prefix_trie(wide.limit(0)).count() == 0
    assert trie.prefix_trie(wide.withColumn("conv_id", wide["conv_id"] * 0 + None)).count() == 0


def test_positions_of_a_hot_conversation(spark):
    """One conversation over many ranges, most of its rows alike."""
    rows = [(5, 1, "user", "same")] * 500 + [(5, t, "user", str(t)) for t in range(2, 300)] + [(c, 0, "user", "x") for c in range(20)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6)).where("conv_id = 5").collect()
    assert sorted(r["pos"] for r in turns) == sorted(range(1, len(turns) + 1)) and len(turns) == 799
    assert len({r["digest"] for r in turns if r["pos"] <= 501}) == 2


def test_decompose_shapes():
    rng = np.random.default_rng(2)
    for n, wide in ((1, 1), (400, 1), (400, 400), (400, 3), (2_000, 40)):
        parent = np.array([-1, *(rng.integers(max(0, i - wide), i) for i in range(1, n))], np.int64)
        parent[rng.random(n) < 0.01] = -1
        weight, values = rng.integers(1, 9, n), rng.integers(-5, 9, (n, 2))
        mass, sums = weight.copy(), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                mass[parent[i]] += mass[i]
                sums[parent[i]] += sums[i]
        mix = rng.permutation(n)  # position of every node
        mixed = np.empty(n, np.int64)
        mixed[mix] = np.where(parent >= 0, mix[parent], -1)
        order = np.argsort(mix)
        assert (rollup.decompose(mixed, mass[order], values[order]) == sums[order]).all()


# --- op13


def brute_clusters(rows, k, rounds):
    ids = [r[0] for r in rows]
    x = np.floor(np.array([r[1] for r in rows], float) * 64).astype(np.int64)
    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())
    centroids = x[order[:k]].copy()
    for r in range(rounds + 1):
        far = ((x[:, None, :] - centroids) ** 2).sum(2)
        own = far.argmin(1)
        if r < rounds:
            for c in set(own.tolist()):
                members = x[own == c]
                centroids[c] = members.sum(0) // len(members)
    distance = far[np.arange(len(x)), own]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted((i, int(c), int(d), int(distance[own == c].sum()), int(distance.sum()), digests[c]) for i, c, d in zip(ids, own, distance, strict=True))


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_cluster_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(9, 64))
    x = centres[rng.integers(0, 9, 700)] + rng.normal(size=(700, 64)) * 0.4
    x[:50] = x[50]  # copies, and a dimension without spread
    x[:, 3] = -0.25
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in clustering.cluster(table, bits=bits).collect())
    assert got == brute_clusters(rows, 16, 3)


def test_cells_decide_most(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64))
    x = np.floor(64 * (centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 64)) * 0.2)).astype(np.int64)
    centres = np.floor(64 * centres).astype(np.int64)
    cells = clustering.make_cells(x.min(0), x.max(0), x.mean(0), x.std(0), 4)
    found, fetched = clustering.nearest(cells, cells.pack(x), x.__getitem__, centres)
    assert (found == ((x[:, None] - centres) ** 2).sum(2).argmin(1)).all() and fetched < 90
    assert (cells.unpack(cells.pack(x)) < 16).all()


def test_cluster_odd(spark):
    nan, inf, one = float("nan"), float("inf"), [0.5] * 64
    rows = [(1, one), (1, one), (None, [-0.01] * 64), (2, None), (3, []), (4, one[:63]), (5, [*one[:63], None]), (6, [*one[:63], nan]),
            (7, [*one[:63], -inf]), (8, [*one[:63], 1e300]), (9, [2.0] * 64)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, cluster string")
    got = sorted((tuple(r[:3]) for r in clustering.cluster(table).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, 9, None] and all(r[2] == 0 for r in got)
    assert {r[1] for r in got if r[0] == 1} < {0, 1, 2, 3}
    assert clustering.cluster(table.limit(0)).count() == 0
    two = clustering.cluster(table, k=1).collect()
    assert len(two) == 4 and {r["cluster"] for r in two} == {0} and sum(r["distance"] for r in two) == two[0]["inertia"]
