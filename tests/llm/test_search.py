"""One shard of the search index against brute force, without Spark, and the risk that the quality classifier lowers."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wattaudit.llm import quality, search


def plain(text):
    return (text or b"").lower().split()


@pytest.fixture(scope="module")
def given():
    """Texts of frequent and rare words, copies, empty and null texts, one long text."""
    draw = np.random.default_rng(5)
    texts = [b" ".join(b"w%d" % w for w in draw.zipf(1.3, draw.integers(1, 90)) if w < 10**6) for _ in range(900)]
    texts += texts[:40] + [b"", None, b" \t", b"W1 " * 5000 + b"rare", texts[7].upper()]
    return texts


@pytest.fixture(scope="module")
def scores(given):
    """BM25 of every text for every text as a query, by the formula."""
    n, mean = len(given), sum(len(plain(t)) for t in given) / len(given)
    df = Counter(w for t in given for w in set(plain(t)))
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    weight = []
    for t in given:
        size = len(plain(t))
        weight.append({w: idf[w] * c * 1.9 / (c + 0.9 * (0.6 + 0.4 * size / mean)) for w, c in Counter(plain(t)).items()})
    return idf, mean, lambda query: [sum(own[w] for w in set(plain(query)) if w in own) for own in weight]


def built(given, mean):
    packer = search.Packer()
    for at in range(0, len(given), 100):  # as batches come
        packer.add(list(range(at, min(at + 100, len(given)))), given[at : at + 100])
    return search.Shard(packer.row().to_pylist()[0], mean)


@pytest.mark.parametrize("seeded", [False, True])
def test_pivots_find_the_best(given, scores, seeded):
    idf, mean, score = scores
    shard, k = built(given, mean), 10
    asked = [(i, w.decode(), idf[w]) for i in range(0, len(given), 9) for w in sorted(set(plain(given[i])))]
    asked += [(len(given), "nowhere", 3.0)]  # a word that the shard doesn't hold
    table = pa.table({"query_id": [a[0] for a in asked], "word": [a[1] for a in asked], "idf": [a[2] for a in asked]})
    want = {}
    for i in {a[0] for a in asked}:
        own = score(given[i]) if i < len(given) else []
        want[i] = sorted((-round(s, 9), d) for d, s in enumerate(own) if s > 0)[:k]
    least = None
    if seeded:  # as known from other shards: exactly the score of the last
        ids = sorted(i for i in want if len(want[i]) == k)
        least = pa.table({"query_id": ids, "least": [-want[i][-1][0] - 1e-8 for i in ids]})
    got = {i: [] for i in want}
    for batch in search._best(shard, search.Queries(table, least), k):
        for r in batch.to_pylist():
            got[r["query_id"]].append((r["score"], r["doc_id"]))
    assert (shard.row >= 0).any() and (shard.row < 0).any()  # both lists and the matrix were in use
    for i, best in want.items():
        assert [s for s, _ in got[i]] == pytest.approx([-s for s, _ in best], abs=3e-9)
        assert [d for _, d in got[i]] == [d for _, d in best] or i == len(given) - 2  # the long text's own sums are less exact


def test_words_are_looked_up_once_for_all_blocks(spark, given, scores, tmp_path, monkeypatch):
    """Blocks of queries hold numbers; a shard looks its words up in the vocabulary once, and finds what it finds by words."""
    idf, mean, _ = scores
    asked = [(i, w.decode()) for i in range(0, len(given), 7) for w in sorted(set(plain(given[i])))]
    asked += [(len(given), "nowhere"), (len(given) + 1, plain(given[0])[0].decode())]
    number = {w: 3 * n for n, w in enumerate(sorted({w for _, w in asked}, reverse=True))}
    rows = [(i, number[w], idf.get(w.encode(), 3.0)) for i, w in asked]
    folder = search._by_block(spark.createDataFrame(rows, "query_id long, number long, idf double"), 5, "blocks", pack=True)
    vocabulary = f"{tmp_path}/vocabulary"
    spark.createDataFrame(list(number.items()), "word string, number long").repartition(3).write.parquet(vocabulary)
    packer = search.Packer()
    packer.add(list(range(len(given))), given)
    looked, index_in = [], search.pc.index_in
    monkeypatch.setattr(search.pc, "index_in", lambda *a, **b: looked.append(1) or index_in(*a, **b))
    run = search._searcher(folder, vocabulary, None, 5, mean, 10)
    got = {}
    for batch in run(iter([packer.row()])):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert len(looked) <= 3  # files of the vocabulary, not blocks times files
    table = pa.table({"query_id": [a[0] for a in asked], "word": [a[1] for a in asked], "idf": [r[2] for r in rows]})
    want = {}
    for batch in search._best(built(given, mean), search.Queries(table, None), 10):
        for r in batch.to_pylist():
            want.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == want and len(want) > 100 and len(given) not in want


@pytest.mark.parametrize("times", [1, 70_000])
def test_large_counts_and_single_documents(times):
    """Counts beyond 16 bits, and a shard of one document."""
    packer = search.Packer()
    packer.add([7], [b"a " * times + b"b"])
    row = packer.row().to_pylist()[0]
    assert len(row["tfs"]) == (2 if times == 1 else 4) * 2
    q = search.Queries(pa.table({"query_id": [1, 1, 2], "word": ["a", "b", "c"], "idf": [1.0, 2.0, 1.0]}), None)
    (found,) = search._best(search.Shard(row, 2.0), q, 10)
    norm = 0.9 * (0.6 + 0.4 * (times + 1) / 2)
    want = times * 1.9 / (times + norm) + 2 * 1.9 / (1 + norm)
    assert [(r["query_id"], r["doc_id"]) for r in found.to_pylist()] == [(1, 7)]
    assert found["score"][0].as_py() == pytest.approx(want, abs=2e-9)


def test_high_threshold_finds_nothing(given, scores):
    idf, mean, _ = scores
    shard = built(given, mean)
    found = sorted(set(plain(given[0])))
    table = pa.table({"query_id": [0] * len(found), "word": [w.decode() for w in found], "idf": [idf[w] for w in found]})
    q = search.Queries(table, pa.table({"query_id": [0], "least": [1e6]}))
    assert sum(b.num_rows for b in search._best(shard, q, 10)) == 0


def test_shards_without_words():
    packer = search.Packer()
    packer.add([1, None, 3], [None, b"", b" \n"])
    row = packer.row().to_pylist()[0]
    assert (row["size"], row["total"], row["words"]) == (3, 0, b"")
    q = search.Queries(pa.table({"query_id": [1], "word": ["a"], "idf": [1.0]}), None)
    assert sum(b.num_rows for b in search._best(search.Shard(row, 0.0), q, 10)) == 0


def test_quality_lowers_the_risk(spark):
    """Prior, scaling and a lower non-negative risk than at the start, computed by the formula over all rows; not that it is the least."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    given = docs.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left").collect()
    x = np.array([quality.features((r["text"] or "").encode()) for r in given], np.float32).astype(float)
    good = np.array([r["quality"] == 1 for r in given])
    known = np.array([r["quality"] is not None for r in given])
    assert model.prior == pytest.approx(good[known].mean(), abs=0.02)
    assert model.mean == pytest.approx(x.mean(0), abs=1e-5)
    x = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    strength = quality.RIDGE + quality.RIDGE_ROWS / good.sum()

    def risk(w):
        z = np.clip(x @ w, -500, 500)
        plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
        rest = minus.mean() - model.prior * minus[good].mean()
        return model.prior * plus[good].mean() + max(0.0, rest) + strength / 2 * (w[:-1] ** 2).sum()

    start = np.append(np.zeros(len(model.weights) - 1), np.log(model.prior / (1 - model.prior)))
    assert risk(model.weights) < 0.75 * risk(start)
