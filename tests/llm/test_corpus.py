"""Corpus operators against brute force, and their edge cases: nulls, empty texts, ties, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF, plan
from wattaudit.llm import bpe, dom, embeddings, langid, language_model, mixing, page_text, quality, search, simhash, warc
from wattaudit.llm.base import remainder
from wattaudit.llm.components import components
from wattaudit.llm.oracle import ORACLE
from wattaudit.llm.queries import QUERIES
from wattaudit.session import work_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, score string, ids string"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, equal and nearly equal texts, repeated rows, missing ids, clashing columns."""
    same = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [
        (1, None, "en", "a", "x", "y"), (2, "", "en", None, "x", "y"), (3, " \t\n ", None, None, None, None), (4, LONG, "en", "a", "x", "y"),
        (5, same, "en", "a", "x", "y"), (6, same, "de", "b", "x", "y"), (6, same, "de", "b", "x", "y"), (7, same + "more", "en", "b", "x", "y"),
        (None, same, "en", "b", "x", "y"), (8, "12 34 !!", "en", "c", "x", "y"), (9, "Été ça 漢字 🙂 x y", "fr", "é", "x", "y"),
        (10, "<|endoftext|> it's", "en", "d", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def pandas(df, key="doc_id"):
    return df.toPandas().sort_values(list(df.columns)[:1]).reset_index(drop=True)


def words(text):
    return (text or "").encode().lower().split()


# --- components


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (8, 3), (20, 21)]])
def test_components(spark, pairs):
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: n for p in pairs if p[0] != p[1] for n in p}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert found == want


# --- op1


def brute_vectors(rows, least):
    ids = [i for i, _ in rows]
    unit = np.array([np.array(v, float) / np.linalg.norm(v) for _, v in rows])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    for _ in ids:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
    return {i: (int(n), min(ids[k] for k in range(len(ids)) if label[k] == c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}


def test_near_vectors_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for _ in range(40):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append((at, (centre + rng.normal(size=24) * rng.choice([0.0, 0.15, 0.3])).tolist()))
            at += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (16, 2048):  # many tiles, and one
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(table, 0.95, tile).collect()}
        assert got == brute_vectors(rows, 0.95)


def test_near_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 0.0]),
            (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e300, 1e-300])]
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, False)
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_survivors_lose_nothing():
    rng = np.random.default_rng(1)
    x = embeddings._unit(rng.normal(size=(300, 40)) + rng.normal(size=40))
    rotation = embeddings.axes(x)
    links, _ = embeddings.compare(x, np.ones(300), np.zeros(300, bool), rotation, 0.6)
    near = x @ x.T >= 0.6
    assert (links == near.sum(1) - 1).all() and near.sum() > 300


# --- op2, op8, op4: learned models


def test_quality_held_out(spark, docs):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col("quality")).count() >= 0.9 * held.count()
    assert found.where("score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0


def test_quality_odd(spark, docs, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    for model in (quality.learn(odd, labels), quality.learn(odd.limit(0), labels.limit(0))):
        found = quality.predict(odd, model)
        assert found.count() == odd.count() and found.where("score is null or score < 0 or score > 1").count() == 0
        assert quality.predict(odd.limit(0), model).count() == 0
    same = found.where("doc_id in (5, 6)").select("score").distinct()
    assert same.count() == 1
    assert np.isfinite(quality.features(LONG.encode())).all() and len(quality.features(None)) == quality.N_FEATURES


def brute_phrases(symbols, sample):
    """Phrases of a text by plain substring search."""
    n = at = 0
    while at < len(symbols):
        end = at + 1
        while end < len(symbols) and symbols[at : end + 1] in sample:
            end += 1
        n, at = n + 1 + (symbols[at] not in sample), end
    return n


def test_cross_parsing():
    rng = random.Random(2)
    samples = {"x": ["abcab cab abca " * 4, "bca"], "y": ["ddea dead de eed " * 4]}
    model = langid.build(samples)
    lookups = langid._lookups(model)
    joined = {lang: "".join("".join(map(chr, [*langid.normal(t), 32])) for t in parts) for lang, parts in samples.items()}
    texts = ["".join(rng.choice("abcde  z") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    units = sorted((u for t in texts if len(u := langid.normal(t))), key=lambda u: -len(u))
    got = langid._phrases(units, model, lookups)
    for i, lang in enumerate(model.langs):
        assert got[i].tolist() == [brute_phrases("".join(map(chr, u)), joined[lang]) for u in units]


def test_large_alphabets():
    """Two languages of 2,000 letters each, none in common; the model stays small."""
    rng = random.Random(4)
    alphabets = {"a": [chr(0x4E00 + i) for i in range(2_000)], "b": [chr(0x4E00 + 4_000 + i) for i in range(2_000)]}

    def text(lang, n):
        return "".join(rng.choice(alphabets[lang]) for _ in range(n))

    model = langid.build({lang: [text(lang, 1_000) for _ in range(32)] for lang in alphabets})
    lookups = langid._lookups(model)
    given = [(lang, text(lang, 40)) for lang in alphabets for _ in range(100)]
    found, scores, _ = langid.identify([t for _, t in given], model, lookups)
    assert found == [lang for lang, _ in given] and min(scores) > 0.6
    assert sum(x.nbytes for x in (model.base, model.check, model.target, model.begin)) < 8 << 20


def test_many_languages_stay_within_the_bound(spark):
    rng = random.Random(5)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(300)] for i in range(80)}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(200))) for lang, w in words.items() for _ in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert len(model.langs) == 80
    assert sum(x.nbytes for x in (model.base, model.check, model.target, model.begin)) < 100 << 20
    fresh = [(lang, " ".join(rng.choice(w) for _ in range(30))) for lang, w in words.items()]
    found = langid.identify([t for _, t in fresh], model, langid._lookups(model))[0]
    assert sum(f == lang for f, (lang, _) in zip(found, fresh, strict=True)) >= 78


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op8_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()


def test_language_of_copies(spark):
    """A language of a few texts in thousands of rows is learned like one of as many different texts."""
    few = spark.range(3).selectExpr("'xx' AS lang", "concat('qaplo zuvit mornak ', id, ' brelk tuvosh gnarip') AS text")
    copies = few.crossJoin(spark.range(40_000)).select("lang", "text")
    other = spark.range(50).selectExpr("'en' AS lang", "concat('the cat sat on the mat and ran ', id) AS text")
    both = copies.unionByName(other)
    model = langid.learn(both, F.lit(True))
    assert model.langs == ["en", "xx"]
    assert [r[0] for r in langid.predict(few, model).select("lang_pred").collect()] == ["xx"] * 3


def test_language_odd(spark, odd):
    model = langid.learn(odd, F.lit(True))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3, 8)) and found[9][0] == "fr"
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.learn(odd.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_language_model_base_score(spark, docs, odd):
    held_out = remainder("doc_id", 7) == 2
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    model, counts = language_model.train(both.where(~held_out))
    found = language_model.score(both, model, counts, {"doc_id": F.col("doc_id"), "held_out": held_out, "text": F.col("text")}).collect()
    assert len(found) == both.count()
    c = Counter()
    for r in found:
        if not r["held_out"]:
            c.update([*words(r["text"]), b""])
    total, distinct = sum(c.values()), len(c)
    for r in found:
        tokens = [*words(r["text"]), b""]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(c[w] > 0 for w in tokens) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_a_distribution(spark):
    texts = ["the cat sat. the dog sat. a cat ran!", "a dog ran, the cat sat", "der hund lief, die katze lief."] * 30
    model, counts = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    known = [r["word"] for r in counts.collect() if r["word"]]
    # The classes' probabilities sum to one at every place, and within a class those of its words and one unknown word.
    places = language_model.Places.of([b"the cat ran the dog"], model.frequent)
    _, rows = next(places.blocks())
    every = [language_model._log_class(rows, np.full(len(rows[0]), k), model.weights, model.log_prior) for k in range(language_model.CLASSES)]
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(len(rows[0])), rel=1e-4)
    held = Counter()
    for r in counts.collect():
        held[int(model.class_of[language_model.ending(r["word"].encode()) if r["word"] else 0])] += r["c"] + 1
    for k, n in held.items():
        assert n + (k > 0) == pytest.approx(10 ** model.log_size[k])
    assert known


def test_add_rows():
    rng = np.random.default_rng(1)
    row, values = rng.integers(0, 9, 200).astype(np.uint16), rng.normal(size=(200, 4)).astype(np.float32)
    got, want = np.zeros((12, 4), np.float32), np.zeros((12, 4))
    language_model._add_rows(got.T, row, values.T)
    np.add.at(want, row, values)
    assert got == pytest.approx(want, abs=1e-5)


def test_add_rows_many_of_one_row():
    """One row of thousands of lines, rows of one line, and a last group that isn't full."""
    rng = np.random.default_rng(2)
    row = np.concatenate([np.full(5000, 7), rng.integers(0, 900, 3001), [899]]).astype(np.uint16)
    values = rng.normal(size=(len(row), 64)).astype(np.float32)
    got, want = np.ones((900, 64), np.float32), np.ones((900, 64))
    language_model._add_rows(got.T, row, values.T)
    np.add.at(want, row, values)
    assert got == pytest.approx(want, abs=1e-3)


def test_language_model_places():
    """Endings and hashes made for many words at once are those of each word, with and without the frequent words."""
    texts = [b"The cat, \xc3\xa9 a of", None, "漢 x cat café".encode(), b" \t\n"]
    frequent = language_model.Frequent.build([(b"cat", 5), (b"a", 3)], 4)
    for places in (language_model.Places.of(texts), language_model.Places.of(texts, frequent)):
        assert places.sizes.tolist() == [6, 1, 5, 1] and places.real.sum() == 13
        tokens = [w for t in texts for w in [*(t or b"").lower().split(), b""]]
        assert places.endings[places.real].tolist() == [language_model.ending(w) if w else 0 for w in tokens]
        assert places.hashed[places.real].tolist() == [zlib.crc32(w) for w in tokens]
    assert places.rest == [b"the", b"cat,", "é".encode(), b"of", "漢".encode(), b"x", "café".encode()]
    assert places.rest_counts().to_pylist()[0] == [{"word": w, "n": 1} for w in ("the", "cat,", "é", "of")]


def test_add_features():
    """A gradient's lines against single additions, over blocks that end within texts, among empty and short ones."""
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"cat", b"dogs", b"ran", b"of", b"a"], n)) for n in (0, 1, 2, 700, 0, 0, 5, 40)] + [None]
    places = language_model.Places.of(texts)
    got, want = np.zeros((language_model.ROWS, language_model.CLASSES), np.float32), np.zeros((language_model.ROWS, language_model.CLASSES))
    language_model.BLOCK, block = 100, language_model.BLOCK
    try:
        for at, rows in places.blocks():
            p = rng.normal(size=(len(at), language_model.CLASSES)).astype(np.float32)
            language_model._add_features(got, places, at, rows, p)
            for r in rows:
                np.add.at(want, r, p)
    finally:
        language_model.BLOCK = block
    assert got == pytest.approx(want, abs=1e-3) and np.abs(want).sum() > 0


def test_count_words_and_pairs(spark, odd):
    found = language_model.count_words(odd).collect()
    tokens, pairs = Counter(), Counter()
    for r in odd.collect():
        of = [*words(r["text"]), b""]
        tokens.update(of)
        endings = [0, *(language_model.ending(w) if w else 0 for w in of)]
        pairs.update(a * language_model.ENDINGS + b for a, b in zip(endings, endings[1:]))
    assert {r["word"].encode(): r["c"] for r in found if r["pair"] is None} == tokens
    assert {r["pair"]: r["c"] for r in found if r["word"] is None} == pairs
    assert len(found) == len(tokens) + len(pairs) and language_model.count_words(odd.limit(0)).count() == 0


def test_numbered_words():
    """Each word once with its number: white space at edges, other controls, slices of a column, no text at all."""
    texts = [" \tThe cat\x0b", None, "", "the\x1ccat \x85CAT É é", "cat " * 3, "skipped"]
    distinct, number, sizes = language_model.numbered(pa.array(["first", *texts])[1:-1])
    want = [words(t) for t in texts[:-1]]
    assert [distinct[i].as_py().encode() for i in number.tolist()] == [w for t in want for w in t]
    assert sizes.tolist() == [len(t) for t in want] and len(set(distinct.to_pylist())) == len(distinct)
    distinct, number, sizes = language_model.numbered(pa.array([], pa.string()))
    assert len(distinct) == len(number) == len(sizes) == 0


def test_checksums_of_words():
    """Checksums and endings of whole columns of words, short, long and empty, are those of each word."""
    found = ["", "a", "été", "of", "x" * language_model.SHORT, "y" * (language_model.SHORT + 1), "z" * 5000, "漢字", "cats."]
    for column in (pa.array(found), pa.array(["other", *found])[1:], pa.array([""]), pa.array([], pa.string())):
        each = [w.encode() for w in column.to_pylist()]
        assert language_model._checksums(column).tolist() == [zlib.crc32(w) for w in each]
        assert language_model._endings(column).tolist() == [language_model.ending(w) if w else 0 for w in each]


def test_language_model_gradient(spark, docs, monkeypatch):
    """Neither the places scored and summed together nor the way of looking up counts changes the scores."""
    scores = []
    for block, summed, looked_up in ((4096, 32_768, 16 << 20), (100, 350, 0)):
        monkeypatch.setattr(language_model, "BLOCK", block)
        monkeypatch.setattr(language_model, "SUMMED", summed)
        monkeypatch.setattr(language_model, "LOOKED_UP", looked_up)
        model, counts = language_model.train(docs)
        found = language_model.score(docs, model, counts, {"doc_id": F.col("doc_id")})
        assert ("ShuffledHashJoin" in found._jdf.queryExecution().toString()) == (looked_up > 0)
        scores.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in found.collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[1][i] == pytest.approx(scores[0][i], rel=1e-4) for i in scores[0])


def test_language_model_without_training(spark, odd):
    model, counts = language_model.train(odd.limit(0))
    found = language_model.score(odd, model, counts).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in found) and len(found) == odd.count()


# --- op3


def test_warc_round_trip(spark):
    page = "page_id long, url string, html string, record_type string"
    rows = [(5, "u5", "same", ""), (3, "u3", "same", ""), (4, None, None, ""), (9, "u\r\n9", "", ""), (3, "u3", "same", ""), (None, "n", "same", ""),
            (None, "n", "alone", ""), (7, "u7", "é漢🙂" * 50_000, ""), (8, "u8", "x" * 3_000_000, "")]
    folder = work_dir(spark, "warc-test")
    manifest = warc.write_warc(spark.createDataFrame(rows, page), folder, file_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 1
    found = warc.read_warc(spark, folder).collect()
    assert len(found) == len(rows)
    by = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert by[3, "response", None, 4] == 1 and by[3, "revisit", 3, 4] == 1 and by[5, "revisit", 3, 4] == 1 and by[None, "revisit", 3, 4] == 1
    assert by[4, "response", None, 0] == 1 and by[9, "revisit", 4, 0] == 1 and by[None, "response", None, 5] == 1
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert payloads[7] == ("é漢🙂" * 50_000).encode() and payloads[8] == b"x" * 3_000_000
    digests = {r["page_id"]: r["payload_digest"] for r in found}
    assert digests[4] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # of nothing
    again = work_dir(spark, "warc-test")
    second = warc.write_warc(spark.createDataFrame(rows[::-1], page).repartition(3), again, file_bytes=300)
    key = lambda m: sorted((r["file"], r["sha256"]) for r in m.collect())
    assert key(second) == key(manifest)
    empty = work_dir(spark, "warc-test")
    assert warc.write_warc(spark.createDataFrame([], page), empty).count() == 0 and warc.read_warc(spark, empty).count() == 0
    big = work_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, page), big, min_bytes=5)
    assert warc.read_warc(spark, big).where("record_type = 'revisit'").count() == 0


# --- op5

ALPHABET = ["a", "the", " ", "  ", "\n", "'s", "'re", "1", "²", "é", "漢", "🙂", "$", "###", "\x1c", "\x85", "<|endoftext|>", "<|end", "́", "٣", "_", "\r\n", "​"]


def test_bpe_against_library():
    library, vocabulary = Tokenizer.from_file(BPE), bpe.vocabulary(open(BPE, encoding="utf-8").read())
    rng, encoder, decoder = random.Random(4), bpe.Encoder(vocabulary, remembered=100), bpe.Decoder(vocabulary)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(bpe.encode_all(encoder, texts)) == want
    for ids in want:
        assert decoder.feed(ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)
    for _ in range(500):  # any ids at all: invalid bytes
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_bpe_pretokens_are_merged_once(monkeypatch):
    """Numbers, marks and words behind a line break are remembered too, whatever the bound and the order."""
    library, vocabulary = Tokenizer.from_file(BPE), bpe.vocabulary(open(BPE, encoding="utf-8").read())
    merged, merge = [], bpe.merge_short
    monkeypatch.setattr(bpe, "merge_short", lambda word, *rest: merged.append(word) or merge(word, *rest))
    text = "So 1234 (and) more,\nwords\u2003here's\n\n  x=77; word, word's 1234.\r\nwords\n"
    want = library.encode(text, add_special_tokens=False).ids
    encoder = bpe.Encoder(vocabulary)
    assert list(bpe.encode_all(encoder, [text, text])) == [want, want] and len(merged) == len(set(merged))
    monkeypatch.setattr(bpe, "PRETOKENS_HELD", 2)
    assert list(bpe.encode_all(bpe.Encoder(vocabulary, remembered=2), [text, None, text])) == [want, [], want]
    decoder = bpe.Decoder(vocabulary)
    assert decoder.feed([-5, *want[:3], 10**6, *want[3:]]) + decoder.finish() == text and decoder.feed([]) == ""


def test_bpe_streams_without_end(monkeypatch):
    library, vocabulary = Tokenizer.from_file(BPE), bpe.vocabulary(open(BPE, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "PIECE", 40)
    rng, encoder = random.Random(6), bpe.Encoder(vocabulary, window=vocabulary.reach + 100)
    for size in (1, 3, 30):
        for _ in range(150):
            one = rng.choice(ALPHABET).replace("<|endoftext|>", "q")
            text = "".join(one * 30 if rng.random() < 0.5 else rng.choice(ALPHABET) for _ in range(25)).replace("<|endoftext|>", "")
            got = [i for ids in encoder.stream(text[k : k + size] for k in range(0, len(text), size)) for i in ids]
            assert got == library.encode(text, add_special_tokens=False).ids


def test_bpe_lookahead_is_sufficient():
    vocabulary = bpe.vocabulary(open(BPE, encoding="utf-8").read())
    rng, letters = random.Random(8), [p for p in vocabulary.pieces.values() if p.isalpha()]
    for _ in range(60):
        data = b"".join(rng.choice(letters) for _ in range(400))
        cut = rng.randrange(vocabulary.reach + 50, len(data))
        whole = bpe.merge_long(data, vocabulary.byte_ids, vocabulary.merges)
        part, end = bpe.merge_long(data[:cut], vocabulary.byte_ids, vocabulary.merges), 0
        for a, b in zip(whole, part, strict=False):
            end += len(vocabulary.pieces[b])
            if end > cut - vocabulary.reach:
                break
            assert a == b


def test_bpe_round_trip_odd(spark, odd):
    library = Tokenizer.from_file(BPE)
    found = {r["doc_id"]: r for r in bpe.round_trip(odd, BPE, "doc_id").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for key, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[key]["n_tokens"] == len(ids) and found[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[key]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(odd, BPE, check="decodes")
    assert encoded.where("not decodes").count() == 0 and encoded.columns == ["doc_id", "text", "lang", "source", "score", "ids", "decodes"]
    decoded = bpe.decode(encoded, BPE)
    assert decoded.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.round_trip(odd.limit(0), BPE, "doc_id").count() == 0


# --- op6


def brute_print(text, size=4):
    found = words(text)
    if not found:
        return 0
    size = min(size, len(found))
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), seed=42) for i in range(len(found) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    own = sorted(set(prints.values()))
    root = {p: p for p in own}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(own):
        for q in own[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                root[find(p)] = find(q)
    least = {}
    for doc, p in prints.items():
        least[find(p)] = min(least.get(find(p), doc), doc)
    return {doc: (f"{p:016x}", least[find(p)]) for doc, p in prints.items()}


def test_simhash_brute_force(spark, docs, odd):
    both = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 1_000_000, "text")).distinct()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in both.collect()}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(both).collect()}
    assert found == brute_groups(prints)


@pytest.mark.parametrize("tile", [3, 1024])
def test_simhash_links_near_prints(spark, tile):
    rng = random.Random(9)
    prints = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    own = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in own]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, tile)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_groups(dict(zip(signed, own, strict=True)))
    assert {p: roots.get(p, p) for p in signed} == {p: w[1] for p, w in want.items()}


def test_simhash_odd(spark, odd):
    found = simhash.simhash_groups(odd).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == odd.count() and by[1]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert {by[i]["component_id"] for i in (5, 6, None)} == {5}
    alone = simhash.simhash_groups(odd.where("doc_id is null")).collect()
    assert [r["component_id"] for r in alone] == [None] and simhash.simhash_groups(odd.limit(0)).count() == 0


# --- op7


@pytest.fixture(scope="module")
def trees(spark):
    return page_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, SF).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))
        want = " ".join(html.unescape(plain).split())
        assert found[r["page_id"]]["text"] == want and found[r["page_id"]]["n_chars"] == len(want)


def test_main_text_sample_of_copies(spark, monkeypatch):
    """Hundreds of different pages give a whole sample, however often one of them is repeated."""
    asked = []
    monkeypatch.setattr(page_text, "_blocks", lambda html: asked.append(html) or [html])
    monkeypatch.setattr(page_text, "boost", lambda x, y: None)
    different = spark.range(400).selectExpr("concat('<p>Page ', id, ' with some words of its own.</p>') AS html")
    copies = spark.range(400_000).selectExpr("'<p>The page that is everywhere.</p>' AS html")
    page_text.learn(different.unionByName(copies))
    assert len(set(asked)) == page_text.SAMPLE


def test_main_text_of_other_layouts(trees):
    page = (
        '<body><div class="topnav"><a href=1>Home</a> <a href=2>News</a></div><div id="wrap"><div class="post-body"><p>First with some &eacute; words, and'
        ' more words here.</p><div class="ad">Buy now!</div><p>Second <b>bold</b>er paragraph<br>of text,   that is long enough.</p></div><div class="sidebar">'
        '<p>Other stuff to read</p></div></div><div class="comments"><div class="comment">I like this article a lot.</div></div><div id="footer">Copyright</div>'
    )
    want = "First with some é words, and more words here. Second bolder paragraph of text, that is long enough."
    odd_pages = ["", None, "<script>x<y</script>", "<p>One</p><p>Two", "just text", "<div " * 2000, "<div>" * 3000 + "deep", "<a href='x"]
    found = page_text.extract([page, *odd_pages], trees)
    assert found[0] == want and found[1:4] == ["", "", ""] and found[4] == "One Two" and found[5] == "just text"


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 8))
        parent = np.array([-1, *[int(rng.integers(0, v)) for v in range(1, n)]])
        odds, own = rng.normal(size=n) * 2, rng.integers(0, 50, n).astype(float)
        kept = page_text.decode(parent, odds, own)
        gain = odds * (1 + np.log1p(own))

        def value(states):
            for v in range(n):
                above = states[parent[v]] if v else 2
                if v == 0 and states[0] == 0 or above == 0 and states[v] != 0 or above == 1 and states[v] == 2:
                    return None
            return sum(g if s == 1 else -g if s == 0 else 0 for g, s in zip(gain, states, strict=True))

        every = [[(code // 3**v) % 3 for v in range(n)] for code in range(3**n)]
        best = max((x, s) for s in every if (x := value(s)) is not None)
        assert kept.tolist() == [s == 1 for s in best[1]]


def test_parse_never_fails():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<b", ">", "<!--", "-->", "<script>", "</script>", "text", "&amp;", "<li>", "</ul>", "<td>", "'", '"', "<br/>", "</", "<x y='>'>"]
    for _ in range(500):
        page = dom.parse("".join(rng.choice(parts) for _ in range(30)))
        assert all(e.parent < i for i, e in enumerate(page.elements))


# --- op9


def test_targets():
    assert mixing.targets([100, 100, 100], (5, 2, 1), 3) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000], (5, 2, 1), 3) == [30.0, 980.0]
    assert mixing.targets([], (5, 2, 1), 3) == [] and mixing.targets([0, 0], (5, 2, 1), 3) == [0.0, 0.0]


def test_mix_odd(spark, odd):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    sizes = sorted((r["doc_id"] or 0, r["size"]) for r in found)
    assert sizes == sorted((r["doc_id"] or 0, len(words(r["text"]))) for r in odd.collect())
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd.where("doc_id = 1")).first()["taken"] == 0
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_meets_targets(spark, docs):
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in found.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"]


def test_mix_needs_no_python(spark, tmp_path):
    """What the driver found is a local relation of the plan, not rows that Python workers of the executors copy."""
    rows = [(i, " ".join(["w"] * (i % 7)), s) for i in range(60) for s in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(path := f"{tmp_path}/docs")
    found = mixing.mix(spark.read.parquet(path))
    assert "ExistingRDD" not in plan(found) and "LocalTableScan" in plan(found)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, mixing.mix(docs).collect()))
    size = sum(i % 7 for i in range(60))
    assert {(r["source_size"], r["target"]) for r in found.collect()} == {(size, 3 * size * w / 8) for w in (5, 2, 1)}


# --- op10


def test_search_brute_force(spark, docs, odd):
    both = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 1_000_000, "text"))
    rows = [(r["doc_id"], words(r["text"])) for r in both.collect()]
    asked = both.where("doc_id % 10 = 0 or doc_id > 1000000 or doc_id is null")
    found = search.top_k(both, asked, k=5, query_words=2000)  # several blocks of queries
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    n, mean, df = len(rows), sum(len(w) for _, w in rows) / len(rows), Counter(w for _, ws in rows for w in set(ws))
    tf = [(d, len(ws), Counter(ws)) for d, ws in rows]
    for query, text in {(r["doc_id"], r["text"]) for r in asked.collect()}:
        want = []
        for d, size, c in tf:
            own = sum(
                math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 1.9 / (c[w] + 0.9 * (0.6 + 0.4 * size / mean)) for w in set(words(text)) if c[w]
            )
            if own > 0:
                want.append((-round(own, 9), 2**63 if d is None else d))
        if query is None or not want:
            assert query not in got
            continue
        assert [2**63 if d is None else d for d, _ in got[query]] == [d for _, d in sorted(want)[:5]]
        assert [s for _, s in got[query]] == pytest.approx([-s for s, _ in sorted(want)[:5]], abs=2e-9)
    assert search.top_k(both.limit(0), both.limit(0)).count() == 0


# --- SQL and pipeline


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    found = QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = db.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    key = lambda rows: Counter(tuple(r) for r in rows)
    assert sorted(names) == sorted(found.columns)
    assert key(result.fetchall()) == key(found.select(*names).collect())


def test_pipeline(spark, odd):
    given = odd.withColumn("_doc", F.lit("clash"))
    labels = "/root/testdata/sf0.001"
    kept = corpus_pipeline.language(spark, given, labels)
    assert kept.columns == given.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 8})
    good = corpus_pipeline.good_quality(spark, kept, labels)
    assert good.columns == given.columns
    once = corpus_pipeline.near_duplicates(spark, kept, labels)
    assert once.columns == given.columns
    texts = [r["text"] for r in once.collect()]
    assert len(texts) == len(set(texts)) and len(texts) < kept.count()
    groups = brute_groups({i: brute_print(t) for i, t in enumerate(r["text"] for r in kept.collect())})
    assert once.count() == len({g for _, g in groups.values()})
    mixed = corpus_pipeline.mixed(spark, once, labels)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(once).collect() if r["copies"]})
    last = corpus_pipeline.encoded(spark, mixed, labels)
    assert last.count() == mixed.count() and last.where("not decodes or n_tokens <> size(ids)").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), labels).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Texts that share an id are kept apart; of near copies one row stays, with the smallest id."""
    one, two, three, four = ["".join(random.Random(i).choice("abcdefgh ") for _ in range(400)) for i in range(4)]
    rows = [(6, one, "a"), (6, two, "a"), (6, one, "b"), (7, one, "a"), (5, three, "a"), (6, three, "a"), (8, four, "a"), (None, four, "a")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(6, one, "a"), (6, two, "a"), (5, three, "a"), (None, four, "a")], key=str)


def test_near_duplicates_sort_whole_rows_once(spark):
    """The rows that stay are looked up by hash; only the groups of equal ids and texts need an order."""
    rows = [(i, f"{random.Random(i).random()} words", "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert re.findall(r"(\w+Join) \[_own[^\n]*LeftSemi", plan(kept)) == ["ShuffledHashJoin"]
    assert set(map(tuple, kept.collect())) <= set(rows)


def test_pipeline_drops_texts_of_no_language(spark):
    """Unlearned scripts, random letters and base64 go, clean documents stay, held out or not."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(5)
    letters = lambda own, n: "".join(rng.choice(own) for _ in range(n))
    junk = [letters("漢字日本語中国人民大学", 300), "Ελληνικά γράμματα που κανείς δεν έμαθε " * 5, letters("абвгдежзиклмнопрст    ", 200)]
    junk += [letters("abcdefghijklmnopqrstuvwxyz", 200) for _ in range(20)]
    junk += [" ".join(letters("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 9)) for _ in range(60)) for _ in range(20)]
    junk += [base64.b64encode(rng.randbytes(300)).decode() for _ in range(20)]
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    rows = spark.createDataFrame([(first + i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    both = docs.unionByName(rows, allowMissingColumns=True)
    kept = corpus_pipeline.language(spark, both, sf)
    assert kept.columns == both.columns and kept.where(F.col("doc_id") >= first).count() == 0
    clean = docs.where(r"text rlike '\\p{L}'")
    assert kept.count() == clean.count()


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SF)
    assert 0 < found.count() <= 3 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_remainder(spark):
    rows = spark.createDataFrame([(1,), (None,), (77,)], "doc_id long").withColumn("r", remainder("doc_id", 5)).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(b"1") % 5, 0, zlib.crc32(b"77") % 5]
