"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | text before) = P(class | text before) * P(word | class). Classes group words that end alike and follow alike. The
class factor is a softmax over hashed n-gram features (the word before, the two words before) and skip features (the
endings of the words one to four places back); its weights start from counts and are trained by gradients summed over all
training texts in Spark. The word factor is a softmax with one bias per word, whose best value is known: the logarithm
of its count plus one, with one more place per class for all unknown words.

Words are looked up without a broadcast of the vocabulary: a bounded number of frequent words goes to every task, all
others are joined by word. Counts, endings, features and gradients cover every training text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import slices, stored

#: Words that make up at least one in so many tokens go to every task; there are at most so many.
FREQUENT = 100_000
#: Kinds of word endings, classes, and buckets of each hashed feature.
ENDINGS, CLASSES, BUCKETS = 512, 64, 8192
#: Places back whose endings are features; a text is preceded by as many empty places.
SKIPS = 4
ROWS = SKIPS * ENDINGS + 2 * BUCKETS
FEATURES = SKIPS + 2
#: Share of the weight that a count's logarithm gets at the start; rounds of gradients, their step and its limit.
START, ROUNDS, STEP, MOST = 0.45, 2, 0.35, 0.5
#: Bytes of words whose checksums are made together.
SHORT = 32
#: Places scored at a time, and those whose gradients are summed together.
BLOCK, SUMMED = 4096, 32_768
#: Texts that are split or scored together, and their bytes; the same where words are only counted.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 20
COUNT_ROWS, COUNT_BYTES = 65_536, 8 << 20
#: Bytes of counted words that a partition of a join may hold, on average, to be looked up in memory.
LOOKED_UP = 16 << 20
END = b""


def ending(word: bytes) -> int:
    """Kind of a word's ending, 1 to ENDINGS - 1: its last three bytes, marks included."""
    return 1 + zlib.crc32(word[-3:]) % (ENDINGS - 1)


#: What a byte adds to a checksum: zlib's table, from its checksums of single bytes.
_CRC = ~np.array([zlib.crc32(bytes([255 ^ b])) for b in range(256)], np.uint32) ^ np.uint32(0x00FFFFFF)


def _bytes(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each word begins among them, and its length."""
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8), ends[:-1], np.diff(ends)


def _endings(found: pa.Array) -> np.ndarray:
    """``ending`` of each word, 0 for END; the checksums of all last bytes, then of all bytes before them, in one go."""
    data, first, size = _bytes(found)
    last = first + size - 1
    crc = np.full(len(found), 0xFFFFFFFF, np.uint32)
    for back in (2, 1, 0):
        more = _CRC[(crc ^ data.take(last - back, mode="clip")) & np.uint32(255)] ^ crc >> np.uint32(8)
        crc = np.where(size > back, more, crc)
    return np.where(size > 0, 1 + ~crc % np.uint32(ENDINGS - 1), 0).astype(np.int32)


def _checksums(found: pa.Array) -> np.ndarray:
    """``zlib.crc32`` of each word; of short words the first bytes, then the next ones, in one go."""
    data, first, size = _bytes(found)
    order = np.argsort(-np.where(size > SHORT, 0, size), kind="stable")
    left = len(found) - np.bincount(size[size <= SHORT], minlength=1).cumsum() - (size > SHORT).sum()
    crc, at = np.full(len(found), 0xFFFFFFFF, np.uint32), first[order]
    for k, n in enumerate(left[left > 0].tolist()):  # the words that have more than k bytes
        now = crc[:n]
        crc[:n] = _CRC[(now ^ data[at[:n] + k]) & np.uint32(255)] ^ now >> np.uint32(8)
    out = np.empty(len(found), np.uint32)
    out[order] = ~crc
    for i in np.nonzero(size > SHORT)[0].tolist():
        out[i] = zlib.crc32(data[first[i] : first[i] + size[i]])
    return out


def numbered(texts_: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word among them, and how many words each text has.

    These are the words that ``words`` finds, in order; what depends on a word alone is then made once for each distinct one.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts_.cast(pa.string()), "")))
    flat, ends = split.flatten(), split.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy() > 0  # white space at a text's edge leaves an empty piece
    before = np.concatenate([[0], real.cumsum()])
    coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(before[ends])


@dataclass
class Frequent:
    """The frequent words with their counts; position i of ``log_count`` belongs to word i, the last one to END."""

    found: pa.Array
    log_count: np.ndarray

    @staticmethod
    def build(counts: list[tuple[bytes, int]], ends: int) -> Frequent:
        found = sorted(counts)
        return Frequent(
            pa.array([w for w, _ in found], pa.binary()).cast(pa.string()),
            np.log10(np.array([c for _, c in found] + [ends], np.float64) + 1),
        )


@dataclass
class Places:
    """Texts one after the other, each preceded by SKIPS empty places and followed by its end."""

    known: np.ndarray  # position among the frequent words, -1 for others and empty places
    hashed: np.ndarray
    endings: np.ndarray
    real: np.ndarray  # places that hold a token
    distinct: pa.Array  # the distinct words
    rest_at: np.ndarray  # the number among them of each word that isn't frequent, in order
    rest_of: np.ndarray  # the text each of these words is in
    sizes: np.ndarray  # tokens of each text

    @staticmethod
    def of(texts_: pa.Array | list[bytes | None], frequent: Frequent | None = None) -> Places:
        """Without ``frequent`` no word is looked up: ``known`` is -1 everywhere and ``rest`` holds all words."""
        distinct, number, counts = numbered(texts_ if isinstance(texts_, pa.Array) else pa.array(texts_, pa.binary()))
        starts = np.concatenate([[0], np.cumsum(counts + 1 + SKIPS)]).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        where = np.arange(len(number)) + np.repeat(starts[:-1] + SKIPS - before, counts)
        known = np.full(starts[-1], -1, np.int32)
        hashed, endings, real = np.zeros(starts[-1], np.uint32), np.zeros(starts[-1], np.int32), np.zeros(starts[-1], bool)
        rest_at, rest_of = number, np.repeat(np.arange(len(counts)), counts)
        if frequent:
            at = pc.index_in(distinct, frequent.found).fill_null(-1).to_numpy()[number]
            known[where], other = at, at < 0
            rest_at, rest_of = number[other], rest_of[other]
        hashed[where] = _checksums(distinct)[number]
        endings[where] = _endings(distinct)[number]
        real[where] = True
        last = starts[1:] - 1
        known[last], real[last] = len(frequent.found) if frequent else -1, True
        return Places(known, hashed, endings, real, distinct, rest_at, rest_of, counts + 1)

    @property
    def rest(self) -> list[bytes]:
        """The words that aren't frequent, in order."""
        return self.distinct.take(pa.array(self.rest_at)).cast(pa.binary()).to_pylist()

    def rest_counts(self) -> pa.Array:
        """Per text the words that aren't frequent, with how often they occur in it."""
        step = max(1, len(self.distinct))
        pairs, n = np.unique(self.rest_of * step + self.rest_at, return_counts=True)
        ends = (pairs // step).searchsorted(np.arange(len(self.sizes) + 1)).astype(np.int32)
        found = self.distinct.take(pa.array(pairs % step))
        items = pa.StructArray.from_arrays([found, pa.array(n, pa.int64())], ["word", "n"])
        return pa.ListArray.from_arrays(ends, items)

    def blocks(self, size: int | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Positions of tokens with the row numbers of their features, some thousand (``BLOCK``) at a time."""
        at, size = np.nonzero(self.real)[0], size or BLOCK
        for start in range(0, len(at), size):
            t = at[start : start + size]
            one, two = self.hashed[t - 1], self.hashed[t - 2]
            rows = [k * ENDINGS + self.endings[t - 1 - k] for k in range(SKIPS)]
            rows.append(SKIPS * ENDINGS + (one * np.uint32(2654435761) >> np.uint32(16)) % BUCKETS)
            pair = one * np.uint32(2654435761) ^ two * np.uint32(2246822519)
            rows.append(SKIPS * ENDINGS + BUCKETS + (pair ^ pair >> np.uint32(15)) % BUCKETS)
            yield t, [r.astype(np.uint16) for r in rows]


@dataclass
class Model:
    """What scoring needs besides the table of counts; all sizes are bounded by parameters."""

    tokens: int
    distinct: int
    size: int  # bytes of the table of counts, about
    frequent: Frequent
    class_of: np.ndarray  # by ending; END has class 0 for itself
    log_prior: np.ndarray
    log_size: np.ndarray  # log10 of the softmax sums of the word factors
    weights: np.ndarray
    small: bool  # whether no logit leaves the range of exp


def _classes(places: Places, class_of: np.ndarray) -> np.ndarray:
    return class_of[places.endings]


_ROOM: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
    """An array whose memory is used again by the next call of the same name; fresh memory costs more than the sums."""
    size = math.prod(shape)
    if name not in _ROOM or _ROOM[name].size < size:
        _ROOM[name] = np.empty(size, kind)
    return _ROOM[name][:size].reshape(shape)


def _small(weights: np.ndarray, log_prior: np.ndarray) -> bool:
    """Whether no sum of weights leaves the range of ``exp`` in single precision."""
    return bool(np.abs(weights).max() * FEATURES + np.abs(log_prior).max() < 80)


def _exp_logits(rows: list[np.ndarray], own: np.ndarray, weights: np.ndarray, log_prior: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the logits of all classes at some places, their sums, and the logit of the class ``own``.

    Unless all logits are ``small``, the largest of each place is taken off. The first lies in memory that is used again.
    """
    z, more = _room("logits", len(own), weights.shape[1]), _room("more", len(own), weights.shape[1])
    first = weights[:ENDINGS] + log_prior  # the first feature of every place is an ending
    first.take(rows[0], axis=0, mode="clip", out=z)
    for r in rows[1:]:
        z += weights.take(r, axis=0, out=more, mode="clip")
    if not small:
        z -= z.max(axis=1, keepdims=True)
    value = z[np.arange(len(own)), own]
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype), value


def _log_class(rows: list[np.ndarray], own: np.ndarray, weights: np.ndarray, log_prior: np.ndarray, small: bool = False) -> np.ndarray:
    """Logarithm of the probability of the class ``own`` at each place."""
    _, total, value = _exp_logits(rows, own, weights, log_prior, small)
    return value - np.log(total)


def _add_rows(sums: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """Add each line of ``values.T`` to the line of ``sums.T`` that ``row`` names."""
    for own, value in zip(sums, values, strict=True):
        own += np.bincount(row, value, len(own))


def _add_features(sums: np.ndarray, places: Places, at: np.ndarray, rows: list[np.ndarray], p: np.ndarray) -> None:
    """Add each line of ``p``, one for each of the places ``at``, to the lines of ``sums`` that ``rows`` name.

    It is done class by class, so ``p`` and ``sums`` had better hold each class's numbers together.
    """
    for k in range(SKIPS):
        _add_rows(sums[k * ENDINGS : (k + 1) * ENDINGS].T, places.endings[at - 1 - k].astype(np.intp), p.T)
    for k, r in enumerate(rows[SKIPS:]):
        first = SKIPS * ENDINGS + k * BUCKETS
        _add_rows(sums[first : first + BUCKETS].T, r.astype(np.intp) - first, p.T)


def _vectors(sums: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    sums = np.ascontiguousarray(sums)
    rows = np.nonzero(seen)[0]
    data = pa.array([sums[r].tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), data], ["row", "sums"])


def _gathered(docs: DataFrame, shape: tuple[int, int], add: Callable) -> np.ndarray:
    """Sum over all texts of what ``add(sums, places)`` adds to a matrix; summed by row in Spark, then collected.

    A task returns the rows it has touched; the reduction is by row number, so it is even. The matrix is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape[::-1], np.float32).T  # what is added comes class by class
        for whole in batches:
            for part in slices(whole, SLICE_ROWS, SLICE_BYTES):
                add(sums, Places.of(part.column(0)))
        yield _vectors(sums, sums.any(axis=1))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = {}, np.zeros(shape[0], bool)
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.float32)
                sums[row] = sums[row] + own if seen[row] else own.astype(np.float64)
                seen[row] = True
        rows = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array([sums[r].astype(np.float32).tobytes() for r in rows], pa.binary())], ["row", "sums"]
        )

    schema = "row int, sums binary"
    out = np.zeros(shape, np.float32)
    for row, data in docs.select("text").mapInArrow(run, schema).repartition("row").mapInArrow(reduce, schema).collect():
        out[row] = np.frombuffer(data, np.float32)
    return out


def _cluster(pairs: np.ndarray, wanted: int) -> np.ndarray:
    """Class of each ending, 1 to wanted - 1, by what comes before and after it; kind 0 (END) is class 0."""
    both = np.hstack([pairs, pairs.T])[1:].astype(np.float64)
    weight = both.sum(axis=1)
    total = max(weight.sum(), 1.0)
    expected = np.outer(weight, both.sum(axis=0)) / total
    affinity = np.log(np.maximum(both, 1e-9) / np.maximum(expected, 1e-9)).clip(0) * (both > 0)
    u, s, _ = np.linalg.svd(affinity, full_matrices=False)
    points = u[:, :16] * s[:16]
    order = np.argsort(-weight, kind="stable")
    centers = points[order[: wanted - 1]].copy()
    label = np.zeros(len(points), np.int64)
    for _ in range(25):
        label = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centers)):
            own = label == c
            if weight[own].sum() > 0:
                centers[c] = np.average(points[own], axis=0, weights=weight[own])
    return np.concatenate([[0], label + 1])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, pair, c) of all texts: how often each word occurs, with no pair, and how often an ending follows another.

    The empty word stands for the end that every text has. A pair is ``ENDINGS`` times the former ending plus the
    latter, with no word; ends and what is before a text have ending 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(ENDINGS * ENDINGS, np.int64)

        def batch(found: pa.Array | None, pair: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            word = found if found is not None else pa.nulls(len(n), pa.string())
            pair = pa.array(pair, pa.int32()) if pair is not None else pa.nulls(len(n), pa.int32())
            return pa.RecordBatch.from_arrays([word, pair, pa.array(n, pa.int64())], ["word", "pair", "n"])

        for whole in batches:
            for part in slices(whole, COUNT_ROWS, COUNT_BYTES):
                distinct, number, sizes = numbered(part.column(0))
                endings = np.zeros(len(number) + len(sizes), np.int32)
                endings[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = _endings(distinct)[number]
                endings[1:] += ENDINGS * endings[:-1]
                pairs += np.bincount(endings, minlength=ENDINGS * ENDINGS)
                yield batch(distinct, None, np.bincount(number, minlength=len(distinct)))
                yield batch(pa.array([END.decode()]), None, np.array([len(sizes)]))
        seen = np.nonzero(pairs)[0]
        yield batch(None, seen.astype(np.int32), pairs[seen])

    return docs.select("text").mapInArrow(run, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("c"))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model of the texts of ``docs`` and the table (word, c) of their counts. A null text is empty: an end alone.

    Without any row the model is uniform over classes and knows no word.
    """
    spark = docs.sparkSession
    both = stored(count_words(docs), "word-counts")
    counts = both.where("pair IS NULL").select("word", "c")
    tokens, distinct, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()
    top = counts.where((F.col("c") * FREQUENT >= tokens) | (F.col("word") == "")).collect()
    ends = next((r[1] for r in top if not r[0]), 0)
    frequent = Frequent.build([(r[0].encode(), r[1]) for r in top if r[0]], ends)

    followed = both.where("word IS NULL").select("pair", "c").toArrow()
    pairs = np.zeros(ENDINGS * ENDINGS)
    pairs[followed.column(0).to_numpy()] = followed.column(1).to_numpy()
    class_of = _cluster(pairs.reshape(ENDINGS, ENDINGS), CLASSES)

    def add_counts(sums: np.ndarray, places: Places) -> None:
        own, codes = _classes(places, class_of), []
        for t, rows in places.blocks():
            codes += [own[t].astype(np.int32) * ROWS + r for r in rows]
        sums += np.bincount(np.concatenate(codes), minlength=CLASSES * ROWS).reshape(CLASSES, ROWS).T

    seen = _gathered(docs, (ROWS, CLASSES), add_counts)
    of_class = seen[:ENDINGS].sum(axis=0).astype(np.float64)
    prior = (of_class + 0.5) / (of_class.sum() + 0.5 * CLASSES)
    log_prior = np.log(prior).astype(np.float32)
    of_row = seen.sum(axis=1, keepdims=True)
    weights = (START * np.log((seen + 20 * prior) / (of_row + 20) / prior)).astype(np.float32)

    for number in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)
        small = _small(weights, log_prior)

        def add_gradient(sums: np.ndarray, places: Places, now: Broadcast = now, small: bool = small) -> None:
            own = _classes(places, class_of)
            for t, rows in places.blocks(SUMMED):
                each = _room("each", CLASSES, len(t), kind=np.float64)
                for start in range(0, len(t), BLOCK):
                    part = slice(start, start + BLOCK)
                    p, total, _ = _exp_logits([r[part] for r in rows], own[t[part]], now.value, log_prior, small)
                    p /= total[:, None]
                    each[:, part] = p.T
                each[own[t], np.arange(len(t))] -= 1
                _add_features(sums, places, t, rows, each.T)

        # Each round takes its share of the texts, so that every text adds to one gradient.
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number)
        gradient = _gathered(part, (ROWS, CLASSES), add_gradient)
        weights = weights - np.clip(STEP * ROUNDS * gradient / (seen + 20 * prior), -MOST, MOST).astype(np.float32)
        now.unpersist()

    known_class = spark.sparkContext.broadcast(class_of)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own = known_class.value[_endings(batch.column(0).cast(pa.string()))]
            n += np.bincount(own, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    sizes = np.ones(CLASSES)
    sizes[0] = 0  # END is the only word of its class
    for k, n, v in counts.mapInArrow(classed, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        sizes[k] += n + v
    log_size = np.log10(np.maximum(sizes, 1))
    return Model(tokens, distinct, size, frequent, class_of, log_prior, log_size, weights, _small(weights, log_prior)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row, with the columns ``keep`` of ``docs``.

    Every row is scored by its whole text (null: an end alone), repeated rows and null ids included. ``base_score`` is
    the logarithm of base 10 of the add-one unigram probability, ``score`` that of the model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_text"))
    at = len(given.columns) - 1
    found = {"n_tokens": "long", "n_known": "long", "logs": "double", "classes": "double", "rest": "array<struct<word:string,n:long>>"}
    schema = given.drop("_text").withColumns({n: F.lit(None).cast(t) for n, t in found.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for batch in slices(whole, SLICE_ROWS, SLICE_BYTES):
                places = Places.of(batch.column(at), m.frequent)
                own = _classes(places, m.class_of)
                value, logs = np.zeros(len(own)), np.zeros(len(own))
                for t, rows in places.blocks():
                    log_p = _log_class(rows, own[t], m.weights, m.log_prior, m.small)
                    value[t] = log_p / np.log(10) - m.log_size[own[t]]
                known = places.real & (places.known >= 0) & (m.tokens > 0)
                logs[known] = m.frequent.log_count[places.known[known]]
                ends = np.cumsum(places.sizes + SKIPS)
                starts = np.concatenate([[0], ends[:-1]])
                columns = [
                    *batch.columns[:at], pa.array(places.sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(value, starts)), places.rest_counts(),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    partial = stored(given.mapInArrow(run, schema), "scored")
    rest = partial.select("_row", F.explode("rest").alias("r")).select("_row", "r.word", "r.n")
    # Counts that are small in every partition need not be sorted, nor the words that look for them.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked_up = counts.hint("shuffle_hash") if model.size <= LOOKED_UP * parts else counts
    joined = rest.join(looked_up, "word").groupBy("_row").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs")
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = np.log10(model.tokens + model.distinct + 1)
    return (
        partial.drop("rest").join(joined, "_row", "left")
        .withColumn("train_tokens", F.lit(model.tokens).cast("long"))
        .withColumn("base_score", logs - F.col("n_tokens") * F.lit(float(base)))
        .withColumn("score", F.col("classes") + logs)
        .withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
        .select(*(keep or {}), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
