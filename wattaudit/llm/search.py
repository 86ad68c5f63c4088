"""Exact top-k search by BM25: a stored inverted index, searched by block-max WAND in every shard, merged with global statistics.

The index is written once. A shard is one row: some thousand documents in order of length, the words they hold, and for each
word its postings in document order. Document counts of words and the mean length are summed over all shards first, so every
shard scores alike. Words of queries are numbered, and queries written as blocks of a bounded number of numbers, a row each, which
tasks read from the shared folder one after another; a shard looks up its words once, not for every block. Nothing of a query
passes through the driver.

Documents are numbered in blocks of a few, and a word has its largest impact within each block. For a query, a document's
upper bound is its exact sum over words that few documents hold, plus the block maxima of the frequent ones. The walk goes
through the shard in document order from pivot to pivot: the next document whose bound reaches the query's k-th best score so
far. Blocks whose bound stays below are passed over whole, and only pivots are scored, few of several queries at once. Without a
threshold, pivots of high bounds come first.

Shards are searched in three rounds, few shards first. After a round the k-th best score of each query over all shards so far
is the next round's threshold, so most shards are searched with a threshold close to the final one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattaudit.llm.base import slices, stored, texts, whole_groups, words
from wattaudit.llm.language_model import numbered
from wattaudit.llm.warc import open_fs
from wattaudit.operators.lookups import join_counted
from wattaudit.session import work_dir

K1, B = 0.9, 0.4
#: Documents of a shard and of a block, bytes of the texts of a shard; words of a block of queries.
SHARD, BLOCK, BYTES, QUERY_WORDS = 8192, 2, 32 << 20, 500_000
#: Rows and bytes of texts that are split into words at a time.
PART, PART_BYTES = 512, 2 << 20
#: A word in one of so many documents of a shard is frequent: it has its block maxima in a matrix, while that has no more rows and cells than these.
DENSE, ROWS, CELLS = 16, 2048, 4 << 20
#: Postings of a list from which on it is cut out once for a shard.
LONG = 12
#: Rounds: every 64th shard, every 8th of the others, the rest.
ROUNDS = (64, 8, 1)
#: Queries whose bounds are computed together, and whose pivots are scored together if they have so few places for them;
#: blocks scored for a first threshold, pivots scored at a time.
TOGETHER, GROUP, FEW, FIRST, STRIDE = 512, 32, 64, 16, 256
#: Impacts are multiples of 1 / UNIT, so that sums up to 65,536 are exact in any order; slack for the single-precision block bounds.
UNIT, SLACK = float(1 << 37), 5e-4
#: Decimals of a score.
DECIMALS = 9
NO_ID = 2**63 - 1

_INDEX = "round int, size long, total long, ids binary, lengths binary, words binary, counts binary, docs binary, tfs binary"
_FOUND = "query_id long, doc_id long, score double"
_ARRAYS = {"ids": np.int64, "ends": np.int64, "terms": np.int32, "numbers": np.int64, "idf": np.float64}


class Packer:
    """Gathers the rows of a shard as numbers; of the texts only the different words are held."""

    def __init__(self) -> None:
        self.ids, self.length, self.size = [], [], 0
        self.found: list[pa.Array] = []
        self.distinct = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: list[int | None], given: list[bytes | None]) -> None:
        found, word, length = numbered(pa.array(given, pa.binary()))
        code, tf = np.unique(np.repeat(np.arange(len(ids)), length) * len(found) + word, return_counts=True)
        if len(code):
            doc = (code // len(found) + len(self.ids)).astype(np.uint16)
            self.parts.append(((code % len(found) + self.distinct).astype(np.int32), doc, tf.astype(np.uint32)))
            self.found.append(found)
            self.distinct += len(found)
        self.ids += ids
        self.length += length.tolist()
        self.size += sum(len(t or b"") for t in given)

    def row(self) -> pa.RecordBatch:
        """The row of the shard: words joined by line feeds, which no word holds, and arrays as bytes."""
        length = np.array(self.length, np.int64)
        order = np.argsort(length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        none = (np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, np.uint32))
        term, doc, tf = (np.concatenate(c) for c in zip(none, *self.parts, strict=True))
        self.parts = []
        encoded = pa.concat_arrays([pa.array([], pa.string()), *self.found]).dictionary_encode()
        term = encoded.indices.to_numpy()[term]
        vocabulary = b"\n".join(encoded.dictionary.cast(pa.binary()).to_pylist())
        self.found, number = [], len(encoded.dictionary)
        doc = place[doc]
        sort = np.argsort(term.astype(np.int64) * len(order) + doc)
        mark = zlib.crc32(vocabulary)
        values = [
            next(i for i, n in enumerate(ROUNDS) if mark % n == 0), len(order), int(length.sum()),
            np.array([NO_ID if i is None else i for i in self.ids], np.int64)[order].tobytes(), length[order].tobytes(), vocabulary,
            np.bincount(term, minlength=number).astype(np.int32).tobytes(), doc[sort].astype(np.uint16).tobytes(),
            tf[sort].astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.uint32).tobytes(),
        ]
        types = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types, strict=True)],
            ["round", "size", "total", "ids", "lengths", "words", "counts", "docs", "tfs"],
        )


def index(docs: DataFrame) -> DataFrame:
    """Stored inverted index of ``docs`` (doc_id, text), a row per shard. Every text is read whole, once; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Packer()
        for whole in batches:
            for batch in slices(whole, PART, PART_BYTES):
                if shard.ids and (len(shard.ids) + batch.num_rows > SHARD or shard.size + batch.nbytes > BYTES):
                    yield shard.row()
                    shard = Packer()
                shard.add(batch.column(0).to_pylist(), texts(batch, 1))
        if shard.ids:
            yield shard.row()

    spark = docs.sparkSession
    path = work_dir(spark, "search-index")
    shards = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)
    # Rows are megabytes, so the writer looks at the size of a row group after each.
    shards.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def _words_of(row: bytes, counts: np.ndarray) -> pa.Array:
    return pa.array(row.split(b"\n") if len(counts) else [], pa.binary())


def word_documents(shards: DataFrame) -> DataFrame:
    """(word, df): number of documents that hold each word, summed over the shards of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, held in zip(batch.column(0), batch.column(1), strict=True):
                counts = np.frombuffer(held.as_py(), np.int32)
                found = _words_of(row.as_py(), counts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(counts.astype(np.int64))], ["word", "df"])

    return shards.select("words", "counts").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def _query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word) for the different words of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PART, PART_BYTES):
                found = [sorted(set(words(t))) for t in texts(part, 1)]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                flat = pa.array([w for f in found for w in f], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat], ["query_id", "word"])

    return queries.mapInArrow(run, "query_id long, word string")


def _files(folder: str) -> Iterator[tuple[str, fs.FileSystem]]:
    """Files of a folder that Spark wrote, in order of their names; none if it isn't there."""
    store, path = open_fs(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            yield f.path, store


def _read_block(folder: str, number: int, columns: list[str]) -> pa.Table | None:
    """Rows of one block of a table that Spark wrote by ``block``; None if there are none."""
    parts = []
    for name, store in _files(f"{folder}/block={number}"):
        with store.open_input_file(name) as file:
            parts.append(pq.ParquetFile(file).read(columns))
    return pa.concat_tables(parts) if parts else None


class Queries:
    """A block of queries: words of query i are ``terms[ends[i]:ends[i + 1]]``, positions in ``vocabulary``, or in ``numbers`` if words have numbers."""

    def __init__(self, asked: pa.Table, least: pa.Table | None):
        self.numbers = self.vocabulary = None
        if "number" in asked.column_names:
            self.numbers, term = np.unique(asked["number"].to_numpy(), return_inverse=True)
        else:
            encoded = asked["word"].cast(pa.binary()).combine_chunks().dictionary_encode()
            self.vocabulary, term = encoded.dictionary, encoded.indices.to_numpy()
        self.idf = np.zeros(int(term.max(initial=-1)) + 1)
        self.idf[term] = asked["idf"].to_numpy()
        self.ids, code = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        self.terms = term[np.lexsort((term, code))].astype(np.int32)
        self.ends = np.bincount(code, minlength=len(self.ids)).cumsum()
        self.ends = np.concatenate([[0], self.ends])
        self._start(least)

    def _start(self, least: pa.Table | None) -> None:
        self.least = np.zeros(len(self.ids))
        if least is not None:
            self.least[np.searchsorted(self.ids, least["query_id"].to_numpy())] = least["least"].to_numpy()

    def row(self, block: int) -> pa.RecordBatch:
        """A block of numbered words as one row, arrays as bytes."""
        values = [a.tobytes() for a in (self.ids, self.ends, self.terms, self.numbers, self.idf)]
        arrays = [pa.array([block], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
        return pa.RecordBatch.from_arrays(arrays, ["block", *_ARRAYS])

    @classmethod
    def of(cls, row: dict, least: pa.Table | None) -> Queries:
        q = cls.__new__(cls)
        q.ids, q.ends, q.terms, q.numbers, q.idf = (np.frombuffer(row[c], t) for c, t in _ARRAYS.items())
        q._start(least)
        return q


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``size`` numbers each, one after another."""
    ends = size.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Shard:
    """Postings of a shard; ``meet`` gives them the weights of a block of queries.

    Document i of the shard has the slot ``i % BLOCK * blocks + i // BLOCK``: slots of a block lie apart, so block maxima are
    taken for all blocks at once.
    """

    def __init__(self, row: dict, mean_length: float):
        self.ids, self.size = np.frombuffer(row["ids"], np.int64), row["size"]
        counts = np.frombuffer(row["counts"], np.int32)
        self.words = _words_of(row["words"], counts)
        self.counts = counts.astype(np.int64)
        self.start = np.concatenate([[0], self.counts.cumsum()])
        doc = np.frombuffer(row["docs"], np.uint16)
        tf = np.frombuffer(row["tfs"], np.uint16 if len(row["tfs"]) == len(row["docs"]) else np.uint32).astype(np.float64)
        norm = K1 * (1 - B + B * np.frombuffer(row["lengths"], np.int64) / max(mean_length, 1e-9))
        self.part = tf * (K1 + 1)
        tf += norm[doc]
        self.part /= tf
        self.impact = tf  # filled by ``meet`` for the words that queries ask for
        self.blocks = -(-self.size // BLOCK)
        self.slots = self.blocks * BLOCK
        self.slot = (np.arange(self.slots) % BLOCK * self.blocks + np.arange(self.slots) // BLOCK).astype(np.uint16)[doc]
        often = np.nonzero((self.counts * DENSE >= self.size) & (self.counts >= BLOCK))[0]
        often = often[np.argsort(-self.counts[often], kind="stable")][: min(ROWS, CELLS // max(self.blocks, 1))]
        self.row = np.full(len(counts), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.most = np.zeros((len(often), self.blocks), np.float32)
        self.met = np.zeros(len(counts), bool)
        # Slots and impacts of long lists as bytes, which are joined faster than arrays; ``view`` is the place of a word's.
        long = np.nonzero((self.counts >= LONG) & (self.row < 0))[0]
        self.view = np.full(len(counts), -1, np.int32)
        self.view[long] = np.arange(len(long))
        self.views = np.empty((2, len(long)), object)
        # Postings of frequent words once more, in document order.
        row_of = np.repeat(self.row, self.counts)
        dense = np.nonzero(row_of >= 0)[0].astype(np.int32)
        self.own = dense[np.argsort(doc[dense], kind="stable")]
        self.own_row = row_of[self.own].astype(np.int16)
        self.own_start = np.concatenate([[0], np.bincount(doc[dense], minlength=self.size).cumsum()])

    def know(self, folder: str) -> None:
        """Finds the numbers of the shard's words in the vocabulary of all queries, file by file."""
        numbers, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, store in _files(folder):
            with store.open_input_file(name) as file:
                given = pq.ParquetFile(file).read(["word", "number"])
            at = pc.index_in(given["word"].cast(pa.binary()).combine_chunks(), value_set=self.words)
            held = at.is_valid()
            numbers.append(given["number"].combine_chunks().filter(held).to_numpy())
            places.append(at.filter(held).to_numpy().astype(np.int64))
        numbers, places = np.concatenate(numbers), np.concatenate(places)
        order = np.argsort(numbers)
        self.numbers, self.places = numbers[order], places[order]

    def meet(self, q: Queries) -> None:
        """Finds the queries' words. Impacts of words that weren't met before, and block maxima of the frequent ones."""
        if q.numbers is None:
            self.term = pc.index_in(q.vocabulary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        else:
            at = np.minimum(np.searchsorted(self.numbers, q.numbers), max(len(self.numbers) - 1, 0))
            self.term = np.where(self.numbers[at] == q.numbers, self.places[at], -1) if len(self.numbers) else np.full(len(q.numbers), -1)
        at = np.nonzero(self.term >= 0)[0]
        at = at[~self.met[self.term[at]]]
        fresh = self.term[at]
        self.met[fresh] = True
        size = self.counts[fresh]
        at, idf, row = _ranges(self.start[fresh], size), np.repeat(q.idf[at], size), np.repeat(self.row[fresh], size)
        impact = np.maximum(np.rint(idf * self.part[at] * UNIT), 1) / UNIT
        self.impact[at] = impact
        for w in fresh[self.view[fresh] >= 0].tolist():
            cut = slice(self.start[w], self.start[w + 1])
            self.views[:, self.view[w]] = self.slot[cut].tobytes(), self.impact[cut].tobytes()
        dense = row >= 0
        np.maximum.at(self.most, (row[dense], self.slot[at[dense]] % self.blocks), impact[dense].astype(np.float32))

    def scored(self, docs: np.ndarray, lists: np.ndarray, use: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores of documents for queries, whose sums over the words that aren't frequent are ``lists``; ``use`` marks the frequent words of each query."""
        size = self.own_start[docs + 1] - self.own_start[docs]
        at = _ranges(self.own_start[docs], size)
        each = np.repeat(np.arange(len(docs)), size)
        weight = self.impact[self.own[at]] * use[query[each], self.own_row[at]]
        return np.round(lists + np.bincount(each, weight, len(docs)), DECIMALS)

    def search(self, q: Queries, first: int, last: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries first to last, the best k documents of the shard that score ``q.least`` or more, with all ties of the last, and their scores."""
        query = np.repeat(np.arange(last - first), np.diff(q.ends[first : last + 1]))
        term = self.term[q.terms[q.ends[first] : q.ends[last]]]
        query, term = query[term >= 0], term[term >= 0]
        row = self.row[term]
        use = np.zeros((last - first, len(self.most)), np.float32)
        use[query[row >= 0], row[row >= 0]] = 1
        most = use @ self.most
        query, term = query[row < 0], term[row < 0]
        least = q.least[first:last]
        enough = np.maximum(least - SLACK * (1 + np.abs(least)), np.finfo(float).tiny).tolist()
        for some in range(0, last - first, GROUP):
            many = range(some, min(some + GROUP, last - first))
            of = slice(*np.searchsorted(query, [many.start, many.stop]))
            few = []
            for i, lists in zip(many, self._sums(query[of] - some, term[of], len(many)), strict=True):
                bound = lists.max(axis=0) + most[i]
                blocks = np.nonzero(bound >= enough[i])[0]
                if len(blocks):
                    if least[i] and len(blocks) * BLOCK <= FEW:
                        upper = lists[:, blocks]
                        inside, at = np.nonzero(upper + most[i, blocks] >= enough[i])
                        few.append((np.full(len(at), i), blocks[at] * BLOCK + inside, upper[inside, at]))
                    else:
                        yield first + i, *self._walk(lists, bound, most[i], use, i, float(least[i]), k)
            if few:
                of, docs, sums = map(np.concatenate, zip(*few, strict=True))
                of, docs, sums = (x[docs < self.size] for x in (of, docs, sums))
                scores = self.scored(docs, sums, use, of)
                good = (scores > 0) & (scores >= least[of])
                of, docs, scores = of[good], docs[good], scores[good]
                for i in np.unique(of):
                    own, found = scores[of == i], docs[of == i]
                    if len(own) > k:
                        own, found = own[keep := own >= np.partition(own, -k)[-k]], found[keep]
                    yield first + i, self.ids[found], own

    def _sums(self, query: np.ndarray, term: np.ndarray, many: int) -> Iterator[np.ndarray]:
        """For each query, sums over the postings of its words ``term``, by place in the block and block."""
        view, each = self.view[term], np.arange(many + 1)
        slots, impacts = self.views[:, view[view >= 0]].tolist()
        starts = np.searchsorted(query[view >= 0], each).tolist()
        query, term = query[view < 0], term[view < 0]
        size = self.counts[term]
        at = _ranges(self.start[term], size)
        slot, impact = self.slot[at], self.impact[at]
        ends = np.concatenate([[0], size.cumsum()])[np.searchsorted(query, each)].tolist()
        for i in range(many):
            own, cut = slice(starts[i], starts[i + 1]), slice(ends[i], ends[i + 1])
            x = np.frombuffer(b"".join([*slots[own], slot[cut].tobytes()]), np.uint16)
            y = np.frombuffer(b"".join([*impacts[own], impact[cut].tobytes()]))
            yield np.bincount(x, y, self.slots).reshape(BLOCK, -1)

    def _walk(self, lists: np.ndarray, bound: np.ndarray, most: np.ndarray, use: np.ndarray, query: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From pivot to pivot in document order. ``lists`` are sums over the words that aren't frequent by place in block and block."""

        def enters(values: np.ndarray) -> np.ndarray:
            return (values > 0) & (values >= least - SLACK * (1 + abs(least)))

        def scored(docs: np.ndarray) -> np.ndarray:
            return self.scored(docs, lists[docs % BLOCK, docs // BLOCK], use, np.full(len(docs), query))

        unknown = not least
        if unknown and self.size > k:
            n = min(max(FIRST, -(-k // BLOCK)), self.blocks)
            some = np.argpartition(-bound, n - 1)[:n]
            own = (some[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            own = scored(own[own < self.size])
            least = max(0.0, np.partition(own, -k)[-k]) if len(own) >= k else 0.0
        blocks = np.nonzero(enters(bound))[0]
        upper = lists[:, blocks].T + most[blocks, None]
        at, inside = np.nonzero(enters(upper))
        pivots, upper = blocks[at] * BLOCK + inside, upper[at, inside]
        pivots, upper = pivots[pivots < self.size], upper[pivots < self.size]
        if unknown:  # a low threshold rises soonest by high bounds
            order = np.argsort(-upper, kind="stable")
            pivots, upper = pivots[order], upper[order]
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(pivots), STRIDE):
            some = pivots[first : first + STRIDE][enters(upper[first : first + STRIDE])]
            own = scored(some)
            good = (own > 0) & (own >= least)
            docs, scores = np.concatenate([docs, some[good]]), np.concatenate([scores, own[good]])
            if len(scores) > k:
                least = max(least, np.partition(scores, -k)[-k])
                docs, scores = docs[scores >= least], scores[scores >= least]
        return self.ids[docs], scores


def _searcher(folder: str, vocabulary: str, bounds: str | None, blocks: int, mean_length: float, k: int) -> object:
    """Every block of queries against every shard; what a shard finds for a block is handed over at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], mean_length)
                shard.know(vocabulary)
                for number in range(blocks):
                    asked = _read_block(folder, number, list(_ARRAYS))
                    if asked is not None:
                        yield from _best(shard, Queries.of(asked.to_pylist()[0], _read_block(bounds, number, ["query_id", "least"]) if bounds else None), k)

    return run


def _best(shard: Shard, q: Queries, k: int) -> Iterator[pa.RecordBatch]:
    shard.meet(q)
    for first in range(0, len(q.ids), TOGETHER):
        query, docs, scores = [], [], []
        for i, doc, score in shard.search(q, first, min(first + TOGETHER, len(q.ids)), k):
            order = np.lexsort((doc, -score))[:k]
            query.append(np.full(len(order), q.ids[i]))
            docs.append(doc[order])
            scores.append(score[order])
        if query:
            doc = np.concatenate(docs)
            found = [pa.array(np.concatenate(query)), pa.array(doc, mask=doc == NO_ID), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(found, ["query_id", "doc_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_block(rows: DataFrame, blocks: int, name: str, pack: bool = False) -> str:
    """Rows with query_id written in folders by block of queries, or each block as one row; the folder of all."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches):
            for block in some["block"].unique().to_pylist():
                yield Queries(some.filter(pc.equal(some["block"], block)), None).row(block)

    path = work_dir(rows.sparkSession, name)
    rows = rows.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "*")
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "query_id")
    if pack:
        rows = rows.mapInArrow(packed, "block int, " + ", ".join(f"{c} binary" for c in _ARRAYS))
    rows.write.partitionBy("block").parquet(path)
    return path


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_words: int = QUERY_WORDS) -> DataFrame:
    """(query_id, rank, doc_id, score) of the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``queries`` (same columns).

    A query is its whole text: the sum over its different words of their BM25 weights. Rank is by score, then doc_id;
    a row without doc_id ranks last among equals. Only rows that share a word with the query are found, so a null or empty
    query finds nothing, and fewer than ``k`` rows may be found. A query that is a document finds itself. Rows of
    ``queries`` that repeat an id are one query, the smallest text; those without id are none.
    """
    shards = index(docs)
    total, length = shards.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = queries.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("query_id")).agg(F.min("text").alias("text"))
    asked = stored(_query_words(asked), "query-words")
    idf = F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    asked_by = asked.groupBy("word").agg(F.count(F.lit(1)).alias("asked"))
    blocks = max(1, -(-asked.count() // query_words))
    vocabulary = work_dir(docs.sparkSession, "query-vocabulary")
    known = word_documents(shards).join(asked_by, "word").select("word", idf, "asked").repartition(blocks, "word")
    known.withColumn("number", F.monotonically_increasing_id()).write.parquet(vocabulary)
    known = docs.sparkSession.read.schema("word string, idf double, asked long, number long").parquet(vocabulary)
    joined = join_counted(asked, known, ["word"], "asked", "inner").select("query_id", "number", "idf")
    folder = _by_block(joined, blocks, "query-blocks", pack=True)
    found, bounds = None, None
    for number in range(len(ROUNDS)):
        if found is not None:
            least = _ranked(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            bounds = _by_block(least.where(F.col("n") == k).select("query_id", "least"), blocks, "query-bounds")
        run = _searcher(folder, vocabulary, bounds, blocks, length / max(total, 1), k)
        part = stored(shards.where(F.col("round") == number).mapInArrow(run, _FOUND), "found")
        found = part if found is None else found.union(part)
    return _ranked(found, k).select("query_id", "rank", "doc_id", "score")
