"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Text goes in piece by piece; ids come out as soon as nothing that may follow can change them. How far back a following
byte can reach is a property of the merge list alone (``lookahead``), so a pretoken without end, such as a megabyte of
letters, needs a window of constant size. Decoding keeps at most three bytes: those of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handed to the transducer at a time.
PIECE = 65_536
#: Words whose ids are remembered; twice as many are held at most.
REMEMBERED = 128_000
#: Other short pretokens whose ids are remembered.
PRETOKENS_HELD = 30_000
#: Words merged in lockstep, and characters of texts whose words are gathered for it.
LOCKSTEP, GATHERED = 8192, 500_000
#: A merge is one number: its rank above, the new id in the low bits.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 60
#: Rows of a batch that is returned, times their mean bytes, stay below this.
BATCH_BYTES = 2_000_000

# The splitting pattern of byte-level BPE files of this kind is fixed by their format.
PRETOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
#: Neither letters nor numbers nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: No pattern looks further ahead than this many characters behind its match.
PEEK = 3


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself, or 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes before the end of a text within which its last tokens may still change, from merges (left, right, new).

    A later byte reaches back only through merges that apply in one continuation and not in another: the first consumes
    the last token before the end, the next (a later merge, since order is time) the token before that, whose partner is
    a token that grew to the right out of the one consumed before. The longest such chain, in bytes of left parts, is
    found by going through the merges in order.
    """
    starts: dict[int, list[int]] = {}  # token -> tokens it grew from by merging to the right
    reach: dict[int, int] = {}
    most = 0
    for left, right, new in merges:
        spine, todo = {right}, [right]
        while todo:
            for t in starts.get(todo.pop(), ()):
                if t not in spine:
                    spine.add(t)
                    todo.append(t)
        far = length[left] + max((reach.get(t, 0) for t in spine), default=0)
        reach[left] = max(reach.get(left, 0), far)
        starts.setdefault(new, []).append(left)
        most = max(most, far)
    return most


@dataclass
class Vocabulary:
    """Bytes of each id, merges by pair, special strings, and the sufficient lookahead."""

    pieces: dict[int, bytes]
    byte_ids: list[int]
    merges: list[dict[int, int]]  # by left id: right id -> rank and new id in one number
    special: dict[str, int]
    reach: int

    @staticmethod
    def parse(text: str) -> Vocabulary:
        """From a tokenizer file. Files that normalise or that add a space in front are refused."""
        spec = json.loads(text)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: token for token, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        steps = []
        for left, right in pairs:
            a, b = bytes(letters[c] for c in left), bytes(letters[c] for c in right)
            steps.append((ids[a], ids[b], ids[a + b]))
        length = [len(pieces.get(i, b"")) for i in range(max(pieces) + 1)]
        merges: list[dict[int, int]] = [{} for _ in length]
        for rank, (a, b, new) in enumerate(steps):
            merges[a][b] = rank << ID_BITS | new
        return Vocabulary(pieces, [ids[bytes([b])] for b in range(256)], merges, special, lookahead(steps, length))


def merge_short(word: bytes, byte_ids: list[int], merges: list[dict[int, int]]) -> list[int]:
    """Ids of a short word: apply the earliest merge that fits, leftmost first, until none fits."""
    ids = [byte_ids[b] for b in word]
    found = [merges[a].get(b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    while found:
        best = min(found)
        if best == NEVER:
            break
        i = found.index(best)
        new = ids[i] = best & ID_MASK
        del found[i], ids[i + 1]
        if i:
            found[i - 1] = merges[ids[i - 1]].get(new, NEVER)
        if i < len(found):
            found[i] = merges[new].get(ids[i + 1], NEVER)
    return ids


def merge_long(word: bytes, byte_ids: list[int], merges: list[dict[int, int]]) -> list[int]:
    """The same for a long word, with a heap of the merges that fit."""
    ids, before, after = [byte_ids[b] for b in word], list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap = [(m >> ID_BITS, i, i + 1, m) for i in range(len(ids) - 1) if (m := merges[ids[i]].get(ids[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, j, merge = heapq.heappop(heap)
        if ids[i] < 0 or after[i] != j or merges[ids[i]].get(ids[j]) != merge:
            continue
        new = ids[i] = merge & ID_MASK
        ids[j], after[i] = -1, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            if m := merges[new].get(ids[after[i]]):
                heapq.heappush(heap, (m >> ID_BITS, i, after[i], m))
        if before[i] >= 0 and (m := merges[ids[before[i]]].get(new)):
            heapq.heappush(heap, (m >> ID_BITS, before[i], i, m))
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts piece by piece. One object serves many texts; what it remembers of words is bounded."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED, window: int | None = None):
        self.vocabulary = vocabulary
        self.window = window or max(4096, 4 * vocabulary.reach)
        self.remembered = remembered
        self.fresh: dict[str, list[int]] = {}  # ids of a space and a word, by word
        self.old: dict[str, list[int]] = {}
        self.pretokens: dict[str, list[int]] = {}  # ids of short pretokens that are looked up as they are
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        codes = [(a << ID_BITS | b, m) for a, row in enumerate(vocabulary.merges) for b, m in row.items()]
        self.codes, self.values = (np.array(c, np.int64) for c in zip(*sorted(codes), strict=True))
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges of pairs of ids, NEVER where there is none."""
        code = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (right >= 0), self.values[at], NEVER)

    def prepare(self, texts: Iterable[str]) -> None:
        """Remember the ids of all new words of some texts: many words are merged in lockstep, one merge each per step."""
        parts: set[str] = set()
        for text in texts:
            parts.update(text.split(" "))
        found = {p.rstrip(MARKS) for p in parts if p not in self.fresh}
        new = [w for w in found if w not in self.fresh and w not in self.old and w.isalpha() and len(w) < 24]
        coded = [b" " + w.encode() for w in new]
        for size in (12, 24, 96):
            own = [i for i, w in enumerate(coded) if len(w) <= size and (size == 12 or len(w) > size // 2 or size == 96 and len(w) > 24)]
            for at in range(0, len(own), LOCKSTEP):
                part = own[at : at + LOCKSTEP]
                for i, ids in zip(part, self._together([coded[i] for i in part]), strict=True):
                    self._remember(new[i], ids)

    def _together(self, coded: list[bytes]) -> list[list[int]]:
        length = np.array([len(w) for w in coded])
        width = int(length.max())
        ids = np.full((len(coded), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        done = ids.copy()
        merge = self._merges(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(len(coded)), np.arange(width + 1)
        while len(rows):
            at = merge.argmin(axis=1)
            best = merge[np.arange(len(rows)), at]
            ended = best == NEVER
            if ended.any():
                done[rows[ended]] = -1
                done[rows[ended], : ids.shape[1]] = ids[ended]
                go_on = ~ended
                rows, ids, merge, at, best = rows[go_on], ids[go_on], merge[go_on], at[go_on], best[go_on]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best & ID_MASK
            shift = columns[: ids.shape[1] - 1] + (columns[: ids.shape[1] - 1] > at[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            merge = np.take_along_axis(merge, shift[:, : merge.shape[1] - 1], axis=1)
            if not merge.shape[1]:
                merge = np.full((len(rows), 1), NEVER)
                ids = np.hstack([ids, np.full((len(rows), 1), -1)])
                continue
            inner = at < merge.shape[1]
            merge[every[inner], at[inner]] = self._merges(ids[every[inner], at[inner]], ids[every[inner], at[inner] + 1])
            inner = at > 0
            merge[every[inner], at[inner] - 1] = self._merges(ids[every[inner], at[inner] - 1], ids[every[inner], at[inner]])
        real = done >= 0
        flat, ends = done[real].tolist(), real.sum(axis=1).cumsum().tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _remember(self, word: str, ids: list[int]) -> None:
        if len(self.fresh) >= self.remembered:
            self.old, self.fresh = self.fresh, {}
        self.fresh[word] = ids

    def _word(self, word: str) -> list[int]:
        data = word.encode()
        if len(data) <= 48:
            return merge_short(data, self.vocabulary.byte_ids, self.vocabulary.merges)
        return self._word_bytes(data)

    def _word_bytes(self, data: bytes) -> list[int]:
        out: list[int] = []
        rest = self._stable(data, out)
        return out + merge_long(rest, self.vocabulary.byte_ids, self.vocabulary.merges)

    def _stable(self, data: bytes, out: list[int]) -> bytes:
        """Append the ids of ``data`` that no continuation can change while more than a window is left; the rest."""
        at = 0
        while len(data) - at > self.window:
            ids = merge_long(data[at : at + self.window], self.vocabulary.byte_ids, self.vocabulary.merges)
            end, last = at, at + self.window - self.vocabulary.reach
            for i in ids:
                if end + len(self.vocabulary.pieces[i]) > last:
                    break
                end += len(self.vocabulary.pieces[i])
                out.append(i)
            at = end
        return data[at:]

    def _pattern(self, text: str) -> list[int]:
        return [i for word in PRETOKENS.findall(text) for i in self._pretoken(word)]

    def _pretoken(self, word: str) -> list[int]:
        ids = self.pretokens.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) < 64:
                if len(self.pretokens) >= PRETOKENS_HELD:
                    self.pretokens.clear()
                self.pretokens[word] = ids
        return ids

    def _spaced(self, part: str) -> list[int]:
        """Ids of a space and ``part``, which holds no white space."""
        ids = self.old.get(part)
        if ids is None:
            word = part.rstrip(MARKS)
            if not word.isalpha():
                ids = self._pattern(" " + part)
            elif word == part:
                ids = self._word(" " + part)
            else:  # marks behind a letter are a pretoken of their own
                return (self.fresh.get(word) or self._spaced(word)) + self._pretoken(part[len(word) :])
            if len(part) > 64:
                return ids
        self._remember(part, ids)
        return ids

    def _closed(self, text: str, out: list[int]) -> None:
        """Append the ids of a text that ends where a pretoken ends whatever follows.

        A space in front of another character than white space always begins a pretoken, and white space always ends
        one, so words with one space in front are looked up; everything else waits in ``other`` for the pattern.
        """
        parts = iter(text.split(" "))
        other = next(parts)
        for part in parts:
            ids = self.fresh.get(part)
            if ids is not None:
                if other:
                    out += self._pattern(other)
                    other = ""
                out += ids
            elif not part or part[0].isspace():
                other = f"{other} {part}"
            else:
                if other:
                    out += self._pattern(other)
                other = ""
                if part.isalnum() or part.split() == [part]:
                    out += self._spaced(part)
                else:
                    other = " " + part
        if other:
            out += self._pattern(other)

    def stream(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text given in pieces, in lists, each as soon as it is stable."""
        text, run, data = "", None, b""  # run: the pattern of a pretoken that is still open, data: its bytes so far
        for piece in pieces:
            text, out = text + piece, []
            if run is not None:
                text, run, data = self._go_on(text, run, data, out)
            if run is None and (cut := self._cut(text)):
                self._closed(text[:cut], out)
                text = text[cut:]
            if run is None and len(text) > PIECE:  # no place to cut: one pretoken at a time
                end = 0
                for m in PRETOKENS.finditer(text):
                    if m.end() > len(text) - PEEK:
                        break
                    out += self._word(m[0])
                    end = m.end()
                text = text[end:]
                if len(text) > PIECE:
                    text, run, data = self._open(text, out)
            yield out
        out = []
        if run is not None:
            m = run.match(text)
            end = m.end() if m else 0
            end -= run is RUNS[3] and 0 < end < len(text)
            out += self._word_bytes(data + text[:end].encode())
            text = text[end:]
        self._closed(text, out)
        yield out

    @staticmethod
    def _cut(text: str) -> int:
        """The last space in front of another character than white space, where a pretoken begins; 0 if there is none."""
        at = text.rfind(" ", 1, len(text) - 1)
        while at > 0 and text[at + 1].isspace():
            at = text.rfind(" ", 1, at)
        return max(at, 0)

    def _open(self, text: str, out: list[int]) -> tuple[str, regex.Pattern, bytes]:
        """Begin a pretoken of which more than a piece is known and whose end isn't."""
        lead = text[0] == " " and not text[1].isspace()
        run = next(r for r in RUNS if r.match(text, int(lead)))
        data = b" " if lead else b""
        return self._go_on(text[int(lead) :], run, data, out)

    def _go_on(self, text: str, run: regex.Pattern, data: bytes, out: list[int]) -> tuple[str, regex.Pattern | None, bytes]:
        m = run.match(text)
        end = m.end() if m else 0
        if end >= len(text) - PEEK:  # still open; the last space of a run may belong to what follows
            keep = min(end, PEEK)
            data = self._stable(data + text[: end - keep].encode(), out)
            return text[end - keep :], run, data
        if run is RUNS[3] and end:
            end -= 1
        out += self._word_bytes(data + text[:end].encode())
        return text[end:], None, b""

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens become their ids."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            self._plain(text[at : m.start()], out)
            out.append(self.vocabulary.special[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        for ids in self.stream(text[i : i + PIECE] for i in range(0, len(text), PIECE)):
            out += ids


def joined(pieces: pa.LargeBinaryArray, ids: np.ndarray) -> bytes:
    """The pieces at positions ``ids``, one after the other."""
    data = pieces.take(pa.array(ids)).buffers()[2]
    return data.to_pybytes() if data else b""


class Decoder:
    """Bytes to text, incrementally: holds the bytes of a character that isn't complete, and marks invalid bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = pa.array([vocabulary.pieces.get(i, b"") for i in range(max(vocabulary.pieces) + 1)], pa.large_binary())
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int] | np.ndarray) -> str:
        """Text that is certain after these ids. Ids outside the vocabulary stand for nothing."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            ids = ids[(ids >= 0) & (ids < len(self.pieces))]
        return self.machine.decode(joined(self.pieces, ids))

    def finish(self) -> str:
        text = self.machine.decode(b"", final=True)
        self.machine.reset()
        return text


@lru_cache(2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary.parse(text)


@lru_cache(1)
def _encoder(text: str) -> Encoder:
    return Encoder(vocabulary(text))


def load(spark: SparkSession, path: str) -> str:
    """The tokenizer file as text, read by the driver: it is a few MB whatever the data."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if "://" in path else open(path, encoding="utf-8").read()


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, BATCH_BYTES * batch.num_rows // max(BATCH_BYTES, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode_all(encoder: Encoder, texts: list[str | None]) -> Iterator[list[int]]:
    """Ids of each text; null has none. Words of some texts at a time are prepared together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < GATHERED:
            size, end = size + len(texts[end] or ""), end + 1
        encoder.prepare(t[:PIECE] for t in texts[at:end] if t)
        for t in texts[at:end]:
            yield encoder.encode(t) if t else []
        at = end


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", check: str | None = None, drop: bool = False) -> DataFrame:
    """``docs`` with the ids of column ``text`` (null: an empty list) as ``ids``, an array of int; other columns stay.

    With ``check``, a column of that name says whether the ids decode to the text again (null: to an empty text); with
    ``drop`` the text itself is left out. A column of ``docs`` that has the name of a new one is replaced. Texts of any length are encoded whole.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))
    rest = docs.drop(ids, *[check] * bool(check))
    given = rest if text in rest.columns else rest.select(*rest.columns, docs[text])
    at = given.columns.index(text)
    kept = [i for i, c in enumerate(given.columns) if c in rest.columns and not (drop and i == at)]
    schema = rest.select(*[given.columns[i] for i in kept]).withColumn(ids, F.lit(None).cast("array<int>")).schema
    if check:
        schema = schema.add(check, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(spec.value), Decoder(vocabulary(spec.value))
        for whole in batches:
            for batch in _sliced(whole):
                texts = batch.column(at).to_pylist()
                found = list(encode_all(encoder, texts))
                columns = [*[batch.column(i) for i in kept], pa.array(found, pa.list_(pa.int32()))]
                if check:
                    same = [decoder.feed(f) + decoder.finish() == (t or "") for f, t in zip(found, texts, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of column ``ids`` (null or empty: an empty text) as ``text``; other columns stay."""
    spec = encoded.sparkSession.sparkContext.broadcast(load(encoded.sparkSession, path))
    given = encoded.drop(text).withColumn(text, F.col(ids))
    at = len(given.columns) - 1
    schema = encoded.drop(text).withColumn(text, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(spec.value))
        for whole in batches:
            for batch in _sliced(whole):
                found = [decoder.feed(i or []) + decoder.finish() for i in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string())], batch.schema.names)

    return given.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str, text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of a text's ids, joined by commas, and of what they decode to.

    The same as ``encode``, ``decode`` and digests of their columns, without passing the ids from task to task.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(spec.value), Decoder(vocabulary(spec.value))
        decimal = pa.array([b"%d," % i for i in range(len(decoder.pieces))], pa.large_binary())
        for whole in batches:
            for batch in _sliced(whole):
                sizes, of_ids, of_text = [], [], []
                for found in encode_all(encoder, batch.column(1).to_pylist()):
                    ids = np.array(found, np.int64)
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(joined(decimal, ids)[:-1]).hexdigest())
                    of_text.append(hashlib.sha256((decoder.feed(ids) + decoder.finish()).encode()).hexdigest())
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    none = F.lit(None)
    schema = docs.select(key).withColumns(
        {"n_tokens": none.cast("long"), "ids_sha256": none.cast("string"), "decoded_sha256": none.cast("string")}
    ).schema
    return docs.select(key, text).mapInArrow(run, schema)
