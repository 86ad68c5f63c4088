"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items form one automaton whose states are the classes of word sequences that end in the same places.
A document is streamed through it word by word: the state and the length of the longest match that ends here are all
that is kept. A match of ``window`` words, or of a whole shorter item, makes its words hits.

Items are cut into overlapping pieces, so that no window is lost and no piece is large, and dealt to blocks of a bounded number of
words. One task builds the automaton of a block; it is broadcast, and each block is one more pass over the documents. Which items a
window belongs to stays in tables: an automaton only names sets of pieces, and equal sets of a document are looked up once.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.llm.base import stored, texts
from wattaudit.operators.lookups import lookup_join

#: Words of a block of items; its automaton has at most twice as many states.
BLOCK_WORDS = 200_000
#: Words of a piece of an item.
PIECE_WORDS = 1_000
#: Bytes of a text that are split at a time.
CHUNK = 1 << 18
#: Numbers of sets within a block.
_SETS = 1 << 32
_NEVER = 1 << 62

# ASCII digits, letters in lower case and all bytes above ASCII make words, everything else parts them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def stream(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, A-Z in lower case, a bounded part at a time."""
    rest = b""
    for start in range(0, len(text or b""), CHUNK):
        part = rest + text[start : start + CHUNK].translate(_FOLD)
        found, rest = part.split(b" "), b""
        if start + CHUNK < len(text):
            rest = found.pop()
        yield [w for w in found if w]


@dataclass
class Automaton:
    """States by number, 0 the empty sequence. ``sets`` of a state is the set of pieces with its window, -1 for none."""

    window: int
    go: list[dict[bytes, int]]
    link: list[int]
    length: list[int]
    need: list[int]
    sets: list[int]
    short: dict[int, list[tuple[int, int]]]
    short_above: list[int]


def suffix_automaton(pieces: Iterable[list[bytes]]) -> tuple[list[dict[bytes, int]], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the automaton of all factors of ``pieces``."""
    go: list[dict[bytes, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, q: int, word: bytes) -> int:
        """The state of the sequences of ``q`` that end a step from ``p``, apart from its longer ones."""
        clone = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and go[p].get(word) == q:
            go[p][word] = clone
            p = link[p]
        return clone

    for piece in pieces:
        last = 0
        for word in piece:
            known = go[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else split(last, known, word)
                continue
            state, p = len(go), last
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and word not in go[p]:
                go[p][word] = state
                p = link[p]
            if p >= 0:
                q = go[p][word]
                link[state] = q if length[q] == length[p] + 1 else split(p, q, word)
            last = state
    return go, link, length


def build(pieces: list[list[bytes]], window: int) -> tuple[Automaton, list[tuple[int, int]]]:
    """Automaton of ``pieces`` and (set, piece number) for every set it names."""
    go, link, length = suffix_automaton(pieces)
    holders: dict[int, set[int]] = {}
    shorts: dict[int, dict[int, set[int]]] = {}
    for number, piece in enumerate(pieces):
        state = 0
        for at, word in enumerate(piece, 1):
            state = go[state][word]
            while length[link[state]] >= window:
                state = link[state]
            if at >= window:
                holders.setdefault(state, set()).add(number)
        if 0 < len(piece) < window:
            shorts.setdefault(state, {}).setdefault(len(piece), set()).add(number)
    names: dict[frozenset[int], int] = {}

    def name(members: set[int]) -> int:
        return names.setdefault(frozenset(members), len(names))

    sets, need, above = [-1] * len(go), [_NEVER] * len(go), [-1] * len(go)
    short = {s: sorted((n, name(m)) for n, m in by_length.items()) for s, by_length in shorts.items()}
    for state in sorted(range(1, len(go)), key=length.__getitem__):
        up = link[state]
        if length[state] >= window:
            sets[state] = sets[up] if length[up] >= window else name(holders[state])
        above[state] = state if state in short else above[up]
        own = short[state][0][0] if state in short else _NEVER
        need[state] = min(need[up], own, window if length[state] >= window else _NEVER)
    members = [(s, piece) for m, s in names.items() for piece in m]
    return Automaton(window, go, link, length, need, sets, short, above), members


class Matcher:
    """Streams one text: spans of hit words [first, last], the sets met, and the number of words."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def match(self, text: bytes | None) -> tuple[int, list[list[int]], set[int]]:
        a = self.automaton
        go, link, length, need, root = a.go, a.link, a.length, a.need, a.go[0]
        spans: list[list[int]] = []
        met: set[int] = set()
        state = run = at = 0
        for part in stream(text):
            for at, word in enumerate(part, at):  # noqa: B020
                follow = go[state].get(word)
                if follow is None:
                    if word not in root:
                        state = run = 0
                        continue
                    while follow is None:
                        state = link[state]
                        follow = go[state].get(word)
                    run = length[state]
                state, run = follow, run + 1
                if run >= need[state]:
                    self._hit(state, run, at, spans, met)
            at += bool(part)
        return at, spans, met

    def _hit(self, state: int, run: int, at: int, spans: list[list[int]], met: set[int]) -> None:
        a = self.automaton
        size = 0
        if run >= a.window and a.sets[state] >= 0:
            met.add(a.sets[state])
            size = a.window
        up = a.short_above[state]
        while up > 0:
            for n, name in a.short[up]:
                if n <= run:
                    met.add(name)
                    size = max(size, n)
            up = a.short_above[a.link[up]]
        add_span(spans, at - size + 1, at)


def add_span(spans: list[list[int]], first: int, last: int) -> None:
    """Add a span that ends behind all others, joined with those it touches."""
    while spans and spans[-1][1] >= first - 1:
        first = min(first, spans.pop()[0])
    spans.append([first, last])


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item_id, piece, n): words of every item in pieces that overlap by ``window`` - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts(batch, 1)):
                held: list[bytes] = []
                out = []
                for part in stream(text):
                    held += part
                    while len(held) > PIECE_WORDS:
                        out.append(held[:PIECE_WORDS])
                        held = held[PIECE_WORDS - window + 1 :]
                # A rest as short as the overlap holds no window of its own.
                if held and (not out or len(held) >= window):
                    out.append(held)
                if out:
                    ids = batch.column(0).take(pa.array([i] * len(out)))
                    columns = [ids, pa.array([b" ".join(p) for p in out], pa.binary()), pa.array([len(p) for p in out], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "piece", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, piece binary, n long")


def automata(items: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, automaton) and the members (set, item_id) of every set that they name."""
    if window >= PIECE_WORDS:
        raise ValueError(f"a window has fewer than {PIECE_WORDS} words")
    pieces = stored(_pieces(items, window).withColumn("hash", F.sha2("piece", 256)), "pieces")
    texts_ = pieces.groupBy("hash").agg(F.first("piece").alias("piece"), F.first("n").alias("n"))
    blocks = max(1, math.ceil((texts_.agg(F.sum("n")).first()[0] or 0) / block_words))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by("hash")
        words = [p.split(b" ") for p in order.column("piece").to_pylist()]
        automaton, members = build(words, window)
        names = order.column("hash").to_pylist()
        block = key[0].as_py()
        rows = [(block, pickle.dumps(automaton), None, None)]
        rows += [(block, None, block * _SETS + s, names[p]) for s, p in members]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    columns, kinds = ["block", "automaton", "set", "hash"], [pa.int64(), pa.binary(), pa.int64(), pa.string()]
    dealt = texts_.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)))
    built = stored(dealt.groupBy("block").applyInArrow(run, "block long, automaton binary, set long, hash string"), "automata")
    members = built.where("set is not null").join(pieces.select("hash", "item_id").distinct(), "hash").select("set", "item_id")
    return built.where("automaton is not null").select("block", "automaton"), members


def find(docs: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (first and last number of hit words) and ``sets``, after a pass for each block."""
    carried = docs.columns
    numbers = sorted(r[0] for r in blocks.select("block").collect())
    found = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<array<long>>"), "sets": F.lit(None).cast("array<long>")})
    at = carried.index("text")
    for number in numbers or [None]:
        # One block is bounded by BLOCK_WORDS, whatever the number of items.
        rows = blocks.where(F.col("block") == number).select("automaton").collect()
        blob = rows[0][0] if rows else pickle.dumps(build([], window)[0])
        shared = docs.sparkSession.sparkContext.broadcast(blob)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=(number or 0) * _SETS) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(pickle.loads(shared.value))
            for batch in batches:
                n_words, spans, sets = [], [], []
                for text, old, met in zip(texts(batch, at), batch.column(len(carried) + 1).to_pylist(), batch.column(len(carried) + 2).to_pylist(), strict=True):
                    n, new, names = matcher.match(text)
                    n_words.append(n)
                    spans.append(merged([*old, *new]) if old else new)
                    sets.append(sorted([*(met or []), *(first + s for s in names)]))
                kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
                new = [pa.array(c, t) for c, t in zip((n_words, spans, sets), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *new], names=[*carried, "n_words", "spans", "sets"])

        found = found.mapInArrow(run, found.schema)
        if number != (numbers or [None])[-1]:
            found = stored(found, "matches")
    return found


def hits(spans: str = "spans") -> F.Column:
    """Number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0] + 1)


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. ``window``
    consecutive words of an item, or all words of a shorter one, are a window; the words of a document inside any occurrence of a
    window are hits. ``items_sha256`` digests the different ids of the items with occurring windows, sorted as texts, joined by
    commas. A null or empty text has no words, and such an item no window. An item without id makes hits but is not counted.
    Repeated rows stay rows; other columns are not read. An empty table gives no rows, an empty benchmark no hits.
    """
    blocks, members = automata(items.select("item_id", "text"), window, block_words)
    found = find(docs.select("doc_id", "text"), blocks, window).drop("text")
    found = stored(found.select("doc_id", "n_words", hits().alias("n_hit"), "sets"), "hits")
    # Documents that met the same sets are looked up together.
    met = found.where(F.size("sets") > 0).select("sets").distinct()
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    listed = met.select("sets", F.explode("sets").alias("set")).join(members, "set").groupBy("sets").agg(ids.alias("ids"))
    listed = stored(listed.select("sets", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "items")
    return lookup_join(found, listed, ["sets"]).select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between the words of a span."""
    out, kept, wanted = [], 0, iter(spans)
    span = next(wanted, None)
    for at, word in enumerate(_WORD.finditer(text.translate(_FOLD))):
        if span is None:
            break
        if at == span[0]:
            out.append(text[kept : word.start()])
        if at == span[1]:
            kept, span = word.end(), next(wanted, None)
    return b"".join([*out, text[kept:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without test items: hit spans are cut out of ``text``, and a document goes of whose words more than
    ``coverage`` are hits.

    Documents without hits stay as they are, byte for byte, null and empty texts too; all other columns pass through,
    whatever their names. Words, windows, nulls and ties are those of ``contaminated``.
    """
    blocks, _ = automata(items.select("item_id", "text"), window, block_words)
    found = find(docs.select(F.struct("*").alias("doc"), "text"), blocks, window)
    kept = found.where(F.col("n_words").isNull() | (hits() <= F.col("n_words") * coverage)).select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(texts(batch, 1), batch.column(2).to_pylist(), strict=True)
            cleaned = pa.array([cut(t, s) if s else t for t, s in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), cleaned], ["doc", "cleaned"])

    cleaned = kept.mapInArrow(run, T.StructType([kept.schema["doc"], T.StructField("cleaned", T.StringType())]))
    return cleaned.select(*[F.col("cleaned").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, 10 AS n, array_to_string(w[p:p + 9], ' ') AS g FROM i, unnest(range(1, len(w) - 8)) t(p) WHERE len(w) >= 10
      UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 9),
n AS (SELECT DISTINCT n FROM g),
s AS (SELECT d.r, p, n.n, array_to_string(d.w[p:p + n.n - 1], ' ') AS g FROM d CROSS JOIN n, unnest(range(1, len(d.w) - n.n + 2)) t(p)),
o AS (SELECT DISTINCT s.r, s.p, s.n, g.item_id FROM s JOIN g ON s.n = g.n AND s.g = g.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, n FROM o), unnest(range(p, p + n)) t(q) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN m ON d.r = m.r
"""
