"""Language identification by cross-parsing: a text belongs to the language whose sample parses it into fewest phrases.

For each language a suffix automaton of a bounded sample of labelled text knows every substring of the sample. A text is
cut from left to right into phrases, each the longest match that the automaton still reads; many texts are parsed in
lockstep. The number of phrases times the logarithm of the sample's length, per character, estimates the cross entropy.

Alphabets may have any size: the transitions of all states lie in one array, shifted against each other so that they fill its gaps, so
the model takes about twelve bytes per transition whatever the number of letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import slices

#: The bounds of the labelled sample: documents per language, characters of each, and characters of all languages, which bounds the
#: model by about 100 MB: above 62 languages each gets its share of them.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 32, 1000, 2_000_000
#: Characters that are parsed as a unit, and units parsed together; rows and bytes of texts that are held at a time.
UNIT, TOGETHER = 2048, 2048
ROWS, BYTES = 1000, 4 << 20
#: Least number of other labelled texts from which the largest fit of a language is learned.
OTHERS = 8
#: How sharply the score falls with the distance of the second language, per bit and character.
SHARPNESS = 10.0
UNKNOWN, SPACE = 0, 1


@dataclass
class Model:
    """All automata. ``alphabet`` lists the code points of the symbols from 2 on; 0 is any other letter and 1 a space.

    The transition of ``state`` by ``symbol`` is at ``base[state] + symbol``: it exists if ``check`` holds the state there, and leads to
    ``target``. ``begin`` is the state after the first symbol of a phrase, by language.
    """

    langs: list[str]
    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    target: np.ndarray
    begin: np.ndarray
    bits: np.ndarray
    letters: list[int]
    sampled: tuple[int, ...] = ()  # hashes of language and text of the sample


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def normal(text: str) -> np.ndarray:
    """Code points of the lower-case text; every run of other things than letters is one space (code 32)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, points, 32)[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``symbols``; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in moves[at]:
            moves[at][s] = new
            at = link[at]
        if at >= 0:
            to = moves[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(s) == to:
                    moves[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


def _shifted(rows: list[tuple[int, list[tuple[int, int]]]], states: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and target of transitions ``rows`` (state, [(symbol, to)], symbols ascending).

    States of several transitions are placed first, the largest foremost, each at the first free place that fits; where many did not
    fit, larger states no longer look. Those of a single transition fill what is free. No place below ``width`` is used, so that no base is
    negative.
    """
    base = np.zeros(states, np.int32)
    taken, low, end, size = bytearray(4 * width), width, width, 0
    places: list[tuple[int, int, int]] = []
    single = [r for r in rows if len(r[1]) == 1]
    for state, out in sorted((r for r in rows if len(r[1]) > 1), key=lambda r: -len(r[1])):
        if len(out) < min(size, 8):
            low = width  # small states fit where larger ones did not
        size, first = len(out), out[0][0]
        while taken[low]:
            low += 1
        at, tries = low, 0
        while any(taken[at - first + s] for s, _ in out):
            at = taken.index(0, at + 1)
            tries += 1
            if tries % 64 == 0:
                low = at
        base[state] = at - first
        for s, to in out:
            taken[at - first + s] = 1
            places.append((at - first + s, state, to))
        end = max(end, at - first + out[-1][0] + 1)
        if len(taken) < end + 2 * width:
            taken += bytes(len(taken) + 2 * width)
    gaps = np.nonzero(np.frombuffer(taken[:end], np.uint8)[width:] == 0)[0] + width
    gaps = np.concatenate([gaps, np.arange(end, end + max(0, len(single) - len(gaps)))])[: len(single)]
    for at, (state, [(s, to)]) in zip(gaps.tolist(), single, strict=True):
        base[state] = at - s
        places.append((at, state, to))
    size = int(base.max(initial=0)) + width + 1
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    if places:
        at, state, to = np.array(places).T
        check[at], target[at] = state, to
    return base, check, target


def build(samples: dict[str, list[str]]) -> Model:
    """Model of the given texts by language."""
    langs = sorted(samples)
    parts = {lang: [normal(t) for t in samples[lang]] for lang in langs}
    found = {lang: set(np.unique(np.concatenate(parts[lang])).tolist()) - {32} for lang in langs}
    common = Counter(p for lang in langs for part in parts[lang] for p in part.tolist() if p != 32)
    alphabet = [p for p, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    code = {32: SPACE} | {p: i + 2 for i, p in enumerate(alphabet)}
    width = len(alphabet) + 2
    begin = np.empty((len(langs), width), np.int32)
    rows, bits, first = [], [], 0
    for i, lang in enumerate(langs):
        symbols = [code[p] for part in parts[lang] for p in [*part.tolist(), 32]]
        moves = suffix_automaton(symbols)
        # The state after a letter that the sample doesn't hold leads nowhere: a phrase of its own.
        begin[i] = first + len(moves)
        for s, to in moves[0].items():
            begin[i, s] = first + to
        rows += [(first + state, sorted((s, first + to) for s, to in out.items())) for state, out in enumerate(moves) if state and out]
        bits.append(np.log2(len(symbols) + 1))
        first += len(moves) + 1
    base, check, target = _shifted(rows, first, width)
    return Model(langs, np.array(alphabet, np.int64), base, check, target, begin, np.array(bits), [len(found[lang]) + 1 for lang in langs])


def learn(docs: DataFrame, known: Column) -> Model:
    """Model from a bounded sample of the rows of ``docs`` (text, lang) where ``known`` holds and both have a value.

    Per language at most SAMPLE_DOCS different documents give their first SAMPLE_CHARS characters, those with the
    smallest hashes of language and text, so the sample is the same in every run. Copies count once: a language of a few
    texts in many rows is learned from all of them. No row at all: a model that knows no language.
    """
    rows = docs.where(known & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", F.xxhash64("lang", "text").alias("h"), F.left("text", F.lit(SAMPLE_CHARS)).alias("part")
    ).where(F.col("part").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in counts.items():
        limit = -(2**63) + int(min(1.0, 4 * SAMPLE_DOCS / n) * (2**64 - 1))
        chosen |= (F.col("lang") == lang) & (F.col("h") <= min(limit, 2**63 - 1))
    found = rows.where(chosen).groupBy("lang", "h").agg(F.first("part").alias("part"))
    found = found.orderBy("h").limit(8 * SAMPLE_DOCS * max(1, len(counts))).collect()
    most = min(SAMPLE_DOCS * SAMPLE_CHARS, SAMPLE_ALL // max(1, len(counts)))
    samples: dict[str, list[str]] = {}
    sampled = []
    for lang, h, part in sorted(found, key=lambda r: (r["lang"], r["h"])):
        parts = samples.setdefault(lang, [])
        if len(parts) < SAMPLE_DOCS and sum(map(len, parts)) + len(part) <= most + SAMPLE_CHARS and letters()[[ord(c) for c in part]].any():
            parts.append(part)
            sampled.append(h)
    return replace(build({lang: parts for lang, parts in samples.items() if parts}), sampled=tuple(sampled))


def _lookups(model: Model) -> np.ndarray:
    """Symbol of every code point."""
    found = np.zeros(0x110000, np.int32)
    found[model.alphabet] = np.arange(2, len(model.alphabet) + 2)
    found[32] = SPACE
    return found


def _phrases(units: list[np.ndarray], model: Model, lookups: np.ndarray) -> np.ndarray:
    """Phrases of each unit by language; units are not empty and sorted by length, longest first.

    A letter that the sample doesn't hold counts twice, as an escape and as itself.
    """
    symbols = np.zeros((len(units[0]), len(units)), np.int32)
    for i, unit in enumerate(units):
        symbols[: len(unit), i] = lookups[unit]
    lengths = np.array([len(u) for u in units])
    state, unknown = model.begin[:, symbols[0]], model.begin[:, :1]
    count = 1 + (state == unknown).astype(np.int32)
    for t in range(1, len(symbols)):
        live = int(np.searchsorted(-lengths, -t))  # units longer than t
        row, at = symbols[t, :live], state[:, :live]
        place = model.base.take(at) + row
        over = model.check.take(place) != at
        state[:, :live] = np.where(over, model.begin.take(row, axis=1), model.target.take(place))
        count[:, :live] += over
        count[:, :live] += state[:, :live] == unknown
    return count


def identify(given: list[str | None], model: Model, lookups: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, score and fit of each text.

    The score compares languages; the fit is absolute: bits per character that the text takes in its language even if
    luck made its phrases one standard deviation too many, so a text of few phrases is hardly evidence against it.
    """
    langs = len(model.langs)
    units, owner = [], []
    chars = np.zeros(len(given), np.int64)
    for i, text in enumerate(given):
        points = normal(text) if text else ()
        chars[i] = len(points)
        for at in range(0, len(points), UNIT):
            units.append(points[at : at + UNIT])
            owner.append(i)
    phrases = np.zeros((langs, len(given)), np.int64)
    order = sorted(range(len(units)), key=lambda k: -len(units[k])) if langs else []
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        np.add.at(phrases.T, [owner[k] for k in part], _phrases([units[k] for k in part], model, lookups).T)
    if not langs:
        return ["und"] * len(given), [0.0] * len(given), [0.0] * len(given)
    rate = phrases * model.bits[:, None] / np.maximum(chars, 1)
    best = rate.argmin(axis=0)
    score = 1 / np.exp(-SHARPNESS * (rate - rate.min(axis=0))).sum(axis=0)
    sure = chars > 0
    found = [model.langs[b] if s else "und" for b, s in zip(best, sure, strict=False)]
    own = phrases[best, np.arange(len(given))]
    fit = (own - np.sqrt(own)) * model.bits[best] / np.maximum(chars, 1)
    return found, np.where(sure, score, 0.0).tolist(), fit.tolist()


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """``docs`` with ``lang`` and ``score`` (0 to 1) of the whole text, and its ``fit`` (see ``identify``) if that is named;
    other columns stay, these are replaced.

    A null text and a text without letters are ``und`` with score 0; of languages that need equally many phrases the
    first in order of code points wins. Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [fit] if fit else []
    given = docs.drop(lang, score, *more)
    at = given.columns.index("text")
    schema = given.withColumns({lang: F.lit("").cast("string"), score: F.lit(0.0)} | {n: F.lit(0.0) for n in more}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookups = _lookups(model)
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                found, *values = identify(batch.column(at).to_pylist(), model, lookups)
                columns = [*batch.columns, pa.array(found, pa.string()), *[pa.array(v, pa.float64()) for v in values[: 1 + len(more)]]]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return given.mapInArrow(run, schema)


def largest_fits(docs: DataFrame, known: Column, model: Model) -> dict[str, float]:
    """By language the fit (see ``identify``) above which a text is not of that language, whatever the others say.

    It lies halfway, as a ratio, between the median of all different labelled texts outside the model's sample and the
    bits of a text none of whose letters is known; junk among the labels moves it little as long as it is the smaller
    part. It is never below that of letters dealt at random from the language's own. With fewer than OTHERS such texts
    that figure stands for the median, so that little more than unknown letters is turned away.
    """
    if not model.langs:
        return {}
    rows = docs.where(known & F.col("text").isNotNull() & F.col("lang").isin(model.langs)).select("lang", "text")
    rows = rows.withColumn("h", F.xxhash64("lang", "text")).where(~F.col("h").isin(list(model.sampled)))
    fits = predict(rows, model, "found", "score", "fit").where("found = lang").groupBy("lang", "h").agg(F.first("fit").alias("fit"))
    medians = fits.groupBy("lang").agg(F.percentile_approx("fit", 0.5, 10_000), F.count("*")).collect()
    learned = {lang: median for lang, median, n in medians if n >= OTHERS}
    cuts = {}
    for lang, letters_, bits in zip(model.langs, model.letters, model.bits.tolist(), strict=True):
        at_random = float(np.log2(letters_ + 1))
        cuts[lang] = max((learned.get(lang, at_random) * bits) ** 0.5, at_random)
    return cuts
