"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block of a page gets a log odds of being main text from trees over its features: density of text and links in its
subtree, tokens of its attributes, depth, and how it compares with its siblings. The decoding then chooses, for the page as a
whole, the best of the choices that do not contradict each other: a block is dropped with all that it holds, or kept, or
passed through (it holds both), and nothing above a kept block may be dropped.

The trees are trained on layouts made from the blocks of a bounded sample of pages, in which the place of every text is
known, and on the sampled pages that mark their article themselves.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.dom import BLOCK, Page, parse

#: The bound of the training sample, in pages and characters of each, and the layouts made of each page.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 300, 20_000, 4
#: Trees, their depth, the bins of a feature, and the share of each tree that is added.
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
#: Pages whose nodes are scored together.
TOGETHER = 128

TAGS = [
    ("article", "main"), ("section",), ("div", "center"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("nav",), ("header", "hgroup"), ("footer", "address"), ("aside",),
    ("form", "fieldset", "button", "select", "label"), ("table", "tbody", "thead", "tr", "td", "th"), ("figure", "figcaption"), ("body", "html"),
]
# Words in class, id and role that tell what an element is for.
TOKENS = [
    "article content post main body entry story text prose hentry",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header masthead topbar branding logo hero",
    "footer copyright colophon legal bottom",
    "sidebar side aside rail widget widgets complementary",
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion dfp",
    "cookie cookies consent gdpr notice notices alert popup modal overlay message disclaimer",
    "comment comments commentlist reply replies respond discussion disqus feedback reviews",
    "share sharing social related recommended recommendations more tags byline author bio newsletter",
    "form search login signup subscribe subscription register contact input",
    "hidden none screenreader visuallyhidden sr",
]
_GROUP_OF = {w: i for i, group in enumerate(TOKENS) for w in group.split()}
_TAG_OF = {t: i for i, group in enumerate(TAGS) for t in group}
#: What a tag says of what it holds, in terms of the same groups.
_MEANS = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9, "button": 9, "label": 9}
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
N_FEATURES = len(TAGS) + 1 + len(TOKENS) + 18


def _groups(attrs: str) -> frozenset[int]:
    found = {_GROUP_OF[w] for value in _ATTR.findall(attrs) for t in _WORD.findall(value) if (w := t.lower()) in _GROUP_OF}
    if _HIDDEN.search(attrs):
        found.add(len(TOKENS) - 1)
    return frozenset(found)


@dataclass(slots=True)
class Nodes:
    """The blocks of a page that are chosen or not: for each its element, the node around it and its features."""

    page: Page
    element: list[int]
    parent: np.ndarray
    of_element: list[int]  # node of each element: itself or the nearest around it
    own: np.ndarray  # characters that lie in the node and in no node inside it
    x: np.ndarray


def nodes(page: Page) -> Nodes:
    """Nodes of a page with their features. Inline elements count as nodes if their attributes say what they are for."""
    elements = page.elements
    element, parent, of_element, groups, means = [-1], [-1], [], [frozenset()], [frozenset()]
    for i, e in enumerate(elements):
        above = of_element[e.parent] if e.parent >= 0 else 0
        own = _groups(e.attrs) if e.attrs else frozenset()
        meant = {_MEANS[e.tag]} if e.tag in _MEANS else set()
        if e.tag in BLOCK or own or e.tag in ("button", "select", "label"):
            of_element.append(len(element))
            element.append(i)
            parent.append(above)
            groups.append(own)
            means.append(own | meant)
        else:
            of_element.append(above)
    n = len(element)
    in_link = [False] * len(elements)
    tags = np.zeros(n)
    for i, e in enumerate(elements):
        in_link[i] = e.tag == "a" or (e.parent >= 0 and in_link[e.parent])
        tags[of_element[i]] += 1
    chars, linked, marks, spaces, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    started, total = [False] * n, 0
    for e, text in page.pieces:
        if text is None:
            continue
        v = of_element[e] if e >= 0 else 0
        size = len(text.strip())
        u = v
        while not started[u]:
            started[u], before[u] = True, total
            u = max(parent[u], 0)
        chars[v] += size
        total += size
        if e >= 0 and in_link[e]:
            linked[v] += size
        marks[v] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
        spaces[v] += text.count(" ") + 1
    own = chars.copy()
    around = np.array(parent)
    paragraphs, kids, kid_chars, depth, good, bad = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    index = np.zeros(n)
    for v in range(1, n):
        p = parent[v]
        depth[v] = depth[p] + 1
        good[v] = good[p] or 0 in means[p]
        bad[v] = bad[p] or any(1 <= g for g in means[p])
        index[v] = kids[p]
        kids[p] += 1
        paragraphs[p] += elements[element[v]].tag == "p"
    for v in range(n - 1, 0, -1):
        p = parent[v]
        for sums in (chars, linked, marks, spaces, tags):
            sums[p] += sums[v]
        kid_chars[p] += chars[v]
    x = np.zeros((n, N_FEATURES))
    for v in range(n):
        tag = elements[element[v]].tag if v else "html"
        x[v, _TAG_OF.get(tag, len(TAGS))] = 1
        for g in groups[v]:
            x[v, len(TAGS) + 1 + g] = 1
    up = np.maximum(around, 0)
    siblings = kids[up]
    mean = kid_chars[up] / np.maximum(siblings, 1)
    rest = np.column_stack([
        good, bad, np.log1p(own), np.log1p(chars), linked / np.maximum(chars, 1), tags / (chars + 1), chars / max(total, 1),
        depth, index, index / np.maximum(siblings, 1), siblings, np.log1p(mean), chars / (mean + 1), marks / np.maximum(spaces, 1),
        np.log1p(spaces), chars / np.maximum(spaces, 1), paragraphs, before / max(total, 1),
    ])
    x[:, len(TAGS) + 1 + len(TOKENS) :] = rest
    return Nodes(page, element, around, of_element, own, x)


# --- gradient-boosted trees


@dataclass
class Trees:
    """Complete binary trees: inner nodes level by level (feature, threshold), then leaves."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the logistic loss, by histograms of binned features."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    n, width = binned.shape
    flat = binned + np.arange(width) * BINS
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    z = np.full(n, start)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.nonzero(at == k)[0]
                if len(own) < 20:
                    continue
                cells = flat[own].reshape(-1)
                sg = np.bincount(cells, np.repeat(g[own], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(cells, np.repeat(h[own], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                gain = sg**2 / (sh + 1) + (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + 1) - sg[:, -1:] ** 2 / (sh[:, -1:] + 1)
                gain[np.minimum(sh, sh[:, -1:] - sh) < 1] = 0
                best, cut = np.unravel_index(gain.argmax(), gain.shape)
                if gain[best, cut] > 1e-6 and cut < len(edges[best]):
                    f[k], t[k] = best, edges[best][cut]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        sums = np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        features.append(f)
        thresholds.append(t)
        leaves.append(-RATE * sums)
        z = z + leaves[-1][leaf]
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


# --- decoding


def decode(parent: np.ndarray, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each node is kept, by the best choice without contradictions; parents come before children.

    Choosing a node counts its log odds, weighted by its own text; passing through counts nothing. Below a dropped node
    all is dropped, below a kept one nodes are kept or dropped, and only nodes below passed ones may be passed.
    """
    gain = odds * (1 + np.log1p(own))
    keep, drop, through = gain.copy(), -gain, np.zeros(len(gain))
    for v in range(len(gain) - 1, 0, -1):
        p = parent[v]
        keep[p] += max(keep[v], drop[v])
        drop[p] += drop[v]
        through[p] += max(through[v], keep[v], drop[v])
    state = np.zeros(len(gain), np.int8)  # 0 dropped, 1 kept, 2 passed
    for v in range(len(gain)):
        above = state[parent[v]] if v else 2
        if above == 2:
            state[v] = int(np.argmax((drop[v], keep[v], through[v]))) if v else 2 if through[v] >= keep[v] else 1
        elif above == 1:
            state[v] = int(keep[v] > drop[v])
    return state == 1


def text_of(found: Nodes, kept: np.ndarray) -> str:
    """Text of the kept nodes in page order: references decoded, white space within a block one space, blocks joined by one."""
    elements, out, last = found.page.elements, [], None
    for e, text in found.page.pieces:
        v = found.of_element[e] if e >= 0 else 0
        if not kept[v]:
            continue
        block = e
        while block >= 0 and elements[block].tag not in BLOCK:
            block = elements[block].parent
        if text is None or block != last:
            out.append(" ")
        if text is not None:
            out.append(entities.unescape(text))
        last = block
    return " ".join("".join(out).split())


# --- training layouts

_HOLD = [
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content"><div>{}</div></div>',
    '<section class="post">{}</section>', '<div class="wrap"><article class="entry">{}</article></div>', '<div class="story-text">{}</div>', "{}",
]
_ASIDE = [
    '<nav><ul>{links}</ul></nav>', '<div class="menu"><ul>{links}</ul></div>', '<ul id="nav">{links}</ul>', '<header><a href="/">{short}</a></header>',
    '<div class="header"><p>{short}</p></div>', '<div class="ad">{text}</div>', '<div class="advert"><p>{text}</p></div>', '<div id="banner">{short}</div>',
    '<aside><h3>{short}</h3><p>{text}</p></aside>', '<div class="sidebar"><h4>{short}</h4><ul>{links}</ul></div>', '<div class="cookie-notice"><p>{text}</p><button>{word}</button></div>',
    '<div class="notice">{text}</div>', '<form action="/s"><label>{word}</label><input name="q"><button>{word}</button></form>', '<form class="subscribe"><p>{short}</p></form>',
    '<div class="related"><h4>{short}</h4><ul>{links}</ul></div>', '<div class="share">{links}</div>', '<p class="byline">{short}</p>',
]
_BELOW = [
    '<footer>&copy; {short}</footer>', '<div class="footer"><p>{text}</p></div>', '<footer><p>{text}</p><ul>{links}</ul></footer>',
    '<section id="comments"><h3>{word}</h3><div class="comment"><p>{text}</p></div><div class="comment"><p>{more}</p></div></section>',
    '<ol class="commentlist"><li>{text}</li><li>{more}</li></ol>', '<div class="comments"><p>{text}</p><p>{more}</p></div>', '<div id="copyright">{short}</div>',
]


def _layout(blocks: list[str], spare: list[str], rng: random.Random) -> str:
    """A page in which the main text is marked by the attribute data-keep and everything else isn't main text."""

    def fill(form: str) -> str:
        words_ = rng.choice(spare).split() or ["-"]
        links = "".join(f'<li><a href="/{i}">{rng.choice(words_)}</a></li>' for i in range(rng.randint(3, 8)))
        cut = " ".join(words_[: rng.randint(3, 12)])
        return form.format(links=links, short=cut, word=words_[0], text=" ".join(words_[: rng.randint(4, 60)]), more=rng.choice(spare)[:200])

    body = []
    for i, text in enumerate(blocks):
        form = "<h1 data-keep>{}</h1>" if i == 0 and rng.random() < 0.7 else rng.choice(["<p data-keep>{}</p>"] * 8 + [
            "<h2 data-keep>{}</h2>", "<ul data-keep><li data-keep>{}</li></ul>", "<blockquote data-keep>{}</blockquote>", "<div data-keep>{}</div>"])
        body.append(form.format(text))
        if rng.random() < 0.08:
            body.append(fill(rng.choice(_ASIDE)))
    if rng.random() < 0.3:
        body.append(fill(rng.choice(_BELOW[3:6])))
    above = [fill(rng.choice(_ASIDE)) for _ in range(rng.randint(0, 4))]
    below = [fill(rng.choice(_ASIDE + _BELOW * 2)) for _ in range(rng.randint(0, 4))]
    held = rng.choice(_HOLD).format("".join(body))
    wrap = rng.choice(["{}", "{}", '<div id="page">{}</div>', '<div class="container"><div class="row">{}</div></div>'])
    return "<html><body>" + wrap.format("".join([*above, held, *below])) + "</body></html>"


def _marked(found: Nodes) -> np.ndarray:
    """Labels of a layout's nodes: 1 main text, 0 not, -1 for nodes that hold both."""
    n = len(found.element)
    keep = np.array([e >= 0 and "data-keep" in found.page.elements[e].attrs for e in found.element])
    return _settled(found, keep, n)


def _settled(found: Nodes, keep: np.ndarray, n: int) -> np.ndarray:
    has, lacks = keep.copy(), np.zeros(n, bool)
    lacks[(found.own > 0) & ~keep] = True
    for v in range(n - 1, 0, -1):
        has[found.parent[v]] |= has[v]
        lacks[found.parent[v]] |= lacks[v]
    label = np.where(has & lacks, -1, np.where(has, 1, 0))
    label[keep] = 1
    return label


def _self_marked(found: Nodes) -> np.ndarray | None:
    """Labels of a page that has one article or main element, all of whose blocks are main text; None for other pages."""
    tags = [found.page.elements[e].tag if e >= 0 else "" for e in found.element]
    roots = [v for v, t in enumerate(tags) if t in ("article", "main")]
    if len(roots) != 1:
        return None
    keep = np.zeros(len(tags), bool)
    keep[roots[0]] = True
    off = len(TAGS) + 1
    for v in range(roots[0] + 1, len(tags)):
        named = found.x[v, off + 1 : off + len(TOKENS)].any() or tags[v] in ("nav", "aside", "footer", "header", "form", "button")
        keep[v] = keep[found.parent[v]] and not named
    return _settled(found, keep, len(tags))


def _blocks(html: str) -> list[str]:
    """Texts of a page's paragraphs and other blocks with enough words, escaped again."""
    page = parse(html)
    texts_: dict[int, list[str]] = {}
    for e, text in page.pieces:
        if text and text.strip():
            texts_.setdefault(e, []).append(text.strip())
    return [entities.escape(entities.unescape(" ".join(t))) for t in texts_.values()]


def learn(pages: DataFrame) -> Trees:
    """Trees from a sample of ``pages`` (html): at most SAMPLE different ones, SAMPLE_CHARS characters of each, those
    with the smallest hashes. Without any page the layouts are made of a few placeholder words."""
    rows = pages.where("html is not null and html <> ''").select(F.xxhash64("html").alias("h"), F.left("html", F.lit(SAMPLE_CHARS)).alias("html"))
    n = rows.select("h").distinct().count()
    limit = min(2**63 - 1, -(2**63) + int(min(1.0, 4 * SAMPLE / max(n, 1)) * (2**64 - 1)))
    sample = rows.where(F.col("h") <= limit).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(SAMPLE).collect()
    rng = random.Random(7)
    texts_ = [b for _, html in sample if (b := _blocks(html))] or [["Text of the page", "More text of the page, with some words."]]
    spare = [t for blocks in texts_ for t in blocks if len(t) < 2000] or ["some other words"]
    xs, ys = [], []
    for blocks in texts_:
        for _ in range(LAYOUTS):
            part = [t for t in blocks if len(t) > 20] or blocks
            at = rng.randrange(len(part))
            part = part[at : at + rng.randint(1, 12)]
            if rng.random() < 0.3:  # short articles too
                part = [" ".join(t.split()[: rng.randint(1, 12)]) for t in part[:3]]
            found = nodes(parse(_layout(part, spare, rng)))
            xs.append(found.x)
            ys.append(_marked(found))
    for _, html in sample:
        found = nodes(parse(html))
        label = _self_marked(found)
        if label is not None:
            xs.append(found.x)
            ys.append(label)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return boost(x[y >= 0], y[y >= 0].astype(np.float64))


def extract(htmls: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page; an empty text for null, for an empty page and for one without main text."""
    out = []
    for at in range(0, len(htmls), TOGETHER):
        found = [nodes(parse(h)) if h else None for h in htmls[at : at + TOGETHER]]
        x = [f.x for f in found if f]
        odds = trees.log_odds(np.concatenate(x)) if x else np.zeros(0)
        for f in found:
            if f is None:
                out.append("")
                continue
            own, odds = odds[: len(f.x)], odds[len(f.x) :]
            out.append(text_of(f, decode(f.parent, own, f.own)))
    return out


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """``pages`` without html, with text: the main text of the whole page (see ``extract``). Other columns stay, a column
    text is replaced; repeated rows get the same text."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    given = pages.drop("text").withColumn("text", F.col("html")).drop("html")
    at = len(given.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                texts_ = pa.array(extract(batch.column(at).to_pylist(), shared.value), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts_], batch.schema.names)

    return given.mapInArrow(run, given.schema)
