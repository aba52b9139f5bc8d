"""Main text of web pages: boosted trees over DOM-node features, decoded over the tree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmfold.llm.common import texts

#: Pages that training reads: a bounded sample, drawn by a hash of the id; each gives VARIANTS of itself.
TRAINING_PAGES, VARIANTS = 240, 4
#: Pages whose blocks go through the trees at once.
GROUP = 200
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 4, 0.2, 32, 10

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

#: Elements whose content is no markup: scripts, styles, the page's title, form input and what stands in for a frame.
_RAW = frozenset("script style title textarea iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a block; they neither begin nor end one.
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var math mi mn mo ms mrow mtext msup msub msubsup mfrac msqrt mroot mstyle "
                    "semantics".split())
TAGS = ("p", "h1", "li", "ul", "div", "section", "article", "main", "nav", "aside", "footer", "header", "form", "table",
        "td", "blockquote", "pre", "figure", "body", "h", "other")
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 19 for i in range(2, 7)} | {"ol": 3, "dl": 3, "dd": 2,
               "dt": 2, "tr": 13, "tbody": 13, "thead": 13, "th": 14, "figcaption": 17, "html": 18, "#root": 18}
#: Words in class, id, role and the like, by what they tend to mark.
GOOD = frozenset("article body content entry main post story text".split())
BAD = frozenset("ad ads advert advertisement banner breadcrumb comment comments consent cookie discussion disqus footer "
                "form header login masthead menu meta nav navbar navigation newsletter notice pager popup promo related "
                "reply response respond share sidebar signup social sponsor sponsored subscribe tags toolbar widget "
                "alert modal feedback copyright skip search".split())


class Page:
    """Block elements of a page in order: parent, tag number, own text pieces, attribute flags.

    ``pieces`` holds (node, text) in page order; inline elements give their text
    to the block around them, where ``links`` counts what stands inside links.
    """

    def __init__(self):
        self.parent, self.tag, self.good, self.bad, self.links = [-1], [_TAG_NUMBER["#root"]], [0], [0], [0]
        self.inner = [0]  # elements of any kind directly or indirectly inside a block, inline ones included
        self.pieces: list[tuple[int, str]] = []
        self.loose = 0  # blocks made of loose text

    def add(self, parent: int, tag: str, attributes: str) -> int:
        good = bad = 0
        if "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-type"):
                    tokens = _TOKEN.findall("".join(values).lower())
                    good += any(t in GOOD for t in tokens)
                    bad += any(t in BAD for t in tokens)
        self.parent.append(parent)
        self.tag.append(_TAG_NUMBER.get(tag, len(TAGS) - 1))
        self.good.append(good)
        self.bad.append(bad)
        self.links.append(0)
        self.inner.append(0)
        return len(self.parent) - 1


_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"},
           "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
           **dict.fromkeys("button noscript template svg select option".split(), frozenset())}  # may stand in a paragraph


def parse(source: str, page: Page | None = None) -> Page:
    """A tolerant reader: unclosed and stray tags never fail, a new block closes an open paragraph.

    Text outside any block, up to the next one, is a paragraph of its own. A
    block that is not closed ends with its parent.
    """
    page = page or Page()
    names, nodes, in_link, place, loose = ["#root"], [0], 0, 0, 0

    def text(part: str) -> None:
        nonlocal loose
        if not part:
            return
        if len(nodes) == 1 and not loose and not part.isspace():
            loose = page.add(0, "p", "")
            page.loose += 1
        node = nodes[-1] or loose
        page.pieces.append((node, part))
        if in_link:
            page.links[node] += len(part)

    while True:
        found = _TAG.search(source, place)
        text(html.unescape(source[place:found.start()] if found else source[place:]))
        if not found:
            return page
        place = found.end()
        closing, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name not in _INLINE and name in names:
                while len(names) > 1 and names.pop() != name:
                    nodes.pop()
                nodes.pop()
            continue
        if name in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(source, place)
                place = end.end() if end else len(source)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                page.pieces.append((nodes[-1] or loose, "\n"))
            page.inner[nodes[-1] or loose] += 1
            continue
        if name in _INLINE:
            page.inner[nodes[-1] or loose] += 1
            in_link += name == "a"
            continue
        if attributes.endswith("/") and (name == "svg" or "svg" in names):
            page.inner[nodes[-1] or loose] += 1  # closed at once, as shapes in a drawing are
            continue
        closes = _CLOSES.get(name, {"p"})
        while len(names) > 1 and names[-1] in closes:
            names.pop()
            nodes.pop()
        in_link = loose = 0
        nodes.append(page.add(nodes[-1], name, attributes))
        names.append(name)


#: What the trees see of each block.
FEATURES = ("log_own", "log_all", "link_share", "density", "depth", "place", "sibling_place", "siblings", "same_tag",
            "share_of_parent", "largest_sibling", "punctuation", "words", "good", "bad", "good_above", "bad_above",
            "boiler_above", "content_above", "children", "list_like", *(f"tag_{t}" for t in TAGS))
_BOILER = np.isin(np.arange(len(TAGS)), [TAGS.index(t) for t in ("nav", "aside", "footer", "header", "form")])
_CONTENT = np.isin(np.arange(len(TAGS)), [TAGS.index(t) for t in ("article", "main")])


def features(page: Page) -> np.ndarray:
    """One row a block. Parents come before their children, so sums run backwards and inheritance forwards."""
    parent, tag = np.array(page.parent), np.array(page.tag)
    n = len(parent)
    own, marks, words, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    at = 0
    for node, text in page.pieces:
        if first[node] < 0:
            first[node] = at
        own[node] += len(text)
        at += len(text)
        marks[node] += text.count(".") + text.count(",")
        words[node] += text.count(" ")
    total, links, inner = own.copy(), np.array(page.links, float), np.array(page.inner, float) + 1
    marks_all, words_all = marks.copy(), words.copy()
    depth, good, bad = np.zeros(n), np.array(page.good, float), np.array(page.bad, float)
    good_above, bad_above, boiler_above, content_above = (np.zeros(n) for _ in range(4))
    order, count, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        inner[p] += inner[i]
        marks_all[p] += marks_all[i]
        words_all[p] += words_all[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    largest = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        order[i] = count[p]
        count[p] += 1
        largest[p] = max(largest[p], total[i])
        good_above[i] = max(good_above[p], good[p])
        bad_above[i] = max(bad_above[p], bad[p])
        boiler_above[i] = max(boiler_above[p], _BOILER[tag[p]])
        content_above[i] = max(content_above[p], _CONTENT[tag[p]])
    pair = parent * len(TAGS) + tag
    _, which, often = np.unique(pair, return_inverse=True, return_counts=True)
    up = np.maximum(parent, 0)
    siblings = np.maximum(count[up], 1)
    same = often[which] / siblings
    full = np.maximum(total, 1)
    columns = [np.log1p(own), np.log1p(total), links / full, total / inner, depth, np.maximum(first, 0) / max(at, 1),
               order / siblings, siblings, same, total / np.maximum(total[up], 1), largest[up] / np.maximum(total[up], 1),
               marks_all / full, np.log1p(words_all), good, bad, good_above, bad_above, boiler_above, content_above, count,
               inner / np.maximum(words_all, 1)]
    return np.column_stack([*columns, tag[:, None] == np.arange(len(TAGS))]).astype(np.float32)


class Trees(NamedTuple):
    """Boosted trees of one depth as arrays: per tree the feature and threshold of each inner node, leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting on the logistic loss with histogram splits; a node without a gain sends all rows left."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    share = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    feature = np.zeros((TREES, inner), np.int32)
    threshold = np.full((TREES, inner), np.inf, np.float32)
    value = np.zeros((TREES, leaves), np.float32)
    for t in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = chance - y, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, base = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-6)
            split = np.full((width, 2), -1)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                key = node * (BINS + 1) + binned[:, f]
                shape = (width, BINS + 1)
                g = np.bincount(key, slope, width * (BINS + 1)).reshape(shape).cumsum(1)
                h = np.bincount(key, curve, width * (BINS + 1)).reshape(shape).cumsum(1)
                c = np.bincount(key, minlength=width * (BINS + 1)).reshape(shape).cumsum(1)
                gain = g ** 2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < LEAST_LEAF) | (c[:, -1:] - c < LEAST_LEAF)] = 0
                gain = gain[:, :len(edges[f])]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                split[better] = np.column_stack([np.full(width, f), top])[better]
            right = np.zeros(len(y), np.int64)
            for k in range(width):
                f, b = split[k]
                if f >= 0:
                    feature[t, base + k], threshold[t, base + k] = f, edges[f][b]
                    mine = node == k
                    right[mine] = binned[mine, f] > b
            node = node * 2 + right
        g, h = np.bincount(node, slope, leaves), np.bincount(node, curve, leaves)
        value[t] = -RATE * g / (h + 1)
        score += value[t][node]
    return Trees(feature, threshold, value, start)


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row to be content."""
    score = np.full(len(x), trees.start)
    rows = np.arange(len(x))
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = node + 2 ** level - 1
            node = node * 2 + (x[rows, feature[at]] > threshold[at])
        score += value[node]
    return score


def decode(parent: list[int], score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The most likely labels in which nothing below a dropped block is kept.

    Blocks count by the length of their own text, and a little for themselves.
    From the leaves up, each block knows the best its subtree can reach kept
    and what it costs dropped; from the root down, choices follow.
    """
    weight = 0.05 + np.log1p(size)
    kept = np.array(weight * -np.logaddexp(0, -score))
    dropped = np.array(weight * -np.logaddexp(0, score))
    for i in range(len(parent) - 1, 0, -1):
        kept[parent[i]] += max(kept[i], dropped[i])
        dropped[parent[i]] += dropped[i]
    keep = np.zeros(len(parent), bool)
    keep[0] = True  # the root holds the page
    for i in range(1, len(parent)):
        keep[i] = keep[parent[i]] and kept[i] > dropped[i]
    return keep


def joined(page: Page, keep: np.ndarray) -> str:
    """Text of the kept blocks: one space for white space inside a block and between blocks, in page order."""
    runs: list[list] = []
    for node, text in page.pieces:
        if keep[node]:
            if runs and runs[-1][0] == node:
                runs[-1][1].append(text)
            else:
                runs.append([node, [text]])
    blocks = (_SPACE.sub(" ", "".join(parts)).strip(" ") for _, parts in runs)
    return " ".join(b for b in blocks if b)


def own_sizes(page: Page) -> np.ndarray:
    size = np.zeros(len(page.parent))
    for node, text in page.pieces:
        size[node] += len(text.strip())
    return size


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; their blocks go through the trees together."""
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    scores = predict(trees, np.concatenate([features(p) for p in pages]))
    parts = np.split(scores, np.cumsum([len(p.parent) for p in pages])[:-1])
    return [joined(p, _kept(p, score)) for p, score in zip(pages, parts)]


def _kept(page: Page, score: np.ndarray) -> np.ndarray:
    """A page of plain text is all kept; any other as its blocks score."""
    if page.loose == len(page.parent) - 1:
        return np.ones(len(page.parent), bool)
    return decode(page.parent, score, own_sizes(page))


# --- training pages -------------------------------------------------------------------------------------------------

_BOILER_KINDS = ("nav", "sidebar", "notice", "advert", "form", "comments", "related", "header", "footer", "share")


def _boilerplate(kind: str, rng: random.Random, words: list[str]) -> str:
    """A block that pages put around articles, filled with words of the sampled pages."""
    def some(least: int, most: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(n))

    name = rng.choice({
        "nav": ["menu", "nav", "main-nav", "breadcrumb"], "sidebar": ["sidebar", "widget", "side-bar widget"],
        "notice": ["cookie-notice", "notice", "banner", "consent", "alert"], "advert": ["ad", "ads", "advert", "sponsored"],
        "form": ["search-form", "newsletter", "signup", "login"], "comments": ["comments", "comment-list", "discussion"],
        "related": ["related", "related-posts", "promo"], "header": ["site-header", "header", "masthead"],
        "footer": ["site-footer", "footer", "copyright"], "share": ["share", "social", "toolbar"],
    }[kind])
    where = rng.choice([f'class="{name}"', f'id="{name}"'])
    tag = {"nav": "nav", "sidebar": "aside", "header": "header", "footer": "footer"}.get(kind, "div")
    tag = "div" if rng.random() < 0.4 else "section" if kind == "comments" and rng.random() < 0.3 else tag
    where = where if tag == "div" or tag == "section" or rng.random() < 0.5 else ""
    if kind in ("nav", "related"):
        body = f"<ul>{links(rng.randint(2, 8))}</ul>"
    elif kind == "sidebar":
        body = f"<h3>{some(1, 4)}</h3>" + rng.choice([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{some(5, 60)}.</p>"])
    elif kind == "form":
        body = f'<form action="/f"><label>{some(1, 5)}</label><input name="q"><p>{some(1, 12)}</p></form>'
    elif kind == "comments":
        body = f"<h3>{some(1, 3)}</h3>" + "".join(
            f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{some(3, 80)}.</p></div>'
            for _ in range(rng.randint(1, 6)))
    elif kind == "share":
        body = "".join(f'<a href="/s">{some(1, 2)}</a> ' for _ in range(rng.randint(2, 5)))
    else:
        body = rng.choice([f"<p>{some(4, 40)}.</p>", f"{some(4, 40)}."])
    return f"<{tag} {where}>{body}</{tag}>"


def training_rows(sources: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of blocks: sampled pages as they are, and variants of them.

    The seed labels are the pages' own ``article`` or ``main`` elements. In a
    variant these may be plain ``div`` elements with or without a telling class,
    and boilerplate of all kinds, filled with the sample's words, is put before,
    after and inside; since we put it there, its labels are known. So the trees
    learn from structure and text, not from one element's name. A page that marks
    no article gives variants around paragraphs of the sample's words.
    """
    rng = random.Random(seed)
    pool = sorted({w for s in sources for w in re.sub(r"<[^>]*>", " ", s).split()[:400] if w.isalpha()})[:20_000] or ["a"]
    rows, labels = [], []
    for source in sources:
        found = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", source, re.S | re.I)
        for variant in range(0 if found else 1, 1 + VARIANTS):
            if found:
                head, body, tail = source[:found.start()], found[2], source[found.end():]
            else:
                head, tail = "<html><body>", "</body></html>"
                body = "".join(f"<p>{' '.join(rng.choice(pool) for _ in range(rng.randint(12, 120)))}.</p>"
                               for _ in range(rng.randint(2, 9)))
            if variant:
                if found and rng.random() < 0.5:
                    head, tail = '<html><body>', "</body></html>"
                extra = [_boilerplate(k, rng, pool) for k in _BOILER_KINDS if rng.random() < 0.5]
                rng.shuffle(extra)
                cut = rng.randint(0, len(extra))
                paragraphs = re.split(r"(?=<p\b)", body)
                for part in [_boilerplate(k, rng, pool) for k in
                             rng.sample(("advert", "share", "related", "comments", "notice"), rng.randint(0, 2))]:
                    paragraphs.insert(rng.choice([rng.randint(0, len(paragraphs)), len(paragraphs)]),
                                      f"<boiler>{part}</boiler>")
                body = "".join(paragraphs)
                head += "".join(f"<boiler>{x}</boiler>" for x in extra[:cut])
                tail = "".join(f"<boiler>{x}</boiler>" for x in extra[cut:]) + tail
                opener, closer = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), (
                    f'<div class="{rng.choice(["content", "post", "entry-content", "story", "main-text", "c1", "x"])}">',
                    "</div>"), ("<div>", "</div>"), ("", ""), (f'<div id="{rng.choice(["main", "content", "p"])}"><article>',
                                                     "</article></div>")])
            else:
                opener, closer = f"<{found[1]}>", f"</{found[1]}>"
            if not opener and rng.random() < 0.5:  # short paragraphs without anything around them
                body = "".join(f"<p>{' '.join(rng.choice(pool) for _ in range(rng.randint(1, 12)))}</p>"
                               for _ in range(rng.randint(1, 3)))
            middle = f"<content>{opener}{body}{closer}</content>"
            if variant and rng.random() < 0.4:
                beside = [f"<boiler>{_boilerplate(k, rng, pool)}</boiler>"
                          for k in rng.sample(("sidebar", "comments", "related", "advert"), rng.randint(0, 2))]
                middle = f'<div class="{rng.choice(["wrap", "container", "page", "row", "site"])}">' + "".join(
                    [*beside[:1], middle, *beside[1:]]) + "</div>"
            whole = head + middle + tail
            page, label = _labelled(whole)
            rows.append(features(page)[1:])
            labels.append(label[1:])
    if not rows:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.concatenate(rows), np.concatenate(labels)


class _Named(Page):
    """A page that also remembers its elements' names."""

    def __init__(self):
        super().__init__()
        self.names = ["#root"]

    def add(self, parent: int, tag: str, attributes: str) -> int:
        self.names.append(tag)
        return super().add(parent, tag, attributes)


def _labelled(source: str) -> tuple[Page, np.ndarray]:
    """Parse a page with <content> and <boiler> marks, take the marks out of the tree, label what was inside."""
    page = parse(source, _Named())
    names = page.names
    label = np.zeros(len(names))
    for i in range(1, len(names)):
        label[i] = 1 if names[i] == "content" else 0 if names[i] == "boiler" else label[page.parent[i]]
    for i in range(len(names) - 1, 0, -1):  # what holds content has to stay for it to stay
        label[page.parent[i]] = max(label[page.parent[i]], label[i])
    real = [i for i, name in enumerate(names) if name not in ("content", "boiler")]
    number = {old: new for new, old in enumerate(real)}

    def lift(i: int) -> int:
        while i > 0 and i not in number:
            i = page.parent[i]
        return number.get(i, -1)

    out = Page()
    out.parent = [-1 if i == 0 else lift(page.parent[i]) for i in real]
    for field in ("tag", "good", "bad", "links", "inner"):
        setattr(out, field, [getattr(page, field)[i] for i in real])
    out.pieces = [(lift(node), text) for node, text in page.pieces]
    return out, label[real]


def train(pages: DataFrame) -> Trees:
    """Fit the trees on a bounded sample of pages; without any page there is nothing to judge and they keep every block."""
    order = F.xxhash64("page_id", F.lit("sample"))
    rows = pages.filter("html is not null").select("page_id", "html").orderBy(order, "page_id").limit(TRAINING_PAGES)
    x, y = training_rows([r["html"] for r in rows.select("html").collect()])
    if not len(y) or y.min() == y.max():
        empty = np.zeros((1, 2 ** DEPTH - 1), np.int32), np.full((1, 2 ** DEPTH - 1), np.inf, np.float32)
        return Trees(*empty, np.zeros((1, 2 ** DEPTH), np.float32), 2.0)
    return boost(x, y)


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every page, read from the whole html.

    A null or empty page has an empty text. Repeated rows give repeated
    results; other columns are ignored; no rows give none. Every page is its
    task's own matter: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, GROUP):
                found += main_texts(batch["html"].slice(start, GROUP).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
