"""Main text of web pages: boosted trees over the features of DOM nodes, decoded along the hierarchy."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import bounded_batches

#: Pages of the sample, most characters of one, layouts drawn for training, seed.
SAMPLE, SAMPLE_CHARS, LAYOUTS, SEED = 80, 30_000, 360, 11
#: Trees, their depth, step, bins of a feature, least second derivative on either side of a cut, damping.
TREES, DEPTH, STEP, BINS, LEAST, DAMP = 80, 4, 0.25, 32, 1.0, 1.0
#: Characters of pages that are scored at once.
BLOCK = 1 << 20

#: Elements without content, elements whose content is no text, elements inside a line, and what closes what.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg object canvas".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
             "time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Kinds of elements, and words of class, id and role that speak against and for main text.
KINDS = [
    set("nav header footer aside menu dialog".split()), set("form fieldset button select option input".split()), {"article", "main"},
    {"section"}, {"div"}, {"p"}, set("h1 h2 h3 h4 h5 h6".split()), set("ul ol dl li dt dd".split()), set("table tbody thead tr td th".split()),
    set("blockquote pre figure figcaption".split()), {"#text"}]
AGAINST = set(
    "ad ads adv advert advertisement advertorial affiliate alert author badge banner bar bottom breadcrumb breadcrumbs button buttons byline "
    "caption-meta carousel categories category comment comments complementary consent contentinfo cookie cookies copyright credits cta discuss "
    "disqus dropdown feedback foot footer form gdpr header hidden legal links list-nav login masthead menu message meta modal more nav "
    "navbar navigation newsletter notice notification overlay pager paginate pagination paywall popular popup privacy promo promoted "
    "promotion rail recommend recommended related replies reply respond search share sharing shop sidebar sidenav signup skip social sponsor "
    "sponsored sticky subscribe subscription subnav tag tags teaser thread toc toolbar top topbar trending warning widget widgets".split())
FOR = set("article articlebody body content entry main page paragraph post prose richtext single story text".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role|hidden|style|data-keep)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?…。，！？]")


class Page:
    """Block elements of a page (``tag``, ``names``, ``parent``, ...; a parent comes before its children) and its text.

    ``blocks``: (node, text, characters inside links) in page order. Elements inside a line belong to the block around them. Text beside
    block elements becomes a node ``#text`` of its own.
    """

    def __init__(self, html: str):
        self.tag, self.names, self.parent, self.keep, self.hidden = ["#page"], [""], [-1], [False], [False]
        self.elements, self.links, self.inputs = [0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        parents = set(self.parent)
        for k, (node, text, linked) in enumerate(self.blocks):
            if node in parents:
                self.blocks[k] = (self._add("#text", "", node), text, linked)

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        names, keep, hidden = [], False, False
        for name, *values in NAMES.findall(attributes) if attributes else ():
            name, value = name.lower(), "".join(values)
            if name == "data-keep":
                keep = True
            elif name == "hidden":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                names.append(value)
        for values, value in ((self.tag, tag), (self.names, " ".join(names)), (self.parent, parent), (self.keep, keep),
                              (self.hidden, hidden), (self.elements, 1), (self.links, 0), (self.inputs, 0)):
            values.append(value)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, pieces, linked, in_link, at = [0], [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                self.blocks.append((stack[-1], text, linked))
            pieces.clear()
            linked = 0

        def text(raw: str) -> None:
            nonlocal linked
            if raw:
                plain = entities.unescape(raw) if "&" in raw else raw
                pieces.append(plain)
                if in_link:
                    linked += len(plain)

        if cut := OPEN_END.search(html, max(0, html.rfind("<"))):
            html = html[:cut.start()]
        while m := TAG.search(html, at):
            text(html[at:m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in INLINE:
                    in_link -= tag == "a" and in_link > 0
                elif tag == "br":
                    pieces.append(" ")
                elif any(self.tag[x] == tag for x in stack):
                    flush()
                    while self.tag[stack.pop()] != tag:
                        pass
                    in_link = 0
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end and not m[3].endswith("/") else at if m[3].endswith("/") else len(html)
                continue
            top = stack[-1]
            self.elements[top] += 1
            if tag in INLINE:
                if tag == "a":
                    in_link += 1
                    self.links[top] += 1
            elif tag in VOID:
                if tag == "input":
                    self.inputs[top] += 1
                if tag in ("br", "hr", "img"):
                    pieces.append(" ")
                if tag == "hr":
                    flush()
            else:
                flush()
                in_link = 0
                closes = CLOSES.get(tag, set())
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = self.tag[stack[k]]
                    if open_tag in WALLS.get(tag, ()) or not (closes or open_tag == "p"):
                        break
                    if open_tag in closes or open_tag == "p":
                        del stack[k:]
                        if not closes:
                            break
                stack.append(self._add(tag, m[3], stack[-1]))
        text(html[at:])
        flush()


FEATURES = (
    ["chars", "share", "words", "density", "linked", "links", "inputs", "blocks", "words_a_block", "marks", "marks_a_word", "depth", "place",
     "siblings", "alike", "starts", "ends", "against", "for", "against_above", "for_above", "hidden", "sign", "has_main", "page_has_main",
     "under_main", "under_edge", "under_form", "paragraphs", "headings", "named", "words_around", "linked_around", "share_around"] + [f"kind{k}" for k in range(len(KINDS))])


def _hits(names: str) -> tuple[int, int]:
    words = [w.lower() for w in WORDS.findall(names)]
    return sum(w in AGAINST for w in words), sum(w in FOR for w in words)


def node_features(page: Page) -> np.ndarray:
    """One row of ``FEATURES`` for each node; sums run over its subtree, which lies behind it."""
    n = len(page.tag)
    chars, words, linked, blocks, marks = (np.zeros(n) for _ in range(5))
    first, last = np.full(n, np.inf), np.zeros(n)
    sign = np.zeros(n)
    offset = 0
    for node, text, inside in page.blocks:
        chars[node] += len(text)
        words[node] += text.count(" ") + 1
        linked[node] += inside
        blocks[node] += 1
        marks[node] += len(MARKS.findall(text))
        sign[node] = max(sign[node], "©" in text)
        first[node] = min(first[node], offset)
        offset += len(text)
        last[node] = offset
    elements, links, inputs = (np.array(x, float) for x in (page.elements, page.links, page.inputs))
    kind = np.zeros((n, len(KINDS)))
    for k, tags in enumerate(KINDS):
        kind[:, k] = [t in tags for t in page.tag]
    paragraphs, headings, main = kind[:, 5].copy(), kind[:, 6].copy(), kind[:, 2].copy()
    hits = np.array([_hits(x) if x else (0, 0) for x in page.names], float).reshape(n, 2)
    parent = page.parent
    depth, above, under = np.zeros(n), np.zeros((n, 2)), np.zeros((n, 3))
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = np.maximum(above[p], hits[p])
        under[i] = np.maximum(under[p], kind[p, [2, 0, 1]])
        children[p].append(i)
    sums = np.stack([chars, words, linked, blocks, marks, elements, links, inputs, paragraphs, headings], 1)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sums[p] += sums[i]
        first[p], last[p] = min(first[p], first[i]), max(last[p], last[i])
        sign[p], main[p] = max(sign[p], sign[i]), max(main[p], main[i])
    chars, words, linked, blocks, marks, elements, links, inputs, paragraphs, headings = sums.T
    place, siblings, alike = np.zeros(n), np.ones(n), np.zeros(n)
    for own in children:
        for k, i in enumerate(own):
            place[i], siblings[i] = k, len(own)
            alike[i] = sum(page.tag[j] == page.tag[i] for j in own[max(0, k - 2):k + 3]) - 1
    total = max(1.0, offset)
    one = lambda x: np.maximum(x, 1)
    up = np.maximum(parent, 0)
    named = np.array([bool(x) for x in page.names], float)
    columns = [
        np.log1p(chars), chars / total, np.log1p(words), chars / one(elements), linked / one(chars), links / one(words), inputs, np.log1p(blocks),
        words / one(blocks), np.log1p(marks), marks / one(words), depth, np.log1p(place), np.log1p(siblings), alike,
        np.where(np.isfinite(first), first, 0) / total, last / total, hits[:, 0], hits[:, 1], above[:, 0], above[:, 1],
        np.array(page.hidden, float), sign, main, np.full(n, main[0]), under[:, 0], under[:, 1], under[:, 2], np.log1p(paragraphs), np.log1p(headings), named,
        words[up] / one(blocks[up]), linked[up] / one(chars[up]), chars[up] / total]
    return np.concatenate([np.stack(columns, 1), kind], 1).astype(np.float32)


def has_text(page: Page) -> np.ndarray:
    out = np.zeros(len(page.tag), bool)
    out[[b[0] for b in page.blocks]] = True
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return out


class Boosted:
    """Gradient-boosted trees of one depth for the log-odds of a class, grown on binned features."""

    def __init__(self):
        self.base, self.feature, self.cut, self.leaf = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((DEPTH, 1 << DEPTH), np.int64), np.full((DEPTH, 1 << DEPTH), np.inf)
            for level in range(DEPTH):
                best = np.full(1 << level, 1e-6)
                pick = np.full((1 << level, 2), -1)
                for j, own in enumerate(edges):
                    if not len(own):
                        continue
                    cell = node * (BINS + 1) + bins[:, j]
                    gs, hs = (np.bincount(cell, w, (1 << level) * (BINS + 1)).reshape(1 << level, -1).cumsum(1) for w in (g, h))
                    gl, hl = gs[:, :len(own)], hs[:, :len(own)]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    gain = gl**2 / (hl + DAMP) + gr**2 / (hr + DAMP) - gs[:, -1:]**2 / (hs[:, -1:] + DAMP)
                    gain[(hl < LEAST) | (hr < LEAST)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(len(at)), at] > best
                    best[better] = gain[np.arange(len(at)), at][better]
                    pick[better] = np.stack([np.full(len(at), j), at], 1)[better]
                for k, (j, at) in enumerate(pick):
                    if j >= 0:
                        feature[level, k], cut[level, k] = j, edges[j][at]
                node = 2 * node + (x[np.arange(len(y)), feature[level, node]] > cut[level, node])
            leaf = STEP * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + DAMP)
            f += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                node = 2 * node + (x[rows, feature[level, node]] > cut[level, node])
            out += leaf[node]
        return out


def decode(page: Page, odds: np.ndarray) -> str:
    """Text of the open nodes. Open nodes form a tree: none lies below a closed one, and of all such trees the one
    with the largest sum of log-odds is taken, so a node is opened only together with all above it if that is worth it."""
    worth = odds.copy()
    for i in range(len(worth) - 1, 0, -1):
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    is_open = worth > 0
    for i in range(1, len(worth)):
        is_open[i] &= is_open[page.parent[i]]
    return " ".join(text for node, text, _ in page.blocks if is_open[node])


def labels(page: Page, by_element: bool = False) -> np.ndarray | None:
    """Whether a node holds main text: as marked, or as a page says that has one ``article`` or ``main`` (else None)."""
    keep = np.array(page.keep)
    if by_element:
        tops = [i for i, t in enumerate(page.tag) if t in KINDS[2]]
        if len(tops) != 1:
            return None
        keep[tops[0]] = True
    inside = np.zeros(len(keep), bool)
    for i in range(1, len(keep)):
        edge = page.tag[i] in KINDS[0] | KINDS[1] if by_element else False
        inside[i] = keep[i] or inside[page.parent[i]] and not edge
    out = np.zeros(len(keep), bool)
    for node, *_ in page.blocks:
        out[node] |= inside[node]
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return out


def layout(rng: random.Random, long: Sequence[str], short: Sequence[str]) -> str:
    """A page of drawn structure around given texts; blocks of main text are marked ``data-keep``."""
    some = lambda low, high: range(rng.randint(low, high))
    words = lambda low, high: " ".join(rng.choice(short) for _ in some(low, high))
    sentence = lambda: rng.choice(long)
    pick = rng.choice

    def box(tags: str, names: str, content: str) -> str:
        """An element; the more telling its tag, the less its names need to say."""
        tag = pick(tags.split())
        name = pick(names.split()) if tag in ("div", "p", "li", "ul", "article") or rng.random() < 0.5 else ""
        attribute = f' {pick(["class", "class", "id"])}="{pick(["", "", "site-", "c-"])}{name}"' if name else ""
        return f"<{tag}{attribute}>{content}</{tag}>"

    menu = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in some(2, k)) + "</ul>"
    ad = lambda: box("div div aside p", "ad ads advert sponsored promo banner", pick([sentence(), words(2, 9), f"<p>{sentence()}</p>", f'<a href="#">{words(2, 6)}</a>']))
    side = lambda: box("aside div div", "sidebar widget rail secondary related popular", "".join(
        f"<h3>{words(1, 3)}</h3>" + pick([menu(6), f"<p>{sentence()}</p>", f"<p>{words(4, 12)}</p><p>{sentence()}</p>"]) for _ in some(1, 3)))
    notice = lambda: box("div div section", "cookie-notice notice alert consent popup newsletter banner", pick([
        f"<p>{sentence()}</p><button>{words(1, 2)}</button>", sentence(), f"{words(4, 12)} <a href='#'>{words(1, 2)}</a>"]))
    form = lambda: pick([
        f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>",
        f'<form class="search"><p>{words(3, 9)}</p><input><select><option>{words(1, 1)}<option>{words(1, 1)}</select></form>'])
    comment = lambda: box("li div article", "comment reply", f"<b>{words(1, 2)}</b><p>{sentence()}</p>" + pick(["", f"<p>{sentence()}</p>"]))
    comments = lambda: box("section div ol", "comments replies discussion disqus respond", f"<h3>{words(1, 3)}</h3>" + "".join(comment() for _ in some(1, 6)))
    meta = lambda: box("div p ul", "meta tags share social byline breadcrumb", pick([words(2, 6), menu(5), f'<a href="#">{words(1, 2)}</a> {words(1, 3)}']))
    keep = ' data-keep="1"'

    def paragraph() -> str:
        text = sentence() if rng.random() < 0.85 else words(1, 4).capitalize() + "."
        if rng.random() < 0.15:
            return f"<p{keep}><b>{text}<br>"
        if rng.random() < 0.2:
            parts = text.split(" ")
            k = rng.randrange(len(parts))
            text = " ".join([*parts[:k], f'<a href="/x">{parts[k]}</a>', *parts[k + 1:]])
        return f"<p{keep}>{text}" + pick(["</p>", "</p>", "</p>", ""])

    body = [f"<h1{keep}>{pick([words(2, 9), sentence()[:60]])}</h1>"] if rng.random() < 0.85 else []
    for _ in some(1, pick([1, 2, 6, 14, 30])):
        body.append(pick([paragraph] * 12 + [
            lambda: f"<h2{keep}>{words(1, 6)}</h2>", lambda: f"<ul>{''.join(f'<li{keep}>{pick([sentence(), words(2, 8)])}</li>' for _ in some(2, 6))}</ul>",
            lambda: f"<blockquote{keep}>{sentence()}</blockquote>", lambda: f"<pre{keep}>{words(5, 20)}</pre>",
            lambda: f"<table><tr><td{keep}>{words(1, 3)}</td><td{keep}>{words(1, 5)}</td></tr></table>"])())
        if rng.random() < 0.06:
            body.append(pick([ad, ad, meta, side, form])())
    text = "".join(body)
    if rng.random() < 0.4:
        text = f'<div class="{pick(["entry-content", "article-body", "post-text", "inner", "wrap"])}">{text}</div>'
    if rng.random() < 0.4:
        text = pick([meta() + text, text + meta(), meta() + text + meta()])
    name = pick(["content", "main", "post", "article", "story", "entry", "page-text", "col-8", ""])
    tag = pick(["article", "article", "article", "main", "div", "div", "section", "td"])
    text = f'<{tag}{f" {pick(["class", "id"])}={chr(34)}{name}{chr(34)}" if name and rng.random() < (0.3 if tag in KINDS[2] else 0.8) else ""}>{text}</{tag}>'
    if tag == "td":
        text = f"<table><tr><td>{menu(6)}</td>{text}</tr></table>"
    parts = [text]
    for make, chance in ((side, 0.6), (comments, 0.45), (ad, 0.3), (form, 0.25), (side, 0.2)):
        if rng.random() < chance:
            parts.insert(pick([0, len(parts), len(parts)]) if make is not comments else len(parts), make())
    text = "".join(parts)
    if rng.random() < 0.5:
        text = f'<div class="{pick(["wrapper", "container", "page", "row", "site"])}">{text}</div>'
    before = [make() for make, chance in (
        (notice, 0.3), (lambda: box("header div", "header masthead topbar top", f"<a href='/'>{words(1, 2)}</a>" + pick(["", f"<p>{words(2, 9)}</p>", menu(5)])), 0.5),
        (lambda: box("nav nav div", "nav menu navbar navigation", menu(9)), 0.8), (ad, 0.5), (form, 0.1)) if rng.random() < chance]
    after = [make() for make, chance in (
        (side, 0.2), (form, 0.15), (ad, 0.2), (notice, 0.2),
        (lambda: box("footer footer div", "footer copyright legal bottom", pick(["&copy; ", "", "(c) "]) + pick([sentence(), words(2, 9), menu(5) + words(2, 6)])), 0.85)) if rng.random() < chance]
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{text}{''.join(after)}</body></html>"


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE, layouts: int = LAYOUTS) -> Boosted:
    """Trees that tell nodes with main text from others. No page comes with labels, so they are made:

    the texts of a bounded sample (``sample`` pages of at most ``SAMPLE_CHARS`` characters, by a hash of their key and text) are set into
    ``layouts`` drawn layouts in which the main text is known; pages of the sample that have just one ``article`` or ``main`` are
    taken as they are, too. Trains on the driver, on that sample only. No text at all: made-up words take its place.
    """
    # About four times the sample passes a filter on the hash, so that tasks without a chosen page send nothing.
    pages = pages.select(html, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), html).alias("h"))
    share = min(1.0, 4 * sample / max(1, pages.count()))
    rows = (
        pages.filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).filter(F.length(html) <= SAMPLE_CHARS)
        .orderBy("h", html).limit(sample).collect())
    own = [Page(r[0]) for r in rows]
    texts = sorted({b[1] for p in own for b in p.blocks})
    rng = random.Random(SEED)
    spare = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    short = [w for w in sorted({w for t in texts for w in t.split()}) if len(w) < 15]
    short = (short if len(short) >= 100 else short + spare)[:5000]
    long = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts if t.count(" ") >= 5]
    if len(long) < 50:
        long = long + [" ".join(rng.choice(spare) for _ in range(rng.randint(6, 60))).capitalize() + "." for _ in range(200)]
    short = [w.replace("&", "&amp;").replace("<", "&lt;") for w in short]
    shown = [(p, y) for p in own if (y := labels(p, by_element=True)) is not None]
    shown += [(p, labels(p)) for p in (Page(layout(rng, long, short)) for _ in range(layouts))]
    x = np.concatenate([node_features(p)[has_text(p)] for p, _ in shown])
    y = np.concatenate([own[has_text(p)] for p, own in shown])
    return Boosted().fit(x, y.astype(float))


def main_texts(pages: Sequence[str | None], model: Boosted) -> list[str]:
    """Main text of each page; the nodes of all pages are scored in one go."""
    read = [Page(h or "") for h in pages]
    odds = model.log_odds(np.concatenate([node_features(p) for p in read])) if read else []
    out, at = [], 0
    for p in read:
        own = np.where(has_text(p), odds[at:at + len(p.tag)], 0.0)
        out.append(decode(p, own))
        at += len(p.tag)
    return out


def extract(df: DataFrame, model: Boosted, html: str = "html") -> DataFrame:
    """Adds ``text``, the main text of each page (a column of this name is replaced).

    Character references are decoded; white space inside a block becomes one space, blocks are joined by one in page order. Scripts,
    styles and other content that is no text never count. Null or empty html gives "". Pages are read where they lie, whole, a few at
    a time; no shuffle.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        out: list[str] = []
        for group in _groups(values):
            out += main_texts(group, model)
        return pa.array(out, pa.string())

    return df.withColumn("text", run(F.col(html)))


def _groups(values: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for value in values:
        group.append(value.as_py())
        size += len(group[-1] or "")
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_boosted_dom_text": (q_pages, None)}
