"""Main text of web pages: the maximum-scoring run of their words and tags.

A page is a sequence of tokens: words, and tags by name. The score of a word is the sum of what is
known about its block, its links, the elements around it and their class names; tags score negative.
These weights are log odds of lying inside the content of labelled pages, with prior values for what
those pages don't show. The best contiguous run is found in one linear scan, and its blocks are the
text. An element of negative sum that names itself boilerplate (an advert within an article) is left
out, and costs the run around it a bounded amount.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import as_bytes, bounded_sample, slices

#: Bound of the sample of labelled pages (pages with an <article> or <main>), and tokens that a feature's weight takes.
SAMPLE, SUPPORT, NAME_SUPPORT = 2_000, 5, 50
#: Largest weight of a token either way, and the weights without labelled pages: published values for words and tags.
LIMIT, WORD_WEIGHT, TAG_WEIGHT = 4.0, 1.0, -3.25
#: Prior weights of words in elements that name themselves boilerplate, surely or perhaps.
SURE, PERHAPS = -8.0, -2.0
#: What an element that is left out costs the run around it, at most; within the page's own marks it costs nothing.
LEFT_OUT = -12.0
#: Share of a page's words in <article> or <main>, from which these count as its own marks.
SHARE = 0.3
#: Tags that have no end by their quotes, after which a page's quotes are no longer trusted.
BROKEN = 8

# Names of HTML elements, and usual names of boilerplate.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
OPTIONAL = frozenset("noscript template noembed noframes".split())  # of these, ones never closed are ignored
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu fieldset head".split())
CONTAINERS = BOILERPLATE | frozenset("div section article main ul ol dl center details figure".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark math q rp rt ruby s samp select small span strike strong"
    " sub sup svg time tt u var wbr br"
    " mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mfenced mstyle semantics g text tspan path circle rect line use".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset("td th".split())
HEADISH = frozenset("head base link meta title script style noscript template".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr notice notices sidebar nav navbar navigation"
    " menu breadcrumb breadcrumbs masthead footer comment comments disqus respond replies newsletter subscribe signup popup modal pagination".split()
)
DOUBTFUL = frozenset("alert banner form header login overlay pager promotion recommended related reply search share sharing skip social subscription toolbar widget".split())
GENERIC = frozenset(
    "area article articles aside bar block body bottom box btn button buttons card cards col column container content entry fixed global group header icons inner"
    " item items left link links list main message more news outer page panel post posts primary region right row secondary section site slot small stories story"
    " sub text thread top unit wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar".split())

#: Tags within a sentence, which part nothing.
_FREE = frozenset(f"{k}{n}" for k in ("<", "</") for n in INLINE - {"a"})
#: An equals sign opens a quote only right before it; possessive, so nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
_BRACKET = re.compile("[<>]")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _lexed(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) of each piece: kind "" for text; "<" or "</" for tags, whose attributes are the content.

    Comments, declarations and the content of raw elements are left out. Each character is looked at
    a bounded number of times, whatever is left open: a missing end is looked for once per name.
    """
    at, n, last, broken = 0, len(html), html.rfind(">"), 0
    ends: dict[str, re.Match | None] = {}

    def end_of(name: str, start: int) -> re.Match | None:
        if name not in ends or (ends[name] is not None and ends[name].start() < start):
            ends[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, start)
        return ends[name]

    while at < n:
        lt = html.find("<", at)
        if lt != at:
            yield "", "", html[at : lt if lt >= 0 else n]
            if lt < 0:
                return
        at = lt
        if html.startswith("<!--", at):
            if html.startswith(("<!-->", "<!--->"), at):
                at = html.index(">", at) + 1
                continue
            end = _COMMENT_END.search(html, at + 4)
            if end is None:
                return  # as browsers do: an open comment goes to the end
            at = end.end()
            continue
        if html.startswith(("<!", "<?"), at) or (html.startswith("</", at) and not html[at + 2 : at + 3].isalpha()):
            at = html.index(">", at) + 1 if at < last else n
            continue
        head = _START.match(html, at)
        if head is None or not head[2][0].isascii():
            yield "", "", "<"
            at += 1
            continue
        m = _TAG.match(html, at) if at < last and broken < BROKEN else None
        if m is not None:
            closing, name, attributes, at = m[1], m[2], m[3], m.end()
        else:  # no end by its quotes: the next bracket ends it
            broken += at < last
            closing, name = head[1], head[2]
            found = _BRACKET.search(html, head.end())
            end = found.start() if found else n
            attributes, at = html[head.end() : end], end + (found is not None and found[0] == ">")
        name = name.lower()
        if name in RAW and not closing:
            end = end_of(name, at)
            if attributes.rstrip().endswith("/") and (end is None or re.compile(rf"<{name}(?=[\s/>])", re.IGNORECASE).search(html, at, end.start())):
                continue
            if end is None and name in OPTIONAL:
                continue
            if name == "xmp":
                yield "<", "pre", ""
                yield "", "", html[at : end.start() if end else n].replace("&", "&amp;")
                yield "</", "pre", ""
            at = end.end() if end else n
            continue
        yield ("</" if closing else "<"), name, attributes


def _evidence(name: str, attributes: str) -> tuple[tuple[str, ...], float]:
    """(name parts, prior weight) of an element by its class, id and role. A value is a name of boilerplate only as a whole:
    each of its parts is such a name or a generic one, so "ad-box" is, and "related-work" isn't."""
    parts: list[str] = []
    weight = 0.0
    for m in _NAMED.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            weight = min(weight, SURE if value.strip().lower() in ROLES else PERHAPS if value.strip().lower() == "alert" else 0.0)
            continue
        for one in value.split():
            own = _PART.findall(_CAMEL.sub("-", one).lower())
            parts += own
            if all(p in NAMES or p in DOUBTFUL or p in GENERIC or len(p) < 3 or p.isdigit() for p in own):
                weight = min(weight, SURE if not NAMES.isdisjoint(own) else PERHAPS if not DOUBTFUL.isdisjoint(own) else 0.0)
    return tuple(dict.fromkeys(parts)), weight


class Page:
    """Tokens of a page, and the elements that hold them.

    ``tokens``: (feature, text, element); tags have "<p" or "</p" and no text, runs of text "w:" and
    the name of their block, with "/a" in links. ``elements``: [parent, name, parts, prior weight,
    whether it lies in the page's own marks, whether it holds main content by its tags].
    """

    def __init__(self, html: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        self.elements: list[list] = [[0, "", (), 0.0, False, False]]
        stack, opened = [0], Counter()
        block, links, named = "", 0, 0  # the block, whether in a link, and the open elements that are boilerplate by name
        pieces = list(_lexed(html))
        closes = Counter(name for kind, name, _ in pieces if kind == "</" and name in CONTAINERS)
        headings: list[int] = []

        def pop() -> None:
            nonlocal named
            gone = self.elements[stack.pop()]
            opened[gone[1]] -= 1
            named -= gone[3] <= SURE

        for kind, name, content in pieces:
            if not kind:
                if not content.isspace():
                    while self.elements[stack[-1]][1] == "head":
                        pop()
                    self.tokens.append((f"w:{block}{'/a' if links else ''}", unescape(content), stack[-1]))
                continue
            if kind == "</":
                element = stack[-1]
                if name in CONTAINERS:
                    closes[name] -= 1
                    if opened[name]:
                        while self.elements[stack[-1]][1] != name:
                            pop()
                        pop()
                if name == "a":
                    links = 0
                if name not in INLINE:
                    block = ""
                self.tokens.append(("</" + name, "", element))
                continue
            while self.elements[stack[-1]][1] == "head" and name not in HEADISH:
                pop()
            if name in ("article", "main"):  # boilerplate that is never closed was left open by mistake
                while named and len(stack) > 1 and not closes[self.elements[stack[-1]][1]]:
                    pop()
            if name in CONTAINERS and not (name not in ("button", "select") and content.rstrip().endswith("/") and not closes[name]):
                parent = self.elements[stack[-1]]
                parts, weight = _evidence(name, content)
                if name in BOILERPLATE and not (name == "header" and parent[4]):
                    weight = SURE
                mark = name in ("article", "main") and weight > SURE
                if mark:
                    headings.append(len(self.elements))
                self.elements.append([stack[-1], name, parts, weight, parent[4] or mark, mark and name == "main"])
                stack.append(len(self.elements) - 1)
                opened[name] += 1
                named += weight <= SURE
            elif name == "h1":
                headings.append(-stack[-1] - 1)
            if name == "a":
                links = 1
            elif name not in INLINE:
                links, block = 0, name
            self.tokens.append(("<" + name, "", stack[-1]))
        self._waive(headings)

    def _waive(self, headings: list[int]) -> None:
        """A form around an <article> or <main> isn't boilerplate, nor by its class what is around <main>, or an <article> and an <h1>."""
        holds = [0] * len(self.elements)  # 1 an article, 2 an h1, 4 main
        for k in headings:
            holds[k if k >= 0 else -k - 1] |= 2 if k < 0 else 4 if self.elements[k][5] else 1
        for k in range(len(self.elements) - 1, 0, -1):
            holds[self.elements[k][0]] |= holds[k]
            name = self.elements[k][1]
            if holds[k] & 5 if name == "form" else name not in BOILERPLATE and (holds[k] & 4 or holds[k] & 3 == 3):
                self.elements[k][3] = 0.0


def _n_words(text: str) -> int:
    return len(text.split())


def best_run(scores: list[float]) -> tuple[int, int]:
    """Range [first, end) of the largest sum; the first of equals, and the shortest; empty if no score is positive."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


def scored(page: Page, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether its element is left out of the text."""
    words = [_n_words(t) if t else 0 for _, t, _ in page.tokens]
    inside = outside = 0
    own, about = [0.0], [0.0]  # an element's own weight, and with those of the elements around it
    for parent, _name, parts, prior, _marked, _main in page.elements[1:]:
        named = sum(weights.get("c:" + p, 0.0) for p in parts)
        own.append(prior if prior <= SURE else prior + named)
        about.append(about[parent] + own[-1])
    for n, (_f, _t, k) in zip(words, page.tokens, strict=True):
        if about[k] > SURE:
            inside, outside = inside + n * page.elements[k][4], outside + n * (not page.elements[k][4])
    by_marks = inside >= SHARE * (inside + outside) > 0
    scores = []
    for n, (f, text, k) in zip(words, page.tokens, strict=True):
        marks = 0.0 if not by_marks else weights.get("m:in", LIMIT) if page.elements[k][4] else weights.get("m:out", -LIMIT)
        if not text:
            tag = weights.get(f, TAG_WEIGHT)
            scores.append(0.0 if f in _FREE else max(-LIMIT, min(max(tag, 0.0), tag + marks)))
            continue
        scores.append(n * max(-LIMIT, min(LIMIT, min(LIMIT, weights.get(f, WORD_WEIGHT) + marks) + about[k])))
    sums = [0.0] * len(own)
    for s, (_f, text, k) in zip(scores, page.tokens, strict=True):
        sums[k] += s if text else 0.0  # its words decide whether an element is left out
    cut = [False] * len(own)
    for k in range(len(own) - 1, 0, -1):
        cut[k] = own[k] < 0 and sums[k] < 0
        if cut[k]:
            sums[k] = 0.0 if by_marks and page.elements[k][4] else max(sums[k], LEFT_OUT)
        sums[page.elements[k][0]] += sums[k]
    top = list(range(len(own)))  # the outermost element left out around each
    for k in range(1, len(own)):
        above = page.elements[k][0]
        top[k] = top[above] if cut[above] else k
        cut[k] = cut[k] or cut[above]
    paid: set[int] = set()
    for i, (_f, _t, k) in enumerate(page.tokens):
        if cut[k]:
            scores[i] = 0.0 if top[k] in paid else sums[top[k]]
            paid.add(top[k])
    return scores, [cut[k] for _, _, k in page.tokens]


def extract(html: str, weights: dict[str, float]) -> str:
    """Main text of a page: blocks joined by a newline, white space inside a block as one space."""
    page = Page(html)
    scores, left_out = scored(page, weights)
    first, end = best_run(scores)
    blocks: list[list[str]] = [[]]
    for (f, text, _), out in zip(page.tokens[first:end], left_out[first:end], strict=True):
        if text:
            if not out:
                blocks[-1].append(text)
        elif (name := f.lstrip("</")) in CELLS or name == "br":
            blocks[-1].append(" ")
        elif name not in INLINE:
            blocks.append([])
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def _labelled(html: str) -> tuple[Counter, Counter] | None:
    """Counts of features inside and outside the content of a labelled page.

    Tokens in elements that name themselves boilerplate count for these names alone.
    """
    page = Page(html)
    if not any(e[4] for e in page.elements):
        return None
    within, without = Counter(), Counter()
    sure = [False] * len(page.elements)
    words = [[0, 0] for _ in page.elements]
    for k, (parent, _n, _p, prior, _m, _h) in enumerate(page.elements):
        sure[k] = sure[parent] or prior <= SURE
    for f, text, k in page.tokens:
        n = _n_words(text) if text else 1
        inside = page.elements[k][4] and not sure[k]
        if text:
            words[k][not inside] += n
        if not sure[k]:
            (within if inside else without)[f] += n
            if text:
                (within if inside else without)["m:in" if inside else "m:out"] += n
    for k in range(len(page.elements) - 1, 0, -1):
        parent, _name, parts = page.elements[k][:3]
        for j, count in enumerate((within, without)):
            words[parent][j] += words[k][j]
            for p in parts:
                count["c:" + p] += words[k][j]
    return within, without


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights of the token features: log odds of lying in the content of labelled pages.

    Labelled are the pages with an <article> or <main>; at most ``sample`` of them are used, the
    first by a hash of the id. Without any, words and tags have the published weights.
    """
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    ids = bounded_sample(marked.select("id"), "id", sample).distinct()
    chosen = marked.join(F.broadcast(ids), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, without = Counter(), Counter()
        for b in batches:
            for h in as_bytes(b.column(0)):
                if counts := _labelled(h.decode()):
                    within.update(counts[0])
                    without.update(counts[1])
        names = sorted({*within, *without})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([within[n] for n in names], pa.int64()), pa.array([without[n] for n in names], pa.int64())], ["feature", "inside", "outside"])

    counts = chosen.select("html").mapInArrow(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    enough = F.when(F.col("feature").startswith("c:"), NAME_SUPPORT).otherwise(SUPPORT)
    out = {r.feature: float(np.clip(np.log((r.inside + 0.5) / (r.outside + 0.5)), -LIMIT, LIMIT)) for r in counts.filter(F.col("inside") + F.col("outside") >= enough).collect()}
    for f in out:  # a tag is no reason by itself to prefer a region, but for the marks of content
        if "<" in f and f.lstrip("</") not in ("article", "main", "p", "h1"):
            out[f] = min(out[f], 0.0)
    return out


def main_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` with a last column ``main_text``: the text of each whole page, '' if there is none or the page is null.

    A column of that name is replaced. No shuffle; repeated pages give repeated rows.
    """
    pages = pages.drop("main_text")
    names = [f"c{i}" for i in range(len(pages.columns))]
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            texts = [extract(h.decode(), weights) for h in as_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "main_text"])

    flat = pages.toDF(*names)
    return flat.mapInArrow(run, flat.select("*", F.lit("").alias("main_text")).schema).toDF(*pages.columns, "main_text")
