"""Main text of HTML pages by a tree-structured graphical model.

Block elements of the DOM are nodes with two states, content or not.  Unary potentials
come from features (tag, class and id words, link share, text length, sentence marks,
depth), parent-child potentials from the states of linked nodes; both are smoothed counts
over labelled pages.  Sum-product messages go up from the leaves and down from the root,
and the text of nodes whose content marginal exceeds one half is the result.

Script, style and other elements without readable text are left out while parsing; forms
are nodes, so that a form around a whole page does not hide it.  Text runs between block
boundaries are blocks: character references are decoded, white space becomes one space,
and blocks are joined by a line feed in page order.

Null and empty html give an empty text.  Malformed markup never fails: unclosed elements,
also those that are left out, end with their parent; stray end tags are ignored; a "<"
that no ">" follows is text; an attribute value without its closing quote ends at ">".
Elements nested deeper than ``MAX_DEPTH`` belong to the deepest open one.  Time is linear
in the page.  Each row is handled by itself, so repeated rows give repeated results.
Pages of any length are read whole.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import labelled_pages
from .shuffle import small_batches

MAX_DEPTH = 512
_NONE: dict[str, str] = {}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
_RAW = set("script style textarea title noscript template xmp noembed noframes iframe".split())
_SKIP = set("button select option datalist object svg canvas audio video annotation annotation-xml map dialog head".split())
_IN_HEAD = set("base basefont bgsound link meta title script style noscript template head".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What a start tag closes, and what the search for it does not pass.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot"}, "thead": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"}}
_TABLE_PART = {"tr", "td", "th", "tbody", "thead", "tfoot"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PASSED = {"p", "div", "address"}
_P_SCOPE = {"td", "th", "table", "caption", "html", "button", "object", "li", "body"}


_P = {"p"}


def _out_of_p(tag: str) -> bool:
    return tag not in _P_SCOPE


def _in_table(tag: str) -> bool:
    return tag != "table"


def _anywhere(tag: str) -> bool:
    return True


@dataclass
class Page:
    """Nodes in document order (a parent comes before its children) and the text runs."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: dict[str, str], labelled: bool) -> int:
        found = [x.lower() for k in ("class", "id", "role") if k in attributes for x in _NAME.findall(attributes[k])] if attributes else ()
        label = int(attributes["data-y"]) if labelled and "data-y" in attributes else None
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(tuple(dict.fromkeys(found)))
        self.label.append(label if label is not None or parent < 0 else self.label[parent])
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append(0)
        return len(self.parent) - 1


def _text(raw: str) -> str:
    return " ".join((_html.unescape(raw) if "&" in raw else raw).split())


class _Finder:
    """Where the next of a string is from ascending places on; no part of the page is searched twice for it."""

    def __init__(self, source: str):
        self.source = source
        self.known: dict[str, int] = {}

    def find(self, wanted: str, at: int) -> int:
        found = self.known.get(wanted, 0)
        if 0 <= found < at:
            found = self.known[wanted] = self.source.find(wanted, at)
        return found


@cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile("</" + re.escape(tag), re.I | re.A)


class _Ends(_Finder):
    """Where the next end tag of a name is, in any case."""

    def find(self, tag: str, at: int) -> int:
        found = self.known.get(tag, 0)
        if 0 <= found < at:
            m = _end_tag(tag).search(self.source, at)
            found = self.known[tag] = m.start() if m else -1
        return found


def _attributes(source: str, at: int, finder: _Finder) -> tuple[dict[str, str], int]:
    """Attributes (the first of each name) from ``at`` on and the place after the tag's ">"; each character is passed once."""
    found: dict[str, str] = {}
    end = len(source)
    while True:
        at = _GAP.match(source, at).end()
        if at >= end:
            return found, end
        if source[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE_NAME.match(source, at)
        name, at = m[0].lower(), m.end()
        m = _EQUALS.match(source, at)
        if not m:
            found.setdefault(name, "")
            continue
        at = m.end()
        quote = source[at : at + 1]
        stop = finder.find(quote, at + 1) if quote in ("'", '"') and quote else -1
        if stop >= 0:
            after = source[stop + 1 : stop + 2]
            if after and after not in " \t\r\n\f/>" and 0 <= source.find(">", at, stop):
                stop = -1  # the quote opens another value: this one was never closed
        if stop >= 0:
            found.setdefault(name, source[at + 1 : stop])
            at = stop + 1
        else:
            m = _PLAIN_VALUE.match(source, at)
            found.setdefault(name, m[0].strip("\"'"))
            at = m.end()


class _Parser:
    """One pass over a page: open elements on a stack, text runs cut at block boundaries."""

    def __init__(self, source: str, labelled: bool):
        self.source, self.labelled, self.finder = source, labelled, _Finder(source)
        self.ends = _Ends(source)
        self.page = Page()
        self.stack: list[tuple[str, int, bool]] = [("html", self.page.add(-1, "html", {}, False), False)]  # tag, node, left out
        self.open: defaultdict[str, int] = defaultdict(int)
        self.skipped = self.deeper = self.linked = 0
        self.in_link = False
        self.run: list[str] = []

    def flush(self) -> None:
        if self.run:
            text = _text("".join(self.run))
            self.run.clear()
            if text:
                node, page = self.stack[-1][1], self.page
                page.runs.append((node, text))
                page.chars[node] += len(text)
                page.linked[node] += min(self.linked, len(text))
                page.marks[node] += text.count(". ") + text.count("? ") + text.count("! ") + text.endswith((".", "!", "?"))
        self.linked = 0

    def text(self, piece: str) -> None:
        if self.skipped and self.stack[-1][0] == "head" and piece.strip():
            self.close_from(len(self.stack) - 1)
        if not self.skipped:
            self.run.append(piece)
            if self.in_link:
                self.linked += len(piece)

    def close_from(self, k: int) -> None:
        """Closes the k-th open element and all inside it."""
        left_out_here = sum([x[2] for x in self.stack[k:]]) if self.skipped else 0
        if self.skipped == left_out_here and not self.stack[k][2]:
            self.flush()
        for tag, _, left_out in self.stack[k:]:
            self.open[tag] -= 1
            self.skipped -= left_out
        del self.stack[k:]
        self.in_link = False

    def last(self, tags: set[str], passed) -> int:
        """Place of the innermost open element of these, or 0; elements on the way must be passable."""
        is_open = self.open
        if any([is_open[t] for t in tags]):
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.stack[k][0]
                if tag in tags:
                    return k
                if not passed(tag):
                    break
        return 0

    def start(self, tag: str, attributes: dict[str, str], at: int) -> None:
        top = self.stack[-1][0]
        if (top == "head" and tag not in _IN_HEAD) or (top == "svg" and tag in _BLOCK):
            self.close_from(len(self.stack) - 1)
        if tag == "hr":
            self.flush()
        elif tag == "br":
            self.text(" ")
        if tag in _VOID or tag == "html" or (tag in ("body", "form") and self.open[tag] > 0):
            return
        if tag == "a":
            self.in_link = True
        block = tag in _BLOCK or (tag in ("ins", "del") and ("class" in attributes or "id" in attributes))
        left_out = tag in _SKIP and (tag == "head" or self.ends.find(tag, at) >= 0)
        if not block and not left_out:
            return
        if block:
            if not self.skipped:
                self.flush()
            self.in_link = False
            if self.open["p"] and tag in _ENDS_P and (k := self.last(_P, _out_of_p)):
                self.close_from(k)
            if tag in _CLOSES and (k := self.last(_CLOSES[tag], _in_table if tag in _TABLE_PART else _PASSED.__contains__)):
                self.close_from(k)
        if len(self.stack) >= MAX_DEPTH:
            self.deeper += 1
            return
        node = self.page.add(self.stack[-1][1], tag, attributes, self.labelled) if block and not self.skipped else self.stack[-1][1]
        self.stack.append((tag, node, left_out))
        self.open[tag] += 1
        self.skipped += left_out

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag == "br":
            self.text(" ")
        elif tag in _BLOCK or tag in _SKIP or tag in ("ins", "del"):
            if tag in _BLOCK and not self.skipped:
                self.flush()
            if self.deeper and tag in _BLOCK:
                self.deeper -= 1
            elif tag in ("html", "body"):
                return
            elif self.stack[-1][0] == tag:
                self.close_from(len(self.stack) - 1)
            elif (k := self.last(_HEADINGS if tag in _HEADINGS else {tag}, _anywhere if tag == "table" or tag in _TABLE_PART else _in_table)):
                self.close_from(k)

    def parse(self) -> Page:
        source, end, at = self.source, len(self.source), 0
        last_gt = source.rfind(">")
        while at < end:
            lt = source.find("<", at)
            if lt < 0 or lt > last_gt:  # no tag can end any more
                self.text(source[at:])
                break
            if lt > at:
                self.text(source[at:lt])
            if source.startswith("<!--", lt):
                stop = self.finder.find("-->", lt + 4)
                at = stop + 3 if stop >= 0 else source.index(">", lt) + 1
                continue
            closing = source.startswith("</", lt)
            m = _TAG_NAME.match(source, lt + 1 + closing)
            if m is None:
                if source[lt + 1] in "!?/":
                    at = source.index(">", lt) + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            tag = m[0].lower()
            at = m.end()
            if source.startswith(">", at):
                attributes, at = _NONE, at + 1
            else:
                attributes, at = _attributes(source, at, self.finder)
            if closing:
                self.end(tag)
            elif tag in _RAW:
                # its text is left out; without its end tag, up to the next end tag
                stop = self.ends.find(tag, at)
                stop = stop if stop >= 0 else self.finder.find("</", at)
                at = end if stop < 0 else stop
            else:
                self.start(tag, attributes, at)
                if tag in _SKIP and source[at - 2] == "/" and self.stack[-1][0] == tag:
                    self.close_from(len(self.stack) - 1)
        self.flush()
        return self.page


def parse(source: str, labelled: bool = False) -> Page:
    """The page's tree; ``labelled`` reads the states of training pages from data-y."""
    return _Parser(source, labelled).parse()


_LEAF = set("p li h1 h2 h3 h4 h5 h6 blockquote dt dd pre td th tr tbody thead figcaption caption summary legend".split())
_PLAIN = set("div ul ol dl section table figure details center hgroup".split())


def edge_kind(page: Page, i: int) -> int:
    """Which potential links node i to its parent: text elements and plain containers without names, the body, or others."""
    return 3 if page.tag[i] == "body" else 2 if page.names[i] else 0 if page.tag[i] in _LEAF else 1 if page.tag[i] in _PLAIN else 2


_BUCKETS = (0, 20, 60, 150, 400, 1200)


def features(page: Page) -> list[list[str]]:
    """Names of the features of each node."""
    n = len(page.parent)
    chars, linked, marks = page.chars[:], page.linked[:], page.marks[:]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
    out = []
    for i in range(n):
        size = chars[i]
        share = linked[i] / size if size else 0.0
        own = page.chars[i]
        found = [] if page.tag[i] in ("html", "body") else ["t:" + page.tag[i]]
        found += ["n:" + x for x in page.names[i]]
        found.append("l:" + ("0" if share < 0.05 else "1" if share < 0.3 else "2" if share < 0.7 else "3"))
        found += ["c:" + str(sum(size > b for b in _BUCKETS)), "o:" + str(sum(own > b for b in _BUCKETS))]
        found += ["m:" + str(min(marks[i], 4)), "u:" + ("0" if page.names[i] else "1")]
        out.append(found)
    return out


#: Features that say the same thing count less.
WEIGHT = {"c": 0.3, "o": 0.3, "m": 0.3, "u": 0.5}


@dataclass
class Model:
    unary: dict[str, float]
    turn: list[list[list[float]]]  # turn[kind][parent][child]


def fit(pages: Iterable[str], smooth: float = 0.5) -> Model:
    """Potentials from labelled pages: log ratios of feature frequencies, and state pairs of parent and child."""
    seen: dict[str, list[float]] = defaultdict(lambda: [smooth, smooth])
    total, pairs = [1.0, 1.0], [[[smooth, smooth], [smooth, smooth]] for _ in range(4)]
    for source in pages:
        page = parse(source, labelled=True)
        label = [y or 0 for y in page.label]
        for i, names in enumerate(features(page)):
            total[label[i]] += 1
            for name in names:
                seen[name][label[i]] += 1
            if i:
                pairs[edge_kind(page, i)][label[page.parent[i]]][label[i]] += 1
    unary = {k: math.log(v[1] / total[1]) - math.log(v[0] / total[0]) for k, v in seen.items()}
    return Model({k: WEIGHT.get(k[0], 1.0) * v for k, v in unary.items()}, [[[x / sum(row) for x in row] for row in kind] for kind in pairs])


def _message(odds: float, t: list[list[float]], down: bool) -> float:
    """Log ratio that a neighbour with these log odds sends over the edge."""
    e = math.exp(max(-40.0, min(40.0, odds)))
    if down:
        return math.log((t[1][1] * e + t[0][1]) / (t[1][0] * e + t[0][0]))
    return math.log((t[1][1] * e + t[1][0]) / (t[0][1] * e + t[0][0]))


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of content for each node by sum-product up and down the tree."""
    unary = model.unary
    belief = [sum(unary.get(f, 0.0) for f in names) for names in features(page)]
    n = len(belief)
    turn = [model.turn[edge_kind(page, i)] for i in range(n)]
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        sent[i] = _message(belief[i], turn[i], down=False)
        belief[page.parent[i]] += sent[i]
    for i in range(1, n):
        belief[i] += _message(belief[page.parent[i]] - sent[i], turn[i], down=True)
    return belief


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    odds = marginals(page, model)
    return "\n".join(text for node, text in page.runs if odds[node] > 0)


@cache
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, held.value) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
