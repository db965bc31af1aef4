"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label, content or not.  A node's
own potential is the likelihood of its observations (tag, class/id cue, text
length, link share, sentence ends) under each label; a parent-child potential
is the chance of the child's label given the parent's and the child's kind of
tag.  One upward and one downward pass of sum-product messages give each
node's marginal; the text of nodes with a marginal of at least 0.5 is the main
text.  All tables are counted, with smoothing, from the labelled pages in
``labelled_pages.py``.

Inline elements belong to the block around them.  Text of ``DROPPED`` elements
and comments is not text.  Character references are decoded, white space in a
block becomes one space, blocks are trimmed and joined by one space in page
order; nothing is capped.

Defined cases: a null or empty html gives an empty text and 0 characters;
unclosed, stray and truncated tags are read leniently: a head ends where
something stands that a head cannot hold, another dropped element at the end
tag of an element around it, or without an own end tag at the next block start
(an unclosed script, style, title, textarea or iframe takes the rest of the
page, as in browsers); text outside any block belongs to the page's root;
repeated pages give repeated rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = frozenset("script style noscript template head title svg iframe object select textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meta link br hr "
                   "wbr q ruby rt s samp small span strike strong sub sup time tt u var".split())
#: start tags that a head may hold (a template is dropped after it as well); any other ends it
HEAD = frozenset("html head title meta link script style base noscript".split())
#: dropped elements whose end tag may be missing, and the block starts that end one
PAIRED = ("svg", "object", "select", "button", "template")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot "
                   "th thead tr ul".split())
RAW = ("script", "style", "title", "textarea", "iframe", "noscript")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a start tag of the first kind ends an open element of the second
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
CLOSED_BY = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: cues in class, id and role values, first match wins
CUES = [(kind, re.compile(rf"(?:^|[^a-z])(?:{words})(?:$|[^a-z])")) for kind, words in (
    ("comment", "comments?|discussion|disqus|replies|reply|respond|commentlist"),
    ("advert", "ads?|advert|advertisement|adverts|sponsor|sponsored|promo|promotion|banner"),
    ("notice", "cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|toast"),
    ("menu", "nav|navigation|navbar|menu|breadcrumbs?|pagination|pager|toc|tabs|skip|toolbar|search"),
    ("side", "sidebar|side|aside|widget|related|recommended|recommendations|popular|trending|more|tags|share|social|complementary"),
    ("frame", "header|masthead|footer|colophon|copyright|banner|contentinfo|branding|legal|imprint"),
    ("main", "article|content|post|entry|story|main|body|text|prose|articlebody"))]
TAGS = {**dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(("nav", "menu"), "nav"),
        **dict.fromkeys(("header",), "header"), "footer": "footer", "aside": "aside",
        **dict.fromkeys(("form", "fieldset", "dialog"), "form"), **dict.fromkeys(("p", "blockquote", "pre"), "para"),
        **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "head"), **dict.fromkeys(("ul", "ol", "dl"), "list"),
        **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th", "caption"), "table"),
        **dict.fromkeys(("figure", "figcaption"), "figure"), **dict.fromkeys(("html", "body", "#root"), "root")}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


_PAIRS = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b.*?(?:</\1|\Z)|<(/?)({'|'.join(PAIRED)})(?=[\s/>])"
                    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", re.S | re.I)


class Node:
    __slots__ = ("tag", "cue", "parent", "runs", "linked", "own", "below", "mark")

    def __init__(self, tag: str, cue: str, parent: int, mark: str | None = None):
        self.tag, self.cue, self.parent, self.mark = tag, cue, parent, mark
        self.runs: list[tuple[int, str]] = []  # (block number, text)
        self.linked = self.own = self.below = 0


def cue_of(attributes: str) -> tuple[str, str | None]:
    values, mark = [], None
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-content":
            mark = value
        else:
            values.append(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
    said = " ".join(values)
    return next((k for k, r in CUES if said and r.search(said)), "none"), mark


def closed(page: str) -> set[int]:
    """Where the ``PAIRED`` start tags with an end tag of their own begin."""
    found, open_at = set(), {tag: [] for tag in PAIRED}
    for m in _PAIRS.finditer(page):
        starts = open_at.get((m[3] or "").lower())
        if starts is None:
            continue
        if not m[2] and not m[4].endswith("/"):
            starts.append(m.start())
        elif m[2] and starts:
            found.add(starts.pop())
    return found


def parse(page: str) -> list[Node]:
    """The block elements in page order, with their own text; node 0 is the root."""
    nodes = [Node("#root", "none", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]
    at = links = block = 0
    skip = ""  # inside a dropped element
    ended = True  # which has an end tag of its own
    inside: Counter = Counter()  # elements open within it
    own_end: set[int] | None = None
    last: set[str] = set()  # tags without a further end tag

    def past(tag: str) -> int | None:
        end = None if tag in last else re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
        if end is None:
            last.add(tag)
        return end.end() if end else None

    def text(piece: str) -> None:
        if piece and not skip:
            node = nodes[stack[-1][1]]
            piece = entities.unescape(piece)
            if node.runs and node.runs[-1][0] == block:
                node.runs[-1] = (block, node.runs[-1][1] + piece)
            else:
                node.runs.append((block, piece))
            if links:
                node.linked += len(piece.strip())

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if skip == "head" and page[at:m.start()].strip():
            skip = ""
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if skip == "head":
            if m[1]:
                if tag in ("head", "body", "html"):
                    skip = ""
                continue
            if tag in HEAD:
                if tag in RAW:
                    at = past(tag) or (at if tag == "noscript" else len(page))
                continue
            skip = ""
        elif skip:
            if m[1]:
                if inside[tag]:
                    inside[tag] -= 1
                    continue
                if tag == skip or not (any(t == tag for t, _ in stack) or not ended and tag in INLINE):
                    skip = "" if tag == skip else skip
                    continue
                skip = ""  # the end of an element around it
            elif tag in BLOCKS and not ended:
                skip = ""
            else:
                if tag in RAW:
                    at = past(tag) or at
                elif tag == skip and tag in ("button", "select"):  # these do not nest: the open one ends
                    ended, inside = m.start() in own_end, Counter()
                elif tag not in VOID and not m[3].endswith("/"):
                    inside[tag] += 1
                continue
        if m[1]:  # end tag
            if tag == "a":
                links = 0
            if tag == "br":
                text(" ")
            elif tag not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        block += 1
                        links = 0
                        break
            continue
        if tag in DROPPED:
            if tag in RAW:
                at = past(tag) or (at if tag == "noscript" else len(page))
            elif not m[3].endswith("/"):
                if own_end is None and tag != "head":
                    own_end = closed(page)
                skip, ended, inside = tag, tag == "head" or m.start() in own_end, Counter()
            if tag not in ("script", "style"):
                text(" ")
            continue
        if tag in ("br", "hr", "img"):
            text(" ")
        if tag in VOID or tag in INLINE:
            links = 1 if tag == "a" else links
            continue
        block += 1
        links = 0
        if stack[-1][0] == "p":  # every block start ends an open paragraph
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ENDS.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in CLOSED_BY.get(tag, {"body"}):
                break
        if tag in ("html", "body") and any(t == tag for t, _ in stack):
            continue
        cue, mark = cue_of(m[3]) if m[3] else ("none", None)
        nodes.append(Node(tag, cue, stack[-1][1], mark))
        stack.append((tag, len(nodes) - 1))
    if skip == "head" and page[at:].strip():
        skip = ""
    text(page[at:])
    for node in nodes:
        node.own = sum(len(" ".join(t.split())) for _, t in node.runs)
        node.below = node.own
    for node in reversed(nodes[1:]):
        nodes[node.parent].below += node.below
        nodes[node.parent].linked += node.linked
    return nodes


def observations(node: Node) -> tuple:
    """What a node shows: tag kind, cue, size of its own text, link share, sentence ends."""
    own = " ".join(" ".join(t.split()) for _, t in node.runs).strip()
    share = node.linked / node.below if node.below else 0.0
    return (("tag", TAGS.get(node.tag, "box")), ("cue", node.cue),
            ("own", 0 if not own else 1 + (len(own) > 25) + (len(own) > 80) + (len(own) > 250)),
            ("links", (share > 0.05) + (share > 0.35) + (share > 0.75)),
            ("ends", 0 if not own else 1 + (own[-1] in ".!?…\"'”’:")))


class Model:
    """Counted potentials; ``own[label][observation]`` and ``pair[kind][parent][child]`` are probabilities."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        seen = (Counter(), Counter())
        pair: dict[str, list[list[float]]] = {}
        values: dict[str, set] = {}
        for page in pages:
            nodes = parse(page)
            label = [0] * len(nodes)
            for i, node in enumerate(nodes):
                label[i] = int(node.mark) if node.mark is not None else label[node.parent] if i else 0
                for o in observations(node):
                    seen[label[i]][o] += 1
                    values.setdefault(o[0], set()).add(o[1])
                if i:
                    table = pair.setdefault(TAGS.get(node.tag, "box"), [[smooth, smooth], [smooth, smooth]])
                    table[label[node.parent]][label[i]] += 1
        total = [Counter(), Counter()]
        for k in (0, 1):
            for (name, _), n in seen[k].items():
                total[k][name] += n
        self.own = [{(name, v): math.log((seen[k][name, v] + smooth) / (total[k][name] + smooth * (len(vs) + 1)))
                     for name, vs in values.items() for v in vs} for k in (0, 1)]
        self.none = [{name: math.log(smooth / (total[k][name] + smooth * (len(vs) + 1))) for name, vs in values.items()} for k in (0, 1)]
        self.pair = {kind: [[x / sum(row) for x in row] for row in table] for kind, table in pair.items()}
        self.other = [[0.9, 0.1], [0.2, 0.8]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of label content for every node, by sum-product on the tree."""
        n = len(nodes)
        up = [[1.0, 1.0] for _ in range(n)]  # own likelihood times the children's messages
        message = [[1.0, 1.0]] * n
        tables = [self.pair.get(TAGS.get(x.tag, "box"), self.other) for x in nodes]
        for i in range(n - 1, -1, -1):
            logs = [sum(self.own[k].get(o, self.none[k][o[0]]) for o in observations(nodes[i])) for k in (0, 1)]
            top = max(logs)
            a, b = up[i][0] * math.exp(logs[0] - top), up[i][1] * math.exp(logs[1] - top)
            s = a + b
            up[i] = [a / s, b / s]
            if i:
                t = tables[i]
                sent = [t[0][0] * a / s + t[0][1] * b / s, t[1][0] * a / s + t[1][1] * b / s]
                message[i] = sent
                p = up[nodes[i].parent]
                p[0] *= sent[0]
                p[1] *= sent[1]
                z = p[0] + p[1]
                p[0] /= z
                p[1] /= z
        down = [up[0]] * n  # beliefs
        down[0] = [1.0 * up[0][0], 1e-3 * up[0][1]]
        z = sum(down[0])
        down[0] = [x / z for x in down[0]]
        for i in range(1, n):
            p, t, sent = down[nodes[i].parent], tables[i], message[i]
            out = [p[0] / max(sent[0], 1e-300), p[1] / max(sent[1], 1e-300)]  # the parent's belief without this child
            a = up[i][0] * (out[0] * t[0][0] + out[1] * t[1][0])
            b = up[i][1] * (out[0] * t[0][1] + out[1] * t[1][1])
            down[i] = [a / (a + b), b / (a + b)]
        return [b for _, b in down]

    def extract(self, page: str) -> str:
        nodes = parse(page)
        content = self.marginals(nodes)
        found = [(block, " ".join(t.split())) for node, c in zip(nodes, content, strict=True) if c >= 0.5 for block, t in node.runs]
        return " ".join(t for _, t in sorted(found, key=lambda x: x[0]) if t)


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, counted once per Python worker from the labelled pages."""
    from churnscope.llm.labelled_pages import PAGES

    return Model(PAGES)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for b in batches:
            texts = [model.extract(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
