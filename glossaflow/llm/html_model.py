"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a variable, content or not. Its own evidence is a sum of log odds of its features (tag, words of class,
id and role, share of its text inside links, length of its text); parent and child are tied by a 2 by 2 potential, one for each kind of child:
right below the page's body, a holder of other blocks, or a block of text. A box (a menu, a form, an advert, comments: by its tag, or by a word of
its class, id or role) cannot be content wherever it stands, and nothing in it can, unless it holds the page's article or its first heading.
Sum-product messages pass up from the leaves and down from the root, which gives each element's exact marginal; the text of
elements more likely content than not is kept. Log odds and potentials are counted on at most FIT_PAGES labelled pages:
pages that mark their article themselves (one article or main element). Its elements are content, but for those of the kinds
in ASIDE within it; everything else is not. The counts start from PRIORS, so pages without such marks, and an empty table,
work as well.

Nulls and empty pages have the empty text; an empty table gives an empty result. Unclosed and stray tags are taken as browsers take
them, in the main. Very long pages are read whole, in time linear in their length. Repeated rows are alike; an element as likely content
as not is kept. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

FIT_PAGES = 1_500
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag: with quoted values, or, in a page with a quote that nothing closes, up to the next bracket.
REST = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
LOOSE_REST = re.compile(r"([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = RAW | {"head", "noscript", "template", "svg", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that a start tag ends when one is open within the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
CLOSES |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ASIDE = {"nav", "aside", "form", "footer"}
ASIDE_NAMES = (
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar cookie cookies consent notice popup modal comment comments "
    "reply replies share social related menu nav navigation breadcrumb breadcrumbs newsletter subscribe subscription login signup pager pagination"
).split()
ASIDE_ROLES = ("banner", "complementary", "contentinfo", "form", "navigation", "search", "dialog", "alert", "alertdialog", "menu")
#: What a box does not hold, and what is never a box itself.
CORE = {"article", "main", "h1"}
PAGE = {"html", "body"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "address", "legend", "summary"}
#: Log odds before any page is seen, as strong as so many observations.
PRIOR_WEIGHT = 40
PRIORS = {"tag=header": -1.5, "tag=article": 5.0, "tag=main": 5.0, "tag=body": -0.5, "tag=html": -0.5}
PRIORS |= {"name=content": 1.0, "name=article": 2.0, "name=post": 1.0, "name=entry": 1.0}
PRIORS |= {"links=3": -2.0, "links=2": -0.8, "links=0": 0.2, "size=0": -0.6, "size=1": -0.2, "size=2": 0.4, "size=3": 0.9}


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    own: int = 0  # characters of text directly inside
    total: int = 0
    linked: int = 0
    core: bool = False  # holds something of CORE
    kind: str = "page"


class _Open:
    """The open elements: their nodes, the block that each lies in, and how many of each tag there are."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes, self.stack, self.holders, self.count = nodes, [0], [0], Counter({"html": 1})

    def push(self, i: int) -> None:
        tag = self.nodes[i].tag
        self.stack.append(i)
        self.holders.append(i if tag in BLOCK else self.holders[-1])
        self.count[tag] += 1
        self.count["dropped"] += tag in DROPPED

    def pop(self) -> str:
        tag = self.nodes[self.stack.pop()].tag
        self.holders.pop()
        self.count[tag] -= 1
        self.count["dropped"] -= tag in DROPPED
        return tag

    def depth_of(self, tags: set[str], bounds: set[str] = frozenset()) -> int:
        """Depth of the innermost open element of these tags, unless one of the bounds lies within it; 0 if there is none."""
        if any(self.count[t] for t in tags):
            for d in range(len(self.stack) - 1, 0, -1):
                tag = self.nodes[self.stack[d]].tag
                if tag in tags:
                    return d
                if tag in bounds:
                    return 0
        return 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order, the root first, and blocks of text with the element that holds each."""
    nodes = [Node("html", -1)]
    still = _Open(nodes)
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    state = {"owner": 0, "text": False, "loose": False}

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        state["text"] = False
        if text:
            blocks.append((state["owner"], text))

    def pop_to(depth: int) -> None:
        while len(still.stack) > max(depth, 1):
            if still.pop() in BLOCK:
                flush()

    def text_at(chunk: str) -> None:
        if not chunk or still.count["dropped"]:
            return
        holder = still.holders[-1]
        if not state["text"]:
            state.update(owner=holder, text=bool(chunk.strip()))
        run.append(chunk)
        length = len(chunk.strip())
        nodes[holder].own += length
        if still.count["a"]:
            nodes[holder].linked += length

    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        text_at(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        rest = None if state["loose"] else REST.match(page, at)
        if rest is None:
            state["loose"] = True
            rest = LOOSE_REST.match(page, at)
        at = rest.end()
        if tag == "html" and not m[1]:
            continue
        if m[1]:
            depth = still.depth_of({tag}, set() if tag in BLOCK else BLOCK)
            if depth:
                pop_to(depth)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if nodes[still.holders[-1]].tag == "p":
                pop_to(still.depth_of({"p"}))
        if tag in CLOSES and (depth := still.depth_of(*CLOSES[tag])):
            pop_to(depth)
        if tag in ("td", "th"):
            run.append(" ")
        node = Node(tag, still.holders[-1])
        for name, *values in ATTRIBUTE.findall(rest[1]):
            value = "".join(values).lower()
            if name.lower() in ("hidden", "aria-hidden"):
                node.names += ["hidden"] * (value != "false")
            else:
                node.names += [("role=" if name.lower() == "role" else "name=") + x for x in NAME.findall(value)]
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not rest[1].endswith("/"):
            still.push(len(nodes) - 1)
    text_at(page[at:])
    flush()
    for node in nodes:
        node.total += node.own
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].total += nodes[i].total
        nodes[nodes[i].parent].linked += nodes[i].linked
        nodes[nodes[i].parent].core |= nodes[i].core or nodes[i].tag in CORE
    for node in nodes[1:]:
        node.kind = "box" if is_box(node) or nodes[node.parent].kind == "box" else "page" if nodes[node.parent].tag in PAGE else "text" if node.tag in TEXT_BLOCKS else "holder"
    return nodes, blocks


def is_box(node: Node) -> bool:
    """Whether an element is marked as something beside the text, and holds none of the page's core."""
    if node.core or node.tag in CORE or node.tag in PAGE:
        return False
    return node.tag in ASIDE or any(map(_beside, node.names))


def _beside(mark: str) -> bool:
    return mark == "hidden" or mark.removeprefix("name=") in ASIDE_NAMES or mark.removeprefix("role=") in ASIDE_ROLES


def evidence(node: Node) -> list[str]:
    """Features of an element; what marks a box says nothing about one that holds the core of its page."""
    share = node.linked / node.total if node.total else 0
    size = 0 if node.total < 20 else 1 if node.total < 80 else 2 if node.total < 300 else 3
    own = [x for x in (f"tag={node.tag}", *dict.fromkeys(node.names)) if not _beside(x) and x.removeprefix("tag=") not in ASIDE]
    return [*own, f"links={0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3}", f"size={size}"]


def labels(nodes: list[Node]) -> list[int] | None:
    """Content or not for each element of a page that marks its article; None for others."""
    marked = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if len(marked) != 1 or nodes[marked[0]].total < 200:
        return None
    out = [0] * len(nodes)
    for i, n in enumerate(nodes):
        out[i] = int(i == marked[0] or (n.parent >= 0 and out[n.parent] == 1 and n.kind != "box"))
    return out


@dataclass
class Model:
    odds: dict[str, float]
    #: By kind of child, log potentials of (parent, child).
    ties: dict[str, list[list[float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each element, by one pass up and one down."""
        own = [sum(self.odds.get(f, 0.0) for f in evidence(n)) for n in nodes]
        up = [[0.0, o] for o in own]  # log messages gathered below, with the own evidence
        sent = [[0.0, 0.0] for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            t = self.ties[nodes[i].kind]
            sent[i] = [_log_sum(t[s][0] + up[i][0], t[s][1] + up[i][1]) for s in (0, 1)]
            top = nodes[i].parent
            up[top][0] += sent[i][0]
            up[top][1] += sent[i][1]
        full = [u[:] for u in up]
        for i in range(1, len(nodes)):
            t = self.ties[nodes[i].kind]
            top = nodes[i].parent
            rest = [full[top][s] - sent[i][s] for s in (0, 1)]
            shift = max(rest)
            down = [_log_sum(t[0][s] + rest[0] - shift, t[1][s] + rest[1] - shift) for s in (0, 1)]
            full[i] = [up[i][s] + down[s] for s in (0, 1)]
        return [1 / (1 + math.exp(max(-50.0, min(50.0, a - b)))) for a, b in full]


#: The log odds of what cannot be content; no votes of children outweigh it.
NEVER = -1e12
#: Transitions before any page is seen, by kind of child: what is read below something else is hardly ever a block of text on its own.
START = {"page": [[10.0, 5.0], [1.0, 30.0]], "holder": [[30.0, 1.0], [1.0, 30.0]], "text": [[30.0, 0.05], [1.0, 30.0]]}


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def learn(counted: Counter) -> Model:
    """A model from counts of (feature, label) and of (kind, parent label, child label)."""
    n = [counted[("all", s)] + 1 for s in (0, 1)]
    odds = {}
    for f in {f for kind, f, *_ in (k if k[0] == "f" else (None, None) for k in counted) if f} | set(PRIORS):
        prior = 1 / (1 + math.exp(-PRIORS.get(f, 0.0)))
        weight = PRIOR_WEIGHT if f in PRIORS else 4
        seen = [counted[("f", f, s)] / n[s] * min(n) for s in (0, 1)]
        odds[f] = math.log((seen[1] + weight * prior) / (seen[0] + weight * (1 - prior)))
        odds[f] = max(-6.0, min(6.0, odds[f]))
    ties: dict[str, list[list[float]]] = {}
    for kind, start in START.items():
        seen = [[counted[("t", kind, a, b)] + start[a][b] for b in (0, 1)] for a in (0, 1)]
        ties[kind] = [[math.log(x / sum(row)) for x in row] for row in seen]
    ties["box"] = [[0.0, NEVER], [0.0, NEVER]]  # whatever it stands in, which it says nothing about
    return Model(odds, ties)


def page_counts(page: str | None) -> Counter:
    nodes, _ = parse(page or "")
    marks = labels(nodes)
    out: Counter = Counter()
    if marks is None:
        return out
    for n, s in zip(nodes, marks, strict=True):
        if n.kind == "box":  # its marks explain it, so its lists and links tell nothing about those elsewhere
            continue
        out[("all", s)] += 1
        for f in evidence(n):
            out[("f", f, s)] += 1
        if n.parent >= 0:
            out[("t", n.kind, marks[n.parent], s)] += 1
    return out


def train(pages: DataFrame, html_col: str = "html", most: int = FIT_PAGES) -> Model:
    """Counts over at most `most` different pages that mark their article, those with the least hashes; added up by Spark.

    The hashes alone are sorted; no page moves but the chosen ones.
    """
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b")).select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("spot"))
    last = marked.select("spot").distinct().orderBy("spot").limit(most).agg(F.max("spot")).first()[0]
    chosen = marked.where(F.col("spot") <= F.lit(last)).dropDuplicates(["spot"])

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(page_counts(page))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join(map(str, k)) for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["key", "n"])

    rows = chosen.select("html").mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counted: Counter = Counter()
    for r in rows:
        kind, *rest = r["key"].split("\t")
        counted[(kind, *(x if n == 0 and kind in "ft" else int(x) for n, x in enumerate(rest)))] += r["n"]
    return learn(counted)


def main_text(page: str | None, model: Model) -> str:
    nodes, blocks = parse(page or "")
    likely = model.marginals(nodes)
    return "\n\n".join(text for owner, text in blocks if likely[owner] >= 0.5)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return only(pages, id=id_col, url=url_col, html=html_col).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
