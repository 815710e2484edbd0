"""Main text of web pages by union-free wrappers of their hosts.

A page becomes a tree of its block elements. The trees of one host are aligned with each other:
matching elements are merged, elements that only some pages have become optional, runs of equal
siblings become a repeated group, texts that differ become slots, texts that do not stay constant.
Merging is done per task first and then per host over the tasks' results, so a host with a third of
all pages costs one small tree per task. The merged wrapper tells where the host's articles stand
(an article or main element, else the element that holds nearly all varying text outside links)
and which lines inside are constant furniture. Each page is then cut along its host's wrapper; a
page that does not fit it is judged by its own tree.

Elements whose tag, role, class or id marks menus, headers, footers, sidebars, notices, adverts,
forms or comments never count. Blocks are joined in page order by two line feeds.

Defined results: a null or empty html gives an empty text; a null url belongs to the host "";
repeated rows are handled one by one; an empty table gives none; other columns do not matter. Elements
deeper than MOST_DEPTH get no node; their blocks and marks count all the same. Siblings of more than
MOST_SIBLINGS changes of symbol are one repeated group of optional elements.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Levels and siblings of a wrapper; longer constant texts are held as a hash of 128 bits.
MOST_DEPTH, MOST_SIBLINGS, CONST_CHARS = 60, 48, 160
#: A constant line is furniture if this many pages and this share of its host's have it; an element holds the article from this share.
FURNITURE_PAGES, FURNITURE_SHARE, MAIN_SHARE = 5, 0.25, 0.8
#: Hosts up to which their wrappers (a few hundred bytes each) are broadcast.
BROADCAST_HOSTS = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|select|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*>?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Element names by what they do.
BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre article section main header footer nav aside form fieldset figure figcaption address details summary hr center head title menu dialog button label hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
NOT_TEXT = frozenset("head title nav footer aside form menu dialog button fieldset search label".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sidebar sidenav rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer foot "
    "masthead topbar notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup share sharing social related recommended comment comments reply replies disqus respond "
    "login search pagination pager skip toolbar disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_HEADINGS = frozenset("h1 h2 h3".split())
_HOLDERS = frozenset("html body div section table tbody tr td center main article".split())


class Node:
    """An element of a page: its symbol, children in order, and its own runs of text."""

    __slots__ = ("children", "link", "out", "symbol", "tag", "text")

    def __init__(self, symbol: str, tag: str, out: bool):
        self.symbol, self.tag, self.out = symbol, tag, out
        self.children: list = []  # nodes and (text, characters inside links)
        self.text: list[str] = []
        self.link = 0


def _symbol(tag: str, attributes: str) -> tuple[str, bool]:
    names, out = tag, tag in NOT_TEXT
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).strip().lower(), name.lower()
            if name == "class" or name == "id":
                words = value.split()
                if name == "class" and words:
                    names += "." + words[0]
                if tag not in ("html", "body", "article", "main"):
                    out |= any(part in MARKS for w in words for part in (w, *re.split(r"[-_]+", w)))
                elif tag == "article":
                    out |= any(part in ("comment", "comments", "ad", "advert", "promo") for w in words for part in re.split(r"[-_]+", w))
            elif name == "role":
                out |= value in ROLES
            elif name == "hidden" and not value or name == "aria-hidden" and value == "true":
                out = True
            elif name == "style" and "display:none" in value.replace(" ", ""):
                out = True
    return names, out


def parse(html: str) -> Node:
    """The tree of block elements; inline elements only mark whether text stands in a link."""
    root = Node("", "", False)
    stack, links, at = [root], 0, 0
    deep: list[tuple[str, bool]] = []  # open elements below the last level, and whether their text counts

    def close_text() -> None:
        node = stack[-1]
        if node.text:
            words = unescape("".join(node.text)).split()
            if words:
                node.children.append((" ".join(words), node.link))
            node.text, node.link = [], 0

    def add(raw: str) -> None:
        if raw and not any(out for _, out in deep):
            stack[-1].text.append(raw)
            if links:
                stack[-1].link += len(raw)

    def pop_to(k: int) -> None:
        deep.clear()
        while len(stack) > k:
            close_text()
            stack.pop()

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            close_text()
            links = 0
            if end and any(name == tag for name, _ in deep):
                while deep.pop()[0] != tag:
                    pass
            elif end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
            else:
                inner, bounds = CLOSES.get(tag, ("", ()))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in bounds:
                        break
                    if stack[k].tag == "p" or stack[k].tag in inner.split() or (stack[k].tag == "head" and tag == "body"):
                        pop_to(k)
                        break
                    if stack[k].tag in ("td", "th", "li", "table", "article", "section", "div", "main", "body") and not inner:
                        break
                if tag not in VOID:
                    symbol, out = _symbol(tag, attributes or "")
                    if tag == "header":  # an article's own header holds its title
                        out |= not any(n.tag in ("article", "main") for n in stack)
                    if len(stack) == MOST_DEPTH:
                        deep.append((tag, out))
                        continue
                    node = Node(symbol, tag, out)
                    stack[-1].children.append(node)
                    stack.append(node)
    add(html[at:])
    while stack:
        close_text()
        stack.pop()
    return root


# A wrapper: {"s": symbol, "t": tag, "o": out, "n": pages, "opt": optional, "rep": repeated,
#             "text": constant text or None for a slot or "" for no text, "own": characters, "link": of them in links, "c": children}


def mark(text: str) -> str:
    """A text, or the hash of a long one."""
    return text if len(text) <= CONST_CHARS else "\0" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _wrap(node: Node) -> dict:
    children: list[dict] = []
    texts, own, link = [], 0, 0
    for child in node.children:
        if isinstance(child, Node):
            children.append(_wrap(child))
        else:
            texts.append(child[0])
            own, link = own + len(child[0]), link + child[1]
    text = " ".join(texts)
    return {"s": node.symbol, "t": node.tag, "o": node.out, "n": 1, "opt": False, "rep": False, "text": mark(text), "own": own, "link": link, "c": _squares(children)}


def _squares(children: list[dict]) -> list[dict]:
    """Runs of siblings with one symbol become a repeated group."""
    out: list[dict] = []
    for child in children:
        if out and out[-1]["s"] == child["s"]:
            n = max(out[-1]["n"], child["n"])
            out[-1] = merge(out[-1], child)
            out[-1]["rep"], out[-1]["n"] = True, n
        else:
            out.append(child)
    for name in ("s", "t"):  # siblings that change very often: a repeated group of optional elements
        if len(out) > MOST_SIBLINGS:
            group: dict[str, dict] = {}
            for child in out:
                own = child if name == "s" else child | {"s": child["t"]}
                old = group.get(own[name])
                group[own[name]] = own | {"opt": True} if old is None else merge(old, own) | {"rep": True, "opt": True, "n": max(old["n"], own["n"])}
            out = list(group.values())
    return out


def merge(a: dict, b: dict) -> dict:
    """The wrapper of both: children aligned by symbol, mismatches optional, differing texts a slot."""
    out = {"s": a["s"], "t": a["t"], "o": a["o"], "n": a["n"] + b["n"], "opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"], "text": a["text"] if a["text"] == b["text"] else None, "own": a["own"] + b["own"], "link": a["link"] + b["link"]}
    x, y = a["c"], b["c"]
    if [c["s"] for c in x] == [c["s"] for c in y]:
        out["c"] = [merge(p, q) for p, q in zip(x, y, strict=True)]
        return out
    # longest common subsequence of symbols; siblings are folded, so lists are short
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i]["s"] == y[j]["s"] else max(best[i + 1][j], best[i][j + 1])
    children, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i]["s"] == y[j]["s"]:
            children.append(merge(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            children.append(x[i] | {"opt": True})
            i += 1
        else:
            children.append(y[j] | {"opt": True})
            j += 1
    out["c"] = _squares(children)
    return out


def expression(w: dict) -> str:
    """The wrapper as a union-free regular expression."""
    inner = ("" if w["text"] == "" else "#" if w["text"] is None else repr(w["text"])) + "".join(expression(c) for c in w["c"])
    body = f"<{w['s']}>{inner}</{w['t']}>"
    return f"({body})+" + "?" * w["opt"] if w["rep"] else f"({body})?" if w["opt"] else body


def _mass(w: dict) -> int:
    """Characters outside links and marked elements."""
    return 0 if w["o"] else max(0, w["own"] - w["link"]) + sum(map(_mass, w["c"]))


def plan(w: dict) -> dict:
    """Where the articles of a wrapper stand (paths of symbols), and its constant lines there."""
    mains: list[tuple] = []

    def seek(node: dict, path: tuple) -> None:
        for c in node["c"]:
            if not c["o"]:
                if c["t"] in ("article", "main") and _mass(c):
                    mains.append((*path, c["s"]))
                else:
                    seek(c, (*path, c["s"]))

    def lines(node: dict, found: list) -> None:
        if node["own"]:
            found.append(node)
        for c in node["c"]:
            if not c["o"]:
                lines(c, found)

    seek(w, ())
    places: list[dict] = []
    if mains:
        for path in mains:
            node = w
            for s in path:
                node = next(c for c in node["c"] if c["s"] == s)
            places.append(node)
    else:
        node, path = w, ()
        while True:
            inner = [c for c in node["c"] if not c["o"]]
            top = max(inner, key=_mass, default=None)
            if top is None or top["t"] not in _HOLDERS or _mass(top) < MAIN_SHARE * _mass(node) or (top["rep"] and node["t"] not in ("", "html")) or any(c["t"] in _HEADINGS for c in inner):
                break
            node, path = top, (*path, top["s"])
        mains, places = [path], [node]
    found: list[dict] = []
    for node in places:
        lines(node, found)
    # a text is furniture only beside texts that differ from page to page
    fixed = {n["text"] for n in found if n["text"] and n["n"] >= max(FURNITURE_PAGES, FURNITURE_SHARE * w["n"]) and n["t"] not in _HEADINGS}
    if sum(n["text"] is None for n in found) < 2:
        fixed = set()
    return {"mains": mains, "fixed": fixed}


def blocks(node: Node, mains: list[tuple], fixed: set) -> list[str] | None:
    """The blocks of the page at the given paths, or None if it has none of them."""
    out: list[str] = []
    fits = False

    def take(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                if not c.out:
                    take(c)
            elif mark(c[0]) not in fixed:
                out.append(c[0])

    def go(n: Node, paths: list[tuple]) -> None:
        nonlocal fits
        if any(not p for p in paths):
            fits = True
            take(n)
            return
        for c in n.children:
            if isinstance(c, Node) and not c.out and (rest := [p[1:] for p in paths if p[0] == c.symbol]):
                go(c, rest)

    go(node, mains)
    return out if fits else None


def extract(html: str, wrapper_plan: dict | None = None) -> str:
    page = parse(html)
    found = blocks(page, **wrapper_plan) if wrapper_plan else None
    if not found:
        found = blocks(page, **plan(_wrap(page))) or []
    return "\n\n".join(found)


def host(url: Column) -> Column:
    """The host of a url, in lower case; "" if it names none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), F.lit("")))


@runtime.lean
def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict] = {}

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([pickle.dumps(w) for w in held.values()], pa.binary())], ["host", "wrapper"])
        held.clear()
        return batch

    for batch in batches:
        for at, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if html:
                own = _wrap(parse(html))
                held[at] = merge(held[at], own) if at in held else own
        if len(held) > 2000:
            yield emit()
    yield emit()


@runtime.lean
def _join_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one host: its tasks' wrappers merged to one plan."""
    at, whole = None, None
    for batch in batches:
        hosts, plans = [], []
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = pickle.loads(raw)
            if name == at:
                whole = merge(whole, w)
            else:
                if whole is not None:
                    hosts.append(at)
                    plans.append(pickle.dumps(plan(whole)))
                at, whole = name, w
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(plans, pa.binary())], ["host", "plan"])
    if whole is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([pickle.dumps(plan(whole))], pa.binary())], ["host", "plan"])


@runtime.lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[bytes, dict] = {}
    for batch in batches:
        texts = []
        for html, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if raw is not None and raw not in plans:
                if len(plans) > 1000:
                    plans.clear()
                plans[raw] = pickle.loads(raw)
            texts.append(extract(html, plans.get(raw)) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_plans(pages: DataFrame) -> DataFrame:
    """host, plan: what the wrapper of each host says about its pages."""
    parts = runtime.parallelism(pages.sparkSession)
    learnt = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_learn, "host string, wrapper binary")
    return runtime.stage(learnt.repartition(parts, "host").sortWithinPartitions("host").mapInArrow(_join_hosts, "host string, plan binary"), "plans")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    runtime.bounded_batches(spark)
    plans = host_plans(pages)
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if plans.count() <= BROADCAST_HOSTS:
        joined = named.join(F.broadcast(plans), "host", "left")
    else:  # each host's plan goes to a few tasks, so that no host's pages meet in one
        salts = 32
        spread = plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "plan").mapInArrow(_cut, "page_id long, url string, text string, n_chars long")
