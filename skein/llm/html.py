"""Main text of web pages by wrappers, union-free regular expressions over same-host token streams (operator 7).

A page's tags and texts become a well-nested token stream. All pages of a host are aligned one after the other, first within
each task, then the tasks' wrappers with each other in two rounds, so that a hot host's pages never meet in one task:
streams are folded, adjacent equal groups become repeated groups, stretches that only one side has become optional groups, and
texts that differ become slots. A wrapper holds structure, short texts and digests of long ones; its size doesn't grow with its pages.

Two things are read off a host's wrapper. Its main region is the article element if there is one, else a marked element, else the element
whose slots carry most text. Its constants are texts inside that region which ``CONSTANT_PAGES`` pages or more have at the same place
and which no page has otherwise: notices and share lines under whatever name. They belong to the template and are left out,
unless they outweigh ``CONSTANT_SHARE`` of the region, since then the pages are copies of each other rather than of a template.
Each page, whole, is then read through its host's wrapper; where a page lacks the region its own stream decides by the same rule.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are also left out by
element name and by the words of class, id and role; a header inside an article is part of it. Character references are decoded,
white space inside a block becomes one space, blocks are joined in page order by two line feeds.

Time is linear in the page, however damaged or deeply nested. Elements below ``DEPTH`` levels are read like others but take no part in
the alignment. Null and empty pages give an empty text. Pages with a null or odd URL share the host "". Rows repeat as often as
they came; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

#: Pages that must agree on a text before it counts as part of the template.
CONSTANT_PAGES = 4
#: Share of the region's characters that constants may make up at most.
CONSTANT_SHARE = 0.25
#: Levels of nesting that take part in an alignment.
DEPTH = 100
#: Hosts whose wrappers a task holds at once, and buckets of tasks whose wrappers are merged first.
_HOSTS, _BUCKETS = 4096, 64
#: Longest group of siblings that is tried as a repeated group.
_GROUP = 4
#: Items of one element that take part in an alignment; beyond it, the longer lists are matched as they come.
_ALIGN = 256

# Element names and the words of class, id and role that mark boilerplate.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption iframe noscript template svg object button select textarea option label".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("nav header footer aside form head title noscript template svg iframe object button select textarea option dialog menu".split())
_MARKS = frozenset("nav navbar navigation menu menubar sidebar ad ads advert advertisement adverts banner cookie cookies consent notice popup modal promo promoted sponsor sponsored comment comments disqus footer header masthead breadcrumb breadcrumbs share sharing social related newsletter subscribe signup login search paywall pagination pager toolbar widget alert".split())
#: Marks that count on elements that only hold text, too.
_SURE_MARKS = frozenset("ad ads advert advertisement adverts cookie cookies consent notice promo promoted sponsor sponsored comment comments newsletter subscribe".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption li dt dd td th tr caption".split())
_REGIONS = ("article", "main")
_REGION_MARKS = frozenset("article main content post entry articlebody story".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPES = frozenset("ul ol dl table article main body div section".split())
_CLOSABLE = frozenset({"p"}.union(*_CLOSES.values()))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


class Node:
    """An element of the token stream: its label, and texts and elements in order."""

    __slots__ = ("children", "dropped", "label", "name", "region")

    def __init__(self, name: str, label: str, dropped: bool, region: bool):
        self.name, self.label, self.dropped, self.region = name, label, dropped, region
        self.children: list[Node | str] = []


def _element(name: str, attrs: str, in_article: bool) -> Node:
    words: set[str] = set()
    hidden, kind = False, ""
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif key == "hidden":
                hidden |= value not in ("false", "until-found")
            else:
                words.update(_WORDS.split(value))
                kind = kind or (value if key == "class" else "")
    free = name in ("html", "body", "article", "main") or (name == "header" and in_article)
    marked = not words.isdisjoint(_SURE_MARKS if name in _TEXT else _MARKS)
    dropped = hidden or (not free and (name in _DROPPED or marked))
    region = name in _REGIONS or (not dropped and not free and not words.isdisjoint(_REGION_MARKS))
    return Node(name, f"{name}.{kind}" if kind else name, dropped, region)


def parse(page: str | None) -> Node:
    """The page as a well-nested stream of block elements and whole text blocks."""
    root = Node("", "", False, False)
    stack, parts = [root], []
    # by level: where the elements stand that a new one may close, up to the next scope
    closable: list[dict[str, int]] = [{}]
    count: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                stack[-1].children.append(text)

    def cut(to: int) -> None:
        for node in stack[to:]:
            count[node.name] -= 1
        del stack[to:], closable[to:]

    page = page or ""
    # no tag ends after the last ">", so one that begins there is unfinished, and all that follows belongs to it
    end = page.rfind(">") + 1
    if unfinished := _UNFINISHED.search(page, end):
        page = page[: unfinished.start()]
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            parts.append(m["text"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in _BLOCKS:
            if name == "br":
                parts.append("\n")
            continue
        flush()
        if m["end"]:
            if count.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        places = closable[-1]
        if places:
            cut(min((at for n, at in places.items() if n == "p" or n in _CLOSES.get(name, ())), default=len(stack)))
        node = _element(name, m["attrs"] or "", bool(count.get("article")))
        stack[-1].children.append(node)
        if name not in _VOID and not (m["attrs"] or "").endswith("/"):
            places = {} if name in _SCOPES else closable[-1]
            if name in _CLOSABLE:
                places = {name: len(stack), **places}
            stack.append(node)
            closable.append(places)
            count[name] = count.get(name, 0) + 1
    flush()
    return root


# Wrappers: items are ["#", text or None (a slot), how often, pages, chars] and [label, children, how often, pages, flags].
# How often: "1", "?" optional, "+" repeated, "*" both. Long texts stand as digests.


def _literal(text: str) -> str:
    return text if len(text) <= 64 else f"\0{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def _often(a: str, b: str) -> str:
    if a == b:
        return a
    maybe, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if maybe and many else "?" if maybe else "+" if many else "1"


def _merge_item(a: list, b: list, pages: int) -> list:
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, _often(a[2], b[2]), pages, a[4] + b[4]]
    return [a[0], merge(a[1], b[1]), _often(a[2], b[2]), pages, a[4] | b[4]]


def _maybe(item: list) -> list:
    return [*item[:2], {"1": "?", "+": "*"}.get(item[2], item[2]), *item[3:]]


def fold(items: list[list]) -> list[list]:
    """Turn adjacent equal groups into repeated groups, short groups first."""
    for size in range(1, _GROUP + 1):
        out: list[list] = []
        for item in items:
            out.append(item)
            left, right = out[-2 * size : -size], out[-size:]
            if len(left) == size and all(x[0] == y[0] for x, y in zip(left, right, strict=True)):
                both = [_merge_item(x, y, max(x[3], y[3])) for x, y in zip(left, right, strict=True)]
                out[-2 * size :] = [[x[0], x[1], "*" if x[2] in "?*" else "+", *x[3:]] for x in both]
        items = out
    return items


def merge(a: list[list], b: list[list]) -> list[list]:
    """Align two item lists; what only one of them has becomes optional."""
    n, m = len(a), len(b)
    if n > _ALIGN or m > _ALIGN:
        a, b = a[:_ALIGN] + [_maybe(x) for x in a[_ALIGN:]], b[:_ALIGN] + [_maybe(x) for x in b[_ALIGN:]]
        n, m = len(a), len(b)
    out: list[list] = []
    start = 0
    while start < min(n, m) and a[start][0] == b[start][0]:  # pages of a template mostly agree
        out.append(_merge_item(a[start], b[start], a[start][3] + b[start][3]))
        start += 1
    best = [[0] * (m + 1) for _ in range(n + 1)] if start < max(n, m) else []
    for i in range(n - 1, start - 1, -1):
        for j in range(m - 1, start - 1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = start
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge_item(a[i], b[j], a[i][3] + b[j][3]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_maybe(a[i]))
            i += 1
        else:
            out.append(_maybe(b[j]))
            j += 1
    return fold(out)


def items_of(node: Node, depth: int = DEPTH) -> list[list]:
    """A page's stream as a wrapper that fits this page alone; below ``depth`` levels there is only a slot."""
    if not depth:
        return [["#", None, "1", 1, 0]] if node.children else []
    return fold([["#", _literal(c), "1", 1, len(c)] if isinstance(c, str) else [c.label, items_of(c, depth - 1), "1", 1, c.dropped | c.region << 1] for c in node.children])


def infer(pages: Iterable[str | None]) -> list[list]:
    """The wrapper of some pages, aligned one after the other."""
    wrapper: list[list] | None = None
    for page in pages:
        own = items_of(parse(page))
        wrapper = own if wrapper is None else merge(wrapper, own)
    return wrapper or []


def expression(wrapper: list[list]) -> str:
    """The wrapper as a union-free regular expression."""
    out = []
    for what, inner, often, *_ in wrapper:
        body = ("#" if inner is None else repr(inner)) if what == "#" else f"<{what}>{expression(inner)}</>"
        out.append(body if often == "1" else f"({body}){often}")
    return "".join(out)


def _slots(items: list[list]) -> int:
    return sum((i[4] if i[1] is None or i[2] in "+*" else 0) if i[0] == "#" else 0 if i[4] & 1 else _slots(i[1]) for i in items)


def region(wrapper: list[list]) -> list[str]:
    """The labels on the way to the main region: an article, else a marked element, else where most slot text is."""
    named: list[tuple[int, int, list[str]]] = []

    def walk(items: list[list], path: list[str]) -> None:
        for i in items:
            if i[0] != "#" and not i[4] & 1:
                here = [*path, i[0]]
                if i[4] & 2:
                    named.append((i[0].split(".")[0] == "article", _slots(i[1]) or 1, here))
                walk(i[1], here)

    walk(wrapper, [])
    if named:
        return max(named, key=lambda x: (x[0], x[1], -len(x[2])))[2]
    path: list[str] = []
    items = wrapper
    while True:
        inner = [(i, _slots(i[1])) for i in items if i[0] != "#" and not i[4] & 1]
        total = _slots(items)
        top = max(inner, key=lambda x: x[1], default=None)
        if top is None or not total or top[1] < 0.8 * total or top[0][2] in "+*":
            return path
        path.append(top[0][0])
        items = top[0][1]


def constants(wrapper: list[list], path: list[str]) -> list[list[str]]:
    """(labels below the region, text) of the region's texts that belong to the template."""
    level = [wrapper]
    for label in path:
        level = [i[1] for items in level for i in items if i[0] == label]
    found: list[list[str]] = []
    chars = [0, 0]  # of constants, of all

    def walk(items: list[list], place: str) -> None:
        for i in items:
            if i[0] != "#":
                if not i[4] & 1:
                    walk(i[1], f"{place}>{i[0]}")
                continue
            chars[1] += i[4]
            if i[1] is not None and i[3] >= CONSTANT_PAGES:
                chars[0] += i[4]
                found.append([place, i[1]])

    for items in level:
        walk(items, "")
    return found if chars[0] <= CONSTANT_SHARE * chars[1] else []


def _blocks(node: Node, left_out: set[tuple[str, str]]) -> Iterator[str]:
    """The texts below an element in order, but for dropped elements and the template's constants."""
    stack: list[tuple[Iterator[Node | str], str | None]] = [(iter(node.children), "" if left_out else None)]
    while stack:
        children, place = stack[-1]
        for c in children:
            if not isinstance(c, str):
                if not c.dropped:
                    deep = place is None or len(stack) >= DEPTH
                    stack.append((iter(c.children), None if deep else f"{place}>{c.label}"))
                    break
            elif place is None or (place, _literal(c)) not in left_out:
                yield c
        else:
            stack.pop()


def extract(page: str | None, path: list[str] | None, template: Iterable[Iterable[str]] = ()) -> str:
    """The main text of a page; ``path`` and ``template`` are the region and the constants of its host's wrapper."""
    tree = parse(page)
    left_out = set(map(tuple, template))
    found = [tree] if path else []
    for label in path or []:
        found = [c for node in found for c in node.children if not isinstance(c, str) and c.label == label]
    if not found:
        left_out, found = set(), [tree]
        for label in region(items_of(tree)):
            found = [c for node in found for c in node.children if not isinstance(c, str) and c.label == label]
    return "\n\n".join(b for node in found for b in _blocks(node, left_out))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lit(""))


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    """One wrapper for each group of (host, part, wrapper), aligned in the order of parts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("part").to_pylist(), rows.column("wrapper").to_pylist(), strict=True))
        wrapper = json.loads(parts[0][1])
        for _, more in parts[1:]:
            wrapper = merge(wrapper, json.loads(more))
        return pa.table({"host": [key[0].as_py()], "part": pa.array([parts[0][0]], pa.int64()), "wrapper": [json.dumps(wrapper)]})

    return df.groupBy(*keys).applyInArrow(run, "host string, part long, wrapper string")


def wrappers(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) for every host of ``df``, the wrapper as JSON; ``expression`` writes it as a regular expression."""
    rows = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            nonlocal part
            part += 1
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array(map(json.dumps, held.values()), pa.string())], ["host", "part", "wrapper"])
            held.clear()
            return made

        for batch in it:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                own, host = items_of(parse(page.as_py())), host.as_py()
                held[host] = merge(held[host], own) if host in held else own
                if len(held) >= _HOSTS:
                    yield out()
        yield out()

    parts = rows.mapInArrow(run, "host string, part long, wrapper string")
    first = _merged(parts.withColumn("bucket", F.pmod(F.shiftright("part", 24), F.lit(_BUCKETS))), "host", "bucket")
    return _merged(first, "host").select("host", "wrapper")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``df``."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            paths, templates = [], []
            for w in batch.column(1):
                wrapper = json.loads(w.as_py())
                paths.append(json.dumps(path := region(wrapper)))
                templates.append(json.dumps(constants(wrapper, path)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(templates, pa.string())], ["of", "path", "template"])

    # written first, so that the planner knows its true size: it is broadcast only if small, else joined by host
    known = materialize(wrappers(df, url_col, html_col).mapInArrow(read, "of string, path string, template string"), "wrappers")
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(known, F.col("host") == F.col("of"), "left").select("id", "url", "html", "path", "template")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [extract(h.as_py(), json.loads(p.as_py() or "null"), json.loads(t.as_py() or "[]")) for h, p, t in zip(batch.column("html"), batch.column("path"), batch.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
