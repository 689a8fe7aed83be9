"""HTML extraction by wrappers: union-free regular expressions inferred per host.

A page becomes a tree of block elements. Runs of like siblings are folded into repeated items and
repeated groups; the trees of a host are aligned one after another, where what only some have
becomes optional. What remains is one expression per host of fixed elements, options, repeats and
text slots. The host's pages then show what each slot holds: text that is the same again and
again, links, or text of its own; so its slots are told apart as article or furniture.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize, same, texts

#: Elements whose content HTML reads as text up to their end tag, or to the end of the page.
_RAW = {n: re.compile(rf"</{n}\b[^>]*>|\Z", re.I) for n in "script style textarea title iframe noembed noframes xmp".split()}
#: Elements whose text is not the page's: pictures, form controls, what is shown without scripts.
_HIDDEN = frozenset("svg template noscript select button option datalist audio video canvas".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLOCKS = frozenset(
    "head main article section nav header footer aside form div p ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details summary hgroup center dialog menu".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: A start tag of the key closes an open element of the set, up to the nearest element of the other set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_FURNITURE_TAGS = frozenset("nav footer aside form head dialog menu".split())
#: Whole class names, ids and roles of furniture, for slots whose pages do not tell (comments differ from page to page).
_FURNITURE = re.compile(
    r"(?:^| )(?:nav|navbar|navigation|site-nav|main-nav|top-nav|menu|main-menu|site-menu|foot|footer|site-footer|page-footer|header|site-header|page-header|masthead"
    r"|top-?bar|side-?bar(?:-\d*)?|(?:left|right)-side-?bar|(?:reader-|user-|post-)?comments?(?:-list|-area|-section|-form|-body|-box)?|replies|disqus(?:_thread)?"
    r"|ads?|ad-(?:box|slot|unit|banner|container)|advert\w*|sponsor(?:ed)?|promo|banner|cookies?|cookie-(?:notice|banner|bar)|consent|notice|popup|modal"
    r"|share|sharing|share-(?:bar|buttons)|social|social-(?:links|share)|related|related-(?:posts|articles|links)|recommended|recommendations|breadcrumbs?|widgets?"
    r"|subscribe|newsletter|signup|login|role-complementary|role-contentinfo|role-navigation|role-banner|role-search|search|search-(?:box|form|bar)"
    r"|toolbar|pagination|pager|skip(?:-link)?)(?:$| )"
)
_DEEPEST = 150
#: Characters at the beginning of a slot's text that pages have in common where the rest differs.
LEAD = 12
#: The parts of a div and the like by which it is told from another: text of its own, headings and
#: paragraphs, lists, tables, forms, further containers.
_PARTS = {
    **dict.fromkeys("h1 h2 h3 h4 h5 h6 p blockquote pre figure hgroup address".split(), "p"), **dict.fromkeys("ul ol dl menu".split(), "l"),
    "table": "t", "form": "f", "fieldset": "f", **dict.fromkeys("div section article main nav aside header footer center".split(), "d"),
}
_CONTAINERS = frozenset("div section center td".split())


# ---------------------------------------------------------------- pages
class Item:
    """An element (or a repeated group of elements) of a page or of a wrapper."""

    __slots__ = ("key", "mode", "kids", "blocks", "slot")

    def __init__(self, key: str, mode: str = "1", kids: list[Item] | None = None) -> None:
        self.key, self.mode, self.kids = key, mode, kids or []
        self.blocks: list[int] = []  # numbers of the text blocks directly in it
        self.slot = -1  # of a wrapper: its number; of a page: that it has no text of its own, or -2


def _key(tag: str, attributes: str) -> str:
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    words = " ".join(found.get(n, "") if n != "role" else "role-" + found[n] for n in ("class", "id", "role") if n in found)
    words = re.sub(r"[^a-z _-]+", "", unescape(words).lower())
    return (tag + " " + " ".join(words.split())).strip()


def _name(item: Item) -> str:
    return item.key.partition(" ")[0].partition("{")[0]


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, tag, attributes) of every tag in page order, and last (text, "", "", "").
    Comments, declarations and the content of raw elements are left out; a raw element gives its
    name and, as attributes, nothing. A quote that is never closed is a character like any other."""
    at = start = 0
    last = html.rfind(">")
    text: list[str] = []
    while (at := html.find("<", start)) >= 0:
        text.append(html[start:at])
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            start = len(html) if end < 0 else end + 3
            continue
        m = _TAG.match(html, at) if at < last else None
        if m is None:
            if at < last and html.startswith(("<!", "<?"), at):
                start = html.index(">", at) + 1
                continue
            if at >= last and re.match(r"</?[a-zA-Z]|<[!?]", html[at : at + 3]):
                start = len(html)  # a tag that the page breaks off
                break
            text.append("<")
            start = at + 1
            continue
        tag = m.group(2).lower()
        start = m.end()
        raw = _RAW.get(tag) if not m.group(1) else None
        if raw is not None:
            start = raw.search(html, start).end()
        yield "".join(text), m.group(1), tag, m.group(3)
        text = []
    text.append(html[start:])
    yield "".join(text), "", "", ""


def parse(html: str) -> tuple[Item, list[str], list[int]]:
    """The element tree of a page, its text blocks in page order, and how many characters of each are links.

    A block is the text between two borders of block elements, character references decoded,
    white space turned into single spaces, trimmed; empty ones are left out. Elements left open
    are closed as HTML does. Elements nested deeper than a limit count as their parent's, and
    their end tags close nothing else.
    """
    root = Item("")
    stack, blocks, links = [root], [], []
    piece: list[str] = []
    linked = 0
    in_link = False
    too_deep: Counter = Counter()
    hidden: list[tuple[str, int]] = []  # an open element whose text is not the page's, and the depth of the stack around it

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                stack[-1].blocks.append(len(blocks))
                blocks.append(text)
                links.append(min(linked, len(text)))
        linked = 0

    def cut(depth: int) -> None:
        del stack[depth:]
        while hidden and hidden[-1][1] > len(stack):
            hidden.pop()

    for text, slash, tag, attributes in tokens(html):
        if text and not hidden:
            piece.append(text)
            if in_link:
                linked += len(text.strip())
        if not tag:
            break
        if tag in _RAW or tag in _VOID:
            if tag in _VOID and not hidden:
                piece.append(" ")
            continue
        if tag in _HIDDEN:
            if slash:
                if any(t == tag for t, _ in hidden):
                    while hidden.pop()[0] != tag:
                        pass
            elif not (tag == "svg" and attributes.rstrip().endswith("/")):
                hidden.append((tag, len(stack)))
            continue
        if slash:
            if tag == "a":
                in_link = False
            elif too_deep[tag]:
                too_deep[tag] -= 1
                flush()
            elif tag in _BLOCKS or any(_name(x) == tag for x in stack[1:]):
                flush()
                if open_at := next((i for i in range(len(stack) - 1, 0, -1) if _name(stack[i]) == tag), 0):
                    cut(open_at)
                in_link = False
            continue
        if tag in ("html", "body"):  # may be left out, so they are no part of the tree
            flush()
            cut(1)
            continue
        if tag == "a":
            in_link = True
        key = _key(tag, attributes) if attributes else tag
        if tag not in _BLOCKS and not (" " in key and _FURNITURE.search(key.partition(" ")[2])):
            continue
        flush()
        in_link = False
        if tag in _BLOCKS:
            while hidden and hidden[-1][0] in ("svg", "option", "button"):  # left open: a block is none of its content
                hidden.pop()
            if _name(stack[-1]) == "p":
                cut(len(stack) - 1)
        closes, until = _CLOSES.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            name = _name(stack[i])
            if name in until:
                break
            if name in closes:
                cut(i)
                break
        if len(stack) < _DEEPEST:
            item = Item(key)
            stack[-1].kids.append(item)
            stack.append(item)
        else:
            too_deep[tag] += 1
    flush()
    _tell_apart(root)
    return root, blocks, links


def _tell_apart(item: Item) -> None:
    """Adds to the keys of containers what they hold: div{p} is another element than div{l}."""
    for kid in item.kids:
        _tell_apart(kid)
    if _name(item) in _CONTAINERS:
        parts = {_PARTS.get(_name(k), "") for k in item.kids} | ({"#"} if item.blocks else set())
        item.key += "{" + "".join(sorted(parts)) + "}"


# ---------------------------------------------------------------- inference
_MODES = {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}


def _mode(a: str, b: str, optional: bool = False, repeated: bool = False) -> str:
    return _MODES[optional or a in "?*" or b in "?*", repeated or a in "+*" or b in "+*"]


def _merge(a: Item, b: Item, repeated: bool = False) -> Item:
    out = Item(a.key, _mode(a.mode, b.mode, repeated=repeated), align(a.kids, b.kids))
    out.blocks = a.blocks + b.blocks
    out.slot = min(a.slot, b.slot)
    return out


def fold(items: list[Item], longest: int = 3) -> list[Item]:
    """Neighbouring like items become one repeated item, neighbouring like runs of up to
    ``longest`` items one repeated group."""
    out: list[Item] = []
    for item in items:
        out.append(item)
        size = 1
        while size <= longest:
            if len(out) >= size + 1 and size > 1 and out[-size - 1].key == _group_key(out[-size:]):
                group = Item(out[-size - 1].key, "+", out[-size:])
                out[-size - 1 :] = [_merge(out[-size - 1], group, repeated=True)]
                size = 1
            elif len(out) >= 2 * size and [x.key for x in out[-size:]] == [x.key for x in out[-2 * size : -size]]:
                first, second = out[-2 * size : -size], out[-size:]
                if size == 1:
                    out[-2:] = [_merge(first[0], second[0], repeated=True)]
                else:
                    merged = [_merge(a, b) for a, b in zip(first, second)]
                    out[-2 * size :] = [Item(_group_key(merged), "+", merged)]
                size = 1
            else:
                size += 1
    return out


def _group_key(items: list[Item]) -> str:
    return "(" + ",".join(x.key for x in items) + ")"


def generalise(item: Item) -> Item:
    out = Item(item.key, item.mode, fold([generalise(k) for k in item.kids]))
    out.blocks = item.blocks
    out.slot = -2 if item.blocks else -1
    return out


def _grouped(items: list[Item], like: list[Item]) -> list[Item]:
    """Runs of ``items`` that match a repeated group of ``like``, as a group of their own."""
    for group in like:
        size = len(group.kids)
        if not group.key.startswith("(") or any(x.key == group.key for x in items):
            continue
        for i in range(len(items) - size + 1):
            if _group_key(items[i : i + size]) == group.key:
                items = [*items[:i], Item(group.key, "1", items[i : i + size]), *items[i + size :]]
                break
    return items


def matches(a: list[Item], b: list[Item], full: int = 40_000) -> list[tuple[int, int]]:
    """Pairs of positions of a common subsequence of keys: equal ends, and between them a longest one,
    or, where a table of ``full`` cells would not do, one along the keys that both have once."""
    return _matches([x.key for x in a], [x.key for x in b], full)


def _matches(a: list[str], b: list[str], full: int) -> list[tuple[int, int]]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) > full:
        ones = ({k: i for i, k in enumerate(z) if n[k] == 1} for z in (x, y) for n in [Counter(z)])
        one, other = ones
        tops: list[int] = []  # longest rising chain of places in y, in order of x
        chain: list[tuple[int, int, int]] = []
        best: list[int] = []
        for key, i in one.items():
            if key in other:
                j = other[key]
                k = bisect_left(tops, j)
                tops[k:] = [j]
                chain.append((i, j, best[k - 1] if k else -1))
                best[k:] = [len(chain) - 1]
        anchors, k = [], best[-1] if best else -1
        while k >= 0:
            anchors.append(chain[k][:2])
            k = chain[k][2]
        inner: list[tuple[int, int]] = []
        i = j = 0
        if anchors:
            for p, q in [*anchors[::-1], (len(x), len(y))]:
                inner += [(i + u, j + v) for u, v in _matches(x[i:p], y[j:q], full)]
                inner += [(p, q)] * (p < len(x))
                i, j = p + 1, q + 1
        else:
            places: dict[str, list[int]] = {}
            for v, key in enumerate(y):
                places.setdefault(key, []).append(v)
            for i, key in enumerate(x):
                at = places.get(key, [])
                if (k := bisect_left(at, j)) < len(at) and at[k] - j <= 64:
                    inner.append((i, at[k]))
                    j = at[k] + 1
    else:
        inner = _longest(x, y)
    return [*ends[0], *((head + i, head + j) for i, j in inner), *ends[1]]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Both lists as one: common items merged in order, others optional, repeats folded."""
    if not a and not b:
        return []
    a, b = _grouped(a, b), _grouped(b, a)
    out, i, j = [], 0, 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        for rest in (*a[i:p], *b[j:q]):
            rest.mode = _mode(rest.mode, "1", optional=True)
            out.append(rest)
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def number(wrapper: Item, at: int = 0) -> int:
    """Gives every item of a wrapper the number of its slot, in order; the count."""
    wrapper.slot = at
    at += 1
    for kid in wrapper.kids:
        at = number(kid, at)
    return at


def _named_furniture(key: str, inside: bool) -> bool:
    words = key.partition(" ")[2].partition("{")[0]
    tag = key.partition(" ")[0].partition("{")[0]
    return tag in _FURNITURE_TAGS or (tag == "header" and not inside) or bool(words and _FURNITURE.search(words))


def decide(wrapper: Item, seen: dict[int, tuple[int, int, int, int, int, int]]) -> list[bool]:
    """By slot, whether it is article (kept) or furniture.

    ``seen``: for the slots that hold text the number of pages with it, on how many of them its text is
    that of another page too, on how many it begins as on another page of the host (the constant
    beginning of a slot whose end varies), characters, those in links, and characters of different texts.

    The main slot is the one with most different text outside links, furniture by name left aside
    where there is other. Slots are furniture whose text mostly repeats or mostly begins alike (on clearly
    more of their pages than the main slot's, so that copied articles stay articles), or that are mostly links;
    a first-degree heading beside the main slot stays its title, whatever its pages have in common;
    within the main slot's article or main element, if it has one, links do not count, and repeats only
    with four pages or more; what is outside such elements is furniture. A name (nav, footer, aside,
    form, class words) makes a slot furniture, too, but not one around the main slot: it decides
    where pages cannot tell, as for readers' comments or a host's only page.
    """
    paths: dict[int, list[Item]] = {}

    def walk(item: Item, path: list[Item]) -> None:
        paths[item.slot] = [*path, item]
        for kid in item.kids:
            walk(kid, paths[item.slot])

    walk(wrapper, [])
    inside = {s: any(_name(x) in ("article", "main") for x in path) for s, path in paths.items()}
    named = {s: any(_named_furniture(x.key, inside[s]) for x in path) for s, path in paths.items()}
    worth = {s: different * (1 - links / max(1, chars)) for s, (_, _, _, chars, links, different) in seen.items()}
    if not worth:
        return [not named[s] for s in range(len(paths))]
    main = max(worth, key=lambda s: (not named[s], worth[s], -s))
    around = set(map(id, paths[main]))
    scope = next((want for want in ("article", "main") if any(_name(x) == want for x in paths[main])), None)
    usual = [n / seen[main][0] for n in seen[main][1:3]]
    keep = []
    for s in range(len(paths)):
        path = paths[s]
        ok = not any(id(x) not in around and _named_furniture(x.key, inside[s]) for x in path)
        if scope is not None and not any(_name(x) == scope for x in path):
            ok = False
        if s in seen and s != main:
            pages, again, led, chars, links, _ = seen[s]
            within = scope is not None
            title = _name(path[-1]) == "h1" and id(path[-2]) in around
            if not title and pages >= (4 if within else 1):
                ok &= not any(u < 0.9 and n / pages >= (1 + u) / 2 for n, u in zip((again, led), usual))
            if not within and 2 * links > chars:
                ok = False
        keep.append(ok)
    return keep


def place(page: Item, wrapper: Item, n_blocks: int) -> list[int]:
    """For every block of a page the slot of its host's wrapper in which it stands, -1 if in none."""
    slots = [-1] * n_blocks

    def walk(item: Item, like: Item | None) -> None:
        for b in item.blocks:
            slots[b] = -1 if like is None else like.slot
        mine = item.kids if like is None else _grouped(item.kids, like.kids)
        pairs = {} if like is None else dict(matches(mine, like.kids))
        by_key = {} if like is None else {x.key: x for x in like.kids}
        for i, kid in enumerate(mine):
            walk(kid, like.kids[pairs[i]] if i in pairs else by_key.get(kid.key))

    walk(page, wrapper)
    return slots


# ---------------------------------------------------------------- as text
def _flat(item: Item) -> list:
    return [item.key, item.mode, [_flat(k) for k in item.kids], item.slot]


def _build(flat: list) -> Item:
    item = Item(flat[0], flat[1], [_build(k) for k in flat[2]])
    item.slot = flat[3]
    return item


def expression(item: Item) -> str:
    """The wrapper as a union-free regular expression: names, groups, ?, + and *, and # for text."""
    inner = " ".join((["#"] if item.slot == -2 else []) + [expression(k) for k in item.kids])
    mark = "" if item.mode == "1" else item.mode
    name = item.key.partition("{")[0]
    return f"({inner}){mark}" if item.key.startswith("(") or not item.key else f"<{name}>{'{' + inner + '}' if inner else ''}{mark}"


def host_of(url: Column) -> Column:
    """The host in lower case without port and user; empty for null or no host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


# ---------------------------------------------------------------- the operator
def _sources(pages: DataFrame, url_col: str, html_col: str, *more: Column) -> DataFrame:
    return pages.select(*more, host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))


def _page(html: bytes) -> tuple[Item, list[str], list[int]]:
    root, blocks, links = parse(html.decode("utf-8", "replace"))
    return generalise(root), blocks, links


def _merge_all(trees: list[tuple[int, str]]) -> str:
    """The trees (pages that have it, tree as text) as one, the commonest first."""
    wrapper = None
    for _, tree in sorted(trees, key=lambda t: (-t[0], t[1])):
        tree = _build(json.loads(tree))
        wrapper = tree if wrapper is None else _merge(wrapper, tree)
    return json.dumps(_flat(wrapper), separators=(",", ":"))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fans: int = 256) -> DataFrame:
    """(host, n_pages, wrapper, expression): one row per host, from all of its pages.

    Every task aligns its own pages of a host, equal results are counted together, and what
    differs is aligned in ``fans`` parts before these are, so that a host with a third of all
    pages is no one task's load.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, sum(t.values()), _merge_all([(n, x) for x, n in t.items()])) for h, t in found.items()]
            found.clear()
            columns = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["host", "n", "tree"])

        held = 0
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), texts(batch, "html")):
                tree = json.dumps(_flat(_page(html)[0]), separators=(",", ":"))
                mine = found.setdefault(host, Counter())
                held += len(tree) * (tree not in mine)
                mine[tree] += 1
                if held > 1 << 24:
                    yield out()
                    held = 0
        yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        trees = list(zip(group["n"].astype(int), group["tree"]))
        return pd.DataFrame([(group["host"].iloc[0], sum(n for n, _ in trees), _merge_all(trees))], columns=["host", "n", "tree"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        joined = join(group)
        wrapper = _build(json.loads(joined["tree"].iloc[0]))
        shown = expression(wrapper)
        number(wrapper)
        flat = json.dumps(_flat(wrapper), separators=(",", ":"))
        return pd.DataFrame([(joined["host"].iloc[0], joined["n"].iloc[0], flat, shown)], columns=["host", "n_pages", "wrapper", "expression"])

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host", "tree").agg(F.sum("n").alias("n"))

    parts = once(_sources(pages, url_col, html_col).mapInArrow(trees, "host string, n long, tree string"))
    parts = parts.groupBy("host", F.pmod(F.xxhash64("tree"), F.lit(fans)).alias("part")).applyInPandas(lambda g: join(g), "host string, n long, tree string")
    return once(parts).groupBy("host").applyInPandas(finish, "host string, n_pages long, wrapper string, expression string")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of every page.

    Each page is matched with its host's wrapper (:func:`infer_wrappers`), which gives every block of
    text a slot. What the slots hold is counted over all pages: a slot's text on a page is a repeat
    if any other page has the same text in any slot. The wrapper's slots are then decided
    (:func:`decide`), and the blocks in article slots are joined by line feeds. Blocks without a
    slot, which a page has only where it and its host's wrapper were aligned differently, are kept.

    Null and empty pages have the empty text. Pages without a host share one wrapper. Repeated rows
    are treated alike and are repeats of each other, as are copies: slots repeat together then, and
    none is furniture for that. Bytes that are not UTF-8 become replacement characters. An empty
    table gives an empty one, and other columns are not read.
    """
    wrappers = materialize(infer_wrappers(pages, url_col, html_col).select("host", "wrapper"), "wrappers").withColumnRenamed("host", "_host")
    source = _sources(pages, url_col, html_col, F.col(id_col).alias("i"), F.col(url_col).alias("u"))
    joined = source.join(wrappers, same(source["host"], wrappers["_host"]), "left").select("i", "u", "host", "html", "wrapper")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("i", "u")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: OrderedDict[str, Item] = OrderedDict()
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                slots, blocks, parts = [], [], []
                for html, shown in zip(texts(batch, "html"), batch.column(4).to_pylist()):
                    wrapper = built.get(shown)
                    if wrapper is None:
                        wrapper = built[shown] = _build(json.loads(shown))
                        if len(built) > 500:
                            built.popitem(last=False)
                    page, found, links = _page(html)
                    slots.append(place(page, wrapper, len(found)))
                    blocks.append([b.encode("utf-8", "replace") for b in found])
                    of_slot: dict[int, list] = {}
                    for slot, block, n in zip(slots[-1], found, links):
                        if slot not in of_slot:
                            of_slot[slot] = [xxhash.xxh64(), 0, 0, xxhash.xxh32_intdigest(block[:LEAD].encode("utf-8", "replace"))]
                        part = of_slot[slot]
                        part[0].update(block.encode("utf-8", "replace") + b"\n")
                        part[1] += len(block)
                        part[2] += n
                    parts.append([
                        {"slot": s, "x": (h.intdigest() ^ 1 << 63) - (1 << 63), "y": y, "chars": c, "links": n} for s, (h, c, n, y) in of_slot.items() if s >= 0
                    ])
                part = pa.list_(pa.struct([("slot", pa.int32()), *((k, pa.int64()) for k in ("x", "y", "chars", "links"))]))
                text = pa.array(blocks, pa.list_(pa.binary()))
                text = pa.ListArray.from_arrays(text.offsets, text.values.view(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(slots, pa.list_(pa.int32())), text, pa.array(parts, part)], ["i", "u", "host", "slots", "blocks", "parts"]
                )

    placed = materialize(
        joined.mapInArrow(
            run,
            f"i {kinds[0]}, u {kinds[1]}, host string, slots array<int>, blocks array<string>, parts array<struct<slot: int, x: long, y: long, chars: long, links: long>>",
        ),
        "placed",
    )
    part = placed.select("host", F.explode("parts").alias("p")).select("host", "p.*")
    part = part.groupBy("host", "slot", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    lead = part.groupBy("host", "slot", "y").agg(F.sum("n").alias("alike"))
    often = part.groupBy("x").agg(F.sum("n").alias("everywhere"))
    slots = (
        part.join(often, "x")
        .join(lead, ["host", "slot", "y"])
        .groupBy("host", "slot")
        .agg(
            F.sum("n").alias("pages"), F.sum(F.when(F.col("everywhere") > 1, F.col("n")).otherwise(0)).alias("again"),
            F.sum(F.when(F.col("alike") > 1, F.col("n")).otherwise(0)).alias("led"),
            F.sum(F.col("n") * F.col("chars")).alias("chars"), F.sum(F.col("n") * F.col("links")).alias("links"), F.sum("chars").alias("different"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", "pages", "again", "led", "chars", "links", "different")).alias("seen"))  # a wrapper's slots
        .withColumnRenamed("host", "_of")
    )
    known = wrappers.join(slots, same(F.col("_host"), F.col("_of")), "left").select("_host", "wrapper", "seen")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for shown, seen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                of_slot = {r["slot"]: (r["pages"], r["again"], r["led"], r["chars"], r["links"], r["different"]) for r in seen or []}
                keep.append([s for s, ok in enumerate(decide(_build(json.loads(shown)), of_slot)) if ok])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.list_(pa.int32()))], ["_host", "keep"])

    kept = materialize(known.mapInArrow(choose, "_host string, keep array<int>"), "kept")  # so that the join knows its size
    text = F.expr("concat_ws('\n', transform(filter(arrays_zip(slots, blocks), z -> z.slots < 0 or array_contains(keep, z.slots)), z -> z.blocks))")
    return placed.join(kept, same(placed["host"], kept["_host"]), "left").select(
        F.col("i").alias(id_col), F.col("u").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars")
    )
