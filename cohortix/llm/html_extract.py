"""Main-text extraction by minimum cut (operator 6).

A page is read once into text blocks (runs of text between block-level tags).
A linear classifier scores each block from its place in the document (article,
navigation, footer, comment and advert containers), its length and the share
of its text in links; the costs of calling it content or boilerplate are its
terminal capacities.  Blocks that follow one another, and blocks close in the
DOM, are joined by smoothness edges.  The minimum cut, found by maximum flow,
separates content from boilerplate.

A block whose score outweighs all its edges has the same label in every
minimum cut; such blocks are decided first, and flow runs on the rest.

Scale: pages are independent; one pass, no shuffle.

An article or main element inside a container that is boilerplate by its name
is scored as an article: a wrapper's class ("layout with-sidebar") does not
outweigh it.  In navigation, asides, footers, comments, adverts and lists of
related pages, and in an article's own boilerplate, it counts only if the page
has no other article.  Scripts, styles, controls, players, frames and drawings
are skipped; a self-closed or unclosed one hides nothing (an unclosed script or
style hides the rest, as in browsers).  Text of math, object and, inside an
article, noscript elements is text.

Edge cases: null or empty html, and html without content, gives the empty
string and n_chars 0; unclosed, unknown and wrongly nested tags are tolerated;
character references are decoded once; pages of any length are read whole;
repeated rows are extracted row by row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import with_columns_of, worker_cache

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
# skipped with their content, if not self-closed and if their own end follows
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style)\b" + _ATTRIBUTES + r"(?<!/)>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<skip>iframe|select|textarea|button|canvas|video|audio)\b" + _ATTRIBUTES + r"(?<!/)>(?:(?!</?(?P=skip)\b).)*+</(?P=skip)\s*>"
    r"|<(?P<nest>svg|template)\b" + _ATTRIBUTES + r"(?<!/)>(?:(?!</?(?P=nest)\b).|<(?P=nest)\b[^>]*/>"
    r"|<(?P=nest)\b[^>]*>(?:(?!</?(?P=nest)\b).)*+</(?P=nest)\s*>)*+</(?P=nest)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>" + _ATTRIBUTES + r")>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q ruby rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr math menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
SELF_CLOSED = frozenset("script style iframe select textarea button canvas video audio svg template object math noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a new one ends an open one of the same kind
IMPLIED_END = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul".split())
AWAY_TAGS = frozenset("nav footer aside form menu dialog".split())
AWAY_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments
    consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices notification overlay pagination pager popup promo promotion recommended related replies reply respond search share
    sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets""".split())
# in these an article may be a teaser or a comment
LIST_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox comment comments disqus footer modal popup promo
    promotion recommended related replies reply respond sidebar sponsor sponsored widget widgets""".split())
LIST_TAGS = frozenset("nav footer aside menu dialog".split())
HOME_WORDS = frozenset("article articlebody body content entry main post story text".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# "has-sidebar" tells of a neighbour, not of the element
_MODIFIER = re.compile(r"(?:has|with|without|no)(?:[-_]|(?=[A-Z]))")

HIDDEN, AWAY, LIST, HOME, ARTICLE, MAIN = "hidden", "away", "list", "home", "article", "main"


def kind_of(tag: str, attributes: str) -> str | None:
    """``container_kind``, remembered by the worker (the memory is bounded)."""
    cache = worker_cache().setdefault("html-containers", {})
    if (tag, attributes) not in cache:
        if len(cache) >= 20_000:
            cache.clear()
        cache[tag, attributes] = container_kind(tag, attributes)
    return cache[tag, attributes]


def container_kind(tag: str, attributes: str) -> str | None:
    """What an element says about its content, by tag, role, class and id."""
    if tag in ("head", "annotation", "annotation-xml"):
        return HIDDEN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) \
            or re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "\"\"", attributes), re.I):
        return HIDDEN
    role = found.get("role", "").lower()
    if role in AWAY_ROLES:
        return AWAY if role in ("form", "search") else LIST
    if tag in AWAY_TAGS:
        return LIST if tag in LIST_TAGS else AWAY
    names = [n for n in (found.get("class", "") + " " + found.get("id", "")).split() if not _MODIFIER.match(n)]
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article" or role == "article":
        return HOME if words & LIST_WORDS else ARTICLE
    if tag in ("html", "body"):
        return None
    if words & AWAY_WORDS and not words & HOME_WORDS or words & {"comment", "comments"}:
        return LIST if words & LIST_WORDS else AWAY
    return HOME if words & HOME_WORDS else (AWAY if tag == "header" else None)


class Block:
    __slots__ = ("parts", "linked", "tag", "parent", "grand", "home", "away", "head", "region")

    def __init__(self, tag, parent, grand, home, away, head, region):
        self.parts, self.linked = [], 0
        self.tag, self.parent, self.grand = tag, parent, grand
        self.home, self.away, self.head, self.region = home, away, head, region


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, hidden ones left out."""
    out: list[Block] = []
    # an open element: tag, number, inside article (ARTICLE or MAIN: by its tag), inside boilerplate (ARTICLE: in an
    # article there), hidden, inside a header, region
    stack = [("", 0, False, False, False, False, 0)]
    current, links, number = None, 0, 0
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            top = stack[-1]
            if top[4]:
                continue
            if current is None:
                if text.isspace():
                    continue
                block = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
                k = stack.index(block)
                current = Block(block[0], block[1], stack[max(k - 1, 0)][1], top[2], top[3], top[5], top[6])
                out.append(current)
            current.parts.append(text)
            if links:
                current.linked += len(text)
            continue
        name = m["tag"] or m["tag2"]
        if name is None:
            if m["skip"] and m["skip"].lower() in ("iframe", "video", "audio", "canvas"):
                current = None
            continue
        tag, closing, attributes = name.lower(), m["end"] or m["end2"], m["attributes"] or m["attributes2"] or ""
        if tag not in INLINE or tag == "wbr":
            if tag != "wbr":
                current = None
        if closing:
            if tag == "a":
                links = max(links - 1, 0)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[k + (tag == "a"):])
                    links = max(links, 0)
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID or tag in SELF_CLOSED and attributes.endswith("/"):
            continue
        ends = IMPLIED_END.get(tag, ()) or (("p",) if tag in CLOSES_P else ())
        if tag in CLOSES_P and "p" not in ends:
            ends += ("p",)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                links = max(links - sum(e[0] == "a" for e in stack[k:]), 0)
                del stack[k:]
                break
            if stack[k][0] not in INLINE and not (stack[k][0] == "p" and "p" in ends):
                break
        top, number = stack[-1], number + 1
        kind = kind_of(tag, attributes)
        home, away, hidden, head, region = top[2], top[3], top[4], top[5], top[6]
        if tag == "noscript" and not kind and not home:
            kind = LIST                 # of an article it is text, elsewhere a notice
        if kind == HIDDEN:
            hidden = True
        elif kind in (HOME, ARTICLE, MAIN):
            if kind == MAIN or kind == ARTICLE and away == AWAY:
                away = False            # a wrapper's name says nothing about the article in it
            elif kind == ARTICLE and away == LIST:
                away = ARTICLE
            home, region = (home or HOME) if kind == HOME else kind, number
        elif kind:
            if tag == "header" and home:
                head = True             # an article's own header: its headings stay
            else:
                # inside an article every further article counts as one of a list
                away = LIST if kind == LIST or home == ARTICLE or away == LIST else AWAY
            region = number
        if tag == "a":
            links += 1
        stack.append((tag, number, home, away, hidden, head, region))
    return out


def score(block: Block, text: str, has_home: bool) -> float:
    """Above 0: content.  The weights are fixed; they favour containers over
    text statistics, so a short paragraph of an article stays."""
    words = text.count(" ") + 1
    s = 0.3 + 0.5 * math.log(words)
    s -= 3.0 * min(1.0, block.linked / max(len(text), 1))
    if block.home:
        s += 4.0
    elif has_home:
        s -= 5.0
    if block.away:
        s -= 12.0
    if block.head and block.tag not in HEADINGS:
        s -= 12.0
    if block.tag in HEADINGS:
        s += 0.7
    elif block.tag == "p":
        s += 0.8
    return s


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the content side of a minimum cut."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    # the difference of a block's two capacities is its score; decided
    # neighbours add their edge to one side
    unary, label = list(scores), [None] * n
    queue = deque(range(n))
    waiting = [True] * n
    while queue:
        i = queue.popleft()
        waiting[i] = False
        if label[i] is not None or abs(unary[i]) <= sum(near[i].values()):
            continue
        label[i] = unary[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            if label[j] is None:
                unary[j] += w if label[i] else -w
                if not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
        near[i].clear()
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow_side(rest, unary, near)):
            label[i] = side
    return label


def _max_flow_side(rest, unary, near) -> list[bool]:
    """Shortest augmenting paths between source (content) and sink; a block is
    content when the source still reaches it."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[source], cap[sink] = {}, {}
    for i in rest:
        if unary[i] > 0:
            cap[source][i], cap[i][source] = unary[i], 0.0
        else:
            cap[i][sink], cap[sink][i] = -unary[i], 0.0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return [i in before for i in rest]
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow


def extract_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found = [(b, " ".join(_html.unescape("".join(b.parts)).split())) for b in blocks_of(page)]
    found = [(b, t) for b, t in found if t]
    if not any(b.home in (ARTICLE, MAIN) and not b.away for b, _ in found):
        for b, _ in found:              # the only articles of the page, whatever holds them
            if b.away == ARTICLE:
                b.away = False
    has_home = any(b.home and not b.away for b, _ in found)
    scores = [score(b, t, has_home) for b, t in found]
    edges, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            p = found[i - 1][0]
            edges.append((i - 1, i, 0.8 if p.parent == b.parent else 0.5 if p.region == b.region else 0.05))
        for place, w in ((b.parent, 0.3), (b.grand, 0.2)):     # close in the DOM
            if place in last and last[place] != i - 1:
                edges.append((last[place], i, w))
        last[b.parent] = last[b.grand] = i
    return " ".join(t for (_, t), keep in zip(found, minimum_cut(scores, edges)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = with_columns_of(pages, ["page_id", "url", "html"]).select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(it):
        import pyarrow as pa

        for b in it:
            texts = [extract_text(h) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    kind = "bigint" if kind == "void" else kind
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint")
