"""HTML extraction by site template removal.

A page is read into a tree; each element's subtree is hashed by its tag, classes and
text.  The hashes are counted per host in Spark, over pages of different content, and
subtrees that recur on many pages of a host are its template and are deleted.  Elements
whose tag, class, id or role says that they are no text (menus, notices, adverts, forms,
comments ...) are deleted too.  Of the rest, the articles are given; the whole body where
a page has none.

Inside an `article` or `main` element, paragraphs and headings are the author's and stay,
so that a paragraph which copies of an article share stays.  Containers there (share bars,
author boxes) are counted by what stands next to them: a bar of the site meets another
text on every page, a list that was copied with its article meets the same.

No word deletes the text of a page: where all articles lie in elements that are named
like no text (`layout has-sidebar`), the elements around the longest one stay.

The recurring hashes go to the tasks while they are at most `SENT`; beyond that the
hashes of each page meet them in a shuffled join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.cascade import host_of
from martlet.llm.common import sent, ship, stage

ship(__name__)

MANY, SHARE = 5, 0.02   # a template recurs on so many different pages of its host, and on this share of them
ENOUGH = 100            # so many pages are enough on a host of any size
SENT = 1_000_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*"|'[^'<]*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACE = re.compile(r"\s+")

# Their content is no markup, to the end of the page if they are not closed.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp"}
# Their content is skipped; one that is not closed is an element like any other.
HIDDEN = {"noscript", "template", "svg", "object", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol",
          "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Tags that a start tag closes, up to the nearest of the tags that stop the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OWN = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details"}   # inside an article, these may be templates
INSIDE = 0x9E3779B97F4A7C15                                              # tells a hash inside an article from the same outside
SECTIONS = {"nav", "header", "footer", "article", "main"}                # a form that holds one is around a page
# Elements that are never text, anywhere; and those that are none outside an article.
NEVER = {"aside", "button", "datalist", "dialog", "footer", "form", "head", "input", "label", "menu", "nav", "select"}
OUTSIDE = {"header"}
NAMED = {"ad", "ads", "adsense", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
         "cookies", "disqus", "dropdown", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager",
         "popup", "promo", "promoted", "related", "replies", "respond", "responses", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
         "complementary", "contentinfo", "search"}
NAMED_OUTSIDE = {"header", "masthead", "top"}
REMARKS = {"comment", "comments", "comment-body"}   # whole classes of an article that is a reader's; `comments-open` is none


class Node:
    __slots__ = ("tag", "names", "parts", "hash", "own", "around", "remark", "wraps")

    def __init__(self, tag: str, names: frozenset, own: bool, remark: bool = False):
        self.tag, self.names, self.own = tag, names, own   # own: inside an article or main
        self.remark = remark                               # an article that is a reader's comment
        self.parts: list = []
        self.hash = 0
        self.around = False   # holds an article or main
        self.wraps = False    # holds a section of the page


def _names(attributes: str) -> frozenset:
    """The words of class, id and role."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(w for m in ATTRIBUTE.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w)


def _classes(attributes: str) -> set:
    """Class, id and role, as whole words."""
    return {w for m in ATTRIBUTE.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}


def _digest(node: Node, host: str) -> int:
    body = "\x1f".join([host, node.tag, " ".join(sorted(node.names)), *[p if isinstance(p, str) else f"{p.hash:x}" for p in node.parts]])
    return xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass"))


def parse(page: str, host: str) -> Node:
    """The tree of a page.  Missing and crossed end tags are mended as browsers do, in outline; text is decoded, white space is single."""
    root = Node("html", frozenset(), False)
    stack = [root]
    at, end = 0, len(page)
    unclosed: set[str] = set()   # hidden tags that no end tag follows any more

    def text(piece: str) -> None:
        if piece:
            piece = SPACE.sub(" ", entities.unescape(piece) if "&" in piece else piece)
            stack[-1].parts.append(piece)

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            node.hash = _digest(node, host)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW or (tag in HIDDEN and tag not in unclosed and not m[3].endswith("/")):
            # A slash closes no script or style; HTML ignores it there.
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if over or tag in RAW:
                at = over.end() if over else end
                continue
            unclosed.add(tag)
        if tag in HIDDEN:
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag != "hr" else Node("hr", frozenset(), False))
            continue
        if tag in BLOCKS and tag != "body":
            # A block ends an open paragraph, with the inline elements in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[i].tag in STOPS[tag]:
                break
            if stack[i].tag in CLOSES[tag]:
                close(i)
                break
        remark = tag in OWN and "=" in m[3] and not REMARKS.isdisjoint(_classes(m[3]))
        node = Node(tag, _names(m[3]), stack[-1].own or tag in OWN, remark)
        stack[-1].parts.append(node)
        for outer in reversed(stack) if tag in SECTIONS else ():
            if outer.wraps:
                break
            outer.wraps = True
        for outer in reversed(stack) if tag in OWN else ():
            if outer.around:
                break
            outer.around = True
        if not m[3].endswith("/") or tag in BLOCKS:
            stack.append(node)
    close(0)
    return root


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [p for p in node.parts if isinstance(p, Node)]


def _may_go(node: Node) -> bool:
    """Whether template removal may delete a subtree."""
    if node.around or not node.parts or node.tag in ("html", "body"):
        return False
    return node.tag in CONTAINERS if node.own else node.tag in BLOCKS


def _key(node: Node) -> int:
    return node.hash ^ INSIDE if node.own else node.hash


def subtree_hashes(root: Node) -> tuple[list[int], list[int], list[int]]:
    """Hashes of the subtrees that template removal may delete: those outside articles, those inside, and for these their neighbours."""
    outside: set[int] = set()
    inside: set[tuple[int, int]] = set()
    for node in _nodes(root):
        parts = [p for p in node.parts if not isinstance(p, str) or p.strip()]
        for at, part in enumerate(parts):
            if not isinstance(part, Node) or not _may_go(part):
                continue
            if not part.own:
                outside.add(part.hash)
                continue
            beside = [p if isinstance(p, str) else f"{p.hash:x}" for p in (*parts[max(at - 1, 0):at], None, *parts[at + 1:at + 2]) if p is not None]
            inside.add((_key(part), xxhash.xxh64_intdigest("\x1f".join(beside).encode("utf-8", "surrogatepass"))))
    return list(outside), [h for h, _ in inside], [by for _, by in inside]


def _is_text(node: Node, kept: frozenset | set) -> bool:
    if node in kept:
        return True
    if node.tag == "form" and node.wraps:
        return True
    if node.tag in NEVER or (node.tag in OUTSIDE and not node.own):
        return False
    if node.tag in OWN or node.tag in ("html", "body"):
        return not node.remark
    return not (node.names & NAMED or (not node.own and node.names & NAMED_OUTSIDE))


def _around_longest(root: Node) -> set[Node]:
    """The longest article of a page that is no reader's, and what is around it."""
    best, kept = 0, set()
    todo: list = [(root, ())]
    while todo:
        node, above = todo.pop()
        if node.tag in NEVER - {"form"} or node.remark:
            continue
        chain = (node, above)
        if node.tag in OWN:
            size = sum(len(p.strip()) for n in _nodes(node) for p in n.parts if isinstance(p, str))
            if size > best:
                best, kept = size, set()
                while chain:
                    kept.add(chain[0])
                    chain = chain[1]
            continue
        if node.around or node is root:
            todo += [(p, chain) for p in node.parts[::-1] if isinstance(p, Node)]
    return kept


def _texts(root: Node, is_template: Callable[[int], bool], kept: frozenset | set) -> tuple[str, str]:
    """Blocks in page order, joined by two line ends: of the outermost articles, and of all that is left."""
    blocks: list[list[str]] = [[]]
    owned: list[list[str]] = [[]]
    # (part, inside an article); None ends a block.
    todo: list = [(root, False)]
    while todo:
        part, inside = todo.pop()
        if part is None or isinstance(part, str):
            for out in (blocks, owned) if inside else (blocks,):
                out.append([]) if part is None else out[-1].append(part)
            continue
        if not _is_text(part, kept) or (_may_go(part) and is_template(_key(part))):
            continue
        inside = inside or part.tag in OWN
        edge = [(None, inside)] if part.tag in BLOCKS else []
        todo += edge + [(p, inside) for p in reversed(part.parts)] + edge
    joined = ([SPACE.sub(" ", "".join(b)).strip() for b in out] for out in (owned, blocks))
    owned_text, all_text = ("\n\n".join(b for b in j if b) for j in joined)
    return owned_text, all_text


def main_text(root: Node, is_template: Callable[[int], bool]) -> str:
    """The text of a page's articles, or of all that is left if there is none."""
    owned, rest = _texts(root, is_template, frozenset())
    if not owned and root.around:
        owned, _ = _texts(root, is_template, _around_longest(root))
    return owned or rest


def _hashed():
    @F.pandas_udf("outside array<long>, inside array<long>, near array<long>")
    def hashed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, hosts in batches:
            rows = [[np.array(part, np.uint64).view(np.int64) for part in subtree_hashes(parse(p, h))] for p, h in zip(pages, hosts)]
            yield pd.DataFrame(rows, columns=["outside", "inside", "near"], dtype=object)

    return hashed


def _extracted(known):
    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        everywhere = set(known.value.tolist()) if known else set()
        for pages, hosts, own in batches:
            texts = []
            for page, host, some in zip(pages, hosts, own):
                found = everywhere if some is None else {int(x) & (1 << 64) - 1 for x in some}
                texts.append(main_text(parse(page, host), found.__contains__))
            yield pd.Series(texts, dtype=object)

    return extracted


def main_texts(pages: DataFrame, many: int = MANY, share: float = SHARE, most_sent: int = SENT, enough: int = ENOUGH) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A subtree is a template on `many` pages of its host that are a share of `share` of
    them, or on `enough` (and `many`) whatever the host's size.
    Inside articles, places with the same neighbours count once.  Null html is an empty
    page; its text is empty, as is that of a page that is all template.  Null or malformed URLs share the empty host.  Rows with the same host
    and html count once as a page of the host; each is extracted.  An empty table
    gives no rows.
    """
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    content = F.xxhash64("html").alias("content")
    hashed = stage(read.select(F.xxhash64("host").alias("site"), content, _hashed()("html", "host").alias("found")))
    # `by` is what different pages are told by: their content, or inside an article the neighbours.
    outside = F.transform("found.outside", lambda h: F.struct(h.alias("h"), F.col("content").alias("by")))
    inside = F.transform(F.arrays_zip("found.inside", "found.near"), lambda x: F.struct(x["inside"].alias("h"), x["near"].alias("by")))
    seen = hashed.select("site", "content", F.concat(outside, inside).alias("hs"))
    sizes = seen.select("site", "content").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counted = seen.select("site", F.inline("hs")).distinct().groupBy("site", "h").agg(F.count(F.lit(1)).alias("on"))
    template = stage(counted.filter(F.col("on") >= many).join(sizes, "site").filter((F.col("on") >= F.col("pages") * share) | (F.col("on") >= enough)).select("h"))
    known = sent(template, most_sent)
    if known:
        read = read.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        hit = seen.select("content", "site", F.inline("hs")).drop("by").join(template.distinct(), "h").groupBy("content", "site").agg(F.collect_set("h").alias("own"))
        hit = hit.select(F.col("content").alias("__content"), F.col("site").alias("__site"), "own")
        same = (F.xxhash64(read["html"]) == hit["__content"]) & (F.xxhash64(read["host"]) == hit["__site"])
        read = read.join(hit, same, "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    texts = read.select("page_id", "url", _extracted(known)("html", "host", "own").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
