"""Main text of web pages by consensus of a host's pages.

First pass: every page is read into a light tree, its containers are scored by the text of their blocks less that of
links, and the best container's generalised path (tags with classes, digits as #) is the page's vote. Spark counts the
votes of each host. Second pass: pages are read again, and the text of the containers on the host's first winning path
that the page has is taken; a page without any takes its own best container. Both passes take time in proportion to the
page, whatever its nesting: what an element needs of its parents is carried down when it opens, scores are added up once
from the last element to the first, and a path is a chain of digests.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag or
role, or by class or id where a whole name says so ("site-header", "comment-list", "ad"; not "notice-period"). Names of
link lists ("related-posts") count only where most of the text is links. A header in an article stays if it holds a
heading. Character references are decoded, white space inside a block is one space, and blocks are joined by two line
ends in page order.

Defined cases: null or empty html gives an empty text; a null url votes with the host ''; tags left open end with their
parent or the page; a tag whose quotes never close ends at its first '>', one without any '>' is dropped; a comment that
never closes ends at its first '>'; a script or style that never closes runs to the end of the page, as HTML has it, other
raw elements are then dropped alone; repeated rows each count.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import with_small, written

#: Paths kept of a host and the share of its votes that one needs; None and 0 keep all.
PATHS, SUPPORT = 5, 0.05
#: What a container hands on to its parent of its score.
SHARE = 0.85

# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADED = frozenset("head base link meta title style script noscript template".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that another's opening tag ends: the kind of each, the kinds that an opening tag ends, and those it shuts off inside.
KIND = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option", "head": "head"}
ENDS = {"li": ("li",), "dt": ("dd",), "dd": ("dd",), "tr": ("tr", "td"), "td": ("td",), "th": ("td",), "option": ("option",)}
SHUTS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "tr": ("td",), "table": ("tr", "td"), "select": ("option",)} | {t: ("p",) for t in CONTAINERS}

LEFT_OUT = frozenset("head nav header footer aside form button select menu dialog svg object canvas audio video map search fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id: of what is left out, of reader comments, of link lists; and words that may stand beside them.
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login".split()
)
COMMENT = frozenset("comment comments commentlist respond replies disqus".split())
LISTS = frozenset("related recommended share sharing social skip pagination pager".split())
PLAIN = frozenset(
    "site page global main top bottom left right upper lower primary secondary box bar block area wrap wrapper container inner outer content list item "
    "items section row col column slot unit widget text link links small large fixed sticky inline bg js id".split()
)
BESIDE_COMMENT = frozenset("post entry article story user reader readers thread form body author reply".split())
BESIDE_LIST = frozenset("post posts article articles story stories content buttons icons media news".split())
FAVOURED = frozenset("article main content post entry story body text".split())

REMARK = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)")
ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+""")
ONE = re.compile(r"""[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; out: left out, hard: even if it holds the article; weak: only if its text is mostly links.

    scope has the innermost open element of each kind that another tag may end; holder, link, code, heads are what it is in:
    the container, a link, code, and the header inside an article.
    """

    __slots__ = ("tag", "leaf", "path", "parent", "scope", "holder", "link", "code", "article", "heads", "out", "hard", "weak", "holds", "score", "all", "linked")

    def __init__(self, tag: str, leaf: str, parent: Node | None):
        self.tag, self.leaf, self.parent = tag, leaf, parent
        self.out = self.hard = self.weak = self.holds = False
        self.score, self.all, self.linked = 0.0, 0, 0
        if parent is None:
            self.path, self.scope, self.holder, self.link, self.code, self.article, self.heads = leaf, {}, self, False, False, False, None
            return
        self.path = hashlib.blake2b(f"{parent.path}/{leaf}".encode(), digest_size=16).hexdigest() + " " + leaf
        self.holder = self if tag in CONTAINERS else parent.holder
        self.link = tag == "a" or (parent.link and tag not in BLOCK)
        self.code = parent.code or tag in ("pre", "code")
        self.article = parent.article or tag in ("article", "main")
        self.heads = self if tag == "header" and parent.article else parent.heads
        self.scope = parent.scope
        if tag in SHUTS or tag in KIND:
            self.scope = {k: n for k, n in parent.scope.items() if k not in SHUTS.get(tag, ())}
            if tag in KIND:
                self.scope[KIND[tag]] = self


def words_of(value: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())) - {""}


def said(names: str) -> tuple[bool, bool, bool]:
    """Whether a whole name among a class's or id's names says: left out, reader comments, a list of links."""
    plain = comment = linked = False
    for name in names.split():
        words = words_of(name)
        plain |= bool(words & WORDS) and words <= WORDS | PLAIN
        comment |= bool(words & COMMENT) and words <= COMMENT | WORDS | PLAIN | BESIDE_COMMENT
        linked |= bool(words & LISTS) and words <= LISTS | WORDS | PLAIN | BESIDE_LIST
    return plain, comment, linked


def opened(tag: str, attributes: str, parent: Node) -> Node:
    """The new element, with whether it is left out for itself; main and article only as comments."""
    a = {}
    if attributes and not attributes.isspace():
        a = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    node = Node(tag, tag + "." + ".".join(sorted(re.sub(r"\d+", "#", a["class"]).split())) if a.get("class") else tag, parent)
    node.out = tag in LEFT_OUT
    node.hard = node.out and node.heads is not node and tag != "form"  # some pages are one form
    if a and tag not in ("html", "body"):
        plain, comment, node.weak = said(f"{a.get('class', '')} {a.get('id', '')}") if not node.code else (False, False, False)
        hidden = a.get("role", "").lower() in ROLES or "hidden" in a or bool(HIDDEN.search(a.get("style", "")))
        node.hard |= comment or hidden
        node.out |= comment or hidden or (plain and tag not in ("main", "article"))
    return node


class Tags:
    """Reads tags; a quote opens a value only after '='. Places from which a tag never ends are kept, so each is read once."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()

    def end(self, start: int, at: int) -> tuple[int, int]:
        """End of the attributes and of the tag that starts there, with its name before at."""
        page = self.page
        if not self.dead:
            stop = ATTRIBUTES.match(page, at).end()
            if page[stop : stop + 1] == ">":
                return stop, stop + 1
        seen, stop = [], at
        while stop not in self.dead:
            seen.append(stop)
            m = ONE.match(page, stop)
            if m is None:
                if page[stop : stop + 1] == ">":
                    return stop, stop + 1
                break
            stop = m.end()
        self.dead.update(seen)
        first = page.find(">", start)
        return (first, first + 1) if first >= 0 else (len(page), len(page))


def tree(page: str) -> tuple[list[Node], list[tuple[int, Node, str, bool]]]:
    """All elements in page order, and the texts: (number of their block, element, text, in a link)."""
    root = now = Node("html", "html", None)
    nodes, texts, at, place, block = [root], [], 0, 0, 0
    tags, open_, endless = Tags(page), {}, set()
    comments = True  # whether another one may close

    def leave(node: Node) -> Node:
        """Closes node and what is open in it."""
        up = now
        while up is not node:
            open_[up.tag] -= 1
            up = up.parent
        open_[node.tag] -= 1
        return node.parent

    while at < len(page):
        start = page.find("<", place)
        name, inside, end, m = "", 0, len(page), None
        if start < 0:
            start = len(page)
        elif page.startswith("<!--", start):
            m = REMARK.match(page, start) if comments else None
            comments = m is not None
            end = m.end() if m else page.find(">", start) + 1 or len(page)
        elif m := TAG.match(page, start):
            name, end = (m[2] or "").lower(), m.end()
            if name:
                inside, end = tags.end(start, m.end())
        else:
            place = start + 1  # a lone '<' is text
            continue
        if start > at and now.tag not in RAW:
            text = html.unescape(page[at:start])
            if now.tag == "head" and not text.isspace():
                now = leave(now)
            texts.append((block, now, text, now.link))
        at = place = end
        if not name:
            continue
        if m[1]:
            if open_.get(name):
                up = now
                while up.tag != name:
                    up = up.parent
                now = leave(up)
            block += name in BLOCK
            continue
        if name == "html" or (name == "body" and open_.get("body")):
            continue
        for kind in (*(("p",) if name in BLOCK else ()), *(("head",) if name not in HEADED else ()), *ENDS.get(name, ())):
            if kind in now.scope:
                now = leave(now.scope[kind])
        block += name in BLOCK
        if name in VOID:
            if name in ("br", "hr", "img"):
                texts.append((block, now, " ", False))
            continue
        attributes = page[m.end() : inside]
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        node = opened(name, attributes.rstrip(" /"), now)
        nodes.append(node)
        if name in RAW:
            close = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, place)
            if close is None:
                endless.add(name)
            at = place = close.end() if close else len(page) if name in ("script", "style") else place
            continue
        if name in HEADINGS and node.heads is not None:
            node.heads.holds = True
        open_[name] = open_.get(name, 0) + 1
        now = node
    for node in nodes:  # what holds the article is no sidebar, whatever its class says
        if node.tag in ("main", "article") and not node.out:
            up = node.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    for _, node, text, link in texts:
        size = len(text.strip())
        node.all += size
        node.linked += size if link else 0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.all += node.all
            node.parent.linked += node.linked
    for node in nodes:
        linked = node.weak and 2 * node.linked > node.all and node.tag not in ("main", "article")
        node.out = (node.out and (node.hard or not node.holds)) or (linked and not node.holds) or (node.parent is not None and node.parent.out)
    return nodes, texts


def best_path(nodes: list[Node], texts: list[tuple[int, Node, str, bool]]) -> tuple[str, float]:
    """Path and score of the page's best container; '' if there is no text."""
    blocks: dict[tuple[int, int], list] = {}
    for block, node, text, link in texts:
        if not node.out and (text := text.strip()):
            held = blocks.setdefault((block, id(node.holder)), [node.holder, 0])
            held[1] += -len(text) if link else len(text)
    for node in nodes:
        node.score = 0.0
    for holder, size in blocks.values():
        holder.score += max(size, 0)
    best, most = None, 0.0
    for node in reversed(nodes):  # the inmost container gets all of it, outer ones less and less
        if node.parent is not None:
            node.parent.score += node.score * SHARE
        if node.score and (node.tag in CONTAINERS or node.parent is None):
            favour = 1.5 if node.tag in ("article", "main") else 1.2 if words_of(node.leaf) & FAVOURED else 1.0
            if node.score * favour >= most:
                best, most = node, node.score * favour
    return (best.path, most) if best else ("", 0.0)


def vote_of(page: str | None) -> tuple[str, float]:
    return best_path(*tree(page)) if page else ("", 0.0)


def main_text(page: str | None, paths: list[str]) -> str:
    """The text on the first of the paths that has any in this page, else that of its own best container."""
    if not page:
        return ""
    nodes, texts = tree(page)
    there = {n.path for n in nodes if not n.out}
    for path in [p for p in paths if p in there] + [None]:
        path = best_path(nodes, texts)[0] if path is None else path
        inside: dict[int, bool] = {}
        for node in nodes:
            inside[id(node)] = node.path == path or (node.parent is not None and inside[id(node.parent)])
        blocks: list[list] = []
        for block, node, text, _ in texts:
            if not node.out and inside[id(node)]:
                if blocks and blocks[-1][0] == block:
                    blocks[-1][1].append(text)
                else:
                    blocks.append([block, [text]])
        found = [x for x in (" ".join("".join(t).split()) for _, t in blocks) if x]
        if found:
            return "\n\n".join(found)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def winners(pages: DataFrame, paths: int | None = PATHS, support: float = SUPPORT) -> DataFrame:
    """(host, paths): of each host the paths with the most votes, best first; all of them with paths None and support 0."""

    @F.pandas_udf("path string, score double")
    def vote(page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vote_of(p) for p in page], columns=["path", "score"])

    votes = pages.select(host_of(pages["url"]).alias("host"), vote(pages["html"]).alias("v")).where("v.path != ''")
    counted = votes.groupBy("host", "v.path").agg(F.count(F.lit(1)).alias("n"), F.sum("v.score").alias("score"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")))
    ranked = ranked.withColumn("all", F.sum("n").over(Window.partitionBy("host")))
    kept = ranked.where(F.col("n") >= F.col("all") * support)
    kept = kept.where(F.col("rank") <= paths) if paths is not None else kept
    return kept.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, columns: list[str], paths: int | None = PATHS, support: float = SUPPORT) -> DataFrame:
    """columns of pages with text."""
    won = written(winners(pages, paths, support))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, best in batches:
            yield pd.Series([main_text(p, [] if x is None else list(x)) for p, x in zip(page, best)], dtype=object)

    rows = pages.select(F.struct(*(pages[c] for c in columns)).alias("_row"), pages["html"].alias("_html"), host_of(pages["url"]).alias("host"))
    joined = with_small(rows, won, ["host"], "left").select("_row", text_of("_html", "paths").alias("_text"))
    return joined.select(*(F.col("_row")[c].alias(c) for c in columns if c.lower() != "text"), F.col("_text").alias("text"))
