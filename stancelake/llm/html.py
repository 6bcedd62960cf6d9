"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

A page is parsed to a tree. Menus, page headers and footers, sidebars, notices, adverts, forms, scripts and
reader comments are cut out by element and by words of class, id and role. A form and a word of class or id say nothing of a
node that holds the page's article or most of its text, as "has-sidebar" does: see _cut_by_words. For every other node the
characters per tag are computed and adjusted by the share of link characters and link tags; the sums of
the children's densities are compared over the tree. The node with the largest sum marks the article; the
least density on its path to the body is the threshold that any further part of the page must reach to
belong to it. Whether a node is an <article> or a <div> makes no difference to what is selected.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm import text

# Elements by role, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CUT = frozenset("script style noscript template head nav footer aside button select textarea input iframe svg canvas object dialog menu title option datalist audio video math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
LISTS = frozenset("ul ol dl table div section".split())
CLOSES_P = BLOCKS - {"body", "html", "tr", "tbody", "tfoot", "thead", "caption"}
FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices notification sidebar side rail menu "
    "menus nav navbar navigation topnav breadcrumb breadcrumbs comment comments commentlist disqus discussion replies reply respond footer share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager login search searchform skip alert disclaimer paywall".split()
)
HEADER = frozenset("header masthead topbar".split())
#: Words of FURNITURE that stand on no wrapper of a whole page, if they are all of a class or id.
NOTICES = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup popup modal overlay alert disclaimer paywall".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Tree:
    """Nodes in document order; texts are (node, block number, text)."""

    def __init__(self) -> None:
        self.name, self.parent, self.cut, self.end = ["#root"], [-1], [False], [0]
        self.words: dict[int, bool] = {}  # nodes that a word of class or id marks; whether it is a notice
        self.texts: list[tuple[int, int, str]] = []


def _cut_out(name: str, attributes: str, within_article: bool) -> tuple[bool, bool, bool]:
    """Whether a node is cut whatever it holds, whether a word of class or id marks it, and whether that is a notice.

    A form is marked as by a word: some pages stand in one whole.
    """
    if name in CUT or name == "header" and not within_article:
        return True, False, False
    marked, notice = name == "form", False
    if not attributes or name in ("html", "body", "main"):
        return False, marked, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False, False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, False
        elif key == "role":
            if value.lower() in ROLES:
                return True, False, False
        else:
            words = {w.lower() for w in _WORD.findall(value)}
            if words & FURNITURE or words & HEADER and not within_article:
                marked = True
                notice |= any((of := {w.lower() for w in _WORD.findall(x)}) & NOTICES and of <= FURNITURE for x in value.split())
    return False, marked, notice


def _parse(page: str) -> _Tree:
    tree = _Tree()
    stack, block, at, articles = [0], 0, 0, 0
    name_of, parent, cut, end, texts = tree.name, tree.parent, tree.cut, tree.end, tree.texts

    open_at: dict[str, list[int]] = {}  # depths of the open elements of each name, and under "" those of all blocks

    def pop_to(depth: int) -> None:
        nonlocal block, articles
        while len(stack) > depth:
            node = stack.pop()
            end[node] = len(name_of)
            if node:
                open_at[name_of[node]].pop()
            if name_of[node] in BLOCKS:
                open_at[""].pop()
                block += 1
            articles -= name_of[node] in ("article", "main")

    def innermost(names: tuple[str, ...]) -> int:
        return max((open_at[name][-1] for name in names if open_at.get(name)), default=0)

    def opened(names: tuple[str, ...], stops: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these names, above any of the stops; 0 for none."""
        depth = innermost(names)
        return depth if depth > innermost(tuple(x for x in stops if x not in names)) else 0

    last = page.rfind(">")
    more = lambda: _TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
    token = more()
    while token:
        if token.start() > at:
            texts.append((stack[-1], block, page[at : token.start()]))
        at = token.end()
        slash, name, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if name:
            name = name.lower()
            if slash:
                inline = name not in BLOCKS
                depth = opened((name,), ("",) if inline else ("table",) if name not in ("table", "body", "html", "article", "main", "section", "div") else ())
                if depth:
                    pop_to(depth)
            else:
                if name in CLOSES_P and (depth := opened(("p",), ("table", "div", "section", "article", "li", "blockquote", "td", "th", "main", "aside"))):
                    pop_to(depth)
                if name == "li" and (depth := opened(("li",), ("ul", "ol", "menu"))) or name in ("dt", "dd") and (depth := opened(("dt", "dd"), ("dl",))) or name == "tr" and (depth := opened(("tr",), ("table",))) or name in ("td", "th") and (depth := opened(("td", "th"), ("tr", "table"))) or name == "option" and (depth := opened(("option",), ("select",))):
                    pop_to(depth)
                if name in ("br", "td", "th"):
                    texts.append((stack[-1], block, " "))
                if name in BLOCKS:
                    block += 1
                if name not in VOID:
                    node = len(name_of)
                    name_of.append(name)
                    parent.append(stack[-1])
                    gone, marked, notice = _cut_out(name, attributes, articles > 0)
                    cut.append(cut[stack[-1]] or gone)
                    if marked:
                        tree.words[node] = notice
                    end.append(0)
                    articles += name in ("article", "main")
                    open_at.setdefault(name, []).append(len(stack))
                    if name in BLOCKS:
                        open_at.setdefault("", []).append(len(stack))
                    stack.append(node)
                    if attributes.endswith("/") and name not in BLOCKS:
                        pop_to(len(stack) - 1)
                    elif name in RAW:
                        close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                        at = close.end() if close else len(page)
                        pop_to(len(stack) - 1)
        token = more()
    if at < len(page):
        texts.append((stack[-1], block, page[at:]))
    pop_to(0)
    if tree.words:
        _cut_by_words(tree)
    return tree


def _cut_by_words(tree: _Tree) -> None:
    """Cuts the nodes that words of class or id mark, but for those that hold what the page is for.

    These are the largest article of the page; a node around it, if no article stands outside all marked nodes and
    under four times its text does; and a node of most of the page's text, if no article and less than a quarter of
    its text stand outside, unless its words are of a notice. Text of links does not count. Marked nodes inside
    a spared one are looked at in the same way.
    """
    n, cut, parent, marked = len(tree.name), tree.cut, tree.parent, tree.words
    linked, within, chars, article = [False] * n, [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        up = parent[i]
        linked[i] = linked[up] or tree.name[i] == "a"
        landmark = tree.name[i] in ("article", "main")
        within[i] = within[up] or landmark
        article[i] = int(landmark and not within[up] and not cut[i])
    for node, _, raw in tree.texts:
        if not cut[node] and not linked[node]:
            chars[node] += len(" ".join(raw.split()))
    own = list(chars)
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
    largest = max((i for i in range(n) if article[i]), key=lambda i: (chars[i], -i), default=0)
    if not chars[largest]:
        largest = 0
    # text and articles of a node outside all marked nodes in it
    free, articles = own, article
    for i in range(n - 1, 0, -1):
        if i not in marked or i == largest:
            free[parent[i]] += free[i]
            articles[parent[i]] += articles[i]
    rest, rest_articles, total = free[0], articles[0], chars[0]
    for i in range(1, n):
        if cut[i] or cut[parent[i]]:
            cut[i] = True
        elif i in marked and i != largest:
            around = largest and i < largest < tree.end[i] and not rest_articles and rest < 4 * chars[i]
            most = 2 * chars[i] > total and not rest_articles and 4 * rest < chars[i] and not marked[i]
            if around or most:
                rest += free[i]
                rest_articles += articles[i]
            else:
                cut[i] = True


def _densities(tree: _Tree) -> tuple[list[float], list[float], int, set[int]]:
    """Composite density and sum of the children's densities of every node, the number of the body, and lists of links only."""
    n = len(tree.name)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.name[i] == "a"
    for node, _, raw in tree.texts:
        if not tree.cut[node]:
            size = len(" ".join(entities.unescape(raw).split()))
            chars[node] += size
            link_chars[node] += size * linked[node]
    for i in range(n - 1, 0, -1):
        if not tree.cut[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (tree.name[i] == "a")
    body = next((i for i in range(n) if tree.name[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t = chars[i], max(1, tags[i])
        if c and not tree.cut[i]:
            lc, lt = max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base)) if c > 1 else 0.01
        if i:
            sums[tree.parent[i]] += density[i]
    menus = {i for i in range(n) if tree.name[i] in LISTS and link_tags[i] >= 3 and link_chars[i] == chars[i]}
    return density, sums, body, menus


def _sources(tree: _Tree, best: int, body: int, menus: set[int]) -> set[int]:
    """Lists of links in the article, not in a page that is all one part, behind half of its other text or more."""
    if not menus or best == body or tree.name[best] == "#root":
        return set()
    linked = [False] * len(tree.name)
    for i in range(1, len(linked)):
        linked[i] = linked[tree.parent[i]] or tree.name[i] == "a"
    never, before, out = math.inf, 0, set()
    at = [never] * len(tree.name)  # words of the article before the first text in a node
    for node, _, raw in tree.texts:
        if best <= node < tree.end[best]:
            at[node] = min(at[node], before)
            before += 0 if linked[node] or tree.cut[node] else len(raw.split())
    for i in range(tree.end[best] - 1, best, -1):
        at[tree.parent[i]] = min(at[tree.parent[i]], at[i])
    for i in menus:
        if best < i < tree.end[best] and before and before <= 2 * at[i] < never:
            out.add(i)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the article joined by newlines, white space inside a block as one space; empty for none.

    Null and empty pages, and pages of furniture only, give the empty string. A page without tags is one block.
    Within the selected parts, lists that have no text but that of three links or more are menus and left out, unless
    they stand in the article behind most of its text, where they are its sources.
    """
    if not page:
        return ""
    tree = _parse(page)
    density, sums, body, menus = _densities(tree)
    n = len(tree.name)
    inside = [i for i in range(body, max(tree.end[body], body + 1)) if not tree.cut[i]]
    best = max(inside, key=lambda i: (sums[i] or density[i], -i), default=0)
    path, at = [], best
    while at >= body and at != -1:
        path.append(at)
        at = tree.parent[at]
    threshold = min((density[i] for i in path), default=0.0)
    chosen = [False] * n
    # parts beside the path that are as dense as the thinnest node of the path; their own furniture is cut already
    roots = [best]
    if best != body and tree.name[best] != "#root":
        on_path = set(path)
        roots += [i for i in inside if i not in on_path and tree.parent[i] in on_path and tree.parent[i] != best and density[i] >= threshold > 0]
    for root in roots:
        for i in range(root, max(tree.end[root], root + 1)):
            chosen[i] = True
    for i in menus.difference(path) - _sources(tree, best, body, menus):
        chosen[i : max(tree.end[i], i + 1)] = [False] * (max(tree.end[i], i + 1) - i)
    for i in path[1:]:  # text that stands directly in the path's nodes, not in a part that was left out
        if tree.name[i] not in ("#root", "html"):
            chosen[i] = chosen[i] or density[best] <= density[i]
    blocks: dict[int, list[str]] = {}
    for node, block, raw in tree.texts:
        if chosen[node] and not tree.cut[node]:
            blocks.setdefault(block, []).append(raw)
    shown = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in shown if x)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` and the main text of each; no shuffle.

    Null pages count as empty and give the empty string; repeated rows are alike, an empty table stays empty. Where
    `pages` has a column `out` already it stays, and the new one gets underscores behind its name.
    """

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in column], dtype=object)

    return pages.select("*", texts(F.col(html_col)).alias(text.free_name(pages.columns, out)))
