"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

_TAG = re.compile(r"[a-zA-Z][^\s/<>]{0,63}")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figcaption", "summary"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_BLOCK = _LEAF | set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figure footer form frameset head header hgroup hr html legend li main menu nav ol optgroup option search section select table tbody td tfoot th thead tr ul video audio canvas object".split())
#: What an opening tag closes, up to an element that bounds the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements whose text a page does not show as text.
_UNSEEN = {"button", "select", "datalist", "template", "svg", "math", "dialog", "head", "object", "canvas", "audio", "video"}
_APART = {"nav", "footer", "aside", "menu", "search"}
#: These may wrap a whole page; like names, they do not count against what holds the article.
_WRAPS = {"form", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "status"}
_NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars navbar nav navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification notifications popup popups modal overlay lightbox newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations widget widgets pagination pager copyright disclaimer skip".split())
_HEAD_NAMES = {"header", "masthead", "head"}
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？»”\"']")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


#: Weights of a block's path by what its elements' tags, roles and names say.
_LOW, _LOWEST, _HIGH = 0.02, 0.01, 3.0
#: Elements nested deeper are siblings of the deepest, as in browsers, so that no walk up is longer.
DEPTH = 256


class _Element:
    __slots__ = ("tag", "parent", "depth", "id", "path", "block", "shown", "apart", "named", "head", "heading", "main", "link", "list")

    def __init__(self, tag: str, attrs: str, parent: _Element | None, number: int, paths: dict[tuple[int, str], int]):
        self.tag, self.parent, self.id = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        p = parent or self
        root = parent is None
        self.shown = tag not in _UNSEEN and (root or p.shown)
        self.apart, self.named = tag in _APART, tag in _WRAPS
        self.head = tag == "header" or (not root and p.head)
        self.heading = tag in _HEADING or (not root and p.heading)
        self.main = tag in ("article", "main") or (not root and p.main)
        self.link = tag == "a" or (not root and p.link)
        self.list = number if tag in ("ul", "ol", "dl") else -1 if root else p.list
        self.block = self if tag in _BLOCK or root else p.block
        name = tag
        if attrs and not attrs.isspace():
            a = {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "" for m in _ATTR.finditer(attrs)}
            own = f"{a.get('class', '')} {a.get('id', '')}"
            if own != " ":
                name = f"{tag}.{own.strip()}"
            if tag not in ("html", "body"):
                words, role = {w.lower() for w in _WORDS.findall(own)}, a.get("role", "").lower()
                self.named |= bool(words & _NAMES)
                self.apart |= role in _ROLES
                self.head |= bool(words & _HEAD_NAMES) and tag not in ("article", "main")
                self.main |= role == "main" or a.get("itemprop", "").lower() == "articlebody"
                if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
                    self.shown = False
        self.path = 0 if root else p.path
        if tag in _BLOCK or tag == "a":
            self.path = paths.setdefault((self.path, tag if tag in _LEAF else name), len(paths) + 1)


class _Text:
    __slots__ = ("text", "links", "at", "path")

    def __init__(self, text: str, links: int, at: _Element):
        self.text, self.links, self.at, self.path = text, links, at, at.path


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page's text, opening and closing tags, in time linear in its length."""
    pos, n, last, plain = 0, len(page), page.rfind(">"), False
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0 or lt > last:
            yield "text", page[pos:], ""
            return
        if lt > pos:
            yield "text", page[pos:lt], ""
        c = page[lt + 1 : lt + 2]
        if c == "!" or c == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                pos = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "raw", page[lt + 9 : end if end >= 0 else n], ""
                pos = end + 3 if end >= 0 else n
            else:
                pos = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt + 1 + (c == "/"))
        if c == "/":
            pos = page.find(">", lt) + 1
            if m:
                yield "close", m[0].lower(), ""
            continue
        if not m:
            yield "text", "<", ""
            pos = lt + 1
            continue
        end = at = m.end()
        while True:
            stop = None if plain else _STOP.search(page, at)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            at = page.find(stop[0][-1], stop.end()) + 1 if stop else 0
            if not at:  # a quote that nothing closes: from here on quotes mean nothing
                plain, end = True, page.find(">", m.end())
                break
        tag, attrs = m[0].lower(), page[m.end() : end]
        pos = end + 1
        closed = attrs.endswith("/")
        if tag in _RAW:
            if not closed or tag in ("script", "style", "textarea", "title"):
                shut = _CLOSE[tag].search(page, pos)
                pos = shut.end() if shut else n
            continue
        yield ("empty" if closed else "open"), tag, attrs


def blocks(page: str) -> list[_Text]:
    """The page's blocks of text that is shown, in order, white space joined, character references decoded."""
    paths: dict[tuple[int, str], int] = {}
    root = at = _Element("#", "", None, 0, paths)
    out, buf, links, number = [], [], 0, 0

    def end_block() -> None:
        nonlocal links
        if buf:
            text = " ".join("".join(buf).split())
            if text and at.shown:
                out.append(_Text(text, min(links, len(text)), at))
            buf.clear()
        links = 0

    for kind, value, attrs in _tokens(page):
        if kind in ("text", "raw"):
            if at.shown:
                text = html.unescape(value) if kind == "text" and "&" in value else value
                buf.append(text)
                if at.link:
                    links += len(text.strip())
            continue
        tag = value
        if kind == "close":
            e = at
            while e.parent and e.tag != tag and not (e.tag in ("table", "td", "th", "article", "main") and tag not in _BLOCK):
                e = e.parent
            if e.parent and e.tag == tag:
                if at.block.depth >= e.depth or not (at.shown and e.parent.shown):
                    end_block()
                at = e.parent
            elif tag in _BLOCK:
                end_block()
            continue
        if tag in _BLOCK:
            end_block()
            e = at.block  # a block inside a paragraph ends it
            if e.tag == "p" or (e.tag in _HEADING and tag in _HEADING):
                at = e.parent
            if tag in _CLOSES:
                shut, bound = _CLOSES[tag]
                e, last = at, None
                while e.parent and e.tag not in bound:
                    if e.tag in shut:
                        last = e
                    e = e.parent
                if last:
                    at = last.parent
        if tag == "br":
            buf.append(" ")
        elif tag not in _VOID and not (kind == "empty" and tag in ("svg", "path", "use")):
            number += 1
            new = _Element(tag, attrs, at.parent if at.depth >= DEPTH else at, number, paths)
            if new.shown != at.shown:
                end_block()
            at = new
    end_block()
    return out


def _sums(elements: list[_Element], values: dict[int, float]) -> list[float]:
    """Of each element the sum over its own and all deeper ones' values; an element's number is over its parent's."""
    out = [0.0] * (elements[-1].id + 1)
    for k, v in values.items():
        out[k] = v
    for e in reversed(elements):
        if e.parent:
            out[e.parent.id] += out[e.id]
    return out


def _elements(all_blocks: list[_Text]) -> list[_Element]:
    """The elements that hold blocks, parents first."""
    found: dict[int, _Element] = {}
    for b in all_blocks:
        e = b.at
        while e and e.id not in found:
            found[e.id] = e
            e = e.parent
    return [found[k] for k in sorted(found)]


def _plain(b: _Text) -> int:
    """Characters outside of links."""
    return len(b.text) - b.links


def weights(all_blocks: list[_Text], elements: list[_Element]) -> list[float]:
    """What tags, roles and names say of each element, as a factor: little for menus, adverts and the like, much for
    articles.  A name, form or fieldset that holds over half of the page's text outside of links counts for nothing,
    unless the page's titles or articles are all outside of it: it wraps the page."""
    own: dict[int, float] = {}
    titles: dict[int, float] = {}
    for b in all_blocks:
        own[b.at.id] = own.get(b.at.id, 0) + _plain(b)
        titles[b.at.id] = titles.get(b.at.id, 0) + (b.at.main or b.at.block.tag == "h1")
    text, titled = _sums(elements, own), _sums(elements, titles)
    out = [1.0] * len(text)
    for e in elements:
        w = out[e.parent.id] if e.parent else 1.0
        if e.apart:
            w *= _LOWEST
        if e.named and not (2 * text[e.id] > text[0] and (titled[e.id] or not titled[0])):
            w *= _LOW
        if e.main and not (e.parent and e.parent.main):
            w *= _HIGH
        out[e.id] = w
    return out


def path_scores(all_blocks: list[_Text], factor: list[float]) -> list[float]:
    """For each block the score of its root-to-leaf tag path.

    A path's ratios are its mean text outside of links and mean punctuation over its nodes.  Laid out in page order they
    are smoothed over neighbours, fused by product, and a path has the greatest of its nodes' values, less where it has
    little text in all, times ``factor`` of the element."""
    sums: dict[int, list[int]] = {}
    for b in all_blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += _plain(b)
        s[1] += len(_PUNCT.findall(b.text)) if b.links < len(b.text) else 0
        s[2] += 1
    ratio = [(s[0] / s[2], s[1] / s[2]) for s in (sums[b.path] for b in all_blocks)]
    pad = [ratio[0], *ratio, ratio[-1]]
    fused: dict[int, float] = {}
    for i, b in enumerate(all_blocks):
        t, p = ((pad[i][k] + 2 * pad[i + 1][k] + pad[i + 2][k]) / 4 for k in (0, 1))
        fused[b.path] = max(fused.get(b.path, 0.0), t * (1 + p) * sums[b.path][0] / (sums[b.path][0] + 40))
    return [fused[b.path] * factor[b.at.id] * (_LOW if b.at.head and not b.at.heading else 1) for b in all_blocks]


def content(all_blocks: list[_Text], share: float = 0.25, hold: float = 0.7) -> list[_Text]:
    """The content blocks.

    Blocks of paths with ``share`` of the greatest score are content; 0 switches the ratios off.  The deepest element
    with ``hold`` of the content's text holds the article, up to the outermost article or main around it: its other
    blocks belong to it, but for what tags, roles or names inside of it set apart, and for lists of links.  A title just
    before it, in an element that adds little else, belongs to it too.
    """
    if not all_blocks:
        return []
    elements = _elements(all_blocks)
    factor = weights(all_blocks, elements)
    scores = path_scores(all_blocks, factor)
    top = max(scores)
    if not top:
        return []
    held: dict[int, float] = {}
    plain: dict[int, float] = {}
    heads: dict[int, float] = {}
    for b, s in zip(all_blocks, scores):
        k = b.at.id
        plain[k] = plain.get(k, 0) + _plain(b)
        heads[k] = heads.get(k, 0) + (b.at.block.tag == "h1")
        if s >= share * top:
            held[k] = held.get(k, 0) + len(b.text)
    held, plain, heads = (_sums(elements, x) for x in (held, plain, heads))
    holder = elements[0]
    for e in elements:
        if e.tag in _BLOCK and e.tag not in _LEAF and held[e.id] >= hold * held[0] and e.depth > holder.depth:
            holder = e
    while holder.tag in ("li", "ul", "ol", "blockquote", "td", "th", "tr", "tbody", "table", "dd", "dl", "figure", "header") and holder.parent.parent and holder.parent.tag not in ("body", "html"):
        holder = holder.parent
    while holder.parent and holder.parent.main:
        holder = holder.parent
    title = None
    if not heads[holder.id] and heads[0]:
        e = holder.parent
        while e and not heads[e.id]:
            e = e.parent
        if e.tag not in ("body", "html", "#") and plain[e.id] <= 1.3 * plain[holder.id]:
            holder = e
        else:
            title = e
    last = dict(zip((e.id for e in elements), (e.id for e in elements)))
    for e in reversed(elements):
        if e.parent:
            last[e.parent.id] = max(last[e.parent.id], last[e.id])
    lists: dict[int, list[int]] = {}
    own, before = [], None
    # where names set all of the content apart, they set none of it apart
    least = min(factor[holder.id], max(factor[b.at.id] for b, s in zip(all_blocks, scores) if s >= share * top)) / 2
    for b in all_blocks:
        if not holder.id <= b.at.id <= last[holder.id]:
            if title and b.at.id < holder.id and b.at.tag == "h1" and b.at.parent is title and factor[b.at.id] >= factor[title.id]:
                before = b
            continue
        if factor[b.at.id] < least or (b.at.head and not holder.head and not b.at.heading):
            continue
        own.append(b)
        if b.at.list >= holder.id:
            s = lists.setdefault(b.at.list, [0, 0, 0])
            s[0] += len(b.text)
            s[1] += b.links
            s[2] += 1
    menus = {k for k, (t, links, n) in lists.items() if n > 1 and links >= 0.8 * t}
    return [before] * (before is not None) + [b for b in own if b.at.list not in menus]


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line; nothing for a null or empty page."""
    return "\n".join(b.text for b in content(blocks(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html): the main text of the whole html.
    A page without an article, or without text, has an empty one; nulls in the other columns are kept; repeated rows stay."""
    return C.map_arrow(C.pick(pages, "page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long")
