"""Main text of web pages, with templates found per site.

A page is cut into elements by one pass over its tags. Every element subtree that holds
text is hashed; Spark counts the hashes per site section (a host, or a folder of it), and
subtrees that recur across many pages of a section are its template and are deleted. Elements that are boilerplate by their
tag, role or class go in any case. Pages count by what they hold besides the subtree, so
copies of one page are one. Inside an article recurrence can also be quotation or a copied
article: there a subtree must be in nearly all different articles of the host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

# A quote only opens a value after an equals sign; there it may hold ">".
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = _RAW | {
    "head", "nav", "footer", "aside", "form", "button", "select", "option", "noscript", "template", "svg", "canvas", "object",
    "dialog", "menu", "datalist", "audio", "video", "map", "fieldset",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
#: A new element of the first kind ends an open one of the second.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Names of boilerplate, and of parts of it. A class or id is boilerplate if all its words are
#: among these and at least one is of the first kind: ``ad-slot``, ``site-footer``; but not
#: ``has-sidebar``, ``no-ad``, ``market-share``.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "sidebar", "navbar", "nav",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social", "related", "recommended", "widget",
    "widgets", "toolbar", "footer", "masthead", "skip", "login", "signup",
}
_PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col", "column", "container", "content",
    "dialog", "fixed", "form", "global", "header", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "media",
    "module", "outer", "page", "panel", "policy", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot",
    "sticky", "stories", "articles", "text", "to", "tools", "top", "unit", "wrap", "wrapper", "of", "the", "your", "us", "our",
}
#: Readers' comments go even if each is marked as an article.
_COMMENTS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
_TOKEN_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Element:
    __slots__ = ("tag", "drop", "named", "article", "inside", "first", "parts", "holds")

    def __init__(self, tag: str, drop: bool, named: bool, article: bool, inside: bool, first: int):
        self.tag, self.drop, self.named, self.article, self.inside, self.first = tag, drop, named, article, inside, first
        self.parts: list[str] = []
        self.holds = False


def _named(value: str, names: set[str]) -> bool:
    """Whether one of the names in a class or id is made up of ``names`` and parts only."""
    for token in value.split():
        words = {w.lower() for w in _TOKEN_WORD.findall(token)}
        if words and not names.isdisjoint(words) and words <= names | _PARTS:
            return True
    return False


def _judged(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its tag, role or state, and whether by its name."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True, False
    named = False
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), max(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            if _named(value, _COMMENTS):
                return True, False
            named |= tag != "article" and _named(value, _NAMES)
    return False, named


def _is_article(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    return "articleBody" in attributes or "role" in attributes and re.search(r"""role\s*=\s*["']?(main|article)\b""", attributes) is not None


class Page:
    """Blocks of a page, and the element subtrees that contain them.

    ``blocks``: ``(text, in_article, kept)`` in page order, ``kept`` unless the block is
    boilerplate by tag, role or name. ``spans``: ``(hash, first, end)``, the range of blocks
    in each subtree outside articles, ``inner`` inside; no hash is in both. ``subtrees``: the
    hashes.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.spans: list[tuple[int, int, int]] = []
        self.inner: list[tuple[int, int, int]] = []
        self._stack = [_Element("#", False, False, False, False, 0)]
        self._text: list[str] = []
        self._nominated: list[tuple[int, int]] = []
        at = 0
        while match := _TAG.search(source, at):
            if match.start() > at:
                self._text.append(source[at : match.start()])
            at = match.end()
            closing, tag, attributes = match[1], match[2], match[3]
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in _RAW and not attributes.endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(source, at)
                    at = end.start() if end else len(source)
        self._text.append(source[at:])
        while len(self._stack) > 1:
            self._close()
        self._flush()
        self._drop_nominated()
        self.subtrees = {mark for mark, _, _ in self.spans + self.inner}

    def _drop_nominated(self) -> None:
        """An element that is boilerplate by its name goes, unless it holds an article or half
        of the page's text: then the name tells of the page, not of the element."""
        upto = [0]
        for text, _, kept in self.blocks:
            upto.append(upto[-1] + len(text) * kept)
        gone = {i for first, end in self._nominated if 2 * (upto[end] - upto[first]) < upto[-1] for i in range(first, end)}
        if gone:
            self.blocks = [(text, inside, kept and i not in gone) for i, (text, inside, kept) in enumerate(self.blocks)]

    def rests(self) -> list[tuple[int | None, int, bool]]:
        """``(hash, rest, inside)`` of each subtree: a hash of the kept texts without it, inside
        an article of those of the articles; and, under a null hash, of all kept texts."""
        sums = {False: [0], True: [0]}
        for text, in_article, kept in self.blocks:
            mark = xxhash.xxh64_intdigest(text.encode()) if kept else 0
            sums[False].append(sums[False][-1] + mark)
            sums[True].append(sums[True][-1] + mark * in_article)
        signed = lambda n: (n & (1 << 64) - 1) - (1 << 63)
        out: list[tuple[int | None, int, bool]] = [(None, signed(sums[False][-1]), False)]
        for inside, spans in ((False, self.spans), (True, self.inner)):
            upto, own = sums[inside], dict.fromkeys((mark for mark, _, _ in spans), 0)
            for mark, first, end in spans:
                own[mark] += upto[end] - upto[first]
            out += ((mark, signed(upto[-1] - n), inside) for mark, n in own.items())
        return out

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(entities.unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            top = self._stack[-1]
            self.blocks.append((text, top.inside, not top.drop))
            top.parts.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            if tag == "br":
                self._text.append(" ")
            elif tag not in _VOID and any(_judged(tag, attributes, True)):
                self._push(tag, attributes)
            return
        self._flush()
        if tag in _VOID:
            return
        self._implied(_ENDS.get(tag, frozenset()))
        if tag not in ("html", "body", "tbody"):
            self._implied({"p"})
        self._push(tag, attributes)

    def _implied(self, ended: set[str] | frozenset[str]) -> None:
        """Closes the nearest open element of ``ended``, unless a block stands between."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag in ended:
                while len(self._stack) > depth:
                    self._close()
                return
            if tag not in _INLINE and tag != "p":
                return

    def _push(self, tag: str, attributes: str) -> None:
        self._flush()
        top = self._stack[-1]
        article = not top.drop and _is_article(tag, attributes)
        drop, named = _judged(tag, attributes, top.inside)
        drop |= top.drop
        self._stack.append(_Element(tag, drop, named, article, not drop and (top.inside or article), len(self.blocks)))

    def _end(self, tag: str) -> None:
        if tag in _INLINE:
            if self._stack[-1].tag != tag:
                return
        else:
            self._flush()
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag == tag:
                while len(self._stack) > depth:
                    self._close()
                return
            if self._stack[depth].tag in ("article", "main", "body") and tag not in ("html", "body"):
                return

    def _close(self) -> None:
        self._flush()
        element = self._stack.pop()
        parent = self._stack[-1]
        parent.holds |= element.holds or element.article
        if element.named and not element.drop and not element.holds:
            self._nominated.append((element.first, len(self.blocks)))
        if not element.parts:
            return
        if element.holds or element.tag in ("html", "body", "head", "title"):
            parent.parts.append("")
            return
        kind = "article " if element.inside else ""
        mark = xxhash.xxh64_intdigest(f"{kind}<{element.tag}>{'|'.join(element.parts)}".encode()) - (1 << 63)
        # A hash of hashes: each text is hashed once. What goes anyway is no part of an article.
        parent.parts.append(str(mark) if element.inside == parent.inside else "")
        (self.inner if element.inside else self.spans).append((mark, element.first, len(self.blocks)))


def main_text(source: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The kept blocks outside ``template``, joined by blank lines.

    Where the page marks an article, its blocks are the text, also if none is left; else all
    kept blocks are.
    """
    return _chosen(Page(source), template)


def _chosen(page: Page, template: frozenset[int] | set[int]) -> str:
    deleted: set[int] = set()
    for mark, first, end in page.spans + page.inner:
        if mark in template:
            deleted.update(range(first, end))
    blocks = [(i, b) for i, b in enumerate(page.blocks) if b[2]]
    article = [(i, b) for i, b in blocks if b[1]]
    return "\n\n".join(b[0] for i, b in article or blocks if i not in deleted)


def host_of(url: str) -> Column:
    """The lower-case host of a URL, without user and port; empty where there is none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def sections_of(url: str) -> Column:
    """The host of a URL and each folder on its path, from the host down; the page's own name,
    with or without a slash at its end, is no folder."""
    path = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    folder = F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]+/*$", 1)
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host_of(url), F.array_join(F.slice(parts, 1, k), "/")))


def templates(
    pages: DataFrame, min_pages: int, min_share: float, article_share: float = 0.8, url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``folder, template``: for each last section of a page the hashes of subtrees that are
    template of it or of a section above.

    That is a subtree on at least ``min_pages`` of a section's pages and ``min_share`` of them;
    inside articles ``article_share`` of the host's. So a menu of one part of a host is found
    however large the host. Pages that are equal besides the subtree count once. A share bounds
    the list by a page's subtrees over the share, for each section above a page.
    """
    rows = pages.select(sections_of(url_col).alias("sections"), text_or_empty(html_col).alias("html"))
    kind = pa.list_(pa.struct([("mark", pa.int64()), ("rest", pa.int64()), ("inside", pa.bool_())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("mark", "rest", "inside"), r)) for r in Page(h).rests()] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sections"), pa.array(found, kind)], ["sections", "found"])

    found = rows.mapInArrow(each, "sections array<string>, found array<struct<mark:long,rest:long,inside:boolean>>")
    # Each page also counts for its sections, under the null mark: one pass gives both counts.
    found = found.select("sections", F.explode("found").alias("s")).select("sections", "s.*")
    own = F.when(F.col("inside"), F.slice("sections", 1, 1)).otherwise(F.col("sections"))
    counted = found.select(F.explode(own).alias("section"), "mark", "rest", "inside")
    counted = counted.groupBy("section", "mark", "inside").agg(F.count_distinct("rest").alias("n"))
    counted = staged(counted.where(F.col("n") >= min_pages), "subtrees")
    sizes = counted.where("mark is null").select("section", F.col("n").alias("pages"))
    share = F.when(F.col("inside"), article_share).otherwise(min_share)
    common = counted.where("mark is not null").join(sizes, "section").where(F.col("n") >= F.col("pages") * share)
    folders = pages.select(sections_of(url_col).alias("sections")).distinct()
    folders = folders.select(F.element_at("sections", -1).alias("folder"), F.explode("sections").alias("section"))
    return folders.join(common, "section").groupBy("folder").agg(F.collect_set("mark").alias("template"))


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 5,
    min_share: float = 0.2,
    article_share: float = 0.8,
) -> DataFrame:
    """``page_id, url, text, n_template`` for every row of ``pages``; ``text`` is empty if none.

    ``n_template`` counts the page's subtrees that are template of its sections. A null html is
    empty; pages without a host share one. Whole pages are read, and each row is extracted
    by itself, so repeated rows get repeated results. Damaged markup is read as far as it
    goes: open elements end with the page. The sections' templates are joined as a table
    whose written size lets the planner choose: sent to all executors if small, else a
    join that splits hot sections. An empty table yields an empty result.
    """
    known = staged(templates(pages, min_pages, min_share, article_share, url_col, html_col), "templates")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.element_at(sections_of(url_col), -1).alias("folder"),
        text_or_empty(html_col).alias("html"),
    ).join(known, "folder", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for source, template in zip(batch.column("html"), batch.column("template")):
                template, page = set(template.as_py() or ()), Page(source.as_py())
                texts.append(_chosen(page, template))
                found.append(len(page.subtrees & template))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(found, pa.int64())],
                ["page_id", "url", "text", "n_template"],
            )

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_template", "long")
    return rows.mapInArrow(each, schema)
