"""Main text of web pages, with site templates removed.

Pages become element trees in tasks. The hash of each block element's subtree
(tags, classes and text) is counted per host in Spark, a page content once, so
copies of a page count as one. Subtrees that recur across many pages of the host
are templates. They are deleted, as are elements whose kind or name says that they
are no main text: whole names (``sidebar``), and for containers also names whose
head is such a word (``comment-list``, but not ``no-sidebar``, ``comments-open`` or
``related-work``). Flow text (paragraphs, headings, lists, tables, quotes) inside an
``article`` or ``main`` element is the author's and is no template, even when many
pages quote the same passage, and whatever its id. Elsewhere, a recurring heading
goes with what it heads, and stays before text of the page's own.

Pages are read in time in proportion to their length, whatever is wrong in them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A subtree is a template of its host when so many pages, and this share of them, have it.
MIN_PAGES, MIN_SHARE = 5, 0.02
#: Up to so many templates are broadcast, as sorted arrays of 8 bytes each; beyond, they are joined page by page.
BROADCAST_TEMPLATES = 1_000_000

#: Element kinds of HTML. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr center address".split())
SKIPPED = frozenset("head nav header footer aside menu form button select option input dialog audio video canvas object applet map template svg math".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open element of the same set.
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: Those and other block starts end an open paragraph.
BLOCK_STARTS = frozenset("article section div main header footer nav aside form address ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6 hr fieldset figure p".split())
#: Flow elements that often hold links; in an article their class or role counts, their id does not.
LISTS = frozenset("ul ol dl table".split())
#: Whole names in class, id or role of what is no main text.
SKIPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header footer masthead comment comments disqus reply replies widget skip complementary contentinfo search".split())
SKIPPED_WHOLE = SKIPPED_NAMES | frozenset("ad-banner ad-container ad-slot cookie-banner cookie-consent cookie-notice comment-list comment-respond comments-area main-menu main-nav nav-bar nav-menu site-footer site-header site-nav side-bar share-buttons sharing-buttons social-links social-share related-articles related-posts newsletter-signup search-form skip-link".split())
#: Containers, in which a name of several parts counts by its head: the last part but for those of ``GENERIC``.
CONTAINERS = frozenset("div section aside ul ol article".split())
HEADS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscription breadcrumb breadcrumbs pagination share sharing sidebar comment comments disqus reply replies".split())
GENERIC = frozenset("area author bar block body box button buttons container content form inner item items link links list main meta outer respond section slot text thread unit wrap wrapper".split())
#: Parts by which a name speaks of what is elsewhere or not there.
UNLESS = frozenset("has no non not with without".split())
#: What an ``article`` is called that is a reader's, and inline text that is an advert.
COMMENTS, ADVERTS = frozenset("comment comments reply replies".split()), frozenset("ad ads advert adverts advertisement sponsored promo".split())
ROOTS = ("article", "main")
#: Never skipped by name.
UNNAMED = frozenset(("html", "body", *ROOTS))
#: Bits of ``Node.named``: a whole id; a whole class or role; a word in any of them, which only tells where articles are
#: sought first; a class of ``HEADS``; the head of a name of several parts; names of comments and of adverts.
BY_ID, BY_CLASS, BY_WORD, STRONG, BY_HEAD, COMMENT, ADVERT = (1 << i for i in range(7))

#: A comment, a declaration, or a tag with its attributes, quoted values being whole. Never backtracks; an open tag has no ">" at its end.
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>?)""", re.S)
#: The same where a quote has no end: a tag goes up to the next ">".
UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A slash that ends an unquoted value.
IN_VALUE = re.compile(r"""=\s*[^\s"'>=]*/\Z""")


class Node:
    __slots__ = ("tag", "names", "children", "digest", "template", "skip", "named")

    def __init__(self, tag: str, names: str = "", skip: bool = False, named: int = 0) -> None:
        self.tag, self.names, self.skip, self.named = tag, names, skip, named
        self.children: list[Node | str] = []
        self.digest = 0
        self.template = False


def _head(name: str) -> tuple[str, bool]:
    """(the part that a name of several parts is about, or an empty string; whether it speaks of what is not there)."""
    parts = [w.lower() for w in PARTS.findall(name)]
    if not UNLESS.isdisjoint(parts):
        return "", True
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return parts[-1] if parts else "", False


def _named(value: str, is_id: bool) -> int:
    """Bits for the names in a class, id or role."""
    bits = 0
    for name in value.split():
        low = name.lower()
        head, absent = _head(name)
        if low in SKIPPED_WHOLE:
            bits |= BY_ID if is_id else BY_CLASS
            bits |= STRONG if low in HEADS and not is_id else 0
            bits |= ADVERT if low in ADVERTS and not is_id else 0
        if head in HEADS:
            bits |= BY_HEAD
        if head in COMMENTS:
            bits |= COMMENT
        if not absent and any(w.lower() in SKIPPED_NAMES for w in PARTS.findall(name)):
            bits |= BY_WORD
    return bits


def _names(attributes: str) -> tuple[str, bool, int]:
    """(class and id, whether the element is hidden, bits for names of what is no main text)."""
    if not attributes.strip():
        return "", False, 0
    said, skip, named = [], False, 0
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            skip = True
        elif name == "aria-hidden":
            skip |= value.lower() == "true"
        else:
            said.append(value)
            named |= _named(value, name == "id")
    return " ".join(said), skip, named


def _skipped(node: Node, marked: bool) -> bool:
    """Whether an element is no main text; ``marked``: it is inside an ``article`` or ``main``."""
    whole = node.named & (BY_ID | BY_CLASS)
    if node.skip or not node.named:
        return node.skip
    if node.tag in UNNAMED:
        return node.tag == "article" and bool(node.named & COMMENT)
    if node.tag in LISTS:
        return bool(whole & BY_CLASS) or (not marked and bool(whole)) or (node.tag in CONTAINERS and bool(node.named & BY_HEAD))
    if node.tag in INLINE:
        return bool(node.named & ADVERT) or (not marked and bool(whole & BY_CLASS))
    if node.tag in FLOW:
        return bool(node.named & STRONG) or (not marked and bool(whole & BY_CLASS))
    return bool(whole) or (node.tag in CONTAINERS and bool(node.named & BY_HEAD))


class _Open:
    """The open elements, with the places of each tag, so that closing one need not look through all."""

    def __init__(self, root: Node) -> None:
        self.stack, self.of = [root], {}
        self.roots: list[int] = []
        self.bounds: list[int] = []  # what a new paragraph or list item does not close

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.of.setdefault(node.tag, []).append(at)
        if node.tag in ROOTS:
            self.roots.append(at)
        if (node.tag not in INLINE and node.tag not in FLOW) or node.tag in LISTS:
            self.bounds.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > at:
            self.of[self.stack.pop().tag].pop()
        for places in (self.roots, self.bounds):
            while places and places[-1] >= at:
                places.pop()

    def end(self, tag: str) -> None:
        places = self.of.get(tag)
        if places and not (tag in INLINE and self.roots and self.roots[-1] > places[-1]):
            self.cut(places[-1])

    def start(self, tag: str) -> None:
        """Closes what a start tag ends."""
        ends = CLOSES.get(tag, frozenset()) | (frozenset({"p"}) if tag in BLOCK_STARTS else frozenset())
        last = max((self.of[t][-1] for t in ends if self.of.get(t)), default=0)
        if last and last >= (self.bounds[-1] if self.bounds else 0):
            self.cut(last)


def _tokens(text: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text, the tag behind it); comments and declarations go. The caller may send how far to go on from."""
    mark, at = MARK, 0
    while True:
        m = mark.search(text, at)
        if m is not None and m[2] and not m[4]:  # no ">" is left outside of quotes, so that they count no more
            mark = UNQUOTED
            m = mark.search(text, m.start())
            if not m[4]:
                m = None
        if m is None:
            yield text[at:], None
            return
        before, at = text[at : m.start()], m.end()
        on = yield before, m if m[2] else None
        at = on or at


def parse(text: str) -> Node:
    """The element tree of a page; what is not well formed is closed as browsers do, roughly."""
    root = Node("#root")
    held, tokens, on = _Open(root), _tokens(text), None
    raw_ends: dict[str, re.Pattern] = {}
    while True:
        try:
            before, m = tokens.send(on)
        except StopIteration:
            return root
        on = None
        if before:
            held.stack[-1].children.append(before)
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            held.end(tag)
            continue
        if tag in CLOSES or tag in BLOCK_STARTS:
            held.start(tag)
        names, skip, named = _names(m[3])
        node = Node(tag, names, skip or tag in SKIPPED, named)
        held.stack[-1].children.append(node)
        if tag in RAW:
            end = raw_ends.setdefault(tag, re.compile(rf"</{tag}[\s/>]", re.I)).search(text, m.end())
            close = text.find(">", end.start()) if end else -1
            on = close + 1 if close >= 0 else len(text)
        elif tag not in VOID and not (m[3].endswith("/") and not IN_VALUE.search(m[3])):
            held.push(node)


def digest(node: Node) -> int:
    """Sets and returns the hash of a subtree: tag, names and children in order.

    Trees are walked with stacks of their own, as deep pages exceed Python's.
    """
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):  # children before their parents
        h = xxhash.xxh3_64(f"{n.tag} {n.names}\x00".encode("utf-8", "surrogatepass"))
        for c in n.children:
            h.update(" ".join(c.split()).encode("utf-8", "surrogatepass") + b"\x01" if isinstance(c, str) else c.digest.to_bytes(8, "little"))
        n.digest = h.intdigest()
    return node.digest


def _roots(tree: Node, avoid: int, inside: bool = False) -> list[Node]:
    """Outermost ``article`` and ``main`` elements, in page order, outside elements that are
    skipped or named by a bit of ``avoid``; ``inside``: also those in skipped ones, but for readers' and hidden ones."""
    found, stack = [], tree.children[::-1]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            continue
        comment = bool(c.named & COMMENT)
        if c.tag in ROOTS and not c.skip and not (c.tag == "article" and comment):
            found.append(c)
        elif c.tag in UNNAMED or (not comment and c.tag in SKIPPED if inside else not _skipped(c, False)):
            if not c.named & avoid or c.tag in UNNAMED:
                stack += c.children[::-1]
        elif inside and not comment and not c.skip:
            stack += c.children[::-1]
    return found


def content(tree: Node) -> tuple[list[Node], bool]:
    """Where the main text is sought, and whether the page marks it as such.

    What is marked stands outside of comments, menus and other skipped elements,
    and rather outside of places such as "related-items", too. Else the page
    counts as a whole, if it has text then; else what is marked inside of skipped
    elements does.
    """
    for avoid in (BY_WORD, 0):
        if found := _roots(tree, avoid):
            return found, True
    if not _has_text(tree) and (found := _roots(tree, 0, inside=True)):
        return found, True
    return [tree], False


def _has_text(tree: Node) -> bool:
    stack: list[Node | str] = [tree]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if entities.unescape(c).strip():
                return True
        elif not _skipped(c, False):
            stack += c.children
    return False


def countable(tree: Node) -> set[int]:
    """Hashes of the subtrees that may be templates."""
    found: set[int] = set()
    tops, marked = content(tree)
    stack = [c for t in tops for c in t.children]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or _skipped(node, marked):
            continue
        if node.tag not in INLINE and not (marked and node.tag in FLOW):
            found.add(node.digest)
        stack += node.children
    return found


def _gone(node: Node, marked: bool, templates) -> list[bool]:
    """For each child whether it goes. A recurring heading stays before text of the page's own."""
    out, own = [False] * len(node.children), False  # own: what comes next stays
    for i in range(len(out) - 1, -1, -1):
        c = node.children[i]
        if isinstance(c, str):
            own = own or bool(c.strip())
            continue
        recurs = c.tag not in INLINE and not (marked and c.tag in FLOW) and c.digest in templates
        out[i] = _skipped(c, marked) or (recurs and not (own and c.tag in HEADINGS))
        own = not out[i]
    return out


def main_text(tree: Node, templates) -> str:
    """Text blocks of the content in page order; ``templates``: hashes to delete."""
    tops, marked = content(tree)
    out: list[str] = []
    stack: list[Node | str | None] = []

    def put(node: Node) -> None:
        gone = _gone(node, marked, templates) if any(isinstance(c, Node) for c in node.children) else [False] * len(node.children)
        stack.extend(None if g else c for c, g in zip(reversed(node.children), reversed(gone), strict=True))

    for top in reversed(tops):
        put(top)
        stack.append(None)
    while stack:
        c = stack.pop()
        if c is None:  # between blocks
            out.append(" ")
        elif isinstance(c, str):
            out.append(entities.unescape(c))
        else:
            if c.tag not in INLINE or c.tag == "br":
                out.append(" ")
                stack.append(None)
            put(c)
    return " ".join("".join(out).split())


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"


def _signed(values) -> np.ndarray:
    return np.array(sorted(values), np.uint64).view(np.int64)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, digest, pages``: subtrees that recur across many different pages of a host."""

    def subtrees(batches):
        for batch in batches:
            host, page, found = [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = parse(text)
                own = digest(tree)
                values = countable(tree) | {0}  # 0 counts the host's pages
                host += [h] * len(values)
                page += [own] * len(values)
                found += values
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(np.array(page, np.uint64).view(np.int64)), pa.array(np.array(found, np.uint64).view(np.int64))], names=["host", "page", "digest"])

    rows = pages.select(_host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html")).mapInArrow(subtrees, "host string, page long, digest long")
    counted = saved(rows.distinct().groupBy("host", "digest").agg(F.count("*").alias("pages")).filter((F.col("pages") >= min_pages) | (F.col("digest") == 0)))
    hosts = counted.filter("digest = 0").select("host", F.col("pages").alias("all"))
    return counted.filter("digest != 0").join(hosts, "host").filter(F.col("pages") >= F.col("all") * min_share).select("host", "digest", "pages")


def _host(url_col: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), HOST, 1))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id_col, url_col, text, n_chars``, a row for each row of ``pages``.

    Null and empty pages, and pages without main text, have an empty text. Pages
    without a host (null or odd urls) are those of one unnamed host. Repeated
    rows give repeated rows. Pages that mark no ``article`` or ``main`` are
    taken whole, less templates and what is named as no main text.
    """
    templates = saved(site_templates(pages, url_col, html_col, min_pages, min_share))
    kind = pages.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, url string, text string, n_chars long"
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(f"`{html_col}`", F.lit("")).alias("html"), _host(url_col).alias("host"))

    def told(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    def text_of(html: str, own) -> str:
        tree = parse(html)
        if len(own):
            digest(tree)
        return main_text(tree, own)

    if templates.count() <= BROADCAST_TEMPLATES:
        found = templates.select("host", "digest").toArrow()  # at most BROADCAST_TEMPLATES rows
        codes = pc.dictionary_encode(found.column("host").combine_chunks()) if found.num_rows else None
        held = {}
        if found.num_rows:
            of, values = codes.indices.to_numpy(), found.column("digest").to_numpy().view(np.uint64)
            order = np.lexsort((values, of))
            of, values = of[order], values[order]
            for k, host in enumerate(codes.dictionary.to_pylist()):
                held[host] = values[np.searchsorted(of, k) : np.searchsorted(of, k, side="right")]
        sent = pages.sparkSession.sparkContext.broadcast(held)

        def own_text(html: str, known: np.ndarray | None) -> str:
            tree = parse(html)
            if known is None:
                return main_text(tree, ())
            digest(tree)
            own = np.array(sorted(countable(tree)), np.uint64)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            return main_text(tree, set(own[known[at] == own].tolist()))

        def extract(batches):
            for batch in batches:
                yield told(batch, [own_text(t, sent.value.get(h)) for t, h in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)])

        out = base.mapInArrow(extract, shape)
    else:  # each page meets the templates that it has itself

        def keyed(batches):
            for batch in batches:
                host, page, found = [], [], []
                for h, t in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    tree = parse(t)
                    own = digest(tree)
                    values = countable(tree)
                    host, page, found = host + [h] * len(values), page + [own] * len(values), found + list(values)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(np.array(page, np.uint64).view(np.int64)), pa.array(np.array(found, np.uint64).view(np.int64))], names=["host", "page", "digest"])

        def key(batches):
            for batch in batches:
                own = [digest(parse(t)) for t in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(own, np.uint64).view(np.int64))], names=["id", "url", "html", "host", "page"])

        def extract_keyed(batches):
            for batch in batches:
                own = [{v & (2**64 - 1) for v in d or ()} for d in batch.column("digests").to_pylist()]
                yield told(batch, [text_of(t, d) for t, d in zip(batch.column("html").to_pylist(), own, strict=True)])

        has = base.mapInArrow(keyed, "host string, page long, digest long").distinct().join(templates, ["host", "digest"]).groupBy("host", "page").agg(F.collect_list("digest").alias("digests"))
        out = base.mapInArrow(key, f"id {kind}, url string, html string, host string, page long").join(has, ["host", "page"], "left").mapInArrow(extract_keyed, shape)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
