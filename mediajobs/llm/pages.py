"""Main text of web pages by equivalence-class template deduction (operator 6).

Tokens of a page are its elements, by the path of tags and classes from the
root, and its text blocks, by path and text. Over the pages of a host, tokens
with the same occurrence vector (how often on each page) make an equivalence
class; vectors are compared by sums of hashes, so no class is gathered before it
is known to be shared by nearly all pages. Such classes that hold elements are
valid; each is nested in the class of the nearest element above it, and the
nested classes are the host's template. Its elements that occur once a page
delimit slots, and the slot that holds the article (an article element, else the
deepest one with all prose) is extracted. Texts of the template (one text at one
path on nearly all pages) are boilerplate, in the slot as well; there headings
stay, and all texts do if they are more than BOILER of the slot and FRAME chars
(then pages are near copies rather than framed alike). Copies of a page count once for the
template. A template is no larger than a page, whatever its host.

What the template can't know is told by tag, role, class or id: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
within the slot go. What remains is the text: blocks in page order, white space
turned into single spaces, joined by an empty line. Nothing else is dropped or cut.

Hosts with fewer than MIN_PAGES different pages (from so few, what pages share
can't be told from what their articles share), and pages without a host, are
taken by their own elements alone. Null and empty pages, and pages without text,
give an empty text. Unclosed, stray and mixed-up tags are tolerated; pages are
read whole. Repeated rows and null ids are rows of their own. Extra columns
aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages of a host from which a template is deduced, at least.
MIN_PAGES = 5
#: Share of a host's pages that have a template's tokens.
SUPPORT = 0.9
#: Words of a block that the slot must hold if no element of PROSE does.
SENTENCE = 8
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
#: Bytes of all templates up to which they are broadcast instead of joined.
SMALL = 16_000_000
#: Pages of a host for each copy of its template, where templates are joined.
ROWS = 2048
#: Share of a slot's text that may be the template's, and its chars a page that may be in any case.
BOILER, FRAME = 0.25, 150
#: Share of prose in elements of PROSE from which on other sentences don't place the slot.
TAGGED = 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg title object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img br".split()
)
DROPPED = frozenset("nav footer aside form head menu dialog button fieldset".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Words of classes, ids and roles of what isn't the article (fixed values).
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside widget nav "
    "navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended "
    "recommendations comment comments reply replies respond disqus pagination pager toolbar contentinfo complementary "
    "search disclaimer copyright masthead".split()
)
#: Words beside them that leave a name what it is (fixed values).
NEUTRAL = frozenset("site page main top bottom left right box block list area container wrapper wrap inner outer content section bar link links button buttons item items form text title post posts articles".split())
#: What the id of a section of the article must be to drop it: other ids may come from its heading (fixed values).
FURNITURE = frozenset("comment comments reply replies respond disqus share sharing subscribe newsletter signup login recommended recommendations sidebar cookies pagination".split())
#: An opening tag of the key closes an open element of these.
CLOSES = {
    "p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"),
    "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",),
}
#: Elements that an opening tag never closes beyond.
SCOPES = frozenset("html body article main section div table ul ol dl blockquote aside nav header footer form".split())

#: Words of classes and ids that drop inline elements (fixed values); other names of those say nothing of the sort.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag without broken quotes, or markup within them.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_STOPS = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    name: str  # tag, classes and ids
    token: int  # hash of the names from the root to here
    depth: int
    dropped: int  # 1: with all in it; 2: but for its headings
    rank: int  # how much it looks like the article
    named: bool = False  # dropped by a class or id, not by tag or role
    part: bool = False  # ... by a part of a name only
    inside: bool = False  # in an article or main element, or one itself
    above: Element | None = None
    kept: bool = True  # whether a block of it is no boilerplate by tags and names
    heading: bool = False  # it or what it is in
    prosaic: bool = False  # the same of PROSE
    prose: int = 0  # chars of kept text in elements of PROSE, without links
    loose: int = 0  # of other sentences
    chars: int = 0  # of kept text in it

    @property
    def path(self) -> str:
        names, e = [], self
        while e:
            names.append(e.name)
            e = e.above
        return "/".join(reversed(names))


@dataclass
class Page:
    elements: list[Element]  # in their order, so a parent is before its children
    blocks: list[tuple[int, str]]  # owner, text
    tokens: list[int]  # of blocks
    linked: set[int]  # blocks that are links

    def within(self, owner: int):
        while owner >= 0:
            yield owner
            owner = self.elements[owner].parent

    def kept(self, owner: int) -> bool:
        """Whether a block of this element is no boilerplate by tags and names."""
        return owner < 0 or self.elements[owner].kept

    def heading(self, owner: int) -> bool:
        return owner >= 0 and self.elements[owner].heading

    def prose(self, i: int) -> tuple[int, int]:
        """Chars of a block that are prose by its element, or by its length only; links are neither."""
        owner, text = self.blocks[i]
        if i in self.linked or not self.kept(owner):
            return 0, 0
        if owner >= 0 and self.elements[owner].prosaic:
            return len(text), 0
        return 0, len(text) if text.count(" ") >= SENTENCE - 1 else 0

    def marked(self, chosen: set[int]) -> list[bool]:
        """For each element whether it, or what it is in, is one of ``chosen``."""
        out: list[bool] = []
        for i, e in enumerate(self.elements):
            out.append(i in chosen or (e.parent >= 0 and out[e.parent]))
        return out


class Tags:
    """Markup of a page, in order: each is (start, end, whether it closes, tag, attributes); comments have no tag.

    Reads forward only: what is known not to follow isn't looked for again. A ``>`` in
    quotes doesn't end a tag, unless they are broken (never closed, or another tag
    begins outside of quotes); then the first one does.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}

    def find(self, at: int) -> tuple[int, int, bool, str, str] | None:
        s = self.source
        while (lo := s.find("<", at)) >= 0:
            if m := _PLAIN.match(s, lo):
                return lo, m.end(), bool(m[1]), m[2].lower(), m[3]
            if s.startswith(("<!--", "<![CDATA["), lo):
                end = s.find("-->" if s.startswith("<!--", lo) else "]]>", lo + 4)
                return lo, end + 3 if end >= 0 else len(s), False, "", ""
            if s.startswith(("<!", "<?"), lo):
                end = s.find(">", lo) + 1
                return lo, end or len(s), False, "", ""
            m = _NAME.match(s, lo + 1)
            if m and m.end() <= self.last[">"]:
                end = self.end(m.end())
                return lo, end, bool(m[1]), m[2].lower(), s[m.end() : end - 1]
            at = lo + 1
        return None

    def end(self, at: int) -> int:
        i = at
        while m := _STOPS.search(self.source, i):
            c = m[0]
            if c == ">":
                return m.end()
            # beyond the last quote of its kind none closes it
            if c == "<" or m.end() > self.last[c]:
                break
            i = self.source.find(c, m.end()) + 1
        return self.source.find(">", at) + 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


def _words_of(name: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(name)}


def parse(source: str) -> Page:
    """Elements and text blocks of a page; text of scripts, styles and other raw elements is no block.

    Time and memory grow with the length of the page, however deep or broken it is.
    """
    elements, blocks, tokens, stack, run = [], [], [], [], []
    states = [hashlib.blake2b(digest_size=8)]  # of the paths of the open elements
    open_, scopes = Counter(), [Counter()]  # open elements by tag; those since each open element of SCOPES
    linked, in_link, link_chars = set(), False, 0
    skipped, nested_in = "", 0  # the inline element that is left out, and how many of its tag are open in it

    def flush():
        nonlocal link_chars, skipped
        whole = "".join(run)
        text = _SPACE.sub(" ", entities.unescape(whole)).strip() if whole and not whole.isspace() else ""
        if text:
            if 10 * link_chars >= 9 * sum(len(x.strip()) for x in run):
                linked.add(len(blocks))
            blocks.append((stack[-1] if stack else -1, text))
            tokens.append(_extended(states[-1], f"\0{text}")[1])
        run.clear()
        link_chars, skipped = 0, ""

    def pop() -> str:
        tag = elements[stack.pop()].tag
        states.pop()
        open_[tag] -= 1
        if tag in SCOPES:
            scopes.pop()
        else:
            scopes[-1][tag] -= 1
        return tag

    def opened(tag, attributes):
        names, role, hidden, article, each, words = "", "", False, False, (), frozenset()
        if attributes:
            found = _attributes(attributes)
            names, role, hidden = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower(), _hidden(found)
            article = found.get("itemprop", "").lower() == "articlebody"
            each = [_words_of(x) for x in names.split()]
            words = frozenset().union(*each)
        parent = stack[-1] if stack else -1
        inside = parent >= 0 and elements[parent].inside
        dropped = int(tag in DROPPED or hidden or role in BOILERPLATE or role in ("dialog", "form"))
        named = part = False
        if not dropped and words & BOILERPLATE and tag not in HEADINGS:
            # the whole of a name says what an element is; of a section or within the article, a part of one doesn't
            whole = any(x & BOILERPLATE and x <= BOILERPLATE | NEUTRAL for x in each)
            if tag == "section":
                by_class = [_words_of(x) for x in found.get("class", "").split()]
                whole = found.get("id", "").lower() in FURNITURE or any(x & BOILERPLATE and x <= BOILERPLATE | NEUTRAL for x in by_class)
            named, part = whole or not (inside or tag == "section"), not any(len(x) == 1 and x <= BOILERPLATE for x in each)
            dropped = int(named)
        if tag in ("html", "body", "article", "main") and not hidden:
            dropped, named = 0, False
        if not dropped and (tag == "header" or "header" in words or role == "header"):
            dropped = 2 if inside else 1
        rank = 4 if article else 3 if tag == "article" else 2 if tag == "main" or role == "main" else 0
        name = _DIGITS.sub("#", ".".join([tag, *sorted(names.split())]) if names else tag)
        state, token = _extended(states[-1], ("/" if parent >= 0 else "") + name)
        elements.append(Element(tag, parent, name, token, len(stack), dropped, rank, named, part, inside or tag in ("article", "main"), elements[parent] if parent >= 0 else None))
        stack.append(len(elements) - 1)
        states.append(state)
        open_[tag] += 1
        if tag in SCOPES:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1

    at, tags = 0, Tags(source)
    while True:
        m = tags.find(at)
        if not skipped:
            run.append(source[at : m[0] if m else None])
            if in_link:
                link_chars += len(run[-1].strip())
        if not m:
            break
        _, at, closes, tag, attributes = m
        if not tag:
            continue
        if tag in RAW:
            if not closes and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
            if tag in ("title", "textarea", "iframe", "object", "select"):
                flush()
            continue
        if tag in INLINE:
            if tag == skipped:
                nested_in += -1 if closes else 1
                skipped = skipped if nested_in else ""
            elif skipped:
                continue
            elif tag in ("br", "img"):
                run.append(" ")
            elif not closes and tag not in VOID and attributes and _left_out(attributes):
                skipped, nested_in = tag, 1
            elif tag == "a":
                in_link = not closes
            continue
        flush()
        if closes:
            if open_[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        closing = CLOSES.get(tag, ("p",))
        while any(scopes[-1][t] for t in closing):
            while pop() not in closing:
                pass
        if not attributes.endswith("/"):
            opened(tag, attributes)
    flush()
    page = Page(elements, blocks, tokens, linked)
    _take_back(page)
    _settle(page)
    return page


def _left_out(attributes: str) -> bool:
    """Whether an inline element is hidden, or an advert by the whole of a class or id."""
    found = _attributes(attributes)
    each = [_words_of(x) for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
    return _hidden(found) or any(x & ADVERTS and x <= ADVERTS | NEUTRAL for x in each)


def _settle(page: Page) -> None:
    """What elements have from those above them, then sums over those below."""
    elements, states = page.elements, []  # in what is dropped; in a dropped header, without a heading between
    for e in elements:
        up = elements[e.parent] if e.parent >= 0 else None
        own = e.tag in HEADINGS
        dead = e.dropped == 1 or (up is not None and states[e.parent][0])
        faint = (e.dropped == 2 or (up is not None and states[e.parent][1])) and not own
        states.append((dead, faint))
        e.kept = not dead and not faint
        e.heading = own or (up is not None and up.heading)
        e.prosaic = e.tag in PROSE or (up is not None and up.prosaic)
    for k, (owner, text) in enumerate(page.blocks):
        if owner >= 0 and page.kept(owner):
            e = elements[owner]
            prose, loose = page.prose(k)
            e.chars += len(text)
            e.prose += prose
            e.loose += loose
    for e in reversed(elements):
        if e.parent >= 0:
            up = elements[e.parent]
            up.chars += e.chars
            up.prose += e.prose
            up.loose += e.loose


def _take_back(page: Page) -> None:
    """Names don't drop what holds the page's only article, or, without one, more than half of its text by a part of a name."""
    elements = page.elements
    if not any(e.named and e.dropped for e in elements):
        return
    chars, total = [0] * len(elements), 0
    gone, names = [], []  # in what tag or role drops; how many named elements it is in
    for e in elements:
        up = e.parent
        gone.append((e.dropped == 1 and not e.named) or (up >= 0 and gone[up]))
        names.append(e.named + (names[up] if up >= 0 else 0))
    for owner, text in page.blocks:
        if owner < 0 or not gone[owner]:
            total += len(text)
            if owner >= 0:
                chars[owner] += len(text)
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            chars[elements[i].parent] += chars[i]
    articles = [(names[i], -chars[i], i) for i, e in enumerate(elements) if e.rank and chars[i]]
    if articles:
        wrong = page.within(min(articles)[2])
    else:
        wrong = [i for i, e in enumerate(elements) if e.part and 2 * chars[i] > total]
    for i in wrong:
        if elements[i].named:
            elements[i].dropped, elements[i].named = 0, False


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _digest(s: str) -> int:
    return _number(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _extended(state, s: str):
    """The state of a hash after ``s``, and its number: that of the whole text so far."""
    state = state.copy()
    state.update(s.encode("utf-8", "surrogatepass"))
    return state, _number(state.digest())


_hash = _digest


ELEMENT, BLOCK, PAGE = 0, 1, 2
_FIELDS = ("kind", "token", "parent", "times", "chars", "prose", "loose", "rank", "depth")
_ARROW = [pa.int8(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int8(), pa.int16()]
PAGES = (
    "host string, page long, whole_prose int, whole_loose int, "
    "tokens array<struct<kind:byte,token:long,parent:long,times:int,chars:int,prose:int,loose:int,rank:byte,depth:short>>"
)


def _token(page: Page, owner: int, text: str | None = None) -> int:
    """Hash of an element, or of a block within it; 0 above the root."""
    if text is not None:
        return _digest(f"{page.elements[owner].path if owner >= 0 else str()}\0{text}")
    return page.elements[owner].token if owner >= 0 else 0


def _tokens(batches):
    """Each page's tokens with how often they occur on it; of a task's copies, the first.

    The rank of an element is its own, that of a block 1 in a heading. Depths beyond 30,000 count as that.
    """
    known = set()
    for b in batches:
        if len(known) > 1_000_000:
            known.clear()
        pages, ends, columns = [], [0], [[] for _ in _FIELDS]
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            key = _digest(source)
            if (host, key) in known:
                continue
            known.add((host, key))
            page = parse(source)
            pages.append((host, key, *[sum(x) for x in zip((0, 0), *map(page.prose, range(len(page.blocks))))]))
            seen: dict[int, list] = {}
            for e in page.elements:
                token = e.token
                row = seen.setdefault(token, [ELEMENT, token, _token(page, e.parent), 0, 0, 0, 0, 0 if e.dropped else e.rank, min(e.depth, 30_000)])
                for i, v in enumerate((1, e.chars, e.prose, e.loose), 3):
                    row[i] += v
            for token, (owner, text) in zip(page.tokens, page.blocks, strict=True):
                depth = page.elements[owner].depth + 1 if owner >= 0 else 0
                row = seen.setdefault(token, [BLOCK, token, _token(page, owner), 0, 0, 0, 0, int(page.heading(owner)), min(depth, 30_000)])
                row[3] += 1
                row[4] += len(text) if page.kept(owner) else 0
            for row in seen.values():
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            ends.append(len(columns[0]))
        tokens = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], _FIELDS)
        host, key, prose, loose = list(zip(*pages, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(key, pa.int64()), pa.array(prose, pa.int32()), pa.array(loose, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)],
            ["host", "page", "whole_prose", "whole_loose", "tokens"],
        )


@dataclass
class Token:
    """A token that nearly all pages of a host have, with sums over its pages; ``vector`` stands for its occurrence vector."""

    kind: int
    token: int
    parent: int
    pages: int
    times: int
    chars: int
    prose: int
    loose: int
    whole_prose: int
    whole_loose: int
    rank: int
    depth: int
    vector: tuple[int, int]


@dataclass
class Template:
    """``classes``: tokens of each valid class and the class it is nested in (-1: none), outermost first."""

    classes: list[tuple[list[int], int]]
    slot: int | None
    texts: list[int]


def nested(tokens: list[Token]) -> Template:
    """The template of one host."""
    by_vector: dict[tuple, list[Token]] = {}
    for t in sorted(tokens, key=lambda t: (t.depth, t.kind, t.token)):
        by_vector.setdefault((t.pages, t.vector), []).append(t)
    valid = [c for c in by_vector.values() if len(c) > 1 and any(t.kind == ELEMENT for t in c)]
    above = {t.token: t.parent for t in tokens if t.kind == ELEMENT}
    of_class = {t.token: k for k, c in enumerate(valid) for t in c if t.kind == ELEMENT}

    def over(t: Token):
        token = t.parent
        while token:
            yield token
            token = above.get(token, 0)

    classes = []
    for k, c in enumerate(valid):
        outer = (of_class[x] for x in over(c[0]) if of_class.get(x, k) != k)
        classes.append(([t.token for t in c], next(outer, -1)))
    elements = [t for c in valid for t in c if t.kind == ELEMENT and t.times == t.pages]
    place = max(((t.rank if t.chars else -1, t.depth, t.token) for t in elements if t.rank or _all_prose(t)), default=None)
    slot = place and next(t for t in elements if t.token == place[2])
    texts = [t for c in valid for t in c if t.kind == BLOCK]
    inner = [t for t in texts if slot and slot.token in over(t)]
    chars = sum(t.chars for t in inner)
    if inner and chars > BOILER * slot.chars and chars > FRAME * slot.pages:
        drop = set()
    else:
        drop = {t.token for t in inner if not t.rank}
    keep = {t.token for t in inner} - drop
    return Template(classes, slot and slot.token, sorted(t.token for t in texts if t.token not in keep))


def _all_prose(t: Token) -> bool:
    """Whether an element holds all prose of the pages that have it."""
    both = t.whole_prose + t.whole_loose
    if t.whole_prose and t.whole_prose >= TAGGED * both:
        return t.prose == t.whole_prose
    return bool(both) and t.prose + t.loose == both


TEMPLATES = "host string, pages long, slot long, texts array<long>, classes array<struct<tokens:array<long>,within:int>>"


def _templates(batches):
    """Rows of common tokens, sorted by host, to TEMPLATES rows."""
    host, tokens, all_pages, out = None, [], 0, [[] for _ in range(5)]

    def solve():
        if tokens:
            t = nested(tokens)
            for c, v in zip(out, (host, all_pages, t.slot, t.texts, [{"tokens": a, "within": b} for a, b in t.classes]), strict=True):
                c.append(v)

    def table():
        kind = pa.list_(pa.struct([("tokens", pa.list_(pa.int64())), ("within", pa.int32())]))
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), kind]
        t = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], ["host", "pages", "slot", "texts", "classes"])
        for c in out:
            c.clear()
        return t

    for b in batches:
        for name, n, *row, v0, v1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if name != host:
                solve()
                host, all_pages, tokens = name, n, []
            tokens.append(Token(*row, (v0, v1)))
        yield table()
    solve()
    yield table()


def host_of(url):
    """Column: lower-cased host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """Per host: host, pages (different ones), slot (token of the article's element, or null), texts (tokens to drop), classes.

    ``pages`` has host and html; pages stay where they are, their tokens are shuffled.
    """
    single = pages.where("host <> ''").select("host", "html").mapInArrow(_tokens, PAGES).dropDuplicates(["host", "page"])
    itself = F.struct(*[F.lit(PAGE if f == "kind" else 1 if f == "times" else 0).cast(t).alias(f) for f, t in zip(_FIELDS, ("byte", "long", "long", *["int"] * 4, "byte", "short"), strict=True)])
    tokens = single.select("host", "page", "whole_prose", "whole_loose", F.inline(F.concat("tokens", F.array(itself))))
    # two sums of 31 bits stand for a token's occurrence vector
    seen = F.xxhash64("page", "times")
    part = lambda k: F.sum(F.pmod(F.shiftrightunsigned(seen, 31 * k), F.lit(1 << 31)))
    sums = ("times", "chars", "prose", "loose", "whole_prose", "whole_loose")
    counts = cut(
        tokens.groupBy("host", "token", "kind").agg(
            F.any_value("parent").alias("parent"), F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in sums],
            F.max("rank").alias("rank"), F.min("depth").alias("depth"), part(0).alias("v0"), part(1).alias("v1"),
        ).where(F.col("pages") >= min_pages)
    )
    hosts = counts.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("all_pages"))
    common = counts.where(F.col("kind") != PAGE).join(hosts, "host").where(F.col("pages") >= support * F.col("all_pages"))
    rows = common.select("host", "all_pages", "kind", "token", "parent", "pages", *sums, "rank", "depth", "v0", "v1")
    return rows.repartition("host").sortWithinPartitions("host").mapInArrow(_templates, TEMPLATES)


def main_text(source: str, slot: int | None, texts: frozenset[int]) -> str:
    """The article's text of one page, given its host's slot and template texts."""
    return decided(source, slot, texts)[0]


def decided(source: str, slot: int | None, texts: frozenset[int]) -> tuple[str, int]:
    """The article's text, and how many blocks of the page the template left out.

    The template comes first: what is outside its slot or one of its texts goes. Tags
    and names decide on what it lets stay, and, where it has no slot on this page, where
    the article is.
    """
    page = parse(source)
    slots = {i for i, e in enumerate(page.elements) if slot is not None and e.token == slot}
    inside = slots
    if not slots:
        fits = [i for i, e in enumerate(page.elements) if e.rank and e.chars and not e.dropped]
        inside = {max(fits, key=lambda i: (page.elements[i].rank, page.elements[i].chars, -i))} if fits else set()
    marked = page.marked(inside)
    out, by_template = [], 0
    for token, (owner, text) in zip(page.tokens, page.blocks, strict=True):
        beside = bool(inside) and (owner < 0 or not marked[owner])
        if token in texts or (beside and slots):
            by_template += 1
        elif not beside and page.kept(owner):
            out.append(text)
    return "\n\n".join(out), by_template


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, rows_per_copy: int = ROWS, small: int = SMALL) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_template (blocks that the template left out)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    found = cut(templates(rows, min_pages).drop("classes"))
    n_bytes = found.agg(F.sum(F.size("texts") * 8 + F.octet_length("host") + 40)).first()[0] or 0
    if n_bytes <= small:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        # pages of a host with many of them are dealt among copies of its template; at most 1 of rows_per_copy pages has such a host
        counts = rows.groupBy("host").agg(F.ceil(F.count("*") / F.lit(rows_per_copy)).cast("int").alias("copies")).where("copies > 1")
        hot = F.broadcast(cut(counts))
        copies = F.coalesce("copies", F.lit(1))
        joined = rows.join(hot, "host", "left").withColumn("copy", F.pmod(F.xxhash64("url", "page_id"), copies).cast("int")).join(
            found.join(hot, "host", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies"), ["host", "copy"], "left"
        )

    def run(batches):
        known: dict[str, frozenset[int]] = {}
        for b in batches:
            text, out = [], []
            hosts, slots = b.column(2).to_pylist(), b.column(4).to_pylist()
            for i, (host, source) in enumerate(zip(hosts, b.column(3).to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(b.column(5)[i].as_py() or ())
                found_text, by_template = decided(source, slots[i], known[host])
                text.append(found_text)
                out.append(by_template)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array(out, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    return joined.select("page_id", "url", "host", "html", "slot", "texts").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_template long"
    )
