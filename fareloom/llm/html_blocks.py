"""Text blocks of HTML pages, each with the part of the page that it stands in."""

import re
from collections import Counter
from html.parser import HTMLParser
from itertools import groupby

#: Elements by what they mean for the text around and inside them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset(("article", "main"))
RAW_TAGS = frozenset(("script", "style"))
TEXTLESS_TAGS = frozenset("head noscript template svg iframe object canvas button select textarea video".split())
DROPPED_TAGS = TEXTLESS_TAGS | frozenset("nav footer aside form menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Nouns of a class name or id that mark adverts, comments, footers and forms, and those that mark menus, headers, sidebars and notices. The
#: latter also name the layout that holds the text; see ``_named``.
STRONG_WORDS = frozenset(
    "ad ads advert advertisement advertising adbox breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr login pagination recommended related replies reply respond responses signup sponsor sponsored subscribe tagcloud trackbacks".split()
)
LAYOUT_WORDS = frozenset("banner header masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted search share sharing sidebar social toolbar widget".split())
DROPPED_WORDS = STRONG_WORDS | LAYOUT_WORDS
#: Roles and properties that say that an element is a comment, whatever its name.
COMMENT_ROLES, COMMENT_TYPES = frozenset(("comment",)), ("schema.org/comment", "schema.org/usercomments")
#: Words that may follow such a noun without changing what it says ("comment-body", "ad-slot"), and words in front
#: that turn it round ("has-sidebar", "tag-cookie").
GENERIC_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons container content desktop feed footer form icon icons inline inner item items left link links list main mobile outer panel post posts primary right row secondary section slot stories story top trail unit wrap wrapper zone".split()
)
QUALIFYING_WORDS = frozenset("category has hide is no non not show skip tag with without".split())
#: Nouns that name a part of an article as well; they say nothing about headings and inside articles.
HEADING_WORDS = frozenset("header masthead banner".split())
#: Elements that don't swallow an article or main inside them even if they are closed; and those that always do.
WRAPPING_TAGS, SWALLOWING_TAGS = frozenset(("form",)), frozenset("aside template noscript".split())
#: Elements whose end tag may be left out: by the start tag that ends them, and how far up the search for them goes.
_ITEM_END, _CELL_END = frozenset("ul ol menu dl table".split()), frozenset("tr table".split())
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), _ITEM_END),
    "dd": (frozenset(("dd", "dt")), _ITEM_END),
    "dt": (frozenset(("dd", "dt")), _ITEM_END),
    "td": (frozenset(("td", "th")), _CELL_END),
    "th": (frozenset(("td", "th")), _CELL_END),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
}
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of a block's text in links, and blocks in a row, from which on they are a menu.
LINK_SHARE, LINK_BLOCKS = 0.9, 3
#: Words that marked elements must hold to be read where nothing else is left of the page, and to be taken for the page's layout.
LEAST_WORDS, LEAST_LAYOUT_WORDS = 60, 20
_SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE_NOUNS: dict[str, frozenset] = {}

PLAIN, CONTENT, MARKED = 0, 1, 2


def _nouns(value: str) -> frozenset:
    """The noun of each class name of an attribute that marks something; whole names count, not words inside them."""
    known = _ATTRIBUTE_NOUNS.get(value)
    if known is None:
        found = []
        for name in value.split():
            words = [w.lower() for w in _SPLIT_WORDS.split(name) if len(w) > 1]
            if not words or words[0] in QUALIFYING_WORDS:
                continue
            while len(words) > 1 and words[-1] in GENERIC_WORDS and words[-1] not in DROPPED_WORDS:
                words.pop()
            if words[-1] in DROPPED_WORDS:
                found.append(words[-1])
        if len(_ATTRIBUTE_NOUNS) > 10_000:
            _ATTRIBUTE_NOUNS.clear()
        known = _ATTRIBUTE_NOUNS[value] = frozenset(found)
    return known


#: Why text is left out, but for names: not at all, by its element or role, or because its element has no text.
_READ, _BY_ELEMENT, _TEXTLESS = 0, 1, 2
#: Zone of blocks left out by a class name or id alone, until the page is complete.
_NAMED = 3

#: An entry of the stack: tag, why dropped inside, content inside, dropped for good inside, named elements around, number of blocks in front of
#: an element dropped by its tag.
_OUTSIDE = ("", _READ, False, False, (), None)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool, tuple[int, ...], int | None]] = []
        self.open: Counter[str] = Counter()  # of the stack's tags
        self.dropped, self.content, self.marked = _READ, False, False
        self.names: tuple[int, ...] = ()  # numbers of the elements around that their names mark; a name inside one of its kind adds nothing
        self.strong: list[bool] = []  # of each such element
        self.blocks: list[tuple[str, int, bool, tuple[int, ...]]] = []  # text, zone, whether it is all links, names
        self.parts: list[str] = []
        self.in_link, self.length, self.linked = False, 0, 0
        self.language, self.raw = "", False

    def _end_block(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                zone = MARKED if self.dropped else CONTENT if self.content else PLAIN
                self.blocks.append((text, zone, self.linked >= LINK_SHARE * self.length, self.names))
            self.parts, self.length, self.linked = [], 0, 0

    def _cut(self, k):
        self.open.subtract(tag for tag, *_ in self.stack[k:])
        del self.stack[k:]
        _, self.dropped, self.content, self.marked, self.names, _ = self.stack[-1] if self.stack else _OUTSIDE

    def _end_implied(self, tag):
        """Ends what a block's start tag ends without an end tag: a paragraph always, an item, cell or row by the next one."""
        kinds, bounds = IMPLIED_ENDS.get(tag, (frozenset(), BLOCK_TAGS))
        if not any(self.open[kind] for kind in kinds):
            bounds = BLOCK_TAGS
        for k in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[k][0]
            if open_tag == "p" or open_tag in kinds:
                self._cut(k)
                if open_tag != "p":
                    return
            elif open_tag in bounds or open_tag in DROPPED_TAGS or open_tag in CONTENT_TAGS:
                return

    def handle_starttag(self, tag, attrs):
        if tag in RAW_TAGS:  # no text, and no end of the block that they stand in
            self.raw = True
            return
        if tag in BLOCK_TAGS:
            self._end_block()
            self._end_implied(tag)
            if tag in HEADING_TAGS or tag in CONTENT_TAGS or tag == "p":
                self.in_link = False
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        given = dict(attrs)
        if tag == "html" and not self.language:
            self.language = given.get("lang") or given.get("xml:lang") or ""
        if tag in VOID_TAGS:
            return
        content, dropped, marked, names, before = self.content or tag in CONTENT_TAGS, self.dropped, self.marked, self.names, None
        if tag in CONTENT_TAGS and not marked:
            dropped = _READ  # an unclosed menu or head in front of the article doesn't swallow it; see handle_endtag
        if tag == "body":
            dropped, marked, names = _READ, False, ()
            self.stack = [(*entry[:5], None) for entry in self.stack]
        if tag in DROPPED_TAGS or (tag == "header" and not self.content):
            dropped, marked = _TEXTLESS if tag in TEXTLESS_TAGS else max(dropped, _BY_ELEMENT), marked or tag in SWALLOWING_TAGS
            before = None if tag in WRAPPING_TAGS else len(self.blocks)
        if attrs:
            role = (given.get("role") or "").lower()
            if role in DROPPED_ROLES or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
                dropped, marked = max(dropped, _BY_ELEMENT), True
            elif tag not in ("html", "body"):
                nouns = frozenset().union(*(_nouns(given[k]) for k in ("class", "id") if given.get(k)))
                nouns -= HEADING_WORDS if self.content or tag in HEADING_TAGS else frozenset()
                a_comment = role in COMMENT_ROLES or (given.get("itemprop") or "").lower() == "comment" or (given.get("itemtype") or "").lower().rstrip("/").endswith(COMMENT_TYPES)
                strong = a_comment or not nouns <= LAYOUT_WORDS
                if (nouns or a_comment) and not any(self.strong[m] for m in names):
                    names = (*names, len(self.strong))
                    self.strong.append(strong)
        if dropped != self.dropped or names != self.names:  # text of an element that is no block
            self._end_block()
        self.stack.append((tag, dropped, content, marked, names, before))
        self.open[tag] += 1
        self.dropped, self.content, self.marked, self.names = dropped, content, marked, names

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS or tag not in BLOCK_TAGS:
            self.handle_starttag(tag, attrs) if tag in VOID_TAGS else None
        elif tag == "svg":
            self._end_block()
        else:  # a slash at the end of a start tag means nothing in HTML, but in SVG
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in RAW_TAGS:
            self.raw = False
            return
        if tag in BLOCK_TAGS:
            self._end_block()
        elif tag == "a":
            self.in_link = False
        for k in range(len(self.stack) - 1 if self.open[tag] else -1, -1, -1):
            if self.stack[k][0] == tag:
                entry, around = self.stack[k], self.stack[k - 1] if k else _OUTSIDE
                if entry[1] != around[1] or entry[4] != around[4]:
                    self._end_block()
                if entry[5] is not None:  # it was closed after all, with what articles it has
                    inside = self.blocks[entry[5] :]
                    self.blocks[entry[5] :] = [] if tag in TEXTLESS_TAGS else [(text, MARKED, *rest) for text, _, *rest in inside]
                self._cut(k)
                return

    def handle_data(self, data):
        if self.dropped != _TEXTLESS and not self.raw:
            self.parts.append(data)
            n = len(data.strip())
            self.length += n
            self.linked += n if self.in_link else 0


def _named(blocks: list[tuple[str, int, bool, tuple[int, ...]]], strong: list[bool]) -> list[tuple[str, int, bool]]:
    """The blocks with zone ``_NAMED`` where a name around them marks what it says.

    A name of layout says nothing where its element holds half of the page's prose and half of what articles and main hold: then it
    names the side that a sidebar is on, or where search results would be. Prose is what other names, elements and links leave.
    """
    if all(strong):
        return [(text, _NAMED if names and zone != MARKED else zone, links) for text, zone, links, names in blocks]
    held, words, content, prose, articles = Counter(), Counter(), Counter(), 0, 0
    for text, zone, links, names in blocks:
        if zone in (PLAIN, CONTENT) and not links and not any(strong[m] for m in names):
            size = len(text)
            prose += size
            articles += size * (zone == CONTENT)
            for m in names:
                held[m] += size
                words[m] += text.count(" ") + 1
                content[m] += size * (zone == CONTENT)
    layout = {m for m in held if words[m] >= LEAST_LAYOUT_WORDS and 2 * held[m] >= prose and 2 * content[m] >= articles}
    return [(text, _NAMED if zone != MARKED and not layout.issuperset(names) else zone, links) for text, zone, links, names in blocks]


def _with_menus_marked(blocks: list[tuple[str, int, bool]]) -> list[tuple[str, int]]:
    """Runs of blocks that are all links are menus, whatever their elements; those inside articles aren't."""
    zones = [zone for _, zone, _ in blocks]
    read = [k for k, zone in enumerate(zones) if zone in (PLAIN, CONTENT)]
    for links, run in groupby(read, lambda k: blocks[k][2] and zones[k] == PLAIN):
        menu = list(run)
        if links and len(menu) >= LINK_BLOCKS:
            for k in menu:
                zones[k] = MARKED
    return [(text, zone) for (text, _, _), zone in zip(blocks, zones, strict=True)]


def page_blocks(html: str | None, marked: bool = False) -> tuple[list[tuple[str, int]], str]:
    """Blocks (text with single spaces, CONTENT inside article or main, else PLAIN) and the declared language.

    Left out: head, scripts, styles, menus, headers, footers, sidebars, forms, and elements whose class, id
    or role says that they are one of these, a notice, an advert or comments; articles inside these as well,
    but for those in forms and behind an unclosed tag; outside articles also three and more blocks in a row that are
    all links. A class name counts as a whole, by its noun. Paragraphs, items, cells and rows end where HTML says,
    with or without an end tag. Where articles and main hold less than half of the
    text, they are teasers and not the content: all blocks are PLAIN. Where nothing else is left of a page,
    what its class names alone had left out is read, if that is a text of some length. With ``marked`` the text
    that is left out comes along as MARKED, but not what elements without text, like head and script, hold.
    """
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._end_block()
    blocks = _with_menus_marked(_named(parser.blocks, parser.strong))
    if not any(zone in (PLAIN, CONTENT) for _, zone in blocks) and sum(len(text.split()) for text, zone in blocks if zone == _NAMED) >= LEAST_WORDS:
        blocks = [(text, PLAIN if zone == _NAMED else zone) for text, zone in blocks]
    size = lambda *zones: sum(len(text) for text, zone in blocks if zone in zones)
    if 2 * size(CONTENT) < size(PLAIN, CONTENT):
        blocks = [(text, PLAIN if zone == CONTENT else zone) for text, zone in blocks]
    blocks = [(text, min(zone, MARKED)) for text, zone in blocks]
    return blocks if marked else [b for b in blocks if b[1] != MARKED], parser.language
