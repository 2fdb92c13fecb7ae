"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks where block elements begin or end. Pass 1 decides
blocks by themselves: what lies in menus, headers, footers, sidebars, notices,
adverts, forms or comments is bad, by element or by class, id and role; so is what
is mostly links. Long blocks with many stop words and few links are good. The
others, short ones above all, stay open. Where article or main elements hold more
than what is good outside of them, blocks outside are bad. Pass 2 gives an open
block the label of its nearest decided neighbours: where both agree, theirs; else
that of the one that shares more of its ancestors, then of the nearer one, then
good. Where no block is good by itself, the open ones are.

A page is worked out in one go in its task, in a time linear in its length; no
rows move.

Cases: a null or empty page has the text "" and 0 characters; tags that never
close, or close twice, comments and quotes that don't end, and markup cut at the
page's end are read as browsers do; repeated rows give a row each; null ids are
kept; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import tune

# Frequent words of four languages, elements by their role, and words in class, id and role of what isn't main text.
STOP_WORDS = frozenset(
    "the of and to a in is that it for on with as was at by this be from or are an not have had but which they all his her you we their there been has when who will more no if out so what up said can"
    " le la les de des du et un une en que qui dans pour pas sur au aux par plus ne se ce il elle son sa ses est sont avec mais ou cette nous vous ont"
    " der die das und den dem ein eine einer eines zu mit sich auf für ist im nicht auch es an werden aus er hat dass sie nach wird bei noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch"
    " el los las y del se por con una su para como lo pero sus al ha este si porque esta entre cuando muy sin sobre ser tiene también hasta hay donde no me".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas audio video textarea title head xmp noembed noframes applet".split())
BAD_ELEMENTS = frozenset("nav aside footer form menu dialog select button datalist search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note status".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login signin menu menus nav navbar navigation breadcrumb breadcrumbs side sidebar sidebars aside asides widget widgets rail footer header masthead topbar toolbar pagination pager comment comments"
    " commentlist disqus respond reply replies discussion share sharing social related recommended recommendations trending outbrain taboola search searchbox hidden copyright disclaimer legal skip".split()
)
#: Before or beside a bad word in one class name, these say that it's about what else the page has, or that the header is the article's own.
PAGE_WORDS, OWN_WORDS = frozenset("with has no without".split()), frozenset("article entry post story headline title content".split())

#: Those by which an inline element says so.
INLINE_WORDS = frozenset("ad ads advert advertisement sponsored promo share social hidden cookie".split())

#: Open elements at most; deeper ones are taken for their parents.
DEEPEST = 512
#: Characters from which on a block can decide by its stop words, and up to which it is short.
LEAST = 70
#: Shares of stop words (good from here on) and of characters in links (bad from here on).
STOP_SHARE, LINK_SHARE = 0.15, 0.5

_MARKUP = re.compile(r"""<!--(?:>|->)?|<[!?]|<(/?)([A-Za-z][^\s/>]{0,63})((?:[^<>"']|"[^"]{0,4096}"|'[^']{0,4096}'|["'])*+)>""")
_CUT = re.compile(r"<[A-Za-z/!?][^<]*$")
_IN_HEAD = re.compile(r"<(script|style|title|template|noscript)\b[^>]*>|<!--|</head\s*>|(?=<(?!meta\b|link\b|base\b)[A-Za-z])", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: What a start tag ends, if it is open with none of the second set between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
#: Where an end tag of an inline element, or an implied end, stops looking.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WALLS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th ul".split())


class Element(NamedTuple):
    name: str
    key: int  # its number in the page
    bad: bool  # it or what it lies in isn't main text
    skip: bool  # an inline element that isn't
    inside: bool  # it is or lies in an article or main element


class Block(NamedTuple):
    text: str
    link_chars: int
    bad: bool
    inside: bool
    path: tuple[int, ...]


def _named_bad(name: str, attributes: str, inside: bool) -> bool:
    """Whether element and attributes say that this isn't main text."""
    if name in BAD_ELEMENTS or name == "header" and not inside:
        return True
    if name in ("html", "body", "main") or not attributes:
        return False
    words = BAD_WORDS if name in BLOCKS else INLINE_WORDS
    for kind, *value in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), html.unescape("".join(value))
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and _HIDING.search(value):
            return True
        if kind == "role" and value.lower() in BAD_ROLES or kind == "itemprop" and value.lower() == "comment":
            return True
        for one in value.split() if kind in ("class", "id") else ():
            pieces = [x.lower() for x in _PIECE.findall(one)]
            found = words.intersection(pieces)
            if found and not PAGE_WORDS.intersection(pieces) and not (found <= {"header", "banner"} and OWN_WORDS.intersection(pieces)):
                return True
    return False


class Reader:
    """Cuts one page into blocks."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.stack: list[Element] = []
        self.parts: list[str] = []
        self.links = self.keys = 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1] if self.stack else None
            self.found.append(Block(text, min(self.links, len(text)), bool(top and top.bad and not top.skip), bool(top and top.inside), tuple(e.key for e in self.stack if e.name in BLOCKS)))
        self.parts.clear()
        self.links = 0

    def say(self, piece: str) -> None:
        if piece and not (self.stack and self.stack[-1].skip):
            self.parts.append(piece)
            if any(e.name == "a" for e in self.stack[-8:]):
                self.links += len(" ".join(piece.split()))

    def close(self, names: set[str] | frozenset[str], walls: set[str] | frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, and what is open in it, unless a wall stands before it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                del self.stack[i:]
                return
            if self.stack[i].name in walls:
                return

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.close({name}, _WALLS - {name} if name in ("p", "li") else frozenset())
        elif name == "br":
            self.say(" ")
        else:
            self.close({name}, _WALLS)

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            if name not in ("html", "body"):
                self.close({"p"}, _WALLS)
            if name in _HEADINGS and self.stack and self.stack[-1].name in _HEADINGS:
                self.stack.pop()
        if name in _CLOSES:
            self.close(*_CLOSES[name])
        if name in VOID:
            if name in ("br", "img"):
                self.say(" ")
            return
        if len(self.stack) >= DEEPEST:
            return
        above = self.stack[-1] if self.stack else Element("", 0, False, False, False)
        self.keys += 1
        bad = above.bad or _named_bad(name, attributes, above.inside)
        self.stack.append(Element(name, self.keys, bad, not block and bad and (above.skip or not above.bad), above.inside or name in ("article", "main")))


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold a character, in page order."""
    r, at, last = Reader(), 0, page.rfind(">") + 1
    while at < len(page):
        m = _MARKUP.search(page, at, last) if at < last else None
        if m is None:
            cut = _CUT.search(page, at)  # markup that the page's end cuts
            r.say(page[at : cut.start()] if cut else page[at:])
            break
        r.say(page[at : m.start()])
        at, token = m.end(), m.group(0)
        if token.startswith("<!--"):
            at = at if token.endswith(">") else _after(page, "-->", at)
        elif token in ("<!", "<?"):
            at = _after(page, "]]>" if page.startswith("[CDATA[", at) else ">", at)
        elif m.group(1):
            r.end(m.group(2).lower())
        else:
            name, attributes = m.group(2).lower(), m.group(3)
            if name == "head":
                at = _after_head(page, at)
            elif name in RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else len(page)
                r.say(" ")
            elif name not in RAW:
                r.start(name, attributes)
    r.flush()
    return r.found


def _after(page: str, mark: str, at: int) -> int:
    stop = page.find(mark, at)
    return len(page) if stop < 0 else stop + len(mark)


def _after_head(page: str, at: int) -> int:
    """Where the head ends: at its end tag, or before the first element that can't be in it."""
    while m := _IN_HEAD.search(page, at):
        if m.group(1):
            stop = re.compile(rf"</{m.group(1)}\b[^>]*>", re.IGNORECASE).search(page, m.end())
            at = stop.end() if stop else len(page)
        elif m.group(0) == "<!--":
            at = _after(page, "-->", m.end())
        else:
            return m.end()
    return len(page)


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def decide(block: Block) -> bool | None:
    """Pass 1: good, bad, or open."""
    if block.bad or block.link_chars >= LINK_SHARE * len(block.text):
        return False
    if len(block.text) >= LEAST and stop_share(block.text) >= STOP_SHARE:
        return True
    return None


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def labels(found: list[Block]) -> list[bool]:
    """Pass 2: open blocks inherit from the nearest decided neighbours."""
    first = [decide(b) for b in found]
    inside = sum(len(b.text) for b, x in zip(found, first, strict=True) if b.inside and x is not False)
    outside = sum(len(b.text) for b, x in zip(found, first, strict=True) if not b.inside and x)
    if inside > outside:  # the page says where its article is
        first = [x if b.inside else False for b, x in zip(found, first, strict=True)]
    if True not in first:
        return [x is None for x in first]
    n, out = len(found), list(first)
    counts = [x is not None and (b.inside and not b.bad or inside <= outside) for b, x in zip(found, first, strict=True)]  # an article's blocks look at its own
    before, after = [-1] * n, [-1] * n
    for i in range(1, n):
        before[i] = i - 1 if counts[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if counts[i + 1] else after[i + 1]
    for i in range(n):
        if first[i] is None:
            near = [j for j in (before[i], after[i]) if j >= 0]
            out[i] = first[max(near, key=lambda j: (_shared(found[i].path, found[j].path), -abs(i - j), first[j]))] if len({first[j] for j in near}) > 1 else first[near[0]]
    return [bool(x) for x in out]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tune(pages.sparkSession)
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id").cast(pa.int64()), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return own.mapInArrow(read, "page_id long, url string, text string, n_chars long")
