"""HTML extraction by two-pass block rules.

A page is read as a sequence of blocks (text between block-level tags). First pass, by density: a block that is mostly links
is boilerplate; one that is long and holds enough stop words of some language, or is long prose without any that is known,
is content; what is short, and headings, are undecided. What a page itself says counts beside: parts that HTML sets apart
(navigation, footers, asides, hidden ones) and those whose whole class or id is made of such names are boilerplate, as is
what is named as comments, whoever's they are; names that may mean a subject as well ("legal") do so only outside an
article. Forms, and names that a whole layout may go by ("sidebar"), only set apart what doesn't hold the page's prose: if
the prose in there is more than twice what stands free, with a heading or an article of its own, it counts as free. Where
articles hold a third of the free prose or more, what stands outside of them is boilerplate. Second pass: undecided blocks
take the label of the nearest neighbour that the first pass decided by its text; inside an article the article's own edges
count as content. Without such a neighbour they are boilerplate. Adverts inside a paragraph are left out of it.

A page is read in time linear in its length, however broken: a quote that is never closed is an ordinary character, and a tag
that never ends ends at the next ">", or with the page.

The text is the content blocks in page order, white space within a block as one space, blocks joined by an empty line.

Defined cases: a null html counts as empty and gives the empty text; a page without content gives the empty text; repeated
rows each keep their row. Pages are independent: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of at least so many characters is decided by its stop words; of so many stop words in a hundred words it is content.
LONG, STOP_WORDS, LINKS = 60, 0.12, 0.5

# Frequent words of the languages that pages come in; fixed lists.
STOP = frozenset(
    """
    the of and to in is that it for was on are as with at be by this have from or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum
    le la les de des et un une du en est que qui dans pour pas au sur ne se ce il par plus avec sont mais ou son aux cette elle nous vous ils ont
    el los las y que en un una por con no para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también
    il lo gli di che è per non una sono con del della dei nel alla si da come anche ma più questo
    o os da do em um uma não com para se na no dos das ao como mais foi são pelo
    het een van ik te dat die niet zijn op aan met er maar om ook als dan voor bij nog naar
    och att det som på är av för med den till inte har ett om men var jag
    og det er til på av ikke som med har jeg af ved fra men
    nie się na że jest do jak ale po co tak za od już był przez dla
    ve bir bu da de için ile çok ne ama gibi daha var kadar
    и в не на что с по это как к но из у за от так же для бы
    και το να του η της με που την από για είναι στο τα δεν οι τον
    """.split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
# What stands in a tag behind its name, by the quotes that are still known to be closed.
_WITHIN = {
    "\"'": re.compile(r"(?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+"),
    '"': re.compile(r"(?:[^\">]|\"[^\"]*+\")*+"),
    "'": re.compile(r"(?:[^'>]|'[^']*+')*+"),
    "": re.compile(r"[^>]*+"),
}
# A tag that ends itself; a slash at the end of a bare value belongs to the value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
# Parts of a class name, whether joined by marks or by capitals.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page, whatever stands in it.
RAW = frozenset("script style noscript template svg iframe object textarea select title".split())
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button".split())
#: Elements, and names, that may as well go around a whole page.
WRAPPERS = frozenset("form fieldset".split())
LAYOUT = frozenset("sidebar sidebars menu menus nav navbar navigation masthead modal popup".split())
#: Names of what readers write, and parts of a name that only tell whether they may.
COMMENTS = frozenset("comment comments commentlist disqus replies responses".split())
STATES = frozenset("open closed enabled disabled has no with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion".split())
#: Names that say boilerplate wherever they stand, and those that only do so outside an article.
STRONG = ADVERTS | frozenset("cookie cookies consent gdpr notice notices notification notifications sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus share sharing newsletter subscribe subscription signup login popup modal pagination pager dropdown related".split())
WEAK = frozenset("banner social recommended widget widgets toolbar topbar overlay skip alert alerts announcement copyright legal crumbs discussion respond feedback header".split())
#: Names that go with any of these without a meaning of their own; those of the article itself besides.
NEUTRAL = frozenset("box boxes block section list container wrapper wrap area bar row col column item items inner outer top bottom left right center main site page global primary secondary body text links buttons button icons form field group panel slot unit trail thread bottombar mobile desktop small large sticky fixed js posts articles stories entries news".split())
ARTICLE = frozenset("article post entry story content".split())
TOP = frozenset(("html", "head", "body", "article", "main"))


#: What a mark on an element means: nothing, a part that may go around the page, a part that is boilerplate.
FREE, SOFT, HARD = 0, 1, 2


def _parts(name: str) -> set[str]:
    return {p.lower() for p in _PART.findall(name)}


def _comments(names: str) -> bool:
    """Whether one of the names is that of readers' comments, by any of its parts."""
    return any(parts & COMMENTS and len(parts) <= 3 and not parts & STATES for parts in map(_parts, names.split()))


def _named(names: str) -> tuple[int, bool, bool]:
    """What a class or id says wherever it stands, whether it says advert, and whether it says boilerplate outside an article."""
    mark, advert, weak, article = FREE, False, False, False
    for parts in map(_parts, names.split()):
        if not parts or not parts <= STRONG | WEAK | NEUTRAL | ARTICLE:
            continue
        advert = advert or bool(parts & ADVERTS)
        weak = weak or bool(parts & WEAK) and not parts & ARTICLE
        article = article or bool(parts & ARTICLE) and not parts & (STRONG | WEAK)
        mark = max(mark, HARD if parts & STRONG - LAYOUT else SOFT if parts & LAYOUT else FREE)
    if _comments(names):
        mark = HARD
    # Beside the article's own name, a layout's name tells what else is on the page.
    return FREE if mark == SOFT and article else mark, advert, weak


def _mark(tag: str, attrs: str, in_article: bool) -> int:
    if tag in BOILERPLATE:
        return HARD
    values = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs else {}
    if tag in TOP:
        return HARD if tag == "article" and _comments(values.get("class", "")) else FREE
    if tag == "header":
        return FREE if in_article else HARD
    mark = SOFT if tag in WRAPPERS else FREE
    if not values:
        return mark
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden") == "true" or "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower():
        return HARD
    # A heading's id is made of its own words.
    said, advert, weak = _named(values.get("class", "") + ("" if tag in HEADINGS else f" {values.get('id', '')}"))
    if tag in INLINE:
        # Within a line only adverts are told by name.
        return HARD if advert else FREE
    return max(mark, said, HARD if weak and not in_article else FREE)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags, comments and the like in page order, as (start, end, tag or nothing, closes, attributes).

    Whoever takes them may send the place to go on at.
    """
    at, quotes = 0, "\"'"
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        tag, closes, attrs = "", False, ""
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(page)
        elif m := _NAME.match(page, at):
            tag, closes = m[2].lower(), bool(m[1])
            at = m.end()
            while (end := _WITHIN[quotes].match(page, at).end()) < len(page) and page[end] != ">":
                # This quote is closed nowhere: no later one of its kind is, either.
                quotes = quotes.replace(page[end], "")
            if end == len(page) and (plain := page.find(">", at)) >= 0:
                end, quotes = plain, ""
            attrs = page[at:end]
            at = min(end + 1, len(page))
        elif page[at : at + 1] in ("!", "?", "/"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        else:
            continue
        to = yield start, at, tag, closes, attrs
        at = at if to is None else to


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters of it in links, stands in boilerplate, stands in an article, is a heading) of each block that has text."""
    return _read(page)[0]


def _read(page: str) -> tuple[list[tuple[str, int, bool, bool, bool]], list[bool | None]]:
    """The blocks of a page, and what the first pass says of each."""
    found: list[tuple[str, int, bool, bool, bool]] = []
    # The innermost part of each block that may go around the page; of each such part the one around it, and whether an article or a page's heading is in it.
    within: list[int] = []
    around: list[int] = []
    holds: list[bool] = []
    # Tag, boilerplate, such part, article, left out of its line: all but the tag with what is around.
    stack: list[tuple[str, bool, int, bool, bool]] = []
    bottom = ("", False, -1, False, False)
    opened: dict[str, int] = {}
    parts: list[str] = []
    unclosed: set[str] = set()
    linked, links, at, breaks = 0, 0, 0, 0

    def pop(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1

    def push(entry: tuple[str, bool, int, bool, bool]) -> None:
        stack.append(entry)
        opened[entry[0]] = opened.get(entry[0], 0) + 1

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                tag, bad, part, article, _ = next((e for e in reversed(stack) if not e[4]), bottom)
                # A paragraph of an article may be one link.
                found.append((text, 0 if article and tag == "p" and _long(text) else linked, bad, article, tag in HEADINGS))
                within.append(part)
        parts, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked, breaks
        if piece and not (stack and stack[-1][4]):
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                linked += len(piece) if links else 0

    def behind(tag: str, at: int) -> int:
        """Where a raw element opened before `at` ends. An unclosed one is only a tag; what follows code or a title up to the next tag is its own."""
        if tag not in unclosed:
            if end := _CLOSE[tag].search(page, at):
                return end.end()
            unclosed.add(tag)
        if tag in ("script", "style", "title"):
            at = page.find("<", at)
        return at if at >= 0 else len(page)

    tags = _tags(page)
    step = next(tags, None)
    while step is not None:
        start, end, tag, closes, attrs = step
        text(page[at:start])
        at = end
        if tag in RAW and not closes:
            if not _EMPTY.search(attrs):
                at = behind(tag, at)
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif tag:
            if tag not in INLINE:
                close()
                # What is left out of a line ends with it.
                while stack and stack[-1][4]:
                    pop(len(stack) - 1)
            if tag == "a":
                links = max(0, links - 1) if closes else links + 1
            _, bad, part, article, out = stack[-1] if stack else bottom
            if closes:
                if opened.get(tag):
                    pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in INLINE:
                if out or _mark(tag, attrs, article):
                    push((tag, bad, part, article, True))
            elif tag not in VOID:
                # A paragraph ends where another block begins, a list item or table cell where the next one does.
                if stack and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                if stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    pop(len(stack) - 1)
                _, bad, part, article, _ = stack[-1] if stack else bottom
                if not attrs.endswith("/") or tag in ("div", "p"):
                    mark = _mark(tag, attrs, article)
                    if mark == SOFT and not bad:
                        around.append(part)
                        holds.append(False)
                        part = len(around) - 1
                    if part >= 0 and tag in ("article", "main", "h1"):
                        holds[part] = True
                    push((tag, bad or mark == HARD, part, article or tag in ("article", "main"), False))
        try:
            step = tags.send(at)
        except StopIteration:
            step = None
    text(page[at:])
    close()
    return _settled(found, within, around, holds)


def _settled(found: list[tuple[str, int, bool, bool, bool]], within: list[int], around: list[int], holds: list[bool]) -> tuple[list[tuple[str, int, bool, bool, bool]], list[bool | None]]:
    """Blocks with what the parts that may go around the page, and its articles, make of them, and the first pass on each."""
    first = [_decided(text, linked, bad, heading) for text, linked, bad, _, heading in found]
    prose = [len(b[0]) if x else 0 for b, x in zip(found, first, strict=True)]
    if around:
        own, count = [0] * len(around), [0] * len(around)
        free, article = 0, 0
        for n, part, b in zip(prose, within, found, strict=True):
            if part < 0:
                free, article = free + n, article + n * b[3]
            else:
                own[part] += n
                count[part] += n > 0
        total = own[:]
        for k in range(len(around) - 1, -1, -1):
            if around[k] >= 0:
                total[around[k]] += total[k]
                count[around[k]] += count[k]
                holds[around[k]] = holds[around[k]] or holds[k]
        apart = []
        for k, outer in enumerate(around):
            stands = outer >= 0 and apart[outer] or total[k] <= 2 * free or not (holds[k] or count[k] > 1 and not article)
            apart.append(stands)
            if not stands:
                free += own[k]
        found = [(text, linked, bad or part >= 0 and apart[part], article, heading) for (text, linked, bad, article, heading), part in zip(found, within, strict=True)]
    inside = sum(n for n, b in zip(prose, found, strict=True) if b[3] and not b[2])
    outside = sum(n for n, b in zip(prose, found, strict=True) if not b[3] and not b[2])
    if 2 * inside > outside:
        found = [(text, linked, bad or not article, article, heading) for text, linked, bad, article, heading in found]
    return found, [x if not b[2] else False for b, x in zip(found, first, strict=True)]


def _long(text: str) -> bool:
    """Whether a block is long; a character of a script without blanks between words counts for three."""
    return len(text) + 2 * sum("\u2e80" <= c <= "\ud7ff" for c in text[:LONG]) >= LONG


def _prose(text: str) -> bool:
    """Whether a text is made of sentences, in whatever language."""
    return sum(c in ".!?;,:。！？、，．؟،।" for c in text) * 200 >= len(text)


def _decided(text: str, linked: int, bad: bool, heading: bool) -> bool | None:
    """The first pass on one block."""
    if bad:
        return False
    if heading:
        return None
    if linked > LINKS * len(text):
        return False
    if not _long(text):
        return None
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP for w in words)
    if stops:
        return True if stops >= STOP_WORDS * len(words) else None
    # Nothing is known of this language: length and sentences decide.
    return True if len(text) >= 2 * LONG and _prose(text) else None


def labels(found: list[tuple[str, int, bool, bool, bool]], first: list[bool | None] | None = None) -> list[bool]:
    """For each block, whether it is content; `first` is what the first pass said, if it was asked before."""
    first = first or [_decided(text, linked, bad, heading) for text, linked, bad, _, heading in found]
    if True not in first:
        # Nothing is content for sure, as on short pages in other languages: long blocks that aren't boilerplate are.
        first = [True if x is None and not b[4] and _long(b[0]) else x for x, b in zip(first, found, strict=True)]
    n = len(found)

    def nearest(order: range) -> list[tuple[int, bool | None]]:
        """For each block, the last one before it in this order that its text decided, as (distance, label)."""
        out: list[tuple[int, bool | None]] = [(0, None)] * n
        place, label, article, step = 0, None, False, order.step
        for k in order:
            if found[k][3] != article:
                # The edge of an article: content for what is inside, boilerplate for what is outside.
                article = found[k][3]
                place, label = k - step, article
            out[k] = (abs(k - place), label)
            if first[k] is not None and not found[k][2]:
                place, label = k, first[k]
        return out

    out = []
    for k, (before, after) in enumerate(zip(nearest(range(n)), nearest(range(n - 1, -1, -1)), strict=True)):
        known = sorted((x for x in (before, after) if x[1] is not None), key=lambda x: (x[0], x[1] != found[k][3]))
        out.append(first[k] if first[k] is not None else bool(known and known[0][1]))
    return out


def main_text(page: str | None) -> str:
    found, first = _read(page or "")
    return "\n\n".join(b[0] for b, good in zip(found, labels(found, first), strict=True) if good)


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text, n_chars of each row."""

    def made(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([main_text(t) for t in texts], dtype=object)

    rows = pages.select(*[F.col(c) for c in keep], F.pandas_udf(made, "string")(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
