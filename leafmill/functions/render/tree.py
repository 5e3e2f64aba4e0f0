"""A small tree of a page, read by the standard library's parser. Nothing here recurses, so nesting may be of any depth."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Blocks before which an open paragraph ends.
BLOCKS = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that end when the next of their kind begins, and what such a search must not leave.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "ac:parameter": ("ac:parameter",), "ac:rich-text-body": ("ac:parameter",), "ac:plain-text-body": ("ac:parameter",)}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)
    #: What a rule has made of the node, and the text that it stands for in place of its children's.
    items: list[tuple[str, str]] | None = None
    said: str | None = None

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def text(self) -> str:
        out: list[str] = []
        waiting: list[Node | str] = [self]
        while waiting:
            k = waiting.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.said is not None:
                out.append(k.said)
            else:
                waiting += reversed(k.kids)
        return "".join(out)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        waiting = self.elements()[::-1]
        while waiting:
            k = waiting.pop()
            yield k
            waiting += k.elements()[::-1]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def child(self, *tags: str) -> Node | None:
        return next((k for k in self.elements() if k.tag in tags), None)


#: By tag, what its start ends without a word.
ENDING = {tag: (("p",) if tag in BLOCKS else ()) + SIBLINGS.get(tag, ()) for tag in {*BLOCKS, *SIBLINGS}}


class _Tree:
    """Makes nodes of tags and text as they come."""

    def __init__(self) -> None:
        self.open = [Node("")]
        self.counts: dict[str, int] = {}

    def _end(self, at: int) -> None:
        for node in self.open[at:]:
            self.counts[node.tag] -= 1
        del self.open[at:]

    def _end_before(self, tag: str) -> None:
        """Ends what a start of tag ends without a word: a paragraph in which only inline elements are open, an item before the next."""
        ending = ENDING.get(tag, ())
        if not any(self.counts.get(t) for t in ending):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in ending:
                self._end(at)
                if tag not in SIBLINGS or self.open[-1].tag not in ending:
                    return
            elif self.open[at].tag not in INLINE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_before(tag)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_before(tag)
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if self.counts.get(tag):
            self._end(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag))

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


class _Reader(_Tree, HTMLParser):
    def __init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)


#: A tag as most pages have them, with its attributes, or text without references; what else there is goes to the library's parser.
PLAIN = re.compile(r'<(?:([a-z][a-z0-9:-]*)((?: [a-z][a-z0-9:-]*="[^"<>&]*")*) ?(/?)|/([a-z][a-z0-9:-]*))>|([^<&]+)')
ATTRIBUTE = re.compile(r'([a-z][a-z0-9:-]*)="([^"]*)"')
#: Elements whose content the library's parser doesn't take for tags, in any of its versions.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


def _read_plain(html: str) -> Node | None:
    """The tree of a page of which all is PLAIN; None for others."""
    if "&" in html or "<!" in html:
        return None
    made, at = _Tree(), 0
    while at < len(html):
        m = PLAIN.match(html, at)
        if m is None:
            return None
        tag, attrs, empty, end, data = m.groups()
        if data is not None:
            made.handle_data(data)
        elif end is not None:
            made.handle_endtag(end)
        elif tag in RAW:
            return None
        else:
            (made.handle_startendtag if empty else made.handle_starttag)(tag, ATTRIBUTE.findall(attrs) if attrs else [])
        at = m.end()
    return made.open[0]


def parse(html: str) -> Node:
    plain = _read_plain(html)
    if plain is not None:
        return plain
    # CDATA becomes escaped text, whatever the parser's version makes of it.
    reader = _Reader()
    reader.feed(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: escape(m[1], quote=False), html, flags=re.S))
    reader.close()
    return reader.open[0]
