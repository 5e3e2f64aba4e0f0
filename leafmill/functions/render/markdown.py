"""HTML elements to markdown: ATX headings, * bullets, fenced code.

An element's rule makes items of its children's items, so each element is made once, innermost first. Items are pairs:
TEXT is a run within a line, BLOCK and LIST stand by themselves, ITEM, CELL and ROW wait for the list or table around them;
MANY holds a container's blocks as they are, so that deep nesting copies nothing, and TABLE rows of cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

from leafmill.functions.render.tree import BLOCKS, Node

TEXT, BLOCK, LIST, ITEM, CELL, ROW, MANY, TABLE = "text", "block", "list", "item", "cell", "row", "many", "table"
Items = list[tuple[str, "str | Items | list[list[str]]"]]
#: Lists and quotes are set in so many levels; those around them add their marks only.
LEVELS = 50


class Deep(str):
    """Text in which lists or quotes are nested so many levels."""

    levels = 0


def _deep(value: str, levels: int) -> Deep:
    out = Deep(value)
    out.levels = levels
    return out


def _levels(items: Items) -> int:
    return max((getattr(v, "levels", 0) for _, v in items), default=0)


def spread(items: Items, *, drawn: bool = True) -> Items:
    """Items without MANY and TABLE: what they hold stands in their place, a table drawn or as its cells' words."""
    out: Items = []
    waiting = items[::-1]
    while waiting:
        kind, value = waiting.pop()
        if kind == MANY:
            waiting += value[::-1]
        elif kind == TABLE:
            out.append((BLOCK, _drawn(value) if drawn else " ".join(c for row in value for c in row)))
        elif kind == ROW and not drawn:
            out.append((BLOCK, " ".join(value)))
        else:
            out.append((kind, value))
    return out


SPACE, MARKS = re.compile(r"\s+"), re.compile(r"([*_])")


def escaped(text: str) -> str:
    text = SPACE.sub(" ", text)
    return MARKS.sub(r"\\\1", text) if "*" in text or "_" in text else text


def text(value: str) -> Items:
    return [(TEXT, escaped(value))] if value else []


def blocks(items: Items) -> Items:
    """Items with runs of text made paragraphs, and items and rows without a list or table around them made one."""
    out: Items = []
    for kind, group in groupby(items, key=lambda i: i[0]):
        values = [v for _, v in group]
        if kind == TEXT:
            paragraph = "".join(values)
            paragraph = (re.sub(r"[ \t]*\n[ \t]*\n\s*", "\n\n", paragraph) if "\n" in paragraph else paragraph).strip()
            out += [(BLOCK, paragraph)] if paragraph else []
        elif kind == ITEM:
            out += listing([(ITEM, v) for v in values], ordered=False)
        elif kind == ROW:
            out += table([(ROW, v) for v in values])
        else:
            out += [(BLOCK if kind == CELL else kind, v) for v in values if v]
    return out


def container(items: Items) -> Items:
    """A block's contents as one item."""
    inside = blocks(items)
    return inside if len(inside) < 2 else [(MANY, inside)]


def flat(items: Items) -> str:
    """Items on one line."""
    runs = ["".join(v for _, v in group) if kind == TEXT else " ".join(v for _, v in group) for kind, group in groupby(spread(items, drawn=False), key=lambda i: i[0])]
    return re.sub(r"\s+", " ", " ".join(runs)).strip()


def _set_in(value: str, first: str, rest: str) -> str:
    """value with marks before its lines; what is set in deeply already only gets the first."""
    if _levels([(BLOCK, value)]) >= LEVELS:
        return first + value
    lines = value.split("\n")
    return "\n".join([first + lines[0].lstrip(" "), *[(rest + line if line else rest.rstrip()) for line in lines[1:]]])


def body(items: Items) -> str:
    """What stands in a list item."""
    parts = spread(blocks(items))
    out = "".join(("" if k == 0 else "\n" if kind == LIST else "\n\n") + value for k, (kind, value) in enumerate(parts))
    return _deep(out, _levels(parts))


def listing(items: Items, ordered: bool) -> Items:
    lines: list[str] = []
    items = spread(items)
    for kind, value in items:
        if kind == ITEM:
            mark = f"{len(lines) + 1}. " if ordered else "* "
            lines.append(_set_in(value, mark, " " * len(mark)))
        elif kind != TEXT and value:
            # A list right inside a list belongs to the item before it.
            lines.append(_set_in(value, "  ", "  "))
    return [(LIST, _deep("\n".join(lines), _levels(items) + 1))] if lines else []


def _drawn(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    shown = ["| " + " | ".join([c.replace("|", "\\|") for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]])


def table(items: Items) -> Items:
    items = spread(items)
    rows = [v for kind, v in items if kind == ROW and v]
    others = blocks([i for i in items if i[0] not in (ROW, TEXT)] if rows else items)
    return [*others, (TABLE, rows)] if rows else others


def quote(items: Items) -> Items:
    parts = spread(blocks(items))
    inside = _deep("\n\n".join(v for _, v in parts), _levels(parts))
    return [(BLOCK, _deep(_set_in(inside, "> ", "> "), _levels(parts) + 1))] if inside else []


def marked(mark: str, items: Items) -> Items:
    """Runs of text between marks; blocks stay as they are."""
    out: Items = []
    for kind, group in groupby(items, key=lambda i: i[0]):
        if kind != TEXT:
            out += group
            continue
        run = "".join(v for _, v in group)
        inner = run.strip()
        out.append((TEXT, run.replace(inner, f"{mark}{inner}{mark}", 1) if inner else run))
    return out


def heading(level: int, items: Items) -> Items:
    line = flat(items)
    return [(BLOCK, f"{'#' * level} {line}")] if line else []


def fenced(code: str, language: str = "") -> Items:
    return [(BLOCK, f"```{language}\n{code.strip(chr(10))}\n```")]


def code(value: str) -> Items:
    return [(TEXT, f"`{value}`")] if value else []


def link(href: str, label: str) -> Items:
    return [(TEXT, f"[{label}]({href})")] if label else []


def _pre(node: Node, items: Items) -> Items:
    inner = node.child("code")
    classes = inner.get("class") if inner is not None else ""
    return fenced(node.text(), classes.rpartition("language-")[2] if "language-" in classes else "")


Rule = Callable[[Node, Items], Items]
RULES: dict[str, Rule] = {
    **dict.fromkeys(("script", "style", "head", "title"), lambda node, items: []),
    **dict.fromkeys(BLOCKS, lambda node, items: container(items)),
    **{f"h{k}": lambda node, items, k=k: heading(k, items) for k in range(1, 7)},
    **dict.fromkeys(("b", "strong"), lambda node, items: marked("**", items)),
    **dict.fromkeys(("i", "em"), lambda node, items: marked("*", items)),
    **dict.fromkeys(("s", "del", "strike"), lambda node, items: marked("~~", items)),
    **dict.fromkeys(("code", "kbd", "samp"), lambda node, items: code(node.text())),
    **dict.fromkeys(("td", "th"), lambda node, items: [(CELL, flat(items))]),
    "tr": lambda node, items: [(ROW, [v for kind, v in items if kind == CELL])],
    **dict.fromkeys(("thead", "tbody", "tfoot"), lambda node, items: items),
    "table": lambda node, items: table(items),
    "ul": lambda node, items: listing(items, False),
    "ol": lambda node, items: listing(items, True),
    "li": lambda node, items: [(ITEM, body(items))],
    "blockquote": lambda node, items: quote(items),
    "pre": _pre,
    "hr": lambda node, items: [(BLOCK, "---")],
    "br": lambda node, items: [(TEXT, "  \n")],
    "img": lambda node, items: [(TEXT, f"![{node.get('alt')}]({node.get('src')})")],
    "a": lambda node, items: link(node.get("href"), flat(items)) if node.get("href") else items,
}


def document(items: Items) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(v for _, v in spread(blocks(items)))).strip()
