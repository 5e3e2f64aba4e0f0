"""One page to markdown, in one walk from the innermost elements out.

Each storage element has a rule that makes items of what its children made; HTML elements have theirs in `markdown`. All
that a page needs to know of other tables comes with its row: which file a reference means, which files are there, users'
names, and which picture and source stand for a diagram.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from leafmill.functions.names import attachment_name
from leafmill.functions.render import markdown as M
from leafmill.functions.render.markdown import BLOCK, ITEM, LIST, TEXT, Items
from leafmill.functions.render.tree import Node, parse

# What emoticon names and short names stand for.
EMOTICONS = {
    "tick": "✅",
    "cross": "❌",
    "warning": "⚠️",
    "information": "ℹ️",
    "plus": "➕",
    "minus": "➖",
    "question": "❓",
    "light-on": "💡",
    "light-off": "💡",
    "yellow-star": "⭐",
    "red-star": "⭐",
    "green-star": "⭐",
    "blue-star": "⭐",
    "heart": "❤️",
    "thumbs-up": "👍",
    "thumbs-down": "👎",
    "smile": "🙂",
    "sad": "🙁",
    "cheeky": "😜",
    "laugh": "😄",
    "wink": "😉",
    "check_mark": "✅",
    "cross_mark": "❌",
    "info": "ℹ️",
}

MACROS = ("ac:structured-macro", "ac:adf-extension")
DECISION_LISTS, DECISION_ITEMS = ("decisionList", "decision-list"), ("decisionItem", "decision-item")
#: Macros that show a file, and those that show a diagram, by name.
FILES = ("view-file", "viewpdf", "viewppt", "viewxls", "multimedia")
DIAGRAMS = ("drawio", "inc-drawio", "drawio-sketch")


@dataclass
class Page:
    """What comes with a page's row."""

    files: Mapping[tuple[str, str], str] = field(default_factory=dict)  # (name, attachment id) to local name
    listed: list[tuple[str, str]] = field(default_factory=list)  # titles and local names of its attachments
    available: frozenset[str] = frozenset()
    users: Mapping[str, str] = field(default_factory=dict)
    diagrams: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # name to picture and source, '' for none
    handlers: Mapping[str, Handler] = field(default_factory=dict)  # of this run, before the own ones


Handler = Callable[["Macro", Page], "list[Node | str] | Items"]


def label(value: str) -> str:
    return re.sub(r"[\[\]()\r\n]", "", value)


def media_url(name: str) -> str:
    return ".media/" + urllib.parse.quote(name, safe="")


def safe_url(url: str) -> str:
    """'' for schemes other than http, https and mailto; else with what may break a link encoded."""
    url = url.strip()
    if re.match(r"[^/]*:", url) and not re.match(r"(?i)https?://|mailto:", url):
        return ""
    return re.sub(r"[^\w:/?#\[\]@!$&'*+,;=~.%-]+", lambda m: urllib.parse.quote(m[0]), url, flags=re.A)


def reference(node: Node) -> tuple[str, str]:
    """Name and attachment id that an attachment reference gives."""
    ids = (node.get(f"ri:{a}") for a in ("content-id", "contentid", "attachment-id", "attachmentid", "id"))
    return node.get("ri:filename").strip(), next(filter(None, ids), "")


def shown_file(page: Page, ref: tuple[str, str], said: str, *, picture: bool = False) -> Items:
    """A link to a page's file or the picture itself, or a note that it is missing."""
    local = page.files.get(ref) or attachment_name(ref[0])
    if local not in page.available:
        return M.text(f"Missing attachment: {label(said)}")
    return [(TEXT, f"![{label(said)}]({media_url(local)})")] if picture else M.link(media_url(local), M.escaped(label(said)))


def user(page: Page, account: str) -> str:
    return page.users.get(account) or account


# Rules of storage elements: node, items of its children, page.


def _emoticon(node: Node, items: Items, page: Page) -> Items:
    own = node.get("ac:emoji-fallback").strip()
    if re.fullmatch(r":.*:|:", own):
        own = ""
    node.said = EMOTICONS.get(node.get("ac:name")) or EMOTICONS.get(node.get("ac:emoji-shortname").strip(":")) or own
    return M.text(node.said)


def _time(node: Node, items: Items, page: Page) -> Items:
    node.said = node.get("datetime")
    return M.text(node.said)


def _mention(node: Node, items: Items, page: Page) -> Items:
    node.said = "@" + user(page, node.get("ri:account-id"))
    return M.text(node.said)


def _image(node: Node, items: Items, page: Page) -> Items:
    file, url = node.find("ri:attachment"), node.find("ri:url")
    if file is not None and reference(file)[0]:
        return shown_file(page, reference(file), reference(file)[0], picture=True)
    src = safe_url(url.get("ri:value")) if url is not None else ""
    return [(TEXT, f"![]({src})")] if src else []


def _link(node: Node, items: Items, page: Page) -> Items:
    parts = {k.tag: k for k in reversed(list(node.walk()))}
    body = parts.get("ac:plain-text-link-body") or parts.get("ac:link-body")
    said = body.text().strip() if body is not None else ""
    if "ri:attachment" in parts and (ref := reference(parts["ri:attachment"]))[0]:
        return shown_file(page, ref, said or ref[0])
    if "ri:url" in parts and (to := safe_url(parts["ri:url"].get("ri:value"))):
        return M.link(to, M.escaped(label(said or to)))
    if "ri:page" in parts and not (body is not None and body.elements()):
        return M.text(said or parts["ri:page"].get("ri:content-title") or "Link")
    return items


def _task_items(items: Items, mark: str) -> Items:
    """An item's own words behind its mark, then the lists that stood among them."""
    items = M.spread(items)
    own = [i for i in items if i[0] != LIST]
    return [(ITEM, M.body([(TEXT, mark), *own, *[i for i in items if i[0] == LIST]]))]


def _task(node: Node, items: Items, page: Page) -> Items:
    status, body = node.child("ac:task-status"), node.child("ac:task-body")
    done = status is not None and status.text().strip() == "complete"
    inside = [i for k in node.elements() if k.tag not in ("ac:task-status", "ac:task-id", "ac:task-uuid") for i in k.items or []]
    if body is not None and not body.elements():
        inside = [*M.text(body.text().strip()), *[i for i in inside if i[0] == LIST]]
    return _task_items(inside, "[x] " if done else "[ ] ")


def _decisions(node: Node, items: Items, page: Page) -> Items:
    items = M.spread(items)
    if node.get("type") in DECISION_LISTS:
        return M.listing(items, False)
    if node.get("type") in DECISION_ITEMS:
        own = M.flat([i for i in items if i[0] not in (LIST, ITEM)])
        if not own:
            return [i for i in items if i[0] in (LIST, ITEM)]
        decided = node.get("state").strip().upper() == "DECIDED"
        return _task_items([(TEXT, own), *[i for i in items if i[0] == LIST]], "✓ " if decided else "")
    return items


def _task_list(node: Node, items: Items, page: Page) -> Items:
    return M.listing([i for i in M.spread(items) if i[0] != TEXT], False)


def _nothing(node: Node, items: Items, page: Page) -> Items:
    return []


Rule = Callable[[Node, Items, Page], Items]
RULES: dict[str, Rule] = {
    "ac:emoticon": _emoticon,
    "time": _time,
    "ri:user": _mention,
    "ac:image": _image,
    "ac:link": _link,
    "ac:task": _task,
    "ac:task-list": _task_list,
    "ac:adf-node": _decisions,
    **dict.fromkeys(("ac:placeholder", "ac:adf-fallback", "ac:adf-attribute", "ac:adf-mark"), _nothing),
}


# Macros.

HANDLERS: dict[str, Handler] = {}


def register(*names: str) -> Callable[[Handler], Handler]:
    """Makes a function the handler of macros of these names; a later one takes its place."""

    def keep(f: Handler) -> Handler:
        HANDLERS.update(dict.fromkeys(names, f))
        return f

    return keep


class Macro:
    """A macro's own name, parameters and bodies, none of them from macros inside it."""

    def __init__(self, node: Node):
        self.node, self.name = node, node.get("ac:name")
        self.param_nodes = [k for k in node.elements() if k.tag == "ac:parameter"]
        self.params = {p.get("ac:name"): p.text().strip() for p in self.param_nodes}
        self.rich = node.child("ac:rich-text-body")
        plain = node.child("ac:plain-text-body")
        self.plain = plain.text() if plain is not None else None

    def unwrapped(self) -> Items:
        """What stands in the macro, but for its parameters."""
        return [i for k in self.node.kids for i in (M.text(k) if isinstance(k, str) else [] if k.tag == "ac:parameter" else k.items or [])]

    def body(self) -> Items:
        return self.rich.items or [] if self.rich is not None else self.unwrapped()

    def file(self) -> tuple[str, str]:
        """The file a macro names: by a reference in it, or by its name parameter."""
        ref = self.node.find("ri:attachment")
        return reference(ref) if ref is not None and reference(ref)[0] else (self.params.get("name", ""), "")

    def diagram(self) -> str:
        return self.file()[0] if self.name == "drawio-sketch" else self.params.get("diagramName") or "diagram"


def note(said: str) -> Items:
    return [(BLOCK, f"*{M.escaped(said)}*")]


def placeholder(macro: Macro) -> Items:
    """What a reader sees of a macro without content; its wording is a fixed value."""
    values = {p.get("ac:name"): next((n.get("ri:content-title") for n in p.walk() if n.tag == "ri:page"), p.text()).strip() for p in macro.param_nodes}
    known = ", ".join(f"{k}={v}" for k, v in values.items() if k and v)
    return note(f"[Confluence dynamic content: {macro.name or 'unnamed'}{f' ({known})' if known else ''}]")


@register("toc", "children", "pagetree")
def _dynamic(macro: Macro, page: Page) -> Items:
    return placeholder(macro)


@register("code")
def _code(macro: Macro, page: Page) -> Items:
    return M.fenced(macro.plain or "", macro.params.get("language", ""))


@register("panel", "info", "note", "warning", "tip")
def _panel(macro: Macro, page: Page) -> Items:
    return M.quote([(BLOCK, f"**{M.escaped(macro.params.get('title') or macro.name.capitalize())}**"), *macro.body()])


@register("expand")
def _expand(macro: Macro, page: Page) -> Items:
    return [*M.heading(4, M.text(macro.params.get("title") or "Details")), *macro.body()]


@register("status")
def _status(macro: Macro, page: Page) -> Items:
    return M.marked("**", M.text(macro.params.get("title", "")))


@register("jira")
def _issue(macro: Macro, page: Page) -> Items:
    return M.code(macro.params.get("key", ""))


@register(*FILES)
def _file(macro: Macro, page: Page) -> Items:
    ref = macro.file()
    if ref[0]:
        return shown_file(page, ref, ref[0])
    return placeholder(macro) if macro.name == "multimedia" else []


@register("widget")
def _widget(macro: Macro, page: Page) -> Items:
    url = safe_url(macro.params.get("url", ""))
    return M.link(url, M.escaped(label(url))) or placeholder(macro)


@register(*DIAGRAMS)
def _diagram(macro: Macro, page: Page) -> Items:
    name = macro.diagram()
    if not name:
        return note("[Draw.io sketch]")
    title = label(name.removesuffix(".drawio"))
    picture, source = page.diagrams.get(name, ("", ""))
    lines = [f"![{title}]({media_url(picture)})" if picture else note(f"[Draw.io diagram not rendered: {title}.drawio]")[0][1]]
    if source in page.available:
        lines.append(f"*Draw.io source: [{title}.drawio]({media_url(source)})*")
    return [(BLOCK, "  \n".join(lines))]


@register("profile")
def _profile(macro: Macro, page: Page) -> Items:
    account = next((n.get("ri:account-id") for n in macro.node.walk() if n.tag == "ri:user"), "")
    said = page.users.get(account) or (f"user:{account}" if account else "Unknown user")
    return [(ITEM, M.escaped(said))]


@register("profile-picture")
def _picture(macro: Macro, page: Page) -> Items:
    account = next((n.get("ri:account-id") for n in macro.node.walk() if n.tag == "ri:user"), "")
    return M.text("@" + user(page, account)) if account else []


@register("anchor")
def _anchor(macro: Macro, page: Page) -> Items:
    return []


@register("excerpt", "section", "column")
def _unwrapped(macro: Macro, page: Page) -> Items:
    return macro.unwrapped()


@register("attachments")
def _attachments(macro: Macro, page: Page) -> Items:
    have = [(title, M.link(media_url(local), M.escaped(label(title))) if local in page.available else M.text(f"Missing attachment: {label(title)}")) for title, local in page.listed]
    return M.listing([(ITEM, M.body(items)) for _, items in have], False)


def other(macro: Macro, page: Page) -> Items:
    """Macros nobody knows: the first body that they have, else what is wrapped in them, else a placeholder."""
    if macro.rich is not None and (macro.rich.elements() or macro.rich.text().strip()):
        return macro.rich.items or []
    if (macro.plain or "").strip():
        return M.text(macro.plain)
    wraps = macro.node.tag == "ac:adf-extension" or any(k.tag in MACROS for k in macro.node.walk())
    return macro.unwrapped() if wraps else placeholder(macro)


def made(node: Node, page: Page) -> Items:
    """A node's items, innermost nodes first; what is made already stays."""
    waiting = [(node, False)]
    while waiting:
        n, ready = waiting.pop()
        if n.items is not None:
            continue
        if not ready:
            waiting.append((n, True))
            waiting += [(k, False) for k in n.kids if isinstance(k, Node)]
            continue
        kids = n.elements()
        items = kids[0].items if len(n.kids) == len(kids) == 1 else [i for k in n.kids for i in (M.text(k) if isinstance(k, str) else k.items)]
        if n.tag in MACROS:
            handler = page.handlers.get(n.get("ac:name")) or HANDLERS.get(n.get("ac:name"), other)
            # A plug-in may return nodes and plain text.
            n.items = [i for x in handler(Macro(n), page) for i in (M.text(x) if isinstance(x, str) else made(x, page) if isinstance(x, Node) else [x])]
        elif n.tag in RULES:
            n.items = RULES[n.tag](n, items, page)
        else:
            n.items = M.RULES[n.tag](n, items) if n.tag in M.RULES else items
    return node.items


def render(heading: str, body: str, page: Page) -> str:
    """The page's markdown below its heading, unless it begins with that."""
    text, top = M.document(made(parse(body), page)), f"# {heading}"
    return text if text.startswith(top) else f"{top}\n\n{text}".strip()
