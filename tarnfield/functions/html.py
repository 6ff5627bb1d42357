"""HTML pages to Markdown records.

The standard parser's events build a small tree (an opening ``<p>``, list item
or table part closes what it implies). A page becomes a stream of typed blocks,
and one fold over that stream joins neighbours of a kind: code lines to one
fence, list items to one list, a caption to the image after it. Runs as an
Arrow function; nothing here is called per row by Spark itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS_P = frozenset("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol div section article body html td th li".split())

# Style classes of the help pages.
CODE_SPANS = frozenset("code command argument colName JSLNumber JSLString JSLOperatorName EquationVariables".split())
CODE_LINES = frozenset("code codeOutput S1SynObj S2Syn S3Syn S1alt2".split())
BULLETS = frozenset("N1bullet N2bullet N3bullet bullet".split())
BOLD_TERMS, PLAIN_TERMS = frozenset("defTerm defTermIndent S3Arg".split()), frozenset("defText defTextIndent S3ArgText".split())
CHROME = frozenset("ww_skin ww_skin_dropdown_arrow fa zmpFigTab".split())


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def nodes(self) -> Iterator["Node"]:
        """All elements inside, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.nodes()

    def elements(self, *names: str) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node) and (not names or c.name in names)]

    def first(self, test) -> "Node | None":
        return next((n for n in self.nodes() if test(n)), None)

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    def text(self, joint: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return joint.join(p for p in parts if p or not strip)

    def without(self, drop) -> "Node":
        return Node(self.name, self.attrs, [c if isinstance(c, str) else c.without(drop) for c in self.children if isinstance(c, str) or not drop(c)])


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def _close(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in CLOSES and tag != "p":
            self._close(CLOSES[tag], frozenset({"table", "ul", "ol", "dl"}))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].name == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(n.name == tag for n in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


# What plain pages consist of: text, end tags, start tags with quoted values.
_PLAIN = re.compile(r'([^<]+)|</([A-Za-z][A-Za-z0-9]*)>|<([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z_][A-Za-z0-9_-]*="[^"<>]*")*)>')
_ATTRIBUTE = re.compile(r'([A-Za-z_][A-Za-z0-9_-]*)="([^"]*)"')
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())  # their content is read in other ways


def _plain_tree(html: str) -> _Tree | None:
    """The tree of a page of plain parts, without the standard parser's steps for all others; None if it has any other part."""
    tree, at = _Tree(), 0
    while at < len(html):
        m = _PLAIN.match(html, at)
        if m is None:
            return None
        at = m.end()
        kind = m.lastindex
        if kind == 1:
            tree.handle_data(unescape(m[1]) if "&" in m[1] else m[1])
        elif kind == 2:
            tree.handle_endtag(m[2].lower())
        else:
            tag = m[3].lower()
            if tag in _RAW:
                return None
            tree.handle_starttag(tag, [(k.lower(), unescape(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(m[4])] if m[4] else [])
    return tree


def parse(html: str) -> Node:
    tree = _plain_tree(html or "")
    if tree is None:
        tree = _Tree()
        tree.feed(html)
        tree.close()
    return tree.root


def squeeze(text: str) -> str:
    return re.sub("[ \t ]+", " ", text).strip()


def image_source(src: str) -> str:
    return unquote(re.sub(r"^(\.\./)+", "", src.strip().replace("\\", "/")).lstrip("/"))


def inline(node: Node) -> str:
    """Inline Markdown of what a node holds, spaces squeezed."""
    return squeeze(_inline(node))


def _inline(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _marked(c) for c in node.children)


def _marked(n: Node) -> str:
    own = n.classes
    if n.name == "img" or (n.name in ("i", "svg") and "fa" in own) or (n.name == "span" and own & CHROME and not n.text().strip()):
        return ""
    text = _inline(n)
    mark = "**" if n.name in ("b", "strong") else "*" if n.name in ("i", "em") or (n.name == "span" and "BookTitle" in own and not own & CODE_SPANS) else "`" if n.name in ("code", "tt") or (n.name == "span" and own & CODE_SPANS) else ""
    if not mark:
        return text
    return f"{mark}{squeeze(text)}{mark}" if squeeze(text) else ""


def table_rows(table: Node) -> list[list[Node]]:
    rows = []
    for tr in (n for n in table.nodes() if n.name == "tr"):
        cells = tr.elements("th", "td") or [n for n in tr.nodes() if n.name in ("th", "td")]
        if cells:
            rows.append(cells)
    return rows


def table_markdown(table: Node) -> str:
    caption = table.first(lambda n: n.name == "caption")
    head = f"**{inline(caption)}**" if caption and inline(caption) else ""
    rows = [[inline(c).replace("|", "\\|") for c in cells] for cells in table_rows(table)]
    if not rows:
        return head
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "|" + "|".join(["---"] * width) + "|")
    return "\n".join(([head, ""] if head else []) + lines)


def is_nav(n: Node) -> bool:
    return any("TOC" in c for c in n.classes) or (n.name in ("h1", "h2", "h3") and "contents" in n.classes)


# --- blocks: (kind, text, extra) with kinds text, code, pre, figure title and image ---


def blocks(container: Node) -> Iterator[tuple[str, str, tuple]]:
    """Blocks of a container's elements in order; bare text between elements is dropped."""
    for n in container.elements():
        yield from _blocks_of(n)
    yield "end", "", ()


def _blocks_of(n: Node) -> Iterator[tuple[str, str, tuple]]:
    if is_nav(n) or n.name in ("script", "style", "noscript"):
        return
    if n.name in ("div", "section", "article"):
        yield from blocks(n)
    elif n.name == "table":
        yield "text", table_markdown(n), ()
    elif n.name in ("ul", "ol"):
        items = [inline(li) for li in n.elements("li")]
        yield "text", "\n".join(f"{i}. {t}" if n.name == "ol" else f"- {t}" for i, t in enumerate(items, 1) if t), ()
    elif n.name == "img":
        yield "image", "", (n,)
    elif re.fullmatch("h[1-6]", n.name):
        yield "text", f"{'#' * int(n.name[1])} {inline(n)}" if inline(n) else "", ()
    elif n.name == "pre":
        yield "pre", n.text("\n").strip("\n"), ()
    elif n.name == "p":
        yield from _paragraph(n)
    elif n.elements():
        yield from blocks(n)
    else:
        yield "text", inline(n), ()


def _paragraph(p: Node) -> Iterator[tuple[str, str, tuple]]:
    own = p.classes
    images = [n for n in p.nodes() if n.name == "img"]
    if "Figure_Title" in own:
        tab = p.first(lambda n: n.name == "span" and "zmpFigTab" in n.classes)
        yield "title", inline(p.without(lambda n: n is tab)), (squeeze(tab.text(" ")) if tab else "",)
        return
    if "figureContainer" in own or (images and not p.text().strip()):
        for n in images if "figureContainer" in own else images[:1]:
            yield "image", "", (n,)
        return
    text = inline(p)
    if not text:
        return
    if own & CODE_LINES:
        yield "code", squeeze(p.text(" ")), ()
    elif own & BOLD_TERMS:
        yield "text", f"**{text}**", ()
    elif own & PLAIN_TERMS:
        yield "text", text, ()
    elif own & BULLETS:
        depth = max([int(c[1]) - 1 for c in own if re.fullmatch(r"N\dbullet", c)], default=0)
        yield "text", f"{'  ' * depth}- {text}", ()
    elif "number" in own:
        yield "text", f"1. {text}", ()
    elif "Note" in own or p.first(lambda n: n.name == "span" and "Note" in n.classes):
        yield "text", "> **Note:** " + re.sub(r"^\s*(note|tip|caution|warning)\s*:\s*", "", text, flags=re.I), ()
    else:
        yield "text", text, ()


def rendered(container: Node, fence: str) -> tuple[str, list[dict]]:
    """(Markdown, figures) of a container."""
    out: list[str] = []
    kinds: list[str] = []
    figures: list[dict] = []
    lines: list[str] = []
    title: tuple[str, str] | None = None
    items = ("- ", "  - ", "1. ")

    def put(kind: str, text: str) -> None:
        text = text.rstrip()
        if not text:
            return
        if kind == "fence" and kinds and kinds[-1] == "fence":
            out[-1] += "\n" + text
        elif kind == "text" and out and kinds[-1] == "text" and text.startswith(items) and out[-1].startswith(items):
            out[-1] += "\n" + text
        else:
            out.append(text)
            kinds.append(kind)

    def flush() -> None:
        if lines:
            put("fence", "\n".join(lines))
            lines.clear()

    for kind, text, extra in blocks(container):
        if kind == "code":
            lines.append(text)
        elif kind == "title":
            title = (extra[0], text)
        elif kind == "image":
            img = extra[0]
            src = image_source(img.attrs.get("src", ""))
            if not src:
                continue
            alt = squeeze(img.attrs.get("alt") or img.attrs.get("title") or "")
            number, caption = title or ("", alt)
            title = None
            figures.append({"figure_id": number, "caption": caption or alt, "src": src, "alt": alt})
            flush()
            put("text", f"[FIGURE: {' - '.join(x for x in (number, caption or alt) if x) or src}]")
        elif kind == "pre":
            flush()
            put("fence", text if text.strip() else "")
        elif kind == "end" or text:
            flush()
            put("text", text)
    flush()
    parts = [f"```{fence}\n{t}\n```" if k == "fence" else t for k, t in zip(kinds, out, strict=True)]
    return re.sub(r"`([A-Za-z][\w ]*)`\s*\(\s*\)", r"`\1()`", "\n\n".join(parts).strip()), figures


def page_record(html: str, book_root: str, fence: str = "code") -> dict:
    """title, breadcrumb, published, prev, next, markdown, n_chars and figures of one page."""
    doc = parse(html)
    by = lambda name, **want: doc.first(lambda n: n.name == name and all(n.attrs.get(k) == v if k != "class_" else v in n.classes for k, v in want.items()))
    crumbs = by("div", class_="ww_skin_breadcrumbs")
    trail = [squeeze(x) for x in crumbs.text(">", strip=True).split(">") if squeeze(x)] if crumbs else []
    date = by("div", class_="ww_creation_date")

    def near(rel: str) -> str:
        link = doc.first(lambda n: n.name == "link" and n.attrs.get("rel") == rel)
        to = (link.attrs.get("href", "") if link else "").split("#")[0].strip()
        return f"{book_root}/{to}" if to else ""

    body = by("div", id="page_content") or by("div", id="page_content_container") or by("body") or doc
    dropped = set()
    for name in ("community-message", "page_dates"):
        node = body.first(lambda n, name=name: n.attrs.get("id") == name)
        if node:
            dropped.add(id(node))
    body = body.without(lambda n: id(n) in dropped or n.name == "footer" or is_nav(n))
    head = body.first(lambda n: n.name in ("h1", "h2", "h3"))
    markdown, figures = rendered(body, fence)
    return {
        "title": inline(head) if head else "",
        "breadcrumb": trail,
        "published": squeeze(date.text(" ")).replace("Publication date:", "").strip() if date else "",
        "prev": near("Prev"),
        "next": near("Next"),
        "markdown": markdown,
        "n_chars": len(markdown),
        "figures": figures,
    }


def menu_items(html: str) -> list[dict]:
    """menu, item, menu_path, description of each table row of a menu page."""
    doc = parse(html)
    clean = lambda n: re.sub(r"\s+", " ", n.text(" ")).strip()
    out = []
    content = doc.first(lambda n: n.attrs.get("id") == "page_content") or doc
    for table in (n for n in content.nodes() if n.name == "table"):
        caption = table.first(lambda n: n.name == "caption")
        menu = re.sub(r"\s*Menu$", "", clean(caption), flags=re.I) if caption else ""
        for tr in (n for n in table.nodes() if n.name == "tr" and menu):
            cells = [n for n in tr.nodes() if n.name in ("td", "th")]
            if len(cells) > 1 and clean(cells[0]) and clean(cells[0]).lower() != "item":
                out.append({"menu": menu, "item": clean(cells[0]), "menu_path": f"{menu} > {clean(cells[0])}", "description": clean(cells[1])})
    return out


def _target(href: str, book_root: str) -> tuple[str, str] | None:
    path, _, anchor = (href or "").strip().partition("#")
    return (path, anchor) if path.startswith(book_root + "/") and path.endswith(".shtml") else None


def toc_entries(html: str, book_root: str) -> list[dict]:
    """path, anchor, title, depth, order, is_folder of each line of a nested table of contents."""
    root = parse(html).first(lambda n: n.name == "div" and n.attrs.get("id", "").startswith("toc:"))
    if root is None:
        raise ValueError("no table of contents in the page")
    out: list[dict] = []
    pending = [(ul, 1) for ul in reversed(root.elements("ul"))]
    while pending:
        node, depth = pending.pop()
        if node.name == "ul":
            pending += [(li, depth) for li in reversed(node.elements("li"))]
            continue
        below = node.elements("ul")
        link = node.first(lambda n: n.name == "a" and "WebWorks_TOC_Link" in n.classes)
        to = _target(link.attrs.get("href", ""), book_root) if link else None
        if to:
            out.append({"path": to[0], "anchor": to[1], "title": link.text("", strip=True), "depth": depth, "order": len(out), "is_folder": bool(below)})
        pending += [(ul, depth + 1) for ul in reversed(below)]
    return out


def ui_entries(html: str, book_root: str) -> list[dict]:
    """pos, names (maybe several, by commas), key, path, anchor of each on-screen name of the help map."""
    out = []
    for a in parse(html).nodes():
        at = a.attrs.get("id", "")
        to = _target(a.attrs.get("href", ""), book_root) if a.name == "a" and at.startswith("topic:") else None
        if to:
            key = at.split(":", 2)[2] if at.count(":") > 1 else ""
            out.append({"pos": len(out), "names": a.text("", strip=True) or key.replace("_", " "), "key": key, "path": to[0], "anchor": to[1]})
    return out
