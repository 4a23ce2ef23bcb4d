"""Markup of documents as Markdown: blocks, emphasis, links, lists and tables, whatever names a format gives them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

# Element names of the three formats, by what they mean for the text.
SKIP = {"eop", "mod", "NOTE", "script", "style", "head", "PREAMBLE", "TOC", "GR.CONSID", "CONSID"}
PARAGRAPH = {"p", "heading", "P", "TXT", "TI", "STI", "h1", "h2", "h3", "h4", "h5", "h6", "caption"}
NUMBERED = {"paragraph": "num", "PARAG": "NO.PARAG", "NP": "NO.P"}
LISTS = {"ol", "ul", "LIST"}
ITEMS = {"li", "ITEM"}
TABLES, ROWS, CELLS = {"table", "TBL"}, {"tr", "ROW"}, {"td", "th", "CELL"}
STRONG, EMPHASIS, LINKS = {"b", "strong"}, {"i", "em"}, {"ref", "a"}
#: Elements of inline text; any other element begins a block of its own.
INLINE = STRONG | EMPHASIS | LINKS | {"span", "sup", "sub", "docNumber", "docTitle", "docDate", "HT", "QUOT.START", "QUOT.END", "DATE", "REF.DOC.OJ", "IE", "br", "u", "small", "num", "NO.P", "NO.PARAG", "term", "def", "date"}


def collapse(text: str) -> str:
    return " ".join(text.split())


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


@dataclass
class Rendered:
    """The Markdown of an element, the links in it and how many notes were left out."""

    blocks: list[str] = field(default_factory=list)
    citations: list[tuple[str | None, str]] = field(default_factory=list)
    notes: int = 0

    @property
    def text(self) -> str:
        return "\n\n".join(b for b in self.blocks if b)


def inline(node, out: Rendered, plain: bool = False) -> str:
    """The text of an element in one line; emphasis is marked, links are noted and give their text."""
    parts: list[str] = []

    def walk(e) -> None:
        name = local(e.tag)
        mark = "" if plain else "**" if name in STRONG or e.get("TYPE") == "BOLD" else "*" if name in EMPHASIS or e.get("TYPE") == "ITALIC" else ""
        if name in SKIP or not name:
            out.notes += name == "NOTE"
        elif name in ("QUOT.START", "QUOT.END"):
            parts.append(chr(int(e.get("CODE") or "0020", 16)))
        elif name == "br":
            parts.append(" ")
        elif name in LINKS:
            text = collapse("".join(e.itertext()))
            out.citations.append((e.get("href"), text))
            if "modref" not in (e.get("class") or ""):
                parts.append(text)
        else:
            parts.append(mark)
            parts.append(e.text or "")
            for child in e:
                walk(child)
            parts.append(mark)
        parts.append(e.tail or "")

    parts.append(node.text or "")
    for child in node:
        walk(child)
    return collapse("".join(parts))


def table(node, out: Rendered) -> str:
    """A pipe table; rows are filled up to the widest, bars in cells are escaped."""
    rows = []
    for row in node.iter():
        if local(row.tag) in ROWS:
            cells = [inline(c, out).replace("|", "\\|") for c in row if local(c.tag) in CELLS]
            if cells:
                rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def render(node, out: Rendered, skip: tuple = ()) -> Rendered:
    """The blocks of an element's children, in order; ``skip`` are elements that stand for something else."""
    loose: list = []  # inline text between blocks

    def flush() -> None:
        if loose:
            holder = ET.Element("p")
            for x in loose:
                if not isinstance(x, str):
                    holder.append(x)
                elif len(holder):
                    holder[-1].tail = (holder[-1].tail or "") + x
                else:
                    holder.text = (holder.text or "") + x
            loose.clear()
            text = inline(holder, out)
            if text:
                out.blocks.append(text)

    if (node.text or "").strip():
        loose.append(node.text)
    for child in node:
        name = local(child.tag)
        tail = child.tail or ""
        if any(child is s for s in skip) or name in SKIP or not name:
            out.notes += name == "NOTE"
        elif name in INLINE:
            bare = ET.Element(child.tag, child.attrib)
            bare.text = child.text
            bare.extend(list(child))
            loose.append(bare)
        else:
            flush()
            block(child, name, out)
        if tail.strip():
            loose.append(tail)
    flush()
    return out


def block(node, name: str, out: Rendered) -> None:
    if name in PARAGRAPH and not any(local(c.tag) in LISTS | TABLES for c in node):
        text = inline(node, out)
        if text:
            out.blocks.append(text)
    elif name in TABLES:
        text = table(node, out)
        if text:
            out.blocks.append(text)
    elif name in LISTS:
        lines = []
        for i, item in enumerate((c for c in node if local(c.tag) in ITEMS), 1):
            inner = render(item, Rendered(citations=out.citations))
            out.notes += inner.notes
            marker = f"{i}. " if name == "ol" else "- " if name == "ul" else ""
            lines.append(marker + " ".join(inner.blocks))
        if lines:
            out.blocks.append("\n".join(lines))
    elif name in NUMBERED:
        number = next((c for c in node if local(c.tag) == NUMBERED[name]), None)
        inner = render(node, Rendered(citations=out.citations), skip=(number,) if number is not None else ())
        out.notes += inner.notes
        label = inline(number, out, plain=True) if number is not None else ""
        if label and inner.blocks:
            label = label if name == "NP" else f"**{label}**"
            if inner.blocks[0].startswith(("|", "-", "1.")) and name != "NP":
                inner.blocks.insert(0, label)
            else:
                inner.blocks[0] = f"{label} {inner.blocks[0]}"
        out.blocks += inner.blocks
    else:
        inner = render(node, Rendered(citations=out.citations))
        out.notes += inner.notes
        out.blocks += inner.blocks


def assemble(rows: list[dict]) -> str:
    """The Markdown of a document's provisions; each gets ``md_start`` and ``md_end``, in code points.

    Headings of a path stand where it changes, from the second level to the fifth.
    """
    parts: list[str] = []
    size, before = 0, []

    def add(text: str) -> None:
        nonlocal size
        parts.append(text)
        size += len(text)

    for r in rows:
        path = (r["path"] or "").split(" / ") if r["path"] else []
        for i, heading in enumerate(path):
            if before[: i + 1] != path[: i + 1]:
                add(f"{'#' * min(2 + i, 5)} {heading}\n\n")
        before = path
        title = " — ".join(x for x in (r["num"], r["heading"]) if x)
        if title:
            add(f"{'#' * min(2 + len(path), 6)} {title}\n\n")
        r["md_start"] = size
        add(r["text"])
        r["md_end"] = size
        add("\n\n")
    return "".join(parts)
