"""From documents to provisions: profiles for markup and for plain text."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.markup import SKIP, Rendered, assemble, collapse, inline, render
from palimpsest.operators.markup import local as _local

SCHEMA = "doc_key string, seq int, anchor string, ptype string, num string, heading string, path string, text string, citations array<struct<href:string,text:string>>, md_start int, md_end int, profile string"
_ARTICLE = r"(?im)^[ \t]*(?:#+[ \t]*)?((?:article|artikel|art\.)[ \t]+\d+(?:[ \t]?(?:er|re|bis|ter|quater))?)\b"


def unique_anchors(rows: list[dict]) -> list[dict]:
    """Repeated anchors of a document get ``__2``, ``__3`` and so on."""
    seen: dict[str, int] = {}
    held = {r["anchor"] for r in rows}
    for r in rows:
        n = seen[r["anchor"]] = seen.get(r["anchor"], 0) + 1
        if n > 1:
            while (name := f"{r['anchor']}__{n}") in held:
                n += 1
            held.add(name)
            r["anchor"] = name
    return rows


def _provision(anchor: str, ptype: str, num: str | None, heading: str | None, path, node, skip=()) -> dict:
    body = render(node, Rendered(), skip)
    return {"anchor": anchor, "ptype": ptype, "num": num or None, "heading": heading or None, "path": " / ".join(path) or None, "text": body.text, "citations": body.citations, "notes": body.notes}


def akn(source: str) -> list[dict]:
    """Akoma Ntoso: one provision per ``article`` or annex, path from the containers around it.

    A document without either is one provision of its whole body.
    """
    rows: list[dict] = []
    containers = ("book", "part", "title", "chapter", "section", "subsection")

    def walk(node, path: tuple[str, ...]) -> None:
        name = _local(node.tag)
        heads = [c for c in node if _local(c.tag) in ("num", "heading")]
        own = {_local(c.tag): inline(c, Rendered(), plain=True) for c in heads}
        if name in ("article", "attachment", "annex"):
            number = re.sub(r"(?i)^(article|art\.)\s*", "", own.get("num", ""))
            kind = "article" if name == "article" else "annex"
            anchor = node.get("eId") or node.get("id") or f"{'art' if kind == 'article' else 'anx'}_{re.sub(r'[^0-9a-z]+', '', number.lower()) or len(rows) + 1}"
            rows.append(_provision(anchor, kind, number, own.get("heading"), path, node, heads))
            return
        if name in containers:
            path = (*path, collapse(" ".join(x for x in (own.get("num"), own.get("heading")) if x)) or name)
        for child in node:
            walk(child, path)

    root = ET.fromstring(source)
    walk(root, ())
    if not rows:
        body = next((e for e in root.iter() if _local(e.tag) in ("body", "mainBody")), root)
        whole = _provision("document", "document", None, None, (), body)
        rows = [whole] if whole["text"] else []
    return unique_anchors(rows)


_SAME_TWICE = re.compile(r"""(\s([\w.-]+:[\w.-]+)=("[^"]*"|'[^']*'))\s\2=\3""")


def repaired(source: str) -> str:
    """A document with its one attribute that is given twice alike given once; as it is if there is none or several."""
    found = _SAME_TWICE.findall(source)
    return _SAME_TWICE.sub(r"\1", source) if len(found) == 1 else source


def formex(source: str) -> list[dict]:
    """Formex: ``ARTICLE`` and annexes in document order; notes, preamble and contents are left out."""
    rows: list[dict] = []

    def walk(node, path: tuple[str, ...]) -> None:
        name = _local(node.tag)
        if name in SKIP:
            return
        if name in ("ARTICLE", "ANNEX", "CONS.ANNEX"):
            heads = [c for c in node if _local(c.tag) in ("TI.ART", "STI.ART", "TITLE")]
            titles = {_local(c.tag): inline(c, Rendered(), plain=True) for c in heads}
            kind, label = ("article", titles.get("TI.ART")) if name == "ARTICLE" else ("annex", titles.get("TITLE"))
            number = re.sub(r"(?i)^(article|annex|annexe|anhang)\s*", "", label or "")
            ident = (node.get("IDENTIFIER") or number or str(len(rows) + 1)).lstrip("0").lower()
            anchor = f"{'art' if kind == 'article' else 'anx'}_{re.sub(r'[^0-9a-z]+', '_', ident)}"
            rows.append(_provision(anchor, kind, label if kind == "article" else None, titles.get("STI.ART") if kind == "article" else label, path, node, heads))
            return
        if name == "DIVISION":
            title = next((c for c in node if _local(c.tag) == "TITLE"), None)
            parts = [inline(t, Rendered(), plain=True) for t in (title if title is not None else ()) if _local(t.tag) in ("TI", "STI")]
            label = " — ".join(p for p in parts if p) or (inline(title, Rendered(), plain=True) if title is not None else "")
            path = (*path, label) if label else path
        for child in node:
            walk(child, path)

    walk(ET.fromstring(source), ())
    return unique_anchors(rows)


def wrapped(source: str) -> list[dict]:
    """Pages whose articles and annexes stand in subdivisions of their own, the outermost of which count."""
    root = ET.fromstring(source)
    rows: list[dict] = []

    def first(node, kind: str):
        return next((e for e in node.iter() if kind in (e.get("class") or "").split()), None)

    def walk(node, path: tuple[str, ...]) -> None:
        ident, kinds = node.get("id") or "", (node.get("class") or "").split()
        if _local(node.tag) == "div":
            if "eli-subdivision" in kinds and ident.startswith(("art_", "anx")):
                heads = [h for h in (first(node, "title-article-norm"), first(node, "stitle-article-norm")) if h is not None]
                titles = {h.get("class").split()[0]: inline(h, Rendered(), plain=True) for h in heads}
                rows.append(_provision(ident, "annex" if ident.startswith("anx") else "article", titles.get("title-article-norm"), titles.get("stitle-article-norm"), path, node, heads))
                return
            if ident.startswith(("cpt_", "sct_")):
                titles = [inline(c, Rendered(), plain=True) for c in node if _local(c.tag) == "p" and "title-division" in (c.get("class") or "")]
                if any(titles):
                    path = (*path, " — ".join(t for t in titles if t))
        for child in node:
            walk(child, path)

    walk(root, ())
    return unique_anchors(rows)


class _Flat(HTMLParser):
    """Blocks of a page in order, as (class of the block, tag, text, id); tolerant of bad markup."""

    BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "table", "ul", "ol", "section", "article", "br", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = [["", "", "", ""]]
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in self.BLOCKS:
            self.blocks.append([a.get("class") or "", tag, "", a.get("id") or ""])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.blocks.append(["", "", "", ""])

    def handle_data(self, data):
        if not self.hidden:
            self.blocks[-1][2] += data


def page(source: str) -> list[dict]:
    """HTML in its flat form: titles of articles open provisions, titles of divisions set the path.

    A title is a block of class ``title-article-norm`` or a heading that names an article;
    what comes before the first one is dropped.
    """
    reader = _Flat()
    reader.feed(source)
    rows: list[dict] = []
    path = ["", ""]
    for kind, tag, raw, ident in reader.blocks:
        text = collapse(raw)
        if not text and not ident:
            continue
        head = re.match(r"(?i)(?:article|artikel|art\.)\s+(\d+\s?(?:er|re|bis|ter|quater)?)\b\s*[—–\-:.]*\s*(.*)", text)
        if "title-division" in kind:
            level = 1 if kind.rstrip().endswith("2") else 0
            path[level:] = [text] + [""] * (1 - level)
        elif "title-annex" in kind:
            path = ["", ""]
            rows.append({"anchor": f"anx_{sum(r['ptype'] == 'annex' for r in rows) + 1}", "ptype": "annex", "num": None, "heading": text, "path": None, "text": ""})
        elif head and ("title-article" in kind or tag[:1] == "h"):
            number = head[1].replace(" ", "")
            rows.append({"anchor": f"art_{number}", "ptype": "article", "num": collapse(text[: head.end(1)]) if "title-article" in kind else number, "heading": head[2] or None, "path": " / ".join(p for p in path if p) or None, "text": ""})
        elif rows and "stitle-article" in kind:
            rows[-1]["heading"] = text
        elif rows and text:
            rows[-1]["text"] = f"{rows[-1]['text']}\n\n{text}".strip()
    return unique_anchors(rows)


def plain(source: str) -> list[dict]:
    """Plain text: heads of articles at the start of a line cut it; annexes likewise."""
    cuts = list(re.finditer(_ARTICLE, source))
    rows = []
    for m, end in zip(cuts, [*(c.start() for c in cuts[1:]), len(source)]):
        head, _, body = source[m.end() : end].partition("\n")
        number = re.sub(r"\s", "", re.sub(r"(?i)^(article|artikel|art\.)\s+", "", m[1]))
        rows.append({"anchor": f"art_{number.lower()}", "ptype": "article", "num": number, "heading": collapse(head.strip(" —–-:.\t")) or None, "path": None, "text": body.strip()})
    return unique_anchors(rows)


# Names of months, French.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")


def squeeze(text: str) -> tuple[str, list[int]]:
    """A text in lower case without accents and white space, and where each character was."""
    out, at = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFD", c.lower()):
            if not d.isspace() and not unicodedata.combining(d):
                out.append(d)
                at.append(i)
    return "".join(out), at


def gazette_window(issue: str, kind: str, date: str) -> str | None:
    """The part of a gazette issue that is one act, found by its form and date.

    The first day of a month is spelled ``1er``.  A place counts only if the first article
    after it is Article 1; the window ends where another act's heading begins.
    """
    year, month, day = date.split("-")
    spelled = f"{'1er' if int(day) == 1 else int(day)} {MONTHS[int(month) - 1]} {year}"
    text, at = squeeze(issue)
    for needle in (squeeze(f"{kind} du {spelled}")[0], squeeze(spelled)[0]):
        place = text.find(needle)
        while place >= 0:
            start = at[place]
            head = re.search(r"(?im)^[ \t]*art(?:icle|\.)\s*(\d+)", issue[start:])
            if head and head[1] == "1":
                other = re.search(r"(?im)^[ \t]*(?:loi|r[eè]glement(?: grand-ducal)?|arr[eê]t[eé]) du \d", issue[start + head.end() :])
                return issue[start : start + head.end() + other.start()] if other else issue[start:]
            place = text.find(needle, place + 1)
    return None


def whole(source: str) -> list[dict]:
    """The fallback: one provision of all the text, or none if there is no text."""
    reader = _Flat()
    reader.feed(source)
    text = collapse(" ".join(b[2] for b in reader.blocks))
    return [{"anchor": "document", "ptype": "document", "num": None, "heading": None, "path": None, "text": text}] if text else []


#: Characters in which the name of the format of an Akoma Ntoso document is looked for.
SNIFFED = 16_384


def extract(source: str | None) -> tuple[str, list[dict]]:
    """The profile that fits a document, and its provisions.

    Akoma Ntoso is told by its head, the others by their elements.  Markup that does not
    parse is repaired if one attribute stands in it twice, and else read as a page; an
    undeclared prefix of links is no error.  A document without provisions is one provision
    as a whole.  Null and empty documents have none.
    """
    if not source or not source.strip():
        return "none", []
    tries = []
    if "akomantoso" in source[:SNIFFED].lower():
        tries += [("akn", akn), ("akn-repaired", lambda x: akn(repaired(x)))]
    elif re.search(r"<(?:ACT|CONS\.ACT|CONS\.DOC|ARTICLE|ANNEX)\b", source):
        tries.append(("formex", formex))
    if re.search(r"(?i)<(?:html|body|div|p|h[1-6])\b", source):
        tries.append(("wrapped", wrapped))
        if "xlink:" in source and "xmlns:xlink" not in source:
            tries.append(("wrapped-xlink", lambda x: wrapped(re.sub(r"\bxlink:(?=\w+=)", "", x))))
        tries.append(("page", page))
    tries += [("plain", plain), ("whole", whole)]
    for name, profile in tries:
        try:
            rows = profile(source)
        except ET.ParseError:
            continue
        if rows:
            return name, rows
    return "none", []


def better(first: list[dict], second: list[dict]) -> list[dict]:
    """Of two extractions the second only if it has text in strictly more provisions."""
    held = [sum(bool((r["text"] or "").strip()) for r in rows) for rows in (first, second)]
    return second if held[1] > held[0] else first


_HEAD = re.compile(r"(?i)^[ \t]*(?:art(?:icle|ikel|\.))\s*(\d+|1er|premier)\b")


def _title_words(title: str | None) -> list[str]:
    return list(dict.fromkeys(squeeze(w)[0] for w in re.findall(r"[^\W\d_]{5,}", title or "")))


def _matches_title(window: str, words: list[str]) -> bool:
    held = [w for w in words if w in window]
    return len(words) >= 3 and len(held) >= 2 and sum(map(len, held)) >= 15 and max(map(len, held)) >= 8


def gazette_by_title(lines: list[str], title: str | None, near: int = 120, window: int = 4) -> list[dict]:
    """The act of a gazette issue whose heading has the distinctive words of a title.

    A heading may run over a few lines; Article 1 must follow within ``near`` lines.  Of
    several headings the last that such an article follows counts.  If article numbers
    repeat, as when an act and its annex both count from one, the act is one provision.
    """
    words, folded = _title_words(title), [squeeze(x)[0] for x in lines]
    starts = [i for i in range(len(lines)) if _matches_title("".join(folded[i : i + window]), words)]
    for i in reversed(starts):
        first = next((j for j in range(i, min(len(lines), i + near)) if _HEAD.match(lines[j])), None)
        if first is None or _HEAD.match(lines[first])[1].lower() not in ("1", "1er", "premier"):
            continue
        rows = plain("\n".join(lines[first:]))
        numbers = [r["num"] for r in rows]
        if len(numbers) == len(set(numbers)):
            return rows
        text = "\n".join(lines[i:]).strip()
        return [{"anchor": "document", "ptype": "document", "num": None, "heading": None, "path": None, "text": text}]
    return []


def extract_provisions(df: DataFrame, key: str, body: str) -> DataFrame:
    """Provisions of every document with their links and places in its Markdown, in one pass by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_key", "seq", "anchor", "ptype", "num", "heading", "path", "text", "citations", "md_start", "md_end", "profile"]
        for batch in batches:
            out = []
            for k, source in zip(batch["k"], batch["b"]):
                profile, rows = extract(source)
                assemble(rows)
                out += [(k, i, r["anchor"], r["ptype"], r["num"], r["heading"], r["path"], r["text"], r.get("citations") or [], r["md_start"], r["md_end"], profile) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=names)

    return df.select(F.col(key).cast("string").alias("k"), F.col(body).cast("string").alias("b")).mapInPandas(run, SCHEMA)


def article_segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, seq, num, chars``: plain texts cut at heads of articles, within the row.

    A mark is set before every head and the text split at it: no Python, no shuffle.
    """
    marked = F.regexp_replace(F.col(text), r"(?m)^((?:Article|Artikel) \d+)", "\x01$1")
    rows = df.select(key, F.posexplode(F.split(marked, "\x01")).alias("seq", "part")).where("seq > 0")
    num = F.regexp_extract("part", r"^(?:Article|Artikel) (\d+)", 1)
    return rows.select(key, F.col("seq").cast("long").alias("seq"), num.alias("num"), F.length("part").cast("long").alias("chars"))


def page_furniture(pages: DataFrame, issue: str, page_id: str, text: str, least_pages: int = 4) -> DataFrame:
    """Lines that stand on more than half of an issue's pages: its running heads and feet.

    Lines longer than eight characters, digits alike; issues of at least four pages.
    """
    count = pages.where(F.col(issue).isNotNull()).groupBy(issue).agg(F.countDistinct(page_id).alias("pages")).where(F.col("pages") >= least_pages)
    line = F.trim(F.regexp_replace(F.regexp_replace("line", r"\d", "#"), r"\s+", " "))
    rows = pages.select(issue, page_id, F.explode_outer(F.split(text, "\n")).alias("line")).where("line is not null").select(issue, page_id, line.alias("line")).where(F.length("line") > 8)
    on = rows.groupBy(issue, "line").agg(F.countDistinct(page_id).alias("on_pages"))
    return on.join(count, issue).where(F.col("on_pages") * 2 > F.col("pages"))


def emptiness(provisions: DataFrame, empty: Column) -> DataFrame:
    """``rid, total, empty, mostly``: of each version its provisions, the empty ones, and whether these are half or more."""
    rows = provisions.groupBy("rid").agg(F.count(F.lit(1)).alias("total"), F.sum(empty.cast("long")).alias("empty"))
    return rows.withColumn("mostly", F.col("empty") * 100 >= F.col("total") * 50)


def mostly_empty(provisions: DataFrame, empty: Column) -> DataFrame:
    """Versions of whose provisions at least half are empty."""
    return emptiness(provisions, empty).where("mostly").drop("mostly")


def more_empty_than_before(now: DataFrame, before: DataFrame, signature: list[str]) -> DataFrame:
    """``signature, now, before``: empty provisions of which there are more than in the baseline, counted by signature."""
    counts = [df.groupBy(*signature).agg(F.count(F.lit(1)).alias(n)) for df, n in ((now, "now"), (before, "before"))]
    rows = counts[0].join(counts[1], signature, "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return rows.where("now > before")


def covering_manifestation(files: DataFrame, bodies: DataFrame, by: list[str], whole: str, others: dict[str, int], kind: str = "format") -> DataFrame:
    """``by, name, kind``: the manifestation that a version is read from.

    ``files`` has the columns ``by``, kind, name, size and part, the body that it covers;
    ``bodies`` the parts of each version.  The ``whole`` kind counts only if it covers every
    part; else the others come in their order, the largest first, then by name.
    """
    covered = files.where(F.col(kind) == whole).select(*by, "part").distinct()
    lacking = bodies.select(*by, "part").distinct().join(covered, [*by, "part"], "left_anti").select(*by).distinct()
    usable = files.where(F.col(kind) == whole).join(lacking, by, "left_anti").unionByName(files.where(F.col(kind) != whole))
    return preferred_manifestation(usable, by, {whole: 0} | {k: v + 1 for k, v in others.items()}, kind)


def preferred_manifestation(rows: DataFrame, by: list[str], priority: dict[str, int], kind: str = "format") -> DataFrame:
    """Of each group the manifestation of the first kind in the order of precedence, then the largest, then by name."""
    rank = F.lit(len(priority))
    for name, place in priority.items():
        rank = F.when(F.col(kind) == name, place).otherwise(rank)
    best = F.min(F.struct(rank.alias("p"), (-F.col("size")).alias("s"), "name", kind))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.name").alias("name"), F.col(f"b.{kind}").alias(kind))
