"""Word documents to HTML with the standard library: headings, paragraphs, lists, tables, links, images, emphasis."""

from __future__ import annotations

import base64
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
MAX_IMAGE = 10_000_000
REQUIRED = ("[Content_Types].xml", "word/document.xml")


class Reader:
    def __init__(self, content: bytes) -> None:
        self.zip, self.warnings = zipfile.ZipFile(io.BytesIO(content)), []
        missing = [p for p in REQUIRED if p not in self.zip.namelist()]
        if missing:
            raise ValueError(f"not a document: {missing}")
        self.rels = {r.get("Id"): r.get("Target") for r in self.part("word/_rels/document.xml.rels")}
        self.styles = {}
        for s in self.part("word/styles.xml").iter(f"{W}style") if self.has("word/styles.xml") else ():
            level, name = s.find(f"{W}pPr/{W}outlineLvl"), s.find(f"{W}name")
            self.styles[s.get(f"{W}styleId")] = (int(level.get(f"{W}val")) if level is not None else None, name.get(f"{W}val") if name is not None else "")
        self.ordered = self.numbering()

    def has(self, name: str) -> bool:
        return name in self.zip.namelist()

    def part(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name)) if self.has(name) else ElementTree.Element("none")

    def numbering(self) -> dict[tuple[str, str], bool]:
        """(numbering, level) to whether it counts."""
        root, formats, out = self.part("word/numbering.xml"), {}, {}
        for a in root.iter(f"{W}abstractNum"):
            for lvl in a.findall(f"{W}lvl"):
                fmt = lvl.find(f"{W}numFmt")
                formats[a.get(f"{W}abstractNumId"), lvl.get(f"{W}ilvl")] = fmt is not None and fmt.get(f"{W}val") != "bullet"
        for n in root.iter(f"{W}num"):
            a = n.find(f"{W}abstractNumId").get(f"{W}val")
            out |= {(n.get(f"{W}numId"), lvl): c for (x, lvl), c in formats.items() if x == a}
        return out

    def image(self, rid: str) -> str:
        target = "word/" + self.rels.get(rid, "").removeprefix("/word/")
        if not self.has(target) or self.zip.getinfo(target).file_size > MAX_IMAGE:
            self.warnings.append(f"image {rid} is missing or too large")
            return ""
        kind = target.rsplit(".", 1)[-1].lower().replace("jpg", "jpeg")
        return f'<img src="data:image/{kind};base64,{base64.b64encode(self.zip.read(target)).decode()}">'

    def run(self, r: ElementTree.Element) -> str:
        out = ""
        for x in r:
            if x.tag == f"{W}t":
                out += html.escape(x.text or "", quote=False)
            elif x.tag in (f"{W}br", f"{W}cr"):
                out += "<br>"
            elif x.tag == f"{W}tab":
                out += "\t"
            elif x.tag == f"{W}drawing":
                out += "".join(self.image(b.get(f"{R}embed")) for b in x.iter(f"{A}blip"))
        pr = r.find(f"{W}rPr")
        for name, tag in (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s")) if pr is not None and out else ():
            on = pr.find(f"{W}{name}")
            if on is not None and on.get(f"{W}val") not in ("0", "false", "none"):
                out = f"<{tag}>{out}</{tag}>"
        return out

    def inline(self, p: ElementTree.Element) -> str:
        out = ""
        for x in p:
            if x.tag == f"{W}r":
                out += self.run(x)
            elif x.tag == f"{W}hyperlink":
                inner = "".join(self.run(r) for r in x.iter(f"{W}r"))
                url = self.rels.get(x.get(f"{R}id"))
                out += f'<a href="{html.escape(url)}">{inner}</a>' if url else inner
        return out

    def heading(self, p: ElementTree.Element) -> int:
        """1 to 6, or 0: the outline level of the paragraph or its style, else the style's name."""
        pr = p.find(f"{W}pPr")
        if pr is None:
            return 0
        own, style = pr.find(f"{W}outlineLvl"), pr.find(f"{W}pStyle")
        if own is not None and int(own.get(f"{W}val")) < 9:
            return min(6, int(own.get(f"{W}val")) + 1)
        level, name = self.styles.get(style.get(f"{W}val"), (None, style.get(f"{W}val"))) if style is not None else (None, "")
        if level is not None and level < 9:
            return min(6, level + 1)
        if m := re.match(r"(?:heading|titre|überschrift|titolo|título|kop)\s*(\d)", name, re.IGNORECASE):
            return min(6, max(1, int(m[1])))
        return int(name.lower() == "title")

    def blocks(self, parent: ElementTree.Element) -> str:
        out, open_lists = [], []

        def close(to: int) -> None:
            while len(open_lists) > to:
                out.append(f"</{open_lists.pop()}>")

        for x in parent:
            num = x.find(f"{W}pPr/{W}numPr") if x.tag == f"{W}p" else None
            level = self.heading(x) if x.tag == f"{W}p" else 0
            if num is not None and not level and num.find(f"{W}numId") is not None:
                depth = num.find(f"{W}ilvl").get(f"{W}val") if num.find(f"{W}ilvl") is not None else "0"
                tag = "ol" if self.ordered.get((num.find(f"{W}numId").get(f"{W}val"), depth)) else "ul"
                close(int(depth) + 1)
                if len(open_lists) == int(depth) + 1 and open_lists[-1] != tag:
                    close(int(depth))
                while len(open_lists) <= int(depth):
                    out.append(f"<{tag}>")
                    open_lists.append(tag)
                out.append(f"<li>{self.inline(x)}</li>")
                continue
            close(0)
            if x.tag == f"{W}p":
                if inner := self.inline(x):
                    out.append(f"<h{level}>{inner}</h{level}>" if level else f"<p>{inner}</p>")
            elif x.tag == f"{W}tbl":
                out.append(self.table(x))
            elif x.tag in (f"{W}sdt", f"{W}sdtContent"):
                out.append(self.blocks(x))
        close(0)
        return "".join(out)

    def table(self, t: ElementTree.Element) -> str:
        rows = ""
        for r in t.findall(f"{W}tr"):
            cells = ""
            for c in r.findall(f"{W}tc"):
                merge, span = c.find(f"{W}tcPr/{W}vMerge"), c.find(f"{W}tcPr/{W}gridSpan")
                if merge is not None and merge.get(f"{W}val") != "restart":
                    continue
                cells += f"<td{f' colspan={chr(34)}{span.get(f'{W}val')}{chr(34)}' if span is not None else ''}>{self.blocks(c)}</td>"
            rows += f"<tr>{cells}</tr>"
        return f"<table>{rows}</table>"

    def html(self, body_only: bool = False) -> str:
        body = self.part("word/document.xml").find(f"{W}body")
        inner = self.blocks(body) if body is not None else ""
        return inner if body_only else f"<html><body>{inner}</body></html>"


def to_html(content: bytes, body_only: bool = False) -> tuple[str | None, list[str]]:
    try:
        r = Reader(content)
        return r.html(body_only), r.warnings
    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, [str(e)]


def html_of(files: DataFrame, name: str, content: str, body_only: bool = False) -> DataFrame:
    """``name, html, warnings`` of each document; an unreadable one has null and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *to_html(bytes(c), body_only)) for n, c in zip(b[name], b[content], strict=True)]
            yield pd.DataFrame(rows, columns=[name, "html", "warnings"])

    return files.select(name, content).mapInPandas(run, f"{name} {files.schema[name].dataType.simpleString()}, html string, warnings array<string>")
