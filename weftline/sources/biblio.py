"""Bibliography formats: MEDLINE (nbib, pubmed) and RIS, read and written as typed rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source string, entry int, title string, abstract string, doi string, date string, journal string, full_entry_type string, authors array<string>, type array<string>, keywords array<string>, affiliations array<string>, full_entry map<string,array<string>>"
NAMES = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|int|array|map))", SCHEMA)]


def day(text: str) -> str | None:
    """An ISO date of ``2015 Oct 15``, ``2018 Jan`` or ``2015``; null for other forms such as month ranges."""
    text = " ".join(text.split())
    for form in ("%Y", "%Y %b", "%Y %b %d", "%Y/%m/%d", "%Y/%m/%d %H:%M", "%Y/%m"):
        try:
            return datetime.strptime(text.strip("/"), form).date().isoformat()
        except ValueError:
            continue
    return None


def medline(text: str) -> list[dict]:
    """Entries between blank lines; ``KEY - value`` lines, continued by lines of six spaces."""
    out = []
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n").strip()):
        tags: dict[str, list[str]] = {}
        for line in re.sub(r"\n {6}", " ", part).split("\n"):
            if m := re.match(r"([A-Z0-9]{2,4})\s*-\s?(.*)", line):
                tags.setdefault(m[1], []).append(m[2].strip())
        if not tags:
            continue
        one = lambda k: tags.get(k, [""])[0]
        dois = [v[: -len("[doi]")].strip() for v in tags.get("LID", []) + tags.get("AID", []) if v.endswith("[doi]")]
        when = day(one("DP")) or (day(tags["PHST"][0].split(" [")[0]) if "PHST" in tags else None)
        out.append({"title": one("TI"), "abstract": one("AB"), "doi": dois[0] if dois else "", "date": when, "journal": one("JT"), "full_entry_type": "medline", "authors": tags.get("AU", []), "type": tags.get("PT", []), "keywords": tags.get("MH", []) + tags.get("OT", []), "affiliations": tags.get("AD", []), "full_entry": tags})
    return out


def medline_text(entries: list[dict]) -> str:
    """Entries as MEDLINE text: the raw tags where they are kept, else the fields."""
    parts = []
    for e in entries:
        tags = e.get("full_entry") or {"TI": [e["title"]], "AB": [e["abstract"]], "LID": [f"{e['doi']} [doi]"], "DP": [datetime.fromisoformat(e["date"]).strftime("%Y %b %d")] if e.get("date") else [], "JT": [e["journal"]], "AU": e["authors"], "AD": e["affiliations"], "PT": e["type"], "OT": e["keywords"]}
        parts.append("\n".join(f"{k:<4}- {v}" for k, vs in tags.items() for v in vs if v))
    return "\n\n".join(parts)


#: RIS tags and the fields they fill. Editors and publishers have no field of their own and stay in ``full_entry``.
RIS = {
    "A1": "authors", "A2": "authors", "A3": "authors", "A4": "authors", "A5": "authors", "A6": "editor", "AB": "abstract", "AU": "authors", "BT": "title",
    "DA": "date", "DI": "doi", "DO": "doi", "DOI": "doi", "JF": "journal", "K1": "keywords", "KW": "keywords", "M3": "type", "N2": "abstract", "PB": "publisher",
    "T1": "title", "T2": "title", "T3": "title", "TI": "title", "U3": "date", "U4": "date", "Y1": "date",
}
#: Tags beyond those that this reader understands as well.
RIS_MORE = {"PY": "date", "JO": "journal", "AD": "affiliations"}
LISTS = ("authors", "type", "keywords", "affiliations")
#: Names of the RIS types.
RIS_TYPES = {
    "ABST": "Journal Article", "ADVS": "Audiovisual Material", "AGGR": "Aggregated Database", "ANCIENT": "Ancient Text", "ART": "Artwork", "BILL": "Bill (was Bill, Unenacted Bill)",
    "BLOG": "Blog", "BOOK": "Book", "CASE": "Case", "CHAP": "Book Section", "CHART": "Chart", "CLSWK": "Classical Work", "COMP": "Computer Program", "CONF": "Conference Proceedings",
    "CPAPER": "Conference Paper", "CTLG": "Catalog", "DATA": "Dataset (was Data File) AND Computer Program", "DBASE": "Online Database", "DICT": "Dictionary", "EBOOK": "Electronic Book",
    "ECHAP": "Electronic Book Section", "EDBOOK": "Edited Book", "EJOUR": "Electronic Article", "ELEC": "Web Page", "ENCYC": "Encyclopedia", "EQUA": "Equation", "FIGURE": "Figure",
    "GEN": "Generic", "GOVDOC": "Government Document", "GRNT": "Grant", "HEAR": "Hearing", "ICOMM": "Personal Communication", "INPR": "Journal Article", "INTV": "Interview",
    "JFULL": "Journal Article", "JOUR": "Journal Article", "LEGAL": "Legal Rule", "MANSCPT": "Manuscript", "MAP": "Map", "MGZN": "Magazine Article", "MPCT": "Film or Broadcast",
    "MULTI": "Online Multimedia", "MUSIC": "Music", "NEWS": "Newspaper Article", "PAMP": "Pamphlet", "PAT": "Patent", "PCOMM": "Personal Communication", "POD": "Podcast",
    "PRESS": "Press Release", "RPRT": "Report", "SER": "Serial", "SLIDE": "Audiovisual Material", "SOUND": "Audiovisual Material", "STAND": "Standard", "STAT": "Statute", "STD": "Generic",
    "THES": "Thesis", "UNBILL": "Bill (was Bill, Unenacted Bill)", "UNPB": "Unpublished Work", "UNPD": "Unpublished Work", "VIDEO": "Audiovisual Material", "WEB": "Web page",
}


def ris(text: str) -> list[dict]:
    """Entries up to ``ER  -``; lines without a tag continue the one before; repeated scalars keep the longest."""
    out = []
    for part in re.split(r"^ER  -.*$", text.replace("\r\n", "\n"), flags=re.MULTILINE):
        tags: list[tuple[str, str]] = []
        for line in part.split("\n"):
            if m := re.match(r"([A-Z][A-Z0-9]{1,2}) {1,2}- ?(.*)", line):
                tags.append((m[1], m[2].strip()))
            elif line.strip() and tags:
                tags[-1] = (tags[-1][0], f"{tags[-1][1]} {line.strip()}")
        if not tags:
            continue
        e: dict = {k: [] for k in LISTS} | dict.fromkeys(("title", "abstract", "doi", "date", "journal"), "") | {"full_entry_type": "ris", "full_entry": {}}
        for k, v in tags:
            e["full_entry"].setdefault(k, []).append(v)
            f = "type" if k == "TY" else RIS.get(k) or RIS_MORE.get(k)
            if f in LISTS:
                v = RIS_TYPES.get(v, v) if k == "TY" else v
                if v not in e[f]:
                    e[f].append(v)
            elif f in e and len(v) > len(e[f]):
                e[f] = v
        e["date"] = day(e["date"]) or None
        out.append(e)
    return out


def ris_text(entries: list[dict]) -> str:
    back = {"title": "TI", "abstract": "AB", "doi": "DO", "date": "PY", "journal": "JF", "authors": "AU", "keywords": "KW", "affiliations": "AD"}
    types = {v: k for k, v in reversed(RIS_TYPES.items())} | {"Journal Article": "JOUR", "Generic": "GEN"}
    parts = []
    for e in entries:
        lines = [f"TY  - {types.get((e['type'] or ['Generic'])[0], 'GEN')}"]
        for f, tag in back.items():
            values = e[f] if f in LISTS else [e[f]]
            lines += [f"{tag}  - {v.replace('-', '/') if f == 'date' else v}" for v in values if v]
        parts.append("\n".join([*lines, "ER  - "]))
    return "\n\n".join(parts) + "\n"


READERS = {"nbib": medline, "pubmed": medline, "ris": ris}


def entries(texts: DataFrame, name: str, text: str, kind: str) -> DataFrame:
    """One row per entry of each text."""
    parse = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, *(e[k] for k in NAMES[2:])) for n, t in zip(b[name], b[text], strict=True) if t is not None for i, e in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=NAMES)

    return texts.select(name, text).mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a folder or pattern, whole, as entries."""
    files = spark.read.option("wholetext", True).text(path).selectExpr("_metadata.file_path AS source", "value")
    return entries(files, "source", "value", kind)
