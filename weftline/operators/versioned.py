"""Versioned documents as flat rows: one row per piece of information.

A document is ``{"title", "mother", "information": {id: piece}}``. A piece is a text (``contents``), a list of sections (``sections``, ids in order) or
the description of a file (``file``); it has ``title, abstract, refs`` (``{id: {"information", "detail", "analysis"}}``) and ``notes``. Version -1 is the
one being written. The functions here make, change and walk such documents; ``rows`` flattens them for Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.documents import Node, parse, parsed_rows
from weftline.operators.graph import written
from weftline.operators.special import load_yaml

ROWS = "information int, parent int, place int, kind string, title string, abstract string, contents string, refs string"


def new_id(taken: dict) -> int:
    """The first free id from the number of ids on."""
    i = len(taken)
    while i in taken:
        i += 1
    return i


def piece(title: str = "", abstract: str = "", **more: object) -> dict:
    return {"title": title, "abstract": abstract, "refs": {}, "notes": {}, "tasks": [], **more}


def empty(title: str = "") -> dict:
    return {"title": title, "mother": 0, "information": {0: piece(title, sections=[])}}


def kind_of(p: dict) -> str:
    return "sections" if "sections" in p else "file" if "file" in p else "text"


def leaves(doc: dict, start: int | None = None) -> list[int]:
    """Ids of the pieces below one that have no sections, in reading order."""
    i = doc["mother"] if start is None else start
    p = doc["information"][i]
    return [i] if kind_of(p) != "sections" else [x for s in p["sections"] for x in leaves(doc, s)]


def rows(doc: dict) -> list[tuple]:
    """``ROWS`` of a document: its section tree in reading order, then what no section holds."""
    info, out, seen = doc["information"], [], set()

    def put(i: int, parent: int | None, place: int) -> None:
        p = info[i]
        seen.add(i)
        out.append((i, parent, place, kind_of(p), p["title"], p["abstract"], p.get("contents") or p.get("file") or "", json.dumps(p["refs"], sort_keys=True, ensure_ascii=False)))
        for k, s in enumerate(p.get("sections", [])):
            if s in info and s not in seen:
                put(s, i, k)

    put(doc["mother"], None, 0)
    for i in sorted(info):
        if i not in seen:
            put(i, None, -1)
    return out


# pages


def heading_tree(text: str) -> list:
    """``[level, heading, body html, children]`` of a page's top elements: a heading holds what follows it up to the next one of its level or above."""
    root = parse(text)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    top: list = [0, "", "", []]
    trail = [top]
    for n in body.children:
        if isinstance(n, Node) and re.fullmatch(r"h[1-6]", n.tag):
            level = int(n.tag[1])
            while trail[-1][0] >= level:
                trail.pop()
            trail[-1][3].append([level, n.text().strip(), "", []])
            trail.append(trail[-1][3][-1])
        else:
            part = n if isinstance(n, str) else n.html()
            if part.strip():
                trail[-1][2] += part.strip()
    return top


def size_of(node: list) -> int:
    return len(node[1]) + len(node[2]) + sum(size_of(c) for c in node[3])


def flat_html(node: list) -> str:
    return node[2] + "".join(f"<h{c[0]}>{c[1]}</h{c[0]}>{flat_html(c)}" for c in node[3])


def from_page(text: str, least: int = 7500, instructions: str = "") -> dict:
    """A page as a versioned document: headings become sections, those below the second level with fewer than ``least`` characters one text each. Texts
    carry themselves as a template and a rewriting task."""
    tree = heading_tree(text)
    root = tree[3][0] if len(tree[3]) == 1 and not tree[2] else tree
    doc = empty(root[1])
    info = doc["information"]

    def put(node: list, parent: int, depth: int) -> None:
        i = new_id(info)
        if node[3] and (depth <= 1 or size_of(node) > least):
            info[i] = piece(node[1], node[1], sections=[])
            if node[2]:
                put([node[0] + 1, "", node[2], []], i, depth + 1)
            for c in node[3]:
                put(c, i, depth + 1)
        else:
            body = flat_html(node)
            info[i] = piece(node[1], f"<p><em>Template of this section.</em></p><hr>{body}", contents=body)
            info[i]["tasks"].append({"name": "rewrite", "params": {"references_mode": "allow", "additional_instructions": instructions}})
        info[parent]["sections"].append(i)

    if root[2]:
        put([1, "", root[2], []], 0, 1)
    for c in root[3]:
        put(c, 0, 1)
    return doc


def page_documents(df: DataFrame, key: str, field: str, least: int = 7500) -> DataFrame:
    """``key`` and ``ROWS`` of each page's versioned document."""
    return parsed_rows(df, key, field, lambda t: rows(from_page(t, least)), ROWS)


# changes

REFERENCE = re.compile(r'<reference\b[^>]*\brefid="(\d+)"[^>]*>.*?</reference>', re.DOTALL)


def with_mentions(text: str) -> str:
    """Mentions start with ``@ ``."""
    return re.sub(r"(<mention\b[^>]*>)(?!@ )([^<]+)(</mention>)", r"\1@ \2\3", text)


def repaired(text: str, known: set[int]) -> tuple[str, list[int]]:
    """The text without references to unknown ids, and the ids left in order."""
    out = REFERENCE.sub(lambda m: m[0] if int(m[1]) in known else "", text)
    return out, list(dict.fromkeys(int(x) for x in REFERENCE.findall(out)))


def digits(value: object) -> int | None:
    found = re.sub(r"\D", "", str(value))
    return int(found) if found else None


def change(doc: dict, information: int, action: str, contents: dict, params: dict) -> None:
    """One change in place: ``title``, ``text``, ``sections`` or ``bibliography``; others are an error."""
    info = doc["information"]
    p = info[information]
    if action == "title":
        p["title"] = contents["title"]
    elif action == "sections":
        if kind_of(p) != "sections":
            raise ValueError("not a list of sections")
        made = []
        for s in contents["sections"]:
            made.append(new_id(info))
            info[made[-1]] = piece(s["title"], s.get("expectations", ""), contents=s.get("contents", ""))
        p["sections"] = made
    elif action == "bibliography":
        if kind_of(p) != "sections":
            raise ValueError("not a list of sections")
        i = new_id(info)
        info[i] = piece(contents["bibliography_title"], "References", contents=contents["html_bibliography"])
        p["sections"] = [*p["sections"], i]
    elif action == "text":
        if params.get("act_on_title"):
            p["title"] = contents["title"]
        if params.get("act_on_expectations"):
            p["abstract"] = contents["html_expectations"]
        if params.get("act_on_contents"):
            p["contents"] = with_mentions(contents["html_content"])
        if params.get("act_on_comments"):
            for c in contents.get("comments", []):
                p["notes"][int(c["comment_id"])] = with_mentions(c["comment_html"])
        for r in contents.get("referencements") or []:
            ref, target = digits(r.get("refid")), digits(r.get("informationid"))
            if ref is None or target is None:
                continue
            if target not in info:
                p["refs"].pop(ref, None)
                continue
            p["refs"][ref] = {"information": target, "detail": str(r["position"]), "analysis": r["html_contents"]}
            if ref not in {int(x) for x in REFERENCE.findall(p["contents"])}:
                p["contents"] += f'<reference refid="{ref}">Reference {ref}</reference>'
        p["contents"], used = repaired(p["contents"], set(p["refs"]))
        p["refs"] = {r: p["refs"][r] for r in used}
    else:
        raise ValueError(f"unknown action {action}")


def merge(doc: dict, changes: Sequence[dict]) -> dict:
    """A document with all changes applied in order."""
    for c in changes:
        change(doc, c["information_id"], c["action"], c["contents"], c.get("params", {}))
    return doc


#: Tasks by the kind of the piece they act on.
TASKS = {
    "text": ("rewrite", "brush", "translate", "make_longer", "make_shorter", "rewrite_expectations", "provide_feedback"),
    "sections": ("sections_rewrite_expectations", "rebuild_sections", "sections_feedback", "sections_references", "write_bibliography"),
    "file": ("reference_style",),
}


def dispatch(doc: dict, task: dict, ask: Callable[[str], str]) -> dict:
    """The change that a task asks for: its prompt goes to ``ask``, whose JSON reply becomes the contents. A task that doesn't fit the piece is an error."""
    p = doc["information"][task["information_id"]]
    kind = kind_of(p)
    if task["name"] not in TASKS[kind]:
        raise ValueError(f"{task['name']} is no task of a piece of {kind}")
    extra = task.get("params", {}).get("additional_instructions", "")
    said = json.loads(ask(f"{task['name']}\n# {p['title']}\n{p['abstract']}\n{p.get('contents', '')}\n{extra}".strip()))
    if kind == "file":
        return {"information_id": task["information_id"], "action": "title", "contents": {"title": said["reference_entry"]}, "params": {}}
    if kind == "sections":
        return {"information_id": task["information_id"], "action": "bibliography" if task["name"] == "write_bibliography" else "sections", "contents": said, "params": {}}
    flags = {"act_on_title": "title" in said, "act_on_expectations": "html_expectations" in said, "act_on_contents": "html_content" in said, "act_on_comments": "comments" in said}
    return {"information_id": task["information_id"], "action": "text", "contents": said, "params": flags}


# plans

REF_TAG = re.compile(r"<ref (\d+)(?: *: *(\d+))? */?>")


def plan_of(text: str) -> dict | None:
    """The plan under ``document`` in a YAML text, or the YAML itself if it has a title; null for other texts."""
    got = load_yaml(text)
    got = got.get("document", got) if isinstance(got, dict) else None
    return got if isinstance(got, dict) and "title" in got else None


def ref_key(source: str, taken: dict) -> int:
    """A four-digit id made from a source, the next free one if it is taken."""
    i = int.from_bytes(hashlib.blake2b(source.encode(), digest_size=4).digest(), "little") % 9000
    while 1000 + i in taken:
        i = (i + 1) % 9000
    return 1000 + i


def from_plan(plan: dict, files: dict[int, str], to_html: Callable[[str], str] = lambda t: f"<p>{t}</p>") -> dict:
    """A plan as a versioned document. ``<ref a:b/>`` tags to known files become references with ids made from the tag; unknown ones go."""
    doc = {"title": plan.get("title", ""), "mother": 0, "information": {}}
    info = doc["information"]
    of_file = {}
    for f in sorted(files):
        of_file[f] = new_id(info)
        info[of_file[f]] = piece(files[f], file=str(f))

    def put(p: dict) -> int:
        kids = [put(s) for s in p.get("sections") or []]
        i = new_id(info)
        if kids:
            info[i] = piece(p.get("title", ""), p.get("abstract", ""), sections=kids)
            return i
        refs: dict[int, dict] = {}
        ids: dict[tuple, int] = {}

        def mark(m: re.Match) -> str:
            a, b = int(m[1]), m[2] or ""
            if a not in of_file:
                return ""
            if (a, b) not in ids:
                ids[a, b] = ref_key(f"{a}:{b}", refs)
                refs[ids[a, b]] = {"information": of_file[a], "detail": b, "analysis": files[a]}
            return f'<reference refid="{ids[a, b]}"></reference>'

        raw = p.get("text") if p.get("text") is not None else "\n".join(p.get("bullets") or [])
        marked = REF_TAG.sub(lambda m: f"\x01{m[0]}\x02", raw)
        html = "".join(mark(REF_TAG.match(x)) if REF_TAG.match(x) and k % 2 else x for k, x in enumerate(re.split(r"[\x01\x02]", marked)))
        info[i] = piece(p.get("title", ""), p.get("abstract", ""), contents=to_html(html))
        info[i]["refs"] = refs
        return i

    doc["mother"] = put(plan)
    return doc


def with_uuids(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """An adjacency table with new random ids. They are made once and written, so that nodes and parents agree whenever and however often the result is computed."""
    ids = written(nodes.select(F.col(node).alias("__old")).distinct().withColumn("__new", F.expr("uuid()")))
    up = ids.select(F.col("__old").alias("__up"), F.col("__new").alias("__new_up"))
    out = nodes.join(ids, nodes[node] == F.col("__old")).join(up, nodes[parent] == F.col("__up"), "left")
    return out.drop(node, parent, "__old", "__up").withColumnsRenamed({"__new": node, "__new_up": parent})


def with_knowledge(nodes: DataFrame, base: Column) -> DataFrame:
    """Every node of a plan points at the knowledge base."""
    return nodes.withColumn("knowledge", base)


# outlines matched to texts


def bare(text: str) -> str:
    return re.sub(r"[^a-zA-Z\s]", "", text).lower().strip()


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def match_titles(wanted: Sequence[str], found: Sequence[str]) -> list[int | None]:
    """For each wanted title the place of its line among those found, in order: longest titles first, unique equal ones, then the nearest, each only
    between the places of its matched neighbours."""
    plain, lines = [bare(x) for x in wanted], [bare(x) for x in found]
    at: list[int | None] = [None] * len(wanted)
    longest = sorted(range(len(wanted)), key=lambda i: -len(wanted[i]))

    def room(i: int) -> range:
        before = [x for x in at[:i] if x is not None]
        after = [x for x in at[i + 1 :] if x is not None]
        return range(max(before) + 1 if before else 0, min(after) if after else len(lines))

    for i in longest:
        same = [k for k in room(i) if lines[k] == plain[i]]
        if len(same) == 1:
            at[i] = same[0]
    for i in longest:
        if at[i] is None and len(room(i)):
            at[i] = min(room(i), key=lambda k: (edits(plain[i], lines[k]), k))
    return at


def from_outline(text: str, titles: Sequence[str]) -> dict:
    """A text cut at the lines that match an outline's titles, as a versioned document of one text per title."""
    lines = text.split("\n")
    doc = empty(titles[0] if titles else "")
    places = [(k, t) for k, t in zip(match_titles(titles, lines), titles, strict=True) if k is not None]
    for (k, t), nxt in zip(places, [*(p for p, _ in places[1:]), len(lines)], strict=True):
        i = new_id(doc["information"])
        doc["information"][i] = piece(t, t, contents="\n".join(lines[k + 1 : nxt]).strip())
        doc["information"][0]["sections"].append(i)
    return doc


# references and gap analysis


def referenced_chunks(leaves_refs: DataFrame, chunks: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """``leaf, document, chunk, rank``: for each leaf the chunks it names, then its best ranked ones, ``most`` in all and each once.

    ``leaves_refs`` has ``leaf, document, chunk`` (chunk null for a whole document), ``chunks`` ``document, chunk``, ``ranked`` ``leaf, chunk, sim``.
    """
    forced = leaves_refs.where("chunk IS NOT NULL").join(chunks, ["document", "chunk"], "left_semi").select("leaf", "document", "chunk", F.lit(0).alias("group"), F.lit(0.0).alias("sim"))
    inside = ranked.join(chunks, "chunk").join(leaves_refs.select("leaf", "document").distinct(), ["leaf", "document"], "left_semi")
    both = forced.unionByName(inside.select("leaf", "document", "chunk", F.lit(1).alias("group"), "sim"))
    first = both.groupBy("leaf", "document", "chunk").agg(F.min(F.struct("group", (-F.col("sim")).alias("away"))).alias("o"))
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy("o", "document", "chunk"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("leaf", "document", "chunk", "rank")


def mapped_sections(mapping: DataFrame, sections: DataFrame, pages: DataFrame, document: tuple[str, ...] = ("side",)) -> DataFrame:
    """``task, section, text`` and the columns of ``document``: the sections a task maps, each with the pages from its own up to the next section's.

    ``mapping`` has ``task, section``, ``sections`` ``section, page`` and ``pages`` ``page, text``, all with the columns of ``document``, which tell one document (or one
    side of a comparison) from others. Of sections that start on one page each has that page, and the last has those after it. A section without
    pages isn't in the result. Each page finds its section by a running value within its document, so no pairs of sections and pages are made.
    """
    keys = list(document)
    begun = sections.groupBy(*keys, "page").agg(F.array_sort(F.collect_set("section")).alias("begun"))
    both = pages.join(begun, [*keys, "page"], "full_outer")
    open_one = F.last(F.element_at("begun", -1), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("page"))
    held = both.withColumn("held", F.coalesce("begun", F.array(open_one))).where("text IS NOT NULL").select(*keys, "page", "text", F.explode("held").alias("section"))
    held = mapping.join(held.where("section IS NOT NULL"), [*keys, "section"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return held.groupBy("task", *keys, "section").agg(text.alias("text"))


def assembled(contents: DataFrame, document: str, path: str, text: str, to_html: Callable[[str], str], template: str = "<html><style>__CSS__</style>__HTML__</html>", css: str = "") -> DataFrame:
    """``document, html``: section texts joined in the order of their paths, made HTML and put into the template."""
    joined = contents.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, text))), lambda x: x[text]), "\n\n").alias("__body"))
    return parsed_rows(joined, document, "__body", lambda t: [(template.replace("__HTML__", to_html(t)).replace("__CSS__", css),)], "html string")


def walk(doc: dict) -> Iterator[tuple[int, int]]:
    """``depth, id`` of the section tree in reading order."""

    def go(i: int, depth: int) -> Iterator[tuple[int, int]]:
        yield depth, i
        for s in doc["information"][i].get("sections", []):
            yield from go(s, depth + 1)

    return go(doc["mother"], 0)


def rendered(doc: dict, focus: int | None = None) -> str:
    """The document as indented text; the focused piece is marked and shows its notes."""
    out = []
    for depth, i in walk(doc):
        p, pad = doc["information"][i], "  " * depth
        out.append(f"{pad}[{i}] {p['title']}{' <<<' if i == focus else ''}")
        if kind_of(p) == "text":
            out += [f"{pad}  {x}" for x in re.sub(r"<[^>]*>", " ", p["contents"]).split("\n") if x.strip()]
        if i == focus:
            out += [f"{pad}  (note {k}) {n}" for k, n in sorted(p["notes"].items())]
    return "\n".join(out)


def find_or_create(doc: dict, file: str, title: str = "") -> int:
    """The piece of a file, made if there is none."""
    for i, p in doc["information"].items():
        if p.get("file") == file:
            return i
    i = new_id(doc["information"])
    doc["information"][i] = piece(title, file=file)
    return i
