"""Pages cut at headings, heading levels, registered domains and mapped sections against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import hosts, page_sections, versioned


def split_page(html, limit):
    """Sections of a page by recursion: ``(path, letters, html)``."""
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", html or "")
    parts = [p for p in re.split(r"(?i)(?=<h[1-6][\s/>])", bare) if p] or [""]
    level = lambda p: int(m[1]) if (m := re.match(r"(?i)<h([1-6])[\s/>]", p)) else None
    head = lambda p: re.match(page_sections.HEADING, p)
    size = lambda p: len(re.sub(r"<[^>]*>|[ \t\r\n\f]+", "", p))
    title = lambda p: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", head(p)[1])).strip(" ") if head(p) else ""

    def go(own, path, top):
        inner = [level(p) for p in own[1:] if level(p)]
        if not inner or sum(map(size, own)) <= limit:
            text = "".join(own)
            if not top:
                text = re.sub(page_sections.HEADING, "", text)
            return [] if path and path[-1] == "" and text.strip(" ") == "" else [(path, sum(map(size, own)), text)]
        at = [i for i, p in enumerate(own) if i and level(p) == min(inner)]
        out = go(own[: at[0]], [*path, ""], top)
        for i, j in zip(at, [*at[1:], len(own)]):
            out += go(own[i:j], [*path, title(own[i])], False)
        return out

    return go(parts, [], True)


def random_page(rng):
    bits = ["<p>" + "x" * rng.randint(0, 30) + "</p>", "text & more ", "<script><h2>no</h2></script>", "<!-- <h1>no</h1> -->", "<hr>", "<h7>no</h7>", "<h2>unclosed "]
    heads = [f"<h{k}{a}>T{k} <b>{'é' * rng.randint(0, 4)}</b></h{k}>" for k in range(1, 7) for a in ("", ' id="a"')] + ["<H3>Up</H3>", "<h4></h4>"]
    return "".join(rng.choice(rng.choice([bits, heads])) for _ in range(rng.randint(0, 40)))


def test_sections_as_by_recursion(spark):
    rng = random.Random(7)
    pages = [(i, random_page(rng)) for i in range(150)] + [(900, None), (901, ""), (902, "no heading"), (903, "<h1>a</h1>"), (904, "x" + "<h2>t</h2>y" * 500)]
    df = spark.createDataFrame(pages, "id long, html string").withColumn("size", F.lit(-1))
    for limit in (0, 60, 10_000):
        got = {}
        for r in page_sections.page_sections(df, "id", "html", limit).orderBy("id", "section").collect():
            assert r.section == len(got.setdefault(r.id, []))
            got[r.id].append((list(r.path), r.size, r.html))
            if r.size > limit:
                rest = r.html if r.path else re.sub(r"(?is)^<h[1-6][\s/>]", "", r.html)
                unclosed = re.match(r"(?i)<h[1-6][\s/>]", rest)
                assert not re.search(r"(?i)<h[1-6][\s/>]", rest[1:] if unclosed else rest)
        for i, html in pages:
            assert got.get(i, []) == split_page(html, limit), (i, limit)


def test_sections_cut_markup_once_and_shuffle_narrow_rows(spark):
    df = page_sections.page_sections(spark.createDataFrame([(1, "<h1>a</h1>")], "id long, html string"), "id", "html", 10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan
    for line in plan.splitlines():
        assert "Window" not in line or "html" not in line


def mended(html, depth):
    used = sorted({int(x) for x in re.findall(r"(?i)<h([1-6])[\s/>]", html)})
    to, last = {}, depth
    for x in used:
        to[x] = last = min(max(x, last + 1), 6)
    return re.sub(r"(?i)<(/?)h([1-6])(?=[\s/>])", lambda m: f"<{m[1]}h{to.get(int(m[2]), m[2])}", html)


def test_levels_are_mended(spark):
    rng = random.Random(3)
    rows = [(random_page(rng), rng.randint(0, 6)) for _ in range(120)] + [("", 2), ("<h1>a</h1><h2>b</h2><h4>c</h4>", 1)]
    df = spark.createDataFrame(rows, "html string, depth int")
    for r in df.select("html", "depth", page_sections.mended_levels(F.col("html"), F.col("depth")).alias("out")).collect():
        assert r.out == mended(r.html, r.depth)
    assert mended(*rows[-1]) == "<h2>a</h2><h3>b</h3><h4>c</h4>"


RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "jp", "!city.kobe.jp", "github.io", "// a comment", "", "  org  ", "org", None]


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://a.b.example.com/x", "example.com"), ("http://u:p@Example.COM:80?q=a.b.c", "example.com"), ("example.com.", "example.com"), ("com", None),
        ("http://x.y.co.uk", "y.co.uk"), ("http://co.uk/", None), ("http://y.uk", "y.uk"), ("http://a.b.c.ck", "b.c.ck"), ("http://c.ck", None), ("http://www.ck", "www.ck"),
        ("http://x.www.ck", "www.ck"), ("http://a.city.kobe.jp", "city.kobe.jp"), ("http://a.b.kobe.jp", "a.b.kobe.jp"), ("http://b.kobe.jp", None), ("http://kobe.jp", "kobe.jp"),
        ("http://me.github.io", "me.github.io"), ("http://deep.me.github.io#x", "me.github.io"), ("http://some.thing.unknown", "thing.unknown"), ("http://localhost/", None),
        ("http://10.0.0.1/x", "10.0.0.1"), ("", None), (None, None), ("/path/only", None),
    ],
)
def test_rules_of_all_kinds(domains, url, domain):
    assert domains[url] == domain


@pytest.fixture(scope="module")
def domains(spark):
    urls = [m[0] for m in test_rules_of_all_kinds.pytestmark[0].args[1]]
    df = spark.createDataFrame([(u, "mine", i) for i, u in enumerate(urls + urls)], "url string, base string, size int")
    rows = hosts.registered_domains(df, "url", spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()
    assert len(rows) == 2 * len(urls) and {r.base for r in rows} == {"mine"} and sorted(r.size for r in rows) == list(range(2 * len(urls)))
    return {r.url: r.domain for r in rows}


def test_no_rules_and_no_rows(spark):
    none = spark.createDataFrame([], "rule string")
    df = spark.createDataFrame([("http://a.b.c/",)], "url string")
    assert [r.domain for r in hosts.registered_domains(df, "url", none).collect()] == ["b.c"]
    assert hosts.registered_domains(df.limit(0), "url", none).count() == 0


def test_mapped_sections_keep_documents_apart(spark):
    rng = random.Random(5)
    docs = [(d, s) for d in range(6) for s in ("a", "b")]
    pages = [(d, s, p, f"{d}{s}{p}") for d, s in docs for p in range(12) if rng.random() < 0.8]
    sections = [(d, s, k, rng.randint(0, 13)) for d, s in docs for k in range(4)]
    mapping = [(f"t{d}", d, s, k) for d, s, k, _ in sections if rng.random() < 0.7]
    want = {}
    for task, d, s, k in mapping:
        start = next(p for dd, ss, kk, p in sections if (dd, ss, kk) == (d, s, k))
        after = [(p, kk) for dd, ss, kk, p in sections if (dd, ss) == (d, s) and (p, kk) > (start, k)]
        stop = max(min(after)[0], start + 1) if after else 10**9
        text = "\n".join(t for dd, ss, p, t in pages if (dd, ss) == (d, s) and start <= p < stop)
        if text:
            want[task, d, s, k] = text
    frames = (spark.createDataFrame(mapping, "task string, doc int, side string, section int"), spark.createDataFrame(sections, "doc int, side string, section int, page int"))
    out = versioned.mapped_sections(*frames, spark.createDataFrame(pages, "doc int, side string, page int, text string"), ("doc", "side"))
    assert {(r.task, r.doc, r.side, r.section): r.text for r in out.collect()} == want
