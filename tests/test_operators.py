"""Small cases: ties, nulls, grammar limits, round trips, optimality."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from exact_assignment import solve_assignment
from pyspark.sql import functions as F

from weftline.functions import template, text
from weftline.operators import aggregate, convert, documents, graph, order, prompts, providers, records, segment, vectors
from weftline.plans import registry
from weftline.sources import biblio, docx, files
from weftline.streaming import events as streams


def test_expressions(spark):
    df = spark.createDataFrame([(3, "ab", None)], "n int, s string, z int")
    one = lambda e: df.select(template.expression(df, e).alias("x")).first().x
    assert one("n + 1") == 4
    assert one("s + '!'") == "ab!"
    assert one("len(s) * 2.5") == 5.0
    assert one("'yes' if n > 2 and s == 'ab' else 'no'") == "yes"
    assert one("s[0]") == "a"
    assert one("s.upper()") == "AB"
    for bad in ("__import__('os')", "(lambda: 1)()", "n.__class__", "[x for x in s]", "missing"):
        with pytest.raises(template.ExpressionError):
            one(bad)


def test_templates(spark):
    df = spark.createDataFrame([("x", 1, True, None)], "a string, n int, b boolean, z string")
    row = df.select(
        template.render(df, r"{a} \{lit\} {n + 1} {b} {z} {nope} {open").alias("t"), template.fill_slots(df, "__a__ __gone__").alias("s"), template.fill_texts("<__text_1__|__text_2__>", F.lit("__text_2__"), F.lit("q")).alias("f")
    ).first()
    assert row.t == "x {lit} 2 True None Error in expression: nope - name 'nope' is not defined {open"
    assert row.s == "x unknown"
    assert row.f == "<q|q>"
    with pytest.raises(ValueError):
        template.fill_texts("none", F.lit("a"))


def test_regex_translation():
    assert text.java_regex(r"(?P<y>a)(?P=y)\Z") == r"(?U)(?<y>a)\k<y>\z"


def test_keep_top_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 1)], "id int, v int")
    assert [r.id for r in order.keep_top(df, "v", ["id"], 2).collect()] == [1, 3]
    assert [r.id for r in order.keep_top(df, "v", ["id"], 2, reverse=True).collect()] == [4, 2]


def test_keep_first_null_is_a_value(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    assert {r.id for r in order.keep_first(df, ["k"], ["id"]).collect()} == {1, 3}
    with pytest.raises(Exception, match="missing key"):
        order.keep_first(df, ["k"], ["id"], strict=True).collect()


def test_index_over_many_partitions(spark):
    got = records.add_index(spark.range(1000, numPartitions=7).withColumn("k", F.hash("id")), "pos", ["k", "id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_segments_keep_text(spark):
    s = "One two. Three four.\nFive! " * 30
    got = spark.range(1).select(segment.segments(F.lit(s), 50).alias("x")).first().x
    assert all(len(c) > 50 for c in got[:-1])
    assert "".join("".join(got).split()) == "".join(s.split())
    assert spark.range(1).select(segment.segments(F.lit(""), 50).alias("x")).first().x == []


def test_uniform_and_headed():
    s = "Intro.\n# A\n" + "Mr. Smith went home. He slept. " * 40 + "\n## B\n" + "x" * 500
    got = segment.uniform(s, 200)
    assert "".join("".join(got).split()) == "".join(s.split())
    heads = segment.headed(s, 100)
    assert heads[-1]["## "] == "## B" and heads[-1]["# "] == "# A"
    assert segment.sentences("Dr. No came. He left.") == ["Dr. No came.", "He left."]


def test_layout_and_outline():
    kept, images = segment.without_layout("// Page 1\nA\n<!--TABLE 1\nx\n<!--END\n![Image 1]\nFigure 1: cap\nB")
    assert kept == "A\nB" and images == [("![Image 1]", "Figure 1: cap")]
    rows = segment.outline_rows("## S\n### T\nAbstract: a\nDetails:\n- d1\n- d2")
    assert rows == [{"section": "S", "section_index": 1, "title": "T", "index": 1, "abstract": "a", "details": ["d1", "d2"]}]


def test_votes_half_to_even_and_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 9)], "k string, v int")
    assert {r.k: r.vote for r in aggregate.votes(df, ["k"], "v", "mean").collect()} == {"a": 2, "b": 4}
    assert {r.k: r.vote for r in aggregate.votes(df, ["k"], "v").collect()} == {"a": 2.5, "b": 2.0}
    ballots = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y")], "k int, d string")
    assert {r.k: (r.decision, round(r.score)) for r in aggregate.majority(ballots, ["k"], "d").collect()} == {1: ("x", 67), 2: ("unsure", 50)}


def test_prompt_truncation(spark):
    rng = random.Random(3)
    for _ in range(5):
        sizes = [rng.randint(0, 40) for _ in range(5)]
        p = F.array(*(prompts.message("user", F.lit("x" * n)) for n in sizes))
        got = [len(m.content) for m in spark.range(1).select(prompts.truncate(p, 60).alias("p")).first().p]
        want, over = list(sizes), sum(sizes) - 60
        for i in sorted(range(5), key=lambda i: (-sizes[i], i)):
            cut = max(0, min(want[i], over))
            want[i], over = want[i] - cut, over - cut
        assert got == want


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        score, doc = rng.standard_normal((5, 2)), [0, 0, 1, 1, 2]
        got = solve_assignment(score, doc, 1, 2, 1)
        best = None
        for pick in itertools.product([None, 0, 1], repeat=5):
            if pick.count(0) == pick.count(1) == 2 and all(any(pick[i] is not None for i in range(5) if doc[i] == d) for d in (0, 1, 2)):
                total = sum(score[i, g] for i, g in enumerate(pick) if g is not None)
                best = total if best is None else max(best, total)
        assert abs(sum(score[c, g] for c, g in got) - best) < 1e-9
    with pytest.raises(ValueError):
        solve_assignment(np.zeros((2, 2)), [0, 0], 1, 2, 1)


def test_components_and_versions(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.label for r in graph.least_labels(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    versions = spark.createDataFrame([(-1, 2), (2, 1), (1, None)], "version_id int, parent_id int")
    values = spark.createDataFrame([(1, "d", "t", "old"), (2, "d", "t", "new"), (1, "d", "u", "kept")], "version_id int, entity string, field string, value string")
    got = {(r.version_id, r.field): r.value for r in graph.resolve_versions(values, versions).collect()}
    assert got[-1, "t"] == "new" and got[-1, "u"] == "kept" and got[1, "t"] == "old"


def test_html_round_trip_and_tree():
    page = "<h1>T</h1><p>a<b>c</b></p><ul><li><table><tr><td>x</td></tr></table></li></ul><h3>S</h3><p>z</p>"
    short, kept = documents.contract(page)
    assert len(kept) == 3 and documents.expand(short, kept) == documents.parse(page).html()
    rows = documents.heading_rows(page)
    assert [(r[1], r[2], r[3]) for r in rows[1:]] == [(0, 1, "T"), (1, 3, "S")]
    assert len(documents.merge_small(rows, 10_000)) == 1


def test_bibliography_text():
    md = "See [3] and [1].\n## Bibliography\n[1] One\n[2] Two\n[3] Three\n"
    got = documents.renumber_citations(md)
    assert "See [1] and [2]." in got and "[1] Three" in got and "- Two" in got
    assert documents.remove_bibliography("# A\ntext [1, 2]\n# References\nx") == "# A\ntext \n"


def test_bibliography_formats():
    nbib = "PMID- 1\nTI  - A long\n      title\nAB  - Abs\nLID - 10.1/x [doi]\nDP  - 2015 Oct 15\nAU  - A B\nAU  - C D\nMH  - k1\nOT  - k2\n\nPMID- 2\nTI  - Two\nDP  - 2015 Apr-Jun\n"
    one, two = biblio.medline(nbib)
    assert one["title"] == "A long title" and one["doi"] == "10.1/x" and one["date"] == "2015-10-15" and one["keywords"] == ["k1", "k2"]
    assert two["date"] is None
    assert biblio.medline(biblio.medline_text([one]))[0]["authors"] == one["authors"]
    made = biblio.ris("TY  - JOUR\r\nTI  - Short\r\nT1  - Longer title\r\nAU  - A\r\nAU  - A\r\nPY  - 2020/01/02\r\nAB  - line\r\nmore\r\nER  - \r\n")
    assert made[0]["title"] == "Longer title" and made[0]["authors"] == ["A"] and made[0]["abstract"] == "line more" and made[0]["date"] == "2020-01-02"
    assert biblio.ris(biblio.ris_text(made))[0]["title"] == "Longer title"


def test_workbook_round_trip():
    a = pd.DataFrame({"x": [1, 2], "s": ["a<b", None]})
    got = files.workbook_frames(files.workbook_bytes({"one/two": a, "b" * 40: a}))
    assert list(got) == ["one_two", "b" * 31] and got["one_two"].x.tolist() == [1, 2] and got["one_two"].s.tolist() == ["a<b", None]
    with pytest.raises(ValueError):
        files.workbook_bytes({"b" * 40: a, "b" * 50: a})
    m = np.arange(6.0).reshape(2, 3)
    assert (files.array_of(files.array_bytes(m)) == m).all()


def test_docx():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>T &amp; t</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got, _ = docx.to_html(buf.getvalue(), body_only=True)
    assert got == "<h1>T &amp; t</h1><p><strong>b</strong></p><table><tr><td><p>c</p></td></tr></table>"
    assert docx.to_html(b"nothing")[0] is None


def test_schemas(spark):
    schema = convert.compile_fields([{"name": "Âge du patient", "type": "int"}, {"name": "notes", "fields": [{"name": "t", "type": "str"}]}])
    assert schema.simpleString() == "struct<age_du_patient:bigint,notes:array<struct<t:string>>>"
    df = spark.createDataFrame([('{"age_du_patient": 3}',), ("{}",), ("nope",)], "j string")
    assert [r.x for r in df.select(convert.verify(F.col("j"), schema, ["age_du_patient"]).alias("x")).collect()] == [True, False, False]
    assert convert.upper_name("1 Été chaud") == "ETE_CHAUD"
    assert convert.html_of({"a": [True, None, "<"]}) == "<ul><li><strong>a:</strong> <ol><li>True</li><li><em>null</em></li><li>&lt;</li></ol></li></ul>"


def test_providers(spark):
    df = spark.createDataFrame([(1, "hello")], "id int, t string").withColumn("p", prompts.start("user", F.col("t")))
    assert providers.complete(df, "p").first().reply == "hello"
    assert providers.reply(df, "p").first().p[-1].content == "hello"
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError
        return texts

    assert providers.with_retries(flaky, ["x"]) == ["x"]
    assert len(providers.embed(df, "t").first().embedding) == 64


def test_plans_and_blueprints(spark):
    ops = registry.load()
    assert len(ops) > 120
    shape = registry.blueprint(ops["order.keep_top"])
    assert shape["inputs"] == ["df"] and "field" in shape["required"] and shape["optional"]["keep"]["default"] == 10
    spec = {"steps": {"top": {"operator": "order.keep_top", "parameters": {"field": "id", "order": ["id"], "keep": 3}, "inputs": {"df": "named"}}, "named": {"operator": "records.set_field", "parameters": {"name": "a", "value": 1}, "inputs": {"df": "in"}}}, "outputs": ["top"]}
    out = registry.Plan.of(spec).compile({"in": spark.range(10).toDF("id")})["top"]
    assert [(r.id, r.a) for r in out.collect()] == [(7, 1), (8, 1), (9, 1)]
    spec["steps"]["named"]["inputs"]["df"] = "top"
    with pytest.raises(ValueError, match="cycle"):
        registry.Plan.of(spec).order()
    c = registry.Conversions()
    c.add("a", "b", lambda x: x + "b")
    c.add("b", "c", lambda x: x + "c")
    assert c.convert("a", "a", "c") == "abc"


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (2, "2024-01-01 00:20:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 3.0)], "event_id long, ts string, event_type string, value double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    s = streams.timed(streams.stream_table(spark, str(tmp_path / "in"), rows))
    streams.run_once(streams.tumbling(streams.first_seen(s, ["event_id"])), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    assert [(r.event_type, r.n, r.total) for r in got] == [("a", 2, 3.0)]
