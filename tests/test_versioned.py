"""Versioned documents, connectors and fixed lists on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import connect, documents, versioned
from weftline.sources import biblio


def test_pages_become_documents():
    doc = versioned.from_page("<h1>Doc</h1><h2>A</h2><p>x</p><h3>B</h3><p>y</p><h2>C</h2>", least=10_000)
    rows = versioned.rows(doc)
    assert [(r[3], r[4]) for r in rows] == [("sections", "Doc"), ("sections", "A"), ("text", ""), ("text", "B"), ("text", "C")]
    assert versioned.leaves(doc) == [2, 3, 4] and doc["information"][3]["tasks"][0]["name"] == "rewrite"
    deep = versioned.from_page("<h1>D</h1><h2>A</h2><h3>B</h3><h4>C</h4><p>z</p>", least=10_000)
    assert [r[4] for r in versioned.rows(deep)] == ["D", "A", "B"]  # the small third level is one text
    assert deep["information"][2]["contents"] == "<h4>C</h4><p>z</p>"
    assert [r[4] for r in versioned.rows(versioned.from_page("<h1>D</h1><h2>A</h2><h3>B</h3><h4>C</h4><p>z</p>", least=1))] == ["D", "A", "B", "C"]
    assert versioned.rows(versioned.from_page("")) == [(0, None, 0, "sections", "", "", "", "{}")]


def test_changes_and_faults():
    doc = versioned.empty("x")
    versioned.change(doc, 0, "sections", {"sections": [{"title": "a", "contents": '<reference refid="1">r</reference>t'}]}, {})
    versioned.change(doc, 1, "text", {"comments": [{"comment_id": "2", "comment_html": "<mention>me</mention>"}], "referencements": [{"refid": "x", "informationid": "0"}]}, {"act_on_comments": True})
    assert doc["information"][1]["contents"] == "t" and doc["information"][1]["notes"] == {2: "<mention>@ me</mention>"}
    with pytest.raises(ValueError, match="unknown action"):
        versioned.change(doc, 0, "burn", {}, {})
    with pytest.raises(ValueError, match="not a list"):
        versioned.change(doc, 1, "sections", {"sections": []}, {})
    with pytest.raises(ValueError, match="no task"):
        versioned.dispatch(doc, {"name": "write_bibliography", "information_id": 1}, str)
    assert versioned.new_id({0: 0, 2: 0}) == 3 and versioned.find_or_create(doc, "f") == versioned.find_or_create(doc, "f")


def test_titles_match_in_order():
    found = ["", "Intro", "text", "Results", "Methods", "Results", "end"]
    assert versioned.match_titles(["Intro", "Methods", "Results"], found) == [1, 4, 5]
    assert versioned.match_titles(["Introduction", "Result"], found) == [1, 3]
    assert versioned.match_titles(["a", "b"], []) == [None, None]


def test_plans():
    assert versioned.plan_of("no: title") is None and versioned.plan_of("[") is None
    doc = versioned.from_plan({"title": "P", "sections": [{"title": "a", "text": "<ref 1/> <ref 1:2/> <ref 1/> <ref 5/>"}]}, {1: "F"})
    refs = doc["information"][1]["refs"]
    assert sorted(r["detail"] for r in refs.values()) == ["", "2"] and all(1000 <= r < 10_000 for r in refs)
    assert doc["information"][1]["contents"].count("<reference") == 3


def test_faults_of_outside_calls(spark):
    assert connect.headings_fault("<h1>a</h1><h3>b</h3>") == "h3 follows h1"
    assert connect.upload_images('<img src="data:image/png;base64,aGk="><img src="u">', lambda p, b: None) == '<img src="u">'
    hits = spark.createDataFrame([("a b", "2024-01-30T00:00:00Z"), ("a", "?"), ("B a", "2023-01-01")], "title string, date string")
    today = F.to_date(F.lit("2024-01-31"))
    assert [r.title for r in connect.titled(connect.recent(hits, today, 30), "A,b").collect()] == ["a b"]
    got = connect.file_text(spark.createDataFrame([(bytearray(b"x"),)], "content binary"), "content", lambda b: ["p", "q"], pages=True).first()
    assert got.text == "// Page 1\np\n// Page 2\nq"


def test_fixed_lists():
    assert documents.remove_bibliography("a [1]\n## Références\nx\n# End [ 2 , 3 ]") == "a \n# End "
    assert documents.remove_bibliography("# Sources\nx\n# Citations\ny") == "# Sources\nx\n# Citations\ny"  # two of them: neither goes
    e = biblio.ris("TY  - CPAPER\nDI  - 10.1/a\nDOI - 10.1/abc\nBT  - Book\nT3  - A longer one\nK1  - k\nPB  - P\nU3  - 2019\nER  -")[0]
    assert (e["type"], e["doi"], e["title"], e["keywords"], e["date"], e["full_entry"]["PB"]) == (["Conference Paper"], "10.1/abc", "A longer one", ["k"], "2019-01-01", ["P"])


def test_new_ids_of_parents_agree(spark):
    nodes = spark.createDataFrame([(i, (i - 1) // 3 if i else None, f"n{i}") for i in range(25)], "node int, parent int, name string").repartition(5)
    made = versioned.with_uuids(nodes, "node", "parent").repartition(3)
    name_of = {r.node: r.name for r in made.collect()}
    again = made.groupBy("name").agg(F.first("node").alias("node"), F.first("parent").alias("parent")).collect()  # computed anew
    assert len(name_of) == 25 and {r["name"]: name_of.get(r.parent) for r in again} == {f"n{i}": f"n{(i - 1) // 3}" if i else None for i in range(25)}


def test_sinks_get_bounded_batches(spark, tmp_path):
    from weftline.operators import providers

    def put(texts):
        (tmp_path / f"{texts[0]}").write_text(str(len(texts)))

    providers.deliver(spark.range(25).selectExpr("cast(id as string) AS t").coalesce(1), "t", put, batch=10)
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [5, 10, 10]
