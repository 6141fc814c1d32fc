"""Reference tags, YAML ballots, report trees, feeds, versioned documents."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from weftline.operators import special


def test_tags(spark):
    a, b = special.missing_tags(F.lit("<ref 1/> <ref 2 : 3/>"), F.lit("x <ref 2:3/> <ref 9 />"))
    assert tuple(spark.range(1).select(a, b).first()) == ("1", "9")


def test_yaml_and_ballots(spark):
    assert special.load_yaml("```yaml\na: b: c\n```") == {"a": "b: c"}
    one = "g:\n  clear writing:\n    value: 3\n    analysis: ok\n"
    df = spark.createDataFrame([(1, one), (2, one.replace("clear writing", "clear writin")), (3, "[")], "id int, t string")
    rows = special.align_criteria(special.ballots(df, "id", "t"), "id").collect()
    assert sorted((r.id, r.criterion, r.value) for r in rows) == [(1, "clear writing", 3.0), (2, "clear writing", 3.0)]


def test_trees_and_outlines(spark):
    tree = {"title": "T", "contents": [{"info_type": "metric", "title": "m", "value": 1, "unit": "kg"}, {"title": "S", "contents": [{"text": "x"}]}]}
    assert special.tree_markdown(tree) == "# T\n\n**m**: 1 kg\n\n## S\n\nx"
    assert special.leaf_paths([{"children": [{}, {}]}, {}]) == [(0, 0), (0, 1), (1,)]
    s = spark.createDataFrame([([(2, "B", []), (1, "A", [(2, "y"), (1, "x")])],)], "s array<struct<index:int,title:string,details:array<struct<index:int,text:string>>>>")
    assert s.select(special.outline_text(F.col("s")).alias("t")).first().t == "## A\n- x\n- y\n\n## B\n"


def test_feed(spark):
    item = "<item><title>t</title><link>https://www.site.org/a</link><pubDate>Mon, 01 Jan 2024 {} GMT</pubDate><description>&lt;b&gt;one&lt;/b&gt; two</description></item>"
    rss = f"<rss><channel>{item.format('10:00:00')}{item.format('00:00:00')}</channel></rss>"
    df = spark.createDataFrame([(1, rss), (2, "broken")], "id int, x string")
    got = special.feeds(df, "id", "x", datetime(2024, 1, 1, 12, tzinfo=timezone.utc), hours=5).collect()
    assert [(r.id, r.title, r.source, r.full) for r in got] == [(1, "t", "Site", "one two")]


def test_changes_and_tasks(spark):
    v = spark.createDataFrame([("e", "f", 1, "a"), ("e", "g", 1, "b")], "entity string, field string, version_id int, value string")
    c = spark.createDataFrame([("e", "f", 1, "x", 1), ("e", "f", 1, "y", 2)], "entity string, field string, version_id int, value string, o int")
    assert {(r.field, r.value) for r in special.apply_changes(v, c, "o").collect()} == {("f", "y"), ("g", "b")}
    q = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, q array<string>")
    assert [tuple(r) for r in special.next_tasks(q, "k", "q").collect()] == [(1, "a")]
    assert special.clean_pages("// Page 1\nab\n// Page 2\nc") == {"1": "ab", "2": "c"}
