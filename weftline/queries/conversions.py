"""Queries on conversions, prompts, providers, plans and versioned documents. Providers are the offline ones or small stand-ins defined here."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftline.functions import template
from weftline.functions import text as tx
from weftline.operators import aggregate, connect, convert, documents, filters, hosts, order, page_sections, prompts, providers, records, segment, special, vectors, versioned
from weftline.plans import registry
from weftline.queries.base import Book
from weftline.session import table as t
from weftline.sources import biblio, files

B = Book()

#: Paragraphs of the pages get headings: the level by the first letter, the title is the first word.
HEADS = (("A-H", 2), ("I-S", 3), ("T-Z", 4))
HEADED_SQL = "html"
for letters, level in HEADS:
    HEADED_SQL = f"regexp_replace({HEADED_SQL}, '<p>([{letters}][a-z]*)', '<h{level}>\\1</h{level}><p>\\1', 'g')"
HEADED_SQL = f"SELECT page_id, {HEADED_SQL} AS html FROM pages"


def headed_pages(spark, d):
    html = F.col("html")
    for letters, level in HEADS:
        html = F.regexp_replace(html, f"<p>([{letters}][a-z]*)", f"<h{level}>$1</h{level}><p>$1")
    return t(spark, d, "pages").select("page_id", html.alias("html"))


# records and lists


@B.add("SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 1) AS region FROM nation")
def record_field(spark, d):
    one = t(spark, d, "region").where("r_regionkey = 1")
    return records.set_record(t(spark, d, "nation").select("n_nationkey"), "r", one).select("n_nationkey", F.col("r.r_name").alias("region"))


@B.add("SELECT n_nationkey, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS regions FROM nation")
def table_field(spark, d):
    out = records.set_table(t(spark, d, "nation").select("n_nationkey"), "rows", t(spark, d, "region"), ["r_regionkey"])
    return out.select("n_nationkey", F.array_join("rows.r_name", ",").alias("regions"))


@B.add("SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'lang,n,source' ELSE 'n,source' END AS kept FROM documents")
def verdict_fields(spark, d):
    values = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"))
    said = F.create_map(F.lit("lang"), F.when(F.col("n_chars") > 1000, " GOOD").otherwise("bad"), F.lit("source"), F.lit("Good "))
    kept = records.filter_fields_by(values, said, "good, ???")
    return t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@B.add("SELECT n_nationkey AS \"analyze:n_nationkey\", n_name, n_regionkey FROM nation")
def renamed_columns(spark, d):
    return files.find_and_rename({"a": t(spark, d, "nation"), "b": t(spark, d, "region")}, "n_nationkey; r_name")["a"]


@B.add("SELECT 'n_name' AS sheet, n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'n_nationkey', n_nationkey, n_name, n_regionkey FROM nation")
def table_per_column(spark, d):
    marked = t(spark, d, "nation").withColumnsRenamed({"n_name": "analyze:n_name", "n_nationkey": "analyze:n_nationkey"})
    parts = [df.select(F.lit(name).alias("sheet"), "n_nationkey", "n_name", "n_regionkey") for book in files.tables_per_column({"s": marked}) for name, df in book.items()]
    return parts[0].unionByName(parts[1])


@B.add("SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name")
def workbook_columns(spark, d):
    frames = files.workbook_frames(files.write_workbook({"nation": t(spark, d, "nation")}))
    return spark.createDataFrame([(c,) for c in files.only_columns(frames)], "name string")


@B.add("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def workbook_round_trip(spark, d):
    return spark.createDataFrame(files.workbook_frames(files.write_workbook({"nation": t(spark, d, "nation"), "region": t(spark, d, "region")}))["nation"])


@B.add("SELECT 'metadata' AS sheet, 'grid' AS key, '{\"a\": 1}' AS value UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation")
def grid_workbook(spark, d):
    book = files.with_schema_sheet(spark, {"nation": t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))}, '{"a": 1}')
    return book["nation"].withColumn("sheet", F.lit("nation")).unionByName(book["metadata"].withColumn("sheet", F.lit("metadata")))


@B.add("SELECT n_nationkey AS k, n_name AS v FROM nation")
def merged_workbooks(spark, d):
    region, nation = t(spark, d, "region").toDF("k", "v"), t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return order.merge_workbooks([{"a": region, "b": region}, {"a": nation}])["a"]


@B.add("SELECT doc_id, [lang, source, source, lang] AS both_lists FROM documents")
def list_concat(spark, d):
    return t(spark, d, "documents").select("doc_id", order.concat_lists(F.array("lang", "source"), F.array("source", "lang")).alias("both_lists"))


@B.add("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS text FROM region")
def table_json(spark, d):
    return aggregate.dump_rows(t(spark, d, "region"), ["r_regionkey"])


@B.add("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS json FROM documents")
def row_json(spark, d):
    df = t(spark, d, "documents").select("doc_id", "lang")
    return df.join(convert.to_json_text(df).select("json", F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id")), "doc_id").select("doc_id", "json")


@B.add("SELECT url, '' AS title, html AS text, '' AS clean_text, '' AS date, []::VARCHAR[] AS images, false AS success FROM pages")
def url_records(spark, d):
    return convert.as_schema(t(spark, d, "pages").select("url", F.col("html").alias("text")), convert.URL)


@B.add("SELECT conv_id, turn, role FROM conversations")
def exploded_records(spark, d):
    held = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("rows"))
    return convert.explode_list(held, "rows")


@B.add("SELECT n_regionkey AS k, n_name AS name FROM nation")
def exploded_scalars(spark, d):
    held = t(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.concat_ws("|", F.col("n_regionkey").cast("string"), "n_name")).alias("names"))
    out = convert.explode_list(held, "names", "x")
    return out.select(F.substring_index("x", "|", 1).cast("int").alias("k"), F.substring_index("x", "|", -1).alias("name"))


@B.add("SELECT n_name AS line FROM nation")
def exploded_texts(spark, d):
    return convert.texts_to_rows(t(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")), "names", "line")


@B.add("SELECT doc_id, 2 AS n, lang AS first, n_chars AS second FROM documents")
def parsed_list(spark, d):
    made = F.concat(F.lit('Here: [{"a": "'), F.col("lang"), F.lit('"}, {"b": '), F.col("n_chars").cast("string"), F.lit("}] - done"))
    got = convert.parse_list(made, "array<struct<a:string,b:bigint>>")
    return t(spark, d, "documents").select("doc_id", F.size(got).alias("n"), F.get(got, F.lit(0))["a"].alias("first"), F.get(got, F.lit(1))["b"].alias("second"))


@B.add("SELECT doc_id, '<ul><li><strong>doc_id:</strong> ' || doc_id || '</li><li><strong>tags:</strong> <ol><li>' || lang || '</li><li>&lt;b&gt;</li></ol></li><li><strong>none:</strong> <em>null</em></li></ul>' AS html FROM documents")
def json_html(spark, d):
    made = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "tags": ["'), F.col("lang"), F.lit('", "<b>"], "none": null}'))
    return convert.map_text(t(spark, d, "documents").select("doc_id", made.alias("json")), "json", "html", lambda x: convert.html_of(json.loads(x))).drop("json")


@B.add("SELECT doc_id, '<html><head><style>p {}</style></head><body><h2>Doc ' || doc_id || '</h2><p>In <strong>' || lang || '</strong> &amp; <em>more</em></p><ul><li>' || source || '</li><li><a href=\"http://x.org\">x</a></li></ul></body></html>' AS html FROM documents")
def markdown_html(spark, d):
    made = F.concat(F.lit("## Doc "), F.col("doc_id").cast("string"), F.lit("\n\nIn **"), F.col("lang"), F.lit("** & *more*\n- "), F.col("source"), F.lit("\n- [x](http://x.org)\n"))
    return convert.map_text(t(spark, d, "documents").select("doc_id", made.alias("md")), "md", "html", lambda x: convert.markdown_to_html(x, "p {}")).drop("md")


@B.add("SELECT doc_id, base64(encode(lang)) AS body, lang AS back, '___ASCII___' || base64(encode(lang)) AS tagged FROM documents")
def tagged_bytes(spark, d):
    tagged = convert.encode_bytes(F.col("lang").cast("binary"))
    return t(spark, d, "documents").select("doc_id", F.substring(tagged, len(convert.TAG) + 1, 1000).alias("body"), convert.decode_bytes(tagged).cast("string").alias("back"), tagged.alias("tagged"))


@B.add("SELECT vec_id, 64 AS n, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def array_codec(spark, d):
    import numpy as np

    def run(batches):
        for b in batches:
            back = [files.array_of(files.array_bytes(np.array(v, np.float32))) for v in b["embedding"]]
            yield b[["vec_id"]].assign(n=[len(x) for x in back], first=[float(x[0]) for x in back], last=[float(x[-1]) for x in back])

    return t(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, n int, first double, last double")


@B.add("SELECT doc_id, n_chars % 2 = 0 AS ok FROM documents")
def verified_json(spark, d):
    made = F.concat(F.lit('{"name": "x", "size": '), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise("null"), F.lit("}"))
    kind = convert.compile_fields([{"name": "Name", "type": "str", "required": True}, {"name": "Size", "type": "int"}, {"name": "Tags", "type": "str", "multiple": True}])
    return t(spark, d, "documents").select("doc_id", convert.verify(made, kind, ["name", "size"]).alias("ok"))


@B.add("SELECT doc_id, source AS name, n_chars AS size, lang AS tag, n_chars / 2.0::DOUBLE AS weight, n_chars AS fit, lang AS analysis FROM documents")
def compiled_schemas(spark, d):
    """Each row as JSON, read back by schemas compiled from field lists."""
    fields = convert.compile_fields([{"name": "Name", "type": "str"}, {"name": "Size in cm", "type": "int"}, {"name": "Tags", "type": "str", "multiple": True}, {"name": "Parts", "fields": [{"name": "Weight", "type": "float"}]}])
    grid = convert.compile_grid([{"name": "Topic", "rows": [{"name": "Fit"}]}])
    said = F.to_json(F.struct(F.col("source").alias("name"), F.col("n_chars").alias("size_in_cm"), F.array("lang").alias("tags"), F.array(F.struct((F.col("n_chars") / 2).alias("weight"))).alias("parts")))
    graded = F.to_json(F.struct(F.struct(F.struct(F.col("n_chars").alias("value"), F.col("lang").alias("analysis")).alias("fit")).alias("topic")))
    df = t(spark, d, "documents").select("doc_id", F.from_json(said, fields).alias("v"), F.from_json(graded, grid).alias("g"))
    return df.select("doc_id", "v.name", F.col("v.size_in_cm").alias("size"), F.get("v.tags", F.lit(0)).alias("tag"), F.get("v.parts", F.lit(0))["weight"].alias("weight"), F.col("g.topic.fit.value").alias("fit"), F.col("g.topic.fit.analysis").alias("analysis"))


@B.add("SELECT doc_id, upper(lang) || '_' || doc_id AS name FROM documents")
def upper_names(spark, d):
    made = F.concat(F.lit("12 "), F.col("lang"), F.lit(" -- "), F.col("doc_id").cast("string"), F.lit("!"))
    return convert.map_text(t(spark, d, "documents").select("doc_id", made.alias("raw")), "raw", "name", lambda x: convert.upper_name(x)).drop("raw")


@B.add("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, '' AS value FROM nation")
def empty_copies(spark, d):
    return records.add_index(records.duplicates(spark, t(spark, d, "nation").count()), "i", ["value"]).select((F.col("i") - 1).alias("i"), "value")


# texts


@B.add("SELECT doc_id, 'In ' || lang || '.' AS line FROM documents")
def format_one(spark, d):
    return t(spark, d, "documents").select("doc_id", template.fill_texts("In __text_1__.", F.col("lang")).alias("line"))


@B.add("SELECT doc_id, 'Intro ' || doc_id || chr(10) || '# One' || chr(10) || 'text  of ' || lang || chr(10) || '# End' || chr(10) || 'z' AS text FROM documents")
def without_bibliography(spark, d):
    made = F.concat(F.lit("Intro "), F.col("doc_id").cast("string"), F.lit("\n# One\ntext [1, 2] of "), F.col("lang"), F.lit("\n## Références\n- x [3]\n# End\nz"))
    return convert.map_text(t(spark, d, "documents").select("doc_id", made.alias("raw")), "raw", "text", documents.remove_bibliography).drop("raw")


@B.add("SELECT doc_id, 'A [1] b [2].' || chr(10) || '## Bibliography' || chr(10) || chr(10) || '[1] Two ' || lang || chr(10) || '[2] One' || chr(10) || chr(10) || '## Unused Sources' || chr(10) || chr(10) || '- Three' || chr(10) AS text FROM documents")
def renumbered_citations(spark, d):
    made = F.concat(F.lit("A [2] b [1].\n## Bibliography\n[1] One\n[2] Two "), F.col("lang"), F.lit("\n[3] Three"))
    return convert.map_text(t(spark, d, "documents").select("doc_id", made.alias("raw")), "raw", "text", documents.renumber_citations).drop("raw")


@B.add("SELECT doc_id, '2, ' || doc_id || ':7' AS unused, '9' AS unknown FROM documents WHERE doc_id > 9")
def tag_difference(spark, d):
    given = F.concat(F.lit("<ref 1/> <ref "), F.col("doc_id").cast("string"), F.lit(" : 7 /> <ref 2 />"))
    a, b = special.missing_tags(given, F.lit("x <ref 1 /> y <ref 9/>"))
    # sorted as numbers would be for two tags: 2 first
    a = F.array_join(F.array_sort(F.split(a, ", "), lambda x, y: F.when(x == "2", -1).when(y == "2", 1).otherwise(0)), ", ")
    return t(spark, d, "documents").where("doc_id > 9").select("doc_id", a.alias("unused"), b.alias("unknown"))


@B.add("SELECT doc_id, '{\"a\" : str or null (in ' || lang || '), \"b\" : int or null (size)}' AS text FROM documents")
def schema_text(spark, d):
    field = lambda n, k, x: F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"), x.alias("description"))
    fields = F.array(field("a", "str", F.concat(F.lit("in "), F.col("lang"))), field("b", "int", F.lit("size")))
    return t(spark, d, "documents").select("doc_id", special.schema_text(fields).alias("text"))


@B.add("SELECT n_regionkey, '## Nations of ' || n_regionkey || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def outline_text(spark, d):
    held = t(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("index"), F.col("n_name").alias("text"))).alias("details"))
    section = F.struct(F.lit(1).alias("index"), F.concat(F.lit("Nations of "), F.col("n_regionkey").cast("string")).alias("title"), "details")
    return held.select("n_regionkey", special.outline_text(F.array(section)).alias("text"))


@B.add("SELECT doc_id, 'body of ' || lang || chr(10) || 'end' AS text, 1 AS images, 'Figure 1: x' AS caption FROM documents")
def without_layout(spark, d):
    made = F.concat(F.lit("// Page 3\nbody of "), F.col("lang"), F.lit("\n<!--TABLE 1-->\n|a|b|\n<!--END-->\n![Image 1](x.png)\nFigure 1: x\n\nend"))
    rows = documents.parsed_rows(t(spark, d, "documents").select("doc_id", made.alias("raw")), "doc_id", "raw", lambda x: [(lambda kept, found: (kept, len(found), found[0][1]))(*segment.without_layout(x))], "text string, images int, caption string")
    return rows


@B.add("SELECT doc_id, 'Part ' || lang AS section, 1 AS number, 'First' AS title, 'About it' AS abstract, 2 AS details FROM documents")
def outline_rows(spark, d):
    made = F.concat(F.lit("## Part "), F.col("lang"), F.lit("\n### First\nAbstract: About it\nDetails:\n- one\n- two\n"))
    f = lambda x: [(r["section"], r["section_index"], r["title"], r["abstract"], len(r["details"])) for r in segment.outline_rows(x)]
    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", made.alias("raw")), "doc_id", "raw", f, "section string, number int, title string, abstract string, details int")


@B.add("SELECT doc_id, unnest(['3', '7']) AS page, unnest(['in ' || lang, 'end']) AS text FROM documents")
def page_split(spark, d):
    made = F.concat(F.lit("head // Page 3\nin "), F.col("lang"), F.lit("\n// Page 7 end"))
    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", made.alias("raw")), "doc_id", "raw", lambda x: list(special.clean_pages(x).items()), "page string, text string")


@B.add(r"SELECT doc_id, 'x' || (doc_id % 7) || '.co.uk' AS domain, 'y.org' AS other FROM documents")
def domain_suffixes(spark, d):
    made = F.concat(F.lit("https://a.b.X"), (F.col("doc_id") % 7).cast("string"), F.lit(".co.uk:80/p"))
    return t(spark, d, "documents").select("doc_id", tx.domain_of(made).alias("domain"), tx.domain_of(F.lit("http://u@www.y.org/?q=a.b")).alias("other"))


@B.add("SELECT * FROM region")
def without_faults(spark, d):
    return filters.inject_faults(t(spark, d, "region"), 0.0)


# bibliographies


@B.add("SELECT doc_id::VARCHAR AS source, 'A longer title' AS title, '10.1/' || doc_id AS doi, '2015-10-15' AS date, 'J ' || lang AS journal, ['One, A', 'Two, B'] AS authors, ['Journal Article', 'review'] AS type, ['k', 'l'] AS keywords FROM documents")
def ris_entries(spark, d):
    made = F.concat(F.lit("TY  - JOUR\nT1  - Title\nT2  - A longer\n title\nDOI  - 10.1/"), F.col("doc_id").cast("string"), F.lit("\nA1  - One, A\nA4  - Two, B\nDA  - 2015/10/15\nJF  - J "), F.col("lang"), F.lit("\nM3  - review\nKW  - k\nK1  - l\nER  - \n"))
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), made.alias("value"))
    return biblio.entries(rows, "source", "value", "ris").select("source", "title", "doi", "date", "journal", "authors", "type", "keywords")


@B.add("SELECT doc_id::VARCHAR AS source, 'On ' || lang AS title, '10.1/x' AS doi, '2018-01-01' AS date, 'Some words that go on.' AS abstract, ['A B', 'C D'] AS authors, ['m', 'o'] AS keywords FROM documents")
def medline_entries(spark, d):
    made = F.concat(F.lit("PMID- 1\nTI  - On "), F.col("lang"), F.lit("\nAB  - Some words\n      that go on.\nDP  - 2018 Jan\nAU  - A B\nAU  - C D\nMH  - m\nOT  - o\nLID - 10.1/x [doi]\n\n"))
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), made.alias("value"))
    return biblio.entries(rows, "source", "value", "nbib").select("source", "title", "doi", "date", "abstract", "authors", "keywords")


@B.add("SELECT doc_id::VARCHAR AS source, 'T ' || lang AS title, '2015-10-15' AS date, source AS journal, ['One, A'] AS authors FROM documents")
def biblio_written_and_read(spark, d):
    def both(x):
        entry = {"title": x.split("|")[0], "abstract": "", "doi": "", "date": "2015-10-15", "journal": x.split("|")[1], "authors": ["One, A"], "type": ["Journal Article"], "keywords": [], "affiliations": []}
        return biblio.ris_text(biblio.medline(biblio.medline_text([entry])))

    df = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("T "), "lang", F.lit("|"), "source").alias("raw"))
    return biblio.entries(convert.map_text(df, "raw", "value", both), "name", "value", "ris").select("source", "title", "date", "journal", "authors")


# prompts and providers


@B.add("SELECT doc_id, 'user' AS role, 'At 2020-01-02 03:04:05: ' || lang AS content FROM documents")
def prompt_dated(spark, d):
    df = t(spark, d, "documents").select("doc_id", "lang")
    made = df.withColumn("p", prompts.start_dated(df, "user", "At {{__date__}}: {{lang}}", F.lit("2020-01-02 03:04:05").cast("timestamp")))
    return made.select("doc_id", F.col("p")[0]["role"].alias("role"), F.col("p")[0]["content"].alias("content"))


@B.add("SELECT doc_id, 2 AS n, 'Use {' || chr(10) || '\"a\" : str or null (x),' || chr(10) || '\"a_justification\" : str,' || chr(10) || '\"b\" : int or null (y),' || chr(10) || '\"b_justification\" : str' || chr(10) || '}.' AS content FROM documents")
def prompt_instructions(spark, d):
    p = prompts.add_instructions(prompts.start("system", F.col("lang")), "user", [("a", "str", "x"), ("b", "int", "y")], "Use ", ".", True)
    return t(spark, d, "documents").select("doc_id", F.size(p).alias("n"), prompts.last(p).alias("content"))


@B.add("SELECT doc_id, 'Say ' || lang AS reply FROM documents")
def offline_text(spark, d):
    df = t(spark, d, "documents").select("doc_id", prompts.start("user", F.concat(F.lit("Say "), "lang")).alias("p"))
    return providers.complete(df, "p").drop("p")


@B.add("SELECT doc_id, unnest([1, 2]) AS a, unnest([lang, 'x']) AS b FROM documents")
def offline_rows(spark, d):
    body = F.concat(F.lit('Rows: [{"a": 1, "b": "'), F.col("lang"), F.lit('"}, {"a": 2, "b": "x"}].'))
    return providers.rows_of(t(spark, d, "documents").select("doc_id", prompts.start("user", body).alias("p")), "p", "a:int, b:string")


@B.add("SELECT doc_id, 'in ' || lang || chr(10) AS block, NULL::VARCHAR AS two FROM documents")
def code_blocks(spark, d):
    body = F.concat(F.lit("So:\n```html\nin "), F.col("lang"), F.lit("\n```\nend"))
    return t(spark, d, "documents").select("doc_id", providers.code_block(body, "html").alias("block"), providers.code_block(F.concat(body, F.lit("\n"), body), "html").alias("two"))


@B.add("SELECT doc_id, CASE WHEN n_chars > 400 THEN left(text, (length(text) * 400 // n_chars)::BIGINT) ELSE text END AS text FROM documents")
def token_budget(spark, d):
    return t(spark, d, "documents").select("doc_id", providers.budget(F.col("text"), F.col("n_chars"), 400).alias("text"))


@B.add("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def best_fields(spark, d):
    return providers.reduce_fields(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@B.add("SELECT doc_id, n_chars + 2 AS grade FROM documents")
def graded(spark, d):
    grades = F.create_map(F.lit("a"), F.col("n_chars"), F.lit("b"), F.lit(2).cast("long"), F.lit("c"), F.lit(None).cast("long"))
    return t(spark, d, "documents").select("doc_id", providers.grade(grades).alias("grade"))


@B.add("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'had' ELSE 'got ' || url END AS html FROM pages")
def fetched_pages(spark, d):
    df = t(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "had").alias("html"))
    return providers.fetch(df, "url", lambda urls: [f"got {u}" for u in urls], "html", F.col("html").isNotNull()).drop("url")


@B.add("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{}' ELSE '{\"a\": ' || doc_id || ', \"b\": \"x\"}' END AS record FROM documents")
def checked_replies(spark, d):
    """A provider that breaks every third answer, and every fifth at the first try."""

    class Flaky:
        def __init__(self):
            self.seen = set()

        def __call__(self, texts):
            out = []
            for x in texts:
                i = int(json.loads(x)[-1]["content"])
                broken = i % 3 == 0 or (i % 5 == 0 and i not in self.seen)
                self.seen.add(i)
                out.append("no" if i % 5 == 0 and broken else f'Here: {{"b": "x"{"" if broken else f", {json.dumps("a")}: {i}"}}}')
            return out

    df = t(spark, d, "documents").select("doc_id", prompts.start("user", F.col("doc_id").cast("string")).alias("p"))
    return connect.checked(df, "p", Flaky(), ["a", "b"]).drop("p")


@B.add("SELECT page_id, '<h1>' || page_id || '</h1><h2>b</h2>' || chr(10) AS html FROM pages")
def mended_headings(spark, d):
    def mend(texts):
        return [f"```html\n<h1>{json.loads(x)[-1]['content']}</h1><h2>b</h2>\n```" for x in texts]

    df = t(spark, d, "pages").select("page_id", prompts.start("user", F.col("page_id").cast("string")).alias("p"))
    return connect.cleaned_headings(df, "p", mend).drop("p")


@B.add(rf"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)<h([1-6])\b', 1) AS v FROM ({HEADED_SQL})),
l AS (SELECT page_id, unnest(v)::INTEGER AS level, generate_subscripts(v, 1) AS k FROM h),
s AS (SELECT page_id, level, k, lag(level) OVER (PARTITION BY page_id ORDER BY k) AS before FROM l),
f AS (SELECT page_id, min_by('h' || level || ' follows h' || before, k) AS fault FROM s WHERE level > before + 1 GROUP BY page_id)
SELECT page_id, CASE WHEN len(v) = 0 THEN 'no heading' WHEN v[1] <> '1' THEN 'the first heading is not h1' ELSE coalesce(fault, '') END AS fault FROM h LEFT JOIN f USING (page_id)""")
def heading_faults(spark, d):
    return convert.map_text(headed_pages(spark, d), "html", "fault", connect.headings_fault).drop("html")


# search and files


def searcher(queries):
    return [json.dumps([{"url": f"http://x.org/{q}/{i}", "title": f"{q} News {i}", "date": f"2024-01-{10 * i + 1:02d}", "text": "t"} for i in range(3)]) for q in queries]


@B.add("SELECT n_nationkey, i::INTEGER AS rank, 'http://x.org/' || n_name || '/' || i AS url, n_name || ' News ' || i AS title FROM nation, range(1, 3) r(i) WHERE contains(lower(n_name || ' news ' || i), 'news')")
def search_hits(spark, d):
    hits = connect.search(t(spark, d, "nation"), "n_nationkey", "n_name", searcher)
    return connect.titled(connect.recent(hits, F.to_date(F.lit("2024-01-31")), 20), "NEWS, ").select("n_nationkey", "rank", "url", "title")


@B.add("SELECT page_id, 'https://site.org/' || page_id AS url, url AS other FROM pages")
def decoded_links(spark, d):
    inside = F.concat(F.lit("\x08\x13\x22\x1e"), F.lit("https://site.org/"), F.col("page_id").cast("string"), F.lit("\x01 tail"))
    code = F.translate(F.rtrim(F.base64(F.encode(inside, "ISO-8859-1")), F.lit("=")), "+/", "-_")
    wrapped = F.concat(F.lit("https://news.example/rss/articles/"), code, F.lit("?oc=5"))
    return t(spark, d, "pages").select("page_id", connect.decoded_address(wrapped).alias("url"), connect.decoded_address(F.col("url")).alias("other"))


def bytes_of(urls):
    return [None if i == "0" else (b"%PDF-1.4 one\x0ctwo" if int(i) % 2 else b"<html>") for i in urls]


@B.add("SELECT page_id, '// Page 1' || chr(10) || '%PDF-1.4 one' || chr(10) || '// Page 2' || chr(10) || 'two' AS text FROM pages WHERE page_id % 2 = 1")
def downloaded_pdfs(spark, d):
    got = connect.download(t(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("at")), "at", bytes_of)
    return connect.file_text(got, "content", lambda b: b.decode("latin-1").split("\x0c"), pages=True).select("page_id", "text")


@B.add("SELECT page_id, 'Corrupted Or Locked PDF' AS text FROM pages")
def broken_files(spark, d):
    df = t(spark, d, "pages").select("page_id", F.lit("x").cast("binary").alias("content"))
    return connect.file_text(df, "content", lambda b: [str(1 // 0)]).select("page_id", "text")


@B.add("SELECT url AS text FROM pages")
def binary_records(spark, d):
    return connect.unwrapped(connect.wrapped(t(spark, d, "pages").select(F.col("url").cast("binary").alias("c")), "c"), "record").select(F.col("content").cast("string").alias("text"))


@B.add("SELECT page_id, '<p>a<img src=\"/store/Uploads/image-1.png\" alt=\"' || page_id || '\">b</p>' AS html FROM pages")
def uploaded_images(spark, d):
    made = F.concat(F.lit('<p>a<img src="data:image/png;base64,aGk=" alt="'), F.col("page_id").cast("string"), F.lit('">b<img src="data:image/gif;base64,!!"></p>'))
    return convert.map_text(t(spark, d, "pages").select("page_id", made.alias("raw")), "raw", "html", lambda x: connect.upload_images(x, lambda path, body: f"/store{path}")).drop("raw")


# comparisons


@B.add("""WITH c AS (SELECT doc_id, i, i % 3 = 0 AS mark FROM documents, range(7) r(i)),
p AS (SELECT *, coalesce(max(CASE WHEN mark THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0)::INTEGER AS page_end FROM c),
s AS (SELECT *, coalesce(lag(page_end) OVER (PARTITION BY doc_id ORDER BY i), 0) AS page_start FROM p)
SELECT doc_id, i::INTEGER AS i, 'chunk ' || i AS text, page_start, page_end, (row_number() OVER (PARTITION BY doc_id, page_start ORDER BY i) - 1)::INTEGER AS local_index FROM s""")
def paged_chunks(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    rows = rows.withColumn("text", F.concat(F.lit("chunk "), F.col("i").cast("string"), F.when(F.col("i") % 3 == 0, F.concat(F.lit("__PAGE_"), F.col("i").cast("string"), F.lit("__"))).otherwise("")))
    return connect.paged_chunks(rows, "doc_id", "i", "text")


@B.add("""WITH v AS (SELECT q.vec_id AS k, o.vec_id AS o, list_cosine_similarity(q.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings o WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, o) AS n FROM v)
SELECT k AS vec_id, 'New passage:' || chr(10) || 'v' || k || chr(10) || chr(10) || 'Old passages:' || chr(10) || string_agg('v' || o, chr(10) || '---' || chr(10) ORDER BY n) AS content FROM r WHERE n <= 3 GROUP BY k""")
def comparison_prompts(spark, d):
    e = t(spark, d, "embeddings").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    new = e.where("vec_id % 50 = 0")
    near = vectors.top_k_queries(e, "vec_id", "embedding", new, "vec_id", "embedding", 3)
    return connect.comparison_prompts(e, new, near, "vec_id", "text").select("vec_id", F.col("prompt")[0]["content"].alias("content"))


@B.add("SELECT n_regionkey AS page, left(n_name, 1) AS kind, count(*) AS n, min(n_nationkey) AS first_index FROM nation GROUP BY ALL")
def comparison_summary(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_regionkey").alias("page"), F.left("n_name", F.lit(1)).alias("kind"), F.col("n_nationkey").alias("local_index"))
    return connect.comparison_summary(rows, "page", "kind")


# plans and trees


@B.add("SELECT n_regionkey AS document, min(n_name) AS first, count(*) AS n FROM nation GROUP BY 1")
def first_references(spark, d):
    got = documents.first_references(t(spark, d, "nation"), "n_regionkey", "n_name", "n_name")
    return got.join(t(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), "n_regionkey").select(F.col("n_regionkey").alias("document"), F.col("n_name").alias("first"), "n")


@B.add("SELECT n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN repeat('#', n_regionkey + 1) || ' ' || n_name END AS text FROM nation")
def applied_contents(spark, d):
    n = t(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("node"), F.lit("old").alias("text"), (F.col("n_regionkey") + 1).alias("depth"))
    given = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("text"))
    return documents.apply_contents(nodes, given, "node", "text", "depth", True).select("node", "text")


@B.add("SELECT n_regionkey AS k, string_agg(repeat('  ', n_nationkey % 3) || '- ' || n_name || CASE WHEN n_nationkey = 3 THEN ' <--' ELSE '' END, chr(10) ORDER BY n_nationkey) AS preview FROM nation GROUP BY 1")
def plan_preview(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") % 3).alias("depth"), F.col("n_name").alias("heading"), F.col("n_nationkey").alias("path"))
    return documents.preview(rows, "k", "depth", "heading", "path", F.col("path") == 3)


@B.add("SELECT conv_id, turn, coalesce(max(CASE WHEN turn % 2 = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), 0)::INTEGER AS page FROM conversations")
def running_pages(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("// Page "), F.col("turn").cast("string"))).otherwise("x").alias("text"))
    return documents.pages_of(rows, "conv_id", "turn", "text").select("conv_id", "turn", "page")


@B.add("SELECT doc_id, unnest(['0.0', '0.1', '1']) AS leaf FROM documents")
def tree_leaves(spark, d):
    tree = [{"children": [{}, {"children": []}]}, {}]
    made = t(spark, d, "documents").select("doc_id", F.lit(json.dumps(tree)).alias("tree"))
    return documents.parsed_rows(made, "doc_id", "tree", lambda x: [(".".join(map(str, p)),) for p in special.leaf_paths(json.loads(x))], "leaf string")


@B.add("SELECT n_nationkey AS k, n_name AS task FROM nation WHERE n_nationkey % 2 = 0")
def queued_tasks(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.lit("later"))).otherwise(F.array().cast("array<string>")).alias("q"))
    return special.next_tasks(rows, "k", "q")


@B.add("SELECT doc_id AS entity, 'text' AS field, 1 AS version_id, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'old' END AS value FROM documents")
def applied_changes(spark, d):
    base = t(spark, d, "documents").select(F.col("doc_id").alias("entity"), F.lit("text").alias("field"), F.lit(1).alias("version_id"))
    changes = base.where("entity % 2 = 0").select("*", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.lit(i).alias("at")) for i, v in enumerate(("first", "second"))))).alias("c")).select("entity", "field", "version_id", "c.value", "c.at")
    return special.apply_changes(base.withColumn("value", F.lit("old")), changes, "at")


@B.add("SELECT doc_id, 'g' AS \"group\", unnest(['a', 'b']) AS criterion, unnest([3.0, (doc_id % 5)::DOUBLE]) AS value, unnest(['is: so', lang]) AS analysis FROM documents")
def yaml_ballots(spark, d):
    made = F.concat(F.lit("```yaml\ng:\n  a:\n    a_analysis: is: so\n    a_value: 3\n  b:\n    b_analysis: \""), F.col("lang"), F.lit("\"\n    b_value: "), (F.col("doc_id") % 5).cast("string"), F.lit("\n```\n"))
    return special.ballots(t(spark, d, "documents").select("doc_id", made.alias("y")), "doc_id", "y")


@B.add("SELECT doc_id, 'T:' || chr(10) || '  c:' || chr(10) || '    c_analysis: text' || chr(10) || '    c_value: one of 1, ' || doc_id AS form FROM documents")
def grid_forms(spark, d):
    f = lambda x: [(special.grid_skeleton([{"name": "T", "rows": [{"name": "c", "possible_values": [{"value": 1}, {"value": x}]}]}]),)]
    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("x")), "doc_id", "x", f, "form string")


@B.add("SELECT doc_id, '# Report ' || lang || chr(10) || chr(10) || 'words' || chr(10) || chr(10) || '**M**: 3 cm' || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || '![i](u)' AS md FROM documents")
def report_markdown(spark, d):
    def f(lang):
        part = {"title": "Part", "contents": [{"info_type": "image", "title": "i", "url": "u"}]}
        body = [{"info_type": "text", "text": "words"}, {"info_type": "metric", "title": "M", "value": 3, "unit": "cm"}, {"info_type": "bullet_points", "items": ["a", "b"]}, {"info_type": "sections", "sections": [part]}]
        return [(special.tree_markdown({"title": f"Report {lang}", "contents": body}),)]

    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", f, "md string")


@B.add("SELECT doc_id, 'On ' || lang AS title, 'http://www.paper.org/a' AS url, '2024-01-30T10:00:00+00:00' AS published, 'Paper' AS source, 'some text' AS \"full\" FROM documents")
def feed_items(spark, d):
    from datetime import datetime, timezone

    item = lambda title, day: f"<item><title>{title}</title><link>http://www.paper.org/a</link><pubDate>{day} Jan 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;some&lt;/b&gt; text</description></item>"
    made = F.concat(F.lit("<rss><channel>" + item("Old", "Sat, 20")), F.replace(F.lit(item("On LANG", "Tue, 30")), F.lit("LANG"), F.col("lang")), F.lit("</channel></rss>"))
    return special.feeds(t(spark, d, "documents").select("doc_id", made.alias("x")), "doc_id", "x", datetime(2024, 1, 31, tzinfo=timezone.utc))


@B.add("SELECT page_id, 'Head ' || page_id AS title, 'Head ' || page_id || ' some text' AS text, ['a.png'] AS images FROM pages")
def article_cells(spark, d):
    made = F.concat(F.lit('<table><tr><td class="x article"><a href="u">Head '), F.col("page_id").cast("string"), F.lit('</a> some  text <img src="a.png"></td><td>no</td></tr></table>'))
    return documents.parsed_rows(t(spark, d, "pages").select("page_id", made.alias("x")), "page_id", "x", documents.article_cells, "title string, text string, images array<string>")


@B.add("SELECT n_nationkey, n_name, 1 AS mark FROM nation ORDER BY n_nationkey DESC LIMIT 10")
def blueprints(spark, d):
    """A plan whose parameters are the defaults that the operators' blueprints give."""
    ops = registry.load()
    keep = registry.blueprint(ops["order.keep_top"])["optional"]["keep"]["default"]
    top = {"operator": "order.keep_top", "parameters": {"field": "n_nationkey", "order": ["n_nationkey"], "keep": keep}, "inputs": {"df": "marked"}}
    marked = {"operator": "records.set_field", "parameters": {"name": "mark", "value": 1}, "inputs": {"df": "nation"}}
    plan = registry.Plan.of({"steps": {"top": top, "marked": marked}, "outputs": ["top"]})
    return plan.compile({"nation": t(spark, d, "nation").select("n_nationkey", "n_name")})["top"]


@B.add("SELECT 3 AS sections, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, sum(len(n_name)) AS size FROM nation")
def newsletter_row(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    out = aggregate.newsletter(t(spark, d, "region"), n, n.limit(0), "x", ["n_nationkey", "r_regionkey"])
    lists = F.lit(3)
    return out.select(lists.alias("sections"), F.array_join("articles.n_name", ",").alias("names"), F.aggregate("articles", F.lit(0).cast("long"), lambda s, x: s + F.length(x["n_name"])).alias("size"))


# pages


def sections_sql(limit):
    """The rounds of ``page_sections`` as SQL."""
    out = f"""WITH h AS ({HEADED_SQL}), b AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g') AS html FROM h),
c AS (SELECT page_id, string_split(regexp_replace(html, '(?i)(<h[1-6][\\s/>])', chr(1) || '\\1', 'g'), chr(1)) AS v FROM b),
e AS (SELECT page_id, unnest(v) AS part, generate_subscripts(v, 1) AS k FROM c),
r0 AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, part, nullif(regexp_extract(part, '(?i)^<h([1-6])[\\s/>]', 1), '')::INTEGER AS level,
trim(regexp_replace(regexp_replace(regexp_extract(part, '{page_sections.HEADING}', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
length(regexp_replace(part, '<[^>]*>|[ \\t\\r\\n\\f]+', '', 'g')) AS size, 0 AS start, []::VARCHAR[] AS path FROM e WHERE part <> '')"""
    for i in range(1, 7):
        out += f""", m{i} AS (SELECT *, min(CASE WHEN pos > start THEN level END) OVER w AS top, sum(size) OVER w AS whole FROM r{i - 1} WINDOW w AS (PARTITION BY page_id, start)),
k{i} AS (SELECT *, coalesce(pos > start AND level = top AND whole > {limit}, false) AS cut FROM m{i}),
n{i} AS (SELECT *, max(CASE WHEN cut THEN pos END) OVER run AS into_, last_value(CASE WHEN cut THEN title END IGNORE NULLS) OVER run AS name, bool_or(cut) OVER (PARTITION BY page_id, start) AS any_
FROM k{i} WINDOW run AS (PARTITION BY page_id, start ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r{i} AS (SELECT page_id, pos, part, level, title, size, coalesce(into_, start) AS start, CASE WHEN any_ THEN list_append(path, coalesce(name, '')) ELSE path END AS path FROM n{i})"""
    return out + f""", g AS (SELECT page_id, start, any_value(path) AS path, sum(size)::BIGINT AS size, string_agg(part, '' ORDER BY pos) AS html FROM r6 GROUP BY 1, 2),
o AS (SELECT page_id, start, path, size, CASE WHEN start > 0 THEN regexp_replace(html, '{page_sections.HEADING}', '') ELSE html END AS html FROM g)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY start) - 1)::INTEGER AS section, array_to_string(path, ' / ') AS path, size, html
FROM o WHERE NOT (len(path) > 0 AND path[-1] = '' AND trim(html) = '')"""


@B.add(sections_sql(400))
def split_pages(spark, d):
    found = page_sections.page_sections(headed_pages(spark, d), "page_id", "html", 400)
    return found.withColumn("path", F.array_join("path", " / "))


SUFFIXES = ("com", "net", "org", "example.org", "*.example.net", "!tiontion.example.net")


@B.add(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages), v AS (SELECT page_id, host, string_split(host, '.') AS v FROM h),
s AS (SELECT page_id, v, CASE WHEN host = 'tiontion.example.net' OR ends_with(host, '.tiontion.example.net') THEN 2 WHEN ends_with(host, '.example.net') THEN 3
WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 2 ELSE 1 END AS n, host FROM v)
SELECT page_id, CASE WHEN host <> '' AND len(v) > n THEN array_to_string(v[len(v) - n:], '.') END AS domain FROM s""")
def registered_domains(spark, d):
    rules = spark.createDataFrame([(r,) for r in SUFFIXES], "rule string")
    return hosts.registered_domains(t(spark, d, "pages").select("page_id", "url"), "url", rules).drop("url")


# versioned documents


PAGE = "<body><h1>Doc</h1><p>intro</p><h2>A</h2><p>{0}</p><h3>B</h3><ul><li>x</li></ul></body>"


@B.add("""SELECT page_id, unnest([0, 1, 2]) AS information, unnest([NULL, 0, 0]) AS parent, unnest(['sections', 'text', 'text']) AS kind, unnest(['Doc', '', 'A']) AS title,
unnest(['', '<p>intro</p>', '<p>' || page_id || '</p><h3>B</h3><ul><li>x</li></ul>']) AS contents FROM pages""")
def versioned_pages(spark, d):
    made = F.replace(F.lit(PAGE), F.lit("{0}"), F.col("page_id").cast("string"))
    flat = convert.map_text(t(spark, d, "pages").select("page_id", made.alias("raw")), "raw", "html", lambda x: x.replace("<h3>", "<h3>"))
    rows = documents.parsed_rows(flat, "page_id", "html", lambda x: versioned.rows(merged_below(versioned.from_page(x))), versioned.ROWS)
    return rows.select("page_id", "information", "parent", "kind", "title", "contents")


def merged_below(doc):
    """Second-level sections always stay sections; this one becomes a text to show what a deeper one does."""
    info = doc["information"]
    for i in [i for i, p in info.items() if i and "sections" in p]:
        inner = info[i]["sections"]
        body = "".join((f"<h3>{info[s]['title']}</h3>" if info[s]["title"] else "") + info[s]["contents"] for s in inner)
        info[i] = versioned.piece(info[i]["title"], contents=body)
        for s in inner:
            del info[s]
    return doc


@B.add("""SELECT doc_id, unnest([0, 1, 2, 3]) AS information, unnest(['New ' || lang, 'One', 'Two', 'Books']) AS title,
unnest(['', '<p><mention>@ you</mention></p><reference refid="7">Reference 7</reference>', 'b', 'refs']) AS contents FROM documents""")
def merged_changes(spark, d):
    def f(lang):
        doc = versioned.empty("x")
        text = {"html_content": '<p><mention>you</mention></p><reference refid="5">gone</reference>', "referencements": [{"refid": "ref 7", "informationid": "id 2", "position": 4, "html_contents": "q"}, {"refid": "8", "informationid": "99", "position": 1, "html_contents": ""}]}
        changes = [
            {"information_id": 0, "action": "title", "contents": {"title": f"New {lang}"}},
            {"information_id": 0, "action": "sections", "contents": {"sections": [{"title": "One", "contents": "a"}, {"title": "Two", "contents": "b"}]}},
            {"information_id": 1, "action": "text", "contents": text, "params": {"act_on_contents": True}},
            {"information_id": 0, "action": "bibliography", "contents": {"bibliography_title": "Books", "html_bibliography": "refs"}},
        ]
        return versioned.rows(versioned.merge(doc, changes))

    rows = documents.parsed_rows(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", f, versioned.ROWS)
    return rows.select("doc_id", "information", "title", "contents")


@B.add("SELECT doc_id, 'text' AS action, 'Better ' || lang AS html_content FROM documents")
def dispatched_tasks(spark, d):
    def f(lang):
        doc = {"title": "", "mother": 0, "information": {0: versioned.piece("T", contents=lang)}}
        made = versioned.dispatch(doc, {"name": "brush", "information_id": 0, "params": {}}, lambda p: json.dumps({"html_content": "Better " + p.split("\n")[-1]}))
        return [(made["action"], versioned.merge(doc, [made])["information"][0]["contents"])]

    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", f, "action string, html_content string")


@B.add("""SELECT doc_id, unnest([3, 1, 2, 0]) AS information, unnest([NULL, 3, 3, NULL]) AS parent, unnest(['sections', 'text', 'text', 'file']) AS kind,
unnest(['Plan ' || lang, 'A', 'B', 'File']) AS title, unnest(['', '<p>see  it</p>', '<p>x' || chr(10) || 'y</p>', '4']) AS contents FROM documents""")
def versioned_plans(spark, d):
    import re

    def f(lang):
        plan = versioned.plan_of(f"```yaml\ndocument:\n  title: Plan {lang}\n  sections:\n    - title: A\n      text: see <ref 9/> it<ref 4 : 2/>\n    - title: B\n      bullets: [x, y]\n```")
        doc = versioned.from_plan(plan, {4: "File"})
        doc["information"][1]["contents"] = re.sub(r"<reference[^>]*></reference>", "", doc["information"][1]["contents"])
        return versioned.rows(doc)

    rows = documents.parsed_rows(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", f, versioned.ROWS)
    return rows.select("doc_id", "information", "parent", "kind", "title", "contents")


@B.add("SELECT count(*) AS n, 25 AS ids, 20 AS inner_links FROM nation")
def plan_uuids(spark, d):
    nodes = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.when(F.col("n_nationkey") >= 5, (F.col("n_nationkey") % 5).cast("string")).alias("parent"))
    out = versioned.with_uuids(nodes, "node", "parent")
    return out.agg(F.count("*").alias("n"), F.countDistinct("node").cast("int").alias("ids"), F.count("parent").cast("int").alias("inner_links"))


@B.add("SELECT n_nationkey, 'base' AS knowledge FROM nation")
def plan_knowledge(spark, d):
    return versioned.with_knowledge(t(spark, d, "nation").select("n_nationkey"), F.lit("base"))


@B.add("SELECT doc_id, unnest(['Introduction', 'Methods']) AS title, unnest(['one' || chr(10) || 'two ' || lang, 'three']) AS contents FROM documents")
def outlined_texts(spark, d):
    made = F.concat(F.lit("Title page\n# Introduction\none\ntwo "), F.col("lang"), F.lit("\n# Methodes\nthree"))
    f = lambda x: [r for r in versioned.rows(versioned.from_outline(x, ["Introduction", "Methods"])) if r[1] is not None]
    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", made.alias("x")), "doc_id", "x", f, versioned.ROWS).select("doc_id", "title", "contents")


@B.add("SELECT doc_id, 'Doc' || chr(10) || '' AS t, '[0] Doc' || chr(10) || '  [1] A <<<' || chr(10) || '    in ' || lang || chr(10) || '    (note 3) n' AS text FROM documents")
def rendered_documents(spark, d):
    def f(lang):
        doc = versioned.empty()
        doc["information"][0] = versioned.piece("Doc", sections=[1])
        doc["information"][1] = versioned.piece("A", contents=f"<p>in {lang}</p>".replace("<p>", "").replace("</p>", "")) | {"notes": {3: "n"}}
        return [("Doc\n", versioned.rendered(doc, 1))]

    return documents.parsed_rows(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", f, "t string, text string")


@B.add("""WITH r AS (SELECT n_regionkey AS leaf, n_regionkey AS document, n_nationkey AS chunk, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1 END, CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE -length(n_name) END, n_nationkey) AS rank FROM nation)
SELECT leaf, document, chunk, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def referenced_chunks(spark, d):
    n = t(spark, d, "nation")
    chunks = n.select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("chunk"))
    whole = n.select(F.col("n_regionkey").alias("leaf"), F.col("n_regionkey").alias("document"), F.when(F.col("n_nationkey") % 7 == 0, F.col("n_nationkey")).alias("chunk"))
    ranked = n.select(F.col("n_regionkey").alias("leaf"), F.col("n_nationkey").alias("chunk"), F.length("n_name").cast("double").alias("sim"))
    return versioned.referenced_chunks(whole, chunks, ranked, 3)


@B.add("SELECT n_regionkey AS task, 'a' AS side, n_regionkey AS section, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM (SELECT n_nationkey, n_name, n_nationkey // 5 AS n_regionkey FROM nation) GROUP BY 1, 3")
def mapped_sections(spark, d):
    n = t(spark, d, "nation")
    pages = n.select(F.lit("a").alias("side"), F.col("n_nationkey").alias("page"), F.col("n_name").alias("text"))
    sections = spark.range(5).select(F.lit("a").alias("side"), F.col("id").cast("int").alias("section"), (F.col("id") * 5).cast("int").alias("page"))
    mapping = sections.select(F.col("section").alias("task"), "side", "section")
    return versioned.mapped_sections(mapping, sections, pages)


@B.add("SELECT n_regionkey AS document, '<html><style>p {}</style>' || string_agg(n_name, '<br>' ORDER BY n_nationkey) || '</html>' AS html FROM nation GROUP BY 1")
def assembled_html(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("path"), F.col("n_name").alias("text"))
    return versioned.assembled(rows, "document", "path", "text", lambda x: x.replace("\n\n", "<br>"), css="p {}")


# rows, bullets, grades


@B.add("SELECT doc_id, lang AS a, unnest([1, 2]) AS b FROM documents")
def extraction_entries(spark, d):
    made = F.concat(F.lit('[{"a": "'), F.col("lang"), F.lit('", "b": 1, "a_JUSTIFICATION": "x"}, {"a": "'), F.col("lang"), F.lit('", "b": 2}]'))
    return convert.entry_rows(t(spark, d, "documents").select("doc_id", made.alias("j")), "doc_id", "j", "a:string,b:int,a_JUSTIFICATION:string")


@B.add("SELECT doc_id, lang AS a FROM documents")
def extraction_record(spark, d):
    made = F.concat(F.lit('{"a": "'), F.col("lang"), F.lit('", "a_justification": "x"}'))
    return convert.entry_rows(t(spark, d, "documents").select("doc_id", made.alias("j")), "doc_id", "j", "a:string,a_justification:string", one=True)


@B.add("SELECT doc_id, 'See [1] and [2], [1] in ' || lang AS text FROM documents WHERE doc_id > 9")
def numbered_references(spark, d):
    tag = F.concat(F.lit("<ref "), F.col("doc_id").cast("string"))
    made = F.concat(F.lit("See "), tag, F.lit("/> and <ref 3 : 4/>, "), tag, F.lit(" : 2 /> in "), F.col("lang"))
    return t(spark, d, "documents").where("doc_id > 9").select("doc_id", convert.numbered_references(made).alias("text"))


@B.add("""WITH v AS (SELECT q.vec_id AS k, o.vec_id AS o, list_cosine_similarity(q.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings o WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, o) AS n FROM v)
SELECT k AS bullet, list(o ORDER BY n) AS chunks, string_agg('v' || o, chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 4 GROUP BY k""")
def bullet_chunks(spark, d):
    e = t(spark, d, "embeddings").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    return vectors.bullet_assignments(e.where("vec_id % 50 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", "text", 4)


@B.add("SELECT n_regionkey AS g, n_nationkey AS o, length(n_name)::DOUBLE AS score FROM nation")
def provider_grades(spark, d):
    def grade(prompts_):
        return [json.dumps([len(x) for x in json.loads(p)[-1]["content"].split("\n")]) for p in prompts_]

    n = t(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("o"), "n_name")
    return providers.scored_fields(n, "g", "o", "n_name", grade, 3)


@B.add("SELECT unnest(['schema', '1_document_level', '2_nations']) AS sheet, unnest([3, 5, 25]) AS n")
def nested_workbook(spark, d):
    held = t(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    fields = [{"name": "n_regionkey", "type": "int"}, {"name": "nations", "fields": [{"name": "n_name", "type": "str"}]}]
    book = files.workbook_frames(files.nested_workbook(held, fields))
    return spark.createDataFrame([(k, len(v)) for k, v in book.items()], "sheet string, n int")


QUERIES, ORACLES = B.queries, B.oracles
