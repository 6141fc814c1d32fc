"""Queries on texts: functions, segments, pages, conversations, bibliographies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import template
from weftline.functions import text as tx
from weftline.operators import aggregate, convert, documents, prompts, records, segment
from weftline.queries.base import Book, simplify_sql
from weftline.session import table as t
from weftline.sources import biblio

B = Book()
S = simplify_sql


@B.add(r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: length(x) > 2))::VARCHAR AS words FROM documents")
def word_count(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("string").alias("words"))


@B.add(f"SELECT doc_id, {S('text')} AS plain FROM documents")
def simplify(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.simplify(F.col("text")).alias("plain"))


@B.add("SELECT doc_id, left(text, 120) AS head FROM documents")
def beginning(spark, d):
    return t(spark, d, "documents").select("doc_id", F.left("text", F.lit(120)).alias("head"))


@B.add(r"SELECT doc_id, regexp_replace(text || ' [1] [12] [123]', '\[\d{1,2}\]', '', 'g') AS bare FROM documents")
def remove_refs(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.remove_refs(F.concat("text", F.lit(" [1] [12] [123]"))).alias("bare"))


@B.add("SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents".replace("\\\\", "\\"))
def split_text(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.split_literal(F.col("text"), ". ").alias("parts"))


@B.add("SELECT doc_id, 'A ' || lang || ' B ' || source AS line FROM documents")
def concat_two(spark, d):
    return t(spark, d, "documents").select("doc_id", template.fill_texts("A __text_1__ B __text_2__", F.col("lang"), F.col("source")).alias("line"))


@B.add("SELECT doc_id, lang || '/' || source || '/' || doc_id || '/' || n_chars AS line FROM documents")
def concat_four(spark, d):
    cols = [F.col(c).cast("string") for c in ("lang", "source", "doc_id", "n_chars")]
    return t(spark, d, "documents").select("doc_id", template.fill_texts("__text_1__/__text_2__/__text_3__/__text_4__", *cols).alias("line"))


@B.add("SELECT doc_id, NOT (lower(trim(lang)) IN ('false', '0', 'no', 'n', 'off')) AND lang <> '' AS yes FROM documents")
def to_bool(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.to_bool(F.col("lang")).alias("yes"))


@B.add("SELECT o_orderkey, '[' || o_orderkey || '] (' || strftime(o_orderdate, '%B %Y') || ') ' || o_orderstatus AS ref FROM orders")
def dated_refs(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tx.render_date_refs(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")).alias("ref"))


@B.add(r"SELECT page_id, regexp_extract(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) AS domain FROM pages")
def url_domain(spark, d):
    return t(spark, d, "pages").select("page_id", tx.domain_of(F.col("url")).alias("domain"))


SENTENCES = """SELECT doc_id, list_filter(string_split(replace(replace(text, chr(10), ' '), '. ', '. ' || chr(1)), chr(1)), lambda x: trim(x) <> '') AS s FROM documents"""
SEGMENTS = f"""WITH q AS ({SENTENCES}), f AS (
  SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(s, lambda x: {{'done': []::VARCHAR[], 'open': trim(x)}})),
    lambda a, x: CASE WHEN length(a.open || x.open || ' ') > 1000 THEN {{'done': list_append(a.done, a.open || x.open || ' '), 'open': ''}} ELSE {{'done': a.done, 'open': a.open || x.open || ' '}} END) AS r FROM q
), c AS (SELECT doc_id, CASE WHEN trim(r.open) <> '' THEN list_append(r.done, trim(r.open)) ELSE r.done END AS chunks FROM f)"""


@B.add(SEGMENTS + " SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS index, unnest(chunks) AS paragraphs FROM c")
def segment_rows(spark, d):
    return segment.segment_rows(t(spark, d, "documents").select("doc_id", "text"), "text", 1000, max_chunks=1_000_000, remove=True)


@B.add(SEGMENTS + " SELECT doc_id, CASE WHEN len(chunks) <= 3 THEN chunks ELSE chunks[:1] || chunks[-2:] END AS chunks FROM c")
def segment_head_tail(spark, d):
    return t(spark, d, "documents").select("doc_id", segment.ends(segment.segments(F.col("text"), 1000), 1, 2).alias("chunks"))


@B.add("SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: left(x, 200)) AS lines FROM documents")
def line_segment(spark, d):
    return t(spark, d, "documents").select("doc_id", segment.lines(F.col("text"), 200).alias("lines"))


@B.add("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
a AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
k AS (SELECT doc_id, pos::INTEGER AS pos, start::BIGINT AS start, left(raw, 1000) AS text FROM a WHERE raw <> '')
SELECT *, (start + length(text))::BIGINT AS stop, coalesce(last_value(CASE WHEN starts_with(text, '#') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'other') AS section FROM k""")
def smart_segment(spark, d):
    return segment.located_lines(t(spark, d, "documents"), ["doc_id"], "text", 1000)


@B.add()
def pack_segments(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(segment.packed(F.col("text"), 2000)).alias("chunk"))


@B.add()
def segment_uniform(spark, d):
    return segment.uniform_rows(t(spark, d, "documents"), "doc_id", "text", 1000)


@B.add()
def segment_headed(spark, d):
    return segment.headed_rows(t(spark, d, "documents"), "doc_id", "text", 750)


@B.add(SEGMENTS + r""", n AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS pos FROM c),
w AS (SELECT doc_id, pos::INTEGER AS pos, lang, chunk, len(list_filter(regexp_split_to_array(regexp_replace(chunk, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: length(x) > 2)) AS words FROM n JOIN documents USING (doc_id)),
u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY """ + S("chunk") + """ ORDER BY doc_id, pos) = 1)
SELECT lang, doc_id, pos, words::INTEGER AS words FROM u QUALIFY row_number() OVER (PARTITION BY lang ORDER BY words DESC, doc_id, pos) <= 20""")
def top_chunks(spark, d):
    """The flagship: chunks of all documents, the first of equal ones, the twenty richest of each language."""
    from pyspark.sql import Window

    chunks = segment.segment_rows(t(spark, d, "documents").select("doc_id", "lang", "text"), "text", 1000, "chunk", "pos", 1_000_000, remove=True)
    plain = tx.simplify(F.col("chunk"))
    # 128 bits stand for the chunk, so that no text enters the shuffle
    keyed = chunks.select("doc_id", "pos", "lang", tx.word_count(F.col("chunk")).alias("words"), plain.alias("plain")).select("*", F.xxhash64("plain").alias("k1"), F.xxhash64(F.lit("chunk"), "plain").alias("k2"))
    first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos", "lang", "words")).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("words"), "doc_id", "pos"))
    return first.withColumn("r", rank).where("r <= 20").select("lang", "doc_id", "pos", "words")


TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@B.add(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, d):
    return t(spark, d, "pages").select("page_id", documents.title(F.col("html")).alias("title"))


@B.add("SELECT page_id, regexp_replace(html, '(?i)<img[^>]*/?>', '', 'g') AS html FROM pages")
def remove_images(spark, d):
    return t(spark, d, "pages").select("page_id", documents.remove_images(F.col("html")).alias("html"))


@B.add("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1))) AS links FROM pages""")
def page_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.array_sort(documents.links(F.col("html"))).alias("links"))


@B.add(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark, d):
    return t(spark, d, "pages").select("page_id", documents.plain_text(F.col("html")).alias("text"))


BARE = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
FOUND = r"""nullif(regexp_extract(html, '(?i)<meta\s[^>]*(?:name|property|itemprop)="{0}"[^>]*content="(\d{{4}}-\d{{2}}-\d{{2}})', 1), '')"""
MAIN = r"CASE WHEN contains(lower(html), '<article') THEN regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) ELSE regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) END"
BODY = r"coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)"


@B.add(
    "WITH p AS (SELECT *, " + BARE.format(MAIN) + " AS main_text FROM pages) SELECT page_id, coalesce("
    + ", ".join(FOUND.format(m) for m in documents.DATE_META)
    + r""", nullif(regexp_extract(html, '(?i)<time\s[^>]*datetime="(\d{4}-\d{2}-\d{2})', 1), '')) AS date, CASE WHEN length(main_text) > 100 THEN main_text ELSE """
    + BARE.format(BODY)
    + " END AS text FROM p"
)
def page_dates(spark, d):
    return t(spark, d, "pages").select("page_id", documents.page_date(F.col("html")).alias("date"), documents.main_text(F.col("html")).alias("text"))


@B.add()
def page_headings(spark, d):
    return documents.parsed_rows(t(spark, d, "pages"), "page_id", "html", documents.heading_rows, "node int, parent int, level int, title string, text string")


@B.add()
def page_contract(spark, d):
    def held(html):
        short, kept = documents.contract(html)
        return [(short, len(kept), documents.expand(short, kept) == documents.parse(html).html())]

    return documents.parsed_rows(t(spark, d, "pages"), "page_id", "html", held, "contracted string, n int, restored boolean")


@B.add("SELECT conv_id, string_agg(trim(coalesce(text, '')), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_builder(spark, d):
    return aggregate.build_text(t(spark, d, "conversations"), "text", ["turn"], group=["conv_id"])


@B.add("SELECT conv_id, 'All: ' || string_agg('- ' || trim(text), '; ' ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def text_builder_formatted(spark, d):
    return aggregate.build_formatted(t(spark, d, "conversations"), "text", ["turn"], "All: __text__", "- ", "; ", ["conv_id"])


@B.add("SELECT role, '|' || string_agg(conv_id::VARCHAR, '|' ORDER BY conv_id, turn) AS text FROM conversations GROUP BY role")
def concat_multi(spark, d):
    return aggregate.concat_multi(t(spark, d, "conversations").withColumn("c", F.col("conv_id").cast("string")), "c", ["conv_id", "turn"], "|", True, ["role"])


@B.add("SELECT role AS \"group\", 'Role ' || role || ':' || chr(10) || string_agg(conv_id || '.' || turn, chr(10) ORDER BY conv_id, turn) AS text FROM conversations GROUP BY role")
def group_render(spark, d):
    return aggregate.render_groups(t(spark, d, "conversations"), "{conv_id}.{turn}", "role", "Role {role}:", ["conv_id", "turn"]).drop("ord")


@B.add("SELECT string_agg(n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation")
def row_render(spark, d):
    return aggregate.render_rows(t(spark, d, "nation"), "{n_nationkey}: {n_name}", ["n_nationkey"])


@B.add("SELECT conv_id, count(*) AS n, arg_max(text, turn) AS last, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def prompt_build(spark, d):
    p = prompts.from_turns(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return p.select("conv_id", F.size("prompt").cast("long").alias("n"), prompts.last(F.col("prompt")).alias("last"), F.get("prompt", F.lit(0))["role"].alias("first_role"))


@B.add("SELECT doc_id, 'system' AS role, left(text, 50) AS content, 2 AS n FROM documents")
def prompt_start(spark, d):
    p = prompts.add(prompts.start("system", F.col("text"), 50), "user", F.lit("Go on."))
    return t(spark, d, "documents").select("doc_id", F.get(p, F.lit(0))["role"].alias("role"), F.get(p, F.lit(0))["content"].alias("content"), F.size(p).alias("n"))


@B.add("""WITH m AS (SELECT conv_id, turn, length(text) AS n, text, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT *, greatest(0, least(n, total - 300 - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY n DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS cut FROM m)
SELECT conv_id, string_agg(left(text, (n - cut)::BIGINT), '|' ORDER BY i) AS text FROM c GROUP BY conv_id""")
def prompt_truncate(spark, d):
    p = prompts.from_turns(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return p.select("conv_id", F.array_join(F.transform(prompts.truncate(F.col("prompt"), 300), lambda m: m["content"]), "|").alias("text"))


@B.add("SELECT doc_id, 'user' AS role, 'Text ' || doc_id || ' in ' || lang AS content FROM documents")
def prompt_template(spark, d):
    df = t(spark, d, "documents")
    m = F.get(prompts.start_template(df, "user", "Text {doc_id} in {lang}"), F.lit(0))
    return df.select("doc_id", m["role"].alias("role"), m["content"].alias("content"))


@B.add("SELECT doc_id, '' AS doi, source AS journal, text AS title, []::VARCHAR[] AS authors FROM documents")
def to_bib(spark, d):
    df = t(spark, d, "documents").select("doc_id", F.col("text").alias("title"), F.col("source").alias("journal"))
    made = convert.as_schema(df, "struct<doc_id:bigint,title:string,doi:string,journal:string,authors:array<string>>")
    return made.select("doc_id", "doi", "journal", "title", "authors")


@B.add("SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS line FROM documents".replace("\\\\", "\\"))
def text_rows(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(convert.urls_from(F.col("text"))).alias("line"))


@B.add("SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS kind FROM documents")
def text_kind(spark, d):
    return records.set_expression(t(spark, d, "documents").select("doc_id", "text"), "kind", "'table' if '|' in text else 'prose'").drop("text")


CELLS = r"list_transform(string_split(regexp_replace(trim({0}), '^\||\|$', '', 'g'), '|'), lambda x: trim(x))"


@B.add(
    "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS ls FROM documents), r AS (SELECT doc_id, "
    + CELLS.format("ls[1]")
    + " AS head, unnest(ls[3:]) AS line, generate_subscripts(ls[3:], 1) - 1 AS line_no FROM l WHERE len(ls) > 2), c AS (SELECT doc_id, head, line_no, "
    + CELLS.format("line")
    + " AS cells FROM r), v AS (SELECT doc_id, head, line_no, cells[1] AS row_name, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS i FROM c) "
    "SELECT doc_id, head[i + 1] AS column_name, row_name, value, line_no::INTEGER AS line_no FROM v WHERE i > 0 AND i < len(head) AND lower(value) NOT IN ('', 'null', 'not found', 'none', 'absent')"
)
def pipe_tables(spark, d):
    return convert.pipe_table(t(spark, d, "documents"), "doc_id", "text")


@B.add("SELECT doc_id::VARCHAR AS source, 0 AS entry, 'Paper ' || doc_id AS title, '' AS abstract, '' AS doi, '2015-10-15' AS date, source AS journal, 'ris' AS full_entry_type, ['One, A', 'Two, B'] AS authors, ['Journal Article'] AS type, []::VARCHAR[] AS keywords, []::VARCHAR[] AS affiliations FROM documents")
def biblio_round_trip(spark, d):
    made = F.concat(F.lit("TY  - JOUR\nTI  - Paper "), F.col("doc_id").cast("string"), F.lit("\nAU  - One, A\nAU  - Two, B\nPY  - 2015/10/15\nJO  - "), F.col("source"), F.lit("\nER  - \n"))
    return biblio.entries(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), made.alias("value")), "source", "value", "ris").drop("full_entry")


QUERIES, ORACLES = B.queries, B.oracles
