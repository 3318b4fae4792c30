"""Queries of library search, codings, codebook, export tables and bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import coding, editing, pages
from corpusloom.operators.search import SearchSpec, search
from corpusloom.plans.registry import core
from corpusloom.session import table
from corpusloom.sinks import notes, tables

SEG = "(SELECT DISTINCT id, document_id, code_id, coder_id, char_start, char_end, status FROM qda_segment)"
CODE = "(SELECT DISTINCT id, project_id, parent_id, name, definition, color, sort_order FROM qda_code)"
_COUNTS = f"d.id, d.title, d.author, d.year, d.era, d.language, d.confidence, coalesce(n.n, 0) AS code_count FROM qda_document d LEFT JOIN (SELECT document_id, count(*) AS n FROM {SEG} GROUP BY 1) n ON n.document_id = d.id"


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.distinct_segments(table(spark, sf_dir, "qda_segment").select("id", "document_id", "code_id", "coder_id", "char_start", "char_end", "status"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_code").select("id", "project_id", "parent_id", "name", "definition", "color", "sort_order").distinct()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document")


def coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_coder")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one era as a collection."""
    return docs(spark, sf_dir).where("era is not null").select(F.col("id").alias("document_id"), F.when(F.col("era") == "early", 1).otherwise(2).alias("collection_id"))


def _register_search(name: str, spec: SearchSpec, where: str, members: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(docs(spark, sf_dir), segs(spark, sf_dir), spec, _members(spark, sf_dir) if members else None)

    core.query(name, f"SELECT {_COUNTS} WHERE {where}")(run)


_WORDS = r"' ' || trim(regexp_replace(translate(lower(coalesce({0}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def _phrase(q: str) -> str:
    w = f" {q.lower()} "
    words = f"(contains({_WORDS.format('title')}, '{w}') OR contains({_WORDS.format('body')}, '{w}'))"
    chars = f"(contains(lower(coalesce(title, '')), lower('{q}')) OR contains(lower(coalesce(body, '')), lower('{q}')))"
    return f"CASE WHEN coalesce(language IN ('en', 'eng', 'english'), false) THEN {words} ELSE {chars} END"


_register_search("flt_search", SearchSpec(query="harbour master", year_min=1700, year_max=1850, coded=True), f"{_phrase('harbour master')} AND year BETWEEN 1700 AND 1850 AND coalesce(n.n, 0) > 0")
_register_search("flt_fts_trigram", SearchSpec(query="古い"[:2] + "農"), _phrase("古い農"))
_register_search("flt_fts_unicode61", SearchSpec(query="toll gate keeper"), _phrase("toll gate keeper"))
_register_search("flt_like_short", SearchSpec(query="Of"), "lower(coalesce(title, '')) LIKE '%of%' OR lower(coalesce(body, '')) LIKE '%of%'")
_register_search("flt_lang", SearchSpec(language="en", order_by="title"), "language = 'en'")
_register_search("flt_author", SearchSpec(author="society"), "translate(author, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%society%'")
_register_search("flt_year", SearchSpec(year_min=1800, order_by="year", descending=True), "year >= 1800")
_register_search("flt_coded", SearchSpec(coded=False), "coalesce(n.n, 0) = 0")
_register_search("flt_collection", SearchSpec(collection_id=1, project_id=1), "era = 'early' AND project_id = 1", members=True)
_register_search("srt_search", SearchSpec(order_by="code_count", descending=True), "true")


@core.query("agg_code_count", f"SELECT document_id, count(DISTINCT id) AS n_codings FROM {SEG} GROUP BY 1")
def agg_code_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segs(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_codings"))


@core.query("agg_code_freq", f"SELECT code_id, count(*) AS n_segments FROM {SEG} GROUP BY 1")
def agg_code_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.code_frequency(segs(spark, sf_dir))


@core.query(
    "agg_code_summary",
    f"""SELECT c.id, c.project_id, c.parent_id, c.name, c.definition, coalesce(f, 0) AS frequency, coalesce(d, 0) AS n_documents FROM {CODE} c
LEFT JOIN (SELECT code_id, count(*) AS f, count(DISTINCT document_id) AS d FROM {SEG} GROUP BY 1) n ON n.code_id = c.id""",
)
def agg_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.code_summary(codes(spark, sf_dir), segs(spark, sf_dir))


@core.query(
    "agg_examples",
    f"""SELECT code_id, array_to_string(list(q ORDER BY id), '|') AS quotes FROM (SELECT s.code_id, s.id, substring(d.body, s.char_start + 1, s.char_end - s.char_start) AS q
FROM {SEG} s JOIN qda_document d ON d.id = s.document_id) WHERE q <> '' GROUP BY code_id""",
)
def agg_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.examples(segs(spark, sf_dir), docs(spark, sf_dir)).select("code_id", F.array_join("quotes", "|").alias("quotes"))


@core.query("agg_distinct_lang", "SELECT DISTINCT language FROM qda_document WHERE language IS NOT NULL")
def agg_distinct_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("language is not null").select("language").distinct().orderBy("language")


@core.query("agg_year_range", "SELECT project_id, min(year) AS first_year, max(year) AS last_year FROM qda_document GROUP BY 1")
def agg_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("project_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@core.query("agg_collection_size", "SELECT c AS collection_id, count(d.id) AS n FROM (VALUES (1), (2), (3)) v(c) LEFT JOIN qda_document d ON d.era IS NOT NULL AND (CASE WHEN d.era = 'early' THEN 1 ELSE 2 END) = c GROUP BY 1")
def agg_collection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.search import collection_sizes

    return collection_sizes(spark.createDataFrame([(1,), (2,), (3,)], "id int"), _members(spark, sf_dir))


@core.query(
    "jn_doc_collections",
    "SELECT d.id, CASE WHEN d.era = 'early' THEN 'early' ELSE 'other' END AS collection FROM qda_document d WHERE d.era IS NOT NULL",
)
def jn_doc_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.search import document_collections

    names = spark.createDataFrame([(1, "early"), (2, "other")], "id int, name string")
    return document_collections(_members(spark, sf_dir), names).select(F.col("document_id").alias("id"), F.col("name").alias("collection"))


@core.query(
    "jn_segment_code_coder",
    f"""SELECT s.id, s.document_id, s.code_id, s.coder_id, s.char_start, s.char_end, s.status, c.name AS code_name, c.color AS code_color, k.name AS coder_name
FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id LEFT JOIN qda_coder k ON k.id = s.coder_id""",
)
def jn_segment_code_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.enrich(segs(spark, sf_dir), codes(spark, sf_dir), coders(spark, sf_dir))


@core.query("flt_point", f"SELECT id, document_id, code_id, char_start, char_end FROM {SEG} WHERE char_start <= 100 AND 100 < char_end")
def flt_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.codings_at(segs(spark, sf_dir), 100).select("id", "document_id", "code_id", "char_start", "char_end")


@core.query("prj_quote", f"SELECT s.id, substring(d.body, s.char_start + 1, s.char_end - s.char_start) AS quote FROM {SEG} s JOIN qda_document d ON d.id = s.document_id")
def prj_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.quotes(segs(spark, sf_dir), docs(spark, sf_dir)).select("id", "quote")


@core.query("win_layers")
def win_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.layers(segs(spark, sf_dir))


@core.query(
    "win_depth",
    f"""WITH s AS (SELECT * FROM {SEG} WHERE char_end > char_start), open AS (SELECT a.document_id, a.id, count(*) AS n FROM s a JOIN s b ON b.document_id = a.document_id AND b.char_start <= a.char_start AND b.char_end > a.char_start GROUP BY 1, 2)
SELECT document_id, CAST(max(n) AS INT) AS n_layers FROM open GROUP BY 1""",
)
def win_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of each document: as many as segments that are open at one place."""
    s = segs(spark, sf_dir).where("char_end > char_start")
    return coding.layers(s).groupBy("document_id").agg((F.max("layer") + 1).cast("int").alias("n_layers"))


@core.query("srt_segments", f"SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY char_start, char_end, id) AS place FROM {SEG}")
def srt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.in_order(segs(spark, sf_dir)).select("id", "place")


_TREE = f"""WITH RECURSIVE c AS (SELECT id, any_value(project_id) AS project_id, any_value(name) AS name, any_value(sort_order) AS so, any_value(parent_id) AS parent_id FROM {CODE} GROUP BY id),
t AS (SELECT c.id, c.project_id, 0 AS depth, [[c.so, c.id]] AS path FROM c LEFT JOIN c p ON p.id = c.parent_id WHERE p.id IS NULL
      UNION ALL SELECT c.id, t.project_id, t.depth + 1, list_append(t.path, [c.so, c.id]) FROM t JOIN c ON c.parent_id = t.id)"""


def _preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.hierarchy import preorder

    return preorder(codes(spark, sf_dir))


@core.query("gr_walk", _TREE + " SELECT id, project_id, depth, CAST(row_number() OVER (PARTITION BY project_id ORDER BY path) AS BIGINT) AS place FROM t")
def gr_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preorder(spark, sf_dir).select("id", "project_id", "depth", "place")


@core.query("lim_quick9", _TREE + ", r AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY path) AS hotkey FROM t) SELECT project_id, hotkey, id FROM r WHERE hotkey <= 9")
def lim_quick9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preorder(spark, sf_dir).where("place <= 9").select("project_id", F.col("place").alias("hotkey"), "id")


@core.query("agg_max_sort", f"SELECT parent_id, coalesce(max(sort_order), -1) + 1 AS next_order FROM {CODE} GROUP BY parent_id")
def agg_max_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.next_sort_order(codes(spark, sf_dir))


@core.query("mut_code_delete", _TREE + f", gone AS (SELECT id FROM t WHERE list_contains(list_transform(path, lambda x: x[2]), (SELECT min(id) FROM t WHERE depth = 0))) SELECT count(*) AS n_segments FROM {SEG} s WHERE s.code_id NOT IN (SELECT id FROM gone)")
def mut_code_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.hierarchy import resolve_hierarchy

    c = codes(spark, sf_dir).dropDuplicates(["id"])
    first = resolve_hierarchy(c, paths=False).where("depth = 0").agg(F.min("id")).first()[0]
    left = editing.delete_codes(c, segs(spark, sf_dir), [first])[1]
    return left.agg(F.count("*").alias("n_segments"))


@core.query("mut_status", f"SELECT id, CASE WHEN status = 'draft' AND coder_id = 1 THEN 'reviewed' ELSE status END AS status FROM {SEG}")
def mut_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir)
    return editing.set_status(s, s.where("status = 'draft' and coder_id = 1").select("id"), "reviewed").select("id", "status")


@core.query("mut_coding_add", f"SELECT count(*) AS n, count(DISTINCT (document_id, code_id, coder_id, char_start, char_end)) AS n_spans FROM (SELECT document_id, code_id, coder_id, char_start, char_end FROM {SEG} UNION ALL SELECT DISTINCT document_id, code_id, coder_id, char_start + 1, char_end + 1 FROM {SEG} s WHERE NOT EXISTS (SELECT 1 FROM {SEG} t WHERE t.document_id = s.document_id AND t.code_id = s.code_id AND t.coder_id = s.coder_id AND t.char_start = s.char_start + 1 AND t.char_end = s.char_end + 1))")
def mut_coding_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir)
    new = s.select("document_id", "code_id", "coder_id", (F.col("char_start") + 1).alias("char_start"), (F.col("char_end") + 1).alias("char_end"), F.lit("draft").alias("status"))
    key = editing.SPAN_KEY
    return editing.add_codings(s, new).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*key)).alias("n_spans"))


@core.query("fn_coalesce_fill", """WITH z AS (SELECT entry_id, any_value(title) AS t, any_value(year) AS y FROM zotero_entry GROUP BY 1)
SELECT d.id, coalesce(nullif(d.title, ''), z.t) AS title, coalesce(d.year, z.y) AS year FROM qda_document d LEFT JOIN z ON z.entry_id = d.id""")
def fn_coalesce_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zotero_entry").groupBy(F.col("entry_id").alias("id")).agg(F.first("title").alias("title"), F.first("year").alias("year"))
    return editing.fill_metadata(docs(spark, sf_dir).select("id", "title", "year"), z).select("id", "title", "year")


@core.query("lim_first", "SELECT project_id, min(id) AS first_coder FROM qda_coder GROUP BY 1")
def lim_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coders(spark, sf_dir).groupBy("project_id").agg(F.min("id").alias("first_coder"))


_SPOILT = f"(SELECT id, CASE WHEN id % 19 = 0 THEN -document_id ELSE document_id END AS document_id, CASE WHEN id % 23 = 0 THEN -code_id ELSE code_id END AS code_id, coder_id, char_start, CASE WHEN id % 17 = 0 THEN char_start ELSE char_end END AS char_end, CASE WHEN id % 29 = 0 THEN 'lost' WHEN id % 31 = 0 THEN NULL ELSE status END AS status FROM {SEG})"


@core.query("validate_segments", f"""SELECT id, 'empty span' AS reason FROM {_SPOILT} WHERE NOT coalesce(char_end > char_start, false) UNION ALL
SELECT id, 'unknown document' FROM {_SPOILT} s WHERE NOT EXISTS (SELECT 1 FROM qda_document d WHERE d.id = s.document_id) UNION ALL
SELECT id, 'unknown code' FROM {_SPOILT} s WHERE NOT EXISTS (SELECT 1 FROM qda_code c WHERE c.id = s.code_id) UNION ALL
SELECT id, 'unknown status' FROM {_SPOILT} WHERE NOT coalesce(status IN ('draft', 'reviewed', 'confirmed'), false)""")
def validate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations among all segments, some of which are spoilt here."""
    s = segs(spark, sf_dir)
    off = lambda k, c, bad: F.when(F.col("id") % k == 0, bad).otherwise(F.col(c))
    status = F.when(F.col("id") % 29 == 0, "lost").when(F.col("id") % 31 != 0, F.col("status"))
    s = s.withColumns({"document_id": off(19, "document_id", -F.col("document_id")), "code_id": off(23, "code_id", -F.col("code_id")), "char_end": off(17, "char_end", F.col("char_start")), "status": status})
    return editing.validate_segments(s, docs(spark, sf_dir), codes(spark, sf_dir))


# export tables and notes


@core.query(
    "jn_segment_export",
    f"""SELECT s.id, s.document_id, d.title, c.name AS code, k.name AS coder, s.char_start, s.char_end, s.status, substring(d.body, s.char_start + 1, s.char_end - s.char_start) AS quote
FROM {SEG} s JOIN qda_document d ON d.id = s.document_id JOIN {CODE} c ON c.id = s.code_id LEFT JOIN qda_coder k ON k.id = s.coder_id""",
)
def jn_segment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.segments_table(segs(spark, sf_dir), docs(spark, sf_dir), codes(spark, sf_dir), coders(spark, sf_dir))


@core.query("prj_metadata", "SELECT id, title, author, year, era, language, script, ocr_engine, confidence FROM qda_document")
def prj_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.metadata_table(docs(spark, sf_dir))


@core.query("agg_report_counts", f"""SELECT p.project_id, n_documents, coalesce(n_segments, 0) AS n_segments FROM (SELECT project_id, count(*) AS n_documents FROM qda_document GROUP BY 1) p
LEFT JOIN (SELECT d.project_id, count(*) AS n_segments FROM {SEG} s JOIN qda_document d ON d.id = s.document_id GROUP BY 1) s ON s.project_id = p.project_id""")
def agg_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("id", "project_id")
    n = d.groupBy("project_id").agg(F.count("*").alias("n_documents"))
    per = segs(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("k"))
    s = per.join(d, F.col("document_id") == F.col("id")).groupBy(F.col("project_id").alias("_p")).agg(F.sum("k").alias("s"))
    return n.join(s, F.col("project_id") == F.col("_p"), "left").select("project_id", "n_documents", F.coalesce("s", F.lit(0)).alias("n_segments"))


@core.query("snk_md", """SELECT id, CASE WHEN trim(regexp_replace(coalesce(title, ''), '[\\\\/:*?"<>|]+', '_', 'g')) = '' THEN 'untitled' ELSE trim(regexp_replace(coalesce(title, ''), '[\\\\/:*?"<>|]+', '_', 'g')) END AS name,
'---' || chr(10) || concat_ws(chr(10), 'title: ' || title, 'author: ' || author, 'year: ' || year, 'era: ' || era, 'language: ' || language, '---') || chr(10) || chr(10) || '# 本文' || chr(10) || chr(10) || coalesce(body, '') || chr(10) AS text FROM qda_document""")
def snk_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.markdown_text(docs(spark, sf_dir).select("id", "title", "author", "year", "era", "language", "body"))


@core.query("snk_vault")
def snk_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.vault_notes(docs(spark, sf_dir), segs(spark, sf_dir), codes(spark, sf_dir))


# pages


@core.query(
    "agg_ocr_lines",
    """WITH w AS (SELECT page_id, word_index, any_value(line_index) AS line_index, any_value(text) AS text, any_value(x) AS x, any_value(y) AS y, any_value(w) AS w, any_value(h) AS h, any_value(confidence) AS confidence FROM ocr_word GROUP BY 1, 2)
SELECT page_id, line_index, string_agg(text, ' ' ORDER BY word_index) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, avg(CASE WHEN confidence >= 0 THEN confidence END) AS confidence FROM w GROUP BY 1, 2""",
)
def agg_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines_from_words(table(spark, sf_dir, "ocr_word"))


@core.query(
    "agg_ocr_conf",
    """WITH w AS (SELECT page_id, word_index, any_value(confidence) AS c FROM ocr_word GROUP BY 1, 2), m AS (SELECT page_id, avg(CASE WHEN c >= 0 THEN c END) AS mean_confidence, count(*) AS n_words FROM w GROUP BY 1)
SELECT page_id, mean_confidence, n_words, coalesce(mean_confidence < 0.6, false) AS needs_review FROM m""",
)
def agg_ocr_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_confidence(table(spark, sf_dir, "ocr_word"))


@core.query("agg_doc_join", "SELECT document_id, trim(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_index, page_id)) AS body, avg(confidence) AS confidence, count(*) AS n_pages FROM ocr_page GROUP BY 1")
def agg_doc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.documents_from_pages(table(spark, sf_dir, "ocr_page"))


@core.query(
    "flt_bbox_hit",
    """WITH w AS (SELECT page_id, line_index, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM ocr_word GROUP BY 1, 2), p AS (SELECT page_id AS point_id, page_id, 150 AS px, 160 AS py FROM ocr_page),
h AS (SELECT p.point_id, w.line_index, row_number() OVER (PARTITION BY p.point_id ORDER BY (w.r - w.x) * (w.b - w.y), w.line_index) AS n FROM p JOIN w ON w.page_id = p.page_id AND px BETWEEN x AND r AND py BETWEEN y AND b)
SELECT point_id, line_index FROM h WHERE n = 1""",
)
def flt_bbox_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "ocr_page").select(F.col("page_id").alias("point_id"), "page_id", F.lit(150).alias("px"), F.lit(160).alias("py"))
    return pages.hit_test(pages.lines_from_words(table(spark, sf_dir, "ocr_word")), points)


@core.query("mut_correction", """WITH w AS (SELECT page_id, word_index, any_value(line_index) AS line_index, any_value(text) AS text FROM ocr_word GROUP BY 1, 2),
l AS (SELECT page_id, line_index, string_agg(text, ' ' ORDER BY word_index) AS text FROM w GROUP BY 1, 2)
SELECT page_id, line_index, CASE WHEN line_index = 0 THEN text || ' *' ELSE text END AS corrected, line_index = 0 AS dirty FROM l""")
def mut_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.lines_from_words(table(spark, sf_dir, "ocr_word")).select("page_id", "line_index", "text")
    edits = lines.where("line_index = 0").select("page_id", "line_index", F.concat("text", F.lit(" *")).alias("corrected"))
    return editing.overlay_corrections(lines, edits).select("page_id", "line_index", "corrected", "dirty")


# bibliography


@core.query(
    "src_biblio",
    """SELECT DISTINCT entry_id, coalesce(nullif(citation_key, ''), 'e' || entry_id) AS key, nullif(title, '') AS title, coalesce(array_to_string(list_filter(authors, lambda a: a IS NOT NULL AND a <> ''), ';'), '') AS authors, year, nullif(language, '') AS language, nullif(source, '') AS source FROM zotero_entry""",
)
def src_biblio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.sources.bibliography import parse_bibliography

    z = table(spark, sf_dir, "zotero_entry").distinct()
    item = F.struct(F.col("citation_key").alias("citationKey"), F.concat(F.lit("e"), "entry_id").alias("id"), "title", F.col("authors").alias("creators"), F.col("year").alias("date"), "language", F.col("source").alias("publicationTitle"), F.col("entry_id").alias("entry"))
    texts = z.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    e = parse_bibliography(texts)
    return e.select(F.get_json_object("raw", "$.entry").cast("long").alias("entry_id"), "key", F.col("title"), F.array_join("authors", ";").alias("authors"), "year", "language", "source").distinct()


@core.query("src_md", """SELECT id, title, author, year, language, coalesce(body, '') || chr(10) AS body FROM (SELECT id, 'doc ' || id AS title, 'unknown' AS author, coalesce(year, 1700) AS year, 'xx' AS language, regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g') AS body FROM qda_document)""")
def src_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.sources.markdown import parse_markdown

    d = docs(spark, sf_dir).select("id", F.concat(F.lit("doc "), F.col("id").cast("string")).alias("title"), F.lit("unknown").alias("author"), F.coalesce("year", F.lit(1700)).alias("year"), F.lit("xx").alias("language"), F.regexp_replace(F.coalesce("body", F.lit("")), r"[\t\n\f\r ]+", " ").alias("body"))
    src = notes.markdown_text(d).select(F.col("text").alias("value"), F.concat(F.lit("/v/"), F.col("id").cast("string"), F.lit(".md")).alias("file_path"))
    e = parse_markdown(src)
    return e.select(F.regexp_extract("file_path", r"(\d+)\.md", 1).cast("long").alias("id"), "title", "author", "year", "language", "body")


@core.query("fn_gap", f"SELECT s.id, greatest(0, greatest(s.char_start, 100) - least(s.char_end, 200)) AS gap FROM {SEG} s")
def fn_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segs(spark, sf_dir).select("id", T.gap(F.col("char_start"), F.col("char_end"), F.lit(100), F.lit(200)).alias("gap"))
