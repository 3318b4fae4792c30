"""Queries of parsers, joins and changes whose files or tables are derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import collaboration, editing, sentiment
from corpusloom.plans.analysis_queries import DICTIONARY, LEXICONS, _SENT_T, _scored
from corpusloom.plans.library_queries import CODE, SEG, coders, codes, docs, segs
from corpusloom.plans.registry import core
from corpusloom.plans.text_queries import SENTENCES
from corpusloom.session import table
from corpusloom.sinks import notes, tables
from corpusloom.sources import bibliography, codebooks, lexicons

# lexicon files: one line a code, as the forms have them


def _lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """Numbered lines made of codes: word, number."""
    c = codes(spark, sf_dir).dropDuplicates(["id"]).where("name is not null")
    word = F.regexp_replace("name", r"[\t:　 ]+", "")
    return c.select(F.col("id").cast("int").alias("line_no"), line(word, F.col("id")).alias("line")).where("line <> ''")


_WORD = "regexp_replace(name, '[\\t:　 ]+', '', 'g')"
_C = f"(SELECT id, any_value(name) AS name FROM {CODE} WHERE name IS NOT NULL GROUP BY id)"


@core.query("src_lex_takamura", f"SELECT w AS word, CAST(arg_max(p, id) AS DOUBLE) AS polarity FROM (SELECT {_WORD} AS w, (id % 21 - 10) / 10.0 AS p, id FROM {_C} WHERE id % 7 <> 0) GROUP BY 1")
def src_lex_takamura(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda i: F.when(i % 7 == 0, "bad").otherwise(((i % 21 - 10) / 10.0).cast("string"))
    return lexicons.parse(_lines(spark, sf_dir, lambda w, i: F.concat_ws(":", w, F.lit("yomi"), F.lit("noun"), score(i))), "colon")


@core.query("src_lex_tohoku", f"SELECT w AS word, CAST(arg_max(p, id) AS DOUBLE) AS polarity FROM (SELECT {_WORD} AS w, CASE WHEN id % 2 = 0 THEN 1.0 ELSE -1.0 END AS p, id FROM {_C} WHERE id % 3 <> 0) GROUP BY 1")
def src_lex_tohoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda i: F.when(i % 3 == 0, "other").when(i % 2 == 0, "posi").otherwise("nega")
    return lexicons.parse(_lines(spark, sf_dir, lambda w, i: F.concat(w, F.lit("\t"), kind(i))), "tab_polarity")


@core.query("src_lex_tohoku_wago", f"SELECT w AS word, CAST(arg_max(p, [CAST(p <> 0 AS BIGINT), id]) AS DOUBLE) AS polarity FROM (SELECT {_WORD} AS w, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS p, id FROM {_C}) GROUP BY 1")
def src_lex_tohoku_wago(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda i: F.when(i % 3 == 0, "ポジ（経験）").when(i % 3 == 1, "ネガ（評価）").otherwise("その他")
    return lexicons.parse(_lines(spark, sf_dir, lambda w, i: F.concat(kind(i), F.lit("\t"), F.substring(w, 1, 1), F.lit("　 "), F.expr("substring(regexp_replace(name, '[\\\\t:　 ]+', ''), 2)"))), "verb_phrases")


@core.query("src_lex_tohoku_noun", f"SELECT w AS word, CAST(arg_max(p, id) AS DOUBLE) AS polarity FROM (SELECT {_WORD} AS w, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS p, id FROM {_C} WHERE id % 4 <> 3) GROUP BY 1")
def src_lex_tohoku_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda i: F.when(i % 4 == 0, "p").when(i % 4 == 1, "n").when(i % 4 == 2, "e").otherwise("a")
    return lexicons.parse(_lines(spark, sf_dir, lambda w, i: F.concat(w, F.lit("\t"), kind(i))), "nouns")


@core.query("src_codebook_xml", f"SELECT CAST(id AS VARCHAR) AS source, 0 AS preorder, CAST(NULL AS INT) AS parent_preorder, 0 AS depth, coalesce(name, '') AS name, nullif(trim(coalesce(definition, '')), '') AS definition FROM (SELECT id, any_value(name) AS name, any_value(definition) AS definition FROM {CODE} GROUP BY id) UNION ALL SELECT CAST(id AS VARCHAR), 1, 0, 1, 'below', NULL FROM (SELECT DISTINCT id FROM {CODE})")
def src_codebook_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir).dropDuplicates(["id"])
    esc = lambda x: T.html_escape(F.coalesce(x, F.lit("")))
    xml = F.concat(F.lit('<P xmlns="urn:x"><Codes><Code name="'), esc(F.col("name")), F.lit('"><Description> '), esc(F.col("definition")), F.lit(' </Description><Code name="below"/></Code></Codes></P>'))
    return codebooks.parse_codebooks(c.select(F.col("id").cast("string").alias("source"), xml.alias("value"))).drop("color")


@core.query("src_biblio_meta", "SELECT nullif(citation_key, '') AS citation_key, nullif(title, '') AS title, nullif(array_to_string(list_filter(authors, lambda a: a IS NOT NULL AND a <> ''), '; '), '') AS author, nullif(year, 0) AS year, nullif(language, '') AS language, nullif(source, '') AS source FROM (SELECT DISTINCT * FROM zotero_entry)")
def src_biblio_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zotero_entry").distinct()
    item = F.struct(F.col("citation_key").alias("citationKey"), "title", F.col("authors").alias("creators"), F.col("year").alias("date"), "language", F.col("source").alias("publicationTitle"))
    return bibliography.to_metadata(bibliography.parse_bibliography(z.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))))


@core.query("src_label", "SELECT page_id, coalesce(source_image, 'page.png') || '#p' || (page_index + 1) AS label FROM ocr_page p LEFT JOIN qda_document d ON d.id = p.document_id")
def src_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("id").alias("_d"), "source_image")
    p = table(spark, sf_dir, "ocr_page").join(d, F.col("document_id") == F.col("_d"), "left")
    return p.select("page_id", F.concat(F.coalesce("source_image", F.lit("page.png")), F.lit("#p"), (F.col("page_index") + 1).cast("string")).alias("label"))


@core.query("snk_csv", f"SELECT c.id, c.name, c.parent_id, c.definition, coalesce(f, 0) AS frequency, coalesce(d, 0) AS n_documents FROM {CODE} c LEFT JOIN (SELECT code_id, count(*) AS f, count(DISTINCT document_id) AS d FROM {SEG} GROUP BY 1) n ON n.code_id = c.id")
def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.codes_table(codes(spark, sf_dir), segs(spark, sf_dir))


@core.query("jn_sent_export", f"WITH {SENTENCES}, {_scored(_SENT_T)} SELECT k[1] AS document_id, d.title, 'sentence' AS unit, CAST(k[2] AS INT) AS char_start, polarity, {DICTIONARY} AS dictionary FROM scored JOIN qda_document d ON d.id = k[1]")
def jn_sent_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return tables.sentiment_table(sentiment.analyze(d, "sentence", LEXICONS), d).drop("char_end")


# relations: the parent links of codes


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir).dropDuplicates(["id"]).where("parent_id is not null")
    return c.select("id", F.col("parent_id").alias("code_a_id"), F.col("id").alias("code_b_id"), F.when(F.col("id") % 2 == 0, "is-a").otherwise("part-of").alias("relation_type"))


_REL = f"(SELECT id, any_value(parent_id) AS a, id AS b, CASE WHEN id % 2 = 0 THEN 'is-a' ELSE 'part-of' END AS t FROM {CODE} WHERE parent_id IS NOT NULL GROUP BY id)"


@core.query("jn_relation_names", f"SELECT r.id, '- [[' || a.name || ']] ' || r.t || ' [[' || b.name || ']]' AS line FROM {_REL} r JOIN {_C} a ON a.id = r.a JOIN {_C} b ON b.id = r.b")
def jn_relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir).dropDuplicates(["id"]).where("name is not null")
    return notes.relation_note(_relations(spark, sf_dir), c)


@core.query("flt_relation", f"SELECT id, a AS code_a_id, b AS code_b_id FROM {_REL} WHERE t = 'is-a'")
def flt_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir).withColumn("project_id", F.lit(1))
    return editing.relations_of(r, 1, "is-a").select("id", "code_a_id", "code_b_id")


# memos: one a document and one a project


def _memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("id", "project_id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("document_id"), F.lit(None).cast("long").alias("segment_id"), F.col("title").alias("content"), (F.col("id") % 5 == 0).alias("is_journal"), "created_at")


@core.query("flt_memo", "SELECT id, title AS content FROM qda_document WHERE project_id = 1 AND id % 3 <> 0")
def flt_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.memos_of(_memos(spark, sf_dir), "project", 1).select("id", "content")


@core.query("mut_memo", "SELECT id, CASE WHEN id % 10 = 0 THEN 'edited' ELSE title END AS content FROM qda_document")
def mut_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memos(spark, sf_dir).select("id", "content")
    return editing.upsert(m, m.where("id % 10 = 0").withColumn("content", F.lit("edited")), ["id"])


@core.query("mut_collection", "SELECT id AS document_id, CASE WHEN era = 'early' THEN 1 ELSE 2 END AS collection_id FROM qda_document WHERE era IS NOT NULL UNION SELECT id, 1 FROM qda_document WHERE id % 4 = 0")
def mut_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    have = d.where("era is not null").select(F.col("id").alias("document_id"), F.when(F.col("era") == "early", 1).otherwise(2).alias("collection_id"))
    return editing.add_members(have, d.where("id % 4 = 0").select(F.col("id").alias("document_id"), F.lit(1).alias("collection_id")))


@core.query("mut_lexicon", f"SELECT word, language, CAST(CASE WHEN n % 2 = 0 THEN 0.5 ELSE -0.5 END AS DOUBLE) AS polarity FROM (SELECT {_WORD} AS word, CASE WHEN min(id) % 2 = 0 THEN 'ja' END AS language, min(id) AS n FROM {_C} GROUP BY 1)")
def mut_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir).where("name is not null").select(F.regexp_replace("name", r"[\t:　 ]+", "").alias("word"), "id").groupBy("word").agg(F.min("id").alias("n"))
    old = c.select("word", F.when(F.col("n") % 2 == 0, "ja").alias("language"), F.lit(9.0).alias("polarity"))
    new = c.select("word", F.when(F.col("n") % 2 == 0, "ja").alias("language"), F.when(F.col("n") % 2 == 0, 0.5).otherwise(-0.5).alias("polarity"))
    return editing.upsert(old, new, ["word", "language"])


@core.query("mut_account", "SELECT id, CASE WHEN id % 2 = 0 THEN 'viewer' ELSE role END AS role FROM qda_coder")
def mut_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coders(spark, sf_dir).select("id", "role")
    return editing.upsert(c, c.where("id % 2 = 0").withColumn("role", F.lit("viewer")), ["id"])


@core.query("mut_coder_delete", f"SELECT count(*) AS n_segments FROM {SEG} WHERE coder_id IS DISTINCT FROM 1")
def mut_coder_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = _memos(spark, sf_dir).withColumn("coder_id", F.lit(1))
    _, left, _, _ = editing.delete_coder(1, coders(spark, sf_dir), segs(spark, sf_dir), memo, memo)
    return left.agg(F.count("*").alias("n_segments"))


@core.query("mut_coding_remove", f"SELECT code_id, count(*) AS n FROM {SEG} WHERE id % 3 <> 0 GROUP BY 1")
def mut_coding_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir)
    return editing.remove_codings(s, s.where("id % 3 = 0").select("id")).groupBy("code_id").agg(F.count("*").alias("n"))


@core.query("mut_code_create", f"""WITH c AS (SELECT id, any_value(project_id) AS p, any_value(color) AS color FROM {CODE} GROUP BY id), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS n FROM c)
SELECT id, coalesce(color, ['#D36868','#D39E68','#D3D368','#9ED368','#68D368','#68D39E','#68D3D3','#689ED3','#6868D3','#9E68D3','#D368D3','#D3689E'][1 + n % 12]) AS color FROM n""")
def mut_code_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.sort_colors(codes(spark, sf_dir).dropDuplicates(["id"])).select("id", "color")


@core.query("mut_audit_project", "WITH a AS (SELECT e.event_id, e.event_type, 1 + e.user_id % 40 AS coder FROM events e WHERE e.event_id % 50 <> 0) SELECT c.project_id, a.event_type AS action, count(*) AS n FROM a JOIN qda_coder c ON c.id = a.coder GROUP BY 1, 2")
def mut_audit_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 != 0, 1 + F.col("user_id") % 40).alias("coder_id"), F.col("event_type").alias("action"))
    return collaboration.of_project(e, coders(spark, sf_dir)).groupBy("project_id", "action").agg(F.count("*").alias("n"))


@core.query("jn_lock_doc", "SELECT id AS document_id, title, 1 + id % 3 AS coder_id FROM qda_document WHERE id % 2 = 0")
def jn_lock_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    log = d.where("id % 2 = 0").select(F.col("id").alias("document_id"), (1 + F.col("id") % 3).alias("coder_id"), F.col("created_at").alias("at"), F.lit("acquire").alias("kind"))
    return collaboration.locks_with_titles(collaboration.lock_state(log), d).drop("acquired_at")


@core.query("fn_en_tokens", "SELECT id, len(regexp_extract_all(coalesce(body, ''), '[A-Za-z'']+')) AS n_tokens, lower(regexp_extract_all(coalesce(body, ''), '[A-Za-z'']+')[1]) AS first FROM qda_document")
def fn_en_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sentiment.word_hits(F.col("body"), sorted(sentiment.NEGATIONS_EN))
    return docs(spark, sf_dir).select("id", F.size(h).cast("long").alias("n_tokens"), F.get(h, F.lit(0))["word"].alias("first"))


@core.query("fn_dict_merge", "SELECT word, CAST(max_by(polarity, p) AS DOUBLE) AS polarity FROM (SELECT name AS word, id % 7 - 3 AS polarity, 1 AS p FROM qda_code WHERE id % 2 = 0 AND name IS NOT NULL UNION ALL SELECT name, id % 5 - 2, 2 FROM qda_code WHERE id % 3 = 0 AND name IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT (p, polarity)) = count(DISTINCT p)")
def fn_dict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of every second code's name with one of every third's on top; names that one of them has twice are left out."""
    c = codes(spark, sf_dir).where("name is not null")
    a = c.where("id % 2 = 0").select(F.col("name").alias("word"), (F.col("id") % 7 - 3).cast("double").alias("polarity")).distinct()
    b = c.where("id % 3 = 0").select(F.col("name").alias("word"), (F.col("id") % 5 - 2).cast("double").alias("polarity")).distinct()
    twice = a.groupBy("word").count().unionByName(b.groupBy("word").count()).where("count > 1").select("word").distinct()
    return sentiment.merge_frames(a, b).join(twice, "word", "left_anti")
