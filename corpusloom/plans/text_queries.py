"""Queries of scalar and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.registry import core
from corpusloom.session import table

# the same white space for DuckDB's RE2
WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = "[^" + WS[1:]
PIECE = r"[^。．！？!?\n]*(?:[。．！？!?]+|\n+)|[^。．！？!?\n]+"
DOC = "(SELECT id, any_value(body) AS body FROM qda_document GROUP BY id)"

SENTENCES = f"""
piece AS (SELECT id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all(coalesce(body, ''), '{PIECE}') AS l FROM {DOC})),
sentence AS (SELECT id, p, CAST(sum(length(p)) OVER (PARTITION BY id ORDER BY i) - length(p) AS INT) AS char_start,
                    CAST(sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS INT) AS char_end FROM piece)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").dropDuplicates(["id"])


@core.query("fn_sentence_spans", f"WITH {SENTENCES} SELECT id, char_start, char_end FROM sentence WHERE regexp_matches(p, '{NON_WS}')")
def fn_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.explode(T.sentence_spans(F.col("body"))).alias("u")).select("id", "u.char_start", "u.char_end")


_PARTS = rf"""
cuts AS (SELECT id, body, string_split_regex(coalesce(body, ''), '\n{WS}*\n') AS parts, regexp_extract_all(coalesce(body, ''), '\n{WS}*\n') AS seps FROM {DOC}),
part AS (SELECT id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i, seps FROM cuts),
placed AS (SELECT id, p, i, coalesce(length(seps[i]), 0) AS s, sum(length(p) + coalesce(length(seps[i]), 0)) OVER (PARTITION BY id ORDER BY i) AS z FROM part)"""


@core.query("fn_paragraph_spans", f"WITH {_PARTS} SELECT id, CAST(z - s - length(p) AS INT) AS char_start, CAST(z - s AS INT) AS char_end FROM placed WHERE regexp_matches(p, '{NON_WS}')")
def fn_paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.explode(T.paragraph_spans(F.col("body"))).alias("u")).select("id", "u.char_start", "u.char_end")


PARAGRAPH_STARTS = f"{_PARTS}, starts AS (SELECT id, z - s AS at FROM placed WHERE s > 0)"


@core.query(
    "fn_paragraph_index",
    f"""WITH {PARAGRAPH_STARTS}, seg AS (SELECT DISTINCT id AS segment_id, document_id, char_start FROM qda_segment)
SELECT g.segment_id, CAST(count(t.at) AS INT) AS paragraph FROM seg g JOIN {DOC} d ON d.id = g.document_id
LEFT JOIN starts t ON t.id = g.document_id AND t.at <= g.char_start GROUP BY g.segment_id""",
)
def fn_paragraph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "qda_segment").select(F.col("id").alias("segment_id"), "document_id", "char_start").distinct()
    d = docs(spark, sf_dir).select("id", T.paragraph_starts(F.col("body")).alias("starts"))
    return s.join(d, F.col("document_id") == F.col("id")).select("segment_id", T.paragraph_index(F.col("starts"), F.col("char_start")).alias("paragraph"))


@core.query(
    "fn_char_spans",
    f"SELECT id, CAST(count(*) AS BIGINT) AS n_units, max(e) AS last_end FROM (SELECT id, unnest(range(1, length(body) + 1)) AS e FROM {DOC}) GROUP BY id",
)
def fn_char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = docs(spark, sf_dir).select("id", F.explode(T.char_spans(F.col("body"))).alias("u"))
    return u.groupBy("id").agg(F.count("*").alias("n_units"), F.max("u.char_end").cast("long").alias("last_end"))


@core.query(
    "fn_atomic_spans",
    f"""WITH seg AS (SELECT DISTINCT id, document_id, char_start, char_end FROM qda_segment), d AS (SELECT id, length(coalesce(body, '')) AS n FROM {DOC}),
pt AS (SELECT document_id AS id, unnest([char_start, char_end]) AS p FROM seg), c AS (
  SELECT DISTINCT d.id, greatest(0, least(p, n)) AS p FROM pt JOIN d ON d.id = pt.id UNION SELECT id, 0 FROM d UNION SELECT id, n FROM d),
nx AS (SELECT id, p, lead(p) OVER (PARTITION BY id ORDER BY p) AS q FROM c)
SELECT id, CAST(p AS INT) AS char_start, CAST(q AS INT) AS char_end FROM nx WHERE q IS NOT NULL""",
)
def fn_atomic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.agreement import document_units

    s = table(spark, sf_dir, "qda_segment").dropDuplicates(["id"])
    return document_units(docs(spark, sf_dir), "segment", s).select(F.col("document_id").alias("id"), F.col("us").alias("char_start"), F.col("ue").alias("char_end"))


_OLD = "國學體廣觀假聲會豐鐵號圓藝缺辭舊寶獨當經惠醫齋櫻氣澤驛萬與亂佛戰禮勳獻歸ゐゑヰヱゝゞヽヾ"
_NEW = "国学体広観仮声会豊鉄号円芸欠辞旧宝独当経恵医斎桜気沢駅万与乱仏戦礼勲献帰いえイエ"


@core.query("fn_normalize", f"SELECT id, translate(body, '{_OLD}', '{_NEW}') AS body, translate(author, '{_OLD}', '{_NEW}') AS author FROM qda_document")
def fn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").select("id", T.normalize_old(F.col("body")).alias("body"), T.normalize_old(F.col("author")).alias("author"))


@core.query(
    "fn_lang_detect",
    """WITH c AS (SELECT id, len(regexp_extract_all(coalesce(body, ''), '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]')) AS k,
  len(regexp_extract_all(coalesce(body, ''), '[A-Za-z]')) AS l FROM qda_document)
SELECT id, CASE WHEN k = 0 AND l = 0 THEN 'und' WHEN k >= l THEN 'ja' ELSE 'en' END AS lang FROM c""",
)
def fn_lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").select("id", T.detect_language(F.col("body")).alias("lang"))


@core.query(
    "fn_ngrams",
    f"""WITH t AS (SELECT id, regexp_replace(coalesce(title, ''), '{WS}+', '', 'g') AS t FROM qda_document),
g AS (SELECT id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END) AS gram FROM t)
SELECT id, gram, count(*) AS n FROM g GROUP BY id, gram""",
)
def fn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "qda_document").select("id", F.explode(T.ngrams(F.col("title"))).alias("gram"))
    return t.groupBy("id", "gram").agg(F.count("*").alias("n"))


@core.query("fn_year_parse", "SELECT entry_id, TRY_CAST(nullif(regexp_extract(raw, '(\\d{4})', 1), '') AS INT) AS year FROM (SELECT DISTINCT entry_id, raw FROM zotero_entry)")
def fn_year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zotero_entry").select("entry_id", "raw").distinct().select("entry_id", T.year_of(F.col("raw")).alias("year"))


@core.query(
    "fn_wikilinks",
    """WITH n AS (SELECT id, 'see [[' || coalesce(title, '') || ']] and [[' || name || '|here]] or [[' || name || '#top]]' AS t FROM
  (SELECT DISTINCT d.id, d.title, c.name FROM qda_document d JOIN qda_code c ON c.id = d.id)),
l AS (SELECT id, t, list_filter(list_transform(regexp_extract_all(t, '\\[\\[([^\\]\\|#]+)[^\\]]*\\]\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS x FROM n)
SELECT id, t, array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i), lambda i: x[i]), ';') AS links FROM l""",
)
def fn_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "qda_code").select(F.col("id").alias("_c"), "name")
    d = table(spark, sf_dir, "qda_document").select("id", "title").join(c, F.col("id") == F.col("_c")).select("id", "title", "name").distinct()
    t = d.select("id", F.concat(F.lit("see [["), F.coalesce("title", F.lit("")), F.lit("]] and [["), "name", F.lit("|here]] or [["), "name", F.lit("#top]]")).alias("t"))
    return t.select("id", "t", F.array_join(T.wikilinks(F.col("t")), ";").alias("links"))


_CITE = """
WITH d AS (SELECT id, coalesce(trim(author), '') AS a, coalesce(trim(title), '') AS t, coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n.d.') AS y, coalesce(trim(era), '') AS s FROM qda_document)
SELECT id, trim(a || ' (' || y || '). ' || t || '.' || CASE WHEN s = '' THEN '' ELSE ' ' || s || '.' END) AS apa,
 trim(a || '. "' || t || '." ' || CASE WHEN s = '' THEN '' ELSE s || ', ' END || y || ', p. 1.') AS chicago,
 trim(a || '. ' || t || '. ' || CASE WHEN s = '' THEN '' ELSE s || ', ' END || y || '.') AS sist02 FROM d"""


@core.query("fn_citation", _CITE)
def fn_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("author", "title", "year", "era")]
    return table(spark, sf_dir, "qda_document").select("id", T.citation(*c, "apa").alias("apa"), T.citation(*c, "chicago", locator=F.lit("p. 1")).alias("chicago"), T.citation(*c).alias("sist02"))


@core.query(
    "fn_segment_citation",
    """WITH g AS (SELECT DISTINCT id, document_id, char_start, char_end FROM qda_segment)
SELECT g.id, CASE WHEN q = '' OR q IS NULL THEN c ELSE '「' || q || '」（' || c || '）' END AS citation FROM (
 SELECT g.id, substring(d.body, g.char_start + 1, g.char_end - g.char_start) AS q,
  trim(coalesce(trim(d.author), '') || '. ' || coalesce(trim(d.title), '') || '. ' || CASE WHEN src = '' THEN '' ELSE src || ', ' END || coalesce(CAST(nullif(d.year, 0) AS VARCHAR), 'n.d.') || '.') AS c
 FROM g JOIN (SELECT *, coalesce(nullif(trim(json_extract_string(metadata_json, '$.source')), ''), trim(era), '') AS src FROM qda_document) d ON d.id = g.document_id) g""",
)
def fn_segment_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.coding import quotes

    d = table(spark, sf_dir, "qda_document")
    s = table(spark, sf_dir, "qda_segment").select("id", "document_id", "char_start", "char_end").distinct()
    m = d.select(F.col("id").alias("_m"), "author", "title", "year", F.coalesce(F.nullif(F.trim(F.get_json_object("metadata_json", "$.source")), F.lit("")), "era").alias("src"))
    q = quotes(s, d).join(m, F.col("document_id") == F.col("_m"))
    return q.select("id", T.citation(F.col("author"), F.col("title"), F.col("year"), F.col("src"), quote=F.col("quote")).alias("citation"))


@core.query(
    "fn_colors",
    """SELECT id, CASE WHEN NOT coalesce(regexp_full_match(color, '#[0-9A-Fa-f]{6}'), false) THEN '#000000'
 WHEN (0.299 * ('0x' || color[2:3])::INT + 0.587 * ('0x' || color[4:5])::INT + 0.114 * ('0x' || color[6:7])::INT) / 255 > 0.55 THEN '#000000' ELSE '#ffffff' END AS ink,
 ['#D36868','#D39E68','#D3D368','#9ED368','#68D368','#68D39E','#68D3D3','#689ED3','#6868D3','#9E68D3','#D368D3','#D3689E'][1 + id % 12] AS fill
FROM (SELECT DISTINCT id, color FROM qda_code)""",
)
def fn_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_code").select("id", "color").distinct().select("id", T.text_color(F.col("color")).alias("ink"), T.auto_color(F.col("id")).alias("fill"))


@core.query(
    "fn_color_scale",
    """WITH n AS (SELECT code_id, count(*) AS n FROM (SELECT DISTINCT id, code_id FROM qda_segment) GROUP BY code_id), p AS (SELECT max(n) AS m FROM n)
SELECT code_id, n, format('#ff{:02x}{:02x}', CAST(floor(255 * (1 - n / m)) AS INT), CAST(floor(220 * (1 - n / m)) AS INT)) AS color FROM n, p""",
)
def fn_color_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.coding import code_frequency

    n = code_frequency(table(spark, sf_dir, "qda_segment").dropDuplicates(["id"])).withColumnRenamed("n_segments", "n")
    peak = n.agg(F.max("n")).first()[0] or 0
    return n.select("code_id", "n", T.color_scale(F.col("n"), F.lit(peak)).alias("color"))


@core.query(
    "fn_safe_name",
    """SELECT id, CASE WHEN trim(regexp_replace(coalesce(file_path, ''), '[\\\\/:*?"<>|]+', '_', 'g')) = '' THEN 'untitled' ELSE trim(regexp_replace(coalesce(file_path, ''), '[\\\\/:*?"<>|]+', '_', 'g')) END AS name,
 '#' || regexp_replace(trim(coalesce(title, '')), '[ 　]+', '_', 'g') AS tag, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM qda_document""",
)
def fn_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").select("id", T.safe_name(F.col("file_path")).alias("name"), T.tag(F.coalesce("title", F.lit(""))).alias("tag"), T.html_escape(F.col("title")).alias("html"))


@core.query("fn_json", "SELECT id, json_extract_string(metadata_json, '$.source') AS source, json_extract_string(metadata_json, '$.shelfmark') AS shelfmark FROM qda_document")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("metadata_json", "map<string,string>")
    return table(spark, sf_dir, "qda_document").select("id", m["source"].alias("source"), m["shelfmark"].alias("shelfmark"))


@core.query(
    "fn_layout_label",
    "SELECT id, CASE language WHEN 'ja' THEN 'Japanese' WHEN 'en' THEN 'English' ELSE 'Unknown' END || CASE WHEN language = 'und' THEN '' WHEN coalesce(script = 'vertical', false) THEN ' vertical' ELSE ' horizontal' END AS label FROM qda_document",
)
def fn_layout_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").select("id", T.layout_label(F.col("language"), F.coalesce(F.col("script") == "vertical", F.lit(False))).alias("label"))
