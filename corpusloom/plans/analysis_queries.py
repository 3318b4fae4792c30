"""Queries of co-occurrence, agreement, sentiment, suggestion and collaboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import agreement, coding, collaboration, cooccurrence, sentiment
from corpusloom.plans.library_queries import CODE, SEG, coders, codes, docs, segs
from corpusloom.plans.registry import core
from corpusloom.plans.text_queries import NON_WS, PARAGRAPH_STARTS, SENTENCES
from corpusloom.session import table

_PS = f"ps AS (SELECT s.*, c.project_id AS project FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id WHERE char_end > char_start)"


def _pairs_sql(condition: str, extra: str = "") -> str:
    return f"""WITH {extra}{_PS} SELECT a.project, least(a.code_id, b.code_id) AS code_a, greatest(a.code_id, b.code_id) AS code_b, count(*) AS n
FROM ps a JOIN ps b ON a.project = b.project AND a.document_id = b.document_id AND a.id < b.id AND a.code_id <> b.code_id AND {condition} GROUP BY 1, 2, 3"""


OVERLAP = _pairs_sql("a.char_start < b.char_end AND b.char_start < a.char_end")


@core.query("agg_cooc_matrix", OVERLAP)
def agg_cooc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.pair_matrix(segs(spark, sf_dir), codes(spark, sf_dir))


@core.query("jn_interval_distance", _pairs_sql("greatest(0, greatest(a.char_start, b.char_start) - least(a.char_end, b.char_end)) <= 20"))
def jn_interval_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.pair_matrix(segs(spark, sf_dir), codes(spark, sf_dir), "distance", 20)


@core.query(
    "jn_same_paragraph",
    f"""WITH {PARAGRAPH_STARTS}, {_PS}, pp AS (SELECT p.id, p.project, p.document_id, p.code_id, count(t.at) AS par FROM ps p JOIN qda_document d ON d.id = p.document_id
LEFT JOIN starts t ON t.id = p.document_id AND t.at <= p.char_start GROUP BY 1, 2, 3, 4)
SELECT a.project, least(a.code_id, b.code_id) AS code_a, greatest(a.code_id, b.code_id) AS code_b, count(*) AS n FROM pp a JOIN pp b
ON a.project = b.project AND a.document_id = b.document_id AND a.par = b.par AND a.id < b.id AND a.code_id <> b.code_id GROUP BY 1, 2, 3""",
)
def jn_same_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.pair_matrix(segs(spark, sf_dir), codes(spark, sf_dir), "paragraph", documents=docs(spark, sf_dir))


@core.query(
    "agg_cooc_lookup",
    f"WITH m AS ({OVERLAP}) SELECT * FROM m UNION ALL SELECT project, code_b, code_a, n FROM m UNION ALL SELECT c.project_id, s.code_id, s.code_id, count(*) FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id GROUP BY 1, 2",
)
def agg_cooc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = segs(spark, sf_dir), codes(spark, sf_dir)
    return cooccurrence.with_diagonal(cooccurrence.pair_matrix(s, c), s, c)


for _dim in cooccurrence.DIMENSIONS:

    def _crosstab(spark: SparkSession, sf_dir: str, dim: str = _dim) -> DataFrame:
        return cooccurrence.crosstab(segs(spark, sf_dir), codes(spark, sf_dir), docs(spark, sf_dir), dim)

    core.query(
        f"agg_crosstab_{_dim}",
        f"SELECT s.code_id, c.name, CAST(d.{_dim} AS VARCHAR) AS value, count(*) AS n FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id JOIN qda_document d ON d.id = s.document_id WHERE d.{_dim} IS NOT NULL GROUP BY 1, 2, 3",
    )(_crosstab)


@core.query("agg_crosstab_wide", f"SELECT s.code_id, c.name, count(*) FILTER (d.era = 'early') AS early, count(*) FILTER (d.era = 'late') AS late FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id JOIN qda_document d ON d.id = s.document_id WHERE d.era IS NOT NULL GROUP BY 1, 2")
def agg_crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.crosstab_wide(cooccurrence.crosstab(segs(spark, sf_dir), codes(spark, sf_dir), docs(spark, sf_dir), "era"), ["early", "late"])


@core.query("agg_code_timeseries", f"SELECT s.code_id, d.year, count(*) AS n FROM {SEG} s JOIN qda_document d ON d.id = s.document_id WHERE d.year IS NOT NULL GROUP BY 1, 2")
def agg_code_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.timeseries(segs(spark, sf_dir), docs(spark, sf_dir))


@core.query("gr_nodes", f"SELECT c.id, c.name AS label, count(*) AS value, c.color FROM {CODE} c JOIN {SEG} s ON s.code_id = c.id GROUP BY 1, 2, 4")
def gr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.graph_nodes(segs(spark, sf_dir), codes(spark, sf_dir))


@core.query("gr_build", f"WITH m AS ({OVERLAP}) SELECT code_a AS source, code_b AS target, CAST(n AS DOUBLE) AS weight, 'cooccurrence' AS relation FROM m WHERE n >= 3 UNION ALL SELECT parent_id, id, 1.0, 'is-a' FROM {CODE} WHERE parent_id IS NOT NULL")
def gr_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir)
    rel = c.where("parent_id is not null").select(F.col("parent_id").alias("code_a_id"), F.col("id").alias("code_b_id"), F.lit(1.0).alias("weight"), F.lit("is-a").alias("relation_type"))
    return cooccurrence.graph_edges(cooccurrence.pair_matrix(segs(spark, sf_dir), c), rel, 3)


# agreement

_LAB = f"""{SENTENCES}, unit AS (SELECT id AS document_id, char_start AS us, char_end AS ue FROM sentence WHERE regexp_matches(p, '{NON_WS}')),
seg AS (SELECT DISTINCT document_id, coder_id, code_id, char_start, char_end FROM {SEG} WHERE coder_id IS NOT NULL),
lab AS (SELECT DISTINCT u.document_id, u.us, u.ue, s.coder_id, s.code_id FROM unit u JOIN seg s ON s.document_id = u.document_id AND s.char_start < u.ue AND u.us < s.char_end),
nu AS (SELECT document_id, CAST(count(*) AS DOUBLE) AS n FROM unit GROUP BY 1)"""


def _units(spark: SparkSession, sf_dir: str, kind: str = "sentence") -> DataFrame:
    return agreement.document_units(docs(spark, sf_dir), kind, segs(spark, sf_dir))


@core.query("jn_unit_label", f"WITH {_LAB} SELECT document_id, us, ue, coder_id, code_id FROM lab")
def jn_unit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.coded_units(_units(spark, sf_dir), segs(spark, sf_dir).where("coder_id is not null"))


@core.query("jn_unit_label_ratio", f"WITH {_LAB} SELECT DISTINCT u.document_id, u.us, u.ue, s.coder_id, s.code_id FROM unit u JOIN seg s ON s.document_id = u.document_id WHERE least(s.char_end, u.ue) - greatest(s.char_start, u.us) > 0 AND (least(s.char_end, u.ue) - greatest(s.char_start, u.us)) / (u.ue - u.us) >= 0.5")
def jn_unit_label_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.coded_units(_units(spark, sf_dir), segs(spark, sf_dir).where("coder_id is not null"), 0.5)


@core.query(
    "agg_pairwise",
    f"""WITH {_LAB}, k AS (SELECT DISTINCT document_id, coder_id FROM seg), one AS (SELECT document_id, code_id, coder_id, CAST(count(*) AS DOUBLE) AS k FROM lab GROUP BY 1, 2, 3),
cs AS (SELECT DISTINCT a.document_id, o.code_id, a.coder_id AS coder_a, b.coder_id AS coder_b FROM k a JOIN k b ON a.document_id = b.document_id AND a.coder_id < b.coder_id JOIN one o ON o.document_id = a.document_id AND o.coder_id IN (a.coder_id, b.coder_id)),
bo AS (SELECT a.document_id, a.code_id, a.coder_id AS coder_a, b.coder_id AS coder_b, CAST(count(*) AS DOUBLE) AS n11 FROM lab a JOIN lab b ON a.document_id = b.document_id AND a.us = b.us AND a.code_id = b.code_id AND a.coder_id < b.coder_id GROUP BY 1, 2, 3, 4),
f AS (SELECT c.*, n.n, coalesce(b.n11, 0) AS n11, coalesce(x.k, 0) AS n1, coalesce(y.k, 0) AS n2 FROM cs c JOIN nu n USING (document_id) LEFT JOIN bo b USING (document_id, code_id, coder_a, coder_b)
 LEFT JOIN one x ON x.document_id = c.document_id AND x.code_id = c.code_id AND x.coder_id = c.coder_a LEFT JOIN one y ON y.document_id = c.document_id AND y.code_id = c.code_id AND y.coder_id = c.coder_b),
g AS (SELECT *, (n - n1 - n2 + 2 * n11) / n AS po, (n1 * n2 + (n - n1) * (n - n2)) / (n * n) AS pe FROM f)
SELECT document_id, code_id, coder_a, coder_b, CAST(n AS BIGINT) AS n, CAST(n11 AS BIGINT) AS n11, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM g""",
)
def agg_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pairwise_kappa(_units(spark, sf_dir), segs(spark, sf_dir))


@core.query(
    "agg_reliability",
    f"""WITH {_LAB}, m AS (SELECT document_id, CAST(count(DISTINCT coder_id) AS DOUBLE) AS m FROM seg GROUP BY 1 HAVING count(DISTINCT coder_id) >= 2),
c AS (SELECT document_id, code_id, us, CAST(count(*) AS DOUBLE) AS c FROM lab GROUP BY 1, 2, 3), s AS (SELECT document_id, code_id, sum(c) AS ones, sum(c * c) AS sq FROM c GROUP BY 1, 2),
f AS (SELECT s.document_id, s.code_id, n, m, ones, m * ones - sq AS u, n * m AS t FROM s JOIN nu USING (document_id) JOIN m USING (document_id)),
g AS (SELECT *, 1 - 2 * u / (n * m * (m - 1)) AS p, (ones / t) * (ones / t) + (1 - ones / t) * (1 - ones / t) AS pe, 2 * u / (m - 1) / t AS ob, 2 * ones * (t - ones) / (t * (t - 1)) AS ex FROM f)
SELECT document_id, code_id, CAST(n AS BIGINT) AS n_units, CAST(m AS BIGINT) AS n_coders, CASE WHEN pe >= 1 THEN 1.0 ELSE (p - pe) / (1 - pe) END AS fleiss, CASE WHEN ex = 0 THEN CASE WHEN ob = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - ob / ex END AS alpha FROM g""",
)
def agg_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.group_agreement(_units(spark, sf_dir), segs(spark, sf_dir))


@core.query(
    "agg_disagree",
    f"""WITH {_LAB}, m AS (SELECT document_id, count(DISTINCT coder_id) AS n_coders FROM seg GROUP BY 1 HAVING count(DISTINCT coder_id) >= 2),
c AS (SELECT document_id, code_id, us, ue, string_agg(CAST(coder_id AS VARCHAR), ',' ORDER BY coder_id) AS coders, count(*) AS k FROM lab GROUP BY 1, 2, 3, 4)
SELECT c.document_id, code_id, us, ue, substring(d.body, us + 1, ue - us) AS text, coders, n_coders FROM c JOIN m USING (document_id) JOIN qda_document d ON d.id = c.document_id WHERE k < n_coders""",
)
def agg_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.disagreements(_units(spark, sf_dir), segs(spark, sf_dir), docs(spark, sf_dir))


@core.query(
    "snk_disagree_csv",
    f"""WITH {_LAB}, m AS (SELECT document_id, count(DISTINCT coder_id) AS n_coders FROM seg GROUP BY 1 HAVING count(DISTINCT coder_id) >= 2),
c AS (SELECT document_id, code_id, us, ue, list(coder_id) AS l, count(*) AS k FROM lab GROUP BY 1, 2, 3, 4)
SELECT c.document_id, code_id, us, ue, substring(d.body, us + 1, ue - us) AS text, {", ".join(f"CAST(list_contains(l, {k}) AS INT) AS coder_{k:02}" for k in range(1, 41))} FROM c JOIN m USING (document_id) JOIN qda_document d ON d.id = c.document_id WHERE k < n_coders""",
)
def snk_disagree_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.disagreement_table(agreement.disagreements(_units(spark, sf_dir), segs(spark, sf_dir), docs(spark, sf_dir)), {k: f"coder_{k:02}" for k in range(1, 41)})


@core.query(
    "agg_training",
    f"""WITH {_LAB}, l AS (SELECT document_id, code_id, us, max(CAST(coder_id = 1 AS INT)) AS m, max(CAST(coder_id = 2 AS INT)) AS t FROM lab WHERE coder_id IN (1, 2) GROUP BY 1, 2, 3),
k AS (SELECT document_id, code_id, sum(m * t) AS tp, sum((1 - m) * t) AS fp, sum(m * (1 - t)) AS fn FROM l GROUP BY 1, 2),
f AS (SELECT k.*, n, (n - fp - fn) / n AS po, ((tp + fn) * (tp + fp) + (n - tp - fn) * (n - tp - fp)) / (n * n) AS pe FROM k JOIN nu USING (document_id))
SELECT document_id, code_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(n - tp - fp - fn AS BIGINT) AS tn, CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM f""",
)
def agg_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.training(_units(spark, sf_dir), segs(spark, sf_dir), 1, 2)


_RATERS = "SELECT doc_id, coder_id, label FROM (SELECT DISTINCT doc_id, coder_id, label FROM review_label WHERE label IS NOT NULL)"


@core.query(
    "agg_kappa",
    f"""WITH r AS ({_RATERS}), p AS (SELECT a.label AS a, b.label AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.coder_id < b.coder_id), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (a = b) AS o FROM p),
e AS (SELECT sum(x.k * y.k) AS e FROM (SELECT a AS v, count(*) AS k FROM p GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS k FROM p GROUP BY 1) y USING (v))
SELECT CAST(n AS BIGINT) AS n, o / n AS po, coalesce(e, 0) / (n * n) AS pe, CASE WHEN coalesce(e, 0) / (n * n) >= 1 THEN 1.0 ELSE (o / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END AS kappa FROM t, e WHERE n > 0""",
)
def agg_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "review_label").select("doc_id", "coder_id", "label").dropna().distinct()
    o = r.select(F.col("doc_id").alias("d2"), F.col("coder_id").alias("k2"), F.col("label").alias("b"))
    p = r.join(o, (F.col("doc_id") == F.col("d2")) & (F.col("coder_id") < F.col("k2"))).select(F.col("label").alias("a"), "b")
    return agreement.cohen(p, "a", "b")


@core.query(
    "agg_fleiss",
    f"""WITH r AS ({_RATERS}), two AS (SELECT doc_id FROM r GROUP BY 1 HAVING count(*) = 2), c AS (SELECT doc_id, label, count(*) AS c FROM r WHERE doc_id IN (SELECT doc_id FROM two) GROUP BY 1, 2),
e AS (SELECT doc_id, sum(c) AS m, sum(c * c) AS q FROM c GROUP BY 1), t AS (SELECT count(*) AS n, avg((q - m) / (m * (m - 1))) AS p FROM e), s AS (SELECT sum(s * s) AS ss, sum(s) AS t FROM (SELECT sum(c) AS s FROM c GROUP BY label))
SELECT n AS n_items, 2 AS raters, CASE WHEN ss / (t * t) >= 1 THEN 1.0 ELSE (p - ss / (t * t)) / (1 - ss / (t * t)) END AS kappa FROM t, s WHERE n > 0""",
)
def agg_fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "review_label").select("doc_id", "coder_id", "label").dropna().distinct()
    two = r.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n")).where("n = 2")
    f = agreement.fleiss(r.join(two, F.col("doc_id") == F.col("_d"), "left_semi"), "doc_id", "label")
    return f.select("n_items", F.col("raters").cast("int").alias("raters"), "kappa")


@core.query(
    "agg_alpha",
    f"""WITH r AS (SELECT doc_id, CAST(label = 'clean' AS INT) AS v FROM ({_RATERS})), m AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS m FROM r GROUP BY 1 HAVING count(*) > 1), c AS (SELECT doc_id, v, CAST(count(*) AS DOUBLE) AS c FROM r WHERE doc_id IN (SELECT doc_id FROM m) GROUP BY 1, 2),
o AS (SELECT sum(CASE WHEN a.v = b.v THEN 0 ELSE a.c * b.c / (m - 1) END) AS o FROM c a JOIN c b USING (doc_id) JOIN m USING (doc_id)), n AS (SELECT v, sum(c) AS n FROM c GROUP BY 1), e AS (SELECT sum(CASE WHEN a.v = b.v THEN 0 ELSE a.n * b.n END) AS e FROM n a, n b), t AS (SELECT sum(n) AS n FROM n)
SELECT CAST(n AS BIGINT) AS n, o / n AS "do", e / (n * (n - 1)) AS de, CASE WHEN e = 0 THEN CASE WHEN o = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - (o / n) / (e / (n * (n - 1))) END AS alpha FROM o, e, t WHERE n > 1""",
)
def agg_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "review_label").select("doc_id", "coder_id", "label").dropna().distinct()
    return agreement.alpha(r.select("doc_id", (F.col("label") == "clean").cast("int").alias("v")), "doc_id", "v")


# sentiment: every document, by the lexicon of its language; words and marks are written out in the SQL

LEXICONS = (
    sentiment.builtin("en").merge(sentiment.Lexicon("period", "en", {"well-known": 0.3, "remarkable": 0.6, "promised": 0.4, "refused": -0.5, "damaged": -0.6, "siege": -0.6, "flood": -0.5, "trembling": -0.4}, frozenset({"without"}))),
    sentiment.builtin("ja").merge(sentiment.Lexicon("period", "ja", {"見事": 0.7, "祭礼": 0.4, "偽って": -0.5, "崩れた": -0.6, "未納": -0.5, "困窮": -0.7, "困": -0.1, "籠城": -0.5, "渋々": -0.4, "消えた": -0.4})),
)

_EN_WORDS = """('good', 0.7), ('great', 0.8), ('happy', 0.8), ('victory', 0.7), ('peace', 0.6), ('honor', 0.6), ('glory', 0.7), ('prosperity', 0.6), ('loyal', 0.6), ('wise', 0.5), ('bad', -0.7), ('sad', -0.8), ('evil', -0.9), ('defeat', -0.7), ('war', -0.4),
('death', -0.5), ('traitor', -0.9), ('crime', -0.6), ('shame', -0.6), ('chaos', -0.5), ('well-known', 0.3), ('remarkable', 0.6), ('promised', 0.4), ('refused', -0.5), ('damaged', -0.6), ('siege', -0.6), ('flood', -0.5), ('trembling', -0.4)"""
_JA_WORDS = """('喜び', 0.8), ('嬉しい', 0.8), ('良い', 0.6), ('善', 0.6), ('忠', 0.5), ('忠義', 0.7), ('名誉', 0.6), ('勝利', 0.7), ('平和', 0.6), ('安寧', 0.6), ('功', 0.4), ('賢', 0.5), ('仁', 0.5), ('栄光', 0.7), ('繁栄', 0.6), ('悲しい', -0.8), ('苦しい', -0.7), ('悪い', -0.6),
('不忠', -0.8), ('逆賊', -0.9), ('敗北', -0.7), ('戦乱', -0.6), ('罪', -0.6), ('恥', -0.6), ('怒り', -0.6), ('憎い', -0.7), ('滅亡', -0.7), ('死', -0.4), ('災い', -0.6), ('混乱', -0.5), ('見事', 0.7), ('祭礼', 0.4), ('偽って', -0.5), ('崩れた', -0.6), ('未納', -0.5), ('困窮', -0.7), ('困', -0.1), ('籠城', -0.5), ('渋々', -0.4), ('消えた', -0.4)"""
_JA_SCAN = "嬉しい|悲しい|苦しい|偽って|崩れた|消えた|喜び|良い|忠義|名誉|勝利|平和|安寧|栄光|繁栄|悪い|不忠|逆賊|敗北|戦乱|怒り|憎い|滅亡|災い|混乱|見事|祭礼|未納|困窮|籠城|渋々|善|忠|功|賢|仁|罪|恥|死|困"


def _lang_sql(label: str, text: str) -> str:
    """SQL of the language by whose lexicon a document is read."""
    low = f"lower(regexp_extract(coalesce({label}, ''), '^\\s*([^-_\\s]*)', 1))"
    cjk, latin = f"len(regexp_extract_all({text}, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]'))", f"len(regexp_extract_all({text}, '[A-Za-z]'))"
    return f"CASE WHEN {low} IN ('en', 'eng', 'english', '英語') THEN 'en' WHEN {low} IN ('ja', 'jpn', 'jp', 'japanese', '日本語') THEN 'ja' WHEN {low} <> '' OR {cjk} + {latin} = 0 THEN 'other' WHEN {cjk} >= {latin} THEN 'ja' ELSE 'en' END"


DOC_LANG = f"(SELECT id, body, coalesce(body, '') AS t, {_lang_sql('language', 'coalesce(body, chr(32))')} AS lang FROM qda_document)"


def _scored(source: str) -> str:
    """SQL scores of rows (k, t, lang)."""
    return f"""src AS ({source}),
norm AS (SELECT k, lang, translate(t, '國學體廣觀假聲會豐鐵號圓藝缺辭舊寶獨當經惠醫齋櫻氣澤驛萬與亂佛戰禮勳獻歸ゐゑヰヱゝゞヽヾ', '国学体広観仮声会豊鉄号円芸欠辞旧宝独当経恵医斎桜気沢駅万与乱仏戦礼勲献帰いえイエ') AS t FROM src),
tok AS (SELECT k, list_transform(regexp_extract_all(t, '[A-Za-z'']+'), lambda x: lower(x)) AS l FROM norm WHERE lang = 'en'),
w AS (SELECT k, l, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM tok), en(word, p) AS (VALUES {_EN_WORDS}), ja(word, p) AS (VALUES {_JA_WORDS}),
cutted AS (SELECT k, string_split(regexp_replace(t, '({_JA_SCAN})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS l FROM norm WHERE lang = 'ja'),
met AS (SELECT k, l, unnest(range(2, len(l) + 1)) AS i FROM cutted),
scan AS (SELECT k, split_part(l[i], chr(2), 1) AS word, replace(array_to_string(l[i:i + 4], ''), chr(2), '') AS rest FROM met),
h AS (SELECT k, CASE WHEN len(list_filter(l[greatest(i - 3, 1):i - 1], lambda x: list_contains(['not', 'no', 'never', 'none', 'without', 'n''t', 'cannot'], x) OR suffix(x, 'n''t'))) > 0 THEN -p ELSE p END AS p FROM w JOIN en USING (word)
      UNION ALL SELECT k, CASE WHEN regexp_matches(substring(rest, length(word) + 1, 4), 'ない|ず|ぬ|なし|ありません|無|不|非|ざる') THEN -p ELSE p END FROM scan JOIN ja USING (word)),
a AS (SELECT k, avg(p) AS m, count(*) FILTER (p > 0) AS pos, count(*) FILTER (p < 0) AS neg, count(*) AS n FROM h GROUP BY 1),
scored AS (SELECT k, lang, greatest(-1.0, least(1.0, coalesce(m, 0.0))) AS polarity, coalesce(pos, 0) AS n_positive, coalesce(neg, 0) AS n_negative, coalesce(n, 0) AS n_words FROM src LEFT JOIN a USING (k))"""


DICTIONARY = "CASE lang WHEN 'en' THEN 'builtin-en+period' WHEN 'ja' THEN 'builtin-ja+period' ELSE 'empty' END"
_DOC_T = f"SELECT id AS k, t, lang FROM {DOC_LANG}"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("id", "body", T.language_of(F.col("language"), F.col("body")).alias("lang"))


@core.query("fn_score_text", f"WITH {_scored(_DOC_T)} SELECT k AS id, polarity, CAST(n_positive AS INT) AS n_positive, CAST(n_negative AS INT) AS n_negative, CAST(n_words AS INT) AS n_words FROM scored")
def fn_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.score_by_language(_read(spark, sf_dir), "body", "lang", LEXICONS).drop("body", "lang")


@core.query("agg_sent_score", f"WITH {_scored(_DOC_T)} SELECT k AS id, polarity, n_positive, n_negative, n_words FROM scored WHERE lang <> 'other'")
def agg_sent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins with lexicon tables of any size."""
    d = _read(spark, sf_dir)
    en, ja = (sentiment.score_large(d.where(F.col("lang") == x.language), "id", "body", x.frame(spark), sorted(x.negations), x.language) for x in LEXICONS)
    return en.unionByName(ja)


@core.query("udf_tokenizer", f"WITH {_scored(_DOC_T)} SELECT k AS id, polarity, CAST(n_words AS INT) AS n_words FROM scored WHERE lang = 'en'")
def udf_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the tokens of a callable, here one that cuts at everything but letters and apostrophes."""
    d = _read(spark, sf_dir).where("lang = 'en'").select("id", "body")
    return sentiment.score_tokens(d, "body", LEXICONS[0], latin_words).select("id", "polarity", "n_words")


def latin_words(text: str) -> list[tuple[str, int]]:
    import re

    return [(m.group(0).lower(), m.start()) for m in re.finditer("[A-Za-z']+", text)]


def _segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.analyze(docs(spark, sf_dir), "segment", LEXICONS, segs(spark, sf_dir))


_SEG_T = f"SELECT s.id AS k, substring(d.t, s.char_start + 1, s.char_end - s.char_start) AS t, lang FROM {SEG} s JOIN {DOC_LANG} d ON d.id = s.document_id"


@core.query("agg_sent_by_code", f"WITH {_scored(_SEG_T)} SELECT s.code_id, count(*) AS n, round(avg(polarity), 9) AS mean_polarity, min(polarity) AS min_polarity, max(polarity) AS max_polarity FROM scored JOIN {SEG} s ON s.id = k GROUP BY 1")
def agg_sent_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.polarity_by_code(_segment_scores(spark, sf_dir), segs(spark, sf_dir)).withColumn("mean_polarity", F.round("mean_polarity", 9))


_SENT_T = f"SELECT [s.id, s.char_start] AS k, s.p AS t, lang FROM sentence s JOIN {DOC_LANG} d ON d.id = s.id WHERE regexp_matches(s.p, '{NON_WS}')"


@core.query("agg_sent_timeseries", f"WITH {SENTENCES}, {_scored(_SENT_T)} SELECT d.year, round(avg(polarity), 9) AS mean_polarity, count(*) AS n_units FROM scored JOIN qda_document d ON d.id = k[1] WHERE d.year IS NOT NULL GROUP BY 1")
def agg_sent_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return sentiment.polarity_by_year(sentiment.analyze(d, "sentence", LEXICONS), d).withColumn("mean_polarity", F.round("mean_polarity", 9))


@core.query("fn_lex_scan", f"WITH {_scored("SELECT id AS k, coalesce(body, '') AS t, 'ja' AS lang FROM qda_document")} SELECT k AS id, polarity, CAST(n_positive AS INT) AS n_positive, CAST(n_negative AS INT) AS n_negative, CAST(n_words AS INT) AS n_words FROM scored")
def fn_lex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by leftmost longest scan with the Japanese lexicon."""
    return sentiment.score(docs(spark, sf_dir).select("id", "body"), "body", LEXICONS[1]).drop("body")


@core.query("snk_sentiment", f"WITH {_scored(_DOC_T)} SELECT k AS document_id, 'document' AS unit, polarity, {DICTIONARY} AS dictionary FROM scored UNION ALL SELECT id, 'sentence', 0.5, 'old' FROM qda_document")
def snk_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old scores of whole documents go, those of their sentences stay."""
    d = docs(spark, sf_dir)
    old = d.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit("document"), F.lit("sentence"))).alias("unit"), F.lit(0.5).alias("polarity"), F.lit("old").alias("dictionary"))
    new = sentiment.analyze(d, "document", LEXICONS).select("document_id", "unit", "polarity", "dictionary")
    return sentiment.replace_scores(old, new)


# suggestion


@core.query(
    "jn_sparse_dot",
    """WITH t AS (SELECT id, regexp_replace(coalesce(title, ''), '[\\s　]+', '', 'g') AS t FROM qda_document),
v AS (SELECT id, gram, CAST(count(*) AS DOUBLE) AS w FROM (SELECT id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END) AS gram FROM t) GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY 1), c AS (SELECT id, name FROM """ + CODE + """ c),
ct AS (SELECT name AS code, regexp_replace(coalesce(name, ''), '[\\s　]+', '', 'g') AS t FROM (SELECT DISTINCT name FROM c)),
cv AS (SELECT code, gram, CAST(count(*) AS DOUBLE) AS w FROM (SELECT code, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END) AS gram FROM ct) GROUP BY 1, 2),
cn AS (SELECT code, sqrt(sum(w * w)) AS n FROM cv GROUP BY 1)
SELECT v.id, cv.code, sum(v.w * cv.w) / any_value(n.n * cn.n) AS score FROM v JOIN cv USING (gram) JOIN n ON n.id = v.id JOIN cn ON cn.code = cv.code GROUP BY 1, 2""",
)
def jn_sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("id", "title")
    c = codes(spark, sf_dir).select(F.col("name").alias("code")).where("code is not null").distinct().withColumn("text", F.col("code"))
    return coding.cosine(coding.gram_vectors(d, "id", "title"), "id", coding.gram_vectors(c, "code", "text"), "code")


@core.query(
    "lim_topk_suggest",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM e GROUP BY 1), cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
s AS (SELECT e.vec_id, c.label AS code_id, sum(e.x * c.m) / any_value(n.n * cn.n) AS score FROM e JOIN c ON c.i = e.i JOIN n ON n.vec_id = e.vec_id JOIN cn ON cn.label = c.label GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, code_id) AS rank FROM s WHERE score >= 0.05) SELECT vec_id, CAST(code_id AS BIGINT) AS code_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
)
def lim_topk_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = coding.suggest_by_embedding(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")
    return coding.top_suggestions(s, "vec_id").select("vec_id", "code_id", F.round("score", 5).alias("score"), "rank")


@core.query(
    "agg_centroid",
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT CAST(label AS BIGINT) AS code_id, i - 1 AS gram, round(avg(CAST(x AS DOUBLE)), 6) AS w FROM e GROUP BY 1, 2""",
)
def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("code_id"), F.posexplode("embedding").alias("gram", "x"))
    v = e.select("code_id", "vec_id", F.col("gram").cast("long").alias("gram"), F.col("x").cast("double").alias("w"))
    return coding.centroids(v, "code_id", "vec_id").select("code_id", "gram", F.round("w", 6).alias("w"))


# collaboration


@core.query("flt_permission", "SELECT id, name, role FROM qda_coder WHERE role IN ('admin', 'coder')")
def flt_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collaboration.allowed(coders(spark, sf_dir), "code").select("id", "name", "role")


@core.query("flt_pending", f"SELECT s.id, s.document_id, d.title, s.code_id, c.name AS code_name, s.coder_id, s.char_start, s.char_end, s.status FROM {SEG} s JOIN {CODE} c ON c.id = s.code_id JOIN qda_document d ON d.id = s.document_id WHERE s.status = 'draft'")
def flt_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collaboration.pending(segs(spark, sf_dir), codes(spark, sf_dir), docs(spark, sf_dir))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 50 != 0, 1 + F.col("user_id") % 3).alias("coder_id"), F.lit("segment").alias("entity"), (F.col("event_id") % 1000).alias("entity_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))


@core.query("lim_history", "SELECT event_id AS id, 1 + user_id % 3 AS coder_id, event_id % 1000 AS entity_id, event_type AS action FROM events WHERE event_id % 50 <> 0 AND 1 + user_id % 3 IN (1, 2) ORDER BY event_id DESC LIMIT 500")
def lim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collaboration.history(_audit(spark, sf_dir), [1, 2], "segment").select("id", "coder_id", "entity_id", "action")


@core.query(
    "mut_workflow",
    f"""WITH s AS (SELECT id, status FROM {SEG}), f AS (SELECT id, CASE WHEN id % 3 = 0 THEN CASE status WHEN 'draft' THEN 'confirmed' ELSE 'confirmed' END WHEN id % 3 = 1 THEN 'draft' ELSE status END AS status,
 CASE WHEN id % 3 = 0 THEN CASE status WHEN 'draft' THEN 2 WHEN 'reviewed' THEN 1 ELSE 0 END WHEN id % 3 = 1 THEN 1 ELSE 0 END AS n_applied FROM s) SELECT * FROM f""",
)
def mut_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir).select("id", "status")
    step = lambda at, who, what: F.struct(F.lit(at).alias("at"), F.lit(who).alias("role"), F.lit(what).alias("action"))
    plan = F.when(F.col("id") % 3 == 0, F.array(step(1, "admin", "approve"), step(2, "admin", "advance"))).when(F.col("id") % 3 == 1, F.array(step(1, "admin", "reject"), step(2, "coder", "approve"))).otherwise(F.array(step(1, "viewer", "reject")))
    # an approval of what is reviewed already does not fit and is passed over; the next step then applies
    events = s.select(F.col("id").alias("segment_id"), F.explode(plan).alias("e")).select("segment_id", "e.at", "e.role", "e.action")
    return collaboration.fold_workflow(s, events)


@core.query(
    "mut_lock",
    """WITH l AS (SELECT d.id AS document_id, 1 + d.id % 3 AS coder_id, d.created_at AS since FROM qda_document d WHERE d.id % 2 = 0)
SELECT document_id, coder_id, since AS acquired_at FROM l WHERE document_id % 4 = 0""",
)
def mut_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("document_id"), (1 + F.col("id") % 3).alias("coder_id"), F.col("created_at").alias("at"))
    take = d.withColumn("kind", F.lit("acquire"))
    again = d.select("document_id", (F.col("coder_id") + 1).alias("coder_id"), (F.col("at") + F.expr("interval 1 minute")).alias("at"), F.lit("acquire").alias("kind"))
    free = d.where("document_id % 4 <> 0").select("document_id", "coder_id", (F.col("at") + F.expr("interval 2 minutes")).alias("at"), F.lit("release").alias("kind"))
    return collaboration.lock_state(take.unionByName(again).unionByName(free))


@core.query("jn_sync_export", f"SELECT d.project_id, d.title AS doc, c.name AS code, k.name AS coder, s.char_start AS start, s.char_end AS \"end\", s.status FROM {SEG} s JOIN qda_document d ON d.id = s.document_id JOIN {CODE} c ON c.id = s.code_id JOIN qda_coder k ON k.id = s.coder_id")
def jn_sync_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collaboration.export_records(segs(spark, sf_dir), docs(spark, sf_dir), codes(spark, sf_dir), coders(spark, sf_dir))


@core.query(
    "mut_sync_import",
    f"""WITH d AS (SELECT title, min(id) AS id FROM qda_document WHERE project_id = 1 GROUP BY 1), c AS (SELECT name, min(id) AS id FROM {CODE} WHERE project_id = 1 GROUP BY 1), k AS (SELECT name, min(id) AS id FROM qda_coder WHERE project_id = 1 GROUP BY 1),
s AS (SELECT document_id, code_id, coder_id, char_start, char_end, arg_min(status, id) AS status FROM {SEG} GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT DISTINCT CASE WHEN s.id % 7 = 0 THEN 'no such title' ELSE d.title END AS doc, c.name AS code, k.name AS coder, s.char_start + CAST(s.id % 5 = 0 AS INT) AS st, s.char_end AS en FROM {SEG} s JOIN qda_document d ON d.id = s.document_id JOIN {CODE} c ON c.id = s.code_id JOIN qda_coder k ON k.id = s.coder_id WHERE d.project_id = 1 AND c.project_id = 1 AND k.project_id = 1),
o AS (SELECT CASE WHEN d.id IS NULL THEN 'missing_document' WHEN s.status IS NULL THEN 'added' WHEN s.status <> 'reviewed' THEN 'conflict' ELSE 'skipped' END AS outcome
 FROM r LEFT JOIN d ON d.title = r.doc LEFT JOIN c ON c.name = r.code LEFT JOIN k ON k.name = r.coder LEFT JOIN s ON s.document_id = d.id AND s.code_id = c.id AND s.coder_id = k.id AND s.char_start = r.st AND s.char_end = r.en)
SELECT outcome, count(*) AS n FROM o GROUP BY 1""",
)
def mut_sync_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d, c, k = segs(spark, sf_dir), docs(spark, sf_dir), codes(spark, sf_dir), coders(spark, sf_dir)
    mine = s.join(d.where("project_id = 1").select(F.col("id").alias("_d"), "title"), F.col("document_id") == F.col("_d")).join(c.where("project_id = 1").select(F.col("id").alias("_c"), F.col("name").alias("code")), F.col("code_id") == F.col("_c"))
    mine = mine.join(k.where("project_id = 1").select(F.col("id").alias("_k"), F.col("name").alias("coder")), F.col("coder_id") == F.col("_k"))
    r = mine.select(F.when(F.col("id") % 7 == 0, "no such title").otherwise(F.col("title")).alias("doc"), "code", "coder", (F.col("char_start") + (F.col("id") % 5 == 0).cast("int")).alias("start"), F.col("char_end").alias("end"), F.lit("reviewed").alias("status")).distinct()
    return collaboration.import_report(collaboration.classify_records(r, d, c, k, s, 1))


_INCOMING = f"""SELECT DISTINCT CASE WHEN s.id % 7 = 0 THEN 'no such title ' || s.id % 3 ELSE d.title END AS doc, CASE WHEN s.id % 11 = 0 THEN 'new code ' || s.id % 4 ELSE c.name END AS code, CASE WHEN s.id % 13 = 0 THEN 'new coder' ELSE k.name END AS coder,
s.char_start AS st, s.char_end AS en FROM {SEG} s JOIN qda_document d ON d.id = s.document_id JOIN {CODE} c ON c.id = s.code_id JOIN qda_coder k ON k.id = s.coder_id WHERE d.project_id = 1 AND c.project_id = 1 AND k.project_id = 1"""


@core.query(
    "mut_sync_create",
    f"""WITH d AS (SELECT title, min(id) AS id FROM qda_document WHERE project_id = 1 GROUP BY 1), r AS ({_INCOMING}), ok AS (SELECT r.* FROM r JOIN d ON d.title = r.doc),
c AS (SELECT name, min(id) AS id FROM {CODE} WHERE project_id = 1 GROUP BY 1), k AS (SELECT name, min(id) AS id FROM qda_coder WHERE project_id = 1 GROUP BY 1),
nc AS (SELECT code AS name, (SELECT max(id) FROM qda_code) + row_number() OVER (ORDER BY code) AS id FROM (SELECT DISTINCT code FROM ok WHERE code NOT IN (SELECT name FROM c))),
nk AS (SELECT coder AS name, (SELECT max(id) FROM qda_coder) + row_number() OVER (ORDER BY coder) AS id FROM (SELECT DISTINCT coder FROM ok WHERE coder NOT IN (SELECT name FROM k)))
SELECT 'code' AS what, id, name FROM nc UNION ALL SELECT 'coder', id, name FROM nk UNION ALL SELECT 'missing document', count(*), doc FROM r WHERE doc NOT IN (SELECT title FROM d WHERE title IS NOT NULL) GROUP BY doc""",
)
def mut_sync_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes and coders that an import creates, and the documents it misses with the number of their records."""
    s, d, c, k = segs(spark, sf_dir), docs(spark, sf_dir), codes(spark, sf_dir), coders(spark, sf_dir)
    j = s.join(d.where("project_id = 1").select(F.col("id").alias("_d"), "title"), F.col("document_id") == F.col("_d")).join(c.where("project_id = 1").select(F.col("id").alias("_c"), F.col("name").alias("_cn")), F.col("code_id") == F.col("_c"))
    j = j.join(k.where("project_id = 1").select(F.col("id").alias("_k"), F.col("name").alias("_kn")), F.col("coder_id") == F.col("_k"))
    doc = F.when(F.col("id") % 7 == 0, F.concat(F.lit("no such title "), (F.col("id") % 3).cast("string"))).otherwise(F.col("title"))
    code = F.when(F.col("id") % 11 == 0, F.concat(F.lit("new code "), (F.col("id") % 4).cast("string"))).otherwise(F.col("_cn"))
    coder = F.when(F.col("id") % 13 == 0, "new coder").otherwise(F.col("_kn"))
    r = j.select(doc.alias("doc"), code.alias("code"), coder.alias("coder"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit("draft").alias("status")).distinct()
    done = collaboration.import_records(r, d, c, k, s, 1)
    new = lambda df, old, what: df.join(old.select(F.col("id").alias("_o")), F.col("id") == F.col("_o"), "left_anti").select(F.lit(what).alias("what"), "id", "name")
    missing = done.missing.select(F.lit("missing document").alias("what"), F.col("n_records").alias("id"), F.col("doc").alias("name"))
    return new(done.codes, c, "code").unionByName(new(done.coders, k, "coder")).unionByName(missing)


@core.query("agg_audit_actions", "SELECT event_type AS action, count(*) AS n, count(DISTINCT 1 + user_id % 3) FILTER (event_id % 50 <> 0) AS n_coders FROM events GROUP BY 1")
def agg_audit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("coder_id").alias("n_coders"))
