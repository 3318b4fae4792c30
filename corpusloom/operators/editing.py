"""Changes as DataFrame transformations: validated appends, anti-joins and rewrites instead of row updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.hierarchy import descendants, resolve_hierarchy
from corpusloom.session import number

SPAN_KEY = ["document_id", "code_id", "coder_id", "char_start", "char_end"]


class CycleError(ValueError):
    """A code was to be moved below itself."""


def add_codings(segments: DataFrame, new: DataFrame) -> DataFrame:
    """Segments with new ones appended; a span that is there already is not added again, an empty one is an error."""
    bad = F.when(F.col("char_end") <= F.col("char_start"), F.raise_error(F.lit("char_end must be greater than char_start")).cast("int"))
    checked = new.dropDuplicates(SPAN_KEY).withColumn("char_end", F.coalesce(bad, F.col("char_end")))
    fresh = checked.join(segments.select(*SPAN_KEY), SPAN_KEY, "left_anti")
    top = segments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    fresh = number(fresh, SPAN_KEY, top + 1)
    return segments.unionByName(fresh, allowMissingColumns=True)


def remove_codings(segments: DataFrame, ids: DataFrame) -> DataFrame:
    return segments.join(ids.select("id"), "id", "left_anti")


def set_status(segments: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The status of the given segments; no check of the steps between."""
    k = ids.select(F.col("id").alias("_k")).distinct()
    out = segments.join(k, F.col("id") == F.col("_k"), "left")
    return out.withColumn("status", F.when(F.col("_k").isNotNull(), status).otherwise(F.col("status"))).drop("_k")


def delete_codes(codes: DataFrame, segments: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Codes and segments without the given codes and all below them."""
    tree = resolve_hierarchy(codes)
    below = descendants(tree).where(F.col("ancestor_id").isin(ids)).select("id").distinct()
    gone = below.unionByName(codes.where(F.col("id").isin(ids)).select("id")).distinct()
    return codes.join(gone, "id", "left_anti"), segments.join(gone.select(F.col("id").alias("_g")), F.col("code_id") == F.col("_g"), "left_anti")


def move_code(codes: DataFrame, code_id: int, new_parent: int | None) -> DataFrame:
    """A code under another parent, behind its new siblings; a parent that is itself or below it raises CycleError."""
    if new_parent is not None:
        below = descendants(resolve_hierarchy(codes)).where((F.col("ancestor_id") == code_id) & (F.col("id") == new_parent))
        if new_parent == code_id or below.limit(1).count():
            raise CycleError(f"{new_parent} is {code_id} or below it")
    siblings = codes.where(F.col("parent_id").isNull() if new_parent is None else F.col("parent_id") == new_parent)
    order = siblings.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("n")).first()[0]
    hit = F.col("id") == code_id
    return codes.withColumns({"parent_id": F.when(hit, F.lit(new_parent).cast("long")).otherwise(F.col("parent_id")), "sort_order": F.when(hit, F.lit(order)).otherwise(F.col("sort_order"))})


def next_sort_order(codes: DataFrame) -> DataFrame:
    """The sort order a new child of each parent gets: parent_id (null for roots), next_order; 0 behind siblings without one."""
    return codes.groupBy("parent_id").agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_order"))


def delete_coder(coder_id: int, coders: DataFrame, segments: DataFrame, memos: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Without a coder: their segments go, their memos and log entries stay without a name."""
    blank = lambda df: df.withColumn("coder_id", F.when(F.col("coder_id") == coder_id, F.lit(None)).otherwise(F.col("coder_id")))
    return coders.where(F.col("id") != coder_id), segments.where(~F.col("coder_id").eqNullSafe(coder_id)), blank(memos), blank(audit)


def fill_metadata(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Title, author, year and language of documents filled from (id, ...) where they are blank."""
    names = [c for c in ("title", "author", "year", "language") if c in found.columns]
    f = found.select(F.col("id").alias("_f"), *[F.col(c).alias(f"_{c}") for c in names])
    out = documents.join(f, F.col("id") == F.col("_f"), "left")
    for c in names:
        old = F.col(c) if c == "year" else F.nullif(F.col(c), F.lit(""))
        out = out.withColumn(c, F.coalesce(old, F.col(f"_{c}")))
    return out.drop("_f", *[f"_{c}" for c in names])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key, nulls equal."""
    n = new.dropDuplicates(key)
    on = None
    marks = n.select(*[F.col(k).alias(f"_{k}") for k in key])
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return old.join(marks, on, "left_anti").unionByName(n)


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Membership with pairs added that are not there yet."""
    return members.unionByName(new).dropDuplicates(["document_id", "collection_id"])


def overlay_corrections(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines (page_id, line_index, text) with edits (page_id, line_index, corrected): corrected text and whether it differs."""
    e = edits.select(F.col("page_id").alias("_p"), F.col("line_index").alias("_l"), "corrected")
    out = lines.join(e, (F.col("page_id") == F.col("_p")) & (F.col("line_index") == F.col("_l")), "left").drop("_p", "_l")
    new = F.coalesce("corrected", "text")
    return out.withColumns({"corrected": new, "dirty": ~new.eqNullSafe(F.col("text"))})


def memos_of(memos: DataFrame, kind: str, value: int | None = None) -> DataFrame:
    """Memos of a document, a segment, a project (on neither) or the journal, by time and id."""
    test = {
        "document": F.col("document_id") == value, "segment": F.col("segment_id") == value,
        "project": (F.col("project_id") == value) & F.col("document_id").isNull() & F.col("segment_id").isNull(), "journal": F.col("is_journal"),
    }
    if kind not in test:
        raise ValueError(f"unknown kind of memo: {kind}")
    return memos.where(test[kind]).orderBy("created_at", "id")


def validate_segments(segments: DataFrame, documents: DataFrame, codes: DataFrame) -> DataFrame:
    """Violations: id and reason (empty span, unknown document, unknown code, unknown status)."""
    d, c = documents.select(F.col("id").alias("_d")), codes.select(F.col("id").alias("_c")).distinct()
    checks = [
        segments.where("not coalesce(char_end > char_start, false)").select("id", F.lit("empty span").alias("reason")),
        segments.join(d, F.col("document_id") == F.col("_d"), "left_anti").select("id", F.lit("unknown document").alias("reason")),
        segments.join(c, F.col("code_id") == F.col("_c"), "left_anti").select("id", F.lit("unknown code").alias("reason")),
        segments.where("not coalesce(status in ('draft', 'reviewed', 'confirmed'), false)").select("id", F.lit("unknown status").alias("reason")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


def sort_colors(codes: DataFrame) -> DataFrame:
    """Codes without a colour get the next of twelve by their place in the project."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("id")) - 1
    return codes.withColumn("color", F.coalesce("color", T.auto_color(n)))


def create_codes(codes: DataFrame, new: DataFrame) -> DataFrame:
    """Codes with new ones (project_id, parent_id, name; perhaps definition) appended, behind their siblings.

    Ids follow the largest in order of project, parent and name; a blank name is an error. A code without a colour
    gets the next of twelve in its project (:func:`sort_colors`).
    """
    blank = F.raise_error(F.lit("a code needs a name"))
    name = F.when(T.is_blank(F.col("name")), blank.cast("string")).otherwise(F.col("name"))
    fresh = new.withColumn("name", name).dropDuplicates(["project_id", "parent_id", "name"])
    top = codes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    fresh = number(fresh, ["project_id", "parent_id", "name"], top + 1)
    n = next_sort_order(codes).select(F.col("parent_id").alias("_p"), "next_order")
    w = Window.partitionBy("project_id", "parent_id").orderBy("id")
    fresh = fresh.join(n, F.col("parent_id").eqNullSafe(F.col("_p")), "left")
    fresh = fresh.withColumn("sort_order", (F.coalesce("next_order", F.lit(0)) + F.row_number().over(w) - 1).cast("int")).drop("_p", "next_order")
    return sort_colors(codes.unionByName(fresh, allowMissingColumns=True))


def update_rows(table: DataFrame, row_id: int, **values: object) -> DataFrame:
    """The row with values set; those that are None stay as they are."""
    hit = F.col("id") == row_id
    return table.withColumns({k: F.when(hit, F.lit(v).cast(table.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items() if v is not None})


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations with new ones (project_id, code_a_id, code_b_id, relation_type; perhaps weight, else 1) appended.

    A code's relation to itself and a blank type are errors. Ids follow the largest, in order of the columns.
    """
    bad = F.when(F.col("code_a_id") == F.col("code_b_id"), F.raise_error(F.lit("a code has no relation to itself")).cast("string"))
    bad = F.coalesce(bad, F.when(T.is_blank(F.col("relation_type")), F.raise_error(F.lit("a relation needs a type")).cast("string")))
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in new.columns else F.lit(1.0)
    fresh = new.withColumns({"relation_type": F.coalesce(bad, F.col("relation_type")), "weight": weight.cast("double")})
    top = relations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    return relations.unionByName(number(fresh, ["project_id", "code_a_id", "code_b_id", "relation_type"], top + 1), allowMissingColumns=True)


def remove_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    return relations.join(ids.select("id"), "id", "left_anti")


def relations_of(relations: DataFrame, project_id: int, relation_type: str | None = None) -> DataFrame:
    """A project's relations, of one type if given, by id."""
    out = relations.where(F.col("project_id") == project_id)
    return (out if relation_type is None else out.where(F.col("relation_type") == relation_type)).orderBy("id")


def set_words(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """A project's lexicon (project_id, word, language, polarity) with words set; null languages are equal."""
    return upsert(lexicon, new, ["project_id", "word", "language"])


def remove_words(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """A lexicon without the given (project_id, word, language); null languages are equal."""
    gone = words.select(*[F.col(c).alias(f"_{c}") for c in ("project_id", "word", "language")]).distinct()
    on = (F.col("project_id") == F.col("_project_id")) & (F.col("word") == F.col("_word")) & F.col("language").eqNullSafe(F.col("_language"))
    return lexicon.join(gone, on, "left_anti")


def set_roles(coders: DataFrame, new: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Coders with roles (id, role) set; a role that there is not is an error."""
    bad = F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), F.raise_error(F.lit("unknown role")).cast("string"))
    n = new.select(F.col("id").alias("_i"), F.coalesce(bad, F.col("role")).alias("_role")).dropDuplicates(["_i"])
    return coders.join(n, F.col("id") == F.col("_i"), "left").withColumn("role", F.coalesce("_role", "role")).drop("_i", "_role")
