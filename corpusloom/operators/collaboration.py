"""Roles, workflow, locks, audit log and exchange of segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, lookup, number

ROLES = ("admin", "coder", "viewer")
STATES = ("draft", "reviewed", "confirmed")
# What each role may do.
PERMISSIONS = {
    "view": ("admin", "coder", "viewer"),
    "code": ("admin", "coder"),
    "manage_codebook": ("admin", "coder"),
    "lock": ("admin", "coder"),
    "approve": ("admin",),
    "manage_accounts": ("admin",),
}


def can(role: str, action: str) -> bool:
    return role in PERMISSIONS.get(action, ())


def permissions(spark: SparkSession) -> DataFrame:
    """The matrix of roles and actions as rows."""
    return spark.createDataFrame([(a, r) for a, rs in PERMISSIONS.items() for r in rs], "action string, role string")


def allowed(coders: DataFrame, action: str) -> DataFrame:
    """Coders whose role may do the action."""
    return coders.where(F.col("role").isin(*PERMISSIONS.get(action, ())))


def pending(segments: DataFrame, codes: DataFrame, documents: DataFrame, status: str = "draft") -> DataFrame:
    """The approval queue: segments of a status with document title and code name."""
    s = segments.where(F.col("status") == status)
    c = codes.select(F.col("id").alias("_c"), F.col("name").alias("code_name"))
    d = documents.select(F.col("id").alias("_d"), "title")
    return s.join(c, F.col("code_id") == F.col("_c")).join(d, F.col("document_id") == F.col("_d")).select("id", "document_id", "title", "code_id", "code_name", "coder_id", "char_start", "char_end", "status")


def fold_workflow(segments: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status, n_applied) after the events (segment_id, at, role, action) in order of time.

    approve takes draft to reviewed, confirm reviewed to confirmed, advance either step, reject any state back
    to draft; only admins' events count and steps that do not fit are passed over. Events at the same time are
    taken by action.
    """
    admin = events.where((F.col("role") == "admin") & F.col("action").isin("approve", "confirm", "advance", "reject"))
    log = admin.groupBy(F.col("segment_id").alias("_s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "action"))), lambda x: x["action"]).alias("log"))
    step = lambda s, a: (
        F.when(a == "reject", "draft").when((s == "draft") & a.isin("approve", "advance"), "reviewed").when((s == "reviewed") & a.isin("confirm", "advance"), "confirmed")
    )
    state = F.aggregate(
        F.coalesce("log", F.expr("cast(array() as array<string>)")),
        F.struct(F.col("status").alias("s"), F.lit(0).alias("n")),
        lambda acc, a: F.struct(F.coalesce(step(acc["s"], a), acc["s"]).alias("s"), (acc["n"] + step(acc["s"], a).isNotNull().cast("int")).alias("n")),
    )
    return segments.join(log, F.col("id") == F.col("_s"), "left").withColumn("_w", state).select("id", F.col("_w.s").alias("status"), F.col("_w.n").alias("n_applied"))


def lock_state(log: DataFrame) -> DataFrame:
    """Documents locked now: document_id, coder_id, acquired_at.

    ``log`` has document_id, coder_id, at, kind (acquire, release, force). An acquisition of a document that
    another holds is void, one by the holder changes nothing; release frees for the holder, force for anyone.
    """
    order = F.sort_array(F.collect_list(F.struct("at", "kind", "coder_id")))
    kind = log.schema["at"].dataType
    free = F.struct(F.lit(None).cast("long").alias("who"), F.lit(None).cast(kind).alias("since"))
    step = lambda acc, e: (
        F.when((e["kind"] == "acquire") & acc["who"].isNull(), F.struct(e["coder_id"].cast("long").alias("who"), e["at"].alias("since")))
        .when((e["kind"] == "force") | ((e["kind"] == "release") & (e["coder_id"] == acc["who"])), free)
        .otherwise(acc)
    )
    out = log.groupBy("document_id").agg(order.alias("log")).select("document_id", F.aggregate("log", free, step).alias("l"))
    return out.where("l.who is not null").select("document_id", F.col("l.who").alias("coder_id"), F.col("l.since").alias("acquired_at"))


def history(audit: DataFrame, coder_ids: list[int] | None = None, entity: str | None = None, entity_id: int | None = None, limit: int = 500) -> DataFrame:
    """The newest entries of the audit log that meet the filters; an empty list of coders gives none."""
    a = audit
    if coder_ids is not None:
        a = a.where(F.col("coder_id").isin(coder_ids)) if coder_ids else a.where(F.lit(False))
    if entity is not None:
        a = a.where(F.col("entity") == entity)
    if entity_id is not None:
        a = a.where(F.col("entity_id") == entity_id)
    return a.orderBy(F.desc("id")).limit(limit)


def record(audit: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with entries (coder_id, entity, entity_id, action, detail map) appended, stamped with the current time.

    ``detail`` becomes JSON, an empty or null one null. Ids follow the largest, in order of the entries' columns.
    """
    detail = F.when(F.size("detail") > 0, F.to_json("detail"))
    fresh = entries.withColumn("detail_json", detail).drop("detail")
    top = audit.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    fresh = number(fresh, ["entity", "entity_id", "action", "coder_id", "detail_json"], top + 1)
    return audit.unionByName(fresh.withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)


def of_project(audit: DataFrame, coders: DataFrame, project_id: int | None = None) -> DataFrame:
    """Log entries of a project's coders (of every project without one), with project_id; entries of nobody are left out."""
    c = coders.select(F.col("id").alias("_k"), "project_id").where(F.lit(True) if project_id is None else F.col("project_id") == project_id)
    return lookup(audit.where("coder_id is not null"), "coder_id", c, "_k").where("_k is not null").drop("_k")


def locks_with_titles(locks: DataFrame, documents: DataFrame) -> DataFrame:
    """Locked documents with their titles."""
    d = documents.select(F.col("id").alias("_d"), "title")
    return locks.join(d, F.col("document_id") == F.col("_d")).select("document_id", "title", "coder_id", "acquired_at")


def export_records(segments: DataFrame, documents: DataFrame, codes: DataFrame, coders: DataFrame) -> DataFrame:
    """Segments with names instead of ids: doc, code, coder, start, end, status. Segments of unknown coders are left out."""
    d = documents.select(F.col("id").alias("_d"), F.col("title").alias("doc"), "project_id")
    c = codes.select(F.col("id").alias("_c"), F.col("name").alias("code"))
    k = coders.select(F.col("id").alias("_k"), F.col("name").alias("coder"))
    s = segments.join(d, F.col("document_id") == F.col("_d")).join(c, F.col("code_id") == F.col("_c")).join(k, F.col("coder_id") == F.col("_k"))
    return s.select("project_id", "doc", "code", "coder", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "status")


def classify_records(records: DataFrame, documents: DataFrame, codes: DataFrame, coders: DataFrame, segments: DataFrame, project_id: int) -> DataFrame:
    """What importing records would do: each record with ``outcome`` added, skipped, conflict or missing_document.

    Documents, codes and coders are found by name in the project (of equal names the smallest id). A record
    whose document is unknown is missing; one whose segment is there with another status is a conflict; one
    that an earlier record of the same batch (by status) adds already is judged against that. A null status
    counts as draft.
    """
    first = lambda df, name: df.where(F.col("project_id") == project_id).groupBy(F.col(name).alias(f"_{name}")).agg(F.min("id").alias("_id"))
    d = first(documents, "title").select(F.col("_title").alias("_doc"), F.col("_id").alias("document_id"))
    c = first(codes, "name").select(F.col("_name").alias("_code"), F.col("_id").alias("code_id"))
    k = first(coders, "name").select(F.col("_name").alias("_coder"), F.col("_id").alias("coder_id"))
    r = records.withColumn("status", F.coalesce("status", F.lit("draft")))
    r = r.join(d, F.col("doc") == F.col("_doc"), "left").join(c, F.col("code") == F.col("_code"), "left").join(k, F.col("coder") == F.col("_coder"), "left")
    s = segments.groupBy(F.col("document_id").alias("sd"), F.col("code_id").alias("sc"), F.col("coder_id").alias("sk"), F.col("char_start").alias("ss"), F.col("char_end").alias("se")).agg(F.min(F.struct("id", "status")).alias("have"))
    on = (F.col("document_id") == F.col("sd")) & (F.col("code_id") == F.col("sc")) & (F.col("coder_id") == F.col("sk")) & (F.col("start") == F.col("ss")) & (F.col("end") == F.col("se"))
    r = r.join(s, on, "left")
    batch = Window.partitionBy("doc", "code", "coder", "start", "end").orderBy("status")
    r = r.withColumn("_n", F.row_number().over(batch)).withColumn("_f", F.first("status").over(batch))
    before = F.coalesce(F.col("have.status"), F.when(F.col("_n") > 1, F.col("_f")))
    outcome = F.when(F.col("document_id").isNull(), "missing_document").when(before.isNull(), "added").when(before != F.col("status"), "conflict").otherwise("skipped")
    return r.select("doc", "code", "coder", "start", "end", "status", outcome.alias("outcome"), before.alias("existing_status"))


def import_report(classified: DataFrame) -> DataFrame:
    """Number of records by outcome."""
    return classified.groupBy("outcome").agg(F.count("*").alias("n"))


def apply_records(segments: DataFrame, classified_ids: DataFrame, prefer: str = "existing") -> DataFrame:
    """Segments after an import of (document_id, code_id, coder_id, char_start, char_end, status) rows.

    New spans are appended with ids behind the largest; of a conflict the existing status holds unless
    ``prefer`` is "incoming".
    """
    key = ["document_id", "code_id", "coder_id", "char_start", "char_end"]
    new = classified_ids.groupBy(*key).agg(F.min("status").alias("_new"))
    if prefer == "incoming":
        kept = segments.join(new, key, "left").withColumn("status", F.coalesce("_new", "status")).select(segments.columns)
    else:
        kept = segments
    top = segments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    fresh = number(new.join(segments.select(*key).distinct(), key, "left_anti"), key, top + 1)
    cols = [c for c in segments.columns if c in {*key, "id"}]
    out = fresh.select(*cols, F.col("_new").alias("status"))
    return kept.unionByName(out, allowMissingColumns=True)


@dataclass
class Import:
    """What an import leaves: codes, coders and segments with the new ones, each record with its outcome, and what
    documents are missing (doc, n_records)."""

    codes: DataFrame
    coders: DataFrame
    segments: DataFrame
    classified: DataFrame
    missing: DataFrame


def _with_new(table: DataFrame, names: DataFrame, project_id: int) -> DataFrame:
    """``table`` with a row for each name that the project has not; ids behind the largest, in order of the names."""
    have = table.where(F.col("project_id") == project_id).select(F.col("name").alias("_n"))
    new = names.where("name is not null").distinct().join(have, F.col("name") == F.col("_n"), "left_anti")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    fresh = number(new, ["name"], top + 1).withColumn("project_id", F.lit(project_id).cast(table.schema["project_id"].dataType))
    return table.unionByName(fresh.withColumn("id", F.col("id").cast(table.schema["id"].dataType)), allowMissingColumns=True)


def import_records(records: DataFrame, documents: DataFrame, codes: DataFrame, coders: DataFrame, segments: DataFrame, project_id: int, prefer: str = "existing") -> Import:
    """Import records (doc, code, coder, start, end, status) into a project.

    Records of unknown documents are reported and change nothing. Codes and coders that the project has not
    are created by name. Spans that are new are appended; where one is there with another status, that holds
    unless ``prefer`` is "incoming". Records without a code, a coder or a span are left out. An empty batch changes
    nothing.
    """
    whole = records.where("doc is not null and code is not null and coder is not null and start is not null and end is not null")
    known = documents.where(F.col("project_id") == project_id).groupBy(F.col("title").alias("_title")).agg(F.min("id").alias("document_id"))
    at = cut(whole.join(known, F.col("doc") == F.col("_title"), "left").drop("_title"))
    here = at.where("document_id is not null")
    all_codes = cut(_with_new(codes, here.select(F.col("code").alias("name")), project_id))
    all_coders = cut(_with_new(coders, here.select(F.col("coder").alias("name")), project_id))
    first = lambda df, name: df.where(F.col("project_id") == project_id).groupBy(F.col("name").alias(f"_{name}")).agg(F.min("id").alias(f"{name}_id"))
    ids = here.join(first(all_codes, "code"), F.col("code") == F.col("_code")).join(first(all_coders, "coder"), F.col("coder") == F.col("_coder"))
    rows = ids.select("document_id", "code_id", "coder_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.coalesce("status", F.lit("draft")).alias("status"))
    missing = at.where("document_id is null").groupBy("doc").agg(F.count("*").alias("n_records"))
    classified = classify_records(whole, documents, all_codes, all_coders, segments, project_id)
    return Import(all_codes, all_coders, apply_records(segments, rows, prefer), classified, missing)
