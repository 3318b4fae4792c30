"""Exchange archives in the REFI-QDA form: project.qde and one text file a document in a ZIP."""

from __future__ import annotations

import zipfile
from uuid import NAMESPACE_URL, uuid5
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guid(kind: str, key: object) -> str:
    """A stable id for a thing of a kind."""
    return str(uuid5(NAMESPACE_URL, f"{kind}/{key}")).upper()


def _codes_xml(rows: list, parent: object = None) -> str:
    """Nested Code elements of rows with id, name, parent_id, definition, color, in their order."""
    below: dict = {}
    ids = {r.id for r in rows}
    for r in rows:
        below.setdefault(r.parent_id if r.parent_id in ids else None, []).append(r)
    out, todo = [], [("open", r) for r in reversed(below.get(parent, []))]
    while todo:
        what, r = todo.pop()
        if what == "close":
            out.append("</Code>")
            continue
        note = f"<Description>{escape(r.definition)}</Description>" if r.definition else ""
        out.append(f"<Code guid={quoteattr(guid('code', r.id))} name={quoteattr(r.name or '')} isCodable=\"true\" color={quoteattr(r.color or '#888888')}>{note}")
        todo.append(("close", r))
        todo += [("open", c) for c in reversed(below.get(r.id, []))]
    return "".join(out)


def write_qdpx(path: str, name: str, documents: DataFrame, segments: DataFrame, codes: DataFrame, coders: DataFrame) -> None:
    """One project's archive. Documents come one at a time with their codings; only codes and coders are held whole.

    Codes on a loop have no place in the tree and are left out, with their codings.
    """
    coding = F.sort_array(F.collect_list(F.struct("char_start", "id", "char_end", "code_id", "coder_id")))
    per = segments.groupBy(F.col("document_id").alias("_d")).agg(coding.alias("codings"))
    docs = documents.select("id", "title", "body").join(per, F.col("id") == F.col("_d"), "left").orderBy("id")
    code_rows = codes.orderBy("sort_order", "id").collect()
    tree = _codes_xml(code_rows)
    users = "".join(f"<User guid={quoteattr(guid('user', r.id))} name={quoteattr(r.name or '')}/>" for r in coders.orderBy("id").collect())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        sources = []
        for d in docs.toLocalIterator():
            g = guid("source", d.id)
            z.writestr(f"sources/{g}.txt", d.body or "")
            marks = "".join(
                f"<PlainTextSelection guid=\"{guid('selection', c.id)}\" startPosition=\"{c.char_start}\" endPosition=\"{c.char_end}\">"
                f"<Coding guid=\"{guid('coding', c.id)}\" creatingUser=\"{guid('user', c.coder_id)}\"><CodeRef targetGUID=\"{guid('code', c.code_id)}\"/></Coding></PlainTextSelection>"
                for c in d.codings or []
            )
            sources.append(f"<TextSource guid=\"{g}\" name={quoteattr(d.title or '')} plainTextPath=\"internal://{g}.txt\">{marks}</TextSource>")
        z.writestr(
            "project.qde",
            f'<?xml version="1.0" encoding="utf-8"?><Project xmlns="urn:QDA-XML:project:1.0" name={quoteattr(name)}><Users>{users}</Users>'
            f"<CodeBook><Codes>{tree}</Codes></CodeBook><Sources>{''.join(sources)}</Sources></Project>",
        )
