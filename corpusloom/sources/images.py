"""Page images: single files, multi-page TIFF, PDF and ZIP, as rows of binary pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "bmp", "webp", "gif")
KNOWN = (*IMAGES, "tif", "tiff", "pdf", "zip")


def _kind(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def pages_in(name: str, content: bytes, dpi: int = 200) -> Iterator[tuple[str, int, bytes, str | None]]:
    """(label source, page_index, content, error) of a file's pages; ZIP members come sorted by name.

    TIFF frames and PDF pages need an imaging library; without one the file comes whole, with a note.
    """
    kind = _kind(name)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in sorted(z.namelist()):
                if _kind(member) in KNOWN and not member.endswith("/"):
                    for label, i, c, err in pages_in(member, z.read(member), dpi):
                        yield f"{name}!{label}", i, c, err
    elif kind in ("tif", "tiff"):
        try:
            from PIL import Image, ImageSequence
        except ImportError:
            yield name, 0, content, "no imaging library: frames are not split"
            return
        for i, frame in enumerate(ImageSequence.Iterator(Image.open(io.BytesIO(content)))):
            out = io.BytesIO()
            frame.convert("RGB").save(out, "PNG")
            yield name, i, out.getvalue(), None
    elif kind == "pdf":
        try:
            import fitz
        except ImportError:
            yield name, 0, content, "no PDF library: pages are not drawn"
            return
        for i, page in enumerate(fitz.open(stream=content, filetype="pdf")):
            yield name, i, page.get_pixmap(dpi=dpi).tobytes("png"), None
    else:
        yield name, 0, content, None


def read_pages(spark: SparkSession, path: str, dpi: int = 200) -> DataFrame:
    """Pages of all known files below a path: path, source, page_index, label, content, error."""
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*KNOWN))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content):
                rows = [(p, s, i, f"{s}#p{i + 1}", b, e) for s, i, b, e in pages_in(p.rsplit("/", 1)[-1], bytes(c), dpi)]
                yield pd.DataFrame(rows, columns=["path", "source", "page_index", "label", "content", "error"])

    return src.select("path", "content").mapInPandas(run, "path string, source string, page_index int, label string, content binary, error string")
