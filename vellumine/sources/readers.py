"""Readers of binary files, as plug-ins: each needs its library only when it runs.

A reader turns a file's bytes into a small structure (pages, paragraphs, elements); what becomes of
that is assembled by Column expressions. A file whose reader fails, or isn't installed, is a failed
row with its error, never a failed job. Files meet all readers of their suffix in one pass.
"""

from __future__ import annotations

import io
import json
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators import assemble
from vellumine.plans.registry import Registry

CELLS = "array<array<array<string>>>"
SPANS = "array<struct<lines:array<struct<spans:array<struct<text:string,size:double,flags:int>>>>>>"
RUNS = "array<struct<text:string,style:string,runs:array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>>>"


def pypdf_pages(raw: bytes, options: dict) -> list[str]:
    """Texts of pages; a page that can't be read is empty. An encrypted file needs ``password``."""
    from pypdf import PdfReader

    pdf = PdfReader(io.BytesIO(raw))
    if pdf.is_encrypted:
        if not options.get("password"):
            raise ValueError("the file is encrypted and no password is given")
        pdf.decrypt(options["password"])
    out = []
    for page in pdf.pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  a page's failure leaves the others
            out.append("")
    return out


def pdfplumber_pages(raw: bytes, options: dict) -> list[dict]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return [{"text": p.extract_text() or "", "tables": p.extract_tables() or []} for p in pdf.pages]


def pymupdf_pages(raw: bytes, options: dict) -> list[list]:
    import fitz

    with fitz.open(stream=raw, filetype="pdf") as pdf:
        return [[b for b in page.get_text("dict")["blocks"] if "lines" in b] for page in pdf]


def pdfminer_text(raw: bytes, options: dict) -> str:
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(raw))


def _beside(raw: bytes, suffix: str, use: Callable[[str], object]) -> object:
    """For libraries that take paths only: a file for as long as ``use`` runs, gone with the task."""
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(raw)
        f.flush()
        return use(f.name)


def camelot_tables(raw: bytes, options: dict) -> list[dict]:
    import camelot

    found = _beside(raw, ".pdf", lambda path: list(camelot.read_pdf(path, pages="all")))
    return [{"accuracy": t.parsing_report["accuracy"], "whitespace": t.parsing_report["whitespace"], "rows": t.df.astype(str).values.tolist()} for t in found]


def docx_document(raw: bytes, options: dict) -> dict:
    from docx import Document

    doc = Document(io.BytesIO(raw))
    runs = lambda p: [{"text": r.text, "bold": bool(r.bold), "italic": bool(r.italic), "underline": bool(r.underline)} for r in p.runs]
    return {"paragraphs": [{"text": p.text, "style": p.style.name, "runs": runs(p)} for p in doc.paragraphs], "tables": [[[c.text for c in row.cells] for row in t.rows] for t in doc.tables]}


def docx2txt_text(raw: bytes, options: dict) -> str:
    import docx2txt

    return docx2txt.process(io.BytesIO(raw)) or ""


#: Commands that print a .doc file's text, with their limits in seconds.
DOC_COMMANDS = (("antiword", ["antiword"], 60), ("catdoc", ["catdoc"], 60))
OFFICE_SECONDS = 120


def _printed(command: list[str], seconds: int) -> Callable[[str], str]:
    return lambda path: subprocess.run([*command, path], capture_output=True, timeout=seconds, check=True).stdout.decode("utf-8", "replace")


def _converted(path: str) -> str:
    with tempfile.TemporaryDirectory() as out:
        subprocess.run(["soffice", "--headless", "--convert-to", "docx", "--outdir", out, path], capture_output=True, timeout=OFFICE_SECONDS, check=True)
        with open(os.path.join(out, os.path.splitext(os.path.basename(path))[0] + ".docx"), "rb") as f:
            return docx2txt_text(f.read(), {})


def doc_text(raw: bytes, options: dict) -> str:
    """The first text that is not blank, of each command in turn, then of a conversion. All errors if there is none."""
    attempts = options.get("attempts") or [*((n, _printed(c, s)) for n, c, s in DOC_COMMANDS), ("libreoffice", _converted)]
    errors = []
    for name, attempt in attempts:
        try:
            text = _beside(raw, ".doc", attempt)
            if text.strip():
                return text
            errors.append(f"{name}: no text")
        except Exception as e:  # noqa: BLE001  the next attempt may do
            errors.append(f"{name}: {type(e).__name__}")
    raise ValueError("; ".join(errors))


def word_com_text(raw: bytes, options: dict) -> str:
    raise OSError("Word automation needs Windows")


def markitdown_text(raw: bytes, options: dict) -> str:
    """Texts pass through; other formats need the library."""
    suffix = options["suffix"]
    if suffix in (".txt", ".csv", ".json"):
        return raw.decode("utf-8", "replace")
    from markitdown import MarkItDown

    return MarkItDown().convert_stream(io.BytesIO(raw), file_extension=suffix).text_content or ""


# Options of a partition that nothing overrides, and what replaces a legacy format.
PARTITION = {"include_page_breaks": False, "chunking_strategy": "by_title", "infer_table_structure": True}
SUCCESSORS = {".doc": "docx", ".ppt": "pptx"}
LANGUAGE_OPTIONS = ("languages", "ocr_languages")


def partition_options(config: dict | None = None, runtime: dict | None = None) -> dict:
    """Defaults, then configuration, then what the call asks for."""
    merged = PARTITION | (config or {}) | (runtime or {})
    return {k: v for k, v in merged.items() if v is not None}


def dispatch(kind: str, find: Callable[[str], Callable | None], path: str, options: dict) -> list:
    """Elements by the partition of ``kind``, or of its successor where there is none; again without languages if it refuses them."""
    found = find(kind) or (find(SUCCESSORS["." + kind]) if "." + kind in SUCCESSORS else None) or find("auto")
    if found is None:
        raise ImportError(f"no partition for {kind}")
    try:
        return found(filename=path, **options)
    except TypeError:
        plain = {k: v for k, v in options.items() if k not in LANGUAGE_OPTIONS}
        if plain == options:
            raise
        return found(filename=path, **plain)


def _library_partition(kind: str) -> Callable | None:
    from importlib import import_module

    try:
        return getattr(import_module(f"unstructured.partition.{kind}"), "partition" if kind == "auto" else f"partition_{kind}")
    except ImportError:
        return None


def partition_elements(raw: bytes, options: dict) -> list[dict]:
    kind = options["suffix"].lstrip(".")
    elements = _beside(raw, options["suffix"], lambda path: dispatch(kind, options.get("find") or _library_partition, path, partition_options(options.get("partition"))))
    out = []
    for e in elements:
        m = e.metadata.to_dict() if getattr(e, "metadata", None) is not None else {}
        out.append({"type": e.category, "text": str(e), "metadata": {k: str(v) for k, v in m.items() if k not in ("category_depth", "text_as_html")}, "category_depth": m.get("category_depth"), "text_as_html": m.get("text_as_html")})
    return out


@dataclass(frozen=True)
class Reader:
    """``read`` gives what JSON holds and ``shape`` (DDL) describes; ``text`` makes the document's text of it."""

    name: str
    suffixes: tuple[str, ...]
    read: Callable[[bytes, dict], object]
    shape: str = "string"
    text: Callable[[Column], Column] = lambda c: c


# The suffixes that each kind of reader takes.
MARKITDOWN = tuple(".pdf .docx .doc .xlsx .xls .pptx .ppt .html .htm .txt .jpg .jpeg .png .gif .bmp .csv .json .xml .zip".split())
PARTITIONED = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".md", ".html", ".txt")

READERS = (
    Reader("pypdf", (".pdf",), pypdf_pages, "array<string>", assemble.plain_pages),
    Reader("pdfplumber", (".pdf",), pdfplumber_pages, f"array<struct<text:string,tables:{CELLS}>>", assemble.pages_with_tables),
    Reader("pymupdf", (".pdf",), pymupdf_pages, f"array<{SPANS}>", lambda pages: assemble.ruled_pages(F.transform(pages, lambda p: assemble.text_blocks(p)))),
    Reader("pdfminer", (".pdf",), pdfminer_text, "string", assemble.form_feed_pages),
    Reader("camelot", (".pdf",), camelot_tables, "array<struct<accuracy:double,whitespace:double,rows:array<array<string>>>>", assemble.table_report),
    Reader("python-docx", (".docx",), docx_document, f"struct<paragraphs:{RUNS},tables:{CELLS}>", lambda d: assemble.docx_document(d["paragraphs"], d["tables"])),
    Reader("docx2txt", (".docx",), docx2txt_text, "string", assemble.docx2txt_document),
    Reader("doc-chain", (".doc",), doc_text, "string", assemble.plain_headings),
    Reader("word-com", (".doc", ".docx", ".rtf"), word_com_text),
    Reader("markitdown", MARKITDOWN, markitdown_text),
    Reader("elements", PARTITIONED, partition_elements, assemble.ELEMENTS, lambda e: assemble.elements_markdown(assemble.drop_elements(e))),
)


def extract_files(files: DataFrame, registry: Registry, readers: tuple[Reader, ...] = READERS, options: dict | None = None) -> DataFrame:
    """(path, file_type, content) to a row for each file and extractor of its suffix, as ``pipeline.extract`` gives.

    ``options`` holds keyword options by reader name. Extractors with a native step read the file as
    UTF-8 text; those without one take the reader of their name. doc_id is the path's hash.
    """
    named, given = {r.name: r for r in readers}, options or {}
    # for each suffix: (order, extractor, whether its step is native)
    routes = {s: [(i, p.name, p.step is not None) for i, p in enumerate(by.values())] for s, by in registry.extractors.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in zip(batch["path"], batch["file_type"], batch["content"], strict=True):
                raw = b"" if content is None else bytes(content)
                for i, name, native in routes.get(suffix, ()):
                    out = error = None
                    try:
                        if native:
                            out = raw.decode("utf-8", "replace")
                        elif name not in named:
                            raise ImportError(f"no reader of the name {name}")
                        else:
                            out = json.dumps(named[name].read(raw, {"suffix": suffix} | given.get(name, {})), default=str)
                    except Exception as e:  # noqa: BLE001  a file's failure must not end the job
                        error = f"{type(e).__name__}: {e}"
                    rows.append((path, suffix, name, i, native, out, error))
            yield pd.DataFrame(rows, columns=["path", "file_type", "extractor", "ext_ord", "native", "out", "error_message"]).astype({"ext_ord": "int32", "native": bool})

    read = files.select("path", "file_type", "content").mapInPandas(run, "path string, file_type string, extractor string, ext_ord int, native boolean, out string, error_message string")
    content = F.lit(None).cast("string")
    for suffix, by in registry.extractors.items():
        for p in by.values():
            here = (F.col("extractor") == p.name) & (F.col("file_type") == suffix)
            if p.step is not None:
                content = F.when(here, p.step(F.col("out"))).otherwise(content)
            elif p.name in named:
                r = named[p.name]
                # in an object, as JSON of a bare string has no schema
                parsed = F.from_json(F.concat(F.lit('{"x":'), F.col("out"), F.lit("}")), f"x {r.shape}")["x"]
                content = F.when(here, r.text(parsed)).otherwise(content)
    ok = F.col("error_message").isNull()
    return read.select(
        F.xxhash64("path").alias("doc_id"), "path", "file_type", "extractor", "ext_ord", F.when(ok, F.coalesce(content, F.lit(""))).otherwise(F.lit("")).alias("content"), F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"), "error_message"
    )
