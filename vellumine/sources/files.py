"""Files and tables as documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of a batch, and media types of suffixes.
PATTERNS = ("*.pdf", "*.docx", "*.doc", "*.pptx", "*.ppt", "*.xlsx", "*.xls", "*.jpg", "*.jpeg", "*.png", "*.tiff")
MEDIA = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xml": "application/xml",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
}


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def media_type(suffix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream"))


def scan(spark: SparkSession, directory: str, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Files of a directory, not below it, with their metadata. A file that two patterns match is listed twice; an empty one has nothing to read and is left out."""
    one = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", p).load(directory)
    files = reduce(DataFrame.unionByName, map(one, patterns))
    suffix = suffix_of(F.col("path"))
    return files.select("path", suffix.alias("file_type"), F.col("length").alias("file_size"), media_type(suffix).alias("mime_type"), F.col("modificationTime").alias("modified_at"), "content")


def texts(files: DataFrame) -> DataFrame:
    """Files whose content is text, decoded as UTF-8 with replacement characters for what is not."""
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "file_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_with(files: DataFrame, reader: Callable[[bytes], str]) -> DataFrame:
    """Texts by a Python reader of file contents, one Arrow batch at a time; a reader's error is the row's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch["content"]:
                try:
                    texts.append(reader(bytes(raw)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a file's failure must not end the job
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            failed = pd.Series([e is not None for e in errors], dtype=bool)
            yield pd.DataFrame({"path": batch["path"], "file_type": batch["file_type"], "text": texts, "status": failed.map({True: "failed", False: "completed"}), "error_message": errors})

    return files.select("path", "file_type", "content").mapInPandas(run, "path string, file_type string, text string, status string, error_message string")


def optional_reader(suffix: str) -> Callable[[bytes], str] | None:
    """A reader for the suffix if its library is installed."""
    import io

    if suffix == ".pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return None
        return lambda raw: "\n\n".join(f"# Страница {i}\n\n{t}" for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1) if (t := p.extract_text()).strip())
    if suffix == ".docx":
        try:
            from docx import Document
        except ImportError:
            return None
        return lambda raw: "\n".join(t for p in Document(io.BytesIO(raw)).paragraphs if (t := p.text.strip()))
    return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer partitions than there are; else as it is.

    A small table is one row group and so one task; a large scan is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
