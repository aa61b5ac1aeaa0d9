"""Named extractors, cleaners and converters, in an order that decides ties."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import assemble, clean, convert

Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Processor:
    """``step`` turns one text column into another; None where only a reader plug-in can do it."""

    kind: str
    name: str
    step: Step | None
    suffixes: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    enabled: bool = True


def identity(text: Column) -> Column:
    return text


@dataclass
class Registry:
    """Extractors by suffix, cleaners and converters; what is registered first ranks first."""

    extractors: dict[str, dict[str, Processor]] = field(default_factory=dict)
    cleaners: list[Processor] = field(default_factory=list)
    converters: dict[str, Processor] = field(default_factory=dict)

    def add_extractor(self, name: str, step: Step | None, *suffixes: str, **parameters) -> Registry:
        """A later extractor of the same name and suffix takes the earlier one's place."""
        for s in suffixes:
            self.extractors.setdefault(s.lower(), {})[name] = Processor("extractor", name, step, tuple(suffixes), parameters)
        return self

    def add_cleaner(self, name: str, step: Step, **parameters) -> Registry:
        self.cleaners.append(Processor("cleaner", name, step, (), parameters))
        return self

    def add_converter(self, name: str, step: Step, **parameters) -> Registry:
        self.converters[name] = Processor("converter", name, step, (), parameters)
        return self

    def extractors_for(self, suffix: str) -> list[str]:
        return list(self.extractors.get(suffix.lower(), {}))

    def chosen_extractors(self, suffix: str, name: str | None = None) -> list[Processor]:
        """All for the suffix, or the named one; an unknown name is an error, an unknown suffix is not."""
        have = self.extractors.get(suffix.lower(), {})
        if name is None or not have:
            return list(have.values())
        if name not in have:
            raise ValueError(f"no extractor {name!r} for {suffix}")
        return [have[name]]

    def chosen_cleaners(self, names: Iterable[str] | None = None) -> list[Processor]:
        """Those named; unknown names are ignored, an empty choice means all."""
        names = set(names or ())
        return [c for c in self.cleaners if not names or c.name in names]

    def chosen_converters(self, name: str | None = None) -> list[Processor]:
        """The one named, or all if there is none of that name."""
        return [self.converters[name]] if name in self.converters else list(self.converters.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """kind, suffix, name, ord, enabled, implemented: a row for each registration."""
        rows = [("extractor", s, p.name, i, p.enabled, p.step is not None) for s, by in self.extractors.items() for i, p in enumerate(by.values())]
        rows += [("cleaner", None, p.name, i, p.enabled, True) for i, p in enumerate(self.cleaners)]
        rows += [("converter", None, p.name, i, p.enabled, True) for i, p in enumerate(self.converters.values())]
        return spark.createDataFrame(rows, "kind string, suffix string, name string, ord int, enabled boolean, implemented boolean")


def default_registry() -> Registry:
    """Text suffixes have native extractors; others name the reader they need."""
    r = Registry()
    r.add_extractor("plain", identity, ".txt", ".md", ".csv", ".json", ".xml")
    r.add_extractor("headed", assemble.plain_headings, ".txt", ".md")
    r.add_extractor("html", identity, ".html", ".htm")
    for name in ("pypdf", "pdfplumber", "pymupdf", "pdfminer", "camelot"):
        r.add_extractor(name, None, ".pdf")
    for name in ("python-docx", "docx2txt"):
        r.add_extractor(name, None, ".docx")
    r.add_extractor("doc-chain", None, ".doc").add_extractor("word-com", None, ".doc", ".docx", ".rtf")
    r.add_extractor("elements", None, ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".md", ".html", ".txt")
    r.add_extractor("markitdown", identity, ".txt", ".csv", ".json")
    r.add_extractor("markitdown", None, ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".html", ".htm", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".xml", ".zip")
    r.add_cleaner("Basic Cleaner", clean.basic_clean).add_cleaner("Advanced Cleaner", clean.advanced_clean).add_cleaner("HTML Cleaner", clean.html_clean)
    r.add_converter("Markdownify", convert.heading_lines).add_converter("html2text", convert.paragraph_markdown).add_converter("Pandoc", convert.basic_markdown)
    return r.add_converter("Custom Markdown Formatter", convert.format_markdown).add_converter("PassThrough", convert.pass_through)


def catalogue() -> tuple[dict, ...]:
    """Processors that configuration names without an implementation."""
    # Names and suffixes of configured processors that have no code.
    named = {"python-pptx": (".pptx",), "openpyxl": (".xlsx",), "pandas_excel": (".xlsx", ".xls"), "xlrd": (".xls",), "tesseract": (".jpg", ".jpeg", ".png", ".tiff"), "easyocr": (".jpg", ".jpeg", ".png", ".tiff")}
    return tuple({"name": n, "suffixes": s, "implemented": False} for n, s in named.items())


def ordered(processors: list[Processor], text: Column) -> Column:
    """array<struct<name, ord, text>> of what each processor makes of ``text``."""
    return F.array(*[F.struct(F.lit(p.name).alias("name"), F.lit(i).alias("ord"), p.step(text).alias("text")) for i, p in enumerate(processors)])
