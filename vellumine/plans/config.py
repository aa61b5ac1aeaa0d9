"""Settings as one checked value; a change that breaks them is refused and leaves them as they were."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession

from vellumine.operators.metrics import METRICS
from vellumine.plans.registry import Registry, catalogue

# Settings by section, and names of processors recommended by file type.
DEFAULTS = {
    "system": {"version": "1.0.0", "debug_mode": False, "auto_cleanup": True, "cleanup_days": 7},
    "logging": {"level": "INFO", "file_logging": True, "console_logging": True},
    "performance": {"max_workers": 4, "timeout_seconds": 300, "max_file_size_mb": 100, "enable_caching": True},
    "processors": {"pdf_default": "PDFPlumber", "cleaner_default": ["Basic Cleaner", "Advanced Cleaner"], "markdown_default": "Custom Markdown Formatter"},
    "quality_metrics": {"text_length_weight": 0.1, "readability_weight": 0.2, "structure_weight": 0.3, "formatting_weight": 0.2, "error_rate_weight": 0.2, "enable_detailed_analysis": True},
    "storage": {"compress_results": False, "backup_enabled": False, "max_storage_mb": 1000},
}
RECOMMENDED = {
    "pdf": ("PDFPlumber", "Advanced Cleaner"),
    "docx": ("Unstructured Partition (DOC/DOCX)", "Basic Cleaner"),
    "pptx": ("Python-pptx", "Advanced Cleaner"),
    "xlsx": ("OpenPyXL", "Basic Cleaner"),
    "image": ("Tesseract", "OCR Artifacts Cleaner"),
}
REQUIRED = ("system", "logging", "performance", "processors")
LIMITS = ("max_workers", "timeout_seconds", "max_file_size_mb")


def problems(settings: dict) -> list[str]:
    """What is wrong with settings; empty if nothing is."""
    found = [f"section {s} is missing" for s in REQUIRED if s not in settings]
    limits = settings.get("performance", {})
    found += [f"{k} must be above 0" for k in LIMITS if not limits.get(k, 0) > 0]
    if not sum(v for k, v in settings.get("quality_metrics", {}).items() if k.endswith("_weight")):
        found.append("the metric weights add up to 0")
    return found


class Settings:
    def __init__(self, values: dict | None = None):
        self.values = copy.deepcopy(DEFAULTS if values is None else values)

    def load(self, text: str) -> Settings:
        """Takes settings from JSON if they hold."""
        new = json.loads(text)
        if found := problems(new):
            raise ValueError("; ".join(found))
        self.values = new
        return self

    def dump(self) -> str:
        return json.dumps(self.values, ensure_ascii=False, indent=2)

    def metrics(self) -> tuple:
        """The metrics, weighted as these settings say."""
        from dataclasses import replace

        own = self.values.get("quality_metrics", {})
        return tuple(replace(m, weight=own.get(f"{m.name}_weight", m.weight)) for m in METRICS)

    def recommended(self, file_type: str) -> dict:
        """Names of an extractor, a cleaner and a converter for a file type; none for one that isn't known."""
        found = RECOMMENDED.get(file_type.lower().lstrip("."))
        return dict(zip(("extractor", "cleaner", "converter"), (*found, "Custom Markdown Formatter"), strict=True)) if found else {}


def processors(spark: SparkSession, registry: Registry) -> DataFrame:
    """Every registration, and what is named without an implementation: kind, suffix, name, ord, enabled, implemented."""
    named = [("extractor", s, p["name"], i, False, False) for i, p in enumerate(catalogue()) for s in p["suffixes"]]
    have = registry.frame(spark)
    return have.unionByName(spark.createDataFrame(named, have.schema))
