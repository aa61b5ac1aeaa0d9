"""File names, provenance headers and reports, as Column expressions where they are per row."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import rx
from vellumine.operators.metrics import METRICS


def sanitise(name: Column) -> Column:
    """A part of a file name: slashes to hyphens, letters, digits, ``_`` and ``-`` kept, spaces to ``_``."""
    safe = F.translate(rx.strip(F.coalesce(name, F.lit(""))), "/\\", "--")
    safe = rx.sub(safe, rf"[^0-9A-Za-zА-Яа-я_\-{rx.S_IN}]", "")
    safe = rx.sub(safe, f"{rx.S}+", "_")
    return F.when(safe == "", F.lit("unknown")).otherwise(safe)


def stage_file(number: Column, stage: Column, libraries: Column, extension: Column, llm: Column) -> Column:
    """``N_stage_lib__lib_LLM-ON.ext``."""
    parts = F.array_join(F.transform(F.filter(libraries, lambda x: F.coalesce(x, F.lit("")) != ""), sanitise), "__")
    base = F.concat_ws("_", number.cast("string"), sanitise(stage), F.nullif(parts, F.lit("")))
    return F.concat(base, F.when(llm, F.lit("_LLM-ON")).otherwise(F.lit("_LLM-OFF")), F.lit("."), F.ltrim(extension, F.lit(".")))


def safe_file(name: Column) -> Column:
    return F.left(F.regexp_replace(name, F.lit("[^A-Za-z0-9_-]"), F.lit("_")), F.lit(50))


def provenance(generated: Column, source: Column, stages: Column) -> Column:
    """Front matter from array<struct<stage, processor, seconds, config>>; config is JSON or null."""

    def one(s: Column, i: Column) -> Column:
        title = F.concat(F.upper(F.left(s["stage"], F.lit(1))), F.lower(F.substring(s["stage"], 2, 1 << 30)))
        config = F.when(s["config"].isNull(), F.lit("      Настройки: {}")).otherwise(F.concat(F.lit("      Настройки:\n"), F.array_join(F.transform(rx.lines(s["config"]), lambda x: F.concat(F.lit("        "), x)), "\n")))
        return F.concat(F.format_string("  - [%d] %s → %s\n", i + 1, title, s["processor"]), F.format_string("      Время выполнения: %.3f сек\n", s["seconds"]), config)

    body = F.when(F.size(stages) == 0, F.lit("Этапы обработки: отсутствуют")).otherwise(F.concat(F.lit("Этапы обработки:\n"), F.array_join(F.transform(stages, one), "\n")))
    head = F.concat_ws("\n", F.lit("---\nметаданные"), F.concat(F.lit("Сгенерировано: "), generated), F.concat(F.lit("Исходный файл: "), source))
    return F.concat(head, F.lit("\n"), body, F.lit("\n---\n\n"))


def quality_json(quality: DataFrame) -> DataFrame:
    """doc_id and a JSON report: every combination's score, how many, and the best one, from one aggregation."""
    row = F.struct("ext_ord", "cln_ord", "cnv_ord", "pipeline_name", "overall_score", "grade", *[m.name for m in METRICS])
    rows = quality.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("combinations"))
    # rows are in registry order, so the first of the greatest score is the best; scores of 0 have none
    above = F.filter("combinations", lambda x: x["overall_score"] > 0)
    top = F.get(F.filter(above, lambda x: x["overall_score"] == F.array_max(F.transform(F.col("combinations"), lambda y: y["overall_score"]))), F.lit(0))
    best_one = F.when(top.isNotNull(), F.struct(top["pipeline_name"].alias("best_combination"), top["overall_score"].alias("best_score"), top["grade"].alias("grade")))
    return rows.select("doc_id", F.to_json(F.struct("combinations", F.size("combinations").alias("total_combinations"), best_one.alias("best"))).alias("report"))


# Words for a score, and the least score of each.
WORDS = ((0.9, "Отлично"), (0.7, "Хорошо"), (0.5, "Удовлетворительно"), (0.3, "Плохо"))
CLASSES = ((0.8, "score-excellent"), (0.6, "score-good"), (0.4, "score-fair"))


def _word(score: float, steps: tuple, last: str) -> str:
    return next((w for least, w in steps if score >= least), last)


def _cells(values, tag: str = "td") -> str:
    return "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)


def comparison_html(rows: list[dict], title: str = "Comparison", advised: list[str] = ()) -> str:
    """A page from comparison rows of one document: the best, all of them, their metrics, and advice.

    A row has extractor, best_combination, best_score, total_time, grade and, if known, metric_scores by name.
    """
    top = max((r for r in rows if r["best_score"] > 0), key=lambda r: r["best_score"], default=None)
    parts = [f"<h1>{html.escape(title)}</h1>"]
    if top:
        parts.append(f"<p>{html.escape(top['extractor'])}: {html.escape(top['best_combination'])}, {top['best_score']:.3f} {html.escape(top['grade'] or '')}</p>")
    lines = ((_word(r["best_score"], CLASSES, "score-poor"), (r["extractor"], r["best_combination"] or "", f"{r['best_score']:.3f}", _word(r["best_score"], WORDS, "Очень плохо"), f"{r['total_time']:.2f}")) for r in rows)
    parts.append("<table>" + "".join(f'<tr class="{kind}">{_cells(values)}</tr>' for kind, values in lines) + "</table>")
    scored = [r for r in rows if r.get("metric_scores")]
    if scored:
        names = [m.name for m in METRICS if any(m.name in r["metric_scores"] for r in scored)]
        body = "".join(f"<tr>{_cells([r['extractor'], *(f'{r['metric_scores'].get(n, 0.0):.3f}' for n in names)])}</tr>" for r in scored)
        parts.append(f'<table class="metrics"><tr>{_cells(["", *names], "th")}</tr>{body}</table>')
    if advised:
        parts.append("<ul>" + _cells(advised, "li") + "</ul>")
    return f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"


def comparison_json(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, sort_keys=True, indent=2)
