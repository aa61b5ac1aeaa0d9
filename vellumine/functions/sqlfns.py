"""The scalar ladders as SQL functions, so that SQL text grades as the DataFrame API does."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vellumine.operators.metrics import GRADES, LOWEST, METRICS


def _case(arg: str, steps: tuple, last: str, test: str) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}D"
    return "CASE " + " ".join(f"WHEN {arg} {test} {bound} THEN {quote(result)}" for bound, result in steps) + f" ELSE {quote(last)} END"


def register_sql(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    weights = {m.name: m.weight for m in METRICS}
    names = ", ".join(f"{m} DOUBLE" for m in weights)
    total = " + ".join(f"{m} * {w}D" for m, w in weights.items())
    made = {
        "quality_grade": ("score DOUBLE", "STRING", _case("score", GRADES, LOWEST, ">=")),
        "text_length_score": ("t STRING", "DOUBLE", _case("length(regexp_replace(t, '(?U)^\\\\s+|\\\\s+$', ''))", ((1, 0.0), (100, 0.2), (500, 0.5), (2000, 0.7), (10000, 0.9)), 1.0, "<")),
        "overall_quality": (names, "DOUBLE", f"({total}) / {sum(weights.values())}D"),
    }
    for name, (args, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(made)
