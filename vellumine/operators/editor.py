"""Element cleaning, with an optional language model given as a callable.

``call(prompt=..., text=..., kind=..., metadata=..., around=...)`` or ``call(prompt)`` gives a string, a dict
with one, or None. Context is the latest cleaned texts of the same document, so a
document's elements are edited in order within one row; rows run in parallel.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import rx
from vellumine.operators.assemble import DROPPED, cleaned_elements_markdown, drop_elements, elements_or_text

CONTEXT = 600


def extra_whitespace(text: Column) -> Column:
    return rx.strip(rx.sub(text, f"{rx.S}+", " "))


#: Named element cleaners. Unknown names are ignored; if none is left, white space is cleaned.
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "clean_extra_whitespace": extra_whitespace,
    "clean_dashes": lambda t: rx.strip(rx.sub(t, "[-–]", " ")),
    "clean_bullets": lambda t: rx.sub(t, rf"\A[•·▪▫◦‣⁃]{rx.S}*", ""),
    "clean_trailing_punctuation": lambda t: rx.sub(t, r"[.,:;]+\z", ""),
}


def resolve(names: tuple[str, ...]) -> list[Callable[[Column], Column]]:
    return [CLEANERS[n] for n in names if n in CLEANERS] or [extra_whitespace]


def clean_elements(elements: Column, text: Column, names: tuple[str, ...] = (), drop: tuple[str, ...] = DROPPED) -> Column:
    """Kept elements with cleaned texts; a document without elements is one narrative element."""

    def one(e: Column) -> Column:
        out = F.coalesce(e["text"], F.lit(""))
        for step in resolve(names):
            out = step(out)
        return e.withField("text", out)

    return F.transform(drop_elements(elements_or_text(elements, text), drop), one)


def context(done: list[str], most: int = CONTEXT) -> str:
    """The longest run of latest texts, blanks aside, whose lengths add up to ``most`` at the utmost."""
    texts = list(filter(None, done))
    left = list(accumulate(map(len, texts[::-1])))  # lengths from the end; they only grow
    return "\n\n".join(texts[len(texts) - bisect_right(left, most) :])


def prompt(text: str, kind: str, metadata: dict, around: str) -> str:
    # The wording of the request.
    return (
        "Выступи в роли редактора. Очисти и нормализуй элемент документа.\n"
        f"Тип элемента: {kind}.\n"
        f"Контекст: {around}.\n"
        "Сохраняй смысл и структуру, не удаляй данные. Верни результат в Markdown.\n"
        f"Текст: {text}\n"
        f"Метаданные: {metadata}\n"
    )


def answer(call: Callable, asked: str, **details) -> str | None:
    """The callable's text; None if it fails or returns none.

    It is called with the prompt and the element's details by name, or, if it doesn't take those, with
    the prompt alone.
    """
    try:
        try:
            out = call(prompt=asked, **details)
        except TypeError:
            out = call(asked)
    except Exception:  # noqa: BLE001  a model that fails leaves the element as it is
        return None
    if isinstance(out, dict):
        out = out.get("text") or out.get("content")
    return out or None


def edit(df: DataFrame, call: Callable[[str], str | dict | None] | None = None) -> DataFrame:
    """(doc_id, elements) to doc_id, content, llm_cleaning_applied, llm_chunks_processed."""
    if call is None:
        return df.select("doc_id", cleaned_elements_markdown(F.col("elements")).alias("content"), F.lit(False).alias("llm_cleaning_applied"), F.lit(0).cast("long").alias("llm_chunks_processed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, elements in zip(batch["doc_id"], batch["elements"], strict=True):
                done: list[str] = []
                n = 0
                for e in elements:
                    details = {"text": e["text"], "kind": e["type"], "metadata": dict(e["metadata"] or {}), "around": context(done)}
                    new = answer(call, prompt(**details), **details) if e["text"] else None
                    n += new is not None
                    done.append(new if new is not None else e["text"])
                rows.append((doc, [{**dict(e), "text": t, "metadata": dict(e["metadata"] or {})} for e, t in zip(elements, done, strict=True)], n))
            yield pd.DataFrame(rows, columns=["doc_id", "elements", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    edited = df.select("doc_id", "elements").mapInPandas(run, f"doc_id {kinds['doc_id']}, elements {kinds['elements']}, n long")
    return edited.select("doc_id", cleaned_elements_markdown(F.col("elements")).alias("content"), (F.col("n") > 0).alias("llm_cleaning_applied"), F.col("n").alias("llm_chunks_processed"))
