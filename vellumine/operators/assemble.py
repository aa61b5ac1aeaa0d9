"""Native assembly of what file readers find: pages, spans, tables, paragraphs, elements.

Readers are plug-ins that return nested columns; everything here is Column expressions over them.
Texts that users see are in Russian, as fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import rx

# Labels in extracted texts.
PAGE, TABLE, TABLES, COLUMN = "# Страница ", "## Таблица ", "# Таблицы", "Колонка "
EMPTY_TABLE, FOUND_NONE, EMPTY_DOCX_TABLE = "*Таблица пуста*", "*Таблицы не найдены*", "*Пустая таблица*"
FOUND_TITLE, FOUND_COUNT, ACCURACY, WHITESPACE = "# Извлеченные таблицы из PDF", "Найдено таблиц: ", "Точность: ", "Whitespace: "
NO_TEXT = "Текст не извлечен или документ пуст"


def _numbered(label: str, i: Column) -> Column:
    return F.concat(F.lit(label), (i + 1).cast("string"))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _rule(n: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), n), "|"), F.lit("|"))


def _table(header: Column, rows: Column, width: Column) -> Column:
    return F.array_join(F.concat(F.array(_row(header), _rule(width)), F.transform(rows, _row)), "\n")


def markdown_rows(rows: Column) -> Column:
    """array<array<string>> to a table: rows are padded to the widest, the first is the header; no rows: ''."""

    def of(all_: Column) -> Column:
        def padded(width: Column) -> Column:
            full = F.transform(all_, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
            return rx.let(full, lambda p: _table(F.get(p, F.lit(0)), F.slice(p, F.lit(2), F.size(p)), width))

        return F.when(F.size(all_) == 0, F.lit("")).otherwise(rx.let(F.array_max(F.transform(all_, lambda r: F.size(r))), padded))

    return rx.let(rows, of)


def pdf_table(table: Column) -> Column:
    """Missing cells are empty; rows keep their own lengths; an empty table or first row gives ''."""

    def of(rows: Column) -> Column:
        clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
        head = F.get(clean, F.lit(0))
        return F.when((F.size(rows) < 1) | (F.size(F.get(rows, F.lit(0))) < 1), F.lit("")).otherwise(_table(head, F.slice(clean, F.lit(2), F.size(clean)), F.size(head)))

    return rx.let(F.coalesce(table, F.array().cast("array<array<string>>")), of)


def frame_table(table: Column) -> Column:
    """A table under made-up column names; cells are stripped."""

    def of(rows: Column) -> Column:
        width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
        names = F.transform(F.sequence(F.lit(0), width - 1), lambda i: _numbered(COLUMN, i))
        cells = F.transform(rows, lambda r: F.transform(r, lambda c: rx.strip(F.coalesce(c, F.lit("")))))
        return F.when((F.size(rows) < 1) | (width < 1), F.lit(EMPTY_TABLE)).otherwise(_table(names, cells, width))

    return rx.let(F.coalesce(table, F.array().cast("array<array<string>>")), of)


def docx_table(table: Column) -> Column:
    clean = F.transform(table, lambda r: F.transform(r, lambda c: F.replace(rx.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))))
    return F.when(F.coalesce(F.size(table), F.lit(0)) < 1, F.lit(EMPTY_DOCX_TABLE)).otherwise(markdown_rows(clean))


# -- pages ----------------------------------------------------------------


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), by)


def plain_pages(pages: Column) -> Column:
    """array<string>: numbered pages, blank ones left out, a blank line between."""
    return _joined(F.transform(pages, lambda p, i: F.when(~rx.blank(p), F.concat(_numbered(PAGE, i), F.lit("\n\n"), p))), "\n\n")


def ruled_pages(pages: Column) -> Column:
    """As ``plain_pages``, stripped, with rules between."""
    return _joined(F.transform(pages, lambda p, i: F.when(~rx.blank(p), F.concat(_numbered(PAGE, i), F.lit("\n\n"), rx.strip(p)))), "\n\n---\n\n")


def pages_with_tables(pages: Column) -> Column:
    """array<struct<text, tables>>: text, then its tables under headings; pages without either are left out."""

    def page(p: Column, i: Column) -> Column:
        text = F.when(~rx.blank(F.coalesce(p["text"], F.lit(""))), F.array(rx.strip(p["text"]))).otherwise(F.array().cast("array<string>"))
        indexed = F.transform(F.coalesce(p["tables"], F.array().cast("array<array<array<string>>>")), lambda t, k: F.when(F.size(t) > 0, F.array(F.concat(F.lit("\n"), _numbered(TABLE, k)), pdf_table(t))))
        tables = F.flatten(F.filter(indexed, lambda t: t.isNotNull()))
        return rx.let(F.concat(text, tables), lambda c: F.when(F.size(c) > 0, F.array_join(F.concat(F.array(_numbered(PAGE, i)), c), "\n\n")))

    return _joined(F.transform(pages, page), "\n\n---\n\n")


def span_text(span: Column, fonts: bool = True) -> Column:
    """Large type gets hashes, then flag 16 bold and flag 2 italic, around the hashes."""
    text = F.coalesce(span["text"], F.lit(""))
    size, flags = F.coalesce(span["size"], F.lit(0.0)), F.coalesce(span["flags"], F.lit(0))
    head = F.concat(F.when(size > 16, F.lit("# ")).when(size > 14, F.lit("## ")).when(size > 12, F.lit("### ")).otherwise(F.lit("")), text)
    bold = F.when(flags.bitwiseAND(F.lit(16)) != 0, F.concat(F.lit("**"), head, F.lit("**"))).otherwise(head)
    styled = F.when(flags.bitwiseAND(F.lit(2)) != 0, F.concat(F.lit("*"), bold, F.lit("*"))).otherwise(bold)
    return F.when(rx.blank(text) | F.lit(not fonts), text).otherwise(styled)


def text_blocks(blocks: Column, fonts: bool = True) -> Column:
    """array<struct<lines: array<struct<spans>>>>: lines joined by spaces, blocks by blank lines."""
    line = lambda x: rx.strip(F.array_join(F.transform(x["spans"], lambda s: span_text(s, fonts)), ""))
    lines = lambda b: F.filter(F.transform(b["lines"], line), lambda x: x != "")
    kept = F.filter(F.transform(F.filter(blocks, lambda b: b["lines"].isNotNull()), lines), lambda x: F.size(x) > 0)
    return F.array_join(F.transform(kept, lambda x: F.array_join(x, " ")), "\n\n")


def form_feed_pages(text: Column, target: int = 3000) -> Column:
    """Pages at form feeds; a text without any is cut into equal chunks of about ``target`` characters."""
    n = F.length(text)
    size = F.greatest(F.lit(1), (n / F.greatest(F.lit(1), (n / target).cast("int"))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), n - 1, size), lambda i: F.substring(text, i + 1, size))
    cut = F.when(F.contains(text, F.lit("\f")), F.split(text, "\f", -1)).when(n == 0, F.array().cast("array<string>")).otherwise(chunks)
    return ruled_pages(cut)


def table_report(tables: Column) -> Column:
    """array<struct<accuracy, whitespace, rows>>: title, count, and each table with its figures."""

    def one(t: Column, i: Column) -> Column:
        return F.array(F.concat(F.lit("\n"), _numbered(TABLE, i)), F.concat(F.lit(ACCURACY), F.format_string("%.2f", t["accuracy"])), F.concat(F.lit(WHITESPACE), F.format_string("%.2f", t["whitespace"])), frame_table(t["rows"]))

    head = F.array(F.lit(FOUND_TITLE), F.concat(F.lit(FOUND_COUNT), F.size(tables).cast("string")))
    body = F.when(F.size(tables) == 0, F.array(F.lit(FOUND_NONE))).otherwise(F.flatten(F.transform(tables, one)))
    return F.array_join(F.concat(head, body), "\n\n")


# -- word documents -------------------------------------------------------


def run_text(run: Column) -> Column:
    """Bold, italic or both; then underline around it."""
    flag = lambda name: F.coalesce(run[name], F.lit(False))
    stars = F.when(flag("bold") & flag("italic"), F.lit("***")).when(flag("bold"), F.lit("**")).when(flag("italic"), F.lit("*")).otherwise(F.lit(""))
    text = F.concat(stars, run["text"], stars)
    return F.when(flag("underline"), F.concat(F.lit("<u>"), text, F.lit("</u>"))).otherwise(text)


def paragraph_text(paragraph: Column, formatted: bool = True) -> Column:
    """struct<text, style, runs>: a heading by its style's name, else its styled runs."""
    text = rx.strip(F.coalesce(paragraph["text"], F.lit("")))
    if not formatted:
        return text
    style = F.lower(F.coalesce(paragraph["style"], F.lit("")))
    out = F.when(text == "", F.lit(""))
    for n in range(1, 7):
        out = out.when(F.contains(style, F.lit(f"heading {n}")) | F.contains(style, F.lit(f"заголовок {n}")), F.concat(F.lit("#" * n + " "), text))
    out = out.when(F.contains(style, F.lit("title")) | F.contains(style, F.lit("название")), F.concat(F.lit("# "), text))
    runs = F.filter(paragraph["runs"], lambda r: F.coalesce(r["text"], F.lit("")) != "")
    return out.when(F.coalesce(F.size(paragraph["runs"]), F.lit(0)) > 0, F.array_join(F.transform(runs, run_text), "")).otherwise(text)


def docx_document(paragraphs: Column, tables: Column) -> Column:
    """Paragraphs, then all tables under one heading."""
    body = F.filter(F.transform(paragraphs, lambda p: paragraph_text(p)), lambda p: p != "")
    each = F.flatten(F.transform(tables, lambda t, i: F.array(_numbered(TABLE, i), docx_table(t))))
    more = F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, F.concat(F.array(F.lit(f"\n{TABLES}\n")), each)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(body, more), "\n\n")


def docx_plain(paragraphs: Column, tables: Column) -> Column:
    """Stripped paragraphs, then table rows with any text, cells joined by bars."""
    body = F.filter(F.transform(paragraphs, rx.strip), lambda p: p != "")
    rows = F.filter(F.transform(F.flatten(tables), lambda r: F.transform(r, rx.strip)), lambda r: F.exists(r, lambda c: c != ""))
    return F.array_join(F.concat(body, F.transform(rows, lambda r: F.array_join(r, " | "))), "\n")


def plain_headings(text: Column) -> Column:
    """Blank lines collapse, none at the start; capitals become level 1, short lines without a stop level 2."""

    def styled(line: Column) -> Column:
        return (
            F.when(line == "", line)
            .when((F.length(line) < 100) & rx.is_upper(line), F.concat(F.lit("# "), line))
            .when((F.length(line) < 80) & ~F.endswith(line, F.lit(".")), F.concat(F.lit("## "), line))
            .otherwise(line)
        )

    stripped = F.transform(rx.lines(text), rx.strip)
    kept = rx.let(stripped, lambda x: F.filter(x, lambda line, i: (line != "") | (F.coalesce(F.get(x, i - 1), F.lit("")) != "")))
    return F.when(text == "", F.lit("")).otherwise(rx.unlines(F.transform(kept, styled)))


def docx2txt_document(text: Column) -> Column:
    return F.when(F.coalesce(rx.blank(text), F.lit(True)), F.lit(NO_TEXT)).otherwise(plain_headings(text))


# -- elements -------------------------------------------------------------

DROPPED = ("Header", "Footer", "PageBreak")
ELEMENTS = "array<struct<type:string,text:string,metadata:map<string,string>,category_depth:int,text_as_html:string>>"


def drop_elements(elements: Column, types: tuple[str, ...] = DROPPED) -> Column:
    return F.filter(elements, lambda e: ~F.coalesce(e["type"], F.lit("Text")).isin(*types))


def _elements(elements: Column, title: bool) -> Column:
    def one(e: Column) -> Column:
        text = rx.strip(F.coalesce(e["text"], F.lit("")))
        depth = F.coalesce(F.nullif(e["category_depth"], F.lit(0)), F.lit(1))
        level = F.greatest(F.lit(1), F.least(F.lit(6), depth)) if title else F.lit(1)
        return (
            F.when(text == "", F.lit(None).cast("string"))
            .when(e["type"] == "Title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
            .when(e["type"] == "ListItem", F.concat(F.lit("- "), text))
            .when((e["type"] == "Table") & F.lit(title), e["text"])
            .otherwise(text)
        )

    return _joined(F.transform(elements, one), "\n\n")


def elements_markdown(elements: Column) -> Column:
    """Titles by depth, list items, tables as their text; blank elements are left out."""
    return _elements(elements, True)


def cleaned_elements_markdown(elements: Column) -> Column:
    """As ``elements_markdown``, but every title is level 1 and tables are stripped."""
    return _elements(elements, False)


def elements_or_text(elements: Column, text: Column) -> Column:
    """The elements, or the whole text as one narrative element where there are none."""
    whole = F.array(F.struct(F.lit("NarrativeText").alias("type"), text.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("int").alias("category_depth"), F.lit(None).cast("string").alias("text_as_html")))
    return F.when(F.coalesce(F.size(elements), F.lit(0)) > 0, elements).otherwise(whole)


# Language names and their three-letter codes.
LANGUAGES = {"ru": "rus", "rus": "rus", "ru-ru": "rus", "russian": "rus", "eng": "eng", "en": "eng", "en-us": "eng", "english": "eng"}


def normalise_languages(codes: Column) -> Column:
    """'ru+en' and the like to distinct codes joined by plus signs; NULL if there are none."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    parts = F.filter(F.transform(F.split(codes, r"[+,;|]", -1), lambda c: F.lower(rx.strip(c))), lambda c: c != "")
    mapped = F.array_distinct(F.transform(parts, lambda c: F.coalesce(F.try_element_at(table, c), c)))
    return F.nullif(F.array_join(mapped, "+"), F.lit(""))
