"""Markdown converters: Column in, Column out, all native. A blank text converts to an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import rx
from vellumine.operators.assemble import markdown_rows

S = rx.S


def _hashes(level: Column, line: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), line)


def _nonblank(text: Column, out: Column) -> Column:
    return F.when(rx.blank(text), F.lit("")).otherwise(out)


def _leading_number(line: Column) -> Column:
    return rx.number(F.regexp_extract(line, r"(?Ud)\A(\d+)", 1))


# -- headings by line -----------------------------------------------------


def is_heading_line(line: Column) -> Column:
    return (F.length(line) < 100) & ~rx.ends_with_any(line, ".,") & (rx.is_upper(line) | rx.is_title(line) | rx.has(line, rf"\A\d+\.?{S}*[{rx.UP}]"))


def heading_line_level(line: Column) -> Column:
    return F.when(rx.is_upper(line), 1).when(rx.has(line, r"\A\d"), F.when(_leading_number(line) <= 10, 2).otherwise(3)).otherwise(2)


def heading_lines(text: Column) -> Column:
    """Every line that looks like a heading gets hashes; all lines are stripped."""

    def of(line: Column) -> Column:
        return F.when((line != "") & is_heading_line(line), _hashes(heading_line_level(line), line)).otherwise(line)

    return _nonblank(text, rx.each_line(text, lambda x: rx.let(rx.strip(x), of)))


def tidy_lines(text: Column) -> Column:
    text = rx.sub(text, r"\n{3,}", "\n\n")
    text = rx.sub(text, rf"\n(#{{1,6}}){S}*([^\n]+)", "\n$1 $2")
    return rx.strip(rx.sub(text, rf"\n{S}*([*+-]){S}*([^\n]+)", "\n$1 $2"))


# -- headings by paragraph ------------------------------------------------


def is_heading_paragraph(text: Column) -> Column:
    return (F.length(text) < 120) & ~rx.ends_with_any(text, ".,") & (rx.is_upper(text) | rx.is_title(text) | rx.has(text, rf"\A[0-9IVX]+\.?{S}*[{rx.UP}]"))


def heading_paragraph_level(text: Column) -> Column:
    return F.when(rx.is_upper(text) | rx.has(text, r"\A[IVX]"), 1).when(rx.has(text, r"\A[0-9]"), 2).otherwise(3)


def _paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, rf"(?Ud)\n{S}*\n", -1), rx.strip)
    return F.filter(parts, lambda p: p != "")


def _flowed(paragraph: Column) -> Column:
    return F.array_join(F.transform(rx.lines(paragraph), rx.strip), " ")


def paragraph_markdown(text: Column) -> Column:
    """Single-line paragraphs that look like headings get hashes; others flow into one line."""

    def of(p: Column) -> Column:
        single = ~F.contains(p, F.lit("\n"))
        return F.when(single & is_heading_paragraph(p), _hashes(heading_paragraph_level(p), p)).otherwise(_flowed(p))

    return _nonblank(text, F.array_join(F.transform(_paragraphs(text), of), "\n\n"))


def tidy_paragraphs(text: Column) -> Column:
    text = rx.sub(text, r"\n{4,}", "\n\n\n")
    text = rx.sub(text, rf"\n(#{{1,6}}){S}*([^\n]+)", "\n$1 $2")
    return rx.strip(rx.each_line(text, rx.rstrip))


# -- basic ----------------------------------------------------------------


def basic_markdown(text: Column) -> Column:
    """Short lines without a final stop: all capitals become level 1, title case level 2."""

    def of(line: Column) -> Column:
        short = (line != "") & (F.length(line) < 80) & ~F.endswith(line, F.lit("."))
        return F.when(short & rx.is_upper(line), _hashes(F.lit(1), line)).when(short & rx.is_title(line), _hashes(F.lit(2), line)).otherwise(line)

    return _nonblank(text, rx.each_line(text, lambda x: rx.let(rx.strip(x), of)))


def tidy_basic(text: Column) -> Column:
    text = rx.sub(text, r"\n{3,}", "\n\n")
    text = rx.sub(text, rf"\n(#{{1,6}})([^{rx.S_IN}])", "\n$1 $2")
    return rx.strip(rx.sub(text, rf"\n([*+-]){S}*([^\n]+)", "\n$1 $2"))


# -- formatter ------------------------------------------------------------


def preprocess(text: Column) -> Column:
    text = rx.let(text, lambda t: F.when(F.contains(t, F.lit("\r")), rx.sub(t, r"\r\n|\r", "\n")).otherwise(t))
    text = rx.let(text, lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), rx.sub(t, r"[ \t]+", " ")).otherwise(t))
    return rx.strip(rx.sub(text, rf"\n{S}*\n{S}*\n+", "\n\n"))


def is_heading(line: Column) -> Column:
    patterns = (
        rf"[{rx.UP}][^.]{{5,80}}",
        rf"[0-9IVX]+\.?{S}*[{rx.UP}].*",
        rf"[{rx.UP}{rx.S_IN}]{{5,50}}",
        rf"[{rx.UP}][a-zа-я]*({S}[{rx.UP}][a-zа-я]*){{1,8}}",
    )
    return (F.length(line) <= 150) & ~rx.ends_with_any(line, ".,;!?") & rx.has(line, "|".join(rf"\A{p}\z" for p in patterns), "Uds")


def heading_level(line: Column) -> Column:
    number = _leading_number(line)
    return (
        F.when((F.length(line) < 30) & rx.is_upper(line), 1)
        .when(rx.has(line, r"\A[0-9]"), F.when(number <= 5, 1).when(number <= 20, 2).otherwise(3))
        .when(rx.has(line, r"\A[IVX]"), 1)
        .when(rx.is_title(line), 2)
        .otherwise(3)
    )


def format_headings(text: Column) -> Column:
    def of(line: Column) -> Column:
        def named(bare: Column) -> Column:
            return F.when((bare == "") | rx.has(bare, rf"\A#{{1,6}}{S}"), bare).when(is_heading(bare), _hashes(heading_level(bare), bare)).otherwise(line)

        return rx.let(rx.strip(line), named)

    return rx.each_line(text, of)


def format_lists(text: Column) -> Column:
    def of(line: Column) -> Column:
        def named(bare: Column) -> Column:
            bullet, numbered = rf"\A(?:[•·▪▫◦‣⁃]|[*+]){S}*(.+)", rf"\A(\d+)[.)]{S}*(.+)"
            return F.when(rx.has(bare, bullet), rx.sub(bare, bullet, "- $1")).when(rx.has(bare, numbered), rx.sub(bare, numbered, "$1. $2")).otherwise(line)

        return rx.let(rx.strip(line), named)

    return rx.each_line(text, of)


def format_paragraphs(text: Column) -> Column:
    """Blocks that begin with a heading or list item stay; the lines of others flow into one."""
    fixed = rf"\A(?:#{{1,6}}{S}|[-*+]{S}|\d+\.{S})"

    def of(block: Column) -> Column:
        return F.when(rx.has(F.get(rx.lines(block), F.lit(0)), fixed), block).otherwise(_flowed(block))

    return F.array_join(F.transform(_paragraphs(text), of), "\n\n")


def format_emphasis(text: Column) -> Column:
    """Words of three capitals or more become bold, short quotations italic."""
    text = rx.sub(text, f"(?=[{rx.UP}]{{3}}){rx.B0}([{rx.UP}]{{3,}}){rx.B1}", "**$1**")
    return F.regexp_replace(text, F.lit('"([^"]{3,30})"'), F.lit("*$1*"))


def table_block(rows: Column) -> Column:
    """Pipe lines to a Markdown table: empty edge cells go, rows are padded, the first is the header."""

    def cells(line: Column) -> Column:
        def trimmed(all_: Column) -> Column:
            head = F.when(F.get(all_, F.lit(0)) == "", F.slice(all_, F.lit(2), F.size(all_))).otherwise(all_)
            return rx.let(head, lambda c: F.when((F.size(c) > 0) & (F.get(c, F.size(c) - 1) == ""), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c))

        return rx.let(F.transform(F.split(line, r"\|", -1), rx.strip), trimmed)

    return markdown_rows(F.filter(F.transform(rows, cells), lambda c: F.size(c) > 0))


def format_tables(text: Column) -> Column:
    """Runs of pipe lines, begun by one with two pipes, become tables if they have two lines or more."""

    def shaped(lines: Column) -> Column:
        pipes = lambda x: F.regexp_count(x, F.lit(r"\|"))
        marks = F.array_join(F.transform(lines, lambda x: F.when(pipes(x) > 1, F.lit("2")).when(pipes(x) == 1, F.lit("1")).otherwise(F.lit("0"))), "")
        # c: a line that goes on with the run before it
        flags = F.split(F.regexp_replace(marks, F.lit(r"(?<=2)[12]|\G(?<!^)[12]"), F.lit("c")), "")

        def piece(flags: Column, starts: Column, at: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(lines)) - at
            run = F.slice(lines, at + 1, size)
            return F.when((F.get(flags, at) == "2") & (size > 1), table_block(F.transform(run, rx.strip))).otherwise(rx.unlines(run))

        def cut(f: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(f, i) != "c")
            return rx.let(starts, lambda s: rx.unlines(F.transform(s, lambda at, k: piece(f, s, at, k))))

        return rx.let(flags, cut)

    return F.when(F.contains(text, F.lit("|")), rx.let(rx.lines(text), shaped)).otherwise(text)


def postprocess(text: Column) -> Column:
    text = rx.sub(text, r"\n{3,}", "\n\n")
    text = rx.sub(text, rf"\n(#{{1,6}}){S}*([^\n]+)", "\n$1 $2")
    text = rx.sub(text, rf"\n{S}*([-*+]){S}*([^\n]+)", "\n$1 $2")
    return rx.strip(rx.sub(text, rf"\n{S}*(\d+\.){S}*([^\n]+)", "\n$1 $2"))


FORMATTER = (preprocess, format_headings, format_lists, format_paragraphs, format_emphasis, format_tables, postprocess)


def format_markdown(text: Column) -> Column:
    out = text
    for step in FORMATTER:
        # a bound step is computed once; plain nesting would repeat long texts in every lambda
        out = rx.let(out, step)
    return _nonblank(text, out)


def pass_through(text: Column) -> Column:
    return text


def element_counts(text: Column) -> Column:
    """A map of how many Markdown elements of each kind there are."""
    # A pattern for each kind of element.
    patterns = {
        "headers": rf"^#{{1,6}}{S}+",
        "lists": rf"^{S}*[-*+]{S}+",
        "links": r"\[([^\]]+)\]\(([^)]+)\)",
        "bold": r"\*\*([^*]+)\*\*",
        "italic": r"\*([^*]+)\*",
        "code_blocks": r"```[\s\S]*?```",
        "tables": r"\|.*\|",
    }
    signs = {"headers": "#", "links": "](", "bold": "**", "italic": "*", "code_blocks": "```", "tables": "|"}
    return F.create_map(*[x for k, p in patterns.items() for x in (F.lit(k), rx.count(text, p, sign=signs.get(k, "")))])
