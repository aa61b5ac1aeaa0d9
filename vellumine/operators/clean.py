"""Text cleaners: Column in, Column out. All are native; NFC is the one Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumine.functions import rx

# Characters that typographic normalisation replaces, in order.
TYPOGRAPHY = (("«", '"'), ("»", '"'), ("—", "-"), ("–", "-"), ("…", "..."), ("№", "No."))
# Garbled sequences and what they stand for, in order; the third-last hides the last two.
GARBLED = (
    ("Ã¡", "á"),
    ("Ã©", "é"),
    ("Ã­", "í"),
    ("Ã³", "ó"),
    ("Ãº", "ú"),
    ("Ã±", "ñ"),
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("â€¦", "..."),
    ('â€"', "-"),
)
# Entities, in order.
ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "..."),
)
BULLETS = "•·▪▫◦‣⁃"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return texts.str.normalize("NFC")


# -- basic ----------------------------------------------------------------


def squeeze_whitespace(text: Column) -> Column:
    """One space for runs, one blank line for several, no white space at line ends."""
    text = rx.sub(text, " +", " ")
    text = rx.sub(text, rf"\n{rx.S}*\n{rx.S}*\n+", "\n\n")
    return rx.each_line(text, rx.strip)


def typography(text: Column) -> Column:
    return rx.swap(text, TYPOGRAPHY)


def normalise_unicode(text: Column) -> Column:
    """NFC, then typographic replacements. Curly quotes stay."""
    return typography(nfc(text))


def fix_encoding(text: Column) -> Column:
    return rx.swap(F.replace(text, F.lit("�"), F.lit("")), GARBLED)


def drop_controls(text: Column) -> Column:
    """Characters below U+0020 but line feeds and tabs go."""
    return F.regexp_replace(text, F.lit(r"[\x00-\x08\x0b-\x1f]"), F.lit(""))


# -- advanced -------------------------------------------------------------


def join_hyphenated(text: Column) -> Column:
    """A word cut by a hyphen at a line end: one word if its head is short or its tail lower-case, else hyphenated."""
    gap = rf"-{rx.S}*\n{rx.S}*"
    w = rx.W
    pattern = rf"({rx.B0}{w}{{1,2}}){gap}({w}+)|({w}+){gap}(\p{{IsLowercase}}{w}*)|({w}+)(-){rx.S}*\n{rx.S}*({w}+)"
    # the pattern goes over each word from each of its letters; few texts have a cut at all
    return rx.let(text, lambda t: F.when(F.contains(t, F.lit("-")) & rx.has(t, rf"-{rx.S}*\n"), rx.sub(t, pattern, "$1$2$3$4$5$6$7")).otherwise(t))


def merge_lines(text: Column) -> Column:
    """A line without a final stop takes in the next one if that starts lower-case; a merged line takes no more."""

    def may_join(before: Column, line: Column) -> Column:
        return (before != "") & ~rx.ends_with_any(before, ".!?:") & rx.starts_lower(line) & rx.has(line, rf"\A[^{rx.S_IN}]{{2}}")

    def joined(parts: Column) -> Column:
        marks = F.array_join(F.transform(parts, lambda x, i: F.when((i > 0) & may_join(F.get(parts, i - 1), x), F.lit("1")).otherwise(F.lit("0"))), "")
        taken = F.split(F.regexp_replace(marks, F.lit("11"), F.lit("10")), "")  # of lines that may join in a row, every second does
        return rx.let(taken, lambda t: F.array_join(F.transform(parts, lambda x, i: F.concat(F.when((i == 0) | (F.get(t, i) == "1"), F.lit("")).otherwise(F.lit("\n")), x)), ""))

    return rx.let(F.transform(rx.lines(text), rx.strip), joined)


def drop_running_heads(text: Column) -> Column:
    """In texts of five lines or more, lines under 100 characters that occur over twice go. Linearithmic: repeats come from sorted lines."""

    def filtered(parts: Column) -> Column:
        def repeated(ordered: Column) -> Column:
            third = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 2) == x, F.lit(False)))
            return F.array_distinct(third)

        short = F.array_sort(F.filter(F.transform(parts, rx.strip), lambda x: (x != "") & (F.length(x) < 100)))
        kept = rx.let(rx.let(short, repeated), lambda gone: F.when(F.size(gone) == 0, parts).otherwise(F.filter(parts, lambda x: ~F.array_contains(gone, rx.strip(x)))))
        return F.when(F.size(parts) < 5, parts).otherwise(kept)

    return rx.unlines(rx.let(rx.lines(text), filtered))


def straighten_quotes(text: Column) -> Column:
    """Low and angle quotes become straight; of an odd number of straight quotes the last one goes."""

    def even(t: Column) -> Column:
        return F.when(F.regexp_count(t, F.lit('"')) % 2 == 1, F.regexp_replace(t, F.lit(r'"(?=[^"]*\z)'), F.lit(""))).otherwise(t)

    return rx.let(F.translate(text, "„‚«»", '""""'), even)


def _bullet(line: Column) -> Column:
    def of(bare: Column) -> Column:
        number = rx.has(bare, r"\A\d+[.)]")
        return (
            F.when(rx.has(bare, rf"\A[{BULLETS}]"), F.concat(F.lit("- "), rx.sub(bare, rf"\A[{BULLETS}]{rx.S}*", "")))
            .when(rx.has(bare, r"\A[*+-]"), F.concat(F.lit("- "), rx.sub(bare, rf"\A[*+-]{rx.S}*", "")))
            .when(number, rx.sub(bare, rf"\A(\d+)[.)]{rx.S}*", "$1. "))
            .otherwise(line)
        )

    return rx.let(rx.strip(line), of)


def normalise_bullets(text: Column) -> Column:
    return rx.each_line(text, _bullet)


# -- HTML -----------------------------------------------------------------


def strip_html(text: Column) -> Column:
    """Tags go, their contents stay; nine entities are decoded, the ampersand first."""
    return rx.swap(F.regexp_replace(text, F.lit("<[^>]+>"), F.lit("")), ENTITIES)


# -- OCR ------------------------------------------------------------------


def fix_ocr_letters(text: Column) -> Column:
    """In order: lone l, a zero before a letter, three letter pairs, three Cyrillic letters."""
    text = rx.sub(text, f"{rx.B0}l{rx.B1}", "I")
    text = rx.sub(text, f"{rx.B0}0(?=[a-zA-Z])", "O")
    text = rx.swap(text, (("rn", "m"), ("cl", "d"), ("ii", "ll")))
    return F.translate(text, "арс", "apc")


def join_spaced_letters(text: Column) -> Column:
    """Three single letters in a row become one word; three passes."""
    one = "([а-яёa-z])"
    for _ in range(3):
        text = rx.sub(text, f"{rx.B0}{one}{rx.S}+{one}{rx.S}+{one}{rx.B1}", "$1$2$3", "Uiud")
    return text


def drop_scan_artifacts(text: Column) -> Column:
    """Bars, braces, rules, dot leaders, lone dots and odd signs become spaces; all white space runs become one space."""
    for pattern in (
        r"[|}{\\]+",
        r"[_=\-]{5,}",
        r"\.{4,}",
        rf"{rx.S}+\.{rx.S}+",
        rf"""[^\w\p{{No}}{rx.S_IN}.,!?;:()\-'"#*\[\]/]+""",
    ):
        text = rx.sub(text, pattern, " ")
    return rx.sub(text, f"{rx.S}+", " ")


def fix_numbers(text: Column) -> Column:
    """In tokens of digits and O, l, S, G, the letters become 0, 1, 5, 6."""

    def fix(part: Column) -> Column:
        return F.when(rx.has(part, r"\A[\dOlSG]{2,}\z"), F.translate(part, "OlSG", "0156")).otherwise(part)

    border = f"(?<={rx.W}){rx.B1}|{rx.B0}(?={rx.W})"
    return F.array_join(F.transform(F.split(text, f"(?Ud){border}", -1), fix), "")


# -- cleaners -------------------------------------------------------------

Step = Callable[[Column], Column]
BASIC: dict[str, Step] = {
    "remove_extra_whitespace": squeeze_whitespace,
    "normalize_unicode": normalise_unicode,
    "fix_encoding": fix_encoding,
    "remove_control_chars": drop_controls,
}
ADVANCED: dict[str, Step] = {
    "fix_hyphenation": join_hyphenated,
    "merge_broken_words": merge_lines,
    "remove_headers_footers": drop_running_heads,
    "normalize_quotes": straighten_quotes,
    "fix_bullet_points": normalise_bullets,
}
OCR: dict[str, Step] = {
    "fix_character_errors": fix_ocr_letters,
    "fix_word_spacing": join_spaced_letters,
    "remove_artifacts": drop_scan_artifacts,
    "fix_numbers": fix_numbers,
}


def cleaner(steps: dict[str, Step], stripped: bool = True) -> Callable[..., Column]:
    """All steps in order, each behind a flag of its name; then white space at both ends goes."""

    def clean(text: Column, **flags: bool) -> Column:
        if unknown := set(flags) - set(steps):
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        for name, step in steps.items():
            if flags.get(name, True):
                text = step(text)
        return rx.strip(text) if stripped else text

    return clean


basic_clean = cleaner(BASIC)
advanced_clean = cleaner(ADVANCED)
ocr_clean = cleaner(OCR)
html_clean = cleaner({"strip_html": strip_html}, stripped=False)
