"""Text primitives as Column expressions, with one regex dialect.

Patterns are Java's with Unicode classes (U) and Unix lines (d), so that ``\\w``, ``\\s``, ``$`` and
``.`` mean what they do for Unicode text with ``\\n`` as the only line end. White space also holds
the separators U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelled out: ranges are matched faster than Unicode classes. Inside and outside a class.
S_IN = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
S = f"[{S_IN}]"
#: A word character; ``\w`` alone leaves out numbers such as superscripts.
W = r"[\w\p{No}]"
#: Word borders for single word characters.
B0, B1 = r"(?<![\w\p{No}])", r"(?![\w\p{No}])"
#: Upper-case letters that count in headings and emphasis; the Cyrillic range leaves out the letter after E.
UP = "A-ZА-Я"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flagged(pattern: str, flags: str = "Ud") -> Column:
    return F.lit(f"(?{flags}){pattern}")


def count(text: Column, pattern: str, flags: str = "Udm", sign: str = "") -> Column:
    """``sign``: what every match holds; a text without it is not matched at all."""
    found = F.regexp_count(text, flagged(pattern, flags))
    return F.when(lacks(text, sign), F.lit(0)).otherwise(found) if sign else found


def lacks(text: Column, sign: str) -> Column:
    return ~F.contains(text, F.lit(sign))


def has(text: Column, pattern: str, flags: str = "Ud") -> Column:
    return F.regexp_like(text, flagged(pattern, flags))


def count_alone(text: Column, letters: str) -> Column:
    """How often one of ``letters`` stands as a word of its own. The letter is looked for before its borders."""
    return count(text, rf"[{letters}](?<![\w\p{{No}}][{letters}]){B1}", "U")


def find_all(text: Column, pattern: str, group: int = 0, flags: str = "Udm") -> Column:
    return F.regexp_extract_all(text, flagged(pattern, flags), F.lit(group))


def sub(text: Column, pattern: str, to: str, flags: str = "Ud") -> Column:
    return F.regexp_replace(text, flagged(pattern, flags), F.lit(to))


def swap(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Literal replacements, in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def each_line(text: Column, body: Callable[[Column], Column]) -> Column:
    return unlines(F.transform(lines(text), body))


def level(text: Column) -> Column:
    """A space for each white-space character."""
    return F.translate(text, SPACES, " " * len(SPACES))


def words(text: Column) -> Column:
    # a split at one plain character needs no regex
    return F.array_remove(F.split(level(text), " ", -1), "")


def blank(text: Column) -> Column:
    return strip(text) == ""


_CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def is_upper(text: Column) -> Column:
    """Some upper-case letter and no lower-case or title-case one."""
    return F.regexp_like(text, F.lit(r"\p{IsUppercase}")) & ~F.regexp_like(text, F.lit(r"[\p{IsLowercase}\p{Lt}]"))


def is_title(text: Column) -> Column:
    """Upper-case letters follow only uncased characters, lower-case ones only cased."""
    return (
        F.regexp_like(text, F.lit(r"[\p{IsUppercase}\p{Lt}]"))
        & ~F.regexp_like(text, F.lit(rf"(?<={_CASED})[\p{{IsUppercase}}\p{{Lt}}]"))
        & ~F.regexp_like(text, F.lit(rf"(?<!{_CASED})\p{{IsLowercase}}"))
    )


def starts_lower(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A\p{IsLowercase}"))


def ends_with_any(text: Column, ends: str) -> Column:
    return F.right(text, F.lit(1)).isin(*ends)


def number(digits: Column) -> Column:
    """The value of a run of digits; beyond 38 digits, the largest there is."""
    return F.coalesce(digits.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
