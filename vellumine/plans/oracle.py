"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

# Fixed values, spelled out here so that the SQL does not take them from the code that it checks.
LANGUAGES = {"ru": "rus", "rus": "rus", "ru-ru": "rus", "russian": "rus", "eng": "eng", "en": "eng", "en-us": "eng", "english": "eng"}
BULLETS = "•·▪▫◦‣⁃"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "..."))
GARBLED = (("Ã¡", "á"), ("Ã©", "é"), ("Ã\xad", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€¦", "..."), ('â€"', "-"))
TYPOGRAPHY = (("«", '"'), ("»", '"'), ("—", "-"), ("–", "-"), ("…", "..."), ("№", "No."))
GRADES = ((0.9, "A+ (Отлично)"), (0.8, "A (Очень хорошо)"), (0.7, "B (Хорошо)"), (0.6, "C (Удовлетворительно)"), (0.5, "D (Плохо)"))
LOWEST = "F (Неудовлетворительно)"
WEIGHTS = {"text_length": 0.1, "readability": 0.2, "structure": 0.3, "formatting": 0.2, "error_rate": 0.2}
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
VOWELS = ("аеёиоуыэюя", "aeiouy")

# White space as Python and Spark with Unicode classes have it; RE2's own class is ASCII.
S_IN = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{S_IN}]"
UP = "A-ZА-Я"
PUNCT = r"""'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'"""


def n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '(?m){pattern}'))"


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', {to}, 'g')"


def strip(text: str) -> str:
    return sub(text, f"^{S}+|{S}+$", "''")


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{S}+'), lambda x: x <> '')"


def lines(text: str, body: str, x: str = "x") -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda {x}: {body}), chr(10))"


def swap(text: str, pairs) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for old, new in pairs:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def ladder(value: str, steps, last, test: str = "<") -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::double"
    return "case " + " ".join(f"when {value} {test} {b} then {quote(r)}" for b, r in steps) + f" else {quote(last)} end"


CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') and not regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def is_title(x: str) -> str:
    return rf"(regexp_matches({x}, '[\p{{Lu}}\p{{Lt}}]') and not regexp_matches({x}, '{CASED}[\p{{Lu}}\p{{Lt}}]') and not regexp_matches({x}, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}'))"


def measured(source: str) -> str:
    """CTEs from (key columns *, t) to every part of the five metrics, in ``parts``."""
    vowels = [f"(length(b) - length(translate(b, '{v}', '')))" for v in VOWELS]
    syllable = f"case when length(b) <= 3 then 1 else greatest(1, case when {vowels[0]} > 0 then {vowels[0]} else {vowels[1]} end) end"
    valid = r"""A-Za-z0-9!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~ \t\n\r\x0b\x0c""" + RUSSIAN + RUSSIAN.upper()
    strange = rf"""[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}{S_IN}.,!?;:()\-''"#*\[\]|`~/@&%$№+=<>{{}}\\]{{3,}}"""
    return f"""
m0 as (select *, {words("t")} as w, list_filter(list_transform(string_split(t, chr(10)||chr(10)), lambda p: length({strip("p")})), lambda k: k > 0) as ps,
  list_transform(regexp_extract_all(t, '(?m)^(#{{1,6}}){S}+[^\\n]+$', 1), lambda h: length(h)) as levels,
  list_distinct(regexp_extract_all(t, '(?m)^(#{{1,6}}){S}+', 1)) as heads,
  list_distinct(list_transform(regexp_extract_all(t, '(?m)^{S}*([-*+]|[0-9]+\\.){S}+', 1), lambda k: trim(k, '0123456789'))) as marks,
  string_split_regex(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') as tokens from {source}),
m1 as (select *, len(w) as words, {n("t", "[.!?]+")} as sentences, length({sub("t", S + "+", "''")}) as characters,
  coalesce(list_sum(list_transform(list_transform(w, lambda x: trim(lower(x), {PUNCT})), lambda b: {syllable})), 0) as syllables,
  {n("t", f"^#{{1,6}}[^#{S_IN}]")} + {n("t", rf"\[[^\]]*\]\([^)]*{S}[^)]*\)")} + {n("t", r"\*\*[^*]*\*([^*]|\z)")} as errors,
  {n("t", "^#{1,6}")} + {n("t", r"\[[^\]]*\]\([^)]*\)")} + {n("t", r"\*\*[^*]*\*\*")} as checks,
  {n("t", "�+")} + {n("t", r"\.{4,}")} + {n("t", S + "{5,}")} + {n("t", strange)} as artifacts,
  len(list_filter(w, lambda x: ends_with(x, '-') and length(x) > 2)) + len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}'))) as broken,
  {n("t", f"[^{valid}]")} as invalid,
  len(list_filter(tokens, lambda x: x in ('I', 'l', '1', 'O', 'o', '0'))) + {n("t", f"[,.][{UP}]")} + {n("t", f"[{UP}]{{10,}}")} + {n("t", r"\p{Nd}[A-Za-zА-Яа-я]")} as ocr,
  list_sum(ps) / len(ps) as par from m0),
m2 as (select *,
  case when sentences = 0 or words = 0 then 0.0::double else 206.835::double - (1.015::double * words / sentences) - (84.6::double * syllables / words) end as flesch,
  case when sentences = 0 or words = 0 then 0.0::double else 4.71::double * (characters / words) + 0.5::double * (words / sentences) - 21.43::double end as ari from m1),
parts as (select *,
  ({ladder("flesch", ((90, 1.0), (80, 0.9), (70, 0.8), (60, 0.7), (50, 0.6), (30, 0.4)), 0.2, ">=")} + {ladder("ari", ((6, 1.0), (9, 0.8), (13, 0.6), (16, 0.4)), 0.2, "<=")}) / 2.0::double as readable,
  {ladder(f"length({strip('t')})", ((1, 0.0), (100, 0.2), (500, 0.5), (2000, 0.7), (10000, 0.9)), 1.0)} as long,
  (case when len(levels) = 0 then case when regexp_matches(t, '(?m)^{S}*[А-ЯA-Z][^.!?]*:?{S}*$') then 0.3 else 0.1 end when len(list_distinct(levels)) > 1 then 1.0 else 0.7 end)::double as headers,
  {ladder(n("t", f"^{S}*[-*+]{S}+") + " + " + n("t", f"^{S}*[0-9]+[.]{S}+"), ((1, 0.5), (5, 0.7)), 1.0)} as lists,
  (case when len(ps) <= 1 then 0.3 when par >= 100 and par <= 500 then 1.0 when par < 50 then 0.6 when par > 1000 then 0.7 else 0.8 end)::double as paragraphs,
  (case when not regexp_matches(t, '\\|[^\\n]*\\|') then 0.5 when regexp_matches(t, '\\|[-{S_IN}:|]+\\|') then 1.0 else 0.7 end)::double as tables,
  case when checks = 0 then 0.8::double else greatest(0.0::double, 1.0::double - errors / checks) end as syntax,
  coalesce((case when len(heads) = 0 then null when len(heads) <= 3 then 0.8 else 0.6 end + case when len(marks) = 0 then null when len(marks) <= 2 then 1.0 else 0.7 end)::double / 2.0::double,
    (case when len(heads) = 0 then null when len(heads) <= 3 then 0.8 else 0.6 end)::double, (case when len(marks) = 0 then null when len(marks) <= 2 then 1.0 else 0.7 end)::double, 0.8::double) as consistency,
  case when length(t) = 0 then 0.0::double when artifacts = 0 then 1.0::double else {ladder("artifacts / length(t)", ((0.01, 0.9), (0.05, 0.7), (0.1, 0.5)), 0.2)} end as artifact_score,
  case when words = 0 then 0.0::double else greatest(0.0::double, 1.0::double - broken / words * 10.0::double) end as broken_score,
  case when length(t) = 0 then 0.0::double else greatest(0.0::double, 1.0::double - invalid / length(t) * 50.0::double) end as invalid_score,
  case when words = 0 then 0.0::double else greatest(0.0::double, 1.0::double - ocr / words * 5.0::double) end as ocr_score from m2),
five as (select *, case when words = 0 then 0.0::double else long end as text_length, case when words = 0 then 0.0::double else readable end as readability,
  case when words = 0 then 0.0::double else (headers + lists + paragraphs + tables) / 4.0::double end as structure,
  case when words = 0 then 0.0::double else (syntax + consistency + artifact_score) / 3.0::double end as formatting,
  case when words = 0 then 0.0::double else (broken_score + invalid_score + ocr_score) / 3.0::double end as error_rate from parts),
scored as (select *, ({" + ".join(f"{m} * {w}::double" for m, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}::double as overall_score from five)
"""


DOCS = "with docs as (select *, text as t from documents), " + measured("docs")
GRADE = ladder("overall_score", GRADES, LOWEST, ">=")


def digest(body: str, key: str = "doc_id", source: str = "documents", column: str = "text") -> str:
    return f"with s as (select {key}, {column} as t from {source}), c as (select {key}, {body} as x from s) select {key}, md5(x) as digest, length(x)::bigint as n from c"


def blank_or(text: str, body: str) -> str:
    return f"case when {strip(text)} = '' then '' else {body} end"


def heading_line(x: str) -> str:
    test = rf"(length({x}) < 100 and right({x}, 1) not in ('.', ',') and ({is_upper(x)} or {is_title(x)} or regexp_matches({x}, '^[0-9]+\.?{S}*[{UP}]')))"
    level = rf"case when {is_upper(x)} then 1 when regexp_matches({x}, '^[0-9]') then case when regexp_extract({x}, '^[0-9]+')::hugeint <= 10 then 2 else 3 end else 2 end"
    return f"case when {x} <> '' and {test} then repeat('#', {level}) || ' ' || {x} else {x} end"


def heading_paragraph(x: str) -> str:
    test = rf"(not contains({x}, chr(10)) and length({x}) < 120 and right({x}, 1) not in ('.', ',') and ({is_upper(x)} or {is_title(x)} or regexp_matches({x}, '^[0-9IVX]+\.?{S}*[{UP}]')))"
    level = f"case when {is_upper(x)} or regexp_matches({x}, '^[IVX]') then 1 when regexp_matches({x}, '^[0-9]') then 2 else 3 end"
    flow = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {strip('y')}), ' ')"
    return f"case when {test} then repeat('#', {level}) || ' ' || {x} else {flow} end"


def stripped_lines(text: str, body: str) -> str:
    """``body`` over x, the stripped lines of ``text``."""
    return f"array_to_string(list_transform(list_transform(string_split({text}, chr(10)), lambda y: {strip('y')}), lambda x: {body}), chr(10))"


BASIC_LINE = f"case when x <> '' and length(x) < 80 and not ends_with(x, '.') and {is_upper('x')} then '# ' || x when x <> '' and length(x) < 80 and not ends_with(x, '.') and {is_title('x')} then '## ' || x else x end"
PARAGRAPHS = rf"list_filter(list_transform(string_split_regex(t, '\n{S}*\n'), lambda p: {strip('p')}), lambda p: p <> '')"


def paragraph_markdown(text: str) -> str:
    return blank_or(text, f"array_to_string(list_transform({PARAGRAPHS.replace('(t,', f'({text},')}, lambda x: {heading_paragraph('x')}), chr(10)||chr(10))")


def basic_markdown(text: str) -> str:
    return blank_or(text, stripped_lines(text, BASIC_LINE))


def plain_headings(text: str) -> str:
    styled = f"case when x = '' then x when length(x) < 100 and {is_upper('x')} then '# ' || x when length(x) < 80 and not ends_with(x, '.') then '## ' || x else x end"
    kept = f"list_filter(list_transform(string_split({text}, chr(10)), lambda y: {strip('y')}), lambda x, i: x <> '' or (i > 1 and {strip(f'string_split({text}, chr(10))[i - 1]')} <> ''))"
    return f"array_to_string(list_transform({kept}, lambda x: {styled}), chr(10))"


def quotes(text: str) -> str:
    t = f"translate({text}, '„‚«»', '\"\"\"\"')"
    return rf"""case when {n(t, '"')} % 2 = 1 then regexp_replace({t}, '"([^"]*)$', '\1') else {t} end"""


def strip_html(text: str) -> str:
    return swap(f"regexp_replace({text}, '<[^>]+>', '', 'g')", ENTITIES)


WHITESPACE = lines(sub(sub("t", " +", "' '"), rf"\n{S}*\n{S}*\n+", "chr(10)||chr(10)"), strip("x"))
CONTROLS = r"regexp_replace({}, '[\x00-\x08\x0b-\x1f]', '', 'g')"
RUNNING = f"""with s as (select doc_id, string_split(text, chr(10)) as ls from documents),
e as (select doc_id, unnest(list_transform(ls, lambda x: {strip("x")})) as k from s),
r as (select doc_id, list(k) as gone from (select doc_id, k from e where k <> '' and length(k) < 100 group by doc_id, k having count(*) > 2) group by doc_id),
c as (select doc_id, array_to_string(case when len(ls) < 5 or gone is null then ls else list_filter(ls, lambda x: not list_contains(gone, {strip("x")})) end, chr(10)) as x from s left join r using (doc_id))
select doc_id, md5(x) as digest, length(x)::bigint as n from c"""
BULLET = rf"""case when regexp_matches({strip("x")}, '^[{BULLETS}*+-]') then '- ' || regexp_replace({strip("x")}, '^[{BULLETS}*+-]{S}*', '')
  when regexp_matches({strip("x")}, '^[0-9]+[.)]') then regexp_replace({strip("x")}, '^([0-9]+)[.)]{S}*', '\1. ') else x end"""
SCAN = "t"
for _p in (r"[|}{\\]+", r"[_=\-]{5,}", r"\.{4,}", rf"{S}+\.{S}+", rf"""[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}{S_IN}.,!?;:()\-''"#*\[\]/]+""", f"{S}+"):
    SCAN = sub(SCAN, _p, "' '")
LIST_LINE = rf"""case when regexp_matches({strip("x")}, '^([•·▪▫◦‣⁃]|[*+]){S}*[^\n]') then regexp_replace({strip("x")}, '^([•·▪▫◦‣⁃]|[*+]){S}*([^\n]+)', '- \2')
  when regexp_matches({strip("x")}, '^[0-9]+[.)]{S}*[^\n]') then regexp_replace({strip("x")}, '^([0-9]+)[.)]{S}*([^\n]+)', '\1. \2') else x end"""
FLOW_BLOCK = rf"case when regexp_matches(string_split(x, chr(10))[1], '^(#{{1,6}}{S}|[-*+]{S}|[0-9]+\.{S})') then x else array_to_string(list_transform(string_split(x, chr(10)), lambda y: {strip('y')}), ' ') end"
HASHED = rf"\n(#{{1,6}}){S}*([^\n]+)"
TIDY_LINES = strip(sub(sub(sub("t", r"\n{3,}", "chr(10)||chr(10)"), HASHED, r"'\n\1 \2'".replace(r"\n", "' || chr(10) || '")), rf"\n{S}*([*+-]){S}*([^\n]+)", r"'' || chr(10) || '\1 \2'"))
TIDY_PARAGRAPHS = strip(lines(sub(sub("t", r"\n{4,}", "chr(10)||chr(10)||chr(10)"), HASHED, r"chr(10) || '\1 \2'"), sub("x", f"{S}+$", "''")))
TIDY_BASIC = strip(sub(sub(sub("t", r"\n{3,}", "chr(10)||chr(10)"), rf"\n(#{{1,6}})([^{S_IN}])", r"chr(10) || '\1 \2'"), rf"\n([*+-]){S}*([^\n]+)", r"chr(10) || '\1 \2'"))

COMBINATIONS = f"""with ex as (select doc_id, 0 as e, 'plain' as extractor, text as t from documents union all select doc_id, 1, 'headed', {plain_headings("text")} from documents),
cl as (select doc_id, e, extractor, 0 as c, 'Quotes' as cleaner, {quotes("t")} as t from ex union all select doc_id, e, extractor, 1, 'HTML Cleaner', {strip_html("t")} from ex),
cv as (select doc_id, e, extractor, c, cleaner, 0 as v, 'html2text' as converter, {paragraph_markdown("t")} as t from cl
  union all select doc_id, e, extractor, c, cleaner, 1, 'Pandoc', {basic_markdown("t")} from cl
  union all select doc_id, e, extractor, c, cleaner, 2, 'PassThrough', t from cl),
{measured("cv")}, q as (select *, round(overall_score, 6) as s from scored)"""

LABELLED = ", ".join(f"('{c}', '{x}')" for c, x in LANGUAGES.items())

ORACLE = {
    "quality_scores": f"{DOCS} select doc_id, {', '.join(f'round({m}, 6) as {m}' for m in WEIGHTS)}, round(overall_score, 6) as overall_score, {GRADE} as grade from scored",
    "readability": f"{DOCS} select doc_id, sentences::bigint as sentences, words::bigint as words, syllables::bigint as syllables, characters::bigint as characters, round(flesch, 6) as flesch, round(ari, 6) as ari, round(readable, 6) as readability from parts",
    "structure_parts": f"{DOCS} select doc_id, headers, lists, paragraphs, tables from parts",
    "formatting_parts": f"{DOCS} select doc_id, round(syntax, 6) as syntax, consistency, artifacts::bigint as artifacts, artifact_score from parts",
    "error_parts": f"{DOCS} select doc_id, broken::bigint as broken_words, round(broken_score, 6) as broken_score, round(ocr_score, 6) as ocr_score, invalid::bigint as invalid_characters, ocr::bigint as ocr_errors from parts",
    "quality_by_language": f"{DOCS} select lang, count(*) as n, round(avg(overall_score), 6) as mean_score, round(min(overall_score), 6) as least_score, round(max(overall_score), 6) as most_score, count(*) filter (where overall_score >= 0.8) as grade_a from scored group by rollup (lang)",
    "best_document_by_source": f"{DOCS} select source, arg_max(doc_id, struct_pack(a := round(overall_score, 6), b := -doc_id)) as doc_id, max(round(overall_score, 6)) as overall_score from scored group by source",
    "score_by_label": f"{DOCS} select quality, toxic, count(*) as n, round(avg(overall_score), 6) as mean_score from scored join labels using (doc_id) group by quality, toxic",
    "custom_metric": f"{DOCS} select doc_id, round(case when words = 0 then 0.0::double else len(list_distinct(w)) / words end, 6) as lexical_variety, round((overall_score + case when words = 0 then 0.0::double else len(list_distinct(w)) / words end * 0.5) / 1.5, 6) as overall_score from scored",
    "markdown_elements": f"select page_id, {n('html', '^#{1,6}' + S + '+')} as headers, {n('html', f'^{S}*[-*+]{S}+')} as lists, "
    + ", ".join(f"{n('html', p)} as {k}" for k, p in (("links", r"\[([^\]]+)\]\(([^)]+)\)"), ("bold", r"\*\*([^*]+)\*\*"), ("italic", r"\*([^*]+)\*"), ("code_blocks", "```(?s:.)*?```"), ("tables", r"\|[^\n]*\|")))
    + " from pages",
    "clean_basic": digest(strip(CONTROLS.format(swap(f"replace({swap(f'nfc_normalize({WHITESPACE})', TYPOGRAPHY)}, '�', '')", GARBLED)))),
    "clean_whitespace": digest(WHITESPACE),
    "clean_typography": digest(swap("t", TYPOGRAPHY)),
    "clean_encoding": digest(swap("replace(t, '�', '')", GARBLED)),
    "clean_controls": digest(CONTROLS.format("t")),
    "clean_running_heads": RUNNING,
    "clean_quotes": digest(quotes("t")),
    "clean_bullets": digest(lines("t", BULLET)),
    "clean_scan_artifacts": digest(SCAN),
    "clean_html_pages": digest(strip_html("t"), "page_id", "pages", "html"),
    "convert_heading_lines": digest(blank_or("t", stripped_lines("t", heading_line("x")))),
    "convert_paragraphs": digest(paragraph_markdown("t")),
    "convert_basic": digest(basic_markdown("t")),
    "convert_pass_through": digest("t"),
    "format_lists": digest(lines("t", LIST_LINE)),
    "format_paragraphs": digest(f"array_to_string(list_transform({PARAGRAPHS}, lambda x: {FLOW_BLOCK}), chr(10)||chr(10))"),
    "tidy_lines": digest(TIDY_LINES),
    "tidy_paragraphs": digest(TIDY_PARAGRAPHS),
    "tidy_basic": digest(TIDY_BASIC),
    "plain_headings": digest(plain_headings("t")),
    "best_combinations": f"{COMBINATIONS}, b as (select doc_id, extractor || '→' || cleaner || '→' || converter as best_combination, s as best_score from q where s > 0 qualify row_number() over (partition by doc_id order by s desc, e, c, v) = 1) select *, {ladder('best_score', GRADES, LOWEST, '>=')} as grade from b",
    "extractor_comparison": f"""{COMBINATIONS}, b as (select doc_id, e, extractor, max(s) as score, case when e = 0 then doc_id % 12 else doc_id % 7 end as secs from q group by all),
a as (select *, case when score > 0.8 and secs < 10 then 'balanced' when score > 0.9 then 'quality' when secs < 5 then 'fast' end as advice from b)
select doc_id, arg_min(extractor, struct_pack(a := secs, b := e)) as fastest, arg_max(extractor, struct_pack(a := score, b := -e)) as best_quality,
coalesce(string_agg(extractor || ':' || advice, ',' order by e) filter (where advice is not null), '') as recommendations from a group by doc_id""",
    "batch_counts": """select count(*) as total_files, count(*) filter (where doc_id % 17 <> 0) as successful, count(*) filter (where doc_id % 17 = 0) as failed,
count(*) filter (where doc_id % 17 <> 0 and doc_id % 5 = 0) as without_scores from (select distinct doc_id from documents)""",
    "run_summaries": """select distinct doc_id, case when doc_id % 5 = 0 then '' else 'extraction,cleaning,conversion,quality' end as stages_completed,
case when doc_id % 5 = 0 then 'No successful text extraction' else 'extraction: reader for absent is not installed' end as errors from documents""",
    "unrouted_documents": "select doc_id, '.bin' as file_type, 'No successful text extraction' as error_message from documents where doc_id % 5 = 0",
    "previews": digest("case when length(t) > 1000 then left(t, 1000) || '...' else t end"),
    "language_codes": f"""with c(code) as (values ('ru+en'), ('rus;eng|en'), ('en-US'), (' , '), ('DE,xx')), m(k, v) as (values {LABELLED}),
p as (select code, i, lower(trim(string_split_regex(code, '[+,;|]')[i])) as part from (select code, unnest(range(1, len(string_split_regex(code, '[+,;|]')) + 1)) as i from c)),
f as (select code, coalesce(v, part) as x, min(i) as i from p left join m on k = part where part <> '' group by all)
select code, string_agg(x, '+' order by i) as codes from c left join f using (code) group by code""",
}
