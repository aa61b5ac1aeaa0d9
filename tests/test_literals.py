"""Cleaners, converters, metrics and assembly on literal rows with known results."""

import pytest
from pyspark.sql import functions as F

from vellumine.functions import html, rx
from vellumine.operators import assemble, clean, convert, editor, metrics
from vellumine.plans import queries as Q


def one(spark, step, text):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t")).alias("x")).first().x


CASES = [
    (clean.normalise_unicode, "«a» — é № 5… “q”", '"a" - é No. 5... “q”'),
    (clean.normalise_unicode, "é", "é"),
    (clean.fix_encoding, "cafÃ© itâ€™s waitâ€¦ x�y", "café it's wait\"¦ xy"),
    (clean.drop_controls, "a\x00\r\n\tb\x7f", "a\n\tb\x7f"),
    (clean.squeeze_whitespace, "  a   b \n \n\n\n\t c", "a b\n\nc"),
    (clean.join_hyphenated, "exam-\nple", "example"),
    (clean.join_hyphenated, "Foo-\nBar", "Foo-Bar"),
    (clean.join_hyphenated, "ab- \n Cd", "abCd"),
    (clean.merge_lines, "one\ntwo\nthree", "onetwo\nthree"),
    (clean.merge_lines, "end.\ntwo\nA x\na bc", "end.\ntwo\nA x\na bc"),
    (clean.drop_running_heads, "A\nx\nA\ny\nA", "x\ny"),
    (clean.drop_running_heads, "A\nx\nA\nA", "A\nx\nA\nA"),
    (clean.straighten_quotes, 'a "b" "c', 'a "b" c'),
    (clean.straighten_quotes, "„a» ‚b«", '"a" "b"'),
    (clean.normalise_bullets, "•a\n2) b\n3.14\n**bold**\n---\n  plain", "- a\n2. b\n3. 14\n- *bold**\n- --\n  plain"),
    (clean.strip_html, "<p>a &amp;lt; b</p><script>t(1)</script>", "a < bt(1)"),
    (clean.fix_ocr_letters, "modern class 0x l 1a рас", "modem dass Ox I 1a pac"),
    (clean.drop_scan_artifacts, "a|b\n-----\nc....d . e €", "a b c d e "),
    (clean.join_spaced_letters, "п р и в е т a b cd", "при вет a b cd"),
    (clean.fix_numbers, "1O2 OS l", "102 05 l"),
    (convert.heading_lines, "TOP\nplain text,\n12 Next\n3. Part\nTitle Case Here", "# TOP\nplain text,\n### 12 Next\n## 3. Part\n## Title Case Here"),
    (convert.heading_lines, " \n ", ""),
    (convert.paragraph_markdown, "IV Part\n\nline one\nline two\n\n7 Next", "# IV Part\n\nline one line two\n\n## 7 Next"),
    (convert.basic_markdown, "TOP\nTitle Here\nplain\n", "# TOP\n## Title Here\nplain\n"),
    (convert.tidy_lines, "a\n\n\n\n#b\n*c", "a\n\n# b\n* c"),
    (convert.tidy_paragraphs, "a \n\n\n\n\n##b ", "a\n\n\n## b"),
    (convert.tidy_basic, "a\n#b\n-c", "a\n# b\n- c"),
    (convert.format_emphasis, 'USA and "quoted" ЁЖИК ab', "**USA** and *quoted* ЁЖИК ab"),
    (convert.postprocess, "a\n\n**ABC** x", "a\n* *ABC** x"),
    (convert.postprocess, "a\n\n3.14 pi", "a\n3. 14 pi"),
    (convert.format_lists, "• a\n+b\n3) c\n  d", "- a\n- b\n3. c\n  d"),
    (convert.format_tables, "x\na|b|c\n1|2\ny|z\nend", "x\n| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |\n| y | z |  |\nend"),
    (convert.format_tables, "a|b|c\nend", "a|b|c\nend"),
    (convert.format_headings, "Overview of things\nnot. here\n# kept\nVI Next\nends;", "### Overview of things\nnot. here\n# kept\n# VI Next\nends;"),
    (convert.format_markdown, "", ""),
    (assemble.plain_headings, "\n\nTOP\n\n\nshort\nlong enough to stop.", "# TOP\n\n## short\nlong enough to stop."),
    (assemble.normalise_languages, "rus;eng|en", "rus+eng"),
    (assemble.normalise_languages, " , ", None),
    (html.html_structure, "<h2>T <b>x</b></h2><ul><li>a</li></ul><ol><li>b<ol><li>c</li></ol></li></ol><em>e</em>", "## T x- a1. bc*e*"),
    (html.html_unescape, "a &eacute; &lt;", "a é <"),
]


@pytest.mark.parametrize(("step", "text", "want"), CASES)
def test_step(spark, step, text, want):
    assert one(spark, step, text) == want


def test_table_block(spark):
    rows = F.array(F.lit("a|b|c"), F.lit("|---|---|"), F.lit("1|2"))
    assert spark.range(1).select(convert.table_block(rows)).first()[0].split("\n") == ["| a | b | c |", "| --- | --- | --- |", "| --- | --- |  |", "| 1 | 2 |  |"]


def test_element_counts(spark):
    text = "# T\n- a\n[x](y) **b** *i*\n|a|\n|b|\n```c```"
    assert one(spark, convert.element_counts, text) == {"headers": 1, "lists": 1, "links": 1, "bold": 1, "italic": 2, "code_blocks": 1, "tables": 2}


def test_lengths_and_grades(spark):
    rows = spark.createDataFrame([("x" * n, want) for n, want in ((0, 0.0), (99, 0.2), (100, 0.5), (500, 0.7), (2000, 0.9), (10000, 1.0))], "t string, want double")
    assert all(r.got == r.want for r in rows.select(metrics.text_length(F.col("t")).alias("got"), "want").collect())
    grades = spark.createDataFrame([(s,) for s in (0.9, 0.8, 0.7, 0.6, 0.5, 0.4999)], "s double").select(metrics.grade(F.col("s"))).collect()
    assert [g[0].split()[0] for g in grades] == ["A+", "A", "B", "C", "D", "F"]


def test_readability(spark):
    text = "The quick brown fox jumps. It runs away!"
    p = one(spark, lambda t: rx.let(rx.words(t), lambda w: metrics.readability_parts(t, w)), text)
    assert (p.sentences, p.words, p.syllables) == (2, 8, 11)
    assert abs(p.flesch - 86.45) < 0.01 and abs(p.ari + 0.00125) < 1e-4
    assert one(spark, lambda t: rx.let(rx.words(t), lambda w: metrics.readability_parts(t, w)["score"]), "no stop here") == 0.6


def test_errors(spark):
    assert one(spark, lambda t: metrics.broken_word_score(rx.words(t)), "word " * 18 + "a wor-") == 0.0
    assert one(spark, metrics.invalid_character_score, "x" * 99 + "é") == 0.5
    assert one(spark, metrics.invalid_character_score, "ok") == 1.0


def test_blank_and_null_score_nothing(spark):
    df = spark.createDataFrame([(1, None, 5), (2, " \n ", 6), (3, "Fine text. It is.", 7)], "doc_id long, text string, structure int")
    got = {r.doc_id: r for r in metrics.score_texts(df).collect()}
    assert got[1].overall_score == got[2].overall_score == 0.0 and got[1].grade.startswith("F")
    assert 0 < got[3].overall_score <= 1
    assert metrics.score_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["table_assembly", "page_assembly", "span_assembly", "word_assembly", "element_assembly", "language_codes", "quirk_literals", "processor_list"])
def test_literal_queries_run(spark, name):
    assert Q.QUERIES[name](spark, "").count() > 0


def test_span_styles(spark):
    assert Q.span_assembly(spark, "").first().styled == "# A**## b***### c****d*** e"


def test_steps_behind_flags(spark):
    assert one(spark, lambda t: clean.basic_clean(t, normalize_unicode=False), " «a»  b ") == "«a» b"
    with pytest.raises(ValueError):
        clean.basic_clean(F.lit("x"), nonsense=True)


def test_model_edits_elements_in_order(spark):
    df = spark.sql("select 1L as doc_id, array(named_struct('type', 'Title', 'text', 'a', 'metadata', cast(map() as map<string,string>), 'category_depth', 1, 'text_as_html', ''), named_struct('type', 'NarrativeText', 'text', 'b', 'metadata', cast(map() as map<string,string>), 'category_depth', 1, 'text_as_html', '')) as elements")

    def call(prompt):
        text = prompt.split("Текст: ")[1].split("\n")[0]
        around = prompt.split("Контекст: ")[1].split(".\n")[0]
        return {"text": f"{text}[{around}]"}

    row = editor.edit(df, call).first()
    assert row.content == "# a[]\n\nb[a[]]" and row.llm_cleaning_applied and row.llm_chunks_processed == 2
    assert editor.edit(df, lambda p: 1 / 0).first().content == "# a\n\nb"
    assert editor.edit(df).first().content == "# a\n\nb"
    assert editor.context(["x" * 500, "y" * 99, "z" * 500]) == "y" * 99 + "\n\n" + "z" * 500
