"""Registered queries over whole tables, one for each operator or a group of small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import html, rx
from vellumine.operators import assemble, clean, convert, editor, metrics
from vellumine.plans import config, pipeline, registry, report
from vellumine.sources.files import spread, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _digest(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, text.alias("t")).select(key, F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


# -- metrics --------------------------------------------------------------


@query
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.score_texts(documents(spark, d))
    return scored.select("doc_id", *[_r(m.name).alias(m.name) for m in metrics.METRICS], _r("overall_score").alias("overall_score"), "grade")


@query
def readability(spark: SparkSession, d: str) -> DataFrame:
    parts = rx.let(rx.words(F.col("text")), lambda w: metrics.readability_parts(F.col("text"), w))
    docs = documents(spark, d).select("doc_id", F.inline(F.array(parts)))
    ints = [F.col(c).cast("long").alias(c) for c in ("sentences", "words", "syllables", "characters")]
    return docs.select("doc_id", *ints, _r("flesch").alias("flesch"), _r("ari").alias("ari"), _r("score").alias("readability"))


@query
def structure_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", metrics.header_score(t).alias("headers"), metrics.list_score(t).alias("lists"), metrics.paragraph_score(t).alias("paragraphs"), metrics.table_score(t).alias("tables"))


@query
def formatting_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", _r(metrics.syntax_score(t)).alias("syntax"), metrics.consistency_score(t).alias("consistency"), metrics.artifact_count(t).cast("long").alias("artifacts"), metrics.artifact_score(t).alias("artifact_score"))


@query
def error_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    parts = rx.let(rx.words(t), lambda w: F.struct(metrics.broken_word_count(w).cast("long").alias("broken_words"), _r(metrics.broken_word_score(w)).alias("broken_score"), _r(metrics.ocr_score(t, w)).alias("ocr_score")))
    return documents(spark, d).select("doc_id", F.inline(F.array(parts)), metrics.invalid_character_count(t).cast("long").alias("invalid_characters"), metrics.ocr_error_count(t).cast("long").alias("ocr_errors"))


@query
def quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    rolled = pipeline.corpus_rollup(metrics.score_texts(documents(spark, d)), "lang")
    return rolled.select("lang", "n", *[_r(c).alias(c) for c in ("mean_score", "least_score", "most_score")], "grade_a")


@query
def best_document_by_source(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.score_texts(documents(spark, d)).withColumn("overall_score", _r("overall_score"))
    top = F.max_by("doc_id", F.struct(F.col("overall_score"), -F.col("doc_id")))
    return scored.groupBy("source").agg(top.alias("doc_id"), F.max("overall_score").alias("overall_score"))


@query
def score_by_label(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.score_texts(documents(spark, d)).select("doc_id", "overall_score")
    return scored.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), _r(F.avg("overall_score")).alias("mean_score"))


@query
def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "pages").select("page_id", convert.element_counts(F.col("html")).alias("m"))
    return counted.select("page_id", *[F.col("m")[k].cast("long").alias(k) for k in ("headers", "lists", "links", "bold", "italic", "code_blocks", "tables")])


@query
def custom_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric of one's own joins the weighted mean."""
    own = (*metrics.METRICS, metrics.Metric("lexical_variety", 0.5, lambda t, w: F.size(F.array_distinct(w)) / F.size(w)))
    scored = metrics.score_texts(documents(spark, d), metrics=own)
    return scored.select("doc_id", _r("lexical_variety").alias("lexical_variety"), _r("overall_score").alias("overall_score"))


# -- cleaners -------------------------------------------------------------


def _cleaned(name: str, step, source: str = "documents", key: str = "doc_id", column: str = "text"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _digest(spread(table(spark, d, source)), key, step(F.col(column)))

    run.__name__ = name
    QUERIES[name] = run


_cleaned("clean_basic", clean.basic_clean)
_cleaned("clean_advanced", clean.advanced_clean)
_cleaned("clean_ocr", clean.ocr_clean)
_cleaned("clean_html_pages", clean.html_clean, "pages", "page_id", "html")
_cleaned("clean_whitespace", clean.squeeze_whitespace)
_cleaned("clean_typography", clean.typography)
_cleaned("clean_encoding", clean.fix_encoding)
_cleaned("clean_controls", clean.drop_controls)
_cleaned("clean_running_heads", clean.drop_running_heads)
_cleaned("clean_quotes", clean.straighten_quotes)
_cleaned("clean_bullets", clean.normalise_bullets)
_cleaned("clean_merged_lines", clean.merge_lines)
_cleaned("clean_hyphenation", clean.join_hyphenated)
_cleaned("clean_ocr_letters", clean.fix_ocr_letters)
_cleaned("clean_scan_artifacts", clean.drop_scan_artifacts)
_cleaned("clean_spaced_letters", clean.join_spaced_letters)
_cleaned("clean_numbers", clean.fix_numbers)
_cleaned("html_structure_pages", html.html_structure, "pages", "page_id", "html")
_cleaned("html_text_pages", html.html_text, "pages", "page_id", "html")
_cleaned("html_unescape_pages", html.html_unescape, "pages", "page_id", "html")

# -- converters -----------------------------------------------------------

_cleaned("convert_heading_lines", convert.heading_lines)
_cleaned("convert_paragraphs", convert.paragraph_markdown)
_cleaned("convert_basic", convert.basic_markdown)
_cleaned("convert_formatter", convert.format_markdown)
_cleaned("convert_pass_through", convert.pass_through)
_cleaned("format_headings", lambda t: convert.format_headings(convert.preprocess(t)))
_cleaned("format_lists", convert.format_lists)
_cleaned("format_paragraphs", convert.format_paragraphs)
_cleaned("format_emphasis", convert.format_emphasis)
_cleaned("format_tables", convert.format_tables)
_cleaned("tidy_lines", convert.tidy_lines)
_cleaned("tidy_paragraphs", convert.tidy_paragraphs)
_cleaned("tidy_basic", convert.tidy_basic)
_cleaned("plain_headings", assemble.plain_headings)
_cleaned("form_feed_pages", assemble.form_feed_pages)

# -- pipeline -------------------------------------------------------------


def small_registry() -> registry.Registry:
    """Two extractors, two cleaners, three converters: combinations that SQL can check."""
    r = registry.Registry()
    r.add_extractor("plain", registry.identity, ".txt").add_extractor("headed", assemble.plain_headings, ".txt")
    r.add_cleaner("Quotes", clean.straighten_quotes).add_cleaner("HTML Cleaner", clean.html_clean)
    return r.add_converter("html2text", convert.paragraph_markdown).add_converter("Pandoc", convert.basic_markdown).add_converter("PassThrough", convert.pass_through)


@query
def pipeline_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Combinations, mean lengths and element counts of the full cross product."""
    texts = pipeline.converted(documents(spark, d), registry.default_registry())
    done = pipeline.by_path(texts.select("paths", "output_length", F.col("markdown_elements")["headers"].alias("headers")))
    return done.groupBy("extractor", "cleaner", "converter", "status").agg(F.count("*").alias("n"), F.sum("output_length").alias("output_length"), F.sum("headers").alias("headers"))


@query
def best_combinations(spark: SparkSession, d: str) -> DataFrame:
    quality = pipeline.process(documents(spark, d), small_registry()).withColumn("overall_score", _r("overall_score"))
    return pipeline.best(quality, "doc_id").withColumn("best_score", _r("best_score"))


@query
def best_default_combinations(spark: SparkSession, d: str) -> DataFrame:
    """The best of all combinations of the default registry."""
    quality = pipeline.process(documents(spark, d), registry.default_registry()).withColumn("overall_score", _r("overall_score"))
    return pipeline.best(quality, "doc_id").withColumn("best_score", _r("best_score"))


@query
def extractor_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations from scores and given times: a time is a column, never a clock."""
    docs = documents(spark, d)
    quality = pipeline.process(docs, small_registry()).withColumn("overall_score", _r("overall_score"))
    # times need no scores: each extractor's documents are enough
    times = pipeline.completed(pipeline.extract(docs, small_registry())).select("doc_id", "extractor").distinct().withColumn("total_time", F.when(F.col("extractor") == "plain", F.col("doc_id") % 12).otherwise(F.col("doc_id") % 7).cast("double"))
    advised = pipeline.recommendations(pipeline.comparison(quality, times))
    return advised.withColumn("recommendations", F.array_join("recommendations", ","))


@query
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that could not be looked at (every 17th, here) fail; those of an unknown suffix succeed without scores."""
    docs = documents(spark, d).withColumn("file_error", F.when(F.col("doc_id") % 17 == 0, F.lit("no such file")))
    suffix = F.when(F.col("doc_id") % 5 == 0, F.lit(".bin")).otherwise(F.lit(".txt"))
    quality = pipeline.process(docs.filter("file_error is null").drop("file_error"), small_registry(), suffix, converter="PassThrough")
    return pipeline.batch_summary(docs, quality)


@query
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Stages completed and errors of each document: an extractor without its reader fails, an unknown suffix has none."""
    docs = documents(spark, d)
    r = small_registry().add_extractor("absent", None, ".txt")
    suffix = F.when(F.col("doc_id") % 5 == 0, F.lit(".bin")).otherwise(F.lit(".txt"))
    extractions = pipeline.extract(docs, r, suffix)
    cleanings = pipeline.clean(extractions, r, ["Quotes"])
    conversions = pipeline.to_markdown(cleanings, r, "PassThrough")
    found = pipeline.run_summary(docs, extractions, cleanings, conversions, conversions.select("doc_id"))
    return found.select("doc_id", F.array_join("stages_completed", ",").alias("stages_completed"), F.array_join("errors", ",").alias("errors"))


@query
def unrouted_documents(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 5 == 0, F.lit(".bin")).otherwise(F.lit(".TXT"))
    return pipeline.unrouted(documents(spark, d), small_registry(), suffix)


@query
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    return report.quality_json(pipeline.process(documents(spark, d), small_registry()))


@query
def processor_list(spark: SparkSession, d: str) -> DataFrame:
    return config.processors(spark, registry.default_registry())


@query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return _digest(documents(spark, d), "doc_id", pipeline.preview(F.col("text"), 1000))


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("/ ", "lang", "source", "text")
    return documents(spark, d).select("doc_id", report.sanitise(name).alias("sanitised"), report.safe_file(name).alias("safe"), report.stage_file(F.lit(2), F.col("lang"), F.array("source", F.lit("a b")), F.lit(".md"), F.col("doc_id") % 2 == 0).alias("stage_file"))


# -- nested literals ------------------------------------------------------

_CELLS = "array(array('a', null, 'c'), array('1', '2'), array('x\\ny'))"


@query
def table_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"select {_CELLS} as t")
    return rows.select(assemble.pdf_table(F.col("t")).alias("pdf"), assemble.frame_table(F.col("t")).alias("frame"), assemble.docx_table(F.col("t")).alias("docx"), convert.table_block(F.array(F.lit("a|b|c"), F.lit("|---|---|"), F.lit("1|2"))).alias("block"))


@query
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(
        "select array('one', ' ', 'three') as p, array(named_struct('text', 'body', 'tables', array(array(array('h', 'k'), array('1', null)))), named_struct('text', ' ', 'tables', array())) as t,"
        " array(named_struct('accuracy', 99.126D, 'whitespace', 1.5D, 'rows', array(array(' v ', null)))) as r"
    )
    return rows.select(assemble.plain_pages(F.col("p")).alias("plain"), assemble.ruled_pages(F.col("p")).alias("ruled"), assemble.pages_with_tables(F.col("t")).alias("with_tables"), assemble.table_report(F.col("r")).alias("report"))


@query
def span_assembly(spark: SparkSession, d: str) -> DataFrame:
    spans = ", ".join(f"named_struct('text', '{t}', 'size', {s}D, 'flags', {f})" for t, s, f in (("A", 16.1, 0), ("b", 14.1, 16), ("c", 12.1, 2), ("d", 12, 18), (" ", 20, 18)))
    rows = spark.sql(f"select array(named_struct('lines', array(named_struct('spans', array({spans})), named_struct('spans', array(named_struct('text', 'e', 'size', 12D, 'flags', 0)))))) as b")
    return rows.select(assemble.text_blocks(F.col("b")).alias("styled"), assemble.text_blocks(F.col("b"), fonts=False).alias("plain"))


@query
def word_assembly(spark: SparkSession, d: str) -> DataFrame:
    run = "array(named_struct('text', 'r', 'bold', true, 'italic', true, 'underline', false), named_struct('text', 'u', 'bold', false, 'italic', true, 'underline', true))"
    none = "cast(array() as array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>)"
    rows = spark.sql(
        f"select array(named_struct('text', ' Head ', 'style', 'Heading 2', 'runs', {run}), named_struct('text', 'ru', 'style', 'Normal', 'runs', {run}), named_struct('text', 'T', 'style', 'Title', 'runs', {none}), named_struct('text', ' ', 'style', 'Normal', 'runs', {none})) as p, array({_CELLS}) as t"
    )
    return rows.select(assemble.docx_document(F.col("p"), F.col("t")).alias("document"), assemble.docx2txt_document(F.lit("TOP\n\n\nshort\nends with stop.")).alias("docx2txt"), assemble.docx2txt_document(F.lit(" ")).alias("empty"))


@query
def element_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"named_struct('type', '{t}', 'text', {x}, 'metadata', cast(map() as map<string,string>), 'category_depth', {k}, 'text_as_html', cast(null as string))" for t, x, k in (("Title", "' T '", "9"), ("Title", "'U'", "cast(null as int)"), ("ListItem", "'l'", "0"), ("Table", "'a b'", "0"), ("Footer", "'f'", "0"), ("NarrativeText", "' '", "0"), ("NarrativeText", "'n  n'", "0")))
    df = spark.sql(f"select 1L as doc_id, array({rows}) as elements, 'whole  text' as text")
    cleaned = editor.clean_elements(F.col("elements"), F.col("text"), ("clean_extra_whitespace", "unknown"))
    whole = editor.clean_elements(F.lit(None).cast(assemble.ELEMENTS), F.col("text"))
    return df.select(assemble.elements_markdown(assemble.drop_elements(F.col("elements"))).alias("markdown"), assemble.cleaned_elements_markdown(cleaned).alias("cleaned"), assemble.cleaned_elements_markdown(whole).alias("whole"))


@query
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select * from values ('ru+en'), ('rus;eng|en'), ('en-US'), (' , '), ('DE,xx') as t(code)").select("code", assemble.normalise_languages(F.col("code")).alias("codes"))


@query
def quirk_literals(spark: SparkSession, d: str) -> DataFrame:
    """Cleaner steps on texts that the tables don't hold."""
    rows = spark.createDataFrame(
        [(1, "exam-\nple Foo-\nBar ab-\nCd"), (2, "one\ntwo\nthree"), (3, "A\nx\nA\ny\nA"), (4, 'a "b" "c'), (5, "•a\n2) b\n3.14\n**bold**\n---\n  plain"), (6, "modern class 0x l 1a рас"), (7, "a|b\n-----\nc....d . e €"), (8, "1O2 OS l п р и"), (9, "cafÃ© itâ€™s waitâ€¦ x�y"), (10, "<p>a &amp;lt; b</p><script>t(1)</script>")], "k int, t string"
    )
    steps = (clean.join_hyphenated, clean.merge_lines, clean.drop_running_heads, clean.straighten_quotes, clean.normalise_bullets, clean.fix_ocr_letters, clean.drop_scan_artifacts, lambda t: clean.fix_numbers(clean.join_spaced_letters(t)), clean.fix_encoding, clean.strip_html)
    out = F.lit(None).cast("string")
    for k, step in enumerate(steps, 1):
        out = F.when(F.col("k") == k, step(F.col("t"))).otherwise(out)
    return rows.select("k", out.alias("cleaned"))
