"""Registry, fan-out, ranking, reports, sources, streams and the DuckDB oracle."""

import os
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vellumine.functions import rx
from vellumine.functions.sqlfns import register_sql
from vellumine.operators import clean, convert, metrics
from vellumine.plans import pipeline, queries, registry, report
from vellumine.plans.queries import small_registry
from vellumine.sources import files
from vellumine.streaming import stream

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, 'Some "text" here.\nMore text, and more.'), (2, None), (3, "   "), (4, "TITLE\n\nBody of it.")], "doc_id long, text string")


def test_fan_out_counts(docs):
    r = small_registry()
    got = pipeline.process(docs, r)
    assert got.count() == 3 * 2 * 2 * 3
    failed = pipeline.extract(docs, r).filter("status = 'failed'")
    assert {(x.doc_id, x.error_message) for x in failed.collect()} == {(2, "No text provided")}
    assert pipeline.process(docs, r, extractor="headed", cleaners=["Quotes", "unknown"], converter="unknown").count() == 3 * 3
    assert pipeline.process(docs, r, converter="PassThrough").count() == 3 * 4
    with pytest.raises(ValueError):
        pipeline.extract(docs, r, extractor="unknown")


def counted(spark, step):
    """``step`` and an accumulator of how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def call(text):
        calls.add(1)
        return text

    return lambda t: call(step(t)), calls


def test_equal_extractions_are_worked_on_once(spark, docs):
    r = registry.Registry().add_extractor("plain", registry.identity, ".txt").add_extractor("same", registry.identity, ".txt").add_extractor("upper", F.upper, ".txt").add_extractor("absent", None, ".txt")
    step, calls = counted(spark, registry.identity)
    r.add_cleaner("None", step).add_converter("PassThrough", registry.identity)
    got = sorted((x.doc_id, x.extractor, x.ext_ord, x.content) for x in pipeline.by_path(pipeline.converted(docs, r)).collect())
    want = pipeline.to_markdown(pipeline.clean(pipeline.extract(docs, r), r), r)
    assert calls.value == 5  # of three texts; a blank one is the same in capitals
    assert got == sorted((x.doc_id, x.extractor, x.ext_ord, x.content) for x in want.collect()) and len(got) == 9


def test_fan_out_of_the_default_registry(spark, tmp_path):
    texts = ["Some \"text\" here-\n and more.\r\n\r\n* item", "TITLE\n\nBody\tof  it.", "", " ", "a\n\n\n\nb &amp; <b>c</b>", "line one\nline\nline\nline\ngoes on", "| a | b |\n| 1 | 2 |", "IBM and ÄIBM, NASA\x0bx", "# A\n\n1. b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = registry.default_registry()
    done = pipeline.to_markdown(pipeline.clean(pipeline.extract(spark.read.parquet(f"{tmp_path}/documents.parquet"), r), r), r)
    want = done.groupBy("extractor", "cleaner", "converter", "status").agg(F.count("*"), F.sum("output_length"), F.sum(F.col("markdown_elements")["headers"]))
    got = queries.pipeline_fan_out(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 45


def test_comparison_scores_once(spark, docs):
    r = small_registry()
    step, calls = counted(spark, registry.identity)
    r.cleaners = []
    r.add_cleaner("None", step)
    quality = pipeline.process(docs, r)
    got = sorted(map(tuple, pipeline.comparison(quality).select("doc_id", "extractor", "ext_ord", "best_combination", "best_score", "grade").collect()))
    assert calls.value == pipeline.completed(pipeline.extract(docs, r)).select("doc_id", "content").distinct().count()
    top = {(x.doc_id, x.extractor): x for x in pipeline.best(quality, "doc_id", "extractor").collect()}
    assert got == sorted((d, e, o, *((b.best_combination, b.best_score, b.grade) if (b := top.get((d, e))) else (None, 0.0, None))) for d, e, o in {(x.doc_id, x.extractor, x.ext_ord) for x in quality.collect()})


def test_texts_without_a_sign_are_not_matched(spark):
    t = F.lit("[" * 200_000)  # each bracket would be followed to the end
    began = time.monotonic()
    got = spark.range(1).select(metrics.syntax_score(t).alias("s"), convert.element_counts(t)["links"].alias("n")).first()
    assert tuple(got) == (0.8, 0) and time.monotonic() - began < 15


def test_cuts_at_line_ends_are_looked_for_first(spark):
    texts = ["foo-\nbar", "a-b", "to- \n Day", "x" * 30000, "-\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    assert [x.c for x in df.select(clean.join_hyphenated(t).alias("c")).collect()] == ["foobar", "a-b", "toDay", "x" * 30000, "-\n", None]


def test_unrouted_and_readers(docs):
    r = registry.default_registry()
    assert pipeline.extract(docs, r, ".bin").count() == 0
    assert pipeline.unrouted(docs, r, ".bin").count() == 4
    assert {x.status for x in pipeline.extract(docs, r, ".pdf").collect()} == {"failed"}
    assert r.extractors_for(".PDF")[0] == "pypdf"


def test_first_wins_ties_and_zero_has_no_best(spark):
    rows = [(1, "a", 0, "c", 0, "v", 0, 0.5), (1, "a", 0, "c", 0, "w", 1, 0.5), (1, "b", 1, "c", 0, "v", 0, 0.5), (2, "a", 0, "c", 0, "v", 0, 0.0)]
    q = spark.createDataFrame(rows, "doc_id long, extractor string, ext_ord int, cleaner string, cln_ord int, converter string, cnv_ord int, overall_score double")
    q = q.withColumn("pipeline_name", F.concat_ws("→", "extractor", "cleaner", "converter"))
    assert [(r.doc_id, r.best_combination) for r in pipeline.best(q, "doc_id").collect()] == [(1, "a→c→v")]
    times = spark.createDataFrame([(1, "a", 12.0), (1, "b", 3.0)], "doc_id long, extractor string, total_time double")
    advised = {r.doc_id: r for r in pipeline.recommendations(pipeline.comparison(q, times)).collect()}
    assert (advised[1].fastest, advised[1].best_quality, advised[1].recommendations) == ("b", "a", ["b:fast"])


def test_names_and_headers(spark):
    df = spark.createDataFrame([(" a/b\\c é Ё «x»  y ",), ("",)], "n string")
    assert [r[0] for r in df.select(report.sanitise(F.col("n"))).collect()] == ["a-b-c_x_y", "unknown"]
    stages = F.array(F.struct(F.lit("cleaning").alias("stage"), F.lit("P").alias("processor"), F.lit(0.12345).alias("seconds"), F.lit(None).cast("string").alias("config")))
    text = spark.range(1).select(report.provenance(F.lit("now"), F.lit("f.txt"), stages)).first()[0]
    assert "  - [1] Cleaning → P\n      Время выполнения: 0.123 сек" in text and text.endswith("\n---\n\n")


def test_file_names_take_the_whole_text(spark, tmp_path):
    text = "one two/three: four\t" + "five\\six? " * 30 + "end"
    spark.createDataFrame([(1, "en", "web", text), (2, None, "web", None)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.file_names(spark, str(tmp_path)).collect()}
    assert got[1].sanitised == "en-_web-_one_two-three_four_" + "five-six_" * 30 + "end"
    assert got[1].safe == "en__web__one_two_three__four_" + "five_six__five_six__f"
    assert got[2].sanitised == "web"


def test_reports(docs):
    quality = pipeline.process(docs, small_registry())
    rows = [r.asDict() for r in pipeline.comparison(quality).filter("doc_id = 1").orderBy("ext_ord").collect()]
    page = report.comparison_html(rows)
    assert "<table>" in page and rows[0]["extractor"] in page
    assert report.comparison_json(rows).startswith("[")
    assert report.quality_json(quality).filter("report like '%total_combinations\":12%'").count() == 3


def test_own_metric_joins_the_mean(docs):
    own = (*metrics.METRICS, metrics.Metric("one", 1.0, lambda t, w: F.lit(1.0)))
    plain = {r.doc_id: r.overall_score for r in metrics.score_texts(docs).collect()}
    got = {r.doc_id: r.overall_score for r in metrics.score_texts(docs, metrics=own).collect()}
    assert abs(got[1] - (plain[1] + 1) / 2) < 1e-9


def test_sql_functions(spark):
    register_sql(spark)
    assert spark.sql("select quality_grade(0.85), text_length_score(repeat('x', 150)), round(overall_quality(1, 1, 1, 1, 1), 6)").first()[0:3] == ("A (Очень хорошо)", 0.5, 1.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.TXT").write_text("x")
    (tmp_path / "c.bin").write_bytes(b"\xff")
    found = files.scan(spark, str(tmp_path), ("*.txt", "a*", "*.bin"))
    assert sorted(r.path.rsplit("/")[-1] for r in found.collect()) == ["a.txt", "a.txt", "c.bin"]
    assert {r.mime_type for r in found.collect()} == {"text/plain", "application/octet-stream"}
    assert "hello" in {r.text for r in files.texts(found).collect()}
    read = files.read_with(found, lambda raw: raw.decode()).collect()
    assert sorted(r.status for r in read) == ["completed", "completed", "failed"]


def test_stream_scores_as_the_batch_does(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in")
    live = stream.scored_stream(stream.document_stream(spark, f"{tmp_path}/in", docs.schema))
    q = live.writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.doc_id, r.overall_score) for r in metrics.score_texts(docs).collect())
    assert sorted((r.doc_id, r.overall_score) for r in spark.table("scored").collect()) == want


def test_plans_stay_native_and_narrow(docs):
    plan = metrics.score_texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    best = pipeline.best(pipeline.process(docs, small_registry()), "doc_id")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in best and "ArrowEvalPython" not in best


def plain_basic(text):
    text = re.sub(r" +", " ", text)
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text)
    text = "\n".join(x.strip() for x in text.split("\n"))
    text = unicodedata.normalize("NFC", text)
    for old, new in clean.TYPOGRAPHY:
        text = text.replace(old, new)
    text = text.replace("�", "")
    for old, new in clean.GARBLED:
        text = text.replace(old, new)
    return "".join(c for c in text if ord(c) >= 32 or c in "\n\t").strip()


def test_random_texts_against_plain_python(spark):
    rng = random.Random(4)
    alphabet = "abAB éёЖ \n\n\t\r-.«»—…1²½  \x1ćǅß□"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = F.col("t")
    got = df.select("k", clean.basic_clean(t).alias("basic"), rx.strip(t).alias("strip"), rx.words(t).alias("words"), rx.is_upper(t).alias("upper"), rx.is_title(t).alias("title"), clean.drop_running_heads(t).alias("heads")).collect()
    for r in got:
        text = texts[r.k]
        assert r.basic == plain_basic(text), repr(text)
        assert r.strip == text.strip() and r.words == text.split(), repr(text)
        assert (r.upper, r.title) == (text.isupper(), text.istitle()), repr(text)
        lines = text.split("\n")
        n = [x.strip() for x in lines]
        kept = [x for x in lines if not x.strip() or n.count(x.strip()) <= 2]
        assert r.heads == (text if len(lines) < 5 else "\n".join(kept))


@needs_data
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 200 and rows[0].overall_score >= rows[-1].overall_score


@needs_data
@pytest.mark.parametrize("name", ["quality_scores", "clean_basic", "convert_heading_lines", "convert_paragraphs", "markdown_elements", "plain_headings", "batch_counts", "quality_by_language"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    have = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(have.columns)
    assert columns == sorted(want.columns)
    tidy = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in columns)]) for r in rows)
    assert tidy([tuple(r) for r in have.collect()], have.columns) == tidy(want.fetchall(), want.columns)
