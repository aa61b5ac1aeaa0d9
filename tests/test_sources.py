"""Readers, sinks, settings and the model client, on literal files and stand-in libraries."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from vellumine.operators import editor, model
from vellumine.plans import config, pipeline, registry, report
from vellumine.sources import files, readers, sinks


def rows_of(spark, *named):
    return spark.createDataFrame([(f"/in/{n}", files_suffix(n), raw) for n, raw in named], "path string, file_type string, content binary")


def files_suffix(name):
    return "." + name.rsplit(".", 1)[1]


PAGES = readers.Reader("paged", (".pdf",), lambda raw, o: raw.decode().split("|"), "array<string>", readers.assemble.plain_pages)
RAISES = readers.Reader("broken", (".pdf",), lambda raw, o: 1 / 0)


def test_files_meet_all_readers_of_their_suffix(spark):
    r = registry.Registry().add_extractor("paged", None, ".pdf").add_extractor("broken", None, ".pdf").add_extractor("plain", registry.identity, ".txt").add_extractor("missing", None, ".txt")
    found = readers.extract_files(rows_of(spark, ("a.pdf", b"one| |three"), ("b.txt", b"t\xff"), ("c.bin", b"")), r, (PAGES, RAISES))
    got = {(x.path, x.extractor): x for x in found.collect()}
    assert set(got) == {("/in/a.pdf", "paged"), ("/in/a.pdf", "broken"), ("/in/b.txt", "plain"), ("/in/b.txt", "missing")}
    assert got["/in/a.pdf", "paged"].content == "# Страница 1\n\none\n\n# Страница 3\n\nthree"
    assert (got["/in/a.pdf", "broken"].status, got["/in/a.pdf", "broken"].error_message[:17]) == ("failed", "ZeroDivisionError")
    assert got["/in/b.txt", "plain"].content == "t\ufffd" and got["/in/b.txt", "missing"].status == "failed"
    assert pipeline.clean(found, registry.default_registry(), ["Basic Cleaner"]).count() == 2  # the stages after go on from it


def test_absent_libraries_are_failed_rows(spark):
    named = [(f"x{s}", b"%PDF") for s in (".pdf", ".docx", ".doc", ".rtf", ".zip", ".xlsx")]
    found = readers.extract_files(rows_of(spark, *named, ("y.csv", b"a,b")), registry.default_registry()).collect()
    by = {(x.path, x.extractor): x for x in found}
    assert {x.extractor for x in found} >= {"pypdf", "pdfplumber", "pymupdf", "pdfminer", "camelot", "python-docx", "docx2txt", "doc-chain", "word-com", "markitdown", "elements"}
    assert all(by[k].status == "failed" and by[k].error_message for k in by if k[0] != "/in/y.csv")
    assert by["/in/y.csv", "markitdown"].content == "a,b"
    assert by["/in/x.rtf", "word-com"].error_message.startswith("OSError")


def test_structures_are_assembled(spark):
    table = [["h", "k"], ["1", None]]
    span = {"text": "Big", "size": 20.0, "flags": 0}
    stand_in = {
        "pdfplumber": [{"text": "body", "tables": [table]}, {"text": " ", "tables": []}],
        "pymupdf": [[{"lines": [{"spans": [span]}]}]],
        "camelot": [{"accuracy": 99.0, "whitespace": 1.0, "rows": [["a", "b"]]}],
        "python-docx": {"paragraphs": [{"text": "Head", "style": "Heading 1", "runs": []}], "tables": [table]},
        "elements": [{"type": "Title", "text": "T", "metadata": {}, "category_depth": 0, "text_as_html": None}, {"type": "Footer", "text": "f", "metadata": {}, "category_depth": None, "text_as_html": None}],
        "pdfminer": "SOME text",
        "docx2txt": " ",
    }
    fakes = tuple(readers.Reader(r.name, r.suffixes, lambda raw, o, out=stand_in[r.name]: out, r.shape, r.text) for r in readers.READERS if r.name in stand_in)
    r = registry.Registry()
    for f in fakes:
        r.add_extractor(f.name, None, ".pdf")
    got = {x.extractor: x for x in readers.extract_files(rows_of(spark, ("a.pdf", b"")), r, fakes).collect()}
    assert all(x.status == "completed" for x in got.values())
    assert got["pdfplumber"].content.startswith("# Страница 1") and "| h | k |" in got["pdfplumber"].content
    assert "Big" in got["pymupdf"].content and "a" in got["camelot"].content
    assert "# Head" in got["python-docx"].content and "h" in got["python-docx"].content
    assert "T" in got["elements"].content and "f" not in got["elements"].content.replace("# T", "")
    assert got["docx2txt"].content == readers.assemble.NO_TEXT


def test_the_first_attempt_with_text_wins():
    def fails(path):
        raise OSError("no such command")

    attempts = [("one", fails), ("two", lambda path: "  "), ("three", lambda path: "text"), ("four", fails)]
    assert readers.doc_text(b"", {"attempts": attempts}) == "text"
    with pytest.raises(ValueError, match="one: OSError; two: no text"):
        readers.doc_text(b"", {"attempts": attempts[:2]})


def test_partition_dispatch():
    assert readers.partition_options({"strategy": None, "chunking_strategy": "x"}, {"languages": ["rus"]}) == {"include_page_breaks": False, "chunking_strategy": "x", "infer_table_structure": True, "languages": ["rus"]}
    seen = []

    def picky(filename, strategy):
        seen.append((filename, strategy))
        return ["done"]

    find = {"docx": picky}.get
    assert readers.dispatch("doc", find, "p", {"strategy": "s", "languages": ["rus"]}) == ["done"]  # the successor's, without languages
    assert seen == [("p", "s")]
    with pytest.raises(TypeError):
        readers.dispatch("docx", find, "p", {"other": 1})
    with pytest.raises(ImportError):
        readers.dispatch("ppt", find, "p", {})


def test_runs_are_numbered_and_cleaned(spark, tmp_path):
    top = f"file://{tmp_path}/runs"
    assert sinks.storage_info(spark, top)["total_files"] == 0
    assert [sinks.next_run(spark, top) for _ in range(3)] == [1, 2, 3]
    docs = spark.createDataFrame([(1, "a b", "completed", "e"), (2, "", "failed", "e")], "doc_id long, content string, status string, extractor string")
    path = sinks.write_stage(docs, top, 2, 1, ["extractor"], llm=True)
    assert [(r.doc_id, r.file_name) for r in spark.read.parquet(path).collect()] == [(1, "1_extraction_e_LLM-ON.md")]
    assert sinks.storage_info(spark, top)["total_files"] >= 4
    assert sinks.cleanup(spark, top, 7) == 0 and sinks.cleanup(spark, top, 0, now=4e9) == 3
    assert sinks.next_run(spark, top) == 1


def test_settings_roll_back():
    s = config.Settings()
    assert config.problems(s.values) == []
    bad = json.loads(s.dump()) | {"performance": {"max_workers": 0, "timeout_seconds": 1, "max_file_size_mb": 1}, "quality_metrics": {}}
    with pytest.raises(ValueError, match="max_workers.*weights"):
        s.load(json.dumps(bad))
    assert s.values == config.DEFAULTS
    good = json.loads(s.dump())
    good["quality_metrics"]["structure_weight"] = 0.9
    assert {m.name: m.weight for m in s.load(json.dumps(good)).metrics()}["structure"] == 0.9
    assert s.recommended(".PDF")["extractor"] == "PDFPlumber" and s.recommended("xyz") == {}
    assert config.problems({}) and "section system is missing" in config.problems({})


def test_processors_name_what_has_no_code(spark):
    found = config.processors(spark, registry.default_registry())
    assert {r.name for r in found.filter("not implemented and not enabled").collect()} == {"python-pptx", "openpyxl", "pandas_excel", "xlrd", "tesseract", "easyocr"}


def test_model_client():
    sent = []

    def post(url, headers, body, timeout):
        sent.append((url, body))
        return {"choices": [{"message": {"content": " ok "}}]}

    call = model.caller(model.ModelSettings("m", "k", "http://host/v1/", temperature=7, max_output_tokens=5), post)
    assert call("p") == "ok" and sent[0][0] == "http://host/v1/chat/completions"
    assert sent[0][1]["temperature"] == 1.0 and sent[0][1]["max_tokens"] == 5
    assert model.endpoint("http://h/chat/completions") == "http://h/chat/completions"

    def down(*_):
        raise urllib.error.URLError("down")

    with pytest.raises(RuntimeError):
        model.caller(model.ModelSettings("m", "k"), down)("p")
    with pytest.raises(ValueError):
        model.caller(model.ModelSettings("m", "k", provider="other"))


def test_models_by_keyword_or_by_prompt():
    assert editor.answer(lambda prompt, text, kind: text + kind, "p", text="a", kind="b") == "ab"
    assert editor.answer(lambda p: {"content": p}, "p", text="a", kind="b") == "p"
    assert editor.answer(lambda p: 1 / 0, "p") is None


@pytest.mark.parametrize("done, most, want", [([], 5, ""), (["abc", "de"], 5, "abc\n\nde"), (["abc", "de"], 4, "de"), (["abcdef"], 5, ""), (["a", "", None, "b"], 2, "a\n\nb"), (["x", "yyyy", "z"], 3, "z")])
def test_context_is_the_latest_that_fits(done, most, want):
    assert editor.context(done, most) == want


def test_comparison_page():
    row = {"extractor": "e<", "best_combination": "c", "best_score": 0.85, "total_time": 1.0, "grade": "A", "metric_scores": {"structure": 0.5}}
    page = report.comparison_html([row, row | {"best_score": 0.0, "metric_scores": None}], "T", ["e: balanced"])
    assert "e&lt;" in page and "<th>structure</th>" in page and "<td>0.500</td>" in page and "<li>e: balanced</li>" in page
    assert "score-excellent" in page and "score-poor" in page
    assert "<ul>" not in report.comparison_html([], "T")


def test_run_summary_keeps_what_was_done(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    r = registry.default_registry()
    extractions = pipeline.extract(docs.filter("doc_id < 3"), r)
    found = {x.doc_id: x for x in pipeline.run_summary(docs, extractions, pipeline.clean(extractions, r), pipeline.to_markdown(pipeline.clean(extractions, r), r), extractions.filter("false").select("doc_id")).collect()}
    assert found[1].stages_completed == ["extraction", "cleaning", "conversion"]
    assert found[2].stages_completed == [] and any(pipeline.NO_TEXT in e for e in found[2].errors)
    assert found[3].errors == [pipeline.NO_EXTRACTION]


def test_shared_texts_score_as_each_combination_does(spark):
    """Against the stages one by one, where every combination is cleaned, converted and scored by itself."""
    texts = ["# Head\n\nSome “quoted” text, and more of it.\n- item\n- item", "PLAIN LINE\n\nbody text here; it goes on.", "<p>tags</p> a|b\n1|2", "", None, "x" * 300, "one two\nthree four-\nfive"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = registry.default_registry()
    slow = pipeline.evaluate(pipeline.to_markdown(pipeline.clean(pipeline.extract(docs, r), r), r))
    columns = ["doc_id", "pipeline_name", "ext_ord", "cln_ord", "cnv_ord", "content", "input_length", "output_length", "overall_score", "grade", "status"]
    rows = lambda df: sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)
    assert rows(pipeline.process(docs, r)) == rows(slow)
    named = pipeline.best(slow, "doc_id")
    assert sorted(map(tuple, pipeline.best(pipeline.process(docs, r), "doc_id").collect())) == sorted(map(tuple, named.collect()))


def test_scanned_files_have_metadata(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.pdf").write_bytes(b"%PDF1")
    (tmp_path / "c.other").write_bytes(b"t\xff")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["b.pdf"].file_size == 5 and got["b.pdf"].mime_type == "application/pdf" and "c.other" not in got
    assert files.texts(files.scan(spark, str(tmp_path), ("*.other",))).select(F.length("text")).first()[0] == 2
