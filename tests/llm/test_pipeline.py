"""The pipeline's stages against brute-force versions of each."""

import corpus_pipeline
from tests.llm.test_operators import brute_contamination, brute_groups, brute_lines, brute_rules, items_of, sha, terms


def brute_keep(rows):
    keep = []
    for i, n, chars, symbols, dup, again in brute_rules(rows):
        text = next(t for k, t in rows if k == i) or ""
        digits, lines = sum(c in "0123456789" for c in text), [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        bad = n < 50 or 2 * again > n or chars < 2 * n or chars > 20 * n or 4 * symbols > chars or 2 * digits > chars or 2 * dup > len(lines)
        if not bad:
            keep.append(i)
    return keep


def test_stages(spark, rows, tmp_path):
    texts = [(i, t) for k, (i, t) in enumerate(rows) if (i, t) not in rows[:k]]  # repeated rows share one fate
    items = [*items_of(rows), (30, " ".join(terms(rows[1][1])[:30]))]
    wide = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "f", [4]) for i, t in texts]
    extra = "n_lines int, n_dropped int, text_hash int, kept string, ids array<int>"  # names that stages use inside
    spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    have = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        before = list(have.items())
        if name == "quality_rules":
            have = {i: have[i] for i in brute_keep(before)}
        elif name == "line_dedup":
            have = {i: t for i, t, _, _ in brute_lines(before, 10)}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            have = {i: have[i] for i, _, _, kept in brute_groups(before, 5, 80) if kept}
        else:
            have = {r[0]: have[r[0]] for r in brute_contamination(before, items) if not r[-1]}
        assert got == have, name
        assert len(have) < len(before) or name == "line_dedup"
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: sha(t) for i, t in have.items()}


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_five_stages_of_the_ten_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "byte_bpe"]
