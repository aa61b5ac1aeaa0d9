"""Line folds against plain loops, on lines where every branch fires."""

import random

from pyspark.sql import functions as F

from vellumine.operators import clean, convert

LINES = ["abc", "Abc", "de.", "  fg h", "x", "", "été un", "a|b|c", "1|2", "|x|y|", "---|---", "a|b", "é|ü|ß", "no pipes here", "end:", " lower"]


def slow_merge(text):
    out, merged = [], True
    for line in (x.strip() for x in text.split("\n")):
        last = out[-1] if out else ""
        if not merged and last and last[-1] not in ".!?:" and line[:1].islower() and len(line) > 1 and not line[1].isspace():
            out[-1], merged = last + line, True
        else:
            out.append(line)
            merged = False
    return "\n".join(out)


def slow_runs(text):
    """Lines in runs: of pipe lines from one with two pipes on, else one by one."""
    runs, inside = [], False
    for line in text.split("\n"):
        n = line.count("|")
        if n and inside:
            runs[-1].append(line)
        else:
            runs.append([line])
            inside = n > 1
    return runs


def test_lines_merge_as_a_loop_merges_them(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [""]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", clean.merge_lines(F.col("t")).alias("m")).collect()
    assert [r.m for r in sorted(got)] == [slow_merge(t) for t in texts]


def test_tables_are_runs_of_pipe_lines(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", "|"]
    blocks = sorted({tuple(r) for t in texts for r in slow_runs(t) if len(r) > 1})
    made = spark.createDataFrame([(k, [x.strip() for x in b]) for k, b in enumerate(blocks)], "k int, b array<string>").select("k", convert.table_block(F.col("b")).alias("m")).collect()
    block = {blocks[r.k]: r.m for r in made}
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", convert.format_tables(F.col("t")).alias("m")).collect()
    assert [r.m for r in sorted(got)] == ["\n".join(block[tuple(r)] if len(r) > 1 else r[0] for r in slow_runs(t)) if "|" in t else t for t in texts]


def test_long_texts_fold_in_linear_time(spark):
    text = "a|b|c\n" * 20000 + "abc\ndef\n" * 20000
    row = spark.createDataFrame([(text,)], "t string").select(F.length(clean.merge_lines(F.col("t"))).alias("m"), F.length(convert.format_tables(F.col("t"))).alias("f")).first()
    assert row.m == len(slow_merge(text)) and row.f > len(text) - 1
