"""Benchmark decontamination through a distributed positional inverted index.

The index holds a posting (doc, position, term) for every training token that is a benchmark term;
all training documents are indexed, terms that no item has can never match. Lookups start at the
rarest terms: each item window contributes its rarest positions (by corpus counts), postings of
those terms are offset-adjusted to diagonals ``position in document - position in item``, and only
diagonals on which a window's rarest terms agree go on. There the remaining postings are
intersected, runs of consecutive agreement give exact phrase matches, and a document's hits are
the union of its runs. Proximity matches order a phrase's terms within a slop instead.

Everything is DataFrame expressions. The benchmark side is broadcast only below ``BROADCAST_BYTES``;
beyond it the same joins shuffle, where adaptive execution splits a hot term's postings.

Edge cases: null and empty texts have no words, cannot be hit and yield no windows; items with the
same words share one lookup and are all reported; rows with equal doc_id and text get equal
results; an empty benchmark contaminates nothing; further columns on either side are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.scratch import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions of a window that a candidate diagonal must agree on first.
RAREST = 2
#: A benchmark-sided table above this many estimated bytes is joined by shuffling.
BROADCAST_BYTES = 64 << 20
_KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; the pattern leaves an empty first or last piece at most."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def item_words(benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """(sequence, ipos, term, need) for each distinct word sequence, and (sequence, item_id)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("sequence", F.sha2(F.concat_ws(" ", "words"), 256))
    distinct = items.groupBy("sequence").agg(F.first("words").alias("words"))
    exploded = distinct.select("sequence", F.least(F.lit(window), F.size("words")).alias("need"), F.size("words").alias("length"), F.posexplode("words").alias("ipos", "term"))
    return exploded, items.select("sequence", "item_id").distinct()


def vocabulary(items: DataFrame) -> DataFrame:
    """(term, term_id) of the benchmark; ids are dense in order of the terms."""
    distinct = items.select("term").distinct()
    return distinct.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: (doc_id, text_hash, position, term_id), staged.

    Each document has one more row with term_id -1, whose position is its word count.
    """
    spark = docs.sparkSession
    end = spark.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("term_id"))
    known = _small(terms.select("term", "term_id").union(end), n_terms, 64)
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit("")))).alias("position", "term"))
    return staged(tokens.join(known, "term").select(*_KEY, "position", "term_id"), "postings")


def phrase_hits(index: DataFrame, items: DataFrame, n_positions: int) -> DataFrame:
    """(doc_id, text_hash, sequence, first, last): document positions of runs that contain a phrase.

    ``items``: (sequence, ipos, term_id, need, length); a phrase is ``need`` consecutive words.
    """
    tokens = index.filter("term_id >= 0")
    counts = tokens.groupBy("term_id").agg(F.count("*").alias("n"))
    ranked = items.join(counts, "term_id").select("sequence", "ipos", "term_id", "need", "length", "n")
    # each word with the windows that it is in: ``need`` of them at most, however long the item
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("need") + 1), F.least(F.col("ipos"), F.col("length") - F.col("need")))
    window = Window.partitionBy("sequence", "start")
    inside = (
        ranked.withColumn("start", F.explode(starts))
        .withColumn("rank", F.row_number().over(window.orderBy("n", "ipos")))
        .withColumn("found", F.count("*").over(window))  # a window that has a term without postings can't occur
    )
    anchors = inside.filter(F.col("found") == F.col("need")).filter(F.col("rank") <= RAREST).select("sequence", "ipos", "term_id", F.least("need", F.lit(RAREST)).alias("agree")).distinct()
    anchors = staged(anchors, "anchors")
    diagonals = (
        tokens.join(_small(anchors, n_positions, 96), "term_id")
        .groupBy(*_KEY, "sequence", (F.col("position") - F.col("ipos")).alias("diagonal"), "agree")
        .agg(F.count_distinct("ipos").alias("agreed"))
        .filter(F.col("agreed") >= F.col("agree"))
        .select(*_KEY, "sequence", "diagonal")
    )
    diagonals = staged(diagonals, "diagonals")
    places = diagonals.select(*_KEY).distinct()
    rows = diagonals.count()
    near = tokens.join(_small(places, rows, 48), _eq(tokens, places), "left_semi")
    here = near.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "position", "term_id")
    on = here["d"].eqNullSafe(diagonals["doc_id"]) & (here["h"] == diagonals["text_hash"])
    aligned = here.join(diagonals, on).select(*_KEY, "sequence", "diagonal", "position", "term_id", (F.col("position") - F.col("diagonal")).alias("ipos"))
    sides = items.select("sequence", "ipos", "term_id", "need")
    agreeing = aligned.join(_small(sides, n_positions, 96), ["sequence", "ipos", "term_id"]).select(*_KEY, "sequence", "need", "diagonal", "position").distinct()
    run = Window.partitionBy(*_KEY, "sequence", "diagonal").orderBy("position")
    return (
        agreeing.withColumn("run", F.col("position") - F.row_number().over(run))
        .groupBy(*_KEY, "sequence", "need", "diagonal", "run")
        .agg(F.min("position").alias("first"), F.max("position").alias("last"))
        .filter(F.col("last") - F.col("first") + 1 >= F.col("need"))
        .select(*_KEY, "sequence", "first", "last")
    )


def _eq(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, item_ids, contaminated.

    Every word within an occurrence of an item window is hit. A document is contaminated if it has
    a hit and ``share * n_hit >= n_words``.
    """
    spelled, members = item_words(benchmark, window)
    spelled = staged(spelled, "item-words")
    n_positions = spelled.count()
    terms = vocabulary(spelled)
    index = postings(docs, terms, n_positions)
    items = staged(spelled.join(terms, "term").select("sequence", "ipos", "term_id", "need", "length"), "item-terms")
    hits = staged(phrase_hits(index, items, n_positions), "hits")
    covered = hits.select(*_KEY, F.explode(F.sequence("first", "last")).alias("position")).groupBy(*_KEY).agg(F.count_distinct("position").alias("n_hit"))
    named = hits.select(*_KEY, "sequence").distinct().join(_small(members, n_positions, 96), "sequence").groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = covered.join(named, _eq(covered, named)).select(covered["doc_id"].alias("d"), covered["text_hash"].alias("h"), "n_hit", "item_ids")
    every = index.filter("term_id = -1").select(*_KEY, F.col("position").cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return every.join(found, every["doc_id"].eqNullSafe(found["d"]) & (every["text_hash"] == found["h"]), "left").select(
        *_KEY,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, start): all terms of a phrase, in order, each at most ``slop`` words late.

    A match starts at an occurrence of the phrase's first term; every next term follows the one
    before by 1 to ``1 + slop`` words. Phrases of one word match each occurrence.
    """
    spelled, members = item_words(phrases, 1 << 30)
    spelled = staged(spelled, "phrase-words")
    n = spelled.count()
    terms = vocabulary(spelled)
    index = postings(docs, terms, n).filter("term_id >= 0")
    items = staged(spelled.join(terms, "term").select("sequence", "ipos", "term_id", "length"), "phrase-terms")
    longest = items.agg(F.max("length")).first()[0] or 0
    ends = index.join(_small(items.filter("ipos = 0"), n, 96), "term_id").select(*_KEY, "sequence", "length", F.col("position").alias("start"), F.col("position").alias("at"))
    done = ends.filter("length = 1")
    for k in range(1, longest):
        step = index.join(_small(items.filter(F.col("ipos") == k), n, 96), "term_id").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("sequence").alias("s"), "position")
        on = ends["doc_id"].eqNullSafe(step["d"]) & (ends["text_hash"] == step["h"]) & (ends["sequence"] == step["s"]) & (step["position"] > ends["at"]) & (step["position"] <= ends["at"] + 1 + slop)
        ends = staged(ends.join(step, on).select(*_KEY, "sequence", "length", "start", F.col("position").alias("at")).distinct(), f"proximity-{k}")
        done = done.unionByName(ends.filter(F.col("length") == k + 1))
    return done.join(members, "sequence").select("doc_id", "item_id", "start").distinct()
