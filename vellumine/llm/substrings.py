"""Removal of word windows that another document, with a smaller doc_id, holds too.

Pass 1 sketches: each window is represented by its minimizer, the least hash among its 17-word
grams; equal windows have equal minimizers, so a minimizer's count in documents is never below a
window's. Partitions count minimizers into the cells of a count-min sketch (two rows of 2**36 cells,
kept sparse), partial sketches merge by summing cells, and a cell below 2 proves its windows unique.
The cells of 2 and more, folded into a bitmap of bounded size, go to every executor.

Pass 2 emits only windows whose minimizer is estimated repeated in both rows and groups them exactly
by a 96-bit hash of their words: smallest and largest doc_id per window, then a join back to the
occurrences. The sketch only overestimates, so no repeated window is lost; if it saturates, more
windows are grouped, with the same result.

Words are runs outside ``[\\x20\\x09-\\x0D]``. Edge cases: null and short texts lose nothing; a window
repeated within one document, or in rows of equal doc_id, is no repeat; a null doc_id neither
removes nor loses words; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import textarrays as X
from vellumine.llm.bitmaps import gathered, has
from vellumine.llm.scratch import in_batches, staged

WINDOW, GRAM = 50, 17
ROWS, CELL_BITS = 2, 36
#: Bits of a row's bitmap: 16 for each repeated cell, up to this power of two (32 MB a row).
MAX_BITS = 28
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Minimizers gathered before a partial sketch is emitted.
_FLUSH = 1 << 21


def _cells(minimizers: np.ndarray, row: int) -> np.ndarray:
    return (minimizers * _ODD[row]) >> np.uint64(64 - CELL_BITS)


def _windows(text: pa.Array, window: int, gram: int) -> Iterator[tuple]:
    """(first row, word hashes, row of each window, its word offset in the row, minimizers, valid)."""
    for a, _, data, off in X.chunks(text):
        word, _, first = X.words(data, off)
        valid = X.within(first, window, len(word))
        if valid.any():
            row = X.row_of(first)[: len(valid)]
            yield a, word, row, np.arange(len(valid)) - first[row], X.sliding_min(X.sequence_hashes(word, gram), window - gram + 1), valid


def repeated_cells(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, cell) of the merged sketch that count two documents or more."""

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(parts)
        for row in range(ROWS):
            cell, n = np.unique(_cells(found, row), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), row, np.int32)), pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int32))], ["row", "cell", "n"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for _, _, row, _, least, valid in _windows(batch.column("text"), window, gram):
                head = valid.copy()
                head[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                parts.append(least[head])
                n += len(parts[-1])
                if n >= _FLUSH:
                    yield from emit(parts)
                    parts, n = [], 0
        if parts:
            yield from emit(parts)

    partial = in_batches(docs.select("text")).mapInArrow(sketch, "row int, cell long, n int")
    return partial.groupBy("row", "cell").agg(F.sum("n").alias("n")).filter("n >= 2").select("row", "cell")


def _bitmaps(cells: DataFrame) -> list[np.ndarray]:
    """A bitmap for each row of the sketch, its cells folded into at most 2**MAX_BITS bits."""
    cells = staged(cells, "sketch")
    bits = max(16, min(MAX_BITS, (16 * max(1, cells.count())).bit_length()))
    return gathered(cells.select("row", F.col("cell").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit")), ROWS, bits)


def candidate_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, doc_id, place) of windows estimated repeated; place is the row's tag and the start."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmaps(repeated_cells(docs, window, gram)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = held.value
        mask = np.uint64(8 * len(maps[0]) - 1)
        for batch in batches:
            tags = batch.column("tag").to_numpy()
            for a, word, row, start, least, keep in _windows(batch.column("text"), window, gram):
                for k, bitmap in enumerate(maps):
                    at = np.flatnonzero(keep)
                    keep[at] = has(bitmap, _cells(least[at], k) & mask)
                at = np.flatnonzero(keep)
                if len(at):
                    first, second = (X.sequence_hashes(word, window, k)[at] for k in (0, 1))
                    place = (tags[a + row[at]].astype(np.int64) << 32) | start[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column("doc_id").take(pa.array(a + row[at])), pa.array(place)],
                        ["w1", "w2", "doc_id", "place"],
                    )

    tagged = docs.filter("doc_id is not null").select("doc_id", "text", _tag().alias("tag"))
    return in_batches(tagged).mapInArrow(emit, f"w1 long, w2 int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long")


def _tag():
    """Tells rows of equal doc_id and different text apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) for each row."""
    docs = docs.select("doc_id", "text")
    found = candidate_windows(docs, window, gram)
    repeated = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w1", "w2", "least")
    later = found.join(repeated.hint("shuffle_hash"), ["w1", "w2"]).filter(F.col("doc_id") > F.col("least"))
    starts = later.groupBy(F.col("doc_id").alias("d"), F.shiftright("place", 32).cast("int").alias("t")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts"))
    joined = docs.join(starts, (docs["doc_id"] == starts["d"]) & (_tag() == starts["t"]), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            starts = batch.column("starts")
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = (text or b"").split()
                words.append(len(own))
                gone = 0
                if starts[k].is_valid:
                    edge = np.zeros(len(own) + 1, np.int32)
                    at = starts[k].values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone = int(cover.sum())
                    own = [w for w, c in zip(own, cover.tolist(), strict=True) if not c]
                removed.append(gone)
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return in_batches(joined).mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
