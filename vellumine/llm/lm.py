"""Language-model scores from a sharded log-frequency Bloom filter of quantised n-gram counts.

Every word and every pair of adjacent tokens of the training documents counts, however rare, at any
corpus size. The filter of all of them grows with the corpus, so no worker could hold it whole. It is
cut into shards by key, and each shard goes to one task together with everything that is asked of it:

1. Documents are taken in batches of about ``BATCH_TOKENS`` tokens. A batch sends each shard the distinct
   keys that it has there, with their training counts in the batch: a pair that a third of all texts
   hold is one key a batch, so no shard is hot.
2. A shard's task adds the counts up, exactly, and builds its filter: a count in the j-th power step
   of ``STEP`` sets the bits of levels 1 to j. Then it probes level after level for each key it was
   sent until one is missing. The last level found stands for its step's geometric middle.
3. Levels, and exact counts of words, go back to the batches, where probabilities interpolate the pair
   estimate with the smoothed word estimate. The base score takes the exact counts.

Nothing is broadcast, and texts are read once: batches are written as numbers of their words. Messages
are packed arrays, never of more keys than there are tokens.

Tokens are words outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, then one end token. Edge cases: a null
or empty text has the end token alone; a null doc_id counts as the empty string for the fold; an
empty training set knows no token; an empty table gives no rows; a text longer than a batch is a
batch of its own; repeated rows each count and get equal scores; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm import textarrays as X
from vellumine.llm.bitmaps import has
from vellumine.llm.scratch import in_batches, staged

END = np.uint64(0x0E0D0E0D0E0D0E0D)
#: Tokens of a batch, and bytes of text whose n-grams a shard has about.
BATCH_TOKENS, SHARD_BYTES = 1 << 21, 8 << 20
STEP, PROBES, BITS_PER_PROBE = 1.5, 4, 6
#: The share of the pair estimate where the word before is known.
MIX = 0.7
#: What keeps words and pairs apart in a filter.
_WORD, _PAIR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
_PAIR_BYTES = 5


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _tokens(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, tokens, index of each row's first token)."""
    for a, b, data, off in X.chunks(text, lower=True):
        word, _, first = X.words(data, off)
        yield a, b, np.insert(word, first[1:], END), first[:-1] + np.arange(b - a)


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return X.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _positions(key: np.ndarray, level: np.ndarray, bits: int) -> list[np.ndarray]:
    h = X.mix(key + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    step = X.mix(h) | np.uint64(1)
    return [(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(PROBES)]


@dataclass
class LogFrequencyFilter:
    """Levels of n-grams in a bitmap: never below the true level, above it for few keys."""

    bitmap: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray, bits_per_probe: int = BITS_PER_PROBE) -> LogFrequencyFilter:
        """From distinct keys and their counts, all 1 or more."""
        top = cls.level(count)
        bits = max(10, math.ceil(math.log2(max(1, int(top.sum())) * PROBES * bits_per_probe)))
        marks = np.zeros(1 << bits, bool)
        for j in range(1, int(top.max(initial=0)) + 1):
            for p in _positions(key[top >= j], np.full(int((top >= j).sum()), j), bits):
                marks[p.astype(np.int64)] = True
        return cls(np.packbits(marks))

    @property
    def bits(self) -> int:
        return int(len(self.bitmap) * 8).bit_length() - 1

    @staticmethod
    def level(count: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(STEP) + 1e-9).astype(np.int64)

    @staticmethod
    def middle(level: np.ndarray) -> np.ndarray:
        """The count that a level stands for: its step's geometric middle, 0 for none."""
        return np.where(level > 0, STEP ** (level.astype(np.float64) - 0.5), 0.0)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Membership probes, level after level until one is missing."""
        out, at, j = np.zeros(len(key), np.uint8), np.arange(len(key)), 1
        while len(at) and j < 256:
            found = np.ones(len(at), bool)
            for p in _positions(key[at], np.full(len(at), j), self.bits):
                found[found] = has(self.bitmap, p[found])
            at = at[found]
            out[at] = j
            j += 1
        return out


def log_probabilities(word: np.ndarray, before: np.ndarray, pair: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of tokens' smoothed probabilities, from levels of the token, the word before and the pair."""
    middle = LogFrequencyFilter.middle
    alone = (middle(word) + 1) / (n + v + 1)
    seen = np.where((word > 0) & (before > 0), middle(pair), 0.0)  # a pair is seen only if its words are
    share = np.minimum(seen / np.maximum(middle(before), 1e-9), 1.0)
    return np.log10(np.where(before > 0, MIX * share + (1 - MIX) * alone, alone))


def _shards_of(key: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of a mixed hash."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


def _pack(key: np.ndarray) -> bytes:
    """The lower 40 bits of each key; within a shard they tell pairs apart but for one in a million."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PAIR_BYTES]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _PAIR_BYTES, 8), np.uint8)
    out[:, :_PAIR_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _PAIR_BYTES)
    return out.view("<u8").ravel()


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of their places, compressed."""
    planes = [_codec().compress(x.tobytes(), asbytes=True) for x in np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)]
    return np.array([len(numbers), *map(len, planes)], "<u8").tobytes() + b"".join(planes)


def _unsqueezed(raw: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(raw[:40], "<u8").tolist()
    out, at = np.empty((n, 4), np.uint8), 40
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(_codec().decompress(raw[at : at + size], n, asbytes=True), np.uint8) if n else 0
        at += size
    return out.view("<u4").ravel()


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order of their first place, the number of each key)."""
    distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[at]


def _pairs_of(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbered pairs of a batch's tokens; documents end with END."""
    token = word[at]
    return _numbered(_pair(np.append(END, token[:-1]), token))


def _batched(batch_tokens: int):
    """mapInArrow from (doc_id, text, held_out) to one row a batch.

    ``words`` are its distinct tokens, ``tokens`` the number of each token among them, ``sizes`` the
    documents' token counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, number = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def close() -> pa.RecordBatch:
            word, at = _numbered(np.concatenate([h[2] for h in held]))
            size = np.concatenate([h[3] for h in held]).astype("<u4")
            lists = [pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays([h[k] for h in held])) for k in (0, 1)]
            blobs = [pa.array([x], pa.binary()) for x in (size.tobytes(), word.tobytes(), _squeezed(at))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *blobs], ["batch", "doc_id", "held_out", "sizes", "words", "tokens"])

        for batch in batches:
            for a, b, token, first in _tokens(batch.column("text")):
                held.append((batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), token, np.diff(np.append(first, len(token)))))
                total += len(token)
                if total >= batch_tokens:
                    yield close()
                    held, total, number = [], 0, number + 1
        if held:
            yield close()

    return run


def _asking(shards: int):
    """mapInArrow from batches to the keys that each sends to each shard (``place``), with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                word, size = np.frombuffer(batch.column("words")[k].as_py(), np.uint64), np.frombuffer(batch.column("sizes")[k].as_py(), "<u4")
                at = _unsqueezed(batch.column("tokens")[k].as_py())
                train = np.repeat(~batch.column("held_out")[k].values.to_numpy(zero_copy_only=False), size)
                pair, pair_at = _pairs_of(word, at)
                packed = []
                for key, where, mixed, pack in ((word, at, X.mix(word), np.ndarray.tobytes), (pair, pair_at, pair, _pack)):
                    counts = np.bincount(where, train, len(key)).astype(np.uint32)
                    shard = _shards_of(mixed, shards)
                    order = np.argsort(shard, kind="stable")
                    packed.append((key[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1)), pack))
                some = np.flatnonzero(np.logical_or(*(np.diff(p[2]) > 0 for p in packed)))
                blobs = [[f(x[e[s] : e[s + 1]]) for s in some.tolist()] for key, counts, e, pack in packed for x, f in ((key, pack), (counts, np.ndarray.tobytes))]
                number = pa.array(np.full(len(some), batch.column("batch")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([number, pa.array(some.astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], ["batch", "place", "words", "counts", "pairs", "pair_counts"])

    return run


def _answered(bits_per_probe: int):
    """mapInArrow over keys sorted by shard: for each batch the levels of its keys, and its words' exact counts.

    One row of each shard has the shard's training tokens and distinct words; 0 elsewhere.
    """

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        words, counts, pairs, pair_counts = ([np.frombuffer(r[k], t) for r in rows] for k, t in ((2, np.uint64), (3, np.uint32), (4, np.uint8), (5, np.uint32)))
        ends, pair_ends = (np.append(0, np.cumsum([len(x) for x in part])) for part in (counts, pair_counts))
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        pair, pair_at = np.unique(_unpack(np.concatenate(pairs).tobytes()), return_inverse=True)
        c = np.bincount(at, np.concatenate(counts), len(word)).astype(np.int64)
        p = np.bincount(pair_at, np.concatenate(pair_counts), len(pair)).astype(np.int64)
        key, many = np.concatenate([X.mix(word + _WORD), X.mix(pair + _PAIR)]), np.concatenate([c, p])
        levels = LogFrequencyFilter.of(key[many > 0], many[many > 0], bits_per_probe).levels(key)
        found = [c[at], levels[: len(word)][at], levels[len(word) :][pair_at]]
        cuts = [[x[a:b].tobytes() for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)] for x, e in zip(found, (ends, ends, pair_ends), strict=True)]
        first = np.arange(len(rows)) == 0
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in cuts), pa.array(first * int(c.sum())), pa.array(first * int((c > 0).sum()))],
            ["batch", "place", "words", "counts", "pairs", "n", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("batch", "place", "words", "counts", "pairs", "pair_counts")), strict=True):
                if rows and row[1] != rows[0][1]:
                    yield answer(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield answer(rows)

    return run


def _scored(shards: int, n: int, v: int):
    """mapInArrow over rows sorted by batch: each batch's answers in order of shards, then itself."""

    def score(row: dict, answers: list[tuple]) -> pa.RecordBatch:
        word, size = np.frombuffer(row["words"].as_py(), np.uint64), np.frombuffer(row["sizes"].as_py(), "<u4").astype(np.int64)
        at = _unsqueezed(row["tokens"].as_py())
        pair, pair_at = _pairs_of(word, at)
        joined = [np.frombuffer(b"".join(a[j] for a in answers), t) for j, t in enumerate((np.int64, np.uint8, np.uint8))]
        exact, level, pair_level = np.empty(len(word), np.int64), np.empty(len(word), np.uint8), np.empty(len(pair), np.uint8)
        order = np.argsort(_shards_of(X.mix(word), shards), kind="stable")
        exact[order], level[order] = joined[0], joined[1]
        pair_level[np.argsort(_shards_of(pair, shards), kind="stable")] = joined[2]
        ends = np.append(0, np.cumsum(size))
        first, c, one = ends[:-1], exact[at], level[at]
        value = log_probabilities(one, np.append(one[-1:], one[:-1]), pair_level[pair_at], n, v)
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10((c + 1.0) / (n + v + 1)), value)]
        return pa.RecordBatch.from_arrays([row["doc_id"].values, row["held_out"].values, *map(pa.array, (size, *sums))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("doc_id", "held_out", "sizes", "words", "tokens", "counts", "pairs")}
                if row["sizes"].is_valid:
                    yield score(row, answers)
                    answers = []
                else:
                    answers.append(tuple(row[c].as_py() for c in ("words", "counts", "pairs")))

    return run


def scores(docs: DataFrame, batch_tokens: int = BATCH_TOKENS, shard_bytes: int = SHARD_BYTES, bits_per_probe: int = BITS_PER_PROBE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4 * n_parts, -(-size // shard_bytes))
    ids, flags = T.ArrayType(docs.schema["doc_id"].dataType), T.ArrayType(T.BooleanType())
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("doc_id", ids), T.StructField("held_out", flags), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "tokens"))])
    rows = staged(in_batches(docs).mapInArrow(_batched(batch_tokens), schema), "lm-batches", "zstd")
    asked = rows.select("batch", "held_out", "sizes", "words", "tokens").mapInArrow(_asking(shards), "batch long, place int, words binary, counts binary, pairs binary, pair_counts binary")
    met = asked.repartition(n_parts, "place").sortWithinPartitions("place")
    answers = staged(met.mapInArrow(_answered(bits_per_probe), "batch long, place int, words binary, counts binary, pairs binary, n long, v long"), "lm-answers", "zstd")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    own = rows.select("batch", F.lit(shards).alias("place"), "doc_id", "held_out", "sizes", "words", "tokens", blank("counts", "binary"), blank("pairs", "binary"))
    back = answers.select("batch", "place", blank("doc_id", ids), blank("held_out", flags), blank("sizes", "binary"), "words", blank("tokens", "binary"), "counts", "pairs")
    home = own.union(back).repartition(n_parts, "batch").sortWithinPartitions("batch", "place")
    out = T.StructType([docs.schema["doc_id"], docs.schema["held_out"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return home.mapInArrow(_scored(shards, n, v), out).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
