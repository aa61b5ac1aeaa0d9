"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped from both ends and A-Z lower-cased; its
identity is a 128-bit hash. ``counts`` holds, exactly, in how many documents each key occurs;
inserting documents adds to it, deleting them subtracts, so any history can be undone. Keys that
reach the threshold are in their shard's cuckoo filter, keys that fall below it are deleted there.
A line that the filter lacks is kept without a lookup; a positive is confirmed on exact counts. Up to
``BROADCAST_KEYS`` frequent keys the filters and the keys go to every executor; beyond, lines are sent
to their shard's filter, and those that it lets pass are joined with the exact counts.

Edge cases: an empty table gives no rows; a null or empty text is one empty line; the empty key is never dropped; a key repeated
in one document counts once; a text whose lines all go becomes empty; repeated rows are separate
documents; columns other than those carried are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.scratch import in_batches, staged

#: Frequent keys (16 bytes each, and 3 of filter) sent to every executor at most; more are joined.
BROADCAST_KEYS = 2_000_000
#: Keys that a task counts before it passes them on.
COUNTED = 1 << 18
#: Frequent keys a shard of the filter holds about.
KEYS_PER_SHARD = 1 << 18
#: Copies of each shard's filter that share the lines of a hot key.
SALTS = 8
_SPACE = b" \t\n\x0b\x0c\r"
_SLOTS = 4


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; keys are pairs of unsigned 64-bit integers."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def of_capacity(cls, n: int) -> CuckooFilter:
        need = max(4, -(-n * 10 // (9 * _SLOTS)))
        return cls(np.zeros((1 << (need - 1).bit_length(), _SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.buckets) - 1)
        mark = (hi & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (lo & mask).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        jump = (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.buckets) - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hi, lo)
        return (self.buckets[a] == mark[:, None]).any(1) | (self.buckets[b] == mark[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if it is too full; the caller then rebuilds it larger from the exact counts."""
        moves = np.random.default_rng(len(self.buckets))
        for mark, a, b in zip(*self._places(hi, lo), strict=True):
            at = a
            for _ in range(500):
                free = np.flatnonzero(self.buckets[at] == 0)
                if not len(free) and at == a:
                    at = b
                    free = np.flatnonzero(self.buckets[at] == 0)
                if len(free):
                    self.buckets[at, free[0]] = mark
                    break
                slot = moves.integers(_SLOTS)
                self.buckets[at, slot], mark = mark, self.buckets[at, slot]
                a = at = self._other(np.array([at]), np.array([mark], np.uint16))[0]
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(hi, lo), strict=True):
            for at in (a, b):
                full = np.flatnonzero(self.buckets[at] == mark)
                if len(full):
                    self.buckets[at, full[0]] = 0
                    break


def built(hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
    n = len(hi)
    while True:
        out = CuckooFilter.of_capacity(n)
        if out.insert(hi, lo):
            return out
        n = 2 * n + 8


def _keys(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The key of each line; too short a key counts as empty, which is never dropped."""
    keys = [x.strip(_SPACE).lower() for x in lines]
    return keys if min_chars <= 1 else [k if len(k.decode()) >= min_chars else b"" for k in keys]


def _digests(keys: list[bytes]) -> np.ndarray:
    """Rows of (hi, lo)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist())


def reference_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, n_docs): in how many documents each key occurs, exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def close() -> pa.RecordBatch:
            d, n = np.unique(np.concatenate(held).view("u8,u8").ravel(), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(d["f0"].astype(np.int64)), pa.array(d["f1"].astype(np.int64)), pa.array(n.astype(np.int64))], ["hi", "lo", "n"])

        for batch in batches:
            keys: list[bytes] = []
            for text in _texts(batch):
                keys += {*_keys(text.split(b"\n"), min_chars)} - {b""}
            held.append(_digests(keys))
            total += len(keys)
            if total >= COUNTED:
                yield close()
                held, total = [], 0
        if held:
            yield close()

    return in_batches(docs.select("text")).mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"))


@dataclass
class LineIndex:
    """Exact counts and the filters over them. Every change returns a new index."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        counts = staged(reference_counts(docs, min_chars), "line-counts")
        shards = cls._needed(counts, min_docs)
        return cls(counts, staged(cls._filters(counts, shards, min_docs), "line-filters"), shards, min_docs, min_chars)

    @staticmethod
    def _needed(counts: DataFrame, min_docs: int) -> int:
        return max(1, -(-counts.filter(F.col("n_docs") >= min_docs).count() // KEYS_PER_SHARD))

    @staticmethod
    def _shard(shards: int):
        return F.pmod("hi", F.lit(shards)).cast("int")

    @classmethod
    def _filters(cls, counts: DataFrame, shards: int, min_docs: int) -> DataFrame:
        def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            made = built(rows["hi"].to_numpy().astype(np.uint64), rows["lo"].to_numpy().astype(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

        frequent = counts.filter(F.col("n_docs") >= min_docs).select(cls._shard(shards).alias("shard"), "hi", "lo")
        return frequent.groupBy("shard").applyInPandas(make, "shard int, filter binary")

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = reference_counts(docs, self.min_chars).select("hi", "lo", (sign * F.col("n_docs")).alias("n_docs"))
        both = self.counts.select("*", F.col("n_docs").alias("old")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
        new = staged(both.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.sum("old").alias("old")).filter("n_docs <> 0 or old <> 0"), "line-change")
        if new.filter("n_docs < 0").head(1):
            raise ValueError("documents are deleted that were never inserted")
        up = (F.col("n_docs") >= self.min_docs) & (F.col("old") < self.min_docs)
        down = (F.col("n_docs") < self.min_docs) & (F.col("old") >= self.min_docs)
        crossing = new.filter(up | down).select(self._shard(self.shards).alias("shard"), "hi", "lo", up.alias("up"))

        def update(key: tuple, have: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(have["filter"].iloc[0]) if len(have) else CuckooFilter.of_capacity(len(rows))
            hi, lo, rises = (rows[c].to_numpy() for c in ("hi", "lo", "up"))
            hi, lo, rises = hi.astype(np.uint64), lo.astype(np.uint64), rises.astype(bool)
            f.delete(hi[~rises], lo[~rises])
            full = not f.insert(hi[rises], lo[rises])
            return pd.DataFrame({"shard": [key[0]], "filter": [None if full else f.to_bytes()]})

        changed = staged(self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(update, "shard int, filter binary"), "line-filters")
        counts = new.filter("n_docs > 0").select("hi", "lo", "n_docs")
        shards = self.shards
        if changed.filter("filter is null").head(1):  # a shard is too full: build anew from the counts
            shards = max(shards, self._needed(counts, self.min_docs))
            changed = staged(self._filters(counts, shards, self.min_docs), "line-filters")
        return LineIndex(counts, changed, shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs).select("hi", "lo")

    def apply(self, docs: DataFrame, carry: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """doc_id, text (what is left of it), n_lines, n_dropped and the carried columns.

        Columns named as a result can't be carried by themselves; put them in a struct of another name.
        """
        carry = tuple(c for c in carry if c not in ("doc_id", "text", "n_lines", "n_dropped"))
        docs = docs.select("doc_id", "text", *carry)
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        if self.frequent().count() <= broadcast_keys:
            return in_batches(docs).mapInArrow(self._by_broadcast(docs), schema)
        return self._by_join(docs, schema)

    def _by_broadcast(self, docs: DataFrame):
        keys = self.frequent().toPandas()
        hi, lo = (keys[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
        order = np.argsort(lo, kind="stable")
        most = int(np.unique(lo, return_counts=True)[1].max()) if len(lo) else 0
        filters = [(r["shard"], bytes(r["filter"])) for r in self.filters.collect()]
        held = docs.sparkSession.sparkContext.broadcast((hi[order], lo[order], most, filters))
        shards, min_chars = self.shards, self.min_chars

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            his, los, most, raw = held.value
            filters = {k: CuckooFilter.from_bytes(v) for k, v in raw}

            def hit(digests: np.ndarray) -> np.ndarray:
                hi, lo = digests[:, 0], digests[:, 1]
                out = np.zeros(len(hi), bool)
                shard = np.mod(hi.view(np.int64), shards)
                for k, f in filters.items():
                    at = np.flatnonzero(shard == k) if shards > 1 else np.arange(len(hi))
                    at = at[f.contains(hi[at], lo[at])]
                    place = np.searchsorted(los, lo[at])
                    for step in range(most):  # keys that share their lower half stand side by side
                        p = np.minimum(place + step, len(los) - 1)
                        out[at] |= (los[p] == lo[at]) & (his[p] == hi[at])
                return out

            for batch in batches:
                lines = [x.split(b"\n") for x in _texts(batch)]
                keys = _keys([y for x in lines for y in x], min_chars)
                gone = hit(np.ascontiguousarray(_digests(keys))) & np.fromiter(map(bool, keys), bool, len(keys))
                yield _without(batch, lines, np.split(gone, np.cumsum([len(x) for x in lines])[:-1]) if lines else [])

        return drop

    def _maybe_frequent(self, docs: DataFrame) -> DataFrame:
        """(doc_id, __hash, __line, hi, lo) of lines that their shard's filter doesn't rule out.

        Lines go to ``SALTS`` copies of their shard's filter, in turn, as one key may hold a third of
        all lines. A task reads each filter before the lines that it decides.
        """
        min_chars, shards = self.min_chars, self.shards

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [_keys(x.split(b"\n"), min_chars) for x in _texts(batch)]
                flat = [k for x in keys for k in x]
                n = np.array([len(x) for x in keys], dtype=np.int64)
                row = np.repeat(np.arange(len(n)), n)
                line = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                some = np.fromiter(map(bool, flat), bool, len(flat))
                d = _digests(flat)[some].astype(np.int64)
                ids = [batch.column(c).take(pa.array(row[some])) for c in ("doc_id", "__hash")]
                shard = np.mod(d[:, 0], shards).astype(np.int32)
                salt = (row[some] % SALTS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (shard, salt, line[some].astype(np.int32), d[:, 0], d[:, 1])), pa.nulls(len(d), pa.binary())], named.names)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, f = None, None
            for batch in batches:
                raw = batch.column("filter")
                place = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt")], 1)
                edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1))).tolist() + [len(place)]
                hit = np.zeros(len(place), bool)
                hi, lo = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("hi", "lo"))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if tuple(place[a]) != key:
                        key, f = tuple(place[a]), None
                    if raw[a].is_valid:
                        f, a = CuckooFilter.from_bytes(raw[a].as_py()), a + 1
                    if f is not None:  # no filter: no key of the shard is frequent
                        hit[a:b] = f.contains(hi[a:b], lo[a:b])
                yield batch.select(["doc_id", "__hash", "__line", "hi", "lo"]).filter(pa.array(hit))

        named = T.StructType([*docs.select("doc_id", "__hash").schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("shard", "salt", "__line")), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("filter", T.BinaryType())])
        asked = in_batches(docs.select("doc_id", "__hash", "text")).mapInArrow(keyed, named)
        blank = lambda c: F.lit(None).cast(named[c].dataType).alias(c)
        salted = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = salted.select(blank("doc_id"), blank("__hash"), "shard", "salt", blank("__line"), blank("hi"), blank("lo"), "filter")
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = asked.union(copies).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        out = T.StructType([f for f in named.fields if f.name in ("doc_id", "__hash", "__line", "hi", "lo")])
        return met.mapInArrow(probe, out)

    def _by_join(self, docs: DataFrame, schema: T.StructType) -> DataFrame:
        names = docs.columns
        docs = docs.withColumn("__hash", F.xxhash64("text"))
        gone = self._maybe_frequent(docs).join(self.frequent(), ["hi", "lo"]).groupBy(F.col("doc_id").alias("__d"), F.col("__hash").alias("__h")).agg(F.collect_set("__line").alias("__gone"))
        joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__d"]) & (docs["__hash"] == gone["__h"]), "left").select(*(docs[c] for c in names), "__gone")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = [x.split(b"\n") for x in _texts(batch)]
                flags = []
                for x, at in zip(lines, batch.column("__gone").to_pylist(), strict=True):
                    f = np.zeros(len(x), bool)
                    f[at or []] = True
                    flags.append(f)
                yield _without(batch.select(names), lines, flags)

        return in_batches(joined).mapInArrow(drop, schema)


def _without(batch: pa.RecordBatch, lines: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
    """The batch with what is left of its texts, and how many lines there were and went."""
    dropped = np.array([g.sum() for g in gone], dtype=np.int64)
    kept = [b"\n".join([x for x, g in zip(xs, gs, strict=True) if not g]) if n else b"\n".join(xs) for xs, gs, n in zip(lines, gone, dropped, strict=True)]
    columns = [pa.array(kept, pa.binary()).cast(pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
    counts = [pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped)]
    return pa.RecordBatch.from_arrays([*columns, *counts], [*batch.schema.names, "n_lines", "n_dropped"])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Lines whose key occurs in at least ``min_docs`` documents leave every document."""
    return LineIndex.build(docs, min_docs, min_chars).apply(docs, carry, broadcast_keys)
