"""Near-duplicate documents through an LSH forest over MinHash signatures.

1. Each document's distinct word shingles give a set hash and ``TREES`` orders of ``DEPTH`` MinHash
   values. Documents of equal set collapse to the smallest doc_id (partial aggregation), so exact
   copies cost one row.
2. Every tree's signatures are sorted globally (range partitions). Neighbours whose longest common
   prefix reaches ``LEAST_DEPTH`` form a region; each member is a candidate of the region's head.
   A region of over ``REGION`` members is dealt into parts of deeper prefixes: members are candidates
   of their part's head, and that of the region's head. Regions cut by a partition's edge are glued
   by their prefix. Candidates are linear in the signatures.
3. Connected candidates form a cluster: every linked pair is in one, but for pairs that share a
   region in no tree (at similarity .85: 2e-8, at .8: 3e-6).
4. Links are confirmed on full shingle sets within a cluster, breadth first: a document is compared
   only with those not yet reached, by size and by the triangle inequality of the Jaccard distance.
   Large clusters are dealt into blocks with shared pivots; documents the pivots don't reach are
   then compared with all blocks, so no link is lost and no task holds an unbounded group.

Edge cases: null, empty and wordless texts have no shingles and link with nothing; fewer words than
the shingle length make one shingle of the whole sequence; rows that share a doc_id are one node;
a null doc_id is a component of its own (null); ids are integers; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import textarrays as X
from vellumine.llm.bitmaps import gathered, has
from vellumine.llm.components import components
from vellumine.llm.scratch import clear, in_batches, staged, written

TREES, DEPTH, LEAST_DEPTH, REGION = 24, 8, 4, 4096
#: Documents that one task compares at a time, and pivots that all blocks of a cluster share.
BLOCK, PIVOTS = 256, 16
#: Bits and probes a candidate's id has in the filter that texts pass before they move; its largest size is 2**FILTER_BITS bits (32 MB).
ID_BITS, PROBES, FILTER_BITS = 16, 3, 28
_draw = np.random.default_rng(7)
_A = _draw.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def shingle_sets(text: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    for _, _, data, off in X.chunks(text, lower=True):
        word, _, first = X.words(data, off)
        gram = X.sequence_hashes(word, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(gram[a : b - n + 1])
            elif b > a:  # the whole sequence; its length keeps it apart from longer shingles
                yield X.mix(X.sequence_hashes(word[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """TREES orders of DEPTH 16-bit values, big-endian: bytes sort as the values do."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(folded), 4096):
        np.minimum(least, (folded[a : a + 4096, None] * _A + _B).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def _described(docs: DataFrame, n: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hi, lo, forest = [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                size.append(len(s))
                hi.append(int(s.sum()) & (2**64 - 1))
                lo.append(int(np.bitwise_xor.reduce(X.mix(s + np.uint64(1)))) if len(s) else 0)
                forest.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.array(forest, pa.binary())],
                ["doc_id", "n_shingles", "hi", "lo", "forest"],
            )

    return in_batches(docs.select("doc_id", "text")).mapInArrow(describe, f"doc_id {kind}, n_shingles long, hi long, lo long, forest binary")


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, signature, doc_id) to (u, v, glue): member and head of its region.

    Rows with ``glue`` name the head of a region at the partition's edge and its prefix.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("glue", pa.binary())])
    last, head, first = None, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.empty((n, 1 + DEPTH), np.uint16)
        key[:, 0] = batch.column("tree").to_numpy()
        key[:, 1:] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(n, DEPTH)
        ids = batch.column("doc_id").to_numpy()
        before = np.vstack([key[:1] if last is None else last, key[:-1]])
        common = np.cumprod(key == before, axis=1).sum(1) - 1  # values shared with the row before; -1: another tree
        if last is None:
            common[0] = -1
        starts = np.flatnonzero(common < LEAST_DEPTH)
        heads = np.full(n, -1, np.int64)
        heads[starts] = ids[starts]
        where = np.maximum.accumulate(np.where(heads >= 0, np.arange(n), -1))
        top = np.where(where >= 0, ids[np.maximum(where, 0)], head if head is not None else ids[0])
        bounds = np.append(starts, n)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            depth = LEAST_DEPTH
            parts = [(a, b)]
            while depth < DEPTH and any(y - x > REGION for x, y in parts):
                depth += 1
                parts = [p for x, y in parts for p in (_cut(common, x, y, depth) if y - x > REGION else [(x, y)])]
            if len(parts) > 1:
                for x, y in parts:
                    top[x:y] = ids[x]
                    top[x] = ids[a]  # the part's head is a candidate of the whole region's
        glue = lambda r: key[r, : 1 + LEAST_DEPTH].astype(">u2").tobytes()
        out = ids != top
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(top[out]), pa.nulls(int(out.sum()), pa.binary())], schema=schema)
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([ids[0]]), pa.array([ids[0]]), pa.array([glue(0)], pa.binary())], schema=schema)
        last, head, first = key[-1:], int(top[-1]), False
        end = glue(n - 1)
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([head]), pa.array([end], pa.binary())], schema=schema)


def _cut(common: np.ndarray, a: int, b: int, depth: int) -> list[tuple[int, int]]:
    at = [a, *(a + 1 + np.flatnonzero(common[a + 1 : b] < depth)).tolist(), b]
    return list(zip(at[:-1], at[1:], strict=True))


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """(node, component) of documents that share a region, from (doc_id, forest)."""
    spark = reps.sparkSession
    width = 2 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("forest"), t * width + 1, F.lit(width)).alias("signature")))
    rows = reps.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(trees).alias("t")).select("t.tree", "t.signature", "doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "tree", "signature", "doc_id").sortWithinPartitions("tree", "signature", "doc_id")
    found = staged(ordered.mapInArrow(_regions, "u long, v long, glue binary").distinct(), "regions")
    heads = found.filter("glue is not null").select("glue", "u")
    glued = heads.join(heads.groupBy("glue").agg(F.min("u").alias("v")), "glue").select("u", "v")
    return components(found.filter("glue is null").select("u", "v").union(glued))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number of each set; sets are linked at 100 * intersection >= percent * union."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    part, left, number = np.full(m, -1), np.ones(m, bool), 0
    for p in range(m):
        if not left[p]:
            continue
        left[p], part[p] = False, number
        stack, distance = [p], None
        while stack:
            x = stack.pop()
            keep = left & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            if distance is not None:
                keep &= np.abs(distance - distance[x]) <= 1 - percent / 100 + 1e-9
            at = np.flatnonzero(keep) if distance is not None else np.arange(m)
            if not left.any():
                break
            if not len(at):
                continue
            own = flat[edge[x] : edge[x + 1]]
            mark[own] = 1
            if len(at) == m:
                shared = np.add.reduceat(mark[flat], edge[:-1])
            else:
                shared = np.fromiter((int(mark[flat[edge[k] : edge[k + 1]]].sum()) for k in at), np.int64, len(at))
            mark[own] = 0
            union = size[x] + size[at] - shared
            if distance is None:
                distance = 1 - shared / union
            new = at[keep[at] & (100 * shared >= percent * union)]
            left[new] = False
            part[new] = number
            stack += new.tolist()
        number += 1
    return part


def _resolve(n: int, percent: int, keys: tuple[str, ...]):
    """mapInArrow over rows ordered by ``keys``: (u, v), each document and its component's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def close() -> tuple[list, list]:
            if len(ids) < 2:
                return [], []
            part = linked(sets, percent)
            own = np.array(ids)
            least = np.full(part.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, part, own)
            return own.tolist(), least[part].tolist()

        for batch in batches:
            u, v = [], []
            groups = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for group, doc, s in zip(groups, batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                if group != key:
                    a, b = close()
                    u += a
                    v += b
                    key, ids, sets = group, [], []
                if len(s):
                    ids.append(doc)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u, v = close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _confirm(rows: DataFrame, n: int, percent: int, *keys: str) -> DataFrame:
    ordered = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return in_batches(ordered.select(*keys, "doc_id", "text")).mapInArrow(_resolve(n, percent, keys), "u long, v long").filter("u <> v")


def _id_bits(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = X.mix(ids.view(np.uint64))
    step = X.mix(h) | np.uint64(1)
    return [(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(PROBES)]


def candidate_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of at least the rows whose doc_id is a ``node`` of ``ids``, without moving any text.

    A Bloom filter of the ids goes to every executor. Where there are too many ids for its largest
    size more rows pass than are candidates; the join that follows drops them.
    """
    bits = max(16, min(FILTER_BITS, (ID_BITS * max(1, ids.count())).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(_id_bits(batch.column("node").to_numpy(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(bit), np.int32)), pa.array(bit)], ["row", "bit"])

    held = docs.sparkSession.sparkContext.broadcast(gathered(ids.select("node").mapInArrow(place, "row int, bit long"), 1, bits)[0])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ones(batch.num_rows, bool)
            for bit in _id_bits(batch.column("doc_id").to_numpy(), bits):
                found &= has(held.value, bit)
            yield batch.filter(pa.array(found))

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(texts).mapInArrow(passing, "doc_id long, text string")


def confirmed_components(docs: DataFrame, clusters: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) after links are confirmed on full sets within ``clusters`` (node, component)."""
    sizes = staged(clusters.groupBy("component").agg(F.count("*").alias("members")), "cluster-sizes")  # written: a large cluster's rows can be split in the join
    dealt = clusters.join(sizes, "component").select(
        "node", F.col("component").alias("cluster"), F.ceil(F.col("members") / block).cast("int").alias("blocks"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)).cast("int").alias("block")
    )
    own = staged(dealt, "clusters")
    begun = written()
    # one pivot for each value of a hash: PIVOTS at most, whatever the cluster's size
    drawn = F.xxhash64(F.col("node") + 1)
    pivots = own.filter("blocks > 1").groupBy("cluster", F.pmod(drawn, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(drawn.alias("h"), F.col("node"))).alias("p"))
    pivots = pivots.select(F.col("cluster").alias("c"), F.col("p.node").alias("pivot"))
    chosen = own.join(pivots, (own["node"] == pivots["pivot"]) & (own["cluster"] == pivots["c"]), "left").select(
        "node", "cluster", "blocks", "block", F.when(F.col("pivot").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")).alias("to")
    )
    texts = staged(candidate_texts(docs, own), "candidate-texts")
    rows = texts.join(chosen, texts["doc_id"] == chosen["node"]).select("cluster", F.explode("to").alias("part"), "doc_id", "text")
    first = staged(_confirm(rows, n, percent, "cluster", "part"), "links")
    labels = staged(components(first), "labels")
    big = own.filter("blocks > 1")
    if not big.head(1):
        clear(docs.sparkSession, begun, keep=1)
        return labels
    # documents of large clusters outside the cluster's largest component meet all blocks
    labelled = big.join(labels, "node", "left").select("node", "cluster", "blocks", "block", F.coalesce("component", "node").alias("component"))
    counts = labelled.groupBy("cluster", "component").agg(F.count("*").alias("k"))
    most = staged(counts.groupBy("cluster").agg(F.max(F.struct("k", "component")).alias("top")).select(F.col("cluster").alias("c"), F.col("top.component").alias("top")), "largest")
    apart = labelled.join(most, labelled["cluster"] == most["c"]).withColumn("out", F.col("component") != F.col("top"))
    apart = staged(apart.select("node", "cluster", "blocks", "block", "out"), "apart")
    left = staged(apart.filter("out").groupBy("cluster").agg(F.count("*").alias("left")).select(F.col("cluster").alias("c"), F.greatest(F.lit(1), F.ceil(F.col("left") / block)).cast("int").alias("lots")), "left")
    if not left.head(1):
        return labels  # the tables written since are as small as it
    lot = F.pmod(F.xxhash64(F.col("node") + 2), F.col("lots")).cast("int")
    meeting = apart.join(left, apart["cluster"] == left["c"]).withColumn("lot", lot)
    every = F.sequence(F.lit(0), F.col("lots") - 1)
    visits = meeting.select("node", "cluster", F.col("block").alias("part"), F.explode(every).alias("lot")).union(
        meeting.filter("out").select("node", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "lot")
    ).distinct()
    again = texts.join(visits, texts["doc_id"] == visits["node"]).select("cluster", "part", "lot", "doc_id", "text")
    second = _confirm(again, n, percent, "cluster", "part", "lot")
    whole = staged(components(first.union(second)), "labels")
    clear(docs.sparkSession, begun, keep=1)
    return whole


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, representative (least doc_id of equal sets), component_id, kept, for each row."""
    rows = staged(_described(docs, n), "signatures")
    begun = written()
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(some.groupBy("hi", "lo", "n_shingles").agg(F.min(F.struct("doc_id", "forest")).alias("r")).select("hi", "lo", "n_shingles", F.col("r.doc_id").cast("long").alias("doc_id"), F.col("r.forest").alias("forest")), "classes")
    clusters = staged(candidate_clusters(classes.select("doc_id", "forest")), "candidates")
    classes = staged(classes.drop("forest"), "classes")
    clear(docs.sparkSession, begun, keep=2)
    labels = confirmed_components(docs, clusters, n, percent, block)
    named = classes.select("hi", "lo", "n_shingles", F.col("doc_id").alias("representative")).join(labels, F.col("representative") == F.col("node"), "left").select("hi", "lo", "n_shingles", "representative", "component")
    same_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "representative", F.col("doc_id")))
    return rows.drop("forest").join(named, ["hi", "lo", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("representative", "doc_id").alias("representative"), same_id.alias("component_id"), F.coalesce(F.col("doc_id") == same_id, F.lit(True)).alias("kept")
    )
