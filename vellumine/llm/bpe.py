"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can come last in the prefix's encoding. The table of
those tokens is filled left to right: a token that ends the prefix is the one if it may follow the
last token of the prefix before it. Two tokens may stand side by side if undoing their merges, the
later first, never shows a pair across the border that would have merged earlier. Reading the table
backwards gives the encoding, appending bytes extends it, and an edit keeps the part before it.

Texts split into pieces by the tokenizer's pattern; each piece is encoded on its own. Pieces seen
before come from a bounded cache.

Edge cases: null and empty texts have no ids and decode to no bytes; ids follow from the text alone,
so repeated rows get equal results; an empty table gives none; a long text is one row of any length;
columns other than those carried are ignored, and so is a carried one with the name of a result.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vellumine.llm.memo import Memo
from vellumine.llm.scratch import in_batches

#: Pieces kept by each worker, in each of two generations; pairs of tokens kept.
CACHE, PAIRS = 100_000, 200_000


class MergeTable:
    """Tokens as strings (bytes or str) with merge ranks; single bytes or characters are units."""

    def __init__(self, ranks: dict):
        self.rank = ranks
        self.made: dict = {}
        self._parts: dict = {}
        self.pairs: dict = {}

    @cached_property
    def tails(self) -> set:
        """Ends of tokens: what no token ends in stops a search."""
        return {t[i:] for t in self.rank for i in range(len(t))}

    def merge(self, text, down_to: int = 1) -> list:
        """Plain BPE: the pair of lowest rank merges first, leftmost first, until ``down_to`` are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > down_to:
            best, at = min((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token):
        """The two tokens whose merge made ``token``; () for a unit, None if BPE never makes it."""
        found = self._parts.get(token, self)
        if found is self:
            if len(token) == 1:
                found = ()
            else:
                found = self.merge(token, 2)
                found = tuple(found) if len(found) == 2 else None
            self._parts[token] = found
        return found

    def candidates(self, text, end: int) -> list:
        """Tokens that BPE can make and that end ``text[:end]``, longest first."""
        tails, made = self.tails, self.made
        found = [text[end - 1 : end]]
        for start in range(end - 2, -1, -1):
            tail = text[start:end]
            if tail not in tails:
                break
            known = made.get(tail)
            if known is None:
                known = made[tail] = tail in self.rank and self.parts(tail) is not None
            if known:
                found.append(tail)
        found.reverse()
        return found

    def may_follow(self, a, b) -> bool:
        """Whether BPE leaves ``a`` then ``b`` as two tokens."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.border_stays(a, b)
        return found

    def border_stays(self, a, b) -> bool:
        limit = float("inf")
        while True:
            if self.rank.get(a + b, limit) < limit:
                return False
            own, other = self.parts(a), self.parts(b)
            if not own and not other:
                return True
            if own and (not other or self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], own[1]  # an equal rank to the right would come later
            else:
                limit, b = self.rank[b] + 0.5, other[0]  # an equal rank to the left would come first


class PrefixTable:
    """The last token of every prefix of ``text``."""

    def __init__(self, table: MergeTable, text):
        self.table, self.text, self.last = table, text[:0], [None]
        self.append(text)

    def append(self, more) -> None:
        table, start = self.table, len(self.text)
        self.text = text = self.text + more
        last, pairs = self.last, table.pairs
        for end in range(start + 1, len(text) + 1):
            for token in table.candidates(text, end):
                before = last[end - len(token)]
                known = pairs.get((before, token))
                if known if known is not None else before is None or table.may_follow(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends this prefix")

    def cut(self, length: int) -> None:
        """Forgets what follows the first ``length`` units."""
        self.text = self.text[:length]
        del self.last[length + 1 :]

    def tokens(self) -> list:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.last[at])
        return out[::-1]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of ``pattern``; texts of code points below 256 take the same pattern with its classes spelled out.

    The standard library matches ranges faster than a Unicode-aware matcher matches properties; both
    see the same classes, as the ranges are what the properties hold below 256.
    """
    whole = regex.compile(pattern).findall
    low = [chr(c) for c in range(256)]
    ranges = {p: "".join(re.escape(c) for c in low if regex.fullmatch(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = "", False, 0
    while at < len(pattern):
        token = regex.match(r"\\p\{\w+\}|\\.|.", pattern[at:], regex.S)[0]
        at += len(token)
        if token in ranges:
            token = ranges[token] if inside else f"[{ranges[token]}]"
        elif token == r"\S" and not inside:
            token = f"[^{ranges[r'\s']}]"
        elif len(token) > 1 and token[1] in "pPwWdDbBS":
            return whole  # a class that isn't spelled out here
        inside = token == "[" or (inside and token != "]")
        out += token
    narrow, beyond = re.compile(out).findall, re.compile("[^\x00-\xff]").search
    return lambda text: whole(text) if beyond(text) else narrow(text)


class BytePairs:
    """A rank file: byte strings in base64 and their ranks, which are also the ids."""

    def __init__(self, raw: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.table = MergeTable(self.ids)
        self.split, self.pattern = splitter(pattern), pattern
        self.ends = ahocorasick.Automaton()  # tells the tokens that end at each byte, longest first
        for t, i in self.ids.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.made: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(self.packed, CACHE)

    def follows(self, key: int) -> bool:
        """Whether the token in the low half of ``key`` may follow the one in the high half, or begin a piece (high half 0)."""
        before, i = key >> 32, key & 0xFFFFFFFF
        made = self.made.get(i)
        if made is None:
            made = self.made[i] = self.table.parts(self.bytes[i]) is not None
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = made and (not before or self.table.border_stays(self.bytes[before - 1], self.bytes[i]))
        return known

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        last = [0] * (len(raw) + 1)  # of each prefix: its last token's id plus one
        pairs = self.pairs
        for end, (n, i) in self.ends.iter(raw.decode("latin-1")):
            if last[end + 1]:
                continue
            key = last[end + 1 - n] << 32 | i
            known = pairs.get(key)
            if known if known is not None else self.follows(key):
                last[end + 1] = i + 1
        out, at = [], len(raw)
        while at:
            out.append(last[at] - 1)
            at -= len(self.bytes[last[at] - 1])
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece)).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids as 32-bit integers in a row."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


#: Characters past a piece's end that its match may have looked at, besides a run of spaces.
LOOK_AHEAD = 4


class Draft:
    """A text under edit: only pieces that an edit may change are split and encoded again.

    A match that ended before an edit stands if it can't have looked at what the edit changed: the
    text between has a character other than space and ``LOOK_AHEAD`` more. Splitting starts at the
    last such border and stops where it meets an old border behind the edit, as patterns look ahead only.
    The last piece's prefix table is kept up to where its bytes change.
    """

    def __init__(self, pairs: BytePairs, text: str = ""):
        self.pairs, self.pieces = pairs, []
        self.find = regex.compile(pairs.pattern).finditer
        self.open = PrefixTable(pairs.table, b"")
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def append(self, more: str) -> None:
        end = sum(map(len, self.pieces))
        self.replace(end, end, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Characters ``start:end`` become ``new``."""
        old = self.pieces
        ends = list(accumulate(map(len, old)))
        first = bisect_right(ends, start)  # pieces before it end at or before the edit
        at = ends[first - 1] if first else 0
        between = old[first][: start - at] if first < len(old) else ""
        while first and not between[: max(0, len(between) - LOOK_AHEAD)].strip():
            first -= 1
            between = old[first] + between
        at = ends[first] - len(old[first]) if first < len(old) else at
        rest = "".join(old[first:])
        fresh = rest[: start - at] + new + rest[end - at :]
        later = {ends[-1] - e: k + 1 for k, e in enumerate(ends) if e >= end}  # characters after a border, and its next piece
        out, after = [], ends[-1] - end if ends else 0
        for match in self.find(fresh):
            out.append(match[0])
            left = len(fresh) - match.end()
            if left <= after and left in later:
                out += old[later[left] :]
                break
        self.pieces = old[:first] + out
        self._reopen()

    def _reopen(self) -> None:
        raw = self.pieces[-1].encode() if self.pieces else b""
        same = len(commonprefix([raw, self.open.text]))
        self.open.cut(same)
        self.open.append(raw[same:])

    def ids(self) -> list[int]:
        out = self.pairs.encode_pieces(self.pieces[:-1])
        return out + [self.pairs.ids[t] for t in self.open.tokens()]


_loaded: dict[int, BytePairs] = {}


def _pairs(held) -> BytePairs:
    """The worker's own tables and caches for a broadcast (file, pattern)."""
    raw, pattern = held.value
    key = hash((raw, pattern))
    if key not in _loaded:
        _loaded[key] = BytePairs(raw, pattern)
    return _loaded[key]


def _shared(spark: SparkSession, path: str, pattern: str):
    with open(path, "rb") as f:  # a vocabulary file beside the driver, about a megabyte
        return spark.sparkContext.broadcast((f.read(), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The carried columns, ``ids`` (array<int>) of each whole text and, if asked for, ``decoded``, the bytes that they stand for."""
    held = _shared(docs.sparkSession, path, pattern)
    carry = tuple(c for c in carry if c not in ("ids", "decoded"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(held)
        for batch in batches:
            packed = [pairs.encode_packed(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            arrays = [*(batch.column(c) for c in range(len(carry))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))]
            if decode:
                arrays.append(pa.array([pairs.decode(np.frombuffer(p, np.int32).tolist()) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "ids", *["decoded"] * decode])

    kept = docs.select(*carry)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.BinaryType())] * decode])
    return in_batches(docs.select(*carry, docs["text"].alias("__text"))).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for; a null list has none."""
    held = _shared(encoded.sparkSession, path, pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(held)
        for batch in batches:
            out = [pairs.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return in_batches(encoded).mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
