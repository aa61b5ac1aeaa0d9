"""Token counts by a compiled finite-state transducer, without building the tokens.

For a BPE with byte fallback, the transducer's state after a prefix holds what decides all that can
follow: the prefix's last token and every unfinished token (its place in the trie, the token before
it, its count relative to the prefix). Reading a character gives the next state and the number of
tokens the prefix gained, which may be negative when a longer token swallows shorter ones. States
and transitions are compiled when first met and kept.

A chunk of text is a map from entry states to (exit state, tokens gained). Chunks are mapped on their
own: where a space follows another character all states lead to one and the same, so the state at a
border follows from the few characters before it, and a chunk's map is that of its head plus a
constant. Maps compose associatively; a text's are composed by a scan in pairs. Should a chunk exit
in a state that the next was not mapped for, the next one's map is extended by it first.

Edge cases: null and empty texts have no tokens; characters that no token holds count their UTF-8
bytes; special strings in a text are ordinary text; a text of any length, with or without spaces, is
cut into chunks; an empty table gives no rows; repeated rows get equal results; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.bpe import MergeTable
from vellumine.llm.memo import Memo
from vellumine.llm.scratch import in_batches

SPACE = "▁"
#: Characters of a chunk; segments kept by each worker, in each of two generations; states compiled.
CHUNK, CACHE, STATES = 1 << 16, 250_000, 200_000


def read_model(path: str) -> tuple[dict[str, float], bool]:
    """Pieces with their scores, and whether a space is put before each text."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and no normalisation are compiled")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(p.type in (4, 5) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("pieces that users define, or that go over a space, aren't compiled")
    return pieces, norm.add_dummy_prefix


class Transducer:
    """States are integers; state 0 has read nothing. ``step[state][char]`` is (state, gain)."""

    def __init__(self, pieces: dict[str, float]):
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.weight = {c: 1 if c in pieces else len(c.encode()) for p in pieces for c in p}
        self.table = MergeTable({p: order[s] for p, s in pieces.items()})
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for p in [*pieces, *self.weight]:
            node = 0
            for c in p:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][c]
            self.token[node] = p
        self.reset()
        self.gain = Memo(lambda segment: self.run(0, segment)[1], CACHE)

    def reset(self) -> None:
        self.states: list[tuple] = [(None, ())]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.step: list[dict[str, tuple[int, int]]] = [{}]

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition from ``state`` by ``c``."""
        last, open_ = self.states[state]
        if c not in self.weight:  # no token holds it: its bytes stand alone and all starts anew
            to = self.step[state][c] = (0, len(c.encode()))
            return to
        found, going = None, []
        for before, node, count in (*open_, (last, 0, 0)):
            node = self.trie[node].get(c)
            if node is None:
                continue
            token = self.token[node]
            if token is not None and found is None and self.table.parts(token) is not None and (before is None or self.table.may_follow(before, token)):
                found = (token, count + (self.weight[token] if len(token) == 1 else 1))
            if self.trie[node]:
                going.append((before, node, count))
        token, gain = found
        key = (token, tuple((b, n, k - gain) for b, n, k in going))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        self.step[state][c] = (to, gain)
        return to, gain

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(state, tokens gained) after ``text``."""
        count, step = 0, self.step
        for c in text:
            to = step[state].get(c)
            state, gain = to if to is not None else self.compile(state, c)
            count += gain
        return state, count


#: From entry states to (exit state, tokens gained).
ChunkMap = dict[int, tuple[int, int]]
_MEETS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
#: Characters before a border that its entry state is looked for in.
LOOK_BACK = 256


def segments(chunk: str) -> list[str]:
    """``chunk`` cut where a space (U+2581) follows another character: from there on all states are as state 0."""
    if SPACE + SPACE in chunk:
        return _MEETS.split(chunk)
    first, *rest = chunk.split(SPACE)
    return [first, *[SPACE + w for w in rest]]


def chunk_map(chunk: str, before: str, entries: set[int], machine: Transducer) -> ChunkMap:
    """The map of ``chunk``, which follows the character ``before``, for some entry states."""
    head, *rest = segments(chunk)
    if chunk[0] == SPACE and (head == "") == (before == SPACE):  # whether its first space is a cut depends on ``before``
        head, *rest = rest if head == "" else ["", head, *rest]
    out = {e: machine.run(e, head) if head else (0, 0) if rest else (e, 0) for e in entries}
    if not rest:
        return out
    inner = sum(map(machine.gain.__getitem__, rest[:-1]))
    state, last = machine.run(0, rest[-1])
    return {e: (state, n + inner + last) for e, (_, n) in out.items()}


def then(first: ChunkMap, second: ChunkMap) -> ChunkMap:
    return {e: (second[x][0], n + second[x][1]) for e, (x, n) in first.items()}


def compose(maps: list[ChunkMap]) -> ChunkMap:
    """All maps in order, joined in pairs, level by level."""
    while len(maps) > 1:
        maps = [then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def entry_state(text: str, border: int, machine: Transducer) -> int:
    """The state at ``border`` as the characters before it tell."""
    seen = text[max(0, border - LOOK_BACK) : border]
    return machine.run(0, segments(seen)[-1])[0]


def count_tokens(text: str, machine: Transducer, spaced: bool, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    if len(machine.states) > STATES:
        machine.reset()  # between texts only, as maps name states
    text = (SPACE if spaced else "") + text.replace(" ", SPACE)
    borders = range(0, len(text), chunk)
    entries = [{entry_state(text, b, machine)} if b else {0} for b in borders]
    one = lambda k, some: chunk_map(text[borders[k] : borders[k] + chunk], text[borders[k] - 1] if k else SPACE, some, machine)
    maps = [one(k, some) for k, some in enumerate(entries)]
    for k in range(1, len(maps)):
        missing = {x for x, _ in maps[k - 1].values()} - maps[k].keys()
        if missing:
            maps[k] |= one(k, missing)
    return compose(maps)[0][1]


_loaded: dict[int, Transducer] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each whole text."""
    pieces, spaced = read_model(path)
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: some thousand pieces
    key = hash((path, len(pieces)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded[key] = Transducer(held.value)
        machine = _loaded[key]
        for batch in batches:
            text = batch.column("text")
            n = [count_tokens(t or "", machine, spaced) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return in_batches(sized).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
