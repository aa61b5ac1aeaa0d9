"""The dealt operators against brute force, on rows with nulls, blanks, copies, ties and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import by_row
from vellumine.llm import bpe, decontam, lines, lm, neardup, pii, rules, sharding, substrings, textarrays, tokcount
from vellumine.llm.queries import QUERIES

SPACE = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# -- 1 ---------------------------------------------------------------------


def test_byte_shards(docs, rows):
    found = sharding.byte_shards(docs, 8).collect()
    sized = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    total, start, counts, want = sum(r[1] for r in sized), 0, Counter(), []
    for i, size, crc in sized:
        shard = 8 * (2 * start + size) // (2 * total)
        want.append((i, size, crc, shard, counts[shard]))
        counts[shard] += 1
        start += size
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)) for r in found)


def test_op1_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_sharding"](spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == want
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)} and {r.shard for r in found} <= set(range(8))
    for shard in range(8):
        own = sorted(r.slot for r in found if r.shard == shard)
        assert own == list(range(len(own)))
    largest = max(size(t) for _, t in rows)
    total = sum(size(t) for _, t in rows)
    assert all(abs(sum(r.size for r in found if r.shard == k) - total / 8) <= largest for k in range(8))


def test_shards_of_equal_rows_and_none(spark, nothing):
    same = spark.createDataFrame([(1, "x" * 9)] * 80, "doc_id long, text string")
    found = sharding.byte_shards(same, 8).collect()
    assert Counter(r.shard for r in found) == {k: 10 for k in range(8)}
    assert sorted((r.shard, r.slot) for r in found) == [(k, s) for k in range(8) for s in range(10)]
    assert sharding.byte_shards(nothing).count() == 0


# -- 2 ---------------------------------------------------------------------


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute_contamination(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = terms(t), set(), set()
        for item, text in items:
            words = terms(text)
            n = min(13, len(words))
            for a in range(len(words) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == words[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items_of(rows):
    texts = [t for _, t in rows if t]
    return [(1, " ".join(terms(texts[0])[:40])), (2, " ".join(terms(texts[65])[20:60])), (20, " ".join(terms(texts[65])[20:60])), (3, "one"), (4, ""), (5, None), (6, "never seen words"), (7, "The of")]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_contamination(spark, docs, rows, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    items = items_of(rows)
    found = decontam.contamination(docs, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_hit int"))
    assert by_row(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == brute_contamination(rows, items)


def test_contamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(nothing, none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a x b x c"), (3, "c b a"), (4, "a x x b c"), (5, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(9, "a b c"), (8, "c")], "item_id long, text string")
    near = decontam.proximity(docs, phrases, 1)
    assert sorted(map(tuple, near.collect())) == [(1, 8, 2), (1, 9, 0), (2, 8, 4), (2, 9, 0), (3, 8, 0), (4, 8, 4)]
    assert (1, 9, 0) in [tuple(r) for r in decontam.proximity(docs, phrases, 0).collect()]


# -- 3 ---------------------------------------------------------------------


def brute_substrings(rows, n):
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for s in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[s : s + n])] < i:
                gone |= set(range(s, s + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gram", "bits"), [(50, 17, 28), (8, 3, 28), (8, 3, 4)])
def test_substrings(docs, rows, nothing, monkeypatch, window, gram, bits):
    monkeypatch.setattr(substrings, "MAX_BITS", bits)  # a full bitmap lets more windows through, with the same result
    found = substrings.remove_repeated(docs, window, gram)
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(rows, window)
    assert substrings.remove_repeated(nothing).count() == 0


def test_word_hashes_follow_words_not_places():
    import pyarrow as pa

    texts = ["a b c", "", " b  c\ta ", None, "ab c", "c" * 3000]
    seen = {}
    for a, b, data, off in textarrays.chunks(pa.array(texts)):
        word, _, first = textarrays.words(data, off)
        for k in range(b - a):
            own = split(texts[a + k])
            assert first[k + 1] - first[k] == len(own)
            for w, h in zip(own, word[first[k] : first[k + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    values = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    assert textarrays.sliding_min(values, 3).tolist() == [3, 1, 1, 1]


# -- 4 ---------------------------------------------------------------------


def slow_base(text):
    """The contract's patterns, with plain regular expressions."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits(m[0])))) % 10 == 0]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Z", ".", ".", "@", "@", "-", "+", " ", "1", "25", "4111111111111111", "é", "(", ")", "\n", "300.1.2.3", "1.2.3.4"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == slow_base(text), text


def test_find_spans(docs, spark, nothing):
    held = spark.createDataFrame([(1, "é mail bob.1@x.example.com or 4111 1111 1111 1111, +1 (555) 555-0100 at 10.0.0.1"), (2, None), (3, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(held).collect()}
    text = "é mail bob.1@x.example.com or 4111 1111 1111 1111, +1 (555) 555-0100 at 10.0.0.1"
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[1].base == ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(text))
    assert got[2].spans == got[3].spans == ""
    assert pii.find_spans(nothing).count() == 0
    assert pii.find_spans(docs).count() == docs.count()


#: Written by hand, in words, places and spellings of their own; what is in double brackets is personal data.
MARKED = [
    ("email", "Please forward the minutes to [[klara.voss (at) nordwind-verlag.de]] before Friday."),
    ("email", "Questions? [[jonas @ brightfield.org]] answers them all."),
    ("email", "The curator ([[m.okafor [at] museum-lagos [dot] org]]) has the catalogue."),
    ("email", "Send invoices to [[billing at harbourline dot com]], thank you."),
    ("email", "Her address was [[zoë_b@lumen.fr]] last year"),
    ("ip", "The router answered from [[172 . 16 . 4 . 21]] yesterday."),
    ("ip", "Blocked host [[203[.]0[.]113[.]77]] after midnight"),
    ("ip", "gateway: [[192 .168 .77 .3]] (old)"),
    ("card", "He paid with [[4539.1488.0343.6467]] in March."),
    ("card", "visa [[4716/1085/9016/8327]] was declined"),
    ("card", "The number [[5500_0055_5555_5559]] is on file."),
    ("phone", "Ring me on [[+44/20/79460958]] after six."),
    ("phone", "phone: [[(212) 555-0187]], ask for Dora"),
    ("phone", "tel [[0049 30 8844217]] during office hours"),
    ("secret", 'client_secret = "[[9f8e7d6c5b4a39281706f5e4d3c2b1a0]]" in the config'),
    ("secret", "export API_KEY=[[Zx81kQpL0vTn5RwYb2Hs6Dg9]] and go on"),
    ("secret", "password: [[c7Tq9ZbLw2XkPv84]]"),
]
CLEAN = [
    "The committee met at noon. Dot matrix printers were discussed, and so was the token gesture.",
    "Version 10.4.2 was released on 2021-03-18 at 14:05:09 with 1,204 fixes.",
    "Invoice 88213 lists 12 items at $4.99 each (total $59.88).",
    "See chapter 3.2.1, pages 114-118, and the footnote on p. 9.",
    "Die Geheimnisse der alten Schlüssel blieben im Turm; niemand fand sie.",
    "commit 3b18e512dba79e4c8300dd08aeb37f8e728b8dad fixes the parser",
    "isbn 978-3-16-148410-0, third edition",
    "### heading *** and %%% junk &&& lines ||| of symbols",
]


def marked(kind, line):
    a = line.index("[[")
    return line.replace("[[", "", 1).replace("]]", "", 1), {(kind, a, line.rindex("]]") - 2)}


def test_tagger_on_lines_of_another_hand():
    """What the patterns miss, by kind: found to the character, or at least touched, and nothing in clean lines."""
    reader = pii.default_tagger().reader()
    lines = [marked(*m) for m in MARKED]
    assert not any(pii.base_spans(t) and {*pii.base_spans(t)} == w for t, w in lines)
    got = [{*pii.all_spans(t, s)} - {*pii.base_spans(t)} for (t, _), s in zip(lines, pii.tagged_spans([t for t, _ in lines], reader), strict=True)]
    exact = sum(len(g & w) for g, (_, w) in zip(got, lines, strict=True))
    touched = sum(any(x[1] < y[2] and y[1] < x[2] for x in g for y in w) for g, (_, w) in zip(got, lines, strict=True))
    assert exact >= 0.6 * len(lines) and touched >= 0.7 * len(lines), (exact, touched)
    assert sum(map(len, got)) <= exact + 4
    for kind in pii.TAGGED:
        assert any(g & w for g, (_, w) in zip(got, lines, strict=True) if {*w} and next(iter(w))[0] == kind), kind
    clean = pii.tagged_spans(CLEAN, reader)
    assert sum(len({*pii.all_spans(t, s)} - {*pii.base_spans(t)}) for t, s in zip(CLEAN, clean, strict=True)) <= 1


def test_tagger_on_held_out_examples():
    model = pii.default_tagger()
    test = pii.labelled_examples(300, seed=77)
    got = pii.tagged_spans([t for t, _ in test], model.reader())
    for kind in pii.TAGGED:
        own = lambda spans: {s for s in spans if s[0] == kind}  # noqa: B023, E731
        right = sum(len(own(a) & own(b)) for a, (_, b) in zip(got, test, strict=True))
        assert right / sum(len(own(a)) for a in got) > 0.8, kind
        assert right / sum(len(own(b)) for _, b in test) > 0.8, kind


def test_tagger_gradients():
    model = pii.Tagger.fresh(1)
    rng = np.random.default_rng(0)
    chars, tags = rng.integers(1, 90, (3, 9)), np.array([[0, 0, 1, 2, 2, 0, 5, 6, 0], [3, 4, 4, 1, 2, 0, 0, 0, 0], [0, 9, 10, 10, 10, 0, 7, 8, 8]])
    _, grads = model.loss_and_gradients(chars, tags)
    for name, w in model.w.items():
        at = (chars[0, 0], 0) if name == "E" else (0,) * w.ndim
        kept = w[at]
        w[at] = kept + 1e-5
        up = model.loss_and_gradients(chars, tags)[0]
        w[at] = kept - 1e-5
        down = model.loss_and_gradients(chars, tags)[0]
        w[at] = kept
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def slow_path(e, model):
    """The best allowed tag path over a whole text, by plain dynamic programming."""
    T, score, back = model.between(), e[0] + np.where(pii._ALLOWED[0], 0, -1e4), []
    for row in e[1:]:
        every = score[:, None] + T
        back.append(every.argmax(0))
        score = every.max(0) + row
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    out, open_ = [], None
    for t, tag in enumerate([*path[::-1], 0]):
        if open_ and tag != open_[0] + 1:
            out.append((pii.TAGS[open_[0]][2:], open_[1], t))
            open_ = None
        if tag % 2:
            open_ = (tag, t)
    return out


def test_one_path_over_whole_texts():
    """Passing over what can't be in a span gives the best path of the whole text, whatever the scores."""
    model, rng = pii.default_tagger(), np.random.default_rng(8)
    reader = model.reader()
    texts = ["".join(t for t, _ in pii.labelled_examples(30, seed=k)) for k in range(3)]
    codes = [pii.classes(t) for t in texts]
    scores = [reader.emissions(c[:, None].astype(np.intp))[:, 0] for c in codes] + [rng.normal(0, s, (60, len(pii.TAGS))).astype(np.float32) for s in (0.3, 1, 3, 3, 5)] + [np.zeros((0, len(pii.TAGS)), np.float32)]
    for e, got in zip(scores, reader.decode(scores), strict=True):
        assert sorted(got) == (sorted(slow_path(e.astype(float), model)) if len(e) else [])


def test_windows_agree_with_the_whole_text():
    reader = pii.default_tagger().reader()
    for seed in range(4):
        text = " ".join(t for t, _ in pii.labelled_examples(40, seed=seed))
        whole = reader.decode([reader.emissions(pii.classes(text)[:, None].astype(np.intp))[:, 0]])[0]
        cut = pii.tagged_spans([text], reader)[0]
        assert len({*whole} & {*cut}) >= 0.9 * max(len(whole), len(cut), 1)
        assert pii.tagged_spans([text, "x", "", text], reader)[::3] == [cut, cut]  # from the text alone


def test_spans_do_not_depend_on_neighbours():
    """Where two windows meet, the window that a character is more central in counts, whatever is tagged beside the text."""
    reader, rng = pii.default_tagger().reader(), np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcde  @.0123-+()="), 590)) for _ in range(20)]  # the second window is as short as that of "x"
    beside = pii.tagged_spans(["x", *texts], reader)[1:]
    assert sum(map(len, beside)) > 100
    assert [sorted(s) for s in beside] == [sorted(pii.tagged_spans([t], reader)[0]) for t in texts]


def test_emissions_are_those_of_training():
    model, rng = pii.default_tagger(), np.random.default_rng(1)
    chars = rng.integers(0, pii._CLASSES, (70, 3))
    x = model.w["E"][chars.T]
    want = np.concatenate([model._lstm(x, way)[0] for way in "fb"], 2) @ model.w["V"] + model.w["c"]
    assert np.abs(model.reader().emissions(chars).transpose(1, 0, 2) - want).max() < 1e-3


def test_scores_of_a_span_are_asked_for_only_where_it_may_stand():
    model = pii.default_tagger()
    reader, asked = model.reader(), []
    text = "plain words of a text, and some more of them. " * 20 + "mail bob (at) example.org today, " + "and plain words after it " * 20
    e = reader.emissions(pii.classes(text)[:, None].astype(np.intp))[:, 0]

    def scores(row, a, b):
        asked.append(b - a)
        return e[a:b]

    assert sorted(reader.search([reader.gains(e)], scores)[0]) == sorted(slow_path(e.astype(float), model))
    assert 0 < sum(asked) < 0.1 * len(text)


def test_op4_query(spark, rows, tmp_path):
    more = [(1000 + k, marked(*m)[0]) for k, m in enumerate(MARKED)] + [(2000, "mail a.b@c.org, card 4111 1111 1111 1111 or +1 (555) 555-0100 from 10.0.0.1")]
    spark.createDataFrame([*rows, *more], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = by_row(QUERIES["op4_personal_data"](spark, str(tmp_path)), "doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans", "n_added", "n_secret")
    reader, want, joined = pii.default_tagger().reader(), [], lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for i, t in [*rows, *more]:
        base = slow_base(t or "")
        every = pii.all_spans(t or "", pii.tagged_spans([t or ""], reader)[0])
        assert {*base} <= {*every}
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.KINDS), sha(joined(base)), joined(every), len(every) - len(base), sum(s[0] == "secret" for s in every)))
    assert found == sorted(want, key=repr)
    assert sum(w[-2] for w in want) >= 10


# -- 5 ---------------------------------------------------------------------


def brute_lines(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or n[key(x)] < least]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [lines.BROADCAST_KEYS, 0])
@pytest.mark.parametrize("least", [2, 10])
@pytest.mark.parametrize("shard", [3, 1 << 18])
def test_lines(docs, rows, nothing, monkeypatch, keys, least, shard):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", shard)
    clashing = docs.selectExpr("doc_id", "text", "lang as text_hash", "lang as gone", "1 as d", "2 as n_lines")
    found = lines.drop_frequent_lines(clashing, least, carry=("text_hash", "gone", "d", "n_lines"), broadcast_keys=keys)
    assert found.columns == ["doc_id", "text", "text_hash", "gone", "d", "n_lines", "n_dropped"]
    assert by_row(found, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, least)
    found = lines.drop_frequent_lines(docs, least, carry=("lang", "hi"), broadcast_keys=keys)
    assert found.columns == ["doc_id", "text", "lang", "hi", "n_lines", "n_dropped"]
    assert by_row(found, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, least)
    assert lines.drop_frequent_lines(nothing, broadcast_keys=keys).count() == 0


def test_line_index_is_reversible(docs, rows):
    half = docs.filter("doc_id % 2 = 0 or doc_id is null")
    rest = docs.filter("doc_id % 2 = 1")
    whole = lines.LineIndex.build(docs, 3)
    grown = lines.LineIndex.build(half, 3).insert(rest)
    back = grown.delete(rest)
    table = lambda i: by_row(i.counts, "hi", "lo", "n_docs")
    assert table(grown) == table(whole)
    assert table(back) == table(lines.LineIndex.build(half, 3))
    assert by_row(grown.apply(docs), "doc_id", "text", "n_dropped") == by_row(whole.apply(docs), "doc_id", "text", "n_dropped")
    assert by_row(back.apply(half), "doc_id", "text") == by_row(lines.LineIndex.build(half, 3).apply(half), "doc_id", "text")
    with pytest.raises(ValueError):
        back.delete(rest)


def test_only_lines_that_pass_a_filter_meet_the_counts(docs, rows):
    index = lines.LineIndex.build(docs, 2)
    asked = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    frequent, passed = index.frequent().count(), index._maybe_frequent(asked)
    assert 0 < passed.select("hi", "lo").distinct().count() <= 1.1 * frequent + 2 < index.counts.count()
    assert passed.join(index.frequent(), ["hi", "lo"], "left_semi").select("hi", "lo").distinct().count() == frequent


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    f = lines.built(hi, lo)
    assert f.contains(hi, lo).all()
    f.delete(hi[:1500], lo[:1500])
    assert f.contains(hi[1500:], lo[1500:]).all()
    assert f.contains(hi[:1500], lo[:1500]).mean() < 0.01
    assert lines.CuckooFilter.from_bytes(f.to_bytes()).contains(hi[1500:], lo[1500:]).all()


# -- 6 and 10 --------------------------------------------------------------

ODD = ["", "a", "  a  b", "\n\n x", "▁ x", "日本語 テキスト", "🙂🙂 ok", "a" * 300, " " * 200 + "x", "\x00\x01 t", "I've don't 's", "tab\t\ttab\r\n", "ééé́", "<s> </s> <unk> <|endoftext|>", "x  \n  y"]


def odd_texts(rows, n=400):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab  \n▁thé日🙂 0'") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return ODD + made + [t for _, t in rows if t]


def test_token_counts_match_the_library(rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, spaced = tokcount.read_model(path)
    machine = tokcount.Transducer(pieces)
    for text in odd_texts(rows):
        for chunk in (7, 1 << 16) if len(text) < 500 else (1000, 1 << 16):
            assert tokcount.count_tokens(text, machine, spaced, chunk) == len(library.encode(text)), text[:80]


def test_chunk_maps_compose_in_any_order():
    pieces, spaced = tokcount.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    machine, rng = tokcount.Transducer(pieces), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", tokcount.SPACE, tokcount.SPACE, "日", "x", "aaaa", "\n"]) for _ in range(40))
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(5))})
        entries, maps = {0, machine.run(0, "th")[0], machine.run(0, "aaa")[0]}, []
        want = {e: machine.run(e, text) for e in entries}
        for a, b in zip(cuts, cuts[1:]):
            maps.append(tokcount.chunk_map(text[a:b], text[a - 1] if a else tokcount.SPACE, entries, machine))
            entries = {x for x, _ in maps[-1].values()}
        left = maps[0]
        for m in maps[1:]:
            left = tokcount.then(left, m)
        assert {e: n for e, (_, n) in left.items()} == {e: n for e, (_, n) in tokcount.compose(maps).items()} == {e: n for e, (_, n) in want.items()}


def test_token_counts_query_shape(docs, rows, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in rows), key=repr)
    assert by_row(tokcount.token_counts(docs, path, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokcount.token_counts(nothing, path).count() == 0


@pytest.fixture(scope="module")
def pairs():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.BytePairs(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(pairs):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ids, special_tokens={})


def test_bpe_matches_the_library(rows, pairs, tiktoken_encoding):
    for text in odd_texts(rows):
        ids = pairs.encode(text)
        assert ids == tiktoken_encoding.encode_ordinary(text), text[:80]
        assert pairs.decode(ids) == text.encode()


def test_drafts_append_and_edit_exactly(pairs, tiktoken_encoding):
    rng = random.Random(5)
    for _ in range(150):
        draft, text = bpe.Draft(pairs), ""
        for _ in range(6):
            new = "".join(rng.choice("ab  \nthé's9") for _ in range(rng.randint(0, 8)))
            if rng.random() < 0.5:
                draft.append(new)
                text += new
            else:
                a = rng.randint(0, len(text))
                b = rng.randint(a, min(len(text), a + 4))
                draft.replace(a, b, new)
                text = text[:a] + new + text[b:]
            assert draft.text == text
            assert draft.ids() == tiktoken_encoding.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["'velrdtms I", "ab  \n\t9'", "w e'l\u00a0\r\n", "é日've 12!?"])
def test_drafts_by_any_alphabet(pairs, tiktoken_encoding, alphabet):
    rng = random.Random(11)
    for _ in range(120):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        draft = bpe.Draft(pairs, text)
        for _ in range(8):
            new = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4)))
            a = rng.randint(0, len(text))
            b = rng.choice([a, a, min(len(text), a + rng.randint(1, 6))])
            draft.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert draft.text == text
            assert draft.ids() == tiktoken_encoding.encode_ordinary(text), text


def test_drafts_of_known_contractions(pairs, tiktoken_encoding):
    draft = bpe.Draft(pairs, "I'v")
    draft.append("e")
    assert draft.ids() == tiktoken_encoding.encode_ordinary("I've")
    draft = bpe.Draft(pairs, "we'l done")
    draft.replace(4, 4, "l")
    assert draft.ids() == tiktoken_encoding.encode_ordinary("we'll done")


def test_every_split_of_a_sample_in_two(pairs, tiktoken_encoding):
    sample = "we've  said\t12 it's\n\n they'll  'd go\u2003é日本!! "
    want = tiktoken_encoding.encode_ordinary(sample)
    for k in range(len(sample) + 1):
        draft = bpe.Draft(pairs, sample[:k])
        draft.append(sample[k:])
        assert draft.ids() == want


def test_op10_query(spark, rows, tmp_path, tiktoken_encoding):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = by_row(QUERIES["op10_byte_bpe"](spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = [(i, tiktoken_encoding.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert found == sorted(((i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, x, t in ids), key=repr)


def test_bpe_round_trip(docs, rows, nothing, tiktoken_encoding):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.decode_documents(bpe.encode_documents(docs, path, pattern, ("doc_id", "n_words")), path, pattern)
    want = sorted(((i, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found.collect()), key=repr) == want
    assert bpe.encode_documents(nothing, path, pattern).count() == 0


# -- 7 ---------------------------------------------------------------------


def brute_groups(rows, n, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((i, len(sets[i]), root(i) if i is not None else None, i is None or root(i) == i) for i, _ in rows), key=repr)


@pytest.mark.parametrize("block", [neardup.BLOCK, 4])
@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, n, percent, block):
    found = neardup.near_duplicates(docs, n, percent, block)
    want = brute_groups(rows, n, percent)
    got = by_row(found, "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert [(r[0], r[2], r[3]) for r in got if r[0] is None] == [(None, None, True)]


def test_near_duplicates_of_none(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [256, 10])
def test_a_hub_whose_copies_are_not_linked(spark, block):
    """Copies near a hub but not near each other: one component, in blocks or not."""
    hub = [f"h{k}" for k in range(300)]
    texts = [" ".join(hub)]
    for c in range(60):
        words = list(hub)
        for k in range(6):  # six changed words of 300: linked to the hub, not to another copy
            words[(c * 7 + k * 50) % 300] = f"c{c}x{k}"
        texts.append(" ".join(words))
    rows = [(900 - k if k else 950, t) for k, t in enumerate(texts)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, 3, 85)


@pytest.mark.parametrize("rows", [7, 400])
@pytest.mark.parametrize("limit", [2, 16, 4096])
def test_regions_over_the_limit_stay_linked(monkeypatch, limit, rows):
    """Signatures that share LEAST_DEPTH values are linked, however large their region, in one batch or many."""
    monkeypatch.setattr(neardup, "REGION", limit)
    rng = np.random.default_rng(5)
    key = np.hstack([rng.integers(0, 3, (400, 1)), rng.integers(0, 2, (400, neardup.DEPTH))])
    key = key[np.lexsort(key.T[::-1])]
    ids = rng.permutation(400)
    table = pa.table({"tree": pa.array(key[:, 0], pa.int32()), "signature": pa.array([k.astype(">u2").tobytes() for k in key[:, 1:]], pa.binary()), "doc_id": pa.array(ids)})
    parent = dict(zip(ids.tolist(), ids.tolist(), strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for batch in neardup._regions(iter(table.to_batches(rows))):
        for r in batch.filter(batch.column("glue").is_null()).to_pylist():
            parent[root(r["u"])] = root(r["v"])
    got, want = {}, {}
    for i, k in zip(ids.tolist(), key.tolist(), strict=True):
        got.setdefault(root(i), set()).add(i)
        want.setdefault(tuple(k[: 1 + neardup.LEAST_DEPTH]), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# -- 8 ---------------------------------------------------------------------


SMALL = {"batch_tokens": 700, "shard_bytes": 2000}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_lm_base_scores(docs, rows, nothing, sizes):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    toks = [[*split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    c = Counter(w for (i, _), w_ in zip(rows, toks, strict=True) if not held(i) for w in w_)
    n, v = sum(c.values()), len(c)
    want = {(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for (i, _), w in zip(rows, toks, strict=True)}
    found = lm.scores(docs, **sizes).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found} == want
    assert len(found) == len(rows)
    assert all(-1e9 < r.score < 0 for r in found)
    assert lm.scores(nothing, **sizes).count() == 0


def test_lm_without_training_documents(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = lm.scores(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_lm_filter_never_underestimates():
    rng = np.random.default_rng(2)
    key, c = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(1, 5000, 500)
    model = lm.LogFrequencyFilter.of(key, c)
    got, true = model.levels(key), lm.LogFrequencyFilter.level(c)
    assert (got >= true).all()
    assert (got == true).mean() > 0.95
    assert (model.levels(rng.integers(0, 2**63, 2000, dtype=np.uint64)) > 0).mean() < 0.02
    assert (lm._unpack(lm._pack(key)) == key % 2**40).all()
    assert (lm._unsqueezed(lm._squeezed(c)) == c).all() and not len(lm._unsqueezed(lm._squeezed(c[:0])))


def test_lm_probabilities_after_a_word_sum_to_about_one():
    """Quantised counts are within half a step of the true ones, so the sum is within one step of 1."""
    rng = random.Random(4)
    text = [rng.choice("abcdefghij") for _ in range(3000)]
    one, two = Counter(text), Counter(zip(text, text[1:], strict=False))
    level = lambda c: lm.LogFrequencyFilter.level(np.array([c]))[0] if c else 0
    for b in one:
        levels = np.array([[level(one[w]), level(one[b]), level(two[b, w])] for w in one])
        total = (10 ** lm.log_probabilities(*levels.T, len(text), len(one))).sum()
        assert 1 / lm.STEP < total < lm.STEP


def test_lm_prefers_what_it_has_seen(spark):
    text = "the cat sat on the mat and the dog ran off"
    rows = [(k, text) for k in range(40)] + [(100, "mat the off ran sat and on cat the dog the"), (101, text)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[101].score > got[100].score + 1
    assert abs(got[101].base_score - got[100].base_score) < 1e-9


def quantised_lm(rows):
    """Sorted (doc_id, score) from exact counts of all training words and pairs, quantised."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    toks = [[None, *split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    train = [w for (i, _), w in zip(rows, toks, strict=True) if not held(i)]
    one, two = Counter(x for w in train for x in w[1:]), Counter(x for w in train for x in zip(w[:-1], w[1:], strict=True))
    n, v = sum(one.values()), len(one)
    q = lambda c: lm.STEP ** (math.floor(math.log(c) / math.log(lm.STEP) + 1e-9) + 0.5) if c else 0

    def p(b, t):
        alone = (q(one[t]) + 1) / (n + v + 1)
        return lm.MIX * min(q(two[b, t]) / q(one[b]), 1) + (1 - lm.MIX) * alone if one[b] else alone

    return sorted(((i, sum(math.log10(p(b, t)) for b, t in zip(w[:-1], w[1:], strict=True))) for (i, _), w in zip(rows, toks, strict=True)), key=repr)


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("bits", [lm.BITS_PER_PROBE, 100])
def test_lm_scores_from_every_word_and_pair(docs, rows, sizes, bits):
    """However batches and shards are cut, the score has all n-grams; only the filter may take an n-gram for a more frequent one."""
    got, want = by_row(lm.scores(docs, bits_per_probe=bits, **sizes), "doc_id", "score"), quantised_lm(rows)
    by_id = lambda found: sorted(found, key=lambda r: (repr(r[0]), r[1]))
    off = np.array([g[1] - w[1] for g, w in zip(by_id(got), by_id(want), strict=True)])
    if bits == 100:
        assert np.abs(off).max() < 1e-6
    tokens = sum(len(split(t)) + 1 for _, t in rows)
    assert np.abs(off).sum() < 0.01 * tokens


# -- 9 ---------------------------------------------------------------------


def brute_rules(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = split(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        ls = [x for x in t.split("\n") if split(x)]
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(again)))
    return sorted(out, key=repr)


def test_rule_measurements(docs, rows, nothing):
    found = rules.ledger(docs)
    assert by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == brute_rules(rows)
    assert rules.ledger(nothing).count() == 0
    kept = rules.passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == found.filter("failures = 0").count()


def test_policies_read_the_ledger(docs):
    rows = rules.ledger(docs).cache()
    total = rows.count()
    base, full = (rows.filter(rules.verdict(p)).count() for p in (rules.BASE, rules.DEFAULT))
    assert 0 < full <= base < total
    both = rules.compare(rows, rules.BASE, rules.DEFAULT).first()
    assert both.kept_by_both == full and both.newly_rejected == base - full and both.newly_kept == 0
    cost = {r.rule: r for r in rules.ablation(rows).collect()}
    for rule in rules.RULES:
        without = rules.Policy("x", tuple(r.name for r in rules.RULES if r != rule))
        alone = rows.filter(rules.verdict(without)).count() - full
        assert (cost[rule.name].rejected_alone if rule.name in cost else 0) == alone


def test_native_operators_run_no_python(spark, docs):
    plan = rules.ledger(docs)._jdf.queryExecution().toString() + sharding.sized(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert docs.select(F.lit(1)).count()
