"""Personal data: exact patterns, and a character BiLSTM-CRF that adds what the patterns miss.

The tagger is a bidirectional LSTM over characters with CRF transitions between BIO tags, trained
here in numpy by gradient descent on the CRF likelihood of labelled spans. The spans it learns from
are given, or drawn by ``labelled_examples``: addresses, numbers, phones and secrets in usual and
unusual spellings amid invented prose and harmless numbers, ``EXAMPLES`` of them.

It reads every character of every text. Overlapping windows give emission scores, each character
takes those of the window it is most central in, and one path over the whole text reconciles them.
A tagged span is added if it touches no pattern match and keeps the limits of its kind (digits
that pass Luhn, four numbers up to 255, ten to fifteen digits); a secret is of a kind of its own.

Edge cases: a null text is empty and has no spans; offsets are code points, ends exclusive; matches
are leftmost and do not overlap within a kind, but kinds may overlap each other; spans follow from
the text alone, so repeated rows get equal results; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumine.llm.scratch import in_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the tagger knows: those of the patterns, and secrets (keys, tokens, passwords).
TAGGED = (*KINDS, "secret")
TAGS = ["O", *(f"{p}-{k}" for k in TAGGED for p in "BI")]
#: Training examples, training passes, LSTM units each way, embedding width.
EXAMPLES, PASSES, UNITS, EMBED = 3000, 18, 8, 10
#: Characters of a window, and of what its neighbour sees better at either end.
WINDOW, MARGIN = 512, 16
_CLASSES = 98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign once: the run before it, back to the last match, and a dotted domain after it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = at = domain.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of pattern matches that hold, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        # four digits without leading zeros decide: int() would refuse thousands of digits
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.groups())]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled_examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their spans: prose of random words and harmless numbers, with personal data in usual and unusual spellings."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    some = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(rng.integers(a, b)))
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    scripts = ("etaoinshrdlu", "etaoinshrdlucmfwypvbgk", "enisratdhulcgmobwfkzäöüß", "eaosrnidltcmupbgvyqhfzjxñíóé", "esaitnrulodcpméèàçêvqfbghjx", "абвгдеиклмнопрст")

    def word() -> str:
        w = some(pick(scripts), 1, 10)
        return pick([w, w, w, w, w.title(), w.upper(), w + pick(["***", "%%%", "$$$", "&&&", "###", "!!!", "...", "++", "'s"])])

    def name() -> str:
        return pick([some(scripts[1], 2, 9), some(scripts[1], 1, 6) + pick("._-") + some(scripts[1], 2, 8), some(scripts[1], 2, 7) + number(rng.integers(1, 4))])

    def domain(dot: str) -> str:
        host = [some(scripts[1], 2, 10) + pick(["", "", "-" + some(scripts[1], 2, 6), number(1)]) for _ in range(rng.integers(1, 3))]
        return dot.join([*host, pick(["com", "org", "net", "de", "es", "fr", "edu", "co.uk", "info"])])

    def email() -> str:
        at, dot = pick([("@", "."), (" @ ", "."), (" @ ", " . "), ("(at)", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), ("[@]", "."), ("@ ", "."), (" @", "."), ("＠", ".")])
        return (name() if rng.random() < 0.8 else some("éñüöàabcdelmn", 3, 9)) + at + domain(dot)

    def ip() -> str:
        return pick([".", ".", " . ", "[.]", "(.)", " .", ". ", ","]).join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        head = pick("3456") + number(rng.integers(13, 16))
        full = next(head + str(d) for d in range(10) if luhn(head + str(d)))
        return pick(["", " ", "-", ".", "/", "_", "  ", " - ", ":"]).join(full[i : i + 4] for i in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        plus = pick([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)}/{a}{b}/{c}", f"+ {number(2)} {a}.{b}{c}", f"+{number(2)}-{a}-{b}-{c}", f"+{number(2)}{a}{b}{c}", f"+{number(2)} {a}/{b}{c}", f"+{number(2)}_{a}_{b}_{c}"])
        called = pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
        return plus if rng.random() < 0.6 else called

    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def secret() -> tuple[str, str, str]:
        """What stands before it, the secret itself, what stands after it. Some kinds of key show by how they begin."""
        if rng.random() < 0.3:
            return "", pick(["AKIA" + some(mixed[:26] + "0123456789", 16, 17), "sk_live_" + some(mixed, 20, 32), "ghp_" + some(mixed, 30, 40)]), ""
        value = pick([some(hexes, 24, 65), some(hexes, 40, 41), some(mixed, 16, 48), "sk_" + some(mixed, 16, 40), some(mixed + "-_", 20, 60)])
        key = pick(["token", "key", "secret", "password", "api_key", "apikey", "passwd", "access_token", "auth", "API_TOKEN", "SECRET_KEY", "pwd", "credential"])
        quote = pick(['"', '"', "'", ""])
        return key + pick([" = ", "=", ": ", ":", " := ", " => "]) + quote, value, quote

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    before = {"email": ["mail ", "write to ", "contact: ", "<", ""], "ip": ["host ", "from ", "ip=", "(", ""], "card": ["card ", "visa ", "no. ", "pay with ", ""], "phone": ["tel ", "call ", "phone: ", "Tel.: ", "fax "]}
    harmless = (
        *(lambda: number(rng.integers(1, 8)), lambda: f"{number(2)}.{number(2)}", lambda: f"{some(scripts[1], 2, 6)}@", lambda: f"@{some(scripts[1], 2, 9)}", lambda: f"{number(1)},{number(3)},{number(3)}"),
        *(lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(rng.integers(9, 22))}", lambda: f"commit {some(hexes, 40, 41)}", lambda: f"md5 {some(hexes, 32, 33)}", lambda: f"{number(2)}:{number(2)}:{number(2)}"),
        *(lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"({number(4)})", lambda: f"{number(3)}-{number(3)}", lambda: f"https://{domain('.')}/{some(scripts[1], 2, 9)}?{some(scripts[1], 1, 4)}={number(5)}", lambda: f"{some(scripts[1], 2, 9)}_{some(scripts[1], 2, 9)} = {number(2)}"),
        *(lambda: f"isbn {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"the {pick(['token', 'key', 'secret', 'password'])} {word()}", lambda: "=" * rng.integers(2, 30), lambda: "-" * rng.integers(2, 30), lambda: some("*%$&#|<>", 2, 9), lambda: f"meet at {word()} dot {word()}"),
        *(lambda: f"{some(scripts[1], 2, 6)}{number(3)}{some(scripts[1], 1, 5)}", lambda: f"{number(1)}. {word()}", lambda: f"${number(3)}.{number(2)}", lambda: "\n\n", lambda: f"{word()}, {word()}; {word()}:", lambda: f"§{number(2)}.{number(1)}.{number(1)}", lambda: f"<{some(scripts[1], 1, 5)} id=\"{some(scripts[1], 2, 8)}\">"),
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 5)):
            text += "".join(word() + pick([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.integers(0, 6)))
            if rng.random() < 0.5:
                kind = pick(TAGGED)
                lead, made, tail = secret() if kind == "secret" else (pick(before[kind]), makers[kind](), "")
                text += lead
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + tail + pick([" ", " ", ".", ", ", "\n", ")", ""])
                text += "" if text[-1] in " \n" else " "
            elif rng.random() < 0.7:
                text += pick(harmless)() + pick([" ", " ", "\n"])
        out.append((text, spans))
    return out


_CLASS_OF = np.full(128, _CLASSES - 1, np.uint8)
_CLASS_OF[32:127] = np.arange(1, 96)
_CLASS_OF[9:14] = _CLASSES - 2


def classes(text: str) -> np.ndarray:
    """0: padding; printable ASCII by itself; one class for spaces other than the blank, one for all else."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS_OF[np.minimum(code, 127)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _allowed() -> np.ndarray:
    """Tags that may follow each tag: an inside only its own kind's begin or inside."""
    out = np.ones((len(TAGS), len(TAGS)), bool)
    for k, kind in enumerate(TAGGED):
        out[:, 2 * k + 2] = False
        out[[TAGS.index("B-" + kind), TAGS.index("I-" + kind)], 2 * k + 2] = True
    return out


_ALLOWED = _allowed()
#: The weight of characters by themselves in the loss.
ALONE = 0.3
#: Transition weights stay within this of 0, which keeps what a neighbour's tag can change small.
REACH = 0.25


@dataclass
class Tagger:
    """Weights by name: embedding ``E``; each way's ``W`` (in), ``U`` (recurrent), ``b``; ``V``, ``c`` out; ``T`` between tags."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        w = {"E": rng.normal(0, 0.5, (_CLASSES, EMBED)), "V": draw(2 * UNITS, len(TAGS)), "c": np.zeros(len(TAGS)), "T": np.zeros((len(TAGS), len(TAGS)))}
        for way in "fb":
            w |= {"W" + way: draw(EMBED, 4 * UNITS), "U" + way: draw(UNITS, 4 * UNITS), "b" + way: np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)}
        return cls(w)

    def between(self) -> np.ndarray:
        return np.where(_ALLOWED, self.w["T"], -1e4)

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Outputs (batch, time, units) and what backpropagation needs."""
        n, steps, _ = x.shape
        pre = x @ self.w["W" + way] + self.w["b" + way]
        h, c, trail, out = np.zeros((n, UNITS)), np.zeros((n, UNITS)), [], np.zeros((n, steps, UNITS))
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w["U" + way]
            gates = _sigmoid(z[:, : 3 * UNITS])
            i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
            g = np.tanh(z[:, 3 * UNITS :])
            before, last = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            trail.append((t, i, f, o, g, s, before, last))
            out[:, t] = h
        return out, trail

    def _lstm_back(self, x: np.ndarray, way: str, trail: list, grad: np.ndarray, into: dict) -> np.ndarray:
        dx, dh, dc = np.zeros_like(x), np.zeros((len(x), UNITS)), np.zeros((len(x), UNITS))
        for t, i, f, o, g, s, before, last in reversed(trail):
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)])
            into["W" + way] += x[:, t].T @ dz
            into["U" + way] += last.T @ dz
            into["b" + way] += dz.sum(0)
            dx[:, t] = dz @ self.w["W" + way].T
            dh, dc = dz @ self.w["U" + way].T, dc * f
        return dx

    def loss_and_gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative CRF log-likelihood of a batch of equal-length windows, and ``ALONE`` times that of each character by itself.

        The second term keeps inside tags low where nothing begins, so that reading can pass over most of a text.
        """
        n, steps = chars.shape
        x, T = self.w["E"][chars], self.between()
        (hf, tf), (hb, tb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([hf, hb], 2)
        e = both @ self.w["V"] + self.w["c"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(T + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(steps)
        gold = e[rows, cols, tags].sum(1) + T[tags[:, :-1], tags[:, 1:]].sum(1)
        single = _lse(e, 2)
        de = np.exp(alpha + beta - z[:, None, None]) + ALONE * np.exp(e - single[:, :, None])
        de[rows, cols, tags] -= 1 + ALONE
        de /= n
        into = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps):
            into["T"] += np.exp(alpha[:, t - 1, :, None] + T + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0) / n
        np.add.at(into["T"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1 / n)
        into["V"] += both.reshape(-1, 2 * UNITS).T @ de.reshape(-1, len(TAGS))
        into["c"] += de.sum((0, 1))
        dboth = de @ self.w["V"].T
        dx = self._lstm_back(x, "f", tf, dboth[:, :, :UNITS], into) + self._lstm_back(x, "b", tb, dboth[:, :, UNITS:], into)
        np.add.at(into["E"], chars, dx)
        alone = (single - e[rows, cols, tags]).sum(1)
        return float((z - gold + ALONE * alone).mean()), into

    def reader(self) -> Reader:
        return Reader(self)


#: Characters of parts that are searched together, padding included.
_SEARCHED = 1 << 15


class Reader:
    """A tagger's weights laid out for reading, in single precision.

    Each way's step is one product: outputs, embedding and a constant one stand beside each other.
    """

    def __init__(self, model: Tagger):
        w = model.w
        halves = np.repeat([0.5, 0.5, 0.5, 1.0], UNITS)  # twice a sigmoid is a tanh of half its argument, plus one
        single = lambda *blocks: np.ascontiguousarray(np.hstack(blocks), np.float32)
        again = {way: (w["U" + way] * halves).T / 2 for way in "fb"}  # outputs stay doubled
        into = {way: np.vstack([w["W" + way], w["b" + way]]).T * halves[:, None] for way in "fb"}
        self.embedding = np.vstack([w["E"].T, np.ones(_CLASSES)]).astype(np.float32)
        self.step = {"f": single(again["f"], into["f"]), "b": single(into["b"], again["b"])}
        self.out = {"f": single(w["V"][:UNITS].T / 2), "b": single(w["c"][:, None], w["V"][UNITS:].T / 2)}
        self.between = model.between()
        least, most, outside = w["T"][_ALLOWED].min(), w["T"][_ALLOWED].max(), w["T"][0, 0]
        self.more = float(most - outside)  # a transition over that between outside tags
        self.slack = float(2 * (outside - least) + self.more)

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores (time, windows, tags) of character classes (time, windows); in memory, windows stand last."""
        steps, n = chars.shape
        own, back = UNITS + EMBED, UNITS + EMBED + 1
        # row t + 1: forward outputs up to the character before t, embedding of t, one, backward outputs from the one after
        held = np.empty((steps + 2, back + UNITS, n), np.float32)
        for t in range(steps):
            np.take(self.embedding, chars[t], axis=1, out=held[t + 1, UNITS:back], mode="clip")
        held[1, :UNITS] = held[steps, back:] = 0
        held[0, own] = 1
        z, more = np.empty((4 * UNITS, n), np.float32), np.empty((UNITS, n), np.float32)
        gates, (i, f, o, g) = z[: 3 * UNITS], z.reshape(4, UNITS, n)
        one, half = np.float32(1), np.float32(0.5)
        for way, read, write, order in (("f", slice(0, back), slice(0, UNITS), range(1, steps + 1)), ("b", slice(UNITS, None), slice(back, None), range(steps, 0, -1))):
            step, on, c = self.step[way], 1 if way == "f" else -1, np.zeros((UNITS, n), np.float32)
            for t in order:
                np.matmul(step, held[t, read], out=z)
                np.tanh(z, out=z)
                np.add(gates, one, out=gates)  # twice each gate
                np.multiply(i, g, out=more)
                np.multiply(c, f, out=c)
                np.add(c, more, out=c)
                np.multiply(c, half, out=c)
                h = held[t + on, write]
                np.tanh(c, out=h)
                np.multiply(h, o, out=h)
        e = np.matmul(self.out["f"], held[2:, :UNITS])
        e += np.matmul(self.out["b"], held[:-2, own:])
        return e.transpose(0, 2, 1)

    def gains(self, e: np.ndarray) -> np.ndarray:
        """For scores (..., tags), what the best begin and the best inside of any kind gain over outside: (2, ...)."""
        outside = e[..., 0] - np.float32(self.more)
        return np.stack([e[..., 1::2].max(-1) - outside, e[..., 2::2].max(-1) - outside])

    def gains_by_kind(self, e: np.ndarray) -> np.ndarray:
        """For scores (time, tags), what begin and inside of each kind gain over outside: (2, kinds, time)."""
        e = np.ascontiguousarray(e.T)
        return (e[1:] - (e[0] - np.float32(self.more))).reshape(-1, 2, e.shape[1]).transpose(1, 0, 2)

    def open_parts(self, gains: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a text, given its gains (2, time) or (2, kinds, time), that a span may stand in.

        A span that stands in the best path gains more over outside tags than transitions can give
        back without it. The most that any span over a character can gain follows from running sums,
        so most characters are outside for certain; a path searched between them is that of the
        whole text. Gains of no kind are as if kinds could change within a span, which opens more.
        """
        run = np.cumsum(gains[1], -1, np.float64)
        until = run + np.maximum.accumulate(gains[0] - run, -1)  # the best span that ends here
        after = np.maximum.accumulate(run[..., ::-1], -1)[..., ::-1] - run  # what it can gain by going on
        most = until + after
        open_ = np.zeros(most.shape[-1] + 2, bool)
        open_[1:-1] = (most if most.ndim == 1 else most.max(0)) >= -self.slack
        edges = np.flatnonzero(open_[1:] != open_[:-1]).tolist()
        return list(zip(edges[::2], edges[1::2], strict=True))

    def decode(self, texts: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        """The spans of the best tag path over each whole text's scores (time, tags)."""
        return self.search([self.gains(e) for e in texts], lambda row, a, b: texts[row][a:b])

    def search(self, gains: list[np.ndarray], scores: Callable[[int, int, int], np.ndarray]) -> list[list[tuple[str, int, int]]]:
        """``decode``, given each text's gains; ``scores(row, a, b)`` is asked only where a span may stand."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in gains]
        parts = []
        for row, gain in enumerate(gains):
            for a, b in self.open_parts(gain):
                e = scores(row, a, b)
                parts += [(d - c, row, a + c, e[c:d]) for c, d in self.open_parts(self.gains_by_kind(e))]
        parts.sort(key=lambda p: p[:3], reverse=True)
        while parts:
            n = max(1, min(len(parts), _SEARCHED // parts[0][0]))
            for (_, row, a, _), path in zip(parts[:n], self._paths([(e, a == 0, a + size == gains[row].shape[1]) for size, row, a, e in parts[:n]]), strict=True):
                open_ = None
                for t, tag in enumerate([*path, 0]):
                    if open_ and tag != open_[0] + 1:
                        found[row].append((TAGS[open_[0]][2:], a + open_[1], a + t))
                        open_ = None
                    if tag % 2:
                        open_ = (tag, t)
            parts = parts[n:]
        return found

    def _paths(self, parts: list[tuple[np.ndarray, bool, bool]]) -> list[list[int]]:
        """The best tags of each part, longest first, between outside tags or a text's ends."""
        T, size = self.between.astype(np.float32), np.array([len(e) for e, _, _ in parts])
        n, going = len(parts), [int((size > t).sum()) for t in range(size[0])]
        score = np.zeros((size[0], len(TAGS), n), np.float32)  # of the best path to each tag
        for k, (own, _, _) in enumerate(parts):
            score[: len(own), :, k] = own
        first, last = (np.array([p[j] for p in parts]) for j in (1, 2))
        score[0] += np.where(_ALLOWED[0][:, None], np.where(first, 0, T[0][:, None]), -1e4)
        for t in range(1, size[0]):
            k = going[t]
            score[t, :, :k] += (score[t - 1, :, None, :k] + T[:, :, None]).max(0)
            score[t, :, :k] -= score[t, :, :k].max(0)
        path = np.zeros((size[0], n), np.int64)
        ends = score[size - 1, :, np.arange(n)] + np.where(last[:, None], 0, T[:, 0])
        tag = ends.argmax(1)
        for t in range(size[0] - 1, 0, -1):
            k = going[t]
            path[t, :k] = tag[:k]
            tag[:k] = (score[t - 1, :, :k] + T[:, tag[:k]]).argmax(0)
        path[0] = tag
        return [path[:m, k].tolist() for k, m in enumerate(size.tolist())]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], passes: int = PASSES, seed: int = 3, steps: int = 64) -> Tagger:
    """Adam over windows of the examples; the model is the same for the same examples."""
    rng, model = np.random.default_rng(seed), Tagger.fresh(seed)
    chars, tags = [], []
    for text, spans in examples:
        x, y = classes(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            y[a], y[a + 1 : b] = TAGS.index("B-" + kind), TAGS.index("I-" + kind)
        for at in range(0, max(1, len(x) - steps // 2), steps // 2):
            cut = slice(at, at + steps)
            chars.append(np.pad(x[cut], (0, steps - len(x[cut]))))
            own = np.pad(y[cut], (0, steps - len(y[cut])))
            if own[0] and own[0] % 2 == 0:
                own[0] -= 1  # a span that the window cuts begins with it
            tags.append(own)
    chars, tags = np.array(chars), np.array(tags)
    m, v, step = {k: np.zeros_like(a) for k, a in model.w.items()}, {k: np.zeros_like(a) for k, a in model.w.items()}, 0
    for p in range(passes):
        order = rng.permutation(len(chars))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            _, grads = model.loss_and_gradients(chars[some], tags[some])
            step += 1
            rate = 0.015 * (1 - p / passes) ** 2 + 0.0005
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            np.clip(model.w["T"], -REACH, REACH, out=model.w["T"])
    return model


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(labelled_examples())


def tagged_spans(texts: list[str], reader: Reader, windows: int = 512) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each whole text. Windows of all texts are scored together."""
    codes = [classes(t) for t in texts]
    gains = [np.empty((2, len(x)), np.float32) for x in codes]
    starts = [range(0, max(1, len(x) - 2 * MARGIN), WINDOW - 2 * MARGIN) for x in codes]
    held: list[list] = [[None] * len(s) for s in starts]  # scores of each window of each text
    # of two windows over a character, the one it is more central in
    border = lambda row, k: starts[row][k] + (MARGIN if k else 0) if k < len(starts[row]) else len(codes[row])
    cuts: dict[int, list[tuple[int, int]]] = {}
    for row, x in enumerate(codes):
        for k, at in enumerate(starts[row] if len(x) else ()):
            cuts.setdefault(min(WINDOW, -(-(len(x) - at) // 128) * 128), []).append((row, k))  # padded by its own length alone
    for steps, same in cuts.items():
        for first in range(0, len(same), windows):
            part = same[first : first + windows]
            chars = np.zeros((len(part), steps), np.intp)
            for own, (row, k) in zip(chars, part, strict=True):
                x = codes[row][starts[row][k] : starts[row][k] + steps]
                own[: len(x)] = x
            e = reader.emissions(np.ascontiguousarray(chars.T))
            for j, (own, (row, k)) in enumerate(zip(np.ascontiguousarray(reader.gains(e).transpose(2, 0, 1)), part, strict=True)):
                at, a, b = starts[row][k], border(row, k), border(row, k + 1)
                gains[row][:, a:b] = own[:, a - at : b - at]
                held[row][k] = e[:, j]

    def scores(row: int, a: int, b: int) -> np.ndarray:
        out, last = [], len(held[row]) - 1
        for k in range(min(last, max(0, (a - MARGIN) // starts[row].step)), last + 1):
            lo, hi = max(a, border(row, k)), min(b, border(row, k + 1))
            if lo < hi:
                out.append(held[row][k][lo - starts[row][k] : hi - starts[row][k]])
            if hi == b:
                break
        return np.concatenate(out)

    return reader.search(gains, scores)


_SPELLED_AT = re.compile(r"\s*[(\[{]\s*(?:at|@)\s*[)\]}]\s*|\s+at\s+|\s*[@＠]\s*", re.I)
_SPELLED_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+(?:dot|\.)\s+", re.I)
_EDGE = " \t\n\r\x0b\x0c,;:!?\"'<>"


def plausible(kind: str, text: str) -> bool:
    """Whether a tagged span can be of its kind: the contract's limits, however it is spelled."""
    digits = _digits(text)
    if kind == "email":  # one address without spaces, once its at and dots are signs
        signs = _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", text))
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", signs))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return len(text) >= 12 and not re.search(r"\s", text)


def all_spans(text: str, tagged: list[tuple[str, int, int]], base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Base spans (sought if not given), and plausible tagged spans, less spaces and marks at their ends, that touch none of them."""
    base, more = base_spans(text) if base is None else base, []
    for kind, a, b in tagged:
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE + ".":
            b -= 1
        if a < b and plausible(kind, text[a:b]) and all(b <= s[1] or a >= s[2] for s in base):
            more.append((kind, a, b))
    return sorted([*base, *more], key=lambda s: (s[1], TAGGED.index(s[0]), s[2]))


#: Characters of text tagged together by a worker, beyond which a single text stands alone.
_TOGETHER = 1 << 20


def find_spans(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern matches), base and spans, as ``kind:start:end`` lists.

    Both lists are comma-joined, by start, then kind; ``n_added`` counts what the tagger added,
    ``n_secret`` the secrets among it.
    """
    held = docs.sparkSession.sparkContext.broadcast((model or default_tagger()).w)  # some thousand weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        reader = Tagger(held.value).reader()
        for batch in batches:
            counts, bases, alls, added, secrets = [[] for _ in KINDS], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) for t in texts]) // _TOGETHER
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                for k, tagged in zip(some.tolist(), tagged_spans([texts[k] for k in some], reader), strict=True):
                    base = base_spans(texts[k])
                    every = all_spans(texts[k], tagged, base)
                    for n, kind in zip(counts, KINDS, strict=True):
                        n.append(sum(s[0] == kind for s in base))
                    bases.append(join(base))
                    alls.append(join(every))
                    added.append(len(every) - len(base))
                    secrets.append(sum(s[0] == "secret" for s in every))
            arrays = [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(bases, pa.string()), pa.array(alls, pa.string()), pa.array(added, pa.int64()), pa.array(secrets, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added", "n_secret"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, n_secret long")
