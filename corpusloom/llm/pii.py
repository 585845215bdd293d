"""Personal data: exact patterns, and spans of a character BiLSTM with a CRF on top.

The patterns are found in linear time over runs of digits and signs of a text. The
model reads every character of every text in both directions; a conditional random field
scores tag sequences (outside, or first/inner character of a kind). It is trained in
numpy on windows of labelled prose from a generator, with spellings that the patterns
miss (spaced dots, brackets, ``at`` and ``dot`` in words, no plus sign) and look-alikes
that are none (versions, dates, keys, prices).

Texts are read in windows of ``WINDOW`` characters that overlap by ``OVERLAP``, many side
by side. A window in which no character of a kind can outweigh being outside by more
than any transition adds is outside as a whole, which needs no decoding; nor does one
without any digit, @ or word ``dot``, since every span that passes its kind's test holds
one of them. A span that
touches an inner edge of its window is left to the neighbour that sees it whole; one
that no window sees whole is read again in a window of its own, larger until it fits.
What remains is ordered by score, and a span stays if it passes its kind's test and
meets no pattern match and no better span. A text's scores are the same to the last bit
whatever is read beside it: states and weights are rounded to ``1 / FINE``, so that sums
of their products are exact in any order, and tags end with their window, outside of all
spans where the text ends with it.

Edge cases: a null or empty text has no spans; repeated rows each get a row; texts of
any length are read whole; equal scores go by place; other columns are ignored unless
kept, and a made column replaces a kept one of its name.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.llm.arrays import column, map_text, sha256_hex

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Patterns ------------------------------------------------------------------
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+(?=[0-9])[\x20().0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            found.append((a, m.end()))
            free = m.end()
    return found


def _ips(text: str, runs: list[Span]) -> list[Span]:
    found, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b == c - 1 and text[b] == "." for (_, b), (c, _) in zip(four, four[1:], strict=False)):
            if all(b - a < 4 or not text[a:b].lstrip("0") or len(text[a:b].lstrip("0")) < 4 for a, b in four) and all(int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
                found.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return found


def _cards(text: str, runs: list[Span]) -> list[Span]:
    found, i = [], 0
    while i < len(runs):
        k = i
        while k + 1 < len(runs) and runs[k + 1][0] == runs[k][1] + 1 and text[runs[k][1]] in " -":
            k += 1
        a, b = runs[i][0], runs[k][1]
        if 13 <= sum(y - x for x, y in runs[i : k + 1]) <= 19 and luhn("".join(text[x:y] for x, y in runs[i : k + 1])):
            found.append((a, b))
        i = k + 1
    return found


def phones(text: str) -> list[Span]:
    found = []
    for m in _PHONE.finditer(text):
        run = m.group().rstrip(" ().-")
        if len(run) >= 4 and 9 <= sum(map(str.isdigit, run)) <= 15:
            found.append((m.start(), m.start() + len(run)))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The patterns' matches by kind, leftmost and without overlap within a kind."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    return {
        "email": emails(text) if "@" in text else [],
        "ip": _ips(text, runs),
        "card": _cards(text, runs),
        "phone": phones(text) if runs and "+" in text else [],
    }


# Labelled spans ------------------------------------------------------------
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 @.-_+()/:,;=\"'%#*\n"
_OTHER, _N_CODES = 1, len(_ALPHABET) + 2
_CODES = np.full(129, _OTHER, np.uint8)
for _i, _c in enumerate(_ALPHABET):
    _CODES[[ord(_c), ord(_c.upper())]] = _i + 2
WINDOW, OVERLAP = 256, 64
CROP = 128  #: characters of a training window
FINE = 1 << 20  #: sums of products of such fractions below 2^13 fit a double


def encoded(text: str) -> np.ndarray:
    """A code for each code point; capitals are as small letters."""
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def labelled_text(r: np.random.Generator, size: int) -> tuple[str, list[tuple[str, int, int]]]:
    """Invented prose of ``size`` characters or more, with its labelled spans."""
    parts = ["an", "the", "er", "on", "st", "re", "ti", "ou", "le", "ch", "en", "de", "que", "ie", "la", "mo", "ka", "sz", "ö", "у"]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(parts[i] for i in r.integers(0, len(parts), r.integers(1, 4)).tolist())
    pick = lambda *x: x[int(r.integers(len(x)))]
    prose = lambda n: " ".join(("at", "dot", word() + ",", word() + ".", word().title(), *[word()] * 9)[i] for i in r.integers(0, 14, n).tolist())

    def private(kind: str) -> str:
        if kind == "email":
            name, host = word() + pick("", ".", "_", "+") + pick(word(), digits(2)), word() + pick("", digits(1))
            at, dot = pick("@", "@", "@", " @ ", "(@)", "[@]"), pick(".", ".", ".", " . ", " dot ")
            if r.random() < 0.2:
                at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))
            return f"{name}{at}{host}{dot}{pick('example', word())}{dot}{pick('com', 'org', 'net', 'de')}"
        if kind == "ip":
            return pick(".", ".", " . ", "[.]", "-").join(str(int(x)) for x in r.integers(0, 256, 4))
        if kind == "card":
            body = digits(15)
            body += next(str(x) for x in range(10) if luhn(body + str(x)))
            gap = pick("", " ", "-", ".", "  ", "/")
            return gap.join(body[i : i + 4] for i in range(0, 16, 4))
        gap = pick(" ", "-", ".", "")
        lead = pick("+" + digits(2) + pick(" ", "-"), "(" + digits(3) + ") ", "00" + digits(2) + " ", digits(3) + pick("-", " "))
        return lead + gap.join([digits(3), digits(pick(3, 4)), digits(pick(2, 4))])

    def public() -> str:
        return pick(
            f"version {digits(1)}.{digits(1)}",
            f"{digits(2)}.{digits(2)}.20{digits(2)}",
            f"20{digits(2)}-{digits(2)}-{digits(2)}",
            f'token = "{"".join(r.choice(list("0123456789abcdef"), 40))}"',
            f"{digits(int(r.integers(1, 6)))},{digits(2)}",
            f"{word()}{digits(int(r.integers(1, 4)))}",
            f"@{word()}",
            f"{word()} at {word()}",
            f"{digits(2)}:{digits(2)}:{digits(2)}",
            digits(int(r.integers(1, 9))),
            digits(int(r.integers(20, 40))),
        )

    text, spans = "", []
    while len(text) < size:
        text += prose(int(r.integers(1, 22))) + pick(" ", " ", ": ", "\n", "")
        if r.random() < 0.6:
            kind = KINDS[int(r.integers(4))]
            item = private(kind)
            spans.append((kind, len(text), len(text) + len(item)))
            text += item
        else:
            text += public()
        text += pick(" ", ", ", ". ", "### ")
    return (text.upper() if r.random() < 0.1 and text.upper().lower() == text.lower() else text), spans


def labelled_examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of ``CROP`` characters cut anywhere from labelled prose; cut spans are clipped."""
    r, out = np.random.default_rng(seed), []
    while len(out) < n:
        text, spans = labelled_text(r, 6 * CROP)
        for _ in range(4):
            at = int(r.integers(0, len(text) - CROP + 1))
            out.append((text[at : at + CROP], [(k, max(a - at, 0), min(b - at, CROP)) for k, a, b in spans if a < at + CROP and b > at]))
    return out[:n]


def tags_of(spans: list[tuple[str, int, int]], size: int) -> np.ndarray:
    """0 outside; 1 + 2k begins and 2 + 2k continues a span of the k-th kind."""
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


# The model -----------------------------------------------------------------
N_TAGS = 1 + 2 * len(KINDS)
_NEVER = np.zeros((N_TAGS, N_TAGS))  # an inner tag follows its own kind only
for _t in range(N_TAGS):
    for _k in range(len(KINDS)):
        if _t not in (1 + 2 * _k, 2 + 2 * _k):
            _NEVER[_t, 2 + 2 * _k] = -1e4
_FIRST = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """A bidirectional LSTM over characters and a linear-chain CRF, in numpy."""

    def __init__(self, hidden: int = 12, size: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {"emb": r.normal(0, 0.3, (_N_CODES, size)), "out": r.normal(0, 0.1, (2 * hidden, N_TAGS)), "out_b": np.zeros(N_TAGS), "next": np.zeros((N_TAGS, N_TAGS))}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.25, (size, 4 * hidden))
            self.p[f"h{d}"] = r.normal(0, 0.2, (hidden, 4 * hidden))
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Hidden states in time order over x (time, lane, size), and what backward needs."""
        n, h = x.shape[1], self.h
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        inputs = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, saved = np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)):
            z = inputs[t] + state @ self.p[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            old, before = cell, state
            cell = f * old + i * new
            top = np.tanh(cell)
            state = o * top
            out[t] = state
            saved.append((i, f, o, new, old, top, before))
        return out, saved

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(time, lane, tag) scores of codes (lane, time)."""
        x = self.p["emb"][codes.T]
        forward, sf = self._pass(x, "f")
        backward, sb = self._pass(x[::-1], "b")
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (codes, x, sf, sb, both)

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags, and its gradients."""
        e, (codes, x, sf, sb, both) = self.emissions(codes)
        n = codes.shape[0]
        loss, de, dnext = self._crf(e.astype(np.float64), gold.T)
        de, g = (de / n).astype(np.float32), {k: np.zeros_like(v) for k, v in self.p.items()}
        g["next"] = (dnext / n).astype(np.float32)
        g["out"], g["out_b"] = np.tensordot(both, de, ((0, 1), (0, 1))), de.sum((0, 1))
        top = de @ self.p["out"].T
        dx = self._back(x, sf, top[:, :, : self.h], "f", g)
        dx = dx + self._back(x[::-1], sb, top[::-1, :, self.h :], "b", g)[::-1]
        np.add.at(g["emb"], codes.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss / n, g

    def _back(self, x: np.ndarray, saved: list, top: np.ndarray, d: str, g: dict[str, np.ndarray]) -> np.ndarray:
        h, n = self.h, x.shape[1]
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        dz = np.empty((len(x), n, 4 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, new, old, peak, before = saved[t]
            dh = dh + top[t]
            dc = dc + dh * o * (1 - peak**2)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * old * f * (1 - f), dh * peak * o * (1 - o), dc * i * (1 - new**2)], 1)
            g[f"h{d}"] += before.T @ dz[t]
            dh, dc = dz[t] @ self.p[f"h{d}"].T, dc * f
        g[f"x{d}"] += np.tensordot(x, dz, ((0, 1), (0, 1)))
        g[f"c{d}"] += dz.sum((0, 1))
        return dz @ self.p[f"x{d}"].T

    def _crf(self, e: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Forward and backward sums as scaled probabilities."""
        steps, n, _ = e.shape
        lanes, at = np.arange(n), np.arange(steps)[:, None]
        move = np.exp(self.p["next"].astype(np.float64) + _NEVER)
        top = e.max(2)
        own = np.exp(e - top[:, :, None])
        forward, backward, size = np.empty_like(own), np.ones_like(own), np.empty((steps, n))
        for t in range(steps):
            now = own[t] * (np.exp(_FIRST) if t == 0 else forward[t - 1] @ move)
            size[t] = now.sum(1)
            forward[t] = now / size[t][:, None]
        seen = own / size[:, :, None]
        for t in range(steps - 2, -1, -1):
            backward[t] = (seen[t + 1] * backward[t + 1]) @ move.T
        whole = np.log(size).sum() + top.sum()
        score = e[at, lanes, gold].sum() + self.p["next"][gold[:-1], gold[1:]].sum()
        de = forward * backward
        dmove = move * np.tensordot(forward[:-1], seen[1:] * backward[1:], ((0, 1), (0, 1)))
        np.add.at(dmove, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        de[at, lanes, gold] -= 1
        return float(whole - score), de, dmove

    def scores(self, codes: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(time, lane, tag) scores of codes (time, lane), of lanes sorted longest first.

        ``live`` says how many lanes are longer than each time; the backward pass begins at
        each lane's own end.
        """
        h, lanes = self.h, codes.shape[1]
        e = np.broadcast_to(self.p["out_b"], (len(codes), lanes, N_TAGS)).copy()
        for d, way in (("f", range(len(codes))), ("b", range(len(codes) - 1, -1, -1))):
            table = self.p["emb"] @ self.p[f"x{d}"] + self.p[f"c{d}"]
            move, out = (np.rint(w.astype(np.float64) * FINE) / FINE**2 for w in (self.p[f"h{d}"], self.p["out"][:h] if d == "f" else self.p["out"][h:]))
            state, cell = np.zeros((lanes, h)), np.zeros((lanes, h), np.float32)  # states times FINE
            for t in way:
                n = int(live[t])
                held = state[:n]
                z = table[codes[t, :n]]
                z += (held @ move).astype(np.float32)
                gates, new, own = z[:, : 3 * h], np.tanh(z[:, 3 * h :]), cell[:n]
                gates *= 0.5  # a sigmoid by the faster tangent
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new *= gates[:, :h]
                own *= gates[:, h : 2 * h]
                own += new
                np.tanh(own, out=new)
                new *= gates[:, 2 * h :]
                np.rint(np.multiply(new, FINE, out=held), out=held)
                e[t, :n] += (held @ out).astype(np.float32)
        return e

    def least_to_leave(self) -> float:
        """What a character's score for a kind must be ahead of outside by, for any path to leave it.

        No path with lesser leads gains on staying outside, whatever its transitions add.
        """
        move = self.p["next"]
        return -float(max(0.0, (move[:, 1:] + _NEVER[:, 1:]).max() - move[0, 0]) + max(0.0, move[1:, 0].max() - move[0, 0]))

    def best_tags(self, e: np.ndarray, size: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (lane, time) of scores, and how far each tag is ahead of outside.

        Lanes are sorted longest first; beyond its ``size`` a lane is outside. Getting there
        counts in the lanes that are the ``last`` of their text.
        """
        size = np.full(e.shape[1], len(e)) if size is None else size
        move = self.p["next"] + _NEVER.astype(np.float32)
        best, links = e[0] + _FIRST.astype(np.float32), []
        live = np.searchsorted(-size, -np.arange(len(e)), "left").tolist()
        for n, now in zip(live[1:], e[1:], strict=True):
            ways = best[:n, :, None] + move
            links.append(ways.argmax(1))
            best[:n] = now[:n] + ways.max(1)
        if last is not None:
            best[last] += move[:, 0]
        tags = np.zeros((e.shape[1], len(e)), np.int64)
        tags[np.arange(len(tags)), size - 1] = best.argmax(1)
        for t in range(len(links) - 1, -1, -1):
            n = live[t + 1]
            tags[:n, t] = links[t][np.arange(n), tags[:n, t + 1]]
        ahead = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - e[:, :, 0].T
        return tags, ahead


@cache
def trained(examples: int = 6000, epochs: int = 7, seed: int = 11) -> Tagger:
    """The tagger, trained by Adam on generated labelled spans; the same every time."""
    model, data = Tagger(), labelled_examples(examples, seed)
    codes = np.stack([encoded(t) for t, _ in data]).astype(np.int64)
    gold = np.stack([tags_of(s, CROP) for _, s in data])
    mean, square = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    random, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = random.permutation(len(codes))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            _, g = model.gradients(codes[own], gold[own])
            step += 1
            scale = min(1.0, 5.0 / (np.sqrt(sum(float((v**2).sum()) for v in g.values())) + 1e-9))
            for k, v in g.items():
                v = v * scale
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v**2 - square[k])
                rate = 0.015 * (1 - epoch / (epochs + 1))
                model.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


# Windows and reconciliation --------------------------------------------------
_TRIGGER = re.compile(r"[0-9@]")
_DOT = re.compile(r"\bdot\b", re.IGNORECASE)
_AT = re.compile(r"\w\W{0,3}(?:@\W?\w.*(?:\.|\bdot\b)|\bat\b\W{1,3}\w+\W{1,3}\bdot\b)\W{0,3}\w", re.IGNORECASE)


def windows_over(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of overlapping windows that hold every character of every text."""
    step = WINDOW - OVERLAP
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // step)), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, start, np.minimum(start + WINDOW, sizes[text])


def hints(text: str, codes: np.ndarray) -> np.ndarray:
    """Up to and with each character of a text: digits, @ and words ``dot``, from zero.

    Every plausible span holds one of them, so windows without any can be passed over.
    """
    held = (codes >= _CODES[ord("0")]) & (codes <= _CODES[ord("9")]) | (codes == _CODES[ord("@")])
    for m in _DOT.finditer(text):
        held[m.start()] = True
    return np.concatenate([[0], np.cumsum(held)])


def plausible(kind: str, item: str) -> bool:
    """The least that a span of its kind holds; the model's spans must pass it."""
    digits = re.sub(r"[^0-9]", "", item)
    if kind == "email":
        return item.count("@") <= 1 and "\n" not in item and _AT.search(item) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", item)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W0-9_]", item)
    return 9 <= len(digits) <= 15 and not re.search(r"[^\W0-9_]", item) and bool(re.search(r"[^0-9]", item))


Found = tuple[float, str, int, int]


def tagged(codes: np.ndarray, start: np.ndarray, end: np.ndarray, model: Tagger, last: np.ndarray | None = None, lanes: int = 2048) -> list[tuple[int, float, str, int, int]]:
    """(window, score, kind, start, end) of the spans of windows ``codes[start:end]``.

    ``last`` says which of them end their text, by default all.
    """
    last = np.ones(len(start), bool) if last is None else last
    out, order, least = [], np.argsort(start - end, kind="stable"), model.least_to_leave()
    for at in range(0, len(order), lanes):
        own = order[at : at + lanes]
        size = end[own] - start[own]
        steps = np.arange(int(size[0]))
        live = np.searchsorted(-size, -steps, "left")  # windows longer than each time
        part = codes[np.minimum(start[own] + steps[:, None], len(codes) - 1)]
        e = model.scores(part, live)
        e[steps[:, None] >= size] = [0.0] + [-1e4] * (N_TAGS - 1)
        lead = e[:, :, 1:].max(2)
        lead -= e[:, :, 0]
        busy = np.flatnonzero((lead > least).any(0))
        if not len(busy):
            continue
        tags, ahead = model.best_tags(e[:, busy], size[busy], last[own[busy]])
        for lane, t in zip(*(x.tolist() for x in np.nonzero(tags % 2 == 1)), strict=True):
            row = tags[lane]
            to = t + 1
            while to < len(row) and row[to] == row[t] + 1:
                to += 1
            out.append((int(own[busy[lane]]), float(ahead[lane, t:to].mean()), KINDS[row[t] // 2], t, to))
    return out


def model_spans(texts: list[str], model: Tagger, every: bool = False) -> list[list[Found]]:
    """(score, kind, start, end) that the windows of each text hold, before reconciling.

    Windows that no plausible span can touch are passed over, unless ``every`` is asked for.
    """
    found: list[list[Found]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    whole = "".join(texts)
    codes = encoded(whole)
    if not len(codes):
        return found
    text, start, end = windows_over(sizes)
    if not every:
        seen = hints(whole, codes)
        some = seen[base[text] + end] > seen[base[text] + start]
        text, start, end = text[some], start[some], end[some]
    while len(text):
        cut: list[tuple[int, str, int, int, int]] = []
        for w, score, kind, a, b in tagged(codes, base[text] + start, base[text] + end, model, end == sizes[text]):
            i, at = int(text[w]), int(start[w])
            if (a == 0 and at > 0) or (at + b == end[w] and end[w] < sizes[i]):
                cut.append((i, kind, at + a, at + b, w))
            else:
                found[i].append((score, kind, at + a, at + b))
        again = set()
        for i, kind, a, b, w in cut:  # left to the neighbour, if that saw a span here as a whole
            if not any(x < b and a < y for _, k, x, y in found[i] if k == kind):
                reach = int(end[w] - start[w])  # three times as wide, so that rounds end
                again.add((i, max(0, int(start[w]) - reach), min(int(sizes[i]), int(end[w]) + reach)))
        text, start, end = (np.array(x, np.int64) for x in zip(*sorted(again), strict=True)) if again else (np.zeros(0, np.int64),) * 3
    return [sorted(set(own)) for own in found]


def reconciled(text: str, base: dict[str, list[Span]], found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Model spans that stay beside the patterns' matches, best first."""
    taken = [s for own in base.values() for s in own]
    out = []
    for _, kind, a, b in sorted(found, key=lambda x: (-x[0], x[2], x[3], x[1])):
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b and plausible(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


FOUND = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("method", StringType())])
FIELDS = [*(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_spans", LongType()), StructField("found", ArrayType(FOUND))]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def spans_of(texts: list[str], model: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text the patterns' matches and the model's spans beside them."""
    out = []
    for text, more in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text) if _TRIGGER.search(text) else {k: [] for k in KINDS}
        out.append(([(k, a, b) for k in KINDS for a, b in base[k]], reconciled(text, base, more) if more else []))
    return out


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: counts and digest of the patterns' matches, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for exact, extra in spans_of([t or "" for t in column(batch, "text").to_pylist()], shared.value):
            for k in KINDS:
                out[f"n_{k}"].append(sum(kind == k for kind, _, _ in exact))
            out["base_sha256"].append(sha256_hex(listed(exact).encode()))
            out["spans"].append(listed([*exact, *extra]))
            out["n_spans"].append(len(exact) + len(extra))
            out["found"].append([{"kind": k, "start": a, "end": b, "method": m} for m, part in (("pattern", exact), ("model", extra)) for k, a, b in part])
        return out

    return map_text(docs, list(keep), FIELDS, work, batch_bytes=4 << 20)


def masked(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "masked") -> DataFrame:
    """Each text with every span found replaced by its kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = column(batch, "text").to_pylist()
        out = list(texts)
        for i, (exact, extra) in enumerate(spans_of([t or "" for t in texts], shared.value)):
            if not exact and not extra:
                continue
            at, parts = 0, []
            for a, b, k in sorted((a, b, k) for k, a, b in [*exact, *extra]):
                if a >= at:
                    parts += [texts[i][at:a], f"<{k}>"]
                at = max(at, b)
            out[i] = "".join([*parts, texts[i][at:]])
        return {name: pa.array(out, pa.string())}

    return map_text(docs, list(keep), [StructField(name, StringType())], work, batch_bytes=4 << 20)


def held_out_accuracy(model: Tagger, texts: int = 40, seed: int = 77) -> dict[str, float]:
    """Precision and recall of whole spans in long texts that did not train."""
    r = np.random.default_rng(seed)
    data = [labelled_text(r, 3000) for _ in range(texts)]
    right = said = true = 0
    for own, (_, spans) in zip(model_spans([t for t, _ in data], model), data, strict=True):
        got = {(k, a, b) for _, k, a, b in own}
        right, said, true = right + len(got & set(spans)), said + len(got), true + len(spans)
    return {"precision": right / max(said, 1), "recall": right / max(true, 1)}
