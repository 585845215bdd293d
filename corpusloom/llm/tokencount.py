"""Exact token counts from a tokenizer compiled to a finite-state transducer.

The tokenizer is one of byte-pair merges over words with a marked last byte. Its
symbols are bytes, and bytes that end a word. Of the encoding of a word's prefix only
the last token matters for what follows, and only where that token could still be
part of a longer one: a state holds the longest end of the prefix that begins some
token, and for each place in it where a token may begin the last token before it and
how many tokens that was ago. That is finite, so the transducer is deterministic; its
transitions carry how many tokens reading a symbol adds (or takes back). It is
compiled on demand, and starts anew when it reaches ``MOST_STATES``.

A batch of texts is one stream of symbols, cut into equal chunks that run in step.
A chunk maps its entry state to an exit state and a count. After the first word end
inside it that map is constant, so all chunks run from there at once. A chunk within a
long word has a map that is known by points: first where it leads from the root, then
from the states to which the chunk before it, or often others of that word, led. A prefix scan composes the maps of such a
chain by doubling, in a logarithmic number of levels; where a composition meets a point
that is not known yet, all such points of all chains run at once, and the scan is done
again. States forget their past within a few tokens, or go round in a small circle, so
a few rounds do, however long the word. Then the beginnings of all chunks run at once from their entry states.

Edge cases: null or empty text has no tokens; special strings inside a text count as
one token each, as the library does by default; repeated rows each get a row; a text
may be one word of any length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from corpusloom.llm.arrays import column, map_text

MOST_STATES = 200_000
_FINAL = 256


def _byte_letters() -> dict[str, int]:
    """The public byte alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merges over strings of symbols; a token is named by its symbols."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, letters = spec["model"], _byte_letters()
        mark = model["end_of_word_suffix"]

        def symbols(token: str) -> str:
            final = token.endswith(mark)
            own = [letters[c] for c in (token[: -len(mark)] if final else token)]
            return "".join(map(chr, own[:-1])) + chr(own[-1] + _FINAL * final)

        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        names = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {symbols(t) for t in model["vocab"] if t not in names}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(pairs)}
        self.begun = {t[:i] for t in self.tokens for i in range(len(t))}
        self._fits: dict[tuple[str, str], bool] = {}

    def encode(self, symbols: str) -> list[str]:
        """The merges applied one by one, the first of the lowest rank each time."""
        own = list(symbols)
        while len(own) > 1:
            best = min(range(len(own) - 1), key=lambda i: (self.rank.get((own[i], own[i + 1]), 1 << 60), i))
            if (own[best], own[best + 1]) not in self.rank:
                break
            own[best : best + 2] = [own[best] + own[best + 1]]
        return own

    def fits(self, before: str, token: str) -> bool:
        """Whether ``token`` may follow ``before`` ('' at a word's start)."""
        key = (before, token)
        if key not in self._fits:
            if len(self._fits) > 500_000:
                self._fits.clear()
            self._fits[key] = self.encode(before + token) == ([before, token] if before else [token])
        return self._fits[key]


#: The end that begins a token; by place in it, (last token before, tokens since) or None.
State = tuple[str, tuple[tuple[str, int] | None, ...]]
_ROOT: State = ("", (("", 0),))


#: A transition as one number: the next state, and the tokens added above a least number.
_ADDS, _LEAST = 1 << 12, -(1 << 11)
#: Points that a chunk's map may get ahead of need.
AHEAD = 8


class Transducer:
    """States as rows and symbols as columns of a table of transitions."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.column = np.full(512, -1, np.int64)
        self.symbols: list[int] = []
        self.rounds = 0  #: of the scan that took most
        self.clear()

    def clear(self) -> None:
        self.keys: list[State] = [_ROOT]
        self.number: dict[State, int] = {_ROOT: 0}
        self.width = max(128, -(-len(self.symbols) // 64) * 64)
        self.moves = np.full(1024 * self.width, -1, np.int32)

    def state(self, key: State) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * self.width > len(self.moves):
                self.moves = np.concatenate([self.moves, np.full((1 << 14) * self.width, -1, np.int32)])
        return self.number[key]

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The column of every symbol; new symbols get new ones."""
        new = np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0))
        if len(new):
            for s in new.tolist():
                self.column[s] = len(self.symbols)
                self.symbols.append(s)
            if len(self.symbols) > self.width:
                self.clear()
        return self.column[symbols]

    def step(self, key: State, symbol: int) -> tuple[State, int]:
        end, places = key
        text = end + chr(symbol)
        for at in range(len(text)):
            place = places[at]
            if place is not None and text[at:] in self.merges.tokens and self.merges.fits(place[0], text[at:]):
                token, added = text[at:], 1 - place[1]
                break
        else:
            raise ValueError("the merges give this text no encoding")
        if symbol >= _FINAL:
            return _ROOT, added
        begun = self.merges.begun
        keep = next(k for k in range(len(text) + 1) if text[k:] in begun)
        moved = [None if p is None else (p[0], p[1] + added) for p in places] + [(token, 0)]
        return (text[keep:], tuple(p if text[k:] in begun else None for k, p in enumerate(moved) if k >= keep)), added

    def fill(self, places: np.ndarray) -> None:
        for at in np.unique(places).tolist():
            key, added = self.step(self.keys[at // self.width], self.symbols[at % self.width])
            self.moves[at] = self.state(key) * _ADDS + added - _LEAST

    def run(self, stream: np.ndarray, states: np.ndarray, begins: np.ndarray, ends: np.ndarray, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Runs lane i over stream[begins[i]:ends[i]] in step: exit states, tokens added by each.

        ``out`` gets the tokens that each symbol adds.
        """
        states, total = states.astype(np.int64), np.zeros(len(states), np.int64)
        order = np.argsort(begins - ends, kind="stable")  # longest first, so that those still running come first
        begins, length, states = begins[order], (ends - begins)[order], states[order]
        live = len(order)
        for t in range(int(length[0]) if len(order) else 0):
            while live and length[live - 1] <= t:
                live -= 1
            at = begins[:live] + t
            places = states[:live] * self.width
            places += stream[at]
            to = self.moves[places]
            if to.min() < 0:
                self.fill(places[to < 0])
                to = self.moves[places]
            added = (to & (_ADDS - 1)) + _LEAST
            total[:live] += added
            if out is not None:
                out[at] = added
            states[:live] = to >> 12
            if len(self.keys) > MOST_STATES:
                used = np.unique(states)
                keys = [self.keys[i] for i in used.tolist()]
                self.clear()
                states = np.array([self.state(k) for k in keys])[np.searchsorted(used, states)]
        back, sums = np.empty_like(states), np.empty_like(total)
        back[order], sums[order] = states, total
        return back, sums

    def count(self, symbols: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Tokens of a stream of whole words: at each symbol those that it adds, or, for a
        chunk within one word, all of the chunk's at its first symbol."""
        n = len(symbols)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        stream = self.columns(symbols)
        size = max(64, -(-n // lanes))
        begins = np.arange(0, n, size)
        ends = np.minimum(begins + size, n)
        resets = np.flatnonzero(symbols >= _FINAL) + 1  # a word begins here, in the first state
        first = np.concatenate([resets, [n]])[np.searchsorted(resets, begins, "right")]
        constant = first <= ends
        first = np.minimum(first, ends)

        def run(which: np.ndarray, states: list[State], a: np.ndarray, b: np.ndarray, sink: np.ndarray | None) -> list[Point]:
            done, sums = self.run(stream, np.array([self.state(k) for k in states], np.int64), a, b, sink)
            return [(self.keys[i], x) for i, x in zip(done.tolist(), sums.tolist(), strict=True)]

        own = np.flatnonzero(constant)
        exits: dict[int, State] = dict(zip(own.tolist(), (k for k, _ in run(own, [_ROOT] * len(own), first[own], ends[own], out)), strict=True))
        within = np.flatnonzero(~constant)
        if len(within):
            cuts = np.flatnonzero(np.diff(within) != 1) + 1
            chains = [c.tolist() for c in np.split(within, cuts)]
            ask = lambda points: run(np.array([i for i, _ in points]), [k for _, k in points], begins[[i for i, _ in points]], ends[[i for i, _ in points]], None)
            solved, rounds = solve_chains(chains, {c[0]: exits.get(c[0] - 1, _ROOT) for c in chains}, ask)
            self.rounds = max(self.rounds, rounds)
            for i, (key, tokens) in solved.items():
                exits[i] = key
                out[begins[i]] = tokens
        own = np.flatnonzero(constant & (first > begins))
        run(own, [exits.get(i - 1, _ROOT) for i in own.tolist()], begins[own], first[own], out)
        return out


Point = tuple[State, int]  #: where an entry state leads, and the tokens on the way


def composed(later: dict[State, Point], earlier: dict[State, Point]) -> dict[State, Point]:
    """The map of two parts one after the other, at the points at which both are known."""
    out = {}
    for key, (middle, n) in earlier.items():
        if (found := later.get(middle)) is not None:
            out[key] = (found[0], n + found[1])
    return out


def scanned(maps: list[dict[State, Point]]) -> list[dict[State, Point]]:
    """All prefixes' compositions, by doubling: log2 levels, each composing all at once."""
    out, step = maps, 1
    while step < len(maps):
        out = [composed(m, out[i - step]) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


def solve_chains(chains: list[list[int]], entries: dict[int, State], ask: Callable[[list[tuple[int, State]]], list[Point]]) -> tuple[dict[int, Point], int]:
    """(exit state and tokens of every part of every chain, rounds) from the chains' entries.

    ``ask`` runs parts from states, all at once.
    """
    maps: dict[int, dict[State, Point]] = {i: {} for c in chains for i in c}
    wanted = {(i, _ROOT) for i in maps} | {(c[0], entries[c[0]]) for c in chains}
    solved: dict[int, Point] = {}
    rounds, left = 0, chains
    while left:
        rounds += 1
        points = sorted(wanted)
        for (i, key), found in zip(points, ask(points), strict=True):
            maps[i][key] = found
        wanted, still = set(), []
        for chain in left:
            entry, whole = entries[chain[0]], scanned([maps[i] for i in chain])
            known = next((k for k, m in enumerate(whole) if entry not in m), len(chain))
            state, before = entry, 0
            for k in range(known):
                exit_, sum_ = whole[k][entry]
                solved[chain[k]] = (exit_, sum_ - before)
                state, before = exit_, sum_
            if known < len(chain):
                rest = chain[known:]
                entries[rest[0]] = state
                still.append(rest)
                wanted.add((rest[0], state))
                led = Counter(k for i in rest for k, _ in maps[i].values())
                often = [state, *(k for k, n in led.most_common(AHEAD) if n > 1)]
                for i, j in zip(rest, rest[1:], strict=False):
                    likely = [k for k in dict.fromkeys([*(k for k, _ in maps[i].values()), *often]) if k not in maps[j]]
                    wanted |= {(j, k) for k in likely[: max(0, AHEAD - len(maps[j]))]}
        left = still
    return solved, rounds


# Words ---------------------------------------------------------------------
_SPACE, _LETTER, _NUMBER, _MARK = range(4)


@cache
def character_kinds() -> np.ndarray:
    kinds = np.full(0x110000, _MARK, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = _LETTER
        elif c == "N":
            kinds[cp] = _NUMBER
        elif c == "Z":
            kinds[cp] = _SPACE
    kinds[[*range(9, 14), 0x85]] = _SPACE
    return kinds


def normalised(text: str) -> str:
    """Composed and lower-cased character by character."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a word begins: runs of letters, single numbers, runs of marks, contractions.

    A contraction is an apostrophe that does not continue a run of marks, with one of
    the letters s t m d or two of re ve ll after it.
    """
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    start &= kinds != _SPACE
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        ahead = np.concatenate([points, [10, 10, 10]])
        one, two = ahead[mark + 1], ahead[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for own, size in ((mark[short], 2), (mark[long], 3)):
            for k in range(1, size):
                start[own + k] = False
            after = own + size
            after = after[after < n]
            start[after] = kinds[after] != _SPACE
    return start


def symbol_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words of all texts, and where each text's symbols begin."""
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kinds = character_kinds()[points]
    start = word_starts(points, kinds)
    inside = kinds != _SPACE
    final = np.ones(len(points), bool)
    final[:-1] = start[1:] | ~inside[1:]
    final &= inside
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.frombuffer(whole.encode("utf-8"), np.uint8).astype(np.int64)
    symbols[offsets[1:][final] - 1] += _FINAL
    kept = np.repeat(inside, sizes)
    place = np.concatenate([[0], np.cumsum(kept)])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return symbols[kept], place[offsets[bounds]]


@cache
def transducer(file: bytes) -> Transducer:
    """Of a tokenizer file's content; one in each worker process."""
    return Transducer(Merges(file))


def count_tokens(texts: list[str], machine: Transducer) -> np.ndarray:
    """Tokens of each text, special strings inside it included."""
    specials = machine.merges.specials
    more = np.zeros(len(texts), np.int64)
    plain = list(texts)
    if specials:
        cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
        for i, t in enumerate(texts):
            if any(s in t for s in specials):
                parts = cut.split(t)
                more[i] = len(parts) - 1
                plain[i] = "\n".join(map(normalised, parts))
                continue
            plain[i] = normalised(t)
    symbols, bounds = symbol_stream(plain)
    sums = np.concatenate([[0], np.cumsum(machine.count(symbols))])
    return sums[bounds[1:]] - sums[bounds[:-1]] + more


FIELDS = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Bytes and tokens of every text by the tokenizer file at ``path`` of the driver.

    The file, of a few MB, goes to the executors as it is and is compiled there.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        tokens = count_tokens(texts, transducer(shared.value))
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": tokens > limit}

    return map_text(docs, list(keep), FIELDS, work, batch_bytes=4 << 20)
