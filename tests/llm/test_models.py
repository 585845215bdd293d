"""Trained operators by held-out accuracy, exact ones by round trips and libraries."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import licenses, media, mixing, pii, tokencount, toxicity
from corpusloom.llm.queries import tokenizer_path


def documents(n=600, seed=1):
    r = np.random.default_rng(seed)
    words, rude = [f"w{i}" for i in range(300)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(n):
        own, bad = list(r.choice(words, 60)), i % 5 == 0
        if bad:
            own[int(r.integers(60))] = str(r.choice(rude)) + "!"
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 > 0), int(bad) if r.random() > 0.03 else 1 - int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = documents()
    extra = [(9001, None), (9002, ""), (None, "idiot"), (9003, "w1 " * 20_000)]
    docs = spark.createDataFrame([(*r, "s", 2) for r in rows + extra], "doc_id long, text string, score string, label int").repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(tables):
    docs, labels = tables
    found = {r.doc_id: r for r in toxicity.decided(toxicity.score(docs, toxicity.train(docs, labels))).collect()}
    assert len(found) == 604 and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].predicted == int(i % 5 == 0) for i in range(600)) and found[9001].predicted == found[9002].predicted == 0
    assert found[None].predicted == 1 and found[9001].score == found[9002].score


def test_pairs_matter():
    """Two terms that are harmless alone; a sum of weights cannot tell."""
    r = np.random.default_rng(0)
    sets = [{1, 2} if k == 0 else {1} if k == 1 else {2} if k == 2 else set() for k in r.integers(0, 4, 3000)]
    labels = np.array([s == {1, 2} for s in sets], float)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = toxicity.fit(labels, offsets, np.array([x for s in sets for x in sorted(s)]))
    slots = model.slot[[1, 2]]
    scores = model.scores(3, np.array([0, 0, 1, 2]), np.array([slots[0], slots[1], slots[0], slots[1]]))
    assert scores[0] > 0.9 and scores[1:].max() < 0.1


def test_terms_that_tell_only_together():
    """Exactly one of two terms: each alone says nothing, so no test of single terms lets it in."""
    r = np.random.default_rng(1)
    sets = [{*np.flatnonzero(r.random(2) < 0.5) + 1, *(r.integers(10, 400, 30)).tolist()} for _ in range(3000)]
    labels = np.array([len(s & {1, 2}) == 1 for s in sets], float)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = toxicity.fit(labels, offsets, np.array([x for s in sets for x in sorted(s)]))
    known = np.flatnonzero(model.slot >= 0)
    assert set(known.tolist()) == {1, 2}
    a, b = model.slot[[1, 2]]
    scores = model.scores(4, np.array([0, 1, 2, 2]), np.array([a, b, a, b]))
    assert scores[:2].min() > 0.9 and scores[2:].max() < 0.1


def test_pair_statistics():
    """The matrix form of the pairs' test equals a count of each pair's groups."""
    r = np.random.default_rng(3)
    x, y = r.random((700, 12)) < 0.4, None
    y = ((x[:, 0] ^ x[:, 1]) | (r.random(700) < 0.1)).astype(float)
    rows, terms_ = np.nonzero(x)
    rate, out = y.mean(), set()

    def cell(m):
        return (y[m].sum() - m.sum() * rate) ** 2 / (m.sum() * rate * (1 - rate)) if m.any() else 0.0

    single = [cell(x[:, i]) + cell(~x[:, i]) for i in range(12)]
    for i in range(12):
        for j in range(i):
            a, b = x[:, i], x[:, j]
            if sum(map(cell, (a & b, a & ~b, ~a & b, ~a & ~b))) - single[i] - single[j] >= toxicity.limit(66) and (a & b).sum() >= toxicity.LEAST_ROWS:
                out |= {i, j}
    assert set(toxicity.telling_pairs(y, rows, terms_, 12, chunk=100).tolist()) == out == {0, 1}


def test_labels_of_one_kind():
    assert toxicity.fit(np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64)).scores(1, np.zeros(0, int), np.zeros(0, int))[0] < 1e-9


def test_mixing(tables):
    docs, labels = tables
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    found = mixing.mix(docs, labels, {"clean": 0.9, "toxic": 0.1, "unknown": 0.0}, domain).collect()
    n, p, rate = (np.array([r[c] for r in found], float) for c in ("n_tokens", "posterior", "rate"))
    assert len(found) == 604 and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (n * rate) @ p / n.sum()
    assert np.abs(share - [0.9, 0.1]).max() < 1e-3
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string")
    assert mixing.mix(empty, labels, {"clean": 1.0}, domain).count() == 0


def dense(n, p):
    """Sums of the same descent on the rates themselves, one array entry a document."""
    rates = []

    def sums(steps):
        if not steps.vectors:
            rates[:] = [np.ones(len(n)), np.ones(len(n))]
        else:
            new = np.maximum(0, rates[1] - p @ steps.vectors[-1])
            rates[:] = [new, new + steps.momentum[-1] * (new - rates[0])]
        own = rates[1] > 0
        return np.concatenate([[(n * x) @ p for x in rates], (p * n[:, None]).T @ p, (p[own] * n[own, None]).T @ p[own]])

    return rates, sums


def test_descent():
    """Targets inside the reach of nonnegative rates are met in few steps, whatever the mix."""
    r = np.random.default_rng(0)
    for k in (2, 4, 7):
        p = r.dirichlet(np.full(k, 0.2), 3000) * np.linspace(1, 0.02, k)
        p /= p.sum(1, keepdims=True)
        n = r.integers(0, 3000, 3000).astype(float)
        for _ in range(5):
            goal = n.sum() * (r.dirichlet(np.ones(k)) * 0.5 + 0.5 / k)
            rates, sums = dense(n, p)
            done = mixing.descend(sums, goal)
            assert done.gap <= mixing.TOLERANCE and len(done.vectors) < 60 and (rates[0] >= 0).all(), (k, done.gap, len(done.vectors))
            assert np.allclose(done.rates(p)[0], rates[0])


@pytest.mark.parametrize("targets", [{"clean": 0.9, "toxic": 0.1}, {"clean": 0.4, "toxic": 0.6}, {"clean": 1.0}])
def test_rates_equal_dense(tables, targets):
    """Replayed steps give what the same descent gives on arrays; the gap is what is missed."""
    docs, labels = tables
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    found = mixing.mix(docs, labels, targets, domain, tokenizer=tokenizer_path()).collect()
    n, p, rate = (np.array([r[c] for r in found], float) for c in ("n_tokens", "posterior", "rate"))
    goal = n.sum() * np.array([targets.get("clean", 0), targets.get("toxic", 0)])
    miss = np.abs((n * rate) @ p - goal).max() / n.sum()
    assert abs(miss - found[0].gap) < 1e-9 and (rate >= 0).all()
    rates, sums = dense(n, p)
    mixing.descend(sums, goal)
    assert np.allclose(rates[0], rate, rtol=1e-5, atol=1e-5) and ("toxic" not in targets or miss <= mixing.TOLERANCE)


def test_unreachable_target(tables):
    """No document is of the domain: the steps end and say how much is missed."""
    docs, labels = tables
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    assert abs(mixing.mix(docs, labels, {"clean": 0.5, "toxic": 0.2, "none": 0.3}, domain).first().gap - 0.3) < 1e-3


_PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_pattern(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m)] for k, p in _PATTERN.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["123", "4", "25", "300", ".", " ", "-", "+", "@", "a", "b.c", "4111111111111111", "4111 1111 1111 1111", "+49 ", "(", "é", "0"]), max_size=16).map("".join))
def test_patterns(text):
    assert pii.base_spans(text) == by_pattern(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained(2400, 6)


def whole_texts():
    """Prose with spans anywhere, also longer than windows overlap, and spelled in words."""
    r = np.random.default_rng(5)
    texts = [pii.labelled_text(r, n)[0] for n in (50, 255, 256, 257, 900, 5000)]
    return [*texts, "", "no data here", "é" * 300 + " write to ann.lee@mail9.example.com now", "w " * 400 + "x@" + "y" * 200 + ".org " + "w " * 400, "call 0049 170 123 4567 or mail joe at corp dot com " * 30, "İ 1.2.3.4 İ 10 . 0 . 0 . 1", "1" * 5000]


def test_tagger(tagger):
    seen = pii.held_out_accuracy(tagger)
    assert seen["precision"] > 0.7 and seen["recall"] > 0.7, seen


def test_windows_lose_nothing(tagger):
    """Passing over windows that no plausible span can touch changes no result; windows hold every character."""
    texts = whole_texts()
    for text, some, every in zip(texts, pii.model_spans(texts, tagger), pii.model_spans(texts, tagger, every=True), strict=True):
        base = pii.base_spans(text)
        assert pii.reconciled(text, base, some) == pii.reconciled(text, base, every), text[:80]
    text, start, end = pii.windows_over(np.array([0, 1, 256, 257, 4000]))
    for i, n in enumerate((0, 1, 256, 257, 4000)):
        assert set().union(*(range(a, b) for t, a, b in zip(text, start, end, strict=True) if t == i)) == set(range(n))


def test_spans_whatever_is_beside(tagger):
    """Scores to the last bit, and where a text ends, do not depend on the batch."""
    texts = [*whole_texts(), *(pii.labelled_text(np.random.default_rng(i), 60 + i)[0] for i in range(300))]
    together = pii.model_spans(texts, tagger)
    assert together[::-1] == pii.model_spans(texts[::-1], tagger)
    assert together == [pii.model_spans([t], tagger)[0] for t in texts]


def test_windows_agree_with_one(tagger):
    """Spans far from window edges are those of one decoding of the whole text."""
    texts, hits, same = [pii.labelled_text(np.random.default_rng(i), 1500)[0] for i in range(12)], 0, 0
    for text, own in zip(texts, pii.model_spans(texts, tagger), strict=True):
        whole = {(k, a, b) for _, _, k, a, b in pii.tagged(pii.encoded(text), np.array([0]), np.array([len(text)]), tagger)}
        hits, same = hits + len(whole), same + len(whole & {(k, a, b) for _, k, a, b in own})
    assert same > 0.95 * hits > 0


def test_skipped_decoding_is_outside(tagger):
    """Windows that the bound calls outside have no span when decoded all the same."""
    r = np.random.default_rng(8)
    for lead in (-3.0, 0.0, 2.0):
        e = r.normal(0, 1, (30, 200, pii.N_TAGS)).astype(np.float32)
        e[:, :, 1:] += lead - 2
        quiet = ((e[:, :, 1:].max(2) - e[:, :, 0]) <= tagger.least_to_leave()).all(0)
        tags, _ = tagger.best_tags(e)
        assert not tags[quiet].any()


def test_find(spark, tagger, monkeypatch):
    monkeypatch.setattr(pii, "trained", lambda: tagger)
    texts = [None, "", "no data here", "mail a.b@mail9.example.com or +49 170 1234567, card 4111 1111 1111 1111 at 10.0.0.1", "w " * 30_000 + "x@y.zz", "1" * 50_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    found = {r.doc_id: r for r in pii.find(docs, ("doc_id", "spans", "n_email")).collect()}
    assert [found[3][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and found[4].n_email == 1 and found[0].spans == found[2].spans == ""
    assert found[3].spans.startswith("email:5:26,") and found[5].n_card == 0
    for i, t in rows:
        want = by_pattern(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert found[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and found[i].n_spans == len(found[i].found) >= sum(map(len, want.values()))
        assert set(filter(None, text.split(","))) <= set(found[i].spans.split(","))
    assert pii.find(docs.limit(0)).count() == 0
    masked = {r.doc_id: r.masked for r in pii.masked(docs).collect()}
    assert "mail9" not in masked[3] and "<email>" in masked[3] and masked[0] is None and masked[2] == texts[2]


def test_crf_gradient():
    """Analytic gradients agree with differences of the loss."""
    model = pii.Tagger(4, 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    codes, gold = r.integers(0, 20, (3, 7)), np.zeros((3, 7), np.int64)
    gold[0, 2:5] = [1, 2, 2]
    _, g = model.gradients(codes, gold)
    for name in ("out", "next", "hf", "xb", "cf", "emb"):
        at = tuple(int(r.integers(n)) for n in model.p[name].shape)
        if name == "emb":
            at = (int(codes[0, 0]), 0)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = model.gradients(codes, gold)[0]
        model.p[name][at] = old - 1e-3
        down = model.gradients(codes, gold)[0]
        model.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=3000))
def test_png_round_trip(raw):
    stored = media.encode_png(media.padded(raw))
    samples, channels = media.decode_png(stored)
    assert samples.tobytes() == media.padded(raw) and channels == 3 and len(samples.tobytes()) % 192 == 0


def test_png_filters_and_checksums():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (9, 12)).astype(np.uint8)
    wide, above = image.astype(int), np.vstack([np.zeros((1, 12), int), image[:-1]])
    left = np.hstack([np.zeros((9, 3), int), wide[:, :-3]])
    corner = np.hstack([np.zeros((9, 3), int), above[:, :-3]])
    guess = left + above - corner
    gaps = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
    nearest = np.choose(gaps.argmin(0), [left, above, corner])
    rows = [wide, wide - left, wide - above, wide - (left + above) // 2, wide - nearest]
    kinds = np.array([0, 1, 2, 2, 3, 4, 4, 1, 3])
    lines = np.array([[k, *(rows[k][i] & 255)] for i, k in enumerate(kinds)], np.uint8)
    assert (media.unfiltered(lines, 3) == image).all()
    stored = bytearray(media.encode_png(media.padded(b"x" * 500)))
    stored[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(stored))
    with pytest.raises(ValueError):
        media.decode_png(bytes(stored[:20]))


def test_media_table(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (5, "z" * 100_000)]
    found = {r.doc_id: r for r in media.read_back(media.store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[1][1:] == found[4][1:] and found[2][1:] == found[3][1:] and (found[1].n_bytes, found[1].payload_bytes, found[2].payload_bytes) == (6, 192, 192)


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = ["", "it's don't 'sx ''s 's's !'s ' 've", "<|endoftext|>hello<|startoftext|> a<|endoftext|>", "x" * 5000, "ab" * 3000, "ΑΣ ΣΑΣ İ", "\x1c\x85a b", "日本語 ١٢٣ é ﬁ", "thntblere " * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_long_words():
    """Words over many chunks: equal to the library, in few rounds of a scan."""
    from tokenizers import Tokenizer

    r = np.random.default_rng(2)
    with open(tokenizer_path(), "rb") as f:
        machine = tokencount.Transducer(tokencount.Merges(f.read()))
    library = Tokenizer.from_file(tokenizer_path())
    texts = ["x" * 40_001, "abc" * 20_000, "hello" * 9_000 + " a b " + "zz" * 8_000, "".join(r.choice(list("etaoinshrdlu"), 50_000)), "日本語" * 5_000, "!" * 10_007]
    for t in texts:
        machine.rounds = 0
        assert tokencount.count_tokens([t, "end"], machine).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in (t, "end")], t[:9]
        assert machine.rounds <= 8, (t[:9], machine.rounds)


def test_scan_composes():
    """Prefix compositions of partial maps equal one step after another."""
    r = np.random.default_rng(0)
    maps = [{(str(a), ()): ((str(r.integers(4)), ()), int(r.integers(9))) for a in range(4) if r.random() < 0.9} for _ in range(37)]
    for entry in [(str(a), ()) for a in range(4)]:
        state, n, dead = entry, 0, False
        for m, whole in zip(maps, tokencount.scanned(maps), strict=True):
            dead = dead or state not in m
            if not dead:
                state, n = m[state][0], n + m[state][1]
            assert whole.get(entry) == (None if dead else (state, n))


def test_tokens_restart(monkeypatch):
    """A transducer that must start anew again and again still counts right."""
    with open(tokenizer_path(), "rb") as f:
        file = f.read()
    text = " ".join("".join(np.random.default_rng(i).choice(list("aeinrst"), 9)) for i in range(300))
    want = tokencount.count_tokens([text], tokencount.transducer(file))
    monkeypatch.setattr(tokencount, "MOST_STATES", 40)
    assert tokencount.count_tokens([text], tokencount.Transducer(tokencount.Merges(file))) == want


def test_repeated_licenses():
    """Copies of a template close to each other, in the middle of a text, are matches each."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("mit", "cc-by-4.0", "mit-notice"):
        own = licenses.normalised(licenses.TEMPLATES[name].encode())
        size = own.count(b" ") + 1
        for between in (b"", b" x y z"):
            for n in (1, 2, 3):
                text = b"some words before " + b" ".join([own + between] * n) + b" and some after"
                step = size + between.count(b" ")
                found = sorted((f for f in scanner.scan([text])[0] if f[0] == name), key=lambda f: f[3])
                assert found == [(name, 1.0, size, 3 + step * i, 3 + step * i + size) for i in range(n)]


def test_stretches_lose_no_match():
    """Wherever a plain table aligns enough of a template in twice its length, a stretch holds it."""
    r = np.random.default_rng(6)
    templates = {n: licenses.TEMPLATES[n] for n in ("mit", "cc-by-4.0", "mit-notice", "apache-2.0-notice", "gpl-3.0-notice")}
    scanner, hits = licenses.Scanner(templates), 0
    for trial in range(60):
        name = list(templates)[trial % 5]
        own = scanner.words[name]
        copy = [w for w in own if r.random() > r.choice([0.05, 0.15, 0.3])]
        for _ in range(int(r.integers(0, len(own) // 3 + 1))):
            copy.insert(int(r.integers(len(copy) + 1)), bytes(r.choice([b"foo", b"the", own[0], b"of"])))
        text = [*r.choice([b"the", b"of", b"x", b"license"], int(r.integers(0, 60))), *copy, *r.choice([b"this", b"y"], int(r.integers(0, 60)))]
        window = copy[: 2 * len(own)]
        enough = licenses.longest_common(window, own) >= scanner.threshold * len(own)
        found = scanner.scan([b" ".join(map(bytes, text))])[0]
        held = scanner.stretches(*licenses.hashed_words([b" ".join(map(bytes, text))])).get(0, [])
        if enough and len(copy) <= 2 * len(own):
            hits += 1
            assert any(n == name for n, _, _ in held), name
        for n, coverage, aligned, a, b in found:
            template = scanner.words[n]
            assert aligned <= licenses.longest_common(list(map(bytes, text[a:b])), template) and abs(coverage - aligned / len(template)) < 1e-9
    assert hits > 20


def test_alignment_of_unique_words():
    """Where no word repeats, patience alignment is a longest common subsequence."""
    r = np.random.default_rng(7)
    for _ in range(200):
        a, b = ([str(x).encode() for x in r.permutation(14)[: r.integers(0, 15)]] for _ in range(2))
        assert len(licenses.align(a, b)) == licenses.longest_common(a, b)


def test_license_edges(spark):
    """Whole licenses, ties, an empty table and columns whose names clash."""
    whole = licenses.TEMPLATES["bsd-3-clause"]
    rows = [(1, whole, "x", 0.5), (2, licenses.TEMPLATES["mit-full"] * 2, "x", 0.5), (3, None, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, coverage double")
    found = {r.doc_id: r for r in licenses.scan(docs, keep=("doc_id", "license")).collect()}
    assert found[1].license == "bsd-3-clause" and found[1].coverage == 1.0 and found[2].license == "mit-full" and len([m for m in found[2].matches if m.license == "mit-full"]) == 2
    assert found[3].license is None and found[3].coverage == 0.0 and licenses.scan(docs.limit(0)).count() == 0
    two = licenses.Scanner({"b": "one two three four", "a": "one two three four"})
    assert [m[0] for m in two.scan([b"one two three four"])[0]] == ["a", "b"] and licenses.Scanner({"none": ""}).scan([b"x"]) == [[]]


def test_licenses(spark):
    apache = licenses.TEMPLATES["apache-2.0-notice"]
    texts = [None, "", "plain words", "Released under the MIT License.", "# " + apache.replace("may not", "can not").replace(",", " ;"), "released under the " + "x " * 40 + "MIT license", "w " * 5000 + apache + " w" * 5000]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].license for i in range(4)] == [None, None, None, "mit"] and found[3].coverage == 1.0
    assert found[4].matches[0].license in ("apache-2.0", "apache-2.0-notice") and any(m.license == "apache-2.0-notice" and m.coverage > 0.95 for m in found[4].matches)
    assert found[5].license is None and (found[6].matches[0].start, found[6].n_words) == (5000, 10_000 + len(licenses.normalised(apache.encode()).split()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_alignment(a, b):
    pairs = licenses.align([x.encode() for x in a], [x.encode() for x in b])
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    own = licenses.increasing([(i, x) for i, x in enumerate(map(ord, dict.fromkeys(a)))])
    assert all(p[1] < q[1] for p, q in zip(own, own[1:], strict=False))


def test_pipeline(spark, monkeypatch, tmp_path, tagger):
    import corpus_pipeline

    monkeypatch.setattr(pii, "trained", lambda: tagger)
    rows, labels = documents(300)
    r = np.random.default_rng(9)
    item = " ".join(r.choice([f"b{i}" for i in range(400)], 30))
    clean = " ".join(r.choice([f"c{i}" for i in range(400)], 200))
    rows += [(700, clean), (701, clean), (702, clean + " end"), (703, "start " + item), (704, "write to a@b.example.com now"), (705, None), (706, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rate int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*docs.columns, "rate_", "domain", "gap"]
    kept = {r.doc_id: r for r in found.collect()}
    assert {i for i in range(300) if i in kept} == {i for i in range(300) if i % 5}
    assert {700, 704, 705, 706} <= set(kept) and not {701, 702, 703} & set(kept)
    assert kept[704].text == "write to <email> now" and kept[704].n_chars == 20 and kept[700].rate == 1
