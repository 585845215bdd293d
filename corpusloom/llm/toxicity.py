"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-cased terms. The machine adds a weight for
each term and the product of two terms' vectors for each pair, so it learns what two
terms say together. It is trained in numpy, on labelled rows only, at most
``TRAIN_ROWS`` of them: those of the smallest hashes of doc_id, whatever the table's
size. Terms enter the model if they tell the labels apart alone, or if with another
term they do so far better than the two apart: of the ``PAIR_TERMS`` most frequent terms
every pair is tested. Both tests allow for their number, so that chance lets in a term
in a hundred trainings; that keeps out terms which wrong labels would make it learn by
heart, and lets in those that say something only together. The terms' counts are summed
where the rows lie; of each row only terms that pass or take part in pairs are gathered.

Edge cases: null or empty text has no term and gets the score of the bias; a null
label or doc_id, or a label of no document, trains nothing; no labels, or labels of
one kind, give the share of ones (0 for none) to all rows; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from corpusloom.llm.arrays import PrefixHash, byte_view, column, lower_ascii, map_text, mixed, words_of
from corpusloom.llm.decontaminate import WORD
from corpusloom.plans.session import materialize

BUCKETS = 1 << 18
TRAIN_ROWS = 12_000
LEAST_ROWS = 5
PAIR_TERMS = 1024
CHANCE = 0.01
FACTORS = 6
_GAPS = np.array([not WORD.match(bytes([c]).lower()) for c in range(256)])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text leaves no rest by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5 == 0


def terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term of every distinct term of every row, in order."""
    data, rows = byte_view(column(batch, "text"))
    data = lower_ascii(data)
    starts, ends, first = words_of(data, rows, _GAPS)
    bucket = (mixed(PrefixHash(data).of(starts, ends)) % np.uint64(BUCKETS)).astype(np.int64)
    return np.repeat(np.arange(len(rows) - 1), np.diff(first)), bucket


@dataclass(frozen=True)
class Machine:
    """``slot`` numbers the hashed terms that the model knows; -1 for others."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, n: int, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Of n rows, from distinct (row, slot) pairs."""
        linear = self.bias + np.bincount(rows, self.weights[slots], n)
        own = self.factors[slots]
        total = np.stack([np.bincount(rows, own[:, f], n) for f in range(own.shape[1])], 1)
        square = np.bincount(rows, (own**2).sum(1), n)
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * ((total**2).sum(1) - square), -30, 30)))


def limit(tests: float) -> float:
    """The chi-square that the largest of so many tests passes by chance in ``CHANCE`` of cases."""
    return 2 * float(np.log(max(tests, 1) / CHANCE))


def surprise(n: np.ndarray, hit: np.ndarray, rate: float) -> np.ndarray:
    """Chi-square of groups of n rows, hit of them of label one, against a share of ``rate``."""
    return (hit - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9) * (n > 0)


def apart(n: int, rate: float, have: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Chi-square of rows with a term against rows without it."""
    return surprise(have, hit, rate) + surprise(n - have, n * rate - hit, rate)


def telling(n: int, positive: float, have: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms that tell alone, the most frequent terms) from rows with each term and their labels."""
    usable = (have >= LEAST_ROWS) & (have < n)
    alone = np.flatnonzero(usable & (apart(n, positive / n, have, hit) >= limit(usable.sum())))
    frequent = np.argsort(-np.where(usable, have, 0), kind="stable")[: min(PAIR_TERMS, int(usable.sum()))]
    return alone, frequent


def telling_pairs(labels: np.ndarray, rows: np.ndarray, terms_: np.ndarray, k: int, chunk: int = 2000) -> np.ndarray:
    """Terms of 0..k-1 that tell the labels apart together with another, not by themselves.

    A pair's four groups of rows are set against what its two terms say apart.
    """
    n, rate = len(labels), float(labels.mean())
    both, hits = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    bounds = np.searchsorted(rows, np.arange(0, n + chunk, chunk))
    for at, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = np.zeros((min(chunk, n - at * chunk), k), np.float32)
        own[rows[a:z] - at * chunk, terms_[a:z]] = 1
        both += own.T @ own
        ones = own[labels[at * chunk : at * chunk + len(own)] > 0]
        hits += ones.T @ ones
    have, hit = both.diagonal().astype(float), hits.diagonal().astype(float)
    single, found = apart(n, rate, have, hit), np.zeros(k, bool)
    most = limit(k * (k - 1) / 2)
    for i in range(k):
        b, h = both[i].astype(float), hits[i].astype(float)
        joint = surprise(b, h, rate) + surprise(have[i] - b, hit[i] - h, rate) + surprise(have - b, hit - h, rate) + surprise(n - have - have[i] + b, n * rate - hit - hit[i] + h, rate)
        strong = (joint - single - single[i] >= most) & (b >= LEAST_ROWS) & (np.arange(k) != i)
        found |= strong
        found[i] |= strong.any()
    return np.flatnonzero(found)


def fit(labels: np.ndarray, offsets: np.ndarray, buckets: np.ndarray, epochs: int = 30, seed: int = 7, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Machine:
    """Trains on rows whose distinct hashed terms lie at ``offsets`` of ``buckets``.

    ``counts`` are rows with each term, and those of label one, where not all terms are given.
    """
    n, positive = len(labels), float(labels.sum())
    slot = np.full(BUCKETS, -1, np.int32)
    bias = float(np.log((positive + 1e-9) / (n - positive + 1e-9))) if n else -30.0
    if not 0 < positive < n:
        return Machine(slot, float(np.clip(bias, -30, 30)), np.zeros(1), np.zeros((1, FACTORS)))
    of = np.repeat(np.arange(n), np.diff(offsets))
    have, hit = counts or (np.bincount(buckets, minlength=BUCKETS).astype(float), np.bincount(buckets, labels[of], BUCKETS))
    alone, frequent = telling(n, positive, have, hit)
    place = np.full(BUCKETS, -1, np.int32)
    place[frequent] = np.arange(len(frequent))
    common = place[buckets] >= 0
    together = frequent[telling_pairs(labels, of[common], place[buckets[common]], len(frequent))]
    chosen = np.union1d(alone, together)
    slot[chosen] = np.arange(len(chosen))
    known = slot[buckets] >= 0
    rows, slots = of[known], slot[buckets[known]]
    bounds = np.searchsorted(rows, np.arange(n + 1))
    random = np.random.default_rng(seed)
    weights, factors = np.zeros(len(chosen)), random.normal(0, 0.05, (len(chosen), FACTORS))
    seen_w, seen_v, seen_b = np.full_like(weights, 1e-4), np.full_like(factors, 1e-4), 1e-4
    size = 128
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, size):
            own = order[at : at + size]
            spans = [np.arange(bounds[i], bounds[i + 1]) for i in own]
            pick = np.concatenate(spans)
            r, s = np.repeat(np.arange(len(own)), [len(x) for x in spans]), slots[pick]
            p = Machine(slot, bias, weights, factors).scores(len(own), r, s)
            error = (p - labels[own]) / len(own)
            total = np.stack([np.bincount(r, factors[s, f], len(own)) for f in range(FACTORS)], 1)
            gw = np.bincount(s, error[r], len(weights)) + 1e-5 * weights
            step = error[r, None] * (total[r] - factors[s])
            gv = np.stack([np.bincount(s, step[:, f], len(weights)) for f in range(FACTORS)], 1) + 1e-4 * factors
            gb = error.sum()
            seen_w += gw**2
            seen_v += gv**2
            seen_b += gb**2
            weights -= 0.3 * gw / np.sqrt(seen_w)
            factors -= 0.05 * gv / np.sqrt(seen_v)
            bias -= 0.1 * gb / np.sqrt(seen_b)
    if not len(chosen):
        weights, factors = np.zeros(1), np.zeros((1, FACTORS))
    return Machine(slot, float(bias), weights, factors)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled rows; their terms' counts and telling terms reach the driver."""
    usable = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).where(~held_out() & F.col("toxic").isNotNull())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` short rows

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        row, bucket = terms(batch)
        pairs = np.unique(row * BUCKETS + bucket)
        bounds = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * BUCKETS)
        return {"terms": pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array((pairs % BUCKETS).astype(np.int32)))}

    hashed = materialize(map_text(known, ["doc_id", "toxic"], [StructField("terms", ArrayType(IntegerType()))], work), "terms")
    summed = hashed.mapInArrow(_term_counts, "bucket int, have double, hit double").groupBy("bucket").agg(F.sum("have").alias("have"), F.sum("hit").alias("hit")).toArrow()
    have, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)  # one number for each bucket at most
    at = summed.column("bucket").to_numpy()
    have[at], hit[at] = summed.column("have").to_numpy(), summed.column("hit").to_numpy()
    total = hashed.agg(F.count("*"), F.sum("toxic")).first()
    n, positive = total[0], total[1] or 0.0
    wanted = np.union1d(*telling(n, positive, have, hit)) if 0 < positive < n else np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(BUCKETS), wanted))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, offsets = list_parts(column(batch, "terms"))
            keep = shared.value[bucket]
            bounds = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.ListArray.from_arrays(bounds, pa.array(bucket[keep]))], names=["doc_id", "toxic", "terms"])

    # of a row at most the telling terms and ``PAIR_TERMS`` frequent ones
    found = hashed.mapInArrow(pick, hashed.schema).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    parts = [list_parts(c) for c in found.column("terms").chunks]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(o) for _, o in parts)])
    own = np.concatenate([np.zeros(0, np.int64), *(b for b, _ in parts)]).astype(np.int64)
    return fit(found.column("toxic").to_numpy(), np.cumsum(sizes), own, counts=(have, hit))


def list_parts(column_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists of a column, and the offsets between the lists."""
    offsets = column_.offsets.to_numpy().astype(np.int64)
    return column_.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows with each term, and those of them of label one."""
    have, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for batch in batches:
        bucket, offsets = list_parts(column(batch, "terms"))
        have += np.bincount(bucket, minlength=BUCKETS)
        hit += np.bincount(bucket, np.repeat(column(batch, "toxic").to_numpy(zero_copy_only=False), np.diff(offsets)), BUCKETS)
    at = np.flatnonzero(have)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(have[at]), pa.array(hit[at])], names=["bucket", "have", "hit"])


SCORE = [StructField("score", DoubleType())]


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Adds the model's probability to every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        model = shared.value
        row, bucket = terms(batch)
        slots = model.slot[bucket]
        pairs = np.unique(row[slots >= 0] * len(model.weights) + slots[slots >= 0])
        return {name: model.scores(batch.num_rows, pairs // len(model.weights), pairs % len(model.weights))}

    return map_text(docs, list(keep), [StructField(name, DoubleType())], work)


def decided(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
