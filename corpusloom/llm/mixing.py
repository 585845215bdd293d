"""Mixing documents to target weights of domains, with soft membership.

A softmax regression, trained on a labelled table, gives each document a posterior
over the domains. A document's rate says how often it is drawn; its tokens, counted by
the transducer of ``tokencount`` (its words where no tokenizer is given), count for
each domain by posterior. The rates minimise the squares of what the domains' expected
token totals miss of their targets, weighted by the inverse of their curvature matrix,
subject to being nonnegative. They are found by scaled projected gradient from rates of one, which goes on until the largest miss is within ``TOLERANCE`` of all tokens, or until
steps no longer lessen the squares: then no nonnegative rates meet the targets. What is
missed is a column of the result.

A rate's gradient needs its document's posterior and the few domains' totals only. So
documents stay where they are: a step is one pass that replays the earlier steps'
domain vectors on the posteriors and sums the new totals, a row of numbers a task.

Edge cases: null or empty text has no tokens and a posterior from the bias; a null
label or doc_id trains nothing; no labels give an equal posterior; a domain of the
targets that no label names has posterior zero and its target is missed; labels that
no target names have target zero; repeated rows each get a row; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm.arrays import SPACES, byte_view, column, map_text, words_of
from corpusloom.llm.tokencount import count_tokens, transducer
from corpusloom.llm.toxicity import terms
from corpusloom.plans.session import materialize

BUCKETS = 1 << 15
TRAIN_ROWS = 6_000
#: Training rows in the order of their hashes count up to so many terms.
TRAIN_TERMS = 6_000_000
TOLERANCE = 1e-4
#: Steps without a lesser sum of squares, by this share, after which there is none.
PATIENCE, PROGRESS = 10, 1e-2


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of distinct hashed terms, of length one by row, and word counts."""
    row, bucket = terms(batch)
    pairs, times = np.unique(row * BUCKETS + bucket % BUCKETS, return_counts=True)
    row, bucket, value = pairs // BUCKETS, pairs % BUCKETS, 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, batch.num_rows))
    data, rows = byte_view(column(batch, "text"))
    words = np.diff(words_of(data, rows, SPACES)[2])
    return row, bucket, value / norm[row], words


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  #: (bucket, domain)
    bias: np.ndarray

    def posteriors(self, n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        z = np.stack([np.bincount(row, self.weights[bucket, k] * value, n) for k in range(len(self.domains))], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(domains: tuple[str, ...], label: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, value: np.ndarray, epochs: int = 12, seed: int = 5) -> Classifier:
    """Softmax regression by AdaGrad with a little weight decay."""
    n, k = len(label), len(domains)
    weights, bias = np.zeros((BUCKETS, k)), np.log((np.bincount(label, minlength=k) + 1) / (n + k))
    seen, seen_b, random = np.full((BUCKETS, k), 1e-3), np.full(k, 1e-3), np.random.default_rng(seed)
    for _ in range(epochs if k > 1 else 0):
        order = random.permutation(n)
        for at in range(0, n, 256):
            own = order[at : at + 256]
            spans = [np.arange(offsets[i], offsets[i + 1]) for i in own]
            pick, r = np.concatenate(spans), np.repeat(np.arange(len(own)), [len(s) for s in spans])
            error = Classifier(domains, weights, bias).posteriors(len(own), r, bucket[pick], value[pick])
            error[np.arange(len(own)), label[own]] -= 1
            error /= len(own)
            g = np.stack([np.bincount(bucket[pick], error[r, c] * value[pick], BUCKETS) for c in range(k)], 1) + 1e-6 * weights
            seen += g**2
            seen_b += error.sum(0) ** 2
            weights -= 0.5 * g / np.sqrt(seen)
            bias -= 0.1 * error.sum(0) / np.sqrt(seen_b)
    return Classifier(domains, weights, bias)


def train(docs: DataFrame, labels: DataFrame, domain: str | Column = "domain", rows: int = TRAIN_ROWS) -> Classifier:
    """Fits on at most ``rows`` labelled rows, those of the smallest hashes of doc_id."""
    named = labels.select("doc_id", (F.col(domain) if isinstance(domain, str) else domain).cast("string").alias("domain"))
    chosen = named.where("domain IS NOT NULL AND doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` short rows

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        row, bucket, value, _ = features(batch)
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        return {"bucket": pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32))), "value": pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32)))}

    kinds = [StructField("bucket", ArrayType(IntegerType())), StructField("value", ArrayType(FloatType()))]
    ready = materialize(map_text(known, ["doc_id", "domain"], kinds, work), "terms")
    by = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = ready.select("doc_id", "domain", F.sum(F.size("bucket")).over(by).alias("so_far")).where(F.col("so_far") > TRAIN_TERMS)  # of at most ``rows`` rows
    over = F.broadcast(sized.select("doc_id", "domain").distinct())
    found = ready.join(over, ["doc_id", "domain"], "left_anti").toArrow().sort_by([("doc_id", "ascending"), ("domain", "ascending")])
    domains = tuple(sorted(set(found.column("domain").to_pylist()))) or ("all",)
    label = np.array([domains.index(d) for d in found.column("domain").to_pylist()], np.int64)
    sizes = np.array([len(x) for x in found.column("bucket")], np.int64)
    flat = [np.concatenate([c.flatten().to_numpy() for c in found.column(n).chunks] or [np.zeros(0)]) for n in ("bucket", "value")]
    return fit(domains, label, np.concatenate([[0], np.cumsum(sizes)]), flat[0].astype(np.int64), flat[1].astype(float))


def posteriors(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None) -> DataFrame:
    """Adds token counts (``n_tokens``) and the posterior over the model's domains.

    Tokens are those of the tokenizer file at ``tokenizer`` of the driver, else words.
    """
    context = docs.sparkSession.sparkContext
    shared, file = context.broadcast(model), context.broadcast(Path(tokenizer).read_bytes() if tokenizer else None)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        row, bucket, value, words = features(batch)
        if file.value is not None:
            words = count_tokens([t or "" for t in column(batch, "text").to_pylist()], transducer(file.value))
        p = shared.value.posteriors(batch.num_rows, row, bucket, value)
        bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * p.shape[1]
        return {"n_tokens": words, "posterior": pa.ListArray.from_arrays(bounds, pa.array(p.ravel()))}

    return map_text(docs, list(keep), [StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))], work, batch_bytes=3 << 19 if tokenizer else 4 << 20)


@dataclass
class Steps:
    """The domain vectors of the steps so far; a rate is a replay of them.

    ``gap`` is the largest miss of a domain's target, as a share of all tokens.
    """

    vectors: list[np.ndarray]
    momentum: list[float]
    gap: float = 0.0

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, extrapolated rates) of documents with posteriors p."""
        now = ahead = np.ones(len(p))
        for vector, push in zip(self.vectors, self.momentum, strict=True):
            new = np.maximum(0.0, ahead - p @ vector)
            ahead, now = new + push * (new - now), new
        return now, ahead


def _sums(table: DataFrame, width: int, of: Steps) -> np.ndarray:
    """Totals over all documents of rates and extrapolated rates, and two curvatures.

    The first curvature is of all documents, the second of those with an extrapolated
    rate above zero: a matrix row for each domain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 + 2 * width, width))
        for batch in batches:
            n = column(batch, "n_tokens").to_numpy().astype(float)
            p = column(batch, "posterior").flatten().to_numpy().reshape(-1, width)
            now, ahead = of.rates(p)
            free = ahead > 0
            total += np.concatenate([[(now * n) @ p, (ahead * n) @ p], (p * n[:, None]).T @ p, (p[free] * n[free, None]).T @ p[free]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    found = table.select("n_tokens", "posterior").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((2 + 2 * width) * width)
    for r in found:  # two numbers for each pair of domains at most
        out[r.i] = r.v
    return out.reshape(-1, width)


def descend(sums: Callable[[Steps], np.ndarray], goal: np.ndarray, tolerance: float = TOLERANCE) -> Steps:
    """Steps until the totals are the goal, or the squares of what they miss grow no less.

    A step is scaled by the curvature of the documents whose rates are free to move. Where
    that overshoots, as rates reach zero, the next ones are scaled by the curvature of all
    documents, which always descends, with momentum.
    """
    width, done = len(goal), Steps([], [])
    now, ahead, *rows = sums(done)
    scaled = lambda m: np.linalg.inv(m + 1e-9 * max(np.trace(m), 1e-9) * np.eye(width))
    weight, whole = scaled(np.array(rows[:width])), now.sum()
    squares = lambda x: float((x - goal) @ weight @ (x - goal))
    best = before = squares(now)
    free, t, idle = True, 1.0, 0
    while np.abs(now - goal).max() > tolerance * whole and idle < PATIENCE:
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        done.vectors.append((scaled(np.array(rows[width:])) if free else weight) @ (ahead - goal))
        done.momentum.append(0.0 if free else (t - 1) / after)
        now, ahead, *rows = sums(done)
        worse = squares(now) > before
        free, t = (free != worse), (1.0 if free or worse else after)
        idle = 0 if squares(now) < best * (1 - PROGRESS) else idle + 1
        best, before = min(best, squares(now)), squares(now)
    done.gap = float(np.abs(now - goal).max() / whole) if whole else 0.0
    return done


def fit_rates(table: DataFrame, domains: tuple[str, ...], targets: dict[str, float], tolerance: float = TOLERANCE) -> Steps:
    """Steps towards rates whose expected totals are the targets' shares of all tokens."""
    weights, every = np.array([targets.get(d, 0.0) for d in domains]), sum(targets.values())
    whole = table.agg(F.sum("n_tokens")).first()[0] or 0
    if not whole or not every:
        return Steps([], [])
    done = descend(lambda steps: _sums(table, len(domains), steps), whole * weights / every, tolerance)
    done.gap = max(done.gap, *(w / every for d, w in targets.items() if d not in domains), 0.0)
    return done


RATES = [StructField("domain", StringType()), StructField("rate", DoubleType()), StructField("gap", DoubleType())]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str | Column = "domain", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None) -> DataFrame:
    """(kept columns, n_tokens, posterior, domain, rate, gap) of every document.

    ``domain`` is the likeliest one. The totals of n_tokens * posterior * rate are the
    targets' shares of all tokens, as near as nonnegative rates come; ``gap``, the same
    in all rows, is the largest miss as a share of all tokens.
    """
    model = train(docs, labels, domain)
    names = [c for c in keep if c not in ("n_tokens", "posterior", "domain", "rate", "gap")]
    table = materialize(posteriors(docs, model, tuple(names), tokenizer), "posteriors")
    width, found = len(model.domains), fit_rates(table, model.domains, targets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = column(batch, "posterior").flatten().to_numpy().reshape(-1, width)
            made = [pa.array([model.domains[i] for i in p.argmax(1)], pa.string()), pa.array(found.rates(p)[0]), pa.array(np.full(len(p), found.gap))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "domain", "rate", "gap"])

    schema = StructType([*table.schema.fields, *RATES])
    return table.mapInArrow(work, schema)
