"""Toxicity by a linear classifier on naive Bayes scaled character n-grams.

Features are the presence of hashed character n-grams of 3 to 5 letters, word
ends included.  A feature's value is the logarithm of the ratio of its
smoothed document frequencies in toxic and other texts, and a logistic
regression weighs the values.  No feature is left out: the smoothing brings
ratios without evidence to one, and the ridge term weights without use to zero.

The classifier is fitted on at most ``per_class`` labelled documents of either
class, those of the smallest hashed ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import binaries, counted, counter_rows, dropped, only, shared_dir, stored
from varigrid.llm.grams import gram_ladder, letter_streams
from varigrid.llm.language import held_out

LEAST, MOST, BITS = 3, 5, 18
PER_CLASS = 20_000
#: Steps of the regression's fit, and the tasks of each.
ROUNDS, TASKS = 25, 16


@dataclass
class Classifier:
    bias: float
    weights: np.ndarray  # by bucket, 0 for features never seen


def _present(column: pa.Array, chosen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: their number, and (text, bucket) of every feature present, each once."""
    stamp = np.zeros(1 << BITS, np.int64)
    for stream, starts in letter_streams(column):
        n = len(starts) - 1
        # the text that each place belongs to; what comes after the last text's start of the next is none's
        of = np.repeat(np.arange(n + 1), np.append(np.diff(starts), len(stream) - starts[n]))
        parts = []
        for size, buckets in gram_ladder(stream, LEAST, MOST, BITS):
            at = np.flatnonzero(chosen[buckets]) if chosen is not None else np.arange(len(buckets))
            doc = of[at]
            inside = (doc < n) & (at + size <= starts[np.minimum(doc, n - 1) + 1] + 1)
            doc, found = doc[inside], buckets[at[inside]]
            parts.append((np.searchsorted(doc, np.arange(n + 1)).tolist(), found))
        sizes, held = [], []
        for d in range(n):
            b = np.concatenate([found[ends[d] : ends[d + 1]] for ends, found in parts])
            # of a bucket's places in the text the one that was stamped last stays
            k = np.arange(len(b))
            stamp[b] = k
            held.append(b[stamp[b] == k])
            sizes.append(len(held[-1]))
        yield n, np.repeat(np.arange(n), sizes), np.concatenate(held)


def sample_of(labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic): of either class the ``per_class`` labelled ids of the smallest hash.
    An id with both labels counts as toxic; null ids and labels don't count."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda x: known.filter(f"toxic {'<>' if x else '='} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return part(0).union(part(1)).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier | None:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers; None without two classes."""
    chosen = sample_of(only(labels, "doc_id", "toxic"), per_class)
    # at most 2 * per_class rows of two numbers
    texts = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, np.int64)
        for batch in batches:
            toxic, at = batch.column(0).to_numpy().astype(np.int64), 0
            for n, doc, bucket in _present(batch.column(1), None):
                total += np.bincount(toxic[at + doc] << BITS | bucket, minlength=2 << BITS)
                at += n
        yield from counter_rows(total)

    seen = counted(texts.mapInArrow(count, "block int, counts binary"), BITS + 1).astype(np.float64)
    clean, toxic = seen[: 1 << BITS], seen[1 << BITS :]
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    # smoothed towards equal frequencies: the pseudo-counts are as the classes' sizes, and an n-gram without evidence gets 0
    few, more = (2 * sizes[c] / (sizes[0] + sizes[1]) for c in (1, 0))
    ratio = np.log((toxic + few) / (sizes[1] + few)) - np.log((clean + more) / (sizes[0] + more))

    # unclear ratios are shrunk by their squared standard error
    spread = 1 / (toxic + few) + 1 / (clean + more)
    ratio = ratio * ratio**2 / (ratio**2 + spread)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, doc, bucket in _present(batch.column(1), None):
                ends = np.searchsorted(doc, np.arange(n + 1))
                lists = [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(lists, pa.binary())], ["toxic", "features"])
                at += n

    path = shared_dir(docs.sparkSession)
    held = stored(texts.repartition(TASKS).mapInArrow(rows, "toxic int, features binary"), path)
    bias, w = logistic(held, ratio, sizes)
    dropped(docs.sparkSession, path)
    return Classifier(bias, w * ratio)


def logistic(held: DataFrame, scale: np.ndarray, sizes: dict[int, int], ridge: float = 1e-4, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Bias and weights of a class-balanced logistic regression on binary features times ``scale``.

    ``held`` (toxic, features) holds the places of a row's features as 32-bit
    numbers.  The driver holds weights and gradients only; a round sums up the
    loss and its gradient where the rows are.
    """
    spark, size = held.sparkSession, len(scale)
    share = [0.5 / max(1, sizes[c]) for c in (0, 1)]
    held = held.coalesce(TASKS)  # small files are read together

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast((v[:-1] * scale, v[-1]))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias = sent.value
            total, loss = np.zeros(size + 1), 0.0
            for batch in batches:
                for toxic, features in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    col = np.frombuffer(features.as_buffer(), np.uint32)
                    z = float(weights[col].sum()) + bias
                    # of log(1 + exp(-z)) for toxic rows and log(1 + exp(z)) for others
                    loss += share[toxic] * float(np.logaddexp(0.0, -z if toxic else z))
                    g = share[toxic] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
                    total[col] += g  # a row has a feature once
                    total[-1] += g
            yield pa.RecordBatch.from_arrays([pa.array([loss]), binaries([total.tobytes()])], ["loss", "gradient"])

        loss, total = 0.5 * ridge * float(v[:-1] @ v[:-1]), np.zeros(size + 1)
        # as Arrow, so that the driver holds a round's gradients once; a round's weights go from the driver too
        found = held.mapInArrow(part, "loss double, gradient binary").toArrow()
        for lost, gradient in zip(found["loss"].to_pylist(), found["gradient"], strict=True):
            loss += lost
            total += np.frombuffer(gradient.as_buffer())
        sent.destroy()
        return loss, np.append(total[:-1] * scale + ridge * v[:-1], total[-1])

    best = descended(at, np.zeros(size + 1), rounds)
    return float(best[-1]), best[:-1]


def descended(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, kept: int = 8, close: float = 1e-3) -> np.ndarray:
    """The least point of a convex function by limited-memory quasi-Newton steps; ``at`` gives value and gradient."""
    value, slope = at(x)
    start, steps = np.abs(slope).max(), deque(maxlen=kept)
    for _ in range(rounds):
        if np.abs(slope).max() <= close * start:
            break
        way, held = -slope, []
        for s, y, sy in reversed(steps):
            held.append(float(s @ way) / sy)
            way = way - held[-1] * y
        if steps:
            s, y, sy = steps[-1]
            way = way * (sy / float(y @ y))
        for (s, y, sy), h in zip(steps, reversed(held), strict=True):
            way = way + s * (h - float(y @ way) / sy)
        step, down = 1.0 if steps else min(1.0, 1 / float(np.abs(slope).sum())), float(slope @ way)
        for _ in range(20):
            new = x + step * way
            new_value, new_slope = at(new)
            if new_value <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if float(s @ y) > 1e-12:
            steps.append((s, y, float(s @ y)))
        x, value, slope = new, new_value, new_slope
    return x


def scored(docs: DataFrame, model: Classifier | None, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``score`` for every row of ``docs``; 0.5 everywhere without a model."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        mask = m.weights != 0 if m else None
        for batch in batches:
            z = [np.zeros(0)]
            if m:
                for n, doc, bucket in _present(batch.column(len(keep)), mask):
                    z.append(np.bincount(doc, weights=m.weights[bucket], minlength=n) + m.bias)
            z = np.concatenate(z) if m else np.zeros(batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(predict, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    A row is held out of learning if crc32 of its id as text is divisible by 5;
    a null id is neither learned from nor held out.  A null or empty text has no
    features and gets the classifier's bias.  Without labels of both classes
    every score is 0.5.
    """
    docs = only(docs, "doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)), per_class)
    found = scored(docs, model, "doc_id")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
