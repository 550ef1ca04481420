"""Language identification by multilingual mixtures.

A document's character trigrams are taken as drawn from a mixture of the
languages' trigram distributions and a flat one for what is none of them.
Expectation-maximisation estimates the proportions.  The set of languages grows
from the best single one for as long as the likelihood, less a penalty of
``PENALTY * log(trigrams)`` for each further member, rises.

The distributions are learned from labelled documents: one count per language
and hashed trigram, an array whose size doesn't depend on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import counted, counter_rows, only
from varigrid.llm.grams import gram_hashes, letter_streams

SIZE, BITS = 3, 15
#: Added to each trigram's count.
SMOOTH = 0.5
PENALTY = 2.0
ROUNDS, TOLERANCE = 30, 1e-4
#: More languages than this in the labels are an error rather than a growing model.
MOST_LANGUAGES = 512


class Model:
    """Trigram distributions of some languages, in ascending order of their names, and a flat one last."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts.astype(np.float64) + SMOOTH
        p = c / c.sum(axis=1, keepdims=True)
        flat = np.full((1, p.shape[1]), 1.0 / p.shape[1])
        self.p = np.ascontiguousarray(np.concatenate([p, flat]).T)
        self.logp = np.log(self.p)

    def mixture(self, grams: np.ndarray) -> tuple[np.ndarray, int]:
        """Proportions of the languages and of the flat distribution for a text's trigrams, and the likeliest single language."""
        counts = np.bincount(grams, minlength=1 << BITS)
        u = np.flatnonzero(counts)
        c = counts[u].astype(np.float64)
        total = c.sum()
        p = self.p[u]
        single = c @ self.logp[u]
        members = [int(np.argmax(single))]
        share, best = np.ones(1), float(single[members[0]])
        while len(members) < p.shape[1]:
            mixed = p[:, members] @ share
            gain = (c / mixed) @ p
            gain[members] = -1.0
            j = int(np.argmax(gain))
            if gain[j] <= total:  # no mixture with a further member is likelier
                break
            trial = [*members, j]
            new, like = em(p[:, trial], c, np.append(share * 0.8, 0.2))
            if like - PENALTY * np.log(total + 1.0) <= best:
                break
            members, share, best = trial, new, like
        out = np.zeros(p.shape[1])
        out[members] = share
        return out, int(np.argmax(single[:-1]))


def em(p: np.ndarray, c: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns of p in observations with counts c, and their log-likelihood."""
    total = c.sum()
    for _ in range(ROUNDS):
        new = share * ((c / (p @ share)) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(c @ np.log(p @ share))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the part kept from learning; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learn(labelled: DataFrame) -> Model | None:
    """A model from (lang, text) rows; rows with a null lang don't count.  None if there are none."""
    labelled = only(labelled, "lang", "text").filter("lang is not null")
    found = labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    k = max(1, (len(languages) - 1).bit_length())
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS + k, np.int64)
        for batch in batches:
            which = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            at = 0
            for stream, starts in letter_streams(batch.column(1)):
                n = len(starts) - 1
                grams = gram_hashes(stream, SIZE, BITS)
                doc = np.repeat(np.arange(n), np.diff(starts))[: len(grams)]
                inside = np.arange(len(grams)) + SIZE <= (starts[1:] + 1)[doc]
                total += np.bincount(grams[inside] + (which[at + doc[inside]] << BITS), minlength=len(total))
                at += n
        yield from counter_rows(total, np.uint64)

    counts = counted(labelled.mapInArrow(count, "block int, counts binary"), BITS + k, np.uint64)
    return Model(languages, counts.reshape(-1, 1 << BITS)[: len(languages)])


def _mixtures(column: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, int] | None]:
    """A text's proportions and likeliest language, or None for one without a letter."""
    for stream, starts in letter_streams(column):
        grams = gram_hashes(stream, SIZE, BITS)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            # the 0 before the text, the text, and the 0 that follows
            yield model.mixture(grams[a : b + 1 - SIZE + 1]) if b - a > 1 and stream[a + 1 : b].any() else None


def identify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The ``keep`` columns and lang_pred, score, other, langs for every row of ``docs``.

    ``score`` is the predicted language's proportion, ``other`` that of the flat
    distribution, ``langs`` the selected languages and their proportions.  A
    text that is null or has no letter, and any text without a model, gives
    ``und``, 0, 0 and none.  A text taken wholly for the flat distribution gets
    the language of the highest likelihood with score 0.
    """
    schema = docs.select(*keep).schema.simpleString()[7:-1].replace(":", " ", len(keep))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores, others, sets = [], [], [], []
            for found in _mixtures(batch.column(len(keep)), m) if m else [None] * batch.num_rows:
                if found is None:
                    names.append("und")
                    scores.append(0.0)
                    others.append(0.0)
                    sets.append([])
                    continue
                share, likeliest = found
                best = int(np.argmax(share[:-1])) if share[:-1].any() else likeliest
                names.append(m.languages[best])
                scores.append(min(1.0, float(share[best])))
                others.append(float(share[-1]))
                sets.append([(m.languages[i], float(share[i])) for i in np.flatnonzero(share[:-1])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores), pa.array(others, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                [*keep, "lang_pred", "score", "other", "langs"],
            )

    return docs.select(*keep, F.col("text")).mapInArrow(predict, f"{schema}, lang_pred string, score double, other double, langs map<string,double>")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, other, langs) for every row of ``docs`` (doc_id, text, lang).

    A row is held out of learning if crc32 of its id as text leaves 2 when
    divided by 4; a null id is neither learned from nor held out.
    """
    docs = only(docs, "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~out))
    found = identify(docs, model, "doc_id")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "other", "langs")


def with_a_language(docs: DataFrame, most_other: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in some learned language, with the columns they had.

    Rejected are texts that are null or without a letter, and those of which
    the flat distribution takes more than ``most_other``.
    """
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [m is not None and m[0][-1] <= most_other for m in _mixtures(batch.column(text), shared.value)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
