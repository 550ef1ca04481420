"""Ranked search with inverted treaps.

A term's postings in a block of documents are a treap: document order from left
to right, and no posting under one of less impact.  Items walk the treaps of
their terms together.  An interval of documents is bounded by the sum of its
terms' subtree roots; it goes as soon as that sum can't enter the item's best
``k``, else the document at its heaviest root is scored in full and the interval
falls into what lies left and right of it.

Blocks are cut from the rows of a task as they come, so the index needs no
shuffle and its memory follows the block; the best of one block prune the next.
Only an item's best rows of each task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.llm.common import only, stored
from varigrid.llm.shingles import mix
from varigrid.llm.tokens import Cutter, bitmap, place, within

#: Fixed value: every byte that is no letter or digit of ASCII; longer characters belong to terms.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bits of the bitmap of the items' terms, bytes of text cut at once.
BITS, TEXT_BYTES = 22, 4 << 20
#: Documents of a block, items searched together, (interval, term) pairs worked on at once, terms of one round of items.
BLOCK, ITEMS, PAIRS, ROUND_TERMS = 1 << 14, 64, 1 << 18, 1 << 19
_NONE = np.int64(-(2**63))


def _term_counts(held: np.ndarray | None):
    """Rows (id, n, terms, tf): a text's number of terms, its different ones that may be in ``held``, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(SEPARATORS)
        for batch in batches:
            for part in cutter.parts(batch.column(1), TEXT_BYTES):
                n, v = len(part.at) - 1, max(1, len(part.distinct))
                codes, rows = part.codes, part.rows() - part.first
                if held is not None and len(codes):
                    may = within(held, mix(part.hashes()), BITS)[codes]
                    codes, rows = codes[may], rows[may]
                keys, tf = np.unique(rows * v + codes, return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(n + 1) * v).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), pa.array(np.diff(part.at)),
                     pa.ListArray.from_arrays(bounds, part.distinct.take(pa.array(keys % v))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                    ["id", "n", "terms", "tf"],
                )

    return run


_COUNTS = "id long, n long, terms array<string>, tf array<int>"


def _bits(spark: SparkSession, terms: DataFrame):
    """The (term) rows as a bitmap of 2 ** BITS bits (512 KB), broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(b"")
        for batch in batches:
            for part in cutter.parts(batch.column(0), TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(place(mix(part.hashes()), BITS))], ["h"])

    words = terms.mapInArrow(run, "h long").groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("b"))
    return spark.sparkContext.broadcast(bitmap({r["w"]: r["b"] for r in words.collect()}, BITS))


# -- a block's treaps -----------------------------------------------------------


class Block:
    """Treaps of a block's postings, one after another: ``doc`` rises within a term's ``at[t]:at[t+1]``."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        self.ids, self.doc, self.impact = ids, doc, impact
        self.at = np.searchsorted(term, np.arange(terms + 1))
        self.key = term * len(ids) + doc
        self.left, self.right, self.root = self._linked(terms)

    def _linked(self, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children and roots.  Of equal impacts a scrambled number decides, so that equal documents make no chain."""
        n = len(self.doc)
        order = np.lexsort((mix(self.doc.astype(np.uint64)), self.impact))
        weight = np.empty(n, np.int64)
        weight[order] = np.arange(n)
        left, right, weights = [-1] * n, [-1] * n, weight.tolist()
        root = np.full(terms, -1, np.int64)
        for t in range(terms):
            path: list[int] = []
            for i in range(self.at[t], self.at[t + 1]):
                under, w = -1, weights[i]
                while path and weights[path[-1]] < w:
                    under = path.pop()
                left[i] = under
                if path:
                    right[path[-1]] = i
                path.append(i)
            if path:
                root[t] = path[0]
        return np.array(left, np.int64), np.array(right, np.int64), root

    def impacts(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of terms in documents, 0 where there is no posting."""
        key = term * len(self.ids) + doc
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0)


class Best:
    """The ``k`` best (score, id) of each item so far; of equal scores the smallest ids."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.score, self.id = k, *(np.empty(0, np.int64),) * 3
        self.least, self.last = np.zeros(items, np.int64), np.full(items, _NONE)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > self.least[item]) | ((score == self.least[item]) & (ids < self.last[item]))
        if not good.any():
            return
        item, score, ids = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.id, ids[good])))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        place_ = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
        full = place_ == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], ids[full]
        kept = place_ < self.k
        self.item, self.score, self.id = item[kept], score[kept], ids[kept]


def search(block: Block, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Walk the treaps for (item, term, weight) rows sorted by item; gives the number of documents scored."""
    here = block.root[term] >= 0
    item, term, weight = item[here], term[here], weight[here]
    if not len(item):
        return 0
    items, of = np.unique(item, return_inverse=True)
    n = len(block.ids)
    # intervals (item, low, high) and their (interval, node, term, weight) pairs
    waiting = [(items, np.zeros(len(items), np.int64), np.full(len(items), n), of, block.root[term], term, weight)]
    scored = 0
    while waiting:
        item, low, high, of, node, term, weight = waiting.pop()
        if len(of) > PAIRS and len(item) > 1:
            half = len(item) // 2
            cut = np.searchsorted(of, half)
            waiting.append((item[:half], low[:half], high[:half], of[:cut], node[:cut], term[:cut], weight[:cut]))
            waiting.append((item[half:], low[half:], high[half:], of[cut:] - half, node[cut:], term[cut:], weight[cut:]))
            continue
        node = _inside(block, node, low[of], high[of])
        has = node >= 0
        of, node, term, weight = of[has], node[has], term[has], weight[has]
        if not len(of):
            continue
        worth = weight * block.impact[node]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        own = of[heads]
        most = np.add.reduceat(worth, heads)
        least = best.least[item[own]]
        open_ = (most > least) | ((most == least) & (block.ids[low[own]] < best.last[item[own]]))
        if not open_.any():
            continue
        sizes = np.diff(np.append(heads, len(of)))
        pair = np.repeat(open_, sizes)
        item, low, high = item[own[open_]], low[own[open_]], high[own[open_]]
        of = np.repeat(np.arange(len(item)), sizes[open_])
        node, term, weight, worth = node[pair], term[pair], weight[pair], worth[pair]
        heads = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        top = np.flatnonzero(worth == np.maximum.reduceat(worth, heads)[of])
        top = top[np.concatenate([[True], of[top][1:] != of[top][:-1]])]
        middle = block.doc[node[top]]
        score = np.add.reduceat(weight * block.impacts(term, middle[of]), heads)
        scored += len(item)
        best.add(item, score, block.ids[middle])
        # both sides of every interval wait together, so that a step has many pairs
        low, high = np.concatenate([low, middle + 1]), np.concatenate([middle, high])
        some = low < high
        number = np.cumsum(some) - 1
        of = np.concatenate([of, of + len(item)])
        pair = some[of]
        item, node, term, weight = (np.concatenate([x, x]) for x in (item, node, term, weight))
        if some.any():
            waiting.append((item[some], low[some], high[some], number[of[pair]], node[pair], term[pair], weight[pair]))
    return scored


def _inside(block: Block, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of each subtree's part between ``low`` and ``high``, -1 where it has none."""
    node = node.copy()
    left_over = np.arange(len(node))
    while len(left_over):
        doc = block.doc[node[left_over]]
        under, over = doc < low[left_over], doc >= high[left_over]
        moved = under | over
        left_over, under = left_over[moved], under[moved]
        at = node[left_over]
        node[left_over] = np.where(under, block.right[at], block.left[at])
        left_over = left_over[node[left_over] >= 0]
    return node


def _searcher(held, n_docs: int, n_terms: int, k: int):
    """Rows (row, id, score): each item's best of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, term, weight, rows = held.value
        code = pa.array(names)
        best = Best(len(rows), k)
        ids, n, doc, terms, tf, full = [], [], [], [], [], 0

        def flush() -> None:
            nonlocal ids, n, doc, terms, tf, full
            if full and sum(map(len, doc)):
                all_ids, all_n = np.concatenate(ids), np.concatenate(n)
                by_id = np.argsort(all_ids, kind="stable")
                rank = np.empty(full, np.int64)
                rank[by_id] = np.arange(full)
                t, f, d = np.concatenate(terms), np.concatenate(tf), np.concatenate(doc)
                m = 25 + (75 * all_n[d] * n_docs) // n_terms
                impact = (1_000_000_000 * f) // (1000 * f + 8 * m)
                d = rank[d]
                order = np.lexsort((d, t))
                block = Block(all_ids[by_id], t[order], d[order], impact[order], len(names))
                for i in range(0, len(rows), ITEMS):
                    a, b = np.searchsorted(item, (i, i + ITEMS))
                    search(block, item[a:b], term[a:b], weight[a:b], best)
            ids, n, doc, terms, tf, full = [], [], [], [], [], 0

        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                found = pc.index_in(batch.column(2).flatten(), code)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                lengths = pc.list_value_length(batch.column(2)).to_numpy()
                of = np.repeat(np.arange(batch.num_rows), lengths)
                ids.append(batch.column(0).fill_null(int(_NONE)).to_numpy())
                n.append(batch.column(1).to_numpy())
                doc.append(of[known] + full)
                terms.append(found.drop_null().to_numpy().astype(np.int64))
                tf.append(batch.column(3).flatten().to_numpy()[known].astype(np.int64))
                full += batch.num_rows
                if full >= BLOCK:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(rows)[best.item]), pa.array(best.id), pa.array(best.score)], ["row", "id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    With N documents of at least one term, L terms in all of them, and for a term
    its documents df and w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document of n
    terms scores the sum of w * (10**9 tf div (1000 tf + 8 m)) over the item's terms,
    repeats included, where m = 25 + (75 n N) div L.

    A null or empty text has no term and is never found; equal scores go by id, a
    null id first; repeated documents are ranked one by one; repeated items are
    answered one by one, so that their rows repeat; empty tables give no rows; other
    columns are not looked at.  Texts are read in whole.

    Items are searched in rounds of about ROUND_TERMS terms, which a task holds; the
    documents' terms that any item may have are written once for all rounds.
    """
    spark = docs.sparkSession
    asked = only(items, "item_id", "text").selectExpr("CAST(item_id AS BIGINT) AS item_id", "text").withColumn("row", F.monotonically_increasing_id())
    asked = stored(asked.select("row", "text", "item_id"))
    per_item = stored(asked.select("row", "text").mapInArrow(_term_counts(None), _COUNTS).withColumnRenamed("id", "row").where("n > 0"))
    words = per_item.select("row", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.tf").alias("times"))
    held = _bits(spark, words.select("term").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _term_counts(held.value)(batches)

    texts = only(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    forward = stored(texts.mapInArrow(count, _COUNTS).where("n > 0"))
    total = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    size = per_item.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()["t"]
    found = "row long, id long, score long"
    if not size or not total["n"]:
        best = spark.createDataFrame([], found)
    else:
        df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000.0 * F.log((2.0 * total["n"] + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        pairs = words.join(df, "term").select("row", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")
        rounds = -(-size // ROUND_TERMS)
        pairs = stored(pairs.withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds))))
        best = None
        for i in range(rounds):
            own = pairs.where(F.col("round") == i).select("row", "term", "weight").orderBy("row").toArrow()
            if not own.num_rows:
                continue
            some = spark.sparkContext.broadcast(_packed(own))
            part = forward.where(F.size("terms") > 0).mapInArrow(_searcher(some, total["n"], total["l"], k), found)
            best = part if best is None else best.unionByName(part)
        best = best if best is not None else spark.createDataFrame([], found)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc_id = F.when(F.col("id") != int(_NONE), F.col("id")).alias("doc_id")
    return best.join(asked.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")


def _packed(pairs: pa.Table) -> tuple:
    """A round's items for the tasks: its terms, and (item, term, weight) in numbers, sorted by item; the items' rows."""
    coded = pairs.column("term").combine_chunks().dictionary_encode()
    rows, item = np.unique(pairs.column("row").to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    term = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), item[order], term[order], pairs.column("weight").to_numpy()[order], rows


def ranked_sql() -> str:
    """The same rows in SQL: every document that shares a term is scored."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS row, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
total AS (SELECT COUNT(*) AS n, SUM(len(t)) AS l FROM d WHERE len(t) > 0),
words AS (SELECT row, term, CAST(COUNT(*) AS BIGINT) AS times FROM (SELECT row, unnest(t) AS term FROM i) GROUP BY row, term),
tf AS (SELECT row, term, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT row, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM words) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n + 2) / (2.0 * COUNT(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n),
p AS (SELECT tf.row, d.doc_id, tf.term, (1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * len(d.t) * total.n) // total.l AS BIGINT))) AS impact
      FROM tf JOIN d ON d.row = tf.row, total),
s AS (SELECT words.row, p.row AS doc, p.doc_id, CAST(SUM(words.times * w.w * p.impact) AS BIGINT) AS score
      FROM words JOIN w USING (term) JOIN p ON p.term = words.term GROUP BY words.row, p.row, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT i.item_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id, r.score FROM r JOIN i ON i.row = r.row WHERE r.rank <= 10"""
