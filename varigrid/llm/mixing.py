"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted ``rate(s) = share(s) * total / n(s)`` times on
average.  How often it comes is drawn from the Poisson distribution of that
mean by inverting its cumulative function at a number that the document's id
and a seed fix, so that any executor, and any later run, draws the same.  A large
mean is drawn in equal parts, each with a number of its own, and added up: the
sum of independent Poisson counts is a Poisson count of the means' sum.
Documents are exploded by their counts and put in an order that a second hash
of id, copy and seed fixes.  All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources beyond this number are joined by shuffle rather than broadcast.
MOST_BROADCAST = 100_000
#: Means up to ``WHOLE`` are drawn at once (``exp(-mean)`` is a double's normal number); larger ones in parts of at most ``PART``.
WHOLE, PART = 700, 500
#: Ids of 13 hexadecimal digits are exact in a double.
_SPAN = float(16**13)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that the key fixes."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... for a mean, to where they leave double precision."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c")
    )
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["c"])


def parts(rate: Column) -> Column:
    """In how many equal parts a mean is drawn."""
    return F.when(rate <= WHOLE, 1).otherwise(F.ceil(rate / PART)).cast("int")


def drawn(cdf: Column, number: Column, *key: Column) -> Column:
    """A Poisson count: ``number`` draws from one part's cumulative probabilities, added up.

    The key fixes the first draw, the key and the part's place the others.
    """
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    rest = F.aggregate(F.sequence(F.lit(1), number - 1), F.lit(0), lambda acc, i: acc + below(uniform(*key, i)))
    return below(F.col("_u")) + F.when(number > 1, rest).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """(source, n, rate): how often each document of a source is wanted.

    Without weights all sources get equal shares.  Sources that the weights
    don't name get none, and their documents none.  ``total`` is the number of
    documents wanted, by default as many as there are.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        share = counts.withColumn("weight", F.lit(1.0))
    else:
        names = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
        known = F.coalesce(F.element_at(names, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
        share = counts.withColumn("weight", F.when(F.col("source").isNull(), 0.0).otherwise(known))
    sums = share.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("n")).otherwise(F.lit(0.0))
    return share.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 1) -> DataFrame:
    """The columns of ``docs`` and ``_copy`` (0, 1, ...), each row as often as drawn, in shuffled order.

    Needs doc_id and source.  A null source is a source of its own, which
    weights can't name; null ids draw as one id does.  Rows that repeat an
    id and a source draw the same count, each for itself.  An empty table gives
    an empty mixture.  Means may be of any size, so a rare source is repeated
    as often as its share needs; only a ``total`` of more than 700 times all
    rows together is taken for a mistake of the caller and raises an error.
    """
    rate = rates(docs, weights, total)
    found = rate.select(F.sum("n").alias("rows"), F.count("*").alias("sources")).first()
    if total is not None and found["rows"] and total > 700 * found["rows"]:
        raise ValueError("a total above 700 times all rows")
    number = parts(F.col("rate"))
    table = rate.select(F.col("source").alias("_source"), number.alias("_parts"), F.when(F.col("rate") > 0, cumulative(F.col("rate") / number)).alias("_cdf"))
    if found["sources"] <= MOST_BROADCAST:
        joined = docs.join(F.broadcast(table), docs["source"].eqNullSafe(table["_source"]))
    else:
        # each source's rate in 64 copies, a document meets one of them: a hot source is spread
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
        joined = docs.withColumn("_at", salt)
        joined = joined.join(salted, joined["source"].eqNullSafe(salted["_source"]) & (joined["_at"] == salted["_salt"])).drop("_at", "_salt")
    key = F.lit("count"), F.lit(seed), F.col("doc_id")
    count = drawn(F.col("_cdf"), F.col("_parts"), *key)
    counted = joined.withColumn("_u", uniform(*key)).withColumn("_times", F.when(F.col("_cdf").isNull(), 0).otherwise(count)).drop("_u", "_cdf", "_parts", "_source")
    copies = counted.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
    return copies.withColumn("_place", uniform(F.lit("place"), F.lit(seed), F.col("doc_id"), F.col("_copy"))).orderBy("_place", "doc_id", "_copy").drop("_place")


def rates_sql(seed: int = 1) -> str:
    """SQL for the (doc_id, source, copy, text) rows of the mixture of ``documents`` in equal shares."""
    return f"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n::DOUBLE) AS rate FROM counts),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms
  WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (
  SELECT doc_id, source, text,
         ('0x' || substr(md5('count:{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
times AS (
  SELECT d.doc_id, d.source, d.text, count(*) FILTER (WHERE t.c <= d.u) AS n
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source
  GROUP BY d.doc_id, d.source, d.text, d.u)
SELECT doc_id, source, CAST(i AS INTEGER) AS copy, text
FROM times, LATERAL (SELECT unnest(range(n)) AS i) x
"""
