"""Phrases whose words keep company, per language.

All n-grams of 1 to ``max_n`` words become rows with their counts, are summed by
language and phrase, meet the counts of their first and last parts, and are
scored in decimals.  Levels go one by one, as no phrase is more frequent than
what it holds: an n-gram of a later level becomes a row only where both its
shorter ones may have ``least`` occurrences.  A bitmap of fixed size tells; it
errs on the side of keeping, so it saves rows and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.llm.common import only, stored
from varigrid.llm.tokens import Cutter, Part, bitmap, chained, distinct_codes, place, string_hashes, within

#: What cuts words, and what cuts pieces.
SEPARATORS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bits of the bitmap of frequent n-grams (2 MB), and bytes of text whose n-grams are counted at once.
BITS, TEXT_BYTES, OUT_ROWS = 24, 4 << 20, 1 << 16
#: Language of texts without one.
NO_LANG = "und"
_ROWS = "lang string, phrase string, f long"


def _level(size: int, held: np.ndarray | None):
    """Rows (lang, phrase, f) of the n-grams of ``size`` words, counted for a few MB of text at a time.

    With ``size`` 1 there is a row with an empty phrase too, which counts all words.
    """

    def hashed(part: Part, lang: np.ndarray, langs: list[str], at: np.ndarray, n: int) -> np.ndarray:
        acc = string_hashes(pa.array(langs, pa.string()))[lang[at]]
        words = part.hashes()
        for k in range(n):
            acc = chained(acc, words[part.codes[at + k]])
        return acc

    def rows(part: Part, lang: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        codes, distinct = part.codes, part.distinct
        at = np.arange(max(0, len(codes) - size + 1))
        at = at[part.piece[at] == part.piece[at + size - 1]]
        if held is not None and len(at):
            at = at[within(held, hashed(part, lang, langs, at, size - 1), BITS)]
            at = at[within(held, hashed(part, lang, langs, at + 1, size - 1), BITS)]
        if not len(at):
            return
        key = lang[at]
        for k in range(size):
            key, n = distinct_codes(key * len(distinct) + codes[at + k])
        first = np.empty(n, np.int64)
        first[key[::-1]] = at[::-1]
        counts = np.bincount(key, minlength=n)
        names = pa.array(langs, pa.string())
        for i in range(0, n, OUT_ROWS):
            some = first[i : i + OUT_ROWS]
            words = [distinct.take(pa.array(codes[some + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*words, " ") if size > 1 else words[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[some])), phrase, pa.array(counts[i : i + OUT_ROWS])], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(SEPARATORS, BREAKS)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            langs, of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for part in cutter.parts(batch.column(1), TEXT_BYTES):
                lang = of_row[part.rows()].astype(np.int64)
                if size == 1 and len(lang):
                    n = np.bincount(lang, minlength=len(langs))
                    has = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in has], pa.string()), pa.array([""] * len(has), pa.string()), pa.array(n[has])], ["lang", "phrase", "f"])
                yield from rows(part, lang, langs)

    return run


def _hashes(size: int):
    """Places in the bitmap of (lang, phrase) rows of ``size`` words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(b" ")
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            seeds = string_hashes(langs.dictionary)
            for part in cutter.parts(batch.column(1), TEXT_BYTES):
                acc = seeds[langs.indices.to_numpy()[part.first : part.first + len(part.at) - 1]]
                words, at = part.hashes(), part.at[:-1]
                for k in range(size):
                    acc = chained(acc, words[part.codes[at + k]])
                yield pa.RecordBatch.from_arrays([pa.array(place(acc, BITS))], ["h"])

    return run


def _frequent_bits(spark: SparkSession, grams: DataFrame, size: int):
    """The level's phrases as a bitmap of 2 ** BITS bits, broadcast."""
    at = grams.where("phrase != ''").select("lang", "phrase").mapInArrow(_hashes(size), "h long")
    words = at.groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("b")).collect()
    return spark.sparkContext.broadcast(bitmap({r["w"]: r["b"] for r in words}, BITS))


def ngram_counts(docs: DataFrame, max_n: int, least: int) -> list[DataFrame]:
    """For each size from 1 to ``max_n`` the (lang, phrase, f) rows with f >= ``least``; the first has the words' number, with an empty phrase."""
    spark = docs.sparkSession
    texts = only(docs, "lang", "text").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    levels, held = [], None
    for size in range(1, max_n + 1):

        def explode(batches, size=size, held=held):
            yield from _level(size, held.value if held is not None else None)(batches)

        rows = texts.mapInArrow(explode, _ROWS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        levels.append(stored(rows.where((F.col("f") >= least) | (F.col("phrase") == ""))))
        if size < max_n:
            held = _frequent_bits(spark, levels[-1], size)
    return levels


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, salts: int = 32) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_n`` words by their weakest cut.

    A phrase with a occurrences, cut into parts with l and r, scores
    ``floor(1000000 * a * a / (l * r))``; its lowest cut counts, the first of equal
    ones.  A phrase goes where one that is longer and holds it has ``share``
    percent of its occurrences.  Returns lang, rank, phrase, a, l, r, n, score.

    A null text has no words and a null language is ``und``; repeated rows count as
    often as they stand there; equal scores go by a, then by phrase, which is
    unique, so that ranks are too; an empty table gives no rows; long texts are
    counted in whole and other columns are not looked at.  Decimals are exact for
    up to 10**16 occurrences.
    """
    levels = ngram_counts(docs, max_n, least)
    words = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    parts = reduce(DataFrame.unionByName, levels[: max_n - 1]).where("phrase != ''")
    sized = [g.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("size")) for k, g in enumerate(levels, 1) if k > 1]
    found = reduce(DataFrame.unionByName, sized)

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    whole = "CAST({} AS DECIMAL(16, 0))".format
    score = F.expr(f"({whole('a')} * {whole('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({whole('l')} * {whole('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    shorter = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    longer = found.where("size > 2").select("lang", "a", F.explode(shorter).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.alias("s").join(longer.alias("x"), (F.col("s.lang") == F.col("x.lang")) & (F.col("s.phrase") == F.col("x.phrase")) & (100 * F.col("x.most") >= share * F.col("s.a")), "left_anti")

    # no task ranks a whole language: the best of each of its parts are ranked first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(salts)))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The same rows in SQL, for phrases of 2 to 3 words with 10 occurrences or more."""
    return r"""
WITH texts AS (SELECT COALESCE(lang, 'und') AS lang, row_number() OVER () AS d,
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS p FROM texts),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, s AS size, array_to_string(w[i : i + s - 1], ' ') AS phrase
          FROM starts, (SELECT unnest([1, 2, 3]) AS s) WHERE i + s - 1 <= len(w)),
f AS (SELECT lang, size, phrase, CAST(COUNT(*) AS HUGEINT) AS f FROM grams GROUP BY lang, size, phrase),
n AS (SELECT lang, SUM(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c),
scored AS (SELECT u.lang, u.size, u.phrase, u.a, u.k, l.f AS l, r.f AS r, (1000000 * u.a * u.a) // (l.f * r.f) AS score
           FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : u.k], ' ')
           JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.k + 1 : u.size], ' ')),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, a, array_to_string(w[1 : 2], ' ') AS phrase FROM c WHERE size = 3
           UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM c WHERE size = 3),
kept AS (SELECT * FROM cut WHERE NOT EXISTS (
           SELECT 1 FROM longer x WHERE x.lang = cut.lang AND x.phrase = cut.phrase AND 100 * x.a >= 50 * cut.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
