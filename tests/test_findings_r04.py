"""Faults found by running larger tables in round 4."""

import random

from pyspark.sql import functions as F

from varigrid.operators import candidates, clips


def lambdas(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")


def test_clips_are_put_back_without_nested_array_functions(spark):
    kind = "pos long, cigar string, bases string, context string, context_start long, former int"
    # the third base is wrong; then comes an insertion.  A messy clip comes back whole, else to its innermost mismatch; a former clip longer than the first matches counts from the insertion
    rows = [(5, "10M2I3M", "ACCTACGTACGGGTA", "ACGTACGTACGTACGT", 5, n) for n in (0, 5, 12)] + [(5, "10M2I3M", "CCCCACGTACGGGTA", "ACGTACGTACGTACGT", 5, 6), (5, None, "A", "A", 5, 1), (None, "4M1I2M", "ACGTTAC", None, None, 3)]
    df = spark.createDataFrame(rows, kind)
    found = df.withColumn("marks", clips.base_marks(F.struct("*"))).withColumn("put", clips.reclipped(F.col("cigar"), F.col("marks"), F.col("former"), F.lit(0)))
    assert [r.marks for r in found.collect()] == ["==X=======UU==="] * 3 + ["X=XX======UU===", None, "XXXXUXX"]
    assert [r.put for r in found.collect()] == ["10M2I3M", "5S5M2I3M", "2S8M2I3M", "6S4M2I3M", None, "3S1M1I2M"]
    assert lambdas(found) == 0


def read_times(spark, rows, kind, what):
    """What an operator gives with batches of 7 rows and of 10,000, and how many times it read its rows."""
    seen, results = spark.sparkContext.accumulator(0), []

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(size)
    try:
        for n in ("7", "10000"):
            spark.conf.set(size, n)
            results.append(sorted(map(tuple, what(spark.createDataFrame(rows, kind).mapInArrow(each, kind)).collect())))
    finally:
        spark.conf.set(size, had)
    assert results[0] == results[1]
    return results[0], seen.value / len(rows) / 2


def test_collapse_reads_candidates_once_and_spans_may_cross_batches(spark):
    kind = "chrom string, pos long, ref string, alt string, open_left boolean, open_right boolean, support long, coverage long"
    # of each five only C at a place is open to the right, and CG there takes it; T is another's, the others are closed
    rows = [("c", p, *x, 100) for p in range(99_500, 100_600, 5) for x in [("A", "C", False, True, 2), ("AA", "CG", False, False, 3), ("A", "T", False, False, 1)]]
    # passed on twice: G closes what is open to both sides, which then goes to the one like it that is closed
    rows += [("d", 7, "AA", "GG", True, True, 2, 9), ("d", 8, "A", "G", True, False, 2, 9), ("d", 7, "AA", "GG", False, False, 4, 9)]
    found, times = read_times(spark, rows, kind, candidates.collapsed)
    want = [("c", p, *x, 100) for p in range(99_500, 100_600, 5) for x in [("A", "T", False, False, 1), ("AA", "CG", False, False, 5)]]
    assert [r for r in found if r[0] == "c"] == sorted(want)
    assert [r for r in found if r[0] == "d"] == [("d", 7, "AA", "GG", False, False, 8, 9)]
    assert times == 1


def test_letters_of_texts_are_not_matched_one_by_one(spark):
    from varigrid.functions import letters

    texts = ["", None, "aB-z\n", "\u212a\u0130\u00c4 e", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", letters.renamed("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")("t").alias("s"))
    old = df.select("i", F.translate(F.regexp_replace(F.lower("t"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("s"))
    assert sorted(map(str, found.collect())) == sorted(map(str, old.collect()))


def test_reallocation_reads_alleles_once_and_leaves_what_no_failed_one_covers(spark):
    kind = "chrom string, pos long, ref string, alt string, support long, callable boolean"
    # a failed allele gives to the callable one inside it, and what is left over to single bases; the insertion and the allele behind stay
    rows = [("c", p, *x) for p in range(99_500, 100_600, 6) for x in [("ACG", "CTT", 4, False), ("A", "AC", 1, False)]] + [("c", p + 1, "CG", "TT", 5, True) for p in range(99_500, 100_600, 6)]
    rows += [("c", p + 3, "TT", "GG", 3, True) for p in range(99_500, 100_600, 6)] + [("d", 99_999, "A" * 30, "C" * 30, 2, False), ("d", 100_005, "AA", "CC", 1, True)]
    found, times = read_times(spark, rows, kind, candidates.reallocated)
    want = [("c", p + d, *x) for p in range(99_500, 100_600, 6) for d, *x in [(0, "A", "C", 4, False), (0, "A", "AC", 1, False), (1, "CG", "TT", 9, True), (3, "TT", "GG", 3, True)]]
    assert [r for r in found if r[0] == "c"] == sorted(want)
    assert [r for r in found if r[0] == "d"] == [("d", p, "A", "C", 2, False) for p in range(99_999, 100_005)] + [("d", 100_005, "AA", "CC", 3, True)] + [("d", p, "A", "C", 2, False) for p in range(100_007, 100_029)]
    assert times == 1
