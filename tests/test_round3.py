"""Faults found by running larger tables."""

import pyspark.sql.functions as F

from varigrid import catalogue
from varigrid.operators import intervals, summaries


def duck(tables, name):
    import duckdb

    con = duckdb.connect()
    for t, path in tables.items():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    rel = con.sql(catalogue.SQL[name])
    return rel.columns, sorted(rel.fetchall())


def test_nearest_indels_round_halves_as_the_sql_does(spark, tmp_path):
    rows = [(1, "A", 100, 1, 30.0, 1.0), (2, "A", 110, 7, 5.0, 10.5), (3, "A", 120, 7, 5.0, 10.7)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    columns, want = duck({"lineitem": f"{tmp_path}/lineitem.parquet"}, "nearest_indels")
    got = catalogue.QUERIES["nearest_indels"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == want == [(1, 100, 110, 2), (1, 100, 120, 1)]


def unstable(spark, n, *columns):
    """Numbers below n in an order that another read doesn't repeat, as rows fetched over a network come."""
    import random

    def each(batches):
        import pandas as pd

        for b in batches:
            at = list(b["id"])
            random.Random().shuffle(at)
            yield pd.DataFrame({"id": at})

    return spark.range(0, n, 1, 2).mapInPandas(each, "id long").select(*columns)


def test_touching_needs_no_row_numbers(spark):
    points = unstable(spark, 4000, (F.col("id") * 10 + 9).alias("pos"), F.repeat(F.lit("A"), (F.col("id") % 4 + 1).cast("int")).alias("ref"))
    places = spark.createDataFrame([(i, i) for i in range(0, 40000, 10)], "start long, stop long")
    got = sorted(tuple(r) for r in intervals.touching(points, places, bin_width=10).collect())
    assert got == sorted((i * 10 + 9, "A" * (i % 4 + 1)) for i in range(3999) if i % 4)


def test_reference_of_rows_that_come_in_any_order(spark):
    blocks = spark.createDataFrame([("c", b * 10 + 1, "".join("ACGT"[(b * 10 + i) % 4] for i in range(1, 11))) for b in range(60)], "contig string, start long, bases string")
    for width in (3, 11, 25, 47):
        rows = unstable(spark, 500, F.lit("c").alias("chrom"), (F.col("id") + 1).alias("pos"))
        got = summaries.with_reference(rows, blocks, F.col("pos") - 2, F.col("pos") - 3 + width, 10).collect()
        assert len(got) == 500
        for r in got:
            first = max(1, r.pos - 2)
            assert (r.context_start, r.context) == (first, "".join("ACGT"[p % 4] for p in range(first, r.pos - 2 + width)))
    lone = spark.createDataFrame([("d", 5), (None, 5), ("c", None), ("c", -9)], "chrom string, pos long")
    assert [(r.context_start, r.context) for r in summaries.with_reference(lone, blocks, F.col("pos"), F.col("pos") + 3, 10).collect()] == [(None, None)] * 4


def test_letters_of_alignments_are_not_nested_array_functions(spark):
    rows = spark.createDataFrame([("r", "c", 5, "2S4M1I4M2D3M", "ACGTACGTACGTAC", [30] * 14, 60, False, False, False, 0), ("s", "c", 5, None, "AC", [30, 30], 60, False, False, False, 0)], "read string, chrom string, pos long, cigar string, bases string, quals array<int>, mapq int, reverse boolean, stitched boolean, mate_unmapped boolean, mismatches int")
    events = summaries.indel_events(rows)
    assert sorted((r.key, r.left, r.right, r.quality) for r in events.collect()) == [("c:12:D:2", 4, 3, 30), ("c:8:I:G", 4, 4, 30), ("c:8:I:G|c:12:D:2", 4, 3, 30)]
    assert "lambdafunction" not in events._jdf.queryExecution().optimizedPlan().toString()


def test_poisson_probabilities_are_not_interpreted_row_by_row(spark):
    from varigrid.functions import stats

    found = spark.createDataFrame([(3, 2.0), (-1, 2.0), (1000, 1000.0)], "k long, m double").select(stats.poisson_cdf(F.col("k"), F.col("m")).alias("p"))
    assert [round(r.p, 6) for r in found.collect()] == [0.857123, 0.0, 0.508409]
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def open_candidates(n, shift=0):
    import random

    of = random.Random(5)
    out = {}
    for _ in range(n):
        pos, ref = of.randrange(99_940, 100_060) + of.choice([0, 0, 100_000]), of.choice(["A", "AC", "ACG"])
        alt = of.choice(["G" * len(ref), "T" * len(ref), ref[0], ref[0] + "GG"])
        out[pos + shift, ref, alt, of.random() < 0.4, of.random() < 0.4] = (of.randrange(1, 9), 100)
    out[99_990 + shift, "A" * 100_030, "A", False, True] = (3, 100)
    return [("c", *k, *v) for k, v in sorted(out.items())]


def test_collapse_shuffles_candidates_once_and_spans_may_cross_blocks(spark):
    from varigrid.operators import candidates

    kind = "chrom string, pos long, ref string, alt string, open_left boolean, open_right boolean, support long, coverage long"
    results = []
    for shift in (0, 50_000, 777_000):
        rows = candidates.collapsed(spark.createDataFrame(open_candidates(300, shift), kind)).collect()
        results.append(sorted((r.pos - shift, len(r.ref), r.alt, r.open_left, r.open_right, r.support) for r in rows))
    assert results[0] == results[1] == results[2] and len(results[0]) < 300
    n = 20_000
    apart = spark.range(n).select(F.lit("c").alias("chrom"), (F.col("id") * 90 + 5).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit(True).alias("open_left"), F.lit(False).alias("open_right"), F.lit(1).cast("long").alias("support"), F.lit(9).cast("long").alias("coverage"))
    before = shuffled_rows(spark)
    assert candidates.collapsed(apart).count() == n
    assert shuffled_rows(spark) - before < 1.5 * n


def walked(pos, cigar, bases, quals, reference, direction, min_q, most_length, most_gap, mnvs):
    """Substitutions of one read of matches alone, letter by letter."""
    out, start, end, opened, broken = [], None, None, False, False
    for i in range(len(bases)):
        if quals[i] < min_q or bases[i] == "N":
            if start is not None:
                out.append((start, end, opened, end == i))
            start, broken = None, True
            continue
        if bases[i] != reference[i]:
            if start is not None and mnvs and i + 1 - start <= most_length and i - end <= most_gap:
                end = i + 1
            else:
                if start is not None:
                    out.append((start, end, opened, False))
                start, end, opened = i, i + 1, broken
        elif start is not None and (not mnvs or i + 1 - end > most_gap):
            out.append((start, end, opened, False))
            start = None
        broken = False
    if start is not None:
        out.append((start, end, opened, False))
    return [(pos + s, reference[s:e], bases[s:e], left, right) for s, e, left, right in out]


def test_candidates_by_whole_batches_are_those_of_each_letter(spark):
    import random

    from varigrid.operators import candidates

    of = random.Random(3)
    reads = [("c", 10 * i + 1, f"{n}M", "".join(of.choices("ACGTN", (5, 5, 5, 5, 1), k=n)), [of.choice([5, 30, 30, 30]) for _ in range(n)], "".join(of.choices("ACGT", k=n + 3)), i % 2) for i, n in enumerate(of.choices(range(1, 30), k=200))]
    rows = spark.createDataFrame(reads, "chrom string, pos long, cigar string, bases string, quals array<int>, reference string, dir int")
    for mnvs, length, gap in ((False, 3, 1), (True, 3, 1), (True, 5, 2), (True, 2, 0), (True, 1, 1)):
        found = candidates.found(rows, mnvs=mnvs, most_length=length, most_gap=gap)
        got = sorted((r.pos, r.ref, r.alt, r.open_left, r.open_right) for r in found.collect())
        assert got == sorted(x for r in reads for x in walked(*r[1:], 20, length, gap, mnvs))
    equal = candidates.found(rows.unionByName(rows)).withColumn("dir", F.when(F.col("pos") % 3 > 0, F.col("dir")))
    keys = ["chrom", "pos", "ref", "alt", "dir", "open_left", "open_right"]
    want = sorted(map(str, equal.groupBy(*keys).agg(F.count("*").alias("support")).collect()))
    assert sorted(map(str, candidates.counted(equal, "dir", "open_left", "open_right").select(*keys, "support").collect())) == want


def test_phased_alleles_plan_stays_small_and_clusters_are_found_once(spark, sf_dir):
    found = catalogue.QUERIES["phased_haplotypes"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 300_000


def test_phased_alleles_cut_sites_that_begin_inside_others(spark):
    from varigrid.operators import clustering

    kind = "chrom string, nbhd long, part long, cluster int, signature string, n long, consensus string"
    clustered = spark.createDataFrame([("c", 1, 9, 1, "10:alt,11:alt,14:alt", 4, "10:alt,11:alt,14:alt"), ("c", 1, 9, 1, "10:alt,11:ref", 3, None), ("c", 1, 9, 2, "10:ref,14:X", 2, "10:ref,14:X")], kind)
    sites = spark.createDataFrame([("c", 1, 10, "ACG", "TCG"), ("c", 1, 11, "CGT", "CGA"), ("c", 1, 14, "G", "C")], "chrom string, nbhd long, pos long, ref string, alt string")
    reference = spark.createDataFrame([("c", p, b) for p, b in zip(range(10, 15), "ACGTG", strict=True)], "chrom string, pos long, base string")
    found, used = clustering.phased_alleles(clustered, sites, reference)
    # ACG, then T of the second, then G: of 10 to 14, with averages of 7, 7, 4 reads of 9, 7, 6
    assert [(r.pos, r.ref, r.alt, r.kind, r.support, r.depth) for r in found.collect()] == [(10, "ACGTG", "TCGAC", "mnv", 6, 7)]
    assert used.collect() == []


def test_regression_leaves_no_weights_on_the_driver(spark):
    import numpy as np

    from varigrid.llm import toxicity

    of = np.random.default_rng(1)
    rows = [(i % 2, np.concatenate([[i % 2], 2 + np.flatnonzero(of.random((1 << 16) - 2) < 0.5)]).astype(np.uint32).tobytes()) for i in range(40)]
    held = spark.createDataFrame(rows, "toxic int, features binary").repartition(4)
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore().memoryUsed()
    before = blocks()
    bias, weights = toxicity.logistic(held, np.ones(1 << 16), {0: 20, 1: 20})
    assert weights[1] > 0 > weights[0]
    assert blocks() - before < 1 << 20
