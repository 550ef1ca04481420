"""Operators on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_intervals(spark):
    from varigrid.operators import intervals as iv

    a = spark.createDataFrame([("c", 1, 10), ("c", 5, 12), ("c", 20, 30), ("c", 13, 14), ("d", 1, 2)], "chrom string, start long, stop long")
    assert rows(iv.merged(a, ["chrom"]), "chrom", "start", "stop") == [("c", 1, 12), ("c", 13, 14), ("c", 20, 30), ("d", 1, 2)]
    b = spark.createDataFrame([("c", 3, 4), ("c", 25, 40)], "chrom string, start long, stop long")
    assert rows(iv.minus(a, b, ["chrom"]), "chrom", "start", "stop") == [("c", 1, 2), ("c", 5, 14), ("c", 20, 24), ("d", 1, 2)]
    points = spark.createDataFrame([("c", p) for p in (1, 12, 13, 15, 19, 30, 31)] + [("d", 3)], "chrom string, pos long")
    assert [p for _, p in rows(iv.inside(points, a, ["chrom"], 7), "chrom", "pos")] == [1, 12, 13, 30]
    assert rows(iv.uncovered(points, a.filter("chrom = 'd'"), ["chrom"]), "chrom", "pos") == [("d", 1), ("d", 2)]
    pairs = iv.overlapping(a, b, ["chrom"], 4).select(F.col("a.start").alias("x"), F.col("b.start").alias("y"))
    assert rows(pairs, "x", "y") == [(1, 3), (20, 25)]
    cut = iv.clipped(spark.createDataFrame([(1, 5, 25)], "id int, start long, stop long"), 10)
    assert rows(cut, "block", "start", "stop") == [(0, 5, 10), (1, 11, 20), (2, 21, 25)]


def test_expanded_regions_follow_reaching_alleles(spark):
    from varigrid.operators import intervals as iv

    calls = spark.createDataFrame([("c", 8, "AAAA"), ("c", 9, "A"), ("c", 5, "AAAA"), ("c", 4, "A"), ("c", 11, "A"), ("c", 20, "A")], "chrom string, pos long, ref string")
    region = spark.createDataFrame([("c", 10, 12)], "chrom string, start long, stop long")
    assert [p for _, p in rows(iv.inside_expanded(calls, region, ["chrom"]), "chrom", "pos")] == [5, 8, 9, 11]


def test_anchor_kinds(spark):
    from varigrid.operators.pileup import anchor

    df = spark.createDataFrame([(0, 30), (3, 30), (9, 30), (30, 9), (30, 2), (4, 4)], "l int, r int")
    assert [r[0] for r in df.select(anchor(F.col("l"), F.col("r"))).collect()] == [0, 3, 5, 5, 8, 6]


def test_spanning_coverage(spark):
    from varigrid.operators.pileup import spanning_coverage

    df = spark.createDataFrame([([10, 8, 3], [6, 9, 0])], "a array<int>, b array<int>")
    mean, least = df.select(spanning_coverage(F.col("a"), F.col("b"), False), spanning_coverage(F.col("a"), F.col("b"), True)).first()
    assert tuple(mean) == (9, 9, 18) and tuple(least) == (6, 9, 15)


def test_types_filters_and_forced_alleles(spark):
    from varigrid.operators import calling

    df = spark.createDataFrame([("A", "."), ("A", "C"), ("AC", "GT"), ("A", "ACC"), ("ACC", "A"), ("ACC", "GT")], "ref string, alt string")
    assert [r[0] for r in df.select(calling.allele_type(F.col("ref"), F.col("alt"))).collect()] == ["ref", "snv", "mnv", "ins", "del", "complex"]
    calls = spark.createDataFrame([("c", 1, "A", "C", ["q30"])], "chrom string, pos long, ref string, alt string, filters array<string>")
    forced = spark.createDataFrame([("c", 1, "a", "c"), ("c", 2, "A", "G"), ("c", 3, "A", "A"), ("c", 4, "A", "<M>")], "chrom string, pos long, ref string, alt string")
    out = calling.with_forced(calls, forced)
    assert rows(out, "pos", "alt", "forced") == [(1, "C", False), (2, "G", True)]
    refs = spark.createDataFrame([("c", 1, "A", "A", False), ("c", 1, "A", "C", False), ("c", 2, "A", "A", False), ("c", 2, "A", "G", True)], "chrom string, pos long, ref string, alt string, forced boolean")
    assert rows(calling.without_covered_references(refs), "pos", "alt") == [(1, "C"), (2, "A"), (2, "G")]


def test_genotypes(spark):
    from varigrid.operators import genotype

    df = spark.createDataFrame([(0.5, 0.5, 100), (0.995, 0.005, 100), (0.9, 0.0, 100), (0.5, 0.5, 5)], "vf float, ref_vf float, dp int")
    got = [r[0] for r in df.select(genotype.somatic(F.lit(False), F.col("vf"), F.col("ref_vf"), F.col("dp"))).collect()]
    assert got == ["0/1", "1/1", "1/.", "./."]
    loci = spark.createDataFrame(
        [("c", 1, "A", "C", 0.5, 0.5, 100), ("c", 2, "A", "C", 0.9, 0.1, 100), ("c", 3, "A", "C", 0.45, 0.0, 100), ("c", 3, "A", "G", 0.5, 0.0, 100), ("c", 4, "A", "C", 0.3, 0.0, 100), ("c", 4, "A", "G", 0.3, 0.0, 100), ("c", 5, "A", "C", 0.1, 0.9, 100), ("c", 6, "A", "C", 0.5, 0.1, 100)],
        "chrom string, pos long, ref string, alt string, vf float, ref_vf float, dp int",
    )
    got = {r.pos: (r.genotype, r.kept, r.filters) for r in genotype.diploid(loci).collect()}
    assert got[1] == ("0/1", ["C"], []) and got[2][0] == "1/1" and got[3] == ("1/2", ["G", "C"], []) and got[4][0] == "./." and got[4][2] == ["MultiAllelicSite"]
    assert got[5][:2] == ("0/0", []) and got[6][0] == "1/."
    counts = spark.createDataFrame([(1, 100), (45, 100), (98, 100), (900, 2000)], "ad long, dp long")
    out = genotype.adaptive(counts)
    assert [r.genotype for r in out.collect()] == ["0/0", "0/1", "1/1", "0/1"] and all(0 <= r.gq <= 100 for r in out.collect())
    chroms = spark.createDataFrame([("chrM",), ("chrX",), ("chr3",)], "chrom string")
    assert [r[0] for r in chroms.select(genotype.ploidy(F.col("chrom"), male=True)).collect()] == ["somatic", "haploid", "diploid"]


def test_mixture_recovers_its_parameters(spark):
    import numpy as np

    from varigrid.operators.mixture import Mixture, fit

    rng = np.random.default_rng(1)
    state = rng.choice(3, 3000, p=[0.7, 0.2, 0.1])
    ad = rng.binomial(100, np.array([0.03, 0.47, 0.96])[state])
    df = spark.createDataFrame([(int(a), 100) for a in ad], "ad long, dp long")
    model = fit(df)
    assert model.means == pytest.approx((0.03, 0.47, 0.96), abs=0.01) and model.priors == pytest.approx((0.7, 0.2, 0.1), abs=0.03)
    (again,) = Mixture.parse(model.lines())
    assert again.means == model.means
    with pytest.raises(ValueError):
        Mixture.parse(["1,2,3"])


def test_pools_meet_lone_references_and_like_alleles(spark):
    from varigrid.operators import pools

    kind = "chrom string, pos long, ref string, alt string, dp long, ad long, rd long"
    a = spark.createDataFrame([("c", 1, "A", "C", 100, 50, 50), ("c", 2, "A", "A", 100, 0, 100), ("c", 3, "A", "C", 100, 5, 95)], kind)
    b = spark.createDataFrame([("c", 1, "A", "C", 100, 40, 60), ("c", 2, "A", "G", 100, 30, 70), ("c", 3, "A", "T", 100, 60, 40), ("c", 4, "A", "T", 100, 60, 40)], kind)
    pairs = pools.paired(a, b)
    got = sorted(((r.pos, r.a.alt if r.a else None, r.b.alt if r.b else None) for r in pairs.collect()), key=str)
    assert sorted(map(str, got)) == sorted(map(str, [(1, "C", "C"), (2, "A", "G"), (3, "C", None), (3, None, "T"), (4, None, "T")]))
    calls = {(r.pos, r.alt): r for r in pools.consensus(pairs).collect()}
    assert calls[1, "C"].genotype == "0/1" and calls[1, "C"].filters == [] and calls[2, "G"].kind == "one_each" and "PB" in calls[2, "G"].filters


def test_spectrum_outliers_and_requalification(spark):
    from varigrid.operators import recalibrate as r

    calls = [("A", "C")] * 300 + [(a, b) for a in "ACGT" for b in "ACGT" if a != b and (a, b) != ("A", "C")] * 10
    df = spark.createDataFrame(calls, "ref string, alt string")
    out = {x.category: x for x in r.suspicious(r.spectrum(df), F.lit(1000)).collect()}
    assert [c for c, x in out.items() if x.suspicious] == ["A>C"] and out["A>C"].cutoff == 10 and out["A>C"].rate_q == 5
    rows_in = spark.createDataFrame([("A", "C", 30, 100, 100, []), ("A", "G", 30, 100, 100, [])], "ref string, alt string, ad long, dp long, vq int, filters array<string>")
    got = {x.alt: x for x in r.requalified(rows_in, r.suspicious(r.spectrum(df), F.lit(1000))).collect()}
    assert got["G"].new_q == 100 and got["C"].new_q < 30 and got["C"].new_filters == ["q30"]


def test_edges(spark):
    from varigrid.operators.recalibrate import edges

    df = spark.createDataFrame([("c", p, 100 if p != 30 else 20) for p in range(1, 31) if p != 15], "chrom string, pos long, dp int")
    got = {r.pos: r.edge for r in edges(df, 2).collect()}
    assert [p for p, e in got.items() if not e] == [*range(3, 13), *range(18, 28)]


def test_neighborhoods_need_two_sites_nearer_than_the_gap(spark):
    from varigrid.operators.phasing import neighborhoods

    df = spark.createDataFrame([("c", p) for p in (0, 49, 99, 148, 300, 500, 510)], "chrom string, pos long")
    got = {}
    for r in neighborhoods(df).collect():
        got.setdefault(r.nbhd, []).append(r.pos)
    assert sorted(map(sorted, got.values())) == [[0, 49], [99, 148], [500, 510]]


def test_candidates_from_alignments(spark):
    from varigrid.operators import candidates

    reads = spark.createDataFrame(
        [("c", 100, "8M", "ACCTTCGT", [30] * 8, "ACGTACGT", 0), ("c", 100, "4M2I2M", "ACGTGGAC", [30] * 8, "ACGTACGT", 1), ("c", 100, "4M2D2M", "ACGTGT", [30] * 6, "ACGTACGT", 0), ("c", 100, "8M", "TCGTACGT", [30, 5] + [30] * 6, "ACGTACGT", 0)],
        "chrom string, pos long, cigar string, bases string, quals array<int>, reference string, dir int",
    )
    got = rows(candidates.found(reads), "pos", "ref", "alt", "open_left", "open_right")
    assert got == [(100, "A", "T", False, True), (102, "G", "C", False, False), (103, "T", "TGG", False, False), (103, "TAC", "T", False, False), (104, "A", "T", False, False)]
    joined = rows(candidates.found(reads.limit(1), mnvs=True), "pos", "ref", "alt")
    assert joined == [(102, "GTA", "CTT")]


def test_collapse_and_reallocation(spark):
    from varigrid.operators import candidates

    open_ones = spark.createDataFrame([("c", 10, "AC", "GT", False, False, 10, 100), ("c", 10, "A", "G", False, True, 4, 100), ("c", 11, "C", "T", True, False, 3, 100), ("c", 50, "A", "G", True, True, 1, 100)], "chrom string, pos long, ref string, alt string, open_left boolean, open_right boolean, support long, coverage long")
    assert rows(candidates.collapsed(open_ones), "pos", "alt", "support") == [(10, "GT", 17), (50, "G", 1)]
    failed = spark.createDataFrame([("c", 10, "ACG", "GTT", 4, False), ("c", 10, "AC", "GT", 9, True), ("c", 30, "AC", "GG", 2, False)], "chrom string, pos long, ref string, alt string, support long, callable boolean")
    assert rows(candidates.reallocated(failed), "pos", "ref", "alt", "support") == [(10, "AC", "GT", 13), (12, "G", "T", 4), (30, "A", "G", 2), (31, "C", "G", 2)]


def test_spans_are_whole_where_batches_end_inside(spark):
    from varigrid.operators import candidates

    data = [(c, 100 * i + j, "ACG"[j], "T", 2 + j, j > 0) for c in "xy" for i in range(40) for j in range(3)]
    data += [(c, 100 * i, "ACG", "TTT", 5, False) for c in "xy" for i in range(0, 40, 2)]
    alleles = spark.createDataFrame(data, "chrom string, pos long, ref string, alt string, support long, callable boolean")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, results = spark.conf.get(name), []
    try:
        for n in ("10000", "1", "3"):
            spark.conf.set(name, n)
            results.append(rows(candidates.reallocated(alleles), "chrom", "pos", "ref", "alt", "support"))
    finally:
        spark.conf.set(name, before)
    # the long allele's support goes to its callable parts, and to the base left over
    expected = sorted((c, 100 * i + j, "ACG"[j], "T", 2 + j + (5 if i % 2 == 0 else 0)) for c in "xy" for i in range(40) for j in range(3))
    assert results[0] == expected and results[1] == expected and results[2] == expected
    assert rows(candidates.reallocated(alleles.limit(0)), "chrom") == []


def test_realignment_accepts_fewer_mismatches(spark):
    from varigrid.operators import realign

    ref = "ACGTTGCAACGTAGCTAGCTTACGGATCCATGCAAGTCTGACCTGATTACG"
    read = ref[5:15] + "TT" + ref[15:25]
    reads = spark.createDataFrame([("r", "c", 6, read)], "read string, chrom string, pos long, bases string")
    cand = spark.createDataFrame([("r", "c", 6, 15, ref[14], ref[14] + "TT", 9, 1), ("r", "c", 6, 12, ref[11], ref[11] + "G", 8, 2)], "read string, chrom string, pos long, indel_pos long, ref string, alt string, score long, rank int")
    (got,) = realign.realigned(reads, cand, spark.createDataFrame([("c", 1 + i, ref[i : i + 10]) for i in range(0, len(ref), 10)], "contig string, start long, bases string"), block=10).collect()
    assert got.indel_pos == 15 and got.mismatches == 0 and got.original > 0 and got.accepted


def test_stitching(spark):
    from varigrid.operators.pairs import stitched

    bases = [("r", "c", 1, 0, "A", 30), ("r", "c", 2, 0, "C", 60), ("r", "c", 2, 1, "C", 60), ("r", "c", 3, 0, "G", 30), ("r", "c", 3, 1, "T", 25), ("r", "c", 4, 0, "G", 10), ("r", "c", 4, 1, "T", 30)]
    got = rows(stitched(spark.createDataFrame(bases, "name string, chrom string, pos long, mate int, base string, q int")), "pos", "base", "q", "dir")
    assert got == [(1, "A", 30, 0), (2, "C", 93, 2), (3, "G", 0, 2), (4, "T", 30, 2)]


def test_repeat_tags_and_known_alleles(spark):
    from varigrid.operators import calling

    ctx = "GGC" + "A" * 10 + "TTG"
    df = spark.createDataFrame([(ctx, 3, "C", "CA", 0.1), (ctx, 3, "C", "CA", 0.5), (ctx, 3, "C", "CT", 0.1), (ctx, 3, "CA", "C", 0.1)], "c string, p int, ref string, alt string, vf float")
    args = [F.col(x) for x in ("c", "p", "ref", "alt")]
    got = [tuple(r) for r in df.select(calling.repeat_tag(*args, F.col("vf")), calling.indel_repeat_tag(*args, 8)).collect()]
    assert got == [("R5x9", "R8"), (None, "R8"), (None, None), ("R5x9", "R8")]
    cand = spark.createDataFrame([("c", 1, "A", "C"), ("c", 2, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert rows(calling.with_known(cand, cand.limit(1)), "pos", "known") == [(1, True), (2, False)]
    calls = spark.createDataFrame([(".", "0/0", ["a"]), (".", "./.", []), ("C", "./.", [])], "alt string, genotype string, filters array<string>")
    assert rows(calling.elided(calls, True), "alt", "genotype") == [(".", "0/0"), ("C", "./.")]
    assert rows(calling.tagged(calls, "LowGQ", F.col("alt") == "C"), "filters") == [([],), (["LowGQ"],), (["a"],)]


def test_spanning_reads_and_reference_spine(spark):
    from varigrid.operators import pileup

    cand = spark.createDataFrame([("c", 1000, "A", "C"), ("c", 5, "AC", "A")], "chrom string, pos long, ref string, alt string")
    reads = spark.createDataFrame([("c", 990, 1010, 0), ("c", 1000, 1010, 0), ("c", 998, 2500, 2), ("c", 1, 7, 1), ("c", 1, 6, 1)], "chrom string, start long, stop long, dir int")
    assert rows(pileup.exact_coverage(cand, reads), "pos", "spanning") == [(5, [0, 1, 0]), (1000, [1, 0, 1])]
    obs = spark.createDataFrame([("c", 1, "A", "A"), ("c", 1, "A", "C"), ("c", 9, "G", "G")], "chrom string, pos long, ref string, base string")
    spine = spark.createDataFrame([("c", 1, 2)], "chrom string, start long, stop long")
    assert rows(pileup.reference_candidates(obs, spine), "pos", "support") == [(1, 1), (2, 0), (9, 1)]


def test_deletion_shadows_and_phasable_sites(spark):
    from varigrid.operators import mixture, phasing

    calls = spark.createDataFrame([("c", 1, "ACGT", "A", "0/1", []), ("c", 3, "A", "C", "0/1", ["q30"]), ("c", 5, "A", "C", "1/1", []), ("c", 6, "A", ".", "0/0", [])], "chrom string, pos long, ref string, alt string, genotype string, filters array<string>")
    assert rows(mixture.outside_deletions(calls), "pos") == [(1,), (5,), (6,)]
    assert rows(phasing.phasable(calls), "pos") == [(1,), (3,), (5,)] and rows(phasing.phasable(calls, True, True), "pos") == [(1,)]
    sites = calls.withColumn("nbhd", F.when(F.col("pos") == 3, 1).otherwise(2))
    assert rows(phasing.with_passing(sites), "pos") == [(1,), (5,), (6,)]


def test_clips_add_support(spark):
    from varigrid.operators.phasing import clipped_support

    calls = spark.createDataFrame([("c", 10, "ACGT", 5)], "chrom string, pos long, alt string, support long")
    clips = spark.createDataFrame([("c", 10, "AC", True), ("c", 10, "AG", True), ("c", 13, "GT", False), ("c", 10, "ACGTAA", True), ("c", 11, "AC", True)], "chrom string, pos long, bases string, at_end boolean")
    assert rows(clipped_support(calls, clips), "support") == [(8,)]


def test_blocks_give_what_whole_windows_do(spark, monkeypatch):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from varigrid.operators import blocks, intervals, recalibrate

    monkeypatch.setattr(blocks, "WIDTH", 7)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), p, p + rng.randrange(12), rng.randrange(100), i) for i, p in enumerate(rng.sample(range(300), 120))]
    df = spark.createDataFrame(rows, "chrom string, pos long, stop long, dp long, id long")
    whole = Window.partitionBy("chrom").orderBy("pos")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: (r.m, r.s, r.n) for r in df.select("id", F.max("stop").over(before).alias("m"), F.sum("dp").over(whole).alias("s"), F.lead("pos").over(whole).alias("n")).collect()}
    got = blocks.running(df, ["chrom"], "pos", ["pos"], F.col("stop"), "m")
    got = blocks.following(blocks.running(got, ["chrom"], "pos", ["pos"], F.col("dp"), "s", "sum", own=True), ["chrom"], "pos", "n")
    assert {r.id: (r.m, r.s, r.n) for r in got.collect()} == want
    covered = lambda rs: sorted({(r.chrom, x) for r in rs for x in range(r.start, r.stop + 1)})
    spans = df.select("chrom", F.col("pos").alias("start"), "stop", "id")
    merged = intervals.merged(spans, ["chrom"]).collect()
    assert covered(merged) == covered(spans.collect()) and sum(r.stop - r.start + 1 for r in merged) == len(covered(merged))
    odd, even = spans.filter("id % 2 = 1"), spans.filter("id % 2 = 0")
    assert covered(intervals.minus(even, odd, ["chrom"]).collect()) == sorted(set(covered(even.collect())) - set(covered(odd.collect())))
    small = {r.id: r.edge for r in recalibrate.edges(df).collect()}
    monkeypatch.setattr(blocks, "WIDTH", 100_000)
    assert small == {r.id: r.edge for r in recalibrate.edges(df).collect()}


def test_forced_alleles_beside_found_ones(spark):
    from varigrid.operators import genotype, phasing

    calls = spark.createDataFrame(
        [("c", 1, "A", "A", "0/0", 30, False, False), ("c", 1, "A", "T", "./.", 9, False, True), ("c", 2, "A", "T", "0/1", 40, False, False), ("c", 2, "A", "T", "./.", 9, False, True), ("c", 2, "A", "G", "./.", 9, False, True), ("c", 3, "A", "G", "./.", 9, False, True)],
        "chrom string, pos long, ref string, alt string, genotype string, gq int, no_call boolean, forced boolean",
    )
    assert rows(phasing.reconciled(calls), "pos", "alt", "forced") == [(1, "A", False), (1, "T", True), (2, "G", True), (2, "T", False), (3, "G", True)]
    assert rows(genotype.forced_genotypes(calls), "pos", "alt", "forced", "genotype", "gq") == [(1, "A", False, "0/0", 30), (1, "T", True, "0/0", 30), (2, "G", True, "*/*", 40), (2, "T", False, "0/1", 40), (2, "T", True, "*/*", 40), (3, "G", True, "./.", 0)]


def test_two_alternatives_by_all_products(spark):
    from math import comb, log10

    from varigrid.operators.genotype import SNV_MEANS, two_alternatives

    counts = [(20, 1, 0), (10, 12, 0), (0, 15, 14), (1, 30, 1), (0, 0, 0), (5, 5, 30)]
    df = spark.createDataFrame([(list(c), sum(c)) for c in counts] + [([1, 2, 3], 7), ([1, 2, 3], 501)], "n array<long>, dp long")
    found = [r.r for r in df.select(two_alternatives(F.col("n"), F.col("dp")).alias("r")).collect()]
    for (a, b, c), r in zip(counts, found[:-2], strict=True):
        each = []
        for second, first in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)):
            p, q = SNV_MEANS[first], SNV_MEANS[second]
            rest = 1 - p - q if 1 - p - q > 0 else 1 - SNV_MEANS[2]
            each.append(comb(a + b + c, a) * comb(b + c, b) * rest**a * p**b * q**c * (0.99 if first == second == 0 else 0.002))
        assert r.posteriors == pytest.approx([min(100, -10 * log10(x / sum(each))) for x in each], abs=1e-6)
        assert r.gq == min(100, round(-10 * log10((sum(each) - each[4]) / sum(each)))) if each[4] < 0.999 * sum(each) else r.gq > 25
    assert found[-2] is None and found[-1].gq == 100 and found[-1].posteriors == [100, 100, 100, 100, 0, 100]


def test_mates_that_disagree(spark):
    from varigrid.operators.realign import mates_disagree, unshared

    indel = "array<struct<before:bigint,after:bigint,kind:string,len:int,terminal:boolean>>"
    read = f"struct<pos:bigint,stop:bigint,nm:int,backward:boolean,indels:{indel}>"
    ins, longer, far = (10, 11, "I", 3, False), (10, 11, "I", 5, False), (500, 501, "D", 2, False)
    cases = [
        (((1, 50, 3, False, [ins]), (1, 50, 3, True, [ins])), False),  # the same
        (((1, 50, 3, False, [ins]), (1, 50, 5, True, [longer])), True),
        (((1, 50, 3, False, [ins]), (1, 50, 5, True, [(10, 11, "I", 5, True)])), True),  # the longer one at an end says nothing
        (((1, 50, 3, False, [(10, 11, "I", 3, True)]), (1, 50, 5, True, [longer])), False),
        (((1, 50, 0, False, []), (400, 600, 2, True, [far])), False),  # not covered
        (((1, 50, 9, False, []), (1, 50, 9, True, [ins])), False),  # none is good
        (((1, 50, 0, False, []), (1, 50, 9, True, [far, ins])), True),
        (((1, 50, None, False, []), (1, 50, None, True, [ins])), False),
    ]
    df = spark.createDataFrame([(*c[0],) for c in cases], f"a {read}, b {read}")
    assert [r[0] for r in df.select(mates_disagree(F.col("a"), F.col("b"))).collect()] == [c[1] for c in cases]
    lone = df.limit(1).select(F.size(unshared(F.col("a.indels"), F.array().cast(indel))))
    assert lone.first()[0] == 1


def test_directions_and_bridges(spark):
    from varigrid.functions.sequence import bridge_anchored, sketchy_anchor, support_direction

    dirs = [0, 0, 2, 2, 1, 1]
    asked = [("snv", 2, 1, 2), ("deletion", 0, 1, 0), ("deletion", 6, 1, 1), ("deletion", 2, 1, 0), ("deletion", 4, 2, 1), ("deletion", 3, 2, 2), ("mnv", 0, 2, 0), ("mnv", 1, 2, 2), ("insertion", 4, 2, 1)]
    df = spark.createDataFrame([(*a, dirs) for a in asked], "kind string, at int, n int, expected int, dirs array<int>")
    assert all(r[0] == r[1] for r in df.select(support_direction(F.col("kind"), F.col("at"), F.col("n"), F.col("dirs")), "expected").collect())
    texts = spark.createDataFrame([("AACGTT", [0, 2, 2, 2, 2, 1], True), ("AATATT", [0, 2, 2, 2, 2, 1], False), ("AAAATT", [2, 2, 2, 2, 1, 1], False), ("AAAATT", [2, 2, 2, 1, 1, 1], True)], "s string, d array<int>, expected boolean")
    assert all(r[0] == r[1] for r in texts.select(bridge_anchored(F.col("s"), F.col("d")), "expected").collect())
    ends = spark.createDataFrame([("GCATATA", "AT", 1, True), ("GCATATG", "AT", 1, False), ("GC", "AT", 1, False)], "s string, u string, at int, expected boolean")
    assert all(r[0] == r[1] for r in ends.select(sketchy_anchor(F.col("s"), F.col("u"), F.col("at")), "expected").collect())


def test_mixture_without_rows_and_with_a_bare_state(spark):
    from varigrid.operators import mixture

    none = spark.createDataFrame([], "ad long, dp long")
    found = mixture.fit(none)
    assert (found.means, found.priors, found.rounds) == (mixture.SNV_MEANS, mixture.SNV_PRIORS, 0)
    # every row is plain reference: the other states keep what they began with
    rows = spark.createDataFrame([(0, 1000)] * 50, "ad long, dp long")
    found = mixture.fit(rows)
    assert found.means[1:] == pytest.approx(mixture.SNV_MEANS[1:], abs=0.2) and sum(found.priors) == pytest.approx(1)


def test_references_of_one_locus_are_merged(spark):
    from varigrid.operators.pools import merged_references

    schema = "chrom string, pos long, ref string, alt string, dp long, vq int, filters array<string>, pb struct<scaled:double>"
    df = spark.createDataFrame([("c", 5, "A", ".", 20, 60, ["LowDP"], (-9.0,)), ("c", 5, "A", ".", 30, 50, ["PB", "LowDP"], (-3.0,)), ("c", 5, "A", "C", 90, 99, [], (0.0,)), ("c", 6, "G", ".", 7, 8, [], (None,))], schema)
    got = rows(merged_references(df), "pos", "ref", "alt", "dp", "vq", "pb_scaled", "filters")
    assert got == [(5, "A", ".", 30, 50, -3.0, ["LowDP", "PB"]), (6, "G", ".", 7, 8, None, [])]


def test_context_tags(spark):
    from varigrid.operators import calling

    text = "ACGTTGCAAC" + "A" * 12 + "CGTGATTACA"
    blocks = spark.createDataFrame([("c", 1 + i, text[i : i + 8]) for i in range(0, len(text), 8)], "contig string, start long, bases string")
    schema = "chrom string, pos long, ref string, alt string, vf float, filters array<string>, sb struct<both:boolean>"
    calls = spark.createDataFrame([
        ("c", 10, "C", "CA", 0.1, ["LowDP"], (True,)), ("c", 10, "C", "CA", 0.4, [], (True,)), ("c", 10, "CA", "C", 0.1, [], (False,)),
        ("c", 3, "G", "T", 0.1, [], (False,)), ("c", 3, "G", ".", 0.9, [], (False,)),
    ], schema)
    biased = spark.createDataFrame([("c", 3, True)], "chrom string, pos long, biased boolean")
    got = rows(calling.with_context_tags(calls, blocks, calling.CallOptions(both_strands=True, indel_repeats=8), biased, flank=15, block=8), "pos", "alt", "vf", "filters")
    by = {(p, a, round(v, 1)): f for p, a, v, f in got}
    assert by[10, "CA", 0.1] == ["LowDP", "R8", "R5x9"] and by[10, "CA", 0.4] == ["R8"] and by[10, "C", 0.1] == ["SB", "R8", "R5x9"]
    assert by[3, "T", 0.1] == ["SB", "AB"] and by[3, ".", 0.9] == []
