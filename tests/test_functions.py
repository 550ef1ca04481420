"""Column functions against hand-computed values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def poisson(k, mean):
    return sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(int(k) + 1)) if k >= 0 else 0.0


def test_poisson_and_binomial_sums(spark):
    from varigrid.functions import stats

    rng = random.Random(1)
    rows = [(rng.randrange(-1, 60), rng.random() * 40 + 0.01) for _ in range(60)]
    got = values(spark, rows, "k int, m double", stats.poisson_cdf(F.col("k"), F.col("m")))
    assert [g[0] for g in got] == pytest.approx([poisson(k, m) for k, m in rows], abs=1e-12)
    rows = [(rng.randrange(0, n + 1), n) for n in [rng.randrange(1, 80) for _ in range(40)]]
    got = values(spark, rows, "k int, n int", stats.log_binomial(F.col("k"), F.col("n"), 0.4), stats.binomial_cdf(F.col("k"), F.col("n"), 0.2))
    for (k, n), (log, cdf) in zip(rows, got, strict=True):
        assert log == pytest.approx(math.log(math.comb(n, k)) + k * math.log(0.4) + (n - k) * math.log(0.6))
        assert cdf == pytest.approx(sum(math.comb(n, i) * 0.2**i * 0.8 ** (n - i) for i in range(k + 1)))


def far_poisson(k, mean):
    """P(X <= k) and P(X > k) from terms relative to the likeliest one."""
    term, terms = 1.0, {int(mean): 1.0}
    for i in range(int(mean), int(mean + 60 * math.sqrt(mean) + 200)):
        term *= mean / (i + 1)
        terms[i + 1] = term
    term = 1.0
    for i in range(int(mean), max(0, int(mean - 60 * math.sqrt(mean) - 100)), -1):
        term *= i / mean
        terms[i - 1] = term
    whole = math.fsum(terms.values())
    return math.fsum(v for i, v in terms.items() if i <= k) / whole, math.fsum(v for i, v in terms.items() if i > k) / whole


def test_probabilities_at_depth(spark):
    from varigrid.functions import stats

    rows = [(int(m + d * math.sqrt(m)), m) for m in (100.0, 130.0, 200.0, 745.0, 1e3, 1e4, 3e5, 1e6) for d in (-11, -8, -6, -1, -0.1, 0, 0.1, 1, 6, 8, 12, 25)]
    rows = [r for r in rows if r[0] >= 0] + [(1000, 0.0), (10**6, 5.0), (200, 1e9)]
    k, m = F.col("k"), F.col("m")
    for (k_, m_), (below, above) in zip(rows, values(spark, rows, "k long, m double", stats.poisson_cdf(k, m), stats.poisson_tail(k, m)), strict=True):
        want = far_poisson(k_, m_) if 5 < m_ < 1e9 else (float(m_ < 10), float(m_ > 10))
        assert below == pytest.approx(want[0], abs=1e-12) and above == pytest.approx(want[1], abs=1e-12)
        if k_ > stats.TERMS and want[1] > 1e-100:
            assert above == pytest.approx(want[1], rel=1e-9)
    got = values(spark, [(1000, 2500), (990, 2500), (2499, 2500), (2500, 2500), (2400, 2500), (0, 2500), (200, 10**7), (-1, 10)], "k long, n long", stats.binomial_cdf(F.col("k"), F.col("n"), 0.4))
    terms = [math.exp(math.lgamma(2501) - math.lgamma(i + 1) - math.lgamma(2501 - i) + i * math.log(0.4) + (2500 - i) * math.log(0.6)) for i in range(2501)]
    assert [g[0] for g in got] == pytest.approx([math.fsum(terms[:1001]), math.fsum(terms[:991]), 1, 1, 1, 0, 0, 0], abs=1e-9)
    got = values(spark, [(n,) for n in (0, 1, 2, 9, 170, 10**6, 10**12)], "n long", stats.log_factorial(F.col("n")))
    assert [g[0] for g in got] == pytest.approx([math.lgamma(n + 1) for n in (0, 1, 2, 9, 170, 10**6, 10**12)], rel=1e-13)


def test_sure_calls_stay_sure_at_depth(spark):
    from varigrid.functions import stats

    n = lambda *x: [F.lit(v).cast("long") for v in x]
    sb = stats.strand_bias(F.array(*n(50_000, 50_000, 0)), F.array(*n(100_000, 100_000, 0)))
    row = spark.range(1).select(
        stats.poisson_cdf(F.lit(1000), F.lit(1000.0)).alias("a"), stats.variant_q(F.lit(2000), F.lit(100_000)).alias("b"), sb["score"].alias("c"), sb["acceptable"].alias("d"),
        stats.amplicon_biased(F.lit(990), F.lit(0.099), F.lit(10_000), F.lit(0.1)).alias("e"),
    )
    assert "sequence(1, 1000000" not in row._jdf.queryExecution().toString()
    assert (round(row.first()["a"], 4), *row.first()[1:]) == (0.5084, 100, pytest.approx(0, abs=1e-9), True, False)


def test_variant_quality(spark):
    from varigrid.functions import stats

    rows = [(0, 100), (5, 0), (1, 100), (3, 100), (10, 100), (500, 500), (2, 1000)]

    def plain(ad, dp):
        if ad <= 0 or dp <= 0:
            return 0
        tail = 1 - poisson(ad - 1, 0.01 * dp)
        return 100 if tail <= 1e-10 else min(100, max(0, round(-10 * math.log10(tail))))

    assert values(spark, rows, "ad int, dp int", stats.variant_q(F.col("ad"), F.col("dp"))) == [(plain(*r),) for r in rows]
    # beyond double precision the leading term orders still
    deep = values(spark, [(200, 1000), (400, 1000)], "ad int, dp int", stats.variant_q(F.col("ad"), F.col("dp"), 20, 10000))
    assert 0 < deep[0][0] < deep[1][0]


def test_strand_bias(spark):
    from varigrid.functions import stats

    rows = [([10, 10, 0], [100, 100, 0]), ([20, 0, 0], [100, 100, 0]), ([5, 5, 0], [50, 0, 0]), ([2, 2, 3], [20, 20, 11])]
    sb = stats.strand_bias(F.col("s"), F.col("c"))
    got = values(spark, rows, "s array<long>, c array<long>", sb["score"], sb["both"], sb["acceptable"], sb["scaled"])
    assert got[0][1] and got[0][2] and got[0][0] < 1e-3
    assert not got[1][1] and not got[1][2] and got[1][0] > 0.5
    assert got[2][0] == 0.0 and got[2][3] == float("-inf")
    assert got[3][1]


def test_sequences(spark):
    from varigrid.functions import sequence as s

    rows = [("5H3S10M2I4M3D6M2S", "ACGTAC", "AAAACC", 100)]
    ops = s.cigar(F.col("c"))
    got = values(spark, rows, "c string, a string, b string, p int", s.span(ops, s.ON_READ), s.span(ops, s.ON_REFERENCE), s.clip(ops), s.clip(ops, True), s.cigar_text(s.reversed_cigar(ops)), F.length(s.expanded(ops)))[0]
    assert got == (27, 23, 3, 2, "2S6M3D4M2I10M3S5H", 35)
    (places,) = values(spark, [("2S3M1I2M2D1M", 10)], "c string, p int", s.position_map(s.cigar(F.col("c")), F.col("p")))[0]
    assert places == [-1, -1, 10, 11, 12, -1, 13, 14, 17]
    (dirs,) = values(spark, [("2F1S3R",)], "d string", s.directions(F.col("d")))[0]
    assert dirs == [0, 0, 2, 1, 1, 1]
    assert values(spark, [("3M2D3M", 10)], "c string, p int", s.aligned_overlap(s.cigar(F.col("c")), F.col("p"), F.lit(12), F.lit(15)))[0][0] == 2
    texts = [("ATATAT",), ("AAAA",), ("ACG",), ("",)]
    assert [r[0] for r in values(spark, texts, "t string", s.repeat_unit(F.col("t")))] == ["AT", "A", "ACG", ""]
    assert [r[0] for r in values(spark, texts, "t string", s.longest_homopolymer(F.col("t")))] == [1, 4, 1, 0]
    assert [r[0] for r in values(spark, [("ATATA",), ("ATAGA",), ("CAGCAGC",)], "t string", s.tandem(F.col("t")))] == [True, False, True]
    assert values(spark, [("GGATATATCC", 5)], "t string, p int", s.repeat_context(F.col("t"), F.col("p"), F.lit("AT")))[0][0] == 3
    assert values(spark, [("ACNT", "AGGT")], "a string, b string", s.hamming(F.col("a"), F.col("b")))[0][0] == 1
    assert values(spark, [("10A5^AC6T0G",)], "m string", s.md_substitutions(F.col("m")))[0][0] == 3
    assert values(spark, [("NNACGTA",)], "t string", s.run_at_start(F.col("t"), "N"), s.most_repeats(F.col("t"), "AC"), s.one_base_share(F.col("t")))[0] == (2, 1, 2 / 7)


def test_records(spark):
    from varigrid.functions import records

    lines = [("##x",), ("#CHROM",), ("chr1\t10\t.\tA\tC,G\t30\tq30;SB\tDP=100\tGT:AD:DP\t1/2:10,40,50:100",), ("chr1\t11\t.\tA\t.\t.\tPASS\t.\tGT:DP\t0/0",)]
    rows = records.parsed(spark.createDataFrame(lines, "value string"))
    got = {r.pos: r for r in rows.collect()}
    assert got[10].filters == ["q30", "SB"] and got[10].info == {"DP": "100"} and got[10]["sample"]["AD"] == "10,40,50"
    assert got[11].qual is None and got[11].filters == [] and got[11]["sample"] == {"GT": "0/0", "DP": None}
    many = sorted((r.alt, r.ad) for r in records.uncrushed(rows.filter("pos = 10")).collect())
    assert many == [("C", 40), ("G", 50)]
    alleles = spark.createDataFrame([("c", 1, "A", "C", 5, 20, ["a"]), ("c", 1, "AT", "A", 7, 20, ["b", "a"])], "chrom string, pos long, ref string, alt string, ad long, dp long, filters array<string>")
    (one,) = records.crushed(alleles).collect()
    assert (one.ref, one.alt, one.ad, one.dp, one.filters) == ("AT", "CT,A", "5,7", 20, ["a", "b"])
    kinds = values(spark, [("q30",), ("R8",), ("R5x9",), ("LowDP",), ("x",)], "f string", records.filter_kind(F.col("f")))
    assert [k[0] for k in kinds] == ["low_quality", "indel_repeat", "repeat", "low_depth", "unknown"]
    assert [g[0] for g in values(spark, [("0|1",), ("./.",), ("2/3",)], "g string", records.genotype_kind(F.col("g")))] == ["het", "no_call", "other"]
    assert values(spark, [("/x/y/abc_S12.genome.vcf.gz",)], "p string", records.sample_name(F.col("p")))[0][0] == "abc"
    assert records.digits(0.01) == 3


def test_more_sequences(spark):
    from varigrid.functions import sequence as s

    ctx = "GGCAAAAAAAAAATTG"
    assert values(spark, [(ctx, 4, "A")], "c string, p int, a string", s.repeats_around(F.col("c"), F.col("p"), F.col("a")))[0][0] == 10
    assert values(spark, [("MMMIID",)], "t string", s.run_lengths(F.col("t")))[0][0] == "3M2I1D"
    (sa,) = values(spark, [("chr1,5,+,3M,60,1;chr2,7,-,2S1M,0,0;",)], "t string", s.supplementary(F.col("t")))[0]
    assert [(x.chrom, x.pos, x.mapq) for x in sa] == [("chr1", 5, 60), ("chr2", 7, 0)]
    kind = "r boolean, m boolean, p int, q int"
    assert [x[0] for x in values(spark, [(False, True, 1, 5), (True, False, 1, 5), (True, False, 5, 1)], kind, s.orientation(F.col("r"), F.col("m"), F.col("p"), F.col("q")))] == ["FR", "RF", "FR"]
    got = values(spark, [(True, "FR", 1, 2), (False, "FR", 1, 0), (False, "FF", None, 1)], "s boolean, o string, v int, w int", s.duplex_class(F.col("s"), F.col("o"), F.col("v"), F.col("w")))
    assert [x[0] for x in got] == ["duplex_stitched", "simplex_forward_unstitched", "simplex_other_unstitched"]
    assert values(spark, [("TTACGACGTT", 5, "ACG")], "c string, p int, i string", s.duplication(F.col("c"), F.col("p"), F.col("i")))[0][0]
    assert values(spark, [("ANG", "ACG"), ("AN", "ACG")], "a string, b string", s.wildcard_equal(F.col("a"), F.col("b"))) == [(True,), (False,)]
