"""What findings of round 3 were about: steps that cost too much a row, and what a cheaper form has to keep."""

import random
import re

from pyspark.sql import functions as F
from tests.test_stitch import frame, pair


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pairs_stay_rows(spark):
    from varigrid.operators.stitch import stitched_pairs

    pairs = frame(spark, [pair("twice", 1, "4M", 2, "4M", "ACGT", "CGTA"), pair("twice", 1, "2M1D2M", 1, "5M"), pair("short", 1, "4M", 1, "4M", "AC", "ACGT")])
    found = stitched_pairs(pairs)
    assert not re.search("Exchange|Generate|Window", plan(found))
    got = sorted(((r.name, r.status, r.bases, r.quals) for r in found.collect()), key=str)
    assert got == [("short", "stitched", "AC", [50, 50, 0, 0]), ("twice", "operations", None, None), ("twice", "stitched", "ACGTA", [30, 50, 50, 50, 20])]


def test_units_are_counted_without_array_functions(spark):
    from varigrid.functions import sequence

    rows = [("GGATATATCC", 5, "ATAT"), ("GGATATATCC", 0, "AT"), ("GGATATATCC", 9, None), (None, 3, "A"), ("AAAA", 2, "AA"), ("CCCC", 2, "A")]
    df = spark.createDataFrame(rows, "c string, p int, b string").repartition(2)
    found = df.select(*df.columns, sequence.repeat_with_unit(F.col("c"), F.col("p"), F.col("b")).alias("r"), sequence.repeats_around(F.col("c"), F.col("p"), F.col("b")).alias("n"))
    assert "lambda" not in plan(found)
    got = {(r.c, r.p, r.b): (r.r.n, r.r.unit, r.n) for r in found.collect()}
    assert [got[r] for r in rows] == [(3, "AT", 3), (0, "", 0), (0, "", 0), (0, "", 0), (4, "A", 4), (0, "", 0)]


def test_strings_are_compared_without_array_functions(spark):
    from varigrid.functions import sequence

    rows = [("ACNT", "AGGT"), ("ACG", "ACGTT"), ("", "A"), (None, "ACG"), (None, None), ("é😀A", "é😀C")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(2)
    a, b = F.col("a"), F.col("b")
    found = df.select("a", "b", sequence.hamming(a, b).alias("d"), sequence.wildcard_equal(a, b).alias("w"), sequence.shared_prefix(a, b).alias("p"), sequence.shared_suffix(a, b).alias("s"))
    assert "lambda" not in plan(found)
    got = {(r.a, r.b): (r.d, r.w, r.p, r.s) for r in found.collect()}
    assert [got[r] for r in rows] == [(1, False, 1, 1), (0, False, 3, 0), (0, False, 0, 0), (0, None, 3, 3), (0, None, None, None), (1, False, 2, 0)]


def test_alleles_are_trimmed_without_array_functions(spark):
    from varigrid.functions import sequence

    rows = [("ACGT", "ACT"), ("AAAA", "AA"), ("A", "A"), ("CAT", "GAT"), ("ACGTG", "ATGTG")]
    df = spark.createDataFrame(rows, "r string, a string").repartition(2)
    found = df.select("r", "a", sequence.trimmed(F.lit(10), F.col("r"), F.col("a")).alias("t"))
    assert "lambda" not in plan(found)
    got = {(x.r, x.a): tuple(x.t) for x in found.collect()}
    assert [got[x] for x in rows] == [(11, "CG", "C"), (10, "AAA", "A"), (10, "A", "A"), (10, "C", "G"), (11, "C", "T")]


def test_two_alternatives_work_each_state_out_once(spark):
    from varigrid.operators.genotype import two_alternatives

    df = spark.createDataFrame([([30, 20, 10], 60), ([1, 2, 3], 7), ([400, 90, 20], 510)], "n array<bigint>, dp bigint").repartition(2)
    found = df.select("dp", two_alternatives(F.col("n"), F.col("dp")).alias("r"))
    assert plan(found).count("EXP(") <= 12  # six states, in a plan that names an expression twice
    got = {r.dp: r.r for r in found.collect()}
    assert got[60].gq == 0 and round(got[60].posteriors[4], 4) == 82.4652 and got[7] is None and got[510].posteriors == [100, 100, 100, 100, 0, 100]


def test_encoder_grows_with_its_pieces():
    import public_tokenizers

    from varigrid.llm.tokenstore import Encoder

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    texts = ["".join(r.choices("abcdefgh 1'.é", k=60_000)) for _ in range(12)]
    enc = Encoder(path, most_pieces=60_000)
    assert enc.keys.nbytes + enc.places.nbytes + enc.up.nbytes < 1 << 20
    for few in ([texts[0]], texts):
        ids, n = enc.encode_all(few)
        want = [enc.whole.encode(t, add_special_tokens=False).ids for t in few]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(enc.keys) >= 3 * enc.known


def test_parts_are_walked_across_batches(spark):
    from varigrid.operators.clustering import clusters

    rows = [("c", i, f"{p}:alt,{p + 9}:{s}", 3 + k) for i in range(5) for p in (10, 500) for k, s in enumerate(("alt", "ref", "X"))]
    signed = spark.createDataFrame(rows, "chrom string, nbhd long, signature string, n long")
    assert "InPandas" not in plan(clusters(signed))
    whole, size = sorted(map(str, clusters(signed).collect())), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        assert sorted(map(str, clusters(signed).collect())) == whole and len(whole) == len(rows)
    finally:
        spark.conf.set(size, before)
    assert clusters(signed.limit(0)).collect() == []


def test_states_and_pairs_of_sites_are_not_sorted(spark):
    from varigrid.operators import phasing

    rng = random.Random(21)
    rows = [("c", n, read, pos, rng.choice(["alt", "ref", "X", "N"])) for n in (1, 2) for read in range(30) for pos in (5, 9, 14, 20) for _ in range(rng.choice((0, 1, 1, 3)))] + [("c", 1, 0, None, "alt"), ("c", None, 0, 5, "alt"), ("c", None, 0, 9, "alt"), ("c", 2, None, 5, "alt")]
    states = spark.createDataFrame(rows, "chrom string, nbhd long, read long, pos long, state string")
    single = phasing.one_state(states)
    assert not re.search("SortAggregate", plan(single))
    least = {}
    for *key, state in rows:
        if state != "N":
            least[tuple(key)] = min(least.get(tuple(key), state), state)
    assert sorted(map(tuple, single.collect()), key=str) == sorted(((*k, v) for k, v in least.items()), key=str)
    pairs = phasing.together(states)
    assert not re.search("Join", plan(pairs))
    known, want = {}, {}
    for c, n, read, pos, state in rows:
        if state != "N" and pos is not None:
            at = known.setdefault((c, n, read), {})
            at[pos] = at.get(pos, False) or state == "alt"
    for (c, n, read), at in known.items():
        if n is None or read is None:
            continue
        for a in at:
            for b in at:
                if a != b and at[a]:
                    x = want.setdefault((c, n, a, b), [0, 0])
                    x[0], x[1] = x[0] + at[b], x[1] + 1
    assert {tuple(r)[:4]: [r.both, r.a_known] for r in pairs.collect()} == want


def test_depth_adds_no_pairs_of_reads_and_candidates(spark):
    from varigrid.operators import pileup

    rng = random.Random(23)
    reads = [(rng.choice("ab"), s := rng.randrange(1, 900), s + rng.choice((0, 3, 49, 260)), rng.choice((0, 1, 2))) for _ in range(1500)] + [("a", 300, 349, 1)] * 500 + [("a", None, 5, 0), ("a", 10, 60, None), (None, 10, 60, 0)]
    candidates = [(c, p, "A" * rng.choice((1, 2, 4)), "T") for c in "abd" for p in range(1, 950, 7)] + [("a", 320, "A", "C")]
    read_rows, rows = spark.createDataFrame(reads, "chrom string, start long, stop long, dir int"), spark.createDataFrame(candidates, "chrom string, pos long, ref string, alt string")
    found = pileup.exact_coverage(rows, read_rows)
    # equal reads are one row before the join
    text = plan(found)
    assert re.search(r"HashAggregate\(keys=\[chrom#\d+, start#\d+L, stop#\d+L, dir#\d+\]", text)
    want = {(c, p, ref, alt): [sum(1 for k, s, e, d in reads if k == c and s is not None and d == way and s <= p - 1 and e >= p + len(ref)) for way in range(3)] for c, p, ref, alt in candidates}
    assert {tuple(r)[:4]: r.spanning for r in found.collect()} == want


def test_the_plan_of_rows_that_stay_is_short(spark):
    from varigrid.llm.jaccard import one_of_each_group

    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base), "quite another text of a few words", None, ""]
    found = one_of_each_group(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))
    # the driver holds the plan, and its text and metrics, of every stage at once
    assert len(re.findall(r"Exchange ", plan(found))) <= 12
    assert sorted(r.doc_id for r in found.collect()) == [1, 4, 5, 6]
