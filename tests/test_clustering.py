"""Clusters of signatures against known results and a plain version; alleles and references from them."""

import random

import pytest

KIND = {"A>G": "alt"}


def frame(spark, rows):
    return spark.createDataFrame([("c", 1, s, n) for s, n in rows], "chrom string, nbhd long, signature string, n long")


def signature(states):
    """From one letter a site (a, r, x, or - for no data)."""
    names = {"a": "alt", "r": "ref", "x": "X"}
    return ",".join(f"{10 + i}:{names[s]}" for i, s in enumerate(states) if s != "-")


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.nbhd, r.part, r.cluster), set()).add(r.signature)
    return sorted(map(sorted, out.values()))


def wanted(*groups):
    return sorted(sorted(signature(s) for s in g) for g in groups)


#: Signatures with their reads, least agreement, and the clusters that they make.
SAMPLE = [("a-", 1), ("ar", 1), ("rr", 1), ("aa", 1), ("-r", 1), ("-a", 1)]
TEN = [("--aaaa", 3), ("-aaa-a", 5), ("aaaa-a", 1), ("rrrrrr", 1)]


def test_known_clusters(spark):
    from varigrid.operators.clustering import clusters

    rows = lambda x: frame(spark, [(signature(s), n) for s, n in x])
    assert gathered(clusters(rows([("r-", 4)]))) == wanted(["r-"])
    got = gathered(clusters(rows(SAMPLE)))
    assert len(got) == 3 and sum(map(len, got)) == 6
    for most, left in ((None, 3), (3, 3), (2, 2), (1, 1)):
        got = gathered(clusters(rows(TEN), most, least_agree=4))
        assert len(got) == left
        assert wanted(["-aaa-a", "aaaa-a"])[0] in got
        assert (wanted(["rrrrrr"])[0] in got) == (left == 3)
    # two equally light clusters can't be told apart: both stay
    assert len(gathered(clusters(rows([("aa", 1), ("rr", 1), ("xx", 5)]), 2))) == 3


def plain_clusters(rows, least, most):
    """The same rules on dictionaries and lists; clusters of one part only."""
    groups = sorted(((dict(s.split(":") for s in sig.split(",")), n, sig) for sig, n in rows), key=lambda g: (-len(g[0]), -g[1], g[2]))

    def agree(a, b):
        shared = [p for p in a[0] if p in b[0]]
        same = sum(a[0][p] == b[0][p] for p in shared)
        return same, len(shared) - same

    def fits(v, found):
        out = []
        for age, c in enumerate(found):
            each = [agree(v, m) for m in c if m is not v]
            if any(d > most for _, d in each):
                continue
            best = max(((s - d, i) for i, (s, d) in enumerate(each)), key=lambda x: (x[0], -x[1]), default=None)
            if best and best[0] > 0 and each[best[1]][0] >= least:
                out.append((best[0], age, c))
        return sorted(out, key=lambda x: x[:2])

    found, free = [], list(groups)
    while free:
        found.append([free.pop(0)])
        if len(found) > 1:
            for c in sorted(found, key=lambda c: sum(m[1] for m in c)):
                while c:
                    score = [sum(s - d for s, d in (agree(v, m) for m in c if m is not v)) for v in c]
                    v = c[score.index(min(score))]
                    good = fits(v, found)
                    if not good or good[0][2] is c:
                        break
                    c[:] = [m for m in c if m is not v]
                    good[0][2].append(v)
            found = [c for c in found if c]
        for _ in range(10):
            left = []
            for v in free:
                good = fits(v, found)
                if not good:
                    left.append(v)
                    continue
                best = [c for s, _, c in good if s == good[-1][0]]
                target, dead = best[0], []
                for i, a in enumerate(best):
                    for b in best[i + 1 :]:
                        if any(a is d or b is d for d in dead):
                            continue
                        members = [*a, *b, v]
                        pairs = [agree(p, q) for x, p in enumerate(members) for q in members[x + 1 :]]
                        if min(pairs, key=lambda p: p[0] - p[1])[1] <= most:
                            a += b
                            found = [c for c in found if c is not b and c is not a] + [a]
                            dead.append(b)
                            target = a
                        elif sum(m[1] for m in b) > sum(m[1] for m in a):
                            target = b
                target.append(v)
            done, free = len(left) == len(free), left
            if done or not free:
                break
    return sorted(sorted(m[2] for m in c) for c in found)


@pytest.mark.parametrize("least, most", [(1, 0), (2, 0), (1, 1)])
def test_clusters_equal_the_plain_version(spark, least, most):
    from varigrid.operators.clustering import clusters

    rng, rows, want = random.Random(least * 10 + most), [], {}
    for nbhd in range(40):
        haplotypes = ["".join(rng.choice("aarrx") for _ in range(6)) for _ in range(rng.randrange(1, 4))]
        seen = {}
        for _ in range(rng.randrange(2, 14)):
            h = rng.choice(haplotypes)
            lo = rng.randrange(0, 4)
            states = "".join("-" if i < lo or i > lo + rng.randrange(1, 4) else rng.choice("arx") if rng.random() < 0.1 else c for i, c in enumerate(h))
            if set(states) != {"-"}:
                seen[signature(states)] = rng.randrange(1, 9)
        # one read over all sites keeps the neighborhood in one part
        seen[signature("xxxxxx")] = 1
        rows += [("c", nbhd, s, n) for s, n in seen.items()]
        want[nbhd] = plain_clusters(list(seen.items()), least, most)
    df = spark.createDataFrame(rows, "chrom string, nbhd long, signature string, n long")
    got = {}
    for r in clusters(df, least_agree=least, most_disagree=most).collect():
        got.setdefault(r.nbhd, {}).setdefault((r.part, r.cluster), []).append(r.signature)
    assert {k: sorted(map(sorted, v.values())) for k, v in got.items()} == want


def test_neighborhoods_are_cut_where_nothing_spans(spark):
    from varigrid.operators.clustering import clusters, parts

    df = frame(spark, [("1:alt,2:alt", 3), ("2:alt,3:ref", 2), ("5:alt", 1), ("5:ref,9:alt", 1), ("300000:alt", 4)])
    got = {r.signature: r.part for r in parts(df).collect()}
    assert got == {"1:alt,2:alt": 3, "2:alt,3:ref": 3, "5:alt": 9, "5:ref,9:alt": 9, "300000:alt": 300000}
    assert clusters(df.limit(0)).collect() == []


def test_ten_thousand_chained_sites(spark):
    """Every site shares reads with the next one: one part, and one cluster for each of two haplotypes."""
    from pyspark.sql import functions as F

    from varigrid.operators.clustering import clusters

    n = 10_000
    rows = [(f"{i * 40}:{k},{i * 40 + 40}:{k},{i * 40 + 80}:{k}", 5) for i in range(n - 2) for k in ("alt", "ref")]
    got = clusters(frame(spark, rows)).groupBy("part", "cluster").agg(F.max("consensus").alias("consensus"), F.count("*").alias("count")).collect()
    assert len(got) == 2 and {r["count"] for r in got} == {n - 2}
    assert {len(set(x.split(":")[1] for x in r.consensus.split(","))) for r in got} == {1}


def test_alleles_are_trimmed_and_references_pay(spark):
    from varigrid.operators.clustering import clusters, phased_alleles, recalled, references_left

    signed = frame(spark, [("10:alt,14:alt", 20), ("10:ref,14:ref", 30), ("10:alt", 4), ("14:ref", 2)])
    sites = spark.createDataFrame([("c", 1, 10, "AC", "AG"), ("c", 1, 14, "T", "TCC")], "chrom string, nbhd long, pos long, ref string, alt string")
    base = spark.createDataFrame([("c", p, b) for p, b in zip(range(8, 17), "GGACTTTAA", strict=True)], "chrom string, pos long, base string")
    found, used = phased_alleles(clusters(signed), sites, base)
    got = [(r.pos, r.ref, r.alt, r.kind, r.support, r.depth) for r in found.collect()]
    # AC TT T -> AG TT TCC: the A goes, counts are (24 + 20) / 2 and (54 + 52) / 2
    assert got == [(11, "CTTT", "GTTTCC", "mnv", 22, 53)]
    assert sorted((r.pos, r.used) for r in used.collect()) == [(12, 22), (13, 22)]
    (call,) = recalled(found).collect()
    assert call.vq == 100 and call["filters"] == [] and recalled(found, least_frequency=0.9).collect() == []
    originals = spark.createDataFrame([("c", 1, 12, "T", "C", 40, 60), ("c", 1, 13, "T", "G", 10, 60), ("c", 1, 20, "A", "C", 9, 30)], "chrom string, nbhd long, pos long, ref string, alt string, ref_support long, depth long")
    left = {r.pos: (r.ref, r.support, r.genotype) for r in references_left(originals, used).collect()}
    assert left == {12: ("T", 18, "0/0"), 13: ("T", 0, "0/."), 20: ("A", 9, "0/0")}


@pytest.mark.parametrize("site, want", [
    (("ACC", "AC"), (10, "AC", "A", "deletion")),
    (("A", "AT"), (10, "A", "AT", "insertion")),
    (("A", "G"), (10, "A", "G", "snv")),
    (("AC", "GC"), (10, "A", "G", "snv")),
])
def test_kinds_of_alleles(spark, site, want):
    from varigrid.operators.clustering import clusters, phased_alleles

    sites = spark.createDataFrame([("c", 1, 10, *site)], "chrom string, nbhd long, pos long, ref string, alt string")
    base = spark.createDataFrame([("c", 9, "G"), ("c", 10, "A"), ("c", 11, "C")], "chrom string, pos long, base string")
    (r,) = phased_alleles(clusters(frame(spark, [("10:alt", 5)])), sites, base)[0].collect()
    assert (r.pos, r.ref, r.alt, r.kind) == want
