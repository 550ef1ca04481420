"""Statistics of base calls as Column expressions.

Sums over few counts are higher-order ``aggregate`` calls on a running term;
beyond that the incomplete gamma and beta functions are integrals of a fixed
number of nodes, so that no array grows with the depth.  Poisson probabilities are
worked out over Arrow batches, all else in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN10 = math.log(10)
#: Probabilities below this have the quality at its side.
LEAST_P, TOP_Q = 1e-300, 3000.0


def q_to_p(q: Column) -> Column:
    """Error probability of a Phred quality."""
    return F.pow(F.lit(10.0), -q / 10.0)


def p_to_q(p: Column) -> Column:
    """Phred quality of a probability; infinite for 0."""
    return -10.0 * F.log10(p)


def p_to_q_capped(p: Column) -> Column:
    return F.when(p < LEAST_P, TOP_Q).otherwise(-10.0 * F.log10(p))


def log_scale(p: Column) -> Column:
    """Ten times the decadic logarithm, minus infinity for 0."""
    return F.when(p <= 0, F.lit(float("-inf"))).otherwise(10.0 * F.log10(p))


#: Counts up to this are summed term by term; beyond it integrals of as many nodes stand for the sums.
TERMS, NODES = 128, 40
_AT, _WEIGHT = np.polynomial.legendre.leggauss(NODES)


def bound(make: Callable[[Column], Column], **columns: Column) -> Column:
    """``make`` of a struct of the columns, which are worked out once each."""
    held = F.array(F.struct(*[c.cast("double").alias(n) for n, c in columns.items()]))
    return F.get(F.transform(held, make), F.lit(0))


def _integral(low: Column, high: Column, f: Callable[[Column], Column]) -> Column:
    """Integral of a smooth function between two bounds in either order, by Gauss and Legendre's rule."""
    nodes = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(_AT, _WEIGHT, strict=True)])
    return F.abs(high - low) * F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["w"] * f(low + (high - low) * n["x"]))


def _stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's formula, for n beyond TERMS."""
    return 1.0 / (12.0 * n) - 1.0 / (360.0 * n * n * n) + 1.0 / (1260.0 * n * n * n * n * n)


def _window(z: Column, least: Column) -> Column:
    """Where an integral from z away from 0, in deviations, has nothing more to add."""
    return F.when(z >= 0, F.greatest(F.lit(12.0), z + 6.0)).otherwise(F.greatest(least, F.least(F.lit(-12.0), z - 6.0)))


def _poisson_far(k: np.ndarray, mean: np.ndarray, beyond: bool) -> np.ndarray:
    """P(X <= k), or P(X > k) if ``beyond``: the incomplete gamma function as an integral over means around k.

    With z deviations from k the integrand is exp(-k (u - ln(1 + u))), u = z / sqrt(k), so
    that no large numbers are taken from each other.
    """
    root = np.sqrt(k)
    z = (mean - k) / root
    end = np.where(z >= 0, np.maximum(12.0, z + 6.0), np.maximum(-root, np.minimum(-12.0, z - 6.0)))
    total = np.zeros(len(k))
    for x, w in zip(_AT, _WEIGHT, strict=True):
        u = (z + (end - z) * (x + 1) / 2) / root
        total += w / 2 * np.exp(-k * (u - np.log1p(np.maximum(-1.0 + 1e-15, u))))
    side = np.abs(end - z) * total * np.exp(-_stirling_rest(k)) / math.sqrt(2 * math.pi)
    return np.clip(np.where((z < 0) == beyond, side, 1.0 - side), 0.0, 1.0)


def _poisson_near(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X <= k) for k up to TERMS, term by term."""
    term = np.exp(-mean)
    total = term.copy()
    for i in range(1, int(k.max(initial=0)) + 1):
        term = term * mean / i
        total += np.where(i <= k, term, 0.0)
    return np.minimum(1.0, total)


@cache
def _poisson(beyond: bool) -> Callable[[Column, Column], Column]:
    """A function of whole numbers and means, worked out over the Arrow batches of a task.

    As expressions the sums and integrals are interpreted for each row, and once more
    wherever their column is used.  Without a number or a mean the probability counts as
    it always did: 1 for P(X <= k).
    """

    @F.arrow_udf(DoubleType())
    def probability(k: pa.Array, mean: pa.Array) -> pa.Array:
        unknown = mean.is_null().to_numpy(zero_copy_only=False)
        far = k.is_null().to_numpy(zero_copy_only=False)
        n, m = k.fill_null(0).to_numpy(zero_copy_only=False).astype("int64"), mean.fill_null(0.0).to_numpy(zero_copy_only=False)
        out = np.full(len(n), 1.0)
        few, many = ~far & ~unknown & (n >= 0) & (n <= TERMS), ~far & ~unknown & (n > TERMS)
        with np.errstate(all="ignore"):
            near = _poisson_near(n[few], m[few])
            out[few] = 1.0 - near if beyond else near
            out[many] = _poisson_far(n[many].astype("float64"), m[many], beyond)
        out[~far & (n < 0)] = 1.0 if beyond else 0.0
        if beyond:
            out[~far & unknown & (n >= 0) & (n <= TERMS)] = 0.0
        return pa.array(out)

    return probability


def _counted(k: Column) -> Column:
    """1 to k, for k up to TERMS."""
    return F.when(k.between(1, TERMS), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) for whole k, cut off toward zero; 0 for negative k.  Costs the same at any depth."""
    return _poisson(False)(k.cast("long"), mean.cast("double"))


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X > k) for whole k; beyond TERMS small tails keep their digits."""
    return _poisson(True)(k.cast("long"), mean.cast("double"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 9."""

    def made(held: Column) -> Column:
        x, y = held["x"], held["x"] + 9.0
        shift = x
        for i in range(1, 9):
            shift = shift * (x + float(i))
        inverse = 1.0 / (y * y)
        rest = (1.0 / 12 - inverse * (1.0 / 360 - inverse * (1.0 / 1260 - inverse * (1.0 / 1680 - inverse / 1188.0)))) / y
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + rest - F.log(shift)

    return bound(made, x=x)


def log_factorial(n: Column) -> Column:
    k = n.cast("long")
    return F.when(k < 2, 0.0).otherwise(log_gamma(k + 1))


def log_poisson(k: Column, mean: Column) -> Column:
    return k * F.log(mean) - mean - log_factorial(k)


def log_binomial(k: Column, n: Column, p: float | Column) -> Column:
    p = F.lit(p) if isinstance(p, float) else p
    k, n = k.cast("long"), n.cast("long")
    ways = F.when((k <= 0) | (k >= n), 0.0).otherwise(log_factorial(n) - log_factorial(k) - log_factorial(n - k))
    return ways + k * F.log(p) + (n - k) * F.log(1.0 - p)


def _binomial_sum(k: Column, n: Column, p: float) -> Column:
    r = p / (1 - p)
    start = F.struct(F.pow(F.lit(1 - p), n).alias("p"), F.pow(F.lit(1 - p), n).alias("s"))
    term = lambda a, i: a["p"] * (n - i + 1) / i * r
    step = lambda a, i: F.struct(term(a, i).alias("p"), (a["s"] + term(a, i)).alias("s"))
    return F.least(F.lit(1.0), F.aggregate(_counted(k), start, step, lambda a: a["s"]))


def _binomial_integral(k: Column, n: Column, p: float) -> Column:
    """The incomplete beta function as an integral over success rates around k / (n - 1)."""

    def made(x: Column) -> Column:
        m, rest = x["n"] - 1.0, x["n"] - 1.0 - x["k"]
        share = x["k"] / m
        unit = F.sqrt(x["k"] * rest / m) / m
        return bound(ended, m=m, k=x["k"], rest=rest, share=share, unit=unit, z=(F.lit(p) - share) / unit)

    def ended(x: Column) -> Column:
        away = lambda z: F.when((z * x["unit"] >= 1.0 - x["share"]) | (z * x["unit"] <= -x["share"]), F.lit(float("-inf")))
        density = lambda z: F.exp(away(z).otherwise(x["k"] * F.log1p(z * x["unit"] / x["share"]) + x["rest"] * F.log1p(-z * x["unit"] / (1.0 - x["share"]))))
        scale = F.exp(_stirling_rest(x["m"]) - _stirling_rest(x["k"]) - _stirling_rest(x["rest"])) / math.sqrt(2 * math.pi) * (x["m"] + 1.0) / x["m"]
        side = scale * _integral(x["z"], _window(x["z"], -x["share"] / x["unit"]), density)
        return F.when(x["z"] < 0, 1.0 - side).otherwise(side)

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound(made, k=k, n=n)))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials; costs the same for any number of them."""
    k, n = k.cast("long"), n.cast("long")
    few, many = _binomial_sum(k, n, p), 1.0 - _binomial_sum(n - k - 1, n, 1 - p)
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(k <= TERMS, few).when(n - k - 1 <= TERMS, F.greatest(F.lit(0.0), many)).otherwise(_binomial_integral(k, n, p))


def variant_q(support: Column, coverage: Column, noise_q: Column | int = 20, most: Column | int = 100) -> Column:
    """Quality of seeing ``support`` or more errors in ``coverage`` at a noise quality, half-even rounded, 0 to ``most``.

    Where the tail probability is lost to rounding, its leading term stands for it.
    """
    noise_q = F.lit(noise_q) if isinstance(noise_q, int) else noise_q
    mean = q_to_p(noise_q) * coverage
    tail = poisson_tail(support - 1, mean)
    far = -10.0 * (log_poisson(support - 1, mean) - F.log(2.0 * (support - mean) / support)) / LN10
    q = F.when(tail > 1e-13, -10.0 * F.log10(tail)).otherwise(far)
    most = F.lit(most) if isinstance(most, int) else most
    bounded = F.greatest(F.lit(0.0), F.least(most.cast("double"), q))
    return F.when((support <= 0) | (coverage <= 0), 0).otherwise(F.bround(bounded)).cast("int")


def strand_bias(support: Column, coverage: Column, noise_q: int = 20, acceptance: float = 0.5) -> Column:
    """Struct (score, scaled, both, acceptable) from arrays by direction: forward, reverse, stitched.

    Half of the stitched reads, rounded down, count for either strand.  C is
    the chance that a strand's support isn't noise and F that it is; the score
    sets the worse of the crossings of C and F against C of all reads.
    """
    error = q_to_p(F.lit(float(noise_q)))
    part = lambda a, i: F.get(a, i) + F.floor(F.get(a, F.lit(2)) / 2)
    fs, rs = part(support, F.lit(0)), part(support, F.lit(1))
    fc, rc = part(coverage, F.lit(0)), part(coverage, F.lit(1))
    sums = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    stats = [_strand(s, c, error) for s, c in ((fs, fc), (rs, rc), (sums(support), sums(coverage)))]
    (f_real, f_none), (r_real, r_none), (all_real, _) = stats
    cross = F.greatest(f_real * r_none, r_real * f_none)
    score = F.when((fc == 0) | (rc == 0), 0.0).when(all_real == 0, 1.0).otherwise(cross / all_real)
    scaled = F.when((fc == 0) | (rc == 0), F.lit(float("-inf"))).otherwise(log_scale(score))
    return F.struct(score.alias("score"), scaled.alias("scaled"), ((fs > 0) & (rs > 0)).alias("both"), (score < acceptance).alias("acceptable"))


def _strand(support: Column, coverage: Column, error: Column) -> tuple[Column, Column]:
    """(C, F) of one strand: C the chance of a false negative turned round, F its complement."""
    absent = F.pow(1.0 - error, coverage)
    real = F.when(support == 0, absent).otherwise(F.greatest(F.lit(0.0), poisson_cdf(support - 1, coverage * error)))
    return real, F.when(support == 0, 1.0 - absent).otherwise(F.greatest(F.lit(0.0), 1.0 - real))


def somatic_gq(vq: Column, frequency: Column, coverage: Column, homozygous: Column, lod: float, least: int = 0, most: int = 100) -> Column:
    """Genotype quality of a somatic call; a homozygous one also pays for the reads that disagree."""
    seen, expected = (1.0 - frequency) * coverage, F.lit(lod) * coverage
    p = q_to_p(vq.cast("double")) + poisson_cdf(seen, expected)
    q = F.bround(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), -10.0 * F.log10(p))))
    return F.when(~homozygous, vq).when(seen >= expected, least).otherwise(q).cast("int")


def diploid_gq(genotype: Column, support: Column, coverage: Column, frequency: Column, least: int = 0, most: int = 100) -> Column:
    """Genotype quality of a diploid call from the likelihoods of two genotypes."""
    n = F.greatest(coverage - support, F.lit(0))
    cov = coverage.cast("double")
    het_k = (cov * frequency).cast("int")
    other = F.when(frequency >= 0.5, log_binomial(het_k, coverage, 0.9)).otherwise(log_binomial(het_k, coverage, 0.1))
    gap = (
        F.when(genotype == "0/0", log_poisson(n, 0.05 * cov) - log_binomial(n, coverage, 0.4))
        .when(genotype == "1/1", log_poisson(n, 0.075 * cov) - log_binomial(support, coverage, 0.4))
        .otherwise(log_binomial(het_k, coverage, 0.4) - other)
    )
    q = F.floor(10.0 / LN10 * gap)
    return F.greatest(F.lit(least), F.least(F.lit(most), q)).cast("int")


def haploid_gq(genotype: Column, support: Column, coverage: Column, least: int = 0, most: int = 100) -> Column:
    """Genotype quality of a haploid call (0 or 1) from how much likelier it is than a mixed site; a no-call gets the least."""
    n = F.greatest(coverage - support, F.lit(0))
    cov = coverage.cast("double")
    gap = F.when(genotype == "0", log_poisson(n, 0.05 * cov) - log_binomial(n, coverage, 0.4)).when(genotype == "1", log_poisson(n, 0.075 * cov) - log_binomial(support, coverage, 0.4))
    q = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(10.0 / LN10 * gap)))
    return F.when(gap.isNull() | (coverage == 0), least).otherwise(q).cast("int")


def amplicon_biased(support: Column, frequency: Column, coverage: Column, top_frequency: Column, threshold: float = 0.01) -> Column:
    """Whether one amplicon has too little support for the highest frequency among its fellows."""
    expected = top_frequency * coverage
    return F.when((expected < 5) | (expected <= support) | (frequency > 0.1), False).otherwise(poisson_cdf(support, expected) < threshold)


def crossing_frequency(depth: Column, low: float, high: float, prior_low: float, prior_high: float) -> Column:
    """The frequency at which two binomial states of given means and priors are equally probable at a depth."""
    rest = math.log((1 - low) / (1 - high))
    return (F.lit(rest) + math.log(prior_low / prior_high) / depth) / (math.log(high / low) + rest)


def pooled_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Two-sample t value with the pooled deviation."""
    pooled = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))
    return (mean_a - mean_b) / (pooled * F.sqrt(1.0 / n_a + 1.0 / n_b))


def unanchored_weight(unanchored_vf: Column, anchored_vf: Column) -> Column:
    """How much unanchored coverage counts for an insertion: the ratio of frequencies, at most 1."""
    return F.when(anchored_vf <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), unanchored_vf / anchored_vf)))
