"""Fitting the binomial mixture of allele states."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.operators import blocks
from varigrid.operators.genotype import SNV_MEANS, SNV_PRIORS, scaled_depth


@dataclass(frozen=True)
class Mixture:
    means: tuple[float, ...]
    priors: tuple[float, ...]
    rounds: int = 0

    def lines(self) -> list[str]:
        """Two comma-separated lines: means, then priors."""
        return [",".join(map(repr, self.means)), ",".join(map(repr, self.priors))]

    @classmethod
    def parse(cls, lines: list[str]) -> list[Mixture]:
        """One model of two lines, or a substitution and an indel model of four."""
        rows = [tuple(float(x) for x in line.split(",")) for line in lines if line.strip()]
        if len(rows) not in (2, 4):
            raise ValueError("a model has two or four lines")
        return [cls(rows[i], rows[i + 1]) for i in range(0, len(rows), 2)]


def training_rows(calls: DataFrame) -> DataFrame:
    """Rows (chrom, ref, alt, vf, dp, ad) fit to learn from: deep enough, and neither stray mismatches nor sure indels."""
    same = F.length("ref") == F.length("alt")
    usable = (F.col("dp") >= 10) & F.when(same, F.col("vf") >= 0.02).otherwise(F.col("vf") != 1) & F.col("chrom").rlike("[0-9]")
    return calls.filter(usable)


def depth_pairs(rows: DataFrame) -> DataFrame:
    """(ad, dp, n): the different pairs of scaled counts.  Depth is at most ``MOST_DEPTH``, so pairs are under half a million."""
    k, n = scaled_depth(F.col("ad"), F.col("dp"))
    return rows.select(k.alias("ad"), n.alias("dp")).groupBy("ad", "dp").agg(F.count("*").alias("n"))


def fit(rows: DataFrame, means: tuple = SNV_MEANS, priors: tuple = SNV_PRIORS, rounds: int = 1000, tolerance: float = 1e-6) -> Mixture:
    """Means and priors by expectation-maximisation over the different (ad, dp) pairs, weighted by their number.

    Without rows the model is the one begun with, after 0 rounds; a state that no row is left to keeps its mean and prior.
    """
    held = np.array([(r["ad"], r["dp"], r["n"]) for r in depth_pairs(rows).collect()], float).reshape(-1, 3)
    return fit_pairs(held[:, 0], held[:, 1], held[:, 2], means, priors, rounds, tolerance)


def fit_pairs(ad: np.ndarray, dp: np.ndarray, weight: np.ndarray, means: tuple, priors: tuple, rounds: int, tolerance: float) -> Mixture:
    m, p = np.array(means, float), np.array(priors, float)
    if not weight.sum():
        return Mixture(tuple(map(float, m)), tuple(map(float, p)), 0)
    order = np.lexsort((ad, dp))
    ad, dp, weight = ad[order], dp[order], weight[order]
    logs = np.array([math.lgamma(i + 1) for i in range(int(dp.max(initial=0)) + 1)])
    ways = logs[dp.astype(int)] - logs[ad.astype(int)] - logs[(dp - ad).astype(int)]
    for i in range(1, rounds + 1):
        like = ways[:, None] + ad[:, None] * np.log(m) + (dp - ad)[:, None] * np.log1p(-m) + np.log(p)
        share = np.exp(like - like.max(axis=1, keepdims=True))
        share *= (weight / share.sum(axis=1))[:, None]
        size = share.sum(axis=0)
        bare = size < 1e-12 * size.sum()
        new_m = np.clip((share * ad[:, None]).sum(axis=0) / np.maximum((share * dp[:, None]).sum(axis=0), 1e-300), 1e-12, 1 - 1e-12)
        new_m = np.where(bare, m, new_m)
        new_p = np.where(bare, p, size / size[~bare].sum() * (1 - p[bare].sum()))
        moved = max(np.abs(new_m - m).max(), np.abs(new_p - p).max())
        m, p = new_m, new_p
        if moved < tolerance:
            break
    return Mixture(tuple(map(float, m)), tuple(map(float, p)), i)


def outside_deletions(calls: DataFrame) -> DataFrame:
    """Calls (chrom, pos, ref, alt) that no deletion before them has taken the place of."""
    end = F.when(F.length("ref") > F.length("alt"), F.col("pos") + F.length("ref") - 1)
    shaded = blocks.running(calls, ["chrom"], "pos", ["pos", "ref", "alt"], end, "_shadow")
    return shaded.filter(F.col("_shadow").isNull() | (F.col("pos") > F.col("_shadow"))).drop("_shadow")
