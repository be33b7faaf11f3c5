"""Genotype likelihoods of the bases at a position, under an error model with dependent errors.

Of n bases at a position, taken by falling quality, the k-th that differs from the genotype costs the logarithm of
how likely a k-th error is after k - 1 others (tails of a binomial distribution with the base's own error rate).
A further base of its letter and strand counts less: by (1 - dependence) ** earlier * (1 - least) + least.
Heterozygous genotypes add the binomial logarithm of how their two letters share their bases.

Bases are first counted by letter, strand and quality, so that a position is at most 8 * 60 rows whatever its depth,
and no base is left out at deep ones. Gaps, letters other than ACGT and bases without a quality don't count. A position
without bases has no row; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: Qualities are held within these bounds; DEPENDENCE and LEAST as above.
LOW, HIGH = 4, 63
DEPENDENCE, LEAST = 0.17, 0.03
PHRED = 10 / math.log(10)
PAIRS = [a + b for i, a in enumerate(LETTERS) for b in LETTERS[i:]]


def log_choose(n: int) -> np.ndarray:
    """Logarithms of n over 0 to n."""
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return f[n] - f - f[::-1]


def costs(q: int, n: int) -> np.ndarray:
    """For k from 0 to n - 1, on the Phred scale: that there are more than k errors among n bases of quality q, if there are at least k."""
    k = np.arange(n + 1)
    e = 10 ** (-q / 10)
    tail = np.logaddexp.accumulate((log_choose(n) + k * math.log(e) + (n - k) * math.log1p(-e))[::-1])[::-1]
    return PHRED * (tail[:-1] - tail[1:])


def likelihoods(letter: np.ndarray, reverse: np.ndarray, q: np.ndarray, many: np.ndarray, dependence: float = DEPENDENCE) -> np.ndarray:
    """Phred likelihoods of PAIRS, of counts (many) by letter (0 to 3), strand and quality. Of equal qualities forward ones come first."""
    n, kept = int(many.sum()), {}
    seen, strand, total = np.zeros(4, np.int64), np.zeros((4, 2), np.int64), np.zeros(4)
    for at in np.lexsort((reverse, letter, -q)):
        b, s, m, level = int(letter[at]), int(reverse[at]), int(many[at]), int(q[at])
        if level not in kept:
            kept[level] = costs(level, n)
        weight = (1 - dependence) ** np.arange(strand[b, s], strand[b, s] + m) * (1 - LEAST) + LEAST
        total[b] += weight @ kept[level][seen[b] : seen[b] + m]
        seen[b] += m
        strand[b, s] += m
    out = []
    for i in range(4):
        for j in range(i, 4):
            both = int(seen[i] + seen[j])
            share = 0.0 if i == j else PHRED * (both * math.log(2) - log_choose(both)[seen[j]])
            out.append(total.sum() - sum(total[k] for k in {i, j}) + share)
    return np.maximum(np.array(out), 0.0)


def allele_likelihoods(bases: DataFrame, dependence: float = DEPENDENCE) -> DataFrame:
    """Of bases (chrom, pos, base, q, reverse), as aligned_bases has them: chrom, pos, depth, genotype (two letters) and its likelihood on the Phred scale."""
    rows = bases.filter("not is_del and not is_refskip and upper(base) in ('A', 'C', 'G', 'T') and q is not null")
    level = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("q"))).cast("int")
    counted = rows.groupBy("chrom", "pos", (F.instr(F.lit(LETTERS), F.upper("base")) - 1).alias("letter"), F.coalesce("reverse", F.lit(False)).cast("int").alias("strand"), level.alias("level")).agg(F.count("*").alias("many"))
    there = counted.groupBy("chrom", "pos").agg(F.collect_list(F.struct("letter", "strand", "level", "many")).alias("c"), F.sum("many").alias("depth"))

    def run(letter: pd.Series, strand: pd.Series, level: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([likelihoods(*map(np.asarray, x), dependence).tolist() for x in zip(letter, strand, level, many)])

    found = F.pandas_udf(run, "array<double>")(*[F.col(f"c.{k}") for k in ("letter", "strand", "level", "many")])
    named = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in PAIRS]).alias("genotype"), F.col("found").alias("likelihood")))
    return there.select("chrom", "pos", "depth", found.alias("found")).select("chrom", "pos", "depth", named.alias("g")).select("chrom", "pos", "depth", "g.*")
