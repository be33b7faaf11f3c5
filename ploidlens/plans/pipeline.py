"""Reads to association in one plan, with the steps of the workflow as functions of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.operators import gwas, kmers


@dataclass(frozen=True)
class Config:
    k: int = 31
    low: int = 5
    high: int = 1000
    min_samples: int = 1
    max_missing: float = 0.8
    ploidy: int = 4
    sketch: int = 10_000_000
    components: int = 3


def genotypes(reads: DataFrame, depth: DataFrame, samples: list[str], config: Config = Config()) -> DataFrame:
    """Counts, matrix, filter and dosage: kmer, allele1, allele0, dosage."""
    tidy = kmers.matrix(kmers.count(reads, config.k), config.low, config.high, config.min_samples)
    return kmers.bimbam(kmers.filter_dosage(tidy, depth, len(samples), config.high, config.max_missing, config.ploidy), samples)


def association(rows: DataFrame, trait: np.ndarray, n: int, config: Config = Config()) -> DataFrame:
    """The scan, with kinship and components from a sketch of the rows. Stage rows as a table first: they are read twice."""
    k = gwas.kinship(kmers.sketch(rows, config.sketch), n)
    return gwas.lmm(rows, trait, gwas.principal_components(k, config.components), k, ploidy=config.ploidy)


#: Folders of a run, in the order of the steps that write them.
FOLDERS = {"count": "01_count", "matrix": "02_matrix", "filter": "03_filter", "convert": "04_dosage", "asso": "05_association"}


def workflow(spark, reads: DataFrame, depth: DataFrame, out: str, pheno: DataFrame | None = None, samples: list[str] | None = None, config: Config = Config()) -> dict[str, DataFrame]:
    """All steps, each written as a table under its folder of `out` and read again: step to table.

    samples: their order in dosage arrays; else the samples of depth by name. Without phenotypes (sample, trait) there is no
    association; a sample without one has a NaN trait, and is left out of the scan."""
    samples = samples or [r["sample"] for r in depth.select("sample").distinct().orderBy("sample").collect()]
    made = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{FOLDERS[name]}"
        df.write.mode("overwrite").parquet(path)
        made[name] = spark.read.parquet(path)
        return made[name]

    counts = kept("count", kmers.count(reads, config.k))
    tidy = kept("matrix", kmers.matrix(counts, config.low, config.high, config.min_samples))
    dosage = kept("filter", kmers.filter_dosage(tidy, depth, len(samples), config.high, config.max_missing, config.ploidy))
    rows = kept("convert", kmers.bimbam(dosage, samples))
    if pheno is not None:
        trait = {r["sample"]: r["trait"] for r in pheno.filter(F.col("sample").isin(samples)).collect()}  # a number for each sample
        y = np.array([np.nan if trait.get(s) is None else trait[s] for s in samples], float)
        kept("asso", association(rows, y, len(samples), config))
    return made


STEPS = {"count": kmers.count, "matrix": kmers.matrix, "filter": kmers.filter_dosage, "convert": kmers.bimbam, "sketch": kmers.sketch, "b2g": kmers.vcf_lines, "kinship": gwas.kinship, "pca": gwas.principal_components, "asso": association}


def step(name: str):
    if name not in STEPS:
        raise ValueError(f"unknown step {name}; one of {', '.join(STEPS)}")
    return STEPS[name]
