"""Incremental k-mer counts over arriving reads (Structured Streaming, update mode)."""

from pyspark.sql import DataFrame

from ploidlens.operators import kmers


def count_stream(reads: DataFrame, k: int = 31) -> DataFrame:
    """A streaming DataFrame of reads (sample, seq) to running counts by sample and canonical k-mer: one stateful aggregation."""
    from pyspark.sql import functions as F

    return kmers.read_kmers(reads, k).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))
