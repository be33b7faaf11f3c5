"""From reads to population matrices: count, dump, matrix, filter, dosage, sketch, retrieve, trace."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.functions import align, codec, rolling

#: Distinct k-mers that a task counts before it passes them on; listed k-mers that go to all tasks (16 bytes each).
HELD, LISTED = 2_000_000, 4_000_000
#: Longest k-mer with a place for each code in an array of a task (32 MB).
DENSE = 11
#: Samples whose depths or places go to all tasks; samples of a row that are collected together.
SAMPLES, BLOCK = 1_000_000, 4096


def read_kmers(reads: DataFrame, k: int, canonical: bool = True, n_as_a: bool = False, keep: list[str] = ("sample",)) -> DataFrame:
    """Each distinct k-mer of each read's chunk: keep columns, kmer. K-mers with other letters than ACGT are dropped."""
    s = codec.bases(F.col("seq"), n_as_a)
    rows = reads.select(*keep, F.explode(codec.chunks(s, k)).alias("chunk")).select(*keep, F.explode(codec.windows(F.col("chunk"), k)).alias("kmer"))
    rows = rows.filter(F.col("kmer").rlike("^[ACGT]+$"))
    return rows.withColumn("kmer", codec.canonical(F.col("kmer"))) if canonical else rows


def count(reads: DataFrame, k: int = 31, canonical: bool = True, n_as_a: bool = False) -> DataFrame:
    """(sample, kmer, cnt) of reads (sample, seq). Tasks count codes of k-mers in arrays; one shuffle, of codes, adds these up.

    Null and short sequences have no k-mers; null samples are a sample of their own; an empty table gives no rows.
    k over 31 is counted as strings. Columns other than sample and seq are ignored."""
    if k > rolling.LONGEST:
        return read_kmers(reads, k, canonical, n_as_a).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))
    rows = reads.select("sample", "seq")

    def run(batches):
        names: dict = {}
        held: list[np.ndarray] = []

        def merged():
            x = np.concatenate(held)
            o = np.lexsort((x[:, 1], x[:, 0]))
            x = x[o]
            first = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])) if len(x) else np.zeros(0, np.int64)
            return np.column_stack([x[first, :2], np.add.reduceat(x[:, 2], first) if len(x) else x[:, 2]])

        def out(x):
            listed = pa.array(list(names), pa.string())
            return pa.record_batch([listed.take(pa.array(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1])), pa.array(np.ascontiguousarray(x[:, 2]))], ["sample", "code", "cnt"])

        for b in batches:
            sample = np.array([names.setdefault(v, len(names)) for v in b.column(0).to_pylist()], np.int64)
            seqs = b.column(1).to_pylist()
            for lo, hi in rolling.steps(seqs):
                code, at = rolling.codes(seqs[lo:hi], k, canonical, n_as_a)
                part = np.column_stack([sample[lo:hi][at], code, np.ones(len(code), np.int64)])
                held.append(part)
                if sum(map(len, held)) > HELD:
                    held = [merged()]
                    if len(held[0]) > HELD // 2:
                        yield out(held.pop())
        if held:
            yield out(merged())

    counted = rows.withColumn("sample", F.col("sample").cast("string")).mapInArrow(run, "sample string, code long, cnt long")
    total = counted.groupBy("sample", "code").agg(F.sum("cnt").alias("cnt"))
    return total.select(F.col("sample").cast(rows.schema["sample"].dataType).alias("sample"), codec.decode(F.col("code"), k).alias("kmer"), "cnt")


def _distinct(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The codes of each read, once a read; reads are fewer than 512."""
    if k > 27:
        o = np.lexsort((at, code))
        code, at = code[o], at[o]
        return code[np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])])] if len(code) else code
    both = np.sort((at << 2 * k | code).astype(np.int32 if k <= 11 else np.int64))
    return (both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both).astype(np.int64) & (1 << 2 * k) - 1


def in_reads(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n_reads) of reads (seq): in how many reads each canonical k-mer (k up to 31) is. Null and short reads have none; each row is a read.

    A task adds up what its reads have: for k up to DENSE in one array, else up to HELD distinct k-mers at a time."""

    def out(code, n):
        return pa.record_batch([pa.array(code), pa.array(n)], ["code", "n"])

    def run(batches):
        whole = np.zeros(4**k if k <= DENSE else 0, np.int64)
        held: list[tuple] = []

        def merged():
            code, n = (np.concatenate([h[q] for h in held]) for q in (0, 1))
            o = np.argsort(code, kind="stable")
            code, n = code[o], n[o]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            return code[first], np.add.reduceat(n, first) if len(first) else n

        for b in batches:
            seqs = b.column(0).to_pylist()
            for lo, hi in rolling.steps(seqs):
                code = _distinct(*rolling.codes(seqs[lo:hi], k), k)
                if k <= DENSE:
                    whole += np.bincount(code, minlength=len(whole))
                    continue
                held.append(np.unique(code, return_counts=True))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out(*held.pop())
        if k <= DENSE:
            held = [(np.flatnonzero(whole), whole[whole > 0])]
        if held:
            yield out(*merged())

    found = reads.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_reads"))
    return found.select(codec.decode(F.col("code"), k).alias("kmer"), "n_reads")


def dump(counts: DataFrame, low: int = 5, high: int = 1000) -> DataFrame:
    """Counts within an abundance band, both ends included."""
    return counts.filter(F.col("cnt").between(low, high))


def matrix(counts: DataFrame, low: int | None = None, high: int | None = None, min_samples: int = 1) -> DataFrame:
    """The population matrix in tidy form: rows of k-mers that occur in at least min_samples samples.

    One aggregation a k-mer (samples and counts collected, as many as there are samples) instead of one join a sample.
    """
    c = counts.filter(F.col("cnt").between(low or 0, high if high is not None else (1 << 62)))
    wide = c.groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("sample", "cnt"))).alias("row"))
    wide = wide.withColumn("n_samples", F.size("row").cast("long")).filter(F.col("n_samples") >= min_samples)
    return wide.select("kmer", "n_samples", F.explode("row").alias("x")).select("kmer", "x.sample", "x.cnt", "n_samples")


def wide(tidy: DataFrame, samples: list[str], value: str = "cnt") -> DataFrame:
    """One column a sample, 0 where a k-mer doesn't occur."""
    return tidy.groupBy("kmer").pivot("sample", samples).agg(F.first(value)).fillna(0)


def filter_dosage(tidy: DataFrame, depth: DataFrame, n_samples: int, max_count: int = 1000, max_missing: float = 0.8, ploidy: int = 4) -> DataFrame:
    """Counts over max_count go, then k-mers missing in more than max_missing of the samples; dosage = least(ploidy, round(cnt * ploidy / depth))."""
    c = tidy.filter(F.col("cnt") <= max_count)
    have = Window.partitionBy("kmer")
    c = c.withColumn("present", F.count("*").over(have)).filter(1 - F.col("present") / F.lit(float(n_samples)) <= max_missing)
    few = depth.select("sample", "depth")
    c = c.join(F.broadcast(few) if few.count() <= SAMPLES else few, "sample")
    return c.select("kmer", "sample", "cnt", F.least(F.lit(float(ploidy)), F.round(F.col("cnt") * ploidy / F.col("depth"))).alias("dosage"))


def _filled(s: F.col, n: F.col) -> F.col:
    """An array of n values of a sorted array of (place, x), 0 where there is none; a place that comes twice raises."""
    last = lambda k: F.coalesce(F.get(s, k)["place"], F.lit(-1).cast("long"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))

    def part(e, i):
        gap = e["place"] - last(i - 1) - 1
        gap = F.when(gap < 0, F.raise_error(F.lit("a sample comes twice for a k-mer")).cast("long")).otherwise(gap)
        return F.concat(zeros(gap), F.array(F.coalesce(e["x"], F.lit(0.0))))

    return F.concat(F.flatten(F.transform(s, part)), zeros(n - 1 - last(F.size(s) - 1)))


def bimbam(dosage: DataFrame, samples: list[str] | DataFrame, allele1: str = "A", allele0: str = "T") -> DataFrame:
    """kmer, allele1, allele0, dosage: an array in the order of samples, 0 where there is none or it is null.

    samples: a list, or a table (sample, place from 0 without gaps). Other samples are left out; a sample that comes twice
    for a k-mer raises. Places are joined to the rows, and over BLOCK samples arrays are made by blocks, then put together,
    so that no task holds all rows of a k-mer one by one."""
    if not isinstance(samples, DataFrame):
        samples = dosage.sparkSession.createDataFrame(list(enumerate(samples)), "place long, sample string")
    n = samples.count()
    at = samples.select("sample", F.col("place").cast("long").alias("place"))
    rows = dosage.select("kmer", "sample", F.col("dosage").cast("double").alias("x")).join(F.broadcast(at) if n <= SAMPLES else at, "sample", "left")
    size = BLOCK if n > BLOCK else max(1, n)
    rows = rows.withColumn("block", F.floor(F.col("place") / size)).withColumn("place", F.col("place") % size)
    got = rows.groupBy("kmer", *["block"] * (n > BLOCK)).agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "x")))).alias("s"))
    if n > BLOCK:
        long = F.least(F.lit(BLOCK), n - F.col("block") * BLOCK)
        got = got.select("kmer", "block", F.when(F.col("block").isNotNull(), _filled(F.col("s"), long)).alias("part"))
        got = got.groupBy("kmer").agg(F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "part")))).alias("s"))
        last = lambda k: F.coalesce(F.get("s", k)["block"], F.lit(-1).cast("long"))
        zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
        whole = F.flatten(F.transform("s", lambda e, i: F.concat(zeros((e["block"] - last(i - 1) - 1) * BLOCK), e["part"])))
        row = F.concat(whole, zeros(n - F.least(F.lit(n).cast("long"), (last(F.size("s") - 1) + 1) * BLOCK)))
    else:
        row = _filled(F.col("s"), F.lit(n).cast("long"))
    return got.select("kmer", F.lit(allele1).alias("allele1"), F.lit(allele0).alias("allele0"), row.alias("dosage"))


def bimbam_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(", ", "kmer", "allele1", "allele0", F.array_join(F.transform("dosage", lambda x: x.cast("string")), ", ")).alias("value"))


def vcf_header(samples: list[str]) -> list[str]:
    """The lines before genotype lines."""
    return ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def vcf_lines(rows: DataFrame, ploidy: int = 2) -> DataFrame:
    """Genotype lines of dosages, the diploid call by thirds of the ploidy: 0/0, 0/1, 1/1; ./. for null."""
    call = F.transform("dosage", lambda d: F.when(d.isNull(), "./.").when(d < ploidy / 3, "0/0").when(d <= 2 * ploidy / 3, "0/1").otherwise("1/1"))
    return rows.select(F.concat_ws("\t", F.lit("0"), F.lit("0"), "kmer", "allele0", "allele1", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(call, "\t")).alias("value"))


def sketch(kmers: DataFrame, n: int, seed: int = 1, chunk: str | None = None) -> DataFrame:
    """n k-mers (of each chunk) with the smallest seeded hashes; the same on every run. Equal k-mers count each.

    Without chunks: a histogram of the hashes' first four digits tells the digits within which the n-th lies; all rows
    before are taken as they are, and only rows of those digits (one in 65536) are ranked."""
    key = F.md5(F.concat("kmer", F.lit(f":{seed}")))
    if chunk is not None:
        return kmers.withColumn("__rank", F.row_number().over(Window.partitionBy(chunk).orderBy(key, "kmer"))).filter(F.col("__rank") <= n).drop("__rank")
    rows = kmers.withColumn("__key", key).withColumn("__part", F.substring("__key", 1, 4))
    parts = rows.groupBy("__part").count().orderBy("__part").collect()  # 65536 rows at most
    upto = 0
    for r in parts:
        if upto + r["count"] > n:
            last = rows.filter(F.col("__part") == r["__part"]).orderBy("__key", "kmer").limit(n - upto)
            return rows.filter(F.col("__part") < r["__part"]).union(last).drop("__key", "__part")
        upto += r["count"]
    return rows.drop("__key", "__part")


def retrieve(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of listed k-mers."""
    return rows.join(keys.select("kmer").distinct(), "kmer", "left_semi")


def _few(listed: DataFrame) -> pa.Table | None:
    """A table of up to LISTED rows at the driver, computed once; else None."""
    got = listed.limit(LISTED + 1).toArrow()
    return got if got.num_rows <= LISTED else None


def _finder(code: np.ndarray, k: int):
    """A function of codes to their first places in a sorted array of codes, -1 for none."""
    if k <= DENSE:
        place = np.full(4**k, -1, np.int32)
        place[code[::-1]] = np.arange(len(code), dtype=np.int32)[::-1]
        return lambda c: place[c]
    if not len(code):
        return lambda c: np.full(len(c), -1)

    def find(c):
        p = np.minimum(np.searchsorted(code, c), len(code) - 1)
        return np.where(code[p] == c, p, -1)

    return find


def hits(reads: DataFrame, kmers: DataFrame, k: int, id_col: str = "read_id") -> DataFrame:
    """For each read with a listed k-mer (kmer, p), on either strand: id_col, p (the smallest) and n_kmers (different ones).

    Up to LISTED k-mers go to all tasks, and reads aren't shuffled but by what they have; more are joined. The list is computed once."""
    listed = kmers.groupBy(codec.canonical(codec.bases(F.col("kmer"))).alias("kmer")).agg(F.min("p").alias("p")).filter(F.length("kmer") == k)
    rows = reads.select(id_col, "seq")
    got = None
    if k <= rolling.LONGEST:
        got = _few(listed.select(codec.encode(F.col("kmer")).alias("code"), F.col("p").cast("double").alias("p")).filter("code is not null"))
    if got is None:
        found = read_kmers(rows, k, True, keep=[id_col]).join(listed, "kmer")
        return found.groupBy(id_col).agg(F.min("p").alias("p"), F.countDistinct("kmer").alias("n_kmers"))
    got = got.sort_by("code")
    held = reads.sparkSession.sparkContext.broadcast((got.column("code").to_numpy(), got.column("p").to_numpy()))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        code, p = held.value
        find = _finder(code, k)
        for b in batches:
            seqs = b.column(1).to_pylist()
            for lo, hi in rolling.steps(seqs):
                c, at = rolling.codes(seqs[lo:hi], k)
                place = find(c)
                hit = np.flatnonzero(place >= 0)
                if not len(hit):
                    continue
                at, place = np.divmod(np.unique(at[hit] * len(code) + place[hit]), len(code))
                read, first, n = np.unique(at, return_index=True, return_counts=True)
                least = np.fmin.reduceat(p[place], first)
                yield pa.record_batch([b.column(0).take(pa.array(read + lo)), pa.array(least, mask=np.isnan(least)), pa.array(n.astype(np.int64))], [id_col, "p", "n_kmers"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, p double, n_kmers long")


def fetch_reads(reads: DataFrame, kmers: DataFrame, k: int, id_col: str = "read_id") -> DataFrame:
    """Reads with a listed k-mer, and the smallest p of those they have. Ids must be unique; a read with a null id is left out."""
    return reads.join(hits(reads, kmers, k, id_col), id_col)


def add_pvalue(reads: DataFrame, kmers: DataFrame, k: int, id_col: str = "read_id") -> DataFrame:
    """All reads, with the smallest p of the listed k-mers that they have, or null."""
    return reads.join(hits(reads, kmers, k, id_col).select(id_col, "p"), id_col, "left")


def pair_name(name) -> F.col:
    """What both mates' names have in common: without /1 or /2."""
    return F.regexp_replace(name, "/[12]$", "")


def fetch_pairs(r1: DataFrame, r2: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Pairs of reads (name, comment, seq, qual), by name, of which one or both have a listed k-mer: pair, p and n_kmers, and a struct for each mate.

    n_kmers adds up both mates'. A read without a mate has none (null struct)."""
    def side(r):
        return r.withColumn("pair", pair_name(F.col("name")))

    a, b = side(r1), side(r2)
    found = hits(a.select("pair", "seq").union(b.select("pair", "seq")), kmers, k, "pair").groupBy("pair").agg(F.min("p").alias("p"), F.sum("n_kmers").alias("n_kmers"))
    mate = lambda r, x: r.select("pair", F.struct("name", "comment", "seq", "qual").alias(x))
    return found.join(mate(a, "r1"), "pair", "left").join(mate(b, "r2"), "pair", "left")


def traced(pairs: DataFrame, mate: str) -> DataFrame:
    """FASTQ records (name, seq, qual) of one mate, the p in the name line."""
    rows = pairs.filter(F.col(mate).isNotNull())
    return rows.select(F.concat_ws(" ", F.col(f"{mate}.name"), F.concat(F.lit("p="), F.col("p").cast("string")), F.col(f"{mate}.comment")).alias("name"), F.col(f"{mate}.seq").alias("seq"), F.col(f"{mate}.qual").alias("qual"))


def fetch_alignments(records: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Alignment records whose sequence has a listed k-mer on either strand; repeated names are told apart by their place."""
    rows = records.withColumn("__id", F.struct("qname", "flag", "chrom", "pos", "cigar", "seq"))
    return rows.join(hits(rows.select(F.to_json("__id").alias("__j"), "seq").distinct(), kmers, k, "__j"), F.to_json("__id") == F.col("__j"), "left_semi").drop("__id")


def tag_pvalue(records: DataFrame, kmers: DataFrame, k: int, tag: str = "XP") -> DataFrame:
    """All records; those with a listed k-mer get the smallest p as an auxiliary tag (type f), in place of one they have."""
    rows = records.withColumn("__j", F.to_json(F.struct("qname", "flag", "chrom", "pos", "cigar", "seq")))
    found = hits(rows.select("__j", "seq").distinct(), kmers, k, "__j").select("__j", "p")
    rows = rows.join(found, "__j", "left")
    return rows.withColumn("aux", F.when(F.col("p").isNull(), F.col("aux")).otherwise(align.with_tag(F.col("aux"), tag, "f", F.col("p").cast("string")))).drop("__j", "p")


def genome_hits(listed: DataFrame, genome: DataFrame, k: int) -> DataFrame:
    """Exact places of listed k-mers (kmer) in sequences (name, seq), on both strands: kmer, chrom, pos (0-based), strand.

    Each task has whole sequences; the places of a sequence come from arrays, not from windows as rows. Up to LISTED k-mers go
    to all tasks, and only their places leave these; for more, all places are joined with the list."""
    given = listed.select(codec.bases(F.col("kmer")).alias("kmer")).distinct().filter(F.length("kmer") == k).withColumn("canon", codec.canonical(F.col("kmer")))
    want = given.select("kmer", codec.encode(F.col("canon")).alias("code"), codec.encode(F.col("kmer")).alias("own_code")).filter("code is not null")
    few = _few(want)
    held = few and genome.sparkSession.sparkContext.broadcast(few.combine_chunks().sort_by("code"))

    def run(batches):
        if held:
            code, own_code = (held.value.column(c).to_numpy() for c in ("code", "own_code"))
            kmer = held.value.column("kmer").combine_chunks()
            find = _finder(code, k)
            same = np.diff(np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), len(code))) if len(code) else code
            many = np.repeat(same, same)  # of each code, how many k-mers have it: one or both strands
        for b in batches:
            names, seqs = b.column(0), b.column(1).to_pylist()
            for lo, hi in rolling.steps(seqs):
                c, own, at, pos = rolling.places(seqs[lo:hi], k)
                if not held:
                    yield pa.record_batch([names.take(pa.array(at + lo)), pa.array(pos), pa.array(c), pa.array(own)], ["chrom", "pos", "code", "own"])
                    continue
                place = find(c)
                hit = np.flatnonzero(place >= 0)
                if len(hit):
                    n = many[place[hit]]
                    first = np.repeat(place[hit], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    hit = np.repeat(hit, n)
                    yield pa.record_batch([kmer.take(pa.array(first)), names.take(pa.array(at[hit] + lo)), pa.array(pos[hit]), pa.array(np.where(own[hit] == own_code[first], "+", "-"))], ["kmer", "chrom", "pos", "strand"])

    rows = genome.select(F.col("name").cast("string").alias("name"), "seq")
    if held:
        return rows.mapInArrow(run, "kmer string, chrom string, pos long, strand string")
    places = rows.mapInArrow(run, "chrom string, pos long, code long, own long")
    return places.join(want, "code").select("kmer", "chrom", "pos", F.when(F.col("own") == F.col("own_code"), "+").otherwise("-").alias("strand"))
