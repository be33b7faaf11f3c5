"""Readers, scalars, filters, pileups, association and the workflow, on small written inputs."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ploidlens import sources
from ploidlens.functions import align, codec, logic, rolling, stats
from ploidlens.operators import alleles, gwas, intervals, kmers, mods
from ploidlens.plans import pipeline


def one(spark, col, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col).first()[0]


def col(spark, f, values, schema="x string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, {schema}")
    return [r[1] for r in df.select("k", f(F.col("x"))).orderBy("k").collect()]


# ---------------------------------------------------------------- reads


FASTQ = "@r1\tc one\nACGTN\n+\n@IIII\n@r2/2 2:Y:18:ACGT\nAC\n+r2\n+@\n@r3\n\n+\n\n"


def test_parse_reads():
    got = list(sources.parse_reads(FASTQ.split("\n")))
    assert got == [("r1", "c one", "ACGTN", "@IIII"), ("r2/2", "2:Y:18:ACGT", "AC", "+@"), ("r3", None, "", "")]
    assert list(sources.parse_reads([">a b", "AC", "GT", "", ">c", "T"])) == [("a", "b", "ACGT", None), ("c", None, "T", None)]
    for bad in (["@a", "ACGT", "+", "II"], ["@a", "AC", "+", "III", "@b", "A", "+", "I"]):
        with pytest.raises(ValueError):
            list(sources.parse_reads(bad))


@pytest.mark.parametrize("zipped", [False, True])
def test_fastq_is_split_within_a_file(spark, tmp_path, zipped):
    rng = np.random.default_rng(1)
    want = []
    for k in range(3000):
        n = int(rng.integers(1, 60))
        want.append((f"r{k}", None, "".join(rng.choice(list("ACGT"), n)), "".join(rng.choice(list("@+I>#"), n))))
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, _, s, q in want)
    path = f"{tmp_path}/s1_R1.fastq" + ".gz" * zipped
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = sources.fastq(spark, path)
        got = sorted((r.name, r.comment, r.seq, r.qual) for r in df.collect())
        assert sources.with_sample(df).select("sample").distinct().first()[0] == "s1"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(want)
    assert sorted((r.name, r.comment, r.seq, r.qual) for r in sources.reads(spark, path).collect()) == sorted(want)


def test_fasta_is_split_within_a_file(spark, tmp_path):
    want = [(f"s{k}", "a b" if k % 2 else None, "ACGTN" * (k % 7)) for k in range(400)]
    (tmp_path / "g.fa").write_text("".join(f">{n}{' ' + c if c else ''}\n" + "".join(f"{s[i : i + 9]}\n" for i in range(0, len(s), 9)) for n, c, s in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sources.fasta(spark, f"{tmp_path}/g.fa").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.name, r.comment or "", r.seq) for r in got) == sorted((n, c or "", s) for n, c, s in want)


def test_mates(spark):
    df = spark.createDataFrame([("a/1", None), ("b", "2:Y:0:ACGT"), ("c", "x")], "name string, comment string")
    assert [tuple(r)[2:] for r in sources.with_mate(df).collect()] == [(1, None, None), (2, True, "ACGT"), (None, None, None)]


def test_rolling_codes_equal_windows():
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACGTUNacgtx"), rng.integers(0, 40), p=[0.11] * 8 + [0.1, 0.01, 0.01])) for _ in range(60)] + [None, ""]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    num = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    for k in (1, 3, 7):
        for as_a in (False, True):
            want = []
            for j, s in enumerate(seqs):
                t = (s or "").upper().replace("U", "T")
                t = "".join(c if c in "ACGT" else "A" if as_a else "N" for c in t)
                want += [(min(num(w), num(rc(w))), j) for i in range(len(t) - k + 1) if "N" not in (w := t[i : i + k])]
            code, at = rolling.codes(seqs, k, True, as_a)
            assert list(zip(code.tolist(), at.tolist())) == want


def test_counts(spark):
    df = spark.createDataFrame([("s", "acgtN"), ("s", "AC"), (None, "ACGU"), ("t", None)], "sample string, seq string")
    got = sorted(((r.sample, r.kmer, r.cnt) for r in kmers.count(df, 4).collect()), key=repr)
    assert got == [("s", "ACGT", 1), (None, "ACGT", 1)] or got == sorted([("s", "ACGT", 1), (None, "ACGT", 1)], key=repr)
    long = spark.createDataFrame([("s", "A" * 40)], "sample string, seq string")
    assert [tuple(r) for r in kmers.count(long, 35).collect()] == [("s", "A" * 35, 6)] and [tuple(r) for r in kmers.count(long, 31).collect()] == [("s", "A" * 31, 10)]
    assert kmers.count(df.filter("false"), 4).count() == 0


def test_codec(spark):
    assert one(spark, codec.encode(F.col("x")), value="ACGT") == 27 and one(spark, codec.decode(F.lit(27), 5)) == "AACGT"
    assert one(spark, codec.reverse_complement(F.col("x")), value="ACGT") == "ACGT"

    def plain(x, bits):
        m = (1 << bits) - 1
        x = (~x + (x << 21)) & m
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & m
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & m
        x ^= x >> 28
        return (x + (x << 31)) & m

    values = [0, 1, 27, 12345678901, (1 << 42) - 1]
    assert col(spark, lambda x: codec.mixed_hash(x, 42), values, "x long") == [plain(v, 42) for v in values]


def test_sketch_takes_the_smallest_hashes(spark):
    names = [f"k{j}" for j in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "kmer string").repartition(5)
    import hashlib

    want = sorted(names, key=lambda n: hashlib.md5(f"{n}:1".encode()).hexdigest())
    for n in (0, 1, 777, 3000, 9000):
        assert sorted(r.kmer for r in kmers.sketch(df, n).collect()) == sorted(want[:n])


PAIRS = [("a", "ACGTACGTAA"), ("b", "TTTTTTTTTT"), ("c", "GGGGGGGGGG")]


def test_pairs_are_fetched_and_written(spark, tmp_path, monkeypatch):
    def side(m, seqs):
        return spark.createDataFrame([(f"{n}/{m}", None, s, "I" * len(s)) for n, s in seqs], "name string, comment string, seq string, qual string")

    r1, r2 = side(1, PAIRS), side(2, [("a", "CCCCCATCCC"), ("b", "AAAAATAAAA"), ("d", "AAAAATAAAA")])
    listed = spark.createDataFrame([("ACGTA", 0.01), ("ATTTT", 0.001), ("CCNCC", 1.0)], "kmer string, p double")
    want = [("a", 0.01, 1, "a/1", "a/2"), ("b", 0.001, 1, "b/1", "b/2"), ("d", 0.001, 1, None, "d/2")]
    for most in (kmers.LISTED, 0):
        monkeypatch.setattr(kmers, "LISTED", most)
        got = kmers.fetch_pairs(r1, r2, listed, 5).cache()
        assert sorted((r.pair, r.p, r.n_kmers, r.r1 and r.r1.name, r.r2 and r.r2.name) for r in got.collect()) == want
    sources.write_fastq(kmers.traced(got, "r2"), f"{tmp_path}/r2")
    assert sorted((r.name, r.comment) for r in sources.reads(spark, f"{tmp_path}/r2").collect()) == [("a/2", "p=0.01"), ("b/2", "p=0.001"), ("d/2", "p=0.001")]


def test_genome_hits(spark):
    g = spark.createDataFrame([("chr1", "ACGTTNACGTT"), ("chr2", "AACGT"), ("chr3", None)], "name string, seq string")
    listed = spark.createDataFrame([("ACGTT",), ("GGGGG",)], "kmer string")
    assert sorted(map(tuple, kmers.genome_hits(listed, g, 5).collect())) == [("ACGTT", "chr1", 0, "+"), ("ACGTT", "chr1", 6, "+"), ("ACGTT", "chr2", 0, "-")]


# ---------------------------------------------------------------- scalars


def test_regions_and_numbers(spark):
    big = 1 << 62
    forms = ["chr1", "chr1:", "chr1:5,100", "chr1:-300", "chr1:2500-3600", ".", "*", "{a:b}:2-3", "chr2:1k-1M"]
    got = [tuple(r) for r in col(spark, align.parse_region, forms)]
    assert got == [("chr1", 0, big), ("chr1", 0, big), ("chr1", 5099, big), ("chr1", 0, 300), ("chr1", 2499, 3600), (None, 0, big), ("*", 0, big), ("a:b", 1, 3), ("chr2", 999, 1_000_000)]
    assert tuple(col(spark, lambda x: align.parse_region(x, True), ["chr1:5100"])[0]) == ("chr1", 5099, 5100)
    assert col(spark, align.parse_number, ["1,234", "1.5k", "2e3", "-7", "3G", "x", None]) == [1234, 1500, 2000, -7, 3_000_000_000, None, None]


def test_flags(spark):
    assert col(spark, align.flag_value, ["PAIRED,UNMAP", "0x4", "010", "77", "read1", "NOPE"]) == [5, 4, 8, 77, 64, None]
    assert col(spark, align.flag_text, [0, 5, 4095], "x int") == ["", "PAIRED,UNMAP", ",".join(align.FLAGS)]
    for k, n in enumerate(align.FLAGS):
        assert col(spark, lambda x, n=n: align.has_flag(x, n), [1 << k, 4095 ^ 1 << k], "x int") == [True, False]


def test_cigar_and_end(spark):
    assert col(spark, align.query_length, ["10M2I5S", "*", "3H4M1D2=1X"]) == [17, 0, 7] and col(spark, align.reference_length, ["10M2I5S", "*", "3H4M1D2=1X"]) == [10, 0, 8]
    ends = spark.createDataFrame([(5, 0, "10M"), (5, 4, "10M"), (5, 0, "*")], "p long, f int, c string").select(align.end_position(F.col("p"), F.col("f"), F.col("c"))).collect()
    assert [r[0] for r in ends] == [15, 6, 6]


def test_tags(spark):
    aux = lambda f: one(spark, f(align.aux_tags(F.split("x", "\t"))), value="NM:i:3\tXA:Z:a:b\tNM:i:4\tbad\tXB:B:c,1,-2")
    assert aux(lambda a: align.tag_number(a, "NM")) == 3.0 and aux(lambda a: align.tag_value(a, "XA")) == "a:b" and aux(lambda a: align.tag_number(a, "XA")) is None
    assert aux(lambda a: align.tag_array(a, "XB")) == [1.0, -2.0] and aux(lambda a: align.tag_value(align.with_tag(a, "NM", "i", F.lit(9)), "NM")) == "9"
    assert aux(lambda a: F.map_contains_key(align.without_tag(a, "NM"), "NM")) is False


def test_bins_bits_and_bases(spark):
    assert col(spark, lambda x: align.bin_number(x, x + 1), [0, 1 << 14, (1 << 29) - 1], "x long") == [4681, 4682, 37448]
    assert col(spark, align.bin_level, [0, 1, 9, 73, 585, 4681], "x long") == [0, 1, 2, 3, 4, 5] and col(spark, align.bin_parent, [0, 8, 4681], "x long") == [None, 0, 585] and align.bin_end() == 1 << 29
    assert col(spark, align.power_of_two, [1, 2, 3, 1025], "x long") == [1, 2, 4, 2048]
    assert col(spark, align.nt16_code, list("ACGTNRu=")) == [1, 2, 4, 8, 15, 5, 8, 0] and col(spark, align.nt16_letter, [1, 8, 15], "x int") == ["A", "T", "N"] and col(spark, align.nt16_int, [1, 8, 5], "x int") == [0, 3, 4]
    assert col(spark, lambda x: align.with_base(x, F.lit(1), F.lit("N")), ["ACGT"]) == ["ANGT"] and col(spark, lambda x: align.base_at(x, F.lit(3)), ["ACGT"]) == ["T"]
    x = 0
    for c in "chr10_some_long_name":
        x = (x * 31 + ord(c)) % (1 << 32)
    assert col(spark, align.x31_hash, ["chr10_some_long_name", ""]) == [x, 0]


def area(a, b, x, n=200_000):
    """The incomplete beta function as a sum of strips (b > 0, x < 1)."""
    t = (np.arange(n) + 0.5) * x / n
    return float((t ** (a - 1) * (1 - t) ** (b - 1)).sum() * x / n / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))


def test_special_functions():
    assert np.allclose([stats.gamma_p(a, x) + stats.gamma_q(a, x) for a, x in ((0.5, 0.2), (3, 9), (10, 4))], 1)
    assert math.isclose(stats.gamma_p(1, 2), 1 - math.exp(-2), rel_tol=1e-12) and math.isclose(stats.gamma_q(0.5, 1.0), math.erfc(1), rel_tol=1e-12)
    assert np.allclose(stats.beta_i([2, 1, 5], [3, 1, 0.5], [0.4, 0.3, 0.9]), [0.5248, 0.3, area(5, 0.5, 0.9)], atol=1e-6) and np.allclose(stats.f_sf(np.array([4.9646]), 1, np.array([10.0])), 0.05, atol=1e-5)
    left, right, two = stats.fisher(3, 1, 1, 3)
    assert np.allclose([left, right, two], [69 / 70, 17 / 70, 34 / 70])


# ---------------------------------------------------------------- filters


def test_three_states(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (1, nan), (2, None)], "k int, x double")
    got = df.select("k", logic.compare(F.col("x"), ">", F.lit(0.0)), logic.compare(F.col("x"), "!=", F.lit(0.0)), logic.negate(logic.compare(F.col("x"), ">", F.lit(0.0))), logic.either(F.col("x") > 50, F.lit(1))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(True, True, False, True), (False, False, True, True), (False, False, True, True)]


SAM = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:1000", "@CO\tfree: text", "r1\t99\tchr1\t11\t60\t5M2I3M1D2M\t=\t51\t50\tACGTACGTACGT\tIIIIIIIIIIII\tNM:i:3\tXA:Z:b", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGTA\tIIIII", "r1\t147\tchr1\t14\t7\t6M\t=\t11\t-50\tACGTAC\t######"]


def sam(spark):
    return sources.sam(spark.createDataFrame([(x,) for x in SAM], "value string"))


@pytest.mark.parametrize("text,names", [
    ("mapq >= 30", "r1"), ("!(mapq >= 30)", "r1r2"), ("flag.unmap || [NM] == 3", "r1r2"), ("exists([NM]) && [XA] == \"b\"", "r1"), ("[NM] < 5", "r1"), ("!([NM] < 5)", "r1r2"), ("rname =~ \"^chr\" && qlen > 6", "r1"),
    ("pos + 3 * 2 - 1 == 16 && (flag & 64) != 0", "r1"), ("length(seq) == 5", "r2"), ("default([NM], 9) == 9", "r1r2"), ("mapq / 0 > 1", ""), ("1", "r1r1r2"), ("0 || \"\"", ""), ("qname !~ \"1\"", "r2"), ("-pos < 0 && mapq % 2 == 1", "r1"),
])
def test_filter_expressions(spark, text, names):
    assert "".join(sorted(r.qname for r in sam(spark).filter(logic.record_filter(text)).collect())) == names


def test_malformed_expressions():
    for text in ("", "mapq >", "(mapq", "mapq 3", "nope == 1", "foo(1)", "mapq ? 1"):
        with pytest.raises(ValueError):
            logic.record_filter(text)


# ---------------------------------------------------------------- alignments


def test_sam_round_trip_and_header(spark):
    lines = spark.createDataFrame([(x,) for x in SAM], "value string")
    assert sorted(r.value for r in sources.sam_lines(sam(spark)).collect()) == sorted(SAM[3:])
    h = sources.header(lines)
    assert sorted(r.value for r in sources.header_lines(h).collect()) == sorted(SAM[:3])
    assert sources.header_find(h, "SQ", "SN", "chr1").count() == 1 and sources.header_remove(h, "SQ", "SN", "chr1").count() == 2 and sources.header_remove(h, "CO").count() == 2
    up = sources.header_update(h, "SQ", "SN", "chr1", LN="7", M5="x").filter("type = 'SQ'").first().tags
    assert up == {"SN": "chr1", "LN": "7", "M5": "x"}


def test_alignments_with_kmers(spark):
    listed = spark.createDataFrame([("GTACGTA", 0.25)], "kmer string, p double")
    assert [r.pos for r in kmers.fetch_alignments(sam(spark), listed, 7).collect()] == [10]
    got = {(r.qname, r.flag): r.value for r in kmers.tag_pvalue(sam(spark), listed, 7).select("qname", "flag", align.tag_value(F.col("aux"), "XP").alias("value")).collect()}
    assert got == {("r1", 99): "0.25", ("r1", 147): None, ("r2", 4): None}


def test_region_fetch_and_counts(spark):
    s = sam(spark)
    names = lambda r: sorted(x.flag for x in intervals.fetch_region(s, r).collect())
    assert names("chr1:1-12") == [99] and names("chr1:20-") == [99] and names("chr1:14-19") == [99, 147]
    assert names(".") == [4, 99, 147] and names("*") == [4] and names("chr1:22") == [] and names("chr2") == []
    assert sorted(map(tuple, intervals.mapping_counts(s).collect())) == [("*", 0, 1), ("chr1", 2, 0)]


def test_pileup_and_insertions(spark):
    b = intervals.aligned_bases(sam(spark))
    got = {(r.pos): (r.depth, r.n_del) for r in intervals.pileup(b).collect()}
    assert got == {p: (1, 0) for p in (10, 11, 12, 19, 20)} | {p: (2, 0) for p in (13, 14, 15, 16, 17)} | {18: (1, 1)}
    assert [tuple(r) for r in intervals.inserted(sam(spark)).collect()] == [("chr1", 14, "r1", "CG")]
    q = {(r.pos, r.base, r.q) for r in intervals.overlap_qualities(b).filter("pos in (13, 18)").collect()}
    assert q == {(13, "T", 32), (13, "A", 0), (18, "", 0), (18, "C", 2)} or {x for x in q if x[0] == 13} == {(13, "T", 32), (13, "A", 0)}


def tail(n, k, e):
    return math.fsum(math.comb(n, i) * e**i * (1 - e) ** (n - i) for i in range(k, n + 1))


def by_base(bases):
    """Likelihoods of genotypes, base by base, with sums of plain binomial terms."""
    n, out = len(bases), {}
    for g in alleles.PAIRS:
        cost, seen, strand = 0.0, {}, {}
        for b, s, q in sorted(bases, key=lambda x: (-x[2], x[0], x[1])):
            k, w = seen.get(b, 0), strand.get((b, s), 0)
            if b not in g:
                e = 10 ** (-q / 10)
                cost -= 10 * math.log10(tail(n, k + 1, e) / tail(n, k, e)) * (0.83**w * 0.97 + 0.03)
            seen[b], strand[b, s] = k + 1, w + 1
        i, j = seen.get(g[0], 0), seen.get(g[1], 0)
        out[g] = cost if g[0] == g[1] else cost - 10 * math.log10(math.comb(i + j, j) / 2 ** (i + j))
    return out


def test_allele_likelihoods(spark):
    r = np.random.default_rng(5)
    at = {p: [(str(r.choice(list("ACGT"), p=[0.6, 0.3, 0.05, 0.05])), bool(r.integers(2)), int(r.integers(4, 42))) for _ in range(n)] for p, n in enumerate((1, 2, 9, 30))}
    rows = [("c", p, b, s, q, False, False) for p, x in at.items() for b, s, q in x]
    rows += [("c", 0, "", False, None, True, False), ("c", 0, "N", False, 30, False, False), ("c", 9, "A", False, None, False, False)]
    df = spark.createDataFrame(rows, "chrom string, pos long, base string, reverse boolean, q int, is_del boolean, is_refskip boolean")
    got = {(x.pos, x.genotype): (x.depth, x.likelihood) for x in alleles.allele_likelihoods(df).collect()}
    want = {(p, g): (len(x), v) for p, x in at.items() for g, v in by_base(x).items()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert alleles.allele_likelihoods(df.limit(0)).count() == 0
    deep = alleles.likelihoods(np.array([0, 1]), np.array([0, 0]), np.array([40, 40]), np.array([30000, 30000]))
    assert np.isfinite(deep).all() and alleles.PAIRS[int(deep.argmin())] == "AC"
    assert alleles.allele_likelihoods(intervals.aligned_bases(sam(spark))).filter("likelihood < 0").count() == 0


def walked(seq, reverse, mm, ml):
    """Modifications by walking over the sequence base by base, for each group."""
    out, at = [], 0
    pair = dict(zip("ACGTN", "TGCAN"))
    for part in mm.split(";")[:-1]:
        head, *skips = part.split(",")
        codes, skips = head[2:].rstrip(".?"), list(map(int, skips))
        for i in range(len(seq)):
            q = len(seq) - 1 - i if reverse else i
            b = pair[seq[q]] if reverse else seq[q]
            if skips and head[0] in (b, "N"):
                if skips[0] == 0:
                    for c in [codes] if codes.isdigit() else codes:
                        out.append((q, head[0], head[1], c, ml[at], not head.endswith("?")))
                        at += 1
                    skips.pop(0)
                else:
                    skips[0] -= 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_modifications_equal_a_walk(seed):
    r = np.random.default_rng(seed)
    seq = "".join(r.choice(list("ACGTN"), 300))
    mm, n = "", 0
    for kind in ("C+m", "C+mh?", "A-a.", "N+27551", "G-76792?"):
        skips = r.integers(0, 4, 8)
        mm += ",".join([kind, *map(str, skips)]) + ";"
        n += 16 if "mh" in kind else 8
    ml = r.integers(0, 256, n).tolist()
    for reverse in (False, True):
        assert mods.modified(seq, reverse, mm, ml) == walked(seq, reverse, mm, ml)


def test_modifications(spark):
    def rows(unchecked=False, flag=0, seq="ACCGC", **tags):
        aux = {k: (("B" if k.upper() == "ML" else "i" if k == "MN" else "Z"), v) for k, v in tags.items()}
        df = spark.createDataFrame([("r", flag, seq, aux)], "qname string, flag int, seq string, aux map<string,struct<type:string,value:string>>")
        return [tuple(r)[2:] for r in mods.base_modifications(df, unchecked).orderBy("qpos", "code").collect()], [tuple(r)[2:] for r in mods.modification_kinds(df).collect()]

    assert rows(MM="C+m?,1;", ML="C,9") == ([(2, "C", "+", "m", 9, False)], [("C", "+", ["m"], False)])
    assert rows(True, MM="C+m?,1;")[0] == [(1, "C", "+", "m", mods.UNCHECKED, False), (2, "C", "+", "m", mods.UNKNOWN, False), (4, "C", "+", "m", mods.UNCHECKED, False)]
    assert rows(Mm="C+mh.,0;", Ml="C,1,2")[0] == [(1, "C", "+", "h", 2, True), (1, "C", "+", "m", 1, True)] and rows(flag=16, MM="G-m,0;", MN="5")[0] == [(4, "G", "-", "m", mods.UNKNOWN, True)]
    assert rows(MM="C+m;") == ([], [("C", "+", ["m"], True)])
    for bad in ({"MM": "C+m,3;"}, {"MM": "C*m,0;"}, {"MM": "C+m,0;", "ML": "C,1,2"}, {"MM": "C+m,0,0;", "ML": "C,1"}, {"MM": "C+m,0;", "MN": "9"}, {"MM": ""}, {}):
        assert rows(**bad)[0] == []
    assert rows(seq=None, MM="C+m,0;") == rows(seq="*", MM="C+m,0;") == ([], [])


def test_positioned_lines_and_sorted_tables(spark, tmp_path):
    def rows(preset, *lines):
        return [tuple(r)[:3] for r in sources.positioned(spark.createDataFrame([(x,) for x in lines], "value string"), preset).collect()]

    assert rows("gff", "#x", "c\ts\tgene\t5\t9\t.", "c", "", "c\ts\tgene\tx\t9") == [("c", 4, 9)] and rows("bed", "c\t5\t9", "c\t5\t9") == [("c", 5, 9)] * 2
    assert rows("sam", "@SQ\tSN:c", "r\t0\tc\t11\t60\t5M2D3M\t*\t0\t0\tA\tI", "r\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI") == [("c", 10, 20)]
    assert rows("vcf", "c\t5\t.\tACG\tA\t.\t.\tDP=1", "c\t5\t.\tN\t<DEL>\t.\t.\tDP=1;END=90") == [("c", 4, 7), ("c", 4, 90)]
    assert rows((2, 1, 0, True, "!"), "!7\tc", "7\tc") == [("c", 7, 8)] and rows("psltbl", "\t".join(["0"] * 14 + ["c", "99", "3", "8"])) == [("c", 3, 8)]
    with pytest.raises(ValueError):
        rows("other", "x")
    df = spark.range(1000).selectExpr("concat('c', id % 3) AS chrom", "(id * 37) % 1000 AS beg", "(id * 37) % 1000 + 5 AS end")
    sources.write_sorted(df, str(tmp_path / "t"), 4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert intervals.fetch_region(back, "c1:101-200", "beg", "end").count() == df.filter("chrom = 'c1' and beg < 200 and end > 100").count() > 0
    per = back.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min(F.struct("chrom", "beg")).alias("lo"), F.max(F.struct("chrom", "beg")).alias("hi")).orderBy("lo").collect()
    assert len(per) == 4 and all(a.hi <= b.lo for a, b in zip(per, per[1:]))


def test_region_files(spark):
    def rows(form, *lines):
        return sorted(map(tuple, sources.regions(spark.createDataFrame([(x,) for x in lines], "value string"), form).collect()))

    assert rows("bed", "track name=x", "browser position", "#c", "chr1\t5\t9", "tracker\t1\t2") == [("chr1", 5, 9), ("tracker", 1, 2)]
    assert rows("tab", "chr1\t5\t9", "chr2\t7") == [("chr1", 4, 9), ("chr2", 6, 7)] and rows("vcf", "chr1\t5\t.\tACG\tA") == [("chr1", 4, 7)] and rows("reg", "chr1:5100") == [("chr1", 5099, 5100)]


def test_sequences_at_regions(spark):
    s = spark.createDataFrame([("c", "ACGTACGT")], "name string, seq string")
    r = spark.createDataFrame([("c", 2, 5), ("c", -4, 3), ("c", 6, 99), ("c", 50, 60), ("d", 0, 1)], "chrom string, beg long, end long")
    assert sorted(map(tuple, intervals.fetch_sequences(s, r).collect())) == [("c", 0, 3, "ACG"), ("c", 2, 5, "GTA"), ("c", 6, 8, "GT"), ("c", 8, 8, "")]


def test_overlap_keeps_columns(spark):
    a = spark.createDataFrame([("c", 0, 10, 1, 1), ("c", 20, 30, 2, 2), (None, 0, 5, 3, 3), ("c", 0, 10, 1, 4)], "chrom string, beg long, end long, bin int, k int")
    b = spark.createDataFrame([("c", 5, 25)], "chrom string, beg long, end long")
    assert sorted((r.bin, r.k, r.b_beg) for r in intervals.overlap(a, b, width=4).collect()) == [(1, 1, 5), (1, 4, 5), (2, 2, 5)]
    assert sorted(r.k for r in intervals.overlap(a, b, "left_anti", 4).collect()) == [3] and sorted(r.k for r in intervals.overlap(a, b, "left_semi", 4).collect()) == [1, 2, 4]
    t = spark.createDataFrame([("c", 3, 3, 8, 3, 4), ("c", 6, 6, 7, 6, 7)], "chrom string, pos long, beg long, end long, vbeg long, vend long")
    assert [sorted(r.pos for r in intervals.targets(t, b, m).collect()) for m in (0, 1, 2)] == [[6], [3, 6], [6]] and [r.pos for r in intervals.targets(t, b, 0, True).collect()] == [3]


VCF = [["c\t1\t.\tA\tT\t.\tPASS", "c\t2\t.\tA\tAT\t.\tPASS", "c\t3\t.\tA\tT,C\t.\tq10", "c\t4\t.\tA\t.\t.\tPASS"], ["c\t1\t.\tA\tC\t.\tPASS", "c\t2\t.\tA\tG\t.\tPASS", "c\t3\t.\tA\tC\t.\tPASS", "c\t4\t.\tA\tG\t.\tPASS"]]


@pytest.mark.parametrize("mode,want", [("any", [2, 2, 2, 2]), ("exact", [1, 1, 1, 1]), ("some", [1, 1, 2, 1]), ("snps", [2, 1, 2, 1]), ("indels", [0, 1, 0, 0]), ("both", [2, 1, 2, 1]), ("snp_ref", [2, 1, 2, 2]), ("indel_ref", [0, 1, 0, 1]), ("both_ref", [2, 1, 2, 2])])
def test_variant_pairings(spark, mode, want):
    tables = [sources.vcf(spark.createDataFrame([(x,) for x in v], "value string")) for v in VCF]
    got = {p: 0 for p in range(4)}
    for r in intervals.sync_variants(tables, mode).collect():
        got[r.pos] = max(got[r.pos], r.n_readers)
    assert [got[p] for p in range(4)] == want
    assert intervals.passes_filter(tables[0], ["q10"]).count() == 1


def test_sample_subsets():
    t = [["a", "b", "c"], ["c", "a"]]
    assert intervals.sample_subset(t, "-") == ["a", "c"] and intervals.sample_subset(t, "c,a") == ["a", "c"] and intervals.sample_subset(t, "!b") == ["a", "c"] and intervals.sample_subset(t, "!", ["a"]) == ["b", "c"]


def test_names_sets_and_order(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in ("b", "a", None, "c", "a")], "x string")
    assert sorted(map(tuple, intervals.name_ids(df, "x").collect())) == [("a", 0), ("b", 1), ("c", 2)]
    n = spark.createDataFrame([(x,) for x in (5, 1, 1, 9, None)], "x int")
    assert [[r.x for r in intervals.kth_smallest(n, "x", k).collect()] for k in (1, 2, 3, 4, 5)] == [[1], [1], [5], [9], []]
    b = intervals.bit_sets(spark.createDataFrame([("k", 0), ("k", 63), ("k", 200), ("k", 200), ("k", -1)], "k string, m int"), "k", "m")
    assert b.select(intervals.bit_size(F.col("bits")), *[intervals.has_bit(F.col("bits"), F.lit(m)) for m in (0, 1, 63, 200, 999)]).first() == (3, True, False, True, True, False)
    (tmp_path / "list").write_text("s3\ns1\n\ns3\ns2\n")
    assert [r.sample for r in sources.sample_list(spark, f"{tmp_path}/list").collect()] == ["s3", "s1", "s2"]


# ---------------------------------------------------------------- association


def test_thresholds_and_adjusted(spark):
    p = [0.001, 0.002, 0.002, 0.03, 0.04, 0.5, 0.9, 1.0, 0.0, None, float("nan"), 1.5]
    df = spark.createDataFrame([(x,) for x in p], "p_wald double")
    ok = sorted(x for x in p if x and 0 < x <= 1)
    n, rank = len(ok), [sum(y <= x for y in ok) for x in ok]
    best = max(x for x, r in zip(ok, rank) if x * n / r < 0.05)
    r = gwas.thresholds(df).first()
    assert (r.n, round(r.bh_cutoff, 9), round(r.bf_cutoff, 9)) == (n, round(-math.log10(best), 9), round(-math.log10(0.05 / n), 9))
    want = {x: min(1, min(y * n / s for y, s in zip(ok, rank) if y >= x)) for x in ok}
    got = gwas.adjusted(df).collect()
    assert len(got) == len(p) and all(math.isclose(r.p_adjusted, want[r.p_wald]) if r.p_wald in want else r.p_adjusted is None for r in got)
    assert tuple(gwas.thresholds(df.filter("p_wald > 0.4")).first())[:2] == (3, None) and tuple(gwas.thresholds(df.filter("false")).first()) == (0, None, None)


def test_significant_and_plot(spark, tmp_path):
    df = spark.createDataFrame([("AA", 0.01), ("CC", 0.001), ("GG", 0.01), ("TT", 0.5)], "rs string, p_wald double")
    assert sorted(map(tuple, gwas.significant_fasta(df, 0.05).collect())) == [(">asso_kmer0_0.001", "CC"), (">asso_kmer1_0.01", "AA"), (">asso_kmer2_0.01", "GG")]
    hits = spark.createDataFrame([("asso_kmer0_1e-5", "chr_2", "30"), ("asso_kmer1_0.5", "chr_2", "4")], "qseqid string, sseqid string, sstart string")
    assert [tuple(r) for r in gwas.plot_table(hits).collect()] == [("asso_kmer1", "chr_2", 4, 0.5), ("asso_kmer0", "chr_2", 30, 1e-5)]
    first = gwas.first_hits(spark.createDataFrame([("q", "tig1", 1), ("q", "chr1", 2), ("q", "chr2", 3)], "q string, s string, n int"), "q", ["n"], "s").collect()
    assert [r.s for r in first] == ["chr1"]
    gwas.write_thresholds(gwas.thresholds(df), f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).columns == ["n", "bh_cutoff", "bf_cutoff"]


def test_lmm_finds_the_optimum(spark):
    rng = np.random.default_rng(5)
    n, m = 40, 30
    g = rng.integers(0, 5, (m, n)).astype(float)
    k = np.cov(g.T) / 2 + np.eye(n) * 0.1
    y = g[0] * 0.7 + rng.multivariate_normal(np.zeros(n), k) + rng.normal(size=n)
    y[3] = np.nan
    rows = [(f"k{j:02d}", "A", "T", [None if (j, i) == (2, 5) else float(v) for i, v in enumerate(x)]) for j, x in enumerate(g)] + [("flat", "A", "T", [1.0] * n)]
    w = np.column_stack([np.ones(n), rng.normal(size=n)])
    got = {r.rs: r for r in gwas.lmm(spark.createDataFrame(rows, "kmer string, allele1 string, allele0 string, dosage array<double>").repartition(3), y, w, k).collect()}
    ok = ~np.isnan(y)
    k2, y2, w2 = k[np.ix_(ok, ok)], y[ok], w[ok]

    def plain(x, lam):
        v = lam * k2 + np.eye(len(y2))
        z = np.column_stack([w2, x])
        vi = np.linalg.inv(v)
        a = z.T @ vi @ z
        b = np.linalg.solve(a, z.T @ vi @ y2)
        e = y2 - z @ b
        df = len(y2) - z.shape[1]
        rss = e @ vi @ e
        return -0.5 * (df * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), b[-1], np.sqrt(rss / df * np.linalg.inv(a)[-1, -1])

    for j in (0, 1, 7, 29):
        x, r = g[j][ok], got[f"k{j:02d}"]
        grid = max((plain(x, lam)[0], lam) for lam in [0.0, *np.exp(np.linspace(-11.5, 11.5, 2000))])
        assert plain(x, r.l_remle)[0] >= grid[0] - 1e-6
        _, beta, se = plain(x, r.l_remle)
        assert math.isclose(r.beta, beta, rel_tol=1e-6) and math.isclose(r.se, se, rel_tol=1e-6) and math.isclose(r.af, x.mean() / 4)
        assert math.isclose(r.p_wald, stats.f_sf(np.array([(beta / se) ** 2]), 1, np.array([36.0]))[0], rel_tol=1e-6)
    assert got["k02"].n_miss == 1 and got["flat"].p_wald is None or math.isnan(got["flat"].p_wald)


def test_workflow(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("ACGT"), 200)) for _ in range(3)]
    reads = [(f"s{j}", base[i][: 80 + 15 * (j % 8)]) for j in range(12) for i in range(3) for _ in range(6)]
    df = spark.createDataFrame(reads, "sample string, seq string").repartition(4)
    depth = spark.createDataFrame([(f"s{j}", 6.0) for j in range(12)], "sample string, depth double")
    config = pipeline.Config(k=15, low=2, max_missing=0.9, sketch=100, components=1)
    made = pipeline.workflow(spark, df, depth, f"{tmp_path}/run", config=config)
    assert list(made) == ["count", "matrix", "filter", "convert"]
    pheno = spark.createDataFrame([(f"s{j}", float(j % 8) if j != 4 else None) for j in range(12)], "sample string, trait double")
    made = pipeline.workflow(spark, df, depth, f"{tmp_path}/run", pheno, config=config)
    p = [r.p_wald for r in made["asso"].collect()]
    assert made["asso"].count() == made["convert"].count() > 100 and all(0 <= x <= 1 for x in p if x is not None and x == x) and any(x is not None and x == x for x in p)
    assert pipeline.step("b2g") and kmers.vcf_header(["a"])[-1].endswith("FORMAT\ta")
    with pytest.raises(ValueError):
        pipeline.step("nope")


@pytest.mark.parametrize("block", [2, 4096])
def test_bimbam_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(kmers, "BLOCK", block)
    df = spark.createDataFrame([("k", "s6", 6.0), ("k", "s0", 1.0), ("k", "s3", None), ("k", "x", 9.0), ("l", "s4", 4.0), ("m", "x", 1.0)], "kmer string, sample string, dosage double")
    want = {"k": [1.0, 0, 0, 0, 0, 0, 6, 0, 0], "l": [0.0] * 4 + [4] + [0] * 4, "m": [0.0] * 9}
    names = [f"s{k}" for k in range(9)]
    at = spark.createDataFrame(list(enumerate(names)), "place long, sample string")
    for samples in (names, at):
        assert {r.kmer: r.dosage for r in kmers.bimbam(df, samples).collect()} == want
    with pytest.raises(Exception, match="comes twice"):
        kmers.bimbam(df.union(df), names).collect()


def test_bimbam_plan_has_no_sample(spark):
    plan = lambda n: len(kmers.bimbam(spark.createDataFrame([("k", "s1", 1.0)], "kmer string, sample string, dosage double"), [f"s{k}" for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert plan(3000) < 2 * plan(30)


@pytest.mark.parametrize("most", [2, 65_536])
def test_kinship_by_tiles(spark, monkeypatch, most):
    monkeypatch.setattr(gwas, "MARKERS", most)
    n = gwas.TILE + 30
    g = np.random.default_rng(4).integers(0, 5, (5, n)).astype(float)
    c = g - g.mean(1, keepdims=True)
    want = c.T @ c / 5
    rows = spark.createDataFrame([(x.tolist(),) for x in g], "dosage array<double>")
    assert np.allclose(gwas.kinship(rows, n), want)
    cells = gwas.kinship_cells(rows, [3 * k + 1 for k in range(n)]).toPandas()
    k = np.full((n, n), np.nan)
    k[cells.i // 3, cells.j // 3] = cells.k
    assert len(cells) == n * n and np.allclose(k, want)


@pytest.mark.parametrize("gone", [0, 2])
def test_lmm_of_few_equals_lmm(spark, gone):
    rng = np.random.default_rng(8)
    n = 70
    g = rng.integers(0, 5, (9, n)).astype(float)
    g[5], g[6] = 2.0, g[1]
    y = g[0] * 0.4 + g[2:5].sum(0) * 0.3 + rng.normal(size=n)
    y[:gone] = np.nan
    rows = spark.createDataFrame([(f"k{j}", "A", "T", x.tolist()) for j, x in enumerate(g)], "kmer string, allele1 string, allele0 string, dosage array<double>")
    k = gwas.kinship(rows, n)
    want = {r.rs: r for r in gwas.lmm(rows, y, gwas.principal_components(k), k).collect()}
    each = spark.createDataFrame([(float(t), x.tolist()) for t, x in zip(y, g.T)], "trait double, dosage array<double>").repartition(3)
    got = {r.rs: r for r in gwas.lmm_of_few(each, [f"k{j}" for j in range(9)]).collect()}
    assert got.keys() == want.keys() and got["k5"].beta is None and want["k5"].beta is None
    for rs, r in want.items():
        for c in ("n_miss", "af") if rs == "k5" else ("n_miss", "af", "beta", "se", "logl_H1", "p_wald"):
            assert math.isclose(got[rs][c], r[c], rel_tol=1e-5, abs_tol=1e-9), (rs, c, got[rs][c], r[c])


def test_overlap_of_repeated_coordinates(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(None if x == 9 else f"c{x % 2}", int(b), int(b + w), k) for k, (x, b, w) in enumerate(zip(rng.integers(0, 10, n), rng.integers(0, 12, n), rng.integers(0, 4, n)))]
    x, y = make(900), make(700)
    a, b = (spark.createDataFrame(v, "chrom string, beg long, end long, bin long") for v in (x, y))
    assert intervals._repeats(a, b) and not intervals._repeats(a.limit(1), b.limit(1)) and not intervals._repeats(a.limit(0), b)
    got = intervals.overlap(a, b, width=4)
    assert got.columns == ["chrom", "beg", "end", "bin", "b_chrom", "b_beg", "b_end", "b_bin"]
    want = sorted((*p, *q) for p in x for q in y if p[0] and p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 2 and plan.count("Aggregate [") == 2  # different coordinates only


@pytest.mark.parametrize("k", [5, 13])
@pytest.mark.parametrize("most", [0, 100])
def test_genome_hits_leave_tasks_alone(spark, monkeypatch, most, k):
    monkeypatch.setattr(kmers, "LISTED", most)
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 400), p=[0.24] * 4 + [0.04])) for _ in range(40)] + [None, "ACG"]
    pick = [s[i : i + k] for s in seqs[:30] if s and len(s) > 60 for i in (3, 40) if "N" not in s[i : i + k]]
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    listed = sorted({*pick[:20], *map(back, pick[:5]), pick[0] + "A", "N" * k})
    got = kmers.genome_hits(spark.createDataFrame([(x,) for x in listed], "kmer string"), spark.createDataFrame([(f"c{j}", s) for j, s in enumerate(seqs)], "name string, seq string").repartition(3), k)
    want = []
    for j, s in enumerate(seqs):
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            want += [(x, f"c{j}", i, "+" if x == w else "-") for x in listed if len(x) == k and "N" not in w and x in (w, back(w))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)


def test_listed_kmers_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows():
        return spark.createDataFrame(spark.sparkContext.parallelize([("ACGTA", 0.5), ("CCCCC", 0.1)]).map(lambda x: (seen.add(1), x)[1]), "kmer string, p double")

    reads = lambda m: spark.createDataFrame([(f"a/{m}", None, "ACGTA" * m, None), (f"b/{m}", None, "TTTTT", None)], "name string, comment string, seq string, qual string")
    assert [(r.pair, r.p, r.n_kmers, r.r1.seq, r.r2.name) for r in kmers.fetch_pairs(reads(1), reads(2), rows(), 5).collect()] == [("a", 0.5, 2, "ACGTA", "a/2")]
    assert seen.value == 2


def test_in_reads_counts_reads(spark, monkeypatch):
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("ACGT"), rng.integers(0, 60))) for _ in range(70)] * 2 + [None]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(2)
    for k in (2, 11, 12, 28):
        monkeypatch.setattr(kmers, "HELD", 3 if k == 12 else 2_000_000)
        want = {}
        for s in seqs:
            for w in {min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in ((s or "")[i : i + k] for i in range(len(s or "") - k + 1))}:
                want[w] = want.get(w, 0) + 1
        assert {r.kmer: r.n_reads for r in kmers.in_reads(df, k).collect()} == want


def test_texts_in_many_files_stay_where_they_are(spark, tmp_path):
    from ploidlens import plans

    spark.range(64).selectExpr("id doc_id", "'s' source", "'Some text 1' text", "11L n_chars").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    r = plans.reads(spark, str(tmp_path))
    assert "Repartition" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert {x.seq for x in r.collect()} == {"GGAATATT"} and r.count() == 64
