"""Registered queries over the driver tables, and their SQL. Texts, projected to four letters, stand for reads; sources for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ploidlens.functions import align, codec, logic
from ploidlens.operators import gwas, intervals, kmers, mods

LETTERS, AS = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
K = 7


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    table = _read(spark, d, "documents")
    docs = table.filter("text is not null").select(F.col("doc_id").alias("read_id"), F.col("source").alias("sample"), "text", "n_chars")
    parts = spark.sparkContext.defaultParallelism
    dealt = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]  # from the files' footers
    if max(dealt, default=0) * parts > 2 * sum(dealt):  # else the texts stay where they are
        docs = docs.repartition(max(parts, len(dealt)), "read_id")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), LETTERS, AS)
    return docs.select("read_id", "sample", seq.alias("seq"), "n_chars")


SEQ = f"SELECT doc_id AS read_id, source AS sample, n_chars, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{AS}') AS seq FROM documents WHERE text IS NOT NULL"


def _canon(x: str) -> str:
    return f"least({x}, reverse(translate({x}, 'ACGT', 'TGCA')))"


def _ctes(k: int = K) -> str:
    return f"""r AS ({SEQ}), w AS (SELECT read_id, sample, substr(seq, CAST(i AS INT), {k}) AS raw FROM (SELECT read_id, sample, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM r)),
c AS MATERIALIZED (SELECT sample, kmer, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT sample, raw, {_canon('raw')} AS kmer, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL)"""


def kmer_count(spark, d):
    return kmers.count(reads(spark, d), K)


def kmer_dump(spark, d):
    return kmers.dump(kmer_count(spark, d), 5, 1000)


def kmer_matrix(spark, d):
    return kmers.matrix(kmer_count(spark, d), 5, 1000, 10)


def kmer_matrix_all(spark, d):
    return kmers.matrix(kmer_count(spark, d)).groupBy("n_samples").agg(F.count("*").alias("n_cells"), F.sum("cnt").cast("long").alias("total"))


def kmer_filter_dosage(spark, d):
    r = reads(spark, d)
    depth = r.groupBy("sample").agg((F.sum("n_chars") / 1000.0).alias("depth"))
    return kmers.filter_dosage(kmers.matrix(kmers.count(r, K)), depth, 20, 1000, 0.8, 4)


def _embed(spark, d):
    """Embeddings as a tidy dosage matrix: 64 markers, a sample each row, and the label as trait."""
    e = _read(spark, d, "embeddings")
    tidy = e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("m", "v")).select("sample", F.col("m").cast("string").alias("kmer"), F.col("v").cast("double").alias("dosage"))
    return tidy, e.select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("trait"))


def assoc_ols(spark, d):
    x = gwas.ols(*_embed(spark, d))
    return x.select("kmer", F.col("n").cast("long").alias("n"), F.round("beta", 8).alias("beta"), F.round("r2", 8).alias("r2"))


def _places(spark, d):
    """Samples and their places in dosage arrays."""
    return intervals.name_ids(_read(spark, d, "embeddings"), "vec_id").select(F.col("name").alias("sample"), F.col("id").alias("place"))


def bimbam_rows(spark, d):
    tidy, _ = _embed(spark, d)
    rows = kmers.bimbam(tidy.withColumn("dosage", F.round("dosage", 4)), _places(spark, d))
    return rows.select("kmer", "allele1", "allele0", F.size("dosage").cast("long").alias("n"), F.aggregate(F.transform("dosage", lambda x, i: F.round(x * 10_000).cast("long") * i), F.lit(0).cast("long"), lambda a, x: a + x).alias("ordered"), F.round(F.aggregate("dosage", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def kinship_entries(spark, d):
    """Entries of the centred relatedness matrix."""
    tidy, _ = _embed(spark, d)
    at = _places(spark, d)
    names = [r["sample"] for r in at.orderBy("place").collect()]  # a number for each sample
    return gwas.kinship_cells(kmers.bimbam(tidy, at), names).select("i", "j", (F.round("k", 7) + 0.0).alias("k"))


def assoc_lmm(spark, d):
    """The mixed model over the embeddings' markers."""
    import numpy as np

    tidy, pheno = _embed(spark, d)
    at = _places(spark, d)
    n, markers = at.count(), [r["kmer"] for r in tidy.select("kmer").distinct().orderBy("kmer").limit(gwas.FEW + 1).collect()]
    if len(markers) <= min(gwas.FEW, n):
        wide = kmers.bimbam(tidy.select(F.col("sample").alias("kmer"), F.col("kmer").alias("sample"), "dosage"), markers)
        return gwas.lmm_of_few(wide.join(pheno, F.col("kmer") == F.col("sample")), markers)
    rows = kmers.bimbam(tidy, at)
    trait = np.array([r["trait"] for r in pheno.orderBy("sample").collect()])  # a number for each sample
    k = gwas.kinship(rows, n)
    return gwas.lmm(rows, trait, gwas.principal_components(k), k)


def bh_threshold(spark, d):
    o = _read(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("top"))
    p = o.crossJoin(F.broadcast(top)).select(F.pow(F.col("o_totalprice") / F.col("top"), 6).alias("p_wald"))  # one row
    x = gwas.thresholds(p)
    return x.select("n", F.round("bh_cutoff", 8).alias("bh_cutoff"), F.round("bf_cutoff", 8).alias("bf_cutoff"))


def sketch(spark, d):
    return kmers.sketch(kmer_count(spark, d).select("kmer").distinct(), 500, 1)


def sketch_per_chunk(spark, d):
    c = kmer_count(spark, d)
    return kmers.sketch(c.select(F.col("sample").alias("chunk"), "kmer"), 20, 1, "chunk")


def _rare(spark, d):
    """9-mers that are in two or three reads, with a p made of their letters."""
    r = reads(spark, d)
    hits = kmers.in_reads(r, 9).filter("n_reads between 2 and 3")
    return r, hits.select("kmer", (F.lit(1.0) / (F.coalesce(codec.encode(F.col("kmer")), F.lit(0)) + 2)).alias("p"))


RARE = f"""WITH r AS ({SEQ}),
w AS (SELECT DISTINCT read_id, {_canon('raw')} AS kmer FROM (SELECT read_id, substr(seq, CAST(i AS INT), 9) AS raw FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 7)) AS i FROM r))),
k AS (SELECT kmer, 1.0::DOUBLE / (list_sum(list_transform(range(1, 10), lambda i: (instr('ACGT', substr(kmer, CAST(i AS INT), 1)) - 1) * CAST(pow(4, 9 - i) AS BIGINT))) + 2) AS p FROM w GROUP BY kmer HAVING count(*) BETWEEN 2 AND 3),
h AS (SELECT read_id, min(p) AS p, count(*) AS n_kmers FROM w JOIN k USING (kmer) GROUP BY read_id)"""


def fetch_reads(spark, d):
    r, k = _rare(spark, d)
    return kmers.fetch_reads(r, k, 9).select("read_id", F.round("p", 12).alias("p"), "n_kmers")


def add_pvalue(spark, d):
    r, k = _rare(spark, d)
    return kmers.add_pvalue(r, k, 9).select("read_id", F.round("p", 12).alias("p"))


def retrieve(spark, d):
    c = kmer_count(spark, d)
    return kmers.retrieve(c, c.filter("cnt >= 200"))


def codec_roundtrip(spark, d):
    k = kmer_count(spark, d).select("kmer").distinct()
    code = codec.encode(F.col("kmer"))
    return k.select("kmer", code.alias("code"), codec.decode(code, K).alias("back"), codec.reverse_complement(F.col("kmer")).alias("rc"))


def first_hit(spark, d):
    e = _read(spark, d, "events")
    return gwas.first_hits(e.withColumn("q", F.concat_ws("/", "user_id", "event_type")), "q", ["ts", "event_id"]).select("q", "event_id", F.col("user_id"), "event_type")


def manhattan(spark, d):
    e = _read(spark, d, "lineitem")
    points = e.select(F.col("l_orderkey").alias("snp"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 7).cast("string")).alias("chr"), F.col("l_partkey").alias("pos"), (F.lit(1.0) / (F.col("l_quantity") + 1)).alias("p"))
    return gwas.manhattan(points).select("snp", "chr", "pos", "x", F.round("y", 8).alias("y"))


def _intervals(spark, d):
    a = _read(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("chrom"), (F.col("o_orderkey") % 5000).alias("beg"), (F.col("o_orderkey") % 5000 + 20).alias("end"), F.col("o_orderkey").alias("id"))
    b = _read(spark, d, "events").select((F.col("event_id") % 10).alias("chrom"), (F.col("event_id") * 7 % 5000).alias("beg"), (F.col("event_id") * 7 % 5000 + 10).alias("end"), F.col("event_id").alias("id"))
    return a, b


INTERVALS = "WITH a AS (SELECT o_orderkey % 10 AS chrom, o_orderkey % 5000 AS beg, o_orderkey % 5000 + 20 AS e, o_orderkey AS id FROM orders), b AS (SELECT event_id % 10 AS chrom, event_id * 7 % 5000 AS beg, event_id * 7 % 5000 + 10 AS e, event_id AS id FROM events)"


def interval_overlap(spark, d):
    a, b = _intervals(spark, d)
    return intervals.overlap(a, b, width=64).select("id", "b_id")


def interval_semi(spark, d):
    a, b = _intervals(spark, d)
    return intervals.overlap(a, b, "left_semi", 64).select("id")


def interval_anti(spark, d):
    a, b = _intervals(spark, d)
    return intervals.overlap(a, b.filter("id % 50 = 0"), "left_anti", 64).select("id")


def sample_discovery(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    return _read(spark, d, "pages").select(host.alias("sample")).distinct()


def flags(spark, d):
    f = (F.col("event_id") % 4096).cast("int")
    e = _read(spark, d, "events")
    return e.select("event_id", align.has_flag(f, "UNMAP").alias("unmapped"), (align.has_flag(f, "READ1") & ~align.has_flag(f, "DUP")).alias("first"), F.bit_count(f).cast("long").alias("bits"))


def cigar_lengths(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "D").otherwise("S")).alias("cigar"))
    return lines.select("l_orderkey", "l_linenumber", align.query_length(F.col("cigar")).alias("q"), align.reference_length(F.col("cigar")).alias("r"), align.end_position(F.col("l_orderkey"), F.lit(0), F.col("cigar")).alias("endpos"))


def bins(spark, d):
    o = _read(spark, d, "orders")
    beg = F.col("o_orderkey") * 1009 % 100_000_000
    return o.select("o_orderkey", align.bin_number(beg, beg + F.col("o_custkey") + 1).alias("bin"))


def _bin_sql() -> str:
    out = "0"
    for level in range(1, 6):
        s = 14 + 3 * (5 - level)
        out = f"CASE WHEN beg >> {s} = (e - 1) >> {s} THEN {((1 << 3 * level) - 1) // 7} + (beg >> {s}) ELSE {out} END"
    return out


def variant_sync(spark, d):
    a = _read(spark, d, "orders").select(F.lit("1").alias("chrom"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"))
    b = _read(spark, d, "lineitem").select(F.lit("1").alias("chrom"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    return intervals.sync_variants([a, b])


def three_state(spark, d):
    """Filter logic on values of which some are unknown."""
    e = _read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    small = logic.compare(F.col("v"), "<", F.lit(50.0))
    return e.select("event_id", small.alias("small"), logic.negate(small).alias("not_small"), logic.either(F.col("v") > 50.0, F.col("event_id") % 3 == 0).alias("any"))


def region_text(spark, d):
    """Regions written in several forms, read again and clamped."""
    o = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("c"), (F.col("o_orderkey") % 900 + 1).alias("a"), (F.col("o_orderkey") % 900 + 1 + F.col("o_custkey") % 50).alias("b"))
    name = F.concat(F.lit("chr"), F.col("c").cast("string"))
    at = lambda x: F.format_number(F.col(x) + 1000, 0)
    text = F.when(F.col("c") == 0, name).when(F.col("c") == 1, F.concat(name, F.lit(":-"), at("b"))).when(F.col("c") == 2, F.concat(name, F.lit(":"), at("a"))).when(F.col("c") == 3, F.concat(F.lit("{"), name, F.lit("}:"), at("a"), F.lit("-"), at("b"))).otherwise(F.concat(name, F.lit(":"), at("a"), F.lit("-"), at("b")))
    r = o.select("o_orderkey", align.parse_region(text).alias("r"))
    beg, end = align.clamp_region(F.col("r.beg"), F.col("r.end"), F.lit(1800).cast("long"))
    return r.select("o_orderkey", "r.chrom", beg.alias("beg"), end.alias("end"))


def number_text(spark, d):
    o = _read(spark, d, "orders")
    text = F.concat(F.col("o_custkey").cast("string"), F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("e2")), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return o.select("o_orderkey", align.parse_number(text).alias("n"))


def flag_names(spark, d):
    f = (F.col("event_id") % 4096).cast("int")
    names = align.flag_text(f)
    return _read(spark, d, "events").select("event_id", names.alias("names"), align.flag_value(F.when(names != "", names).otherwise("0x0")).cast("long").alias("back"))


def _p(spark, d):
    o = _read(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("top"))
    return o.crossJoin(F.broadcast(top)).select(F.col("o_orderkey").cast("string").alias("rs"), F.pow(F.col("o_totalprice") / F.col("top"), 6).alias("p_wald"))  # one row


def bh_adjusted(spark, d):
    return gwas.adjusted(_p(spark, d)).select("rs", F.round("p_adjusted", 9).alias("p_adjusted"))


def significant_fasta(spark, d):
    x = gwas.significant_fasta(_p(spark, d), 1e-4)
    return x.select(F.regexp_extract("name", ">asso_kmer([0-9]+)_", 1).cast("long").alias("i"), "seq")


def kth_price(spark, d):
    return intervals.kth_smallest(_read(spark, d, "orders"), "o_totalprice", 137)


def name_ids(spark, d):
    return intervals.name_ids(_read(spark, d, "part"), "p_name")


def _records(spark, d):
    """Alignments made of orders: two blocks with a gap."""
    o = _read(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("qname"), F.when(F.col("o_orderkey") % 9 == 0, 4).otherwise(F.when(F.col("o_orderkey") % 2 == 0, 16).otherwise(0)).alias("flag"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("chrom"), (F.col("o_orderkey") % 3000).alias("pos"), (F.col("o_custkey") % 61).cast("int").alias("mapq"), F.lit("5S10M3D2I7M").alias("cigar"), F.repeat(F.lit("ACGT"), 6).alias("seq"), F.repeat(F.lit("I"), 24).alias("qual"), F.create_map(F.lit("NM"), F.struct(F.lit("i").alias("type"), (F.col("o_custkey") % 5).cast("string").alias("value"))).alias("aux"), F.lit(None).cast("long").alias("isize"))


RECORDS = "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 4 WHEN o_orderkey % 2 = 0 THEN 16 ELSE 0 END AS flag, 'c' || (o_orderkey % 3) AS chrom, o_orderkey % 3000 AS pos, o_custkey % 61 AS mapq, o_custkey % 5 AS nm FROM orders)"


def mapping_counts(spark, d):
    return intervals.mapping_counts(_records(spark, d))


def region_fetch(spark, d):
    return intervals.fetch_region(_records(spark, d), "c1:501-900").select("qname")


def pileup(spark, d):
    return intervals.pileup(intervals.aligned_bases(_records(spark, d)))


def _modified(spark, d):
    """The records with one group of modified bases each."""
    of = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
    n = F.col("qname").cast("long")
    aux = F.create_map(F.lit("MM"), of("Z", F.concat(F.lit("C+mh?,"), (n % 3).cast("string"), F.lit(",1;"))), F.lit("ML"), of("B", F.concat(F.lit("C,200,10,"), (n % 256).cast("string"), F.lit(",0"))))
    return _records(spark, d).withColumns({"seq": F.repeat(F.lit("AACGT"), 5), "aux": aux})


def base_modifications(spark, d):
    return mods.base_modifications(_modified(spark, d)).drop("flag")


def modification_kinds(spark, d):
    return mods.modification_kinds(_modified(spark, d)).select("qname", "canonical", "strand", F.concat_ws(",", "codes").alias("codes"), "implicit")


def insertions(spark, d):
    return intervals.inserted(_records(spark, d)).select("qname", "pos", "text")


def record_filter(spark, d):
    hit = logic.record_filter('mapq >= 30 && !flag.unmap && ([NM] < 3 || chrom =~ "[02]$")')
    return _records(spark, d).filter(hit).select("qname")


def targets(spark, d):
    a, b = _intervals(spark, d)
    return intervals.targets(a.withColumnRenamed("beg", "pos"), b.filter("id % 50 = 0"), 0, width=64).select("id")


def _variants(spark, d):
    a, b = (_read(spark, d, t).select(F.lit("1").alias("chrom"), F.datediff(c, F.lit("1990-01-01")).cast("long").alias("pos"), F.lit("A").alias("ref"), F.when(k % 3 == 0, "T").when(k % 3 == 1, "AT").otherwise("T,C").alias("alt")) for t, c, k in (("orders", "o_orderdate", F.col("o_orderkey")), ("lineitem", "l_shipdate", F.col("l_partkey"))))
    return [a, b]


def variant_exact(spark, d):
    return intervals.sync_variants(_variants(spark, d), "exact")


def variant_snps(spark, d):
    return intervals.sync_variants(_variants(spark, d), "snps")


def variant_some(spark, d):
    return intervals.sync_variants(_variants(spark, d), "some")


def _variant_sql(mode: str) -> str:
    kind = "CASE {0} % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'AT' ELSE 'T,C' END"
    day = "date_diff('day', DATE '1990-01-01', CAST({0} AS DATE))"
    rows = f"WITH v AS (SELECT DISTINCT 0 AS r, {day.format('o_orderdate')} AS pos, {kind.format('o_orderkey')} AS alt FROM orders UNION SELECT DISTINCT 1, {day.format('l_shipdate')}, {kind.format('l_partkey')} FROM lineitem)"
    got = "CAST(count(DISTINCT r) AS BIGINT) AS n_readers, string_agg(DISTINCT CAST(r AS VARCHAR), ',' ORDER BY CAST(r AS VARCHAR)) AS readers"
    if mode == "exact":
        return f"{rows} SELECT '1' AS chrom, pos, 'A' AS ref, alt, {got} FROM v GROUP BY pos, alt"
    if mode == "snps":
        return f"{rows} SELECT '1' AS chrom, pos, {got} FROM v WHERE alt <> 'AT' GROUP BY pos"
    return f"{rows}, s AS (SELECT r, pos, unnest(string_split(alt, ',')) AS allele FROM v) SELECT '1' AS chrom, pos, 'A' AS ref, allele, {got} FROM s GROUP BY pos, allele"


def fetch_pairs(spark, d):
    """Reads 2n and 2n + 1 as mates."""
    r, k = _rare(spark, d)
    side = lambda m: r.filter(F.col("read_id") % 2 == m - 1).select(F.concat(F.shiftright("read_id", 1).cast("string"), F.lit(f"/{m}")).alias("name"), F.lit(None).cast("string").alias("comment"), "seq", F.lit(None).cast("string").alias("qual"))
    x = kmers.fetch_pairs(side(1), side(2), k, 9)
    return x.select("pair", F.round("p", 12).alias("p"), "n_kmers", F.col("r1.name").alias("r1"), F.col("r2.name").alias("r2"))


def genome_hits(spark, d):
    """Places of the rare 9-mers in all reads."""
    r, k = _rare(spark, d)
    return kmers.genome_hits(k, r.select(F.col("read_id").cast("string").alias("name"), "seq"), 9)


def sequence_parts(spark, d):
    r = reads(spark, d).select(F.col("read_id").cast("string").alias("name"), "seq")
    at = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chrom"), (F.col("doc_id") % 40 - 5).alias("beg"), (F.col("doc_id") % 90).alias("end"))
    return intervals.fetch_sequences(r, at)


def part_sets(spark, d):
    x = intervals.bit_sets(_read(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    return x.select("l_suppkey", intervals.bit_size(F.col("bits")).alias("n"), intervals.has_bit(F.col("bits"), F.lit(7)).alias("seven"))


def name_hash(spark, d):
    return _read(spark, d, "customer").select("c_custkey", align.x31_hash(F.col("c_name")).alias("h"))


def base_codes(spark, d):
    r = reads(spark, d).select("read_id", align.base_at(F.col("seq"), F.lit(3)).alias("b"))
    code = align.nt16_code(F.col("b"))
    return r.select("read_id", "b", F.when(F.col("b") != "", code).cast("long").alias("code"), F.when(F.col("b") != "", align.nt16_int(code)).cast("long").alias("i"))


MORE = (region_text, number_text, flag_names, bh_adjusted, significant_fasta, kth_price, name_ids, mapping_counts, region_fetch, pileup, base_modifications, modification_kinds, insertions, record_filter, targets, variant_exact, variant_snps, variant_some, fetch_pairs, genome_hits, sequence_parts, part_sets, name_hash, base_codes)
QUERIES = {f.__name__: f for f in (kmer_count, kmer_dump, kmer_matrix, kmer_matrix_all, kmer_filter_dosage, assoc_ols, assoc_lmm, bimbam_rows, kinship_entries, bh_threshold, sketch, sketch_per_chunk, fetch_reads, add_pvalue, retrieve, codec_roundtrip, first_hit, manhattan, interval_overlap, interval_semi, interval_anti, sample_discovery, flags, cigar_lengths, bins, variant_sync, three_state, *MORE)}

EMBED = "t AS (SELECT vec_id AS sample, label, unnest(range(0, 64)) AS m, CAST(unnest(embedding) AS DOUBLE) AS dosage FROM embeddings)"
ORACLE_SQL = {
    "kmer_count": f"WITH {_ctes()} SELECT * FROM c",
    "kmer_dump": f"WITH {_ctes()} SELECT * FROM c WHERE cnt BETWEEN 5 AND 1000",
    "kmer_matrix": f"WITH {_ctes()}, f AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n_samples FROM c WHERE cnt BETWEEN 5 AND 1000) SELECT kmer, sample, cnt, n_samples FROM f WHERE n_samples >= 10",
    "kmer_matrix_all": f"WITH {_ctes()}, f AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n_samples FROM c) SELECT n_samples, count(*) AS n_cells, CAST(sum(cnt) AS BIGINT) AS total FROM f GROUP BY 1",
    "kmer_filter_dosage": f"WITH {_ctes()}, q AS (SELECT sample, sum(n_chars) / 1000.0::DOUBLE AS depth FROM r GROUP BY 1), f AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS present FROM c WHERE cnt <= 1000) SELECT kmer, sample, cnt, least(4.0::DOUBLE, round(cnt * 4 / depth)) AS dosage FROM f JOIN q USING (sample) WHERE 1 - present / 20.0::DOUBLE <= 0.8",
    "assoc_ols": f"WITH {EMBED} SELECT CAST(m AS VARCHAR) AS kmer, CAST(regr_count(label, dosage) AS BIGINT) AS n, round(regr_slope(label, dosage), 8) AS beta, round(regr_r2(label, dosage), 8) AS r2 FROM t GROUP BY m",
    "bimbam_rows": f"WITH {EMBED} SELECT CAST(m AS VARCHAR) AS kmer, 'A' AS allele1, 'T' AS allele0, count(*) AS n, CAST(sum(CAST(round(round(dosage, 4) * 10000) AS BIGINT) * place) AS BIGINT) AS ordered, round(sum(round(dosage, 4)), 4) AS total FROM (SELECT *, dense_rank() OVER (ORDER BY sample) - 1 AS place FROM t) GROUP BY m",
    "kinship_entries": f"WITH {EMBED}, x AS (SELECT sample, m, dosage - avg(dosage) OVER (PARTITION BY m) AS v FROM t) SELECT a.sample AS i, b.sample AS j, round(sum(a.v * b.v) / 64, 7) + 0.0 AS k FROM x a JOIN x b USING (m) GROUP BY 1, 2",
    "bh_threshold": "WITH p AS (SELECT pow(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS p FROM orders), v AS (SELECT p FROM p WHERE p > 0 AND p <= 1), n AS (SELECT count(*) AS n FROM v), r AS (SELECT p, n, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM v, n) SELECT max(n)::BIGINT AS n, round(-log10(max(CASE WHEN p * n / rank < 0.05 THEN p END)), 8) AS bh_cutoff, round(-log10(0.05 / max(n)), 8) AS bf_cutoff FROM r",
    "sketch": f"WITH {_ctes()} SELECT kmer FROM (SELECT DISTINCT kmer FROM c) ORDER BY md5(kmer || ':1'), kmer LIMIT 500",
    "sketch_per_chunk": f"WITH {_ctes()} SELECT sample AS chunk, kmer FROM c QUALIFY row_number() OVER (PARTITION BY sample ORDER BY md5(kmer || ':1'), kmer) <= 20",
    "fetch_reads": f"{RARE} SELECT read_id, round(p, 12) AS p, n_kmers FROM h",
    "add_pvalue": f"{RARE} SELECT r.read_id, round(h.p, 12) AS p FROM r LEFT JOIN h USING (read_id)",
    "retrieve": f"WITH {_ctes()} SELECT * FROM c WHERE kmer IN (SELECT kmer FROM c WHERE cnt >= 200)",
    "codec_roundtrip": f"WITH {_ctes()} SELECT kmer, list_sum(list_transform(range(1, {K + 1}), lambda i: (instr('ACGT', substr(kmer, CAST(i AS INT), 1)) - 1) * CAST(pow(4, {K} - i) AS BIGINT)))::BIGINT AS code, kmer AS back, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM (SELECT DISTINCT kmer FROM c)",
    "first_hit": "SELECT user_id || '/' || event_type AS q, event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "manhattan": "WITH e AS (SELECT l_orderkey AS snp, 'chr' || (l_suppkey % 7) AS chr, l_partkey AS pos, 1.0::DOUBLE / (l_quantity + 1) AS p FROM lineitem), t AS (SELECT chr, max(pos) AS top FROM e GROUP BY 1), o AS (SELECT chr, coalesce(sum(top) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t) SELECT snp, chr, pos, CAST(pos + off AS BIGINT) AS x, round(-log10(p), 8) AS y FROM e JOIN o USING (chr)",
    "interval_overlap": f"{INTERVALS} SELECT a.id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom AND a.beg < b.e AND b.beg < a.e",
    "interval_semi": f"{INTERVALS} SELECT a.id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.beg < b.e AND b.beg < a.e)",
    "interval_anti": f"{INTERVALS} SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id % 50 = 0 AND a.chrom = b.chrom AND a.beg < b.e AND b.beg < a.e)",
    "sample_discovery": "SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)/', 1) AS sample FROM pages",
    "flags": "SELECT event_id, (event_id % 4096) & 4 <> 0 AS unmapped, ((event_id % 4096) & 64 <> 0) AND ((event_id % 4096) & 1024 = 0) AS first, CAST(bit_count(CAST(event_id % 4096 AS INT)) AS BIGINT) AS bits FROM events",
    "cigar_lengths": "WITH x AS (SELECT *, CAST(l_quantity AS INT) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(n + CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END AS BIGINT) AS q, CAST(n + CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END AS BIGINT) AS r, CAST(l_orderkey + n + CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END AS BIGINT) AS endpos FROM x",
    "bins": f"SELECT o_orderkey, CAST({_bin_sql()} AS BIGINT) AS bin FROM (SELECT o_orderkey, o_orderkey * 1009 % 100000000 AS beg, o_orderkey * 1009 % 100000000 + o_custkey + 1 AS e FROM orders)",
    "variant_sync": "WITH a AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS pos FROM orders), b AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS pos FROM lineitem) SELECT '1' AS chrom, coalesce(a.pos, b.pos) AS pos, CAST((a.pos IS NOT NULL)::INT + (b.pos IS NOT NULL)::INT AS BIGINT) AS n_readers, CASE WHEN b.pos IS NULL THEN '0' WHEN a.pos IS NULL THEN '1' ELSE '0,1' END AS readers FROM a FULL JOIN b ON a.pos = b.pos",
    "three_state": "SELECT event_id, coalesce(v < 50, false) AS small, NOT coalesce(v < 50, false) AS not_small, coalesce(v > 50, false) OR event_id % 3 = 0 AS any FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)",
}

_NAMES = ", ".join(f"CASE WHEN (event_id % 4096) & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(align.FLAGS))
_P = "p AS (SELECT CAST(o_orderkey AS VARCHAR) AS rs, pow(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS p FROM orders)"
ORACLE_SQL |= {
    "region_text": "WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS c, o_orderkey % 900 + 1001 AS a, o_orderkey % 900 + 1001 + o_custkey % 50 AS b FROM orders) SELECT o_orderkey, 'chr' || c AS chrom, CAST(CASE WHEN c <= 1 THEN 0 ELSE least(a - 1, 1800) END AS BIGINT) AS beg, CAST(CASE WHEN c IN (0, 2) THEN 1800 ELSE least(b, 1800) END AS BIGINT) AS end FROM o",
    "number_text": "SELECT o_orderkey, CAST(o_custkey * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100 END AS BIGINT) AS n FROM orders",
    "flag_names": f"SELECT event_id, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS names, CAST(event_id % 4096 AS BIGINT) AS back FROM events",
    "bh_adjusted": f"WITH {_P}, r AS (SELECT rs, p, p * (SELECT count(*) FROM p WHERE p > 0 AND p <= 1) / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM p WHERE p > 0 AND p <= 1) SELECT p.rs, round(least(1.0, min(q) OVER (ORDER BY r.p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_adjusted FROM p LEFT JOIN r USING (rs)",
    "significant_fasta": f"WITH {_P} SELECT row_number() OVER (ORDER BY p, rs) - 1 AS i, rs AS seq FROM p WHERE p < 1e-4",
    "kth_price": "SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders) WHERE i = 137",
    "name_ids": "SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)",
    "mapping_counts": f"{RECORDS} SELECT chrom, count(*) FILTER (flag <> 4) AS mapped, count(*) FILTER (flag = 4) AS unmapped FROM o GROUP BY chrom",
    "region_fetch": f"{RECORDS} SELECT CAST(o_orderkey AS VARCHAR) AS qname FROM o WHERE chrom = 'c1' AND pos < 900 AND pos + CASE WHEN flag = 4 THEN 1 ELSE 20 END > 500",
    "pileup": f"{RECORDS}, b AS (SELECT chrom, pos + i AS pos, i BETWEEN 10 AND 12 AS gap FROM (SELECT chrom, pos, unnest(range(0, 20)) AS i FROM o WHERE flag <> 4)) SELECT chrom, pos, count(*) FILTER (NOT gap) AS depth, count(*) FILTER (gap) AS n_del FROM b GROUP BY ALL",
    "base_modifications": f"{RECORDS}, m AS (SELECT o_orderkey, flag, CASE WHEN j < 2 THEN 0 ELSE 2 END + o_orderkey % 3 AS nth, CASE j % 2 WHEN 0 THEN 'm' ELSE 'h' END AS code, CASE j WHEN 0 THEN 200 WHEN 1 THEN 10 WHEN 2 THEN o_orderkey % 256 ELSE 0 END AS qual FROM (SELECT o_orderkey, flag, unnest(range(0, 4)) AS j FROM o)) SELECT CAST(o_orderkey AS VARCHAR) AS qname, CAST(CASE WHEN flag = 16 THEN 23 - 5 * nth ELSE 2 + 5 * nth END AS BIGINT) AS qpos, 'C' AS canonical, '+' AS strand, code, CAST(qual AS INT) AS qual, false AS implicit FROM m",
    "modification_kinds": "SELECT CAST(o_orderkey AS VARCHAR) AS qname, 'C' AS canonical, '+' AS strand, 'm,h' AS codes, false AS implicit FROM orders",
    "insertions": f"{RECORDS} SELECT CAST(o_orderkey AS VARCHAR) AS qname, pos + 12 AS pos, substr(repeat('ACGT', 6), 16, 2) AS text FROM o WHERE flag <> 4",
    "record_filter": f"{RECORDS} SELECT CAST(o_orderkey AS VARCHAR) AS qname FROM o WHERE mapq >= 30 AND flag <> 4 AND (nm < 3 OR chrom IN ('c0', 'c2'))",
    "targets": f"{INTERVALS} SELECT a.id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.id % 50 = 0 AND a.chrom = b.chrom AND a.beg < b.e AND b.beg <= a.beg)",
    "variant_exact": _variant_sql("exact"),
    "variant_snps": _variant_sql("snps"),
    "variant_some": _variant_sql("some"),
    "fetch_pairs": f"{RARE}, s AS (SELECT read_id // 2 AS pair, min(p) AS p, CAST(sum(n_kmers) AS BIGINT) AS n_kmers FROM h GROUP BY 1), i AS (SELECT DISTINCT read_id FROM r) SELECT CAST(pair AS VARCHAR) AS pair, round(p, 12) AS p, n_kmers, CASE WHEN pair * 2 IN (SELECT read_id FROM i) THEN pair || '/1' END AS r1, CASE WHEN pair * 2 + 1 IN (SELECT read_id FROM i) THEN pair || '/2' END AS r2 FROM s",
    "genome_hits": f"{RARE.replace('h AS (', 'g AS (SELECT read_id, i - 1 AS pos, substr(seq, CAST(i AS INT), 9) AS raw FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 7)) AS i FROM r)), h AS (')} SELECT k.kmer, CAST(read_id AS VARCHAR) AS chrom, pos, CASE WHEN raw = k.kmer THEN '+' ELSE '-' END AS strand FROM g JOIN k ON k.kmer = {_canon('raw')}",
    "sequence_parts": f"WITH r AS ({SEQ}), c AS (SELECT read_id, seq, least(greatest(read_id % 40 - 5, 0), length(seq)) AS b, read_id % 90 AS e FROM r) SELECT CAST(read_id AS VARCHAR) AS chrom, CAST(b AS BIGINT) AS beg, CAST(greatest(least(e, length(seq)), b) AS BIGINT) AS end, substr(seq, CAST(b + 1 AS INT), CAST(greatest(least(e, length(seq)), b) - b AS INT)) AS seq FROM c",
    "part_sets": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n, bool_or(l_partkey = 7) AS seven FROM lineitem GROUP BY 1",
    "name_hash": "SELECT c_custkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (h * 31 + x) % 4294967296) AS BIGINT) AS h FROM customer",
    "base_codes": f"WITH r AS ({SEQ}), b AS (SELECT read_id, substr(seq, 4, 1) AS b FROM r) SELECT read_id, b, CASE b WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 END::BIGINT AS code, CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END::BIGINT AS i FROM b",
}
