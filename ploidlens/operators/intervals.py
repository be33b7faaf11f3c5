"""Interval joins, region filters, binning, variant merging and pileups. Coordinates are 0-based half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.functions import align, ranges

#: From so many pairs of rows for a pair of coordinates on, overlap works on different coordinates.
REPEATS = 16

def overlap(a: DataFrame, b: DataFrame, how: str = "inner", width: int = 1 << 14) -> DataFrame:
    """Pairs of overlapping intervals (chrom, beg, end; the rest of b prefixed b_), by an equi-join on bins of `width`.

    A pair meets in the bin where the later of the two begins, so it is made once. left_semi and left_anti keep rows of a once.
    Rows with a null coordinate overlap nothing; an interval of no length counts as one base for its bin only. Columns of a
    that are named as those of b with b_ raise. Where coordinates repeat (pairs of rows at least REPEATS times those of
    different coordinates), only different coordinates meet in bins, and rows come to their pairs by equality, so that no
    pair of rows is tried in vain and the rows of one pair of coordinates stand together.
    """
    if how == "inner" and _repeats(a, b):
        return _by_coordinates(a, b, width)
    return _in_bins(a, b, how, width)


def _repeats(a: DataFrame, b: DataFrame) -> bool:
    n = [x.groupBy("chrom", "beg", "end").count().agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first() for x in (a, b)]
    return n[0].rows * n[1].rows >= REPEATS * n[0].n * n[1].n > 0


def _by_coordinates(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Inner overlap by pairs of different coordinates."""
    by = ("chrom", "beg", "end")
    pairs = _in_bins(a.select(*by).distinct(), b.select(*by).distinct(), "inner", width)
    pairs = pairs.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(f"b_{c}").alias(f"__b_{c}") for c in by])
    left = a.select(*[F.col(f"`{c}`").alias(f"__a{k}") for k, c in enumerate(a.columns)])
    here = {c: f"__a{a.columns.index(c)}" for c in by}
    left = left.join(pairs, [F.col(here[c]) == F.col(f"__{c}") for c in by]).drop(*[f"__{c}" for c in by])
    right = b.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns])
    met = left.hint("merge").join(right, [F.col(f"__b_{c}") == F.col(f"b_{c}") for c in by])
    return met.select(*[F.col(f"__a{k}").alias(c) for k, c in enumerate(a.columns)], *[F.col(f"`{c}`") for c in right.columns])


def _in_bins(a: DataFrame, b: DataFrame, how: str, width: int) -> DataFrame:
    bins = lambda x, y: F.explode(F.sequence(F.floor(x / width), F.floor((F.greatest(y, x + 1) - 1) / width)))
    left = a.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in a.columns])).select("__row", "chrom", "beg", "end")
    left = left.withColumn("__bin", bins(F.col("beg"), F.col("end")))
    right = b.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns])
    right = right.withColumn("__b_bin", bins(F.col("b_beg"), F.col("b_end")))
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("__bin") == F.col("__b_bin")) & (F.col("beg") < F.col("b_end")) & (F.col("b_beg") < F.col("end"))
    if how == "inner":
        at = F.floor(F.greatest("beg", "b_beg") / width)
        return left.join(right, on & (F.col("__bin") == at)).select("__row.*", *right.columns).drop("__b_bin")
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    hit = left.join(right, on, "left_semi").select("chrom", "beg", "end").distinct()  # rows with equal coordinates fare alike
    same = F.col("chrom").eqNullSafe(F.col("h_chrom")) & F.col("beg").eqNullSafe(F.col("h_beg")) & F.col("end").eqNullSafe(F.col("h_end"))
    return a.join(hit.select(*[F.col(c).alias(f"h_{c}") for c in hit.columns]), same, how)


def region_counts(regions: DataFrame) -> DataFrame:
    """Regions of each sequence; null sequences are one."""
    return regions.groupBy("chrom").agg(F.count("*").alias("n_regions"))


def fetch_region(records: DataFrame, region: str, beg: str = "pos", end: str | None = None) -> DataFrame:
    """Alignments (chrom, pos, flag, cigar) that overlap a region, in the forms of align.parse_region: "." all, "*" those without a place."""
    if region == ".":
        return records
    if region == "*":
        return records.filter(F.col("chrom").isNull() | (F.col("chrom") == "*"))
    r = align.parse_region(F.lit(region))
    stop = F.col(end) if end else align.end_position(F.col(beg), F.col("flag"), F.col("cigar"))
    return records.filter((F.col("chrom") == r.chrom) & (F.col(beg) < r.end) & (stop > r.beg))


def fetch_sequences(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """Of sequences (name, seq), the parts at regions (chrom, beg, end; clamped): chrom, beg, end, seq. Unknown names have no row."""
    rows = regions.join(sequences.select(F.col("name").alias("chrom"), F.col("seq").alias("__whole")), "chrom")
    low, high = align.clamp_region(F.col("beg"), F.col("end"), F.length("__whole").cast("long"))
    return rows.select("chrom", low.alias("beg"), high.alias("end"), F.substr("__whole", (low + 1).cast("int"), (high - low).cast("int")).alias("seq"))


def sequence_index(sequences: DataFrame) -> DataFrame:
    """name and length of each sequence."""
    return sequences.select("name", F.length("seq").cast("long").alias("length"))


def mapping_counts(records: DataFrame) -> DataFrame:
    """For each sequence of alignments mapped and unmapped (placed there) records; those without a place under *."""
    name = F.coalesce(F.when(F.col("pos") >= 0, F.col("chrom")), F.lit("*"))
    off = align.has_flag(F.col("flag"), "UNMAP")
    return records.groupBy(name.alias("chrom")).agg(F.count_if(~off).alias("mapped"), F.count_if(off).alias("unmapped"))


def name_ids(names: DataFrame, col: str) -> DataFrame:
    """Different names (not null) with ids from 0 in their order; ranges of names are numbered apart, then shifted."""
    rows = names.select(F.col(col).alias("name")).filter("name is not null").distinct()
    rows = rows.withColumn("part", ranges.piece(rows, "name", rows.count()))
    base = rows.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))  # a row for each range
    i = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return rows.join(F.broadcast(base), "part").select("name", i.cast("long").alias("id"))


def kth_smallest(rows: DataFrame, col: str, k: int) -> DataFrame:
    """The k-th smallest value (k from 1; nulls don't count), one row or none; values are counted in ranges, and one range is sorted."""
    counts = rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).count()
    parts = counts.withColumn("part", ranges.piece(counts, "v", counts.count()))
    base = parts.groupBy("part").agg(F.sum("count").alias("s")).select("part", "s", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    near = parts.join(F.broadcast(base.filter((F.col("base") < k) & (F.col("base") + F.col("s") >= k))), "part")
    upto = F.col("base") + F.sum("count").over(Window.partitionBy("part").orderBy("v"))
    return near.withColumn("upto", upto).filter((F.col("upto") >= k) & (F.col("upto") - F.col("count") < k)).select(F.col("v").alias(col))


def bit_sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """For each key the set of its members (0 or more) as words of 64 bits: key and bits, a map from word number to word."""
    words = rows.filter(F.col(member) >= 0).groupBy(key, F.shiftright(member, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(member).bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    return words.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "x")))).alias("bits"))


def has_bit(bits, member):
    """Whether a set of bit_sets() has a member."""
    word = F.try_element_at(bits, F.shiftright(member, 6))
    return F.coalesce(F.call_function("shiftright", word, member.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def bit_size(bits):
    return F.aggregate(F.map_values(bits), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))


#: Ways to pair sites of several tables.
PAIRINGS = ("any", "exact", "some", "snps", "indels", "both", "snp_ref", "indel_ref", "both_ref")


def sync_variants(tables: list[DataFrame], alleles: str = "any") -> DataFrame:
    """Sites of all tables (chrom, pos, ref, alt): chrom, pos (and alleles, if exact), n_readers, readers.

    alt: text, several joined by commas, or an array. alleles: any (by position), exact (by ref and all of alt), some (by
    position, of tables that share an allele), snps or indels (by position, sites that have one), both (snps with snps,
    indels with indels), snp_ref, indel_ref, both_ref (these, and sites without an alternative, which pair with them).
    """
    if alleles not in PAIRINGS:
        raise ValueError(f"unknown pairing {alleles}")
    rows = None
    for k, t in enumerate(tables):
        alt = F.col("alt") if t.schema["alt"].dataType.simpleString().startswith("array") else F.split("alt", ",")
        x = t.select("chrom", "pos", "ref", alt.alias("alts"), F.lit(k).alias("reader"))
        rows = x if rows is None else rows.union(x)
    real = F.filter("alts", lambda x: ~x.isin(".", "<*>", "<NON_REF>", ""))
    rows = rows.withColumn("real", F.coalesce(real, F.array().cast("array<string>")))
    snp = F.exists("real", lambda x: (F.length(x) == 1) & (F.length("ref") == 1))
    indel = F.exists("real", lambda x: F.length(x) != F.length("ref"))
    plain = F.size("real") == 0
    key = ["chrom", "pos"]
    if alleles == "exact":
        rows, key = rows.withColumn("alt", F.array_join("alts", ",")), ["chrom", "pos", "ref", "alt"]
    elif alleles in ("snps", "indels"):
        rows = rows.filter(snp if alleles == "snps" else indel)
    elif alleles in ("snp_ref", "indel_ref"):
        rows = rows.filter((snp if alleles == "snp_ref" else indel) | plain)
    elif alleles in ("both", "both_ref"):
        kinds = F.array_compact(F.array(F.when(snp, "snp"), F.when(indel, "indel"), F.when(~snp & ~indel & ~plain, "other")))
        if alleles == "both_ref":
            kinds = F.when(plain, F.array(F.lit("snp"), F.lit("indel"))).otherwise(kinds)
        else:
            kinds = F.when(plain, F.array(F.lit("ref"))).otherwise(kinds)
        rows, key = rows.withColumn("kind", F.explode(kinds)), ["chrom", "pos", "kind"]
    elif alleles == "some":
        rows, key = rows.withColumn("allele", F.explode(F.when(plain, F.array(F.lit("."))).otherwise(F.col("real")))), ["chrom", "pos", "ref", "allele"]
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_set("reader")).alias("r"))
    return got.select(*key, F.size("r").cast("long").alias("n_readers"), F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("readers"))


def choose_samples(samples: list[str], listed: list[str], exclude: bool = False) -> list[str]:
    """Samples that are listed (or not), in their own order."""
    return [s for s in samples if (s in set(listed)) != exclude]


def sample_subset(tables: list[list[str]], text: str, lines: list[str] | None = None) -> list[str]:
    """The samples that `text` names, in the order of the first table: a list joined by commas, or "-" for those that all tables
    have; lines, if given, are a file's instead. A leading ! or ^ takes all others."""
    if text == "-":
        return [s for s in tables[0] if all(s in set(t) for t in tables[1:])]
    exclude = text[:1] in ("!", "^")
    named = [x.strip() for x in lines] if lines is not None else text.lstrip("!^").split(",")
    return choose_samples(tables[0], named, exclude)


def targets(a: DataFrame, regions: DataFrame, mode: int = 1, complement: bool = False, width: int = 1 << 14) -> DataFrame:
    """Rows of a (chrom, pos, beg, end) at regions (or elsewhere). mode 0: pos lies in one; 1: the record overlaps one; 2: what varies (vbeg, vend) does."""
    if mode not in (0, 1, 2):
        raise ValueError(f"unknown mode {mode}")
    beg, end = {0: ("pos", None), 1: ("beg", "end"), 2: ("vbeg", "vend")}[mode]
    last = F.col(end) if end else F.col(beg) + 1
    rows = a.select(F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("__a"), "chrom", F.col(beg).alias("beg"), last.alias("end"))
    return overlap(rows, regions.select("chrom", "beg", "end"), "left_anti" if complement else "left_semi", width).select("__a.*")


def passes_filter(df: DataFrame, names: list[str], col: str = "filter") -> DataFrame:
    return df.filter(F.arrays_overlap(col, F.array(*[F.lit(n) for n in names])))


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row for each base or gap on the reference: chrom, pos, qname, qpos, is_del, is_refskip, base, q (quality), reverse."""
    ops = align.cigar_ops(F.col("cigar"))
    zero = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<r:bigint,q:bigint,len:bigint,op:string>>").alias("out"))
    uses = lambda x, s: F.when(x.op.isin(*s), x.len).otherwise(F.lit(0).cast("long"))
    step = lambda a, x: F.struct((a.r + uses(x, align.REFERENCE_OPS)).alias("r"), (a.q + uses(x, align.QUERY_OPS)).alias("q"), F.when(x.op.isin(*align.REFERENCE_OPS), F.concat(a.out, F.array(F.struct(a.r.alias("r"), a.q.alias("q"), x.len.alias("len"), x.op.alias("op"))))).otherwise(a.out).alias("out"))
    rows = reads.filter(~align.has_flag(F.col("flag"), "UNMAP")).select("chrom", "qname", "seq", "qual", align.has_flag(F.col("flag"), "REVERSE").alias("reverse"), F.explode(F.aggregate(ops, zero, step, lambda a: a.out)).alias("o"))
    rows = rows.select("chrom", "qname", "seq", "qual", "reverse", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.len") - 1)).alias("i")).filter("o.len > 0")
    gap = F.col("o.op").isin("D", "N")
    q = F.when(~gap, F.col("o.q") + F.col("i"))
    return rows.select("chrom", (F.col("o.r") + F.col("i")).alias("pos"), "qname", q.alias("qpos"), (F.col("o.op") == "D").alias("is_del"), (F.col("o.op") == "N").alias("is_refskip"), F.substr("seq", (q + 1).cast("int"), F.lit(1)).alias("base"), (F.ascii(F.substr("qual", (q + 1).cast("int"), F.lit(1))) - 33).alias("q"), "reverse")


def pileup(bases: DataFrame, max_depth: int | None = None) -> DataFrame:
    """chrom, pos, depth (without gaps), n_del. With max_depth, that many reads a position, by name."""
    if max_depth:
        bases = bases.withColumn("rank", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("qname"))).filter(F.col("rank") <= max_depth)
    return bases.groupBy("chrom", "pos").agg(F.count_if(~F.col("is_del") & ~F.col("is_refskip")).alias("depth"), F.count_if("is_del").alias("n_del"))


def overlap_qualities(bases: DataFrame) -> DataFrame:
    """Of mates that cover one base: equal bases add up (200 at most), else the better one keeps 0.8 of its quality; the other gets 0."""
    w = Window.partitionBy("chrom", "pos", "qname").orderBy(F.desc("q"), "qpos")
    nth, two = F.row_number().over(w), Window.partitionBy("chrom", "pos", "qname")
    same, total, n = F.min("base").over(two) == F.max("base").over(two), F.sum("q").over(two), F.count("*").over(two)
    q = F.when(n < 2, F.col("q")).when(nth > 1, 0).when(same, F.least(total, F.lit(200))).otherwise(F.floor(F.col("q") * 0.8))
    return bases.withColumn("q", q.cast("int"))


def inserted(reads: DataFrame) -> DataFrame:
    """Insertions of alignments: chrom, pos (of the base before), qname and the text inserted."""
    ops = align.cigar_ops(F.col("cigar"))
    zero = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<r:bigint,q:bigint,len:bigint>>").alias("out"))
    uses = lambda x, s: F.when(x.op.isin(*s), x.len).otherwise(F.lit(0).cast("long"))
    step = lambda a, x: F.struct((a.r + uses(x, align.REFERENCE_OPS)).alias("r"), (a.q + uses(x, align.QUERY_OPS)).alias("q"), F.when(x.op == "I", F.concat(a.out, F.array(F.struct(a.r.alias("r"), a.q.alias("q"), x.len.alias("len"))))).otherwise(a.out).alias("out"))
    rows = reads.filter(~align.has_flag(F.col("flag"), "UNMAP")).select("chrom", "qname", "seq", F.explode(F.aggregate(ops, zero, step, lambda a: a.out)).alias("o"))
    return rows.select("chrom", (F.col("o.r") - 1).alias("pos"), "qname", F.substr("seq", (F.col("o.q") + 1).cast("int"), F.col("o.len").cast("int")).alias("text"))
