"""Readers with fixed schemas, and writers. Paths are Hadoop URIs; gzip, bzip2 and zstd are read by Spark's codecs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = "file string, name string, comment string, seq string, qual string"
SAM_FIELDS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "isize", "seq", "qual")
SAMPLE_FILE = r"(?i)^(.*?)(?:_R?[12])?\.(?:fastq|fq)(?:\.gz)?$"


def parse_reads(lines):
    """FASTA and FASTQ records of lines: name to the first space, comment, sequence over several lines, quality until it is as long."""
    name = comment = None
    seq, qual, state = [], [], "seq"

    def done():
        if state == "qual" and sum(map(len, qual)) != sum(map(len, seq)):
            raise ValueError(f"quality of {name} isn't as long as its sequence")
        return name, comment, "".join(seq), "".join(qual) if state == "qual" else None

    for line in lines:
        line = line.rstrip("\r\n")
        if state == "qual" and sum(map(len, qual)) < sum(map(len, seq)):
            qual.append(line)
            continue
        if line[:1] in (">", "@"):
            if name is not None:
                yield done()
            parts = line[1:].split(None, 1) if line[1:2].strip() else ["", line[1:].strip()]
            name, comment = (parts + [""])[0] if parts else "", parts[1] if len(parts) > 1 else ""
            comment, seq, qual, state = comment or None, [], [], "seq"
        elif line[:1] == "+" and name is not None and state == "seq":
            state = "qual"
        elif name is not None and state == "seq":
            seq.append(line.strip())
    if name is not None:
        yield done()


def reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTA or FASTQ files in any layout (sequences and qualities over several lines): a file is one record stream in one task.

    Files whose records have four lines, or FASTA, are split within a file by fastq() and fasta()."""
    import pandas as pd

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for b in batches:
            for f, v in zip(b["file"], b["value"]):
                rows = [(f, *r) for r in parse_reads(v.split("\n"))]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "name", "comment", "seq", "qual"])

    return whole.mapInPandas(run, READ)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, split within a file: Spark cuts at "\\n>", so a record is a row wherever a block ends."""
    rows = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    head = F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1)
    seq = F.regexp_replace(F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 1), r"\s", "")
    comment = F.trim(F.regexp_replace(head, r"^\S*", ""))
    rows = rows.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return rows.select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def _starts(lines: list[str]) -> int | None:
    """The first line of a block at which a record of four lines begins: such that it and the next, as far as they are there, are well formed."""
    for k in range(min(8, len(lines))):
        ok, j = False, k
        for _ in range(3):
            part = lines[j : j + 4]
            if len(part) < 4:
                break
            if not (part[0][:1] == "@" and part[2][:1] == "+" and len(part[1]) == len(part[3])):
                ok = False
                break
            ok, j = True, j + 4
        if ok:
            return k
    return None


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTQ files with four lines each, split within a file. Spark deals out blocks of lines; each task finds where records begin
    in its blocks, and what is left before and after, a few lines of a block, is put together file by file. A record that isn't well formed raises ValueError."""
    import pandas as pd

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    kind = f"{READ}, at long, rest string"

    def frame(file, at, records, rest):
        n = [(file, *r, None, None) for r in records] + ([(file, None, None, None, None, at, "\n".join(rest))] if rest is not None else [])
        return pd.DataFrame(n, columns=["file", "name", "comment", "seq", "qual", "at", "rest"]).astype({"at": "Int64"})

    def run(batches):
        key, held, first, tail = None, [], [], False

        def flush(last):
            """Whole records of what is held; what can't be told yet stays."""
            nonlocal held, first, tail
            records = []
            if not tail:
                at = 0 if key[1] == 0 else _starts(held)
                if at is None:
                    if not last and len(held) < 64:
                        return None
                    first, held = first + held, []
                else:
                    first, held, tail = held[:at], held[at:], True
            n = len(held) // 4 * 4
            records = list(parse_reads(held[:n])) if n else []
            held = held[n:]
            if last:
                return frame(key[0], key[1], records, None), frame(key[0], key[1], [], first + ["\0"] * bool(tail) + held)
            return (frame(key[0], key[1], records, None),)

        for b in batches:
            for file, at, line in zip(b["file"], b["at"], b["value"]):
                if (file, at) != key:
                    if key is not None:
                        yield from flush(True)
                    key, held, first, tail = (file, at), [], [], False
                held.append(line.rstrip("\r"))
                if len(held) >= 40_000:
                    yield from flush(False) or ()
        if key is not None:
            yield from flush(True)

    def joined(pdf):
        text = "\n".join(pdf.sort_values("at")["rest"]).split("\n")
        records, part = [], []
        for x in text:
            if x == "\0":  # where whole records stood
                records += list(parse_reads(part))
                part = []
            elif x or part:
                part.append(x)
        records += list(parse_reads(part))
        return pd.DataFrame([(pdf["file"].iloc[0], *r) for r in records], columns=["file", "name", "comment", "seq", "qual"])

    parts = rows.mapInPandas(run, kind)
    whole = parts.filter("rest is null").select("file", "name", "comment", "seq", "qual")
    return whole.union(parts.filter("rest is not null").select("file", "at", "rest").groupBy("file").applyInPandas(joined, READ))


def with_mate(df: DataFrame) -> DataFrame:
    """Adds mate (1 or 2, of a name's /1 or /2 or of a CASAVA comment), filtered (CASAVA's Y) and barcode (the comment's last field); null where not told."""
    casava = r"^([12]):([YN]):(\d+):(\S*)$"
    name, comment = F.regexp_extract("name", "/([12])$", 1), F.coalesce("comment", F.lit(""))
    of = lambda k: F.regexp_extract(comment, casava, k)
    mate = F.coalesce(F.when(name != "", name), F.when(of(1) != "", of(1))).cast("int")
    return df.withColumn("mate", mate).withColumn("filtered", F.when(of(2) != "", of(2) == "Y")).withColumn("barcode", F.when(of(4) != "", of(4)))


def with_sample(df: DataFrame, file: str = "file") -> DataFrame:
    """Adds the sample that a file's name tells."""
    return df.withColumn("sample", F.regexp_extract(F.element_at(F.split(F.col(file), "/"), -1), SAMPLE_FILE, 1))


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")).write.text(path)


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """A delimited table without guessing its schema (counts, depth, phenotypes, results, plot tables)."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def counts(spark, path):
    return table(spark, path, "kmer string, cnt long")


def depth(spark, path):
    return table(spark, path, "sample string, depth double")


def sample_list(spark, path):
    """The samples of a list, each once, in the order of the list."""
    rows = spark.read.text(path).select(F.trim("value").alias("sample"), F.monotonically_increasing_id().alias("at")).filter("sample <> ''")
    return rows.groupBy("sample").agg(F.min("at").alias("at")).orderBy("at").select("sample")


def samples_of(depths: DataFrame) -> DataFrame:
    """The sample list that a table of depths gives, in order of name."""
    return depths.select("sample").distinct().orderBy("sample")


def phenotypes(spark, path, column: int = 1):
    """Sample and the column-th trait of a table separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("sample"), F.get(parts, F.lit(column)).try_cast("double").alias("trait"))


def bimbam(spark, path):
    parts = F.split("value", r"\s*,\s*")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("kmer"), F.get(parts, F.lit(1)).alias("allele1"), F.get(parts, F.lit(2)).alias("allele0"), F.transform(F.slice(parts, 4, F.size(parts)), lambda x: x.try_cast("double")).alias("dosage"))


def association(spark, path):
    from ploidlens.operators.gwas import RESULT

    return table(spark, path, RESULT, header=True)


def regions(lines: DataFrame, form: str) -> DataFrame:
    """chrom, beg, end (0-based half-open) of lines (value): bed, tab (1-based, inclusive), reg (CHR:FROM-TO), vcf."""
    from ploidlens.functions.align import parse_region

    rows = lines.filter(r"value <> '' and not value like '#%' and not value rlike '^(track|browser)(\\s|$)'")
    if form == "reg":
        return rows.select(parse_region(F.trim("value"), True).alias("r")).select("r.*")
    p = F.split("value", r"\s+")
    at = lambda k: F.get(p, F.lit(k))
    n = lambda k: at(k).try_cast("long")
    if form == "bed":
        beg, end = n(1), n(2)
    elif form == "tab":
        beg, end = n(1) - 1, F.coalesce(n(2), n(1))
    elif form == "vcf":
        beg, end = n(1) - 1, n(1) - 1 + F.length(at(3))
    else:
        raise ValueError(f"unknown form {form}")
    return rows.select(at(0).alias("chrom"), beg.alias("beg"), end.alias("end"))


#: Columns of name, begin and end (from 1; 0: none), whether begin counts from 0, and the mark of comments.
PRESETS = {"gff": (1, 4, 5, False, "#"), "bed": (1, 2, 3, True, "#"), "psltbl": (15, 17, 18, True, "#"), "sam": (3, 4, 0, False, "@"), "vcf": (1, 2, 0, False, "#")}


def positioned(lines: DataFrame, preset: str | tuple[int, int, int, bool, str]) -> DataFrame:
    """chrom, beg, end (0-based half-open) and value of tab-separated lines, in a preset's columns or in others.

    Without an end column a line covers one base; sam takes the end from the CIGAR, vcf from END= or the reference allele.
    Lines that aren't positioned (comments, empty ones, no number or too few columns) go. Repeated lines stay.
    """
    from ploidlens.functions.align import end_position

    if isinstance(preset, str) and preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    name, first, last, zero, mark = PRESETS[preset] if isinstance(preset, str) else preset
    p = F.split("value", "\t")
    at = lambda k: F.get(p, F.lit(k - 1))
    beg = at(first).try_cast("long") - (0 if zero else 1)
    if preset == "sam":
        end = end_position(beg, F.coalesce(at(2).try_cast("int"), F.lit(0)), at(6))
    elif preset == "vcf":
        end = F.coalesce(F.regexp_extract(at(8), r"(?:^|;)END=(\d+)", 1).try_cast("long"), beg + F.length(at(4)))
    else:
        end = at(last).try_cast("long") if last else beg + 1
    rows = lines.filter(~F.col("value").startswith(mark)).select(at(name).alias("chrom"), beg.alias("beg"), end.alias("end"), "value")
    return rows.filter("chrom is not null and beg >= 0 and end is not null")


def write_sorted(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes rows (chrom, beg, ...) as Parquet in that order, dealt by ranges: least and greatest values of each file and row group are the index that filters on chrom and beg use."""
    by = ("chrom", "beg")
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.parquet(path)


def sam(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines (value): the fixed fields (pos 0-based) and aux, a map of tags."""
    from ploidlens.functions.align import aux_tags

    p = F.split("value", "\t")
    at = lambda k: F.get(p, F.lit(k))
    kinds = {"flag": "int", "mapq": "int", "isize": "long"}
    cols = [(at(k).try_cast("long") - 1).alias(n) if n in ("pos", "mate_pos") else at(k).try_cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(SAM_FIELDS)]
    return lines.filter("value <> '' and not value like '@%'").select(*cols, aux_tags(F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0)))).alias("aux"))


def sam_lines(df: DataFrame) -> DataFrame:
    tags = F.transform(F.map_entries("aux"), lambda e: F.concat_ws(":", e.key, e.value.type, e.value.value))
    cols = [(F.col(c) + 1).cast("string") if c in ("pos", "mate_pos") else F.col(c).cast("string") for c in SAM_FIELDS]
    return df.select(F.concat_ws("\t", *cols, F.array_sort(tags)).alias("value"))


def header(lines: DataFrame) -> DataFrame:
    """Header lines of SAM text as type and tags; find, remove and update are filters, anti joins and map functions."""
    p = F.split(F.substr("value", F.lit(2)), "\t")
    tags = F.map_from_entries(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.substr(x, F.lit(4)))))
    tags = F.when(~F.col("value").startswith("@CO"), tags).otherwise(F.create_map(F.lit("CO"), F.substr("value", F.lit(5))))
    return lines.filter("value like '@%'").select(F.get(p, F.lit(0)).alias("type"), tags.alias("tags"))


def header_lines(rows: DataFrame) -> DataFrame:
    """Lines of a header (type, tags)."""
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e.key, e.value))
    return rows.select(F.when(F.col("type") == "CO", F.concat(F.lit("@CO\t"), F.element_at("tags", "CO"))).otherwise(F.concat_ws("\t", F.concat(F.lit("@"), "type"), F.array_join(tags, "\t"))).alias("value"))


def header_find(rows: DataFrame, kind: str, tag: str, value: str) -> DataFrame:
    return rows.filter((F.col("type") == kind) & (F.try_element_at("tags", F.lit(tag)) == value))


def header_remove(rows: DataFrame, kind: str, tag: str | None = None, value: str | None = None) -> DataFrame:
    """Without lines of a type (with a tag of a value)."""
    hit = F.col("type") == kind
    if tag is not None:
        hit = hit & F.coalesce(F.try_element_at("tags", F.lit(tag)) == value, F.lit(False))
    return rows.filter(~hit)


def header_update(rows: DataFrame, kind: str, tag: str, value: str, **tags: str) -> DataFrame:
    """With tags set on lines of a type whose tag has a value; a tag given as None goes."""
    from ploidlens.functions.align import without_tag

    new = F.col("tags")
    for k, v in tags.items():
        new = without_tag(new, k)
        new = new if v is None else F.map_concat(new, F.create_map(F.lit(k), F.lit(v)))
    return rows.withColumn("tags", F.when((F.col("type") == kind) & (F.try_element_at("tags", F.lit(tag)) == value), new).otherwise(F.col("tags")))


def write_header(rows: DataFrame, records: DataFrame, path: str) -> None:
    """A header's lines, then records' lines, as text files in a folder: 0-header and records."""
    header_lines(rows).coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    sam_lines(records).write.mode("overwrite").text(f"{path}/records")


def vcf(lines: DataFrame) -> DataFrame:
    """Sites of VCF lines: chrom, pos (0-based), id, ref, alt, filter."""
    p = F.split("value", "\t")
    at = lambda k: F.get(p, F.lit(k))
    return lines.filter("value <> '' and not value like '#%'").select(at(0).alias("chrom"), (at(1).try_cast("long") - 1).alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alt"), F.split(at(6), ";").alias("filter"))


FORMATS = {"fasta": ("fa", "fasta", "fna"), "fastq": ("fq", "fastq"), "sam": ("sam",), "bed": ("bed",), "vcf": ("vcf",), "bimbam": ("bimbam",)}
UNSUPPORTED = ("bam", "cram", "bcf", "bai", "crai", "csi", "tbi", "gzi", "fai", "d4", "crypt4gh")


def detect(path: str) -> str:
    """The format of a path by its extension; formats that aren't read raise ValueError."""
    m = re.search(r"\.([a-z0-9]+)(?:\.(?:gz|bgz|bz2|zst|xz))?$", path.lower())
    ext = m[1] if m else ""
    for f, names in FORMATS.items():
        if ext in names:
            return f
    raise ValueError(f"{ext or path}: {'not supported' if ext in UNSUPPORTED else 'unknown format'}")
