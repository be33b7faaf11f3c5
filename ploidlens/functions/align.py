"""Alignment and region scalars: CIGAR, flags, auxiliary tags, numbers, regions, bins. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of flag bits, from the lowest; operations that use the query and the reference.
FLAGS = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def flag_text(flag: Column) -> Column:
    names = F.array(*[F.when(has_flag(flag, n), F.lit(n)) for n in FLAGS])
    return F.array_join(F.array_compact(names), ",")


def flag_value(text: Column) -> Column:
    """Of names joined by commas, or a number: decimal, hexadecimal (0x) or octal (0). Null if a name isn't known."""
    t = F.trim(text)
    parts = F.split(F.upper(t), ",")
    named = sum((F.when(F.array_contains(parts, n), 1 << k).otherwise(0) for k, n in enumerate(FLAGS)), F.lit(0))
    hexa, octal = F.conv(F.substr(t, F.lit(3)), 16, 10), F.conv(t, 8, 10)
    number = F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexa).when(t.rlike("^0[0-7]+$"), octal).when(t.rlike("^[0-9]+$"), t)
    known = F.size(F.array_except(parts, F.array(*[F.lit(n) for n in FLAGS]))) == 0
    return F.coalesce(number.try_cast("int"), F.when(known, named))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>; empty for * and null."""
    text = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=XB])"), 1)
    return F.transform(text, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("len"), F.right(x, F.lit(1)).alias("op")))


def _length(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x.op.isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x.len)


def query_length(cigar: Column) -> Column:
    return _length(cigar, QUERY_OPS)


def reference_length(cigar: Column) -> Column:
    return _length(cigar, REFERENCE_OPS)


def end_position(pos: Column, flag: Column, cigar: Column) -> Column:
    """The first base after the alignment; pos + 1 if unmapped or without reference bases."""
    n = reference_length(cigar)
    return pos + F.when(has_flag(flag, "UNMAP") | (n == 0), 1).otherwise(n)


def aux_tags(fields: Column) -> Column:
    """map tag -> struct<type, value> of an array of TAG:TYPE:VALUE; of a tag given twice the first."""
    ok = F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    names = F.transform(ok, lambda x: F.substring(x, 1, 2))
    once = F.filter(F.transform(ok, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: F.array_position(names, F.substring(e.x, 1, 2)) == e.i + 1)
    return F.map_from_entries(F.transform(once, lambda e: F.struct(F.substring(e.x, 1, 2), F.struct(F.substring(e.x, 4, 1).alias("type"), F.substr(e.x, F.lit(6)).alias("value")))))


def tag_value(aux: Column, tag: str) -> Column:
    """The text of a tag, or null."""
    return F.try_element_at(aux, F.lit(tag)).value


def tag_number(aux: Column, tag: str) -> Column:
    """The number of a tag of type i or f, else null."""
    t = F.try_element_at(aux, F.lit(tag))
    return F.when(t.type.isin("i", "f"), t.value.try_cast("double"))


def tag_array(aux: Column, tag: str) -> Column:
    """The elements of a tag of type B as doubles, else null."""
    t = F.try_element_at(aux, F.lit(tag))
    parts = F.split(t.value, ",")
    return F.when(t.type == "B", F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double")))


def with_tag(aux: Column, tag: str, kind: str, value: Column) -> Column:
    """aux with a tag set, in place of one of its name."""
    own = F.create_map(F.lit(tag), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.when(aux.isNull(), own).otherwise(F.map_concat(without_tag(aux, tag), own))


def without_tag(aux: Column, tag: str) -> Column:
    return F.map_filter(aux, lambda k, v: k != tag)


#: Codes 0 to 15 of letters that stand for sets of bases, as bits A 1, C 2, G 4, T 8.
NT16 = "=ACMGRSVTWYHKDBN"


def nt16_code(base: Column) -> Column:
    """The code of a letter (upper or lower case; U as T; others as N)."""
    at = F.instr(F.lit(NT16), F.translate(F.upper(base), "U", "T")) - 1
    return F.when(at >= 0, at).otherwise(15)


def nt16_letter(code: Column) -> Column:
    return F.substr(F.lit(NT16), code + 1, F.lit(1))


def nt16_int(code: Column) -> Column:
    """0 to 3 of a code that is one base, else 4."""
    return F.when(code.isin(1, 2, 4, 8), F.log2(code.cast("double")).cast("int")).otherwise(4)


def base_at(seq: Column, at: Column) -> Column:
    return F.substr(seq, (at + 1).cast("int"), F.lit(1))


def with_base(seq: Column, at: Column, base: Column) -> Column:
    return F.overlay(seq, base, (at + 1).cast("int"), 1)


def parse_number(text: Column) -> Column:
    """A whole number with thousands separators, an exponent or a suffix k, M or G; null if there is none."""
    t = F.regexp_replace(F.trim(text), ",", "")
    m = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)([kKmMgG]?)"
    unit = F.lower(F.regexp_extract(t, m, 2))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return (F.regexp_extract(t, m, 1).try_cast("double") * scale).cast("long")


def parse_region(text: Column, one_base: bool = False) -> Column:
    """REF, REF:, REF:a, REF:-b, REF:a-b and {REF}:..., 1-based inclusive, as struct<chrom, beg, end>, 0-based half-open.

    REF:a runs to the end, or is one base if one_base. "." is everything (null chrom), "*" the unplaced (chrom *).
    """
    m = r"^(?:\{([^}]*)\}|(.*?))(?::([\d,.eEkKmMgG+]*)(-?)([\d,.eEkKmMgG+]*))?$"
    part = lambda k: F.regexp_extract(text, m, k)
    name = F.when(part(1) != "", part(1)).otherwise(part(2))
    beg, dash, end = part(3), part(4), part(5)
    last = F.lit((1 << 62)).cast("long")
    first = F.when(beg != "", parse_number(beg) - 1).otherwise(0).cast("long")
    stop = F.when(end != "", parse_number(end)).when((dash == "") & (beg != "") & F.lit(one_base), parse_number(beg)).otherwise(last)
    return F.struct(F.when(name != ".", name).alias("chrom"), F.greatest(first, F.lit(0).cast("long")).alias("beg"), stop.alias("end"))


def clamp_region(beg: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Half-open bounds within a sequence."""
    low = F.least(F.greatest(beg, F.lit(0)), length)
    return low, F.greatest(F.least(end, length), low)


def bin_number(beg: Column, end: Column, shift: int = 14, depth: int = 5) -> Column:
    """The smallest bin of a binning index that holds [beg, end)."""
    out = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        s = shift + 3 * (depth - level)
        out = F.when(F.shiftright(beg, s) == F.shiftright(end - 1, s), F.lit(((1 << 3 * level) - 1) // 7).cast("long") + F.shiftright(beg, s)).otherwise(out)
    return out


def power_of_two(x: Column) -> Column:
    """The smallest power of two that is no less than x (x >= 1)."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("long")


def bin_level(number: Column, depth: int = 5) -> Column:
    """The level of a bin: 0 for the one that holds all."""
    out = F.lit(0)
    for level in range(1, depth + 1):
        out = F.when(number >= ((1 << 3 * level) - 1) // 7, level).otherwise(out)
    return out


def bin_parent(number: Column) -> Column:
    return F.when(number > 0, F.shiftright(number - 1, 3))


def bin_end(shift: int = 14, depth: int = 5) -> int:
    """The largest position that an index of this shape can hold."""
    return 1 << shift + 3 * depth


def x31_hash(text: Column) -> Column:
    """The string hash h = 31 h + byte, in 32 unsigned bits, begun with the first byte; ASCII text."""
    letters = F.split(text, "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)) % (1 << 32))
