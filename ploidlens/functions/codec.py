"""k-mer codec: 2-bit codes, reverse complement, canonical form, windows. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a chunk: substring() scans from the start of a string, so windows are cut from short chunks.
CHUNK = 200


def bases(seq: Column, n_as_a: bool = False) -> Column:
    """Upper case, U as T; with n_as_a every other letter as A."""
    s = F.translate(F.upper(seq), "U", "T")
    return F.regexp_replace(s, "[^ACGT]", "A") if n_as_a else s


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(s, reverse_complement(s))


def encode(s: Column) -> Column:
    """The packed code (A 0, C 1, G 2, T 3) of a k-mer of at most 31 letters; null if it has another letter."""
    return F.when(s.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def windows(s: Column, k: int) -> Column:
    """All k-mers of a short string (an array; empty if it is shorter than k)."""
    n = F.length(s) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(s, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def chunks(s: Column, k: int, size: int = CHUNK) -> Column:
    """Pieces of a string whose k-mers, together, are those of the string."""
    n = F.length(s) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n, F.lit(size)), lambda i: F.substring(s, i + 1, F.lit(size + k - 1)))).otherwise(F.array().cast("array<string>"))


def _shifted(n: int):
    return lambda v: v.bitwiseXOR(F.shiftright(v, n))


def mixed_hash(x: Column, bits: int) -> Column:
    """An invertible mix of a code of at most 31 * 2 bits; each addend is masked, so nothing overflows."""
    mask = (1 << bits) - 1

    def add(a: Column, b: Column) -> Column:  # a + b modulo 2 ** bits, in halves
        half = bits // 2
        low = a.bitwiseAND(F.lit((1 << half) - 1)) + b.bitwiseAND(F.lit((1 << half) - 1))
        high = F.shiftright(a, half) + F.shiftright(b, half) + F.shiftright(low, half)
        return F.shiftleft(high.bitwiseAND(F.lit((1 << (bits - half)) - 1)), half).bitwiseOR(low.bitwiseAND(F.lit((1 << half) - 1)))

    def left(a: Column, n: int) -> Column:
        return F.shiftleft(a, n).bitwiseAND(F.lit(mask))

    def then(x: Column, step) -> Column:  # step(x), with x computed once
        return F.get(F.transform(F.array(x), step), F.lit(0))

    x = then(x, lambda v: add(F.bitwise_not(v).bitwiseAND(F.lit(mask)), left(v, 21)))
    for right, first, second in ((24, 3, 8), (14, 2, 4)):
        x = then(x, _shifted(right))
        x = then(x, lambda v: F.struct(v.alias("v"), add(v, left(v, first)).alias("w")))  # noqa: B023 (called at once)
        x = then(x, lambda e: add(e.w, left(e.v, second)))  # noqa: B023
    x = then(x, _shifted(28))
    return then(x, lambda v: add(v, left(v, 31)))
