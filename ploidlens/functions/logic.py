"""Three-state filter logic: comparisons with an unknown (null or NaN) fail, and not unknown is true."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """x, or null where it is NaN."""
    return F.when(~F.coalesce(F.isnan(x.try_cast("double")), F.lit(False)), x)


def compare(a: Column, op: str, b: Column) -> Column:
    """a op b for < <= > >= == !=; false if either is unknown (null or NaN)."""
    a, b = known(a), known(b)
    got = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.coalesce(got, F.lit(False))


def truth(x: Column) -> Column:
    """Unknown is false; so are 0 and the empty string."""
    return F.coalesce(F.when(x.try_cast("double").isNotNull(), x.try_cast("double") != 0).otherwise(F.coalesce(x.try_cast("boolean"), x.cast("string") != "")), F.lit(False))


def negate(x: Column) -> Column:
    return ~truth(x)


def either(a: Column, b: Column) -> Column:
    return truth(a) | truth(b)


def both(a: Column, b: Column) -> Column:
    return truth(a) & truth(b)


TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"((?:[^"\\]|\\.)*)"|\[([A-Za-z][A-Za-z0-9])\]|([A-Za-z_][A-Za-z0-9_.]*)|(&&|\|\||==|!=|<=|>=|=~|!~|[-+*/%<>!()&|^~,]))""")
#: Binary operators, those that bind least first.
LEVELS = (("||",), ("&&",), ("==", "!=", "=~", "!~"), ("<", "<=", ">", ">="), ("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%"))


class _ById:
    """What is known of a column, which can be neither compared nor hashed."""

    def __init__(self):
        self.held: dict[int, tuple[Column, Column]] = {}

    def __setitem__(self, key: Column, value: Column) -> None:
        self.held[id(key)] = key, value

    def __contains__(self, key: Column) -> bool:
        return id(key) in self.held

    def get(self, key: Column, other: Column) -> Column:
        return self.held[id(key)][1] if id(key) in self.held else other


def parse(text: str, name: Callable[[str], Column], tag: Callable[[str], tuple[Column, Column]]) -> Column:
    """A filter expression as a Column: numbers, "strings", names, [TAG]; || && == != =~ !~ < <= > >= | ^ & + - * / % ! - ~; exists(x), length(x), default(x, y).

    name gives the column of a symbol, tag that of a tag as number and as text (used beside strings). Comparisons with an unknown are false, arithmetic with one is unknown, and
    unknown is false in !, && and ||. Malformed text raises ValueError."""
    tokens, at, texts, tags = [], 0, _ById(), _ById()
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:]!r}")
        kind = next(k for k in range(1, 6) if m[k] is not None)
        tokens.append((kind, m[kind]))
        at = m.end()
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else (0, "")

    def take(want=None):
        nonlocal place
        got = peek()
        if want is not None and got != (5, want) or not got[0]:
            raise ValueError(f"{want or 'a value'} expected in {text!r}")
        place += 1
        return got

    def value() -> Column:
        kind, x = take()
        if kind == 1:
            return F.lit(float(x)) if re.search("[.eE]", x) else F.lit(int(x))
        if kind == 2:
            got = F.lit(re.sub(r"\\(.)", r"\1", x))
            texts[got] = got
            return got
        if kind == 3:
            number, as_text = tag(x)
            tags[number] = as_text
            return number
        if kind == 4:
            if peek() != (5, "("):
                return name(x)
            take("(")
            args = [binary(0)]
            while peek() == (5, ","):
                take(",")
                args.append(binary(0))
            take(")")
            if (x, len(args)) not in (("exists", 1), ("length", 1), ("default", 2)):
                raise ValueError(f"unknown function {x} of {len(args)}")
            return tags.get(args[0], args[0]).isNotNull() if x == "exists" else F.length(tags.get(args[0], args[0]).cast("string")) if x == "length" else F.coalesce(*args)
        if x == "(":
            got = binary(0)
            take(")")
            return got
        if x == "!":
            return negate(value())
        if x == "-":
            return -value()
        if x == "~":
            return F.bitwise_not(value().cast("long"))
        raise ValueError(f"unexpected {x} in {text!r}")

    def binary(level: int) -> Column:
        if level == len(LEVELS):
            return value()
        left = binary(level + 1)
        while peek()[0] == 5 and peek()[1] in LEVELS[level]:
            op = take()[1]
            right = binary(level + 1)
            if op in ("=~", "!~") or right in texts or left in texts:
                left, right = tags.get(left, left), tags.get(right, right)
            left = _apply(op, left, right)
        return left

    out = binary(0)
    if place < len(tokens):
        raise ValueError(f"unexpected {peek()[1]} in {text!r}")
    return out


def _apply(op: str, a: Column, b: Column) -> Column:
    if op in ("||", "&&"):
        return either(a, b) if op == "||" else both(a, b)
    if op in ("=~", "!~"):
        hit = F.regexp_like(a, b)
        return F.coalesce(hit if op == "=~" else ~hit, F.lit(False))
    if op in ("|", "^", "&"):
        x, y = a.cast("long"), b.cast("long")
        return {"|": x.bitwiseOR, "^": x.bitwiseXOR, "&": x.bitwiseAND}[op](y)
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op in ("/", "%"):
        return F.try_divide(a, b) if op == "/" else F.when(b != 0, a % b)
    return compare(a, op, b)


def record_filter(text: str) -> Column:
    """parse() over the columns of alignment records: qname, flag, rname or chrom, pos (1-based), mapq, cigar, rlen, qlen, seq, qual, flag.NAME and [TAG]."""
    from ploidlens.functions import align

    def name(x: str) -> Column:
        if x.startswith("flag.") and x[5:].upper() in align.FLAGS:
            return align.has_flag(F.col("flag"), x[5:].upper())
        if x == "pos":
            return F.col("pos") + 1
        if x in ("rlen", "qlen"):
            return (align.reference_length if x == "rlen" else align.query_length)(F.col("cigar"))
        if x in ("qname", "flag", "mapq", "cigar", "seq", "qual", "chrom", "isize"):
            return F.col(x)
        if x == "rname":
            return F.col("chrom")
        raise ValueError(f"unknown name {x}")

    def tag(x: str) -> tuple[Column, Column]:
        return align.tag_value(F.col("aux"), x).try_cast("double"), align.tag_value(F.col("aux"), x)

    return truth(parse(text, name, tag))
