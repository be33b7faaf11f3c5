"""Base modifications of reads, told by the tags MM, ML and MN of alignments.

MM lists, for each base and strand, how many bases of that kind are skipped before each modified one, in the
direction the read was sequenced; ML has a probability (0 to 255) for each; MN is the length of the sequence
they were made for. Mm and Ml stand in for tags that are missing. Records without MM (or with a null or *
sequence) have no modifications; neither have malformed ones: unknown groups, more skips than bases, an ML of
another length, an MN that isn't the sequence's length. Repeated records are read each. Empty table: no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.functions import align

#: Values of qual for a modification without a probability, and for a base that wasn't looked at.
UNKNOWN, UNCHECKED = -1, -2
GROUP = re.compile(r"([ACGTUN])([-+])([a-z]+|[0-9]+)([.?]?)((?:,[0-9]+)*)")
COMPLEMENT = str.maketrans("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")
FOUND = "array<struct<qpos:bigint,canonical:string,strand:string,code:string,qual:int,implicit:boolean>>"


def groups(mm: str) -> list[tuple[str, str, list[str], bool, np.ndarray]] | None:
    """Canonical base, strand, codes, whether bases not listed are unmodified, and skips of each group; None if malformed."""
    out = []
    for part in filter(None, mm.split(";")):
        m = GROUP.fullmatch(part)
        if not m:
            return None
        base, strand, code, mark, skips = m.groups()
        out.append((base, strand, [code] if code.isdigit() else list(code), mark != "?", np.array(skips.split(",")[1:], np.int64)))
    return out


def modified(seq: str, reverse: bool, mm: str, ml: list[float] | None, unchecked: bool = False) -> list[tuple]:
    """(qpos, canonical, strand, code, qual, implicit) by place in the sequence as it is stored; linear in the sequence."""
    seq, found = seq.upper(), groups(mm)
    read = seq.translate(COMPLEMENT)[::-1] if reverse else seq
    letters = np.frombuffer(read.replace("U", "T").encode("ascii", "replace"), np.uint8)
    out, used = [], 0
    for base, strand, codes, implicit, skips in found or []:
        there = np.arange(len(letters)) if base == "N" else np.flatnonzero(letters == ord(base.replace("U", "T")))
        nth = np.cumsum(skips + 1) - 1
        n = len(nth) * len(codes)
        if len(nth) and nth[-1] >= len(there) or ml is not None and used + n > len(ml):
            return []
        rest = np.delete(there, nth) if unchecked and not implicit else there[:0]
        for at, each in ((there[nth], True), (rest, False)):
            at = len(letters) - 1 - at if reverse else at
            for k, code in enumerate(codes):
                qual = np.full(len(at), UNKNOWN if each else UNCHECKED) if ml is None or not each else np.array(ml[used + k : used + n : len(codes)], int)
                out += [(q, base, strand, code, v, implicit) for q, v in zip(at.tolist(), qual.tolist())]
        used += n
    return sorted(out) if ml is None or used == len(ml) else []


def _modified(unchecked: bool):
    def run(seq: pd.Series, reverse: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.Series:
        return pd.Series([modified(s, r, m, None if p is None else list(p), unchecked) for s, r, m, p in zip(seq, reverse, mm, ml)])

    return F.pandas_udf(run, FOUND)


def _tagged(records: DataFrame) -> DataFrame:
    mm = F.coalesce(align.tag_value(F.col("aux"), "MM"), align.tag_value(F.col("aux"), "Mm"))
    ml = F.coalesce(align.tag_array(F.col("aux"), "ML"), align.tag_array(F.col("aux"), "Ml"))
    rows = records.withColumn("__mm", mm).filter("__mm <> '' and seq <> '*'")
    return rows.withColumn("__ml", ml).filter(F.coalesce(align.tag_number(F.col("aux"), "MN") == F.length("seq"), F.lit(True)))


def base_modifications(records: DataFrame, unchecked: bool = False) -> DataFrame:
    """One row for each modification: qname, flag, qpos (0-based), canonical, strand, code (a letter or ChEBI number), qual, implicit.

    With unchecked, also the bases that groups marked ? don't list, with qual UNCHECKED.
    """
    rows = _tagged(records)
    reverse = F.coalesce(align.has_flag(F.col("flag"), "REVERSE"), F.lit(False))
    found = _modified(unchecked)("seq", reverse, "__mm", "__ml")
    return rows.select("qname", "flag", F.explode(found).alias("m")).select("qname", "flag", "m.*")


def modification_kinds(records: DataFrame) -> DataFrame:
    """The groups of each record's MM tag: qname, flag, canonical, strand, codes (a letter or a number each), implicit."""
    part = F.regexp_extract_all("__mm", F.lit(r"([ACGTUN][-+](?:[a-z]+|[0-9]+)[.?]?)(?=[,;]|$)"), 1)
    rows = _tagged(records).select("qname", "flag", F.explode(part).alias("p"))
    code = F.regexp_extract("p", "[a-z]+|[0-9]+", 0)
    codes = F.when(code.rlike("^[0-9]"), F.array(code)).otherwise(F.filter(F.split(code, ""), lambda x: x != ""))
    return rows.select("qname", "flag", F.substring("p", 1, 1).alias("canonical"), F.substring("p", 2, 1).alias("strand"), codes.alias("codes"), (~F.col("p").endswith("?")).alias("implicit"))
