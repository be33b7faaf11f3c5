"""Quality rules, the last of which is n-gram perplexity under a modified Kneser-Ney model.

The model is one of the characters (code points) of all texts, of order 5. Spark counts all 5-grams, each
task adding up its own first; lower orders have continuation counts. All discounts, context sums and
probabilities are DataFrame aggregations and joins over the distinct n-grams, whose number has no limit but the
corpus. As every text is counted, every n-gram that is looked up is in the model, with the log probability that
interpolation with all lower orders gives it, in millionths.

For scoring, the model is kept in arrays sorted by the n-grams' 64-bit hashes. Up to SMALL n-grams (96 MB)
these go to all tasks; a larger model stays a table that the documents' n-grams are joined with. Both give the
same sums, which are of whole numbers.

A document is rejected if a base rule fails or its log perplexity lies outside its language's band:
from q1 - width * s to q3 + width * s, with exact quartiles (in steps of a thousandth) of all the language's distinct texts that pass the base
rules, each counted once however many copies there are; s is q3 - q1, or SPREAD if that is more, so that
near copies of one text can't narrow the band to themselves. The counts, too, take a text that has over
one in HEAVY rows (so there are fewer than HEAVY such texts) once, else its copies would make it an
outlier. A null lang is a language of its own.

Null texts: no words, base_failed. Repeated rows and ids: judged each. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.llm import common as C

ORDER, WIDTH = 5, 3.0
#: The least spread of a band.
SPREAD = 0.025
HEAVY = 1000
#: Distinct n-grams of the largest model that goes to all tasks (12 bytes each), and languages of the bands that do.
SMALL, LANGUAGES = 8_000_000, 100_000
#: Distinct n-grams that a task holds before it passes them on.
HELD = 1_000_000
UNIT = 1e-6
SYMBOL = re.compile(r"[#*$%&|<>]")
U64 = np.uint64


def codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, each between order - 1 spaces and one, and where its n-grams begin (each text's length and one of them)."""
    pad = " " * (order - 1)
    flat = np.frombuffer("".join(f"{pad}{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    at = np.arange(int((size + 1).sum())) + np.repeat(np.arange(len(texts)) * (order - 1), size + 1)
    return flat, at


def hashes(flat: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """64-bit hashes of the n-grams of code points that begin at the places."""
    there = np.flatnonzero(np.bincount(flat, minlength=1))
    value = np.zeros(int(flat.max()) + 1 if len(flat) else 1, U64)
    value[there] = C.mix(there.astype(U64) + U64(0x9E3779B97F4A7C15))
    v, h = value[flat], np.zeros(max(0, len(flat) - order + 1), U64)
    for k in range(order):
        h = h * U64(0xD6E8FEB86659FD93) + v[k : len(flat) - order + 1 + k]
    return C.mix(h)[at]


def distinct(flat: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams: hashes, a place of each, and counts."""
    there = np.bincount(flat, minlength=1) > 0
    number, bits = np.cumsum(there) - 1, int(there.sum()).bit_length()
    if bits * order <= 64:  # packed: cheaper to sort, and unpacked again
        x, key = number[flat].astype(U64), np.zeros(len(flat) - order + 1, U64)
        for k in range(order):
            key = key << U64(bits) | x[k : len(flat) - order + 1 + k]
        key, count = np.unique(key[at], return_counts=True)
        point = np.flatnonzero(there).astype(np.uint32)
        gram = np.stack([point[(key >> U64(bits * (order - 1 - k)) & U64((1 << bits) - 1)).astype(np.int64)] for k in range(order)], 1)
    else:
        _, one, count = np.unique(hashes(flat, at, order), return_index=True, return_counts=True)
        gram = flat[at[one][:, None] + np.arange(order)]
    return hashes(gram.ravel(), np.arange(len(gram)) * order, order), gram, count


def heavy(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How many rows have each text (by hash) that is more than one in HEAVY of all."""
    rows = docs.filter(F.length(text_col) > 0).groupBy(F.xxhash64(text_col).alias("h")).count().cache()
    total = rows.agg(F.sum("count")).first()[0] or 0
    out = {r["h"]: r["count"] for r in rows.filter((F.col("count") > 1) & (F.col("count") * HEAVY > total)).collect()}  # fewer than HEAVY rows
    rows.unpersist()
    return out


def count_grams(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(h, gram, c) of all texts, heavy ones once: hash, three bytes of each code point, and count. Each task adds up its own first."""
    copies = heavy(docs, text_col)

    def rows(held):
        h, gram, c = (np.concatenate(x) for x in zip(*held))
        _, one, at = np.unique(h, return_index=True, return_inverse=True)
        h, gram, c = h[one], gram[one], np.bincount(at, c)
        return [h, gram, c]

    def out(h, gram, c):
        raw = np.ascontiguousarray(gram.astype("<u4").view(np.uint8).reshape(len(gram), order, 4)[:, :, 2::-1]).tobytes()
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * order), len(gram), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pa.record_batch([pa.array(h.view(np.int64)), raw, pa.array(c.astype(float))], ["h", "gram", "c"])

    def run(batches):
        held, shared = [], Counter()
        for b in C.slices(batches, 0):
            texts = []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and h not in copies:
                    texts.append(t)
                elif t:
                    shared[h, t] += 1
            if texts:
                held.append(distinct(*codes(texts, order), order))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [rows(held)]
                    if len(held[0][0]) > HELD:
                        yield out(*held.pop())
        for (h, t), k in shared.items():
            x = distinct(*codes([t], order), order)
            held.append((x[0], x[1], x[2] * (k / copies[h])))
        if held:
            yield out(*rows(held))

    got = docs.select(text_col, F.xxhash64(text_col)).mapInArrow(C.released(run), "h long, gram binary, c double")
    return got.groupBy("h", "gram").agg(F.greatest(F.lit(1), F.round(F.sum("c"))).cast("long").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4; within bounds where these are too few."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return [min(max(x, 0.05), most) for x, most in zip(d, (0.95, 1.9, 2.85))]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(h, lp) of the n-grams counted: log probability of the last character after the others, in UNIT."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: how many characters precede
        levels[k] = levels[k + 1].groupBy(F.substring("gram", 4, 3 * k).alias("gram")).agg(F.count("*").alias("c"))
    p = None
    for k in range(1, order + 1):
        t = levels[k]
        d = discounts(*t.agg(*(F.count_if(F.col("c") == j) for j in (1, 2, 3, 4))).first())
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = Window.partitionBy(F.substring("gram", 1, 3 * (k - 1)))  # as many rows as there are characters at most
        t = t.withColumn("taken", taken).select("*", F.sum("c").over(context).alias("total"), F.sum("taken").over(context).alias("left"), F.count("*").over(Window.partitionBy()).alias("v") if k == 1 else F.lit(0).alias("v"))
        own = (F.col("c") - F.col("taken")) / F.col("total")
        back = F.col("left") / F.col("total")
        if k == 1:
            p = t.select("gram", (own + back / F.col("v")).alias("p"))
        else:
            low = p.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
            t = t.join(low, F.substring("gram", 4, 3 * (k - 1)) == F.col("suffix"))
            p = t.select(*(["h"] if k == order else ["gram"]), (own + back * F.col("low")).alias("p"))
    return p.select("h", F.round(F.log("p") / UNIT).cast("int").alias("lp"))


class Sorted:
    """Arrays of hashes, ascending, and of values; a table of where each first bits begin makes look-ups short."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        o = np.argsort(h)
        self.h, self.value = np.append(h[o], ~U64(0)), np.append(value[o], 0).astype(np.int32)
        self.bits = max(1, len(h).bit_length() + 1)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes that are there."""
        if not hasattr(self, "first"):
            self.first = np.searchsorted(self.h[:-1], np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)
        at = self.first[(h >> U64(64 - self.bits)).astype(np.int64)]
        k = np.flatnonzero(self.h[at] < h)
        while len(k):
            at[k] += 1
            k = k[self.h[at[k]] < h[k]]
        return self.value[at]


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(t) - sum(t.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        flat = np.empty(n, object)
        flat[:] = words
        code, uniq = pd.factorize(flat)
        u = len(uniq)
        if u > 2_000_000:  # three codes no longer fit into 63 bits
            pair = pd.factorize(code[:-1] * u + code[1:])[0]
            key = pair[:-1] * u + code[2:]
        else:
            key = (code[:-2] * u + code[1:-1]) * u + code[2:]
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        if same.any():
            twice = np.zeros(len(key), bool)
            twice[o[1:][same]] = True
            twice[o[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= twice
            repeats = int(cover.sum())
    return n, chars, len(SYMBOL.findall(t)), len(lines) - len(set(lines)), repeats


def _scored(docs: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    """Rows (row, text) with total: the sum of log probabilities of the text's n-grams; null for null and empty texts."""
    if model.count() > SMALL:
        return _joined(docs, model)
    got = model.toArrow()  # at most SMALL rows
    held = docs.sparkSession.sparkContext.broadcast(Sorted(got.column("h").to_numpy().view(U64), got.column("lp").to_numpy()) if got.num_rows else None)

    def run(batches):
        for b in C.slices(batches):
            texts = b.column(1).to_pylist()
            have = [t for t in texts if t]
            total = iter(np.add.reduceat(held.value.look_up(hashes(*codes(have))).astype(np.int64), np.cumsum([0] + [len(t) + 1 for t in have[:-1]])).tolist() if have else [])
            yield _measured(b, texts, [next(total) if t else None for t in texts])

    return docs.mapInArrow(C.released(run), _kind(docs))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _kind(docs: DataFrame) -> str:
    return f"row {docs.schema['row'].dataType.simpleString()}, key string, h long, {', '.join(f'{n} long' for n in NAMES)}, size long, total long"


def _measured(b, texts, total) -> pa.RecordBatch:
    found = [base_features(t) for t in texts]
    cols = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(NAMES))]
    return pa.record_batch([b.column(0), b.column(2), b.column(3), *cols, pa.array([len(t) + 1 if t else None for t in texts], pa.int64()), pa.array(total, pa.int64())], ["row", "key", "h", *NAMES, "size", "total"])


def _joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same, the model being a table that n-grams of documents are joined with."""
    rows = C.staged(docs.withColumn("id", F.monotonically_increasing_id()), "rows")

    def grams(batches):
        for b in C.slices(batches):
            for t, k in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                if t:
                    h, n = np.unique(hashes(*codes([t])), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64)), pa.array(n)], ["id", "h", "n"])

    def run(batches):
        for b in C.slices(batches):
            yield _measured(b, b.column(1).to_pylist(), b.column(4))

    sums = rows.mapInArrow(C.released(grams), "id long, h long, n long").join(model, "h").groupBy("id").agg(F.sum(F.col("n") * F.col("lp")).alias("total"))
    return rows.join(sums, "id", "left").select("row", "text", "key", "h", "total").mapInArrow(C.released(run), _kind(docs))


def judged(docs: DataFrame, width: float = WIDTH, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Rows of docs (the columns to carry, all by default) as the struct `row`, with the base features, base_failed, log_perplexity, band_low, band_high and kept."""
    counts = C.staged(count_grams(docs, text_col), "grams")
    model = C.staged(kneser_ney(counts), "model")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), key.alias("key"), F.xxhash64(f"`{text_col}`").alias("h"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = _scored(rows, model, text_col).withColumn("base_failed", failed).withColumn("log_perplexity", -F.col("total") * UNIT / F.col("size"))
    scored = C.staged(scored.drop("total", "size"), "scored")
    once = scored.filter("not base_failed and log_perplexity is not null").groupBy("key", "h").agg(F.max("log_perplexity").alias("x"))
    steps = once.groupBy("key", F.floor(F.col("x") * 1000).alias("step")).agg(F.count("*").alias("n"))  # some thousand steps a language
    by, all_ = Window.partitionBy("key").orderBy("step"), Window.partitionBy("key")
    steps = steps.select("key", "step", F.sum("n").over(by).alias("upto"), F.sum("n").over(all_).alias("all"))
    low, high = (F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("step"))) / 1000 for k in (1, 3))
    q = steps.groupBy("key").agg(low.alias("low"), high.alias("high"))
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(SPREAD))
    bands = C.staged(q.select("key", (F.col("low") - width * spread).alias("band_low"), (F.col("high") + width * spread).alias("band_high")), "bands")
    if bands.count() <= LANGUAGES:
        bands = F.broadcast(bands)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    C.dropped(counts, model)
    return scored.join(bands, "key", "left").withColumn("kept", kept).drop("key", "h")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = judged(C.documents(spark, sf_dir), carry=["doc_id"])
    return rows.select("row.doc_id", *NAMES, "base_failed", "log_perplexity", "band_low", "band_high", "kept")
