"""Language of each word, and of each text, by a linear-chain conditional random field.

Features of a word: itself (a learned lexicon), prefixes and suffixes of one to three letters, and
letter bigrams and trigrams with its ends; all hashed into one table of weights for each language.
Learned transitions join neighbouring words, so that code-switched text is labelled stretch by
stretch. Forward-backward gives each word's probabilities; a text's language is the one with the
largest sum, its score that sum's share.

Fitting: the weights, transitions and starts are learned by stochastic gradient on sequences made of stretches
of several documents; the gradient is what is there less what forward-backward expects, of words and of pairs of
neighbours. The documents are a bounded sample of labelled rows: of each language PER_LANG different texts
(those with the smallest hashes), TOTAL in all, whole. Prediction
uses all words of whole texts. Sums over long texts run in blocks of words, by products of transition
matrices, so a long text costs no more a word than a short one.

Words are runs of letters, lowered. A run of over 24 letters becomes successive words of at most 24, each
with the last two letters of the one before, so that all letter trigrams count. Texts that are null or have no letter: "und", score 0. Nothing to learn from:
all texts "und". Ties go to the first language by name. Repeated rows are predicted each. Empty
table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.llm import common as C

WORD = re.compile(r"[^\W\d_]+")
#: Characters often found at the ends of words; only a shortcut.
ENDS = ".,;:!?'\"()[]*#$%&|<>-"
#: The bound of the sample, and sizes of the fit.
PER_LANG, TOTAL = 400, 4000
BITS, MAXLEN, BLOCK = 18, 24, 64
SEQUENCES, LENGTH, STEPS, RATE = 64, 48, 150, 0.15
#: Words whose scores a worker keeps.
KEEP = 500_000
U = np.uint64


def features(words: np.ndarray) -> np.ndarray:
    """Rows of hashed features of words (an object array of str); unused places hold 1 << BITS."""
    n = len(words)
    raw = np.array([w[:MAXLEN] for w in words], f"<U{MAXLEN}") if n else np.zeros(0, f"<U{MAXLEN}")
    c = raw.view(np.uint32).reshape(n, MAXLEN).astype(np.uint64) if n else np.zeros((0, MAXLEN), U)
    size = (c > 0).sum(1)
    tails = np.array([w[-3:].rjust(3, "\x01") for w in words], "<U3").view(np.uint32).reshape(n, 3).astype(np.uint64) if n else np.zeros((0, 3), U)
    s = np.zeros((n, MAXLEN + 2), U)  # with ends
    s[:, 1:-1] = c
    s[:, 0] = 1
    s[np.arange(n), size + 1] = 2
    width = int(size.max()) + 2 if n else 2
    s = s[:, :width]
    out = []
    two = s[:, :-1] * U(0x10001) + s[:, 1:]
    three = two[:, :-1] * U(0x10003) + s[:, 2:]
    at = np.arange(width)
    pad = U(1) << U(63)
    out.append(np.where(at[None, :-1] + 1 <= size[:, None] + 1, C.mix(two + U(11)) >> U(1), pad))
    out.append(np.where(at[None, :-2] + 2 <= size[:, None] + 1, C.mix(three + U(13) * U(1 << 40)) >> U(1), pad))
    h = np.zeros(n, U)
    for k in range(c.shape[1] if n else 0):
        h = np.where(c[:, k] > 0, C.mix(h + c[:, k] + U(17)), h)
        if k < 3:
            out.append((C.mix(h + U(k + 101)) >> U(1))[:, None])
    out.append((C.mix(h + U(211) + np.array([len(w) for w in words], U)) >> U(1))[:, None])
    t = np.zeros(n, U)
    for k in range(3):
        t = C.mix(t + tails[:, 2 - k] + U(307 + k))
        out.append((t >> U(1))[:, None])
    all_ = np.concatenate(out, 1)
    return np.where(all_ == pad, 1 << BITS, (all_ & U((1 << BITS) - 1)).astype(np.int64)).astype(np.int32)


def words_of(text: str | None) -> list[str]:
    out = []
    for w in (text or "").lower().split():
        if w.isalpha() or (w := w.strip(ENDS)).isalpha():
            out.append(w)
        elif w:
            out += WORD.findall(w)
    if out and max(map(len, out)) > MAXLEN:
        out = [w[k : k + MAXLEN] for w in out for k in range(0, max(1, len(w) - 2), MAXLEN - 2)]
    return out


def marginals(e: np.ndarray, trans: np.ndarray, start: np.ndarray, end_at: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of each word. e: scores of all sequences' words, one after the other, which end at end_at."""
    n, k = e.shape
    sizes = np.diff(np.concatenate([[0], end_at]))
    e = np.exp(e - e.max(1, keepdims=True))
    a, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    per = -(-sizes // BLOCK)
    blocks = int(per.sum())
    owner = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(blocks) - np.repeat(np.cumsum(per) - per, per)
    begin = (end_at - sizes)[owner] + nth * BLOCK
    length = np.minimum(BLOCK, end_at[owner] - begin)
    ix = np.minimum(begin[None, :] + np.arange(BLOCK)[:, None], n - 1)
    inside = np.arange(BLOCK)[:, None] < length[None, :]
    p = np.broadcast_to(np.eye(k, dtype=e.dtype), (blocks, k, k)).copy()  # the product of a block's matrices
    head = nth == 0
    for t in range(BLOCK):
        on = np.flatnonzero(inside[t])
        step = (p[on].reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:
            step[head[on]] = np.eye(k)  # no transition into the first word
        step *= e[ix[t, on]][:, None, :]
        p[on] = step / step.sum((1, 2), keepdims=True)
    alpha, beta = np.empty((blocks, k), e.dtype), np.empty((blocks, k), e.dtype)
    at = np.cumsum(per) - per
    live, v = np.flatnonzero(per > 0), np.broadcast_to(first, (len(sizes), k)).copy()
    for j in range(int(per.max(initial=0))):
        live = live[per[live] > j]
        b = at[live] + j
        alpha[b] = v[live]
        w = np.einsum("ni,nij->nj", v[live], p[b])
        v[live] = w / w.sum(1, keepdims=True)
    live, v = np.flatnonzero(per > 0), np.ones((len(sizes), k), e.dtype)
    for j in range(int(per.max(initial=0))):
        live = live[per[live] > j]
        b = at[live] + per[live] - 1 - j
        beta[b] = v[live]
        w = np.einsum("nij,nj->ni", p[b], v[live])
        v[live] = w / w.sum(1, keepdims=True)
    f = np.empty((BLOCK, blocks, k), e.dtype)
    v = alpha
    for t in range(BLOCK):
        w = v @ a if t else np.where(head[:, None], v, v @ a)
        w = w * e[ix[t]]
        v = np.where(inside[t][:, None], w / w.sum(1, keepdims=True), v)
        f[t] = v
    v, out = beta, np.empty((n, k), e.dtype)
    for t in range(BLOCK - 1, -1, -1):
        on = np.flatnonzero(inside[t])
        w = f[t, on] * v[on]
        out[ix[t, on]] = w / w.sum(1, keepdims=True)
        w = (v[on] * e[ix[t, on]]) @ a.T
        v[on] = w / w.sum(1, keepdims=True)
    return out


def expected(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of one length (sequences, words, labels): probabilities of each word's labels, and of each two neighbours', summed."""
    n, length, k = e.shape
    x, a = np.exp(e - e.max(2, keepdims=True)), np.exp(trans - trans.max())
    f, b = np.empty_like(x), np.ones_like(x)
    f[:, 0] = np.exp(start - start.max()) * x[:, 0]
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        w = f[:, t - 1] @ a * x[:, t]
        f[:, t] = w / w.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        w = (x[:, t + 1] * b[:, t + 1]) @ a.T
        b[:, t] = w / w.sum(1, keepdims=True)
    p = f * b
    pair = f[:, :-1, :, None] * a * (x * b)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p / p.sum(2, keepdims=True), pair.sum((0, 1))


class Tagger:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.weights = labels, np.zeros(((1 << BITS) + 1, k), np.float32)
        self.trans, self.start = np.eye(k) * 2.0, np.zeros(k)

    def scores(self, words: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), np.float32)
        by = np.argsort([len(w) for w in words], kind="stable")  # words of one length have as many features
        for lo in range(0, len(words), 8000):
            at = by[lo : lo + 8000]
            out[at] = self.weights[features(words[at])].sum(1)
        return out

    def known_scores(self, words: np.ndarray) -> np.ndarray:
        """scores(), kept for words that come again (of KEEP words at most)."""
        if not hasattr(self, "known") or len(self.known) > KEEP:
            self.known, self.table = {}, np.zeros((0, len(self.labels)), np.float32)
        get = self.known.get
        row = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.table = np.concatenate([self.table, self.scores(words[new])])
            self.known.update(zip(words[new].tolist(), row[new].tolist()))
        return self.table[row]

    def fit(self, texts: list[list[str]], langs: list[str], seed: int = 5) -> "Tagger":
        """Learns from words of documents and their languages."""
        rng, k = np.random.default_rng(seed), len(self.labels)
        number = {x: j for j, x in enumerate(self.labels)}
        of = [[w for w, x in zip(texts, langs) if number[x] == j and w] for j in range(k)]
        there = [j for j in range(k) if of[j]]
        square, ts = np.full(self.weights.shape, 1e-3, np.float32), np.full((k, k), 1e-3)
        ss = np.full(k, 1e-3)
        for _ in range(STEPS if there else 0):
            words, y = [], []
            for _ in range(SEQUENCES):
                w, z = [], []
                while len(w) < LENGTH:
                    j = there[rng.integers(len(there))]
                    d = of[j][rng.integers(len(of[j]))]
                    m = int(rng.integers(3, 24))
                    s = int(rng.integers(0, max(1, len(d) - m + 1)))
                    w += d[s : s + m]
                    z += [j] * len(d[s : s + m])
                words += w[:LENGTH]
                y += z[:LENGTH]
            y = np.array(y)
            flat = np.empty(len(words), object)
            flat[:] = words
            x = features(flat)
            e = self.weights[x].sum(1).astype(np.float64)
            p, pairs = expected(e.reshape(SEQUENCES, LENGTH, k), self.trans, self.start)
            p = p.reshape(-1, k)
            g = -p
            g[np.arange(len(y)), y] += 1
            rows, at = np.unique(x, return_inverse=True)
            at = at.reshape(x.shape)
            s = np.zeros((len(rows), k), np.float32)
            for j in range(k):
                s[:, j] = np.bincount(at.ravel(), np.repeat(g[:, j], x.shape[1]), len(rows))
            s /= np.sqrt(LENGTH)
            square[rows] += s * s
            self.weights[rows] += RATE * s / np.sqrt(square[rows])
            self.weights[1 << BITS] = 0
            z = y.reshape(SEQUENCES, LENGTH)
            d = np.bincount((z[:, :-1] * k + z[:, 1:]).ravel(), minlength=k * k).reshape(k, k) - pairs
            d /= np.sqrt(SEQUENCES * (LENGTH - 1))
            ts += d * d
            self.trans += RATE * d / np.sqrt(ts)
            d = (np.bincount(z[:, 0], minlength=k) - p[::LENGTH].sum(0)) / np.sqrt(SEQUENCES)
            ss += d * d
            self.start += RATE * d / np.sqrt(ss)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        if not self.labels or not sizes.sum():
            return ["und"] * len(texts), np.zeros(len(texts))
        flat = np.empty(sizes.sum(), object)
        flat[:] = [w for d in words for w in d]
        code, uniq = pd.factorize(flat)
        have = np.flatnonzero(sizes)
        p = marginals(self.known_scores(uniq)[code], self.trans.astype(np.float32), self.start.astype(np.float32), np.cumsum(sizes[have]))
        total = np.zeros((len(texts), len(self.labels)))
        total[have] = np.add.reduceat(p, np.cumsum(sizes[have]) - sizes[have], 0)
        best = total.argmax(1)
        score = total[np.arange(len(texts)), best] / np.maximum(sizes, 1)
        return [self.labels[b] if n else "und" for b, n in zip(best, sizes)], np.where(sizes > 0, np.clip(score, 0, 1), 0.0)


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """The labelled texts to learn from: TOTAL at most, PER_LANG different ones of a language, by hash; each task ranks its own first."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = rows.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= PER_LANG).orderBy("rank", "lang").limit(TOTAL)
    few = rows.sparkSession.createDataFrame([(r["lang"], r["h"], r["rank"]) for r in few.collect()], "lang string, h long, rank int")  # TOTAL rows at most
    return rows.join(F.broadcast(few), ["lang", "h"]).groupBy("rank", "lang").agg(F.min("text").alias("text")).orderBy("rank", "lang").collect()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each row: id_col, held_out, lang_pred and score."""
    rows = sample(docs, id_col, text_col, lang_col)
    labels = sorted({r["lang"] for r in rows})
    tagger = Tagger(labels).fit([words_of(r["text"]) for r in rows], [r["lang"] for r in rows])
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        k = len(labels)  # a block of words takes labels * labels numbers
        for b in C.slices(batches, 2, max(1 << 16, (4 << 20) // max(1, k * k // 64))):
            lang, score = model.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), text_col).mapInArrow(C.released(run), f"{id_col} long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(C.documents(spark, sf_dir))
