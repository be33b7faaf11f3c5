"""Token ids as files of blocks, compressed by an adaptive context-mixing range coder.

A block holds whole documents. Its ids are cut into lanes, coded side by side with one shared model
that starts from nothing in each block, so that a block can be read alone:

- order 2 and order 1: for the two ids (the id) before, the two ids that follow most often, with counts of
  each and of all others, that decay; a share of the probability stays for what a context hasn't met;
- order 0: adaptive counts of all ids;
- mixing: p = w2 p2 + w1 p1 + w0 p0, with weights for each pair of confidences of orders 2 and 1, learned from
  what each order's share was of the probabilities of the ids coded. An id that orders 2 and 1 both predict
  gets the sum of their shares. What they don't assign goes to order 0.

The ids that orders 2 and 1 predict have their intervals first, then all ids by order 0 in what is left (so an id
predicted above has, besides, an interval there that isn't used).

A 64-bit carryless range coder codes the intervals, 16 bits at a time. A block has a CRC-32 of all
that follows it in the block, and one of its ids; a reader that meets another value raises ValueError.

Null texts are empty; every document ends with the end id. Empty table: no blocks, no rows. Rows
with equal or null ids are kept (nulls first). Other columns are ignored. A very long document makes
a block of its own, longer than the others.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.llm import common as C
from ploidlens.llm.tokens import Encoder

U64 = np.uint64
MAGIC = b"PLI2"
HEAD = struct.Struct("<4sIIIIII")  # magic, CRC of the rest, documents, ids, symbols, lanes, CRC of the ids
#: Ids after which a block ends; lanes at most, and ids in a lane at least.
BLOCK, LANES, LANE = 1 << 21, 4096, 192
TOP, LOW = U64(1 << 48), U64((1 << 32) - 1)
#: Contexts of order 2 (bits of their hash); bits of the shares of the mix, of weights, and of p2 and p1.
ORDER2, UNIT, WEIGHT, PART = 19, 16, 12, 12
#: Steps from one adjustment of the weights, and of order 0, to the next; every step is used before the first.
OFTEN, SELDOM = 4, 16
#: An entry of a context: its two ids (17 bits each), and three counts of 4 bits: of these ids and of others.
IDS, MOST = 17, 15
NONE_A, NONE_B = (1 << IDS) - 2, (1 << IDS) - 1
SWAP, RENEW = 1 << 12, 1 << 13


def _states():
    """By the three counts: p of both ids (PART bits), confidence (3 bits); and by outcome (first, second, other id) the next counts, with SWAP and RENEW."""
    st = np.arange(1 << 12)
    a, b, x = st & 15, st >> 4 & 15, st >> 8
    total = a + b + x
    p = [((n << PART) * 4 // (4 * total + 3)).astype(np.int64) for n in (a, b)]  # 0.75 for ids not met
    sure = np.where(a == 0, 0, 1 + np.minimum(2, a // 2) * 2 + (a * 2 > total))
    nexts = []
    for outcome in range(3):
        na, nb, nx, flag = a + (outcome == 0), b + (outcome == 1), x.copy(), np.zeros_like(a)
        if outcome == 2:
            new = b <= 1  # the second id makes room
            flag |= np.where(new, RENEW, 0)
            nx = np.where(new, x + nb, x + 1)
            nb = np.where(new, 1, nb)
        over = (na > MOST) | (nb > MOST) | (nx > MOST)
        na, nb, nx = (np.where(over, n + 1 >> 1, n) for n in (na, nb, nx))
        swap = nb > na
        na, nb = np.where(swap, nb, na), np.where(swap, na, nb)
        nexts.append(na | nb << 4 | np.minimum(nx, MOST) << 8 | flag | np.where(swap, SWAP, 0))
    return *p, sure.astype(np.int64), np.concatenate(nexts).astype(np.int64)


P_A, P_B, SURE, NEXT = _states()


class Model:
    """The predictions. All lanes of a step are predicted, then learned."""

    def __init__(self, symbols: int, lanes: int):
        if symbols > NONE_A:
            raise ValueError("ids are too large")
        self.n, self.bits = symbols, max(16, symbols.bit_length() + 2)
        self.count = np.ones(symbols, np.int64)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.t1, self.t2 = (np.full(n, NONE_A | NONE_B << IDS, np.int64) for n in (symbols, 1 << ORDER2))
        self.won = np.tile(np.array([2.0, 2.0, 4.0]), (64, 1))
        self.late: list[np.ndarray] = []
        self.step = 0
        self._weigh()
        self._refresh()

    def _weigh(self) -> None:
        w = self.won / self.won.sum(1, keepdims=True)
        self.w2, self.w1 = (np.floor(w[:, k] * ((1 << WEIGHT) - 160)).astype(np.int64) for k in (0, 1))
        self.w0 = (1 << WEIGHT) - self.w2 - self.w1

    def _refresh(self) -> None:
        if self.late:
            self.count += 8 * np.bincount(np.concatenate(self.late), minlength=self.n)
            self.late = []
        size = 1 << self.bits
        self.freq = 1 + self.count * (size - self.n) // int(self.count.sum())
        self.freq[self.freq.argmax()] += size - int(self.freq.sum())
        self.cum = np.cumsum(self.freq) - self.freq
        self.by_place = None

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals in order 0 hold the places."""
        if self.by_place is None:
            self.by_place = np.repeat(np.arange(self.n, dtype=np.int32), self.freq)
        return self.by_place[place].astype(np.int64)

    def predict(self):
        """The ids predicted, the ends of their intervals, in units; what is left is order 0's."""
        self.h = ((self.p2 * 0x9E3779B1 + self.p1 * 0x85EBCA6B) >> 7) & ((1 << ORDER2) - 1)
        e2, e1 = self.t2[self.h], self.t1[self.p1]
        mask = (1 << IDS) - 1
        a2, b2, s2 = e2 & mask, e2 >> IDS & mask, e2 >> 2 * IDS
        a1, b1, s1 = e1 & mask, e1 >> IDS & mask, e1 >> 2 * IDS
        self.ctx = SURE[s2] << 3 | SURE[s1]
        w2, w1 = self.w2[self.ctx], self.w1[self.ctx]
        shift = WEIGHT + PART - UNIT
        fa2, fb2, fa1, fb1 = w2 * P_A[s2] >> shift, w2 * P_B[s2] >> shift, w1 * P_A[s1] >> shift, w1 * P_B[s1] >> shift
        aa, ab, ba, bb = a1 == a2, a1 == b2, b1 == a2, b1 == b2
        end1 = fa2 + fa1 * aa + fb1 * ba
        end2 = end1 + fb2 + fa1 * ab + fb1 * bb
        end3 = end2 + fa1 * ~(aa | ab)
        end4 = end3 + fb1 * ~(ba | bb)
        self.ids, self.states = (a2, b2, a1, b1), (s2, s1)
        return (a2, b2, a1, b1), (end1, end2, end3, end4)

    def _follow(self, table: np.ndarray, at: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, state: np.ndarray) -> None:
        is_a, is_b = x == a, x == b
        new = NEXT[(2 - 2 * is_a - is_b) << 12 | state]
        b = np.where(new & RENEW, x, b)
        swap = (new & SWAP) != 0
        table[at] = np.where(swap, b, a) | np.where(swap, a, b) << IDS | (new & (SWAP - 1)) << 2 * IDS

    def learn(self, x: np.ndarray) -> None:
        (a2, b2, a1, b1), (s2, s1) = self.ids, self.states
        if self.step < OFTEN or self.step % OFTEN == 0:
            shares = [w[self.ctx] * (P_A[s] * (x == a) + P_B[s] * (x == b)) for w, s, a, b in ((self.w2, s2, a2, b2), (self.w1, s1, a1, b1))]
            shares.append(self.w0[self.ctx] * self.freq[x] / float(1 << self.bits - PART))
            total = shares[0] + shares[1] + shares[2]
            for k in range(3):
                self.won[:, k] += np.bincount(self.ctx, shares[k] / total, 64)
            self._weigh()
        if self.step & 1:  # one order a step: the ids of the others' contexts are met again
            self._follow(self.t1, self.p1, x, a1, b1, s1)
        else:
            self._follow(self.t2, self.h, x, a2, b2, s2)
        self.p2, self.p1 = self.p1, x
        self.late.append(x)
        self.step += 1
        if self.step < 4 or self.step % SELDOM == 0:
            self._refresh()


def _shift(low: np.ndarray, size: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """Of all lanes, or those given, the ones whose top 16 bits are settled (or whose range is too small, which settles them)."""
    a, b = (low, size) if lanes is None else (low[lanes], size[lanes])
    settled = (a ^ (a + b)) < TOP
    small = ~settled & (b <= LOW)
    if small.any():
        k = np.flatnonzero(small) if lanes is None else lanes[small]
        size[k] = (~low[k] + U64(1)) & LOW
        settled |= small
    return np.flatnonzero(settled) if lanes is None else lanes[settled]


def encode(ids: np.ndarray, symbols: int) -> bytes:
    """The lanes' bytes of ids below symbols: their lengths, then their 16-bit units."""
    n = len(ids)
    lanes = max(1, min(LANES, n // LANE))
    steps = -(-n // lanes)
    x = np.zeros(lanes * steps, np.int64)
    x[:n] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    out, used = np.zeros((lanes, 3 * steps + 8), np.uint16), np.zeros(lanes, np.int64)
    low, size, m = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64), Model(symbols, lanes)
    none = np.zeros(lanes, np.int64)
    for t in range(steps):
        s = x[t]
        ids, ends = m.predict()
        unit, left = size >> U64(UNIT), ends[3]
        share = unit * ((1 << UNIT) - left).view(U64) >> U64(m.bits)
        add, size = unit * left.view(U64) + share * m.cum[s].view(U64), share * m.freq[s].view(U64)
        begin = none
        for guess, end in zip(ids, ends):
            k = np.flatnonzero((guess == s) & (end > begin))
            if len(k):
                first = begin[k]
                add[k], size[k] = unit[k] * first.view(U64), unit[k] * (end[k] - first).view(U64)
            begin = end
        low += add
        k = _shift(low, size)
        while len(k):
            out[k, used[k]] = low[k] >> U64(48)
            used[k] += 1
            low[k] <<= U64(16)
            size[k] <<= U64(16)
            k = _shift(low, size, k)
        m.learn(s)
    for _ in range(4):
        out[np.arange(lanes), used] = low >> U64(48)
        used += 1
        low <<= U64(16)
    keep = np.arange(out.shape[1])[None, :] < used[:, None]
    return used.astype("<u4").tobytes() + out[keep].astype("<u2").tobytes()


def decode(data: bytes, n: int, symbols: int) -> np.ndarray:
    lanes = max(1, min(LANES, n // LANE))
    steps = -(-n // lanes)
    used = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    units = np.concatenate([np.frombuffer(data, "<u2", offset=4 * lanes), np.zeros(4, np.uint16)]).astype(U64)
    at = np.cumsum(used) - used
    code = np.zeros(lanes, U64)
    for _ in range(4):
        code = (code << U64(16)) | units[at]
        at += 1
    x = np.zeros((steps, lanes), np.int64)
    low, size, m = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64), Model(symbols, lanes)
    none = np.zeros(lanes, np.int64)
    for t in range(steps):
        ids, ends = m.predict()
        unit, left = size >> U64(UNIT), ends[3]
        share = unit * ((1 << UNIT) - left).view(U64) >> U64(m.bits)
        base = unit * left.view(U64)
        place = code - low
        above = place >= base
        s = np.where(above, (place - base) // share, U64(0)).view(np.int64)
        s = m.symbol(np.minimum(s, (1 << m.bits) - 1))
        add, size = base + share * m.cum[s].view(U64), share * m.freq[s].view(U64)
        k = np.flatnonzero(~above)
        if len(k):
            nth = (place[k] // unit[k]).view(np.int64)
            which = sum((nth >= e[k]).astype(np.int64) for e in ends[:3])
            s[k] = np.choose(which, [g[k] for g in ids])
            first, end = np.choose(which, [none[k], *(e[k] for e in ends[:3])]), np.choose(which, [e[k] for e in ends])
            add[k], size[k] = unit[k] * first.view(U64), unit[k] * (end - first).view(U64)
        low += add
        k = _shift(low, size)
        while len(k):
            code[k] = (code[k] << U64(16)) | units[np.minimum(at[k], len(units) - 1)]
            at[k] += 1
            low[k] <<= U64(16)
            size[k] <<= U64(16)
            k = _shift(low, size, k)
        x[t] = s
        m.learn(s)
    return x.T.reshape(-1)[:n].astype(np.uint32)


def write_block(doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """One block: documents (ids, which of them are null, sizes), all their ids, and how many ids the file has before."""
    symbols = int(ids.max()) + 1 if len(ids) else 1
    body = struct.pack("<Q", before) + doc_ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + sizes.astype("<u4").tobytes() + encode(ids, symbols)
    rest = HEAD.pack(MAGIC, 0, len(sizes), len(ids), symbols, 0, zlib.crc32(ids.astype("<u4").tobytes()))[8:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def read_block(data: bytes):
    """(doc_ids, null, sizes, ids, before) of a block; ValueError if it is damaged."""
    magic, crc, docs, n, symbols, _, own = HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[8:]) != crc:
        raise ValueError("damaged block")
    at = HEAD.size
    before = struct.unpack_from("<Q", data, at)[0]
    doc_ids = np.frombuffer(data, "<i8", docs, at + 8)
    null = np.frombuffer(data, "u1", docs, at + 8 + 8 * docs).astype(bool)
    sizes = np.frombuffer(data, "<u4", docs, at + 8 + 9 * docs).astype(np.int64)
    ids = decode(data[at + 8 + 13 * docs :], n, symbols)
    if zlib.crc32(ids.tobytes()) != own:
        raise ValueError("damaged ids")
    return doc_ids, null, sizes, ids, before


def _write(tokenizer: str, end_id: int):
    def run(batches):
        enc, part, block, before, held, n = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0, [], 0

        def done():
            d, z, s, i = (np.concatenate(x) for x in zip(*held))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(i)], pa.int64()), pa.array([write_block(d, z, s, i, before)], pa.binary())], ["part", "block", "n", "data"])

        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 2000):
                ids, sizes = enc.ids(texts[lo : lo + 2000])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                col = b.column(0).slice(lo, 2000)
                held.append((col.fill_null(0).to_numpy(), np.asarray(col.is_null()), sizes + 1, ids))
                n += len(ids)
                if n >= BLOCK:
                    yield done()
                    block, before, held, n = block + 1, before + n, [], 0
        if n:
            yield done()

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending id order; the table of files: part, block, n, data."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    return C.staged(rows.mapInArrow(_write(tokenizer, end_id), "part int, block int, n long, data binary"), "ids")


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: id_col, start, n_tokens, ids_crc32 for each document."""
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a file
    base, total = {}, 0
    for p in sorted(sums):
        base[p] = total
        total += sums[p]

    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                d, null, sizes, ids, before = read_block(data.as_py())
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(d, mask=null), pa.array(base[part] + before + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.select("part", "data").mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def op5_id_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
