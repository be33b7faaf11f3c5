"""Lossless WebP (VP8L): a decoder into pixel arrays, and an encoder, both over many images at a time.

The decoder reads all of the format: simple and normal prefix codes, meta prefix codes (groups of
codes by blocks of the image), literals, back-references with the two-dimensional distance map, the
colour cache, and the inverses of the predictor, cross-colour, subtract-green and palette
(colour-indexing) transforms. Images without cache or meta codes that have no back-references,
or one channel beyond the transforms, are decoded side by side, a symbol of each at a time, by table look-ups on arrays;
back-references are copied after that.

The encoder stores a payload as 8-bit samples: grey images 64 pixels wide; one over TILE bytes as several images, file
after file, so that a long text is decoded as fast as many short ones. Every image has its green subtracted, which leaves
one channel, and is searched for back-references: of the places before with the same 4 or 8 pixels the last, taken
if it costs less than literals do and no less is saved from the next pixel on. What is estimated as shorter with
them or without is written. Images of up to COLOURS values are written with a palette too, also with a cache, and those whose
differences from the left or from above have less entropy than the samples with the predictor of least
differences for each block; the shortest file is kept. A palette of more values packs no pixels, and a cache
parts the symbols of a channel that is alone, so neither shortens other images; the cross-colour transform has nothing to
predict in channels that are zero. encode() writes any transforms and cache that it is asked for.

Null texts are empty: a payload of 64 zero bytes. Texts are whole, of any length. Equal
texts give equal values; repeated rows and ids are kept. Empty table: no rows. Extra columns are
ignored. Damaged data raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.llm import common as C

#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
LONGEST = 15
#: Of each symbol of lengths and distances: the least value and the number of extra bits.
LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)])
EXTRA = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)])
#: Bits of the longest code written: short ones keep the tables of many images small.
WRITTEN = 11
#: Columns of an image, and bytes of a payload in one.
WIDTH, TILE = 64, 16384
#: Different bytes of payloads that are tried with a palette, back-references and a colour cache as well.
COLOURS = 16
#: Pixels of the shortest back-reference, of the longest, and those that arrays compare at once; sides of a predictor's block, as a power of 2.
SHORTEST, FARTHEST, COMPARED, BLOCK = 4, 4096, 32, 4


# ---------------------------------------------------------------- prefix codes


def code_lengths(count: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of a prefix code for symbols counted, none over `longest`."""
    if len(count) < 2:
        return dict.fromkeys(count, 1)
    floor, symbols = 0, sorted(count, key=count.get)
    while True:
        leaves = [max(count[s], floor) for s in symbols]
        parent, i, j = [0] * (2 * len(leaves) - 1), 0, 0
        joined: list[int] = []  # ascending, as the leaves are: the two least are in front
        n = len(leaves)
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if i < n and (j >= len(joined) or leaves[i] <= joined[j]):
                    parent[i] = k
                    total += leaves[i]
                    i += 1
                else:
                    parent[n + j] = k
                    total += joined[j]
                    j += 1
            joined.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= longest:
            return dict(zip(symbols, depth))
        floor = 2 * floor or max(1, sum(count.values()) >> longest)


def _flipped(bits: int) -> np.ndarray:
    x = np.arange(1 << bits)
    return sum(((x >> k & 1) << (bits - 1 - k) for k in range(bits)), np.zeros_like(x))


FLIPPED = _flipped(LONGEST).tolist()


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """The bits of each symbol's code, first bit lowest."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        last = n
        out[s] = FLIPPED[code] >> (LONGEST - n)
        code += 1
    return out


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """A table by the next `bits` bits: symbol << 4 | length. A code of one symbol has no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int32), 0
    if not len(used) or (1 << LONGEST) != int((1 << (LONGEST - lengths[used])).sum()):
        raise ValueError("prefix code isn't complete")
    bits = int(lengths.max())
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[order])
    entry = np.repeat((order << 4 | lengths[order]).astype(np.int32), span)
    return entry[_reversed(bits)], bits


_REVERSED: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    if bits not in _REVERSED:
        _REVERSED[bits] = _flipped(bits)
    return _REVERSED[bits]


# ---------------------------------------------------------------- bits


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits

    def code(self, lengths: dict[int, int], symbols: int) -> dict[int, tuple[int, int]]:
        """Writes a prefix code; what each symbol is written as: (bits, size)."""
        used = [s for s in lengths if lengths[s]]
        if not used or len(used) <= 2 and max(used) < 256:
            used = sorted(used) or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            wide = used[0] > 1
            self.put(wide, 1)
            self.put(used[0], 8 if wide else 1)
            if len(used) == 2:
                self.put(used[1], 8)
                return {used[0]: (0, 1), used[1]: (1, 1)}
            return {used[0]: (0, 0)}
        if len(used) == 1:  # over 255: not a simple code; a second symbol makes it complete
            lengths = lengths | {0: 1}
        self.put(0, 1)
        seq, k = [], 0
        for s in sorted(s for s in lengths if lengths[s]):
            gap = s - k
            while gap >= 3:
                n = min(gap, 138)
                seq.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
                gap -= n
            seq += [(0, 0, 0)] * gap
            seq.append((lengths[s], 0, 0))
            k = s + 1
        count: dict[int, int] = {}
        for s, _, _ in seq:
            count[s] = count.get(s, 0) + 1
        own = code_lengths(count, 7)
        if len(own) == 1:
            own = own | {next(x for x in (0, 1) if x not in own): 1}
        listed = max(CODE_ORDER.index(s) for s in own) + 1
        listed = max(4, listed)
        self.put(listed - 4, 4)
        for s in CODE_ORDER[:listed]:
            self.put(own.get(s, 0), 3)
        self.put(1, 1)  # the number of lengths written is given
        width = max(1, -(-(max(0, (len(seq) - 2)).bit_length()) // 2))
        self.put(width - 1, 3)
        self.put(len(seq) - 2, 2 * width)
        bits = canonical(own)
        value, size = 0, 0
        for s, extra, n in seq:
            value |= (bits[s] | extra << own[s]) << size
            size += own[s] + n
        self.put(value, size)
        out = canonical(lengths)
        return {s: (out[s], lengths[s]) for s in out}

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.value = 0
        self.left = 0

    def get(self, bits: int) -> int:
        while self.left < bits:
            if self.at >= len(self.data) + 8:
                raise ValueError("data ends early")
            self.value |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.left
            self.at += 8
            self.left += 64
        out = self.value & ((1 << bits) - 1)
        self.value >>= bits
        self.left -= bits
        return out

    @property
    def place(self) -> int:
        return self.at * 8 - self.left

    def symbol(self, table: tuple[np.ndarray, int]) -> int:
        t, bits = table
        if not bits:
            return int(t[0]) >> 4
        if self.left < LONGEST:
            if self.at >= len(self.data) + 8:
                raise ValueError("data ends early")
            self.value |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.left
            self.at += 8
            self.left += 64
        x = int(t[self.value & ((1 << bits) - 1)])
        n = x & 15
        self.value >>= n
        self.left -= n
        return x >> 4


def read_code(r: Reader, symbols: int) -> np.ndarray:
    """The lengths of a normal prefix code."""
    out = np.zeros(symbols, np.int64)
    own = np.zeros(19, np.int64)
    for s in CODE_ORDER[: 4 + r.get(4)]:
        own[s] = r.get(3)
    table = lookup(own)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else symbols
    t, bits = table[0].tolist(), (1 << table[1]) - 1
    k, last = 0, 8
    while k < symbols and left:
        left -= 1
        if r.left < 14:  # 7 bits of a code and 7 extra ones
            if r.at >= len(r.data) + 8:
                raise ValueError("data ends early")
            r.value |= int.from_bytes(r.data[r.at : r.at + 8], "little") << r.left
            r.at += 8
            r.left += 64
        s = t[r.value & bits]
        n = s & 15
        r.value >>= n
        r.left -= n
        s >>= 4
        if s < 16:
            out[k] = s
            k += 1
            last = s or last
        else:
            n = {16: (2, 3), 17: (3, 3), 18: (7, 11)}[s]
            n = r.get(n[0]) + n[1]
            if k + n > symbols:
                raise ValueError("code lengths run over")
            if s == 16:
                out[k : k + n] = last
            k += n
    return out


def read_table(r: Reader, symbols: int) -> tuple[np.ndarray, int]:
    """lookup() of the code that follows."""
    if r.get(1):
        two = r.get(1)
        first = r.get(8 if r.get(1) else 1)
        if not two:
            return _single(first)
        out = np.zeros(256, np.int64)
        out[first] = out[r.get(8)] = 1
        return lookup(out)
    return lookup(read_code(r, symbols))


@functools.cache
def _single(symbol: int) -> tuple[np.ndarray, int]:
    return np.array([symbol << 4], np.int32), 0


# ---------------------------------------------------------------- decoding one image


def _prefixed(r: Reader, p: int) -> int:
    if p < 4:
        return p + 1
    extra = (p - 2) >> 1
    return ((2 + (p & 1)) << extra) + r.get(extra) + 1


def _size(r: Reader) -> int:
    return r.get(3) + 2


def _entropy(r: Reader, w: int, h: int, main: bool):
    """What stands before the pixels: bits of the colour cache, the group of each block, and the codes."""
    cache = 0
    if r.get(1):
        cache = r.get(4)
        if not 1 <= cache <= 11:
            raise ValueError("colour cache")
    meta, bits, groups = None, 0, 1
    if main and r.get(1):
        bits = _size(r)
        meta = (pixels(r, (w + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits, False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)
    return cache, meta, bits, [[read_table(r, n) for n in sizes] for _ in range(groups)]


def pixels(r: Reader, w: int, h: int, main: bool, head=None) -> np.ndarray:
    """An entropy-coded image: ARGB as uint32, h x w."""
    cache, meta, bits, groups = head or _entropy(r, w, h, main)
    out, n, k = np.zeros(w * h, np.uint32), w * h, 0
    colours = [0] * (1 << cache)
    shift = 32 - cache
    g = groups[0]
    while k < n:
        if meta is not None:
            g = groups[int(meta[k // w >> bits, k % w >> bits])]
        s = r.symbol(g[0])
        if s < 256:
            red, blue, alpha = r.symbol(g[1]), r.symbol(g[2]), r.symbol(g[3])
            x = alpha << 24 | red << 16 | s << 8 | blue
            out[k] = x
            k += 1
            if cache:
                colours[(CACHE_HASH * x & 0xFFFFFFFF) >> shift] = x
        elif s < 280:
            length = _prefixed(r, s - 256)
            d = _prefixed(r, r.symbol(g[4]))
            if d > 120:
                d -= 120
            else:
                x, y = DISTANCES[d - 1]
                d = max(1, x + y * w)
            if d > k or k + length > n:
                raise ValueError("back-reference out of the image")
            for j in range(k, k + length):
                x = int(out[j - d])
                out[j] = x
                if cache:
                    colours[(CACHE_HASH * x & 0xFFFFFFFF) >> shift] = x
            k += length
        else:
            out[k] = x = colours[s - 280]
            colours[(CACHE_HASH * x & 0xFFFFFFFF) >> shift] = x
            k += 1
    return out.reshape(h, w)


def _channels(x: np.ndarray) -> np.ndarray:
    """ARGB as (..., 4) integers a, r, g, b."""
    return np.stack([x >> 24 & 255, x >> 16 & 255, x >> 8 & 255, x & 255], -1).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, tl, tr) -> list[int]:
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return half(half(left, tr), top)
    if mode <= 9:
        return half(*((left, tl), (left, top), (tl, top), (top, tr))[mode - 6])
    if mode == 10:
        return half(half(left, tl), half(top, tr))
    if mode == 11:
        pl = sum(abs(t - x) for t, x in zip(top, tl))
        pt = sum(abs(x - t) for x, t in zip(left, tl))
        return left if pl < pt else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, tl)]
    avg = half(left, top)
    return [clamp(a + int((a - b) / 2)) for a, b in zip(avg, tl)]


def predicted(x: np.ndarray, modes: np.ndarray, bits: int, back: bool) -> np.ndarray:
    """The predictor transform: residuals to pixels if back, else pixels to residuals."""
    h, w = x.shape
    if back and not (x & 0xFFFF00FF).any():
        return _predicted_green(x, modes, bits)
    c = _channels(x).tolist()
    out = [[None] * w for _ in range(h)]
    seen = out if back else c
    for y in range(h):
        for k in range(w):
            if not y:
                p = seen[0][k - 1] if k else [255, 0, 0, 0]
            elif not k:
                p = seen[y - 1][0]
            else:
                up = seen[y - 1]
                tr = up[k + 1] if k + 1 < w else seen[y][0]  # beyond the row: its own first pixel
                p = _predict(int(modes[y >> bits, k >> bits]) & 15, seen[y][k - 1], up[k], up[k - 1], tr)
            out[y][k] = [(a + b if back else a - b) & 255 for a, b in zip(c[y][k], p)]
    return _packed(np.array(out, np.int64).reshape(h, w, 4))


def _predicted_green(x: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """predicted() back, of residuals in green alone: alpha stays 255, red and blue stay 0."""
    h, w = x.shape
    rows, up = [], None
    for y, c in enumerate((x >> 8 & 255).tolist()):
        row = []
        if up is None:
            left = 0
            for v in c:
                left = left + v & 255
                row.append(left)
        else:
            left = c[0] + up[0] & 255
            row.append(left)
            mode = (modes[y >> bits] & 15).tolist()
            for k in range(1, w):
                m, t, tl, tr = mode[k >> bits], up[k], up[k - 1], up[k + 1] if k + 1 < w else row[0]
                if m in (0, 14, 15):
                    p = 0
                elif m <= 4:
                    p = (left, t, tr, tl)[m - 1]
                elif m == 5:
                    p = (left + tr >> 1) + t >> 1
                elif m <= 9:
                    p = (left + tl, left + t, tl + t, t + tr)[m - 6] >> 1
                elif m == 10:
                    p = (left + tl >> 1) + (t + tr >> 1) >> 1
                elif m == 11:
                    p = left if abs(t - tl) < abs(left - tl) else t
                elif m == 12:
                    p = min(255, max(0, left + t - tl))
                else:
                    avg = left + t >> 1
                    p = min(255, max(0, avg + int((avg - tl) / 2)))
                left = c[k] + p & 255
                row.append(left)
        rows.append(row)
        up = row
    return np.uint32(0xFF000000) | np.array(rows, np.uint32) << np.uint32(8)


def crossed(x: np.ndarray, factors: np.ndarray, bits: int, back: bool) -> np.ndarray:
    """The cross-colour transform, inverted if back. factors: ARGB, of which r, g, b are red-to-blue, green-to-blue, green-to-red."""
    h, w = x.shape
    f = _channels(factors[(np.arange(h) >> bits)[:, None], (np.arange(w) >> bits)[None, :]])
    s8 = lambda v: (v + 128 & 255) - 128
    delta = lambda t, v: s8(t) * s8(v) >> 5
    c = _channels(x)
    sign = 1 if back else -1
    red = c[..., 1] + sign * delta(f[..., 3], c[..., 2]) & 255
    blue = c[..., 3] + sign * (delta(f[..., 2], c[..., 2]) + delta(f[..., 1], red if back else c[..., 1]))
    c[..., 1], c[..., 3] = red, blue
    return _packed(c)


def greened(x: np.ndarray, back: bool) -> np.ndarray:
    x = np.asarray(x, np.uint32)
    g = x >> np.uint32(8) & np.uint32(255)
    g |= g << np.uint32(16)
    rb = x & np.uint32(0xFF00FF)
    return x & np.uint32(0xFF00FF00) | (rb + g if back else (rb | np.uint32(0x01000100)) - g) & np.uint32(0xFF00FF)


def _unpaletted(x: np.ndarray, palette: np.ndarray, bits: int, w: int) -> np.ndarray:
    ix = x >> 8 & 255
    if bits:
        each = 8 >> bits
        ix = (ix[:, :, None] >> (np.arange(1 << bits) * each)[None, None, :] & (1 << each) - 1).reshape(len(x), -1)[:, :w]
    whole = np.zeros(256, np.uint32)
    whole[: len(palette)] = palette
    return whole[ix]


def _undone(x: np.ndarray, transforms: list) -> np.ndarray:
    for t in reversed(transforms):
        if t[0] == PREDICTOR:
            x = predicted(x, t[1] >> 8, t[2], True)
        elif t[0] == CROSS:
            x = crossed(x, t[1], t[2], True)
        elif t[0] == SUBTRACT:
            x = greened(x, True)
        else:
            x = _unpaletted(x, t[1], t[2], t[3])
    return x


def _opened(data: bytes):
    """The reader after the transforms: reader, width that is coded, width, height, transforms."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP")
    at = 12  # chunks before the image (extended files) are passed over
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless WebP")
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + n % 2
    if at + 13 > len(data) or data[at + 8] != 0x2F:
        raise ValueError("no lossless WebP")
    n = struct.unpack_from("<I", data, at + 4)[0]
    if at + 8 + n > len(data) or struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        raise ValueError("data ends early")
    r = Reader(data[at + 9 : at + 8 + n])
    w, h = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("version")
    coded, transforms = w, []
    while r.get(1):
        kind = r.get(2)
        if kind in (x[0] for x in transforms):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS):
            bits = _size(r)
            transforms.append((kind, pixels(r, (coded + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits, False), bits))
        elif kind == SUBTRACT:
            transforms.append((kind,))
        else:
            n = r.get(8) + 1
            p = _packed(np.cumsum(_channels(pixels(r, n, 1, False)[0]), 0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, p, bits, coded))
            coded = (coded + (1 << bits) - 1) >> bits
    return r, coded, w, h, transforms


def _checked(f):
    """f, damaged data raising ValueError whatever it leads to."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        except (IndexError, KeyError, OverflowError, struct.error) as e:
            raise ValueError("damaged data") from e

    return run


@_checked
def decode(data: bytes) -> np.ndarray:
    """The pixels of one image, ARGB as uint32, rows by columns."""
    r, coded, _, h, transforms = _opened(data)
    return _undone(pixels(r, coded, h, True), transforms)


# ---------------------------------------------------------------- decoding many images


@_checked
def decode_many(images: list[bytes]) -> list[np.ndarray]:
    """decode() of each; those with one group of codes and no cache side by side, if they have no back-references or one channel."""
    out: list = [None] * len(images)
    literal, referred = [], []
    for k, data in enumerate(images):
        r, coded, _, h, transforms = _opened(data)
        head = _entropy(r, coded, h, True)
        one = head[3][0]
        if head[0] or head[1] is not None:
            out[k] = _undone(pixels(r, coded, h, True, head), transforms)
        elif int(one[0][0].max()) >> 4 < 256:
            literal.append((k, coded * h, coded, h, r, transforms, one))
        elif not (one[1][1] or one[2][1] or one[3][1]):
            referred.append((k, coded * h, coded, h, r, transforms, one))
        else:
            out[k] = _undone(pixels(r, coded, h, True, head), transforms)
    for plain, decoded, most in ((literal, _side_by_side, 24_000_000), (referred, _with_references, 8_000_000)):
        plain.sort(key=lambda x: -x[1])
        lo = 0
        while lo < len(plain):  # of like sizes, and a bounded number of pixels
            hi = min(len(plain), lo + max(1, most // plain[lo][1]))
            for (k, n, w, h, _, transforms, _), x in zip(plain[lo:hi], decoded(plain[lo:hi])):
                out[k] = _undone(x.reshape(h, w), transforms)
            lo = hi
    return out


def _streams(plain: list, codes: tuple[int, ...]):
    """The data as 64 bits from each 32-bit word, the bit at which each image's pixels begin and its data end, and the tables of the codes listed."""
    raw, start, end, at = [], np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), 0
    for k, x in enumerate(plain):
        d = x[4].data + bytes(16 + -len(x[4].data) % 4)
        start[k], end[k] = at * 8 + x[4].place, (at + len(x[4].data)) * 8
        raw.append(d)
        at += len(d)
    w32 = np.frombuffer(b"".join([*raw, bytes(1024)]), "<u4").astype(np.uint64)
    words = (w32[:-1] | w32[1:] << np.uint64(32)).view(np.int64)
    made: dict[bytes, int] = {}
    tables, size = [], 0
    base, mask = np.zeros((len(codes), len(plain)), np.int64), np.zeros((len(codes), len(plain)), np.int64)
    for k, x in enumerate(plain):
        for c, code in enumerate(codes):
            t, bits = x[6][code]
            key = t.tobytes()
            if key not in made:
                made[key] = size
                tables.append(t)
                size += len(t)
            base[c, k], mask[c, k] = made[key], (1 << bits) - 1
    return words, start, end, np.concatenate(tables).astype(np.int64), base, mask


def _with_references(plain: list) -> list[np.ndarray]:
    """Pixels of images whose red, blue and alpha are fixed: the symbols of all, one of each at a time, then copies."""
    words, p, end, table, (base, base2), (mask, mask2) = _streams(plain, (0, 4))
    sizes = np.array([x[1] for x in plain])
    steps, images = int(sizes.max()), len(plain)
    symbol, count = np.zeros((steps, images), np.int16), np.zeros(images, np.int64)
    own, left, t, found = np.arange(images), sizes.copy(), 0, []
    while len(own):
        m = min(32, steps - t)  # steps until those that are done go; what they read in between isn't used
        if m <= 0:
            raise ValueError("more symbols than pixels")
        symbols, place, togo = np.zeros((m, len(own)), np.int16), np.zeros((m, len(own)), np.int64), np.zeros((m, len(own)), np.int64)
        for j in range(m):
            s = table[base + (words[p >> 5] >> (p & 31) & mask)]
            p += s & 15
            s >>= 4
            symbols[j] = s
            left -= 1
            ref = (s > 255).nonzero()[0]
            if len(ref):
                q, k = p[ref], s[ref] - 256
                e = EXTRA[k]
                n = LEAST[k] + (words[q >> 5] >> (q & 31) & (1 << e) - 1)
                q += e
                k = table[base2[ref] + (words[q >> 5] >> (q & 31) & mask2[ref])]
                q += k & 15
                k >>= 4
                e = EXTRA[k]
                d = LEAST[k] + (words[q >> 5] >> (q & 31) & (1 << e) - 1)
                p[ref] = q + e
                left[ref] -= n - 1
                found.append((own[ref], np.full(len(ref), t + j), n, d))
            place[j], togo[j] = p, left
        symbol[t : t + m, own] = symbols
        t += m
        done = left <= 0
        if done.any():
            gone = done.nonzero()[0]
            last = (togo[:, gone] <= 0).argmax(0)
            if togo[last, gone].any():
                raise ValueError("back-reference out of the image")
            if (place[last, gone] > end[own[gone]]).any():
                raise ValueError("data ends early")
            count[own[gone]] = t - m + last + 1
            keep = ~done
            own, left, p, base, mask, base2, mask2 = (x[keep] for x in (own, left, p, base, mask, base2, mask2))
        if len(p) and int(p.max()) > 32 * len(words) - 4096:
            raise ValueError("data ends early")
    symbol = np.ascontiguousarray(symbol[:t].T)
    image, at, length, far = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((4, 0), np.int64)
    real = at < count[image]
    order = real.nonzero()[0][np.argsort(image[real], kind="stable")]
    image, at, length, far = image[order], at[order], length[order], far[order]
    w = np.array([x[2] for x in plain])[image]
    near = np.minimum(far, 120)
    far = np.where(far > 120, far - 120, np.maximum(1, NEAR_X[near] + NEAR_Y[near] * w))
    cut = np.searchsorted(image, np.arange(images + 1)).tolist()
    at, length, far, out = at.tolist(), length.tolist(), far.tolist(), []
    for k, (n, x) in enumerate(zip(count.tolist(), plain)):
        fixed = [int(x[6][c][0][0]) >> 4 for c in (1, 2, 3)]
        a, b = cut[k], cut[k + 1]
        green = np.frombuffer(_copied(symbol[k, :n].astype(np.uint8).tobytes(), at[a:b], length[a:b], far[a:b]), np.uint8)
        out.append(np.uint32(fixed[2] << 24 | fixed[0] << 16 | fixed[1]) | green.astype(np.uint32) << np.uint32(8))
    return out


NEAR_X, NEAR_Y = (np.array([0] + [d[c] for d in DISTANCES]) for c in (0, 1))


def _copied(symbols: bytes, at: list[int], length: list[int], far: list[int]) -> bytearray:
    """The symbols of one channel, each of those at `at` replaced by `length` pixels from `far` back."""
    out, last = bytearray(), 0
    for j, n, d in zip(at, length, far):
        out += symbols[last:j]
        last = j + 1
        k = len(out) - d
        if k < 0:
            raise ValueError("back-reference out of the image")
        if d >= n:
            out += out[k : k + n]
        else:
            out += (out[k:] * (n // d + 1))[:n]
    out += symbols[last:]
    return out


def _side_by_side(plain: list) -> list[np.ndarray]:
    sizes = np.array([x[1] for x in plain])
    words, start, _, table, base, mask = _streams(plain, (0, 1, 2, 3))
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # how many have a pixel t
    shift = (8, 16, 0, 24)  # green, red, blue, alpha
    coded = [c for c in range(4) if mask[c].any()]
    fixed = sum(((table[base[c]] >> 4) << shift[c] for c in range(4) if c not in coded), np.zeros(len(plain), np.int64)).astype(np.uint32)
    out = [np.zeros((steps, len(plain)), np.uint8) for _ in coded]
    p = start.copy()
    for t in range(steps):
        m = int(live[t])
        if m < len(p):
            p = p[:m]
            base, mask = np.ascontiguousarray(base[:, :m]), np.ascontiguousarray(mask[:, :m])
        for c, o in zip(coded, out):
            v = words[p >> 5] >> (p & 31)  # the sign fills bits that no mask of 15 reaches
            s = table[base[c] + (v & mask[c])]
            p = p + (s & 15)
            o[t, :m] = s >> 4
    whole = []
    for k, n in enumerate(sizes.tolist()):
        x = np.full(n, fixed[k], np.uint32)
        for c, o in zip(coded, out):
            x |= o[:n, k].astype(np.uint32) << np.uint32(shift[c])
        whole.append(x)
    return whole


# ---------------------------------------------------------------- encoding


def _prefix_of(v: int) -> tuple[int, int, int]:
    """A length or distance as prefix symbol, extra bits and their number."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _write_pixels(wr: Writer, x: np.ndarray, main: bool, cache: int = 0, runs: bool = False) -> None:
    """An entropy-coded image, symbol by symbol."""
    wr.put(bool(cache), 1)
    if cache:
        wr.put(cache, 4)
    if main:
        wr.put(0, 1)
    flat = x.ravel().tolist()
    colours = [0] * (1 << cache)
    ops, k = [], 0
    while k < len(flat):
        n = 0
        if runs and k:
            while k + n < len(flat) and n < 4096 and flat[k + n] == flat[k - 1]:
                n += 1
        v = flat[k]
        at = (CACHE_HASH * v & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        if n >= 3:
            ops.append((256 + _prefix_of(n)[0], *_prefix_of(n)[1:]))
            k += n
        elif cache and colours[at] == v and k:
            ops.append((280 + at, 0, 0))
            k += 1
        else:
            ops.append((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
            k += 1
            colours[at] = v
    count: list[dict[int, int]] = [{}, {}, {}, {}, {}]
    far = _prefix_of(2)  # the distance code of the pixel to the left
    for o in ops:
        count[0][o[0]] = count[0].get(o[0], 0) + 1
        if len(o) == 4:
            for c in range(1, 4):
                count[c][o[c]] = count[c].get(o[c], 0) + 1
        elif o[0] < 280:
            count[4][far[0]] = count[4].get(far[0], 0) + 1
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    codes = [wr.code(code_lengths(c), n) for c, n in zip(count, sizes)]
    for o in ops:
        wr.put(*codes[0][o[0]])
        if len(o) == 4:
            for c in range(1, 4):
                wr.put(*codes[c][o[c]])
        elif o[0] < 280:
            wr.put(o[1], o[2])
            wr.put(*codes[4][far[0]])
            wr.put(far[1], far[2])


def _file(body: bytes) -> bytes:
    body = b"\x2f" + body
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(x: np.ndarray, transforms: tuple[int, ...] = (), cache: int = 0, runs: bool = False, bits: int = 2, seed: int = 0) -> bytes:
    """One image, symbol by symbol, with transforms (their numbers, in order), a colour cache and runs as back-references."""
    h, w = x.shape
    wr, rng = Writer(), np.random.default_rng(seed)
    wr.put(w - 1, 14)
    wr.put(h - 1, 14)
    wr.put(1, 1)
    wr.put(0, 3)
    for t in transforms:
        wr.put(1, 1)
        wr.put(t, 2)
        bh, bw = (h + (1 << bits) - 1) >> bits, (x.shape[1] + (1 << bits) - 1) >> bits
        if t == PREDICTOR:
            modes = rng.integers(0, 14, (bh, bw)).astype(np.uint32)
            wr.put(bits - 2, 3)
            _write_pixels(wr, 0xFF000000 | modes << 8, False)
            x = predicted(x, modes, bits, False)
        elif t == CROSS:
            f = rng.integers(0, 1 << 24, (bh, bw)).astype(np.uint32)
            wr.put(bits - 2, 3)
            _write_pixels(wr, 0xFF000000 | f, False)
            x = crossed(x, f, bits, False)
        elif t == SUBTRACT:
            x = greened(x, False)
        else:
            p, ix = np.unique(x, return_inverse=True)
            ix = ix.reshape(x.shape)
            if len(p) > 256:
                raise ValueError("too many colours for a palette")
            wr.put(len(p) - 1, 8)
            c = _channels(p)
            _write_pixels(wr, _packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :], False)
            b = 3 if len(p) <= 2 else 2 if len(p) <= 4 else 1 if len(p) <= 16 else 0
            each = 8 >> b
            wide = np.pad(ix, ((0, 0), (0, -x.shape[1] % (1 << b)))).reshape(h, -1, 1 << b)
            x = (0xFF000000 | (wide << (np.arange(1 << b) * each)).sum(2) << 8).astype(np.uint32)
    wr.put(0, 1)
    _write_pixels(wr, x, True, cache, runs)
    return _file(wr.bytes())


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads (whole numbers of rows of WIDTH bytes) as images: the shortest of the forms that the module names."""
    out = [b""] * len(payloads)
    lo = 0
    while lo < len(payloads):
        hi, total = lo, 0
        while hi < len(payloads) and (hi == lo or total < 100_000):
            total += len(payloads[hi])
            hi += 1
        some = payloads[lo:hi]
        forms = [(k, WIDTH, p, _subtracted(), 255) for k, p in enumerate(some)]
        forms += [f for k, p in enumerate(some) if len(set(p)) <= COLOURS for f in [_palette_form(k, p)]]
        forms += [_predictor_form(k, some[k]) for k in _predictable(some)]
        best: list = [None] * len(some)
        for w in sorted({f[1] for f in forms}):
            same = [f for f in forms if f[1] == w]
            for f, data in zip(same, _encode_forms([f[2] for f in same], w, [f[3] for f in same], [f[4] for f in same])):
                best[f[0]] = min(best[f[0]] or data, data, key=len)
        for k, p in enumerate(some):
            if len(p) <= TILE and len(set(p)) <= COLOURS:
                best[k] = min(best[k], encode(_grey(p), (SUBTRACT, PALETTE), 4, True), key=len)
        out[lo:hi] = best
        lo = hi
    return out


def _grey(p: bytes) -> np.ndarray:
    return np.uint32(0xFF000000) | np.frombuffer(p, np.uint8).astype(np.uint32).reshape(-1, WIDTH) * np.uint32(0x010101)


def _subtracted() -> Writer:
    wr = Writer()
    wr.put(1, 1)
    wr.put(SUBTRACT, 2)
    return wr


def _palette_form(k: int, p: bytes) -> tuple:
    """Payload k with a palette: (k, columns, samples, transforms as written, alpha)."""
    colours, ix = np.unique(np.frombuffer(p, np.uint8), return_inverse=True)
    wr = _subtracted()
    wr.put(1, 1)
    wr.put(PALETTE, 2)
    wr.put(len(colours) - 1, 8)
    delta = np.diff(colours, prepend=np.uint8(0)).astype(np.uint32) << np.uint32(8)
    delta[0] |= np.uint32(0xFF000000)
    _write_pixels(wr, delta[None, :], False)
    b = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    each = 8 >> b
    x = (ix.reshape(-1, 1 << b) << np.arange(1 << b) * each).sum(1).astype(np.uint8)
    return k, WIDTH >> b, x.tobytes(), wr, 255


def _log(x: np.ndarray) -> np.ndarray:
    """Logarithms in 1/256 bits: whole, so that sums don't depend on what else is encoded."""
    return np.rint(np.log2(np.maximum(x, 1)) * 256).astype(np.int64)


def _bits(count: np.ndarray) -> np.ndarray:
    """Of each row of counts, the bits (in 1/256) of its symbols at their entropy, and some for the code of those used."""
    n = count.sum(1)
    return n * _log(n) - (count * _log(count)).sum(1) + 5 * 256 * (count > 0).sum(1)


def _predictable(payloads: list[bytes]) -> list[int]:
    """The payloads whose differences from the left or from above have less entropy than the samples."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    own = np.repeat(np.arange(len(payloads)) * 256, [len(p) for p in payloads])
    first = np.cumsum([0] + [len(p) for p in payloads[:-1]])
    bits = []
    for back in (0, 1, WIDTH):
        d = flat.copy()
        if back:
            d[back:] -= flat[: len(flat) - back]
            head = (first[:, None] + np.arange(back)).ravel()
            d[head] = flat[head]
        bits.append(_bits(np.bincount(own + d, minlength=256 * len(payloads)).reshape(-1, 256)))
    return np.flatnonzero(np.minimum(bits[1], bits[2]) < bits[0]).tolist()


def _predictor_form(k: int, p: bytes) -> tuple:
    """Payload k as residuals of the predictor, for each block the one of least differences."""
    x = np.frombuffer(p, np.uint8).reshape(-1, WIDTH).astype(np.int16)
    h = len(x)
    left, top, tl, tr = (np.zeros_like(x) for _ in range(4))
    left[:, 1:] = x[:, :-1]
    top[1:] = x[:-1]
    tl[1:, 1:] = x[:-1, :-1]
    tr[1:, :-1] = x[:-1, 1:]
    tr[1:, -1] = x[1:, 0]
    half = lambda a, b: a + b >> 1
    avg = half(left, top)
    turn = avg - tl
    guesses = [
        np.zeros_like(x), left, top, tr, tl, half(half(left, tr), top), half(left, tl), avg, half(tl, top), half(top, tr), half(half(left, tl), half(top, tr)),
        np.where(abs(top - tl) < abs(left - tl), left, top), np.clip(left + top - tl, 0, 255), np.clip(avg + np.sign(turn) * (abs(turn) >> 1), 0, 255),
    ]
    bh, bw = (h + (1 << BLOCK) - 1) >> BLOCK, WIDTH >> BLOCK
    residual, cost = [], []
    for g in guesses:
        r = x - g
        r[0] = x[0] - left[0]
        r[1:, 0] = x[1:, 0] - x[:-1, 0]
        residual.append(r & 255)
        wide = np.pad(abs((r + 128 & 255) - 128), ((0, (bh << BLOCK) - h), (0, 0)))
        cost.append(wide.reshape(bh, 1 << BLOCK, bw, 1 << BLOCK).sum((1, 3), dtype=np.int64))
    modes = np.argmin(cost, 0)
    each = modes[(np.arange(h) >> BLOCK)[:, None], (np.arange(WIDTH) >> BLOCK)[None, :]]
    wr = _subtracted()
    wr.put(1, 1)
    wr.put(PREDICTOR, 2)
    wr.put(BLOCK - 2, 3)
    _write_pixels(wr, 0xFF000000 | modes.astype(np.uint32) << np.uint32(8), False)
    return k, WIDTH, np.choose(each, residual).astype(np.uint8).tobytes(), wr, 0


def _encode_some(payloads: list[bytes]) -> list[bytes]:
    """Payloads as literals of the samples under one code, without back-references."""
    return _encode_forms(payloads, WIDTH, [_subtracted() for _ in payloads], [255] * len(payloads), False)


@functools.cache
def _near(w: int) -> np.ndarray:
    """What a distance (in pixels, of an image w wide) is written as, for those within the map of near ones."""
    out = np.arange(9 * w + 9) + 120
    for k in range(len(DISTANCES), 0, -1):
        x, y = DISTANCES[k - 1]
        out[max(1, x + y * w)] = k
    return out


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix_of() of many."""
    p = _symbols(int(v.max(initial=1)).bit_length())[v]
    return p, v - LEAST[p], EXTRA[p]


@functools.cache
def _symbols(bits: int) -> np.ndarray:
    """The prefix symbols of all values below 1 << bits."""
    return np.searchsorted(LEAST, np.arange(1 << bits), "right") - 1


def _references(data: bytes, flat: np.ndarray, own: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references of images that follow each other: where, of how many pixels, and how far back."""
    n = len(flat)
    padded = np.concatenate([flat, np.zeros(COMPARED + 8, np.uint8)]).astype(np.uint64)
    two = padded[:-1] | padded[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    ends = np.cumsum(sizes)
    first, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)  # as many for all batches of tiles: equal texts, equal references
    places = np.arange(n, dtype=np.uint64)
    before = np.full(n, -1, np.int64)
    for grams in (four[:n], eight[:n]):  # the last place of 8 equal pixels goes before that of 4
        key = grams * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key &= ~low
        key |= places
        key.sort()
        same = ((key[1:] ^ key[:-1]) <= low).nonzero()[0]
        key = (key & low).view(np.int64)
        at, to = key[same + 1], key[same]
        real = (to >= first[at]) & (grams[at] == grams[to])
        before[at[real]] = to[real]
    at = ((before >= 0) & (end - np.arange(n) >= SHORTEST)).nonzero()[0]
    to, room = before[at], np.minimum(end[at] - at, FARTHEST)
    size = np.zeros(len(at), np.int64)
    go = np.arange(len(at))
    for k in range(0, COMPARED, 8):
        x = eight[at[go] + k] ^ eight[to[go] + k]
        size[go] += np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3)
        go = go[x == 0]
    size = np.minimum(size, room)
    count = np.bincount(own * 256 + flat, minlength=256 * len(sizes)).reshape(-1, 256)
    price = _log(sizes)[:, None] - _log(count)
    paid = np.concatenate([[0], np.cumsum(price.ravel()[own * 256 + flat])])
    saved = np.zeros(n + 1, np.int64)
    saved[at] = paid[at + size] - paid[at] - 256 * (9 + _prefixes(_coded_distance(at - to, w))[2] + _prefixes(size)[2])
    taken = (saved[at] > 0) & (saved[at + 1] <= saved[at]) & (size >= SHORTEST)
    at, to, size, room = at[taken], to[taken], size[taken], room[taken]
    after = np.searchsorted(at, at + size)  # the next that can be taken
    after[(size == COMPARED) & (room > COMPARED)] = -1  # may be longer
    chosen, after, k = [], after.tolist(), 0
    while k < len(after):
        chosen.append(k)
        if after[k] < 0:
            i, j, m, most = int(at[k]), int(to[k]), COMPARED, int(room[k])
            while m < most and data[i + m : i + m + 64] == data[j + m : j + m + 64]:
                m += 64
            while m < most and data[i + m] == data[j + m]:
                m += 1
            size[k] = min(m, most)
            k = int(np.searchsorted(at, i + size[k]))
        else:
            k = after[k]
    chosen = np.array(chosen, np.int64)
    return at[chosen], size[chosen], (at - to)[chosen]


def _coded_distance(d: np.ndarray, w: int) -> np.ndarray:
    near = _near(w)
    return np.where(d < len(near), near[np.minimum(d, len(near) - 1)], d + 120)


def _starts(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where symbols begin among n pixels, of which `size` from each `at` on are one."""
    inner = np.zeros(n + 1, np.int8)
    inner[at + 1] = 1
    inner[at + size] -= 1
    return (np.cumsum(inner[:n], dtype=np.int8) == 0).nonzero()[0]


def _encode_forms(images: list[bytes], w: int, transforms: list[Writer], alpha: list[int], refer: bool = True) -> list[bytes]:
    """Images of one channel, w wide, after the transforms given; bits are joined on arrays."""
    sizes = np.array([len(x) for x in images])
    data = b"".join(images)
    flat = np.frombuffer(data, np.uint8)
    own = np.repeat(np.arange(len(images)), sizes)
    starts, symbol = np.arange(len(flat)), flat.astype(np.int64)
    at = size = far = np.zeros(0, np.int64)
    if refer:
        at, size, far = _references(data, flat, own, sizes, w)
        plain = np.bincount(own * 256 + flat, minlength=256 * len(images)).reshape(-1, 256)
        starts = _starts(len(flat), at, size)
        symbol[at] = 256 + _prefixes(size)[0]
        to, _, n = _prefixes(_coded_distance(far, w))
        bits = _bits(np.bincount(own[starts] * 280 + symbol[starts], minlength=280 * len(images)).reshape(-1, 280))
        bits += _bits(np.bincount(own[at] * 40 + to, minlength=40 * len(images)).reshape(-1, 40)) + 256 * np.bincount(own[at], n + _prefixes(size)[2], len(images)).astype(np.int64)
        shorter = bits < _bits(plain)
        if not shorter.all():
            longer = at[~shorter[own[at]]]
            symbol[longer] = flat[longer]
            keep = shorter[own[at]]
            at, size, far = at[keep], size[keep], far[keep]
            starts = _starts(len(flat), at, size)
    ref = np.searchsorted(starts, at)
    own, symbol = own[starts], symbol[starts]
    _, extra, extra_bits = _prefixes(size)
    to, rest, rest_bits = _prefixes(_coded_distance(far, w))
    counts = np.bincount(own * 280 + symbol, minlength=280 * len(images)).reshape(-1, 280)
    counts2 = np.bincount(own[ref] * 40 + to, minlength=40 * len(images)).reshape(-1, 40)
    codes, lens = np.zeros((len(images), 280), np.uint64), np.zeros((len(images), 280), np.int64)
    codes2, lens2 = np.zeros((len(images), 40), np.uint64), np.zeros((len(images), 40), np.int64)
    heads = []
    for k, n in enumerate(sizes.tolist()):
        wr = Writer()
        wr.put(WIDTH - 1, 14)
        wr.put(n // w - 1, 14)
        wr.put(0, 1 + 3)  # no alpha, version
        wr.put(transforms[k].value, transforms[k].size)
        wr.put(0, 1 + 1 + 1)  # no more transforms, no colour cache or meta codes
        for one, c, code, lengths in ((-1, counts, codes, lens), (0, None, None, None), (0, None, None, None), (alpha[k], None, None, None), (-1, counts2, codes2, lens2)):
            if one >= 0:  # red, blue, alpha
                wr.code({one: 1}, 256)
                continue
            used = np.flatnonzero(c[k])
            made = wr.code(code_lengths(dict(zip(used.tolist(), c[k, used].tolist())), WRITTEN), c.shape[1])
            if len(used):
                pairs = [made[s] for s in used.tolist()]
                code[k, used], lengths[k, used] = [x[0] for x in pairs], [x[1] for x in pairs]
        heads.append(wr)
    bits, n = codes.ravel()[own * 280 + symbol], lens.ravel()[own * 280 + symbol]
    if len(ref):
        b, m = bits[ref], n[ref].astype(np.uint64)
        for value, size in ((extra, extra_bits), (codes2.ravel()[own[ref] * 40 + to], lens2.ravel()[own[ref] * 40 + to]), (rest, rest_bits)):
            b |= value.astype(np.uint64) << m
            m += size.astype(np.uint64)
        bits[ref], n[ref] = b, m.astype(np.int64)
    first = np.searchsorted(own, np.arange(len(images)))
    total = np.add.reduceat(n, first)
    each = np.diff(np.append(first, len(own)))
    start = np.array([x.size for x in heads])
    room = (start + total + 63) // 64 * 64 + 64
    base = np.cumsum(room) - room
    at = np.cumsum(n) - n
    at += np.repeat(base + start - (np.cumsum(total) - total), each)
    words = np.zeros(int(room.sum()) // 64, np.uint64)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    low = bits << off
    high = np.where(off > 0, bits >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[new]] = np.bitwise_or.reduceat(low, new)
    spill = np.flatnonzero(high)
    words[word[spill] + 1] |= high[spill]  # one symbol at most runs into a word
    raw = words.tobytes()
    out = []
    for k, x in enumerate(heads):
        n = -(-int(start[k] + total[k]) // 8)
        a = int(base[k]) // 8
        body = bytearray(raw[a : a + n])
        head = x.value.to_bytes(-(-x.size // 8), "little")
        m = len(head)
        body[:m] = (int.from_bytes(body[:m], "little") | x.value).to_bytes(m, "little") if m <= n else head
        out.append(_file(bytes(body)))
    return out


# ---------------------------------------------------------------- the operator


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0), len(raw)


def media_of(payloads: list[bytes]) -> list[bytes]:
    """The stored form of payloads: WebP files, one for each TILE bytes."""
    tiles = [p[k : k + TILE] for p in payloads for k in range(0, len(p), TILE)]
    files, at, out = encode_many(tiles), 0, []
    for p in payloads:
        n = -(-len(p) // TILE)
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def images_of(media: list[bytes]) -> list[list[np.ndarray]]:
    """The images of stored forms."""
    files, counts = [], []
    for m in media:
        at, n = 0, 0
        while at < len(m):
            size = 8 + struct.unpack_from("<I", m, at + 4)[0]
            files.append(m[at : at + size])
            at, n = at + size, n + 1
        counts.append(n)
    images, at, out = decode_many(files), 0, []
    for n in counts:
        out.append(images[at : at + n])
        at += n
    return out


def samples(images: list[np.ndarray]) -> bytes:
    """The green channel of the images, one after the other."""
    return b"".join((x >> 8 & 255).astype(np.uint8).tobytes() for x in images)


def features(images: list[np.ndarray], data: bytes) -> str:
    """Images, width and rows, distinct samples, their mean and mean difference from the left, in thousandths."""
    c = np.frombuffer(data, np.uint8)
    have = np.bincount(c, minlength=256)
    change = int(np.abs(np.diff(c.reshape(-1, images[0].shape[1]).astype(np.int16), axis=1)).sum())
    return f"{len(images)};{images[0].shape[1]}x{sum(len(x) for x in images)};{int((have > 0).sum())};{int(have @ np.arange(256)) * 1000 // len(c)};{change * 1000 // len(c)}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's payload as a WebP file; staged."""

    def run(batches):
        for b in batches:
            made = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media_of([p for p, _ in made]), pa.binary())], ["id", "n_bytes", "media"])

    return C.staged(docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_bytes long, media binary"), "media")


def read(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes the stored files: sizes, digests and features of what they hold."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            files = b.column(2).to_pylist()
            rows = []
            for f, x in zip(files, images_of(files)):
                p = samples(x)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), features(x, p)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]], names)

    return media.mapInArrow(run, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_webp_media(spark, sf_dir: str) -> DataFrame:
    return read(store(C.documents(spark, sf_dir)))
