"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once a worker.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts. For texts made only of
characters on which Python's and the library's classes agree (ASCII without \\x1c-\\x1f, and
U+00C0-U+017F without U+0130) the pieces are cut here, by the classes of all bytes at a time unless a text has
what looks like a contraction, and only pieces not met before go through the
merges, many of them at a time (long ones to the library's model). All other texts, and tokenizers of another
make, are encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pandas as pd

from ploidlens.llm import common as C

LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
SAFE = re.compile("[\x00-\x1b\x20-\x7fÀ-įı-ſ]*")
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = {
    "byte": re.compile(f"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"{SHORT}|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+"),
}
#: What the cut by classes doesn't know: contractions, and two characters between the letters.
SPECIAL = re.compile("'(?:[stmd]|re|ve|ll)|[×÷]")
WHITE, LETTER, DIGIT = 0, 1, 2
#: Bytes of pieces that two words hold, besides their length.
HELD = 15
#: Bytes of the longest pieces that are merged side by side.
WIDTH = 24
#: Pieces that a worker keeps; beyond, it starts anew.
KEEP = 1_000_000


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    out = np.full(256, 3, np.uint8)
    out[list(b" \t\n\v\f\r")] = WHITE
    out[[k for k in range(256) if k >= 128 or chr(k).isalpha()]] = LETTER
    out[list(b"0123456789")] = DIGIT
    return out


CLASSES = _classes()


def cut(texts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where pieces begin and end, and how many each text has; texts without SPECIAL."""
    flat = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    n = len(flat) - 16
    c = CLASSES[flat[:n]]
    white = c == WHITE
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(n + 1, bool)  # of a text
    first[ends] = first[0] = True
    change = np.concatenate([[True], c[1:] != c[:-1]])
    if kind == "word":
        begin = ~white & (change | first[:n] | (c == DIGIT))
        stop = np.flatnonzero(np.concatenate([begin | (white & change), [True]]))
        start = np.flatnonzero(begin)
        end = stop[np.searchsorted(stop, start, "right")]
        end = np.minimum(end, ends[np.searchsorted(ends, start, "right")])
    else:
        before = np.concatenate([[False], white[:-1]])
        last = np.concatenate([~white[1:], [False]]) & ~first[1:]  # white space before something else
        attached = np.concatenate([[False], flat[: n - 1] == 32]) & before
        begin = first[:n] | np.where(white, ~before | last, change & ~attached)
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
    count = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    return flat, start, end, count


class Merges:
    """The merges of a byte-level BPE, for many pieces side by side: of each piece, the pair of the lowest rank, leftmost, becomes one symbol, until none has a rank."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict, chars: dict[int, str]):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        rank = np.arange(len(key), dtype=np.int32)
        o = np.unique(key, return_index=True)[1]  # a pair listed twice has its first rank
        key, rank = key[o], rank[o]
        rng, self.tables = np.random.default_rng(1), []
        while len(key):  # what finds its place taken goes to the next table
            factor, bits = int(rng.integers(1 << 62)) | 1, max(10, len(key).bit_length() + 3)
            at = self._place(key, factor, bits)
            own = np.unique(at, return_index=True)[1]
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
            keys[at[own]], ranks[at[own]] = key[own], rank[own]
            self.tables.append((keys, ranks, factor, bits))
            key, rank = np.delete(key, own), np.delete(rank, own)

    @staticmethod
    def _place(key: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        out, left = np.full(key.shape, self.NONE, np.int32), np.flatnonzero((a >= 0) & (b >= 0))
        flat, given = key.ravel(), out.ravel()
        for keys, ranks, factor, bits in self.tables:
            k = flat[left]
            at = self._place(k, factor, bits)
            held = keys[at]
            hit = held == k
            given[left[hit]] = ranks[at[hit]]
            left = left[~hit & (held >= 0)]  # an empty place: in no table
        return given.reshape(key.shape)

    def ids(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of one byte or more and at most WIDTH, one after the other, and how many each has."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        lens, held = np.zeros(len(raw), np.int64), []
        for low, high in ((0, 6), (6, 12), (12, WIDTH)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            at = np.arange(high)
            inside = at < size[rows, None]
            s = np.where(inside, self.first[flat[np.minimum(start[rows, None] + at, len(flat) - 1)]], -1)
            s[np.arange(len(rows)), size[rows] - 1] = self.last[flat[start[rows] + size[rows] - 1]]
            r = np.full(s.shape, self.NONE, np.int32)
            r[:, :-1] = self.ranks(s[:, :-1], s[:, 1:])
            live = np.arange(len(rows))
            while len(live):
                x, q = s[live], r[live]
                best = q.argmin(1)
                n = np.arange(len(live))
                rank = q[n, best]
                go = rank != self.NONE
                live, x, q, best, rank = live[go], x[go], q[go], best[go], rank[go]
                n = n[: len(live)]
                x[n, best] = self.made[rank]
                after = at[:-1] > best[:, None]
                x[:, :-1] = np.where(after, x[:, 1:], x[:, :-1])
                x[:, -1] = -1
                q[:, :-1] = np.where(after, q[:, 1:], q[:, :-1])
                q[:, -1] = self.NONE
                q[n, best] = self.ranks(x[n, best], np.where(best + 1 < high, x[n, np.minimum(best + 1, high - 1)], -1))
                k = np.flatnonzero(best)
                q[k, best[k] - 1] = self.ranks(x[k, best[k] - 1], x[k, best[k]])
                s[live], r[live] = x, q
            held.append((rows, s))
            lens[rows] = (s >= 0).sum(1)
        out, start = np.zeros(int(lens.sum()), np.uint32), np.cumsum(lens) - lens
        for rows, s in held:
            inside = s >= 0
            out[(start[rows, None] + np.arange(s.shape[1]))[inside]] = s[inside]
        return out, lens


class Encoder:
    """ids(texts): the ids of all texts, one after the other, and how many each text has. None is an empty text."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        self.kind = None
        if made["model"]["type"] == "BPE" and not made["model"].get("dropout"):
            if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
                self.kind = "byte"
            elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}:
                self.kind = "word"
        self.added = [t["content"] for t in made["added_tokens"]]
        self.chars = _byte_chars()
        self.merges = Merges(made["model"], self.chars) if self.kind else None
        self._reset()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = array("I"), array("I")
        self.met = np.zeros((0, 3), np.uint64)  # hash and the two words of pieces, by hash
        self.met_row = np.zeros(0, np.int64)

    def _safe(self, t: str) -> bool:
        return self.kind is not None and not any(a in t for a in self.added) and SAFE.fullmatch(t) is not None

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        if len(self.known) + len(self.met) > KEEP:
            self._reset()
        kinds = [2 if not self._safe(t) else 1 if ("'" in t or "×" in t or "÷" in t) and SPECIAL.search(t) else 0 for t in texts]
        low = [t.lower() if self.kind == "word" and k < 2 else t for k, t in zip(kinds, texts)]
        cuts = [PIECES[self.kind].findall(t) for k, t in zip(kinds, low) if k == 1]
        groups = [self._fast([t.encode() for k, t in zip(kinds, low) if not k]), self._listed([p for c in cuts for p in c], [len(c) for c in cuts])]
        if not any(kinds):
            return groups[0]
        held = [iter(np.split(f, np.cumsum(n)[:-1])) for f, n in groups]
        out = [next(held[k]) if k < 2 else np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in zip(kinds, texts)]  # whole ones one by one: such texts may be long
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _listed(self, pieces: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = self._pieces(pieces)
        return flat, self._sums(lens, counts)

    @staticmethod
    def _sums(lens: np.ndarray, counts) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
        return ends[at[1:]] - ends[at[:-1]]

    def _fast(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, start, end, count = cut(texts, self.kind) if any(texts) else (None, [], [], [0] * len(texts))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        size = end - start
        words = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))  # the eight bytes from each place on
        room = np.arange(9, dtype=np.uint64) * np.uint64(8)
        keep = np.append((np.uint64(1) << room[:8]) - np.uint64(1), ~np.uint64(0))
        a = words[start] & keep[np.minimum(size, 8)]
        b = words[np.minimum(start + 8, len(words) - 1)] & keep[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        h = C.mix(a + C.mix(b + np.uint64(7)))
        long = np.flatnonzero(size > HELD)
        h[long] = 0
        code, uniq = pd.factorize(h)
        one = np.empty(len(uniq), np.int64)
        one[code] = np.arange(len(code))
        row = self._met(uniq, a[one], b[one], flat, start[one], end[one])
        if ((a[one[code]] != a) | (b[one[code]] != b)).sum() > len(long):  # two pieces with one hash
            raise ValueError("pieces with equal hashes")
        row = row[code]
        if len(long):
            row[long] = self._rows([bytes(flat[s:e]).decode() for s, e in zip(start[long], end[long])])
        flat, lens = self._of(row)
        return flat, self._sums(lens, count)

    def _met(self, h, a, b, flat, start, end) -> np.ndarray:
        """The rows of short pieces, new ones encoded."""
        at = np.minimum(np.searchsorted(self.met[:, 0], h), max(0, len(self.met) - 1))
        hit = (self.met[at] == np.stack([h, a, b], 1)).all(1) if len(self.met) else np.zeros(len(h), bool)
        row = np.where(hit, self.met_row[at], -1) if len(self.met) else np.full(len(h), -1)
        new = np.flatnonzero(~hit & (h != 0))
        if len(new):
            raw = flat.tobytes()
            row[new] = self._add([raw[s:e] for s, e in zip(start[new].tolist(), end[new].tolist())])
            met = np.concatenate([self.met, np.stack([h[new], a[new], b[new]], 1)])
            rows = np.concatenate([self.met_row, row[new]])
            o = np.argsort(met[:, 0])
            self.met, self.met_row = met[o], rows[o]
        return row

    def _add(self, raw: list[bytes]) -> np.ndarray:
        """Encodes pieces; their rows."""
        first = len(self.size)
        run, chars = self.tok.model.tokenize, self.chars
        long = [k for k, p in enumerate(raw) if len(p) > WIDTH]
        own = [[t.id for t in run(raw[k].decode("latin-1").translate(chars))] for k in long]
        for k in long:
            raw[k] = b""
        got, n = self.merges.ids(raw)
        if long:
            got = np.insert(got, np.repeat((np.cumsum(n) - n)[long], [len(x) for x in own]), [i for x in own for i in x])
            n[long] = [len(x) for x in own]
        self.flat.frombytes(got.astype(np.uint32).tobytes())
        self.size.frombytes(n.astype(np.uint32).tobytes())
        return np.arange(first, len(self.size))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            known.update(zip(new, self._add([p.encode() for p in new]).tolist()))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _of(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.frombuffer(self.size, np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        lens = size[row]
        ends = np.cumsum(lens)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(start[row] - (ends - lens), lens) + np.arange(ends[-1])], lens

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._of(self._rows(pieces)) if pieces else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
