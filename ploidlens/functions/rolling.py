"""Codes of all k-mers of many reads at a time, on arrays: what the column functions of codec do, without strings."""

from __future__ import annotations

import numpy as np

#: Longest k-mer that has a code in a signed 64-bit number.
LONGEST = 31
OTHER, END = 4, 5


def _letters(n_as_a: bool) -> np.ndarray:
    out = np.full(256, 0 if n_as_a else OTHER, np.uint8)
    for k, both in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
        out[list(both)] = k
    out[0] = END
    return out


def codes(seqs: list[str | None], k: int, canonical: bool = True, n_as_a: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all k-mers without other letters, and the place of the read of each. Null and short reads have none."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST}")
    code, _, at, _ = _windows(seqs, k, canonical, n_as_a)
    return code, at


def places(seqs: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all k-mers without other letters: the canonical code, the code as it stands, the place of the read and the place in the read."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST}")
    return _windows(seqs, k, True, False)


def steps(seqs: list[str | None], most: int = 500, letters: int = 4_000_000):
    """Pieces of a list, of so many reads and letters at most (a longer read alone): begin and end."""
    lo, held = 0, 0
    for i, s in enumerate(seqs):
        n = len(s or "")
        if i > lo and (i - lo == most or held + n > letters):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(seqs):
        yield lo, len(seqs)


def _windows(seqs: list[str | None], k: int, canonical: bool, n_as_a: bool):
    raw = [(s or "").encode("ascii", "replace") for s in seqs]
    x = _letters(n_as_a)[np.frombuffer(b"\0".join(raw), np.uint8)]
    n = len(x) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    own = code = _joined(x & 3, k, False)
    if canonical:
        code = np.minimum(code, _joined(3 - (x & 3), k, True))
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    other = np.flatnonzero(x >= OTHER)
    if len(other) * 4 < n:  # few
        ok = np.ones(n, bool)
        for j in range(k):
            ok[(p := other - j)[(p >= 0) & (p < n)]] = False
    else:
        bad = np.concatenate([[0], np.cumsum(x >= OTHER)])
        ok = bad[k:] == bad[:-k]
    at = np.repeat(np.arange(len(raw)), np.diff(starts))[:n][ok]
    return code[ok].astype(np.int64), own[ok].astype(np.int64), at, np.flatnonzero(ok) - starts[at]


def _joined(x: np.ndarray, k: int, back: bool) -> np.ndarray:
    """Numbers of k letters from each place on, in base 4; back: the first letter is the lowest. Pieces of 1, 2, 4, ... letters are put together."""
    kind = np.int32 if k <= 15 else np.int64
    n = len(x) - k + 1
    out, have, piece, width = None, 0, x.astype(kind), 1
    while True:
        if k & width:
            new = piece[have : have + n]
            out = new if out is None else (new << 2 * have) | out if back else (out << 2 * width) | new
            have += width
        if have == k:
            return out
        low, high = (piece[:-width], piece[width:]) if back else (piece[width:], piece[:-width])
        piece, width = (high << 2 * width) | low, 2 * width
