"""Best-fit packing of documents into sequences by bin completion with branch and bound.

Texts become ids and an end id; only those longer than a sequence are cut. How many pieces there
are of each length (at most `capacity` numbers, however many documents) is all that the search
needs: it runs on the driver on these counts, and a filling found once is used for as many
sequences as the counts allow. So the plan has a few thousand rows at any scale.

The search (bin completion): take the largest length left, enumerate the undominated fillings of
the room around it (a filling is dominated if one of its pieces, or a sum of some, can be replaced
by a longer single piece that fits), best fit first. Descending greedily gives an incumbent;
branches whose waste exceeds what the incumbent less one sequence may waste are pruned; the search
ends at the lower bound or after `nodes` branches, with the best incumbent. A branch has up to 16
fillings, looked for in 400 steps.

Pieces then get a rank within their length, by salted partitions, and the rank tells sequence and
offset. Null texts are empty (the end id alone). Repeated rows and ids are packed each; null ids are
kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.llm import common as C
from ploidlens.llm.tokens import Encoder

#: Rows that one salt of a length should have.
SALT_ROWS = 200_000


def _dominated(filling: list[tuple[int, int]], waste: int, count: np.ndarray, there: int) -> bool:
    """Whether a piece left over fits in, or could replace a shorter piece or sum of pieces. there: bits of the lengths counted."""
    sums = 1
    for x, k in filling:
        if k == count[x]:
            there &= ~(1 << x)
        m = 1
        while k > 0:
            sums |= sums << min(m, k) * x
            k, m = k - m, 2 * m
    longer, n = sums << 1, 1
    while n < waste:  # sums and 1 to `waste` more
        m = min(n, waste - n)
        longer, n = longer | longer << m, n + m
    return bool(longer & there)


def fillings(room: int, count: np.ndarray, waste: int, want: int = 4, nodes: int = 3000) -> list[list[int]]:
    """Undominated fillings of the room from the lengths counted, least waste first (at most `want`, none over `waste`).

    A length is placed in multiples, which is one step. When the steps run out, the filling at hand is completed greedily."""
    found: list[tuple[int, list[tuple[int, int]]]] = []
    spare: list[tuple[int, list[tuple[int, int]]]] = []  # the best of the dominated ones
    have: list[tuple[int, int]] = []
    number = np.flatnonzero(count)
    total = np.cumsum(number * count[number]).tolist()
    lengths = number.tolist()
    there = sum(1 << x for x in lengths)
    steps = [nodes]

    def limit() -> int:
        return waste if len(found) < want else min(waste, found[-1][0] - 1)

    def record(room: int) -> None:
        if room > limit():
            return
        if room and _dominated(have, room, count, there):
            if not spare or room < spare[0][0]:
                spare[:] = [(room, have[:])]
            return
        found.append((room, have[:]))
        found.sort(key=lambda f: f[0])
        del found[want:]

    def search(room: int, top: int) -> None:
        steps[0] -= 1
        top = bisect_right(lengths, room, 0, top)
        if not top or steps[0] <= 0:
            n = len(have)
            while top := bisect_right(lengths, room, 0, top):
                top -= 1
                k = min(int(count[lengths[top]]), room // lengths[top])
                have.append((lengths[top], k))
                room -= k * lengths[top]
            record(room)
            del have[n:]
            return
        for i in range(top - 1, -1, -1):
            if room - total[i] > limit():
                return  # even all that are no longer don't fill the room
            x = lengths[i]
            for k in range(min(int(count[x]), room // x), 0, -1):
                have.append((x, k))
                search(room - k * x, i)
                have.pop()
                if steps[0] <= 0 or limit() < 0:
                    return

    search(room, len(lengths))
    if spare and (not found or spare[0][0] < found[0][0]):
        found = (spare + found)[:want]
    return [[x for x, k in f for _ in range(k)] for _, f in found]


def _greedy(count: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Largest first, each time the best filling: (times, lengths) until nothing is left."""
    count, out = count.copy(), []
    while count.any():
        x = int(np.flatnonzero(count)[-1])
        count[x] -= 1
        f = fillings(capacity - x, count, capacity, want=1, nodes=400)
        count[x] += 1
        out.append(_use(count, [x, *(f[0] if f else [])]))
    return out


def _use(count: np.ndarray, lengths: list[int], most: int | None = None) -> tuple[int, list[int]]:
    v, k = np.unique(lengths, return_counts=True)
    m = int((count[v] // k).min())
    m = m if most is None else min(m, most)
    count[v] -= m * k
    return m, lengths


def bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's lower bound L2 on the sequences that are needed."""
    size = np.arange(capacity + 1)
    total, n = np.cumsum(count * size), np.cumsum(count)
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        large = int(n[-1] - n[capacity - k]) if k else 0
        middle = int(n[capacity - k] - n[half])
        room = middle * capacity - int(total[capacity - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def complete(count: np.ndarray, capacity: int, nodes: int = 3000) -> list[tuple[int, list[int]]]:
    """The plan: (times, lengths of a sequence). count[x]: pieces of length x, for x up to capacity."""
    count = count.astype(np.int64)
    best = _greedy(count, capacity)
    bins, low, total = sum(m for m, _ in best), bound(count, capacity), int((count * np.arange(capacity + 1)).sum())
    left = [nodes]
    while bins > low and left[0] > 0:
        target = bins - 1
        found = _branch(count.copy(), capacity, target * capacity - total, left)
        if found is None:
            break
        best, bins = found, sum(m for m, _ in found)
    return best


def _branch(count: np.ndarray, capacity: int, waste: int, left: list[int]) -> list[tuple[int, list[int]]] | None:
    """A plan that wastes no more than `waste`, or None; depth first, least waste first."""
    path: list[tuple[int, list[int]]] = []
    stack: list[list] = []

    def options(waste: int):
        x = int(np.flatnonzero(count)[-1])
        count[x] -= 1
        f = fillings(capacity - x, count, waste, want=16, nodes=400)
        count[x] += 1
        return [[x, *g] for g in f]

    spent = 0
    while True:
        if not count.any():
            return path
        left[0] -= 1
        stack.append(options(waste - spent) if left[0] > 0 else [])
        while stack and not stack[-1]:
            stack.pop()
            if not path:
                return None
            m, f = path.pop()
            v, k = np.unique(f, return_counts=True)
            count[v] += m * k
            spent -= m * (capacity - sum(f))
        if not stack:
            return None
        f = stack[-1].pop(0)
        w = capacity - sum(f)
        path.append(_use(count, f, (waste - spent) // w if w else None))
        spent += path[-1][0] * w


def slots(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, ranks, of one sequence, first sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for m, lengths in plan:
        offset = 0
        for v, k in zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))):
            out.append((v, rank.get(v, 0), m * k, k, sequence, offset))
            rank[v] = rank.get(v, 0) + m * k
            offset += v * k
        sequence += m
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        enc = Encoder.of(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids, sizes = enc.ids(part.column(1).to_pylist())
                raw = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes()
                ends = np.cumsum(sizes + 1)
                rows = []
                for k, (e, n) in enumerate(zip(ends.tolist(), (sizes + 1).tolist())):
                    for p, s in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - s)
                        at = 4 * (e - n + s)
                        rows.append((k, p, s, m, zlib.crc32(raw[at : at + 4 * m])))
                k, p, s, m, c = zip(*rows)
                yield pa.record_batch([part.column(0).take(pa.array(k)), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = C.staged(rows.mapInArrow(C.released(_cut(tokenizer, capacity, end_id)), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `capacity` rows
        count[r["length"]] = r["count"]
    plan = slots(complete(count, capacity))
    salts = max(16, int(count.max()) // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = rows.groupBy("length", "salt").count()
    base = base.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("base"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece"))).join(base, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rn") - 1).alias("rank"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        key = plan[:, 0] << 40 | plan[:, 1]
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = plan[np.searchsorted(key, n << 40 | r, "right") - 1]
            j = r - at[:, 1]
            yield pa.record_batch([*b.columns[:5], pa.array(at[:, 4] + j // at[:, 3]), pa.array(at[:, 5] + j % at[:, 3] * n)], names)

    return ranked.mapInArrow(C.released(place), f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
