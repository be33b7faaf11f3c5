"""Exact n-gram Jaccard self-join of documents by a blocked sparse matrix product.

The product of the document by n-gram incidence matrix with its own transpose holds the overlap of
every pair. It is computed in blocks, and only in those that can hold a linked pair:

1. Each text becomes its set of distinct n-word shingles (64-bit hashes). Texts with equal sets
   form a class (a 128-bit hash of the set); only one row of the matrix stands for a class.
2. Size bounds: a link of a set of n shingles needs ceil(n num/den) common ones. So of any one order
   of all shingles, the first n - ceil(n num/den) + 1 of two linked sets have one in common, and their
   sizes are within the ratio num/den. The order is by how many classes a shingle occurs in, rarest first: the
   columns of the matrix are dealt by hash to count them, and only entries of columns with two rows or
   more return, to the tasks' shares of rows they came from. A set with too many shingles of its own has no
   link and drops out; passages that many documents share come last. Columns of the most frequent shingles
   (by counts of 1 << BITS buckets, 4 MB that go to all tasks) aren't dealt; they are the last in the order. Classes
   with one of their first shingles in common, in order of
   size, are chained one to the next wherever sizes allow a link, within a task first, then across
   tasks. No pair of a group is listed: the connected components are the candidate blocks.
3. In each block (large ones are split into sub-blocks, and each pair of sub-blocks is a task), the
   sparse product accumulates overlap counts: rare columns by their few pairs, frequent ones by
   dense strips. Pairs below the bounds are dropped, links counted, and a spanning forest kept.

Nulls and texts without words: an empty set, no links. Texts with fewer than n words: the whole
sequence is one shingle. Repeated rows (and repeated doc_ids) each keep a row; rows with a null
doc_id keep theirs, and link as others do (their component is null if it has no id at all). Empty table:
no rows. Other columns of the input are ignored. Ids must be whole numbers, or text that is one; another
text raises. Two shingles with one 64-bit hash would count as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.llm import common as C

U64 = np.uint64
#: Classes and shingles in a sub-block at most (24 MB of hashes); a block has four sub-blocks if each gets LEAST classes.
ROWS, SHINGLES, LEAST = 6000, 3_000_000, 512
#: Columns with at most so many rows are multiplied pair by pair, others in dense strips.
SPARSE = 12
#: Entries of the matrix that a task holds at a time, and those of a shard of columns.
ENTRIES, SHARD = 2_000_000, 1_500_000
#: Buckets of shingles, by the first bits of their hashes, whose counts tell the most frequent; a segment is one row.
BITS, SEGMENT = 22, 1 << 16
#: A shingle whose bucket has over four times the mean count and this is among the most frequent.
HEAVY = 4096
#: Candidates up to this number go to all tasks (32 bytes each), so that only their texts are moved.
FEW = 1_000_000


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    docs = [C.ascii_words(t) for t in texts]
    h, ends = C.word_hashes(docs)
    if len(h) >= n:
        s = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            s = C.mix(s + h[k : len(h) - n + 1 + k])
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            x = np.array([b - a], U64)
            for w in h[a:b]:
                x = C.mix(x + w + U64(7))
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def needed(n, num: int, den: int):
    """How many shingles of a set of n a linked set has, too, at least."""
    return -(-num * n // den)


def prefix(own: np.ndarray, often: np.ndarray, h: np.ndarray, size: np.ndarray, heavy: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which entries (own: row, often: classes with the shingle, two at least, h: its hash) are among the first of their row.

    size, heavy: of each row, all its shingles and those of the most frequent. The shingles that a row has alone come
    first, then these entries by often and h, then the most frequent."""
    o = np.lexsort((h, often, own))
    own = own[o]
    have = np.bincount(own, minlength=len(size))
    alone = size - heavy - have
    first = size - needed(size, num, den) + 1 - alone
    return o[np.arange(len(own)) - (np.cumsum(have) - have)[own] < first[own]]


def _node(x: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return tuple(v - (v >> 63 << 64) for v in (h >> 64, h & (1 << 64) - 1))


FEATURES = f"id long, t long, n long, node {C.NODE}, segment int, counts binary"


def _features(n: int):
    """For each row its set's size and class; and for each task counts of the buckets of its shingles, each class once."""

    def run(batches):
        count, seen = np.zeros(1 << BITS, np.uint32), set()
        for b in C.slices(batches, 2):
            sets = shingle_sets(b.column(2).to_pylist(), n)
            node = [_node(x) for x in sets]
            new = [x for x, v in zip(sets, node) if len(x) and not (v in seen or seen.add(v))]
            if new:
                count += np.bincount((np.concatenate(new) >> U64(64 - BITS)).astype(np.int64), minlength=len(count)).astype(np.uint32)
            full = np.array([len(x) > 0 for x in sets], bool)
            v = np.array(node, np.int64).reshape(-1, 2)
            v = pa.StructArray.from_arrays([pa.array(v[:, 0].copy()), pa.array(v[:, 1].copy())], ["a", "b"], mask=pa.array(~full))
            m = len(sets)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), v, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["id", "t", "n", "node", "segment", "counts"])
        for k in range(0, len(count) // SEGMENT if seen else 0):
            part = pa.compress(count[k * SEGMENT : (k + 1) * SEGMENT].tobytes(), "zstd", asbytes=True)
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, v.type), pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["id", "t", "n", "node", "segment", "counts"])

    return run


def levels(features: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket a byte, eight times the base-2 logarithm of its count (1 << BITS bytes whatever the input), and the least byte of the most frequent."""

    def run(batches):
        for (k,), t in C.groups_of(batches, ["segment"]):
            total = np.zeros(SEGMENT)
            for x in t.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(x, 4 * SEGMENT, "zstd"), np.uint32)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([total.sum()]), pa.array([np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8).tobytes()], pa.binary())], ["segment", "total", "level"])

    out, total = np.zeros(1 << BITS, np.uint8), 0.0
    rows = features.filter("segment is not null").select("segment", "counts").repartition("segment").sortWithinPartitions("segment")
    for r in rows.mapInArrow(C.released(run), "segment int, total double, level binary").collect():  # 64 rows of 64 KB
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["level"], np.uint8)
        total += r["total"]
    return out, min(255, int(8 * np.log2(1 + HEAVY + 4 * total / len(out))))


def _packed(x: np.ndarray, kind: str) -> bytes:
    """An array with the bytes of like weight together, compressed; ascending ones as differences."""
    x = x.astype(kind)
    if kind == "<u8":
        x = np.diff(x, prepend=x.dtype.type(0))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n).T
    x = np.ascontiguousarray(raw).view(kind).ravel()
    return np.cumsum(x, dtype=x.dtype) if kind == "<u8" else x


#: What tasks send: entries of the matrix in `shard`, or (kind 1) rows of the share `share`, or (kind 2) rows of CHAIN as bytes.
SENT = "shard int, share long, kind int, n long, h binary, own binary, extra binary"
ENTRY, ROW, LINK = range(3)


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SENT.split(", ")])


def _reduced(k: np.ndarray, z: np.ndarray, v: np.ndarray, node: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of rows with first shingle k, size z and place v in node: rows (k, n, node, u) as longs, u being 0, 0 and n -1 for no edge.

    Classes of one k in order of size are chained wherever neighbours may be linked by size. What is between
    two kept rows of the chain is within the ratio of both, so that other tasks' rows needn't meet it: in each
    range of sizes that is no wider than the ratio, the first and last stay."""
    o = np.lexsort((z, k))
    k, z, v = k[o], z[o], v[o]
    same = k[1:] == k[:-1]
    link = same & (z[1:] * num <= z[:-1] * den)
    e = C.forest(v[:-1][link], v[1:][link]) if link.any() else C.NO_EDGE
    cell = np.floor(np.log(z) / (np.log(den / num) * 0.9999)) if den > num else z
    first = np.concatenate([[True], ~same | (cell[1:] != cell[:-1])])
    keep = np.flatnonzero(first | np.concatenate([first[1:], [True]]))
    out = np.zeros((len(keep) + len(e), 6), np.int64)
    out[: len(keep), 0], out[: len(keep), 1], out[: len(keep), 2:4] = k[keep].view(np.int64), z[keep], node[v[keep]]
    out[len(keep) :, 1], out[len(keep) :, 2:4], out[len(keep) :, 4:] = -1, node[e[:, 1]], node[e[:, 0]]
    return out


def _dealt(level, most: int, n: int, num: int, den: int, shards: int):
    """The entries of a task's rows, each class once, by shards of columns; the rows; and the chains of the most frequent shingles."""

    def done(sets, own, share):
        size, node = np.array([len(x) for x in sets], np.int64), np.array(own, np.int64).reshape(-1, 2)
        h, v = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        rank = level.value[(h >> U64(64 - BITS)).astype(np.int64)]
        often = rank >= most
        heavy = np.bincount(v[often], minlength=len(sets))
        place = share % shards
        out = [(place, share, ROW, len(sets), _packed(node.ravel(), "<i8"), _packed(size, "<i8"), _packed(heavy, "<i8"))]
        key = rank[often].astype(U64) << U64(56) | C.mix(h[often] + U64(99)) >> U64(8)
        at = v[often]
        o = np.lexsort((key, at))
        at, key = at[o], key[o]
        nth = np.arange(len(at)) - (np.cumsum(heavy) - heavy)[at]
        use = nth < (heavy - needed(size, num, den) + 1)[at]
        if use.any():
            c = _reduced(key[use], size[at[use]], at[use], node, num, den)
            out.append((place, share, LINK, len(c), _packed(c.ravel(), "<i8"), b"", b""))
        h, v = h[~often], v[~often]
        o = np.argsort(h)
        h, v = h[o], v[o]
        ends = np.searchsorted((h >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1))
        a = node[:, 0].astype("<i8").tobytes()
        out += [(k, share, ENTRY, hi - lo, _packed(h[lo:hi], "<u8"), _packed(v[lo:hi], "<u4"), a) for k, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if hi > lo]
        yield _message(out)

    def run(batches):
        sets, own, seen, total, share = [], [], set(), 0, TaskContext.get().partitionId() << 32
        for b in C.slices(batches, 2):
            for x in shingle_sets(b.column(2).to_pylist(), n):
                if not len(x) or (v := _node(x)) in seen:
                    continue
                seen.add(v)
                sets.append(x)
                own.append(v)
                total += len(x)
                if total >= ENTRIES:
                    yield from done(sets, own, share)
                    sets, own, total, share = [], [], 0, share + 1
        if sets:
            yield from done(sets, own, share)

    return run


def _counted(batches):
    """For each shard, its entries in columns of two classes or more, sent back to their shares with the columns' counts."""
    for (shard,), t in C.groups_of(batches, ["shard"]):
        kind = t.column("kind").to_numpy()
        rest = t.filter(pa.array(kind != ENTRY))
        if rest.num_rows:
            yield from rest.combine_chunks().to_batches()
        held = [r for r in t.filter(pa.array(kind == ENTRY)).to_pylist()]
        if not held:
            continue
        h = np.concatenate([_unpacked(r["h"], r["n"], "<u8") for r in held])
        own = [_unpacked(r["own"], r["n"], "<u4") for r in held]
        a = np.concatenate([np.frombuffer(r["extra"], "<i8")[v] for r, v in zip(held, own)])
        place = np.repeat(np.arange(len(held)), [len(v) for v in own])
        own = np.concatenate(own)
        o = np.lexsort((a, h))
        new = np.concatenate([[True], h[o][1:] != h[o][:-1]])
        differ = new | np.concatenate([[True], a[o][1:] != a[o][:-1]])  # a class that several tasks have counts once
        column = np.cumsum(new) - 1
        often = np.zeros(len(h), np.int64)
        often[o] = np.bincount(column, differ)[column].astype(np.int64)
        use = np.flatnonzero(often > 1)
        use = use[np.lexsort((h[use], place[use]))]
        ends = np.searchsorted(place[use], np.arange(len(held) + 1))
        out = []
        for r, lo, hi in zip(held, ends.tolist(), ends[1:].tolist()):
            if hi > lo:
                k = use[lo:hi]
                out.append((shard, r["share"], ENTRY, hi - lo, _packed(h[k], "<u8"), _packed(own[k], "<u4"), _packed(often[k], "<u4")))
        if out:
            yield _message(out)


def _firsts(num: int, den: int):
    """For each share, the chains of its rows' first shingles."""

    def run(batches):
        for _, t in C.groups_of(batches, ["share"]):
            found = []
            got = t.to_pylist()
            for r in got:
                if r["kind"] == LINK:
                    found.append(_unpacked(r["h"], 6 * r["n"], "<i8").reshape(-1, 6))
                elif r["kind"] == ROW:
                    m = r["n"]
                    node, size, heavy = _unpacked(r["h"], 2 * m, "<i8").reshape(-1, 2), _unpacked(r["own"], m, "<i8"), _unpacked(r["extra"], m, "<i8")
            held = [r for r in got if r["kind"] == ENTRY]
            if held:
                h, own, often = (np.concatenate([_unpacked(r[c], r["n"], k) for r in held]) for c, k in (("h", "<u8"), ("own", "<u4"), ("extra", "<u4")))
                own = own.astype(np.int64)
                at = prefix(own, often, h, size, heavy, num, den)
                if len(at):
                    found.append(_reduced(h[at], size[own[at]], own[at], node, num, den))
            for c in found:
                edge = c[:, 1] < 0
                pair = lambda x, none: pa.StructArray.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"], mask=pa.array(none))
                yield pa.record_batch([pa.array(c[:, 0].copy(), mask=edge), pa.array(c[:, 1].copy(), mask=edge), pair(c[:, 2:4], np.zeros(len(c), bool)), pair(c[:, 4:], ~edge)], ["k", "n", "node", "u"])

    return run


CHAIN = f"k long, n long, node {C.NODE}, u {C.NODE}"


def chains(base: DataFrame, level, most: int, entries: int, n: int, num: int, den: int) -> DataFrame:
    """Rows (k, n, node) of first shingles k that others may have, too, and edges (u, node) between those of a share."""
    shards = max(1, -(-entries // SHARD))
    sent = base.mapInArrow(C.released(_dealt(level, most, n, num, den, shards)), SENT)
    back = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(C.released(_counted), SENT)
    return back.repartition("share").sortWithinPartitions("share").mapInArrow(C.released(_firsts(num, den)), CHAIN)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrices of sets a and b: counts of common elements."""
    out = np.zeros((len(a), len(b)))
    va, ra = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    vb, rb = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    oa, ob = np.argsort(va, kind="stable"), np.argsort(vb, kind="stable")
    va, ra, vb, rb = va[oa], ra[oa], vb[ob], rb[ob]
    cols = np.intersect1d(va, vb)
    if not len(cols):
        return out
    a0, a1 = np.searchsorted(va, cols), np.searchsorted(va, cols, "right")
    b0, b1 = np.searchsorted(vb, cols), np.searchsorted(vb, cols, "right")
    na, nb = a1 - a0, b1 - b0
    few = na * nb <= SPARSE * SPARSE
    for lo in range(0, int(few.sum()), 200_000):  # column by column, all pairs of its rows
        ix = np.flatnonzero(few)[lo : lo + 200_000]
        n = na[ix] * nb[ix]
        col = np.repeat(np.arange(len(ix)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = ra[a0[ix][col] + k // nb[ix][col]]
        j = rb[b0[ix][col] + k % nb[ix][col]]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    many = np.flatnonzero(~few)
    width = max(16, min(2048, 8_000_000 // max(len(a), len(b))))
    for lo in range(0, len(many), width):
        ix = many[lo : lo + width]

        def strip(r, s, n, rows, ix=ix):
            m = np.zeros((rows, len(ix)), np.float32)
            c = np.repeat(np.arange(len(ix)), n[ix])
            k = np.arange(len(c)) - np.repeat(np.cumsum(n[ix]) - n[ix], n[ix])
            m[r[s[ix][c] + k], c] = 1
            return m

        out += strip(ra, a0, na, len(a)) @ strip(rb, b0, nb, len(b)).T
    return out


def _shingled(n: int):
    """The sets again, of the candidates only; texts whose hash is a candidate's but whose set isn't go."""

    def run(batches):
        for b in C.slices(batches, 0):
            sets = shingle_sets(b.column(0).to_pylist(), n)
            ok = [_node(x) == tuple(v) for x, v in zip(sets, C.pairs(b.column(1)).tolist())]
            yield pa.record_batch([pa.array([x.tobytes() for x in sets], pa.binary()), *b.columns[1:]], ["x", *b.schema.names[1:]]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(num: int, den: int):
    """For each pair of sub-blocks: edges of a spanning forest of its links, and links of each node."""

    def run(batches):
        for (_, _, i, j), t in C.groups_of(batches, ["ca", "cb", "bi", "bj"]):
            node, at = np.unique(C.pairs(t.column("node").combine_chunks()), return_index=True)  # a repeated row counts once
            block, copies, x = t.column("b").to_numpy()[at], t.column("copies").to_numpy()[at], t.column("x").take(pa.array(at)).to_pylist()
            sets = [np.frombuffer(v, U64) for v in x]
            o = np.lexsort((np.array([len(v) for v in sets]), block))
            node, block, copies, sets = node[o], block[o], copies[o], [sets[k] for k in o]
            p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(p) or not len(q):
                continue
            size = np.array([len(s) for s in sets], np.int64)
            edges, links = [], np.zeros(len(node), np.int64)
            step = max(256, 2_000_000 // len(q))
            for lo in range(0, len(p), step):  # rows in order of size: others than these are out of bounds
                r = p[lo : lo + step]
                c = q[(size[q] * den >= size[r[0]] * num) & (size[q] * num <= size[r[-1]] * den)]
                if not len(c):
                    continue
                o = overlaps([sets[k] for k in r], [sets[k] for k in c])
                hit = o * (den + num) >= num * (size[r][:, None] + size[c][None, :])
                u, v = np.nonzero(hit)
                u, v = r[u], c[v]
                if i == j:
                    u, v = u[u < v], v[u < v]
                if len(u):
                    links += np.bincount(u, copies[v], len(node)).astype(np.int64) + np.bincount(v, copies[u], len(node)).astype(np.int64)
                    edges.append(C.forest(u, v))
            e = np.concatenate(edges) if edges else C.NO_EDGE
            e = C.forest(*e.T) if len(e) else C.NO_EDGE
            own = np.flatnonzero(links)
            u, v = np.concatenate([node[e[:, 0]], node[own]]), np.concatenate([node[e[:, 1]], node[own]])
            yield pa.record_batch([C.nodes(u), C.nodes(v), pa.array(np.concatenate([np.zeros(len(e), np.int64), links[own]]))], ["u", "v", "links"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def classes(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, t, n, node), staged, t being a hash of the text; and of each class (node) comp, rep (smallest id), own_t (smallest t), copies and n_links."""
    base = _rows(docs, id_col, text_col)
    found = C.staged(base.mapInArrow(C.released(_features(n)), FEATURES), "features")
    level, most = levels(found)
    level = docs.sparkSession.sparkContext.broadcast(level)
    rows = found.filter("segment is null").select("id", "t", "n", "node")
    own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    nodes = rows.filter("node is not null").groupBy("node").agg(own.alias("own"), F.count("*").alias("copies"), F.first("n").alias("n"))
    nodes = C.staged(nodes.select("node", F.col("own.id").alias("rep"), F.col("own.t").alias("own_t"), "copies", "n"), "nodes")
    entries = nodes.agg(F.sum("n")).first()[0] or 0
    parts = C.staged(_near(chains(base, level, most, entries, n, num, den), num, den), "near")
    clusters = C.components(parts)
    many = clusters.select("node", F.col("comp").alias("cl")).join(nodes, "node")
    fewest = F.ceil(F.count("*") / F.greatest(F.lit(LEAST), F.least(F.lit(ROWS), F.count("*") / 4)))
    total = many.groupBy("cl").agg(F.greatest(fewest, F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    many = many.join(total, "cl").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = C.staged(many.select(F.col("rep").alias("i"), F.col("own_t").alias("h"), "node", "cl", "b", "blocks", "copies"), "candidates")
    if many.count() <= FEW:
        many = F.broadcast(many)
    x = base.join(many, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h")))
    x = x.select("text", "node", F.col("cl.a").alias("ca"), F.col("cl.b").alias("cb"), "b", "copies", "blocks")
    x = x.mapInArrow(C.released(_shingled(n)), f"x binary, node {C.NODE}, ca long, cb long, b int, copies long, blocks int")
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    x = x.withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o")
    x = x.repartition("ca", "cb", "bi", "bj").sortWithinPartitions("ca", "cb", "bi", "bj")
    links = C.staged(x.mapInArrow(C.released(_blocks(num, den)), f"{C.EDGES}, links long"), "links")
    comp = C.components(links.filter("links = 0").select("u", "v"))
    count = links.filter("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    whole = nodes.join(comp, "node", "left").join(count, "node", "left")
    whole = whole.select("node", F.coalesce("comp", "node").alias("comp"), "rep", "own_t", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    whole = C.staged(whole, "classes")
    C.dropped(parts, clusters, comp, links, nodes)
    return rows, whole


def _near(chain: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v): those of the tasks, and of neighbours in the order of size that share a first shingle and may be linked by size."""
    before = F.lag(F.struct("n", "node")).over(Window.partitionBy("k").orderBy("n", "node"))
    rows = chain.filter("k is not null").select("n", F.col("node").alias("v"), before.alias("p"))
    rows = rows.filter((F.col("p.node") != F.col("v")) & (F.col("n") * num <= F.col("p.n") * den)).select(F.col("p.node").alias("u"), "v")
    return chain.filter("u is not null").select("u", F.col("node").alias("v")).union(rows)


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with |A & B| / |A | B| >= num/den over their n-word shingles are linked.

    Returns for each row: id_col, n_shingles, component_id (smallest id reachable by links, its own
    included) and n_links (of the row's class: documents it links with, equal sets included).
    """
    rows, whole = classes(docs, n, num, den, id_col, text_col)
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    whole = whole.join(least, "comp").select("node", "component_id", "n_links")
    out = rows.select("id", "n", "node").join(whole, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each component of linked documents one: that with the smallest id (null last), then hash of the text.

    Rows without words are linked with nothing: all stay. Of rows with equal id and text one stays, the others being copies."""
    rows, whole = classes(docs, n, num, den, id_col, text_col)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "own_t")).alias("f")
    keep = whole.groupBy("comp").agg(first).select(F.col("f.rep").alias("i"), F.col("f.own_t").alias("h"))
    left = rows.join(keep, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h"))).groupBy("i", "h").agg(F.count("*").alias("rows"))
    empty = rows.filter("node is null").select(F.col("id").alias("i"), F.col("t").alias("h")).distinct().withColumn("rows", F.lit(1).cast("long"))
    left = C.staged(left.union(empty), "kept")
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("i")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("h"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    once = packed.join(left.filter("rows = 1"), on, "left_semi").select("row.*")
    twice = left.filter("rows > 1")
    if twice.isEmpty():  # saves a second reading of docs
        return once
    more = packed.join(twice.select("i", "h"), on).groupBy("i", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(more.select("row.*"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), k AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
e AS (SELECT doc_id, n, unnest(sh) AS g FROM k),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL
), l AS (SELECT u, v FROM p WHERE 100 * o >= 90 * (nu + nv - o)),
r AS (SELECT doc_id AS d, doc_id AS c FROM k UNION SELECT r.d, l.v FROM r JOIN l ON l.u = r.c),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d), c AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links
FROM k JOIN m ON m.d = k.doc_id LEFT JOIN c ON c.u = k.doc_id
"""


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(C.documents(spark, sf_dir))
