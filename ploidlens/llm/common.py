"""Helpers shared by the corpus operators: input, shared tables, word and id arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
NO_EDGE = np.zeros((0, 2), np.int64)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(24 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master only, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not re.match(r"local($|\[)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="ploidlens-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage.

    The table survives the loss of executors. It is deleted when the application ends, or by dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ploidlens/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _folder(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        where, fs = _folder(df.sparkSession, df._staged_at)
        fs.delete(where, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one after the other, and the offsets of the documents."""
    ends = np.cumsum([0] + [len(d) for d in docs])
    if not ends[-1]:
        return np.zeros(0, U64), ends
    flat = np.empty(ends[-1], object)
    flat[:] = [w for d in docs for w in d]
    codes, uniq = pd.factorize(flat)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, uniq), U64, len(uniq))[codes], ends


def slices(batches, column: int = 1, most: int = 4 << 20):
    """The rows of Arrow batches in smaller ones, of about `most` bytes of text or one longer text.

    A text's words take some ten times its size as Python objects, so this bounds what a worker holds.
    """
    for b in batches:
        size = pc.fill_null(pc.cast(pc.binary_length(b.column(column)), pa.int64()), 0).to_numpy()
        cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def released(run):
    """run, after which the worker, that Spark keeps for later tasks, gives its free memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def groups_of(batches, keys: list[str]):
    """Runs of rows with equal keys of a sorted stream of Arrow batches, as (key, table)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(b.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s].item() for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges (parent, node) of a spanning forest of the graph with edges u-v."""
    nodes, ix = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = ix[: len(u)], ix[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[own]], nodes[own]], 1) if len(own) else NO_EDGE


#: Edges of a node that its join isn't left to one task for, and nodes (32 bytes each) that go to all tasks at most.
HUB, HUBS = 1000, 1_000_000
NODE = "struct<a:bigint,b:bigint>"
EDGES = f"u {NODE}, v {NODE}"
_PAIR = np.dtype([("a", np.int64), ("b", np.int64)])


def pairs(column) -> np.ndarray:
    """An Arrow column of nodes as a structured array."""
    out = np.empty(len(column), _PAIR)
    for k, name in enumerate("ab"):
        out[name] = column.field(k).to_numpy()
    return out


def nodes(x: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in "ab"], ["a", "b"])


def local_forest(batches):
    """mapInArrow: of the edges (u, v) that a task holds, a spanning forest by blocks."""
    held, n = [], 0

    def done():
        node, at = np.unique(np.concatenate([x for e in held for x in e]), return_inverse=True)
        ends = np.cumsum([0] + [len(x) for e in held for x in e])
        cut = [at[a:b] for a, b in zip(ends, ends[1:])]
        f = forest(np.concatenate(cut[::2]), np.concatenate(cut[1::2]))
        return pa.record_batch([nodes(node[f[:, 0]]), nodes(node[f[:, 1]])], ["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((pairs(b.column(0)), pairs(b.column(1))))
            n += b.num_rows
        if n >= 1_000_000:
            yield done()
            held, n = [], 0
    if n:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), nodes of two longs: one row (node, comp) for each node that has an edge.

    Alternates large-star and small-star steps until the edges no longer change; each step joins
    with a minimum for each node, and is staged; the table before goes. No component is ever gathered
    in one place: nodes with over HUB edges (of which there are fewer than edges / HUB) are joined by sending their
    minima to all tasks, if they are HUBS at most. comp is the smallest node. No edges: no rows. Loops and repeated
    edges don't matter.
    """
    now = staged(edges.select("u", "v").filter("u <> v").mapInArrow(released(local_forest), EDGES).distinct(), "edges")
    before, edges = None, now.count()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        later = both.filter("v > u")
        if HUB < edges <= HUB * HUBS // 2:
            hubs = least.filter(F.col("n") > HUB).select("u", F.col("m").alias("h"))
            later = later.join(F.broadcast(hubs), "u", "left")
            large = later.filter("h is not null").select("v", F.col("h").alias("m")).union(later.filter("h is null").join(least, "u").select("v", "m"))
        else:
            large = later.join(least, "u").select("v", "m")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, now = now, staged(small, "edges")
        dropped(last)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before, edges = sign, sign[0]
    star = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    out = staged(star.union(star.select(F.col("comp").alias("node"), "comp").distinct()), "components")
    dropped(now)
    return out
