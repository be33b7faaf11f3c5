"""Mixing sources to target weights by capped water-filling.

The mix takes `share` of all sizes (words), shared out by the sources' weights. A source gives at
most `cap` times its size; the excess is reshared by weight until no target is above its cap. In
order of cap / weight this is one pass: the first source whose cap is above its share sets the
level for all that follow.

A target is target / source_size repetitions of each document: whole ones for all, and one more for
those that come first in a seeded order (md5 of seed and doc_id, or of the text where that is null) until the
rest of the target is reached; a document is taken if its middle lies before that point, so a source's taken
words differ from its target by half a document at most (by half of all rows with one id, where ids repeat).
So a source's place in the order is all that its documents need: texts are read, but never dealt out. The prefix
sums run over 4096 buckets of the order a source, so no source is sorted in one place; equal rows are taken
alike, so that reruns agree.

Null text: size 0. Null source: a source of its own, last. Null or repeated doc_ids: allowed; rows
with the same id have the same place in the order. No words at all: targets 0. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidlens.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of rows (source, size): source, source_size, target. One row a source, which are few; in a single partition."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("free", F.col("most") / F.col("w") > F.col("level"))
    first = F.min(F.when(F.col("free"), F.struct("rank", "level"))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("most")).otherwise(F.col("first.level") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


#: Sources whose cuts (some 100 bytes each) go to all tasks.
SOURCES = 100_000


def _placed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with __source, __size, __skey and __key: source, words, source as a key without nulls, place in the order."""
    text, name = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("string")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name, F.concat(F.lit("t"), text), F.lit("t"))))
    source = F.col(f"`{source_col}`").cast("string")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], source.alias("__source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("__skey"), place.alias("__key"))


def cuts(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of rows (__source, __size, __skey, __key): for each source __skey, source_size, target, whole (repetitions of all) and cut, up to which one more is taken."""
    t = targets(sizes.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = C.staged(t.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__skey"), "source_size", "target", whole.alias("whole")), "targets")
    few = F.broadcast(t) if t.count() <= SOURCES else t
    points = sizes.groupBy("__skey", "__key").agg(F.sum("__size").alias("s")).withColumn("bucket", F.substring("__key", 1, 3))
    base = points.groupBy("__skey", "bucket").agg(F.sum("s").alias("sum"))
    base = base.select("__skey", "bucket", (F.sum("sum").over(Window.partitionBy("__skey").orderBy("bucket")) - F.col("sum")).alias("base"))
    upto = F.sum("s").over(Window.partitionBy("__skey", "bucket").orderBy("__key"))
    points = points.withColumn("upto", upto).join(base, ["__skey", "bucket"]).join(few, "__skey")
    taken = F.col("base") + F.col("upto") - F.col("s") / 2 < F.col("target") - F.col("whole") * F.col("source_size")
    cut = points.filter(taken).groupBy("__skey").agg(F.max("__key").alias("cut"))
    return C.staged(t.join(cut, "__skey", "left"), "cuts")


def _with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    rows = rows.join(F.broadcast(cut) if cut.count() <= SOURCES else cut, "__skey")
    return rows.withColumn("times", F.col("whole") + F.coalesce(F.col("__key") <= F.col("cut"), F.lit(False)).cast("long"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row its id as `id`, with size, source_size, target, times (repetitions) and taken (size * times). Texts are read once."""
    rows = _placed(docs, seed, id_col, text_col, source_col).select(F.col(f"`{id_col}`").alias("id"), "__source", "__size", "__skey", "__key")
    rows = C.staged(rows, "sizes")
    rows = _with_cuts(rows, cuts(rows, weights, share, cap))
    return rows.select("id", F.col("__size").alias("size"), "source_size", "target", "times", (F.col("__size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken (documents without words never)."""
    rows = _placed(docs, seed, id_col, text_col, source_col)
    cut = cuts(C.staged(rows.select("__source", "__size", "__skey", "__key"), "sizes"), weights, share, cap)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__skey", "__key", F.col(f"`{text_col}`").rlike(WORD).alias("__any"))
    packed = _with_cuts(packed.filter("__any"), cut).filter("times > 0")
    return packed.select("__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))) AS k FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, row_number() OVER o AS r, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / w, source NULLS LAST)
), f AS (SELECT min(r) AS r, min_by(level, r) AS level FROM l WHERE most / w > level),
t AS (SELECT source, source_size, CASE WHEN f.r IS NULL OR l.r < f.r THEN most ELSE f.level * w END AS target FROM l CROSS JOIN f),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) - sum(d.size) OVER (PARTITION BY d.source, d.k) / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows = mix(C.documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
