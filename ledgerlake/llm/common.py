"""Helpers of the document operators: readers, Arrow passes, row numbers, connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ledgerlake.workspace import written

#: Rows of an Arrow batch: whole texts are long, so a batch of the default 10,000 rows could be large.
BATCH_ROWS = 1_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table of documents; sessions that run these operators get small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/documents.parquet")


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null stays null."""
    return F.col(column).cast("binary")


def held_out(parts: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``rest``; rows without an id are never learned from."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.col("doc_id").isNull() | (F.pmod(digest, F.lit(parts)) == rest)


def aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], used: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """``work`` on ``docs`` whose columns but the ``used`` ones bear names that clash with nothing.

    ``work`` keeps the columns it gets; the result has the columns of ``docs`` by their own names.
    """
    away = {c: f"__column{i}" for i, c in enumerate(docs.columns) if c not in used}
    done = work(docs.withColumnsRenamed(away))
    return done.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def extended(schema: StructType, **columns: DataType) -> StructType:
    """``schema`` and further columns, named with their types."""
    return StructType([*schema.fields, *[StructField(n, t) for n, t in columns.items()]])


def numbered(df: DataFrame, keys: Sequence[str], name: str, label: str) -> DataFrame:
    """Number the rows of each key from 0, without gaps, however many rows one key has.

    The rows are written once with an id of their own, whose upper bits name the writing task. Rows
    are counted per (key, task); running sums over these few counts give each task the place where it
    begins, and a row number within (key, task) does the rest. No task sees a whole hot key.
    """
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("__task", F.shiftright("__row", 33))
    counts = rows.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__task").alias("__t"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"),
    )
    same = F.col("__task") == F.col("__t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "__task").orderBy("__row")) - 1
    placed = rows.withColumn("__place", place).join(begins, same)
    return placed.select(*df.columns, (F.col("__begin") + F.col("__place")).cast("long").alias(name))


def components(links: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Connected components of undirected links between long ids: rows (node, root), root the least id.

    Alternates large-star and small-star steps until the links no longer change; each step is written,
    so lineage stays short. A step keeps at most one link per (node, neighbour); joins on a hub are left
    to adaptive execution, which splits them. Nodes without a link have no row; null ids are ignored.
    """
    edges = written(_directed(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), label)
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct().toDF("node", "root")
            )
        state = now


def _directed(pairs: DataFrame) -> DataFrame:
    """Links from the larger id ``u`` to the smaller ``v``, each once."""
    ordered = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(moved.union(least.select("u", F.col("m").alias("v"))))
