"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROOT = str(Path(__file__).resolve().parents[2])

#: Stands for a NULL id inside an operator; results show NULL again.
NULL_ID = -(2**63)

#: Characters of a text that bounds of a sort by text hold.
_START = 256

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """mapInArrow whose Python workers can import this package where it isn't installed."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return df.mapInArrow(fn, schema)


def cut_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder.

    Spark itself reads spark.checkpoint.dir at its start. Only a local session without one gets a
    folder of its own; on a cluster that would be lost with its machine, so it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder that spark.checkpoint.dir names."""
    cut_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of this application, which all executors share.

    It is Spark's own subfolder of spark.checkpoint.dir and goes when that is cleared.
    """
    cut_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text): NULL_ID for a NULL id, an empty text for a NULL one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def _repeated(rows: DataFrame) -> bool:
    """Does an id repeat? Ids alone are counted, so that texts are shuffled only where they must."""
    return rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def in_order(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, *more) with a row per document, sorted by doc_id and text, within partitions and over them.

    Rows that are equal in doc_id and text are one document, with the least of what comes along;
    rows that differ in text are several, and so is each row with a NULL id (NULL_ID, the smallest).
    """
    rows = _rows(docs, *more)
    if not _repeated(rows):
        return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    names = rows.columns[2:]
    # Of rows without an id each is kept.
    apart = rows.withColumn("_nth", F.when(F.col("doc_id") == NULL_ID, F.monotonically_increasing_id()).otherwise(-1))
    single = apart.groupBy("doc_id", "text", "_nth").agg(*(F.min(c).alias(c) for c in names)) if names else apart.distinct()
    # Bounds of parts hold the start of a text only; short texts that are equal may go to several.
    start = F.substring("text", 1, _START)
    nth = F.when(F.length("text") <= _START, F.col("_nth")).otherwise(F.lit(2**63 - 1))
    return single.repartitionByRange("doc_id", start, nth).sortWithinPartitions("doc_id", "text", "_nth").drop("_nth")


def keyed(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a row per document (see in_order), and what its doc_id stands for.

    Ids that don't repeat stand for themselves (NULL_ID for NULL), and the second is None. Else
    they are numbers in the order of (doc_id, text), and it is (doc_id, given, *more).
    """
    rows = _rows(docs)
    if not _repeated(rows):
        return rows, None
    placed = cut(in_order(docs, *more))
    counted = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_at"))
    sizes = counted.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = counted.join(before, "_part").withColumnRenamed("doc_id", "given").withColumn("doc_id", F.col("_base") + F.col("_at"))
    return numbered.select("doc_id", "text"), numbered.select("doc_id", "given", *placed.columns[2:])


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """df with the ids that the numbers in its columns stand for (see keyed)."""
    if names is None:
        return df
    order = df.columns
    for c in columns or ("doc_id",):
        given = names.select(F.col("doc_id").alias(c), F.col("given").alias("_given"))
        df = df.join(given, c).drop(c).withColumnRenamed("_given", c)
    return df.select(*order)


def with_ids(docs: DataFrame) -> DataFrame:
    """(_id, _row): a doc_id of its own for each document (see keyed), and the row with all its columns.

    The caller's columns stay inside _row, whatever their names.
    """
    row = F.struct(*docs.columns).alias("_row")
    own, names = keyed(docs, row)
    if names is None:
        return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), row)
    return names.select(F.col("doc_id").alias("_id"), "_row")


def shown_id(name: str = "doc_id"):
    """The id as the caller gave it."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, NULL as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about limit bytes of text (one row may hold more)."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        total += size or 0
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def with_texts(docs: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with the texts that an operator, (doc_id, text) to (doc_id, text), makes of them and, where there is one, n_chars to match.

    Other columns come along without the old texts; there is a row per document (see in_order).
    """
    names = docs.columns
    own = with_ids(docs)
    texts = texts_of(own.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")))
    rest = own.select("_id", F.struct(*(F.col(f"_row.`{c}`").alias(c) for c in names if c not in ("text", "n_chars"))).alias("_rest"))
    joined = rest.join(texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_id")
    kinds = dict(docs.dtypes)
    made = {
        "text": F.col("_text").alias("text"),
        "n_chars": F.length("_text").cast(kinds.get("n_chars", "long")).alias("n_chars"),
    }
    return joined.select(*(made.get(c, F.col(f"_rest.`{c}`").alias(c)) for c in names))
