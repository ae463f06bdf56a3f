"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a document: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: The setting of Spark for the bytes of a batch of rows that Python gets at once, and a value that keeps tasks small.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session, spark.checkpoint.dir; where that is unset, a temporary one on a single machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='marlstone-')}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of tables that are no longer used; it does so when the driver collects
    its garbage, which may be long after a loop of many small tables."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> bool:
    """Sets BATCH to BATCH_BYTES for the session, and says so, unless the session has a value of its own.

    A task holds a batch several times over, outside of the heap of the JVM and in Python, and neither gives that memory back; with
    Spark's own 64 MB that is several hundred MB of an executor. A longer row is a batch by itself, so no row is cut.
    """
    if spark.conf.get(BATCH, None) is not None:
        return False
    spark.conf.set(BATCH, str(BATCH_BYTES))
    return True


def packed(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and more of df, and _doc, a struct of all its columns, whose names then clash with none."""
    return df.select("doc_id", "text", *more, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_doc"))


def keyed(column: str):
    """A non-null key that tells null from every string, for joins and windows."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("~"))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a checkpointed table has at most so many rows; only then may it be broadcast."""
    return df.count() <= rows


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", keys: int = 64) -> DataFrame:
    """left joined to right, which has a key once, where a key may hold any share of left.

    Keys with over a thousandth of left's rows, of which there are a thousand at most, are dealt out over so many keys by a
    hash of left's column spread. left is read twice, so it is a table or a checkpoint.
    """
    counted = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = F.broadcast(counted.filter(F.col("_n") > total / 1000).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(keys))).otherwise(F.lit(0)).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(keys - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def map_text(df: DataFrame, carry: list[str], text: str, fn, added: str, chunk_bytes: int = 8_000_000) -> DataFrame:
    """Columns carry of df as they are, and the columns added (DDL) that fn makes from a list of texts (null: None).

    fn gets texts of about chunk_bytes together at most, or a single longer one, and returns a list for each added column.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in carry] + new.fields)
    kinds = [f.type for f in to_arrow_schema(new)]
    names = schema.names

    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(len(carry))), 0).to_pylist()
            start, held = 0, 0
            for k, n in enumerate([*sizes, None]):
                if n is None or held and held + n > chunk_bytes:
                    if k > start:
                        part = batch.slice(start, k - start)
                        made = fn(part.column(len(carry)).to_pylist())
                        arrays = [pa.array(x, type=kind) for x, kind in zip(made, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *arrays], names=names)
                    start, held = k, 0
                held += n or 0

    import pyarrow.compute  # noqa: F401  binds pa.compute for run

    plain = df.select(*carry, F.col(text).cast("string").alias("_text to map"))
    return plain.mapInArrow(run, schema)
