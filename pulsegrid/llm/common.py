"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python task is sent at a time.
BATCH_BYTES = 2 << 20
#: Words are runs of anything but ASCII characters that are neither digits nor lower-case letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder serves a local
    session; a cluster's executors could not read that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    if not base or spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-shared-"))
    return base or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: like `materialize`, in compressed columns, of which later
    steps read what they need."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Python tasks of this session get at most so many bytes at a time (one row at least), which bounds their
    memory, and that of the JVM beside them, where rows hold texts. A smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: functions over Arrow batches do not take names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, read from one JSON literal: no Python runs for it."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")))


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """text with A to Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's columns: repeated rows share it."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def wide_key(*columns: str) -> Column:
    """The same with 128 bits, as two longs in a struct: no two different rows meet, in any number."""
    shown = [F.struct(F.col(c).isNull(), F.col(c)) for c in columns]
    return F.struct(F.xxhash64(*shown).alias("a"), F.xxhash64(F.lit(1), *shown).alias("b"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
