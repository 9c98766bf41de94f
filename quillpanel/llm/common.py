"""What the operators of this subpackage share: tables, names, durable cuts of lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine (each worker asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_keys(columns: list[Column]) -> tuple[Column, Column]:
    """Two hashes that tell rows apart by the values and the nulls of these columns."""
    none = [c.isNull() for c in columns]
    return F.xxhash64(F.lit(1), *none, *columns), F.xxhash64(*reversed(columns), *none, F.lit(2))


def word_slices(data: bytes, overlap: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data, A-Z lower-cased, slice by slice; each slice starts with the last words of the one before.

    Words are parted by blanks 9 to 13 and 32. A row of overlap + 1 words lies whole in just one slice.
    """
    carry: list[bytes] = []
    at, end = 0, len(data)
    while at < end:
        cut = min(end, at + size)
        if cut < end and (m := _BLANK.search(data, cut)) is not None:
            cut = m.start()
        elif cut < end:
            cut = end
        words = carry + data[at:cut].lower().split()
        yield words
        carry = words[len(words) - overlap :] if len(words) > overlap else words
        at = cut


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only on one machine, where that is unset, a folder of this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "quillpanel-checkpoints")
    return f"{named}/quillpanel-{context.applicationId}"


#: Folders written by durable and not yet removed, oldest first.
_written: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table where every executor can read it again.

    The folder goes with discard or release, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def written() -> list[str]:
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove what durable wrote to these folders; nothing may read it any more."""
    for path in paths:
        if path in _written:
            _written.remove(path)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_but(spark: SparkSession, before: list[str], *needed: DataFrame) -> None:
    """Remove what was written since before, but for the tables needed."""
    keep = {*before, *(df.durable_path for df in needed)}
    discard(spark, [p for p in written() if p not in keep])


def release(spark: SparkSession) -> None:
    """Remove every table that this process's operators wrote: to be called when their results were read."""
    discard(spark, written())


#: Keys that a join spreads (any other has at most a 1,000th of the rows), and tasks for each of them.
HOT, SALTS = 1000, 64


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], weight: str, salt: Column) -> DataFrame:
    """many joined to few (one row a key, weight its rows in many); the heaviest keys are salted.

    What is broadcast are the HOT heaviest keys at most, whatever the size of few. They are picked
    once and written, so that both sides salt the same keys even if a task runs again.
    """
    hot = durable(few.orderBy(F.desc(weight), *keys).limit(HOT).select(*keys, F.lit(True).alias("hot")))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(salt, F.lit(SALTS))).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).otherwise(F.array(F.lit(0).cast("long")))
    right = few.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*keys, "salt"]).drop("salt")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def groups_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))
