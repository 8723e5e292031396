"""What the operators share: shared folders, text normalisation, array-of-words hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id where ids are ordered: below every other.
NO_ID = -(2**63)


#: The folders made in this process, until clean_up().
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors all see, under spark.checkpoint.dir. That is set here only where it is unset and the master is
    local, as in tests: on a cluster a folder of the driver's own machine is none that executors see."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="varloom-")
        spark.sparkContext.setCheckpointDir(top)
    _made.append(f"{top.rstrip('/')}/varloom-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> None:
    """Deletes the folders made in this process. DataFrames that the operators gave read from them until their rows are written."""
    while _made:
        delete(spark, _made.pop())


def written(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet under path, read again: lineage ends there, and a lost executor costs no recomputation."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is many times faster and the same on pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of DataFrames that nothing refers to any more: what follows reads written tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
