"""Cluster-side helpers: checkpoints in the shared folder, sizes, sub-partition counts, row keys."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a row group, where rows are large.
LARGE = 32


def shared_folder(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "spanloom-checkpoints"))


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts in Arrow batches of the default 10,000 rows take memory for nothing: lower it where the session leaves the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_reads(spark: SparkSession, rows: int = 256) -> None:
    """Spark's Parquet reader holds 4,096 rows a task on the heap, unseen by its memory manager: with whole texts lower it where the session leaves the default."""
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", "4096") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(spark: SparkSession, total_bytes: int, per_bucket: int = 24 << 20) -> int:
    """Hash buckets such that each holds about per_bucket bytes; at least one for each shuffle partition."""
    return max(partitions(spark), math.ceil(total_bytes / per_bucket))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    small_batches(docs.sparkSession)
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def annotated(docs: DataFrame, column: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """docs with further columns (new name, SQL type) that a function of one column's Arrow array gives; whatever the other columns are called.

    make() runs once per task and returns the function.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(column)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(f"x{i}", T._parse_datatype_string(t)) for i, (_, t) in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(b.column(at))], schema.names)

    return docs.toDF(*schema.names[: len(docs.columns)]).mapInArrow(run, schema).toDF(*docs.columns, *(name for name, _ in fields))


def written(df: DataFrame, hashes: bool = False, large: bool = False) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back. hashes: most values are hashes, of which no dictionary is tried.

    large: rows are large. Spark's reader holds up to 4,096 rows of a row group at once, so groups have LARGE rows at most;
    else all of a file is held.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    groups = {"parquet.block.row.count.limit": LARGE} if large else {}
    df.write.options(**groups).option("compression", "lz4_raw" if hashes else "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(out)
    return spark.read.parquet(out)


def discard(table: DataFrame) -> None:
    """Removes a table that `written` gave, once nothing reads it any more."""
    jvm = table.sparkSession.sparkContext._jvm
    for name in {n.rsplit("/", 1)[0] for n in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("table-"):
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
