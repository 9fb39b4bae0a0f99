"""What the operators of this subpackage share: the shared folder, tables, and Arrow batches cut by bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a worker holds as Python objects at one time, in characters (one longer text is taken alone).
BLOCK_CHARS = 4 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Where the setting is empty on a single machine (tests), a folder of this machine is set for the session; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes, where the session sets no numbers of its own."""
    own = spark._jsparkSession.sessionState().conf().settings()
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not own.containsKey(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    return written_at(df, scratch(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The tables that a computation writes in the shared folder; on leaving, all but those `kept` are deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch(self.spark, name))
        return written_at(df, self.paths[-1])

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted over its partitions by these columns (nulls first), with quern_part and quern_within, the partition and the place in it.

    To be written before it is used twice, as the bounds of the parts may differ from run to run; the order doesn't.  Rows that
    agree in all of `order` are told apart by where they were read, so many equal ones spread over several parts.
    """
    rows = df.withColumn("quern_read", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "quern_read"]]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("quern_read")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumns({"quern_part": F.spark_partition_id(), "quern_within": within})


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """The columns of the batches as Python lists, in blocks of at most `most` characters of column `text`."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield [c.to_pylist() for c in batch.slice(start, i - start).columns]
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield [c.to_pylist() for c in batch.slice(start).columns]


def give_back() -> None:
    """Returns freed memory to the system: workers and the driver live on after a stage, and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a worker that yields dicts of columns; schema is Spark's DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(df.sparkSession)
    to = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in to for x in [columns[f.name]]], schema=to)
            del columns
        give_back()

    return df.mapInArrow(run, schema)
