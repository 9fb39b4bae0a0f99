"""Tables by which loops hand on their state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that carries texts to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes, where the session sets no numbers of its own."""
    own = spark._jsparkSession.sessionState().conf().settings()
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not own.containsKey(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def step(df: DataFrame, block: int | None = None) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir (on a single machine a temporary one where that is unset) and read again.

    block: the bytes of a row group, where Parquet's own are too many.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.size": block} if block else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
