"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tokenweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; options: of its files."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], name: str = "running", ranged: bool = False, **options) -> DataFrame:
    """df with the sums of integer columns over all rows before in the given order (a total order), as sums names them: by range partitions and carried sums, so no task sorts all rows.

    The rows move once, into their ranges, and not at all if df is ranged by the order already; they are summed there before they are written.
    """
    parts = (df if ranged else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())

    def local(batches):
        before = dict.fromkeys(sums, 0)
        for b in batches:
            upto = []
            for c in sums:
                x = np.asarray(b.column(b.schema.get_field_index(c)).fill_null(0)).astype(np.int64)
                upto.append(pa.array(before[c] + np.cumsum(x) - x, pa.int64()))
                before[c] += int(x.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, *upto], names=[*b.schema.names, *[f"__l_{c}" for c in sums]])

    schema = StructType([*parts.schema.fields, *[StructField(f"__l_{c}", LongType()) for c in sums]])
    parts = written(parts.mapInArrow(local, schema), name, **options)  # partition numbers differ between two runs of a plan
    every = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])  # one row a partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("__p", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    out = parts.join(F.broadcast(carried), "__p")
    return out.withColumns({to: F.col(f"__b_{c}") + F.col(f"__l_{c}") for c, to in sums.items()}).drop("__p", *[f"__{x}_{c}" for x in "bl" for c in sums])
